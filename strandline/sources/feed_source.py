"""The change feed as a streaming source: a batch holds what is newer than the last one's newest entry.

A feed is a folder of pages, newest first: page 1, 2, ... as ``page=N/*`` or
``N.*``, with entries as JSON lines (``format`` json) or as a captured HTML page
(``html``). The offset is the newest entry that was seen, the watermark. A batch
reads pages in order up to the watermark and opens none behind it, as the feed
only grows at its head; without a watermark (a first run) all pages are read, in
parallel. A watermark that is no longer in the feed is looked for to the end.

A batch that is replayed after a failure is bounded by entries, not by pages:
what came in since then stands before its first entry and is left to the next
batch. The folder lies on a file system that all executors mount.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from strandline.session import drop_folder, shared_folder, written

SCHEMA = "slug string, rev_no bigint, ts bigint, author string"
COLUMNS = ("slug", "rev_no", "ts", "author")
#: Pages that one partition of a first run reads.
PAGES = 50


def page_files(root: str) -> list[list[str]]:
    """The files of each page, newest page first."""
    found: dict[int, list[str]] = {}
    for name in os.listdir(root) if os.path.isdir(root) else ():
        number = name.removeprefix("page=").split(".")[0]
        if not number.isdigit():
            continue
        path = os.path.join(root, name)
        inside = sorted(os.path.join(path, x) for x in os.listdir(path) if not x.startswith((".", "_"))) if os.path.isdir(path) else [path]
        found.setdefault(int(number), []).extend(inside)
    return [found[n] for n in sorted(found)]


def entries(paths: list[str], kind: str) -> list[tuple]:
    """The entries of one page in the feed's order."""
    out = []
    for path in paths:
        with open(path, encoding="utf-8-sig") as file:
            text = file.read()
        if kind == "html":
            from strandline.functions import trees

            out += [(slug, rev_no, ts, None if author is None else str(author)) for slug, rev_no, ts, author in trees._change_rows(text)]
        else:
            out += [tuple(json.loads(line).get(c) for c in COLUMNS) for line in text.splitlines() if line]
    return out


class _Pages(InputPartition):
    """Pages to read: from the newest to the watermark, or a run of pages of a first batch."""

    def __init__(self, pages: list[list[str]], kind: str, newest: tuple | None, oldest: tuple | None):
        self.pages, self.kind, self.newest, self.oldest = pages, kind, newest, oldest


class FeedReader(DataSourceStreamReader):
    def __init__(self, root: str, kind: str):
        self.root, self.kind = root, kind

    def initialOffset(self) -> dict:
        return {"newest": None}

    def latestOffset(self) -> dict:
        """The newest entry: the first of the first page that has any."""
        for page in page_files(self.root):
            for entry in entries(page, self.kind):
                return {"newest": list(entry)}
        return {"newest": None}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        newest, oldest = (None if x["newest"] is None else tuple(x["newest"]) for x in (end, start))
        if newest is None or newest == oldest:
            return []
        pages = page_files(self.root)
        if oldest is not None:
            return [_Pages(pages, self.kind, newest, oldest)]
        # The first batch has no lower end. What has come in since its offset was taken is on pages before its first entry.
        first = next((k for k, page in enumerate(pages) if newest in entries(page, self.kind)), None)
        return [_Pages(pages[k : k + PAGES], self.kind, newest if k == first else None, None) for k in range(first or 0, len(pages), PAGES)]

    def read(self, partition: _Pages):
        begun = partition.newest is None
        for page in partition.pages:
            for entry in entries(page, partition.kind):
                begun = begun or entry == partition.newest
                if partition.oldest is not None and entry == partition.oldest:
                    return
                if begun:
                    yield entry

    def commit(self, end: dict) -> None:
        """Nothing is held for a batch."""


class ChangeFeed(DataSource):
    """``spark.readStream.format("change_feed").option("path", folder)``; option format: json (the default) or html."""

    @classmethod
    def name(cls) -> str:
        return "change_feed"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FeedReader(self.options["path"].removeprefix("file://"), self.options.get("format", "json"))


def feed_source(spark: SparkSession, path: str, kind: str = "json") -> DataFrame:
    spark.dataSource.register(ChangeFeed)
    return spark.readStream.format("change_feed").option("path", path).option("format", kind).load()


def write_feed(feed: DataFrame, path: str, page_rows: int = 200) -> None:
    """feed (slug, rev_no, ts, author) as pages of JSON lines, newest first: by ts, then rev_no, then slug, falling.

    Ranks come from counts by range partition, so that no task sees the whole feed.
    """
    order = [F.desc("ts"), F.desc("rev_no"), F.desc("slug")]
    ranged = feed.select(*COLUMNS).repartitionByRange(*order).sortWithinPartitions(*order)
    # Ranges are sampled anew by every job: places are written down before anything is counted by them.
    folder = shared_folder(feed.sparkSession, "feed")
    placed, _ = written(ranged.withColumn("place", F.monotonically_increasing_id()), folder)
    part = F.shiftright("place", 33)
    counts = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row a partition
    ranked = placed.withColumn("part", part).join(F.broadcast(before), "part")
    ranked = ranked.withColumn("rank", F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1))
    rows = ranked.select(F.to_json(F.struct(*COLUMNS)).alias("value"), (F.floor(F.col("rank") / page_rows) + 1).cast("long").alias("page"), "rank")
    rows.repartition("page").sortWithinPartitions("page", "rank").select("value", "page").write.partitionBy("page").text(path)
    drop_folder(feed.sparkSession, folder)
