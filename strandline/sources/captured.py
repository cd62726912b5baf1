"""Captured answers of both platforms as rows: pages, sources, change pages, and the JSON service."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import text as X
from strandline.functions import trees
from strandline.sources.legacy import LOG, envelope


def page_rows(captured: DataFrame) -> DataFrame:
    """page_id (null: none), title, tags, html of captured pages (html); a byte order mark is cut."""
    clean = captured.select(X.without_bom(F.col("html")).alias("html"))
    return clean.select(X.page_id(F.col("html")).try_cast("bigint").alias("page_id"), trees.titles(F.col("html"))["page"].alias("title"), trees.page_tags(F.col("html")).alias("tags"), "html")


def source_rows(captured: DataFrame) -> DataFrame:
    """rev_id, content and refused of captured source answers (rev_id, answer): an envelope around the page's source."""
    opened = captured.select("rev_id", envelope(F.col("answer")).alias("e"))
    return opened.select("rev_id", trees.page_source(F.col("e.body")).alias("content"), F.col("e.refused").alias("refused"))


def attachment_rows(spark: SparkSession, path: str) -> DataFrame:
    """name, content and media type of captured attachments, a file each."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("name"), "content").withColumn("media", trees.sniff(F.col("content"), F.col("name")))


def change_pages(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """slug, rev_no, ts, author of captured HTML pages of the change list, a file each."""
    reader = spark.readStream if stream else spark.read
    pages = reader.text(path, wholetext=True).select(X.without_bom(F.col("value")).alias("html"))
    return pages.mapInPandas(_change_batches, "slug string, rev_no bigint, ts bigint, author bigint")


def _change_batches(batches):
    import pandas as pd

    for batch in batches:
        rows = [r for html in batch["html"] for r in trees._change_rows(html or "")]
        yield pd.DataFrame(rows, columns=["slug", "rev_no", "ts", "author"])


#: The service's answers.
ARTICLES = "array<struct<pageId:string,updatedAt:string>>"
ARTICLE = "uid bigint, title string, tags array<string>, source string"
FILES = "files array<struct<name:string>>"


def parsed(answer: Column, schema: str) -> Column:
    """The answer, failing the plan where it is no JSON of this shape."""
    return F.from_json(answer, schema, {"mode": "FAILFAST"})


def article_list(answers: DataFrame) -> DataFrame:
    """slug and updated_at (unix seconds, 0 if unreadable) of list answers (answer)."""
    rows = answers.select(F.explode(parsed(F.col("answer"), ARTICLES)).alias("a"))
    return rows.select(F.col("a.pageId").alias("slug"), F.coalesce(X.iso8601(F.col("a.updatedAt")), F.lit(0).cast("long")).alias("updated_at"))


def articles(answers: DataFrame) -> DataFrame:
    """slug, page_id, title, tags, content of article answers (slug, answer); what is absent is empty."""
    rows = answers.select("slug", parsed(F.col("answer"), ARTICLE).alias("a"))
    return rows.select("slug", F.col("a.uid").alias("page_id"), F.coalesce("a.title", F.lit("")).alias("title"), F.coalesce("a.tags", F.array().cast("array<string>")).alias("tags"), F.coalesce("a.source", F.lit("")).alias("content"))


def article_logs(answers: DataFrame) -> DataFrame:
    """slug, rev_no, version_id, ts, author of log answers (slug, answer), all entries that name a version."""
    rows = answers.select("slug", F.explode(parsed(F.col("answer"), LOG)["entries"]).alias("e"))
    out = rows.select("slug", F.col("e.revNumber").alias("rev_no"), F.coalesce("e.meta.version_id", "e.meta.source.version_id").alias("version_id"), F.coalesce(X.iso8601(F.col("e.createdAt")), F.lit(0).cast("long")).alias("ts"), F.coalesce("e.user.id", F.lit(0).cast("long")).alias("author"))
    return out.where("version_id is not null")


def versions(answers: DataFrame) -> DataFrame:
    """slug, rev_no, content of version answers (slug, rev_no, answer)."""
    return answers.select("slug", "rev_no", F.coalesce(parsed(F.col("answer"), "source string")["source"], F.lit("")).alias("content"))


def file_names(answers: DataFrame, host: str) -> DataFrame:
    """slug and path of file-list answers (slug, answer): the canonical key of each attachment on the site's own host."""
    from strandline.functions import urls

    rows = answers.select("slug", F.explode(parsed(F.col("answer"), FILES)["files"]).alias("f"))
    return rows.select("slug", urls.own_row_key(F.lit(host), F.concat(F.lit(f"https://{host}/local--files/"), "slug", F.lit("/"), "f.name")).alias("path"))
