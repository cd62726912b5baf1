"""Keyed tables in layers: small changes lie beside the base and are merged when they are read.

A table is cut into buckets by a hash of its key. Its *base* holds whole rows;
a change writes a *delta* of new rows and tombstones, and commits with the next
sequence number in one step. A reader settles the deltas first (the greatest
number of a key wins), then drops their keys from the base by one anti-join:
the base is scanned, never shuffled, as long as the deltas are few. What a
change writes is in proportion to the change.

Writers need no lock. A change notes which keys it read and wrote (their
hashes, or ranges of hashes by bucket where they are many). When another commit
came first, a change whose keys that commit did not write is moved behind it
and tried again; one whose keys it wrote is refused with ``Conflict``. Ranges can meet
where no key does: ``begin(exact=True)`` then compares the keys themselves, by a
join with the other commit's delta, and is refused for a shared key only.

``compact`` folds the deltas of some buckets into a new base for these, beside
running writers: it changes no row, so it conflicts with nothing.
``vacuum`` deletes what no kept version names once it is old enough that no
writer can still be about to name it. ``changes`` is the feed between two
versions: from their deltas alone, each touched key with its rows before and after.

Keys are not null, and a change has one row a key; anything else fails before it
is committed.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from strandline.operators import merge
from strandline.operators.versions import _Log
from strandline.session import shared_folder, written

#: Rows of deltas whose keys a reader broadcasts; beyond it the anti-join shuffles.
BROADCAST_ROWS = 1 << 17
#: Keys that a commit notes one by one; beyond it by ranges of their hashes.
EXACT_KEYS = 4_096
#: Rows of a bucket that one file of a base holds at most.
FILE_ROWS = 4_000_000


class Conflict(RuntimeError):
    """Another commit wrote a key that this change read or wrote."""


class Footprint:
    """Keys as hashes: a range a bucket, and all of them while they are few. everything: the whole table."""

    def __init__(self, ranges: dict[int, tuple[int, int]] | None = None, hashes: set[int] | None = None, everything: bool = False):
        self.ranges, self.hashes, self.everything = ranges or {}, hashes, everything

    def meets(self, other: Footprint) -> bool:
        if self.everything or other.everything:
            return bool((self.everything or self.ranges) and (other.everything or other.ranges))
        near = any(b in other.ranges and lo <= other.ranges[b][1] and other.ranges[b][0] <= hi for b, (lo, hi) in self.ranges.items())
        if near and self.hashes is not None and other.hashes is not None:
            return not self.hashes.isdisjoint(other.hashes)
        return near

    def to_json(self) -> dict:
        return {"ranges": {str(b): r for b, r in self.ranges.items()}, "hashes": None if self.hashes is None else sorted(self.hashes), "everything": self.everything}

    @staticmethod
    def of_json(found: dict) -> Footprint:
        return Footprint({int(b): tuple(r) for b, r in found["ranges"].items()}, None if found["hashes"] is None else set(found["hashes"]), found["everything"])


class LayeredTable(_Log):
    """See the module. State and footprint of every commit are in its marker, so a reader opens one small object."""

    # -- what a version holds ---------------------------------------------

    def state(self, version: int | None = None) -> dict:
        return json.loads(self.marker(self.pinned(version)))

    def note(self, version: int | None = None) -> str | None:
        return self.state(version)["note"]

    def create(self, rows: DataFrame, keys: list[str], buckets: int = 16, note: str | None = None, by: list[str] | None = None) -> int:
        """The first version. by: the keys that choose a row's bucket, so that read_groups() opens few of them (all by default)."""
        if not set(by or keys) <= set(keys):
            raise ValueError(f"{by} are not all keys of {keys}")
        state = {"keys": keys, "by": by or keys, "schema": rows.schema.json(), "buckets": buckets, "bases": {}, "deltas": [], "own": None, "wrote": Footprint().to_json(), "note": note}
        folder, held = self._write_rows(rows, state, "b")
        #: A bucket's base, and the number up to which it holds all changes.
        state["bases"] = {str(b): [folder, 0] for b in held}
        if not self._try_mark(1, state):
            raise Conflict(f"{self.path} exists")
        return 1

    @staticmethod
    def _schema(state: dict) -> StructType:
        return StructType.fromJson(json.loads(state["schema"]))

    def _hash(self, keys: list[str]) -> Column:
        return F.xxhash64(*keys)

    def _bucket(self, state: dict) -> Column:
        return F.pmod(self._hash(state.get("by", state["keys"])), F.lit(state["buckets"])).cast("int")

    def _base(self, state: dict, buckets: set[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/{folder}/_bucket={b}" for b, (folder, _) in state["bases"].items() if folder and (buckets is None or int(b) in buckets)]
        schema = self._schema(state)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _layers(self, state: dict, buckets: set[int] | None = None, after: int = 0) -> DataFrame:
        """The newest delta row of each key, with _gone."""
        upto = {int(b): max(n, after) for b, (_, n) in state["bases"].items()}
        paths, number = [], {}
        for seq, folder, held, _ in state["deltas"]:
            own = [b for b in held if (buckets is None or b in buckets) and seq > upto.get(b, after)]
            paths += [f"{self.path}/{folder}/_bucket={b}" for b in own]
            if own:
                number[folder] = seq
        schema = StructType([*self._schema(state).fields, StructField("_gone", BooleanType())])
        if not paths:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(*paths)
        if len(number) == 1:
            return rows
        folder = F.regexp_extract(F.col("_metadata.file_path"), r"/(d-[0-9a-f]{32})/", 1)
        rows = rows.select("*", F.create_map(*(F.lit(x) for pair in number.items() for x in pair))[folder].alias("_seq"))
        newest = rows.groupBy(*state["keys"]).agg(F.max_by(F.struct(*(c for c in schema.fieldNames() if c not in state["keys"])), "_seq").alias("_row"))
        return newest.select(*(F.col(c) if c in state["keys"] else F.col(f"_row.`{c}`").alias(c) for c in schema.fieldNames()))

    def _rows(self, state: dict, buckets: set[int] | None = None, only: DataFrame | None = None, on: list[str] | None = None) -> DataFrame:
        """Rows of a state, of these buckets, and of the keys (those of on, if given) of only."""
        keys, columns = state["keys"], self._schema(state).fieldNames()
        base, layers = self._base(state, buckets), self._layers(state, buckets)
        if only is not None:
            base, layers = base.join(only, on or keys, "left_semi"), layers.join(only, on or keys, "left_semi")
        few = sum(d[3] for d in state["deltas"]) <= BROADCAST_ROWS
        touched = layers.select(keys)
        kept = base.join(F.broadcast(touched) if few else touched, keys, "left_anti") if state["deltas"] else base
        return kept.select(columns).unionByName(layers.where("not _gone").select(columns))

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of one pinned version (the newest by default)."""
        return self._rows(self.state(version))

    def read_keys(self, keys: DataFrame, version: int | None = None) -> DataFrame:
        """The rows of these keys; only their buckets are read."""
        state = self.state(version)
        only = keys.select(state["keys"]).distinct()
        return self._rows(state, self._buckets_of(only, state), only)

    def read_groups(self, groups: DataFrame, version: int | None = None) -> DataFrame:
        """All rows that share the bucketing keys of these rows; only their buckets are read."""
        state = self.state(version)
        by = state.get("by", state["keys"])
        only = groups.select(by).distinct()
        return self._rows(state, self._buckets_of(only, state), only, by)

    def _buckets_of(self, keys: DataFrame, state: dict) -> set[int]:
        return {r[0] for r in keys.select(self._bucket(state)).distinct().collect()}  # at most as many as buckets

    # -- writing ----------------------------------------------------------

    def _write_rows(self, rows: DataFrame, state: dict, kind: str, files: int = 1) -> tuple[str, list[int]]:
        """Folder, and buckets that have rows."""
        folder = f"{kind}-{uuid.uuid4().hex}"
        part = F.pmod(F.xxhash64(F.lit(7), *state["keys"]), F.lit(files))
        dealt = rows.withColumn("_bucket", self._bucket(state))
        dealt.repartition("_bucket", part).write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        place = self._path(f"{self.path}/{folder}")
        held = sorted(int(s.getPath().getName().split("=")[1]) for s in self._fs.listStatus(place) if s.getPath().getName().startswith("_bucket=") and s.getPath().getName()[8:].isdigit())
        return folder, held

    def _try_mark(self, number: int, state: dict) -> bool:
        if number in self.numbers():
            return False
        try:
            self._mark(number, json.dumps(state))
        except RuntimeError:
            return False
        return True

    def begin(self, exact: bool = False) -> Change:
        """A change on top of the newest version. exact: where noted ranges meet those of another commit, the keys decide."""
        return Change(self, exact)

    def upsert(self, delta: DataFrame, rules: dict[str, Callable[[Column, Column], Column]] | None = None, where: Callable | None = None, note: str | None = None) -> int:
        return self.begin().upsert(delta, rules, where).commit(note)

    def insert_or_ignore(self, delta: DataFrame, note: str | None = None) -> int:
        return self.begin().insert_or_ignore(delta).commit(note)

    def delete(self, keys: DataFrame, note: str | None = None) -> int:
        return self.begin().delete(keys).commit(note)

    # -- upkeep -----------------------------------------------------------

    def compact(self, least_share: float = 0.0) -> int | None:
        """Fold deltas into a new base where a bucket's share of delta rows is at least least_share; the new version, or None."""
        version = self.pinned(None)
        state = self.state(version)
        sizes: dict[int, int] = {}
        for _, _, held, rows in state["deltas"]:
            for b in held:
                sizes[b] = sizes.get(b, 0) + max(1, rows // len(held))
        if not sizes:
            return None
        counted = {r["b"]: r["n"] for r in self._base(state, set(sizes)).groupBy(self._bucket(state).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()} if least_share else {}
        chosen = {b for b, n in sizes.items() if n >= least_share * counted.get(b, 0)}
        if not chosen:
            return None
        files = max(1, -(-max(counted.values(), default=0) // FILE_ROWS))
        folder, held = self._write_rows(self._rows(state, chosen), state, "b", files)
        while True:
            latest = self.pinned(None)
            now = self.state(latest)
            for b in chosen:  # unless a later compaction came first; a bucket without rows has no folder
                if now["bases"].get(str(b), [None, 0])[1] < version:
                    now["bases"][str(b)] = [folder if b in held else None, version]
            self._drop_folded(now)
            now |= {"own": None, "wrote": Footprint().to_json(), "note": now["note"]}
            if self._try_mark(latest + 1, now):
                return latest + 1

    @staticmethod
    def _drop_folded(state: dict) -> None:
        """Deltas lose the buckets that a base covers; empty ones go."""
        upto = {int(b): n for b, (_, n) in state["bases"].items()}
        kept = []
        for seq, folder, held, rows in state["deltas"]:
            left = [b for b in held if seq > upto.get(b, 0)]
            if left:
                kept.append([seq, folder, left, rows])
        state["deltas"] = kept

    def vacuum(self, keep: int = 2, grace_s: float = 3_600) -> list[str]:
        """Delete versions but the newest keep, and folders that none of these names and that are older than grace_s; the folders."""
        numbers = self.numbers()
        kept = [self.state(n) for n in numbers[-keep:]]
        named = {x[0] for s in kept for x in s["bases"].values() if x[0]} | {d[1] for s in kept for d in s["deltas"]} | {s["own"][0] for s in kept if s["own"]}
        for n in numbers[:-keep]:
            self._fs.delete(self._path(f"{self.path}/_log/{n:012d}"), False)
        gone = []
        for status in self._fs.listStatus(self._path(self.path)):
            name = status.getPath().getName()
            if name[:2] in ("b-", "d-") and name not in named and status.getModificationTime() / 1000 <= time.time() - grace_s:
                self._fs.delete(status.getPath(), True)
                gone.append(name)
        return sorted(gone)

    # -- change feed ------------------------------------------------------

    def changes(self, after: int, upto: int | None = None) -> DataFrame:
        """key columns, kind (insert, update, delete), before and after: what differs between two versions.

        Only the deltas between them say which keys to look at. Both versions, and all between, must be kept.
        """
        upto = self.pinned(upto)
        old, new = self.state(after), self.state(upto)
        keys, schema = old["keys"], self._schema(new)
        paths, buckets = [], set()
        for n in range(after + 1, upto + 1):
            own = self.state(n)["own"]
            if own:
                paths += [f"{self.path}/{own[0]}/_bucket={b}" for b in own[1]]
                buckets |= set(own[1])
        empty = self.spark.createDataFrame([], schema)
        touched = (self.spark.read.schema(schema).parquet(*paths) if paths else empty).select(keys).distinct()

        def side(state: dict, name: str) -> DataFrame:
            return self._rows(state, buckets, touched).select(*keys, F.struct(*schema.fieldNames()).alias(name))

        both = side(old, "before").join(side(new, "after"), keys, "full_outer")
        kind = F.when(F.col("before").isNull(), "insert").when(F.col("after").isNull(), "delete").otherwise("update")
        return both.where(~F.col("before").eqNullSafe(F.col("after"))).select(*keys, kind.alias("kind"), "before", "after")


class Change:
    """A change on top of one version: reads see that version, writes gather in one delta."""

    def __init__(self, table: LayeredTable, exact: bool = False):
        self.table, self.version, self.exact = table, table.pinned(None), exact
        self.state = table.state(self.version)
        self.keys = self.state["keys"]
        self.schema = table._schema(self.state)
        self.delta: DataFrame | None = None
        #: What was read: footprints, and the keys that they are of (None: the whole table).
        self._read: list[tuple[Footprint, DataFrame | None]] = []

    def read(self) -> DataFrame:
        """All rows; whoever reads everything conflicts with any other writer."""
        self._read.append((Footprint(everything=True), None))
        return self.table._rows(self.state)

    def read_keys(self, keys: DataFrame) -> DataFrame:
        """The rows of these keys, which count as read."""
        return self._held(keys)

    def _held(self, rows: DataFrame) -> DataFrame:
        """The rows that have keys of these; all of the keys count as read."""
        only = rows.select(self.keys).distinct()
        if self.exact:  # the keys as they were read, whatever becomes of where they came from
            only, _ = written(only, shared_folder(self.table.spark, "keys"))
        seen, _ = self._footprint(only)
        self._read.append((seen, only))
        return self.table._rows(self.state, set(seen.ranges), only)

    def _add(self, rows: DataFrame, gone: bool) -> Change:
        blank = [F.lit(None).cast(f.dataType).alias(f.name) if gone and f.name not in self.keys else F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields]
        rows = rows.select(*blank, F.lit(gone).alias("_gone"))
        self.delta = rows if self.delta is None else self.delta.unionByName(rows)
        return self

    def upsert(self, delta: DataFrame, rules: dict | None = None, where: Callable | None = None) -> Change:
        """As merge.upsert(), on the rows of the delta's keys only; without rules the new row wins whole."""
        if rules is None:
            return self._add(delta, False)
        return self._add(merge.upsert(self._held(delta), delta, self.keys, rules, where), False)

    def insert_or_ignore(self, delta: DataFrame) -> Change:
        """Rows whose key is new; those that are not count as read."""
        return self._add(delta.join(self._held(delta).select(self.keys), self.keys, "left_anti"), False)

    def delete(self, keys: DataFrame) -> Change:
        """Keys that are not there count as read."""
        return self._add(self._held(keys).select(self.keys), True)

    def _footprint(self, keys: DataFrame) -> tuple[Footprint, int]:
        """Of rows of keys, and how many rows these are; a key that comes twice is an error."""
        hashed = keys.select(*self.keys, self.table._bucket(self.state).alias("b"), self.table._hash(self.keys).alias("h"))
        by_key = hashed.groupBy("b", "h", *self.keys).agg(F.count(F.lit(1)).alias("n"))
        grouped = by_key.groupBy("b").agg(F.min("h").alias("lo"), F.max("h").alias("hi"), F.sum("n").alias("n"), F.max("n").alias("most"))
        found = grouped.collect()  # a row a bucket
        if max((r["most"] for r in found), default=1) > 1:
            raise ValueError(f"two rows of one key: {by_key.where('n > 1').select(self.keys).first().asDict()}")
        rows = sum(r["n"] for r in found)
        hashes = {r[0] for r in hashed.select("h").collect()} if rows <= EXACT_KEYS else None
        return Footprint({r["b"]: (r["lo"], r["hi"]) for r in found}, hashes), rows

    def _meets(self, mine: Footprint, keys: DataFrame | None, other: dict) -> bool:
        """Whether the commit of this state wrote keys of mine; if exact, as the keys say and not their noted ranges."""
        if not mine.meets(Footprint.of_json(other["wrote"])):
            return False
        if not self.exact or keys is None:
            return True
        folder, held = other["own"]
        theirs = self.table.spark.read.schema(self.schema).parquet(*(f"{self.table.path}/{folder}/_bucket={b}" for b in held if b in mine.ranges))
        return not theirs.select(self.keys).join(keys, self.keys, "left_semi").isEmpty()

    def commit(self, note: str | None = None) -> int:
        """Write the delta and make it the next version, behind commits that wrote none of its keys."""
        table = self.table
        if self.delta is None:
            raise ValueError("nothing was changed")
        bad = None
        for k in self.keys:
            bad = F.col(k).isNull() if bad is None else bad | F.col(k).isNull()
        checked = self.delta.withColumn("_gone", F.when(bad, F.raise_error(F.lit("a key is null"))).otherwise(F.col("_gone")))
        folder, held = table._write_rows(checked, self.state, "d")
        paths = [f"{table.path}/{folder}/_bucket={b}" for b in held]
        own = table.spark.read.schema(self.schema).parquet(*paths).select(self.keys) if paths else table.spark.createDataFrame([], self.schema).select(self.keys)
        wrote, rows = self._footprint(own)
        checked_to = self.version
        while True:
            latest = table.pinned(None)
            for n in range(checked_to + 1, latest + 1):
                if any(self._meets(x, keys, table.state(n)) for x, keys in [(wrote, own), *self._read]):
                    raise Conflict(f"version {n} wrote keys that this change, made on version {self.version}, read or wrote")
            checked_to = latest
            state = table.state(latest)
            state["deltas"] = state["deltas"] + ([[latest + 1, folder, held, rows]] if held else [])
            state |= {"own": [folder, held] if held else None, "wrote": wrote.to_json(), "note": note}
            if table._try_mark(latest + 1, state):
                return latest + 1


def retried(table: LayeredTable, change: Callable[[Change], Change], note: str | None = None, tries: int = 5) -> int:
    """Make a change again on the newest version for as long as another writer's keys are in its way."""
    for left in range(tries - 1, -1, -1):
        try:
            return change(table.begin()).commit(note)
        except Conflict:
            if not left:
                raise
    raise AssertionError


def open_or_create(spark: SparkSession, path: str, empty: DataFrame, keys: list[str], buckets: int = 16) -> LayeredTable:
    table = LayeredTable(spark, path)
    if not table.numbers():
        table.create(empty, keys, buckets)
    return table
