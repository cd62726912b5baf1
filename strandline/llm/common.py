"""Shared ground: word hashes and tables, batched text passes, shared-folder tables, components.

Texts are handled as UTF-8 bytes. ``bytes.split()`` cuts at exactly
``[\\x20\\x09-\\x0D]``, which is the word rule of the operators here.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strandline.session import drop_folder, drop_tables, shared_folder  # noqa: F401

#: Bytes of text that one step of a Python pass holds as word objects.
STEP_BYTES = 1_000_000
#: Distinct words that a worker remembers before it starts afresh.
WORD_TABLE_LIMIT = 200_000
#: Rows of ids that a join may broadcast (16 bytes each, so 16 MB); beyond it the join shuffles.
BROADCAST_ROWS = 1 << 20
#: Edges (16 bytes each) whose components one task finds; beyond it they are found by joins.
SMALL_EDGES = 1 << 18

U64 = np.uint64
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def word64(*factors: int) -> np.uint64:
    """A product modulo 2**64."""
    out = 1
    for factor in factors:
        out = out * factor & 0xFFFFFFFFFFFFFFFF
    return U64(out)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, on arrays."""
    h = h.astype(U64, copy=True)
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


class WordTable(dict):
    """word -> dense number; ``value`` computes what is kept of a new word."""

    def __init__(self, value: Callable[[bytes], object], limit: int = WORD_TABLE_LIMIT):
        super().__init__()
        self.value, self.limit = value, limit
        self.rows: list = []

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.rows)
        self.rows.append(self.value(word))
        return number

    def trim(self) -> None:
        """Call between steps: numbers do not outlive a step."""
        if len(self.rows) > self.limit:
            self.clear()
            self.rows.clear()

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A 64-bit value of each byte, and of each byte with A-Z in lower case.
BYTES = mix(np.arange(1, 257, dtype=U64) * word64(0x9E3779B97F4A7C15))
LOWER_BYTES = BYTES[np.frombuffer(LOWER, np.uint8)]
#: Bytes that are hashed at a time; a longer word comes alone.
SEGMENT = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
#: What once_a_task() remembers.
TASK_TABLES: list = []


def once_a_task(function: Callable) -> Callable:
    """A cache that give_back() empties: waiting workers keep no tables of numbers."""
    TASK_TABLES.append(cached := lru_cache(maxsize=4)(function))
    return cached


@once_a_task
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE to the powers 0 to n - 1, and their inverses modulo 2**64."""
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        p = np.full(n, U64(base), U64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=U64))
    return out[0], out[1]


@once_a_task
def multipliers(n: int) -> np.ndarray:
    """n odd numbers of 64 bits that are unlike each other's powers: one a place of a run."""
    return mix(np.arange(1, n + 1, dtype=U64) * word64(0xD6E8FEB86659FD93)) | U64(1)


def run_hashes(values: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run [first, end) of values; the runs are in order and do not overlap.

    A sum of the values, each times a number of its place in the run. (Powers of one base would not do: modulo
    2**64 they give two words of 1,024 characters, a Thue-Morse word and its complement, one hash.)
    """
    out = np.zeros(len(first), U64)
    k = 0
    while k < len(first):
        base = int(first[k])
        stop = max(k + 1, int(np.searchsorted(end, base + SEGMENT, "right")))
        length = int(end[stop - 1]) - base
        lo, hi = first[k:stop] - base, end[k:stop] - base
        begins = np.zeros(length, np.int64)
        begins[lo] = lo
        place = np.arange(length) - np.maximum.accumulate(begins)
        longest = int((hi - lo).max(initial=1))
        factors = multipliers(1 << max(10, longest.bit_length()))
        prefix = np.zeros(length + 1, U64)
        # Between runs places go on beyond any run's; what stands there is in no difference below.
        np.cumsum(values[base : base + length] * factors[np.minimum(place, len(factors) - 1)], out=prefix[1:], dtype=U64)
        out[k:stop] = mix(prefix[hi] - prefix[lo] + (hi - lo).astype(U64) * word64(0x9E3779B97F4A7C15))
        k = stop
    return out


def word_hashes(texts: list[bytes | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of all texts in turn, and where each text's words start (one more at the end).

    Words are what bytes.split() gives; lower: A-Z count as a-z.
    """
    raw = np.frombuffer(b" ".join([b"", *(t or b"" for t in texts), b""]), np.uint8)
    space = SPACE[raw]
    first = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    end = np.flatnonzero(~space[:-1] & space[1:]) + 1
    out = run_hashes((LOWER_BYTES if lower else BYTES)[raw], first, end)
    bounds = np.cumsum([1, *(len(t or b"") + 1 for t in texts)])
    return out, np.searchsorted(first, bounds)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    elif pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    return column.to_pylist()


def steps(batches: Iterator[pa.RecordBatch], text: str = "text", size: int | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of about size (STEP_BYTES) bytes of text; a longer text comes alone."""
    size = size or STEP_BYTES
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + size, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def flatten(lists: list[list]) -> tuple[list, np.ndarray]:
    """All members in one list, and where each inner list starts (one more at the end)."""
    starts = np.zeros(len(lists) + 1, np.int64)
    np.cumsum([len(x) for x in lists], out=starts[1:])
    return [x for y in lists for x in y], starts


def give_back() -> None:
    """Return freed memory to the system: Python workers outlive their tasks and wait beside the next ones."""
    for cached in TASK_TABLES:
        cached.cache_clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def arrow_pass(df: DataFrame, run: Callable, schema: str | StructType) -> DataFrame:
    """mapInArrow; what a task held goes back to the system at its end."""

    def trimmed(batches):
        yield from run(batches)
        give_back()

    return df.mapInArrow(trimmed, schema)


def text_pass(df: DataFrame, function: Callable, schema: str | StructType, done: Callable[[], None] | None = None, size: int | None = None) -> DataFrame:
    """mapInArrow over text steps of size bytes; function maps a RecordBatch to RecordBatches. done: drops what function remembers, at a task's end."""

    def run(batches):
        for step in steps(batches, size=size):
            yield from function(step)
        if done is not None:
            done()

    return arrow_pass(df, run, schema)


def with_carry(ddl: str, df: DataFrame, carry: tuple[str, ...]) -> StructType:
    """The schema of ddl with columns of df, whatever their types and names, after it."""
    return StructType([*StructType.fromDDL(ddl).fields, *(df.schema[c] for c in carry)])


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that they ride through a pass under one name."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns))


def table(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends here. Its rows are counted on the way."""
    path = shared_folder(spark, "table")
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.rows_written, out.written_path = seen.get["rows"], path
    return out


def drop_table(written: DataFrame) -> None:
    """Delete what table() wrote, once nothing reads it any more."""
    drop_folder(written.sparkSession, written.written_path)


def rows_of(written: DataFrame) -> int:
    """Rows of what table() returned, without a job."""
    return written.rows_written


def small(ids: DataFrame) -> DataFrame:
    """What table() returned, marked for broadcast only while it is small; beyond that joins with it shuffle."""
    return F.broadcast(ids) if rows_of(ids) <= BROADCAST_ROWS else ids


def semi_join(big: DataFrame, ids: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows of big whose key is in ids, a written table."""
    return big.join(small(ids), on, "left_semi")


def few_components(edges: DataFrame) -> DataFrame:
    """components() of at most SMALL_EDGES edges, by union-find in one task."""

    def run(batches):
        up: dict[int, int] = {}

        def top(x):
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                x, y = top(up.setdefault(a, a) if a not in up else a), top(up.setdefault(b, b) if b not in up else b)
                up[max(x, y)] = min(x, y)
        if up:
            yield pa.RecordBatch.from_arrays([pa.array(list(up), pa.int64()), pa.array([top(x) for x in up], pa.int64())], names=["node", "root"])

    return edges.coalesce(1).mapInArrow(run, "node long, root long")


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """Connected components of edges(a, b): (node, root), root the smallest key reached.

    Alternates large-star and small-star (Kiveris et al. 2014). Every step is a
    min per node with map-side combine and an equi-join, so that no
    neighbourhood is gathered in one task. Nodes without edges are absent.
    Up to SMALL_EDGES edges one task is enough.
    """
    if getattr(edges, "rows_written", SMALL_EDGES + 1) <= SMALL_EDGES:
        return few_components(edges.where("a <> b"))
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = table(spark, edges)
    if rows_of(edges) <= SMALL_EDGES:
        return few_components(edges)
    signature, row = None, ()
    while row != signature:
        signature = row
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        seen = Observation()
        edges = table(spark, small.select("e.a", "e.b").where("a <> b").distinct().observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")))
        row = tuple(seen.get.values())
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
