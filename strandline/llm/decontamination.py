"""Benchmark decontamination with a generalised suffix automaton of the test items.

Items are normalised to word sequences. Documents stream past the automaton;
where the longest match reaches the window, the words of the window are hit.
Only runs of words whose neighbours follow each other in some item are walked:
a match is always inside such a run, so nothing is missed.

The automaton is broadcast while the items fit ``SHARD_BYTES``; more items make
more shards of that size, and each document passes them one after another. No
more than ``SHARDS_AT_ONCE`` of them are held at a time, however many there are.

Defined cases: null or wordless text: no words, nothing hit; items with a null
id, null text or no words are ignored; rows that repeat an item_id count as
one item; repeated documents each get a result row.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.automaton import SuffixAutomaton
from strandline.llm.common import as_bytes, drop_table, flatten, table, text_pass, whole_row, with_carry

WINDOW = 10
#: Text of test items that one automaton, and so one broadcast, holds at most (about 60 times that in memory).
SHARD_BYTES = 2_000_000
#: Automata that are broadcast at a time.
SHARDS_AT_ONCE = 2
#: Share of hit words above which a document is dropped instead of reduced.
MAX_COVERAGE = 0.8

FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 0x30 or 0x3A <= c <= 0x60 or 0x7B <= c <= 0x7F else c for c in range(256))
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
STATE = "doc_id long, text string, n_words long, spans array<struct<lo:int,hi:int>>, items array<string>"


def item_words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def automata(benchmark: DataFrame, window: int):
    """(automaton, item ids) of each shard; one shard at a time is in the driver's memory."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = -(-total // SHARD_BYTES)
    for k in range(shards):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == k)
        automaton, labels = SuffixAutomaton(), []
        for row in part.orderBy("item_id", "text").toLocalIterator():
            words = item_words(row["text"].encode())
            if words:
                automaton.add(words)
                labels.append(row["item_id"])
        if labels:
            yield automaton.finish(window), labels


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted ranges [lo, hi] without overlap."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def without_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """text without the words of the spans, and without what stands between words of one span."""
    words = list(WORD.finditer(text))
    parts, at = [], 0
    for lo, hi in spans:
        parts.append(text[at : words[lo].start()])
        at = words[hi].end()
    return b"".join([*parts, text[at:]])


def shard_pass(state: DataFrame, shared, carry: str | None = None, max_coverage: float | None = None) -> DataFrame:
    """Adds the spans and items of one shard's automaton.

    With max_coverage this is the last shard: out come clean_text, dropped (more than max_coverage of the words were hit) and carry.
    """

    def one(step):
        automaton, labels = shared.value
        texts = as_bytes(step.column("text"))
        flat, starts = flatten([item_words(t) if t else [] for t in texts])
        lookup = automaton.vocabulary.get
        ids = np.fromiter((lookup(w, -1) for w in flat), np.int64, len(flat))
        owner = np.repeat(np.arange(step.num_rows), np.diff(starts))
        spans = [[(s["lo"], s["hi"]) for s in x or ()] for x in step.column("spans").to_pylist()]
        items = [set(x or ()) for x in step.column("items").to_pylist()]
        touched = set()
        for first, end in automaton.runs(ids, owner):
            i = int(owner[first])
            shift = first - int(starts[i])
            for lo, hi, found in automaton.windows(ids[first:end].tolist()):
                spans[i].append((lo + shift, hi + shift))
                items[i].update(labels[x] for x in found)
                touched.add(i)
        for i in touched:
            spans[i] = merged(spans[i])
        counts = np.diff(starts)
        extra = [carry] if carry else []
        if max_coverage is not None:
            hit = np.array([sum(hi - lo + 1 for lo, hi in x) for x in spans], np.int64)
            clean = [without_spans(t, x) if x else t for t, x in zip(texts, spans, strict=True)]
            arrays, names = [pa.array(clean, pa.binary()).cast(pa.string()), pa.array(hit > max_coverage * counts)], ["clean_text", "dropped"]
        else:
            arrays = [step.column("doc_id").cast(pa.int64()), step.column("text"), pa.array(counts), pa.array([[{"lo": a, "hi": b} for a, b in x] for x in spans], pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))), pa.array([sorted(x) for x in items], pa.list_(pa.string()))]
            names = ["doc_id", "text", "n_words", "spans", "items"]
        yield pa.RecordBatch.from_arrays([*arrays, *(step.column(c) for c in extra)], names=[*names, *extra])

    schema = STATE if max_coverage is None else "clean_text string, dropped boolean"
    return text_pass(state, one, with_carry(schema, state, (carry,) if carry else ()))


def contaminated_spans(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, carry: str | None = None, max_coverage: float | None = None) -> DataFrame:
    """doc_id, text, n_words, spans (ranges of hit words, merged), items (their ids, sorted as strings) and the column carry.

    With max_coverage: what shard_pass() says of it. At most SHARDS_AT_ONCE automata are broadcast at a time: then
    the state is written, and they go.
    """
    spark = documents.sparkSession
    state = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(None).cast("long").alias("n_words"), F.expr("cast(null as array<struct<lo:int,hi:int>>)").alias("spans"), F.expr("cast(null as array<string>)").alias("items"), *([carry] if carry else []))
    live: list = []
    written = None
    waiting = None
    for pair in automata(benchmark, window):
        if waiting is not None:
            state = shard_pass(state, waiting, carry)
            live.append(waiting)
            if len(live) == SHARDS_AT_ONCE:
                state, before = table(spark, state), written
                written = state
                for shared in live:
                    shared.destroy()
                live = []
                if before is not None:
                    drop_table(before)
        waiting = spark.sparkContext.broadcast(pair)
    if waiting is None:
        waiting = spark.sparkContext.broadcast((SuffixAutomaton().finish(window), []))
    return shard_pass(state, waiting, carry, max_coverage)


def digest(state: DataFrame) -> DataFrame:
    """The columns that summarise spans and items."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + (s["hi"] - s["lo"] + 1))
    return state.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def keep_clean(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """documents without hit words; those of which more than max_coverage was hit go. n_chars follows the text.

    Rows keep their other columns as a struct that rides along, so nothing is joined back.
    """
    carried = documents.select("doc_id", "text", whole_row(documents).alias("_row"))
    clean = contaminated_spans(carried, benchmark, window, carry="_row", max_coverage=max_coverage).where("not dropped")
    columns = []
    for c in documents.columns:
        column = F.col(f"_row.`{c}`")
        if c == "text":
            column = F.col("clean_text")
        elif c == "n_chars":
            column = F.char_length("clean_text").cast(documents.schema[c].dataType)
        columns.append(column.alias(c))
    return clean.select(columns)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return digest(contaminated_spans(documents, benchmark))


QUERIES = {"op8_benchmark_decontamination": op8}

_WORDS = r"coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"

ORACLE = {
    "op8_benchmark_decontamination": rf"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
  b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
  bw AS (SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS g FROM
    (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM b WHERE len(w) > 0)),
  ks AS (SELECT DISTINCT k FROM bw),
  dw AS (SELECT doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') AS g FROM
    (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, ks)),
  m AS (SELECT doc_id, dw.k, p, item_id FROM dw JOIN bw ON bw.k = dw.k AND bw.g = dw.g),
  hits AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM m) GROUP BY doc_id),
  its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM m) GROUP BY doc_id)
  SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
  FROM d LEFT JOIN hits ON hits.doc_id = d.doc_id LEFT JOIN its ON its.doc_id = d.doc_id""",
}
