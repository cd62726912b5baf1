"""Substring dedup: remove each word in a window of 50 that also starts in an earlier document.

Against a reference of its own (:func:`remove_against`), suffix automata of its
shards are broadcast, documents stream past them for matching statistics, and
spans above the length threshold go.

The corpus as its own reference comes first to what can repeat at all: each
window names an anchor, the least hash among its 16-word grams, and equal
windows name equal anchors wherever they stand. Windows of one document that
follow each other with one anchor form a block, and a block with an equal in an
earlier document is removed whole. Only where an anchor has several different
blocks (edges of shared passages, edited places) are windows judged one by one:
:func:`judged_windows` makes their words the reference of broadcast automata as
long as they are ``REFERENCE_WORDS`` at most; beyond that equal windows meet by hash,
since shards x documents would grow with the square of the corpus; see README.

Defined cases: null text has no words and kept_sha256 of the empty string;
fewer words than a window: nothing removed; null doc_id: neither reference nor
reduced; repeated rows (one doc_id) never remove each other, and each gets a
result row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.automaton import SuffixAutomaton
from strandline.llm.common import BROADCAST_ROWS, U64, arrow_pass, as_bytes, drop_table, mix, once_a_task, powers, rows_of, semi_join, small, steps, table, text_pass, whole_row, with_carry, word64, word_hashes

WINDOW, GRAM = 50, 16
#: Blocks that one task remembers to settle repeats among its own documents.
SEEN_BLOCKS = 500_000
#: Text of the reference that one automaton, and so one broadcast, holds at most (about 60 times that in memory).
SHARD_BYTES = 2_000_000
#: Judged words up to which they are the reference of broadcast automata.
REFERENCE_WORDS = 200_000
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


class Rolling:
    """Hashes of runs of up to 64 words of one step, in constant time each.

    Powers modulo 2**64 are sound only for short runs: see LongRuns.
    """

    def __init__(self, hashes: np.ndarray):
        size = 1 << max(10, int(len(hashes)).bit_length())
        forward, self.inverse = powers(size)
        self.prefix = np.zeros(len(hashes) + 1, U64)
        np.cumsum(hashes * forward[: len(hashes)], out=self.prefix[1:], dtype=U64)

    def runs(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return mix((self.prefix[start + length] - self.prefix[start]) * self.inverse[start])


@once_a_task
def prime_powers(n: int, prime: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """base to the powers 0 to n - 1 modulo prime, and their inverses."""
    out = []
    for b in (base, pow(base, -1, prime)):
        p = np.ones(1, U64)
        while len(p) < n:
            p = np.concatenate([p, p * U64(pow(b, len(p), prime)) % U64(prime)])
        out.append(p[:n])
    return out[0], out[1]


class LongRuns:
    """Hashes of runs of any length: polynomials modulo two primes, which two different runs share once in 2**62."""

    #: Primes under 2**31, so that products stay in 64 bits, and a base of each.
    FIELDS = ((2_147_483_647, 1_103_527_590), (2_147_483_629, 1_566_083_941))

    def __init__(self, hashes: np.ndarray):
        size = 1 << max(10, int(len(hashes)).bit_length())
        self.sums = []
        for prime, base in self.FIELDS:
            forward, inverse = prime_powers(size, prime, base)
            prefix = np.zeros(len(hashes) + 1, U64)
            np.cumsum(hashes % U64(prime) * forward[: len(hashes)] % U64(prime), out=prefix[1:], dtype=U64)
            self.sums.append((U64(prime), prefix, inverse))

    def runs(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        parts = [(prefix[start + length] - prefix[start]) % prime * inverse[start] % prime for prime, prefix, inverse in self.sums]
        return mix((parts[0] << U64(32) | parts[1]) + length.astype(U64) * word64(0xD6E8FEB86659FD93))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each width values that follow each other."""
    out, reach = values, 1
    while reach * 2 <= width:
        out = np.minimum(out[:-reach], out[reach:])
        reach *= 2
    if reach < width:
        rest = width - reach
        out = np.minimum(out[: len(out) - rest], out[rest:])
    return out


def window_blocks(hashes: np.ndarray, starts: np.ndarray, window: int, gram: int):
    """Blocks as (document, first start, last start, anchor, block hash) of one step."""
    none = np.zeros(0, np.int64)
    if len(hashes) < window:
        return none, none, none, none.view(U64), none.view(U64), None
    roll = Rolling(hashes)
    grams = roll.runs(np.arange(len(hashes) - gram + 1), gram)
    least = sliding_min(grams, window - gram + 1)
    lengths = np.diff(starts)
    owner = np.repeat(np.arange(len(lengths)), lengths)[: len(least)]
    at = np.arange(len(least))
    valid = at + window <= starts[owner + 1]
    at, owner, least = at[valid], owner[valid], least[valid]
    if not len(at):
        return none, none, none, none.view(U64), none.view(U64), roll
    new = np.ones(len(at), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (least[1:] != least[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    lo, hi = at[first], at[last]
    span = hi - lo + window
    block = LongRuns(hashes).runs(lo, span)
    return owner[first], lo - starts[owner[first]], hi - starts[owner[first]], least[first], block, roll


def text_hash(values: list[bytes | None]) -> np.ndarray:
    import xxhash

    # 42: the seed of Spark's xxhash64.
    return np.fromiter((xxhash.xxh64_intdigest(v or b"", seed=42) for v in values), U64, len(values)).view(np.int64)


def block_pass(documents: DataFrame, window: int, gram: int) -> DataFrame:
    """One row a block; anchor is null where an earlier document of the task has the block."""

    def run(batches):
        seen = {}
        for step in steps(batches):
            texts = as_bytes(step.column("text"))
            hashes, starts = word_hashes(texts)
            owner, lo, hi, anchor, block, _ = window_blocks(hashes, starts, window, gram)
            ids = step.column("doc_id").cast(pa.int64()).to_pylist()
            doc = [ids[i] for i in owner.tolist()]
            settled = np.zeros(len(doc), bool)
            if len(seen) > SEEN_BLOCKS:
                seen.clear()
            for i, (b, d) in enumerate(zip(block.tolist(), doc, strict=True)):
                if d is not None and seen.setdefault(b, d) < d:
                    settled[i] = True
                elif d is not None and d < seen[b]:
                    seen[b] = d
            keep = np.array([d is not None for d in doc], bool)
            arrays = [pa.array(anchor.view(np.int64)[keep], mask=settled[keep]), pa.array(block.view(np.int64)[keep]), pa.array([d for d in doc if d is not None], pa.int64()), pa.array(text_hash(texts)[owner[keep]]), pa.array(lo[keep].astype(np.int32)), pa.array(hi[keep].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, names=["anchor", "block", "doc_id", "th", "lo", "hi"])

    return arrow_pass(documents.select("doc_id", "text"), run, "anchor long, block long, doc_id long, th long, lo int, hi int")


def window_pass(documents: DataFrame, window: int) -> DataFrame:
    """documents: doc_id, th, text, spans: each window that starts in a span, by its hash."""

    def one(step):
        hashes, starts = word_hashes(as_bytes(step.column("text")))
        roll = Rolling(hashes)
        at, owner = [], []
        for i, spans in enumerate(step.column("spans").to_pylist()):
            for s in spans:
                at.append(np.arange(s["lo"], s["hi"] + 1) + starts[i])
                owner.append(np.full(s["hi"] + 1 - s["lo"], i))
        at, owner = np.concatenate(at), np.concatenate(owner)
        doc, th = (step.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "th"))
        yield pa.RecordBatch.from_arrays([pa.array(roll.runs(at, window).view(np.int64)), pa.array(doc[owner]), pa.array(th[owner]), pa.array((at - starts[owner]).astype(np.int32))], names=["f", "doc_id", "th", "lo"])

    return text_pass(documents.select("doc_id", "th", "text", "spans"), one, "f long, doc_id long, th long, lo int")


def reference_automata(reference: DataFrame, window: int) -> Iterator[tuple[SuffixAutomaton, list]]:
    """(automaton, ids by label) of each shard of reference (id, text), at most SHARD_BYTES of text each; one at a time is in the driver's memory."""
    rows = reference.where("text is not null").select("id", "text")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = -(-total // SHARD_BYTES)
    for k in range(shards):
        automaton, ids = SuffixAutomaton(), []
        part = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(shards)) == k) if shards > 1 else rows
        for row in part.orderBy(F.col("id").asc_nulls_last(), "text").toLocalIterator():
            words = row["text"].encode().split()
            if len(words) >= window:
                automaton.add(words)
                ids.append(row["id"])
        if ids:
            yield automaton.finish_least(window), ids


def match_pass(documents: DataFrame, shared, earlier: bool) -> DataFrame:
    """documents: doc_id, th, text, spans (null: whole text). Starts of windows that the shard's reference has.

    earlier: only where a reference row with a smaller id has it.
    """

    def one(step):
        automaton, ids = shared.value
        window, lookup = automaton.window, automaton.vocabulary.get
        docs, places = [], []
        for i, (text, doc, spans) in enumerate(zip(as_bytes(step.column("text")), step.column("doc_id").to_pylist(), step.column("spans").to_pylist(), strict=True)):
            words = np.array([lookup(w, -1) for w in (text or b"").split()], np.int64)
            for lo, hi in ((0, len(words)),) if spans is None else ((s["lo"], s["hi"] + window) for s in spans):
                own = words[lo:hi]
                for first, end in automaton.runs(own, np.zeros(len(own), np.int64)):
                    for at, label in automaton.repeats(own[first:end].tolist()):
                        if not earlier or (doc is not None and ids[label] < doc):
                            docs.append(i)
                            places.append(lo + first + at)
        starts = pa.array(places, pa.int32())
        yield pa.RecordBatch.from_arrays([step.column("doc_id").cast(pa.int64()).take(pa.array(docs, pa.int64())), step.column("th").take(pa.array(docs, pa.int64())), starts, starts], names=["doc_id", "th", "lo", "hi"])

    return text_pass(documents.select("doc_id", "th", "text", "spans"), one, "doc_id long, th long, lo int, hi int")


def matched(documents: DataFrame, reference: DataFrame, window: int, earlier: bool) -> DataFrame:
    """match_pass() over all shards of the reference; the result of each is written before the next automaton is broadcast."""
    spark = documents.sparkSession
    found = spark.createDataFrame([], "doc_id long, th long, lo int, hi int")
    for pair in reference_automata(reference, window):
        shared = spark.sparkContext.broadcast(pair)
        found = found.unionByName(table(spark, match_pass(documents, shared, earlier)))
        shared.destroy()
    return found


def fragments(documents: DataFrame, window: int) -> DataFrame:
    """(id, text): the words under each span of documents (doc_id, text, spans)."""

    def one(step):
        ids, out = [], []
        for text, doc, spans in zip(as_bytes(step.column("text")), step.column("doc_id").to_pylist(), step.column("spans").to_pylist(), strict=True):
            words = text.split()
            for s in spans:
                ids.append(doc)
                out.append(b" ".join(words[s["lo"] : s["hi"] + window]))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())], names=["id", "text"])

    return text_pass(documents.select("doc_id", "text", "spans"), one, "id long, text string")


def judged_windows(candidates: DataFrame, edges: DataFrame, window: int, reference_words: int) -> DataFrame:
    """(doc_id, th, lo, hi) of the windows under the spans of candidates that an earlier document has. edges: the spans, and how many were listed.

    Where all their words are reference_words at most, they are the reference: its suffix automata are
    broadcast and the candidates stream past them. Beyond that, equal windows meet by hash, which grows with
    the windows and not with shards x documents.
    """
    spark = candidates.sparkSession
    words = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["hi"] - s["lo"] + window)
    if (edges.agg(F.sum(words)).first()[0] or 0) <= reference_words:
        candidates = table(spark, candidates)
        return matched(candidates, fragments(candidates, window), window, earlier=True)
    windows = window_pass(candidates, window)
    # Only repeated rows repeat windows; distinct would shuffle all of them.
    windows = table(spark, windows if edges.where("listed > size(spans)").isEmpty() else windows.distinct())
    lows = table(spark, windows.groupBy("f").agg(F.min("doc_id").alias("p"), F.max("doc_id").alias("q")).where("p < q").select("f", "p"))
    out = table(spark, windows.join(lows, "f").where("p < doc_id").select("doc_id", "th", "lo", F.col("lo").alias("hi")))
    drop_table(windows)
    drop_table(lows)
    return out


def repeated_spans(documents: DataFrame, window: int = WINDOW, gram: int = GRAM, reference_words: int | None = None) -> DataFrame:
    """(doc_id, th, spans): starts of windows that an earlier document has, as ranges lo..hi; a table."""
    spark = documents.sparkSession
    rows = table(spark, block_pass(documents, window, gram))
    settled = rows.where("anchor is null").select("doc_id", "th", "lo", "hi")
    open_rows = rows.where("anchor is not null")
    shared = open_rows.groupBy("anchor").agg(F.min("doc_id").alias("p"), F.max("doc_id").alias("q")).where("p < q").select("anchor")
    # Anchors and blocks are made distinct, and written, before they meet their rows: a hot one is one row on that
    # side, and both sides are plain exchanges, so that the other can be split.
    shared = table(spark, shared)
    met = table(spark, open_rows.join(shared, "anchor"))
    drop_table(shared)
    blocks = table(spark, met.groupBy("anchor", "block").agg(F.min("doc_id").alias("first")))
    several = table(spark, blocks.groupBy("anchor").agg(F.min("block").alias("p"), F.max("block").alias("q")).where("p <> q").select("anchor"))
    judged = met.join(blocks.select("block", "first"), "block")
    whole = judged.where("first < doc_id").select("doc_id", "th", "lo", "hi")
    edges = judged.where("first >= doc_id").join(several, "anchor").groupBy("doc_id", "th").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"), F.count(F.lit(1)).alias("listed"))
    edges = table(spark, edges)
    texts = semi_join(documents.select("doc_id", "text"), table(spark, edges.select("doc_id").distinct()), "doc_id").withColumn("th", hash_column("text"))
    single = judged_windows(texts.join(edges, ["doc_id", "th"]), edges, window, REFERENCE_WORDS if reference_words is None else reference_words)
    spans = settled.unionByName(whole).unionByName(single)
    out = table(spark, spans.groupBy("doc_id", "th").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")))
    for read in (rows, met, blocks, several, edges):
        drop_table(read)
    return out


def remove_against(documents: DataFrame, reference: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept_text: words in runs of window words or more that a text of reference has go.

    reference: text. Its suffix automata, SHARD_BYTES of text each, are broadcast one after another, and all
    documents stream past each: for references that are small beside the documents.
    """
    spark = documents.sparkSession
    base = documents.select("doc_id", "text", hash_column("text").alias("th"), F.lit(None).cast("array<struct<lo:int,hi:int>>").alias("spans"))
    found = matched(base, reference.select(F.lit(0).alias("id"), "text").distinct(), window, earlier=False)
    # Of equal rows each gets the spans of one.
    spans = table(spark, found.groupBy("doc_id", "th").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")))
    on = base["doc_id"].eqNullSafe(F.col("_id")) & (base["th"] == F.col("_th"))
    joined = base.drop("spans").join(spans.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "spans"), on, "left")
    return removal_pass(joined.select("doc_id", "text", "spans"), window, True)


def hash_column(name: str):
    """text_hash as a native column."""
    return F.xxhash64(name)


def covered(spans, n: int, window: int) -> np.ndarray:
    mark = np.zeros(n + 1, np.int32)
    for s in spans:
        mark[s["lo"]] += 1
        mark[min(n, s["hi"] + window)] -= 1
    return np.cumsum(mark[:n]) > 0


def removal_pass(rows: DataFrame, window: int, with_text: bool) -> DataFrame:
    """rows: doc_id, text, spans (null: none): counts, digest and the text that stays."""

    def one(step):
        texts = as_bytes(step.column("text"))
        counts, removed, digests, kept = [], [], [], []
        for text, spans in zip(texts, step.column("spans").to_pylist(), strict=True):
            words = (text or b"").split()
            out = text
            gone = 0
            if spans:
                mask = covered(spans, len(words), window)
                gone = int(mask.sum())
                if with_text:
                    out = cut(text, mask)
                words = [w for w, m in zip(words, mask.tolist(), strict=True) if not m]
            counts.append(len(words) + gone)
            removed.append(gone)
            digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
            kept.append(out)
        arrays = [step.column("doc_id").cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
        if with_text:
            arrays.append(pa.array(kept, pa.binary()).cast(pa.string()))
            names.append("kept_text")
        yield pa.RecordBatch.from_arrays(arrays, names=names)

    return text_pass(rows.select("doc_id", "text", "spans"), one, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)


def cut(text: bytes, mask: np.ndarray) -> bytes:
    """text without the marked words; the white space before a removed word goes with it."""
    out, at = [], 0
    for gone, m in zip(mask.tolist(), WORD.finditer(text), strict=True):
        if not gone:
            out.append(text[at : m.end()])
        at = m.end()
    out.append(text[at:])
    return b"".join(out).strip()


def substring_dedup(documents: DataFrame, window: int = WINDOW, gram: int = GRAM, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, with_text, kept_text, a row for each input row.

    Only documents that lose words travel to their spans, as long as their ids fit a broadcast.
    """
    spark = documents.sparkSession
    spans = repeated_spans(documents, window, gram)
    ids = table(spark, spans.select("doc_id").distinct())
    base = documents.select("doc_id", "text")
    if rows_of(ids) <= BROADCAST_ROWS:
        hit = base.join(F.broadcast(ids), "doc_id", "left_semi")
        rest = base.join(F.broadcast(ids), "doc_id", "left_anti").select("doc_id", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))
        joined = hit.withColumn("th", hash_column("text")).join(spans, ["doc_id", "th"], "left").select("doc_id", "text", "spans")
        return removal_pass(rest, window, with_text).unionByName(removal_pass(joined, window, with_text))
    joined = base.withColumn("th", hash_column("text")).join(spans, ["doc_id", "th"], "left")
    return removal_pass(joined.select("doc_id", "text", "spans"), window, with_text)


def keep_rest(documents: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """documents with reduced texts; a text of which nothing is left goes. n_chars follows the text."""
    spark = documents.sparkSession
    spans = repeated_spans(documents, window, gram)
    ids = table(spark, spans.select("doc_id").distinct())
    ids = small(ids)
    # The row rides as one struct, and its text in it only: whatever its columns are called, they meet no name of the plan.
    rows = documents.select("doc_id", whole_row(documents).alias("_row"))
    same = rows.join(ids, "doc_id", "left_anti").select("_row.*")
    hit = rows.join(ids, "doc_id", "left_semi").withColumn("_th", hash_column("_row.text"))
    hit = hit.join(spans.select("doc_id", F.col("th").alias("_th"), F.col("spans").alias("_spans")), ["doc_id", "_th"], "left")
    # A pass, and not a function in a column: a filter on that is pushed below it and runs it twice, in twice the workers.
    others = F.struct(*(F.col(f"_row.`{c}`").alias(c) for c in documents.columns if c != "text"))
    hit = cut_pass(hit.select(F.col("_row.text").alias("text"), "_spans", others.alias("_row")), window).where("text is null or text <> ''")
    changed = {"text": F.col("text")}
    if "n_chars" in documents.columns:
        changed["n_chars"] = F.char_length("text").cast(documents.schema["n_chars"].dataType)
    return same.unionByName(hit.select(*(changed.get(c, F.col(f"_row.`{c}`")).alias(c) for c in documents.columns)))


def cut_pass(rows: DataFrame, window: int) -> DataFrame:
    """rows: text, _spans (null: none), _row: the text that stays, and _row as it is."""

    def one(step):
        out = as_bytes(step.column("text"))
        for i, spans in enumerate(step.column("_spans").to_pylist()):
            if out[i] is not None and spans is not None:
                out[i] = cut(out[i], covered(spans, len(out[i].split()), window))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string()), step.column("_row")], names=["text", "_row"])

    return text_pass(rows, one, with_carry("text string", rows, ("_row",)))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return substring_dedup(documents, with_text=False)


QUERIES = {"op6_substring_dedup": op6}

ORACLE = {
    "op6_substring_dedup": r"""WITH t AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
  win AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM t)),
  firsts AS (SELECT h, min(doc_id) AS f FROM win GROUP BY h),
  starts AS (SELECT win.doc_id, p FROM win JOIN firsts USING (h) WHERE f < win.doc_id),
  gone AS (SELECT doc_id, list(DISTINCT q) AS qs FROM (SELECT doc_id, unnest(range(p, p + 50)) AS q FROM starts) GROUP BY doc_id),
  words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS q FROM t),
  kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.q) AS s, count(*) AS c FROM words
    LEFT JOIN (SELECT doc_id, unnest(qs) AS q, true AS x FROM gone) g ON g.doc_id = words.doc_id AND g.q = words.q WHERE x IS NULL GROUP BY words.doc_id)
  SELECT t.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(c, 0))::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
  FROM t LEFT JOIN kept ON kept.doc_id = t.doc_id""",
}
