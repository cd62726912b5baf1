"""Ranked lexical search: TPUT over term-partitioned postings, exact top k for every item.

Each document becomes one forward row (its length and its counts of the
items' terms) in a written table, and its entries go to inverted lists, cut
into segments of one term and one block of documents, sorted by what an entry
adds to a score. Then, for all items at once:

1. The k greatest entries of every list are fetched, and the documents they
   name are scored whole: the k-th score of an item is its lower bound.
2. No document without an entry of at least bound / (number of the item's lists)
   can reach the bound. Every list is cut at that uniform threshold (``SLACK``
   times lower, which leaves fewer candidates) and what lies above goes to the
   documents' blocks. There sums bound each document from below, and the
   greatest entries under the cuts from above; a document that k others
   surely precede goes, ties by doc_id included.
3. The candidates that are left are looked up in the forward table and scored.

A list is never in one task: a term that all documents hold has a segment a
block. Items are taken in groups of about ``PAIRS`` (item, term) pairs, which
bounds what is broadcast; a larger set of items passes over the corpus once a
group. All sums are 64-bit integers.

Defined cases: null text: no terms; an item without terms, or one that no
document matches: no rows; rows of items with one item_id (null included) are
one item, whose terms are those of all of them; repeated documents rank one by
one; a document without doc_id ranks behind others of its score, and is returned
with a null doc_id.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from strandline.llm.common import arrow_pass, as_bytes, rows_of, small, table, text_pass

TOP = 50
#: (item, term) pairs of a group of items: what tasks hold of the items, and the terms that one pass over texts looks for.
PAIRS = 1 << 20
#: Documents of a block, as a power of two.
BLOCK_BITS = 14
#: How far under bound / lists the lists are cut.
SLACK = 2
#: Stands for a missing doc_id where ties are broken.
NO_ID = (1 << 63) - 1

#: Digits, letters (A-Z as a-z) and every byte of a character beyond ASCII belong to terms; the rest separates them.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TERM_BYTES).split()


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, terms): the distinct terms of every item that has any."""

    def one(step):
        found = [[t.decode() for t in set(terms_of(x))] for x in as_bytes(step.column("text"))]
        yield pa.RecordBatch.from_arrays([step.column("item_id"), pa.array(found, pa.list_(pa.string()))], names=["item_id", "terms"])

    kinds = StructType([items.schema["item_id"], *StructType.fromDDL("terms array<string>").fields])
    terms = text_pass(items.select("item_id", "text"), one, kinds)
    return terms.select("item_id", F.explode("terms").alias("term")).groupBy("item_id").agg(F.array_sort(F.collect_set("term")).alias("terms"))


def forward_table(documents: DataFrame, words: dict[bytes, int]) -> DataFrame:
    """One written row a document: uid, doc_id, n (its terms), terms and tfs (those of words, by number)."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(words)

    def one(step):
        get = shared.value.get
        lengths, numbers, counts, starts = [], [], [], [0]
        for text in as_bytes(step.column("text")):
            terms = terms_of(text)
            lengths.append(len(terms))
            for term, count in Counter(terms).items():
                number = get(term)
                if number is not None:
                    numbers.append(number)
                    counts.append(count)
            starts.append(len(numbers))
        offsets = pa.array(starts, pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x, kind)) for x, kind in ((numbers, pa.int32()), (counts, pa.int64()))]
        yield pa.RecordBatch.from_arrays([step.column("uid"), step.column("doc_id").cast(pa.int64()), pa.array(lengths, pa.int64()), *lists], names=["uid", "doc_id", "n", "terms", "tfs"])

    rows = documents.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text")
    return table(spark, text_pass(rows, one, "uid long, doc_id long, n long, terms array<int>, tfs array<long>"))


class Weights:
    """What an entry adds to a score, from the statistics of the corpus."""

    def __init__(self, documents: int, terms: int, by_term: np.ndarray):
        self.documents, self.terms, self.by_term = documents, terms, by_term

    def entries(self, n: np.ndarray, term: np.ndarray, tf: np.ndarray) -> np.ndarray:
        m = 100 - 50 + (50 * n * self.documents) // max(self.terms, 1)
        return self.by_term[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


def weigh(forward: DataFrame, n_terms: int) -> Weights:
    """Counts over all documents; a document frequency for each term of the items."""
    total = forward.where("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = forward.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    by_term = np.zeros(n_terms, np.int64)
    for term, w in held.select("term", F.floor(1000 * F.log((F.lit(2.0 * total[0] + 2)) / (2 * F.col("df") + 1)))).collect():
        by_term[term] = w
    return Weights(int(total[0]), int(total[1]), by_term)


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and count of every entry of a batch of forward rows."""
    lengths = np.asarray(batch.column("terms").value_lengths())
    return np.repeat(np.arange(batch.num_rows), lengths), np.asarray(batch.column("terms").flatten(), np.int64), np.asarray(batch.column("tfs").flatten(), np.int64)


def inverted_lists(forward: DataFrame, weights: Weights) -> DataFrame:
    """Written segments (term, block, places, entries), by falling entry; term -1 holds the doc_ids of a block instead."""
    spark = forward.sparkSession
    shared = spark.sparkContext.broadcast(weights)
    place = (1 << BLOCK_BITS) - 1

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            row, term, tf = _flat(batch)
            entry = shared.value.entries(np.asarray(batch.column("n"))[row], term, tf)
            uid = np.asarray(batch.column("uid"))
            ids = np.asarray(batch.column("doc_id").fill_null(NO_ID))
            some = entry > 0
            row = np.concatenate([row[some], np.arange(len(uid))])
            term = np.concatenate([term[some], np.full(len(uid), -1)])
            entry = np.concatenate([entry[some], ids])
            block = uid[row] >> BLOCK_BITS
            order = np.lexsort((-entry, block, term))
            row, term, entry, block = row[order], term[order], entry[order], block[order]
            first = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (block[1:] != block[:-1])])
            offsets = pa.array(np.r_[first, len(row)].astype(np.int32))
            places = pa.array((uid[row] & place).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(term[first].astype(np.int32)), pa.array(block[first]), pa.ListArray.from_arrays(offsets, places), pa.ListArray.from_arrays(offsets, pa.array(entry))],
                names=["term", "block", "places", "entries"],
            )

    segments = arrow_pass(forward, run, "term int, block long, places array<int>, entries array<long>")
    return table(spark, segments.repartition("term", "block").sortWithinPartitions("term"))


def list_heads(lists: DataFrame, top: int) -> DataFrame:
    """(term, uid): the greatest entries of every list, ties by uid."""
    heads = lists.where("term >= 0").select("term", "block", F.explode(F.arrays_zip(F.slice("places", 1, top).alias("place"), F.slice("entries", 1, top).alias("entry"))).alias("e"))
    heads = heads.select("term", (F.shiftleft("block", BLOCK_BITS) + F.col("e.place")).alias("uid"), F.col("e.entry").alias("entry"))
    ranked = heads.withColumn("rn", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("entry"), "uid")))
    return ranked.where(F.col("rn") <= top).select("term", "uid")


def look_up(forward: DataFrame, wanted: DataFrame, weights: Weights, terms: list[np.ndarray]) -> DataFrame:
    """(item, uid, doc, score): whole scores of wanted(item, uid) from the forward table."""
    spark = forward.sparkSession
    shared = spark.sparkContext.broadcast((weights, [x.tolist() for x in terms]))

    def run(batches):
        weights, terms = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            row, term, tf = _flat(batch)
            entry = weights.entries(np.asarray(batch.column("n"))[row], term, tf).tolist()
            term = term.tolist()
            starts = np.concatenate([[0], np.cumsum(np.asarray(batch.column("terms").value_lengths()))]).tolist()
            items, scores, back = [], [], []
            for k, wanted_by in enumerate(batch.column("items").to_pylist()):
                get = dict(zip(term[starts[k] : starts[k + 1]], entry[starts[k] : starts[k + 1]], strict=True)).get
                for item in wanted_by:
                    items.append(item)
                    scores.append(sum(get(t, 0) for t in terms[item]))
                    back.append(k)
            back = pa.array(back, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(items, pa.int32()), batch.column("uid").take(back), batch.column("doc_id").fill_null(NO_ID).take(back), pa.array(scores, pa.int64())], names=["item", "uid", "doc", "score"]
            )

    by_document = table(spark, wanted.groupBy("uid").agg(F.collect_set("item").alias("items")))
    return arrow_pass(forward.join(small(by_document), "uid"), run, "item int, uid long, doc long, score long")


def cut_lists(lists: DataFrame, least: np.ndarray) -> DataFrame:
    """Segments down to the least threshold of their term, and rest: the greatest entry under it (0: none)."""
    shared = lists.sparkSession.sparkContext.broadcast(least)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            term, lengths = np.asarray(batch.column("term")), np.asarray(batch.column("entries").value_lengths())
            entry, place = np.asarray(batch.column("entries").flatten()), np.asarray(batch.column("places").flatten())
            of = np.repeat(np.arange(len(term)), lengths)
            bar = np.where(term < 0, np.iinfo(np.int64).min, shared.value[term])
            kept = entry >= bar[of]
            n_kept = np.bincount(of[kept], minlength=len(term))
            starts = np.concatenate([[0], np.cumsum(lengths)])
            under = n_kept < lengths
            rest = np.zeros(len(term), np.int64)
            rest[under] = entry[(starts[:-1] + n_kept)[under]]
            offsets = pa.array(np.concatenate([[0], np.cumsum(n_kept)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("term"), batch.column("block"), pa.ListArray.from_arrays(offsets, pa.array(place[kept])), pa.ListArray.from_arrays(offsets, pa.array(entry[kept])), pa.array(rest)],
                names=["term", "block", "places", "entries", "rest"],
            )

    return arrow_pass(lists, run, "term int, block long, places array<int>, entries array<long>, rest long")


def candidates(cut: DataFrame, bounds: np.ndarray, thresholds: np.ndarray, terms: list[np.ndarray], top: int) -> DataFrame:
    """(item, uid, doc, low, high): documents of every block that may be among an item's top, with bounds of their scores."""
    shared = cut.sparkSession.sparkContext.broadcast((bounds, thresholds, terms))
    size = 1 << BLOCK_BITS

    def run(group: pa.Table) -> pa.Table:
        bounds, thresholds, terms = shared.value
        ids = np.full(size, NO_ID)
        segments: dict[int, list] = {}
        block = group.column("block")[0].as_py() if group.num_rows else 0
        rows = zip(group.column("term").to_pylist(), group.column("places"), group.column("entries"), group.column("rest").to_pylist(), strict=True)
        for term, places, entries, rest in rows:
            places, entries = np.asarray(places.values), np.asarray(entries.values)
            if term < 0:
                ids[places] = entries
            else:
                segments.setdefault(term, []).append((places, -entries, rest))
        found: list[list[np.ndarray]] = [[], [], [], [], []]
        for item, own in enumerate(terms):
            threshold, unseen = thresholds[item], 0
            low, high = np.zeros(size, np.int64), np.zeros(size, np.int64)
            for term in own.tolist():
                parts = segments.get(term)
                if not parts:
                    continue
                cuts = [int(np.searchsorted(falling, -threshold, "right")) for _, falling, _ in parts]
                under = max(int(-falling[k]) if k < len(falling) else rest for k, (_, falling, rest) in zip(cuts, parts, strict=True))
                unseen += under
                for k, (places, falling, _) in zip(cuts, parts, strict=True):
                    low[places[:k]] -= falling[:k]
                    high[places[:k]] -= falling[:k] + under
            high += unseen
            at = np.flatnonzero((high >= bounds[item]) & (low > 0))
            if len(at) > top:
                order = np.lexsort((ids[at], -low[at]))
                last = at[order[top - 1]]
                at = at[(high[at] > low[last]) | ((high[at] == low[last]) & (ids[at] <= ids[last]))]
            for column, values in zip(found, (np.full(len(at), item), (block << BLOCK_BITS) + at, ids[at], low[at], high[at]), strict=True):
                column.append(values)
        columns = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in found]
        return pa.table({"item": pa.array(columns[0].astype(np.int32)), **{name: pa.array(x.astype(np.int64)) for name, x in zip(("uid", "doc", "low", "high"), columns[1:], strict=True)}})

    return cut.groupBy("block").applyInArrow(run, "item int, uid long, doc long, low long, high long")


def _search_group(documents: DataFrame, group: list, item_type, top: int) -> DataFrame:
    """The search for one group of items [(item_id, terms)]."""
    spark = documents.sparkSession
    words: dict[bytes, int] = {}
    terms = [np.array([words.setdefault(t.encode(), len(words)) for t in own], np.int64) for _, own in group]
    forward = forward_table(documents, words)
    weights = weigh(forward, len(words))
    terms = [x[weights.by_term[x] > 0] for x in terms]
    lists = inverted_lists(forward, weights)
    # 1: heads, and whole scores of the documents they name.
    pairs = spark.createDataFrame([(int(t), k) for k, own in enumerate(terms) for t in own], "term int, item int")
    heads = look_up(forward, list_heads(lists, top).join(F.broadcast(pairs), "term").select("item", "uid"), weights, terms)
    bounds = np.ones(len(terms), np.int64)
    for item, scores in heads.where("score > 0").groupBy("item").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")).select("item", F.get("s", F.lit(top - 1))).collect():
        bounds[item] = scores or 1
    # 2: every list cut at one threshold an item.
    counts = np.array([max(len(x), 1) for x in terms], np.int64)
    thresholds = np.maximum(1, -(-bounds // counts) // SLACK)
    least = np.full(max(len(words), 1), NO_ID)
    for own, threshold in zip(terms, thresholds, strict=True):
        np.minimum.at(least, own, threshold)
    bounded = table(spark, candidates(cut_lists(lists, least), bounds, thresholds, terms, top))
    order = Window.partitionBy("item").orderBy(F.desc("low"), "doc", "uid")
    last = bounded.withColumn("rn", F.row_number().over(order)).where(F.col("rn") == top).select("item", F.col("low").alias("last_low"), F.col("doc").alias("last_doc"))
    # 3: whole scores of what may still be among the top.
    left = bounded.join(F.broadcast(last), "item", "left").where("last_low is null or high > last_low or (high = last_low and doc <= last_doc)")
    scored = look_up(forward, left.select("item", "uid"), weights, terms)
    ranked = scored.where("score > 0").withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc", "uid"))).where(F.col("rank") <= top)
    names = spark.createDataFrame([(k, item_id) for k, (item_id, _) in enumerate(group)], StructType([StructField("item", LongType()), item_type]))
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "score")


def search(documents: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the top documents (doc_id, text) of every item (item_id, text)."""
    spark = documents.sparkSession
    queries = table(spark, item_terms(items))
    pairs = queries.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    groups = max(1, -(-pairs // PAIRS))
    out = None
    for k in range(groups):
        group = [(r[0], r[1]) for r in queries.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == k).collect()] if rows_of(queries) else []
        found = _search_group(documents, group, StructField("item_id", items.schema["item_id"].dataType), top)
        out = found if out is None else out.unionByName(found)
    return out


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op11_lexical_search": op11}

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE = {
    "op11_lexical_search": f"""WITH d AS (SELECT doc_id, {_TERMS} AS terms FROM documents),
  s AS (SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d WHERE len(terms) > 0),
  q AS (SELECT DISTINCT item_id, unnest(terms) AS term FROM (SELECT item_id, {_TERMS} AS terms FROM benchmark)),
  p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM d) GROUP BY ALL),
  f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
  w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM f, s),
  r AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
    FROM q JOIN p USING (term) JOIN w USING (term), s GROUP BY item_id, doc_id),
  k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM r WHERE score > 0)
  SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= 50""",
}
