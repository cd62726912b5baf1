"""Language ID: interpolated Kneser-Ney character models, one a language.

Grams are counted within words (a space opens and closes each), so a text's
cross-entropy is the sum over its words, and a word is scored once a worker.
Counting covers every learning row: each task sums its grams, one shuffle adds
them up, and a second derives the continuation counts that the lower orders use.

The models lie side by side in sorted hash arrays: for each order the grams of
all languages with their interpolated log2 probabilities in each, and the
contexts with their back-off weights. Every gram is kept. A caller may bound
the grams of each language and order by ``max_grams``: then the rarest go by a
count cut-off found from the counts' histogram, while discounts and context
totals stay those of all grams and the back-off weights take over their mass.

A language is rejected where the text's bits per character exceed its limit.
The limit starts at the language's own mean and ``slack`` of the distance to
unigram noise (characters drawn alike from all seen); where more than
``REJECTED`` of the language's own documents lie beyond that, it is raised to
their quantile. These are all learning rows that are given their own language,
equal texts once; the quantile is one of their values, found by counts of ranges.

Defined cases: null text, or text without a letter: ``und``, score 0, rejected;
no learning rows: ``und``; ties: the language first in order; learning rows
with null text or lang are left out.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm.common import U64, WordTable, arrow_pass, as_bytes, drop_table, flatten, mix, steps, table, text_pass, with_carry, word64

ORDER = 4
SLACK = 0.5
#: Share of a language's own documents that its limit may reject.
REJECTED = 0.001
#: Binary places of the ranges in which quantiles are sought, before single values.
PLACES = (12, 30)
LETTER = r"\p{L}"


EMPTY = np.array([0x2545F4914F6CDD1D], U64)


def extend(prefix: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Hashes of grams from those of all but their last character."""
    return mix(prefix * word64(0x9E3779B97F4A7C15) + points.astype(U64))


def points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def hash_of(points: np.ndarray) -> np.ndarray:
    """Hashes of grams of one length, a row each."""
    h = np.repeat(EMPTY, len(points))
    for k in range(points.shape[1]):
        h = extend(h, points[:, k])
    return h


def count_pass(learn: DataFrame, order: int) -> DataFrame:
    """(lang, n, gram, c): counts of grams of each length from 1 to order, summed within each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter[bytes]] = {}
        grams: dict[str, dict[str, int]] = {}

        def spill_words() -> None:
            for lang, counts in words.items():
                g = grams.setdefault(lang, {})
                for w, c in counts.items():
                    s = f" {w.decode()} "
                    for i in range(1, len(s)):
                        # Each character after the opening space, with its context inside the word.
                        key = s[max(0, i - order + 1) : i + 1]
                        g[key] = g.get(key, 0) + c
            words.clear()

        def out():
            for lang, g in grams.items():
                keys = list(g)
                for k in range(0, len(keys), 100_000):
                    part = keys[k : k + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array(part), pa.array([g[x] for x in part], pa.int64())], names=["lang", "gram", "c"])
            grams.clear()

        for step in steps(batches):
            for text, lang in zip(as_bytes(step.column("text")), step.column("lang").to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(text.lower().split())
            if sum(map(len, words.values())) > 300_000:
                spill_words()
            if sum(map(len, grams.values())) > 1_500_000:
                yield from out()
        spill_words()
        yield from out()

    return arrow_pass(learn.select("text", "lang"), run, "lang string, gram string, c long")


def gram_counts(learn: DataFrame, order: int, max_grams: int | None) -> tuple[DataFrame, dict[tuple[str, int], float]]:
    """(lang, gram, n, c, total of the context) for every order, and discounts by (lang, n).

    c: raw counts at the top and where a word begins, else continuations.

    A gram that starts with the word's opening space has no character before
    it, so its own count stands for its continuations.
    """
    spark = learn.sparkSession
    top = table(spark, count_pass(learn, order).groupBy("lang", "gram").agg(F.sum("c").alias("c")))
    levels = [top.select("lang", "gram", "c", F.length("gram").alias("n"))]
    # Suffixes: each distinct longer gram is one continuation of what follows its first character.
    current = top.select("lang", "gram", "c")
    for n in range(order - 1, 0, -1):
        shorter = current.where(F.length("gram") == n + 1).groupBy("lang", F.expr("substring(gram, 2)").alias("gram")).agg(F.count(F.lit(1)).alias("c"))
        begun = current.where(F.length("gram") <= n)
        current = begun.unionByName(shorter).groupBy("lang", "gram").agg(F.sum("c").alias("c"))
        levels.append(current.where(F.length("gram") == n).select("lang", "gram", "c", F.length("gram").alias("n")))
    full = levels[0].where(F.col("n") == order)
    for level in levels[1:]:
        full = full.unionByName(level)
    full = table(spark, full)
    # Totals of contexts and counts of counts are of all grams, whether or not the model keeps them.
    context = F.expr("left(gram, n - 1)")
    totals = full.groupBy("lang", "n", context.alias("context")).agg(F.sum("c").alias("total"))
    stats = full.groupBy("lang", "n").agg(F.count(F.lit(1)).alias("grams"), F.count_if(F.col("c") == 1).alias("once"), F.count_if(F.col("c") == 2).alias("twice")).collect()
    kept = full.withColumn("context", context).join(totals, ["lang", "n", "context"]).select("lang", "gram", "n", "c", "total")
    # The least count cut-off at which an order fits.
    for row in stats if max_grams is not None else ():
        if row["grams"] <= max_grams:
            continue
        histogram = full.where((F.col("lang") == row["lang"]) & (F.col("n") == row["n"])).groupBy(F.least("c", F.lit(10_000)).alias("c")).count().orderBy("c").collect()
        left, least = row["grams"], 0
        for h in histogram:
            if left <= max_grams:
                break
            left, least = left - h["count"], h["c"]
        kept = kept.where(~((F.col("lang") == row["lang"]) & (F.col("n") == row["n"]) & (F.col("c") <= least)))
    return kept, {(r["lang"], r["n"]): discount(r["once"], r["twice"]) for r in stats}


def discount(once: int, twice: int) -> float:
    return min(0.95, max(0.1, once / (once + 2 * twice))) if once + twice else 0.5


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in sorted keys, and which are hits."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, keys[at] == wanted


class Weights:
    """Back-off weights by the hash of the context."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values

    def __getitem__(self, context: str) -> float:
        at, hit = find(self.keys, hash_of(points_of(context)[None, :]))
        if not hit[0]:
            raise KeyError(context)
        return float(self.values[at[0]])


class Model:
    """One language's interpolated Kneser-Ney probabilities, in sorted hash arrays; only the driver holds it."""

    def __init__(self, orders: list[tuple], discounts: list[float] | None = None, totals: list[np.ndarray] | None = None):
        """orders[n - 1]: grams of length n (strings, or their code points in rows) and their (continuation) counts.

        discounts and totals (of each gram's context) are of all counts, where orders hold only some;
        what a context's missing grams had goes to its back-off weight.
        """
        self.points, self.grams, self.contexts = [], [], []
        for n, (grams, counts) in enumerate(orders, 1):
            points = points_of("".join(grams)).reshape(len(grams), n) if isinstance(grams, list) else grams
            counts = np.asarray(counts, float)
            away = discounts[n - 1] if discounts else discount(int((counts == 1).sum()), int((counts == 2).sum()))
            keys, first, member = np.unique(hash_of(points[:, :-1]), return_index=True, return_inverse=True)
            total = totals[n - 1] if totals else np.bincount(member, counts, len(keys))[member]
            own = np.maximum(counts - away, 0.0) / total
            # 1 less what the kept grams have: their discounts, and all of the others.
            gamma = np.bincount(member, np.minimum(counts, away) / total, len(keys))
            gamma += np.maximum(0.0, 1 - np.bincount(member, counts, len(keys)) / total[first]) if totals else 0.0
            if n == 1:
                self.floor = 1.0 / (max(1, len(points)) + 1)
                lower = np.full(len(points), self.floor)
            else:
                lower = self.probabilities(points[:, 1:])
            self.contexts.append((keys, gamma))
            h = hash_of(points)
            order = np.argsort(h)
            self.points.append(points[order])
            self.grams.append((h[order], (own + gamma[member] * lower)[order]))
        keys, values = (np.concatenate([c[k] for c in self.contexts]) for k in (0, 1))
        order = np.argsort(keys)
        self.gamma = Weights(keys[order], values[order])

    def probabilities(self, points: np.ndarray) -> np.ndarray:
        """Of each row's last character after the others, backing off as far as needed."""
        out, weight, left = np.empty(len(points)), np.ones(len(points)), np.arange(len(points))
        for n in range(points.shape[1], 0, -1):
            part = points[left, points.shape[1] - n :]
            keys, values = self.grams[n - 1]
            at, hit = find(keys, hash_of(part))
            out[left[hit]] = weight[left[hit]] * values[at[hit]]
            left, part = left[~hit], part[~hit]
            keys, values = self.contexts[n - 1]
            at, hit = find(keys, hash_of(part[:, :-1]))
            weight[left[hit]] *= values[at[hit]]
        out[left] = weight[left] * self.floor
        return out

    def of(self, gram: str) -> float:
        return float(self.probabilities(points_of(gram)[None, :])[0])


class Identifier:
    """All languages' models side by side: for each order the sorted hashes of the grams that any
    language has, with log2 probabilities in every language, and the same of contexts with back-off weights."""

    def __init__(self, order: int, languages: list[str], models: list[Model], slack: float):
        self.order, self.languages, self.slack = order, languages, slack
        self.floor = np.array([math.log2(m.floor) for m in models], np.float32)
        self.grams, self.contexts = [], []
        for n in range(order):
            keys, points = np.zeros(0, U64), np.zeros((0, n + 1), np.uint32)
            if models:
                keys, first = np.unique(np.concatenate([m.grams[n][0] for m in models]), return_index=True)
                points = np.concatenate([m.points[n] for m in models])[first]
            self.grams.append((keys, self.columns([m.probabilities(points) for m in models], len(keys))))
            keys = np.unique(np.concatenate([m.contexts[n][0] for m in models])) if models else np.zeros(0, U64)
            gammas = []
            for m in models:
                own, values = m.contexts[n]
                at, hit = find(own, keys)
                gammas.append(np.ones(len(keys)))
                gammas[-1][hit] = values[at[hit]]
            self.contexts.append((keys, self.columns(gammas, len(keys))))
        self.limits = np.zeros(len(models))

    @staticmethod
    def columns(values: list[np.ndarray], count: int) -> np.ndarray:
        out = np.zeros((count, len(values)), np.float32)
        for k, column in enumerate(values):
            out[:, k] = np.log2(column)
        return out

    def log2(self, hashes: list[np.ndarray], depth: np.ndarray) -> np.ndarray:
        """(positions, languages): log2 p of the character at each position.

        hashes[n][i]: of the gram of length n that ends at i; depth: the longest that stays in its word.
        """
        count = len(depth)
        out = np.empty((count, len(self.floor)), np.float32)
        weight = np.zeros_like(out)
        left = np.arange(count)
        for n in range(self.order, 0, -1):
            fit = left[depth[left] >= n]
            keys, values = self.grams[n - 1]
            at, hit = find(keys, hashes[n][fit])
            out[fit[hit]] = values[at[hit]] + weight[fit[hit]]
            miss = fit[~hit]
            if len(miss):
                keys, values = self.contexts[n - 1]
                prefix = hashes[n - 1][miss - 1] if n > 1 else np.repeat(EMPTY, len(miss))
                at, hit = find(keys, prefix)
                weight[miss[hit]] += values[at[hit]]
            left = np.concatenate([left[depth[left] < n], miss])
        out[left] = self.floor + weight[left]
        return out

    def word_bits(self, words: list[bytes]) -> np.ndarray:
        """(languages + 1) numbers a word: its bits in each language, and its characters with the closing space."""
        points = points_of(" " + b" ".join(words).decode() + " ")
        spaces = np.flatnonzero(points == 32)
        hashes = [np.repeat(EMPTY, len(points))]
        for n in range(1, self.order + 1):
            h = np.zeros(len(points), U64)
            h[n - 1 :] = extend(hashes[n - 1][n - 2 : -1] if n > 1 else hashes[0], points[n - 1 :])
            hashes.append(h)
        sizes = np.diff(spaces)
        depth = np.arange(1, len(points)) - np.repeat(spaces[:-1], sizes) + 1
        bits = -self.log2([h[1:] if n else h for n, h in enumerate(hashes)], depth)
        return np.concatenate([np.add.reduceat(bits, spaces[:-1]), sizes[:, None]], axis=1).astype(np.float32)

    def calibrate(self, samples: list[Iterator[tuple[list[bytes], np.ndarray]]], characters: int) -> None:
        """Limits of each language from chunks of its own words and their counts: mean bits, and those of noise."""
        noise = math.log2(max(characters, 2)) + 2.0
        for k, chunks in enumerate(samples):
            own = length = 0.0
            for words, counts in chunks:
                bits = self.word_bits(words)
                own += float((bits[:, k] * counts).sum())
                length += float((bits[:, -1] * counts).sum())
            mean = own / length
            self.limits[k] = mean + self.slack * max(noise - mean, 1.0)


def learn(learn_rows: DataFrame, order: int = ORDER, max_grams: int | None = None, slack: float = SLACK) -> Identifier:
    """The identifier of all learning rows (text, lang), with every gram unless max_grams bounds them."""
    rows = learn_rows.where("text is not null and lang is not null")
    full, discounts = gram_counts(rows, order, max_grams)
    grams: dict[str, list[list[tuple]]] = {}
    words: dict[str, list[tuple[pa.Array, np.ndarray]]] = {}
    for batch in full.orderBy("lang", "n", "gram").toArrow().to_batches(50_000):
        for lang, n in sorted(set(zip(batch.column("lang").to_pylist(), batch.column("n").to_pylist(), strict=True))):
            part = batch.filter(pc.and_(pc.equal(batch.column("lang"), lang), pc.equal(batch.column("n"), n)))
            counts, totals = (part.column(x).to_numpy(zero_copy_only=False) for x in ("c", "total"))
            points = points_of("".join(part.column("gram").to_pylist())).reshape(part.num_rows, n)
            grams.setdefault(lang, [[] for _ in range(order)])[n - 1].append((points, counts, totals))
            if n == order:
                words.setdefault(lang, []).append((part.column("gram"), counts))
    languages = sorted(grams)
    models = []
    for lang in languages:
        parts = [own or [(np.zeros((0, n), np.uint32), np.zeros(0), np.zeros(0))] for n, own in enumerate(grams.pop(lang), 1)]
        points, counts, totals = ([np.concatenate([p[k] for p in own]) for own in parts] for k in range(3))
        models.append(Model(list(zip(points, counts, strict=True)), [discounts.get((lang, n), 0.5) for n in range(1, order + 1)], totals))
    out = Identifier(order, languages, models, slack)

    def chunks(lang: str):
        """Pieces of words that the top grams hold, with their counts, stand for the language's words."""
        empty = True
        for column, counts in words.get(lang, ()):
            found = [(g.strip().encode() or b"a", c) for g, c in zip(column.to_pylist(), counts.tolist(), strict=True) if " " not in g[1:-1]]
            for k in range(0, len(found), 20_000):
                empty = False
                yield [w for w, _ in found[k : k + 20_000]], np.array([c for _, c in found[k : k + 20_000]], float)
        if empty:
            yield [b"a"], np.ones(1)

    out.calibrate([chunks(lang) for lang in languages], len(np.unique(np.concatenate([m.grams[0][0] for m in models]))) if models else 0)
    if models:
        own_quantiles(rows, out)
    return out


def own_quantiles(rows: DataFrame, identifier: Identifier) -> None:
    """Raise limits to the quantile of the bits of all of the language's own learning rows."""
    spark = rows.sparkSession
    hashed = rows.select("text", F.struct("lang", F.xxhash64("text", F.lit(3)).alias("h")).alias("own"))
    scored = identify(hashed, identifier, carry="own").where("bits is not null and own.lang = lang_pred")
    values = table(spark, scored.select("own.lang", "own.h", "bits").distinct().groupBy("lang", "bits").agg(F.count(F.lit(1)).alias("c")))
    place = {lang: k for k, lang in enumerate(identifier.languages)}
    for lang, limit in quantiles(values).items():
        identifier.limits[place[lang]] = max(identifier.limits[place[lang]], limit)
    drop_table(values)


def quantiles(values: DataFrame) -> dict[str, float]:
    """Of values (lang, bits, c: how often), the least one of each language that at most REJECTED of its own lie above.

    Ranges of values are counted, then those inside the one that the rank falls into: no task sorts a language.
    """
    spark = values.sparkSession
    counted = values.groupBy("lang").agg(F.sum("c").alias("n")).collect()  # a row a language
    wanted = [(r["lang"], None, r["n"] - math.ceil((r["n"] - 1) * (1 - REJECTED))) for r in counted]
    inside = values
    downwards = Window.partitionBy("lang").orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    for places in (*PLACES, None):
        def cut(p: int | None):
            return F.col("bits") if p is None else F.floor(F.col("bits") * 2.0**p).cast("double")

        ranges = inside.groupBy("lang", cut(places).alias("range")).agg(F.sum("c").alias("c"))
        ranked = ranges.withColumn("above", F.coalesce(F.sum("c").over(downwards), F.lit(0)))
        ranks = spark.createDataFrame(wanted, "lang string, range double, rank long")
        found = ranked.join(F.broadcast(ranks.select("lang", "rank")), "lang").where("above < rank and rank <= above + c")  # a row a language
        wanted = [(r["lang"], r["range"], r["rank"] - r["above"]) for r in found.collect()]
        if wanted and places is not None:
            chosen = spark.createDataFrame(wanted, "lang string, range double, rank long").select("lang", "range")
            inside = values.withColumn("range", cut(places)).join(F.broadcast(chosen), ["lang", "range"], "left_semi").drop("range")  # a row a language
    return {lang: value for lang, value, _ in wanted}


class ScoredWords(WordTable):
    """Words with their bits a language, scored many at a time."""

    def __init__(self, identifier: Identifier):
        super().__init__(lambda w: w)
        self.identifier = identifier
        self.array = np.zeros((0, len(identifier.languages) + 1), np.float32)

    def matrix(self) -> np.ndarray:
        if len(self.array) < len(self.rows):
            fresh = self.rows[len(self.array) :]
            self.array = np.concatenate([self.array, *(self.identifier.word_bits(fresh[k : k + 20_000]) for k in range(0, len(fresh), 20_000))])
        return self.array

    def trim(self) -> None:
        super().trim()
        if not self.rows:
            self.array = self.array[:0]


def identify(documents: DataFrame, identifier: Identifier, carry: str = "doc_id") -> DataFrame:
    """The column carry, lang_pred, score, bits (per character, of the best language) and accepted."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(identifier)
    words: ScoredWords | None = None

    def one(step):
        nonlocal words
        model = shared.value
        words = words or ScoredWords(model)
        texts = as_bytes(step.column("text"))
        flat, starts = flatten([t.lower().split() if t else [] for t in texts])
        numbers = words.numbers(flat)
        matrix = words.matrix()
        n = len(model.languages)
        has_letter = step.column("letter").to_pylist()
        pred, score, bits, accepted = [], [], [], []
        for i in range(step.num_rows):
            part = numbers[starts[i] : starts[i + 1]]
            if not has_letter[i] or not len(part) or not n:
                pred.append("und"), score.append(0.0), bits.append(None), accepted.append(False)
                continue
            sums = matrix[part].sum(axis=0, dtype=np.float64)
            rate = sums[:n] / sums[n]
            best = int(np.argmin(rate))
            # Posterior of equally likely languages, softened to 20 characters so that long texts do not all score 1.
            odds = np.exp2(np.clip((rate[best] - rate) * min(sums[n], 20.0), -500, 0))
            pred.append(model.languages[best]), score.append(float(1.0 / odds.sum())), bits.append(float(rate[best]))
            accepted.append(bool(rate[best] <= model.limits[best]))
        words.trim()
        yield pa.RecordBatch.from_arrays([pa.array(pred), pa.array(score), pa.array(bits, pa.float64()), pa.array(accepted), step.column(carry)], names=["lang_pred", "score", "bits", "accepted", carry])

    rows = documents.select(carry, "text", F.coalesce(F.col("text").rlike(LETTER), F.lit(False)).alias("letter"))
    def done():
        nonlocal words
        words = None

    return text_pass(rows, one, with_carry("lang_pred string, score double, bits double, accepted boolean", documents, (carry,)), done)


def held_out(modulus: int, remainder: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    identifier = learn(documents.where(~held_out(3, 1)).select("text", "lang"))
    found = identify(documents, identifier)
    return found.select("doc_id", held_out(3, 1).alias("held_out"), "lang_pred", "score", "bits", "accepted")


QUERIES = {"op3_language_id": op3}

ORACLE: dict[str, str] = {}
