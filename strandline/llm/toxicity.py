"""Toxic spans by a linear-chain CRF; marginals add up to document scores.

Labels come a document at a time. Words that occur in many more toxic than
clean learning documents, by a likelihood-ratio test after copies are dropped,
are labelled toxic in toxic documents; the CRF is fitted on runs of words around them and
on runs of clean documents. It sees each word's core (letters and digits,
lower case), the core's first five and six characters, both neighbours' cores
and the word's shape.

Scoring runs over whole texts: forward and backward recursions are products
of 2 x 2 matrices, computed for all texts of a step at once in blocks that are
joined afterwards; a text's first word starts a fresh chain. A document's
evidence is the noisy-or of all its words' squared marginals (so that many
words of hardly any suspicion do not add up to much), and a logistic curve
fitted on the learning sample turns it into a score.

The learning sample is bounded by ``MAX_TOXIC`` + ``MAX_CLEAN`` labelled rows,
the least by a hash of doc_id, and by ``MAX_SAMPLE_TEXT`` bytes a text; this
bounds the vocabulary too, which has every core that two sampled texts share.

Defined cases: null or empty text: no words, the score of no evidence; no
learning rows of both labels: score 0; several labels for a doc_id: toxic wins.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import WordTable, as_bytes, flatten, text_pass
from strandline.llm.crf import Crf
from strandline.llm.language_id import held_out

MAX_TOXIC, MAX_CLEAN, MAX_SAMPLE_TEXT = 1_500, 3_000, 200_000
#: Likelihood ratio (chi-square with one degree of freedom) beyond which a word counts as toxic.
MIN_RATIO = 30.0
SHAPES = 4
_CORE = re.compile(r"[\W_]+")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def core(word: bytes) -> str:
    return _CORE.sub("", word.decode()).lower()


def shape_of(text: str, kept: str) -> int:
    """0 plain, 1 capitals only, 2 with symbols inside, 3 without letters and digits; kept: letters and digits."""
    if not kept:
        return 3
    if len(kept) < len(text) - 1:
        return 2
    return 1 if kept.isupper() and len(kept) > 1 else 0


def shape(word: bytes) -> int:
    text = word.decode()
    return shape_of(text, _CORE.sub("", text))


def features(c: str) -> tuple[str, str, str]:
    """A core and the beginnings of it that tie derived words to their root."""
    return c, f"{c[:5]}-" if len(c) > 5 else "", f"{c[:6]}-" if len(c) > 6 else ""


@dataclass
class Tagger:
    vocabulary: dict[str, int]
    own: np.ndarray
    before: np.ndarray
    after: np.ndarray
    shapes: np.ndarray
    move: np.ndarray
    slope: float = 1.0
    offset: float = 0.0
    ready: bool = True

    def row(self, word: bytes) -> tuple[int, int, int, int]:
        """Numbers of the core and its beginnings, and the shape."""
        text = word.decode()
        kept = text if text.isalnum() else _CORE.sub("", text)
        get = self.vocabulary.get
        return (*(get(x, 0) for x in features(kept.lower())), shape_of(text, kept))

    def weights(self, rows: list[tuple]) -> np.ndarray:
        """Scores of words: as themselves, as the word before and as the word after, two labels each."""
        k, five, six, shapes = np.array(rows, np.int64).reshape(-1, 4).T
        return np.concatenate([self.own[k] + self.own[five] + self.own[six] + self.shapes[shapes], self.before[k], self.after[k]], axis=1)

    def score(self, evidence: np.ndarray) -> np.ndarray:
        x = np.log(np.clip(evidence, 1e-6, 1 - 1e-6)) - np.log1p(-np.clip(evidence, 1e-6, 1 - 1e-6))
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * x + self.offset, -30, 30)))


def chain(matrices: np.ndarray, block: int = 256) -> np.ndarray:
    """Row vectors v_t = v_(t-1) T_t, each scaled to sum 1, from v = (1, 1); matrices: (n, 2, 2)."""
    n = len(matrices)
    rows = -(-n // block)
    padded = np.empty((rows * block, 2, 2))
    padded[:n] = matrices
    padded[n:] = np.eye(2)
    t = np.ascontiguousarray(padded.reshape(rows, block, 4).transpose(1, 2, 0))
    q = np.empty_like(t)
    q[0] = t[0] / t[0].sum(0)
    for k in range(1, block):
        a, b, m = q[k - 1], t[k], q[k]
        np.multiply(a[0], b[0], out=m[0])
        m[0] += a[1] * b[2]
        np.multiply(a[0], b[1], out=m[1])
        m[1] += a[1] * b[3]
        np.multiply(a[2], b[0], out=m[2])
        m[2] += a[3] * b[2]
        np.multiply(a[2], b[1], out=m[3])
        m[3] += a[3] * b[3]
        m /= m.sum(0)
    heads = np.empty((2, rows))
    x, y = 0.5, 0.5
    for r, (a, b, c, d) in enumerate(q[-1].T.tolist()):
        heads[:, r] = x, y
        x, y = x * a + y * c, x * b + y * d
        s = x + y
        x, y = x / s, y / s
    out = np.stack([heads[0] * q[:, 0] + heads[1] * q[:, 2], heads[0] * q[:, 1] + heads[1] * q[:, 3]], axis=2)
    out = out.transpose(1, 0, 2).reshape(-1, 2)[:n]
    return out / out.sum(1, keepdims=True)


def marginals(emissions: np.ndarray, first: np.ndarray, move: np.ndarray) -> np.ndarray:
    """P(toxic) of each word; first: whether it starts a text."""
    if not len(emissions):
        return np.zeros(0)
    e = np.exp(np.clip(emissions - emissions.max(1, keepdims=True), -30, 0))
    matrices = np.exp(move)[None] * e[:, None, :]
    matrices[first] = e[first][:, None, :]
    alpha = chain(matrices)
    turned = np.concatenate([np.ones((1, 2, 2)), matrices[:0:-1].transpose(0, 2, 1)])
    beta = chain(turned)[::-1]
    both = alpha * beta
    return both[:, 1] / both.sum(1)


class Scorer:
    def __init__(self, tagger: Tagger):
        self.tagger = tagger
        self.words = WordTable(tagger.row)
        self.array = np.zeros((0, 6))

    def marginals(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """P(toxic) of all words of all texts, and where each text's words start."""
        flat, starts = flatten([t.split() if t else [] for t in texts])
        self.words.trim()
        if not self.words.rows:
            self.array = np.zeros((0, 6))
        numbers = self.words.numbers(flat)
        if len(self.array) < len(self.words.rows):
            self.array = np.concatenate([self.array, self.tagger.weights(self.words.rows[len(self.array) :])])
        rows = self.array[numbers]
        first = np.zeros(len(rows) + 1, bool)
        first[starts[:-1]] = True
        first[-1] = True
        e = rows[:, 0:2].copy()
        e[1:] += np.where(first[1:-1, None], 0.0, rows[:-1, 2:4])
        e[:-1] += np.where(first[1:-1, None], 0.0, rows[1:, 4:6])
        return marginals(e, first[:-1], self.tagger.move), starts

    def evidence(self, p: np.ndarray, starts: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(np.log1p(-np.minimum(p, 1 - 1e-9) ** 2))])
        return -np.expm1(total[starts[1:]] - total[starts[:-1]])


def toxic_words(texts: list[list[str]], toxic: list[int]) -> set[str]:
    """Cores that are tied to toxic documents by a likelihood-ratio test; copies count once."""
    seen: set[int] = set()
    found = [Counter(), Counter()]
    sizes = [0, 0]
    for words, label in zip(texts, toxic, strict=True):
        grams = [xxhash.xxh64_intdigest(" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))]
        sketch = min(grams)
        if sketch in seen:
            continue
        seen.add(sketch)
        sizes[label] += 1
        found[label].update({x for w in set(words) for x in features(w)})
    out = set()
    n1, n0 = max(sizes[1], 1), max(sizes[0], 1)
    for w, a in found[1].items():
        b = found[0][w]
        if not w or a * n0 <= b * n1:
            continue
        p, p1, p0 = (a + b) / (n1 + n0), a / n1, b / n0

        def like(k, n, q):
            return (k * np.log(q) if k else 0.0) + ((n - k) * np.log1p(-q) if n > k else 0.0)

        if 2 * (like(a, n1, p1) + like(b, n0, p0) - like(a, n1, p) - like(b, n0, p)) >= MIN_RATIO:
            out.add(w)
    # A word unknown to clean documents also counts if the beginning it shares with others does.
    return {w for w in found[1] if w in out or (not found[0][w] and features(w)[2] in out)} - {""}


def fit(texts: list[bytes], toxic: list[int]) -> Tagger:
    """The tagger of a learning sample."""
    words = [t.split() for t in texts]
    cores = [[core(w) for w in ws] for ws in words]
    lexicon = toxic_words(cores, toxic)
    counts = Counter(x for cs in cores for x in {y for c in set(cs) for y in features(c)} if x)
    vocabulary = {c: i for i, c in enumerate(sorted(c for c in counts if counts[c] > 1 or c in lexicon), 1)}
    size = len(vocabulary) + 1
    rows, lengths, labels = [], [], []
    rng = np.random.default_rng(11)
    for ws, cs, label in zip(words, cores, toxic, strict=True):
        gold = [int(bool(label) and c in lexicon) for c in cs]
        hits = [i for i, g in enumerate(gold) if g]
        spots = hits or ([int(rng.integers(len(cs)))] if cs else [])
        runs: list[list[int]] = []
        for i in spots:
            lo, hi = max(0, i - 8), min(len(cs), i + 9)
            if runs and lo <= runs[-1][1]:
                runs[-1][1] = hi
            else:
                runs.append([lo, hi])
        for lo, hi in runs:
            for k in range(lo, hi):
                ids = [vocabulary.get(x, 0) for x in features(cs[k])]
                ids.append(size + (vocabulary.get(cs[k - 1], 0) if k else 0))
                ids.append(2 * size + (vocabulary.get(cs[k + 1], 0) if k + 1 < len(cs) else 0))
                ids.append(3 * size + shape(ws[k]))
                rows.append(ids)
                labels.append(gold[k])
            lengths.append(hi - lo)
    crf = Crf(3 * size + SHAPES, 2)
    crf.fit(np.array(rows).ravel(), np.arange(len(rows) + 1) * 6, np.array(lengths), np.array(labels), rounds=8)
    tagger = Tagger(vocabulary, crf.emit[:size], crf.emit[size : 2 * size], crf.emit[2 * size : 3 * size], crf.emit[3 * size :], crf.move)
    # Logistic curve of the evidence, by Newton's method with a weak prior.
    scorer = Scorer(tagger)
    x = []
    for k in range(0, len(texts), 200):
        p, starts = scorer.marginals(texts[k : k + 200])
        x.append(scorer.evidence(p, starts))
    e = np.clip(np.concatenate(x), 1e-6, 1 - 1e-6)
    design = np.stack([np.log(e) - np.log1p(-e), np.ones(len(e))], axis=1)
    y, beta = np.array(toxic, float), np.zeros(2)
    for _ in range(30):
        mu = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (y - mu) - 1e-2 * beta
        hessian = (design * (mu * (1 - mu))[:, None]).T @ design + 1e-2 * np.eye(2)
        beta += np.linalg.solve(hessian, gradient)
    tagger.slope, tagger.offset = float(beta[0]), float(beta[1])
    return tagger


def learning_sample(documents: DataFrame, labels: DataFrame) -> tuple[list[bytes], list[int]]:
    """Texts and labels of the least labelled rows by hash; at most MAX_TOXIC + MAX_CLEAN."""
    marked = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    parts = [marked.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(limit) for value, limit in ((1, MAX_TOXIC), (0, MAX_CLEAN))]
    chosen = parts[0].unionByName(parts[1])
    # At most MAX_TOXIC + MAX_CLEAN ids.
    rows = documents.select("doc_id", "text").where(F.octet_length("text").between(1, MAX_SAMPLE_TEXT)).join(F.broadcast(chosen), "doc_id")
    found = rows.dropDuplicates(["doc_id"]).select("doc_id", "text", "toxic").toArrow().sort_by("doc_id")
    return as_bytes(found.column("text").combine_chunks()), [int(x) for x in found.column("toxic").to_pylist()]


def learn(documents: DataFrame, labels: DataFrame) -> Tagger:
    texts, toxic = learning_sample(documents, labels)
    if len(set(toxic)) < 2:
        zero = np.zeros((1, 2))
        return Tagger({}, zero, zero, zero, np.zeros((SHAPES, 2)), np.zeros((2, 2)), ready=False)
    return fit(texts, toxic)


def tag(documents: DataFrame, tagger: Tagger) -> DataFrame:
    """doc_id, score, predicted, n_toxic_words (marginal 0.5 or more) and spans: runs of them, in code points."""
    shared = documents.sparkSession.sparkContext.broadcast(tagger)
    scorer: Scorer | None = None

    def one(step):
        nonlocal scorer
        scorer = scorer or Scorer(shared.value)
        texts = as_bytes(step.column("text"))
        p, starts = scorer.marginals(texts)
        score = scorer.tagger.score(scorer.evidence(p, starts)) if scorer.tagger.ready else np.zeros(len(texts))
        hit = p >= 0.5 if scorer.tagger.ready else np.zeros(len(p), bool)
        counts, spans = [], []
        hits = np.flatnonzero(hit)
        bounds = np.searchsorted(hits, starts)
        for i, text in enumerate(texts):
            own = hits[bounds[i] : bounds[i + 1]] - starts[i]
            counts.append(len(own))
            out = []
            if len(own):
                places = [m.span() for m in _WORD.finditer(text.decode())]
                chance = p[starts[i] : starts[i + 1]]
                heads = np.flatnonzero(np.diff(own, prepend=-2) > 1).tolist()
                for a, b in zip(heads, [*heads[1:], len(own)], strict=True):
                    lo, hi = int(own[a]), int(own[b - 1])
                    out.append({"start": places[lo][0], "end": places[hi][1], "p": float(chance[lo : hi + 1].max())})
            spans.append(out)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
        yield pa.RecordBatch.from_arrays([step.column("doc_id").cast(pa.int64()), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(counts, pa.int64()), pa.array(spans, kind)], names=["doc_id", "score", "predicted", "n_toxic_words", "spans"])

    def done():
        nonlocal scorer
        scorer = None

    return text_pass(documents.select("doc_id", "text"), one, "doc_id long, score double, predicted int, n_toxic_words long, spans array<struct<start:int,end:int,p:double>>", done)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    tagger = learn(documents, labels.where(~held_out(5, 0)))
    found = tag(documents, tagger)
    return found.select("doc_id", held_out(5, 0).alias("held_out"), "score", "predicted", "n_toxic_words", "spans")


QUERIES = {"op1_toxicity": op1}

ORACLE: dict[str, str] = {}
