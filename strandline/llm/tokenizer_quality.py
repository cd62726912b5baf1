"""Tokeniser fertility as a quality rule, beside a base rule on words and repeats.

Public vocabularies cut every word (with the space before it, as in running
text); each distinct word is cut once a worker. A document's measures are
characters per token, the share of byte-fallback tokens, the entropy of its
tokens and, from a second vocabulary, characters per token again. Bands of
these, one set for each script, give the method's verdict.

Base measures follow the byte rule of the words; code points are counted as
UTF-8 bytes that do not continue one. Repeats are found by rolling hashes of
8-word windows.

Defined cases: null or wordless text: no words, base_failed, measures null; a
script without bands of its own, or a text without letters: the bands
``Other``; below ``ENTROPY_TOKENS`` tokens the entropy bound shrinks with log2 of
their number, the most that so many tokens can have.
"""

from __future__ import annotations

import base64
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import U64, WordTable, as_bytes, flatten, mix, text_pass, word64, word_hashes
from strandline.llm.substring_dedup import Rolling

PIECES = "/opt/tokenizers/piece_bpe_32k.model"
RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
REPEAT_WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
ENTROPY_TOKENS = 200


@dataclass(frozen=True)
class Band:
    """What a script's ordinary text keeps to."""

    least_chars: float
    most_chars: float
    most_bytes: float
    least_entropy: float
    #: Of the second, byte-level vocabulary.
    least_chars_2: float


#: Bands by script. Wide on purpose: a rule that rejects a clean text costs more than one junk text kept.
BANDS = {
    "Latin": Band(1.35, 7.0, 0.10, 3.5, 1.68),
    "Cyrillic": Band(1.1, 7.0, 0.10, 3.5, 1.0),
    "Greek": Band(0.8, 5.0, 0.30, 3.5, 0.7),
    "Han": Band(0.4, 3.0, 0.80, 3.0, 0.3),
    "Kana": Band(0.4, 3.0, 0.60, 3.0, 0.3),
    "Hangul": Band(0.3, 3.0, 0.85, 3.0, 0.3),
    "Arabic": Band(0.8, 5.0, 0.40, 3.5, 0.6),
    "Devanagari": Band(0.5, 5.0, 0.60, 3.0, 0.3),
    "Other": Band(0.3, 7.0, 0.90, 2.5, 0.3),
}
SCRIPTS = tuple(BANDS)
#: First word of a letter's Unicode name -> script.
_NAMES = {"LATIN": "Latin", "CYRILLIC": "Cyrillic", "GREEK": "Greek", "CJK": "Han", "HIRAGANA": "Kana", "KATAKANA": "Kana", "HANGUL": "Hangul", "ARABIC": "Arabic", "DEVANAGARI": "Devanagari"}

SYMBOLS = b"#*$%&|<>"
_SPACES = bytes([0x20, *range(0x09, 0x0E)])
_POINT = np.array([0 if 0x80 <= b < 0xC0 or b in _SPACES else 1 for b in range(256)], np.int64)
_SYMBOL = np.array([b in SYMBOLS for b in range(256)], np.int64)


def word_script(word: str) -> tuple[int, int]:
    """The script of a word's first letter, and its letters."""
    if word.isascii():
        letters = sum(map(str.isalpha, word))
        return (0, letters) if letters else (len(SCRIPTS) - 1, 0)
    letters = [c for c in word if c.isalpha()]
    if not letters:
        return len(SCRIPTS) - 1, 0
    name = unicodedata.name(letters[0], "").split(" ")[0].split("-")[0]
    return SCRIPTS.index(_NAMES.get(name, "Other")), len(letters)


class Cutter:
    """Tokens of words, remembered."""

    def __init__(self, pieces: str, ranks: str):
        import sentencepiece
        import tiktoken

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.is_byte = np.array([self.pieces.is_byte(i) for i in range(self.pieces.vocab_size())])
        with open(ranks, "rb") as file:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        #: A word is one pre-token here; the pattern of running text would only cut off its punctuation.
        self.second = tiktoken.Encoding("second", pat_str=r"\s?[\p{L}\p{M}]+|\s?\p{N}+|\s?[^\s\p{L}\p{M}\p{N}]+", mergeable_ranks=table, special_tokens={})
        self.table = WordTable(lambda w: w, 400_000)
        self.reset()

    def reset(self) -> None:
        self.ids = np.zeros(0, np.int32)
        self.starts = np.zeros(1, np.int64)
        self.second_count = np.zeros(0, np.int64)
        self.script = np.zeros((0, 2), np.int64)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        self.table.trim()
        if not self.table.rows:
            self.reset()
        out = self.table.numbers(words)
        fresh = [w.decode() for w in self.table.rows[len(self.second_count) :]]
        if fresh:
            cut = self.pieces.encode(fresh, out_type=int, num_threads=1)
            ids, starts = flatten(cut)
            self.ids = np.concatenate([self.ids, np.array(ids, np.int32)])
            self.starts = np.concatenate([self.starts, starts[1:] + self.starts[-1]])
            encode = self.second.encode_ordinary
            self.second_count = np.concatenate([self.second_count, np.fromiter((len(encode(" " + w)) for w in fresh), np.int64, len(fresh))])
            self.script = np.concatenate([self.script, np.array([word_script(w) for w in fresh], np.int64)])
        return out

    def tokens(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of these words in turn, and how many each word has."""
        sizes = self.starts[numbers + 1] - self.starts[numbers]
        before = np.cumsum(sizes) - sizes
        at = np.arange(int(sizes.sum())) - np.repeat(before - self.starts[numbers], sizes)
        return self.ids[at], sizes


def repeated_words(hashes: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """For each text the words in windows that it holds twice or more."""
    n = len(starts) - 1
    if len(hashes) < window:
        return np.zeros(n, np.int64)
    owner = np.repeat(np.arange(n), np.diff(starts))
    at = np.arange(len(hashes) - window + 1)
    at = at[at + window <= starts[owner[at] + 1]]
    keys = mix(Rolling(hashes).runs(at, window) + owner[at].astype(U64) * word64(0xD6E8FEB86659FD93))
    order = np.argsort(keys)
    sorted_keys = keys[order]
    same = sorted_keys[1:] == sorted_keys[:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    mark = np.zeros(len(hashes) + window, np.int64)
    mark[at[twice]] += 1
    np.subtract.at(mark, at[twice] + window, 1)
    return np.add.reduceat(np.append(np.cumsum(mark)[: len(hashes)] > 0, False).astype(np.int64), np.minimum(starts[:-1], len(hashes))) * (np.diff(starts) > 0)


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the values of each text."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[starts[1:]] - total[starts[:-1]]


def entropy_bound(least: float, n_tokens: int) -> float:
    return least * min(1.0, float(np.log2(n_tokens) / np.log2(ENTROPY_TOKENS)))


def entropy(ids: np.ndarray) -> float:
    counts = np.bincount(ids)
    share = counts[counts > 0] / len(ids)
    return float(-(share * np.log2(share)).sum())


def fit_bands(documents: DataFrame, tail: float = 0.005, slack: float = 0.15, pieces: str = PIECES, ranks: str = RANKS) -> dict[str, Band]:
    """Bands by script that all but ``tail`` of these documents keep to at each bound, widened by ``slack``.

    documents: clean ones, such as the learning rows that labels call good; those that fail the base rule do
    not count. Scripts without such a document have no band here. BANDS is wider than what this finds on
    the driver's labelled documents without slack; tests hold the two against each other.
    """
    measured = measure(documents, pieces, ranks).where("not base_failed")
    low = lambda c: F.percentile(c, F.lit(tail)).alias(f"low_{c}")
    high = lambda c: F.percentile(c, F.lit(1 - tail)).alias(f"high_{c}")
    rows = measured.groupBy("script").agg(low("chars_per_token"), high("chars_per_token"), high("byte_share"), low("token_entropy"), low("chars_per_token_2")).collect()
    return {r["script"]: Band(r["low_chars_per_token"] * (1 - slack), r["high_chars_per_token"] * (1 + slack), r["high_byte_share"] * (1 + slack) + 0.01, r["low_token_entropy"] * (1 - slack), r["low_chars_per_token_2"] * (1 - slack)) for r in rows}


SCHEMA = """doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,
  base_failed boolean, kept boolean, script string, n_tokens long, chars_per_token double, chars_per_token_2 double, byte_share double, token_entropy double"""


def measure(documents: DataFrame, pieces: str = PIECES, ranks: str = RANKS, bands: dict[str, Band] | None = None) -> DataFrame:
    """Base measures, fertility measures and verdict of each document."""
    bands = bands or BANDS
    state: list = []

    def one(step):
        if not state:
            state.append(Cutter(pieces, ranks))
        cutter = state[0]
        texts = [t or b"" for t in as_bytes(step.column("text"))]
        flat, starts = flatten([t.split() for t in texts])
        counts = np.diff(starts)
        n = len(texts)
        raw = np.frombuffer(b"".join(texts), np.uint8)
        raw_starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        chars, symbols = sums(_POINT[raw], raw_starts), sums(_SYMBOL[raw], raw_starts)
        dup_lines = []
        for t in texts:
            lines = [x for x in t.split(b"\n") if x.strip()] if b"\n" in t else []
            dup_lines.append(len(lines) - len(set(lines)))
        repeats = repeated_words(word_hashes(texts)[0], starts, REPEAT_WINDOW)
        base_failed = (counts < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * counts)
        numbers = cutter.numbers(flat)
        ids, sizes = cutter.tokens(numbers)
        token_starts = np.concatenate([[0], np.cumsum(sizes)])[starts]
        n_tokens = np.diff(token_starts)
        byte_tokens = sums(cutter.is_byte[ids].astype(np.int64), token_starts)
        second = sums(cutter.second_count[numbers], starts)
        script, letters = cutter.script[numbers].T
        owner = np.repeat(np.arange(n), counts)
        by_script = np.bincount(owner * len(SCRIPTS) + script, weights=letters, minlength=n * len(SCRIPTS)).reshape(n, -1)
        kept, names, entropies = [], [], []
        for i in range(n):
            name = SCRIPTS[int(by_script[i].argmax())] if by_script[i].any() else "Other"
            e = entropy(ids[token_starts[i] : token_starts[i + 1]]) if n_tokens[i] else None
            names.append(name)
            entropies.append(e)
            good = not base_failed[i]
            if good:
                band, rate = bands[name], chars[i] / n_tokens[i]
                good = band.least_chars <= rate <= band.most_chars and byte_tokens[i] <= band.most_bytes * n_tokens[i]
                good = good and chars[i] >= band.least_chars_2 * second[i] and e >= entropy_bound(band.least_entropy, n_tokens[i])
            kept.append(bool(good))
        empty = n_tokens == 0
        at_least = np.maximum(n_tokens, 1)
        arrays = [step.column("doc_id").cast(pa.int64()), *(pa.array(x.astype(np.int64)) for x in (counts, chars, symbols, np.array(dup_lines), repeats)), pa.array(base_failed), pa.array(kept), pa.array(names), pa.array(n_tokens), pa.array(chars / at_least, mask=empty), pa.array(chars / np.maximum(second, 1), mask=empty), pa.array(byte_tokens / at_least, mask=empty), pa.array(entropies, pa.float64())]
        yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in SCHEMA.split(",")])

    return text_pass(documents.select("doc_id", "text"), one, SCHEMA, state.clear)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op2_tokenizer_quality": op2}

ORACLE: dict[str, str] = {}
