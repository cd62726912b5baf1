"""Secret scans: three patterns, and the guess cost of values that stand where credentials stand.

Base spans: assignments to a credential's name, access keys, runs of hex digits;
an assignment's span is the whole match, name and value. Beside them every
value in a credential's context is judged (after a name of ``CONTEXT`` and a
separator, after ``Bearer``, or as the password of a URL), whatever its
characters are. Its cost is the base-10 logarithm of the guesses that the
cheapest segmentation takes, by dynamic programming over the value:

* word: a ranked vocabulary's word, in any case, with common substitutions of letters;
* date: year, month and day in usual orders, or a year;
* repeat: at least as many characters as the period, equal to those a period earlier;
* walk: neighbours on a keyboard, in the alphabet or among digits;
* brute force: each character by the size of its class.

Every segment costs ``SEGMENT`` more. A value whose cost is at least
``LEAST_COST``, and at least ``LEAST_RATE`` a character, is a secret: placeholders,
ordinary words and identifiers are not. Its span has the kind ``guess`` and is
left out where a base span holds it.

The program is linear in the value's length (times periods and word lengths),
and whole texts are scanned; texts without any of the names skip the patterns.

Defined cases: null and empty texts: no spans; bytes are matched, and offsets are
code points of the text; repeated rows are scanned each; extra columns ride along.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import LOWER, as_bytes, text_pass, whole_row, with_carry

WORDS = "/opt/tokenizers/word_bpe_49k.json"
LEAST_COST = 10.0
LEAST_RATE = 0.9
MOST_WORD = 24
MOST_PERIOD = 12
SEGMENT = math.log10(2)
KINDS = ("assign", "access", "hex", "guess")
VALUE_LENGTH = 12

ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
#: AKIA[A-Z0-9]+ of 18 or more characters: a match that is too short holds no longer one.
ACCESS = re.compile(rb"AKIA[A-Z0-9]{14,}")
HEX = re.compile(rb"[0-9a-f]{16,}")
CONTEXT = re.compile(
    rb"""(?:pass(?:word|wd|phrase|code)|pwd|secret|token|api[_ -]?key|access[_ -]?key|private[_ -]?key|credentials?|authorization)["'\]]?\x20{0,4}(?:=>|:=|[:=]|is\x20)\x20{0,4}(?:bearer\x20|basic\x20)?["'`]?([^\s"'`<>,;(){}\[\]]{6,})""",
    re.IGNORECASE,
)
BEARER = re.compile(rb"\bbearer\x20+([^\s\"'`<>,;(){}\[\]]{6,})", re.IGNORECASE)
USERINFO = re.compile(rb"[A-Za-z][A-Za-z0-9+.-]{0,30}://[^\s/:@\"'<>]+:([^\s/@\"'<>]{4,})@")
#: A text without any of these has no match of ASSIGN or CONTEXT.
NAMES = (b"passw", b"passph", b"passc", b"pwd", b"secret", b"token", b"api", b"key", b"credential", b"authorization")

ROWS = ("`1234567890-=", " qwertyuiop[]\\", " asdfghjkl;'", " zxcvbnm,./")
SHIFTED = dict(zip('~!@#$%^&*()_+{}|:"<>?', "`1234567890-=[]\\;',./", strict=True))
_PLACE = {c: (r, k) for r, row in enumerate(ROWS) for k, c in enumerate(row) if c != " "}
KEYS = len(_PLACE)
#: Neighbours of a key: beside it, and the two above and below.
_STEPS = {(0, -1), (0, 1), (-1, 0), (-1, 1), (1, 0), (1, -1)}
LEET = str.maketrans({"4": "a", "@": "a", "8": "b", "3": "e", "1": "l", "!": "i", "0": "o", "$": "s", "5": "s", "7": "t", "+": "t"})


def step_of(a: str, b: str) -> object:
    """The direction from one character to the next on the keyboard, in the alphabet or among digits; None: no neighbours."""
    a, b = a.lower(), b.lower()
    if len(a) == len(b) == 1 and ((a.isalpha() and b.isalpha()) or (a.isdigit() and b.isdigit())) and abs(ord(b) - ord(a)) == 1:
        return ord(b) - ord(a)
    p, q = _PLACE.get(SHIFTED.get(a, a)), _PLACE.get(SHIFTED.get(b, b))
    if p is None or q is None:
        return None
    move = (q[0] - p[0], q[1] - p[1])
    return move if move in _STEPS else None


def char_cost(c: str) -> float:
    return math.log10(10 if "0" <= c <= "9" else 26 if "a" <= c <= "z" or "A" <= c <= "Z" else 33 if c < "\x80" else 100)


def word_cost(part: str, words: dict[str, int]) -> float:
    """Of a part that is a word of the vocabulary; infinite otherwise."""
    lower = part.lower()
    changed, rank = 0, words.get(lower)
    if rank is None:
        plain = lower.translate(LEET)
        rank = words.get(plain) if len(plain) == len(lower) else None
        if rank is None:
            return math.inf
        changed = sum(x != y for x, y in zip(lower, plain, strict=True))
    upper = sum(c.isupper() for c in part)
    if not upper:
        cases = 0
    elif upper == len(part) or (upper == 1 and part[0].isupper()):
        cases = 1
    else:
        cases = min(upper, len(part) - upper) + 1
    return math.log10(rank + 1) + (cases + changed) * math.log10(2)


_DATES = [re.compile(x, re.ASCII) for x in (r"(?P<y>\d{4})(?P<s>[-/._])(?P<m>\d{1,2})(?P=s)(?P<d>\d{1,2})", r"(?P<d>\d{1,2})(?P<s>[-/._])(?P<m>\d{1,2})(?P=s)(?P<y>\d{4})", r"(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})", r"(?P<d>\d{2})(?P<m>\d{2})(?P<y>\d{4})", r"(?P<m>\d{2})(?P<d>\d{2})(?P<y>\d{4})")]
_YEAR = re.compile(r"(?:19|20)\d\d", re.ASCII)


def date_cost(part: str) -> float:
    """Of a part that is a date or a year; infinite otherwise."""
    least = math.inf
    if _YEAR.fullmatch(part):
        least = math.log10(max(20, abs(int(part) - 2000)))
    for pattern in _DATES:
        m = pattern.fullmatch(part)
        if m and 1900 <= int(m["y"]) <= 2100 and 1 <= int(m["m"]) <= 12 and 1 <= int(m["d"]) <= 31:
            separated = math.log10(4) if "s" in pattern.groupindex else 0
            least = min(least, math.log10(365 * max(20, abs(int(m["y"]) - 2000))) + separated)
    return least


def walk_costs(same: bool) -> float:
    """Of one more step of a walk, in the same direction or another."""
    return 0.1 if same else math.log10(8)


def repeat_cost(period: int) -> float:
    return math.log10(period) + math.log10(2)


def guess_cost(value: str, words: dict[str, int]) -> float:
    """Base-10 logarithm of the guesses that the cheapest segmentation of value takes."""
    n, inf = len(value), math.inf
    best, brute = [inf] * (n + 1), [inf] * (n + 1)
    best[0] = 0.0
    walk1, walk2, walk3 = inf, inf, inf
    run = [0] * (MOST_PERIOD + 1)  # characters up to here that equal those a period earlier
    repeat = [inf] * (MOST_PERIOD + 1)
    before = None
    for i in range(1, n + 1):
        c = value[i - 1]
        brute[i] = min(brute[i - 1], best[i - 1] + SEGMENT) + char_cost(c)
        found = brute[i]
        step = step_of(value[i - 2], c) if i > 1 else None
        if step is None:
            walk1, walk2, walk3 = best[i - 1] + SEGMENT + math.log10(KEYS), inf, inf
        else:
            turn = walk_costs(step == before)
            walk1, walk2, walk3 = best[i - 1] + SEGMENT + math.log10(KEYS), walk1 + walk_costs(False), min(walk2, walk3) + turn
        before = step
        found = min(found, walk3)
        for p in range(1, min(MOST_PERIOD, i - 1) + 1):
            if c == value[i - 1 - p]:
                run[p] += 1
                least = max(p, 2)
                if run[p] >= least and i - least >= p:
                    repeat[p] = min(repeat[p], best[i - least] + SEGMENT + repeat_cost(p))
                found = min(found, repeat[p])
            else:
                run[p], repeat[p] = 0, inf
        for length in range(3, min(MOST_WORD, i) + 1):
            cost = word_cost(value[i - length : i], words)
            if cost < inf:
                found = min(found, best[i - length] + SEGMENT + cost)
        if "0" <= c <= "9":
            for length in (4, 8, 9, 10):
                if length <= i:
                    found = min(found, best[i - length] + SEGMENT + date_cost(value[i - length : i]))
        best[i] = found
    return best[n]


@lru_cache(maxsize=2)
def ranked_words(path: str) -> dict[str, int]:
    """word -> rank from a vocabulary file with word ends; its order is by frequency."""
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    words = [w[:-4] for w, _ in sorted(vocabulary.items(), key=lambda x: x[1]) if w.endswith("</w>")]
    return {w: k + 1 for k, w in enumerate(w for w in words if len(w) >= 3 and w.isalpha())}


def is_secret(value: str, words: dict[str, int]) -> float | None:
    """The cost of a value that is hard to guess; None for others."""
    cost = guess_cost(value, words)
    return cost if cost >= LEAST_COST and cost >= LEAST_RATE * len(value) else None


class Scanner:
    """Spans of texts; verdicts of values are remembered."""

    def __init__(self, words: dict[str, int]):
        self.judge = lru_cache(maxsize=20_000)(lambda value: is_secret(value, words))

    def spans(self, text: bytes | None) -> list[tuple[int, int, int, float | None]]:
        """(start, kind, end, cost) by start and kind, in code points."""
        if not text:
            return []
        lower = text.translate(LOWER)
        named = any(name in lower for name in NAMES)
        found = []
        if named:
            found += [(m.start(), 0, m.end(), None) for m in ASSIGN.finditer(text) if len(m[2]) >= VALUE_LENGTH]
        if b"AKIA" in text:
            found += [(m.start(), 1, m.end(), None) for m in ACCESS.finditer(text)]
        found += [(m.start(), 2, m.end(), None) for m in HEX.finditer(text)]
        values = {m.span(1) for m in CONTEXT.finditer(text)} if named else set()
        if b"bearer" in lower:
            values |= {m.span(1) for m in BEARER.finditer(text)}
        if b"://" in text:
            values |= {m.span(1) for m in USERINFO.finditer(text)}
        if values:
            starts = sorted((s, -e) for s, _, e, _ in found)
            reach = np.maximum.accumulate([-e for _, e in starts]) if starts else np.zeros(0)
            for start, end in sorted(values):
                while end > start and text[end - 1] in b".:!?&":
                    end -= 1
                k = int(np.searchsorted([s for s, _ in starts], start, "right"))
                if k and reach[k - 1] >= end:
                    continue
                cost = self.judge(text[start:end].decode("utf-8", "replace"))
                if cost is not None:
                    found.append((start, 3, end, cost))
        if found and not text.isascii():
            points = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
            found = [(int(points[s]), kind, int(points[e]), cost) for s, kind, e, cost in found]
        return sorted(found, key=lambda x: x[:3])


def find_secrets(documents: DataFrame, carry: tuple[str, ...] = (), words: str = WORDS) -> DataFrame:
    """n_assign, n_access, n_hex, n_guess, base_sha256, spans (kind:start:end, comma-joined), found (an array of structs with costs), and columns of carry."""

    def one(step):
        scanner = scanner_of(words)
        every = [scanner.spans(text) for text in as_bytes(step.column("text"))]
        named = [[f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in x] for x in every]
        base = [",".join(n for n, y in zip(names, x, strict=True) if y[1] < 3) for names, x in zip(named, every, strict=True)]
        counts = [pa.array([sum(y[1] == k for y in x) for x in every], pa.int64()) for k in range(4)]
        found = pa.array([[{"kind": KINDS[k], "start": s, "end": e, "cost": c} for s, k, e, c in x] for x in every], pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("cost", pa.float64())])))
        columns = [*counts, pa.array([hashlib.sha256(x.encode()).hexdigest() for x in base]), pa.array([",".join(x) for x in named], pa.string()), found]
        yield pa.RecordBatch.from_arrays([*columns, *(step.column(f"c{k}") for k in range(len(carry)))], names=[*OUT, *carry])

    rows = documents.select("text", *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(carry)))
    return text_pass(rows, one, with_carry("n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string, found array<struct<kind: string, start: long, end: long, cost: double>>", documents, carry))


OUT = ("n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans", "found")


@lru_cache(maxsize=2)
def scanner_of(words: str) -> Scanner:
    return Scanner(ranked_words(words))


def redact(documents: DataFrame, mark: str = "[REDACTED]", words: str = WORDS) -> DataFrame:
    """All columns of documents; each maximal run of overlapping spans of text becomes mark."""
    rows = documents.select("text", whole_row(documents).alias("_row"))
    scanned = find_secrets(rows, ("_row",), words)
    text = F.col("_row.text")
    # Spans are in order of start; what lies between the furthest end so far and the next start stays.
    done = F.aggregate(
        "found",
        F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda acc, s: F.struct(
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mark))).otherwise(acc["out"]).alias("out"),
            F.greatest(acc["at"], s["end"]).alias("at"),
        ),
    )
    kept = scanned.select("_row", done.alias("_done"))
    clean: Column = F.when(text.isNotNull(), F.concat("_done.out", F.substring(text, (F.col("_done.at") + 1).cast("int"), F.length(text))))
    return kept.select(*(clean.alias(c) if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in documents.columns))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"), ("doc_id",)).select("doc_id", "n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans")


QUERIES = {"op12_secret_scan": op12}

ORACLE: dict[str, str] = {}
