"""N-gram Jaccard join: size-aware heavy-light join of shingle sets.

Sets are collapsed to classes of equal sets first (a 64-bit digest names a
class). A pair of classes whose larger set has at most ``boundary`` members
meets in *light* keys: each set enumerates its subsets down to the smallest
size that the intersection of a linked pair can have. Every other pair meets
in *heavy* lists: inverted lists of single shingles. Under any one order of all
shingles a linked pair shares a shingle among the first ``probe`` of the larger
set and the first ``index`` of the smaller one, so each set enters the lists of
these only. The order is by how often a shingle recurs, rarest first, from a
pass over all documents: each task counts its shingles and reports those that
crowd; the ``HOT_SHINGLES`` most crowded go to every task. Any order gives the
same links, a good one gives short lists. The boundary is the size at which
enumeration stops being cheaper by :func:`light_cost` and :func:`heavy_cost`.

Lists with the same members are read once. A list of two is a pair to verify;
of longer ones each member is first verified against the list's leader, and
what links is merged. Then the lists that still hold several components are
scanned, in blocks: parity bitmaps (their Hamming distance never exceeds the
symmetric difference) rule out most pairs, and each member's nearest partner of
another component is verified, until the pairs that are left are few or none
of them merges anything; then all of them are verified. Any link between
different components shares a list, so none is missing.

Links lie inside components. They are counted there by scanning inverted lists
of all shingles of a block of classes, a pair of blocks at a time: counts leave
the scan, pairs never do.

Defined cases: null or wordless text: empty set, linked with nothing,
component_id its own doc_id, n_links 0. Fewer words than the shingle size: one shingle.
Null doc_id: never a component_id unless the whole component has none.
Repeated rows: one result row for each input row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import BROADCAST_ROWS, U64, arrow_pass, as_bytes, components, drop_table, mix, rows_of, small, steps, table, word64, word_hashes

#: Boundaries that the cost formula chooses among: this many sizes at which one more member may be left out.
BOUNDARIES = 3
#: Bytes of a parity bitmap, and of the one of sets with WIDE_FROM members or more.
NARROW, WIDE, WIDE_FROM = 128, 1024, 2_048
#: Shingles that a task counts at a time, and how often one must recur among them to be reported.
COUNTED, CROWDED = 4_000_000, 3
#: Reported shingles that every task gets (12 bytes each). It decides the order of shingles only.
HOT_SHINGLES = 1 << 20
#: Members of one centre that one task compares before the centre is salted.
CENTRE_ROWS = 500
#: Members of one block of a list, and classes of one block of a component.
LIST_ROWS, COMPONENT_ROWS = 2_048, 512
#: Members of a list of which all pairs are compared in one go with other lists.
SHORT_LIST = 16
#: Possible pairs for each member of two blocks up to which all of them are verified at once.
FEW = 2
#: Texts and classes that a task remembers to pass over their repeats.
REMEMBERED = 100_000


def shingle_sets(texts: list[bytes | None], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after another, and the starts."""
    h, starts = word_hashes(texts, lower=True)
    n = len(texts)
    lengths = np.diff(starts)
    owner = np.repeat(np.arange(n), lengths)
    padded = np.concatenate([h, np.zeros(size, U64)])
    value = np.zeros(len(h), U64)
    for k in range(size):
        value += padded[k : k + len(h)] * word64(0x9E3779B97F4A7C15, 2 * k + 1)
    keep = np.arange(len(h)) + size <= starts[owner + 1]
    for i in np.flatnonzero((lengths > 0) & (lengths < size)):
        whole = h[starts[i] : starts[i + 1]]
        value[starts[i]] = sum((int(x) * int(word64(0x9E3779B97F4A7C15, 2 * k + 1)) for k, x in enumerate(whole)), len(whole)) & 0xFFFFFFFFFFFFFFFF
        keep[starts[i]] = True
    value, owner = mix(value[keep]), owner[keep]
    bits = U64(max(1, n.bit_length()))
    order = np.argsort((owner.astype(U64) << (U64(64) - bits)) | (value >> bits))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    out = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(owner, minlength=n), out=out[1:])
    return value, out


class Plan:
    """Which keys a set of a given size emits, for a threshold in percent."""

    def __init__(self, percent: int, boundary: int):
        self.percent, self.boundary = percent, boundary

    def left_out(self, n):
        """Members that the intersection with a linked set may lack at most."""
        return n - -(-n * self.percent // 100)

    def probe(self, n):
        """Members whose lists a set enters to meet smaller sets."""
        return self.left_out(n) + 1

    def index(self, n):
        """Members whose lists a set enters to meet sets of its size or more."""
        return n - -(-2 * n * self.percent // (100 + self.percent)) + 1

    def light(self, n: int) -> bool:
        """Up to the boundary, unless the set is too small to link with any other size or content."""
        return 0 < n <= self.boundary and 100 * n >= self.percent * (n + 1)

    def heavy(self, n):
        """Sets that may link with one beyond the boundary."""
        return n * 100 > self.boundary * self.percent


def boundaries(percent: int) -> list[int]:
    plan = Plan(percent, 0)
    return [n for n in range(1, 1_000) if plan.left_out(n + 1) > plan.left_out(n)][:BOUNDARIES]


def light_cost(n: int, left_out: int) -> float:
    total, term = 1, 1
    for k in range(left_out):
        term = term * (n - k) // (k + 1)
        total += term
    return float(total)


def heavy_cost(probe: int, crowd: float) -> float:
    """List entries, and members met in vain: crowd, a shingle's mean list length beyond itself."""
    return probe * (1.0 + crowd)


def choose_boundary(sizes: dict[int, int], percent: int, crowd: float) -> int:
    """The boundary with the least summed cost. sizes: sets by size, for the sizes it can concern."""
    costs = {}
    for boundary in boundaries(percent):
        plan = Plan(percent, boundary)
        costs[boundary] = 0.0
        for n, count in sizes.items():
            if plan.light(n):
                costs[boundary] += count * light_cost(n, plan.left_out(n))
            if plan.heavy(n):
                costs[boundary] += count * heavy_cost(plan.probe(n), crowd)
    return min(costs, key=lambda b: (costs[b], b)) if costs else 0


def light_keys(members: np.ndarray, plan: Plan) -> np.ndarray:
    n = len(members)
    total, out = members.sum(dtype=U64), []
    for k in range(plan.left_out(n) + 1):
        if k == 0:
            sums = np.array([total], U64)
        elif k == 1:
            sums = total - members
        else:
            sums = total - np.array([members[list(c)].sum(dtype=U64) for c in combinations(range(n), k)], U64)
        out.append(mix(sums + word64((n - k) * 2 + 1, 0xD6E8FEB86659FD93)))
    return np.concatenate(out)


class Order:
    """Rarest first: the crowded shingles by how often they recur, after all others; ties by hash."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        at = np.argsort(tokens)
        self.tokens = tokens[at]
        self.level = 1 + np.log2(np.maximum(counts[at], 1)).astype(np.uint8)
        self.sieve = np.zeros(1 << 22, bool)
        self.sieve[(self.tokens & U64((1 << 22) - 1)).astype(np.int64)] = True

    def levels(self, members: np.ndarray) -> np.ndarray:
        out = np.zeros(len(members), np.int64)
        some = np.flatnonzero(self.sieve[(members & U64((1 << 22) - 1)).astype(np.int64)])
        if len(some):
            at = np.searchsorted(self.tokens, members[some])
            at[at == len(self.tokens)] = 0
            hit = self.tokens[at] == members[some]
            out[some[hit]] = self.level[at[hit]]
        return out


def list_entries(members: np.ndarray, starts: np.ndarray, plan: Plan, order: Order) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, owner, whether for sets of its size or more) of the inverted lists that sets enter."""
    sizes = np.diff(starts)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    level = order.levels(members)
    if level.any():
        # Members are sorted by value within each set already.
        at = np.argsort(owner * 64 + level, kind="stable")
        members = members[at]
    place = np.arange(len(members)) - starts[owner]
    kept = plan.heavy(sizes)[owner] & (place < plan.probe(sizes)[owner])
    return members[kept], owner[kept], (place < plan.index(sizes)[owner])[kept]


def bitmaps(members: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """Parity bitmaps: one bit for each value of a member's last bits; halves of a wide one fold into a narrow one."""
    out: list[bytes] = []
    sizes = np.diff(starts)
    for lo in range(0, len(sizes), 512):
        hi = min(len(sizes), lo + 512)
        part, own = members[starts[lo] : starts[hi]], np.repeat(np.arange(hi - lo), sizes[lo:hi])
        counts = np.bincount(own * (NARROW * 8) + (part & U64(NARROW * 8 - 1)).astype(np.int64), minlength=(hi - lo) * NARROW * 8)
        packed = np.packbits((counts & 1).astype(np.uint8)).reshape(hi - lo, NARROW)
        out.extend(row.tobytes() for row in packed)
    for i in np.flatnonzero(sizes >= WIDE_FROM):
        counts = np.bincount((members[starts[i] : starts[i + 1]] & U64(WIDE * 8 - 1)).astype(np.int64), minlength=WIDE * 8)
        out[i] = np.packbits((counts & 1).astype(np.uint8)).tobytes()
    return out


def class_keys(members: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64 bits that stand for each whole set; order does not matter."""
    totals = []
    for values in (mix(members), members):
        sums = np.concatenate([np.zeros(1, U64), np.cumsum(values, dtype=U64)])
        totals.append(sums[starts[1:]] - sums[starts[:-1]])
    return mix(totals[0] + totals[1] * word64(0xD6E8FEB86659FD93)).view(np.int64)


class Sets:
    """The sets of a task's texts; equal texts are cut once, and each class is new once."""

    def __init__(self, size: int):
        self.size = size
        self.known: dict[bytes, tuple[int, int | None]] = {}
        self.seen: set[int] = set()

    def read(self, texts: list[bytes | None]) -> tuple[list[tuple[int, int | None]], np.ndarray, np.ndarray, np.ndarray, list[int]]:
        """(size, class key) of each text, then members, starts and keys of the classes seen first here, and their texts' places."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        digests = [xxhash.xxh3_128_digest(t or b"") for t in texts]
        fresh: dict[bytes, int] = {}
        for i, d in enumerate(digests):
            if d not in self.known and d not in fresh:
                fresh[d] = i
        places = list(fresh.values())
        members, starts = shingle_sets([texts[i] for i in places], self.size)
        keys, sizes = class_keys(members, starts), np.diff(starts)
        new = np.zeros(len(places), bool)
        for i, (d, key, n) in enumerate(zip(fresh, keys.tolist(), sizes.tolist(), strict=True)):
            self.known[d] = (n, key if n else None)
            if n and key not in self.seen:
                self.seen.add(key)
                new[i] = True
        out = [self.known[d] for d in digests]
        if not new.all():
            members = members[np.repeat(new, sizes)]
            starts = np.concatenate([[0], np.cumsum(sizes[new])])
            keys = keys[new]
        return out, members, starts, keys, [p for p, m in zip(places, new.tolist(), strict=True) if m]


def class_pass(documents: DataFrame, size: int) -> DataFrame:
    """Each row's set size, class key and text hash, a bitmap once for each class and task; and rows of crowded shingles."""
    names = ["doc_id", "n_shingles", "key", "th", "bits", "shingle", "c"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, held, count = Sets(size), [], 0

        def crowded() -> pa.RecordBatch:
            values = np.concatenate(held)
            held.clear()
            values.sort()
            first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
            counts = np.diff(np.append(first, len(values)))
            often = counts >= CROWDED
            found = [pa.array(values[first[often]].view(np.int64)), pa.array(counts[often], pa.int64())]
            return pa.RecordBatch.from_arrays([*(pa.nulls(len(found[0]), k) for k in kinds[:5]), *found], names=names)

        for step in steps(batches):
            texts = as_bytes(step.column("text"))
            rows, members, starts, _, places = sets.read(texts)
            bits: list[bytes | None] = [None] * len(texts)
            for place, b in zip(places, bitmaps(members, starts), strict=True):
                bits[place] = b
            th = np.fromiter((xxhash.xxh64_intdigest(t or b"", seed=42) for t in texts), U64, len(texts))
            arrays = [step.column("doc_id").cast(pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(th.view(np.int64)), pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays([*arrays, *(pa.nulls(len(texts), k) for k in kinds[5:])], names=names)
            held.append(members)
            count += len(members)
            if count >= COUNTED:
                yield crowded()
                count = 0
        if count:
            yield crowded()

    return arrow_pass(documents.select("doc_id", "text"), run, "doc_id long, n_shingles long, key long, th long, bits binary, shingle long, c long")


def entry_pass(documents: DataFrame, size: int, plan: Plan, shared) -> DataFrame:
    """(sig, key, early): the lists of each class, once a task; early: for sets of its size or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, order = Sets(size), Order(*shared.value)
        for step in steps(batches):
            _, members, starts, keys, _ = sets.read(as_bytes(step.column("text")))
            sigs, owner, early = list_entries(members, starts, plan, order)
            found = [(sigs, keys[owner], early)]
            for i in np.flatnonzero(np.diff(starts) <= plan.boundary):
                own = members[starts[i] : starts[i + 1]]
                if plan.light(len(own)):
                    light = light_keys(own, plan)
                    found.append((light, np.full(len(light), keys[i]), np.ones(len(light), bool)))
            sigs, owners, early = (np.concatenate(x) for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(sigs.view(np.int64)), pa.array(owners.astype(np.int64)), pa.array(early)], names=["sig", "key", "early"])

    return arrow_pass(documents.select("text"), run, "sig long, key long, early boolean")


def as_words(column: pa.BinaryArray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Bitmaps as rows of 64-bit words: all of them folded to the narrow width, and the wide ones by place."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    if len(data) == len(column) * NARROW:
        return data.view(U64).reshape(len(column), NARROW // 8), {}
    values = column.to_pylist()
    wide = {i: np.frombuffer(v, U64) for i, v in enumerate(values) if len(v) > NARROW}
    # packbits puts neighbouring bits together, so bit k of the narrow map is bits k, k + 1024, ... of the wide one.
    rows = [np.bitwise_xor.reduce(wide[i].reshape(-1, NARROW // 8)) if i in wide else np.frombuffer(v, U64) for i, v in enumerate(values)]
    return np.stack(rows), wide


def possible(far: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """False where sizes or bitmaps rule a link out."""
    return (np.minimum(n_a, n_b) * 100 >= np.maximum(n_a, n_b) * percent) & (far * (100 + percent) <= (n_a + n_b) * (100 - percent))


def likely_pairs(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b, far, ...) of the pairs that may link; other columns of pairs stay. far: Hamming distance of the bitmaps."""
    others = [c for c in pairs.columns if c not in ("a", "b")]
    side = lambda x: classes.select(F.col("key").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            (x, wide_x), (y, wide_y) = as_words(batch.column("bits_a")), as_words(batch.column("bits_b"))
            far = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            for i in wide_x.keys() & wide_y.keys():
                far[i] = np.bitwise_count(wide_x[i] ^ wide_y[i]).sum(dtype=np.int64)
            kept = pa.array(possible(far, batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy(), percent))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).filter(kept) for c in ("a", "b")), pa.array(far).filter(kept), *(batch.column(c).filter(kept) for c in others)], names=["a", "b", "far", *others])

    extra = "".join(f", {c} {pairs.schema[c].dataType.simpleString()}" for c in others)
    return arrow_pass(both.select("a", "b", "n_a", "n_b", "bits_a", "bits_b", *others), run, f"a long, b long, far long{extra}")


def class_texts(documents: DataFrame, classes: DataFrame, keys: DataFrame, rows: int) -> DataFrame:
    """(key, text): a text of each of the classes keys (rows of them at most, repeats included)."""
    few = rows <= BROADCAST_ROWS
    wanted = classes.join(F.broadcast(keys) if few else keys, "key", "left_semi").select("key", F.col("doc_id").alias("_id"), "th")
    wanted = F.broadcast(wanted) if few else wanted
    base = documents.select("doc_id", "text").withColumn("th", F.xxhash64("text"))
    # doc_id may be repeated or null: the text's hash tells which of its rows is meant.
    found = base.join(wanted, (base["th"] == wanted["th"]) & base["doc_id"].eqNullSafe(wanted["_id"]))
    return table(documents.sparkSession, found.select("key", "text").dropDuplicates(["key"]))


def verify(documents: DataFrame, classes: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of class keys that link, as a table. pairs: a table.

    b's text travels to its centre a; a centre with many members is dealt over
    several salts, and members stream past the centre's set.
    """
    if not rows_of(pairs):
        return pairs
    both = pairs.select(F.explode(F.array("a", "b")).alias("key"))
    texts = class_texts(documents, classes, both, 2 * rows_of(pairs))
    hint = F.broadcast if rows_of(pairs) <= BROADCAST_ROWS else (lambda df: df)
    own = texts.withColumnRenamed("key", "a")
    other = texts.withColumnRenamed("key", "b")
    if rows_of(pairs) <= CENTRE_ROWS:
        centres = own.join(hint(pairs.select("a")), "a", "left_semi").select("a", F.lit(0).alias("salt"), F.lit(None).cast("long").alias("b"), "text")
        members = other.join(hint(pairs.select("a", "b")), "b").select("a", F.lit(0).alias("salt"), "b", "text")
    else:
        salts = pairs.groupBy("a").agg((F.floor(F.count(F.lit(1)) / CENTRE_ROWS) + 1).cast("int").alias("salts"))
        centres = own.join(hint(salts), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), "text")
        dealt = pairs.join(hint(salts), "a").select("a", "b", F.pmod(F.hash("b"), "salts").cast("int").alias("salt"))
        members = other.join(hint(dealt), "b").select("a", "salt", "b", "text")
    parted = centres.unionByName(members).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def run(batches):
        centre = own = None
        for step in steps(batches):
            sets, starts = shingle_sets(as_bytes(step.column("text")), size)
            found = []
            for i, (a, b) in enumerate(zip(step.column("a").to_pylist(), step.column("b").to_pylist(), strict=True)):
                own_set = sets[starts[i] : starts[i + 1]]
                if b is None:
                    centre, own = a, own_set.copy()
                    continue
                assert a == centre
                at = np.searchsorted(own, own_set)
                at[at == len(own)] = 0
                common = int((own[at] == own_set).sum())
                if 100 * common >= percent * (len(own) + len(own_set) - common):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    linked = table(documents.sparkSession, arrow_pass(parted, run, "a long, b long"))
    drop_table(texts)
    return linked


def in_blocks(members: DataFrame, count: str, rows: int) -> DataFrame:
    """members with i and j: each pair of blocks of about so many rows of a group meets once; side tells the block. count: the group's size."""
    dealt = members.withColumn("blocks", (F.floor((F.col(count) - 1) / rows) + 1).cast("int")).withColumn("block", F.pmod(F.hash("key", F.lit(9)), "blocks"))
    at = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    spread = dealt.select(*members.columns, "block", at)
    return spread.select(*members.columns, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).alias("side"))


def group_pass(rows: DataFrame, group: str, function: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str, at_once: bool) -> DataFrame:
    """function on the rows of each (group, i, j) of in_blocks(); at_once: on those of many whole groups in turn."""
    parted = rows.repartition(group, "i", "j").sortWithinPartitions(group, "i", "j")

    def run(batches):
        rest: list[pa.RecordBatch] = []
        last = None
        for batch in batches if at_once else steps(batches):
            if not batch.num_rows:
                continue
            ids = np.stack([batch.column(c).to_numpy() for c in (group, "i", "j")])
            cuts = (np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1).tolist()
            if rest and tuple(ids[:, 0]) != last:
                cuts = [0, *cuts]
            cuts = cuts[-1:] if at_once else cuts
            for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if hi > lo:
                    rest.append(batch.slice(lo, hi - lo))
                if hi < batch.num_rows:
                    if rest:
                        yield from function(pa.Table.from_batches(rest))
                    rest = []
            last = tuple(ids[:, -1])
        if rest:
            yield from function(pa.Table.from_batches(rest))

    return arrow_pass(parted, run, schema)


def pairs_far(words: np.ndarray, wide: dict[int, np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hamming distances of the bitmaps at left and right."""
    far = np.bitwise_count(words[left] ^ words[right]).sum(axis=1, dtype=np.int64)
    if wide:
        for k, (x, y) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
            if x in wide and y in wide:
                far[k] = np.bitwise_count(wide[x] ^ wide[y]).sum(dtype=np.int64)
    return far


class ListScan:
    """Pairs of different components in lists, from rows in the order of (sig, i, j)."""

    NAMES = ("a", "b", "far", "whole", "sig")

    def __init__(self, percent: int, everything: bool):
        self.percent, self.everything = percent, everything

    def rows(self, found: pa.Table) -> Iterator[pa.RecordBatch]:
        """All pairs of short lists, in one go; longer ones one by one."""
        self.sig, self.i, self.j, self.keys, self.roots, self.sizes = (found.column(c).to_numpy() for c in ("sig", "i", "j", "key", "root", "n"))
        self.side = found.column("side").to_numpy()
        self.words, self.wide = as_words(found.column("bits").combine_chunks())
        new = np.ones(len(self.sig), bool)
        new[1:] = (self.sig[1:] != self.sig[:-1]) | (self.i[1:] != self.i[:-1]) | (self.j[1:] != self.j[:-1])
        starts = np.flatnonzero(new)
        counts = np.diff(np.append(starts, len(new)))
        short = (counts <= SHORT_LIST) & (self.i[starts] == self.j[starts])
        for size in np.unique(counts[short]).tolist():
            x, y = np.triu_indices(size, 1)
            at = starts[short & (counts == size)]
            step = max(1, 200_000 // max(1, len(x)))
            for k in range(0, len(at), step):
                left, right = (at[k : k + step, None] + x).ravel(), (at[k : k + step, None] + y).ravel()
                kept = (self.roots[left] != self.roots[right]) & (np.minimum(self.sizes[left], self.sizes[right]) * 100 >= np.maximum(self.sizes[left], self.sizes[right]) * self.percent)
                left, right = left[kept], right[kept]
                far = pairs_far(self.words, self.wide, left, right)
                good = possible(far, self.sizes[left], self.sizes[right], self.percent)
                yield self.batch(left[good], right[good], far[good], True)
        for lo, size in zip(starts[~short].tolist(), counts[~short].tolist(), strict=True):
            yield from self.long(np.arange(lo, lo + size))

    def batch(self, left: np.ndarray, right: np.ndarray, far: np.ndarray, whole: bool) -> pa.RecordBatch:
        a, b = self.keys[left], self.keys[right]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(far), pa.array(np.full(len(a), whole)), pa.array(self.sig[left])], names=list(self.NAMES))

    def long(self, own: np.ndarray) -> Iterator[pa.RecordBatch]:
        """A pair of blocks. Where it has more than FEW pairs a member, only the nearest of each member, unless everything is asked for."""
        same = self.i[own[0]] == self.j[own[0]]
        left, right = (own, own) if same else (own[~self.side[own]], own[self.side[own]])
        if not len(left) or not len(right):
            return
        step = max(1, 2_000_000 // len(right))
        wide_right = [k for k, y in enumerate(right.tolist()) if y in self.wide] if self.wide else []
        matrix = np.stack([self.wide[right[k]] for k in wide_right]) if wide_right else None
        for lo in range(0, len(left), step):
            rows = left[lo : lo + step]
            far = np.zeros((len(rows), len(right)), np.int64)
            for k in range(self.words.shape[1]):
                far += np.bitwise_count(self.words[rows, k][:, None] ^ self.words[right, k][None, :])
            if matrix is not None:
                for r, x in enumerate(rows.tolist()):
                    if x in self.wide:
                        far[r, wide_right] = np.bitwise_count(matrix ^ self.wide[x]).sum(axis=1, dtype=np.int64)
            good = possible(far, self.sizes[rows][:, None], self.sizes[right][None, :], self.percent) & (self.roots[rows][:, None] != self.roots[right][None, :])
            if same:
                good &= self.keys[rows][:, None] < self.keys[right][None, :]
            whole = bool(self.everything or good.sum() <= FEW * (len(rows) + len(right)))
            if not whole:
                far[~good] = 1 << 40
                nearest = np.zeros_like(good)
                nearest[np.arange(len(rows)), far.argmin(axis=1)] = True
                nearest[far.argmin(axis=0), np.arange(len(right))] = True
                good &= nearest
            x, y = np.nonzero(good)
            yield self.batch(rows[x], right[y], far[x, y], whole)


def scan_lists(mixed: DataFrame, classes: DataFrame, percent: int, everything: bool = False) -> DataFrame:
    """mixed: (sig, c, key, root), a table. Pairs (a, b, far, whole, sig) of different components that share a list and may link.

    Where whole is false, only the nearest partner of each member of the list came. Bitmaps meet their lists here
    only: tables and earlier shuffles of lists carry keys.
    """
    scan = ListScan(percent, everything)
    listed = F.broadcast(mixed) if rows_of(mixed) <= BROADCAST_ROWS // 16 else mixed
    sized = listed.join(classes.select("key", "n", "bits"), "key")
    return group_pass(in_blocks(sized, "c", LIST_ROWS), "sig", scan.rows, "a long, b long, far long, whole boolean, sig long", at_once=True)


def banded(members: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(sig, key, home): lists cut by set size. A set is at home in its own band, and a guest of the one below if sets there can be large enough."""
    width = np.log(max(1.25, 101 / percent))
    at = F.floor(F.log("n") / width)
    top = F.exp(at * width) * 100 / percent + 1
    sized = members.join(small(classes).select("key", "n"), "key").select("sig", "key", "n", at.alias("at"), top.alias("top"))
    places = F.array(F.struct(F.col("at").alias("band"), F.lit(True).alias("home")), F.struct(F.when(F.col("n") <= F.col("top"), F.col("at") - 1).alias("band"), F.lit(False).alias("home")))
    spread = sized.select("sig", "key", F.explode(places).alias("place")).where("place.band is not null")
    return spread.select(F.xxhash64("sig", "place.band").alias("sig"), "key", F.col("place.home").alias("home"))


def mixed_lists(longer: DataFrame, root: DataFrame) -> DataFrame:
    """(sig, c, key, root): members of the lists that hold several components. longer: (sig, c, key)."""
    marked = longer.join(small(root), "key", "left").withColumn("root", F.coalesce("root", "key"))
    mixed = marked.groupBy("sig").agg(F.min("root").alias("p"), F.max("root").alias("q")).where("p < q").select("sig")
    return marked.join(mixed, "sig", "left_semi").select("sig", "c", "key", "root")


def merge_classes(spark: SparkSession, documents: DataFrame, lists: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """(key, root) of the components of classes, a table. lists: (sig, key, lead, c)."""
    others = lists.where("key <> lead")
    couples = others.where("c = 2").select(F.col("lead").alias("a"), F.col("key").alias("b"))
    led = others.where("c > 2").groupBy("key").agg(F.max_by("lead", F.struct("c", "lead")).alias("a")).select("a", F.col("key").alias("b"))
    chosen = table(spark, likely_pairs(couples.unionByName(led), classes, percent).select("a", "b"))
    links = verify(documents, classes, chosen, size, percent)
    root = table(spark, components(spark, links).withColumnRenamed("node", "key"))
    longer = lists.where("c > 2").select("sig", "c", "key")
    last = False
    while not last:
        mixed = table(spark, mixed_lists(longer, root))
        if not rows_of(mixed):
            break
        scanned = table(spark, scan_lists(mixed, classes, percent))
        unsettled = scanned.where("not whole")
        last = unsettled.isEmpty()
        near = scanned.groupBy("a", "b").agg(F.min("far").alias("far"), F.max("whole").alias("whole"))
        best = near.where("whole").select("a", "b")
        if not last:
            # Each class tries its nearest partner first where it has too many; a list that gave all its pairs is settled.
            best = best.unionByName(near.where("not whole").groupBy("a").agg(F.min_by("b", F.struct("far", "b")).alias("b")))
            longer = table(spark, longer.join(unsettled.select("sig"), "sig", "left_semi"))
        found = verify(documents, classes, table(spark, best), size, percent)
        if not last and not rows_of(found):
            # The nearest ones merge nothing: all that is left.
            rest = table(spark, mixed.join(unsettled.select("sig"), "sig", "left_semi"))
            found = verify(documents, classes, table(spark, scan_lists(rest, classes, percent, everything=True).select("a", "b").distinct()), size, percent)
            drop_table(rest)
            last = True
        drop_table(mixed)
        drop_table(scanned)
        if rows_of(found):
            links = table(spark, links.unionByName(found))
            root = table(spark, components(spark, links).withColumnRenamed("node", "key"))
    return root


def count_links(documents: DataFrame, classes: DataFrame, root: DataFrame, size: int, percent: int) -> DataFrame:
    """(key, n_links) of the classes in components of several. Counts leave the scan, pairs do not."""
    sizes = root.groupBy("root").agg(F.count(F.lit(1)).alias("members"))
    held = table(documents.sparkSession, root.join(sizes, "root"))
    couples = held.where("members = 2").select("key", F.lit(1).cast("long").alias("n_links"))

    def one(found: pa.Table):
        members, starts = shingle_sets(as_bytes(found.column("text").combine_chunks()), size)
        counts = np.diff(starts)
        owner = np.repeat(np.arange(len(counts)), counts)
        side, keys = found.column("side").to_numpy(), found.column("key").to_numpy()
        same = found.column("i")[0].as_py() == found.column("j")[0].as_py()
        listed = np.ones(len(counts), bool) if same else side
        # Inverted lists of one block; the sets of the other scan them.
        of = listed[owner]
        order = np.argsort(members[of])
        values, owners = members[of][order], owner[of][order]
        degree = np.zeros(len(counts), np.int64)
        for x in range(len(counts)) if same else np.flatnonzero(~side).tolist():
            own = members[starts[x] : starts[x + 1]]
            lo, hi = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
            lengths = hi - lo
            at = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths - lo, lengths)
            common = np.bincount(owners[at], minlength=len(counts))
            linked = (100 * common >= percent * (len(own) + counts - common)) & listed
            linked[x] = False
            degree[x] += int(linked.sum())
            if not same:
                degree += linked
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(degree)], names=["key", "n_links"])

    crowd = held.where("members > 2")
    texts = class_texts(documents, classes, crowd.select("key"), rows_of(held))
    spread = in_blocks(crowd, "members", COMPONENT_ROWS)
    many = texts.join(F.broadcast(spread) if rows_of(held) <= BROADCAST_ROWS // 16 else spread, "key").select("root", "i", "j", "side", "key", "text")
    counted = group_pass(many, "root", one, "key long, n_links long", at_once=False)
    return couples.unionByName(counted).groupBy("key").agg(F.sum("n_links").alias("n_links"))


def jaccard_join(documents: DataFrame, size: int = 3, percent: int = 90, boundary: int | None = None, counted: bool = True) -> DataFrame:
    """doc_id, n_shingles, key (class of equal sets), component_id and n_links of every row.

    n_links: how many other classes the row's class links with; only where counted.
    """
    spark = documents.sparkSession
    found = table(spark, class_pass(documents, size))
    rows = found.where("shingle is null").select("doc_id", "n_shingles", "key", "th", "bits")
    # Any row of a class may speak for it; one with a doc_id if there is one.
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "th")).alias("rep")
    classes = rows.where("bits is not null").groupBy("key").agg(F.first("n_shingles").alias("n"), F.first("bits").alias("bits"), rep)
    classes = table(spark, classes.select("key", "n", "bits", "rep.doc_id", "rep.th"))
    crowded = found.where("shingle is not null").groupBy("shingle").agg(F.sum("c").alias("c"))
    hot = crowded.orderBy(F.desc("c"), "shingle").limit(HOT_SHINGLES).toArrow()
    tokens, counts = hot.column("shingle").to_numpy().view(U64), hot.column("c").to_numpy().astype(np.float32)
    if boundary is None:
        total = classes.agg(F.sum("n")).first()[0] or 1
        sizes = classes.where(F.col("n") <= 2 * boundaries(percent)[-1]).groupBy("n").agg(F.count(F.lit(1)).alias("c"))
        boundary = choose_boundary({r["n"]: r["c"] for r in sizes.collect()}, percent, float(np.square(counts, dtype=float).sum()) / total)
    shared = spark.sparkContext.broadcast((tokens, counts))
    entries = table(spark, entry_pass(documents, size, Plan(percent, boundary), shared))
    met = entries.groupBy("sig").agg(F.min("key").alias("p"), F.max("key").alias("q"), F.max("early").alias("early")).where("p < q and early").select("sig")
    # Never broadcast: it is the largest of these tables, and a shuffle costs the same at every size.
    met = table(spark, met)
    shared_lists = table(spark, entries.select("sig", "key").join(met.hint("merge"), "sig").distinct())
    drop_table(entries)
    drop_table(met)
    members = table(spark, banded(shared_lists, classes, percent))
    drop_table(shared_lists)
    content = members.groupBy("sig").agg(F.min("key").alias("lead"), F.count(F.lit(1)).alias("c"), F.max("home").alias("home"), F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("y"))
    # Lists with the same members count as one.
    once = content.where("c > 1 and home").groupBy("c", "x", "y").agg(F.min("sig").alias("sig"), F.min("lead").alias("lead")).select("sig", "lead", "c")
    once = table(spark, once)
    lists = table(spark, members.select("sig", "key").join(small(once), "sig"))
    drop_table(members)
    drop_table(once)
    root = merge_classes(spark, documents, lists, classes, size, percent)
    drop_table(lists)
    lows = rows.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("rows"))
    grouped = lows.join(small(root), "key", "left").select("key", "low", "rows", F.coalesce("root", "key").alias("root"), F.col("root").isNotNull().alias("linked"))
    least = grouped.groupBy("root").agg(F.min("low").alias("component_id"))
    # Only rows of repeated or linked classes differ from what they say of themselves.
    told = grouped.where("rows > 1 or linked").join(least, "root").select("key", "component_id")
    if counted:
        told = told.join(table(spark, count_links(documents, classes, root, size, percent)), "key", "left")
    told = table(spark, told)
    drop_table(classes)
    out = rows.join(small(told), "key", "left")
    n_links = [F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")] if counted else []
    return out.select("doc_id", "n_shingles", "key", F.coalesce("component_id", "doc_id").alias("component_id"), *n_links)


def keep_one(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Documents without near copies: of each component the row with the smallest doc_id stays.

    Rows with an empty set, or no doc_id, all stay.
    """
    found = jaccard_join(documents, size, percent, counted=False)
    drop = table(documents.sparkSession, found.where("component_id < doc_id").select("doc_id").distinct())
    kept = documents.join(small(drop), "doc_id", "left_anti")
    # Rows that repeat a doc_id are rare: only they are compared by text.
    repeated = table(documents.sparkSession, found.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("doc_id"))
    if not rows_of(repeated):
        return kept.select(documents.columns)
    once = kept.join(small(repeated), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(small(repeated), "doc_id", "left_anti").select(documents.columns).unionByName(once.select(documents.columns))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return jaccard_join(documents).select("doc_id", "n_shingles", "component_id", "n_links")


QUERIES = {"op5_ngram_jaccard_join": op5}

ORACLE: dict[str, str] = {}
