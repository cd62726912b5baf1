"""SentencePiece sampling without replacement: Gumbel top-k by a perturbed A* search over the lattice.

A text's lattice has an arc for each vocabulary piece that fits; a path's
probability is the product of its pieces' probabilities, normalised over all
paths. The search tree branches at arcs, in text order. The root's perturbed
value is a Gumbel draw; the best child keeps its parent's value and the other
children together get a Gumbel draw cut off at it (Maddison et al. 2014, Kool
et al. 2019), so the agenda's best entry always holds the next of the k largest
perturbed paths. A descent follows the best child to a leaf, for all texts of
a step at once; only its k best side branches can ever be popped and are kept.

Where no piece holds two neighbouring characters side by side, no arc crosses
between them: there a text is cut into chunks, the lattice is a chain of their
lattices, and a chunk's arcs are computed once a worker.

The vocabulary files hold merge ranks, not probabilities: a piece of rank r
weighs 1 / (r + ``ZIPF_SHIFT``), the Zipf-Mandelbrot law. A character that is
no piece is one arc of its byte pieces.

Draws come from a counter hashed with the row key and the seed: the same row
gives the same samples under any partitioning.

Defined cases: null text: no samples (null); empty text: one empty sample;
fewer paths than k: all of them, with inclusion 1; rows that repeat a key with
the same text repeat its samples; null key: counts as the key 'null'.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import U64, as_bytes, mix, run_hashes, text_pass, word64

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES = 2
SEED = 20_240_229
#: Fixed constant of the Zipf-Mandelbrot law for word ranks.
ZIPF_SHIFT = 2.7
#: Chunks whose arcs a worker remembers; about 500 bytes each.
CHUNKS = 150_000
#: Arcs of a path whose side branches are drawn for all texts at once.
FIRST = 512
#: No draw of uniform() lifts a Gumbel value further above its location.
REACH = 37.5
SPACE = "▁"
#: Stands for a text's own SPACE sign, which is spelled in byte pieces; no valid text holds it.
STAND = "\udc81"


def bigram_table(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of characters (0: in no piece), and which pairs of them some piece holds side by side."""
    characters = sorted({c for p in pieces for c in p})
    number = np.zeros(0x110000, np.uint16)
    number[[ord(c) for c in characters]] = np.arange(1, len(characters) + 1)
    tied = np.zeros((len(characters) + 1,) * 2, bool)
    for p in pieces:
        for a, b in pairwise(p):
            tied[number[ord(a)], number[ord(b)]] = True
    return number, tied


class Pieces:
    """Vocabulary of a SentencePiece model file: weights, byte pieces and a matcher of all pieces."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        kinds = {"normal": 1, "byte": 6}
        normal = [(i, p.piece, p.score) for i, p in enumerate(model.pieces) if p.type == kinds["normal"]]
        ranks = {i: r for r, (i, _, _) in enumerate(sorted(normal, key=lambda x: (-x[2], x[0])), 1)}
        self.byte_id = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kinds["byte"]}
        self.count = len(model.pieces)
        self.length = np.zeros(self.count, np.int64)
        self.logp = np.zeros(self.count)
        total = math.log(sum(1 / (r + ZIPF_SHIFT) for r in ranks.values()))
        self.bytes = [b""] * self.count
        self.matcher = ahocorasick.Automaton()
        for i, piece, _ in normal:
            self.matcher.add_word(piece, i)
            self.length[i] = len(piece)
            self.logp[i] = -math.log(ranks[i] + ZIPF_SHIFT) - total
            self.bytes[i] = piece.replace(SPACE, " ").encode()
        self.matcher.make_automaton()
        for b, i in self.byte_id.items():
            self.bytes[i] = bytes([b])
        self.byte_logp = float(self.logp[[i for i, _, _ in normal]].min())
        self.number, self.tied = bigram_table([p for _, p, _ in normal])

    def decode(self, ids) -> bytes:
        """The text of a sequence of pieces, without the space that encoding puts first."""
        return b"".join(map(self.bytes.__getitem__, ids))[1:]


class Lattice:
    """Arcs of chunks. Nodes are character positions; arcs of a node lie together, likeliest first."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.limit = CHUNKS
        self.unknown: dict[str, int] = {}
        self.unknown_ids: list[list[int]] = []
        self.clear()

    def clear(self) -> None:
        self.node_of: dict[int, int] = {}
        self.arc_start = np.zeros(0, np.int32)
        self.last = np.zeros(0, bool)
        self.cum, self.logp = np.zeros(0, np.float32), np.zeros(0, np.float32)
        self.to, self.piece = np.zeros(0, np.int32), np.zeros(0, np.int32)

    def cut(self, texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
        """All texts in one (spaces as in the vocabulary, one before each text), borders of its chunks, their hashes, and where each text's start."""
        marked = [SPACE + t.replace(SPACE, STAND).replace(" ", SPACE) if t else "" for t in texts]
        whole = "".join(marked)
        starts = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(m) for m in marked], out=starts[1:])
        if not whole:
            return "", np.zeros(1, np.int64), np.zeros(0, U64), np.zeros(len(texts) + 1, np.int64)
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        number = self.pieces.number[points]
        border = np.ones(len(whole) + 1, bool)
        border[1:-1] = ~self.pieces.tied[number[:-1], number[1:]]
        border[starts] = True
        at = np.flatnonzero(border)
        hashes = run_hashes(mix(points + word64(0x9E3779B97F4A7C15)), at[:-1], at[1:])
        return whole, at, hashes, np.searchsorted(at, starts)

    def nodes(self, whole: str, at: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The first node of each chunk; chunks are known by their hashes."""
        if len(self.node_of) > self.limit:
            self.clear()
        distinct, place, member = np.unique(hashes, return_index=True, return_inverse=True)
        known, names = self.node_of, distinct.tolist()
        fresh = [k for k, h in enumerate(names) if h not in known]
        if fresh:
            places = place[fresh]
            self._add([whole[a:b] for a, b in zip(at[places].tolist(), at[places + 1].tolist(), strict=True)], [names[k] for k in fresh])
        return np.fromiter(map(known.__getitem__, names), np.int64, len(names))[member]

    def _add(self, chunks: list[str], names: list[int]) -> None:
        text = "\0".join(chunks) + "\0"
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        ends = np.cumsum(sizes + 1) - 1
        starts = ends - sizes
        found = np.fromiter(chain.from_iterable(self.pieces.matcher.iter(text)), np.int64).reshape(-1, 2)
        piece = found[:, 1]
        length = self.pieces.length[piece]
        start = found[:, 0] - length + 1
        logp = self.pieces.logp[piece]
        inside = np.ones(len(text), bool)
        inside[ends] = False
        bare = inside.copy()
        bare[start[length == 1]] = False
        # A match never holds the separator unless the vocabulary does; a text's own NUL is a byte arc.
        bare = np.flatnonzero(bare)
        if len(bare):
            codes, logs = [], []
            for at in bare.tolist():
                c = text[at]
                k = self.unknown.get(c)
                if k is None:
                    k = self.unknown[c] = len(self.unknown_ids)
                    self.unknown_ids.append([self.pieces.byte_id[b] for b in (SPACE if c == STAND else c).encode()])
                codes.append(self.pieces.count + k)
                logs.append(self.pieces.byte_logp * len(self.unknown_ids[k]))
            piece = np.concatenate([piece, codes])
            start = np.concatenate([start, bare])
            length = np.concatenate([length, np.ones(len(bare), np.int64)])
            logp = np.concatenate([logp, logs])
        to = start + length
        # beta: log of the summed weight of all ways to the chunk's end, from the end backwards.
        left = np.repeat(ends, sizes + 1) - np.arange(len(text))
        beta = np.zeros(len(text))
        order = np.argsort(left[start] << 32 | start)
        s_start, s_to, s_logp = start[order], to[order], logp[order]
        bounds = np.searchsorted(left[s_start], np.arange(1, int(left.max()) + 2))
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            if lo == hi:
                continue
            own = s_start[lo:hi]
            heads = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            beta[own[heads]] = np.logaddexp.reduceat(s_logp[lo:hi] + beta[s_to[lo:hi]], heads)
        conditional = logp + beta[to] - beta[start]
        order = np.argsort(start << 16 | np.minimum(conditional * -1000, 65_535).astype(np.int64).clip(0))
        start, to, piece, conditional = start[order], to[order], piece[order], conditional[order]
        running = np.cumsum(np.exp(conditional))
        arc_start = np.searchsorted(start, np.arange(len(text)))
        before = np.concatenate([[0.0], running])[arc_start[start]]
        cum = running - before
        final = np.ones(len(start), bool)
        final[:-1] = start[1:] != start[:-1]
        cum[final] = 2.0
        node0, arc0 = len(self.last), len(self.cum)
        self.arc_start = np.concatenate([self.arc_start, (arc_start + arc0).astype(np.int32)])
        self.last = np.concatenate([self.last, ~inside])
        self.cum = np.concatenate([self.cum, cum.astype(np.float32)])
        self.logp = np.concatenate([self.logp, np.minimum(conditional, 0.0).astype(np.float32)])
        self.to = np.concatenate([self.to, (to + node0).astype(np.int32)])
        self.piece = np.concatenate([self.piece, piece.astype(np.int32)])
        self.node_of.update(zip(names, (starts + node0).tolist(), strict=True))

    def walk(self, nodes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Random arcs from each node to its chunk's end: all arcs, and where each walk starts. keys: a number for each walk's draws."""
        n = len(nodes)
        rounds, active, cur, t = [], np.flatnonzero(~self.last[nodes]), nodes[~self.last[nodes]], 0
        count = np.zeros(n, np.int64)
        while len(active):
            u = uniform(keys[active], t)
            arc = self.arc_start[cur]
            rest = np.flatnonzero(u > self.cum[arc])
            while len(rest):
                arc[rest] += 1
                rest = rest[u[rest] > self.cum[arc[rest]]]
            rounds.append((active, arc))
            count[active] += 1
            cur = self.to[arc]
            alive = ~self.last[cur]
            active, cur = active[alive], cur[alive]
            t += 1
        starts = np.zeros(n + 1, np.int64)
        np.cumsum(count, out=starts[1:])
        out = np.zeros(starts[-1], np.int64)
        for t, (active, arc) in enumerate(rounds):
            out[starts[active] + t] = arc
        return out, starts

    def ids(self, arcs: np.ndarray) -> np.ndarray:
        pieces = self.piece[arcs]
        odd = np.flatnonzero(pieces >= self.pieces.count)
        if not len(odd):
            return pieces
        sizes = np.ones(len(pieces), np.int64)
        spelled = [self.unknown_ids[p - self.pieces.count] for p in pieces[odd].tolist()]
        sizes[odd] = [len(x) for x in spelled]
        out = np.repeat(pieces, sizes)
        out[out >= self.pieces.count] = list(chain.from_iterable(spelled))
        return out


def mix_one(h: int) -> int:
    """mix() of one number."""
    mask = 0xFFFFFFFFFFFFFFFF
    h &= mask
    h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & mask
    h = (h ^ h >> 27) * 0x94D049BB133111EB & mask
    return h ^ h >> 31


def uniform_one(key: int, t: int) -> float:
    return ((mix_one(key + (t + 1) * 0x9E3779B97F4A7C15) >> 11) + 0.5) * 2.0**-53


def uniform(keys: np.ndarray, t: int) -> np.ndarray:
    return ((mix(keys + word64(t + 1, 0x9E3779B97F4A7C15)) >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53


def cut_gumbel(mu: np.ndarray, limit, u: np.ndarray) -> np.ndarray:
    """Gumbel draws at mu that stay below limit."""
    with np.errstate(invalid="ignore"):
        return np.where(np.isneginf(mu), -np.inf, -np.logaddexp(-limit, np.log(-np.log(u)) - mu))


def side_values(logp: np.ndarray, phi: np.ndarray, value, keys: np.ndarray) -> np.ndarray:
    """Perturbed values of the branches beside each arc. phi: log-probability before the arc."""
    with np.errstate(divide="ignore"):
        mu = phi + np.log1p(-np.exp(logp))
    return cut_gumbel(mu, value, uniform(keys, 77))


class Search:
    """The agenda of one text."""

    __slots__ = ("agenda", "seed", "chunks", "paths", "found", "draws")

    def __init__(self, seed: int, chunks: np.ndarray):
        self.seed, self.chunks = seed, chunks
        self.agenda: list[tuple] = []
        #: (arcs, chunk of each arc, log-probability before each arc)
        self.paths: list[tuple] = []
        self.found: list[tuple] = []
        self.draws = 0

    def draw(self) -> float:
        self.draws += 1
        return uniform_one(self.seed, 1_000_003 + self.draws)

    def complete(self, arcs: np.ndarray, chunk: np.ndarray, logp: np.ndarray, phi: np.ndarray, value: float, since: int, keep: int, side: np.ndarray, salt) -> None:
        """A path with this perturbed value is found; side branches from arc number since on join the agenda.

        side: the branches' values of the first FIRST arcs.
        """
        self.found.append((arcs, float(phi[-1]), value))
        self.paths.append((arcs, chunk, phi))
        path = len(self.paths) - 1
        if keep <= 0 or since >= len(arcs):
            return
        kept: list[tuple] = []
        # phi only falls: beyond some arc no side branch can reach the best ones found before it.
        at, end = since, since + len(side)
        while True:
            best = np.argpartition(-side, keep)[:keep].tolist() if len(side) > keep else range(len(side))
            kept = sorted([*kept, *((float(side[i]), at + i) for i in best if side[i] > -np.inf)], key=lambda x: (-x[0], x[1]))[:keep]
            if end >= len(arcs) or (len(kept) == keep and phi[end] + REACH < kept[-1][0]):
                break
            at, end = end, min(end + 2 * (end - at), len(arcs))
            side = side_values(logp[at:end], phi[at:end], value, np.arange(at, end).astype(U64) + salt)
        for x, i in kept:
            heapq.heappush(self.agenda, (-x, path, i, (int(arcs[i]),)))

    def branch(self, lattice: Lattice) -> tuple | None:
        """Pop the best entry: (arcs so far with the new one, their chunks, value, level)."""
        if not self.agenda:
            return None
        negative, path, level, taken = heapq.heappop(self.agenda)
        arcs, chunk, phi = self.paths[path]
        lo = int(arcs[level])
        while lo > 0 and lattice.cum[lo - 1] < 2.0:
            lo -= 1
        hi = lo
        while lattice.cum[hi] < 2.0:
            hi += 1
        options = [a for a in range(lo, hi + 1) if a not in taken]
        weights = [math.exp(x) for x in lattice.logp[options].tolist()]
        left, at = self.draw() * sum(weights), 0
        while at + 1 < len(weights) and left > weights[at]:
            left -= weights[at]
            at += 1
        others = sum(weights) - weights[at]
        if len(options) > 1 and others > 0:
            mu = float(phi[level]) + math.log(others)
            again = -float(np.logaddexp(negative, math.log(-math.log(self.draw())) - mu))
            heapq.heappush(self.agenda, (-again, path, level, (*taken, options[at])))
        return np.append(arcs[:level], options[at]), chunk[: level + 1], -negative, level


def sample_texts(texts: list[str | None], seeds: list[int], lattice: Lattice, k: int) -> list[list[tuple] | None]:
    """For each text up to k of (ids, log_prob, perturbed, log_inclusion), best perturbed value first."""
    whole, at, hashes, bounds = lattice.cut([t or "" for t in texts])
    nodes = lattice.nodes(whole, at, hashes)
    del whole, at, hashes
    searches = [Search(s, nodes[a:b]) if t is not None else None for t, s, a, b in zip(texts, seeds, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    for search in searches:
        if search is not None and not len(search.chunks):
            search.found.append((np.zeros(0, np.int64), 0.0, 0.0))
    # (text, arcs fixed so far, their chunks, value, level); the walk goes on in the last arc's chunk.
    none = np.zeros(0, np.int64)
    jobs = [(s, none, none, -math.log(-math.log(s.draw())), -1) for s in searches if s is not None and len(s.chunks)]
    for turn in range(k):
        starts, keys, sizes = [], [], []
        for s, arcs, chunk, _, level in jobs:
            begin = s.chunks
            if level >= 0:
                at = int(chunk[-1])
                begin = np.concatenate([lattice.to[arcs[-1:]], s.chunks[at + 1 :]])
            starts.append(begin)
            sizes.append(len(begin))
            keys.append(np.arange(len(begin)).astype(U64) * word64(0xD6E8FEB86659FD93) + U64(mix_one(s.seed + 31 * turn)))
        if not jobs:
            break
        arcs_all, walk_starts = lattice.walk(np.concatenate(starts), np.concatenate(keys))
        chunk_counts = np.diff(walk_starts)
        offset = 0
        paths, chunks = [], []
        for (_, arcs, chunk, _, level), size in zip(jobs, sizes, strict=True):
            fresh = arcs_all[walk_starts[offset] : walk_starts[offset + size]]
            first = int(chunk[-1]) if level >= 0 else 0
            rest = np.repeat(np.arange(first, first + size), chunk_counts[offset : offset + size])
            offset += size
            paths.append(np.concatenate([arcs, fresh]) if level >= 0 else fresh)
            chunks.append(np.concatenate([chunk, rest]) if level >= 0 else rest)
        ends = np.cumsum([len(x) for x in paths])
        logp = lattice.logp[np.concatenate(paths)].astype(np.float64)
        total = np.zeros(len(logp) + 1)
        np.cumsum(logp, out=total[1:])
        begins = np.concatenate([[0], ends[:-1]])
        since = np.array([j[4] + 1 for j in jobs])
        salts = np.array([mix_one(j[0].seed ^ (turn + 1)) for j in jobs], U64)
        counts = np.clip(ends - begins - since, 0, FIRST)
        level_of = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts - since, counts)
        place = level_of + np.repeat(begins, counts)
        sides = side_values(logp[place], total[place] - np.repeat(total[begins], counts), np.repeat(np.array([j[3] for j in jobs]), counts), level_of.astype(U64) + np.repeat(salts, counts))
        bounds_side = np.concatenate([[0], np.cumsum(counts)])
        following = []
        for i, (s, _, _, value, level) in enumerate(jobs):
            a, b = begins[i], ends[i]
            s.complete(paths[i], chunks[i], logp[a:b], total[a : b + 1] - total[a], value, level + 1, k - turn, sides[bounds_side[i] : bounds_side[i + 1]], salts[i])
            if turn + 1 < k and (found := s.branch(lattice)) is not None:
                following.append((s, *found))
        jobs = following
    out: list[list[tuple] | None] = []
    for s in searches:
        if s is None:
            out.append(None)
            continue
        threshold = -s.agenda[0][0] if s.agenda and len(s.found) == k else None
        rows = []
        for arcs, log_prob, value in s.found:
            inclusion = 0.0
            if threshold is not None:
                x = log_prob - threshold
                inclusion = x if x < -30 else math.log(-math.expm1(-math.exp(min(x, 50.0))))
            rows.append((lattice.ids(arcs), log_prob, value, inclusion))
        out.append(rows)
    return out


_LOADED: dict[str, Lattice] = {}


def lattice_of(path: str) -> Lattice:
    if path not in _LOADED:
        _LOADED[path] = Lattice(Pieces(path))
    return _LOADED[path]


def forget(path: str):
    """Drops the arcs that a worker remembers; the vocabulary stays."""
    return lambda: lattice_of(path).clear()


def row_seed(key, seed: int) -> int:
    return xxhash.xxh64_intdigest(str(key) if key is not None else "null", seed=seed)


SAMPLE = "struct<ids:array<int>,log_prob:double,perturbed:double,log_inclusion:double>"


def _sampled(step, vocabulary: str, k: int, seed: int):
    lattice = lattice_of(vocabulary)
    seeds = [row_seed(x, seed) for x in step.column("doc_id").to_pylist()]
    return lattice, sample_texts(step.column("text").to_pylist(), seeds, lattice, k)


def sample(documents: DataFrame, k: int = SAMPLES, seed: int = SEED, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and samples: up to k distinct segmentations of the whole text."""

    def one(step):
        _, found = _sampled(step, vocabulary, k, seed)
        rows = [None if x is None else [{"ids": ids, "log_prob": lp, "perturbed": g, "log_inclusion": q} for ids, lp, g, q in x] for x in found]
        kind = pa.list_(pa.struct([("ids", pa.list_(pa.int32())), ("log_prob", pa.float64()), ("perturbed", pa.float64()), ("log_inclusion", pa.float64())]))
        yield pa.RecordBatch.from_arrays([step.column("doc_id").cast(pa.int64()), pa.array(rows, kind)], names=["doc_id", "samples"])

    return text_pass(documents.select("doc_id", "text"), one, f"doc_id long, samples array<{SAMPLE}>", forget(vocabulary))


def nested(found: list[list[tuple] | None]) -> pa.ListArray:
    """The ids of all samples of each text, as one flat array under two levels of offsets."""
    counts = [len(rows) if rows else 0 for rows in found]
    flat = [ids for rows in found for ids, *_ in rows or ()]
    inner = np.zeros(len(flat) + 1, np.int32)
    np.cumsum([len(ids) for ids in flat], out=inner[1:])
    values = np.concatenate(flat).astype(np.int32) if flat else np.zeros(0, np.int32)
    outer = np.zeros(len(found) + 1, np.int32)
    np.cumsum(counts, out=outer[1:])
    return pa.ListArray.from_arrays(outer, pa.ListArray.from_arrays(inner, values), mask=pa.array([rows is None for rows in found]))


def sample_digest(documents: DataFrame, k: int = SAMPLES, seed: int = SEED, vocabulary: str = VOCABULARY, with_ids: bool = False, remembered: int = CHUNKS, step_bytes: int | None = None) -> DataFrame:
    """doc_id and, for each sample in turn, its size, scores, SHA-256 of its ids, and whether all decode to the text; with_ids: the ids too.

    remembered and step_bytes: chunks that a worker remembers and bytes of text that it takes at a time; less
    memory, more time.
    """

    def one(step):
        lattice_of(vocabulary).limit = remembered
        lattice, found = _sampled(step, vocabulary, k, seed)
        columns: list[list] = [[] for _ in range(7)]
        for text, rows in zip(as_bytes(step.column("text")), found, strict=True):
            if rows is None:
                values = [0, None, None, None, None, None, None]
            else:
                exact = all((lattice.pieces.decode(ids.tolist()) == text) for ids, *_ in rows)
                values = [len(rows), [len(ids) for ids, *_ in rows], [r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows], [hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest() for ids, *_ in rows], exact]
            for column, value in zip(columns, values, strict=True):
                column.append(value)
        kinds = [pa.int64(), pa.list_(pa.int64()), *[pa.list_(pa.float64())] * 3, pa.list_(pa.string()), pa.bool_()]
        names = ["n_samples", "n_pieces", "log_prob", "perturbed", "log_inclusion", "ids_sha256", "round_trip"]
        extra = [nested(found)] if with_ids else []
        yield pa.RecordBatch.from_arrays([step.column("doc_id").cast(pa.int64()), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True)), *extra], names=["doc_id", *names, *(["ids"] if with_ids else [])])

    return text_pass(documents.select("doc_id", "text"), one, "doc_id long, n_samples long, n_pieces array<long>, log_prob array<double>, perturbed array<double>, log_inclusion array<double>, ids_sha256 array<string>, round_trip boolean" + ", ids array<array<int>>" * with_ids, forget(vocabulary), step_bytes)


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, ids -> doc_id, text; null ids: null text."""

    def run(batches):
        pieces = lattice_of(vocabulary).pieces
        for batch in batches:
            texts = [None if x is None else pieces.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=True)


QUERIES = {"op4_piece_sampling": op4}

ORACLE: dict[str, str] = {}
