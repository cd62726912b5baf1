"""Generalised suffix automaton over word sequences, and its matching statistics."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np


class SuffixAutomaton:
    """Every run of words of every added sequence, with the labels of the sequences that have it.

    Words are numbered by ``vocabulary``; ``length``, ``link`` and ``step`` are
    the usual arrays (Blumer et al. 1985), one entry a state.
    """

    def __init__(self):
        self.vocabulary: dict[bytes, int] = {}
        self.length, self.link, self.step = [0], [-1], [{}]
        self.ends: dict[int, set[int]] = {}
        self.pairs: set[int] = set()
        self.sequences: list[list[int]] = []

    def add(self, words: Iterable[bytes]) -> None:
        number = self.vocabulary
        ids = [number.setdefault(w, len(number)) for w in words]
        label = len(self.sequences)
        self.sequences.append(ids)
        self.pairs.update(a << 32 | b for a, b in zip(ids, ids[1:], strict=False))
        last = 0
        for c in ids:
            last = self._extend(last, c)
            self.ends.setdefault(last, set()).add(label)

    def _new(self, length: int, link: int, step: dict) -> int:
        self.length.append(length)
        self.link.append(link)
        self.step.append(step)
        return len(self.length) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.step[q]))
        self.link[q] = clone
        while p >= 0 and self.step[p].get(c) == q:
            self.step[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        q = self.step[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
        fresh = self._new(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in self.step[p]:
            self.step[p][c] = fresh
            p = self.link[p]
        if p >= 0:
            q = self.step[p][c]
            self.link[fresh] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        return fresh

    def finish(self, window: int) -> SuffixAutomaton:
        """Settle, for each state, which windows end there: (state of the window, whole short sequences)."""
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True)
        owners = {s: set(x) for s, x in self.ends.items()}
        for s in order:
            if self.link[s] > 0 and self.length[self.link[s]] >= min(window, 1) and s in owners:
                owners.setdefault(self.link[s], set()).update(owners[s])
        # The labels of a window: those of the state where its length lies.
        self.window_labels = {s: frozenset(x) for s, x in owners.items() if self.length[s] >= window > self.length[self.link[s]]}
        short: dict[int, list[tuple[int, int]]] = {}
        for label, ids in enumerate(self.sequences):
            if 0 < len(ids) < window:
                s = 0
                for c in ids:
                    s = self.step[s][c]
                short.setdefault(s, []).append((len(ids), label))
        self.short: dict[int, list[tuple[int, int]]] = {}
        if short:
            for s in reversed(order):
                found = self.short.get(self.link[s], []) + short.get(s, [])
                if found:
                    self.short[s] = found
        self.window = window
        self.least = min([window, *(len(x) for x in self.sequences if x)])
        self.pair_array = np.array(sorted(self.pairs), np.int64)
        del self.ends, self.pairs
        return self

    def finish_least(self, window: int) -> SuffixAutomaton:
        """Settle, for each state, the smallest label of a sequence that has its runs."""
        self.first = [len(self.sequences)] * len(self.length)
        for s, labels in self.ends.items():
            self.first[s] = min(labels)
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            up = self.link[s]
            if self.first[s] < self.first[up]:
                self.first[up] = self.first[s]
        self.window = self.least = window
        self.pair_array = np.array(sorted(self.pairs), np.int64)
        del self.ends, self.pairs
        return self

    def repeats(self, ids: list[int]) -> Iterator[tuple[int, int]]:
        """(first word, smallest label) of each window of ids that an added sequence has. After finish_least()."""
        window, link, length = self.window, self.link, self.length
        for i, (s, n) in enumerate(self.statistics(ids)):
            if n >= window:
                while length[link[s]] >= window:
                    s = link[s]
                yield i - window + 1, self.first[s]

    def statistics(self, ids: list[int]) -> Iterator[tuple[int, int]]:
        """(state, length) of the longest run of an added sequence that ends at each word."""
        s = n = 0
        step, link, length = self.step, self.link, self.length
        for c in ids:
            while s and c not in step[s]:
                s = link[s]
                n = length[s]
            t = step[s].get(c)
            if t is None:
                s = n = 0
            else:
                s, n = t, n + 1
            yield s, n

    def windows(self, ids: list[int]) -> Iterator[tuple[int, int, frozenset[int] | tuple[int]]]:
        """(first, last, labels) of each window that occurs in ids."""
        window, link, length = self.window, self.link, self.length
        for i, (s, n) in enumerate(self.statistics(ids)):
            if n >= window:
                w = s
                while length[link[w]] >= window:
                    w = link[w]
                yield i - window + 1, i, self.window_labels[w]
            if self.short:
                w = s
                # The current state may stand for longer runs than the one matched.
                for size, label in self.short.get(w, ()):
                    if size <= n:
                        yield i - size + 1, i, (label,)

    def runs(self, ids: np.ndarray, owner: np.ndarray) -> Iterator[tuple[int, int]]:
        """Where a window can be: [first, end) of words that follow each other as in some sequence.

        ids: word numbers, -1 for other words; owner: the text of each word.
        """
        if not len(ids):
            return
        known = ids >= 0
        tied = np.zeros(len(ids), bool)
        both = np.flatnonzero(known[1:] & known[:-1] & (owner[1:] == owner[:-1])) + 1
        if len(both) and len(self.pair_array):
            keys = ids[both - 1] << 32 | ids[both]
            at = np.searchsorted(self.pair_array, keys)
            at[at == len(self.pair_array)] = 0
            tied[both] = self.pair_array[at] == keys
        starts = np.flatnonzero(known & ~tied)
        # A run goes on while words are tied to the one before.
        breaks = np.flatnonzero(~tied)
        ends = np.append(breaks[1:], len(ids))[np.searchsorted(breaks, starts)]
        long = ends - starts >= self.least
        yield from zip(starts[long].tolist(), ends[long].tolist(), strict=True)
