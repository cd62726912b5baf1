"""A linear-chain conditional random field with hashed binary features, on NumPy alone.

Scores are linear: an emission for each (feature, label) and a transition for
each pair of labels. Sequences of a batch are padded and laid out time first,
so that the recursions run once a position for the whole batch.
"""

from __future__ import annotations

import numpy as np


def pad(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sequences that follow each other in a flat array: (time, sequence) indices into it, and which are real."""
    starts = np.cumsum(lengths) - lengths
    t = np.arange(int(lengths.max()) if len(lengths) else 0)[:, None]
    mask = t < lengths[None, :]
    return np.where(mask, starts[None, :] + t, 0), mask


def logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


class Crf:
    def __init__(self, features: int, labels: int):
        self.emit = np.zeros((features, labels))
        self.move = np.zeros((labels, labels))

    def scores(self, feature_ids: np.ndarray, row_starts: np.ndarray) -> np.ndarray:
        """Emission scores of rows whose active features follow each other."""
        total = np.concatenate([np.zeros((1, self.emit.shape[1])), np.cumsum(self.emit[feature_ids], axis=0)])
        return total[row_starts[1:]] - total[row_starts[:-1]]

    def forward_backward(self, emissions: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(marginals, summed pair marginals, log partition of each sequence); emissions: flat rows."""
        index, mask = pad(lengths)
        e = emissions[index]
        steps, n, labels = e.shape
        alpha = np.zeros_like(e)
        beta = np.zeros_like(e)
        alpha[0] = e[0]
        for t in range(1, steps):
            new = logsumexp(alpha[t - 1][:, :, None] + self.move[None], 1) + e[t]
            alpha[t] = np.where(mask[t][:, None], new, alpha[t - 1])
        for t in range(steps - 2, -1, -1):
            new = logsumexp(self.move[None] + (e[t + 1] + beta[t + 1])[:, None, :], 2)
            beta[t] = np.where(mask[t + 1][:, None], new, 0.0)
        z = logsumexp(alpha[-1], 1)
        marginals = np.exp(alpha + beta - z[None, :, None])
        pairs = np.zeros((labels, labels))
        for t in range(1, steps):
            live = mask[t]
            joint = alpha[t - 1][live][:, :, None] + self.move[None] + (e[t] + beta[t])[live][:, None, :] - z[live][:, None, None]
            pairs += np.exp(joint).sum(0)
        return marginals.transpose(1, 0, 2)[mask.T], pairs, z

    def viterbi(self, emissions: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The best labels, flat like the emissions."""
        index, mask = pad(lengths)
        e = emissions[index]
        steps, n, _ = e.shape
        best = e[0].copy()
        back = np.zeros(e.shape, np.int8)
        for t in range(1, steps):
            options = best[:, :, None] + self.move[None]
            back[t] = options.argmax(1)
            best = np.where(mask[t][:, None], options.max(1) + e[t], best)
        labels = np.zeros((steps, n), np.int8)
        last = best.argmax(1)
        for t in range(steps - 1, -1, -1):
            labels[t] = last
            if t:
                last = np.where(mask[t], back[t][np.arange(n), last], last)
        return labels.T[mask.T]

    def fit(self, feature_ids: np.ndarray, row_starts: np.ndarray, lengths: np.ndarray, labels: np.ndarray, rounds: int = 60, rate: float = 0.5, l2: float = 1e-4, batch: int = 256, seed: int = 7) -> Crf:
        """Maximum likelihood by Adagrad over batches of sequences; rows and sequences follow each other."""
        rng = np.random.default_rng(seed)
        seen_emit, seen_move = np.full_like(self.emit, 1e-6), np.full_like(self.move, 1e-6)
        seq_starts = np.concatenate([[0], np.cumsum(lengths)])
        by_length = np.argsort(lengths, kind="stable")
        groups = [by_length[k : k + batch] for k in range(0, len(by_length), batch)]
        for _ in range(rounds):
            for g in rng.permutation(len(groups)):
                group = groups[g]
                rows = np.concatenate([np.arange(seq_starts[s], seq_starts[s + 1]) for s in group])
                counts = (row_starts[1:] - row_starts[:-1])[rows]
                at = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts - row_starts[:-1][rows], counts)
                ids = feature_ids[at]
                emissions = self.scores(ids, np.concatenate([[0], np.cumsum(counts)]))
                marginals, pairs, _ = self.forward_backward(emissions, lengths[group])
                gold = labels[rows]
                delta = marginals
                delta[np.arange(len(rows)), gold] -= 1.0
                gradient = np.zeros_like(self.emit)
                np.add.at(gradient, ids, np.repeat(delta, counts, axis=0))
                ends = np.cumsum(lengths[group])
                inner = np.ones(len(rows), bool)
                inner[ends - 1] = False
                inner = np.flatnonzero(inner)
                np.add.at(pairs, (gold[inner], gold[inner + 1]), -1.0)
                gradient = gradient / len(group) + l2 * self.emit
                pairs = pairs / len(group) + l2 * self.move
                seen_emit += gradient**2
                seen_move += pairs**2
                self.emit -= rate * gradient / np.sqrt(seen_emit)
                self.move -= rate * pairs / np.sqrt(seen_move)
        return self
