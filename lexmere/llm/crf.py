"""A linear-chain conditional random field with binary features, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LABELS = 2


@dataclass
class Chain:
    """Weights by feature and label, and by neighbouring labels (with start and end)."""

    names: list[str]
    emit: np.ndarray
    step: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def __post_init__(self) -> None:
        self.index = {name: i for i, name in enumerate(self.names)}

    def scores(self, rows: list[list[str]]) -> np.ndarray:
        """Label scores of every position; a feature never seen in training has no weight."""
        out = np.zeros((len(rows), LABELS))
        get = self.index.get
        for i, row in enumerate(rows):
            out[i] = self.emit[[k for name in row if (k := get(name)) is not None]].sum(axis=0)
        return out

    def viterbi(self, rows: list[list[str]]) -> list[int]:
        """The best label sequence; ties go to the lower label."""
        if not rows:
            return []
        scores = self.scores(rows)
        best = self.start + scores[0]
        back = np.zeros((len(rows), LABELS), np.int64)
        for i in range(1, len(rows)):
            paths = best[:, None] + self.step
            back[i] = paths.argmax(axis=0)
            best = paths.max(axis=0) + scores[i]
        labels = [int((best + self.end).argmax())]
        for i in range(len(rows) - 1, 0, -1):
            labels.append(int(back[i, labels[-1]]))
        return labels[::-1]


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def train(pages: list[tuple[list[list[str]], list[int]]], *, rounds: int = 150, rate: float = 0.1, decay: float = 1e-4) -> Chain:
    """Maximum likelihood with an L2 penalty, by Adam over all pages at once.

    pages: (features of every position, label of every position). Gradients are observed
    less expected counts, by forward and backward sums over padded chains.
    """
    pages = [p for p in pages if p[0]]
    names = sorted({name for rows, _ in pages for row in rows for name in row})
    index = {name: i for i, name in enumerate(names)}
    n, longest = len(pages), max(len(rows) for rows, _ in pages)
    lengths = np.array([len(rows) for rows, _ in pages])
    live = np.arange(longest)[None] < lengths[:, None]
    seen = np.zeros((n, longest, len(names)), bool)
    truth = np.zeros((n, longest), np.int64)
    for p, (rows, labels) in enumerate(pages):
        truth[p, : len(labels)] = labels
        for i, row in enumerate(rows):
            seen[p, i, [index[name] for name in row]] = 1
    flat = seen[live].astype(float)  # padding has no features
    del seen
    known = np.eye(LABELS)[truth] * live[..., None]
    last = lengths - 1
    every = np.arange(n)
    both = live[:, 1:, None, None]
    observed = [
        flat.T @ known[live],
        np.einsum("ptk,ptl->kl", known[:, :-1], known[:, 1:]),
        known[:, 0].sum(axis=0),
        known[every, last].sum(axis=0),
    ]
    weights = [np.zeros((len(names), LABELS)), np.zeros((LABELS, LABELS)), np.zeros(LABELS), np.zeros(LABELS)]
    first = [np.zeros_like(w) for w in weights]
    second = [np.zeros_like(w) for w in weights]
    total = float(lengths.sum())
    for turn in range(1, rounds + 1):
        emit, step, start, end = weights
        scores = np.zeros((n, longest, LABELS))
        scores[live] = flat @ emit
        ahead = np.zeros((n, longest, LABELS))
        behind = np.zeros((n, longest, LABELS))
        ahead[:, 0] = start + scores[:, 0]
        for i in range(1, longest):
            ahead[:, i] = _logsum(ahead[:, i - 1, :, None] + step, 1) + scores[:, i]
        behind[every, last] = end
        for i in range(longest - 2, -1, -1):
            carried = _logsum(step + (scores[:, i + 1] + behind[:, i + 1])[:, None, :], 2)
            behind[:, i] = np.where(live[:, i + 1, None], carried, behind[:, i])
        norm = _logsum(ahead[every, last] + end, 1)
        node = np.exp(ahead + behind - norm[:, None, None]) * live[..., None]
        edge = ahead[:, :-1, :, None] + step + (scores[:, 1:] + behind[:, 1:])[:, :, None, :]
        edge = np.where(both, np.exp(np.where(both, edge - norm[:, None, None, None], 0)), 0)
        expected = [flat.T @ node[live], edge.sum(axis=(0, 1)), node[:, 0].sum(axis=0), node[every, last].sum(axis=0)]
        for k, w in enumerate(weights):
            slope = (observed[k] - expected[k]) / total - decay * w
            first[k] = 0.9 * first[k] + 0.1 * slope
            second[k] = 0.99 * second[k] + 0.01 * slope**2
            w += rate * (first[k] / (1 - 0.9**turn)) / (np.sqrt(second[k] / (1 - 0.99**turn)) + 1e-8)
    return Chain(names, *weights)
