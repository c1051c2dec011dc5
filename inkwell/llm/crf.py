"""A linear-chain conditional random field in numpy, over many sequences at once.

Sequences lie one after another in flat arrays; every recursion walks positions and treats all sequences
that are long enough together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np


@dataclass
class Chain:
    """Weights: features x labels, transitions from label to label, and the first label's."""

    emit: np.ndarray
    move: np.ndarray
    first: np.ndarray


def steps(sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(position, flat index of it in each sequence that has it); longest sequences first."""
    base = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    base, sorted_sizes = base[order], -sizes[order]
    for t in range(int(sizes.max()) if len(sizes) else 0):
        yield t, base[: np.searchsorted(sorted_sizes, -t, "left")] + t


def viterbi(scores: np.ndarray, chain: Chain, sizes: np.ndarray) -> np.ndarray:
    """Best label of each position given its label scores."""
    labels = np.zeros(len(scores), np.int64)
    back = np.zeros(scores.shape, np.int64)
    best = scores.copy()
    every = []
    for t, at in steps(sizes):
        every.append(at)
        if t == 0:
            best[at] += chain.first
        else:
            through = best[at - 1][:, :, None] + chain.move
            back[at] = through.argmax(1)
            best[at] += through.max(1)
    follow = None
    for at in reversed(every):
        own = best[at].argmax(1)
        if follow is not None:  # sequences that go on are a prefix of those that reach this far
            own[: len(follow)] = back[follow, labels[follow]]
        labels[at] = own
        follow = at
    return labels


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def marginals(scores: np.ndarray, chain: Chain, sizes: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log partition summed over the sequences, label marginals, and expected transitions in all."""
    alpha, beta = scores.copy(), np.zeros_like(scores)
    every = []
    for t, at in steps(sizes):
        every.append(at)
        alpha[at] = scores[at] + (chain.first if t == 0 else _logsum(alpha[at - 1][:, :, None] + chain.move, 1))
    for at in reversed(every[1:]):
        beta[at - 1] = _logsum(chain.move + (scores[at] + beta[at])[:, None, :], 2)
    ends = np.cumsum(sizes) - 1
    total = _logsum(alpha[ends], 1)
    per = np.repeat(total, sizes)
    edge = np.zeros_like(chain.move)
    for at in every[1:]:
        edge += np.exp(alpha[at - 1][:, :, None] + chain.move + (scores[at] + beta[at])[:, None, :] - per[at][:, None, None]).sum(0)
    return float(total.sum()), np.exp(alpha + beta - per[:, None]), edge


def fit(x: np.ndarray, y: np.ndarray, sizes: np.ndarray, n_labels: int, rounds: int = 120, rate: float = 0.2, ridge: float = 1e-3) -> Chain:
    """Maximum conditional likelihood by Adam; every sequence has at least one position."""
    chain = Chain(np.zeros((x.shape[1], n_labels)), np.zeros((n_labels, n_labels)), np.zeros(n_labels))
    starts = np.cumsum(sizes) - sizes
    inside = np.ones(len(y), bool)
    inside[starts] = False
    seen_first = np.bincount(y[starts], minlength=n_labels)
    seen_move = np.zeros((n_labels, n_labels))
    np.add.at(seen_move, (y[np.flatnonzero(inside) - 1], y[inside]), 1)
    seen = np.eye(n_labels)[y]
    parts = [chain.emit, chain.move, chain.first]
    m, v = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    for step in range(1, rounds + 1):
        _, node, edge = marginals(x @ chain.emit, chain, sizes)
        slopes = [x.T @ (seen - node), seen_move - edge, seen_first - node[starts].sum(0)]
        for i, (p, g) in enumerate(zip(parts, slopes)):
            g = g / len(y) - ridge * p
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            p += rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
    return chain
