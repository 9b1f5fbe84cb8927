"""Two-state linear-chain conditional random field over binned features, in numpy.

Positions of all sequences lie one after the other; ``bounds`` holds where each
sequence starts (one more entry than sequences).  Every position has one bin per
feature group; the score of a state is the sum of its bins' weights.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Crf:
    weights: np.ndarray  # bins x 2
    moves: np.ndarray  # from x to

    def scores(self, bins: np.ndarray) -> np.ndarray:
        return self.weights[bins].sum(axis=1) if len(bins) else np.zeros((0, 2))


def _schedule(bounds: np.ndarray):
    """Sequences by falling length, and for each step how many still run."""
    length = np.diff(bounds)
    order = np.argsort(-length, kind="stable")
    first, length = bounds[:-1][order], length[order]
    steps = int(length[0]) if len(length) else 0
    return first, length, [int(np.searchsorted(-length, -t, side="left")) for t in range(steps)]


def viterbi(scores: np.ndarray, moves: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Best state of every position; ties go to state 1."""
    first, length, running = _schedule(bounds)
    best, back = scores.copy(), np.zeros(scores.shape, dtype=np.int8)
    for t, k in enumerate(running[1:], 1):
        at = first[:k] + t
        via = best[at - 1][:, :, None] + moves[None]
        back[at] = via[:, 1] >= via[:, 0]
        best[at] += via.max(axis=1)
    state = np.zeros(len(scores), dtype=np.int8)
    full = length > 0
    last = (first + length - 1)[full]
    state[last] = best[last, 1] >= best[last, 0]
    for t in range(len(running) - 2, -1, -1):
        at = first[: running[t + 1]] + t
        state[at] = back[at + 1, state[at + 1]]
    return state


def forward_backward(scores: np.ndarray, moves: np.ndarray, bounds: np.ndarray):
    """Marginals of the states, summed pair marginals, and the log partition of each sequence.

    ``moves``: one table for all steps, or one per position for the step into it.
    """
    each = moves.ndim == 3
    first, length, running = _schedule(bounds)
    top = scores.max(axis=1, keepdims=True) if len(scores) else scores[:, :1]
    emit = np.exp(scores - top)
    table = np.exp(moves)
    ahead, scale = np.zeros_like(emit), np.ones(len(emit))
    for t, k in enumerate(running):
        at = first[:k] + t
        x = emit[at] if t == 0 else np.einsum("ni,nij->nj" if each else "ni,ij->nj", ahead[at - 1], table[at] if each else table) * emit[at]
        scale[at] = x.sum(axis=1)
        ahead[at] = x / scale[at][:, None]
    behind = np.ones_like(emit)
    pairs = np.zeros((2, 2))
    for t in range(len(running) - 1, 0, -1):
        at = first[: running[t]] + t
        y = emit[at] * behind[at] / scale[at][:, None]
        behind[at - 1] = np.einsum("nj,nij->ni" if each else "nj,ij->ni", y, table[at] if each else table)
        if not each:
            pairs += np.einsum("ni,nj->ij", ahead[at - 1], y) * table
    log_z = np.add.reduceat(np.log(scale) + top[:, 0], bounds[:-1]) if len(scores) else np.zeros(0)
    return ahead * behind, pairs, log_z


def train(bins: np.ndarray, states: np.ndarray, bounds: np.ndarray, n_bins: int, rounds: int = 120, rate: float = 0.2, ridge: float = 1e-3) -> Crf:
    """Fit by gradient ascent (Adam) on the log likelihood; empty sequences must be left out."""
    model = Crf(np.zeros((n_bins, 2)), np.zeros((2, 2)))
    n = len(states)
    if n == 0:
        return model
    inner = np.ones(n, dtype=bool)
    inner[bounds[:-1]] = False
    at = np.flatnonzero(inner)
    seen_pairs = np.zeros((2, 2))
    np.add.at(seen_pairs, (states[at - 1], states[at]), 1)
    seen = np.zeros((n, 2))
    seen[np.arange(n), states] = 1
    flat = bins.ravel()
    groups = bins.shape[1]

    def per_bin(p):
        return np.stack([np.bincount(flat, np.repeat(p[:, s], groups), n_bins) for s in (0, 1)], axis=1)

    params = [model.weights, model.moves]
    m, v = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params]
    target = per_bin(seen)
    for r in range(1, rounds + 1):
        p, pairs, _ = forward_backward(model.scores(bins), model.moves, bounds)
        grads = [(target - per_bin(p)) / n - ridge * params[0], (seen_pairs - pairs) / n - ridge * params[1]]
        for x, g, a, b in zip(params, grads, m, v):
            a[:] = 0.9 * a + 0.1 * g
            b[:] = 0.99 * b + 0.01 * g * g
            x += rate * (a / (1 - 0.9**r)) / (np.sqrt(b / (1 - 0.99**r)) + 1e-6)
    return model
