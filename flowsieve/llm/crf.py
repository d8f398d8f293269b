"""A linear-chain conditional random field over hashed features, in numpy.

A position has a set of features; a feature has a weight for each label, and a pair of neighbouring labels has one. Sequences
of different lengths are worked on side by side, longest first, so that a step of the recursion is one operation over all
sequences that still have a word there; nothing is padded.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np


def hashed(feature: str, buckets: int) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % buckets


@dataclass
class Crf:
    labels: list[str]
    weights: np.ndarray
    moves: np.ndarray
    start: np.ndarray

    def score(self, features: list[int]) -> np.ndarray:
        return self.weights[features].sum(0)


def marginals(emit: np.ndarray, lengths: np.ndarray, crf: Crf, counts: bool = False):
    """Forward-backward. ``emit``: exp of the positions' scores, sequence after sequence, longest sequence first.

    Gives the label probabilities of each position, and with ``counts`` the expected numbers of label pairs.
    """
    offsets = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    active = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), side="left")
    moves, n = np.exp(crf.moves), emit.shape[1]
    alpha, scale = np.empty_like(emit), np.empty(len(emit))
    before = None
    for t, k in enumerate(active):
        at = offsets[:k] + t
        now = (np.exp(crf.start) if t == 0 else before[:k] @ moves) * emit[at]
        scale[at] = total = now.sum(1)
        before = now / total[:, None]
        alpha[at] = before
    beta, pairs = np.ones((len(lengths), n)), np.zeros((n, n))
    for t in range(len(active) - 1, -1, -1):
        k = active[t]
        at = offsets[:k] + t
        weighed = emit[at] * beta[:k] / scale[at][:, None]
        alpha[at] *= beta[:k]
        if t:
            if counts:
                pairs += (alpha[at - 1].T @ weighed) * moves
            beta[:k] = weighed @ moves.T
    return alpha / alpha.sum(1, keepdims=True), pairs


def fit(sequences: list[list[list[int]]], targets: list[list[int]], labels: list[str], buckets: int, rounds: int = 4, batch: int = 128,
        rate: float = 0.3, decay: float = 1e-6, seed: int = 1) -> Crf:
    """Maximum likelihood by adaptive gradient steps. ``sequences`` hold a feature list for each position."""
    n = len(labels)
    crf = Crf(labels, np.zeros((buckets, n)), np.zeros((n, n)), np.zeros(n))
    past = [np.full_like(x, 1e-8) for x in (crf.weights, crf.moves, crf.start)]
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        order = rng.permutation(len(sequences))
        for first in range(0, len(order), batch):
            chosen = sorted((i for i in order[first:first + batch] if sequences[i]), key=lambda i: -len(sequences[i]))
            if not chosen:
                continue
            lengths = np.array([len(sequences[i]) for i in chosen])
            features = [f for i in chosen for f in sequences[i]]
            sizes = np.array([len(f) for f in features])
            flat, where = np.concatenate([np.array(f, np.int64) for f in features]), np.repeat(np.arange(len(features)), sizes)
            score = np.zeros((len(features), n))
            np.add.at(score, where, crf.weights[flat])
            known = np.concatenate([np.array(targets[i]) for i in chosen])
            gamma, pairs = marginals(np.exp(score - score.max(1, keepdims=True)), lengths, crf, counts=True)
            error = np.eye(n)[known] - gamma
            steps = [np.zeros_like(crf.weights), -pairs, np.zeros(n)]
            np.add.at(steps[0], flat, error[where])
            heads = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            steps[2] = error[heads].sum(0)
            inner = np.ones(len(known), bool)
            inner[heads] = False
            to = np.flatnonzero(inner)
            np.add.at(steps[1], (known[to - 1], known[to]), 1.0)
            for value, step, seen in zip((crf.weights, crf.moves, crf.start), steps, past):
                step = step / len(chosen) - decay * value
                seen += step * step
                value += rate * step / np.sqrt(seen)
    return crf


def viterbi(scores: np.ndarray, crf: Crf) -> list[int]:
    """The best labels of one sequence; of equally good ones the first label."""
    if not len(scores):
        return []
    best, back = crf.start + scores[0], []
    for row in scores[1:]:
        way = best[:, None] + crf.moves
        back.append(way.argmax(0))
        best = way.max(0) + row
    path = [int(best.argmax())]
    for step in reversed(back):
        path.append(int(step[path[-1]]))
    return path[::-1]
