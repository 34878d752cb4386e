"""SetSketch registers: truncated, exponentially spaced minima of a set.

A register holds floor(1 - log_b(x)), cut to 0..q+1, for x the least of a
exponential variates of rate `a` that the elements draw by hash.  Registers of a
union are the element-wise maxima, and equal registers are the likelier the more
alike two sets are, so bands of them serve as locality-sensitive keys.
"""

from __future__ import annotations

import numpy as np

from vellumix.llm.tokens import stream64

B, A, Q = 1.001, 20.0, (1 << 16) - 2
_U = np.uint64
_LOG_B = np.log(B)


def multipliers(m: int) -> np.ndarray:
    return stream64(m, 2024) | _U(1)


def registers(elements: np.ndarray, starts: np.ndarray, m: int) -> np.ndarray:
    """m uint16 registers of each run of distinct element hashes; no run may be empty."""
    least = np.empty((len(starts), m), np.float64)
    drawn = np.empty_like(elements)
    for j, factor in enumerate(multipliers(m)):
        np.multiply(elements, factor, out=drawn)
        least[:, j] = np.minimum.reduceat(drawn, starts)
    x = -np.log1p(-(least + 0.5) / 2.0**64 * (1 - 2.0**-53)) / A
    return np.clip(np.floor(1 - np.log(x) / _LOG_B), 0, Q + 1).astype(np.uint16)


def merged(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(x, y)


def joint_similarity(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of sketches of sets of known sizes.

    The likelihood of the counts of greater, smaller and equal registers is
    concave in the similarity, so a ternary search finds its top.
    """
    more, less = (x > y).sum(1).astype(float), (x < y).sum(1).astype(float)
    same = x.shape[1] - more - less
    u = nx / (nx + ny)
    v = 1 - u
    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)

    def chance(t):
        return -np.log1p(-np.clip(t, 0, 1) * (B - 1) / B) / _LOG_B

    def likelihood(j):
        p, q = chance(u - v * j), chance(v - u * j)
        return more * np.log(np.maximum(p, 1e-12)) + less * np.log(np.maximum(q, 1e-12)) + same * np.log(np.maximum(1 - p - q, 1e-12))

    for _ in range(rounds):
        one, two = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        worse = likelihood(one) < likelihood(two)
        lo, hi = np.where(worse, one, lo), np.where(worse, hi, two)
    return (lo + hi) / 2
