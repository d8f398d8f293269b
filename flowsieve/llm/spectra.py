"""Eigenvalues and eigenvectors of a scatter matrix under rank-one updates.

A spectrum stands for ``sum((x - mean)(x - mean)^T)`` of the rows seen. A row changes it by one vector: the scatter grows by
``z z^T`` with ``z = sqrt(k / (k + 1)) * (x - mean)``. In the basis of the eigenvectors that is a diagonal matrix plus a rank-one
matrix, whose eigenvalues are the roots of a secular equation between the old ones; directions that ``z`` does not touch, and
equal eigenvalues, are deflated first.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps


def secular_roots(d: np.ndarray, z2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of ``1 + sum(z2 / (d - t)) = 0`` for ascending, distinct ``d`` and positive ``z2``: root i lies between d[i] and d[i + 1].

    Returned as the index of the nearer pole and the distance from it, so that differences to poles keep their digits. Each
    step fits a pole on either side; a step that leaves the bracket is replaced by its middle.
    """
    k = len(d)
    own = np.arange(k)
    gap = np.append(d[1:] - d[:-1], z2.sum())
    # the sign at the middle tells the nearer pole
    f = 1 + (1 / ((d - d[:, None]) - (gap / 2)[:, None])) @ z2
    inner = own < k - 1
    near = own + ((f < 0) & inner)
    lo, hi = np.where(f < 0, np.where(inner, -gap / 2, gap / 2), 0.0), np.where(f < 0, np.where(inner, 0.0, gap), gap / 2)
    found, rel, at = np.zeros(k), d - d[near][:, None], (lo + hi) / 2
    lower = (own <= own[:, None]).astype(float)
    right = np.minimum(own + 1, k - 1)
    for _ in range(100):
        delta = rel - at[:, None]
        inverse = 1 / delta
        part = inverse * z2
        f = 1 + part.sum(1)
        below = np.einsum("ij,ij->i", part, lower)
        done = (np.abs(f) <= EPS * k * (f - 2 * below)) | (hi - lo <= 2 * EPS * np.maximum(np.abs(lo), np.abs(hi)))
        if done.any():
            # settled roots leave the iteration
            found[own[done]] = at[done]
            open_ = ~done
            if not open_.any():
                break
            own, right, rel, lower, at, lo, hi, f, delta, inverse, part = (
                x[open_] for x in (own, right, rel, lower, at, lo, hi, f, delta, inverse, part))
        lo, hi = np.where(f < 0, at, lo), np.where(f > 0, at, hi)
        slope = part * inverse
        psi = np.einsum("ij,ij->i", slope, lower)
        phi = slope.sum(1) - psi
        rows = np.arange(len(own))
        d1, d2 = delta[rows, own], delta[rows, right]
        with np.errstate(all="ignore"):
            # inner roots: c + q / (d1 - e) + s / (d2 - e) with value and slopes matched; the last one has a pole on one side
            q, s = psi * d1 * d1, phi * d2 * d2
            c = f - psi * d1 - phi * d2
            a1, a0 = c * (d1 + d2) + q + s, f * d1 * d2
            root = np.sqrt(np.maximum(a1 * a1 - 4 * c * a0, 0))
            step = np.where(a1 <= 0, (a1 - root) / (2 * c), 2 * a0 / (a1 + root))
            new = at + np.where(own == k - 1, d1 + q / c, step)
        at = np.where((new > lo) & (new < hi), new, (lo + hi) / 2)
    else:
        found[own] = at
    return near, found


def rank_one(d: np.ndarray, basis: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum of ``basis diag(d) basis^T + v v^T``; ``d`` ascending before and after."""
    z = v @ basis
    norm = np.sqrt(z @ z)
    if not norm:
        return d, basis
    scale = max(d[-1], norm * norm)
    tiny = 8 * EPS * scale
    # nearly equal eigenvalues: a rotation moves all of z into the later one
    close = np.flatnonzero(np.diff(d) <= tiny)
    if close.size:
        d, z, basis = d.copy(), z.copy(), basis.copy()
        for i in close:
            r = np.hypot(z[i], z[i + 1])
            if r:
                c, s = z[i + 1] / r, z[i] / r
                z[i], z[i + 1] = 0.0, r
                basis[:, [i, i + 1]] = basis[:, [i, i + 1]] @ np.array([[c, s], [-s, c]])
    live = np.flatnonzero(np.abs(z) * norm > tiny)
    if not live.size:
        return d, basis
    dk, zk = d[live], z[live]
    near, at = secular_roots(dk, zk * zk)
    # pole minus root, with the digits of the difference kept
    delta = (dk[:, None] - dk[near]) - at
    # z is taken anew from the roots, which makes the vectors orthogonal however close the roots are
    gaps = dk[:, None] - dk
    np.fill_diagonal(gaps, 1.0)
    exact = np.sqrt(np.abs(delta / gaps).prod(1))
    vectors = np.copysign(exact, zk)[:, None] / delta
    vectors /= np.sqrt((vectors * vectors).sum(0))
    d, basis = d.copy(), basis.copy()
    d[live] = dk[near] + at
    basis[:, live] = basis[:, live] @ vectors
    if (np.diff(d) < 0).any():
        order = np.argsort(d, kind="stable")
        d, basis = d[order], basis[:, order]
    return d, basis


class Spectrum:
    """Rows seen, their mean and the spectrum of their centred scatter. Vectors come relative to a pivot all share."""

    def __init__(self, size: int):
        self.rows, self.mean = 0, np.zeros(size)
        self.d, self.basis = np.zeros(size), np.eye(size)

    def add(self, x: np.ndarray) -> None:
        away = x - self.mean
        if self.rows:
            self.d, self.basis = rank_one(self.d, self.basis, away * np.sqrt(self.rows / (self.rows + 1)))
        self.rows += 1
        self.mean = self.mean + away / self.rows

    def merge(self, other: Spectrum) -> None:
        """The other's scatter comes as one rank-one update an eigenvector, the distance of the means as one more."""
        if not other.rows:
            return
        if not self.rows:
            self.rows, self.mean, self.d, self.basis = other.rows, other.mean, other.d, other.basis
            return
        rows = self.rows + other.rows
        for k in np.flatnonzero(other.d > 0):
            self.d, self.basis = rank_one(self.d, self.basis, other.basis[:, k] * np.sqrt(other.d[k]))
        away = other.mean - self.mean
        self.d, self.basis = rank_one(self.d, self.basis, away * np.sqrt(self.rows * other.rows / rows))
        self.mean = self.mean + away * (other.rows / rows)
        self.rows = rows
