"""Singular values and right singular directions of a small square matrix, by qd transforms.

Householder reflections make the matrix upper bidiagonal.  The differential
quotient-difference transform with shifts (dqds) finds the squares of its
singular values, each to high relative accuracy, from the smallest up; the
shifts stay below the smallest value, by the trace of the inverse that an
unshifted transform gives for nothing.  Directions come from twisted
factorisations: forward and backward factors of the shifted matrix are glued
where they nearly break down, which solves for the vector directly.  Values
closer than ``CLOSE`` (relatively) are solved for anew, orthogonally to those
before, as their gap alone would not keep them apart.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
CLOSE = 1e-3
NOTHING = 1e-290  # against a largest entry of 1
MOST_STEPS = 200  # for each value


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, superdiagonal, V) of the bidiagonal B with r = U B V', for orthogonal U and V."""
    a = np.array(r, dtype=np.float64)
    n = a.shape[1]
    v = np.eye(n)

    def reflector(x: np.ndarray) -> np.ndarray | None:
        size = np.linalg.norm(x)
        if size == 0 or np.all(x[1:] == 0):
            return None
        u = x.copy()
        u[0] += np.copysign(size, x[0])
        return u / np.linalg.norm(u)

    for k in range(n):
        u = reflector(a[k:, k])
        if u is not None:
            a[k:, k:] -= 2 * np.outer(u, u @ a[k:, k:])
        if k < n - 2:
            u = reflector(a[k, k + 1 :])
            if u is not None:
                a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ u, u)
                v[:, k + 1 :] -= 2 * np.outer(v[:, k + 1 :] @ u, u)
    return np.diagonal(a).copy(), np.diagonal(a, 1).copy(), v


def _transform(q: list[float], e: list[float], tau: float) -> tuple[list[float], list[float], list[float]] | None:
    """One dqds transform; also its d's.  None if the shift is above the smallest value."""
    d = q[0] - tau
    new_q, new_e, ds = [], [], [d]
    for i, off in enumerate(e):
        if d < 0:
            return None
        top = d + off
        new_q.append(top)
        if top <= NOTHING:
            new_e.append(0.0)
            d = q[i + 1] - tau
        else:
            ratio = q[i + 1] / top
            new_e.append(off * ratio)
            d = d * ratio - tau
        ds.append(d)
    if d < 0:
        return None
    new_q.append(d)
    return new_q, new_e, ds


def _last_two(q: list[float], e: list[float]) -> float:
    """The smaller eigenvalue of the last two by two block."""
    a, c = q[-2] + (e[-2] if len(e) > 1 else 0.0), q[-1] + e[-1]
    off = q[-2] * e[-1]
    half = (a - c) / 2
    return (a * c - off) / ((a + c) / 2 + np.sqrt(half * half + off)) if a + c else 0.0


def dqds(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squares of the singular values of a bidiagonal matrix, falling."""
    scale = max(np.max(np.abs(diagonal), initial=0), np.max(np.abs(above), initial=0))
    if scale == 0:
        return np.zeros(len(diagonal))
    found: list[float] = []
    todo = [(((diagonal / scale) ** 2).tolist(), ((above / scale) ** 2).tolist(), 0.0)]
    steps = 0
    while todo:
        q, e, shift = todo.pop()
        while q:
            steps += 1
            if steps > MOST_STEPS * len(diagonal):
                raise ArithmeticError("singular values do not converge")
            if len(q) == 1:
                found.append(q[0] + shift)
                break
            if e[-1] <= max(EPS * EPS * (shift + q[-1]), NOTHING):
                found.append(q.pop() + shift)
                e.pop()
                continue
            cut = next((i for i in range(len(e)) if e[i] <= max(EPS * EPS * (shift + min(q[i], q[i + 1])), NOTHING)), None)
            if cut is not None:
                todo.append((q[: cut + 1], e[:cut], shift))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            q, e, ds = _transform(q, e, 0.0)
            if min(ds) <= 0:
                continue  # a value is zero: the next transform makes it split off
            below = 1 / sum(1 / d for d in ds)
            bold = _last_two(q, e) - np.sqrt(q[-2] * e[-2] if len(e) > 1 else 0.0)
            for tau in sorted({t for t in (bold, below * (1 - 1e-10), below / 2) if t > 0}, reverse=True):
                if tau <= min(ds) and tau > EPS * EPS * shift and (step := _transform(q, e, tau)) is not None:
                    q, e, _ = step
                    shift += tau
                    break
    return np.sort(np.array(found))[::-1] * scale * scale


class Twisted:
    """Forward and backward factors of B'B - value, and where they fit together best."""

    def __init__(self, a: np.ndarray, b: np.ndarray, value: float):
        n = len(a)
        ratio, q = b / a[:-1], a * a
        self.least = EPS * value
        forward, lower = np.empty(n), np.empty(n - 1)
        backward, upper = np.empty(n), np.empty(n - 1)
        s, p = np.empty(n), np.empty(n)
        s[0] = -value
        for i in range(n - 1):
            forward[i] = self._pivot(s[i] + q[i])
            s[i] += forward[i] - (s[i] + q[i])
            lower[i] = q[i] * ratio[i] / forward[i]
            s[i + 1] = lower[i] * ratio[i] * s[i] - value
        forward[-1] = self._pivot(s[-1] + q[-1])
        p[-1] = q[-1] - value
        for i in range(n - 2, -1, -1):
            off = q[i] * ratio[i] ** 2
            backward[i + 1] = self._pivot(off + p[i + 1])
            p[i + 1] += backward[i + 1] - (off + p[i + 1])
            t = q[i] / backward[i + 1]
            upper[i] = ratio[i] * t
            p[i] = p[i + 1] * t - value
        gamma = s + p + value
        gamma[~np.isfinite(gamma)] = np.inf
        self.lower, self.upper, self.forward, self.backward = lower, upper, forward, backward
        self.twist = int(np.argmin(np.abs(gamma)))
        self.gamma = gamma[self.twist]

    def _pivot(self, x: float) -> float:
        """A pivot that is nearly zero is moved by a rounding error of the value."""
        return x if abs(x) > self.least else float(np.copysign(self.least, x))

    def _spread(self, w: np.ndarray) -> np.ndarray:
        """Solve N' z = w outwards from the twist."""
        z = w.copy()
        for i in range(self.twist - 1, -1, -1):
            z[i] -= self.lower[i] * z[i + 1]
        for i in range(self.twist, len(z) - 1):
            z[i + 1] -= self.upper[i] * z[i]
        return z / np.linalg.norm(z)

    def vector(self) -> np.ndarray:
        w = np.zeros(len(self.forward))
        w[self.twist] = 1
        return self._spread(w)

    def solve(self, x: np.ndarray) -> np.ndarray:
        """The direction of (B'B - value)^-1 x."""
        w = x.copy()
        for i in range(self.twist):
            w[i + 1] -= self.lower[i] * w[i]
        for i in range(len(w) - 1, self.twist, -1):
            w[i - 1] -= self.upper[i - 1] * w[i]
        pivots = np.concatenate([self.forward[: self.twist], [self._pivot(self.gamma)], self.backward[self.twist + 1 :]])
        return self._spread(w / pivots)


def directions(diagonal: np.ndarray, above: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of B'B (columns) for its given eigenvalues, the largest ones in falling order."""
    n = len(diagonal)
    if n == 1 or not len(values):
        return np.ones((n, len(values)))
    size = max(np.max(np.abs(diagonal)), np.max(np.abs(above)))
    a = np.where(np.abs(diagonal) < EPS * size / 16, EPS * size / 16, diagonal) / size
    b, scaled = above / size, values / size**2
    rng = np.random.default_rng(11)
    out = np.empty((n, len(values)))
    first = 0  # of the values close to each other
    for k, value in enumerate(scaled):
        if k and scaled[k - 1] - value > CLOSE * scaled[k - 1]:
            first = k
        factors = Twisted(a, b, value)
        z = factors.vector()
        near = out[:, first:k]
        if near.shape[1]:
            z = rng.normal(size=n)
            for _ in range(5):
                for _ in range(2):
                    z = z - near @ (near.T @ z)
                z = factors.solve(z / np.linalg.norm(z))
            for _ in range(2):
                z = z - near @ (near.T @ z)
            z /= np.linalg.norm(z)
        out[:, k] = z
    return out


def right_singular(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(squares of all singular values, falling; directions of the first ``most`` that are not zero, as columns)."""
    diagonal, above, v = bidiagonalise(r)
    squares = dqds(diagonal, above)
    rank = int(np.sum(squares > squares[0] * (16 * len(squares) * EPS) ** 2)) if squares[0] > 0 else 0
    return squares, v @ directions(diagonal, above, squares[: min(most, rank)])
