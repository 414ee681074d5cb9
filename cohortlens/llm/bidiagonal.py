"""Singular values and right singular vectors of a small square matrix: Householder
bidiagonalisation, dqds, twisted factorisations.  Numpy on one matrix of the size of
the vectors' dimension; what grows with the rows happens in Spark (``whitening``).
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(np.float64).eps


def bidiagonalise(r: np.ndarray):
    """(diagonal, superdiagonal, reflectors) with ``r = U B V'``; reflector ``k`` of
    the columns is ``(k + 1, v)`` and stands for ``I - 2 v v'`` on the places from there."""
    a = np.array(r, np.float64)
    d = a.shape[0]
    right = []

    def reflector(x):
        """(unit v, the value that x becomes) with (I - 2 v v') x = value * e1."""
        top = np.abs(x).max(initial=0.0)
        if len(x) < 2 or not np.abs(x[1:]).max(initial=0.0):
            return None, x[0]
        y = x / top
        norm = np.sqrt(y @ y)
        v = y.copy()
        v[0] += norm if y[0] >= 0 else -norm
        return v / np.sqrt(v @ v), -np.copysign(norm * top, x[0])
    for k in range(d):
        v, value = reflector(a[k:, k])
        if v is not None:
            a[k:, k + 1:] -= 2 * np.outer(v, v @ a[k:, k + 1:])
        a[k, k], a[k + 1:, k] = value, 0
        if k + 1 < d:
            v, value = reflector(a[k, k + 1:])
            if v is not None:
                a[k + 1:, k + 1:] -= 2 * np.outer(a[k + 1:, k + 1:] @ v, v)
                right.append((k + 1, v))
            a[k, k + 1], a[k, k + 2:] = value, 0
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def _safe_shift(q, e):
    """A lower bound of the smallest eigenvalue: one over the trace of the inverse,
    whose diagonal the unshifted transform gives."""
    d, total = q[0], 0.0
    for k in range(len(q)):
        if d <= 0.0:
            return 0.0
        total += 1.0 / d
        if k < len(e):
            d = d * (q[k + 1] / (d + e[k]))
    return (1.0 - 4.0 * len(q) * EPS) / total if np.isfinite(total) else 0.0


def _transform(q, e, shift):
    """One dqds sweep with a shift: new (q, e), or None where the shift was too large."""
    n = len(q)
    nq, ne = [0.0] * n, [0.0] * (n - 1)
    d = q[0] - shift
    for k in range(n - 1):
        if d < 0.0:
            return None
        nq[k] = d + e[k]
        if nq[k] == 0.0:
            ne[k], d = 0.0, q[k + 1] - shift
            continue
        t = q[k + 1] / nq[k]
        ne[k] = e[k] * t
        d = d * t - shift
    if d < 0.0:
        return None
    nq[n - 1] = d
    return nq, ne


def squared_singular_values(diagonal, above) -> np.ndarray:
    """Squares of the singular values of a bidiagonal matrix by dqds, falling.  Each
    sweep subtracts a proven lower bound of the smallest one, so no sweep fails for
    more than rounding, and small values keep their relative accuracy."""
    found: list[float] = []
    work = [([float(x) ** 2 for x in diagonal], [float(x) ** 2 for x in above], 0.0)]
    while work:
        q, e, base = work.pop()
        if q and q[0] < q[-1]:  # the same matrix read from its other end: the small values go last
            q, e = q[::-1], e[::-1]
        while q:
            n = len(q)
            if n == 1:
                found.append(base + q[0])
                break
            cut = next((k for k in range(n - 2, -1, -1) if e[k] <= EPS * EPS * (base + min(q[k], q[k + 1]))), None)
            if cut is not None:
                work.append((q[cut + 1:], e[cut + 1:], base))
                q, e = q[:cut + 1], e[:cut]
                continue
            shift = _safe_shift(q, e)
            got = _transform(q, e, shift) if shift > 0.0 else None
            if got is None:
                shift, got = 0.0, _transform(q, e, 0.0)
            q, e = got
            base += shift
    return np.sort(np.array(found))[::-1]


def _twisted(diagonal, above, value, nth: int = 0):
    """An eigenvector of B'B for ``value`` by a twisted factorisation: the stationary
    sweep from the top and the progressive one from the bottom, both in differential
    form, meet at the place of the smallest residual (``nth``: of the nth smallest)."""
    n = len(diagonal)
    tiny = np.finfo(np.float64).tiny / EPS
    a2, b2 = np.asarray(diagonal) ** 2, np.asarray(above) ** 2
    off = np.asarray(diagonal[:-1]) * np.asarray(above)
    s, p, top, bottom = np.empty(n), np.empty(n), np.empty(n), np.empty(n)

    def pivot(x):
        return x if abs(x) > tiny else -tiny
    s[0] = -value
    for k in range(n - 1):
        top[k] = pivot(a2[k] + s[k])
        s[k + 1] = s[k] * (b2[k] / top[k]) - value
    p[n - 1] = a2[n - 1] - value
    for k in range(n - 2, -1, -1):
        bottom[k + 1] = pivot(b2[k] + p[k + 1])
        p[k] = p[k + 1] * (a2[k] / bottom[k + 1]) - value
    at = int(np.argsort(np.abs(s + p + value), kind="stable")[nth])
    z = np.zeros(n)
    z[at] = 1.0
    for k in range(at - 1, -1, -1):
        z[k] = -(off[k] / top[k]) * z[k + 1]
    for k in range(at + 1, n):
        z[k] = -(off[k - 1] / bottom[k]) * z[k - 1]
    return z / np.sqrt(z @ z)


def right_singular(r: np.ndarray, most: int):
    """(squared singular values, falling, all of them; the right singular vectors of
    the first ``most`` as columns, fewer where the rank is lower).

    Vectors of values that agree to three digits are made orthogonal to each other,
    starting over at the next best twist where one adds nothing to those before it."""
    d = r.shape[0]
    top = np.abs(r).max(initial=0.0)
    if d == 0 or top == 0.0:
        return np.zeros(d), np.zeros((d, 0))
    diagonal, above, right = bidiagonalise(r / top)
    # negligible couplings split the matrix into independent pieces
    scale = np.abs(diagonal).max() + np.abs(above).max(initial=0.0)
    cuts = [k + 1 for k in range(d - 1) if abs(above[k]) <= EPS * min(abs(diagonal[k]), abs(diagonal[k + 1]))
            or abs(above[k]) <= EPS * EPS * scale]
    pairs = []
    for a, z in zip([0, *cuts], [*cuts, d]):
        for v in squared_singular_values(diagonal[a:z], above[a:z - 1]):
            pairs.append((v, a, z))
    pairs.sort(key=lambda x: -x[0])
    values = np.array([p[0] for p in pairs])
    rank = int((values > values[0] * (d * EPS) ** 2).sum())
    kept: list[np.ndarray] = []
    for k in range(min(most, rank)):
        value, a, z = pairs[k]
        near = [kept[j] for j in range(k) if pairs[j][1] == a and abs(values[j] - value) <= 1e-3 * values[j]]
        full = np.zeros(d)
        for nth in range(z - a):
            y = np.zeros(d)
            y[a:z] = _twisted(diagonal[a:z], above[a:z - 1], value, nth)
            for _ in range(2):
                for other in near:
                    y -= (other @ y) * other
            norm = np.sqrt(y @ y)
            if norm > 1e-4 or not near:
                full = y / norm
                break
        kept.append(full)
    v = np.stack(kept, axis=1) if kept else np.zeros((d, 0))
    for at, w in reversed(right):
        v[at:] -= 2 * np.outer(w, w @ v[at:])
    return values * top * top, v
