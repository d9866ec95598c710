"""Steady-state Gram matrices W = sum over the window of gamma^(j-delta) (C A^j)' C A^j."""

from __future__ import annotations

import warnings

import numpy as np
from numpy.polynomial import legendre

from .models import power

#: Finite windows up to this length are summed directly.
DIRECT = 8192


class WConditionNumberWarning(UserWarning):
    """W is close to singular: results may be inaccurate."""


def kron_q(x, q: int) -> np.ndarray:
    """Kronecker power of order q."""
    x = np.asarray(x, float)
    out = np.ones((1,) * x.ndim)
    for _ in range(q):
        out = np.kron(out, x)
    return out


def limited_sum(A, C, gamma, a, b, delta) -> np.ndarray:  # noqa: N803
    """The definition; finite windows only."""
    if not np.isfinite([a, b]).all():
        raise ValueError("a sum needs finite boundaries")
    row = np.atleast_2d(C) @ power(np.asarray(A, float), int(a))
    w = np.zeros((len(A), len(A)))
    for j in range(int(a), int(b) + 1):
        w += gamma ** (j - delta) * row.T @ row
        row = row @ A
    return w


def stein(A, C, gamma, a, b, delta) -> np.ndarray:  # noqa: N803
    """W from the linear fixed point W = gamma A' W A + boundary terms, solved over the Kronecker square."""
    A, rows = np.asarray(A, float), np.atleast_2d(C)  # noqa: N806
    n = len(A)
    if a == -np.inf:  # mirrored: offsets run down from b with the inverse transition
        return stein(np.linalg.inv(A), C, 1 / gamma, -b, np.inf, -delta)

    def edge(j):
        r = rows @ power(A, int(j))
        return gamma ** (j - delta) * r.T @ r

    right = edge(a) - (edge(b + 1) if np.isfinite(b) else 0)
    system = np.eye(n * n) - gamma * np.kron(A.T, A.T)
    try:
        return np.linalg.solve(system, right.ravel()).reshape(n, n)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(system, right.ravel(), rcond=None)[0].reshape(n, n)


def legendre_form(C, gamma, a, b, delta, n, h) -> np.ndarray:  # noqa: N803
    """A finite window over a Legendre basis: outputs are Legendre values, so W is a weighted Vandermonde product."""
    j = np.arange(int(a), int(b) + 1)
    start = _argument_of(C, n)
    v = legendre.legvander(start + h * j, n - 1)
    return (v * (gamma ** (j - delta))[:, None]).T @ v


def _argument_of(C, n) -> float:  # noqa: N803
    return float(np.asarray(C).ravel()[1]) if n > 1 else 0.0


def meixner_diagonal(n: int, gamma: float, start: float, delta: int) -> np.ndarray:
    """A backward window from its own start to infinity: Meixner polynomials are orthogonal, with known norms."""
    return gamma ** (start - delta) * np.diag(gamma ** -np.arange(n, dtype=float)) / (1 - gamma)


def is_meixner(A, C=None, tol: float = 1e-10) -> bool:  # noqa: N803
    """Whether A is I - s triu(1, 1) with s > 0 (and C all ones, if given)."""
    A = np.asarray(A, float)  # noqa: N806
    n = len(A)
    if n < 2:
        return False
    s = -A[0, 1]
    return bool(s > 0 and np.allclose(A, np.eye(n) - s * np.triu(np.ones((n, n)), 1), atol=tol) and (C is None or np.allclose(C, 1, atol=tol)))


def is_legendre(A, C=None, tol: float = 1e-10) -> bool:  # noqa: N803
    """Whether A shifts Legendre coefficients by some step (and C holds Legendre values, if given)."""
    A = np.asarray(A, float)  # noqa: N806
    n = len(A)
    if n < 2 or not np.isfinite(A).all():
        return False
    t = np.cos((2 * np.arange(n) + 1) * np.pi / (2 * n))
    v = legendre.legvander(t, n - 1)
    same = np.allclose(A, np.linalg.solve(v, legendre.legvander(t + A[0, 1], n - 1)), atol=tol * max(1, np.abs(A).max()))
    return bool(same and (C is None or np.allclose(np.ravel(C), legendre.legvander([np.ravel(C)[1]], n - 1)[0], atol=tol)))


def gram(model, segment, method: str = "auto", warn: bool = True) -> np.ndarray:
    """W of a model over a segment. method: auto, schur (the same), closed_form (fixed point) or limited_sum."""
    A, C, s = model.A, model.C, segment  # noqa: N806
    finite = np.isfinite([s.a, s.b]).all()
    if method not in ("auto", "schur", "closed_form", "limited_sum"):
        raise ValueError(f"unknown method {method!r}")
    if method == "limited_sum":
        w = limited_sum(A, C, s.gamma, s.a, s.b, s.delta)
    elif method == "closed_form" and not (finite and s.gamma == 1):
        w = stein(A, C, s.gamma, s.a, s.b, s.delta)
    elif model.basis == "legendre" and finite and C.ndim == 1 and model.N > 1:
        w = legendre_form(C, s.gamma, s.a, s.b, s.delta, model.N, A[0, 1])
    elif model.basis == "meixner" and s.b == np.inf and getattr(model, "shift", None) == s.a and np.isclose(model.gamma, s.gamma) and C.ndim == 1:
        w = meixner_diagonal(model.N, s.gamma, s.a, s.delta)
    elif finite and s.b - s.a <= DIRECT:
        w = limited_sum(A, C, s.gamma, s.a, s.b, s.delta)
    else:
        w = stein(A, C, s.gamma, s.a, s.b, s.delta)
    if warn:
        warn_if_singular(w)
    return w


def warn_if_singular(w: np.ndarray) -> None:
    if len(w) and np.linalg.cond(w) > 1e15:
        warnings.warn(f"condition number of W is {np.linalg.cond(w):.3g}", WConditionNumberWarning, stacklevel=3)


def covariance_matrix_limited_sum(A, C, gamma, a, b, delta) -> np.ndarray:  # noqa: N803
    return limited_sum(A, C, gamma, a, b, delta)


def covariance_matrix_closed_form(A, C, gamma, a, b, delta) -> np.ndarray:  # noqa: N803
    return stein(A, C, gamma, a, b, delta)


def covariance_matrix_legendre(A, C, gamma, a, b, delta) -> np.ndarray:  # noqa: N803
    return legendre_form(C, gamma, a, b, delta, len(A), np.asarray(A)[0, 1])


def covariance_matrix_meixner(A, C, gamma, a, b, delta) -> np.ndarray:  # noqa: N803
    """The diagonal for a window to infinity that starts where C is all ones; finite windows are summed."""
    start = np.ravel(C) @ power(np.asarray(A, float), int(a))
    if b == np.inf and np.allclose(start, 1):
        return meixner_diagonal(len(A), gamma, a, delta)
    return stein(A, C, gamma, a, b, delta) if b == np.inf else limited_sum(A, C, gamma, a, b, delta)


def covariance_matrix_schur(A, C, gamma, a, b, delta, basis: str | None = None) -> np.ndarray:  # noqa: N803
    """W of bare matrices; the structure is taken from basis or found out."""
    finite = np.isfinite([a, b]).all()
    if finite and (basis == "legendre" or basis is None and np.ndim(C) == 1 and is_legendre(A, C)):
        return covariance_matrix_legendre(A, C, gamma, a, b, delta)
    if b == np.inf and (basis == "meixner" or basis is None and is_meixner(A)):
        return covariance_matrix_meixner(A, C, gamma, a, b, delta)
    return limited_sum(A, C, gamma, a, b, delta) if finite and b - a <= DIRECT else stein(A, C, gamma, a, b, delta)
