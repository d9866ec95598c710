"""Localized polynomials: fitted coefficients compared with a template polynomial that is shifted, stretched and scaled.

The squared difference, integrated over an interval, is a quadratic form of the coefficients; every grid point of shift and
stretch is a literal vector, so the search is a fold over a literal array in each row, without a join.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as la
from ..functions import poly as pl


def metric(n: int, a: float, b: float) -> np.ndarray:
    """Integrals of x^(i + j) over [a, b]."""
    q = np.add.outer(np.arange(n), np.arange(n)) + 1
    return (float(b) ** q - float(a) ** q) / q


def distance(p: pl.Poly, q: pl.Poly, a: float, b: float) -> float:
    """Integral of (p - q)^2 over [a, b]."""
    d = pl.poly_sum((p, pl.Poly(-q.coef, q.expo)))
    return float(np.diff(pl.poly_int(pl.poly_square(d)).eval(np.array([a, b], float)))[0])


def reduce_degree(p: pl.Poly, degree: int, a: float, b: float) -> pl.Poly:
    """The polynomial of a lower degree that is nearest over [a, b]."""
    n = max(int(max(p.expo)), degree) + 1
    dense = np.bincount(p.expo, p.coef, n)
    m = metric(n, a, b)
    return pl.Poly(np.linalg.solve(m[: degree + 1, : degree + 1], m[: degree + 1] @ dense), np.arange(degree + 1))


def grid(template: pl.Poly, n: int, a: float, b: float, shifts, stretches=(1.0,)) -> list[tuple[float, float, np.ndarray, float]]:
    """(shift, stretch, metric times coefficients, squared norm) of template(stretch * (x + shift))."""
    m, out = metric(n, a, b), []
    for eta in stretches:
        for s in shifts:
            moved = pl.poly_shift(pl.poly_dilation(template, eta), s)
            c = np.bincount(moved.expo, moved.coef, n)
            if len(c) > n:
                raise ValueError("the template's degree exceeds the fit's")
            if not c @ m @ c > 0:
                raise ValueError("the template is zero over the interval")
            out.append((float(s), float(eta), m @ c, float(c @ m @ c)))
    return out


def best_match(df: DataFrame, x: str, n: int, template: pl.Poly, interval, shifts, stretches=(1.0,), name: str = "match") -> DataFrame:
    """df with a struct (cost, shift, stretch, amplitude) of the grid point at the least cost; the amplitude is the best for it."""
    a, b = interval
    own = la.quadratic(metric(n, a, b), F.col(x))

    def at(s: float, eta: float, row: np.ndarray, norm: float) -> Column:
        along = la.dot_literal(F.col(x), row)
        return F.struct((own - along * along / norm).alias("cost"), F.lit(s).alias("shift"), F.lit(eta).alias("stretch"), (along / norm).alias("amplitude"))

    return df.withColumn(name, F.array_min(F.array(*[at(*g) for g in grid(template, n, a, b, shifts, stretches)])))
