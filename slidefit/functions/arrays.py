"""Linear algebra on array<double> columns with literal matrices; all stays inside Catalyst."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def lit_vector(v) -> Column:
    return F.array(*[F.lit(float(x)) for x in np.ravel(v)])


def lit_matrix(m) -> Column:
    return F.array(*[lit_vector(r) for r in np.atleast_2d(m)])


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, z: s + z)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda p, q: p * q))


def dot_literal(a: Column, v) -> Column:
    """a . v as plain arithmetic on the elements that count: code generation sees scalars, zeros vanish."""
    terms = [a[i] if c == 1 else a[i] * F.lit(float(c)) for i, c in enumerate(np.ravel(v)) if c]
    out = terms[0] if terms else F.lit(0.0)
    for t in terms[1:]:
        out = out + t
    return out


def matvec(m, a: Column) -> Column:
    """Literal matrix times array."""
    return F.array(*[dot_literal(a, r) for r in np.atleast_2d(m)])


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda p, q: p + q)


def kron(a: Column, b: Column) -> Column:
    """Kronecker product of two vectors."""
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: x * y)))


def quadratic(m, a: Column) -> Column:
    """a' M a with a literal M."""
    return dot(a, matvec(m, a))


def zeros(n: int) -> Column:
    return F.array(*[F.lit(0.0)] * n)
