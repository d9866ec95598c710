"""Calculus on polynomials.

A univariate polynomial is sum_i coef_i x^expo_i; a multivariate one has a coefficient for every combination of its
variables' exponents, in Kronecker order. Every operation is defined once, on coefficient tensors (an axis per variable);
its matrix on coefficient vectors (`*_L`) is what the operation does to unit vectors, so both always agree.

Polynomial values live on the driver (`Poly`, `MPoly`); the column functions (`col_*`) work on
struct<coef: array<double>, expo: array<int>> columns, and any literal matrix applies to a coefficient column by
`arrays.matvec`.
"""

from __future__ import annotations

from functools import reduce
from itertools import product
from math import comb

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def kron_sequence(arrays, sparse: bool = False):
    """Kronecker product of several arrays; sparse gives (rows, columns, values, shape) of the entries that aren't 0."""
    out = reduce(np.kron, [np.asarray(a) for a in arrays])
    if not sparse:
        return out
    out = np.atleast_2d(out)
    r, c = np.nonzero(out)
    return r, c, out[r, c], out.shape


class MPoly:
    """coefs: a 1-tuple with the full coefficient vector, or one vector per variable (their product is meant)."""

    def __init__(self, coefs, expos):
        self.expos = tuple(np.asarray(e) for e in expos)
        given = tuple(np.asarray(c, float) for c in coefs)
        sizes = tuple(len(e) for e in self.expos)
        if len(given) == len(sizes) and tuple(map(len, given)) == sizes:
            self.coefs_fac = given if len(given) > 1 else None
            self.coefs = (kron_sequence(given),)
        elif len(given) == 1 and len(given[0]) == np.prod(sizes):
            self.coefs_fac, self.coefs = None, given
        else:
            raise ValueError(f"coefficients {[len(c) for c in given]} don't fit exponents {sizes}")

    @property
    def variable_count(self) -> int:
        return len(self.expos)

    @property
    def tensor(self) -> np.ndarray:
        return self.coefs[0].reshape([len(e) for e in self.expos])

    def eval(self, variables):
        """Element-wise value; variables: one array (or number) per variable, of one shape."""
        if len(variables) != self.variable_count:
            raise ValueError(f"{self.variable_count} variables are needed")
        out, values = 0.0, [np.asarray(v, float) for v in variables]
        for at in product(*[range(len(e)) for e in self.expos]):
            term = self.tensor[at]
            for v, e, i in zip(values, self.expos, at, strict=True):
                term = term * v ** e[i]
            out = out + term
        return out

    def __str__(self) -> str:
        return f"{type(self).__name__}(coefs={tuple(c.tolist() for c in self.coefs)}, expos={tuple(e.tolist() for e in self.expos)})"


class Poly(MPoly):
    """One variable."""

    def __init__(self, coef, expo):
        super().__init__((coef,), (expo,))

    coef = property(lambda self: self.coefs[0])
    expo = property(lambda self: self.expos[0])
    Q = property(lambda self: len(self.expos[0]))

    def eval(self, variable):
        return super().eval((variable,))


def _matrix(fn, size: int) -> np.ndarray:
    """The matrix of a linear map on vectors of that size."""
    return np.stack([np.ravel(fn(e)) for e in np.eye(size)], 1)


def _along(tensor: np.ndarray, axis: int, matrix: np.ndarray) -> np.ndarray:
    """A matrix applied along one axis."""
    return np.moveaxis(np.tensordot(matrix, tensor, (1, axis)), 0, axis)


def _changed(expos, position: int, new) -> tuple:
    return tuple(new if i == position else e for i, e in enumerate(expos))


def _without(expos, position: int) -> tuple:
    return tuple(e for i, e in enumerate(expos) if i != position)


def _on(expos, position: int, matrix) -> np.ndarray:
    """The matrix on the whole coefficient vector of one that acts on one variable's coefficients."""
    sizes = [len(e) for e in expos]
    return _matrix(lambda v: _along(v.reshape(sizes), position, np.atleast_2d(matrix)), int(np.prod(sizes)))


# one variable: sums and products


def poly_sum_coef(polys) -> np.ndarray:
    return np.concatenate([p.coef for p in polys])


def poly_sum_expo(expos) -> np.ndarray:
    return np.concatenate([np.asarray(e) for e in expos])


def poly_sum_coef_Ls(expos) -> list[np.ndarray]:  # noqa: N802
    """Blocks that place each polynomial's coefficients in the sum's."""
    sizes = [len(e) for e in expos]
    return np.split(np.eye(sum(sizes)), np.cumsum(sizes)[:-1], axis=1)


poly_sum_expo_Ms = poly_sum_coef_Ls


def poly_sum(polys) -> Poly:
    """Terms side by side; equal exponents aren't merged."""
    return Poly(poly_sum_coef(polys), poly_sum_expo([p.expo for p in polys]))


def poly_prod_coef(polys) -> np.ndarray:
    return kron_sequence([p.coef for p in polys])


def poly_prod_expo(expos) -> np.ndarray:
    return reduce(lambda q, r: np.add.outer(q, r).ravel(), [np.asarray(e) for e in expos])


def poly_prod_expo_Ms(expos) -> list[np.ndarray]:  # noqa: N802
    """Matrices whose sum over the factors' exponents is the product's."""
    sizes = [len(e) for e in expos]
    return [kron_sequence([np.eye(n) if i == k else np.ones((n, 1)) for i, n in enumerate(sizes)]) for k in range(len(sizes))]


def poly_prod(polys) -> Poly:
    return Poly(poly_prod_coef(polys), poly_prod_expo([p.expo for p in polys]))


def poly_square_coef(poly) -> np.ndarray:
    return poly_prod_coef((poly, poly))


def poly_square_expo(expo) -> np.ndarray:
    return poly_prod_expo((expo, expo))


def poly_square_expo_M(expo) -> np.ndarray:  # noqa: N802
    return sum(poly_prod_expo_Ms((expo, expo)))


def poly_square(poly) -> Poly:
    return poly_prod((poly, poly))


# one variable: shift, dilation, integral, derivative


def poly_shift_expo(expo) -> np.ndarray:
    return np.arange(int(max(expo)) + 1)


def poly_shift_coef_L(expo, gamma) -> np.ndarray:  # noqa: N802
    """Binomial theorem for (x + gamma)^q."""
    return np.array([[comb(int(q), int(s)) * float(gamma) ** max(int(q) - int(s), 0) for q in expo] for s in poly_shift_expo(expo)])


def poly_shift_coef(poly, gamma) -> np.ndarray:
    return poly_shift_coef_L(poly.expo, gamma) @ poly.coef


def poly_shift(poly, gamma) -> Poly:
    return Poly(poly_shift_coef(poly, gamma), poly_shift_expo(poly.expo))


def poly_dilation_coef_L(expo, eta) -> np.ndarray:  # noqa: N802
    return np.diag(float(eta) ** np.asarray(expo))


def poly_dilation_coef(poly, eta) -> np.ndarray:
    return poly.coef * float(eta) ** poly.expo


def poly_dilation(poly, eta) -> Poly:
    return Poly(poly_dilation_coef(poly, eta), poly.expo)


def poly_int_expo(expo) -> np.ndarray:
    return np.asarray(expo) + 1


def poly_int_coef_L(expo) -> np.ndarray:  # noqa: N802
    return np.diag(1.0 / poly_int_expo(expo))


def poly_int_coef(poly) -> np.ndarray:
    return poly.coef / poly_int_expo(poly.expo)


def poly_int(poly) -> Poly:
    """The antiderivative that is 0 at 0."""
    return Poly(poly_int_coef(poly), poly_int_expo(poly.expo))


def poly_diff_expo(expo) -> np.ndarray:
    return np.maximum(np.asarray(expo) - 1, 0)


def poly_diff_coef_L(expo) -> np.ndarray:  # noqa: N802
    return np.diag(np.asarray(expo, float))


def poly_diff_coef(poly) -> np.ndarray:
    return poly.coef * poly.expo


def poly_diff(poly) -> Poly:
    return Poly(poly_diff_coef(poly), poly_diff_expo(poly.expo))


# several variables: operations on one of them


def mpoly_int_expos(expos, position) -> tuple:
    return _changed(expos, position, poly_int_expo(expos[position]))


def mpoly_int_coef_L(expos, position, sparse=False) -> np.ndarray:  # noqa: N802
    return _on(expos, position, poly_int_coef_L(expos[position]))


def mpoly_int_coef(mpoly, position) -> np.ndarray:
    return _along(mpoly.tensor, position, poly_int_coef_L(mpoly.expos[position])).ravel()


def mpoly_int(mpoly, position) -> MPoly:
    return MPoly((mpoly_int_coef(mpoly, position),), mpoly_int_expos(mpoly.expos, position))


def mpoly_diff_expos(expos, position) -> tuple:
    return _changed(expos, position, poly_diff_expo(expos[position]))


def mpoly_diff_coef_L(expos, position, sparse=False) -> np.ndarray:  # noqa: N802
    return _on(expos, position, poly_diff_coef_L(expos[position]))


def mpoly_diff_coef(mpoly, position, sparse=False) -> np.ndarray:
    return _along(mpoly.tensor, position, poly_diff_coef_L(mpoly.expos[position])).ravel()


def mpoly_diff(mpoly, position, sparse=False) -> MPoly:
    return MPoly((mpoly_diff_coef(mpoly, position),), mpoly_diff_expos(mpoly.expos, position))


def mpoly_substitute_expos(expos, position) -> tuple:
    return _without(expos, position)


def mpoly_substitute_coef_L(expos, position, substitute) -> np.ndarray:  # noqa: N802
    return _on(expos, position, float(substitute) ** np.asarray(expos[position]))


def mpoly_substitute_coef(mpoly, position, substitute) -> np.ndarray:
    return np.tensordot(float(substitute) ** mpoly.expos[position], mpoly.tensor, (0, position)).ravel()


def mpoly_substitute(mpoly, position, substitute) -> MPoly:
    """One variable becomes a number and goes."""
    return MPoly((mpoly_substitute_coef(mpoly, position, substitute),), mpoly_substitute_expos(mpoly.expos, position))


def mpoly_def_int_expos(expos, position) -> tuple:
    return _without(expos, position)


def mpoly_def_int_coef_L(expos, position, a, b, sparse=False) -> np.ndarray:  # noqa: N802
    q = poly_int_expo(expos[position])
    return _on(expos, position, (float(b) ** q - float(a) ** q) / q)


def mpoly_def_int_coef(mpoly, position, a, b) -> np.ndarray:
    return mpoly_def_int_coef_L(mpoly.expos, position, a, b) @ mpoly.coefs[0]


def mpoly_def_int(mpoly, position, a, b) -> MPoly:
    """Integral over one variable from a to b."""
    return MPoly((mpoly_def_int_coef(mpoly, position, a, b),), mpoly_def_int_expos(mpoly.expos, position))


def mpoly_dilate_expos(expos) -> tuple:
    return tuple(expos)


def mpoly_dilate_coef_L(expos, position, eta) -> np.ndarray:  # noqa: N802
    return _on(expos, position, poly_dilation_coef_L(expos[position], eta))


def mpoly_dilate_coefs(mpoly, position, eta) -> tuple:
    return (_along(mpoly.tensor, position, poly_dilation_coef_L(mpoly.expos[position], eta)).ravel(),)


def mpoly_dilate(mpoly, position, eta) -> MPoly:
    return MPoly(mpoly_dilate_coefs(mpoly, position, eta), mpoly.expos)


# several variables: sums, products, squares


def mpoly_add_expos(poly1, poly2) -> tuple:
    return tuple(np.concatenate([[0], p.expo]) for p in (poly1, poly2))


def mpoly_add_coefs(poly1, poly2) -> tuple:
    """The two parts of p1(x) + p2(y) over the joint exponents."""
    one = lambda p: np.r_[1.0, np.zeros(p.Q)]
    return kron_sequence([np.r_[0.0, poly1.coef], one(poly2)]), kron_sequence([one(poly1), np.r_[0.0, poly2.coef]])


def mpoly_add(poly1, poly2) -> MPoly:
    """p1(x) + p2(y)."""
    return MPoly((sum(mpoly_add_coefs(poly1, poly2)),), mpoly_add_expos(poly1, poly2))


def mpoly_multiply(poly1, poly2) -> MPoly:
    """p1(x) p2(y), as factors where both are products of a factor per variable."""
    parts = [p.coefs_fac or (p.coefs if p.variable_count == 1 else None) for p in (poly1, poly2)]
    coefs = (*parts[0], *parts[1]) if all(parts) else (np.kron(poly1.coefs[0], poly2.coefs[0]),)
    return MPoly(coefs, (*poly1.expos, *poly2.expos))


def mpoly_prod(polys) -> MPoly:
    """Product of polynomials of a variable each."""
    return reduce(mpoly_multiply, polys)


def mpoly_square_expos(expos) -> tuple:
    return tuple(poly_square_expo(e) for e in expos)


def mpoly_square_expo_Ms(expos) -> list[np.ndarray]:  # noqa: N802
    return [poly_square_expo_M(e) for e in expos]


def _square_places(sizes) -> np.ndarray:
    """Where the entry (i1, i2, .., j1, j2, ..) of coef x coef stands in the order (i1, j1, i2, j2, ..)."""
    n = len(sizes)
    mixed = np.arange(int(np.prod(sizes)) ** 2).reshape(*sizes, *sizes)
    return mixed.transpose([a for k in range(n) for a in (k, n + k)]).ravel()


def mpoly_square_coef_L(expos, sparse=False) -> np.ndarray:  # noqa: N802
    """The permutation that brings coef x coef into the order of the squared exponents; any number of variables."""
    places = _square_places([len(e) for e in expos])
    return np.eye(len(places))[places]


def mpoly_square_coef(mpoly, sparse=False) -> np.ndarray:
    return np.kron(mpoly.coefs[0], mpoly.coefs[0])[_square_places([len(e) for e in mpoly.expos])]


def mpoly_square(mpoly, sparse=False) -> MPoly:
    return MPoly((mpoly_square_coef(mpoly),), mpoly_square_expos(mpoly.expos))


# one variable becomes two


def mpoly_shift_expos(expo) -> tuple:
    return (poly_shift_expo(expo),) * 2


def mpoly_shift_coef_L(expo) -> np.ndarray:  # noqa: N802
    """p(x + y) over powers of (y, x)."""
    n = int(max(expo)) + 1
    out = np.zeros((n, n, len(expo)))
    for i, q in enumerate(expo):
        for s in range(int(q) + 1):
            out[int(q) - s, s, i] = comb(int(q), s)
    return out.reshape(n * n, len(expo))


def mpoly_shift_coef(poly) -> np.ndarray:
    return mpoly_shift_coef_L(poly.expo) @ poly.coef


def mpoly_shift(poly) -> MPoly:
    return MPoly((mpoly_shift_coef(poly),), mpoly_shift_expos(poly.expo))


def mpoly_dilate_ind_expos(expo) -> tuple:
    return (expo, expo)


def mpoly_dilate_ind_coef_L(expo) -> np.ndarray:  # noqa: N802
    """p(x y): coefficients on the diagonal of the joint exponents."""
    return _matrix(np.diag, len(expo))


def mpoly_dilate_ind_coefs(poly) -> tuple:
    return (np.diag(poly.coef).ravel(),)


def mpoly_dilate_ind(poly) -> MPoly:
    return MPoly(mpoly_dilate_ind_coefs(poly), mpoly_dilate_ind_expos(poly.expo))


def extend_basis(mpoly, new_expos) -> MPoly:
    """The same polynomial with further variables that don't matter; each new exponent vector has one 0."""
    out = mpoly.tensor
    for e in new_expos:
        at = np.asarray(e) == 0
        if at.sum() != 1:
            raise ValueError("a new exponent vector needs exactly one 0")
        out = np.multiply.outer(out, at.astype(float))
    return MPoly((out.ravel(),), (*mpoly.expos, *[np.asarray(e) for e in new_expos]))


def mpoly_extend_coef_L(expos, pos, sparse=False) -> np.ndarray:  # noqa: N802
    """Inserts variables at the given positions, at their exponent 0; expos are those of the result."""
    return kron_sequence([(np.asarray(e) == 0).astype(float)[:, None] if n in pos else np.eye(len(e)) for n, e in enumerate(expos)])


# permutations, like terms, transformations


def commutation_matrix(m, n, sparse=False) -> np.ndarray:
    """K with K (a x b) = b x a for a of n and b of m entries."""
    return np.eye(m * n, dtype=int)[np.arange(m * n).reshape(n, m).T.ravel()]


def permutation_matrix(m, n, i, j, sparse=False) -> np.ndarray:
    return kron_sequence([np.eye(n, dtype=int), commutation_matrix(m, j), np.eye(i, dtype=int)])


def permutation_matrix_square(m, i, sparse=False) -> np.ndarray:
    return permutation_matrix(m, m, i, i)


def remove_redundancy(expo) -> tuple[np.ndarray, np.ndarray]:
    """The matrix that adds coefficients of equal exponents, and the distinct exponents."""
    distinct, place = np.unique(np.asarray(expo), return_inverse=True)
    return np.eye(len(distinct))[:, place], distinct


def mpoly_remove_redundancy(expos, sparse=False) -> tuple[np.ndarray, tuple]:
    parts = [remove_redundancy(e) for e in expos]
    return kron_sequence([p[0] for p in parts]), tuple(p[1] for p in parts)


def mpoly_transformation_expos(q) -> tuple:
    return (q, q, q, np.arange(2))


def mpoly_transformation_coef_L(q, c=0) -> np.ndarray:  # noqa: N802
    """Scaling, a shift by c and a free shift of a polynomial of exponents 0 .. len(q) - 1, over (scale, shift, x, amplitude)."""
    n = len(q)
    powers = np.arange(n)
    scaled = mpoly_dilate_ind_coef_L(powers)
    moved = np.kron(mpoly_shift_coef_L(powers) @ poly_shift_coef_L(powers, c), np.eye(n))
    ordered = np.kron(np.eye(n), commutation_matrix(n, n))
    return np.kron(ordered @ moved @ scaled, np.array([[0.0], [1.0]]))


# columns


def col_poly(coef, expo) -> Column:
    """A literal polynomial column."""
    return F.struct(F.array(*[F.lit(float(c)) for c in coef]).alias("coef"), F.array(*[F.lit(int(e)) for e in expo]).alias("expo"))


def col_eval(p: Column, x: Column) -> Column:
    terms = F.zip_with(p["coef"], p["expo"], lambda c, q: F.when(q == 0, c).otherwise(c * F.pow(x, q)))
    return F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)


def _made(coef: Column, expo: Column) -> Column:
    return F.struct(coef.alias("coef"), expo.alias("expo"))


def col_sum(p: Column, q: Column) -> Column:
    return _made(F.concat(p["coef"], q["coef"]), F.concat(p["expo"], q["expo"]))


def col_prod(p: Column, q: Column) -> Column:
    both = lambda a, b, f: F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: f(x, y))))
    return _made(both(p["coef"], q["coef"], lambda x, y: x * y), both(p["expo"], q["expo"], lambda x, y: x + y))


def col_square(p: Column) -> Column:
    return col_prod(p, p)


def col_diff(p: Column) -> Column:
    return _made(F.zip_with(p["coef"], p["expo"], lambda c, q: c * q), F.transform(p["expo"], lambda q: F.greatest(q - 1, F.lit(0))))


def col_int(p: Column) -> Column:
    return _made(F.zip_with(p["coef"], p["expo"], lambda c, q: c / (q + 1)), F.transform(p["expo"], lambda q: q + 1))


def col_dilation(p: Column, eta: Column) -> Column:
    return _made(F.zip_with(p["coef"], p["expo"], lambda c, q: c * F.pow(eta, q)), p["expo"])


def col_shift(p: Column, gamma: Column) -> Column:
    """p(x + gamma) over exponents 0 .. the largest."""

    def binomial(q: Column, s: Column) -> Column:
        return F.aggregate(F.when(s > 0, F.sequence(F.lit(1), s)).otherwise(F.expr("array()").cast("array<int>")), F.lit(1.0), lambda r, i: r * (q - s + i) / i)

    def at(s: Column) -> Column:
        parts = F.zip_with(p["coef"], p["expo"], lambda c, q: F.when(q < s, 0.0).otherwise(c * binomial(q, s) * F.when(q == s, 1.0).otherwise(F.pow(gamma, q - s))))
        return F.aggregate(parts, F.lit(0.0), lambda a, b: a + b)

    expo = F.sequence(F.lit(0), F.array_max(p["expo"]))
    return _made(F.transform(expo, at), expo)


def col_merged(p: Column) -> Column:
    """Equal exponents merged, in order."""
    expo = F.array_sort(F.array_distinct(p["expo"]))
    pairs = F.arrays_zip(p["coef"], p["expo"])
    coef = F.transform(expo, lambda e: F.aggregate(F.filter(pairs, lambda z: z["expo"] == e), F.lit(0.0), lambda s, z: s + z["coef"]))
    return _made(coef, expo)


# fits over polynomial coefficients


def constrain_matrix_for_exponents(expos, threshold) -> np.ndarray:
    """Columns of the identity for exponent combinations of total degree threshold at most."""
    degrees = reduce(lambda a, b: np.add.outer(a, b).ravel(), [np.asarray(e) for e in expos])
    return np.eye(len(degrees))[:, degrees <= threshold]


def subspace_terms(beta_expo, boundaries, coord, coord_expos) -> tuple[np.ndarray, np.ndarray]:
    """For one sampled polynomial: A (its coefficients from those of the fit) and C (the integral's metric)."""
    a, b = boundaries
    if a > b:
        raise ValueError("a <= b isn't fulfilled")
    q = poly_square_expo(beta_expo) + 1
    metric = ((float(b) ** q - float(a) ** q) / q).reshape(len(beta_expo), len(beta_expo))
    powers = kron_sequence([float(v) ** np.asarray(e) for v, e in zip(coord, coord_expos, strict=True)])
    return np.kron(np.eye(len(beta_expo)), powers), metric


def fit_subspace(betas, beta_expo, boundaries, coords, coord_expos, H=None, return_cost: bool = False):  # noqa: N803
    """Coefficients of the multivariate polynomial nearest, in the integral of squares over the boundaries, to univariate
    polynomials sampled at coordinates. betas: (N, Q, ...)."""
    betas = np.asarray(betas, float)
    if betas.shape[1] != len(beta_expo) or len(coords) != len(betas):
        raise ValueError("betas don't fit their exponents or coordinates")
    left, right, energy = 0.0, 0.0, 0.0
    for beta, coord in zip(betas, coords, strict=True):
        a, c = subspace_terms(beta_expo, boundaries, np.atleast_1d(coord), coord_expos)
        a = a if H is None else a @ H
        left, right = left + a.T @ c @ a, right + np.tensordot(a.T @ c, beta, 1)
        energy = energy + np.einsum("a...,ab,b...->...", beta, c, beta)
    out = np.tensordot(np.linalg.pinv(left), right, 1)
    if not return_cost:
        return out
    return out, np.einsum("a...,ab,b...->...", out, left, out) - 2 * np.einsum("a...,a...->...", right, out) + energy


mpoly_fit_subspace1 = fit_subspace
