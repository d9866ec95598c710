from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from slidefit.functions import poly as pl

X = np.linspace(-2, 2, 9)
A, B = pl.Poly([1, 3, 5], [0, 1, 2]), pl.Poly([2, -1], [0, 1])
M = pl.MPoly(([1.0, -2.0, 0.5], [3.0, 1.0]), ([0, 1, 3], [1, 2]))
U, V = np.meshgrid(X, X + 0.3)


def test_printed_examples():
    s = pl.poly_sum((A, B))
    assert s.coef.tolist() == [1, 3, 5, 2, -1] and s.expo.tolist() == [0, 1, 2, 0, 1]
    d = pl.poly_diff(A)
    assert d.coef.tolist() == [0, 3, 10] and d.expo.tolist() == [0, 0, 1]


polys = st.lists(st.tuples(st.floats(-3, 3), st.integers(0, 4)), min_size=1, max_size=4).map(lambda t: pl.Poly([c for c, _ in t], [q for _, q in t]))


@settings(max_examples=40, deadline=None)
@given(polys, polys, st.floats(-1.5, 1.5))
def test_univariate_operations_by_value(p, q, g):
    close = lambda a, b: np.testing.assert_allclose(a, b, atol=1e-6, rtol=1e-8)
    close(pl.poly_sum((p, q)).eval(X), p.eval(X) + q.eval(X))
    close(pl.poly_prod((p, q)).eval(X), p.eval(X) * q.eval(X))
    close(pl.poly_square(p).eval(X), p.eval(X) ** 2)
    close(pl.poly_shift(p, g).eval(X), p.eval(X + g))
    close(pl.poly_dilation(p, g).eval(X), p.eval(g * X))
    close(pl.poly_diff(pl.poly_int(p)).eval(X), p.eval(X))
    close(sum(L @ r.coef for L, r in zip(pl.poly_sum_coef_Ls((p.expo, q.expo)), (p, q), strict=True)), pl.poly_sum_coef((p, q)))
    close(sum(m @ e for m, e in zip(pl.poly_prod_expo_Ms((p.expo, q.expo)), (p.expo, q.expo), strict=True)), pl.poly_prod_expo((p.expo, q.expo)))
    close(pl.poly_square_expo_M(p.expo) @ p.expo, pl.poly_square_expo(p.expo))
    close(pl.poly_int_coef_L(p.expo) @ p.coef, pl.poly_int_coef(p))
    close(pl.poly_diff_coef_L(p.expo) @ p.coef, pl.poly_diff_coef(p))
    close(pl.poly_dilation_coef_L(p.expo, g) @ p.coef, pl.poly_dilation_coef(p, g))
    L, e = pl.remove_redundancy(p.expo)
    close(pl.Poly(L @ p.coef, e).eval(X), p.eval(X))
    close(pl.mpoly_shift(p).eval((U, V)), p.eval(U + V))
    close(pl.mpoly_dilate_ind(p).eval((U, V)), p.eval(U * V))
    close(pl.mpoly_add(p, q).eval((U, V)), p.eval(U) + q.eval(V))
    close(pl.mpoly_multiply(p, q).eval((U, V)), p.eval(U) * q.eval(V))


def test_multivariate_operations_by_value():
    close = np.testing.assert_allclose
    close(M.eval((U, V)), (1 - 2 * U + 0.5 * U**3) * (3 * V + V**2))
    for position in (0, 1):
        close(pl.mpoly_diff(pl.mpoly_int(M, position), position).eval((U, V)), M.eval((U, V)), atol=1e-9)
        close(pl.mpoly_dilate(M, position, 1.5).eval((U, V)), M.eval((U * 1.5, V) if position == 0 else (U, V * 1.5)), atol=1e-9)
        rest = V if position == 0 else U
        close(pl.mpoly_substitute(M, position, 0.7).eval((rest,)), M.eval((np.full_like(V, 0.7), V) if position == 0 else (U, np.full_like(U, 0.7))), atol=1e-9)
        primitive = pl.mpoly_int(M, position)
        at = lambda c: primitive.eval((np.full_like(V, c), V) if position == 0 else (U, np.full_like(U, c)))  # noqa: B023, E731
        close(pl.mpoly_def_int(M, position, -1, 2).eval((rest,)), at(2) - at(-1), atol=1e-9)
        for fn, args in ((pl.mpoly_int, ()), (pl.mpoly_diff, ()), (pl.mpoly_substitute, (0.7,)), (pl.mpoly_def_int, (-1, 2))):
            matrix = getattr(pl, fn.__name__ + "_coef_L")(M.expos, position, *args)
            close(matrix @ M.coefs[0], fn(M, position, *args).coefs[0], atol=1e-12)
        close(pl.mpoly_dilate_coef_L(M.expos, position, 2) @ M.coefs[0], pl.mpoly_dilate_coefs(M, position, 2)[0])


def test_squares_of_any_number_of_variables():
    three = pl.mpoly_prod([pl.Poly([1, 2], [0, 1]), pl.Poly([3, -1, 1], [0, 1, 2]), pl.Poly([1, 1], [0, 2])])
    rng = np.random.default_rng(1)
    for p in (A, M, three, pl.MPoly((rng.standard_normal(12),), ([0, 1], [0, 1, 2], [0, 3]))):
        x = tuple(rng.standard_normal(5) for _ in range(p.variable_count))
        np.testing.assert_allclose(pl.mpoly_square(p).eval(x), p.eval(x[0] if p is A else x) ** 2, rtol=1e-9)
        np.testing.assert_allclose(pl.mpoly_square_coef_L(p.expos) @ np.kron(p.coefs[0], p.coefs[0]), pl.mpoly_square_coef(p))
    np.testing.assert_allclose(pl.mpoly_square_coef_L(M.expos), pl.permutation_matrix_square(3, 2))


def test_commutation():
    rng = np.random.default_rng(2)
    a, b = rng.standard_normal(3), rng.standard_normal(4)
    np.testing.assert_allclose(pl.commutation_matrix(4, 3) @ np.kron(a, b), np.kron(b, a))
    k = pl.commutation_matrix(3, 4)
    want = np.zeros_like(k)
    for i, j in product(range(3), range(4)):
        t = np.kron(np.eye(3, dtype=int)[[i]].T, np.eye(4, dtype=int)[[j]])
        want += np.kron(t, t.T)
    np.testing.assert_array_equal(k, want)
    assert pl.permutation_matrix(2, 3, 2, 4).shape == (48, 48)


def test_extending_and_transforming():
    e = pl.extend_basis(M, [np.array([0, 1])])
    np.testing.assert_allclose(e.eval((X, X, X * 3)), M.eval((X, X)), atol=1e-9)
    np.testing.assert_allclose(pl.mpoly_extend_coef_L((*M.expos, np.array([0, 1])), [2]) @ M.coefs[0], e.coefs[0])
    with pytest.raises(ValueError):
        pl.extend_basis(M, [np.array([1, 2])])
    q = np.arange(3)
    t = pl.MPoly((pl.mpoly_transformation_coef_L(q, 0.4) @ A.coef,), pl.mpoly_transformation_expos(q))
    assert t.variable_count == 4 and np.isfinite(t.eval((0.5, 0.2, 0.7, 2.0)))
    L, expos = pl.mpoly_remove_redundancy(([0, 1, 1], [0, 0]))
    m = pl.MPoly(([1.0, 2, 3], [4.0, 5]), ([0, 1, 1], [0, 0]))
    np.testing.assert_allclose(pl.MPoly((L @ m.coefs[0],), expos).eval((X, X)), m.eval((X, X)))
    r, c, v, shape = pl.kron_sequence([np.eye(2), np.eye(3)], sparse=True)
    assert shape == (6, 6) and r.tolist() == c.tolist() and (v == 1).all()
    h = pl.constrain_matrix_for_exponents(([0, 1, 2], [0, 1]), 1)
    assert h.shape == (6, 3)


def test_subspace_fit_recovers():
    """Polynomials sampled from a known bivariate one are given back, at no cost."""
    truth = np.array([1.0, 2, -1, 0.5])  # (x exponents 0, 1) x (coordinate exponents 0, 1)
    coords = np.linspace(-1, 1, 6)[:, None]
    betas = np.stack([truth.reshape(2, 2) @ np.array([1, c[0]]) for c in coords])
    got, cost = pl.fit_subspace(betas, [0, 1], (-1, 1), coords, ([0, 1],), return_cost=True)
    np.testing.assert_allclose(got, truth, atol=1e-9)
    np.testing.assert_allclose(cost, 0, atol=1e-9)


def test_columns(spark):
    df = spark.createDataFrame([(float(x),) for x in X], "x double")
    p, q, x = pl.col_poly(A.coef, A.expo), pl.col_poly(B.coef, B.expo), F.col("x")
    made = [pl.col_sum(p, q), pl.col_prod(p, q), pl.col_square(p), pl.col_diff(p), pl.col_int(p), pl.col_dilation(p, F.lit(0.5)), pl.col_shift(p, F.lit(-1.5)), pl.col_merged(pl.col_prod(p, q))]
    want = [A.eval(X) + B.eval(X), A.eval(X) * B.eval(X), A.eval(X) ** 2, pl.poly_diff(A).eval(X), pl.poly_int(A).eval(X), A.eval(X / 2), A.eval(X - 1.5), A.eval(X) * B.eval(X)]
    rows = df.select(*[pl.col_eval(c, x).alias(f"c{i}") for i, c in enumerate(made)]).collect()
    np.testing.assert_allclose(np.array(rows), np.stack(want, 1), atol=1e-9)
