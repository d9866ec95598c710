import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from slidefit.operators.estimator import Estimator
from slidefit.operators.nd import NDEstimator
from slidefit.operators.windowed import STRATEGIES, Term, scan_blocks, windowed_sums
from slidefit.plans import costs, gram, models, segments

S = segments.Segment
GOLDEN_VARYING = [0.00078396, 0.00175143, 0.00267136, 0.00290315, 0.00288889, 0.00629653, 0.02259697, 0.05396076, 0.08716118, 0.10819699]
GOLDEN_STEADY = [0.09217478, 0.17659045, 0.22973486, 0.18450274, 0.07276776, 0.00629653, 0.02259697, 0.05396076, 0.08716118, 0.10819699]


def sine_cost(degree=2):
    return costs.CompositeCost([models.AlssmPoly(degree)], [S(-5, -1, "fw", 10), S(0, 5, "bw", 10)], np.ones((1, 2)))


def signal(spark, y, name="s"):
    return spark.createDataFrame([(name, k, float(v)) for k, v in enumerate(y)], "series_id string, k long, y double")


@pytest.mark.parametrize("steady, golden", [(False, GOLDEN_VARYING), (True, GOLDEN_STEADY)])
def test_golden_errors(spark, steady, golden):
    df = signal(spark, np.sin(np.linspace(0, 2 * np.pi, 20)))
    e = Estimator(sine_cost(), steady_state=steady)
    got = [r.J for r in e.eval_errors(e.minimize_x(e.filter(df))).orderBy("k").select("J").collect()]
    np.testing.assert_allclose(got, golden + golden[::-1], atol=6e-9)


def test_golden_channel_set(spark):
    t = np.linspace(0, 2 * np.pi, 20)
    df = spark.createDataFrame([("s", c, k, float(v)) for c, y in enumerate((np.sin(t), 1.5 * np.cos(t))) for k, v in enumerate(y)], "series_id string, ch int, k long, y double")
    e = Estimator(sine_cost(), steady_state=False, keys=("series_id", "ch"))
    got = [r.J for r in e.eval_errors(e.minimize_x(e.filter(df))).where("ch = 1").orderBy("k").collect()]
    golden = [0.00198539, 0.00838537, 0.02624551, 0.06540435, 0.13690168, 0.24825427, 0.21157827, 0.14100976, 0.06630881, 0.01897823]
    np.testing.assert_allclose(got, golden + golden[::-1], atol=6e-9)


def direct(y, cost, k):
    xi, w = np.zeros(cost.get_alssm_order()), 0
    for m, s, beta in cost.cells():
        for j in range(int(s.a), int(s.b) + 1):
            if 0 <= k + j < len(y):
                r = m.output_row(j)
                xi, w = xi + beta * s.gamma ** (j - s.delta) * r * y[k + j], w + beta * s.gamma ** (j - s.delta) * np.outer(r, r)
    return xi, w


@pytest.mark.parametrize("window", [(-10, -1), (0, 7), (2, 9), (-6, 5), (-9, -3)])
def test_strategies_agree(spark, window):
    y = np.random.default_rng(3).standard_normal(40)
    df = signal(spark, y)
    cost = costs.CostSegment(models.AlssmPoly(1), S(*window, "bw", 20))
    want = np.stack([direct(y, cost, k)[0] for k in range(40)])
    for strategy in [s for s in STRATEGIES if s != "auto"]:
        got = [r.xi for r in Estimator(cost, strategy=strategy).filter(df).orderBy("k").collect()]
        np.testing.assert_allclose(got, want, atol=1e-9, err_msg=strategy)
    for strategy in ("shift", "doubling", "fold"):
        got = [r.xi for r in Estimator(cost, strategy=strategy, block=7).filter(df).orderBy("k").collect()]
        np.testing.assert_allclose(got, want, atol=1e-9, err_msg=f"{strategy} in blocks")


def test_infinite_windows(spark):
    y = np.random.default_rng(4).standard_normal(300)
    df = signal(spark, y)
    m = models.AlssmPoly(1)
    for s in (S(-np.inf, -1, "fw", 8), S(0, np.inf, "bw", 8), S(-np.inf, 2, "fw", 8), S(-3, np.inf, "bw", 8)):
        want = np.zeros((300, 2))
        for k in range(300):
            for i in range(300):
                if s.a <= i - k <= s.b:
                    want[k] += s.gamma ** (i - k) * m.output_row(i - k) * y[i]
        got = [r.xi for r in Estimator(costs.CostSegment(m, s)).filter(df).orderBy("k").collect()]
        np.testing.assert_allclose(got, want, atol=1e-8)
        for block in (64, None):
            whole = Estimator(costs.CostSegment(m, s), block=block).filter(df).orderBy("k").collect()
            np.testing.assert_allclose([r.xi for r in whole], want, atol=1e-8)
        blocks = scan_blocks(df, [Term("xi", m.A, m.C, "y", s.a, s.b, s.gamma, 0)], ["series_id"], block=64)
        np.testing.assert_allclose([r.xi for r in blocks.orderBy("k").collect()], want, atol=1e-8)
    two = costs.CompositeCost([m], [S(-np.inf, -1, "fw", 8), S(0, 5, "bw", 8), S(6, np.inf, "bw", 9)], np.ones((1, 3)))
    got, want = ([(*r.xi, r.kappa, r.nu) for r in Estimator(two, block=b, dense=False).filter(df.where("k % 7 <> 3")).orderBy("k").collect()] for b in (32, None))
    np.testing.assert_allclose(got, want, atol=1e-8)
    with pytest.raises(ValueError):
        scan_blocks(df, [Term("xi", m.A, m.C, "y", -3, 3, 1.0, 0)], ["series_id"])


def test_gaps_and_nulls(spark):
    rows = [("s", k, None if k == 4 else float(k)) for k in range(12) if k != 7]
    df = spark.createDataFrame(rows, "series_id string, k long, y double")
    cost = costs.CostSegment(models.AlssmPoly(0), S(-2, 2, "bw", 1e9))
    got = {r.k: (r.kappa, r.nu) for r in Estimator(cost, dense=False).filter(df).collect()}
    np.testing.assert_allclose(got[5], (3**2 + 5**2 + 6**2, 3), rtol=1e-6)
    assert Estimator(cost).filter(df.limit(0)).count() == 0


def test_weights_and_vector_outputs(spark):
    rng = np.random.default_rng(5)
    y, v = rng.standard_normal((30, 2)), rng.random(30)
    df = spark.createDataFrame([("s", k, y[k].tolist(), float(v[k])) for k in range(30)], "series_id string, k long, y array<double>, w double")
    m = models.AlssmStacked([models.AlssmPoly(1), models.AlssmExp(0.9)])
    s = S(-4, 3, "bw", 10)
    e = Estimator(costs.CostSegment(m, s), steady_state=False, w="w")
    for r in e.filter(df).collect():
        rows = [(s.gamma**j * v[r.k + j], m.output_row(j), y[r.k + j]) for j in range(-4, 4) if 0 <= r.k + j < 30]
        np.testing.assert_allclose(r.xi, sum(g * c.T @ z for g, c, z in rows), atol=1e-10)
        np.testing.assert_allclose(r.W, sum(g * c.T @ c for g, c, z in rows), atol=1e-10)
        np.testing.assert_allclose(r.kappa, sum(g * z @ z for g, c, z in rows), atol=1e-10)


def test_constrained_and_solvers(spark):
    y = np.random.default_rng(6).standard_normal(60)
    df = signal(spark, y)
    cost = costs.TSLM.create_cost((-8, 8), (20, 20))
    for steady in (True, False):
        e = Estimator(cost, steady_state=steady)
        f = e.filter(df)
        for H, h in ((costs.TSLM.H_Continuous, None), (costs.TSLM.H_Peak, np.array([0.1, 0, 0.2, 0]))):
            for solver in ("lstsq", "solve", "inv"):
                out = e.minimize_v(e.minimize_x(f, H, h, solver), H, h, solver).where("k between 20 and 30").collect()
                for r in out:
                    xi, w = direct(y, cost, r.k)
                    hh = np.zeros(4) if h is None else h
                    v = np.linalg.solve(H.T @ w @ H, H.T @ (xi - w @ hh))
                    np.testing.assert_allclose(r.v, v, atol=1e-8)
                    np.testing.assert_allclose(r.x, H @ v + hh, atol=1e-8)
    with pytest.raises(ValueError):
        e.fit(df, "z")
    assert set(Estimator(cost).fit(df, ("x", "v", "y_hat")).columns) == {"series_id", "k", "y", "x", "v", "y_hat"}


def test_convolve_is_filter_then_dot(spark):
    y = np.sin(np.arange(200) / 9)
    e = Estimator(costs.CostSegment(models.AlssmPoly(2), S(-10, 10, "bw", 200)))
    ref = [1, -0.5, 0.25]
    got = [r.c for r in e.convolve(signal(spark, y), ref).orderBy("k").collect()]
    xi = np.stack([r.xi for r in e.filter(signal(spark, y)).orderBy("k").collect()])
    np.testing.assert_allclose(got, xi @ ref, atol=1e-9)
    two = signal(spark, y).withColumn("ch", F.lit(0)).union(signal(spark, 2 * y).withColumn("ch", F.lit(1)))
    e2 = Estimator(e.cost, keys=("series_id", "ch"))
    summed = [r.c for r in e2.convolve(two, ref, over=("ch",)).orderBy("k").collect()]
    np.testing.assert_allclose(summed, 3 * xi @ ref, atol=1e-8)


def grid(spark, y):
    names = [f"k{d}" for d in range(y.ndim)]
    rows = [("s", *map(int, at), float(v)) for at, v in np.ndenumerate(y) for at in [at]]
    return spark.createDataFrame(rows, "series_id string, " + ", ".join(f"{n} long" for n in names) + ", y double"), names


def nd_cost(degrees):
    one = lambda d: costs.CompositeCost([models.AlssmPoly(d)], [S(-4, -1, "fw", 5), S(0, 4, "bw", 5)], np.ones((1, 2)))
    return costs.NDCompositeCost([one(d) for d in degrees])


def test_golden_nd(spark):
    rng = np.random.default_rng(42)
    two, three = rng.standard_normal((15, 15)), rng.standard_normal((10, 10, 10))
    for y, degrees, golden in ((two, (1, 2), {(0, 0): 9.992930587808743, (7, 7): 23.937775766491953}), (three, (1, 2, 3), {(0, 0, 0): 43.26491371078278, (5, 5, 5): 179.54505841688405})):
        df, axes = grid(spark, y)
        results = []
        for order in (None, list(range(y.ndim))[::-1]):
            e = NDEstimator(nd_cost(degrees), axes, dim_order=order)
            got = {tuple(r[a] for a in axes): r.J for r in e.eval_errors(e.minimize_x(e.filter(df))).collect()}
            for at, j in golden.items():
                np.testing.assert_allclose(got[at], j, rtol=1e-9)
            results.append([got[k] for k in sorted(got)])
            if y.ndim == 3:
                break
        np.testing.assert_allclose(results[0], results[-1], rtol=1e-8)


def test_nd_recovers_separable_polynomials(spark):
    k = np.arange(20)
    y = np.outer(2 + 3 * (k / 10), 1 - k / 10 + 0.5 * (k / 10) ** 2)
    df, axes = grid(spark, y)
    one = lambda d: costs.CostSegment(models.AlssmPoly(d), S(-6, 6, "bw", 10))
    e = NDEstimator(costs.NDCompositeCost([one(1), one(2)]), axes)
    got = e.eval_output(e.minimize_x(e.filter(df))).where("k0 between 6 and 13 and k1 between 6 and 13").collect()
    np.testing.assert_allclose([r.y_hat for r in got], [r.y for r in got], atol=1e-8)


def test_gram_methods():
    for m, s in (
        (models.AlssmPoly(2), S(-5, 5, "bw", 10)),
        (models.AlssmPolyJordan(3), S(0, np.inf, "bw", 10)),
        (models.AlssmPoly(1), S(-np.inf, -1, "fw", 7)),
        (models.AlssmPolyLegendre(3, -6, 6), S(-6, 6, "bw", 50)),
        (models.AlssmSin(0.3, 0.99), S(0, 40, "bw", 30)),
    ):
        want = gram.limited_sum(m.A, m.C, s.gamma, max(s.a, -600), min(s.b, 600), s.delta)
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            for method in ("auto", "closed_form"):
                np.testing.assert_allclose(gram.gram(m, s, method), want, rtol=1e-6, atol=1e-6 * np.abs(want).max())


def test_meixner_is_orthogonal():
    for s in (S(0, np.inf, "bw", 20), S(3, np.inf, "bw", 20), S(-np.inf, -1, "fw", 20)):
        m = models.AlssmPolyMeixner(4, s)
        w = gram.gram(m, s)
        lo, hi = (int(s.a), 900) if s.b == np.inf else (-900, int(s.b))
        np.testing.assert_allclose(w, gram.limited_sum(m.A, m.C, s.gamma, lo, hi, 0), rtol=1e-6, atol=1e-3)
        np.testing.assert_allclose(w, np.diag(np.diag(w)), atol=1e-6 * w.max())
    assert gram.is_meixner(models.AlssmPolyMeixner(3, S(0, np.inf, "bw", 9)).A)
    assert gram.is_legendre(models.AlssmPolyLegendre(3, -5, 5).A)


def test_unipotent_models_agree():
    """The same polynomial space in four bases gives the same fitted output."""
    y = np.random.default_rng(8).standard_normal(21)
    s = S(-10, 10, "bw", 30)
    fits = []
    for m in (models.AlssmPoly(3), models.AlssmPolyJordan(3), models.AlssmPolyLegendre(3, -10, 10)):
        rows = np.stack([m.output_row(j) for j in range(-10, 11)])
        g = np.sqrt(s.gamma ** np.arange(-10.0, 11))
        fits.append(rows @ np.linalg.lstsq(rows * g[:, None], y * g, rcond=None)[0])
    np.testing.assert_allclose(fits[1], fits[0], atol=1e-8)
    np.testing.assert_allclose(fits[2], fits[0], atol=1e-8)


def test_spline_and_constraints():
    cost = costs.TSLM.create_cost((-10, 10), (20, 20))
    span = lambda h: h @ np.linalg.pinv(h)
    np.testing.assert_allclose(span(cost.spline_H(0)), span(costs.TSLM.H_Continuous), atol=1e-12)
    np.testing.assert_allclose(span(cost.spline_H(1)), span(costs.TSLM.H_Peak), atol=1e-12)
    np.testing.assert_allclose(cost.spline_H(-1), np.eye(4))
    h = costs.ConstrainMatrix(cost).constrain((0, 2), 1).digest()
    np.testing.assert_allclose(span(h), span(costs.TSLM.H_Continuous), atol=1e-12)


def test_labels_and_algebra():
    m = models.AlssmSum([models.AlssmPoly(1, label="line"), models.AlssmSin(0.1, label="wave")], label="all")
    assert m.get_state_var_indices("all.wave.cos") == (2,) and m.get_state_var_indices("wave.sin") == (3,) and m.get_state_var_indices("none") == []
    p = models.AlssmProd([models.AlssmExp(0.9), models.AlssmPoly(1)])
    x = np.array([2.0, 0.5])
    np.testing.assert_allclose(p.eval_output(x, [0, 3]), [2, 0.9**3 * 3.5])
    st = models.AlssmStacked([models.AlssmExp(0.5), models.AlssmPoly(1)])
    assert st.Q == 2 and models.common_output_width([p, m]) == 0
    with pytest.raises(ValueError):
        models.AlssmSum([st, p])
    with pytest.raises(ValueError):
        S(3, 3, "bw", 5)
    w = models.transform_model(models.AlssmPoly(2), np.triu(np.ones((3, 3))))
    np.testing.assert_allclose(w.eval_output(np.triu(np.ones((3, 3))) @ np.array([1.0, 2, 3]), [4]), [1 + 8 + 48])
    assert "AlssmPoly" in m.dump_tree()


def test_windowed_sums_refuses():
    with pytest.raises(ValueError):
        windowed_sums(None, [], [], strategy="other")


def test_nd_windows_double_and_block(spark):
    """Long windows, cut into blocks, against sums over offsets."""
    from slidefit.operators import nd

    rng = np.random.default_rng(11)
    y = rng.standard_normal((70, 9))
    df = spark.createDataFrame([("s", i, j, float(y[i, j])) for i in range(70) for j in range(9)], "series_id string, k0 long, k1 long, y double")
    cost = costs.NDCompositeCost([costs.CompositeCost([models.AlssmPoly(2)], [S(-15, -1, "fw", 20), S(0, 17, "bw", 20)], np.ones((1, 2)), betas=[1, 2]), costs.CostSegment(models.AlssmPoly(1), S(-1, 2, "bw", 8))])
    e = nd.NDEstimator(cost, ("k0", "k1"), block=64)
    long = {(r.k0, r.k1): (r.xi, r.kappa) for r in e.filter(df).collect()}
    short, nd.SHORT = nd.SHORT, 1000
    try:
        want = {(r.k0, r.k1): (r.xi, r.kappa) for r in nd.NDEstimator(cost, ("k0", "k1")).filter(df).collect()}
    finally:
        nd.SHORT = short
    assert set(long) == set(want) and len(long) == 630
    for k, (xi, kappa) in long.items():
        np.testing.assert_allclose(xi, want[k][0], atol=1e-8)
        np.testing.assert_allclose(kappa, want[k][1], atol=1e-8)
