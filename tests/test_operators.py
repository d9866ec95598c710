import numpy as np
import pytest
from pyspark.sql import functions as F

from slidefit import queries
from slidefit.operators import detect, placement
from slidefit.operators.estimator import Estimator, create_rls
from slidefit.plans import check, costs, gram, models
from slidefit.plans.segments import Segment as S
from slidefit.sources import csv
from slidefit.sources import generators as gen
from slidefit.streaming.onesided import streaming_xi


def values(df, column="y"):
    return np.array([r[column] for r in df.orderBy("k").collect()])


def test_generators_by_formula(spark):
    k = np.arange(200)
    np.testing.assert_allclose(values(gen.gen_sine(spark, 200, [50], [2.0])), 2 * np.sin(np.linspace(0, 4, 200) * 2 * np.pi), atol=1e-12)
    np.testing.assert_allclose(values(gen.gen_exp(spark, 200, 0.9, 3)), 0.9 ** (k - 3.0))
    np.testing.assert_allclose(values(gen.gen_rect(spark, 200, 10, duty_cycle=0.3)), (k % 10 < 3) * 1.0)
    np.testing.assert_allclose(values(gen.gen_saw(spark, 200, 8)), k % 8 / 8 - 0.5)
    np.testing.assert_allclose(values(gen.gen_tri(spark, 200, 8)), 1 - np.abs(k % 8 - 4) / 4 - 0.5)
    np.testing.assert_allclose(values(gen.gen_pulse(spark, 200, [0, 5, 5, 199])), np.isin(k, [0, 5, 199]) * 1.0)
    np.testing.assert_allclose(values(gen.gen_steps(spark, 200, [5, 5, 50], [9, 1, 2])), (k >= 5) * 1.0 + (k >= 50) * 2.0)
    np.testing.assert_allclose(values(gen.gen_slopes(spark, 200, [10, 60, 90], [1, 2, -1])), np.interp(k, [10, 60, 90], [1, 3, 2]))
    base, template = np.sin(k / 7.0), np.array([1.0, 2, 0.5, -1])
    df = spark.createDataFrame([(int(i), float(v)) for i, v in zip(k, base, strict=True)], "k long, y double")
    np.testing.assert_allclose(values(gen.gen_conv(df, template)), np.convolve(base, template, "same"), atol=1e-12)
    with pytest.raises(ValueError):
        gen.gen_pulse(spark, 10, [10])
    assert gen.k_period_to_omega(4) == pytest.approx(np.pi / 2)


def test_random_generators(spark):
    w = values(gen.gen_rand_walk(spark, 500, 1, blocks=7))
    assert np.abs(np.diff(w)).max() <= 1 and w.std() > 0
    assert 0.8 < values(gen.gen_wgn(spark, 4000, 1.0, 3)).std() < 1.2
    p = gen.gen_rand_pulse(spark, 300, 4, 5, 2, channels=2)
    assert p.where("ch = 0").agg(F.sum("y")).first()[0] == pytest.approx(20, abs=4) and p.count() == 600


def test_csv(spark, tmp_path):
    path = str(tmp_path / "signal.csv")
    data = np.arange(40.0).reshape(20, 2)
    with open(path, "w") as f:
        f.write("\n".join(",".join(map(str, r)) for r in data) + "\nx, 7\n\n")
    got = csv.load_csv_mc(spark, path).orderBy("k").collect()
    assert [r.k for r in got] == list(range(21)) and np.isnan(got[20].y0) and got[20].y1 == 7
    np.testing.assert_allclose([(r.y0, r.y1) for r in got[:20]], data)
    np.testing.assert_allclose(values(csv.load_csv(spark, path, K=10, k_start=3, channel=1, ds_rate=3)), data[3:13:3, 1])
    np.testing.assert_allclose(values(csv.load_data(spark, path, K=10, kstart=3)), data[3:10, 0])
    np.testing.assert_allclose(values(csv.load_lib_csv(spark, str(tmp_path), "signal.csv", K=2)), data[:2, 0])
    assert csv.load_lib_csv_mc(spark, str(tmp_path), "signal.csv", channels=[1]).columns == ["k", "y0"]


def peaks_by_loop(v, height, distance):
    at, i = [], 1
    while i < len(v) - 1:
        j = i
        while j < len(v) - 1 and v[j + 1] == v[i]:
            j += 1
        if v[i - 1] < v[i] and j < len(v) - 1 and v[j + 1] < v[i]:
            at.append((i + j) // 2)
        i = j + 1
    at = [i for i in at if v[i] >= height]
    keep = dict.fromkeys(at, True)
    for i in sorted(at, key=lambda i: (v[i], i), reverse=True):
        if keep[i]:
            for j in at:
                if j != i and abs(j - i) < distance:
                    keep[j] = False
    return [i for i in at if keep[i]]


def test_peaks(spark):
    rng = np.random.default_rng(1)
    for n in (40, 200):
        v = rng.integers(0, 9, n).astype(float)
        df = spark.createDataFrame([("s", i, float(x)) for i, x in enumerate(v)], "series_id string, k long, lcr double")
        got = [r.k for r in detect.find_peaks(df, "lcr", 3, 5).orderBy("k").collect()]
        assert got == peaks_by_loop(v, 3, 5)
    assert detect.find_peaks(df.limit(0), "lcr", 1, 2).count() == 0


def test_detection_helpers(spark):
    rows = [("s", k, v) for k, v in enumerate([1.0, float("nan"), 3.0, 3.0, None])]
    df = spark.createDataFrame(rows, "series_id string, k long, lcr double")
    assert detect.argmax(df, "lcr").first().k == 2
    m, s = models.AlssmPoly(1), S(0, 15, "bw", 20)
    w = gram.limited_sum(m.A, m.C, s.gamma, 0, 31, 0)
    np.testing.assert_allclose(detect.double_gram(gram.gram(m, s), m.A, s.gamma, 16), w)
    p = np.linalg.inv(detect.whitening(w))
    np.testing.assert_allclose(p.T @ w @ p, np.eye(2), atol=1e-9)
    np.testing.assert_allclose(m.C @ detect.fractional_power(m.A, 0.5), [1, 0.5])
    sin = models.AlssmSin(0.4, 0.9)
    np.testing.assert_allclose(np.linalg.matrix_power(detect.fractional_power(sin.A, 0.25), 4), sin.A, atol=1e-12)
    one = spark.createDataFrame([([1.0, 2.0, 3.0],)], "x array<double>").select(detect.zeroed(F.col("x"), 3, [1]).alias("x")).first().x
    assert one == [1.0, 0.0, 3.0]


def test_matched_filter(spark):
    rng = np.random.default_rng(2)
    y = rng.standard_normal((3, 50))
    df = spark.createDataFrame([("s", c, k, float(y[c, k])) for c in range(3) for k in range(50)], "series_id string, ch int, k long, y double")
    cov = detect.channel_covariance(df, "ch", keys=("series_id",))
    np.testing.assert_allclose(cov, np.cov(y), atol=1e-12)
    e = Estimator(costs.CostSegment(models.AlssmPoly(1), S(-3, 3, "bw", 9)), keys=("series_id", "ch"))
    t = rng.standard_normal((3, 2))
    got = [r.c for r in detect.matched_filter(e, df, t, cov, "ch").orderBy("k").collect()]
    xi = {(r.ch, r.k): np.array(r.xi) for r in e.filter(df).collect()}
    w = np.linalg.inv(np.cov(y)) @ t
    np.testing.assert_allclose(got, [sum(xi[c, k] @ w[c] for c in range(3)) for k in range(50)], atol=1e-8)


def test_matched_filter_query_takes_all_channels(spark, tmp_path):
    y = np.random.default_rng(6).standard_normal((150, 64))
    spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(y)], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.k: r.c for r in queries.matched_filter(spark, str(tmp_path)).collect()}
    white = y @ (np.linalg.inv(np.cov(y.T)) @ np.ones(64))
    want = [sum(queries.EMB.segments[0].weight(j) * (1 + j) * white[k + j] for j in range(-4, 5)) for k in range(4, 146)]
    np.testing.assert_allclose([got[k] for k in range(4, 146)], want, atol=1e-3)
    assert len(got) == 150


def test_windows_are_placed(spark):
    cost = costs.CompositeCost([models.AlssmPoly(1)], [S(-3, -1, "fw", 5), S(0, 2, "bw", 5)], np.ones((1, 2)))
    anchors = spark.createDataFrame([("s", 1), ("s", 3), ("s", 9)], "series_id string, k long")
    got = [r.value for r in placement.window_place(cost, anchors, 10).orderBy("k").collect()]
    want = np.zeros(10)
    for a in (1, 3, 9):
        for s in cost.segments:
            for j, w in zip(*s.window(), strict=True):
                if 0 <= a + j < 10:
                    want[a + j] = max(want[a + j], w)
    np.testing.assert_allclose(got, want)
    apart = placement.window_place(cost, anchors, 10, merged_ks=False, merged_seg=False)
    assert set(apart.columns) == {"series_id", "k", "anchor_k", "segment", "value"}
    nd = costs.NDCompositeCost([cost, cost])
    rows = {(r.segment, r.j0, r.j1): r.weight for r in placement.window_eval(spark, nd).collect()}
    assert rows["0x1", -2, 1] == pytest.approx(cost.segments[0].weight(-2) * cost.segments[1].weight(1)) and len(rows) == 36


def test_placement_covers_whole_series(spark, tmp_path):
    """Series longer than 1000 samples, and of different lengths: every peak and every sample counts."""
    rng = np.random.default_rng(7)
    own = {"a": rng.standard_normal(1300), "b": rng.standard_normal(700)}
    rows = [(s, k, k, float(100 * v)) for s, y in own.items() for k, v in enumerate(y)]
    spark.createDataFrame(rows, "event_type string, ts long, event_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    windows = {(r.series_id, r.k): r.value for r in queries.window_place(spark, str(tmp_path)).collect()}
    lines = {(r.series_id, r.k): r.value for r in queries.trajectory_place(spark, str(tmp_path)).collect()}
    e = Estimator(queries.SMALL)
    states = {(r.series_id, r.k): r.x for r in e.minimize_x(e.filter(queries.events(spark, str(tmp_path)))).collect()}
    weight = {j: s.weight(j) for s in queries.SMALL.segments for j in range(int(s.a), int(s.b) + 1)}
    assert set(windows) == set(lines) == {(s, k) for s, y in own.items() for k in range(len(y))}
    for s, y in own.items():
        n = len(y)
        peak = [0 < k < n - 1 and y[k - 1] < y[k] > y[k + 1] for k in range(n)]
        for k in range(n):
            near = range(max(0, k - 5), min(n, k + 6))
            assert windows[s, k] == pytest.approx(max((weight[k - a] for a in near if peak[a]), default=0), abs=2e-6)
            assert lines[s, k] == pytest.approx(max(states[s, a][0] + (k - a) * states[s, a][1] for a in near), abs=2e-5)


def test_trajectories(spark):
    cost = costs.CompositeCost([models.AlssmPoly(1), models.AlssmPoly(1)], [S(-3, -1, "fw", 10), S(0, 3, "bw", 10)], np.eye(2))
    states = spark.createDataFrame([("s", 2, [1.0, 0.5, 2.0, -1.0]), ("s", 5, [0.0, 1.0, 0.0, 1.0])], "series_id string, k long, x array<double>")
    got = {(r.k, r.segment, r.j): r.value for r in placement.trajectory_eval(cost, states).collect()}
    assert got[2, "0", -2] == 0.0 and got[2, "1", 3] == -1.0 and len(got) == 14
    placed = placement.trajectory_place(cost, states, states, 8)
    v = [r.value for r in placed.orderBy("k").collect()]
    np.testing.assert_allclose(v[:5], [0.0, 0.5, 2.0, 1.0, 0.0])  # at 2 to 4 the larger of both windows
    assert len(v) == 8 and not np.isnan(v[7])
    none = placement.trajectory_place(cost, states, states.limit(0), 8)
    assert none.count() == 0


def test_streaming_equals_batch(spark, tmp_path):
    y = np.random.default_rng(3).standard_normal(40)
    df = spark.createDataFrame([("s", k, float(v)) for k, v in enumerate(y)], "series_id string, k long, y double")
    for i in range(2):
        df.where(F.col("k").between(20 * i, 20 * i + 19)).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    m, s = models.AlssmPoly(1), S(-6, -1, "fw", 10)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = streaming_xi(stream, m, s).writeStream.format("memory").queryName("fits").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.k: r.xi for r in spark.table("fits").collect()}
    want = {r.k: r.xi for r in Estimator(costs.CostSegment(m, s)).filter(df).collect()}
    for k, xi in got.items():
        np.testing.assert_allclose(xi, want[k], atol=1e-9)
    assert len(got) == 40


def test_small_things():
    assert check.is_1dim([1]) and check.is_2dim([[1]]) and check.is_square(np.eye(2)) and check.is_array_like((1,)) and check.is_string("x")
    assert "(2, 2)" in check.info_str_found_shape(np.eye(2)) and "str" in check.info_str_found_type("")
    with pytest.warns(DeprecationWarning):
        assert check.deprecated(len)([1]) == 1
    with pytest.warns(DeprecationWarning):
        assert check.DeprecationHelper(list)((1,)) == [1]
    assert not create_rls(costs.TSLM.create_cost((-3, 3), (5, 5))).steady
    assert S(-5, -1, "forward", 10).gamma == pytest.approx(10 / 9) and "direction=fw" in str(S(-5, -1, "fw", 10))
    with pytest.raises(ValueError):
        S(0, np.inf, "fw", 10)
    np.testing.assert_allclose(gram.kron_q([1.0, 2.0], 2), [1, 2, 2, 4])


def test_gram_of_bare_matrices():
    leg, mei = models.AlssmPolyLegendre(3, -6, 6), models.AlssmPolyMeixner(3, S(2, np.inf, "bw", 15))
    s = S(-6, 6, "bw", 30)
    want = gram.limited_sum(leg.A, leg.C, s.gamma, -6, 6, 0)
    np.testing.assert_allclose(gram.covariance_matrix_schur(leg.A, leg.C, s.gamma, -6, 6, 0), want, rtol=1e-8, atol=1e-8)
    np.testing.assert_allclose(gram.covariance_matrix_legendre(leg.A, leg.C, s.gamma, -6, 6, 0), want, rtol=1e-8, atol=1e-8)
    w = gram.covariance_matrix_closed_form(mei.A, mei.C, mei.gamma, 2, np.inf, 0)
    np.testing.assert_allclose(gram.covariance_matrix_schur(mei.A, mei.C, mei.gamma, 2, np.inf, 0), w, rtol=1e-6, atol=1e-6)
    np.testing.assert_allclose(gram.covariance_matrix_meixner(mei.A, mei.C, mei.gamma, 2, 30, 0), gram.covariance_matrix_limited_sum(mei.A, mei.C, mei.gamma, 2, 30, 0))


def test_profiling(capsys):
    from slidefit.plans import profiling

    f = profiling.profile(lambda n: sum(range(n)))
    profiling.clear()
    f(10)
    assert not profiling.get_records()
    profiling.enable()
    f(200_000)
    profiling.disable()
    assert len(profiling.get_records()) == 1 and profiling.get_reliable_records(0.0) and "CPU" in profiling.report()
    profiling.clear()


def test_localized_polynomials(spark):
    from slidefit.functions.poly import Poly
    from slidefit.operators import localized

    p, q = Poly([1.0, 2, -1, 0.5], [0, 1, 2, 3]), Poly([0.5, 1], [0, 1])
    x = np.linspace(-1, 2, 20001)
    assert localized.distance(p, q, -1, 2) == pytest.approx(np.trapezoid((p.eval(x) - q.eval(x)) ** 2, x), rel=1e-6)
    r = localized.reduce_degree(p, 1, -1, 2)
    assert localized.distance(p, r, -1, 2) <= min(localized.distance(p, Poly(r.coef + d, r.expo), -1, 2) for d in ([0.01, 0], [0, 0.01], [-0.01, 0], [0, -0.01]))
    t = Poly([1.0, 0, 0.3], [0, 1, 2])
    moved = [3.0 * v for v in (1 + 0.3 * 4, 2 * 0.3 * 4, 0.3 * 4)]  # 3 t(2 (x + 1))
    df = spark.createDataFrame([(moved,)], "x array<double>")
    m = localized.best_match(df, "x", 3, t, (-2, 2), [-1.0, 0.0, 1.0], [1.0, 2.0]).first().match
    assert (m.shift, m.stretch) == (1.0, 2.0) and m.amplitude == pytest.approx(3) and abs(m.cost) < 1e-9


def test_silent_stretches_have_defined_ratios(spark):
    """Zero, constant and null stretches: no preference where both costs vanish, never an error."""
    y = [0.0] * 60 + [1.0] * 60 + [None] * 60 + [float(v) for v in np.random.default_rng(1).standard_normal(60)]
    df = spark.createDataFrame([("s", k, v) for k, v in enumerate(y)], "series_id string, k long, y double")
    e = Estimator(queries.EDGE)
    f = {r.k: r for r in detect.hypotheses(e, e.filter(df), costs.TSLM.H_Continuous, costs.TSLM.H_Straight).collect()}
    assert f[30].lcr == 0 and f[150].lcr == 0 and all(r.lcr is not None and not np.isnan(r.lcr) for r in f.values())
    m = {r.k: r.match for r in detect.shape_match(e, e.filter(df), [1.0, 0.0, 1.0, 0.0]).collect()}
    assert m[30] == 1 and m[150] == 1 and not any(np.isnan(v) for v in m.values())
    rows = spark.createDataFrame([(0.0, 0.0), (0.0, 2.0), (2.0, 0.0), (-1e-18, 0.0), (None, 1.0)], "j0 double, j1 double")
    got = [r[0] for r in rows.select(detect.lcr(F.col("j0"), F.col("j1"))).collect()]
    assert got == [0.0, float("-inf"), float("inf"), 0.0, None]
    assert [r[0] for r in rows.select(detect.lcr10(F.col("j0"), F.col("j1"))).collect()] == got


def test_csv_folders_in_file_order(spark, tmp_path):
    """Small files first by name are first by number, whatever their size; short rows have NaN."""
    (tmp_path / "a.csv").write_text("1,5\n2\n")
    (tmp_path / "b.csv").write_text("\n".join(f"{i},{i}" for i in range(10, 2000)))
    got = csv.load_csv_mc(spark, str(tmp_path)).orderBy("k").collect()
    assert [r.y0 for r in got[:4]] == [1, 2, 10, 11] and np.isnan(got[1].y1) and len(got) == 1992


def test_numbering_by_time(spark):
    from slidefit.sources.order import numbered

    rows = [("a", 3600 * (i % 7) + i, i) for i in range(50)] + [("b", None, 3), ("b", 5, 1), ("b", 5, 0)]
    df = spark.createDataFrame(rows, "series_id string, t long, i long").withColumn("t", F.col("t").cast("timestamp"))
    got = [(r.series_id, r.i) for r in numbered(df, ["series_id"], "t", "i").orderBy("series_id", "k").collect()]
    assert got == [("a", i) for _, _, i in sorted(rows[:50], key=lambda r: (r[1], r[2]))] + [("b", 3), ("b", 0), ("b", 1)]


def test_centred_windows_double(spark):
    y = np.random.default_rng(2).standard_normal(80)
    y[:20] = y[-20:] = 0
    df = spark.createDataFrame([("s", k, float(v)) for k, v in enumerate(y)], "series_id string, k long, y double")
    m = models.AlssmPoly(2)
    f = Estimator(costs.CostSegment(m, S(-4, 3, "bw", 30)), calc=("xi",)).filter(df)
    got = {r.k: r.xi for r in detect.double_centred_window(f, m.A, S(-4, 3, "bw", 30).gamma, 8, block=40).collect()}
    want = {r.k: r.xi for r in Estimator(costs.CostSegment(m, S(-8, 7, "bw", 30)), calc=("xi",)).filter(df).collect()}
    for k in range(10, 70):
        np.testing.assert_allclose(got[k], want[k], atol=1e-9)


def test_known_shape_is_found(spark):
    j = np.arange(-4, 5)
    y = np.zeros(120)
    y[56:65] = 1 - 0.05 * j**2
    df = spark.createDataFrame([("s", k, float(v) + 0.01 * k) for k, v in enumerate(y)], "series_id string, k long, y double")
    cost = costs.CompositeCost([models.AlssmPoly(2), models.AlssmPoly(1)], [S(-10, -5, "fw", 50), S(-4, 4, "fw", 50), S(5, 10, "bw", 50)], [[0, 1, 0], [1, 1, 1]])
    e = Estimator(cost)
    best = detect.argmax(detect.known_shape(e, e.filter(df), [1.0, 0.0, -0.05]), "lcr").first()
    assert best.k == 60
