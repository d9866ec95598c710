"""Further queries over the test tables: sources, models, costs, constrained and structured fits, N-D, streams and the matrices
of the polynomial calculus, each with SQL from the definitions."""

from __future__ import annotations

import warnings
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import oracles as sq
from .functions import poly as pl
from .operators import detect, localized, placement
from .operators.estimator import Estimator, create_rls
from .operators.nd import NDEstimator
from .plans import check, costs, gram, models, profiling
from .plans.segments import Segment
from .queries import EDGE_SQL, EMB_SQL, EVENTS, FIT2, FIT2_SQL, LINES, MP, P, Q, SHAPE, SMALL, SMALL_SQL, _fit, channels, events, nd_sql, query, r_sql, rounded, table
from .sources import csv
from .sources import generators as gen
from .sources.scratch import scratch_path
from .streaming.onesided import streaming_xi


def _columns(df: DataFrame, digits: int, **made) -> DataFrame:
    return df.select("series_id", "k", *[(F.round(c, digits) + F.lit(0.0)).alias(n) for n, c in made.items()])


# sources

CSV_SQL = """WITH s AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS k, c_acctbal::DOUBLE AS y0, c_nationkey::DOUBLE AS y1 FROM customer)
SELECT 'all channels' AS reader, k, y0, y1 FROM s
UNION ALL SELECT 'one channel', (k - 10) // 3, y1, NULL FROM s WHERE k BETWEEN 10 AND 59 AND (k - 10) % 3 = 0
UNION ALL SELECT 'library, channels', k - 5, y1, y0 FROM s WHERE k BETWEEN 5 AND 104
UNION ALL SELECT 'library', k, y0, NULL FROM s
UNION ALL SELECT 'older, channels', k - 20, y0, y1 FROM s WHERE k BETWEEN 20 AND 99
UNION ALL SELECT 'older', k, y1, NULL FROM s"""


@query(CSV_SQL)
def csv_signals(spark, sf):
    """Balances and nations of the customers, written as text in several files and read by every loader."""
    path = scratch_path(spark, "signal")
    own = table(spark, sf, "customer").repartitionByRange(4, "c_custkey").sortWithinPartitions("c_custkey")
    own.select(F.concat_ws(",", F.col("c_acctbal").cast("double").cast("string"), F.col("c_nationkey").cast("string"))).write.text(path)
    base, name = path.rsplit("/", 1)
    read = {
        "all channels": csv.load_csv_mc(spark, path),
        "one channel": csv.load_csv(spark, path, K=50, k_start=10, channel=1, ds_rate=3).withColumnRenamed("y", "y0"),
        "library, channels": csv.load_lib_csv_mc(spark, base, name, K=100, k_start=5, channels=[1, 0]),
        "library": csv.load_lib_csv(spark, base, name).withColumnRenamed("y", "y0"),
        "older, channels": csv.load_data_mc(spark, path, K=100, kstart=20),
        "older": csv.load_data(spark, path, chIdx=1).withColumnRenamed("y", "y0"),
    }
    rows = [(df if "y1" in df.columns else df.withColumn("y1", F.lit(None).cast("double"))).select(F.lit(n).alias("reader"), "k", "y0", "y1") for n, df in read.items()]
    return reduce(DataFrame.unionByName, rows)


# models and costs on the driver

MODEL_SQL = """WITH t AS (SELECT unnest(range(-3, 4)) AS j)
SELECT name, j, round(v, 9) + 0.0 AS value FROM (
SELECT 'matrices' AS name, j, 1 + 2.0 * j AS v FROM t
UNION ALL SELECT 'polynomial', j, 1 + 2.0 * j - j * j FROM t
UNION ALL SELECT 'Newton basis', j, 1 + 2.0 * j - j * (j - 1) / 2.0 FROM t
UNION ALL SELECT 'Legendre basis', j, 1 + 2.0 * j / 8 - (3 * pow(j / 8.0, 2) - 1) / 2 FROM t
UNION ALL SELECT 'Meixner basis', j, 1 + 2 * (1 - j / 19.0) - (1 - 2 * j / 19.0 + j * (j - 1) / 2.0 / 361) FROM t
UNION ALL SELECT 'wave', j, pow(0.99, j) * (cos(0.5 * j) - 2 * sin(0.5 * j)) FROM t
UNION ALL SELECT 'decay', j, 2 * pow(0.9, j) FROM t
UNION ALL SELECT 'sum', j, 1 + 2.0 * j + 3 * pow(0.9, j) FROM t
UNION ALL SELECT 'product', j, pow(0.9, j) * (1 + 2.0 * j) FROM t
UNION ALL SELECT 'stack, first', j, 1 + 2.0 * j FROM t
UNION ALL SELECT 'stack, second', j, 3 * pow(0.9, j) FROM t
UNION ALL SELECT 'univariate', j, 1 + 3.0 * j + 5 * j * j FROM t
UNION ALL SELECT 'bivariate', j, (1 + 2.0 * j) * (3 - (j + 1) + 0.5 * (j + 1) * (j + 1)) FROM t)
UNION ALL VALUES ('omega', 0, round(2 * pi() / 40, 9)), ('index of trend.x1', 0, 1e0), ('index of decay.x0', 0, 2e0), ('labels', 0, 6e0), ('own label', 0, 1e0), ('lines of the tree', 0, 3e0), ('outputs of a stack', 0, 2e0),
('cost output', 0, 4e0), ('composite output', 0, 4.5e0), ('N-D output', 0, 8e0), ('index in a composite', 0, 2e0), ('common outputs', 0, 0e0)"""


@query(MODEL_SQL)
def model_outputs(spark, sf):
    """Outputs of every model over offsets, and what models and costs say of their states."""
    js, line, decay = np.arange(-3, 4), models.AlssmPoly(1, label="trend"), models.AlssmExp(0.9, label="decay")
    both, stack = models.AlssmSum([line, decay], label="both"), models.AlssmStacked([line, decay])
    own = {
        "matrices": (models.Alssm([[1, 1], [0, 1]], [1, 0]), [1, 2]),
        "polynomial": (models.AlssmPoly(2), [1, 2, -1]),
        "Newton basis": (models.AlssmPolyJordan(2), [1, 2, -1]),
        "Legendre basis": (models.AlssmPolyLegendre(2, -8, 8), [1, 2, -1]),
        "Meixner basis": (models.AlssmPolyMeixner(2, Segment(0, np.inf, "bw", 20)), [1, 2, -1]),
        "wave": (models.AlssmSin(0.5, 0.99), [1, 2]),
        "decay": (decay, [2]),
        "sum": (both, [1, 2, 3]),
        "product": (models.AlssmProd([decay, line]), [1, 2]),
    }
    rows = [(n, int(j), float(v)) for n, (m, x) in own.items() for j, v in zip(js, m.eval_output(x, js), strict=True)]
    rows += [(f"stack, {n}", int(j), float(v[i])) for j, v in zip(js, stack.eval_output([1, 2, 3], js), strict=True) for i, n in enumerate(("first", "second"))]
    rows += [(n, int(j), float(v)) for n, values in (("univariate", P.eval(js.astype(float))), ("bivariate", MP.eval((js, js + 1)))) for j, v in zip(js, values, strict=True)]
    both.set_state_var_label("ends", (0, 2))
    composite = costs.CompositeCost([line, decay], SMALL.segments, np.ones((2, 2)))
    one = costs.CostSegment(line, SMALL.segments[0])
    said = {
        "omega": gen.k_period_to_omega(40),
        "index of trend.x1": both.get_state_var_indices("trend.x1")[0],
        "index of decay.x0": both.get_state_var_indices("both.decay.x0")[0],
        "labels": len([n for n in both.get_state_var_labels() if n.startswith(("both.trend", "both.decay", "both.x"))]),
        "own label": len(both.get_state_var_indices("ends")) - 1,
        "lines of the tree": len(both.dump_tree().splitlines()),
        "outputs of a stack": stack.get_alssm_output_dimension(),
        "cost output": one.eval_alssm_output([4.0, 2.0]),
        "composite output": composite.eval_alssm_output([4.0, 2.0, 1.0], [1, 0.5]),
        "N-D output": costs.NDCompositeCost([one, one]).eval_alssm_output([8.0, 1.0, 1.0, 1.0]),
        "index in a composite": composite.get_state_var_indices("decay.x0")[0],
        "common outputs": models.common_output_width([line, decay]),
    }
    rows += [(n, 0, float(v)) for n, v in said.items()]
    return rounded(spark.createDataFrame(rows, "name string, j long, value double"), 9, "value")


GRAM_SQL = """WITH t AS (SELECT unnest(range(-6, 7)) AS t), u AS (SELECT unnest(range(0, 2000)) AS t), i AS (SELECT unnest(range(3))::INTEGER AS i), j AS (SELECT unnest(range(3))::INTEGER AS j),
l AS (SELECT t, pow(29e0 / 30e0, t) AS g, [1, t / 6e0, (3 * pow(t / 6e0, 2) - 1) / 2] AS p, [1, t, t * t]::DOUBLE[] AS m FROM t),
x AS (SELECT t, pow(14e0 / 15e0, t) AS g, [1, 1 - t / 14e0, 1 - t / 7e0 + t * (t - 1) / 392e0] AS p FROM u)
SELECT form, i, j, round(w, 5) + 0.0 AS w FROM (
SELECT unnest(['sum', 'fixed point', 'bare matrices']) AS form, i, j, sum(g * m[i + 1] * m[j + 1]) AS w FROM l, i, j GROUP BY i, j
UNION ALL SELECT unnest(['Legendre', 'Legendre found']), i, j, sum(g * p[i + 1] * p[j + 1]) FROM l, i, j GROUP BY i, j
UNION ALL SELECT unnest(['Meixner', 'Meixner found']), i, j, sum(g * p[i + 1] * p[j + 1]) FROM x, i, j GROUP BY i, j
UNION ALL SELECT 'Kronecker powers', i, j, [1, 2, 3][i + 1] * [1, 2, 3][j + 1] FROM i, j)"""


@query(GRAM_SQL)
def gram_forms(spark, sf):
    """Gram matrices by every form, over bare matrices."""
    s, far = Segment(-6, 6, "bw", 30), Segment(0, np.inf, "bw", 15)
    m, leg, mei = models.AlssmPoly(2), models.AlssmPolyLegendre(2, -6, 6), models.AlssmPolyMeixner(2, far)
    over = lambda f, x, s, **more: f(x.A, x.C, s.gamma, s.a, s.b, s.delta, **more)
    assert gram.is_legendre(leg.A) and gram.is_meixner(mei.A) and not gram.is_meixner(leg.A)
    made = {
        "sum": over(gram.covariance_matrix_limited_sum, m, s),
        "fixed point": over(gram.covariance_matrix_closed_form, m, s),
        "bare matrices": over(gram.covariance_matrix_schur, m, s),
        "Legendre": over(gram.covariance_matrix_legendre, leg, s),
        "Legendre found": over(gram.covariance_matrix_schur, leg, s),
        "Meixner": over(gram.covariance_matrix_meixner, mei, far),
        "Meixner found": over(gram.covariance_matrix_schur, mei, far),
        "Kronecker powers": gram.kron_q([1.0, 2.0, 3.0], 2).reshape(3, 3),
    }
    return rounded(spark.createDataFrame([(n, i, j, float(w[i, j])) for n, w in made.items() for i in range(3) for j in range(3)], "form string, i int, j int, w double"), 5, "w")


@query("VALUES ('one dimension', true), ('two dimensions', true), ('square', true), ('not square', false), ('array', true), ('text', true), ('shape in words', true), ('type in words', true), ('warned function', true), ('warned class', true), ('records', true), ('reliable records', true), ('report', true), ('records off', true), ('singular Gram matrix', true)".replace("VALUES", "SELECT * FROM (VALUES", 1) + ") t(name, result)")
def argument_checks(spark, sf):
    """Checks of arguments, warnings and the profiler."""
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        old, renamed = check.deprecated(len)([1]), check.DeprecationHelper(list)((1,))
        gram.warn_if_singular(np.diag([1.0, 1e-20]))
    kinds = [w.category for w in seen]
    profiling.clear()
    profiling.enable()
    f = profiling.profile(lambda n: sum(range(n)))
    f(10)
    profiling.disable()
    f(10)
    said = {
        "one dimension": check.is_1dim([1]),
        "two dimensions": check.is_2dim([[1]]),
        "square": check.is_square(np.eye(2)),
        "not square": check.is_square(np.ones((2, 3))),
        "array": check.is_array_like((1,)),
        "text": check.is_string("x"),
        "shape in words": "(2, 2)" in check.info_str_found_shape(np.eye(2)),
        "type in words": "str" in check.info_str_found_type(""),
        "warned function": old == 1 and kinds[0] is DeprecationWarning,
        "warned class": renamed == [1] and kinds[1] is DeprecationWarning,
        "records": len(profiling.get_records()) == 1,
        "reliable records": len(profiling.get_reliable_records(0.0)) == 1,
        "report": "CPU" in profiling.report(),
        "records off": len(profiling.get_records()) == 1,
        "singular Gram matrix": kinds[2] is gram.WConditionNumberWarning,
    }
    profiling.clear()
    return spark.createDataFrame([(n, bool(v)) for n, v in said.items()], "name string, result boolean")


# fits

TIED, OFFSET = ((1, 0), (0, 1), (0, 0.5)), (0.1, 0.0, -0.2)


@query(f"WITH {sq.sums(FIT2_SQL, EVENTS)}, {sq.solved(3, TIED, OFFSET, v='v')} SELECT series_id, k, {r_sql('x0', 5, 'y_hat')}, {', '.join(r_sql(c, 5, c) for c in ('x0', 'x1', 'x2', 'v0', 'v1'))} FROM s")
def fit_outputs(spark, sf):
    """fit as users call it: parameters, states and values on x = H v + h."""
    f = create_rls(FIT2, steady_state=True).fit(events(spark, sf), output=("y_hat", "x", "v"), H=np.array(TIED), h=np.array(OFFSET))
    return _columns(f, 5, y_hat=F.col("y_hat"), **{f"x{i}": F.col("x")[i] for i in range(3)}, **{f"v{i}": F.col("v")[i] for i in range(2)})


@query(sq.fit([sq.Part(0, 899, sq.backward(20), sq.MONOMIALS[:3])], EVENTS, 4))
def meixner_fit(spark, sf):
    """A parabola over a backward window to infinity, in the Meixner basis; SQL fits it in monomials, cut where weights are 1e-20."""
    s = Segment(0, np.inf, "bw", 20)
    return _fit(costs.CostSegment(models.AlssmPolyMeixner(2, s), s), events(spark, sf), 4)


@query(sq.fit([sq.Part(-899, 0, sq.forward(20), LINES)], EVENTS, 4))
def meixner_forward_fit(spark, sf):
    """A line over a forward window from minus infinity, in the Meixner basis."""
    s = Segment(-np.inf, 0, "fw", 20)
    return _fit(costs.CostSegment(models.AlssmPolyMeixner(1, s), s), events(spark, sf), 4)


PAIR = "SELECT d::VARCHAR AS series_id, vec_id AS k, embedding[d + 1]::DOUBLE AS y FROM embeddings, (SELECT unnest(range(2)) AS d)"


@query(f"WITH {sq.sums([sq.Part(-4, 4, sq.backward(10), LINES)], PAIR)}, {sq.solved(2)} SELECT 'e' AS series_id, k, round(max(x0) FILTER (series_id = '0'), 5) + 0.0 AS y_hat0, round(max(x0) FILTER (series_id = '1'), 5) + 0.0 AS y_hat1, {r_sql(f'sum({sq.cost(2)})', 4, 'J')} FROM s CROSS JOIN w GROUP BY k")
def stacked_fit(spark, sf):
    """Two outputs fitted together by stacked lines."""
    y = F.array(*[F.col("embedding")[d].cast("double") for d in range(2)])
    own = table(spark, sf, "embeddings").select(F.lit("e").alias("series_id"), F.col("vec_id").alias("k"), y.alias("y"))
    e = Estimator(costs.CostSegment(models.AlssmStacked([models.AlssmPoly(1), models.AlssmPoly(1)]), Segment(-4, 4, "bw", 10)))
    f = e.eval_errors(e.eval_output(e.minimize_x(e.filter(own))))
    return rounded(f.select("series_id", "k", F.col("y_hat")[0].alias("y_hat0"), F.col("y_hat")[1].alias("y_hat1"), "J"), 5, "y_hat0", "y_hat1").withColumn("J", F.round("J", 4) + F.lit(0.0))


#: Two parabolas l and r that meet at 0 with one difference: r0 = l0 and r1 + r2 = -(l1 + l2).
SPLINE = ((1, 0, 0, 0), (0, 1, 0, 0), (0, 0, 1, 0), (1, 0, 0, 0), (0, -1, -1, -1), (0, 0, 0, 1))
SPLINE_SQL = [sq.Part(-15, -1, sq.forward(20), ("1", "j", "j * j", "0", "0", "0")), sq.Part(0, 15, sq.backward(20), ("0", "0", "0", "1", "j", "j * j"))]


@query(sq.fit(SPLINE_SQL, EVENTS, 4, SPLINE, basis=("1", "0", "0", "1", "0", "0")))
def spline_fit(spark, sf):
    """Two parabolas tied where they meet."""
    cost = costs.CompositeCost([models.AlssmPoly(2), models.AlssmPoly(2)], [Segment(-15, -1, "fw", 20), Segment(0, 15, "bw", 20)], np.eye(2))
    e = Estimator(cost)
    f = e.eval_errors(e.eval_output(e.minimize_x(e.filter(events(spark, sf)), cost.spline_H(1))))
    return _columns(f, 4, y_hat=F.col("y_hat"), J=F.col("J"))


@query(sq.fit(EDGE_SQL, EVENTS, 4, ((1, 0, 0), (0, 1, 0), (0, 0, 1), (0, 1, 0)), basis=("1", "0", "1", "0")))
def constrained_fit(spark, sf):
    """Two lines of one slope, tied by their labels."""
    cost = costs.TSLM.create_cost((-20, 19), (20, 20))
    builder = costs.ConstrainMatrix(cost).constrain_by_labels("left line model.x1", "right line model.x1")
    assert costs.ConstrainMatrix(cost).constrain((1, 3)).digest().shape == builder.digest().shape == (4, 3)
    e = Estimator(cost)
    f = e.eval_errors(e.eval_output(e.minimize_x(e.filter(events(spark, sf)), builder.digest())))
    return _columns(f, 4, y_hat=F.col("y_hat"), J=F.col("J"))


@query(sq.fit(FIT2_SQL, EVENTS, 4))
def whitened_fit(spark, sf):
    """The parabola in states in which the steady Gram matrix is the identity."""
    own = models.transform_model(models.AlssmPoly(2), detect.whitening(FIT2.get_steady_state_W()))
    cost = costs.CompositeCost([own], FIT2.segments, np.ones((1, 2)))
    assert np.allclose(cost.get_steady_state_W(), np.eye(3), atol=1e-6)
    return _fit(cost, events(spark, sf), 4)


@query(f"WITH {sq.sums(SMALL_SQL, EVENTS)}, {sq.solved(2)} SELECT series_id, k, segment, j, {r_sql('x0 + x1 * j', 5, 'value')} FROM s, (SELECT CASE WHEN j < 0 THEN '0' ELSE '1' END AS segment, j FROM (SELECT unnest(range(-5, 6)) AS j))")
def trajectory_values(spark, sf):
    """Every fitted line, evaluated over its window."""
    e = Estimator(SMALL)
    f = placement.trajectory_eval(SMALL, e.minimize_x(e.filter(events(spark, sf))).select("series_id", "k", "x"))
    return rounded(f.select("series_id", "k", "segment", "j", "value"), 5, "value")


# detection

TEMPLATE = (0.0, 0.2, -0.05)


def _template_sql() -> str:
    zero = sq.cost(3, "z")
    return f"""WITH {sq.sums(FIT2_SQL, EVENTS)}, {sq.solved(3, ((1,), (0,), (0,)), TEMPLATE, tag="a", x="t")}, {sq.solved(3, source="a", tag="b")},
z AS (SELECT *, x0 AS z0, 0e0 AS z1, x2 AS z2 FROM b)
SELECT series_id, k, {r_sql(f"kappa / {sq.cost(3, 't')}", 4, "match")}, {r_sql(zero, 4, "J_flat")} FROM z CROSS JOIN w"""


@query(_template_sql())
def template_match(spark, sf):
    """A fixed template on a free level against no signal, and the cost of a parabola whose slope is set to zero."""
    e = Estimator(FIT2)
    f = detect.shape_match(e, e.filter(events(spark, sf)), TEMPLATE, np.eye(3)[:, :1])
    f = e.minimize_x(f).withColumn("flat", detect.zeroed(F.col("x"), 3, [1]))
    f = e.eval_errors(f, "flat", "J_flat")
    return _columns(f, 4, match=F.col("match"), J_flat=F.col("J_flat"))


ECG_SHAPE = (0.8, -0.1, 0.05)
ECG_BASES = [("0", "0", "0", "0", "0", "0"), ("0", "0", "0", "1", "j", "j * j"), ("1", "j", "j * (j - 1) / 2", "1", "j", "j * j")]


def _ecg_sql() -> str:
    fw, bw = sq.forward(140), sq.backward(140)
    parts = [sq.Part(-14, -8, fw, ECG_BASES[0], 0.0, -8), sq.Part(-7, -5, fw, ECG_BASES[1], delta=-5), sq.Part(-4, 4, fw, ECG_BASES[2]), sq.Part(5, 15, bw, ECG_BASES[1], delta=5), sq.Part(16, 22, bw, ECG_BASES[0], 0.0, 16)]
    free = [[0, 0, 0]] * 3 + [[1, 0, 0], [0, 1, 0], [0, 0, 1]]
    states = ", ".join(f"{'0e0' if i < 3 else f'x{i}'} AS z{i}" for i in range(6))
    return f"""WITH {sq.sums(parts, EVENTS)}, {sq.solved(6, free, (*ECG_SHAPE, 0, 0, 0))}, z AS (SELECT *, {states} FROM s)
SELECT series_id, k, {r_sql(f"-0.5 * ln({sq.cost(6, 'x')} / {sq.cost(6, 'z')})", 4, "lcr")} FROM z CROSS JOIN w"""


@query(_ecg_sql())
def shape_segmentation(spark, sf):
    """A known pulse on a parabolic baseline over five segments, the outer two of no weight: where the pulse explains the signal."""
    ends = [Segment(-14, -8, "fw", 140, -8), Segment(-7, -5, "fw", 140, -5), Segment(-4, 4, "fw", 140), Segment(5, 15, "bw", 140, 5), Segment(16, 22, "bw", 140, 16)]
    cost = costs.CompositeCost([models.AlssmPolyJordan(2), models.AlssmPoly(2)], ends, [[0, 0, 1, 0, 0], [0, 1, 1, 1, 0]], betas=[0, 1, 1, 1, 0])
    e = Estimator(cost)
    return _columns(detect.known_shape(e, e.filter(events(spark, sf)), ECG_SHAPE), 4, lcr=F.col("lcr"))


@query(f"WITH {sq.sums([sq.Part(-32, 31, sq.backward(200), LINES)], EVENTS)} SELECT series_id, k, {r_sql('xi0', 4, 'xi0')}, {r_sql('xi1 / 100', 4, 'xi1')} FROM f")
def centred_doubling(spark, sf):
    """A centred window of 64 samples composed from one of 16; samples off the ends count as zeros, as long as the composed
    states reach them, so both ends are padded first."""
    m, s, pad = models.AlssmPoly(1), Segment(-8, 7, "bw", 200), 32
    own = events(spark, sf)
    last = own.groupBy("series_id").agg(F.max("k").alias("last"))
    # 32 zeros before and behind each series; k counts from the first of them
    off = last.select("series_id", F.explode(F.sequence(F.lit(0), F.lit(2 * pad - 1))).alias("i"), "last").select("series_id", F.when(F.col("i") < pad, F.col("i")).otherwise(F.col("i") + F.col("last") + 1).cast("long").alias("k"), F.lit(0.0).alias("y"))
    f = Estimator(costs.CostSegment(m, s), calc=("xi",)).filter(own.withColumn("k", F.col("k") + pad).unionByName(off))
    for length in (16, 32):
        f = detect.double_centred_window(f, m.A, s.gamma, length)
    inside = f.join(last, "series_id").where((F.col("k") >= pad) & (F.col("k") <= F.col("last") + pad)).withColumn("k", F.col("k") - pad)
    return _columns(inside, 4, xi0=F.col("xi")[0], xi1=F.col("xi")[1] / 100)


@query(f"WITH {sq.sums([sq.Part(-10, 10, sq.forward(100), ('1', '-j'))], EVENTS)} SELECT series_id, k, {r_sql('xi0 + 0.1 * xi1', 4, 'c')} FROM f")
def inverse_convolution(spark, sf):
    """Convolution in feature space: the inverse transition turns the template around."""
    m = models.AlssmPolyJordan(1)
    e = Estimator(costs.CostSegment(models.Alssm(np.linalg.inv(m.A), m.C), Segment(-10, 10, "fw", 100)))
    return _columns(e.convolve(events(spark, sf), [1.0, 0.1]), 4, c=F.col("c"))


@query("SELECT * FROM (VALUES ('constant', round(1 + 0.05 * 25e0 / 3, 9)), ('slope', -0.2), ('distance', round(0.0025 * (2 * 625e0 - 50e0 / 3 * 250 / 3 + 10 * 625e0 / 9), 9))) t(name, value)")
def reduced_degree(spark, sf):
    """The line nearest to a parabola over [-5, 5], and how far it is."""
    line = localized.reduce_degree(SHAPE, 1, -5, 5)
    rows = [("constant", float(line.coef[0])), ("slope", float(line.coef[1])), ("distance", localized.distance(SHAPE, line, -5, 5))]
    return rounded(spark.createDataFrame(rows, "name string, value double"), 9, "value")


# several dimensions


def _grid(spark, sf) -> DataFrame:
    """Embeddings as a grid of vectors, rows of eight dimensions and places in them."""
    own = channels(spark, sf)
    return own.select("series_id", F.col("k").alias("k0"), F.floor(F.col("ch") / 8).cast("long").alias("k1"), (F.col("ch") % 8).cast("long").alias("k2"), "y")


PLANE_SQL = "SELECT vec_id AS k0, d AS k1, embedding[d + 1]::DOUBLE AS y FROM embeddings, (SELECT unnest(range(64)) AS d)"
KERNEL_SQL = [sq.Part(-3, -1, sq.forward(5000), ("pow(1e0 / 0.8, j)", "pow(1e0 / 0.8, j) * j", "0", "0")), sq.Part(0, 3, sq.backward(5000), ("0", "0", "pow(0.8, j)", "pow(0.8, j) * j"))]
KERNEL = (1.0, 0.2, 1.0, -0.2)


@query(f"WITH {nd_sql([KERNEL_SQL, KERNEL_SQL], PLANE_SQL, ['k0', 'k1']).split(', e_s_0 AS')[0].split(',' + chr(10) + 'e_s_0 AS')[0]} SELECT 'e' AS series_id, g.k0, g.k1, {r_sql(sq.combined([a * b for a in KERNEL for b in KERNEL], [f'xi{i}' for i in range(16)]), 4, 'c')} FROM g JOIN f ON f.k0 = g.k0 AND f.k1 = g.k1")
def separable_convolution(spark, sf):
    """The grid convolved with a separable two-sided kernel of damped lines, in feature space."""
    sides = [models.AlssmProd([models.AlssmExp(v), models.AlssmPoly(1)]) for v in (1 / 0.8, 0.8)]
    axis = costs.CompositeCost(sides, [Segment(-3, -1, "fw", 5000), Segment(0, 3, "bw", 5000)], np.eye(2))
    plane = channels(spark, sf).select("series_id", F.col("k").alias("k0"), F.col("ch").cast("long").alias("k1"), "y")
    e = NDEstimator(costs.NDCompositeCost([axis, axis]), ("k0", "k1"))
    return rounded(e.convolve(plane, np.kron(KERNEL, KERNEL)).select("series_id", "k0", "k1", "c"), 4, "c")


CUBE_SQL = "SELECT vec_id AS k0, d // 8 AS k1, d % 8 AS k2, embedding[d + 1]::DOUBLE AS y FROM embeddings, (SELECT unnest(range(64)) AS d)"


@query(f"WITH {nd_sql([[sq.Part(-2, 2, sq.backward(10), LINES)], [sq.Part(-1, 1, sq.backward(5), LINES)], [sq.Part(-1, 1, sq.backward(5), ('1',))]], CUBE_SQL, ['k0', 'k1', 'k2'])} SELECT 'e' AS series_id, g.k0, g.k1, g.k2, {r_sql('x0', 5, 'y_hat')} FROM g JOIN s ON s.k0 = g.k0 AND s.k1 = g.k1 AND s.k2 = g.k2")
def nd_fit_3d(spark, sf):
    """A separable fit on a grid of three axes."""
    axes = [costs.CostSegment(models.AlssmPoly(d), Segment(-r, r, "bw", g)) for d, r, g in ((1, 2, 10), (1, 1, 5), (0, 1, 5))]
    e = NDEstimator(costs.NDCompositeCost(axes), ("k0", "k1", "k2"))
    return rounded(e.eval_output(e.minimize_x(e.filter(_grid(spark, sf)))).select("series_id", "k0", "k1", "k2", "y_hat"), 5, "y_hat")


# streams


@query(f"WITH {sq.sums([sq.Part(-10, -1, sq.forward(20), LINES)], EVENTS)} SELECT series_id, k, {r_sql('xi0', 5, 'xi0')}, {r_sql('xi1', 5, 'xi1')} FROM f")
def streaming_sums(spark, sf):
    """The forward window over the events as a stream: numbered events are written, streamed and read back."""
    source, sink, state = (scratch_path(spark, n) for n in ("events", "sums", "state"))
    events(spark, sf).write.parquet(source)
    schema = "series_id string, k long, y double"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1 << 30).parquet(source)
    sums = streaming_xi(stream, models.AlssmPoly(1), Segment(-10, -1, "fw", 20))
    sums.writeStream.format("parquet").option("path", sink).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    f = spark.read.schema("series_id string, k long, xi array<double>").parquet(sink)
    return _columns(f, 5, xi0=F.col("xi")[0], xi1=F.col("xi")[1])


# matrices of the polynomial calculus


def polynomial(coef, expos, *x) -> F.Column:
    """A multivariate polynomial of literal coefficients over columns."""
    p = pl.MPoly((np.asarray(coef, float),), expos)
    terms = [reduce(lambda t, ve: t * F.pow(ve[0], F.lit(int(ve[1]))), zip(x, (e[i] for e, i in zip(p.expos, at, strict=True)), strict=True), F.lit(float(c))) for at, c in np.ndenumerate(p.tensor)]
    return reduce(lambda a, b: a + b, terms)


P_SQL, Q_SQL = (lambda x: f"(1 + 3 * {x} + 5 * {x} * {x})"), (lambda x: f"(2 - {x})")
MATRIX_SQL = {
    "sum_terms": f"{P_SQL('u')} + {Q_SQL('u')}",
    "sum_blocks": f"{P_SQL('u')} + {Q_SQL('u')}",
    "prod_terms": f"{P_SQL('u')} * {Q_SQL('u')}",
    "square_terms": f"{P_SQL('u')} * {P_SQL('u')}",
    "shifted": P_SQL("(u + 0.5)"),
    "dilated": P_SQL("(2 * u)"),
    "integral": "u + 1.5 * u * u + 5e0 / 3 * u * u * u",
    "integral_values": "u + 1.5 * u * u + 5e0 / 3 * u * u * u",
    "derivative": "3 + 10 * u",
    "derivative_values": "3 + 10 * u",
    "m_integral": "(u + u * u) * (3 - v + 0.5 * v * v)",
    "m_derivative": "(1 + 2 * u) * (v - 1)",
    "m_substituted": "(1 + 2 * u) * 2.625",
    "m_definite": "(1 + 2 * u) * (6 - 2 + 4e0 / 3)",
    "m_dilated": "(1 + 6 * u) * (3 - v + 0.5 * v * v)",
    "m_multiplied": f"{P_SQL('u')} * {Q_SQL('v')}",
    "m_product": f"{P_SQL('u')} * {Q_SQL('v')} * {Q_SQL('w')}",
    "m_squared": "pow((1 + 2 * u) * (3 - v + 0.5 * v * v), 2)",
    "m_shifted": P_SQL("(u + v)"),
    "m_joint": P_SQL("(u * v)"),
    "extended": "(1 + 2 * u) * (3 - v + 0.5 * v * v)",
    "extended_matrix": "(1 + 2 * u) * (3 - v + 0.5 * v * v)",
    "commuted": f"{P_SQL('u')} * {Q_SQL('v')}",
    "permuted": f"{P_SQL('u')} * {P_SQL('w')} * {Q_SQL('v')} * {Q_SQL('u')}",
    "permuted_square": f"{P_SQL('u')} * {P_SQL('w')} * {Q_SQL('v')} * {Q_SQL('u')}",
    "merged": f"{P_SQL('u')} * {P_SQL('u')}",
    "m_merged": "(1 + 5 * u) * 9",
    "transformed": f"v * {P_SQL('(w * (u + v + 0.4))')}",
    "low_degree": "3 - v + 6 * u",
    "subspace": "1 + 2 * v - u + 0.5 * u * v",
}


@query("SELECT p_partkey, " + ", ".join(f"round({e}, 6) + 0.0 AS {n}" for n, e in MATRIX_SQL.items()) + " FROM (SELECT p_partkey, sqrt(p_retailprice) / 30 AS u, sqrt(p_size) / 7 AS v, sqrt(p_retailprice) / 30 - sqrt(p_size) / 7 AS w FROM part)")
def polynomial_matrices(spark, sf):
    """Coefficient matrices, exponent matrices, permutations, extensions and the subspace fit, by the polynomials that they make."""
    u, v, w = F.col("u"), F.col("v"), F.col("w")
    p, q, m, e = P.coef, Q.coef, MP.coefs[0], MP.expos
    three = np.arange(3)
    coords = np.linspace(-1, 1, 6)[:, None]
    betas = np.stack([np.array([[1.0, 2.0], [-1.0, 0.5]]) @ np.array([1, c[0]]) for c in coords])
    swapped = pl.permutation_matrix(3, 3, 2, 2) @ pl.kron_sequence([p, q, p, q])
    swapped_square = pl.permutation_matrix_square(3, 2) @ pl.kron_sequence([p, q, p, q])
    like, distinct = pl.remove_redundancy(pl.poly_square_expo(P.expo))
    alike, few = pl.mpoly_remove_redundancy(([0, 1, 1], [0, 0]))
    low = pl.constrain_matrix_for_exponents(e, 1)
    added = [x @ c for x, c in zip(pl.poly_sum_coef_Ls((P.expo, Q.expo)), (p, q), strict=True)]
    own = pl.mpoly_multiply(P, Q)
    more = pl.mpoly_prod([P, Q, Q])
    squares = [x @ np.asarray(c) for x, c in zip(pl.mpoly_square_expo_Ms(e), e, strict=True)]
    wide = pl.extend_basis(MP, [np.array([0, 1])])
    made = {
        "sum_terms": polynomial(pl.poly_sum_coef((P, Q)), (pl.poly_sum_expo((P.expo, Q.expo)),), u),
        "sum_blocks": polynomial(sum(added), (sum(x @ np.asarray(c) for x, c in zip(pl.poly_sum_expo_Ms((P.expo, Q.expo)), (P.expo, Q.expo), strict=True)),), u),
        "prod_terms": polynomial(pl.poly_prod_coef((P, Q)), (sum(x @ np.asarray(c) for x, c in zip(pl.poly_prod_expo_Ms((P.expo, Q.expo)), (P.expo, Q.expo), strict=True)),), u),
        "square_terms": polynomial(pl.poly_square_coef(P), (pl.poly_square_expo_M(P.expo) @ P.expo,), u),
        "shifted": polynomial(pl.poly_shift_coef_L(P.expo, 0.5) @ p, (pl.poly_shift_expo(P.expo),), u),
        "dilated": polynomial(pl.poly_dilation_coef_L(P.expo, 2) @ p, (P.expo,), u),
        "integral": polynomial(pl.poly_int_coef_L(P.expo) @ p, (pl.poly_int_expo(P.expo),), u),
        "integral_values": polynomial(pl.poly_int_coef(P), (pl.poly_int_expo(P.expo),), u),
        "derivative": polynomial(pl.poly_diff_coef_L(P.expo) @ p, (pl.poly_diff_expo(P.expo),), u),
        "derivative_values": polynomial(pl.poly_diff_coef(P), (pl.poly_diff_expo(P.expo),), u),
        "m_integral": polynomial(pl.mpoly_int_coef_L(e, 0) @ m, pl.mpoly_int_expos(e, 0), u, v),
        "m_derivative": polynomial(pl.mpoly_diff_coef_L(e, 1) @ m, pl.mpoly_diff_expos(e, 1), u, v),
        "m_substituted": polynomial(pl.mpoly_substitute_coef_L(e, 1, 0.5) @ m, pl.mpoly_substitute_expos(e, 1), u),
        "m_definite": polynomial(pl.mpoly_def_int_coef_L(e, 1, 0, 2) @ m, pl.mpoly_def_int_expos(e, 1), u),
        "m_dilated": polynomial(pl.mpoly_dilate_coef_L(e, 0, 3) @ m, pl.mpoly_dilate_expos(e), u, v),
        "m_multiplied": polynomial(own.coefs[0], own.expos, u, v),
        "m_product": polynomial(more.coefs[0], more.expos, u, v, w),
        "m_squared": polynomial(pl.mpoly_square_coef_L(e) @ np.kron(m, m), squares, u, v),
        "m_shifted": polynomial(pl.mpoly_shift_coef_L(P.expo) @ p, pl.mpoly_shift_expos(P.expo), u, v),
        "m_joint": polynomial(pl.mpoly_dilate_ind_coef_L(P.expo) @ p, pl.mpoly_dilate_ind_expos(P.expo), u, v),
        "extended": polynomial(wide.coefs[0], wide.expos, u, v, w),
        "extended_matrix": polynomial(pl.mpoly_extend_coef_L((*e, np.array([0, 1])), [2]) @ m, (*e, np.array([0, 1])), u, v, w),
        "commuted": polynomial(pl.commutation_matrix(2, 3) @ np.kron(p, q), (Q.expo, P.expo), v, u),
        "permuted": polynomial(swapped, (P.expo, P.expo, Q.expo, Q.expo), u, w, v, u),
        "permuted_square": polynomial(swapped_square, (P.expo, P.expo, Q.expo, Q.expo), u, w, v, u),
        "merged": polynomial(like @ pl.poly_square_coef(P), (distinct,), u),
        "m_merged": polynomial(alike @ pl.kron_sequence([[1.0, 2, 3], [4.0, 5]]), few, u, v),
        "transformed": polynomial(pl.mpoly_transformation_coef_L(three, 0.4) @ p, pl.mpoly_transformation_expos(three), *TRANSFORMED(u, v, w)),
        "low_degree": polynomial(low @ (low.T @ m), e, u, v),
        "subspace": polynomial(pl.mpoly_fit_subspace1(betas, [0, 1], (-1, 1), coords, ([0, 1],)), ([0, 1], [0, 1]), u, v),
    }
    own = table(spark, sf, "part").select("p_partkey", (F.sqrt("p_retailprice") / 30).alias("u"), (F.sqrt("p_size") / 7).alias("v")).withColumn("w", u - v)
    return own.select("p_partkey", *[(F.round(c, 6) + F.lit(0.0)).alias(n) for n, c in made.items()])


#: The variables of the transformation matrix: shift, scale, place, amplitude.
TRANSFORMED = lambda u, v, w: (v, w, u, v)
