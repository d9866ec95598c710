"""Queries over the test tables, and the SQL that computes the same from the definitions: a join on the window's offsets
with literal weights. Results are rounded, as sums in another order differ in the last digits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import oracles as sq
from .functions import poly as pl
from .operators import detect, localized, placement
from .operators.estimator import Estimator
from .operators.nd import NDEstimator
from .operators.windowed import Term, windowed_sums
from .plans import costs, gram, models
from .plans.segments import Segment
from .sources import generators as gen
from .sources.order import numbered

EVENTS = "SELECT event_type AS series_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS k, value / 100 AS y FROM events"
DAILY = "SELECT 'orders' AS series_id, row_number() OVER (ORDER BY d) - 1 AS k, y FROM (SELECT o_orderdate::DATE AS d, sum(o_totalprice) / 1e6 AS y FROM orders GROUP BY 1)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a type in time order: series_id, k, y."""
    own = table(spark, sf_dir, "events").select(F.col("event_type").alias("series_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", (F.col("value") / 100).alias("y"))
    return numbered(own, ["series_id"], "ts", "event_id").select("series_id", "k", "y")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders' daily total: one series; a row per day."""
    days = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg((F.sum("o_totalprice") / 1e6).alias("y"))
    return days.select(F.lit("orders").alias("series_id"), (F.row_number().over(Window.orderBy("d")) - 1).cast("long").alias("k"), "y")


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


# SQL of the definitions: formulas of each cost's windows and bases, apart from the engine's


def r_sql(expr: str, digits: int, name: str) -> str:
    return sq.rounded(expr, digits, name)


LINES = sq.MONOMIALS[:2]
LINE_SQL = [sq.Part(-10, -1, sq.forward(20), LINES)]
FIT2_SQL = [sq.Part(-10, -1, sq.forward(10), sq.MONOMIALS[:3]), sq.Part(0, 10, sq.backward(10), sq.MONOMIALS[:3])]
EDGE_SQL = [sq.Part(-20, -1, sq.forward(20), ("1", "j", "0", "0")), sq.Part(0, 19, sq.backward(20), ("0", "0", "1", "j"))]
SAVGOL_SQL = [[sq.Part(-7, 7, sq.backward(1e6), sq.MONOMIALS[:n])] for n in (1, 2, 3)]
PULSE_SQL = [sq.Part(-15, -1, sq.forward(30), ("1", "j", "0")), sq.Part(0, 5, sq.backward(30), ("1", "j", "1"), beta=2.0), sq.Part(6, 20, sq.backward(30), ("1", "j", "0"))]
WAVE_SQL = [sq.Part(-12, 12, sq.backward(20), ("pow(0.99, j) * cos(0.5 * j)", "-pow(0.99, j) * sin(0.5 * j)", "pow(0.95, j)"))]
PROD_SQL = [sq.Part(0, 12, sq.backward(15), ("pow(0.9, j)", "pow(0.9, j) * j"), beta=0.5)]
JORDAN_SQL = [sq.Part(-8, 8, sq.backward(40), ("1", "j", "j * (j - 1) / 2", "j * (j - 1) * (j - 2) / 6"))]
LEGENDRE_SQL = [sq.Part(-8, 8, sq.backward(40), ("1", "j / 8e0", "(3 * pow(j / 8e0, 2) - 1) / 2", "(5 * pow(j / 8e0, 3) - 3 * (j / 8e0)) / 2"))]
LONG_SQL = [sq.Part(0, 127, sq.backward(100), LINES)]
SMALL_SQL = [sq.Part(-5, -1, sq.forward(10), LINES), sq.Part(0, 5, sq.backward(10), LINES)]
EMB_PART = [sq.Part(-4, 4, sq.backward(10), LINES)]


# costs of the queries

LINE = costs.CostSegment(models.AlssmPoly(1), Segment(-10, -1, "fw", 20))
FIT2 = costs.CompositeCost([models.AlssmPoly(2)], [Segment(-10, -1, "fw", 10), Segment(0, 10, "bw", 10)], np.ones((1, 2)))
EDGE = costs.TSLM.create_cost((-20, 19), (20, 20))
MEAN = costs.CostSegment(models.AlssmPoly(0), Segment(-7, 7, "bw", 1e6))
SAVGOL1 = costs.CostSegment(models.AlssmPoly(1), Segment(-7, 7, "bw", 1e6))
SAVGOL2 = costs.CostSegment(models.AlssmPoly(2), Segment(-7, 7, "bw", 1e6))
PULSE = costs.CompositeCost([models.AlssmPoly(1), models.AlssmPoly(0)], [Segment(-15, -1, "fw", 30), Segment(0, 5, "bw", 30), Segment(6, 20, "bw", 30)], [[1, 1, 1], [0, 1, 0]], betas=[1, 2, 1])
WAVE = costs.CostSegment(models.AlssmSum([models.AlssmSin(0.5, 0.99), models.AlssmExp(0.95)]), Segment(-12, 12, "bw", 20))
PROD = costs.CostSegment(models.AlssmProd([models.AlssmExp(0.9), models.AlssmPoly(1)]), Segment(0, 12, "bw", 15), beta=0.5)
BASES = {
    "jordan": costs.CostSegment(models.AlssmPolyJordan(3), Segment(-8, 8, "bw", 40)),
    "legendre": costs.CostSegment(models.AlssmPolyLegendre(3, -8, 8), Segment(-8, 8, "bw", 40)),
}
LONG = costs.CostSegment(models.AlssmPoly(1), Segment(0, 127, "bw", 100))
EXPANSION = Segment(0, np.inf, "bw", 12)
TSLM_KINDS = {k[2:].lower(): getattr(costs.TSLM, k) for k in dir(costs.TSLM) if k.startswith("H_")}

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _spread(df: DataFrame, names: list[str], digits: int = 6, **arrays) -> DataFrame:
    """Array columns as scalar ones, rounded."""
    out = [F.col(n) for n in ("series_id", "k")] + [(F.round(F.col(n), digits) + F.lit(0.0)).alias(n) for n in names]
    out += [(F.round(F.col(c)[i], digits) + F.lit(0.0)).alias(f"{c}{i}") for c, n in arrays.items() for i in range(n)]
    return df.select(*out)


@query(f"WITH {sq.sums(LINE_SQL, EVENTS)} SELECT series_id, k, {r_sql('kappa', 6, 'kappa')}, {r_sql('nu', 6, 'nu')}, {r_sql('xi0', 6, 'xi0')}, {r_sql('xi1', 5, 'xi1')} FROM f")
def xi_window_sum(spark, sf):
    """The estimator's windowed sums over a forward window."""
    f = Estimator(LINE).filter(events(spark, sf))
    return f.select("series_id", "k", *[(F.round(c, d) + F.lit(0.0)).alias(n) for c, n, d in ((F.col("kappa"), "kappa", 6), (F.col("nu"), "nu", 6), (F.col("xi")[0], "xi0", 6), (F.col("xi")[1], "xi1", 5))])


def _varying_sql() -> str:
    sums = ", ".join(f"round(coalesce(sum(CASE WHEN b.y IS NOT NULL THEN o.g * o.p{i} * o.p{k} END), 0), 5) + 0.0 AS w{i}{k}" for i, k in ((0, 0), (0, 1), (1, 1)))
    return f"""WITH sig AS ({EVENTS}), {sq.window(LINE_SQL)}
SELECT a.series_id, a.k, {sums} FROM sig a CROSS JOIN o LEFT JOIN sig b ON b.series_id = a.series_id AND b.k = a.k + o.j GROUP BY a.series_id, a.k"""


@query(_varying_sql())
def gram_timevarying(spark, sf):
    """The Gram matrix of every sample's truncated window."""
    f = Estimator(LINE, steady_state=False).filter(events(spark, sf))
    return f.select("series_id", "k", *[(F.round(F.col("W")[i][j], 5) + F.lit(0.0)).alias(f"w{i}{j}") for i, j in ((0, 0), (0, 1), (1, 1))])


def _fit(cost, df, digits: int = 5, **switches) -> DataFrame:
    e = Estimator(cost, **switches)
    return _spread(e.eval_errors(e.eval_output(e.minimize_x(e.filter(df)))), ["y_hat", "J"], digits)


@query(sq.fit(FIT2_SQL, EVENTS))
def polynomial_fit(spark, sf):
    """A parabola over a two-sided decaying window at every event."""
    return _fit(FIT2, events(spark, sf))


@query(sq.fit(SAVGOL_SQL[0], DAILY))
def moving_average(spark, sf):
    """Degree 0 over daily totals."""
    return _fit(MEAN, daily(spark, sf))


@query(sq.fit(SAVGOL_SQL[1], DAILY))
def savgol_deg1(spark, sf):
    return _fit(SAVGOL1, daily(spark, sf))


@query(sq.fit(SAVGOL_SQL[2], DAILY))
def savgol_deg2(spark, sf):
    return _fit(SAVGOL2, daily(spark, sf))


@query(sq.fit(WAVE_SQL, EVENTS))
def sinusoid_fit(spark, sf):
    """A damped wave plus a decay."""
    return _fit(WAVE, events(spark, sf))


@query(sq.fit(PROD_SQL, EVENTS))
def product_model_fit(spark, sf):
    """A decaying line, a product of models, with a scaled cost."""
    return _fit(PROD, events(spark, sf))


@query(sq.fit(JORDAN_SQL, EVENTS))
def jordan_fit(spark, sf):
    return _fit(BASES["jordan"], events(spark, sf))


@query(sq.fit(LEGENDRE_SQL, EVENTS))
def legendre_fit(spark, sf):
    return _fit(BASES["legendre"], events(spark, sf))


@query(sq.fit(FIT2_SQL, EVENTS))
def fit_fold_strategy(spark, sf):
    """The same fit by range frames, which also serve series with gaps."""
    return _fit(FIT2, events(spark, sf), strategy="fold")


@query(sq.fit(FIT2_SQL, EVENTS))
def fit_doubling_strategy(spark, sf):
    """The same fit by doubled windows, in blocks with a halo."""
    return _fit(FIT2, events(spark, sf), strategy="doubling", block=256)


@query(sq.fit(FIT2_SQL, EVENTS))
def fit_explode_strategy(spark, sf):
    """The same fit by sending samples to their anchors."""
    return _fit(FIT2, events(spark, sf), strategy="explode")


@query(f"WITH {sq.sums(LONG_SQL, EVENTS)} SELECT series_id, k, {r_sql('xi0', 4, 'xi0')}, {r_sql('xi1 / 100', 4, 'xi1')} FROM f")
def long_window_doubling(spark, sf):
    """A window of 128 samples in seven doublings."""
    f = Estimator(LONG, calc=("xi",)).filter(events(spark, sf))
    return f.select("series_id", "k", (F.round(F.col("xi")[0], 4) + F.lit(0.0)).alias("xi0"), (F.round(F.col("xi")[1] / 100, 4) + F.lit(0.0)).alias("xi1"))


def _tslm_sql() -> str:
    parts = [sq.solved(4, H, tag=f"s_{kind}") for kind, H in TSLM_KINDS.items()]  # noqa: N806
    picks = " UNION ALL ".join(f"SELECT series_id, k, '{kind}' AS hypothesis, {r_sql(sq.cost(4), 4, 'J')} FROM s_{kind} CROSS JOIN w" for kind in TSLM_KINDS)
    return f"WITH {sq.sums(EDGE_SQL, EVENTS)}, {', '.join(parts)} {picks}"


@query(_tslm_sql())
def tslm_hypotheses(spark, sf):
    """The cost of each of the eight two-sided line hypotheses, on one filter pass."""
    e = Estimator(EDGE)
    f = e.filter(events(spark, sf))
    for kind, H in TSLM_KINDS.items():  # noqa: N806
        f = e.eval_errors(e.minimize_x(f, H, name=f"x_{kind}"), f"x_{kind}", f"J_{kind}")
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("hypothesis"), F.col(f"J_{k}").alias("J")) for k in TSLM_KINDS])).alias("r")
    return rounded(f.select("series_id", "k", rows).select("series_id", "k", "r.hypothesis", "r.J"), 4, "J")


def _edge_sql() -> str:
    """Continuous: both lines share the offset. Straight: they share both parameters."""
    bend, straight = ((1, 0, 0), (0, 1, 0), (1, 0, 0), (0, 0, 1)), ((1, 0), (0, 1), (1, 0), (0, 1))
    return f"""WITH {sq.sums(EDGE_SQL, EVENTS)}, {sq.solved(4, bend, tag="s1", x="p")}, {sq.solved(4, straight, source="s1", tag="s0", x="q")},
j AS (SELECT series_id, k, {sq.cost(4, "p")} AS j1, {sq.cost(4, "q")} AS j0 FROM s0 CROSS JOIN w), l AS (SELECT *, -0.5 * ln(j1 / j0) AS lcr FROM j)"""


def edges(spark, sf) -> DataFrame:
    e = Estimator(EDGE)
    return detect.hypotheses(e, e.filter(events(spark, sf)), costs.TSLM.H_Continuous, costs.TSLM.H_Straight)


@query(f"{_edge_sql()} SELECT series_id, k, {r_sql('lcr', 4, 'lcr')} FROM l")
def edge_lcr(spark, sf):
    """How much better a bend explains each window than a straight line."""
    return rounded(edges(spark, sf).select("series_id", "k", "lcr"), 4, "lcr")


@query(f"{_edge_sql()} SELECT series_id, arg_max(k, lcr) AS k, {r_sql('max(lcr)', 4, 'lcr')} FROM l GROUP BY series_id")
def onset_detection(spark, sf):
    """The strongest onset of each series."""
    return rounded(detect.argmax(edges(spark, sf), "lcr").select("series_id", F.col("k").cast("long").alias("k"), "lcr"), 4, "lcr")


PULSE_H1, PULSE_H0 = np.eye(3), np.eye(3)[:, :2]


def _pulse_sql() -> str:
    """A line with and without a box on the middle segment."""
    return f"""WITH {sq.sums(PULSE_SQL, EVENTS)}, {sq.solved(3, tag="s1", x="p")}, {sq.solved(3, ((1, 0), (0, 1), (0, 0)), source="s1", tag="s0", x="q")}
SELECT series_id, k, {r_sql("p2", 4, "height")}, {r_sql(f"-0.5 * ln({sq.cost(3, 'p')} / {sq.cost(3, 'q')})", 4, "lcr")} FROM s0 CROSS JOIN w"""


@query(_pulse_sql())
def pulse_detection(spark, sf):
    """A rectangular pulse on a line: three segments, scaled, with a model that shows in the middle one only."""
    e = Estimator(PULSE)
    f = detect.hypotheses(e, e.filter(events(spark, sf)), PULSE_H1, PULSE_H0)
    return rounded(f.select("series_id", "k", F.col("x1")[2].alias("height"), "lcr"), 4, "height", "lcr")


PEAKS_SQL = f"""{_edge_sql().replace("WITH ", "WITH RECURSIVE ", 1)},
n AS (SELECT *, lag(lcr) OVER (PARTITION BY series_id ORDER BY k) AS l0, lead(lcr) OVER (PARTITION BY series_id ORDER BY k) AS l1 FROM l),
c AS (SELECT series_id, list({{'k': k, 'lcr': lcr}} ORDER BY lcr DESC, k DESC) AS p FROM n WHERE l0 < lcr AND l1 < lcr AND lcr >= 0.01 GROUP BY series_id),
g AS (SELECT series_id, p[1] AS top, list_filter(p[2:], lambda x: abs(x.k - p[1].k) >= 30) AS rest FROM c
      UNION ALL SELECT series_id, rest[1], list_filter(rest[2:], lambda x: abs(x.k - rest[1].k) >= 30) FROM g WHERE len(rest) > 0)
SELECT series_id, top.k AS k, {r_sql("top.lcr", 4, "lcr")} FROM g"""


@query(PEAKS_SQL)
def find_peaks(spark, sf):
    """Peaks of the onset score, 30 samples apart at least."""
    return rounded(detect.find_peaks(edges(spark, sf), "lcr", height=0.01, distance=30), 4, "lcr")


@query(f"WITH {sq.sums(FIT2_SQL, EVENTS)} SELECT series_id, k, {r_sql('xi0 - 0.5 * xi1 + 0.25 * xi2', 4, 'c')} FROM f")
def convolve_template(spark, sf):
    """Correlation with a template in feature space."""
    return rounded(Estimator(FIT2).convolve(events(spark, sf), [1.0, -0.5, 0.25]).select("series_id", "k", "c"), 4, "c")


def _shape_sql() -> str:
    """A template 1 + 0.2 j - 0.05 j^2, scaled at its best: J_A = kappa - a^2 / b."""
    t, names = (1.0, 0.2, -0.05), [f"xi{i}" for i in range(3)]
    a = f"({sq.combined(t, names)})"
    b = f"({sq.combined([p * q for p in t for q in t], [f'w{i}_{k}' for i in range(3) for k in range(3)])})"
    return f"WITH {sq.sums(FIT2_SQL, EVENTS)} SELECT series_id, k, {r_sql(f'kappa / (kappa - {a} * {a} / {b})', 4, 'match')} FROM f CROSS JOIN w"


@query(_shape_sql())
def shape_match(spark, sf):
    """J_0 / J_A: how well a scaled template explains the window."""
    e = Estimator(FIT2)
    return rounded(detect.shape_match(e, e.filter(events(spark, sf)), [1.0, 0.2, -0.05]).select("series_id", "k", "match"), 4, "match")


@query(f"WITH {sq.sums([sq.Part(0, 63, sq.backward(50), LINES)], EVENTS)} SELECT series_id, k, {r_sql('xi0', 4, 'xi0')}, {r_sql('xi1 / 100', 4, 'xi1')} FROM f")
def multiscale_doubling(spark, sf):
    """A window of 64 samples composed from windows of 16."""
    m, s = models.AlssmPoly(1), Segment(0, 15, "bw", 50)
    f = Estimator(costs.CostSegment(m, s), calc=("xi",)).filter(events(spark, sf))
    for length in (16, 32):
        f = detect.double_window(f, m.A, s.gamma, length)
    return f.select("series_id", "k", (F.round(F.col("xi")[0], 4) + F.lit(0.0)).alias("xi0"), (F.round(F.col("xi")[1] / 100, 4) + F.lit(0.0)).alias("xi1"))


EMB = costs.CostSegment(models.AlssmPoly(1), Segment(-4, 4, "bw", 10))
EMB_SQL = "SELECT ch::VARCHAR AS series_id, vec_id AS k, embedding[ch + 1]::DOUBLE AS y FROM embeddings, (SELECT unnest(range(64)) AS ch)"


def channels(spark, sf) -> DataFrame:
    """Embeddings as a multi-channel signal: vec_id is the sample, the dimension the channel."""
    return table(spark, sf, "embeddings").select(F.lit("e").alias("series_id"), F.col("vec_id").alias("k"), F.posexplode("embedding").alias("ch", "v")).select("series_id", "ch", "k", F.col("v").cast("double").alias("y"))


@query(f"WITH {sq.sums(EMB_PART, EMB_SQL)}, {sq.solved(2)} SELECT 'e' AS series_id, k, {r_sql('sum(x0)', 4, 'level')}, {r_sql(f'sum({sq.cost(2)})', 4, 'J')} FROM s CROSS JOIN w GROUP BY k")
def multichannel_energy(spark, sf):
    """Every channel fitted apart; levels and costs summed over channels."""
    e = Estimator(EMB, keys=("series_id", "ch"))
    f = e.eval_errors(e.minimize_x(e.filter(channels(spark, sf)))).withColumn("level", F.col("x")[0])
    return rounded(detect.energy(f, ["level", "J"], "ch", ("series_id", "ch")), 4, "level", "J")


@query(f"WITH {sq.sums(EMB_PART, EMB_SQL)} SELECT 'e' AS series_id, k, {r_sql('sum(xi0 + 0.1 * xi1)', 4, 'c')} FROM f GROUP BY k")
def multichannel_convolve(spark, sf):
    e = Estimator(EMB, keys=("series_id", "ch"))
    return rounded(e.convolve(channels(spark, sf), [1.0, 0.1], over=("ch",)), 4, "c")


@query()
def matched_filter(spark, sf):
    """A template whitened by the covariance of all channels."""
    e = Estimator(EMB, keys=("series_id", "ch"))
    df = channels(spark, sf)
    cov = detect.channel_covariance(df, "ch", keys=("series_id",))
    return rounded(detect.matched_filter(e, df, np.ones((len(cov), 2)), cov, "ch"), 4, "c")


ND = costs.NDCompositeCost([costs.CostSegment(models.AlssmPoly(1), Segment(-3, 3, "bw", 10)), costs.CostSegment(models.AlssmPoly(1), Segment(-2, 2, "bw", 5))])


def nd_sql(axes: list[list[sq.Part]], signal: str, names: list[str]) -> str:
    """CTEs g (keys, y), windows, f (xi over all axes, Kronecker order), states x0, ..: the Gram matrix is a product over the axes."""
    n = len(axes)
    states = list(np.ndindex(*[len(a[0].basis) for a in axes]))
    xi = ", ".join(f"sum(b.y * {' * '.join(f'r{d}.r{i[d]}' for d in range(n))}) AS xi{c}" for c, i in enumerate(states))
    gram_ = ", ".join(f"{' * '.join(f'w{d}.w{i[d]}_{k[d]}' for d in range(n))} AS w{a}_{b}" for a, i in enumerate(states) for b, k in enumerate(states))
    return f"""g AS ({signal}), {', '.join(sq.window(a, str(d)) for d, a in enumerate(axes))},
w AS (SELECT {gram_} FROM {' CROSS JOIN '.join(f'w{d}' for d in range(n))}),
f AS (SELECT {', '.join(f'b.{k} - r{d}.j AS {k}' for d, k in enumerate(names))}, {xi} FROM g b {' '.join(f'CROSS JOIN r{d}' for d in range(n))} GROUP BY {', '.join(str(d + 1) for d in range(n))}),
{sq.solved(len(states))}"""


def _nd_sql() -> str:
    own = nd_sql([[sq.Part(-3, 3, sq.backward(10), LINES)], [sq.Part(-2, 2, sq.backward(5), LINES)]], "SELECT vec_id AS k0, d AS k1, embedding[d + 1]::DOUBLE AS y FROM embeddings, (SELECT unnest(range(64)) AS d)", ["k0", "k1"])
    return f"WITH {own} SELECT 'e' AS series_id, g.k0, g.k1, {r_sql('x0', 5, 'y_hat')} FROM g JOIN s ON s.k0 = g.k0 AND s.k1 = g.k1"


@query(_nd_sql())
def nd_fit_2d(spark, sf):
    """A separable plane over a window on the grid of vectors and dimensions."""
    e = NDEstimator(ND, ("k0", "k1"))
    grid = channels(spark, sf).select("series_id", F.col("k").alias("k0"), F.col("ch").cast("long").alias("k1"), "y")
    return rounded(e.eval_output(e.minimize_x(e.filter(grid))).select("series_id", "k0", "k1", "y_hat"), 5, "y_hat")


def _infinite_sql() -> str:
    g = "(11e0 / 12e0)"
    return f"""WITH RECURSIVE sig AS ({EVENTS}), n AS (SELECT series_id, max(k) AS last FROM sig GROUP BY 1),
s(series_id, k, xi0, xi1) AS (
  SELECT sig.series_id, sig.k, sig.y, 0.0::DOUBLE FROM sig JOIN n ON n.series_id = sig.series_id AND sig.k = n.last
  UNION ALL
  SELECT s.series_id, s.k - 1, {g} * s.xi0 + sig.y, {g} * (s.xi0 + s.xi1) FROM s JOIN sig ON sig.series_id = s.series_id AND sig.k = s.k - 1)
SELECT series_id, k, {r_sql("xi0", 4, "xi0")}, {r_sql("xi1 / 10", 4, "xi1")} FROM s"""


@query(_infinite_sql())
def infinite_window(spark, sf):
    """A backward window to infinity."""
    f = Estimator(costs.CostSegment(models.AlssmPoly(1), EXPANSION), calc=("xi",)).filter(events(spark, sf))
    return f.select("series_id", "k", (F.round(F.col("xi")[0], 4) + F.lit(0.0)).alias("xi0"), (F.round(F.col("xi")[1] / 10, 4) + F.lit(0.0)).alias("xi1"))


SMALL = costs.CompositeCost([models.AlssmPoly(1)], [Segment(-5, -1, "fw", 10), Segment(0, 5, "bw", 10)], np.ones((1, 2)))


def _with_length(anchors: DataFrame, signal: DataFrame) -> DataFrame:
    """Anchors with the length of their own series."""
    return anchors.join(signal.groupBy("series_id").agg((F.max("k") + 1).alias("length")), "series_id")


@query(f"""WITH sig AS ({EVENTS}), {sq.window(SMALL_SQL)},
n AS (SELECT *, lag(y) OVER (PARTITION BY series_id ORDER BY k) AS l0 FROM sig),
c AS (SELECT *, sum(CASE WHEN l0 = y THEN 0 ELSE 1 END) OVER (PARTITION BY series_id ORDER BY k) AS run FROM n),
u AS (SELECT series_id, run, min(k) AS k0, max(k) AS k1, any_value(y) AS y FROM c GROUP BY 1, 2),
v AS (SELECT *, lag(y) OVER (PARTITION BY series_id ORDER BY run) AS l0, lead(y) OVER (PARTITION BY series_id ORDER BY run) AS l1 FROM u),
a AS (SELECT series_id, (k0 + k1) // 2 AS k FROM v WHERE l0 < y AND l1 < y),
p AS (SELECT a.series_id, a.k + o.j AS k, max(o.g) AS v FROM a CROSS JOIN o GROUP BY 1, 2)
SELECT s.series_id, s.k, {r_sql("coalesce(p.v, 0e0)", 6, "value")} FROM sig s LEFT JOIN p ON p.series_id = s.series_id AND p.k = s.k WHERE s.series_id IN (SELECT series_id FROM a)""")
def window_place(spark, sf):
    """Windows at every peak of every series, on the whole axis of each, merged by their maximum."""
    signal = events(spark, sf)
    anchors = _with_length(detect.find_peaks(signal, "y").select("series_id", "k"), signal)
    return rounded(placement.window_place(SMALL, anchors, "length").select("series_id", "k", "value"), 6, "value")


@query(f"""WITH {sq.sums(SMALL_SQL, EVENTS)}, {sq.solved(2)}, c AS (SELECT DISTINCT j FROM o)
SELECT t.series_id, t.k, {r_sql("max(s.x0 + s.x1 * c.j)", 5, "value")} FROM s CROSS JOIN c JOIN sig t ON t.series_id = s.series_id AND t.k = s.k + c.j GROUP BY 1, 2""")
def trajectory_place(spark, sf):
    """Fitted lines at all samples, on the whole axis of each series; the largest stays where they overlap."""
    e, signal = Estimator(SMALL), events(spark, sf)
    anchors = _with_length(signal.select("series_id", "k"), signal)
    return rounded(placement.trajectory_place(SMALL, e.minimize_x(e.filter(signal)), anchors, "length", fill_value=None).select("series_id", "k", "value"), 5, "value")


@query("SELECT segment, j, round(w, 9) + 0.0 AS weight FROM (SELECT '0' AS segment, j, pow(10e0 / 9e0, j) AS w FROM (SELECT unnest(range(-5, 0)) AS j) UNION ALL SELECT '1', j, pow(9e0 / 10e0, j) FROM (SELECT unnest(range(0, 6)) AS j))")
def window_eval(spark, sf):
    return rounded(placement.window_eval(spark, SMALL), 9, "weight")


# polynomials over numbers of the tables

P, Q = pl.Poly([1.0, 3.0, 5.0], [0, 1, 2]), pl.Poly([2.0, -1.0], [0, 1])


@query("""SELECT p_partkey, round(1 + 3*x + 5*x*x, 6) + 0.0 AS p, round(3 + 2*x + 5*x*x, 6) + 0.0 AS p_sum, round((1 + 3*x + 5*x*x) * (2 - x), 6) + 0.0 AS p_prod,
round(pow(1 + 3*x + 5*x*x, 2), 5) + 0.0 AS p_square, round(1 + 3*(x + 0.5) + 5*(x + 0.5)*(x + 0.5), 6) + 0.0 AS p_shift, round(1 + 6*x + 20*x*x, 6) + 0.0 AS p_dilation,
round(x + 1.5*x*x + 5.0/3*x*x*x, 6) + 0.0 AS p_int, round(3 + 10*x, 6) + 0.0 AS p_diff FROM (SELECT p_partkey, p_retailprice / 1000 AS x FROM part)""")
def poly_calculus(spark, sf):
    """Univariate calculus on polynomial columns."""
    x, p, q = F.col("x"), pl.col_poly(P.coef, P.expo), pl.col_poly(Q.coef, Q.expo)
    made = {"p": p, "p_sum": pl.col_sum(p, q), "p_prod": pl.col_merged(pl.col_prod(p, q)), "p_square": pl.col_square(p), "p_shift": pl.col_shift(p, F.lit(0.5)), "p_dilation": pl.col_dilation(p, F.lit(2.0)), "p_int": pl.col_int(p), "p_diff": pl.col_diff(p)}
    own = table(spark, sf, "part").select("p_partkey", (F.col("p_retailprice") / 1000).alias("x"))
    return own.select("p_partkey", *[(F.round(pl.col_eval(c, x), 5 if n == "p_square" else 6) + F.lit(0.0)).alias(n) for n, c in made.items()])


MP = pl.MPoly(([1.0, 2.0], [3.0, -1.0, 0.5]), ([0, 1], [0, 1, 2]))


@query("""SELECT l_orderkey, l_linenumber, round((1+2*u)*(3-v+0.5*v*v), 9) + 0.0 AS m, round((u+u*u)*(3-v+0.5*v*v), 9) + 0.0 AS m_int, round((1+2*u)*(v-1), 9) + 0.0 AS m_diff,
round(pow((1+2*u)*(3-v+0.5*v*v), 2), 9) + 0.0 AS m_square, round((1+2*u)*(6-2+4e0/3), 9) + 0.0 AS m_def_int, round((1+2*u)*2.625, 9) + 0.0 AS m_substitute,
round((1+6*u)*(3-v+0.5*v*v), 9) + 0.0 AS m_dilate, round(1+3*(u+v)+5*(u+v)*(u+v), 9) + 0.0 AS m_shift, round(1+3*u*v+5*u*v*u*v, 9) + 0.0 AS m_dilate_ind, round(1+3*u+5*u*u+2-v, 9) + 0.0 AS m_add
FROM (SELECT l_orderkey, l_linenumber, l_quantity / 50 AS u, l_discount * 10 AS v FROM lineitem)""")
def mpoly_calculus(spark, sf):
    """Multivariate calculus: literal coefficients over two columns."""
    u, v = F.col("u"), F.col("v")

    def value(p: pl.MPoly, *x) -> F.Column:
        terms = []
        for at, c in np.ndenumerate(p.tensor):
            t = F.lit(float(c))
            for var, e, i in zip(x, p.expos, at, strict=True):
                for _ in range(int(e[i])):
                    t = t * var
            terms.append(t)
        out = terms[0]
        for t in terms[1:]:
            out = out + t
        return out

    made = {
        "m": value(MP, u, v),
        "m_int": value(pl.mpoly_int(MP, 0), u, v),
        "m_diff": value(pl.mpoly_diff(MP, 1), u, v),
        "m_square": value(pl.mpoly_square(MP), u, v),
        "m_def_int": value(pl.mpoly_def_int(MP, 1, 0, 2), u),
        "m_substitute": value(pl.mpoly_substitute(MP, 1, 0.5), u),
        "m_dilate": value(pl.mpoly_dilate(MP, 0, 3), u, v),
        "m_shift": value(pl.mpoly_shift(P), u, v),
        "m_dilate_ind": value(pl.mpoly_dilate_ind(P), u, v),
        "m_add": value(pl.mpoly_add(P, Q), u, v),
    }
    own = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 50).alias("u"), (F.col("l_discount") * 10).alias("v"))
    return own.select("l_orderkey", "l_linenumber", *[(F.round(c, 9) + F.lit(0.0)).alias(n) for n, c in made.items()])


# generators

N = 500


@query(f"""SELECT k, round(sin(2*pi()*k*({N}/50.0)/{N - 1}) + 0.5*sin(2*pi()*(k-3)*({N}/20.0)/{N - 1}), 8) + 0.0 AS sine, round(pow(0.99, k - 5), 8) + 0.0 AS expo,
CASE WHEN (k + 7) % 40 < 10 THEN 1.0 ELSE 0.0 END::DOUBLE AS rect, round((k % 25) / 25.0 - 0.5, 8) + 0.0 AS saw, round(0.5 - abs(k % 25 - 12.5) / 12.5, 8) + 0.0 AS tri,
CASE WHEN k IN (3, 99) THEN 1.0 ELSE 0.0 END::DOUBLE AS pulse, (CASE WHEN k >= 10 THEN 2.0 ELSE 0.0 END - CASE WHEN k >= 200 THEN 0.5 ELSE 0.0 END)::DOUBLE AS steps,
round(CASE WHEN k <= 10 THEN 1.0 WHEN k <= 110 THEN 1 + (k - 10) * 0.02 WHEN k <= 210 THEN 3 - (k - 110) * 0.01 ELSE 2.0 END::DOUBLE, 8) + 0.0 AS slopes FROM (SELECT unnest(range({N})) AS k)""")
def generators(spark, sf):
    """All deterministic generators, joined on k."""
    out = gen.gen_sine(spark, N, [50, 20], [1.0, 0.5], [0, 3]).withColumnRenamed("y", "sine")
    for name, df in {
        "expo": gen.gen_exp(spark, N, 0.99, 5),
        "rect": gen.gen_rect(spark, N, 40, 10, k0=7),
        "saw": gen.gen_saw(spark, N, 25),
        "tri": gen.gen_tri(spark, N, 25),
        "pulse": gen.gen_pulse(spark, N, [3, 99, 99]),
        "steps": gen.gen_steps(spark, N, [10, 200], [2.0, -0.5]),
        "slopes": gen.gen_slopes(spark, N, [10, 110, 210], [1.0, 2.0, -1.0]),
    }.items():
        out = out.join(df.withColumnRenamed("y", name), "k")
    return rounded(out, 8, "sine", "expo", "saw", "tri", "slopes")


@query(f"""WITH sig AS ({DAILY}), t(j, v) AS (VALUES (-1, 0.25), (0, 0.5), (1, 0.25))
SELECT a.series_id, a.k, round(coalesce(sum(b.y * t.v), 0), 6) + 0.0 AS y FROM sig a CROSS JOIN t LEFT JOIN sig b ON b.k = a.k - t.j GROUP BY 1, 2""")
def generator_convolution(spark, sf):
    """Daily totals convolved with a short template."""
    return rounded(gen.gen_conv(daily(spark, sf), [0.25, 0.5, 0.25], ("series_id",)), 6, "y")


DRAW = lambda seed, stream: f"((('0x' || substr(md5('{seed}:{stream}:' || k::VARCHAR), 1, 13))::BIGINT + 0.5) / 4503599627370496e0)"


@query(f"""WITH t AS (SELECT unnest(range({N})) AS k), p AS (SELECT k FROM t ORDER BY {DRAW(3, 0)}, k LIMIT 5),
b AS (SELECT p.k + d AS k, count(*) AS n FROM p, (SELECT unnest(range(-3, 4)) AS d) GROUP BY 1)
SELECT t.k, round(0.5 * sqrt(-2 * ln({DRAW(1, 0)})) * cos(2 * pi() * {DRAW(1, 1)}), 8) + 0.0 AS noise,
round(sum(CASE WHEN {DRAW(2, 0)} < 0.5 THEN -1 ELSE 1 END * {DRAW(2, 1)}) OVER (ORDER BY t.k), 8) + 0.0 AS walk, coalesce(b.n, 0)::DOUBLE AS pulses FROM t LEFT JOIN b ON b.k = t.k""".replace("|| k::VARCHAR", "|| t.k::VARCHAR"))
def random_generators(spark, sf):
    """Seeded noise, walk and pulses; draws are digests, so SQL makes the same."""
    a = gen.gen_wgn(spark, N, 0.5, 1).withColumnRenamed("y", "noise")
    b = gen.gen_rand_walk(spark, N, 2).withColumnRenamed("y", "walk")
    c = gen.gen_rand_pulse(spark, N, 5, 7, 3).withColumnRenamed("y", "pulses")
    return rounded(a.join(b, "k").join(c, "k"), 8, "noise", "walk")


@query(f"WITH {sq.sums([sq.Part(-21, -1, sq.forward(100), LINES)], EVENTS)} SELECT series_id, k, {r_sql('xi0', 5, 'xi0')}, {r_sql('xi1 / 10', 5, 'xi1')} FROM f")
def benchmark_window(spark, sf):
    """Degree 1 over [-21, -1], the window of the speed definition; xi only."""
    f = Estimator(costs.CostSegment(models.AlssmPoly(1), Segment(-21, -1, "fw", 100)), calc=("xi",)).filter(events(spark, sf))
    return f.select("series_id", "k", (F.round(F.col("xi")[0], 5) + F.lit(0.0)).alias("xi0"), (F.round(F.col("xi")[1] / 10, 5) + F.lit(0.0)).alias("xi1"))


TWO_SIDED = costs.CompositeCost([models.AlssmPoly(1)], [Segment(-10, -1, "fw", 20), Segment(0, 10, "bw", 20)], np.ones((1, 2)))


def _truncated_sql() -> str:
    """The 2 x 2 normal equations of every truncated window in closed form; at the minimum J = kappa - xi'x."""
    return f"""WITH sig AS ({EVENTS}), {sq.window([sq.Part(-10, -1, sq.forward(20), LINES), sq.Part(0, 10, sq.backward(20), LINES)])},
f AS (SELECT a.series_id, a.k, sum(b.y * b.y * o.g) AS kappa, sum(b.y * o.g) AS p, sum(b.y * o.g * o.j) AS q,
             sum(CASE WHEN b.y IS NOT NULL THEN o.g END) AS w00, sum(CASE WHEN b.y IS NOT NULL THEN o.g * o.j END) AS w01, sum(CASE WHEN b.y IS NOT NULL THEN o.g * o.j * o.j END) AS w11
      FROM sig a CROSS JOIN o LEFT JOIN sig b ON b.series_id = a.series_id AND b.k = a.k + o.j GROUP BY a.series_id, a.k),
x AS (SELECT *, (w11 * p - w01 * q) / (w00 * w11 - w01 * w01) AS x0, (w00 * q - w01 * p) / (w00 * w11 - w01 * w01) AS x1 FROM f)
SELECT series_id, k, {r_sql("x0", 5, "y_hat")}, {r_sql("kappa - p * x0 - q * x1", 5, "J")} FROM x"""


@query(_truncated_sql())
def timevarying_fit(spark, sf):
    """A line over truncated windows with a pseudo-inverse for every sample."""
    return _fit(TWO_SIDED, events(spark, sf), steady_state=False)


@query(f"WITH {sq.sums(SMALL_SQL, EVENTS)}, {sq.solved(2)} SELECT series_id, k, fraction, {r_sql('x0 + fraction * x1', 5, 'y_hat')} FROM s CROSS JOIN (VALUES (0e0), (0.25e0), (0.5e0), (0.75e0)) t(fraction)")
def oversampling(spark, sf):
    """The fitted line between samples."""
    e = Estimator(SMALL)
    out = detect.oversampled(e, e.minimize_x(e.filter(events(spark, sf))), [0.0, 0.25, 0.5, 0.75])
    return rounded(out.select("series_id", "k", "fraction", "y_hat"), 5, "y_hat")


@query("SELECT i, j, round(sum(pow(19e0 / 20e0, t) * pow(t, i + j)), 6) + 0.0 AS w FROM (SELECT unnest(range(3))::INTEGER AS i), (SELECT unnest(range(3))::INTEGER AS j), (SELECT unnest(range(-10, 11)) AS t) GROUP BY i, j")
def steady_state_gram(spark, sf):
    """The Gram matrix of a parabola over a window, as a table."""
    w = gram.gram(models.AlssmPoly(2), Segment(-10, 10, "bw", 20), "closed_form")
    return rounded(spark.createDataFrame([(i, j, float(w[i, j])) for i in range(3) for j in range(3)], "i int, j int, w double"), 6, "w")


@query(f"WITH sig AS ({EVENTS}) SELECT a.series_id, a.k, round(coalesce(sum(b.y), 0), 6) + 0.0 AS total FROM sig a LEFT JOIN sig b ON b.series_id = a.series_id AND b.k BETWEEN a.k - 3 AND a.k + 4 GROUP BY 1, 2")
def plain_windowed_sum(spark, sf):
    """The bare windowed sum, without a cost."""
    t = Term("total", np.ones((1, 1)), np.ones(1), "y", -3, 4, 1.0, 0)
    out = windowed_sums(events(spark, sf), [t], ["series_id"])
    return out.select("series_id", "k", (F.round(F.col("total")[0], 6) + F.lit(0.0)).alias("total"))


SHAPE, SHIFTS, STRETCHES = pl.Poly([1.0, -0.2, 0.05], [0, 1, 2]), [-3.0, -1.5, 0.0, 1.5, 3.0], [0.5, 1.0, 2.0]


def _shift_sql() -> str:
    """Template 1 - 0.2 u + 0.05 u^2 at u = stretch (x + shift): its coefficients c0 .. c2 in x by expansion; the metric's entries
    are integrals of x^(i + j) over [-5, 5]."""
    m = [[f"((pow(5, {i + k + 1}) - pow(-5, {i + k + 1})) / {i + k + 1}.0)" for k in range(3)] for i in range(3)]
    form = lambda p, q: " + ".join(f"{p}{i} * {q}{k} * {m[i][k]}" for i in range(3) for k in range(3))
    return f"""WITH {sq.sums(FIT2_SQL, EVENTS)}, {sq.solved(3)},
g AS (SELECT shift, stretch, 1 - 0.2 * stretch * shift + 0.05 * pow(stretch * shift, 2) AS c0, -0.2 * stretch + 0.1 * stretch * stretch * shift AS c1, 0.05 * stretch * stretch AS c2
      FROM (VALUES (-3e0), (-1.5e0), (0e0), (1.5e0), (3e0)) a(shift), (VALUES (0.5e0), (1e0), (2e0)) b(stretch)),
c AS (SELECT series_id, k, shift, stretch, {form('x', 'x')} AS own, {form('x', 'c')} AS along, {form('c', 'c')} AS norm FROM s CROSS JOIN g),
d AS (SELECT *, own - along * along / norm AS cost, along / norm AS amplitude FROM c)
SELECT series_id, k, {r_sql("min(cost)", 4, "cost")}, arg_min(shift, cost) AS shift, arg_min(stretch, cost) AS stretch, {r_sql("arg_min(amplitude, cost)", 4, "amplitude")} FROM d GROUP BY series_id, k"""


@query(_shift_sql())
def shift_estimation(spark, sf):
    """Shift, stretch and amplitude at which a template polynomial is nearest to each local fit."""
    e = Estimator(FIT2)
    f = localized.best_match(e.minimize_x(e.filter(events(spark, sf))), "x", 3, SHAPE, (-5, 5), SHIFTS, STRETCHES)
    return rounded(f.select("series_id", "k", "match.cost", "match.shift", "match.stretch", "match.amplitude"), 4, "cost", "amplitude")
