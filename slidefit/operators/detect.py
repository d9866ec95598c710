"""Detection: cost ratios of hypotheses, peaks, templates, matched filters, multi-scale windows."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrays as la
from .windowed import BLOCK, with_halo


def _log_ratio(j1: Column, j0: Column, log) -> Column:
    """log(j1 / j0) of costs. A cost that isn't positive counts as zero: rounding may leave a perfect fit just under it. With
    both zero neither side is preferred; one alone gives an infinity; null stays null."""
    one, other = F.lit(float("-inf")), F.lit(float("inf"))
    return F.when((j1 <= 0) & (j0 <= 0), 0.0).when(j1 <= 0, one).when(j0 <= 0, other).otherwise(log(F.try_divide(j1, j0)))


def lcr(j0: Column, j1: Column) -> Column:
    """Log-cost ratio -1/2 ln(J1 / J0): how much better hypothesis 1 explains the window. 0 if both costs are zero."""
    return _log_ratio(j1, j0, F.log) * -0.5


def lcr10(j0: Column, j1: Column) -> Column:
    """The base-10 form with the operands as -1/2 log10(J1 / J0)."""
    return _log_ratio(j1, j0, F.log10) * -0.5


def hypotheses(estimator, df: DataFrame, H1, H0, h1=None, h0=None, name: str = "lcr") -> DataFrame:  # noqa: N803
    """Both hypotheses on one filter pass: columns x1, x0, J1, J0 and their ratio."""
    out = estimator.minimize_x(df, H1, h1, name="x1")
    out = estimator.minimize_x(out, H0, h0, name="x0")
    out = estimator.eval_errors(estimator.eval_errors(out, "x1", "J1"), "x0", "J0")
    return out.withColumn(name, lcr(F.col("J0"), F.col("J1")))


def zeroed(x: Column, n: int, indices) -> Column:
    """A state with some entries set to 0: the hypothesis without a sub-model."""
    drop = set(indices)
    return F.array(*[F.lit(0.0) if i in drop else x[i] for i in range(n)])


def shape_match(estimator, df: DataFrame, template, H=None, name: str = "match") -> DataFrame:  # noqa: N803
    """J_0 / J_A: the cost of no signal over the cost of a template scaled (or H with the template as its offset). 1 if both are
    zero, infinite if the template alone leaves none."""
    template = np.ravel(np.asarray(template, float))
    basis, offset = (template[:, None], None) if H is None else (H, template)
    out = estimator.eval_errors(estimator.minimize_x(df, basis, offset, name="x_template"), "x_template", "J_A")
    none, left = F.col("kappa") <= 0, F.col("J_A") <= 0
    return out.withColumn(name, F.when(none & left, 1.0).when(left, float("inf")).otherwise(F.try_divide("kappa", "J_A")))


def known_shape(estimator, df: DataFrame, shape, name: str = "lcr") -> DataFrame:
    """A shape of fixed states (the first len(shape) ones) on what the other states explain, against those alone: x1, x0, J1, J0
    and -1/2 ln(J1 / J0). x0 keeps the other states of x1, so the ratio tells what the shape itself brings."""
    shape, n = np.ravel(np.asarray(shape, float)), estimator.n
    free = np.eye(n)[:, len(shape) :]
    out = estimator.minimize_x(df, free, np.concatenate([shape, np.zeros(n - len(shape))]), name="x1")
    out = out.withColumn("x0", zeroed(F.col("x1"), n, range(len(shape))))
    out = estimator.eval_errors(estimator.eval_errors(out, "x1", "J1"), "x0", "J0")
    return out.withColumn(name, lcr(F.col("J0"), F.col("J1")))


def argmax(df: DataFrame, score: str, keys=("series_id",), order: str = "k") -> DataFrame:
    """Per series the sample of the largest score; NaN and null scores don't count, the first wins ties."""
    s = F.when(~F.isnan(score), F.col(score))
    best = F.max(F.when(s.isNotNull(), F.struct(s.alias("s"), (-F.col(order)).alias("o"))))
    return df.groupBy(*keys).agg(best.alias("b")).select(*keys, (-F.col("b.o")).alias(order), F.col("b.s").alias(score))


def find_peaks(df: DataFrame, score: str, height: float | None = None, distance: int | None = None, keys=("series_id",), order: str = "k", block: int = BLOCK) -> DataFrame:
    """Local maxima (a plateau counts once, at its middle, rounded down) of at least height; of two nearer than distance
    the higher stays. Samples are compared with their neighbours in blocks; only ends of plateaus and candidates meet by series,
    and for the distance rule, which depends on order, by groups of candidates without a gap of distance between them.

    The order column counts 0, 1, 2, ...; ends of a series are no peaks. Nulls and NaN are below everything.
    """
    keys = list(keys)
    value = F.when(F.col(score).isNull() | F.isnan(score), F.lit(float("-inf"))).otherwise(F.col(score))
    rows = with_halo(df.select(*keys, order, value.alias("_v")), order, max(block, 4), 1, 1)
    w = Window.partitionBy(*keys, "_block").orderBy(order)
    near = rows.withColumns({"_l": F.lag("_v").over(w), "_r": F.lead("_v").over(w)}).where("_own").select(*keys, order, "_v", "_l", "_r")
    alone = near.where("_l < _v and _r < _v").select(*keys, F.col(order).cast("long").alias(order), F.col("_v").alias(score))
    # a plateau's first and last samples follow one another
    ends = near.withColumns({"_from": (F.col("_l").isNull() | (F.col("_l") != F.col("_v"))) & (F.col("_r") == F.col("_v")), "_to": (F.col("_l") == F.col("_v")) & (F.col("_r").isNull() | (F.col("_r") != F.col("_v")))}).where("_from or _to")
    e = Window.partitionBy(*keys).orderBy(order)
    flat = ends.withColumns({"_end": F.lead(order).over(e), "_falls": F.lead(F.coalesce(F.col("_r") < F.col("_v"), F.lit(False))).over(e)}).where("_from and _l < _v and _falls")
    peaks = alone.unionByName(flat.select(*keys, F.floor((F.col(order) + F.col("_end")) / 2).cast("long").alias(order), F.col("_v").alias(score)))
    if height is not None:
        peaks = peaks.where(F.col(score) >= height)
    if distance is None or distance <= 1:
        return peaks
    schema, columns = peaks.schema, peaks.columns

    def suppress(frame: pd.DataFrame) -> pd.DataFrame:
        f = frame.sort_values(order, kind="stable").reset_index(drop=True)
        at, high = f[order].to_numpy(), f[score].to_numpy()
        keep = np.ones(len(f), bool)
        for i in np.argsort(high, kind="stable")[::-1]:
            if keep[i]:
                lo, hi = np.searchsorted(at, [at[i] - distance + 1, at[i] + distance])
                keep[lo:hi] = False
                keep[i] = True
        return f[keep]

    apart = (F.col(order) - F.lag(order).over(e) >= distance).cast("int")
    grouped = peaks.withColumn("_new", F.coalesce(apart, F.lit(0))).withColumn("_group", F.sum("_new").over(e))
    return grouped.groupBy(*keys, "_group").applyInPandas(lambda f: suppress(f)[columns], schema)


def energy(df: DataFrame, j_columns, channel: str, keys=("series_id",), order: str = "k") -> DataFrame:
    """Costs summed over channels, for ratios of multi-channel hypotheses."""
    by = [k for k in keys if k != channel]
    return df.groupBy(*by, order).agg(*[F.sum(c).alias(c) for c in j_columns])


def channel_covariance(df: DataFrame, channel: str, order: str = "k", y: str = "y", keys=()) -> np.ndarray:
    """Sample covariance between channels, in their order, over the samples at which both have a value: partial sums of products
    by Arrow batch, added up by Spark; an M x M matrix comes to the driver."""
    names = [r[0] for r in df.select(channel).distinct().orderBy(channel).collect()]
    m = len(names)
    wide = df.groupBy(*keys, order).pivot(channel, names).agg(F.first(y)).select(*[F.col(f"`{n}`").cast("double") for n in names])

    def partial(batches):
        sums = np.zeros((4, m, m))
        for b in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns], 1)
            has = ~np.isnan(x)
            x, one = np.where(has, x, 0.0), has.astype(float)
            sums += [one.T @ one, x.T @ one, one.T @ x, x.T @ x]
        i, j = np.divmod(np.arange(m * m), max(m, 1))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (i.astype(np.int32), j.astype(np.int32), *sums.reshape(4, -1))], names=["i", "j", "n", "si", "sj", "sij"])

    total = wide.mapInArrow(partial, "i int, j int, n double, si double, sj double, sij double").groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "si", "sj", "sij")]).toPandas()
    out = np.full((m, m), np.nan)
    some = total[total["n"] > 1]
    out[some["i"], some["j"]] = (some["sij"] - some["si"] * some["sj"] / some["n"]) / (some["n"] - 1)
    return out


def matched_filter(estimator, df: DataFrame, template, covariance, channel: str, name: str = "c") -> DataFrame:
    """Templates (channels x N) whitened by the inverse channel covariance, correlated and summed over channels."""
    return estimator.convolve(df, np.linalg.pinv(covariance) @ np.asarray(template, float), name, over=(channel,))


def _moved(df: DataFrame, steps: dict[str, int], xi: str, n: int, keys, order: str, block: int) -> DataFrame:
    """df with the states of other samples, zeros off the series; series are cut into blocks with a halo."""
    before, after = max(0, -min(steps.values())), max(0, max(steps.values()))
    cut = with_halo(df, order, max(block, 2 * (before + after)), before, after)
    w = Window.partitionBy(*keys, "_block").orderBy(order)
    return cut.withColumns({c: F.coalesce(F.lead(xi, s).over(w) if s > 0 else F.lag(xi, -s).over(w), la.zeros(n)) for c, s in steps.items()}).where("_own").drop("_block", "_own")


def double_window(df: DataFrame, transition, gamma: float, length: int, xi: str = "xi", keys=("series_id",), order: str = "k", name: str | None = None, block: int = BLOCK) -> DataFrame:
    """xi over twice the window: xi[k] + gamma^L (A^L)' xi[k + L], for windows that start at offset 0 or later."""
    a = np.linalg.matrix_power(np.asarray(transition, float), length)
    n, far = len(a), gamma**length * a.T
    out = _moved(df, {"_far": length}, xi, n, keys, order, block)
    return out.withColumn(name or xi, F.array(*[F.col(xi)[i] + la.dot_literal(F.col("_far"), far[i]) for i in range(n)])).drop("_far")


def double_centred_window(df: DataFrame, transition, gamma: float, length: int, xi: str = "xi", keys=("series_id",), order: str = "k", name: str | None = None, block: int = BLOCK) -> DataFrame:
    """xi over [-L, L - 1] from that over [-L/2, L/2 - 1]: the window moved by half its length to either side."""
    if length % 2:
        raise ValueError("a centred window has an even length")
    half = length // 2
    a = np.linalg.matrix_power(np.asarray(transition, float), half)
    n, right, left = len(a), gamma**half * a.T, gamma**-half * np.linalg.inv(a).T
    out = _moved(df, {"_right": half, "_left": -half}, xi, n, keys, order, block)
    return out.withColumn(name or xi, F.array(*[la.dot_literal(F.col("_right"), right[i]) + la.dot_literal(F.col("_left"), left[i]) for i in range(n)])).drop("_right", "_left")


def double_gram(W, transition, gamma: float, length: int) -> np.ndarray:  # noqa: N803
    """W over twice the window."""
    a = np.linalg.matrix_power(np.asarray(transition, float), length)
    return np.asarray(W) + gamma**length * a.T @ W @ a


def oversampled(estimator, df: DataFrame, fractions, x: str = "x") -> DataFrame:
    """The model between samples: rows (.., fraction, y_hat) for fractional offsets; transitions by their eigenvectors or, if
    those don't span (polynomials), by the logarithm's series."""
    rows = []
    for f in fractions:
        row = [np.ravel(m.C @ fractional_power(m.A, float(f))) for m in estimator.cost.get_alssms()]
        rows.append((float(f), [float(v) for v in np.concatenate(row)]))
    table = df.sparkSession.createDataFrame(rows, T.StructType([T.StructField("fraction", T.DoubleType()), T.StructField("row", T.ArrayType(T.DoubleType()))]))
    # a row for each fraction that was asked for
    return df.join(F.broadcast(table) if len(rows) <= 1 << 16 else table).withColumn("y_hat", la.dot(F.col(x), F.col("row"))).drop("row")


def fractional_power(a: np.ndarray, p: float) -> np.ndarray:
    """A^p: for unipotent A the finite binomial series, otherwise by eigenvalues."""
    n = len(a)
    d = a - np.eye(n)
    if np.allclose(np.linalg.matrix_power(d, n), 0, atol=1e-9):
        out, term = np.eye(n), np.eye(n)
        for k in range(1, n):
            term = term @ d * (p - k + 1) / k
            out = out + term
        return out
    values, vectors = np.linalg.eig(a)
    return np.real(vectors * values.astype(complex) ** p @ np.linalg.inv(vectors))


def whitening(W) -> np.ndarray:  # noqa: N803
    """P with P^-T W P^-1 = I: in states P x the steady Gram matrix is the identity."""
    return np.linalg.cholesky(np.asarray(W)).T
