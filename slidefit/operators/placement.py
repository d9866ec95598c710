"""Windows and trajectories: evaluated by offset, or placed at anchors on the samples' axis and merged by their maximum."""

from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as la


def _axes(cost) -> list:
    return list(getattr(cost, "cost_terms", None) or [cost])


def _offset_names(cost) -> list[str]:
    n = len(_axes(cost))
    return ["j"] if n == 1 else [f"j{d}" for d in range(n)]


def _windows(df: DataFrame, cost, segment_indices=None, thd: float = 1e-6) -> DataFrame:
    """df times every offset of every segment (for several axes, of every combination): segment, j..., weight. Offsets are made by
    the engine, so windows may be of any length."""
    names, axes = _offset_names(cost), _axes(cost)
    for d, (c, name) in enumerate(zip(axes, names, strict=True)):
        chosen = range(len(c.segments)) if segment_indices is None else segment_indices
        rows = [(p, *c.segments[p].ab_range(thd), c.segments[p]) for p in chosen]
        own = F.array(*[F.struct(F.lit(str(p)).alias("p"), F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b"), F.lit(float(s.gamma)).alias("g"), F.lit(int(s.delta)).cast("long").alias("d")) for p, a, b, s in rows])
        df = df.withColumn(f"_s{d}", F.explode(own)).withColumn(name, F.explode(F.sequence(F.col(f"_s{d}.a"), F.col(f"_s{d}.b"))))
    weight = F.lit(1.0)
    for d, name in enumerate(names):
        weight = weight * F.pow(F.col(f"_s{d}.g"), F.col(name) - F.col(f"_s{d}.d"))
    parts = [f"_s{d}" for d in range(len(axes))]
    return df.withColumns({"segment": F.concat_ws("x", *[F.col(f"{p}.p") for p in parts]), "weight": weight}).drop(*parts)


def window_eval(spark: SparkSession, cost, segment_indices=None, thd: float = 1e-6) -> DataFrame:
    """One row for each offset and segment (combination): segment, j..., weight."""
    return _windows(spark.range(1), cost, segment_indices, thd).select("segment", *_offset_names(cost), "weight")


def _placed(at: DataFrame, names: list[str], order: list[str], lengths) -> DataFrame:
    """Anchors with offsets, moved to where they stand and clipped to [0, K)."""
    for o, n in zip(order, names, strict=True):
        at = at.withColumn(o, F.col(o) + F.col(n))
    for o, k in zip(order, lengths, strict=True):
        at = at.where((F.col(o) >= 0) & (F.col(o) < _length(k)))
    return at


#: Samples of an axis made at a time.
BLOCK = 1 << 16
#: Rows of a table of offsets up to which it is broadcast.
FEW = 1 << 16


def _with_rows(df: DataFrame, cost, F_, thd: float) -> DataFrame:  # noqa: N803
    """df times the literal output rows of every segment (combination); the table is broadcast where it is small."""
    rows = int(np.prod([sum(b - a + 1 for a, b in (s.ab_range(thd) for s in c.segments)) for c in _axes(cost)]))
    table = trajectory_table(df.sparkSession, cost, F_, thd)
    return df.join(F.broadcast(table) if rows <= FEW else table)


def _length(k):
    """A number, or the column of the anchors that holds each series' own."""
    return F.col(k) if isinstance(k, str) else F.lit(int(k))


def _length_columns(lengths) -> list[str]:
    return [k for k in lengths if isinstance(k, str)]


def window_place(cost, anchors: DataFrame, lengths, keys=("series_id",), order=("k",), merged_ks: bool = True, merged_seg: bool = True, segment_indices=None, thd: float = 1e-6, fill_value: float | None = 0.0) -> DataFrame:
    """Windows at anchors (keys..., order...): value at every sample, the largest where several meet.

    lengths: samples per axis, each a number or a column of the anchors (constant in a series). Unmerged results also have the anchor (anchor_...) or the segment. With a fill_value, merged
    results have a row for every sample of each series that has an anchor; with None, covered samples only.
    """
    keys, order = list(keys), list(order)
    lengths = [lengths] if np.isscalar(lengths) else list(lengths)
    marked = anchors.select(*keys, *order, *_length_columns(lengths), *[F.col(o).alias(f"anchor_{o}") for o in order])
    at = _placed(_windows(marked, cost, segment_indices, thd), _offset_names(cost), order, lengths)
    return _merged(at, F.col("weight"), keys, order, lengths, merged_ks, merged_seg, fill_value, anchors)


def _merged(at: DataFrame, value, keys, order, lengths, merged_ks, merged_seg, fill_value, anchors) -> DataFrame:
    by = [*keys, *order] + ([] if merged_ks else [f"anchor_{o}" for o in order]) + ([] if merged_seg else ["segment"])
    out = at.groupBy(*by).agg(F.max(value).alias("value"))
    if fill_value is None or not (merged_ks and merged_seg):
        return out
    spine = anchors.select(*keys, *_length_columns(lengths)).distinct()
    for o, k in zip(order, lengths, strict=True):  # an axis is made in pieces, so no array holds a whole one
        length, piece = _length(k).cast("long"), F.lit(BLOCK).cast("long")
        spine = spine.where(length > 0).withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), length - 1, piece)))
        spine = spine.withColumn(o, F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + piece, length) - 1))).drop("_from")
    return spine.drop(*_length_columns(lengths)).join(out, [*keys, *order], "left").withColumn("value", F.coalesce("value", F.lit(float(fill_value))))


def trajectory_table(spark: SparkSession, cost, F_=None, thd: float = 1e-6) -> DataFrame:  # noqa: N803
    """segment, j..., row: the literal output rows C A^j of every segment (combination)."""
    per_axis = []
    for c in _axes(cost):
        cells = c.cells() if F_ is None else type(c)(c.alssms, c.segments, F_).cells()
        rows = []
        for p, (model, s, _) in enumerate(cells):
            a, b = s.ab_range(thd)
            rows += [(p, j, np.ravel(model.output_row(j))) for j in range(a, b + 1)]
        per_axis.append(rows)
    out = []
    for rs in product(*per_axis):
        row = np.ones(1)
        for r in rs:
            row = np.kron(row, r[2])
        out.append(("x".join(str(r[0]) for r in rs), *[int(r[1]) for r in rs], [float(v) for v in row]))
    return spark.createDataFrame(out, f"segment string, {', '.join(f'{n} long' for n in _offset_names(cost))}, row array<double>")


def trajectory_eval(cost, states: DataFrame, x: str = "x", F_=None, thd: float = 1e-6) -> DataFrame:  # noqa: N803
    """states (with an array column x) times offsets: segment, j..., value."""
    return _with_rows(states, cost, F_, thd).withColumn("value", la.dot(F.col(x), F.col("row"))).drop("row")


def trajectory_place(cost, states: DataFrame, anchors: DataFrame, lengths, keys=("series_id",), order=("k",), x: str = "x", F_=None, merged_ks: bool = True, merged_seg: bool = True, fill_value: float | None = float("nan"), thd: float = 1e-6) -> DataFrame:  # noqa: N803
    """The trajectories of the states at anchors, placed on the samples' axis and merged by their maximum.

    states has the states of all samples, or of the anchors only: the join picks the anchors'.
    """
    keys, order = list(keys), list(order)
    lengths = [lengths] if np.isscalar(lengths) else list(lengths)
    own = states.join(anchors.select(*keys, *order, *_length_columns(lengths)).distinct(), [*keys, *order]).select(*keys, *order, x, *_length_columns(lengths), *[F.col(o).alias(f"anchor_{o}") for o in order])
    at = _placed(_with_rows(own, cost, F_, thd), _offset_names(cost), order, lengths)
    return _merged(at, la.dot(F.col(x), F.col("row")), keys, order, lengths, merged_ks, merged_seg, fill_value, anchors)
