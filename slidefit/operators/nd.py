"""N-dimensional separable fits: one windowed pass per axis; states are Kronecker products in the order of the passes.

The first axis turns the samples into states along it; each later axis sums the states of its neighbours, weighted, and
extends them by its own output row. Every pass is one exchange on the other axes; an axis is cut into blocks with a halo, so a
long one is spread over tasks. Short windows take a lag per offset, longer ones are doubled: S_2L[k] = S_L[k] + M^L S_L[k + L].
W is a literal Kronecker product, so the rest of the estimator is arithmetic on the xi column. Kappa is carried along the same way.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as la
from ..plans.models import power
from .estimator import Estimator
from .windowed import BLOCK, with_halo


#: Offsets from which on windows are doubled.
SHORT = 24


def _total(parts: list[Column]) -> Column:
    out = parts[0] if parts else F.lit(0.0)
    for c in parts[1:]:
        out = out + c
    return out


def _moved(c: str, j: int, n: int, w) -> Column:
    """The array of the sample j further on, zeros off the axis."""
    return F.col(c) if not j else F.coalesce(F.lead(c, j).over(w) if j > 0 else F.lag(c, -j).over(w), la.zeros(n))


def _by_offset(df: DataFrame, cost, n: int, w) -> DataFrame:
    """xi and kappa of one axis from a lag or lead per offset."""
    m = cost.get_alssm_order()
    rows, decay = {}, {}
    for model, s, beta in cost.cells():
        for j in range(int(s.a), int(s.b) + 1):
            g = beta * s.gamma ** (j - s.delta)
            rows[j] = rows.get(j, np.zeros(m)) + g * np.ravel(model.output_row(j))
            decay[j] = decay.get(j, 0.0) + g
    offsets = sorted(rows)
    out = df.withColumns({f"_x{i}": _moved("xi", j, n, w) for i, j in enumerate(offsets)} | {f"_k{i}": F.coalesce(F.lead("kappa", j).over(w) if j > 0 else F.lag("kappa", -j).over(w) if j else F.col("kappa"), F.lit(0.0)) for i, j in enumerate(offsets)})
    xi = [_total([F.col(f"_x{i}")[p] * F.lit(float(rows[j][q])) for i, j in enumerate(offsets) if rows[j][q]]) for p in range(n) for q in range(m)]
    kappa = _total([F.col(f"_k{i}") * F.lit(float(decay[j])) for i, j in enumerate(offsets)])
    return out.withColumns({"xi": F.array(*xi), "kappa": kappa})


def _blocked(c: str, matrix: np.ndarray, n: int) -> list[Column]:
    """The matrix applied to each of the n parts of an array."""
    m = len(matrix)
    return [_total([F.col(c)[p * m + r] * F.lit(float(v)) for r, v in enumerate(matrix[q]) if v]) for p in range(n) for q in range(m)]


def _by_doubling(df: DataFrame, cost, n: int, w) -> DataFrame:
    """xi and kappa of one axis from log2(length) windows; kappa is the sum of a model with one constant state."""
    out, parts = df.withColumn("_kappa", F.array("kappa")), {"xi": [], "kappa": []}
    count = 0
    for model, s, beta in cost.cells():
        for name, source, many, a, c in (("xi", "xi", n, model.A, np.ravel(model.C)), ("kappa", "_kappa", 1, np.eye(1), np.ones(1))):
            for low, high in [(int(s.a), int(s.b))] if s.a >= 0 or s.b <= 0 else [(int(s.a), -1), (0, int(s.b))]:
                ahead, m = low >= 0, len(c)
                step = s.gamma * a.T if ahead else power(a, -1).T / s.gamma
                offset, rest, size = low if ahead else -high, high - low + 1, 1
                column = f"_d{count}"
                out = out.withColumn(column, F.array(*[F.col(source)[p] * F.lit(float(v)) for p in range(many) for v in c]))
                while True:
                    if rest & 1:
                        count += 1
                        out = out.withColumn(f"_p{count}", _moved(column, offset if ahead else -offset, many * m, w))
                        parts[name].append(_blocked(f"_p{count}", beta * s.gamma**-s.delta * np.linalg.matrix_power(step, offset), many))
                        offset += size
                    rest >>= 1
                    if not rest:
                        break
                    count += 1
                    far = np.linalg.matrix_power(step, size)
                    out = out.withColumn("_m", _moved(column, size if ahead else -size, many * m, w))
                    moved = _blocked("_m", far, many)
                    out = out.withColumn(f"_d{count}", F.array(*[F.col(column)[i] + moved[i] for i in range(many * m)]))
                    column, size = f"_d{count}", 2 * size
                count += 1
    total = {name: [_total([p[i] for p in ps]) for i in range(len(ps[0]))] for name, ps in parts.items()}
    return out.withColumns({"xi": F.array(*total["xi"]), "kappa": total["kappa"][0]})


class NDEstimator(Estimator):
    """axes: the index columns, one for each cost term, each counting consecutive cells; dim_order: the order of the passes."""

    def __init__(self, cost, axes, keys=("series_id",), y: str = "y", w: str | None = None, dim_order=None, steady_state_method: str = "auto", block: int | None = BLOCK):
        if len(axes) != cost.L:
            raise ValueError(f"{cost.L} axes are needed, found {len(axes)}")
        super().__init__(cost, True, steady_state_method, keys, axes[0], y, w, block=block)
        self.axes, self.dim_order = list(axes), list(dim_order or range(cost.L))

    @property
    def W(self) -> np.ndarray:  # noqa: N802
        return self.cost.get_steady_state_W(self.dim_order, self.method)

    def filter(self, df: DataFrame) -> DataFrame:
        """df with xi and kappa; one windowed pass per axis."""
        weight = F.coalesce(F.col(self.w).cast("double"), F.lit(0.0)) if self.w else F.lit(1.0)
        y = F.coalesce(F.col(self.y).cast("double"), F.lit(0.0))
        out = df.withColumns({"xi": F.array(weight * y), "kappa": weight * y * y})
        n = 1
        for d in self.dim_order:
            cost, axis = self.cost.cost_terms[d], self.axes[d]
            cells = cost.cells()
            if not np.isfinite([v for _, s, _ in cells for v in (s.a, s.b)]).all():
                raise ValueError("axes take finite windows")
            before, after = max(0, int(-min(s.a for _, s, _ in cells))), max(0, int(max(s.b for _, s, _ in cells)))
            cut = with_halo(out, axis, max(self.block or BLOCK, 2 * (before + after)), before, after)
            w = Window.partitionBy(*self.keys, *[a for a in self.axes if a != axis], "_block").orderBy(axis)
            run = _by_offset if max(s.b - s.a for _, s, _ in cells) < SHORT else _by_doubling
            out = run(cut, cost, n, w).where("_own").select(*df.columns, "xi", "kappa")
            n *= cost.get_alssm_order()
        return out

    def eval_output(self, df: DataFrame, x: str = "x", name: str = "y_hat", weights=None, j: float = 0) -> DataFrame:
        return df.withColumn(name, la.dot_literal(F.col(x), self.cost.output_rows(weights, self.dim_order)))

    def convolve(self, df: DataFrame, xref, name: str = "c", over=()) -> DataFrame:
        out = self.filter(df).withColumn(name, la.dot_literal(F.col("xi"), np.ravel(xref)))
        return out if not over else out.groupBy(*[c for c in self.keys if c not in over], *self.axes).agg(F.sum(name).alias(name))
