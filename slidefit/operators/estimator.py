"""Windowed weighted least squares of state-space models at every sample.

filter gives xi, kappa, nu and, unless steady, W; minimize solves for states, freely or on x = H v + h; eval_errors gives
the cost of given states. In the steady form W is one literal matrix for all samples, so minimization is arithmetic on the
xi column inside the plan (xi and kappa still see the truncated signal near its ends, which draws estimates to 0 there).
In the time-varying form W is a column and the solves run on Arrow batches.
"""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrays as la
from ..plans.gram import WConditionNumberWarning
from .windowed import BLOCK, Term, windowed_sums

SOLVERS = ("lstsq", "solve", "inv")
OUTPUTS = ("y_hat", "x", "v")


def terms_of(cost, value, weight: str, energy: str, steady: bool, calc=("xi", "kappa", "nu", "W")) -> list[Term]:
    """The windowed sums of a 1-D cost. value: a column for a scalar output, or one column for each output row."""
    out = []
    for model, s, beta in cost.cells():
        common = {"a": s.a, "b": s.b, "gamma": s.gamma, "delta": s.delta, "scale": beta}
        rows = model.rows()
        if "xi" in calc:
            out += [Term("xi", model.A, r, v, **common) for r, v in zip(rows, [value] if isinstance(value, str) else value, strict=True)]
        if "W" in calc and not steady:
            out.append(Term("W", np.kron(model.A, model.A), sum(np.kron(r, r) for r in rows), weight, **common))
        one = np.ones((1, 1))
        if "kappa" in calc:
            out.append(Term("kappa", one, np.ones(1), energy, **common))
        if "nu" in calc:
            out.append(Term("nu", one, np.ones(1), weight, **common))
    return out


class Estimator:
    """A cost with its switches.

    y: a double column, or an array<double> column for models with several outputs. keys: the columns of a series (channels
    of a set are further keys). w: sample weights, 1 if not given. dense, block and strategy: see windowed_sums.
    """

    def __init__(self, cost, steady_state: bool = True, steady_state_method: str = "auto", keys=("series_id",), order: str = "k", y: str = "y", w: str | None = None, strategy: str = "auto", dense: bool = True, block: int | None = BLOCK, calc=("xi", "kappa", "nu", "W")):
        self.cost, self.steady, self.keys, self.order, self.y, self.w = cost, steady_state, list(keys), order, y, w
        self.strategy, self.dense, self.block, self.calc, self.method = strategy, dense, block, tuple(calc), steady_state_method
        self.n = cost.get_alssm_order()
        self._pinv: dict[bytes, np.ndarray] = {}

    @property
    def W(self) -> np.ndarray:  # noqa: N802
        """The steady-state Gram matrix."""
        return self.cost.get_steady_state_W(method=self.method)

    def filter(self, df: DataFrame) -> DataFrame:
        """df with xi (array), kappa, nu (doubles) and, unless steady, W (array of rows). Nulls weigh nothing."""
        q = self.cost.get_alssm_output_dimension()
        y = F.col(self.y)
        weight = F.coalesce(F.col(self.w).cast("double"), F.lit(0.0)) if self.w else F.lit(1.0)
        weight = F.when(y.isNull(), 0.0).otherwise(weight)
        if q:
            values = {f"_v{i}": weight * F.coalesce(y[i], F.lit(0.0)) for i in range(q)}
            energy = weight * la.total(F.transform(F.coalesce(y, la.zeros(q)), lambda z: z * z))
        else:
            values = {"_v0": weight * F.coalesce(y.cast("double"), F.lit(0.0))}
            energy = values["_v0"] * F.coalesce(y.cast("double"), F.lit(0.0))
        ready = df.withColumns({**values, "_w": weight, "_e": energy})
        terms = terms_of(self.cost, list(values) if q else "_v0", "_w", "_e", self.steady, self.calc)
        out = windowed_sums(ready, terms, self.keys, self.order, self.strategy, self.dense, self.block)
        done = [F.col(c) for c in df.columns]
        if "xi" in self.calc:
            done.append(F.col("xi"))
        done += [F.col(c)[0].alias(c) for c in ("kappa", "nu") if c in self.calc]
        if "W" in self.calc and not self.steady:
            done.append(F.array(*[F.slice("W", self.n * i + 1, self.n) for i in range(self.n)]).alias("W"))
        return out.select(*done)

    def _projection(self, H, h) -> tuple[np.ndarray, np.ndarray]:  # noqa: N803
        H = np.eye(self.n) if H is None else np.asarray(H, float)  # noqa: N806
        h = np.zeros(self.n) if h is None else np.ravel(np.asarray(h, float))
        if H.ndim != 2 or len(H) != self.n or len(h) != self.n:
            raise ValueError(f"H must have {self.n} rows and h {self.n} entries")
        return H, h

    def solution(self, H=None, h=None, solver: str = "lstsq") -> tuple[np.ndarray, np.ndarray]:  # noqa: N803
        """v = G xi + g in the steady form."""
        if solver not in SOLVERS:
            raise ValueError(f"solver must be one of {SOLVERS}")
        H, h = self._projection(H, h)  # noqa: N806
        W = self.W  # noqa: N806
        inner = H.T @ W @ H
        if len(inner) and not np.linalg.cond(inner) < 1 / np.finfo(float).eps:
            warnings.warn("H'WH is close to singular", WConditionNumberWarning, stacklevel=3)
        if solver == "lstsq":
            u, s, vt = np.linalg.svd(inner)
            keep = s > np.finfo(float).eps * len(s) * (s[0] if len(s) else 0)
            inverse = vt.T[:, keep] / s[keep] @ u.T[keep]
        else:
            inverse = np.linalg.inv(inner)
        return inverse @ H.T, -inverse @ H.T @ W @ h

    def minimize_v(self, df: DataFrame, H=None, h=None, solver: str = "lstsq", name: str = "v") -> DataFrame:  # noqa: N803
        """df (from filter) with the parameters that minimize the cost."""
        if self.steady:
            gain, constant = self.solution(H, h, solver)
            return df.withColumn(name, F.array(*[la.dot_literal(F.col("xi"), r) + F.lit(float(c)) for r, c in zip(gain, constant, strict=True)]))
        return self._solved(df, H, h, solver, name)

    def _solved(self, df: DataFrame, H, h, solver: str, name: str) -> DataFrame:  # noqa: N803
        if solver not in SOLVERS:
            raise ValueError(f"solver must be one of {SOLVERS}")
        H, h = self._projection(H, h)  # noqa: N806
        n = self.n

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def solve(w: pd.Series, xi: pd.Series) -> pd.Series:
            if not len(w):
                return pd.Series([], dtype=object)
            g = np.array([np.concatenate(m) for m in w]).reshape(-1, n, n)
            right = (np.stack(xi.to_numpy()) - g @ h) @ H
            left = H.T @ g @ H
            if solver == "lstsq":
                out = np.einsum("kij,kj->ki", np.linalg.pinv(left, rcond=np.finfo(float).eps * left.shape[-1], hermitian=True), right)
            else:
                fit = np.linalg.cond(left) < 1 / np.finfo(float).eps
                out = np.full(right.shape, np.nan)
                out[fit] = np.linalg.solve(left[fit], right[fit][..., None])[..., 0]
                if solver == "solve":  # rows that can't be solved get the smallest least-squares solution
                    out[~fit] = np.einsum("kij,kj->ki", np.linalg.pinv(left[~fit], hermitian=True), right[~fit])
            return pd.Series(list(out))

        return df.withColumn(name, solve("W", "xi"))

    def minimize_x(self, df: DataFrame, H=None, h=None, solver: str = "lstsq", name: str = "x") -> DataFrame:  # noqa: N803
        """df with the states x = H v + h that minimize the cost."""
        H, h = self._projection(H, h)  # noqa: N806
        if self.steady:
            gain, constant = self.solution(H, h, solver)
            gain, constant = H @ gain, H @ constant + h
            return df.withColumn(name, F.array(*[la.dot_literal(F.col("xi"), r) + F.lit(float(c)) for r, c in zip(gain, constant, strict=True)]))
        v = self._solved(df, H, h, solver, "_v")
        return v.withColumn(name, F.array(*[la.dot_literal(F.col("_v"), r) + F.lit(float(c)) for r, c in zip(H, h, strict=True)])).drop("_v")

    def errors(self, x: Column) -> Column:
        """J = x'Wx - 2 xi'x + kappa of a states column."""
        if self.steady:
            W, parts = self.W, []  # noqa: N806
            for i in range(self.n):
                parts.append(x[i] * (la.dot_literal(x, W[i]) - F.col("xi")[i] * 2.0))
            out = F.col("kappa")
            for p in parts:
                out = out + p
            return out
        wx = F.transform(F.col("W"), lambda r: la.dot(r, x))
        return la.dot(x, wx) - la.dot(F.col("xi"), x) * 2.0 + F.col("kappa")

    def eval_errors(self, df: DataFrame, x: str = "x", name: str = "J") -> DataFrame:
        return df.withColumn(name, self.errors(F.col(x)))

    def eval_output(self, df: DataFrame, x: str = "x", name: str = "y_hat", weights=None, j: float = 0) -> DataFrame:
        """The models' output of states: a double, or an array for several outputs; j moves it off the anchor by whole samples."""
        rows = self.cost.output_rows(weights)
        if j:
            rows = np.concatenate([s * m.output_row(int(j)) for s, m in zip(np.ones(len(self.cost.get_alssms())) if weights is None else weights, self.cost.get_alssms(), strict=True)], -1)
        return df.withColumn(name, la.dot_literal(F.col(x), rows) if rows.ndim == 1 else la.matvec(rows, F.col(x)))

    def fit(self, df: DataFrame, output=("y_hat",), H=None, h=None, eval_alssm_weights=None, solver: str = "lstsq") -> DataFrame:  # noqa: N803
        """filter, minimize and evaluate; output names any of y_hat, x, v as columns."""
        output = (output,) if isinstance(output, str) else tuple(output)
        if not output or not set(output) <= set(OUTPUTS):
            raise ValueError(f"output names must be among {OUTPUTS}")
        out = self.minimize_x(self.filter(df), H, h, solver)
        if "v" in output:
            out = self.minimize_v(out, H, h, solver)
        if "y_hat" in output:
            out = self.eval_output(out, weights=eval_alssm_weights)
        return out.select(*df.columns, *output)

    def convolve(self, df: DataFrame, xref, name: str = "c", over=()) -> DataFrame:
        """<xi, xref> at every sample; over: key columns (channels) that are summed away, xref then has a row for each value in
        its order, or one for all."""
        only = Estimator(self.cost, True, self.method, self.keys, self.order, self.y, self.w, self.strategy, self.dense, self.block, ("xi",))
        xref = np.asarray(xref, float)
        if xref.ndim == 1:
            out = only.filter(df).withColumn(name, la.dot_literal(F.col("xi"), xref))
        else:
            if len(over) != 1:
                raise ValueError("a reference for each channel needs the channels' column in over")
            chosen = F.element_at(la.lit_matrix(xref), F.col(over[0]).cast("int") + 1)
            out = only.filter(df).withColumn(name, la.dot(F.col("xi"), chosen))
        if not over:
            return out
        return out.groupBy(*[c for c in self.keys if c not in over], self.order).agg(F.sum(name).alias(name))


def create_rls(cost, steady_state: bool = False, **switches) -> Estimator:
    """An estimator that is time-varying unless asked otherwise."""
    return Estimator(cost, steady_state=steady_state, **switches)
