"""Windowed sums: for every sample k of every series, the sum over offsets j in [a, b] of R_j v[k + j].

R_j = gamma^(j - delta) (T')^j c with a literal transition T and output c. All of the estimator's quantities are of this
form: xi (T = A, c = C'), the Gram matrix (T = A x A, c = C' x C', v = weight), the energy (T = 1, v = y^2), the weight.

Strategies, all with the same results:

* shift - one lag or lead per offset in a single Window; short finite windows of consecutive samples.
* doubling - S_2L[k] = S_L[k] + gamma^L (T^L)' S_L[k + L], so log2(length) windows that share one exchange and one sort;
  long finite windows. Windows across 0 are split, as a sum over offsets on one side must not need anchors off the series.
* fold - a range frame on k folded by a higher-order function; finite windows of series with gaps.
* explode - every sample is sent to the anchors it weighs in on and summed; finite windows, wants no order.
* scan - a recursion per series in Arrow batches; windows with an infinite side.

A null value or weight counts as weight 0. Long series are cut into blocks with a halo, so that no task holds a whole
series (finite windows; an infinite side carries its state over blocks in a second pass).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrays as la
from ..plans.models import block_diagonal, power

STRATEGIES = ("auto", "shift", "doubling", "fold", "explode", "scan")
#: Finite windows up to this length take a lag per offset.
SHIFT_LENGTH = 48
#: Samples of a series that one task takes at most; of an infinite window's recursion.
BLOCK, SCAN_BLOCK = 1 << 20, 1 << 14


@dataclass(frozen=True)
class Term:
    """One windowed sum: name of the result, transition, output, value column, window."""

    name: str
    transition: np.ndarray
    output: np.ndarray
    value: str
    a: float
    b: float
    gamma: float
    delta: int
    scale: float = 1.0

    @property
    def n(self) -> int:
        return len(self.output)

    def row(self, j: int) -> np.ndarray:
        return self.scale * self.gamma ** (j - self.delta) * (power(self.transition, j).T @ self.output)

    def table(self) -> np.ndarray:
        return np.stack([self.row(j) for j in range(int(self.a), int(self.b) + 1)])

    @property
    def finite(self) -> bool:
        return bool(np.isfinite([self.a, self.b]).all())


def choose(terms: list[Term], dense: bool) -> str:
    if not all(t.finite for t in terms):
        return "scan"
    if not dense:
        return "fold"
    return "shift" if max(t.b - t.a for t in terms) < SHIFT_LENGTH else "doubling"


def windowed_sums(df: DataFrame, terms: list[Term], keys: list[str], order: str = "k", strategy: str = "auto", dense: bool = True, block: int | None = BLOCK) -> DataFrame:
    """df with an array<double> column for each name; terms of one name (the segments of a cost) add up.

    dense: every series' order column counts 0, 1, 2, ... without gaps or repeats. Otherwise fold finds neighbours by value.
    block: samples of a series that one task takes at most; None leaves series whole.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    chosen = choose(terms, dense) if strategy == "auto" else strategy
    if chosen in ("shift", "doubling") and not dense:
        raise ValueError(f"{chosen} needs consecutive samples")
    if chosen != "scan" and not all(t.finite for t in terms):
        raise ValueError("an infinite side needs the scan strategy")
    names = list(dict.fromkeys(t.name for t in terms))
    if chosen == "scan" and block:
        return _scan_apart(df, terms, keys, order, dense, block).select(*df.columns, *names)
    if block and chosen in ("shift", "doubling", "fold"):
        before, after = max(0, int(-min(t.a for t in terms))), max(0, int(max(t.b for t in terms)))
        cut = with_halo(df, order, max(block, 2 * (before + after)), before, after)
        out = _RUN[chosen](cut, terms, [*keys, "_block"], order)
        return out.where("_own").select(*df.columns, *names)
    return _RUN[chosen](df, terms, keys, order).select(*df.columns, *names)


def with_halo(df: DataFrame, order: str, block: int, before: int, after: int) -> DataFrame:
    """Rows dealt to blocks of that many samples, and copied to the neighbour whose windows reach them; _own marks the originals.

    block must be at least before + after, so that a sample has one such neighbour at most.
    """
    k, size = F.col(order), F.lit(int(block)).cast("long")
    place = F.pmod(k, size)
    mine = ((k - place) / size).cast("long")
    cut = df.withColumn("_mine", mine)
    own = F.col("_mine")
    reach = F.when(place < after, F.array(own - 1, own)).when(place >= block - before, F.array(own, own + 1)).otherwise(F.array(own))
    return cut.withColumn("_block", F.explode(reach)).withColumn("_own", F.col("_block") == own).drop("_mine")


def _sum(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def _gather(df: DataFrame, scalars: dict[str, list[Column]]) -> DataFrame:
    return df.withColumns({name: F.array(*cols) for name, cols in scalars.items()})


def _shift(df: DataFrame, terms: list[Term], keys: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    wanted = sorted({(t.value, j) for t in terms for j in range(int(t.a), int(t.b) + 1)})
    at = {v: f"_at{i}" for i, v in enumerate(wanted)}
    moved = df.withColumns({c: F.coalesce(F.lead(v, j).over(w) if j > 0 else F.lag(v, -j).over(w) if j < 0 else F.col(v), F.lit(0.0)) for (v, j), c in at.items()})
    scalars: dict[str, list[Column]] = {}
    for name in dict.fromkeys(t.name for t in terms):
        own = [t for t in terms if t.name == name]
        scalars[name] = [_sum([F.col(at[t.value, int(t.a) + i]) * F.lit(float(r[n])) for t in own for i, r in enumerate(t.table()) if r[n]] or [F.lit(0.0)]) for n in range(own[0].n)]
    return _gather(moved, scalars)


def _sides(t: Term) -> list[tuple[int, int]]:
    a, b = int(t.a), int(t.b)
    return [(a, b)] if a >= 0 or b <= 0 else [(a, -1), (0, b)]


def _doubling(df: DataFrame, terms: list[Term], keys: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    done: dict[tuple, str] = {}
    out, parts = df, {}
    count = 0

    def moved(column: str, steps: int, ahead: bool, n: int) -> Column:
        if not steps:
            return F.col(column)
        return F.coalesce((F.lead if ahead else F.lag)(column, steps).over(w), la.zeros(n))

    for t in terms:
        for a, b in _sides(t):
            ahead = a >= 0
            # one step away from 0: the neighbour's sum moved over by it
            step = t.gamma * t.transition.T if ahead else power(t.transition, -1).T / t.gamma
            start, length = (a, b - a + 1) if ahead else (-b, b - a + 1)
            column, size, offset = None, 1, start
            rest = length
            while rest:
                key = (t.value, ahead, size, step.tobytes(), t.output.tobytes())
                if key not in done:
                    done[key] = f"_s{count}"
                    count += 1
                    if size == 1:
                        value = F.coalesce(F.col(t.value), F.lit(0.0))
                        out = out.withColumn(done[key], F.array(*[value * F.lit(float(c)) for c in t.output]))
                    else:
                        half = done[t.value, ahead, size // 2, step.tobytes(), t.output.tobytes()]
                        far = np.linalg.matrix_power(step, size // 2)
                        out = out.withColumn("_m", moved(half, size // 2, ahead, t.n)).withColumn(done[key], F.array(*[F.col(half)[i] + la.dot_literal(F.col("_m"), far[i]) for i in range(t.n)]))
                column = done[key]
                if rest & 1:
                    place = t.scale * t.gamma**-t.delta * np.linalg.matrix_power(step, offset)
                    name = f"_p{count}"
                    count += 1
                    out = out.withColumn(name, moved(column, offset, ahead, t.n))
                    parts.setdefault(t.name, []).append((name, place))
                    offset += size
                rest >>= 1
                size *= 2
    return _gather(out, {name: [_sum([la.dot_literal(F.col(c), m[i]) for c, m in ps]) for i in range(len(ps[0][1]))] for name, ps in parts.items()})


def _folded(t: Term, frame: Column, order: str) -> Column:
    table = la.lit_matrix(t.table())

    def enter(total: Column, e: Column) -> Column:
        row = F.element_at(table, (e["k"] - F.col(order) - int(t.a) + 1).cast("int"))
        return F.zip_with(total, row, lambda p, q: p + q * e[t.value])

    return F.aggregate(frame, la.zeros(t.n), enter)


def _fold(df: DataFrame, terms: list[Term], keys: list[str], order: str) -> DataFrame:
    frames = list(dict.fromkeys((int(t.a), int(t.b)) for t in terms))
    values = list(dict.fromkeys(t.value for t in terms))
    row = F.struct(F.col(order).alias("k"), *[F.coalesce(F.col(v), F.lit(0.0)).alias(v) for v in values])
    out = df.withColumns({f"_f{i}": F.collect_list(row).over(Window.partitionBy(*keys).orderBy(order).rangeBetween(a, b)) for i, (a, b) in enumerate(frames)})
    scalars: dict[str, list[Column]] = {}
    for name in dict.fromkeys(t.name for t in terms):
        own = [t for t in terms if t.name == name]
        sums = [_folded(t, F.col(f"_f{frames.index((int(t.a), int(t.b)))}"), order) for t in own]
        total = sums[0]
        for s in sums[1:]:
            total = la.add(total, s)
        out = out.withColumn(name, total)
    return out


def _explode(df: DataFrame, terms: list[Term], keys: list[str], order: str) -> DataFrame:
    sent = None
    names = list(dict.fromkeys(t.name for t in terms))
    width = {t.name: t.n for t in terms}
    for t in terms:
        rows = F.array(*[F.struct(F.lit(int(t.a) + i).alias("j"), la.lit_vector(r).alias("r")) for i, r in enumerate(t.table())])
        one = df.select(*keys, order, F.coalesce(F.col(t.value), F.lit(0.0)).alias("_v")).select(*keys, F.col(order), "_v", F.explode(rows).alias("_e"))
        one = one.select(*keys, (F.col(order) - F.col("_e.j")).alias(order), F.lit(t.name).alias("_name"), F.transform("_e.r", lambda r: r * F.col("_v")).alias("_r"))
        sent = one if sent is None else sent.unionByName(one)
    sums = sent.groupBy(*keys, order).agg(*[F.array(*[F.sum(F.when(F.col("_name") == n, F.col("_r")[i])) for i in range(width[n])]).alias(n) for n in names])
    # the join keeps anchors with empty windows and drops those off the series
    return df.join(sums, [*keys, order], "left").withColumns({n: F.coalesce(F.transform(F.col(n), lambda v: F.coalesce(v, F.lit(0.0))), la.zeros(width[n])) for n in names})


def scan_array(t: Term, v: np.ndarray) -> np.ndarray:
    """The windowed sums of one series, by a recursion for infinite sides and a direct sum for finite ones; (K, n)."""
    size = len(v)
    out = np.zeros((size, t.n))
    if t.finite:
        for j, r in zip(range(int(t.a), int(t.b) + 1), t.table(), strict=True):
            lo, hi = max(0, -j), min(size, size - j)
            if lo < hi:
                out[lo:hi] += v[lo + j : hi + j, None] * r
        return out
    if t.a == -np.inf:  # S[k] = decayed S[k-1] + what enters at k + b
        step, b = power(t.transition, -1).T / t.gamma, int(t.b)
        entering = np.outer(_between(v, b, size + max(0, b)), t.row(b))  # samples before the series only if b reaches ahead
        return recurrence(step, entering)[-size:] if size else out
    step, a = t.gamma * t.transition.T, int(t.a)
    entering = np.outer(_between(v[::-1], -a, size + max(0, -a)), t.row(a))
    return recurrence(step, entering)[-size:][::-1] if size else out


def _between(v: np.ndarray, ahead: int, length: int) -> np.ndarray:
    """What enters at each of the last len(v) samples and, if samples ahead enter, at those before: v moved back by ahead."""
    out = np.zeros(length)
    if ahead >= 0:
        out[: len(v)] = v
    elif -ahead < len(v):
        out[-ahead:] = v[:ahead]
    return out


def recurrence(step: np.ndarray, entering: np.ndarray) -> np.ndarray:
    """states[i] = step states[i - 1] + entering[i], by doubling: log2(n) passes over the whole array."""
    states, d = entering.copy(), 1
    while d < len(states):
        states[d:] += states[:-d] @ step.T
        step, d = step @ step, 2 * d
    return states


def _scan(df: DataFrame, terms: list[Term], keys: list[str], order: str) -> DataFrame:
    names = list(dict.fromkeys(t.name for t in terms))
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T.ArrayType(T.DoubleType())) for n in names]])
    columns = df.columns

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        f = frame.sort_values(order, kind="stable").reset_index(drop=True)
        k = f[order].to_numpy(np.int64)
        first = int(k[0]) if len(k) else 0
        place = k - first
        sums: dict[str, np.ndarray] = {}
        for t in terms:
            v = np.zeros(int(place[-1]) + 1 if len(k) else 0)
            np.add.at(v, place, np.nan_to_num(f[t.value].to_numpy(float)))
            sums[t.name] = sums.get(t.name, 0) + scan_array(t, v)[place]
        for n in names:
            f[n] = list(sums[n])
        return f[[*columns, *names]]

    return df.groupBy(*keys).applyInPandas(run, schema)


_RUN = {"shift": _shift, "doubling": _doubling, "fold": _fold, "explode": _explode, "scan": _scan}


def _scan_apart(df: DataFrame, terms: list[Term], keys: list[str], order: str, dense: bool, block: int) -> DataFrame:
    """Infinite windows one after another by blocks, finite ones by their own strategy; parts of one name are added."""
    out, parts, groups = df, {}, {}
    for t in terms:
        groups.setdefault((t.a, t.b, t.gamma, t.delta) if not t.finite else None, []).append(t)
    for g, (window, own) in enumerate(groups.items()):
        merged: dict[tuple, Term] = {}
        for i, t in enumerate(own):
            parts.setdefault(t.name, []).append(f"_g{g}_{i}")
            merged[g, i] = Term(f"_g{g}_{i}", t.transition, t.output, t.value, t.a, t.b, t.gamma, t.delta, t.scale)
        renamed = list(merged.values())
        out = windowed_sums(out, renamed, keys, order, "auto", dense, block) if window is None else scan_blocks(out, renamed, keys, order, min(block, SCAN_BLOCK))
    for name, columns in parts.items():
        total = F.col(columns[0])
        for c in columns[1:]:
            total = la.add(total, F.col(c))
        out = out.withColumn(name, total)
    return out


def scan_blocks(df: DataFrame, terms: list[Term], keys: list[str], order: str = "k", block: int = 1 << 14) -> DataFrame:
    """Sums over one window with an infinite side: blocks of a series are scanned apart, their final states are carried over
    blocks (one small row each), and each sample adds what its block was handed. df with a column for each term.
    """
    first = terms[0]
    if first.finite or any((t.a, t.b, t.gamma, t.delta) != (first.a, first.b, first.gamma, first.delta) for t in terms):
        raise ValueError("blocks are scanned for terms of one window with an infinite side")
    ahead = first.b == np.inf
    edge = int(first.a if ahead else first.b)
    size = max(block, 2 * abs(edge) + 1)
    step = block_diagonal([t.gamma * t.transition.T if ahead else power(t.transition, -1).T / t.gamma for t in terms])
    rows, cuts = [t.row(edge) for t in terms], np.cumsum([0] + [t.n for t in terms])
    cut = with_halo(df, order, size, max(0, -edge), max(0, edge))
    arrays = T.ArrayType(T.DoubleType())
    schema = T.StructType([*cut.schema.fields, T.StructField("_local", arrays), T.StructField("_out", arrays)])
    columns, values, names = cut.columns, [t.value for t in terms], [t.name for t in terms]

    def local(frame: pd.DataFrame) -> pd.DataFrame:
        """Samples at k + edge enter where k is in the block; the last state is what the block hands on."""
        f = frame.sort_values(order, kind="stable").reset_index(drop=True)
        lo = int(f["_block"].iloc[0]) * size
        k = f[order].to_numpy(np.int64)
        v = np.nan_to_num(f[values].to_numpy(float))
        at, mine = k - edge, (k >= lo) & (k < lo + size)
        inside = (at >= lo) & (at < lo + size)
        state, states, start = np.zeros(len(step)), np.zeros((0, len(step))), 0
        if mine.any() or inside.any():
            seen = np.concatenate([at[inside], k[mine]])
            start, stop = int(seen.min()), int(seen.max())
            entering = np.zeros((stop - start + 1, len(step)))
            np.add.at(entering, at[inside] - start, np.concatenate([np.outer(v[inside, i], r) for i, r in enumerate(rows)], 1))
            states = recurrence(step, entering[::-1])[::-1] if ahead else recurrence(step, entering)
            state = np.linalg.matrix_power(step, start - lo if ahead else lo + size - 1 - stop) @ states[0 if ahead else -1]
        f["_local"] = [states[x - start] if own else None for x, own in zip(k.tolist(), mine.tolist(), strict=True)]
        f["_out"] = [state] * len(f)
        return f[[*columns, "_local", "_out"]]

    scanned = cut.groupBy(*keys, "_block").applyInPandas(local, schema)
    ends = scanned.groupBy(*keys, "_block").agg(F.first("_out").alias("_out"))
    whole = np.linalg.matrix_power(step, size)
    carried = T.StructType([*[df.schema[c] for c in keys], T.StructField("_block", T.LongType()), T.StructField("_in", arrays)])

    def carry(frame: pd.DataFrame) -> pd.DataFrame:
        f = frame.sort_values("_block", ascending=not ahead)
        state, last, out = np.zeros(len(step)), None, []
        for at, entered in zip(f["_block"].tolist(), f["_out"].tolist(), strict=True):
            if last is not None and abs(at - last) > 1:  # blocks without samples only age the state
                state = np.linalg.matrix_power(whole, abs(at - last) - 1) @ state
            out.append(state)
            state, last = whole @ state + np.asarray(entered), at
        f = f[[*keys, "_block"]].copy()
        f["_in"] = out
        return f

    handed = ends.select(*keys, F.col("_block").cast("long").alias("_block"), "_out").groupBy(*keys).applyInPandas(carry, carried)
    own = scanned.where("_own").join(handed, [*keys, "_block"])
    final, result = df.columns, T.StructType([*df.schema.fields, *[T.StructField(n, arrays) for n in names]])

    def finish(frames):
        """The handed state has as many steps to go as lie between the block's beginning and the sample."""
        powers: dict[int, np.ndarray] = {}
        for f in frames:
            k = f[order].to_numpy(np.int64) - f["_block"].to_numpy(np.int64) * size
            steps = size - k if ahead else k + 1
            out = np.stack(f["_local"].to_numpy()) if len(f) else np.zeros((0, len(step)))
            inn = np.stack(f["_in"].to_numpy()) if len(f) else out
            moved = np.flatnonzero(inn.any(1))
            for n in np.unique(steps[moved]).tolist():
                if n not in powers:
                    powers[n] = step @ powers[n - 1] if n - 1 in powers else np.linalg.matrix_power(step, n)
                at = moved[steps[moved] == n] if len(moved) < 64 else None
                if at is not None:
                    out[at] += inn[at] @ powers[n].T
            if len(moved) >= 64:
                out[moved] += np.einsum("kij,kj->ki", np.stack([powers[n] for n in steps[moved].tolist()]), inn[moved])
            for i, n in enumerate(names):
                f[n] = list(out[:, cuts[i] : cuts[i + 1]])
            yield f[[*final, *names]]

    return own.mapInPandas(finish, result)
