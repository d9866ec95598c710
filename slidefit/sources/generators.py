"""Synthetic signals as tables (k, y): column formulas over range(K), so any length is made in parallel.

Signals with a history (steps, slopes, walks) are running sums within blocks of samples plus the blocks' offsets. Random draws
are digests of seed and sample, so a signal is the same on any cluster; other libraries' values with that seed differ.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F



def draw(seed: int, stream: int) -> Column:
    """A uniform number in (0, 1) for each k: 52 bits of a digest."""
    digest = F.md5(F.concat(F.lit(f"{seed}:{stream}:"), F.col("k").cast("string")))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def _seed(seed: int | None) -> int:
    return int(np.random.default_rng().integers(1 << 62)) if seed is None else int(seed)


def running(df: DataFrame, values: dict[str, Column], length: int, blocks: int = 64) -> DataFrame:
    """df (k) with running sums: within blocks, then the blocks' offsets, a row for each of at most that many blocks."""
    size = max(1, -(-int(length) // blocks))
    w = Window.partitionBy("_b").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    cut = df.withColumns({**{f"_{n}": c for n, c in values.items()}, "_b": F.floor(F.col("k") / size)})
    offsets = cut.groupBy("_b").agg(*[F.sum(f"_{n}").alias(f"_{n}") for n in values]).select("_b", *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0.0)).alias(f"_o{n}") for n in values])
    within = cut.select("*", *[F.sum(f"_{n}").over(w).alias(f"_w{n}") for n in values])
    return within.join(offsets, "_b").select(*df.columns, *[(F.col(f"_w{n}") + F.col(f"_o{n}")).alias(n) for n in values])


def index(spark: SparkSession, length: int) -> DataFrame:
    """k = 0 .. length - 1."""
    return spark.range(int(length)).withColumnRenamed("id", "k")


def k_period_to_omega(k_period: float) -> float:
    """Angular frequency of a period in samples."""
    return 2 * np.pi / k_period


def sine(length: int, k_periods, amplitudes=None, k0s=None) -> Column:
    """A sum of sines. The phase runs over length/period turns including the end point, so a step is (K/period)/(K-1) turns."""
    periods = np.atleast_1d(k_periods)
    amplitudes = np.ones(len(periods)) if amplitudes is None else np.broadcast_to(amplitudes, len(periods))
    starts = np.zeros(len(periods)) if k0s is None else np.broadcast_to(k0s, len(periods))
    out = F.lit(0.0)
    for p, a, k0 in zip(periods, amplitudes, starts, strict=True):
        turn = 2 * np.pi * (length / p) / max(length - 1, 1)
        out = out + F.sin((F.col("k") - F.lit(float(k0))) * F.lit(float(turn))) * F.lit(float(a))
    return out


def gen_sine(spark, length, k_periods, amplitudes=None, k0s=None) -> DataFrame:
    return index(spark, length).select("k", sine(length, k_periods, amplitudes, k0s).alias("y"))


def gen_exp(spark, length, decay, k0: float = 0) -> DataFrame:
    """decay^(k - k0)."""
    return index(spark, length).select("k", F.pow(F.lit(float(decay)), F.col("k") - F.lit(k0)).alias("y"))


def gen_rect(spark, length, k_period: int, k_on: int | None = None, duty_cycle: float | None = None, k0: int = 0) -> DataFrame:
    """Ones for the first k_on (or duty_cycle, or half) samples of each period, moved back by k0. The period's phase also
    holds before the first full period; nothing wraps to the end."""
    if k_on is None:
        k_on = k_period // 2 if duty_cycle is None else int(duty_cycle * k_period)
    return index(spark, length).select("k", F.when(F.pmod(F.col("k") + F.lit(int(k0)), F.lit(int(k_period))) < int(k_on), 1.0).otherwise(0.0).alias("y"))


def _phase(k_period: int) -> Column:
    return F.pmod(F.col("k"), F.lit(int(k_period)))


def gen_saw(spark, length, k_period: int) -> DataFrame:
    return index(spark, length).select("k", (_phase(k_period) / k_period - 0.5).alias("y"))


def gen_tri(spark, length, k_period: int) -> DataFrame:
    half = k_period / 2
    return index(spark, length).select("k", (F.lit(0.5) - F.abs(_phase(k_period) - half) / half).alias("y"))


def _knots(spark, ks, values) -> DataFrame:
    return spark.createDataFrame([(int(k), float(v)) for k, v in zip(ks, values, strict=True)], "k long, v double")


def _inside(length, ks) -> None:
    if len(ks) and not (0 <= min(ks) and max(ks) < length):
        raise ValueError("positions must lie in [0, K)")


def gen_pulse(spark, length, ks) -> DataFrame:
    """Ones at ks; repeated positions count once."""
    _inside(length, ks)
    marks = _knots(spark, sorted(set(ks)), np.ones(len(set(ks))))
    return index(spark, length).join(marks, "k", "left").select("k", F.coalesce("v", F.lit(0.0)).alias("y"))


def gen_steps(spark, length, ks, deltas) -> DataFrame:
    """Level changes of deltas at ks, accumulated; of repeated positions the last counts."""
    _inside(length, ks)
    last = dict(zip(ks, deltas, strict=True))
    marked = index(spark, length).join(_knots(spark, list(last), list(last.values())), "k", "left")
    return running(marked.select("k", F.coalesce("v", F.lit(0.0)).alias("step")), {"y": F.col("step")}, length).select("k", "y")


def gen_slopes(spark, length, ks, deltas) -> DataFrame:
    """Straight lines through (ks, accumulated deltas), constant outside: running sums of the changes of slope and intercept."""
    k, v = np.asarray(ks, float), np.cumsum(np.asarray(deltas, float))
    slope = np.r_[np.diff(v) / np.diff(k), 0.0] if len(k) > 1 else np.zeros(1)
    level = v - slope * k
    at = np.maximum(np.ceil(k), 0)
    changes = spark.createDataFrame([(int(a), float(s), float(c)) for a, s, c in zip(at, np.diff(slope, prepend=0.0), np.diff(level, prepend=v[0]), strict=True)], "k long, slope double, level double").groupBy("k").agg(F.sum("slope").alias("slope"), F.sum("level").alias("level"))
    marked = index(spark, length).join(changes, "k", "left").select("k", F.coalesce("slope", F.lit(0.0)).alias("ds"), F.coalesce("level", F.lit(0.0)).alias("dl"))
    out = running(marked, {"slope": F.col("ds"), "level": F.col("dl")}, length)
    return out.select("k", (F.lit(float(v[0])) + F.col("level") + F.col("slope") * F.col("k")).alias("y"))


def _normal(seed: int) -> Column:
    """Box and Muller's Gaussian from two uniform draws."""
    return F.sqrt(F.log(draw(seed, 0)) * -2.0) * F.cos(draw(seed, 1) * F.lit(2 * np.pi))


def gen_wgn(spark, length, sigma: float, seed: int | None = None) -> DataFrame:
    """Gaussian noise."""
    return index(spark, length).select("k", (_normal(_seed(seed)) * float(sigma)).alias("y"))


def gen_rand_walk(spark, length, seed: int | None = None, blocks: int = 64) -> DataFrame:
    """A running sum of uniform steps of random sign."""
    seed = _seed(seed)
    step = F.when(draw(seed, 0) < 0.5, -1.0).otherwise(1.0) * draw(seed, 1)
    return running(index(spark, length), {"y": step}, length, blocks)


def gen_rand_pulse(spark, length, n_pulses: int, pulse_length: int = 1, seed: int | None = None, channels: int | None = None) -> DataFrame:
    """n_pulses at different random positions (those of the smallest draws), each a box of pulse_length around it ('same'
    alignment); overlapping boxes add up. Channels share the positions."""
    if not 0 <= n_pulses <= length:
        raise ValueError("n_pulses must lie in [0, K]")
    seed = _seed(seed)
    back = (pulse_length - 1) // 2
    at = index(spark, length).withColumn("_d", draw(seed, 0)).orderBy("_d", "k").limit(int(n_pulses))
    marks = at.select(F.explode(F.sequence(F.col("k") - (pulse_length - 1 - back), F.col("k") + back)).alias("k")).groupBy("k").agg(F.count("*").cast("double").alias("v"))
    out = index(spark, length).join(marks, "k", "left").select("k", F.coalesce("v", F.lit(0.0)).alias("y"))
    return out if channels is None else out.withColumn("ch", F.explode(F.array(*[F.lit(c) for c in range(channels)])))


def gen_conv(base: DataFrame, template, keys=()) -> DataFrame:
    """base (keys, k, y) convolved with a template, cut to the centre part of base's length; every channel apart."""
    t = np.asarray(template, float)
    centre = (len(t) - 1) // 2
    taps = F.array(*[F.struct(F.lit(i - centre).alias("j"), F.lit(float(v)).alias("t")) for i, v in enumerate(t)])
    sent = base.select(*keys, "k", "y", F.explode(taps).alias("e")).select(*keys, (F.col("k") + F.col("e.j")).alias("k"), (F.col("y") * F.col("e.t")).alias("p"))
    return base.select(*keys, "k").join(sent.groupBy(*keys, "k").agg(F.sum("p").alias("y")), [*keys, "k"], "left").select(*keys, "k", F.coalesce("y", F.lit(0.0)).alias("y"))
