"""Quality by compression: zstandard dictionaries of good and of bad text, and a calibrated size difference.

Two dictionaries are trained on a bounded sample of labelled documents, one for each label. A text is cut into blocks; each
is compressed with either dictionary, and the difference of the total sizes, over their sum, is positive where the good
dictionary fits better. Labelled documents that took no part in the dictionaries calibrate it: a logistic curve over the
difference and the mean size per byte (text that any dictionary compresses far too well is stutter) gives the probability
of label 1. Only texts and labels are learned from; ids only choose and split the sample.

Null texts count as empty; an empty text has difference zero, so its score is the curve's value there. Without both labels
the score is the share of label 1, or one half. Repeated rows are scored each, rows without an id keep a null one; an empty table
gives an empty result. Very long texts are scored whole, block by block, but don't enter the sample. Further columns are left
behind by score and untouched by keep.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 1024
_state: dict = {}


class Sizes:
    """Compressed sizes of blocks with either dictionary."""

    def __init__(self, good: bytes, bad: bytes, level: int = 3):
        self.pair = []
        for d in (good, bad):
            known = zstandard.ZstdCompressionDict(d)
            known.precompute_compress(level)
            self.pair.append(zstandard.ZstdCompressor(dict_data=known, level=level, write_content_size=False, write_checksum=False, write_dict_id=False))

    def measure(self, text: bytes) -> tuple[float, float]:
        """(bad - good) / (bad + good) of the sizes summed over blocks, and their mean per byte; (0, 1) for an empty text."""
        if not text:
            return 0.0, 1.0
        good, bad = (sum(len(c.compress(text[k : k + BLOCK])) for k in range(0, len(text), BLOCK)) for c in self.pair)
        return (bad - good) / (bad + good), (bad + good) / (2 * len(text))


class Model:
    """Dictionaries and the curve's weights: of difference, of size per byte, and the shift."""

    def __init__(self, good: bytes, bad: bytes, weights: np.ndarray):
        self.good, self.bad, self.weights = good, bad, weights

    def score(self, measures: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(measures @ self.weights[:2] + self.weights[2], -50, 50)))


def curve(x: np.ndarray, y: np.ndarray, steps: int = 50) -> np.ndarray:
    """A logistic fit, both classes weighing the same, by Newton steps with a small penalty; the first weight is never negative."""
    mean, scale = x.mean(0), x.std(0) + 1e-12
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    weight, penalty = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())), np.array([1e-2, 1e-2, 1e-9])
    b = np.zeros(3)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -50, 50)))
        hess = (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + np.diag(penalty)
        b = b + np.clip(np.linalg.solve(hess, z.T @ (weight * (y - p)) - penalty * b), -5, 5)
    b[0] = max(0.0, b[0])
    w = b[:2] / scale
    return np.array([*w, b[2] - mean @ w])


def dictionary(texts: list[bytes], size: int) -> bytes:
    """A trained dictionary; the texts themselves where there are too few to train on."""
    blocks = [t[k : k + BLOCK] for t in texts for k in range(0, len(t), BLOCK)]
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, blocks)) // 8), blocks).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(blocks)[-size:] or b"\n" * 8


def sample(docs: DataFrame, labels: DataFrame, allowed: Column | None, rows: int, most_chars: int) -> list[tuple[bytes, int]]:
    """At most rows labelled documents of either label, of at most most_chars characters, by the smallest id hashes."""
    marked = labels.select(F.col("doc_id").alias("doc_id"), F.col("quality").alias("y")).where("y is not null and doc_id is not null")
    if allowed is not None:
        marked = marked.where(allowed)
    draw = marked.withColumn("draw", F.xxhash64("doc_id"))
    chosen = draw.where("y = 1").orderBy("draw").limit(rows).unionByName(draw.where("y <> 1").orderBy("draw").limit(rows))
    own = docs.select("doc_id", "text").where(F.col("text").isNotNull() & F.length("text").between(1, most_chars))
    found = own.join(F.broadcast(chosen), "doc_id").select("draw", "doc_id", "y", F.col("text").cast("binary").alias("text")).withColumn("digest", F.xxhash64("text"))
    order = ["draw", "doc_id", "digest"]
    # ids may repeat in either table, so the join is bounded again: keys alone tell where each label's sample ends, then one of
    # equal rows comes here. Rows collected from an ordered limit would come from every task, as many as the limit.
    key, taken = F.struct(*order), F.lit(False)
    for good in (True, False):
        mine = (F.col("y") == 1) == F.lit(good)
        last = found.where(mine).select(key.alias("key")).orderBy("key").limit(rows).agg(F.max("key").alias("key")).first()["key"]
        if last is not None:
            end = F.struct(*(F.lit(last[c]).cast(found.schema[c].dataType).alias(c) for c in order))
            taken = taken | (mine & (key <= end))
    kept = sorted(found.where(taken).groupBy("y", *order, "text").agg(F.count("*").alias("n")).collect(), key=lambda r: [r[c] for c in order])
    got = []
    for good in (True, False):
        got += [r for r in kept if (r["y"] == 1) == good for _ in range(min(r["n"], rows))][:rows]
    return [(bytes(r["text"]), int(r["y"] == 1)) for r in sorted(got, key=lambda r: (r["draw"], r["doc_id"], r["y"], r["text"]))]


def fit(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, rows: int = 2000, most_chars: int = 20_000, dictionary_bytes: int = 65_536) -> Model | float:
    """A model from at most 2 * rows documents; a constant where a label is missing."""
    rows_ = sample(docs, labels, allowed, rows, most_chars)
    y = np.array([v for _, v in rows_], float)
    if len(rows_) < 4 or y.min() == y.max() or min(y.sum(), (1 - y).sum()) < 2:
        return float(y.mean()) if len(y) else 0.5
    parts: dict[int, tuple[list[bytes], list[bytes]]] = {0: ([], []), 1: ([], [])}
    for text, label in rows_:  # alternately for the dictionary and the curve
        a, b = parts[label]
        (a if len(a) <= len(b) else b).append(text)
    good, bad = dictionary(parts[1][0], dictionary_bytes), dictionary(parts[0][0], dictionary_bytes)
    sizes = Sizes(good, bad)
    x = np.array([sizes.measure(t) for label in (1, 0) for t in parts[label][1]])
    return Model(good, bad, curve(x, np.array([1.0] * len(parts[1][1]) + [0.0] * len(parts[0][1]))))


def _measures(m: Model, batch: list[bytes]) -> np.ndarray:
    if _state.get("of") != (m.good, m.bad):
        _state.update(of=(m.good, m.bad), sizes=Sizes(m.good, m.bad))
    return np.array([_state["sizes"].measure(t or b"") for t in batch]).reshape(-1, 2)


def keep(docs: DataFrame, model: Model | float, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows of docs, unchanged, whose score reaches the threshold; nothing is shuffled. A constant keeps all."""
    if not isinstance(model, Model):
        return docs
    sent, column = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches):
        m = sent.value
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                yield part.filter(pa.array(m.score(_measures(m, part.column(column).cast(pa.binary()).to_pylist())) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def score(docs: DataFrame, model: Model | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, difference and score of every document; nothing is shuffled."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    if not isinstance(model, Model):
        return own.select("doc_id", F.lit(0.0).alias("difference"), F.lit(float(model)).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of a fixed size

    def run(batches):
        m = sent.value
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                x = _measures(m, part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(x[:, 0]), pa.array(m.score(x))], names=["doc_id", "difference", "score"])

    return own.mapInArrow(run, "doc_id long, difference double, score double")
