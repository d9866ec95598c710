"""Quality rules: gradient-boosted trees over document statistics, flattened into numpy node arrays.

Statistics are counted over whole texts. Fixed base rules come first; then trees, grown here on a bounded sample of labelled
documents, give the probability that a document is good. Chosen features are monotonic: more symbols, repeated lines or
words, capitals or exclamation marks never raise it. A tree's nodes lie in arrays of a complete binary tree, so scoring a
batch takes a few vector steps per level.

Null texts have no words. Documents without words fail the base rules. Without labels there is no model and the base rules
decide alone. Ties at a threshold go left. Repeated rows are judged each, rows without an id keep a null one; an empty table
gives an empty result. Very long texts are counted whole. Further columns are left behind by the statistics, untouched by keep.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import write_table

SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\r\x0b\x0c"
WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_distinct", "n_upper", "n_exclaim", "n_digits", "n_bytes")
_TAIL = bytes(range(0x80, 0xC0))
_UPPER = bytes(range(65, 91))
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], np.uint64)

#: Model inputs and their direction: -1 where more may only lower the score, 1 where it may only raise it, 0 free.
FEATURES = {
    "symbols_per_word": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "upper_share": -1,
    "exclaim_per_word": -1,
    "digit_share": 0,
    "word_length": 0,
    "distinct_share": 1,
    "words_per_line": 0,
    "log_words": 0,
}


def repeated_words(ids: np.ndarray) -> int:
    """How many words lie in windows of eight that occur twice or more."""
    n = len(ids) - WINDOW + 1
    if n < 2:
        return 0
    u = ids.astype(np.uint64)
    h = u[:n] * _MIX[0]
    for k in range(1, WINDOW):
        h = h + u[k : n + k] * _MIX[k]
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    a, b = order[1:][same], order[:-1][same]
    if not all(np.array_equal(ids[a + k], ids[b + k]) for k in range(WINDOW)):  # equal hashes of unequal windows: compare the windows
        _, place, many = np.unique(np.lib.stride_tricks.sliding_window_view(ids, WINDOW), axis=0, return_inverse=True, return_counts=True)
        at = np.flatnonzero(many[place.ravel()] > 1)
    else:
        at = np.union1d(a, b)
    step = np.zeros(len(ids) + 1, np.int32)
    step[at] += 1
    np.add.at(step, at + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(step[:-1])))


def statistics(b: bytes) -> tuple[int, ...]:
    """COUNTS and MORE of a UTF-8 text."""
    words = b.split()  # bytes split at exactly \\x20 and \\x09-\\x0d
    n = len(words)
    first: dict[bytes, int] = {}
    ids = np.fromiter(map(first.setdefault, words, count()), np.int64, n)
    seen: set[bytes] = set()
    dup = lines = 0
    for line in b.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    size = len(b)
    repeats = 0 if len(first) == n else repeated_words(ids)
    return (
        n,
        len(b.translate(None, _TAIL + SPACE)),
        size - len(b.translate(None, SYMBOLS)),
        dup,
        repeats,
        lines,
        len(first),
        size - len(b.translate(None, _UPPER)),
        b.count(b"!"),
        size - len(b.translate(None, b"0123456789")),
        size,
    )


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and a long column for each of COUNTS and MORE; nothing is shuffled."""
    names = [*COUNTS, *MORE]

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                rows = [statistics(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True))], names=["doc_id", *names])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return own.mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in names))


def features(s: pd.DataFrame) -> np.ndarray:
    w, line, chars = np.maximum(s["n_words"], 1), np.maximum(s["n_lines"], 1), np.maximum(s["word_chars"], 1)
    columns = [s["n_symbols"] / w, s["n_dup_lines"] / line, s["n_repeat_words"] / w, s["n_upper"] / chars, s["n_exclaim"] / w, s["n_digits"] / chars, s["word_chars"] / w, s["n_distinct"] / w, s["n_words"] / line, np.log1p(s["n_words"])]
    return np.stack([np.asarray(c, float) for c in columns], 1)


class Trees:
    """Additive trees of a fixed depth as node arrays: feature, threshold and, at the last level, value."""

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray, base: float):
        self.feature, self.threshold, self.value, self.base = feature, threshold, value, base

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(v)))):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += v[at - len(f)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -50, 50)))


def grow(x: np.ndarray, y: np.ndarray, signs: list[int], rounds: int = 40, depth: int = 3, rate: float = 0.25, bins: int = 48, leaf: float = 1.0) -> Trees:
    """Newton boosting of logistic loss on binned features; splits that break a feature's direction aren't taken, and a
    monotonic split bounds the values below it by the middle of its two sides."""
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base, n = float(np.log(share / (1 - share))), len(y)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    place = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    margin, nodes = np.full(n, base), 2**depth - 1
    fs, ts, vs = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        f, t = np.zeros(nodes, np.int64), np.full(nodes, np.inf)
        low, high = np.full(2 * nodes + 1, -np.inf), np.full(2 * nodes + 1, np.inf)
        at = np.zeros(n, np.int64)
        for node in range(nodes):
            low[[2 * node + 1, 2 * node + 2]], high[[2 * node + 1, 2 * node + 2]] = low[node], high[node]
            mine = np.flatnonzero(at == node)
            if not len(mine):
                continue
            best = (1e-6, None)
            gt, ht = g[mine].sum(), h[mine].sum()
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                gl = np.cumsum(np.bincount(place[mine, j], g[mine], len(c) + 1))[:-1]
                hl = np.cumsum(np.bincount(place[mine, j], h[mine], len(c) + 1))[:-1]
                left, right = np.clip(gl / (hl + leaf), low[node], high[node]), np.clip((gt - gl) / (ht - hl + leaf), low[node], high[node])
                gain = gl * gl / (hl + leaf) + (gt - gl) ** 2 / (ht - hl + leaf) - gt * gt / (ht + leaf)
                gain[(hl < 1e-3) | (ht - hl < 1e-3) | (signs[j] * (right - left) < 0)] = -1
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (j, c[k], (left[k] + right[k]) / 2))
            if best[1] is None:
                at[mine] = 2 * node + 1
                continue
            j, cut, middle = best[1]
            f[node], t[node] = j, cut
            at[mine] = 2 * node + 1 + (x[mine, j] > cut)
            if signs[j]:
                (high if signs[j] > 0 else low)[2 * node + 1] = middle
                (low if signs[j] > 0 else high)[2 * node + 2] = middle
        v = np.zeros(nodes + 1)
        gs, hs = np.bincount(at - nodes, g, nodes + 1), np.bincount(at - nodes, h, nodes + 1)
        v = rate * np.clip(gs / (hs + leaf), low[nodes:], high[nodes:])
        margin += v[at - nodes]
        fs, ts, vs = [*fs, f], [*ts, t], [*vs, v]
    return Trees(np.array(fs), np.array(ts), np.array(vs), base)


def fit(stats: DataFrame, labels: DataFrame, rows: int = 20_000) -> Trees | None:
    """Trees grown on the labelled documents with the smallest id hashes, rows of them at most; None without both classes."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("y")).where("y is not null and doc_id is not null")
    chosen = marked.withColumn("draw", F.xxhash64("doc_id")).orderBy("draw", "doc_id", "y").limit(rows)
    names = [c for c in stats.columns if c != "doc_id"]
    s = stats.join(F.broadcast(chosen), "doc_id").orderBy("draw", "doc_id", "y", *names).limit(rows).toPandas()  # ids may repeat in either table
    y = s["y"].to_numpy(float)
    return grow(features(s), y, list(FEATURES.values())) if len(s) and 0 < y.mean() < 1 else None


def judge(stats: DataFrame, trees: Trees | None, threshold: float = 0.5) -> DataFrame:
    """stats with base_failed, score (null without a model) and kept."""
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    if trees is None:
        scored = stats.withColumn("score", F.lit(None).cast("double"))
    else:
        names = stats.columns

        def run(frames):
            for f in frames:
                yield pd.concat([f[names], pd.DataFrame({"score": trees.probability(features(f))}, index=f.index)], axis=1)

        scored = stats.mapInPandas(run, stats.withColumn("score", F.lit(0.0)).schema)
    return scored.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.coalesce(F.col("score"), F.lit(1.0)) >= threshold))


def fit_on(train: DataFrame, labels: DataFrame, rows: int = 20_000) -> Trees | None:
    """Trees from train's labelled documents; only the sample's texts are read into statistics."""
    ids = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).withColumn("draw", F.xxhash64("doc_id")).orderBy("draw").limit(rows).select("doc_id").distinct()
    return fit(document_statistics(train.join(F.broadcast(ids), "doc_id", "left_semi")), labels, rows)


def keep(docs: DataFrame, trees: Trees | None, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs, unchanged, that the base rules and the trees let pass; counted and judged in one pass, nothing is shuffled."""
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                s = pd.DataFrame([statistics(t or b"") for t in part.column(at).cast(pa.binary()).to_pylist()], columns=[*COUNTS, *MORE])
                good = ~((s["n_words"] < 20) | (s["n_repeat_words"] * 100 > s["n_words"] * 30))
                if trees is not None:
                    good &= trees.probability(features(s)) >= threshold
                yield part.filter(pa.array(good.to_numpy()))

    return docs.mapInArrow(run, docs.schema)


def apply(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics, score and verdict of every document; the trees are grown on the labelled ones."""
    stats, _ = write_table(document_statistics(docs), "statistics")
    return judge(stats, fit(stats, labels))
