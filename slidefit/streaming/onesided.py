"""Streaming fits: xi of a forward window that ends at the current sample, for every arriving sample.

Each series keeps the samples its window reaches back to. Samples must come in order within a series; late ones (an index
at or before the last one seen) are dropped. Gaps count as zeros.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout


def streaming_xi(stream: DataFrame, model, segment) -> DataFrame:
    """stream (series_id string, k long, y double) -> series_id, k, xi; segment: finite, b <= 0."""
    if not np.isfinite([segment.a, segment.b]).all() or segment.b > 0:
        raise ValueError("a streaming window is finite and ends at the current sample or before")
    a, b = int(segment.a), int(segment.b)
    rows = {j: segment.gamma ** (j - segment.delta) * np.ravel(model.output_row(j)) for j in range(a, b + 1)}

    def step(key, frames, state):
        last, kept = state.get if state.exists else (-1, [])
        known = np.array(kept, float).reshape(-1, 2)
        for f in frames:
            f = f[["k", "y"]].sort_values(["k", "y"], kind="stable").drop_duplicates("k")
            f = f[f["k"] > last]
            if not len(f):
                continue
            k, y = f["k"].to_numpy(np.int64), f["y"].fillna(0.0).to_numpy(float)
            at, value = np.concatenate([known[:, 0].astype(np.int64), k]), np.concatenate([known[:, 1], y])
            xi = np.zeros((len(k), model.N))
            for j, row in rows.items():
                place = np.minimum(np.searchsorted(at, k + j), len(at) - 1)
                xi += np.where(at[place] == k + j, value[place], 0.0)[:, None] * row
            last = int(k[-1])
            near = at >= last + a
            known = np.stack([at[near], value[near]], 1)
            yield pd.DataFrame({"series_id": key[0], "k": k, "xi": list(xi)})
        state.update((last, known.tolist()))

    return stream.groupBy("series_id").applyInPandasWithState(step, "series_id string, k long, xi array<double>", "last long, kept array<array<double>>", "append", GroupStateTimeout.NoTimeout)
