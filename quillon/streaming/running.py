"""Sufficient statistics and betting capitals of a stream.

Statistics add, so a stream's are a streaming aggregate equal to the batch's; capitals need
their order, so they are kept per key in a state that a pandas kernel advances.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillon.operators.sequential import PIT_LAMBDAS


def gram_stream(stream: DataFrame, x: Column, y: Column, key: str) -> DataFrame:
    """By key: n, sums and sums of products, as a streaming (or batch) aggregate in complete mode."""
    return stream.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(x * x).alias("sxx"), F.sum(y).alias("sy"), F.sum(x * y).alias("sxy"), F.sum(y * y).alias("syy"))


def windowed(stream: DataFrame, ts: str, width: str, late: str, key: str, value: Column) -> DataFrame:
    """Tumbling windows with a watermark: count, mean and largest value."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("largest"))


def eprocess_stream(stream: DataFrame, key: str, order: str, u: str, alpha: float = 0.01) -> DataFrame:
    """By key and batch: length, log of the mixture of capitals and the first crossing so far (-1 if none)."""
    kind = dict(stream.dtypes)[key]

    def advance(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get) if state.exists else [0, -1, *([0.0] * 12)]
        n, first, logs = int(held[0]), int(held[1]), np.array(held[2:], float)
        rows = pd.concat(list(parts)).sort_values(order)
        for v in rows[u].to_numpy():
            h = (2 * v - 1, 6 * v * (1 - v) - 1, 20 * v**3 - 30 * v**2 + 12 * v - 1)
            logs += np.log1p([lam * b for b in h for lam in PIT_LAMBDAS])
            n += 1
            m = logs.max() + math.log(np.exp(logs - logs.max()).mean())
            if first < 0 and m >= math.log(1 / alpha):
                first = n
        state.update((n, first, *logs.tolist()))
        yield pd.DataFrame({key: [k[0]], "n": [n], "log_e": [float(logs.max() + math.log(np.exp(logs - logs.max()).mean()))], "first_crossing": [first]})

    fields = "n long, first long, " + ", ".join(f"c{i} double" for i in range(12))
    return stream.groupBy(key).applyInPandasWithState(advance, f"{key} {kind}, n long, log_e double, first_crossing long", fields, "update", GroupStateTimeout.NoTimeout)
