"""Keyed running averages over a stream of updates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def running_averages(updates: DataFrame, warmup: int) -> DataFrame:
    """(key, n, ema) after each trigger for the keys it touched, from a stream (key bigint, epoch int, x double).

    beta is 1 - 1/(t+1) during warm-up and 0.99 then; a key's first value is taken as it is.
    Updates of one trigger are applied in the order of epochs.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, ema = state.get if state.exists else (0, 0.0)
        for epoch, x in sorted(pair for f in frames for pair in zip(f.epoch, f.x)):
            beta = 1 - 1 / (epoch + 1) if epoch < warmup else 0.99
            ema = float(x) if n == 0 else beta * ema + (1 - beta) * float(x)
            n += 1
        state.update((n, ema))
        yield pd.DataFrame({"key": [key[0]], "n": [n], "ema": [ema]})

    return updates.groupBy("key").applyInPandasWithState(step, "key bigint, n bigint, ema double", "n bigint, ema double", "update", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, ts: str, key: str, size: str = "1 hour", late: str = "2 days") -> DataFrame:
    """(start, key, n) per tumbling window, on streams with a watermark for late rows."""
    from pyspark.sql import functions as F

    marked = events.withWatermark(ts, late) if events.isStreaming else events
    return marked.groupBy(F.window(ts, size), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "n")
