"""Occurrence counters and sliding means on streams: an extension, the batch operators are in ``operators.windows``."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def running_occurrence(events: DataFrame, keys: Sequence[str], time: str, order: str) -> DataFrame:
    """(keys, time, order, repetition): how often the keys came before, over micro-batches.

    The state of a key is one number. Rows of a micro-batch are counted in the
    order of time; rows that come later count as later.
    """
    keys = list(keys)
    kinds = dict(events.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*keys, time, order]) + ", repetition long"

    def f(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        rows = pd.concat(list(parts))[[*keys, time, order]].sort_values([time, order])
        rows["repetition"] = range(n, n + len(rows))
        state.update((n + len(rows),))
        yield rows

    return events.groupBy(*keys).applyInPandasWithState(f, schema, "n long", "append", GroupStateTimeout.NoTimeout)


def windowed_mean(events: DataFrame, keys: Sequence[str], time: str, value: str, size: str, step: str, late: str) -> DataFrame:
    """(keys, start, mean, n) of sliding time windows; rows later than ``late`` are dropped with their state."""
    w = events.withWatermark(time, late).groupBy(*keys, F.window(time, size, step)).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    return w.select(*keys, F.col("window.start").alias("start"), "mean", "n")


def deduplicated(events: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """The first row of each key within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
