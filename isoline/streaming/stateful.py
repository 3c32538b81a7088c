"""Stateful operators on streams, with the semantics of the batch folds.

Each keeps a small state per key and reads its rows in (t, id) order within a
micro-batch; across batches the source gives the order, as the only guard
against time running back is the filter's step of 1 ms.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _ordered(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    rows = pd.concat(list(batches)).sort_values(["t", "id"])
    return rows.itertuples(index=False)


def one_euro(df: DataFrame, min_cutoff: float = 1.5, beta: float = 0.05, dcutoff: float = 1.0) -> DataFrame:
    """The one-euro filter of a stream of (key long, id long, t double, value double): key, id, raw, smooth. State: the filtered value, its speed and its time."""

    def alpha(cutoff: float, dt: float) -> float:
        return 1 / (1 + 1 / (2 * math.pi * cutoff) / dt)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        x, dx, last = state.get if state.exists else (None, 0.0, None)
        out = []
        for r in _ordered(batches):
            if x is None:
                x = r.value
            else:
                dt = r.t - last if r.t - last > 0 else 1e-3
                a = alpha(dcutoff, dt)
                dx = a * (r.value - x) / dt + (1 - a) * dx
                b = alpha(min_cutoff + beta * abs(dx), dt)
                x = b * r.value + (1 - b) * x
            last = r.t
            out.append((key[0], r.id, r.value, x))
        state.update((float(x), float(dx), float(last)))
        yield pd.DataFrame(out, columns=["key", "id", "raw", "smooth"])

    return df.groupBy("key").applyInPandasWithState(step, "key long, id long, raw double, smooth double", "x double, dx double, t double", "append", GroupStateTimeout.NoTimeout)


def presence(df: DataFrame, up: float = 0.34, down: float = 0.16) -> DataFrame:
    """Presence of a stream of (key, id, t, value): value above 0 is a hit. key, id, presence."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        p = state.get[0] if state.exists else 0.0
        out = []
        for r in _ordered(batches):
            p = min(1.0, p + up) if r.value > 0 else max(0.0, p - down)
            out.append((key[0], r.id, p))
        state.update((float(p),))
        yield pd.DataFrame(out, columns=["key", "id", "presence"])

    return df.groupBy("key").applyInPandasWithState(step, "key long, id long, presence double", "p double", "append", GroupStateTimeout.NoTimeout)


def rolling(df: DataFrame, rows: int = 8) -> DataFrame:
    """Root mean square and greatest of the last rows values of a stream of (key, id, t, value)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        out = []
        for r in _ordered(batches):
            held = [*held, float(r.value)][-rows:]
            out.append((key[0], r.id, math.sqrt(sum(v * v for v in held) / len(held)), max(held)))
        state.update((held,))
        yield pd.DataFrame(out, columns=["key", "id", "rms", "most"])

    return df.groupBy("key").applyInPandasWithState(step, "key long, id long, rms double, most double", "held array<double>", "append", GroupStateTimeout.NoTimeout)


def windowed_metrics(df: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts and means of a stream of (name, ts timestamp, value) in tumbling windows; rows later than the watermark are left out. An extension: batches have no windows of time."""
    w = df.withWatermark("ts", late).groupBy(F.window("ts", size), "name")
    return w.agg(F.count("value").alias("n"), F.avg("value").alias("mean")).select(F.col("window.start").alias("start"), "name", "n", "mean")


def run_once(df: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """What a stream has now, written to path as Parquet and read back."""
    query = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.read.parquet(path)
