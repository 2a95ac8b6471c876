"""Streams: windowed counts with a watermark, and a running baseline kept as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def daily_counts(events: DataFrame, ts: str = "ts", kind: str = "event_type", late: str = "1 day") -> DataFrame:
    """(day, kind, n): tumbling days; a day closes once the watermark has passed it, and later rows are dropped."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return timed.groupBy(F.window("_ts", "1 day").alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("day"), kind, "n")


def running_baseline(readings: DataFrame, key: str, time: str, value: str, keep: float = 0.9, limit: float = 0.25) -> DataFrame:
    """(key, time, value, baseline, flag) as readings arrive; a key's state is one number.

    Rows of a key within one batch are taken in order of time; the first reading ever is its own baseline.
    """

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(["t", "x"], kind="stable")
        base = state.get[0] if state.exists else None
        out = []
        for t, x in zip(rows["t"], rows["x"], strict=True):
            base = x if base is None else base
            out.append((k[0], t, x, base, abs(x - base) > limit))
            base = keep * base + (1 - keep) * x
        state.update((float(base),))
        yield pd.DataFrame(out, columns=["key", "t", "x", "baseline", "flag"])

    named = readings.select(F.col(key).alias("key"), F.col(time).cast("bigint").alias("t"), F.col(value).cast("double").alias("x"))
    kind = named.schema["key"].dataType.simpleString()
    out = named.groupBy("key").applyInPandasWithState(step, f"key {kind}, t bigint, x double, baseline double, flag boolean", "base double", "append", GroupStateTimeout.NoTimeout)
    return out.select(F.col("key").alias(key), F.col("t").alias(time), F.col("x").alias(value), "baseline", "flag")


def run_once(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now, into Parquet at ``path``, and reads it."""
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/progress").outputMode(mode).trigger(availableNow=True).start(f"{path}/rows")
    query.awaitTermination()
    spark = stream.sparkSession
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def residuals(events: DataFrame, flagged: DataFrame, on: list[str]) -> DataFrame:
    """The full rows of what a summary has flagged, and of nothing else."""
    return events.join(flagged.select(*on).distinct(), on, "left_semi")
