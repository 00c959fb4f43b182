"""Hourly bars and threshold positions over a stream, with the batch operators as their twins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from tidemark.operators.folds import band_positions


def event_stream(spark: SparkSession, path: str, schema: StructType, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def hourly_bars(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Bars of closed hours; events later than the watermark are dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    bars = timed.groupBy(F.window("ts", "1 hour"), F.col("event_type").alias("symbol")).agg(F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"), F.count("*").alias("volume"))
    return bars.select("symbol", F.col("window.start").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "volume")


def streaming_positions(z: DataFrame, entry: float, exit_: float) -> DataFrame:
    """Positions of (symbol, ts, z) rows that arrive in order by symbol; the state is the last position."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else 0.0
        for frame in frames:
            frame = frame.sort_values("ts")
            # The state enters as a z-score that forces it: beyond the band for a held side, 0 for flat.
            start = {0.0: 0.0, -1.0: entry, 1.0: -entry}[last]
            made = band_positions(pd.Series([start, *frame["z"]]).to_numpy(float), entry, exit_)[1:]
            last = float(made[-1]) if len(made) else last
            yield frame.assign(position=made)[["symbol", "ts", "position"]]
        state.update((last,))

    return z.groupBy("symbol").applyInPandasWithState(run, "symbol string, ts timestamp_ntz, position double", "last double", "append", GroupStateTimeout.NoTimeout)
