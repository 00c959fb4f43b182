"""Streams give what their batch twins give."""

import datetime as dt

import pandas as pd

from tidemark.operators import folds
from tidemark.sources.tables import bars
from tidemark.streaming import bars as streaming

SF = "/root/testdata/sf0.001"


def drained(df, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    query.processAllAvailable()
    query.stop()
    return df.sparkSession.table(name)


def test_hourly_bars(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(str(tmp_path / "events"))
    stream = streaming.event_stream(spark, str(tmp_path / "events"), events.schema, files=100)
    got = {(r["symbol"], r["ts"]): r["close"] for r in drained(streaming.hourly_bars(stream), "bars_out").collect()}
    want = {(r["symbol"], r["ts"]): r["close"] for r in bars(spark, SF).collect()}
    assert got.items() <= want.items()
    last = max(t for _, t in want)
    assert all(k in got for k in want if k[1] < last - dt.timedelta(hours=2))


def test_positions_carry_state_over_batches(spark, tmp_path):
    z = [0, 2.5, 2, 0, -2.5, -1, 0, 3, -3, 1]
    start = dt.datetime(2024, 1, 1)
    rows = [("a", start + dt.timedelta(hours=i), float(v)) for i, v in enumerate(z)]
    schema = "symbol string, ts timestamp_ntz, z double"
    for i in range(0, len(rows), 3):
        spark.createDataFrame(rows[i : i + 3], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "z"))
    import pyspark.sql.types as T

    stream = streaming.event_stream(spark, str(tmp_path / "z"), T._parse_datatype_string(schema))
    out = drained(streaming.streaming_positions(stream, 2.0, 0.0), "positions_out").toPandas().sort_values("ts")
    assert out["position"].tolist() == folds.band_positions(pd.Series(z).to_numpy(), 2.0, 0.0).tolist()
