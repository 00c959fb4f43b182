"""Readers, derived tables and sinks.

Tables are Parquet paths that only Spark opens. Derived tables give the shapes the operators work on: hourly
bars, a pair panel, constituent prices with calendar, index and membership spells, and a labelled table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of event values: symbol, ts, open, high, low, close, volume."""
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("symbol"), hour.alias("hour"))
        .agg(F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"), F.count("*").alias("volume"))
        .withColumnRenamed("hour", "ts")
    )


def pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily mean order prices of two priorities: date, y, x."""
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "5-LOW"))
    leg = lambda p: F.avg(F.when(F.col("o_orderpriority") == p, F.col("o_totalprice")))
    out = orders.groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(leg("1-URGENT").alias("y"), leg("5-LOW").alias("x"))
    return out.where("y is not null and x is not null")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily mean unit price by brand: date, symbol, close."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_shipdate").cast("date").alias("date"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("p"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("symbol"))
    return lines.join(parts, "l_partkey").groupBy("date", "symbol").agg(F.avg("p").alias("close"))


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("date")).distinct()


def index_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_shipdate").cast("date").alias("date")).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("close"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership spells with open ends: symbol, in_date, out_date."""
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("symbol")).distinct()
    k = F.row_number().over(Window.orderBy("symbol"))
    start = F.lit("1995-01-01").cast("date")
    rows = brands.withColumn("k", k)
    return rows.select("symbol", F.date_add(start, (F.col("k") * 30).cast("int")).alias("in_date"), F.when(F.col("k") % 3 != 0, F.date_add(start, (F.col("k") * 30 + 1500).cast("int"))).alias("out_date"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, quality, toxic."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id")


#: Moduli and multipliers of the deterministic normal stream.
MODULUS = 2147483647


def normals(spark: SparkSession, n: int, start: int = 0) -> DataFrame:
    """id, z: n standard normal numbers that depend on the id alone (four modular mixes and Box-Muller)."""
    return spark.range(start, start + n).withColumn("z", normal_of(F.col("id")))


def normal_of(i: Column) -> Column:
    def mixed(x: Column) -> Column:
        x = (x * 48271 + 11) % MODULUS
        x = (x * x + 12345) % MODULUS
        x = (x * 69621 + 7) % MODULUS
        return (x * x + 777) % MODULUS

    unit = lambda x: (mixed(x) + F.lit(0.5)) / F.lit(2147483648.0)
    return F.sqrt(-2 * F.log(unit(2 * i + 1))) * F.cos(2 * F.pi() * unit(2 * i + 2))


def demo_bars(spark: SparkSession, symbols: Iterable[str], periods: int, start: str = "2020-01-01", drift: float = 0.00002, vol: float = 0.015) -> DataFrame:
    """Deterministic random-walk bars: open is the close before, high and low lie a random spread outside."""
    names = [(s, sum(map(ord, s))) for s in symbols]
    base = spark.createDataFrame(names, "symbol string, seed long").crossJoin(spark.range(periods))
    at = F.col("seed") * 1_000_003 + F.col("id") * 3
    w = Window.partitionBy("symbol").orderBy("id")
    out = base.withColumn("close", 100 * F.exp(F.sum(drift + vol * normal_of(at)).over(w.rowsBetween(Window.unboundedPreceding, 0))))
    out = out.withColumn("open", F.coalesce(F.lag("close").over(w), F.col("close")))
    spread = F.abs(0.004 * F.col("close") * normal_of(at + 1))
    ts = F.timestamp_seconds(F.unix_timestamp(F.lit(start), "yyyy-MM-dd") + F.col("id") * 3600).cast("timestamp_ntz")
    return out.select("symbol", ts.alias("ts"), "open", (F.greatest("open", "close") + spread).alias("high"), (F.least("open", "close") - spread).alias("low"), "close", F.abs(1000 + 300 * normal_of(at + 2)).alias("volume"))


def first_available(*readers: Callable[[], DataFrame]) -> DataFrame:
    """The first reader whose source can be read; the fallback takes the place of all that failed."""
    failure: Exception | None = None
    for read in readers:
        try:
            return read()
        except Exception as e:  # noqa: BLE001 - any failure of a source selects the next
            failure = e
    raise failure or ValueError("no reader")


OHLCV = T.StructType([T.StructField("timestamp", T.StringType())] + [T.StructField(c, T.StringType()) for c in ("open", "high", "low", "close", "volume")])


def read_csv(spark: SparkSession, path: str | list[str], columns: list[str] | None = None, schema: T.StructType | None = None) -> DataFrame:
    """CSV files (also by glob), only the named columns; text unless a schema is given."""
    out = spark.read.csv(path, header=True, schema=schema)
    return out.select(*columns) if columns else out


def read_config(spark: SparkSession, path: str, defaults: dict[str, float]) -> dict[str, float]:
    """Lines of key: value; unknown keys and comments are skipped, missing ones keep their default."""
    out = dict(defaults)
    lines = spark.read.text(path).select(F.trim(F.split("value", "#")[0]).alias("line")).where(F.contains("line", F.lit(":")))
    pairs = lines.select(F.trim(F.substring_index("line", ":", 1)).alias("key"), F.expr("try_cast(trim(substr(line, instr(line, ':') + 1)) as double)").alias("value"))
    for row in pairs.where(F.col("key").isin(list(defaults))).collect():
        if row["value"] is not None:
            out[row["key"]] = row["value"]
    return out


def write_table(df: DataFrame, path: str, partition_by: str | None = None, kind: str = "parquet") -> None:
    """Parquet partitioned by a key, or CSV with header."""
    writer = df.write.mode("overwrite").option("header", True)
    (writer.partitionBy(partition_by) if partition_by else writer).format(kind).save(path)


def closes(df: DataFrame, column: str = "close") -> DataFrame:
    """The close as double, without rows that have none."""
    return df.withColumn(column, F.expr(f"try_cast({column} as double)")).where(F.col(column).isNotNull())
