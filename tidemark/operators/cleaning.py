"""Parsing, type inference and row cleaning. Unparsable values become null; nothing is guessed silently."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Date formats tried in order.
DATE_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "yyyyMMdd", "yyyy-MM-dd HH:mm:ss", "dd.MM.yyyy")


def number(text: Column) -> Column:
    """Double of a text that may hold thousands commas."""
    return F.regexp_replace(text, ",", "").try_cast("double")


def mixed_date(text: Column) -> Column:
    """Date of a text in any of DATE_FORMATS."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS]).cast("date")


def auto_timestamp(df: DataFrame, column: str, out: str) -> DataFrame:
    """Timestamps of a text column: if more than 80 % are numbers, epochs whose unit follows from the median
    magnitude (s, ms, us, ns), else ISO texts. One aggregate over the column, joined back as one row."""
    x = F.col(column).try_cast("double")
    stats = df.agg((F.count(x) / F.count(F.lit(1))).alias("_share"), F.percentile(F.abs(x), F.lit(0.5)).alias("_median"))
    scale = F.when(F.col("_median") > 1e17, 1e9).when(F.col("_median") > 1e14, 1e6).when(F.col("_median") > 1e11, 1e3).otherwise(1.0)
    epoch = F.timestamp_micros((x / scale * 1e6).cast("long")).cast("timestamp_ntz")
    iso = F.try_to_timestamp(F.regexp_replace(F.col(column), "T", " ")).cast("timestamp_ntz")
    return df.crossJoin(F.broadcast(stats)).withColumn(out, F.when(F.col("_share") > 0.8, epoch).otherwise(iso)).drop("_share", "_median")


def clean_bars(df: DataFrame, order: str, key: str = "symbol", ts: str = "ts", values: tuple = ("open", "high", "low", "close", "volume")) -> DataFrame:
    """Rows with a timestamp, the first by order of each (key, ts), numbers cast, rows with any null dropped."""
    first = F.row_number().over(Window.partitionBy(key, ts).orderBy(order)) == 1
    df = df.where(F.col(ts).isNotNull()).withColumn("_first", first).where("_first").drop("_first")
    return df.withColumns({c: F.col(c).try_cast("double") for c in values}).na.drop(subset=list(values))


def numeric_columns(df: DataFrame) -> tuple[list[str], list[str]]:
    """Names of numeric and of other columns."""
    kinds = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    numbers = [c for c, t in df.dtypes if t in kinds or t.startswith("decimal")]
    return numbers, [c for c in df.columns if c not in numbers]


def column_kinds(df: DataFrame, columns: list[str], share: float = 0.85) -> DataFrame:
    """column, kind (number, date, id or text) of text columns, from one pass over the data."""
    facts = []
    for c in columns:
        x = F.col(c)
        facts.append(F.struct(F.lit(c).alias("column"), F.try_divide(F.count(x.try_cast("double")), F.count(x)).alias("numbers"), F.try_divide(F.count(mixed_date(x)), F.count(x)).alias("dates"), F.try_divide(F.count_distinct(x), F.count(x)).alias("distinct")))
    rows = df.agg(F.array(*facts).alias("f")).select(F.explode("f").alias("f")).select("f.*")
    kind = F.when(F.col("numbers") > share, "number").when(F.col("dates") > share, "date").when(F.col("distinct") > share, "id").otherwise("text")
    return rows.withColumn("kind", kind)


def date_parts(df: DataFrame, column: str) -> DataFrame:
    """Year, month, day and weekday (Monday 0) of a date in place of it."""
    d = F.col(column)
    return df.withColumns({f"{column}_year": F.year(d), f"{column}_month": F.month(d), f"{column}_day": F.dayofmonth(d), f"{column}_weekday": F.weekday(d)}).drop(column)


def binary_label(label: Column, positive: str = "completed", skip: str = "in progress") -> Column:
    """1 for the positive label, null for the one to skip, 0 for others and for null."""
    low = F.lower(label)
    return F.when(low == skip, F.lit(None)).otherwise(F.coalesce((low == positive).cast("int"), F.lit(0)))


def fill_missing(df: DataFrame, medians: DataFrame, numbers: list[str], texts: list[str]) -> DataFrame:
    """Numbers take the fitted median (one row of params named as the columns), texts the word Missing."""
    params = medians.select(*[F.col(c).alias(f"_m_{c}") for c in numbers])
    df = df.crossJoin(F.broadcast(params)).withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_m_{c}")) for c in numbers})
    return df.withColumns({c: F.coalesce(F.col(c), F.lit("Missing")) for c in texts}).drop(*[f"_m_{c}" for c in numbers])


def medians(df: DataFrame, numbers: list[str]) -> DataFrame:
    return df.agg(*[F.percentile(c, F.lit(0.5)).alias(c) for c in numbers])


def align(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of like, in its order."""
    return df.select(*like.columns)


def ordinal(level: Column, order: tuple[str, ...] = ("beginner", "intermediate", "advanced"), default: int = 1) -> Column:
    """Place of a level name, counted from 1; unknown and null get the default."""
    out = F.lit(default)
    for i, name in reversed(list(enumerate(order))):
        out = F.when(F.lower(level) == name, i + 1).otherwise(out)
    return out


def slug(text: Column) -> Column:
    """Lower case, runs of other characters than letters and digits as one underscore, none at the ends."""
    out = F.btrim(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", "_"), F.lit("_"))
    return F.when(out == "", "factor").otherwise(out)


def regime(z: Column, high: float = 1.0, low: float = -1.0) -> Column:
    return F.when(z > high, "overheated").when(z < low, "overcooled").when(z.isNotNull(), "neutral")
