"""Joins of ordered data: pair panels, spells, calendars, gaps and last-known values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.rolling import change, cum, full, series


def pair_panel(y: DataFrame, x: DataFrame, key: str, date: str = "date", least: int = 252) -> DataFrame:
    """Both legs on common dates with 1-row returns, for keys with enough dates; legs are (key, date, close)."""
    both = y.select(key, date, F.col("close").alias("y")).join(x.select(key, date, F.col("close").alias("x")), [key, date]).na.drop()
    w = series(key, date)
    both = both.withColumn("n", F.count("*").over(Window.partitionBy(key))).where(F.col("n") >= least).drop("n")
    return both.withColumns({"y_ret": change("y", 1, w), "x_ret": change("x", 1, w)})


def members_by_day(calendar: DataFrame, spells: DataFrame, date: str = "date") -> DataFrame:
    """(date, symbol) on every calendar date inside a spell, ends included, open ends meaning the calendar's.

    Spells become days by sequence and meet the calendar in an equi-join, so no range join is needed.
    """
    edge = calendar.agg(F.min(date).alias("_a"), F.max(date).alias("_b"))
    days = spells.crossJoin(F.broadcast(edge)).select("symbol", F.greatest(F.coalesce("in_date", "_a"), F.col("_a")).alias("_from"), F.least(F.coalesce("out_date", "_b"), F.col("_b")).alias("_to"))
    days = days.where("_from <= _to").select("symbol", F.explode(F.sequence("_from", "_to")).alias(date)).distinct()
    return days.join(calendar, date)


def on_calendar(calendar: DataFrame, prices: DataFrame, n: int = 120, least: int = 120) -> DataFrame:
    """Every (date, symbol) of the calendar with its close or null, and valid: a close, and enough closes in the last n dates."""
    grid = calendar.crossJoin(F.broadcast(prices.select("symbol").distinct()))
    w = series("symbol", "date")
    out = grid.join(prices, ["date", "symbol"], "left")
    return out.withColumn("valid", F.col("close").isNotNull() & F.coalesce(full(F.count, "close", n, w, min_count=least) >= least, F.lit(False)))


def missing_bars(df: DataFrame, step: str = "1 hour", key: str = "symbol", ts: str = "ts") -> DataFrame:
    """(key, ts) of the regular grid from each key's first to last bar that have no row."""
    span = df.groupBy(key).agg(F.min(ts).alias("_a"), F.max(ts).alias("_b"))
    grid = span.select(key, F.explode(F.expr(f"sequence(_a, _b, interval {step})")).alias(ts))
    return grid.join(df.select(key, ts), [key, ts], "left_anti")


def last_known(df: DataFrame, stamps: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """df with the values of the latest stamp at or before each row (as-of join): union, then last non-null."""
    marked = stamps.select(*keys, order, F.struct(*values).alias("_v")).withColumn("_side", F.lit(0))
    rows = df.withColumn("_side", F.lit(1)).unionByName(marked, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(order, "_side").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    return rows.select(*df.columns, *[F.col("_v")[v].alias(v) for v in values])


def periods(df: DataFrame, breaks: list[str], date: str = "date") -> DataFrame:
    """period (0, 1, ...) of half-open slices between breakpoints."""
    out = F.lit(0)
    for b in breaks:
        out = out + (F.col(date) >= F.lit(b).cast("date")).cast("int")
    return df.withColumn("period", out)


def standardise_by(df: DataFrame, columns: list[str], key: list[str], where: str, population: bool = False) -> DataFrame:
    """Columns less their mean over the fitting rows of the key, by their deviation there (null for none)."""
    w = Window.partitionBy(*key)
    std = F.stddev_pop if population else F.stddev_samp
    fit = lambda c: F.when(F.expr(where), F.col(c))
    return df.withColumns({c: F.try_divide(F.col(c) - F.avg(fit(c)).over(w), std(fit(c)).over(w)) for c in columns})


def expanding_rank(df: DataFrame, x: str, out: str, key: str, order: str) -> DataFrame:
    """Percentile of each value among its key's values so far: (below + half of equal) / n * 100."""
    from tidemark.operators.folds import scan

    import bisect

    import numpy as np

    def run(c: dict) -> dict:
        seen: list[float] = []
        made = np.full(len(c[x]), np.nan)
        for i, v in enumerate(c[x].tolist()):
            if v == v:
                bisect.insort(seen, v)
                low, high = bisect.bisect_left(seen, v), bisect.bisect_right(seen, v)
                made[i] = (low + (high - low) / 2) / len(seen) * 100
        return {out: made}

    return scan(df, [key], order, run, [x], {out: "double"})


def expanding_z(df: DataFrame, x: str, out: str, key: str | list[str], order: str, least: int = 2) -> DataFrame:
    w = cum(series(key, order))
    return df.withColumn(out, F.when(F.count(x).over(w) >= least, F.try_divide(F.col(x) - F.avg(x).over(w), F.stddev_samp(x).over(w))))
