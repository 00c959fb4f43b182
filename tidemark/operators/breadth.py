"""Cross-sectional breadth of a constituent panel and the sentiment built on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.rolling import change, full, series
from tidemark.operators.alignment import expanding_rank, expanding_z
from tidemark.operators.cleaning import regime
from tidemark.operators.folds import ewm

BREADTH = ("new_high_low_net", "above_ma", "positive_return", "advance_decline")


def breadth(panel: DataFrame, extreme: int = 60, mean: int = 120, back: int = 20) -> DataFrame:
    """date, the four ratios and valid_stocks of a panel (date, symbol, close, valid): one window pass, one aggregate."""
    w = series("symbol", "date")
    c = F.col("close")
    p = panel.withColumns({"_hi": full(F.max, c, extreme, w), "_lo": full(F.min, c, extreme, w), "_ma": full(F.avg, c, mean, w), "_back": change(c, back, w), "_one": change(c, 1, w)})
    counted = lambda cond: F.count_if(F.coalesce(cond, F.lit(False)) & F.col("valid"))
    out = p.groupBy("date").agg(
        (counted(c >= F.col("_hi")) - counted(c <= F.col("_lo"))).alias("_net"), counted(c > F.col("_ma")).alias("_above"), counted(F.col("_back") > 0).alias("_positive"),
        (counted(F.col("_one") > 0) - counted(F.col("_one") < 0)).alias("_advance"), F.count_if("valid").alias("valid_stocks"),
    )
    parts = zip(BREADTH, ("_net", "_above", "_positive", "_advance"), strict=True)
    return out.select("date", *[F.try_divide(F.col(v), F.col("valid_stocks")).alias(k) for k, v in parts], "valid_stocks")


def signal_z(df: DataFrame, x: str, span: int, key: str, order: str, out: str = "signal_z") -> DataFrame:
    """Expanding percentile rank, EMA, expanding z-score."""
    df = ewm(expanding_rank(df, x, "_pct", key, order), {"_slow": ("_pct", {"span": span})}, key, order)
    return expanding_z(df, "_slow", out, key, order).drop("_pct", "_slow")


def composite(df: DataFrame, weights: dict[str, float], span: int, key: str, order: str) -> DataFrame:
    """sentiment_raw (weighted percentile ranks), sentiment_slow, sentiment_z and regime."""
    for x in weights:
        df = expanding_rank(df, x, f"{x}_pct", key, order)
    raw = sum((F.col(f"{x}_pct") * v for x, v in weights.items()), F.lit(0.0))
    df = ewm(df.withColumn("sentiment_raw", raw), {"sentiment_slow": ("sentiment_raw", {"span": span})}, key, order)
    df = expanding_z(df, "sentiment_slow", "sentiment_z", key, order)
    return df.withColumn("regime", regime(F.col("sentiment_z")))
