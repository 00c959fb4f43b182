"""Technical indicators as frame-to-frame functions: each adds columns to bars keyed by (symbol, ts).

All windows share one partitioning and order, so a chain of indicators needs one exchange and one sort.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.rolling import ahead, change, cum, full, past, roll, series, windowed
from tidemark.operators.folds import ewm_values, scan



def __getattr__(name: str) -> WindowSpec:
    """W, the window of a bar table; made on use, as it needs a session."""
    if name == "W":
        return series()
    raise AttributeError(name)


@windowed
def zscore(df: DataFrame, x: str, n: int, out: str, w: WindowSpec | None = None) -> DataFrame:
    return df.withColumn(out, F.try_divide(F.col(x) - full(F.avg, x, n, w), full(F.stddev_samp, x, n, w)))


@windowed
def momentum(df: DataFrame, k: int, out: str, x: str = "close", w: WindowSpec | None = None) -> DataFrame:
    return df.withColumn(out, change(x, k, w))


@windowed
def reversal(df: DataFrame, k: int, out: str, x: str = "close", w: WindowSpec | None = None) -> DataFrame:
    return df.withColumn(out, -change(x, k, w))


@windowed
def volume_price_trend(df: DataFrame, n: int, out: str, w: WindowSpec | None = None) -> DataFrame:
    df = zscore(df.withColumn("_ret", change("close", 1, w)), "volume", n, "_volume_z", w)
    return df.withColumn(out, full(F.sum, "_ret", n, w) * F.col("_volume_z")).drop("_ret", "_volume_z")


@windowed
def range_position(df: DataFrame, n: int, out: str, w: WindowSpec | None = None) -> DataFrame:
    low = full(F.min, "low", n, w)
    return df.withColumn(out, F.try_divide(F.col("close") - low, full(F.max, "high", n, w) - low) - 0.5)


@windowed
def rsi(df: DataFrame, n: int, out: str, w: WindowSpec | None = None, move: str = "return") -> DataFrame:
    """Simple-mean RSI of returns or of price differences; without losses it is 100, without any move null."""
    step = change("close", 1, w) if move == "return" else F.col("close") - F.lag("close").over(w)
    df = df.withColumn("_r", step)
    gain = full(F.avg, F.when(F.col("_r").isNotNull(), F.greatest(F.col("_r"), F.lit(0.0))), n, w)
    loss = full(F.avg, F.when(F.col("_r").isNotNull(), F.greatest(-F.col("_r"), F.lit(0.0))), n, w)
    df = df.withColumn("_gain", gain).withColumn("_loss", loss)
    value = F.when((F.col("_loss") == 0) & (F.col("_gain") > 0), F.lit(100.0)).otherwise(100 - F.try_divide(F.lit(100.0), 1 + F.try_divide("_gain", "_loss")))
    return df.withColumn(out, value).drop("_r", "_gain", "_loss")


@windowed
def volatility(df: DataFrame, n: int, out: str, w: WindowSpec | None = None) -> DataFrame:
    df = df.withColumn("_ret", change("close", 1, w))
    return df.withColumn(out, full(F.stddev_samp, "_ret", n, w)).drop("_ret")


@windowed
def autocorrelation(df: DataFrame, n: int, out: str, w: WindowSpec | None = None) -> DataFrame:
    df = df.withColumn("_ret", change("close", 1, w))
    df = df.withColumn("_before", F.lag("_ret").over(w))
    both = F.when(F.col("_ret").isNotNull() & F.col("_before").isNotNull(), 1)
    value = F.when(F.count(both).over(roll(w, n)) == n, F.corr("_ret", "_before").over(roll(w, n)))
    return df.withColumn(out, value).drop("_ret", "_before")


@windowed
def bollinger_position(df: DataFrame, n: int, out: str, n_std: float = 2.0, w: WindowSpec | None = None) -> DataFrame:
    mid, std = full(F.avg, "close", n, w), full(F.stddev_samp, "close", n, w)
    return df.withColumn(out, F.try_divide(F.col("close") - (mid - n_std * std), 2 * n_std * std))


@windowed
def distance_from_ma(df: DataFrame, n: int, out: str, w: WindowSpec | None = None) -> DataFrame:
    return df.withColumn(out, F.try_divide(F.col("close"), full(F.avg, "close", n, w)) - 1)


@windowed
def money_flow(df: DataFrame, n: int, out: str, w: WindowSpec | None = None) -> DataFrame:
    df = df.withColumn("_tp", (F.col("high") + F.col("low") + F.col("close")) / 3.0)
    df = df.withColumn("_before", F.lag("_tp").over(w)).withColumn("_flow", F.col("_tp") * F.col("volume"))
    up = F.when(F.col("_tp") > F.col("_before"), F.col("_flow")).otherwise(0.0)
    down = F.when(F.col("_tp") < F.col("_before"), F.col("_flow")).otherwise(0.0)
    ratio = F.try_divide(full(F.sum, up, n, w), F.nullif(full(F.sum, down, n, w), F.lit(0.0)))
    return df.withColumn(out, 100 - F.try_divide(F.lit(100.0), 1 + ratio)).drop("_tp", "_before", "_flow")


@windowed
def stochastic(df: DataFrame, x: str, n: int, out: str, w: WindowSpec | None = None) -> DataFrame:
    low, high = full(F.min, x, n, w), full(F.max, x, n, w)
    return df.withColumn(out, F.try_divide(F.col(x) - low, high - low) * 100)


def macd_values(close: np.ndarray, fast: int = 12, slow: int = 26, signal: int = 9) -> np.ndarray:
    """(MACD - its signal line) / close of one series."""
    macd = ewm_values(close, 2 / (fast + 1)) - ewm_values(close, 2 / (slow + 1))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(close != 0, (macd - ewm_values(macd, 2 / (signal + 1))) / close, np.nan)


def stochastic_values(x: np.ndarray, n: int) -> np.ndarray:
    """Place of each value in the range of the last n, 0 to 100; null without n values or without a range."""
    out = np.full(len(x), np.nan)
    if len(x) >= n:
        rows = np.lib.stride_tricks.sliding_window_view(x, n)
        low, high = rows.min(axis=1), rows.max(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            out[n - 1 :] = np.where(high > low, (x[n - 1 :] - low) / (high - low) * 100, np.nan)
    return out


def trend_cycle_values(close: np.ndarray, cycle: int = 10) -> np.ndarray:
    """MACD, stochastic, EMA 3, stochastic, EMA 3 of one series."""
    macd = ewm_values(close, 2 / 13) - ewm_values(close, 2 / 27)
    return ewm_values(stochastic_values(ewm_values(stochastic_values(macd, cycle), 0.5), cycle), 0.5)


def directional_values(tr: np.ndarray, plus: np.ndarray, minus: np.ndarray, n: int = 14) -> dict[str, np.ndarray]:
    """plus_di, minus_di and adx of one series, with Wilder smoothing (alpha 1/n, n values needed)."""
    atr, up, down = (ewm_values(x, 1 / n, n) for x in (tr, plus, minus))
    with np.errstate(divide="ignore", invalid="ignore"):
        up, down = (np.where(atr != 0, 100 * x / atr, np.nan) for x in (up, down))
        dx = np.where(up + down != 0, 100 * np.abs(up - down) / (up + down), np.nan)
    return {"plus_di": up, "minus_di": down, "adx": ewm_values(dx, 1 / n, n)}


def macd_normalized(df: DataFrame, out: str, fast: int = 12, slow: int = 26, signal: int = 9, key: str = "symbol", order: str = "ts") -> DataFrame:
    return scan(df, [key], order, lambda c: {out: macd_values(c["close"], fast, slow, signal)}, ["close"], {out: "double"})


def schaff_trend_cycle(df: DataFrame, out: str, cycle: int = 10, key: str = "symbol", order: str = "ts") -> DataFrame:
    return scan(df, [key], order, lambda c: {out: trend_cycle_values(c["close"], cycle)}, ["close"], {out: "double"})


@windowed
def true_range(df: DataFrame, out: str, w: WindowSpec | None = None) -> DataFrame:
    before = F.lag("close").over(w)
    return df.withColumn(out, F.greatest(F.abs(F.col("high") - F.col("low")), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))


@windowed
def average_true_range(df: DataFrame, n: int, out: str, w: WindowSpec | None = None) -> DataFrame:
    df = true_range(df, "_tr", w)
    return df.withColumn(out, full(F.avg, "_tr", n, w, min_count=max(5, n // 4))).drop("_tr")


def directional_moves(df: DataFrame, w: WindowSpec) -> DataFrame:
    """_tr, _plus, _minus: true range and directional moves."""
    df = true_range(df.withColumn("_up", F.col("high") - F.lag("high").over(w)).withColumn("_down", F.lag("low").over(w) - F.col("low")), "_tr", w)
    plus = F.when((F.col("_up") > F.col("_down")) & (F.col("_up") > 0), F.col("_up")).otherwise(0.0)
    minus = F.when((F.col("_down") > F.col("_up")) & (F.col("_down") > 0), F.col("_down")).otherwise(0.0)
    return df.withColumns({"_plus": plus, "_minus": minus}).drop("_up", "_down")


def directional_movement(df: DataFrame, n: int = 14, key: str = "symbol", order: str = "ts") -> DataFrame:
    """plus_di, minus_di and adx."""
    df = directional_moves(df, series(key, order))
    made = scan(df, [key], order, lambda c: directional_values(c["_tr"], c["_plus"], c["_minus"], n), ["_tr", "_plus", "_minus"], dict.fromkeys(("plus_di", "minus_di", "adx"), "double"))
    return made.drop("_tr", "_plus", "_minus")


@windowed
def on_balance_volume(df: DataFrame, out: str, w: WindowSpec | None = None) -> DataFrame:
    df = df.withColumn("_sign", F.coalesce(F.signum(F.col("close") - F.lag("close").over(w)), F.lit(0.0)))
    return df.withColumn(out, F.sum(F.col("_sign") * F.col("volume")).over(cum(w))).drop("_sign")


@windowed
def rolling_correlation(df: DataFrame, x: str, y: str, n: int, out: str, w: WindowSpec | None = None) -> DataFrame:
    both = F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)
    return df.withColumn(out, F.when(F.count(both).over(roll(w, n)) == n, F.corr(x, y).over(roll(w, n))))


@windowed
def past_quantiles(df: DataFrame, x: str, n: int, levels: dict[str, float], min_count: int, w: WindowSpec | None = None) -> DataFrame:
    """Quantiles of the n rows before each row, null with fewer than min_count values there."""
    frame = past(w, n)
    enough = F.count(x).over(frame) >= min_count
    return df.withColumns({out: F.when(enough, F.percentile(x, F.lit(q)).over(frame)) for out, q in levels.items()})


def alpha_dataset(df: DataFrame, week: int = 168, key: str = "symbol", order: str = "ts") -> DataFrame:
    """Returns, the next return and 24 factors; week is the number of bars of a week."""
    w = series(key, order)
    df = df.withColumn("ret_1h", change("close", 1, w)).withColumn("future_ret_1h", ahead("close", 1, w))
    for k in (4, 12, 26, 52):
        df = momentum(df, k * week, f"factor_mom_{k}w", w=w)
    for k in (1, 2):
        df = reversal(df, k * week, f"factor_rev_{k}w", w=w)
    for k in (4, 12, 26):
        df = volatility(df, k * week, f"factor_vol_{k}w", w)
    df = df.withColumn("factor_vol_change", F.try_divide("factor_vol_4w", F.nullif("factor_vol_12w", F.lit(0.0))))
    df = autocorrelation(df, 12 * week, "factor_ret_autocorr_12w", w)
    df = volume_price_trend(df, 24, "factor_vol_price", w)
    df = range_position(df, 48, "factor_range_pos", w)
    df = rsi(df, 14, "factor_rsi_14", w)
    df = bollinger_position(df, 20, "factor_bb_position_20", w=w)
    for n in (10, 50):
        df = distance_from_ma(df, n, f"factor_dist_ma_{n}", w)
    df = money_flow(df, 14, "factor_mfi_14", w)
    # All recurrences in one scan of a series, so the factors need one more exchange and no second one.
    df = directional_moves(df, w)
    names = {"plus_di": "factor_plus_di", "minus_di": "factor_minus_di", "adx": "factor_adx"}

    def recurrences(c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        dmi = directional_values(c["_tr"], c["_plus"], c["_minus"], 14)
        return {names[k]: v for k, v in dmi.items()} | {"factor_macd_signal": macd_values(c["close"]), "factor_stc": trend_cycle_values(c["close"])}

    outputs = ["factor_macd_signal", "factor_stc", *names.values()]
    df = scan(df, [key], order, recurrences, ["close", "_tr", "_plus", "_minus"], dict.fromkeys(outputs, "double")).drop("_tr", "_plus", "_minus")
    return df.withColumn("factor_dmi_spread", F.col("factor_plus_di") - F.col("factor_minus_di"))
