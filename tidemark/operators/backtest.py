"""Signals, positions and cost-aware backtests as window expressions over (symbol, ts).

Two timings exist and are not mixed: a position held over the next bar earns that bar's forward return
(monetise), or yesterday's position earns today's return (backtest_signal, signal_backtest).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.rolling import change, cum, first_turn, full, past, series, windowed



@windowed
def ma_signal(df: DataFrame, fast: int, slow: int, long_only: bool = False, w: WindowSpec | None = None) -> DataFrame:
    """ret, ma_fast, ma_slow, signal (0 until the slow mean exists), position (signal one bar later)."""
    df = df.withColumns({"ret": change("close", 1, w), "ma_fast": full(F.avg, "close", fast, w), "ma_slow": full(F.avg, "close", slow, w)})
    below = 0.0 if long_only else -1.0
    signal = F.when(F.col("ma_slow").isNull(), 0.0).when(F.col("ma_fast") > F.col("ma_slow"), 1.0).otherwise(below)
    df = df.withColumn("signal", signal)
    return df.withColumn("position", F.coalesce(F.lag("signal").over(w), F.lit(0.0)))


@windowed
def backtest_signal(df: DataFrame, fee_bps: float | Column = 2.0, w: WindowSpec | None = None) -> DataFrame:
    """turnover, cost, strategy_ret, and additive equity and buy_hold."""
    df = df.withColumn("turnover", first_turn("position", w))
    df = df.withColumn("cost", F.col("turnover") * fee_bps / 10_000)
    df = df.withColumn("strategy_ret", F.coalesce(F.col("position") * F.col("ret") - F.col("cost"), F.lit(0.0)))
    run = cum(w)
    return df.withColumn("equity", 1 + F.sum("strategy_ret").over(run)).withColumn("buy_hold", 1 + F.sum(F.coalesce("ret", F.lit(0.0))).over(run))


def performance_summary(df: DataFrame, keys: list[str], order: str = "ts", periods: int = 24 * 365) -> DataFrame:
    """Geometric annual return, volatility, their ratio, absolute drawdown, turnover."""
    w = series(keys, order)
    df = df.withColumn("_dd", F.col("equity") - F.max("equity").over(cum(w)))
    out = df.groupBy(*keys).agg(
        F.max_by("equity", order).alias("last"), F.count("*").alias("n"), (F.stddev_samp("strategy_ret") * F.sqrt(F.lit(float(periods)))).alias("annual_vol"),
        F.min("_dd").alias("max_drawdown"), F.avg("turnover").alias("average_turnover"),
    )
    out = out.withColumn("annual_return", F.when(F.col("last") > 0, F.pow("last", periods / F.col("n"))) - 1)
    return out.withColumn("total_return", F.col("last") - 1).withColumn("sharpe", F.when(F.col("annual_vol") > 0, F.try_divide("annual_return", "annual_vol")))


@windowed
def monetise(df: DataFrame, factor: str, target: str, n: int, high: float = 0.8, low: float = 0.2, fee_bps: float = 2.0, direction: int = 1, w: WindowSpec | None = None) -> DataFrame:
    """Long above the past high quantile of a factor, short below the low one; the position earns the target of its own row."""
    df = df.withColumn("factor", F.col(factor) * direction)
    frame = past(w, n)
    enough = F.count("factor").over(frame) >= n // 6
    df = df.withColumns({"q_high": F.when(enough, F.percentile("factor", F.lit(high)).over(frame)), "q_low": F.when(enough, F.percentile("factor", F.lit(low)).over(frame))})
    df = df.withColumn("position", F.when(F.col("factor") < F.col("q_low"), -1.0).when(F.col("factor") > F.col("q_high"), 1.0).otherwise(0.0))
    df = df.withColumn("turnover", first_turn("position", w))
    df = df.withColumn("pnl", F.col("position") * F.col(target) - F.col("turnover") * fee_bps / 10_000)
    return df.withColumn("equity", F.product(1 + F.coalesce("pnl", F.lit(0.0))).over(cum(w)))


def backtest_metrics(df: DataFrame, keys: list[str], order: str = "ts", periods: int = 24 * 365) -> DataFrame:
    """Metrics of a multiplicative equity curve; the drawdown is absolute."""
    w = series(keys, order)
    df = df.withColumn("_dd", F.col("equity") - F.max("equity").over(cum(w)))
    out = df.groupBy(*keys).agg(
        F.max_by("equity", order).alias("last"), F.count("equity").alias("n"), F.avg("pnl").alias("mean"), F.stddev_samp("pnl").alias("std"), F.min("_dd").alias("max_drawdown"),
        F.avg("turnover").alias("avg_turnover"), F.avg(F.abs("position")).alias("avg_exposure"), F.avg(F.when(F.col("pnl").isNotNull(), (F.col("pnl") > 0).cast("int"))).alias("win_rate"),
    )
    return out.withColumn("annual_return", F.when(F.col("last") > 0, F.pow("last", periods / F.col("n"))) - 1).withColumn("sharpe", F.try_divide("mean", "std") * F.sqrt(F.lit(float(periods))))


def split_rows(df: DataFrame, key: list[str], order: str = "ts", train: int = 6, valid: int = 2, names: tuple = ("train", "valid", "test")) -> DataFrame:
    """Chronological split in tenths of the rows: the first train, then valid, the rest last."""
    rn, n = F.row_number().over(series(key, order)) - 1, F.count(F.lit(1)).over(Window.partitionBy(*key))
    return df.withColumn("_rn", rn).withColumn("_n", n).withColumn("split", F.when(F.col("_rn") < F.floor(F.col("_n") * train / 10), names[0]).when(F.col("_rn") < F.floor(F.col("_n") * (train + valid) / 10), names[1]).otherwise(names[2])).drop("_rn", "_n")


def quantile_position(df: DataFrame, signal: str, q: float, key: list[str], lookback: int | None = None, order: str = "ts") -> DataFrame:
    """position 1 above the q quantile of the signal, -1 below the 1-q one: of the train split, or of the lookback rows before."""
    w = series(key, order)
    if lookback is None:
        seen = F.when(F.col("split") == "train", F.col(signal))
        frame, enough = Window.partitionBy(*key), F.lit(True)
    else:
        seen, frame = F.col(signal), past(w, lookback)
        enough = F.count(signal).over(frame) >= max(5, lookback // 4)
    df = df.withColumns({"_hi": F.when(enough, F.percentile(seen, F.lit(q)).over(frame)), "_lo": F.when(enough, F.percentile(seen, F.lit(1 - q)).over(frame))})
    s = F.col(signal)
    return df.withColumn("position", F.when(s < F.col("_lo"), -1.0).when(s > F.col("_hi"), 1.0).otherwise(0.0)).drop("_hi", "_lo")


def lagged_pnl(df: DataFrame, key: list[str], ret: str = "ret", fee_bps: float | Column = 2.0, order: str = "ts") -> DataFrame:
    """turnover, fee and pnl of yesterday's position on today's return."""
    w = series(key, order)
    df = df.withColumn("turnover", first_turn("position", w)).withColumn("fee", F.col("turnover") * fee_bps / 10_000)
    return df.withColumn("pnl", F.coalesce(F.lag("position").over(w), F.lit(0.0)) * F.col(ret) - F.col("fee"))


def signal_metrics(df: DataFrame, key: list[str], order: str = "ts", periods: int = 24 * 365) -> DataFrame:
    """Arithmetic annual figures of pnl by key; equity is additive and restarts in every group."""
    w = series(key, order)
    df = df.withColumn("_eq", 1 + F.sum(F.coalesce("pnl", F.lit(0.0))).over(cum(w)))
    df = df.withColumn("_dd", F.col("_eq") - F.max("_eq").over(cum(w))).withColumn("_turn", first_turn("position", w))
    both = F.col("signal").isNotNull() & F.col("ret").isNotNull()
    out = df.groupBy(*key).agg(
        (F.avg("pnl") * periods).alias("ann_return"), (F.stddev_samp("pnl") * F.sqrt(F.lit(float(periods)))).alias("ann_vol"), F.min("_dd").alias("max_drawdown"), F.sum("pnl").alias("total_return"),
        F.avg(F.when(F.col("pnl").isNotNull(), (F.col("pnl") > 0).cast("int"))).alias("hit_rate"), F.avg(F.abs("position")).alias("avg_abs_position"), F.avg("_turn").alias("turnover_per_bar"),
        F.when(F.count(F.when(both, 1)) > 1, F.corr("signal", "ret")).alias("ic"),
    )
    return out.withColumn("sharpe", F.try_divide("ann_return", "ann_vol"))


def calendar_returns(df: DataFrame, key: list[str], order: str = "ts") -> DataFrame:
    """Compounded pnl per key and calendar period (month, quarter, year): calendar, period_end, period_return."""
    day = F.col(order).cast("date")
    df = df.where("pnl is not null").select(*key, "pnl", F.explode(F.array(F.struct(F.lit("month").alias("calendar"), F.last_day(day).alias("period_end")),
        F.struct(F.lit("quarter").alias("calendar"), F.last_day(F.add_months(F.trunc(day, "quarter"), 2)).alias("period_end")),
        F.struct(F.lit("year").alias("calendar"), F.last_day(F.add_months(F.trunc(day, "year"), 11)).alias("period_end")))).alias("c"))
    return df.groupBy(*key, "c.calendar", "c.period_end").agg((F.product(1 + F.col("pnl")) - 1).alias("period_return"))


def calendar_summary(periods: DataFrame, key: list[str]) -> DataFrame:
    r = F.col("period_return")
    return periods.groupBy(*key, "calendar").agg(F.count("*").alias("n_periods"), F.avg(r).alias("mean_return"), F.stddev_samp(r).alias("std_return"), F.avg((r > 0).cast("int")).alias("win_rate"), (F.product(1 + r) - 1).alias("total_return"))


def count_entries(position: Column, before: Column) -> Column:
    """Entries from flat, a non-zero first bar included; a flip is none."""
    return F.count_if((position != 0) & (F.coalesce(before, F.lit(0.0)) == 0))


def round_trips(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """n_trades (a flip starts a new one), avg_holding, time_in_market, by gaps and islands of equal position."""
    w = series(key, order)
    df = df.withColumn("_new", F.coalesce((F.col("position") != F.lag("position").over(w)).cast("int"), F.lit(1)))
    df = df.withColumn("_run", F.sum("_new").over(cum(w)))
    runs = df.groupBy(*key, "_run").agg(F.first("position").alias("position"), F.count("*").alias("bars"))
    held = F.when(F.col("position") != 0, F.col("bars"))
    return runs.groupBy(*key).agg(F.count(held).alias("n_trades"), F.coalesce(F.avg(held), F.lit(0.0)).alias("avg_holding"), (F.coalesce(F.sum(held), F.lit(0)) / F.sum("bars")).alias("time_in_market"))


def pair_backtest(df: DataFrame, key: list[str], order: str, beta: str | float, cost_bps: float | Column = 5.0, capital: float = 1.0) -> DataFrame:
    """Yesterday's position on the change of y - beta x per yesterday's gross notional, minus cost of both legs; equity compounds.

    The first bar, which has no change, has no pnl. beta may be a column that varies; the spread change then uses yesterday's beta.
    """
    w = series(key, order)
    b = F.col(beta) if isinstance(beta, str) else F.lit(float(beta))
    df = df.withColumn("_b", F.lag(b).over(w)).withColumn("_py", F.lag("y").over(w)).withColumn("_px", F.lag("x").over(w)).withColumn("_pp", F.coalesce(F.lag("position").over(w), F.lit(0.0)))
    gross = F.abs("_py") + F.abs(F.col("_b") * F.col("_px"))
    gain = F.try_divide(F.col("y") - F.col("_py") - F.col("_b") * (F.col("x") - F.col("_px")), gross)
    df = df.withColumn("turnover", first_turn("position", w))
    df = df.withColumn("pnl", F.col("_pp") * gain - 2 * F.col("turnover") * cost_bps / 10_000)
    return df.withColumn("equity", capital * F.product(1 + F.coalesce("pnl", F.lit(0.0))).over(cum(w))).drop("_b", "_py", "_px", "_pp")


def nav_backtest(df: DataFrame, key: list[str], order: str, commission: float = 0.0002, stamp: float = 0.001, slippage: float = 0.0, leverage: float = 1.0, capital: float = 1_000_000.0) -> DataFrame:
    """NAV of a position (0..leverage) in an index: the cost of a bar is a share of NAV that does not depend on
    NAV, so NAV is the capital times a running product."""
    w = series(key, order)
    df = df.withColumn("position", F.least(F.greatest(F.col("position"), F.lit(0.0)), F.lit(leverage)))
    move = F.col("position") - F.coalesce(F.lag("position").over(w), F.col("position"))
    df = df.withColumn("cost", F.abs(move) * (commission + slippage) + F.greatest(-move, F.lit(0.0)) * stamp)
    df = df.withColumn("ret", change("index_close", 1, w))
    df = df.withColumn("cost", F.when(F.col("ret").isNotNull(), F.col("cost")).otherwise(0.0))
    df = df.withColumn("net", F.coalesce(F.col("position") * F.col("ret") - F.col("cost"), F.lit(0.0)))
    df = df.withColumn("nav", capital * F.product(1 + F.col("net")).over(cum(w)))
    return df.withColumn("benchmark", capital * F.product(1 + F.coalesce("ret", F.lit(0.0))).over(cum(w)))


def nav_summary(df: DataFrame, key: list[str], order: str, days: int = 252) -> DataFrame:
    """Return of the segment, its annualised growth, relative drawdown, Sharpe (population deviation), trades, mean
    position and excess over the benchmark, by key; windows restart in every group."""
    w = series(key, order)
    df = df.withColumn("_dd", F.col("nav") / F.max("nav").over(cum(w)) - 1).withColumn("_moved", F.abs(F.col("position") - F.lag("position").over(w)) > 1e-9)
    out = df.groupBy(*key).agg(
        F.count("*").alias("n_days"), (F.max_by("nav", order) / F.min_by("nav", order) - 1).alias("total_return"), (F.max_by("benchmark", order) / F.min_by("benchmark", order) - 1).alias("benchmark_return"),
        F.product(1 + F.col("net")).alias("_grown"), F.avg("net").alias("_mean"), F.stddev_pop("net").alias("_std"), F.min("_dd").alias("max_drawdown"), F.count_if("_moved").alias("n_trades"), F.avg("position").alias("avg_position"),
        F.sum(F.col("cost") * F.col("nav") / (1 + F.col("net"))).alias("total_cost"),
    )
    out = out.withColumn("annualized_return", F.when(F.col("_grown") > 0, F.pow("_grown", days / F.col("n_days"))) - 1)
    return out.withColumn("sharpe", F.when(F.col("n_days") > 1, F.try_divide("_mean", "_std") * F.sqrt(F.lit(float(days))))).withColumn("excess_return", F.col("total_return") - F.col("benchmark_return")).drop("_grown", "_mean", "_std")
