"""Queries of signals, backtests and their metrics over hourly bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import rolling as R
from tidemark.functions import technical as X
from tidemark.operators import backtest as B
from tidemark.plans.registry import query
from tidemark.queries.windows import CHANGE, RSI_T, W, lag, past_q, roll, simple
from tidemark.sources.tables import bars

CUM = f"OVER ({W} ROWS UNBOUNDED PRECEDING)"


def turn(p: str = "position", by: str = W) -> str:
    return f"coalesce(abs({p} - lag({p}) OVER ({by})), abs({p}))"


# Returns of these bars are large, so equity curves that compound use a hundredth of them.
SMALL = f"SELECT *, ({CHANGE}) / 100 AS ret FROM v1"


def small(b: DataFrame) -> DataFrame:
    return b.withColumn("ret", R.change("close", 1, X.W) / 100)


simple(
    "w21_quantile_monetization",
    lambda b: B.monetise(X.rsi(b, 14, "f").withColumn("t", R.ahead("close", 1, X.W) / 100), "f", "t", 60, direction=-1),
    f"""WITH {RSI_T}, d AS (SELECT symbol, ts, -f AS f, t / 100 AS t FROM fac),
    q AS (SELECT *, {past_q('f', 60, 0.8, 10)} AS q_high, {past_q('f', 60, 0.2, 10)} AS q_low FROM d),
    p AS (SELECT *, CASE WHEN f < q_low THEN -1.0 WHEN f > q_high THEN 1.0 ELSE 0.0 END AS position FROM q),
    n AS (SELECT *, {turn()} AS turnover FROM p), gp AS (SELECT *, position * t - turnover * 2 / 10000 AS pnl FROM n)
    SELECT *, product(1 + coalesce(pnl, 0)) {CUM} AS equity FROM gp""",
    "position turnover pnl equity",
    digits=5,
)


def ma_sql(fast: int, slow: int, below: float) -> str:
    return f"""m AS (SELECT *, {CHANGE} AS ret, {roll('avg', 'close', fast)} AS ma_fast, {roll('avg', 'close', slow)} AS ma_slow FROM v1),
    s AS (SELECT *, CASE WHEN ma_slow IS NULL THEN 0.0 WHEN ma_fast > ma_slow THEN 1.0 ELSE {below} END AS signal FROM m),
    p AS (SELECT *, coalesce({lag('signal')}, 0.0) AS position FROM s)"""


BT = f"""t AS (SELECT *, {turn()} AS turnover FROM p), c AS (SELECT *, turnover * 2.0 / 10000 AS cost FROM t),
    r AS (SELECT *, coalesce(position * ret - cost, 0) AS strategy_ret FROM c),
    e AS (SELECT *, 1 + sum(strategy_ret) {CUM} AS equity, 1 + sum(coalesce(ret, 0)) {CUM} AS buy_hold FROM r)"""
simple("w22_ma_signal", lambda b: B.ma_signal(b, 5, 20), f"WITH {ma_sql(5, 20, -1.0)} SELECT * FROM p", "ma_fast ma_slow signal position")
simple("w23_ma_signal_long_only", lambda b: B.ma_signal(b, 5, 20, long_only=True), f"WITH {ma_sql(5, 20, 0.0)} SELECT * FROM p", "signal position")
simple("w24_backtest_signal", lambda b: B.backtest_signal(B.ma_signal(b, 5, 20)), f"WITH {ma_sql(5, 20, -1.0)}, {BT} SELECT * FROM e", "turnover cost strategy_ret equity buy_hold", digits=5)
PERF = f"""f AS (SELECT symbol, max_by(equity, ts) AS last, count(*) AS n, stddev_samp(strategy_ret) * sqrt(8760.0) AS annual_vol, min(dd) AS max_drawdown, avg(turnover) AS average_turnover
    FROM (SELECT *, equity - max(equity) {CUM} AS dd FROM e) GROUP BY symbol)
    SELECT symbol, n, last - 1 AS total_return, pow(CASE WHEN last > 0 THEN last END, 8760.0 / n) - 1 AS annual_return, annual_vol, max_drawdown, average_turnover FROM f"""


@query("a01_performance_summary", f"WITH {ma_sql(5, 20, -1.0)}, {BT}, {PERF}".replace("{CHANGE}", CHANGE), "symbol n", "total_return annual_vol max_drawdown average_turnover", 4)
def a01(spark, d):
    return B.performance_summary(B.backtest_signal(B.ma_signal(bars(spark, d), 5, 20)), ["symbol"])


MONEY = f"""WITH {RSI_T}, d AS (SELECT symbol, ts, -f AS f, t / 100 AS t FROM fac),
    q AS (SELECT *, {past_q('f', 60, 0.8, 10)} AS q_high, {past_q('f', 60, 0.2, 10)} AS q_low FROM d),
    p AS (SELECT *, CASE WHEN f < q_low THEN -1.0 WHEN f > q_high THEN 1.0 ELSE 0.0 END AS position FROM q),
    n AS (SELECT *, {turn()} AS turnover FROM p), gp AS (SELECT *, position * t - turnover * 2 / 10000 AS pnl FROM n),
    e AS (SELECT *, product(1 + coalesce(pnl, 0)) {CUM} AS equity FROM gp)"""


@query(
    "a02_backtest_metrics",
    MONEY + f""" SELECT symbol, avg(pnl) / NULLIF(stddev_samp(pnl), 0) * sqrt(8760.0) AS sharpe, min(dd) AS max_drawdown, avg(turnover) AS avg_turnover,
      avg(abs(position)) AS avg_exposure, avg(CASE WHEN pnl IS NOT NULL THEN CAST(pnl > 0 AS INT) END) AS win_rate, max_by(equity, ts) AS last
    FROM (SELECT *, equity - max(equity) {CUM} AS dd FROM e) GROUP BY symbol""",
    "symbol", "last sharpe max_drawdown avg_turnover avg_exposure win_rate", 4,
)
def a02(spark, d):
    b = X.rsi(bars(spark, d), 14, "f").withColumn("t", R.ahead("close", 1, X.W) / 100)
    return B.backtest_metrics(B.monetise(b, "f", "t", 60, direction=-1), ["symbol"])


simple("w25_true_range", lambda b: X.true_range(b, "x"), f"SELECT symbol, ts, greatest(abs(high - low), abs(high - {lag('close')}), abs(low - {lag('close')})) AS x FROM v1")
simple("w26_average_true_range", lambda b: X.average_true_range(b, 24, "x"), f"WITH t AS (SELECT *, greatest(abs(high - low), abs(high - {lag('close')}), abs(low - {lag('close')})) AS tr FROM v1) SELECT symbol, ts, {roll('avg', 'tr', 24, 6)} AS x FROM t")

SPLIT = "CASE WHEN rn < floor(n * 6 / 10) THEN 'train' WHEN rn < floor(n * 8 / 10) THEN 'valid' ELSE 'test' END AS split"
SIGNAL = f"""WITH {RSI_T}, ok AS (SELECT symbol, ts, close, -f AS signal, ret / 100 AS ret, t / 100 AS t FROM fac WHERE f IS NOT NULL AND ret IS NOT NULL),
    num AS (SELECT *, row_number() OVER ({W}) - 1 AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM ok), sp AS (SELECT *, {SPLIT} FROM num)"""
QPOS = """ps AS (SELECT *, CASE WHEN signal < quantile_cont(CASE WHEN split = 'train' THEN signal END, 0.2) OVER (PARTITION BY symbol) THEN -1.0
      WHEN signal > quantile_cont(CASE WHEN split = 'train' THEN signal END, 0.8) OVER (PARTITION BY symbol) THEN 1.0 ELSE 0.0 END AS position FROM sp)"""
LAGGED = f"tn AS (SELECT *, {turn()} AS turnover FROM ps), bt AS (SELECT *, turnover * 2 / 10000 AS fee, coalesce({lag('position')}, 0) * ret - turnover * 2 / 10000 AS pnl FROM tn)"


def signal_frame(spark, d) -> DataFrame:
    """symbol, ts, close, signal, ret, t, split: a reversed RSI as signal."""
    b = X.rsi(small(bars(spark, d)), 14, "f").withColumn("t", R.ahead("close", 1, X.W) / 100)
    b = b.where("f is not null and ret is not null").select("symbol", "ts", "close", (-F.col("f")).alias("signal"), "ret", "t")
    return B.split_rows(b, ["symbol"])


@query("w27_signal_to_position", f"{SIGNAL}, {QPOS} SELECT * FROM ps", "symbol ts split", "position")
def w27(spark, d):
    return B.quantile_position(signal_frame(spark, d), "signal", 0.8, ["symbol"])


@query(
    "w27_signal_to_position_lookback",
    f"""{SIGNAL}, q AS (SELECT *, {past_q('signal', 48, 0.8, 12)} AS hi, {past_q('signal', 48, 0.2, 12)} AS lo FROM sp)
    SELECT *, CASE WHEN signal < lo THEN -1.0 WHEN signal > hi THEN 1.0 ELSE 0.0 END AS position FROM q""",
    "symbol ts", "position",
)
def w27b(spark, d):
    # The fraction 1 - 0.8 is not exactly 0.2; SQL gets the same number.
    return B.quantile_position(signal_frame(spark, d), "signal", 0.8, ["symbol"], lookback=48)


def signal_bt(spark, d) -> DataFrame:
    return B.lagged_pnl(B.quantile_position(signal_frame(spark, d), "signal", 0.8, ["symbol"]), ["symbol"])


@query("w28_signal_backtest", f"{SIGNAL}, {QPOS}, {LAGGED} SELECT * FROM bt", "symbol ts split", "position turnover fee pnl", 5)
def w28(spark, d):
    return signal_bt(spark, d)


@query("w29_alpha_dataset", None, "symbol ts")
def w29(spark, d):
    out = X.alpha_dataset(bars(spark, d), week=10)
    return out.select("symbol", "ts", *[F.round(c, 6).alias(c) for c in out.columns if c.startswith("factor_")])


@query("w30_time_split", f"{SIGNAL} SELECT * FROM sp", "symbol ts split")
def w30(spark, d):
    return signal_frame(spark, d)


PERIOD = "PARTITION BY symbol, split ORDER BY ts"
METRICS = """avg(pnl) * 8760 AS ann_return, stddev_samp(pnl) * sqrt(8760.0) AS ann_vol, min(dd) AS max_drawdown, sum(pnl) AS total_return,
      avg(CASE WHEN pnl IS NOT NULL THEN CAST(pnl > 0 AS INT) END) AS hit_rate, avg(abs(position)) AS avg_abs_position, avg(turn) AS turnover_per_bar,
      corr(signal, ret) AS ic, avg(pnl) * 8760 / NULLIF(stddev_samp(pnl) * sqrt(8760.0), 0) AS sharpe"""
METRIC_COLUMNS = "ann_return ann_vol max_drawdown total_return hit_rate avg_abs_position turnover_per_bar ic sharpe"


def metrics_sql(by: str, keys: str, source: str = "bt") -> str:
    return f"""eq AS (SELECT *, 1 + sum(coalesce(pnl, 0)) OVER ({by} ROWS UNBOUNDED PRECEDING) AS equity, {turn('position', by)} AS turn FROM {source}),
    dd AS (SELECT *, equity - max(equity) OVER ({by} ROWS UNBOUNDED PRECEDING) AS dd FROM eq) SELECT {keys}, {METRICS} FROM dd GROUP BY {keys}"""


@query("a03_signal_metrics", f"{SIGNAL}, {QPOS}, {LAGGED}, {metrics_sql(W, 'symbol')}", "symbol", METRIC_COLUMNS, 4)
def a03(spark, d):
    return B.signal_metrics(signal_bt(spark, d), ["symbol"])


@query("a04_metrics_by_period", f"{SIGNAL}, {QPOS}, {LAGGED}, {metrics_sql(PERIOD, 'symbol, split')}", "symbol split", METRIC_COLUMNS, 4)
def a04(spark, d):
    return B.signal_metrics(signal_bt(spark, d), ["symbol", "split"])


CALENDAR = """days AS (SELECT symbol, split, pnl, CAST(ts AS DATE) AS day FROM bt WHERE pnl IS NOT NULL),
    ends AS (SELECT *, 'month' AS calendar, last_day(day) AS period_end FROM days
      UNION ALL SELECT *, 'quarter', last_day(CAST(date_trunc('quarter', day) AS DATE) + INTERVAL 2 MONTH) FROM days
      UNION ALL SELECT *, 'year', last_day(CAST(date_trunc('year', day) AS DATE) + INTERVAL 11 MONTH) FROM days),
    periods AS (SELECT symbol, split, calendar, CAST(period_end AS DATE) AS period_end, product(1 + pnl) - 1 AS period_return FROM ends GROUP BY ALL)"""


@query("a05_calendar_returns", f"{SIGNAL}, {QPOS}, {LAGGED}, {CALENDAR} SELECT * FROM periods", "symbol split calendar period_end!", "period_return", 5)
def a05(spark, d):
    return B.calendar_returns(signal_bt(spark, d), ["symbol", "split"])


@query(
    "a06_calendar_summary",
    f"""{SIGNAL}, {QPOS}, {LAGGED}, {CALENDAR} SELECT symbol, split, calendar, count(*) AS n_periods, avg(period_return) AS mean_return, stddev_samp(period_return) AS std_return,
    avg(CAST(period_return > 0 AS INT)) AS win_rate, product(1 + period_return) - 1 AS total_return FROM periods GROUP BY ALL""",
    "symbol split calendar n_periods", "mean_return std_return win_rate total_return", 5,
)
def a06(spark, d):
    return B.calendar_summary(B.calendar_returns(signal_bt(spark, d), ["symbol", "split"]), ["symbol", "split"])


simple("a30_max_drawdown_absolute", lambda b: b.withColumn("dd", F.col("close") - F.max("close").over(R.cum(X.W))).groupBy("symbol").agg(F.min("dd").alias("x")), f"SELECT symbol, min(dd) AS x FROM (SELECT symbol, close - max(close) {CUM} AS dd FROM v1) GROUP BY symbol", keys="symbol")
simple("a31_max_drawdown_relative", lambda b: b.withColumn("dd", F.try_divide(F.col("close"), F.max("close").over(R.cum(X.W))) - 1).groupBy("symbol").agg(F.min("dd").alias("x")), f"SELECT symbol, min(dd) AS x FROM (SELECT symbol, close / NULLIF(max(close) {CUM}, 0) - 1 AS dd FROM v1) GROUP BY symbol", keys="symbol")
simple("a29_count_entries", lambda b: B.ma_signal(b, 5, 20).withColumn("before", F.lag("position").over(X.W)).groupBy("symbol").agg(B.count_entries(F.col("position"), F.col("before")).alias("n")), f"WITH {ma_sql(5, 20, -1.0)} SELECT symbol, CAST(count(*) FILTER (WHERE position <> 0 AND coalesce(before, 0) = 0) AS BIGINT) AS n FROM (SELECT *, {lag('position')} AS before FROM p) GROUP BY symbol", "", "symbol n")
simple(
    "a28_round_trips",
    lambda b: B.round_trips(B.ma_signal(b, 5, 20), ["symbol"], "ts"),
    f"""WITH {ma_sql(5, 20, -1.0)}, nw AS (SELECT *, CASE WHEN position = {lag('position')} THEN 0 ELSE 1 END AS fresh FROM p), rn AS (SELECT *, sum(fresh) {CUM} AS run FROM nw),
    runs AS (SELECT symbol, run, min(position) AS position, count(*) AS bars FROM rn GROUP BY ALL)
    SELECT symbol, count(*) FILTER (WHERE position <> 0) AS n_trades, coalesce(avg(bars) FILTER (WHERE position <> 0), 0) AS avg_holding,
      coalesce(sum(bars) FILTER (WHERE position <> 0), 0) / sum(bars) AS time_in_market FROM runs GROUP BY symbol""",
    "avg_holding time_in_market", "symbol n_trades",
)
simple("w46_change_flags", lambda b: B.ma_signal(b, 5, 20).withColumn("changed", F.coalesce(F.abs(F.col("position") - F.lag("position").over(X.W)) > 1e-9, F.lit(False)).cast("long")), f"WITH {ma_sql(5, 20, -1.0)} SELECT symbol, ts, CAST(coalesce(abs(position - {lag('position')}) > 1e-9, false) AS BIGINT) AS changed FROM p", "", "symbol ts changed")
simple(
    "w42_drawdown_rolling_sharpe",
    lambda b: small(b).withColumn("dd", F.try_divide(F.col("close"), F.max("close").over(R.cum(X.W))) - 1).withColumn("x", F.try_divide(R.full(F.avg, "ret", 63, X.W), R.full(F.stddev_samp, "ret", 63, X.W)) * F.sqrt(F.lit(252.0))),
    f"WITH r AS ({SMALL}) SELECT symbol, ts, close / NULLIF(max(close) {CUM}, 0) - 1 AS dd, ({roll('avg', 'ret', 63)}) / NULLIF({roll('stddev_samp', 'ret', 63)}, 0) * sqrt(252.0) AS x FROM r",
    "dd x", digits=5,
)
simple("w47_rank_column", lambda b: b.withColumn("rank", F.row_number().over(R.series("symbol", "close").orderBy(F.col("close").desc(), "ts")).cast("long")), "SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY close DESC, ts) AS rank FROM v1", "", "symbol ts rank")
