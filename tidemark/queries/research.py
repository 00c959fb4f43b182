"""Queries of breadth, sentiment, rules, information coefficients, tabular preparation, econometrics and simulation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import rolling as R
from tidemark.functions import technical as X
from tidemark.operators import backtest as B
from tidemark.operators import breadth as H
from tidemark.operators import econometrics as E
from tidemark.operators import folds
from tidemark.operators import montecarlo as M
from tidemark.operators import allocation as P
from tidemark.operators import rules
from tidemark.operators import statistics as S
from tidemark.operators import tabular as Tb
from tidemark.operators.alignment import expanding_rank, expanding_z
from tidemark.plans.registry import query
from tidemark.queries.backtests import SIGNAL, signal_frame, turn
from tidemark.queries.panels import PANEL, panel, source
from tidemark.queries.windows import RSI_T, W, roll, simple
from tidemark.sources import tables as T

# --- breadth and sentiment ---------------------------------------------------------------------------------

BY = "PARTITION BY symbol ORDER BY date"


def f(agg: str, x: str, n: int) -> str:
    frame = f"OVER ({BY} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {frame} = {n} THEN {agg}({x}) {frame} END"


BREADTH = f"""{PANEL}, ind AS (SELECT *, {f('max', 'close', 10)} AS hi, {f('min', 'close', 10)} AS lo, {f('avg', 'close', 15)} AS ma,
      close / NULLIF(lag(close, 5) OVER ({BY}), 0) - 1 AS back, close / NULLIF(lag(close) OVER ({BY}), 0) - 1 AS one FROM pan),
    br AS (SELECT date, CAST(count(*) FILTER (WHERE valid) AS BIGINT) AS valid_stocks,
      (count(*) FILTER (WHERE valid AND close >= hi) - count(*) FILTER (WHERE valid AND close <= lo)) / NULLIF(count(*) FILTER (WHERE valid), 0) AS new_high_low_net,
      count(*) FILTER (WHERE valid AND close > ma) / NULLIF(count(*) FILTER (WHERE valid), 0) AS above_ma,
      count(*) FILTER (WHERE valid AND back > 0) / NULLIF(count(*) FILTER (WHERE valid), 0) AS positive_return,
      (count(*) FILTER (WHERE valid AND one > 0) - count(*) FILTER (WHERE valid AND one < 0)) / NULLIF(count(*) FILTER (WHERE valid), 0) AS advance_decline FROM ind GROUP BY date)"""


def breadth(s, d) -> DataFrame:
    return H.breadth(panel(s, d), extreme=10, mean=15, back=5)


for _id, _column in (("w33_new_high_low", "new_high_low_net"), ("w34_above_ma", "above_ma"), ("w35_positive_return", "positive_return"), ("w36_advance_decline", "advance_decline")):
    source(_id, breadth, f"WITH {BREADTH} SELECT date, {_column} FROM br", "date!", _column)
source("w37_breadth_indicators", breadth, f"WITH {BREADTH} SELECT * FROM br", "date! valid_stocks", "new_high_low_net above_ma positive_return advance_decline")
source("a36_valid_counts", lambda s, d: breadth(s, d).select("date", "valid_stocks"), f"WITH {BREADTH} SELECT date, valid_stocks FROM br", "date! valid_stocks")

RANK = "SELECT a.symbol, a.ts, a.close, (sum(CASE WHEN b.close < a.close THEN 1.0 WHEN b.close = a.close THEN 0.5 ELSE 0 END) / count(*)) * 100 AS pct FROM v1 a JOIN v1 b ON b.symbol = a.symbol AND b.ts <= a.ts GROUP BY ALL"
simple("w38_expanding_percentile_rank", lambda b: expanding_rank(b, "close", "pct", "symbol", "ts"), RANK, "pct")


def z_sql(span: int) -> str:
    return f"""WITH RECURSIVE pk AS ({RANK}), nu AS (SELECT *, row_number() OVER ({W}) AS rn FROM pk),
    ew AS (SELECT symbol, rn, ts, close, pct AS y FROM nu WHERE rn = 1 UNION ALL SELECT n.symbol, n.rn, n.ts, n.close, p.y + {2 / (span + 1)!r} * (n.pct - p.y) FROM ew p JOIN nu n ON n.symbol = p.symbol AND n.rn = p.rn + 1),
    sz AS (SELECT symbol, ts, close, rn, CASE WHEN rn >= 2 THEN (y - avg(y) OVER c) / NULLIF(stddev_samp(y) OVER c, 0) END AS z FROM ew WINDOW c AS ({W} ROWS UNBOUNDED PRECEDING))"""


def chain_sql(lead: str, rows: str, keys: str, span: int, order: str = "date") -> str:
    """Percentile rank, EMA and expanding z of the column x of rows (keys, order, x), as the CTE sz."""
    on = " AND ".join(f"b.{k} = a.{k}" for k in keys.split(", "))
    follows = " AND ".join(f"n.{k} = p.{k}" for k in keys.split(", "))
    a, n = ", ".join(f"a.{k}" for k in keys.split(", ")), ", ".join(f"n.{k}" for k in keys.split(", "))
    return f"""{lead}, xr AS ({rows}), pk AS (SELECT {a}, a.{order}, sum(CASE WHEN b.x < a.x THEN 1.0 WHEN b.x = a.x THEN 0.5 ELSE 0 END) / count(*) * 100 AS pct FROM xr a JOIN xr b ON {on} AND b.{order} <= a.{order} GROUP BY ALL),
    nu AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn FROM pk),
    ew AS (SELECT {keys}, rn, {order}, CAST(pct AS DOUBLE) AS y FROM nu WHERE rn = 1 UNION ALL SELECT {n}, n.rn, n.{order}, p.y + {2 / (span + 1)!r} * (n.pct - p.y) FROM ew p JOIN nu n ON {follows} AND n.rn = p.rn + 1),
    sz AS (SELECT {keys}, {order}, y, CASE WHEN rn >= 2 THEN (y - avg(y) OVER c) / NULLIF(stddev_samp(y) OVER c, 0) END AS z FROM ew WINDOW c AS (PARTITION BY {keys} ORDER BY {order} ROWS UNBOUNDED PRECEDING))"""


def signal(b: DataFrame, span: int = 10) -> DataFrame:
    return H.signal_z(b, "close", span, "symbol", "ts", "z")


simple("w39_signal_z", lambda b: signal(b), z_sql(10) + " SELECT * FROM sz", "z", digits=5)
COMPOSITE = f"""WITH RECURSIVE {BREADTH}, xr AS (SELECT * FROM br WHERE above_ma IS NOT NULL),
    pk AS (SELECT a.date, {", ".join(f"(sum(CASE WHEN b.{c} < a.{c} THEN 1.0 WHEN b.{c} = a.{c} THEN 0.5 ELSE 0 END) / count(b.{c})) * 100 AS {c}_pct" for c in H.BREADTH[:3])} FROM xr a JOIN xr b ON b.date <= a.date GROUP BY a.date),
    nu AS (SELECT date, 0.4 * new_high_low_net_pct + 0.3 * above_ma_pct + 0.3 * positive_return_pct AS sentiment_raw, row_number() OVER (ORDER BY date) AS rn FROM pk),
    ew AS (SELECT date, rn, CAST(sentiment_raw AS DOUBLE) AS sentiment_raw, CAST(sentiment_raw AS DOUBLE) AS y FROM nu WHERE rn = 1 UNION ALL SELECT n.date, n.rn, n.sentiment_raw, p.y + {2 / 21!r} * (n.sentiment_raw - p.y) FROM ew p JOIN nu n ON n.rn = p.rn + 1),
    sz AS (SELECT date, sentiment_raw, y AS sentiment_slow, CASE WHEN rn >= 2 THEN (y - avg(y) OVER c) / NULLIF(stddev_samp(y) OVER c, 0) END AS sentiment_z FROM ew WINDOW c AS (ORDER BY date ROWS UNBOUNDED PRECEDING))
    SELECT *, CASE WHEN sentiment_z > 1 THEN 'overheated' WHEN sentiment_z < -1 THEN 'overcooled' WHEN sentiment_z IS NOT NULL THEN 'neutral' END AS regime FROM sz"""
query("w40_composite_sentiment", COMPOSITE, "date! regime", "sentiment_raw sentiment_slow sentiment_z")(lambda s, d: H.composite(breadth(s, d).where("above_ma is not null").withColumn("k", F.lit(1)), {"new_high_low_net": 0.4, "above_ma": 0.3, "positive_return": 0.3}, 20, "k", "date"))
simple("w48_signal_with_regime", lambda b: signal(b).withColumn("regime", F.when(F.col("z") > 1, "overheated").when(F.col("z") < -1, "overcooled").otherwise("neutral")).where("z is not null").groupBy("symbol", "regime").agg(F.count("*").alias("n")),
       z_sql(10) + " SELECT symbol, CASE WHEN z > 1 THEN 'overheated' WHEN z < -1 THEN 'overcooled' ELSE 'neutral' END AS regime, count(*) AS n FROM sz WHERE z IS NOT NULL GROUP BY 1, 2", "", "symbol regime n")
query("w49_index_momentum_signal", chain_sql("WITH RECURSIVE im AS (SELECT date, close / NULLIF(lag(close, 60) OVER (ORDER BY date), 0) - 1 AS m FROM v5)", "SELECT 1 AS k, date, m AS x FROM im WHERE m IS NOT NULL", "k", 40) + " SELECT * FROM sz", "date!", "z")(lambda s, d: H.signal_z(T.index_level(s, d).withColumn("k", F.lit(1)).withColumn("m", R.change("close", 60, R.series("k", "date"))).where("m is not null"), "m", 40, "k", "date", "z"))
query("w50_all_alphas", chain_sql(f"WITH RECURSIVE {BREADTH}", " UNION ALL ".join(f"SELECT '{c}' AS alpha, date, {c} AS x FROM br WHERE {c} IS NOT NULL" for c in H.BREADTH), "alpha", 40) + " SELECT * FROM sz", "alpha date!", "z")(lambda s, d: H.signal_z(breadth(s, d).unpivot(["date"], list(H.BREADTH), "alpha", "x").where("x is not null"), "x", 40, "alpha", "date", "z"))
simple("w41_forward_returns", lambda b: b.withColumns({f"f{h}": R.ahead("close", h, X.W) for h in (5, 20)}), f"SELECT symbol, ts, lead(close, 5) OVER ({W}) / NULLIF(close, 0) - 1 AS f5, lead(close, 20) OVER ({W}) / NULLIF(close, 0) - 1 AS f20 FROM v1", "f5 f20")
simple("w43_feature_block", lambda b: X.on_balance_volume(X.rsi(X.stochastic(X.bollinger_position(X.distance_from_ma(b, 7, "dev7"), 20, "bb"), "close", 14, "k"), 14, "rsi", move="difference"), "obv").withColumn("d", R.full(F.avg, "k", 3, X.W)).withColumn("ratio", F.try_divide(F.col("close"), R.full(F.max, "close", 60, X.W))).withColumn("vr", F.try_divide(F.col("volume"), R.full(F.avg, "volume", 20, X.W))),
       f"""WITH s AS (SELECT *, close / NULLIF({roll('avg', 'close', 7)}, 0) - 1 AS dev7, (close - ({roll('avg', 'close', 20)} - 2 * {roll('stddev_samp', 'close', 20)})) / NULLIF(4 * {roll('stddev_samp', 'close', 20)}, 0) AS bb,
         (close - {roll('min', 'close', 14)}) / NULLIF({roll('max', 'close', 14)} - {roll('min', 'close', 14)}, 0) * 100 AS k, close - lag(close) OVER ({W}) AS dp,
         close / NULLIF({roll('max', 'close', 60)}, 0) AS ratio, volume / NULLIF({roll('avg', 'volume', 20)}, 0) AS vr FROM v1),
       g AS (SELECT *, CASE WHEN dp IS NOT NULL THEN greatest(dp, 0) END AS up, CASE WHEN dp IS NOT NULL THEN greatest(-dp, 0) END AS down FROM s),
       m AS (SELECT *, {roll('avg', 'up', 14)} AS gain, {roll('avg', 'down', 14)} AS loss, {roll('avg', 'k', 3)} AS d, sum(coalesce(sign(dp), 0) * volume) OVER ({W} ROWS UNBOUNDED PRECEDING) AS obv FROM g)
       SELECT *, CASE WHEN loss = 0 AND gain > 0 THEN 100 ELSE 100 - 100 / NULLIF(1 + gain / NULLIF(loss, 0), 0) END AS rsi FROM m""", "dev7 bb k d obv ratio vr rsi")  # fmt: skip
simple("w45_row_mean", lambda b: X.zscore(X.zscore(b, "close", 20, "a"), "volume", 30, "b").withColumn("x", F.try_divide(F.coalesce("a", F.lit(0.0)) + F.coalesce("b", F.lit(0.0)), F.when(F.col("a").isNotNull(), 1).otherwise(0) + F.when(F.col("b").isNotNull(), 1).otherwise(0))),
       f"""WITH z AS (SELECT *, (close - {roll('avg', 'close', 20)}) / NULLIF({roll('stddev_samp', 'close', 20)}, 0) AS a, (volume - {roll('avg', 'volume', 30)}) / NULLIF({roll('stddev_samp', 'volume', 30)}, 0) AS b FROM v1)
       SELECT symbol, ts, (coalesce(a, 0) + coalesce(b, 0)) / NULLIF(CAST(a IS NOT NULL AS INT) + CAST(b IS NOT NULL AS INT), 0) AS x FROM z""", "x")  # fmt: skip

# --- rules and backtests -----------------------------------------------------------------------------------

Z20 = f"zz AS (SELECT symbol, ts, close, CASE WHEN count(close) OVER f = 20 THEN (close - avg(close) OVER f) / NULLIF(stddev_samp(close) OVER f, 0) END AS z FROM v1 WINDOW f AS ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)), zl AS (SELECT *, lag(z) OVER ({W}) AS zp FROM zz)"


def z20(b: DataFrame) -> DataFrame:
    return X.zscore(b, "close", 20, "z")


def rule_sql(fixed: str, initial: float = 0.0, z: str = Z20) -> str:
    return f"WITH {z}, fx AS (SELECT *, CASE WHEN zp IS NOT NULL THEN {fixed} END AS fixed FROM zl) SELECT *, coalesce(last_value(fixed IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING), {initial}) AS position FROM fx"


BASE = "CASE WHEN zp < -1 THEN 1.0 WHEN zp > 1 THEN 0.0 END"
ewm_out = {"y": ("close", {"span": 12})}
simple("f01_ewm", lambda b: folds.ewm(b, ewm_out), f"WITH RECURSIVE b AS (SELECT *, row_number() OVER ({W}) AS rn FROM v1), e AS (SELECT symbol, ts, rn, CAST(close AS DOUBLE) AS y FROM b WHERE rn = 1 UNION ALL SELECT b.symbol, b.ts, b.rn, p.y + {2 / 13!r} * (b.close - p.y) FROM e p JOIN b ON b.symbol = p.symbol AND b.rn = p.rn + 1) SELECT * FROM e", "y")
simple("f01_ewm_last", lambda b: b.groupBy("symbol").agg(folds.last_ewm("symbol", "ts", "close", 12).alias("y")), f"SELECT symbol, list_reduce(list(close ORDER BY ts), lambda a, e: a + {2 / 13!r} * (e - a)) AS y FROM v1 GROUP BY symbol", "y", "symbol")
FOLD = f"""WITH RECURSIVE {Z20}, nu AS (SELECT symbol, ts, z, row_number() OVER ({W}) AS rn FROM zz),
    st AS (SELECT symbol, ts, rn, z, CASE WHEN z >= 1.5 THEN -1.0 WHEN z <= -1.5 THEN 1.0 ELSE 0.0 END AS position FROM nu WHERE rn = 1
      UNION ALL SELECT n.symbol, n.ts, n.rn, n.z, CASE WHEN n.z IS NULL THEN p.position
        WHEN p.position = 0 THEN CASE WHEN n.z >= 1.5 THEN -1.0 WHEN n.z <= -1.5 THEN 1.0 ELSE 0.0 END
        WHEN p.position > 0 AND n.z >= 0 THEN 0.0 WHEN p.position < 0 AND n.z <= 0 THEN 0.0 ELSE p.position END FROM st p JOIN nu n ON n.symbol = p.symbol AND n.rn = p.rn + 1)"""
simple("f02_generate_positions", lambda b: folds.positions(z20(b), "z", 1.5, 0.0, ["symbol"], "ts"), FOLD + " SELECT * FROM st", "position")
simple("f03_baseline_rule", lambda b: rules.hold(z20(b), rules.baseline(-1, 1), ["z"], ["symbol"], "ts"), rule_sql(BASE), "position")
simple("f04_hysteresis_rule", lambda b: rules.hold(z20(b), rules.hysteresis(-1.5, 0.5), ["z"], ["symbol"], "ts"), rule_sql("CASE WHEN zp < -1.5 THEN 1.0 WHEN zp > 0.5 THEN 0.0 END"), "position")
simple("f05_default_long_rule", lambda b: rules.hold(z20(b), rules.default_long(-1, 1), ["z"], ["symbol"], "ts", initial=1.0), rule_sql(BASE, 1.0), "position")
CONTINUOUS = "CASE WHEN zp > 1 THEN 0.0 WHEN zp <= -1 THEN least(greatest((-zp - 1) / 2, 0), 1) END"
simple("f06_continuous_rule", lambda b: rules.hold(z20(b), rules.continuous(-1, 1), ["z"], ["symbol"], "ts"), rule_sql(CONTINUOUS), "position")
Z2 = Z20.replace("zl AS (SELECT *, lag(z) OVER", "z2 AS (SELECT *, lag(z, 5) OVER (PARTITION BY symbol ORDER BY ts) AS y FROM zz), zl AS (SELECT *, lag(y) OVER (PARTITION BY symbol ORDER BY ts) AS yp, lag(z) OVER").replace("AS zp FROM zz)", "AS zp FROM z2)")
simple("f07_dual_rule", lambda b: rules.hold(z20(b).withColumn("y", F.lag("z", 5).over(X.W)), rules.both_to_enter(-0.5, 1.0), ["z", "y"], ["symbol"], "ts"), rule_sql("CASE WHEN yp IS NOT NULL THEN CASE WHEN zp > 1 OR yp > 1 THEN 0.0 WHEN zp < -0.5 AND yp < -0.5 THEN 1.0 END END", z=Z2), "position")
simple("f07_average_rule", lambda b: folds.scan(z20(b).withColumn("y", F.lag("z", 5).over(X.W)), ["symbol"], "ts", lambda c: {"position": folds.average_rule(c["z"], c["y"], -1.0, 1.0)}, ["z", "y"], {"position": "double"}),
       f"""WITH RECURSIVE {Z20}, nu AS (SELECT symbol, ts, z, lag(z, 5) OVER ({W}) AS y, row_number() OVER ({W}) AS rn FROM zz),
       st AS (SELECT symbol, ts, rn, 0.0::DOUBLE AS position FROM nu WHERE rn = 1 UNION ALL SELECT n.symbol, n.ts, n.rn, CASE WHEN n.z IS NULL OR n.y IS NULL THEN p.position ELSE
         (CASE WHEN n.z < -1 THEN 1.0 WHEN n.z > 1 THEN 0.0 ELSE p.position END + CASE WHEN n.y < -1 THEN 1.0 WHEN n.y > 1 THEN 0.0 ELSE p.position END) / 2 END FROM st p JOIN nu n ON n.symbol = p.symbol AND n.rn = p.rn + 1) SELECT * FROM st""", "position")  # fmt: skip


@query("f08_rule_registry", f"""WITH {Z20}, fx AS (SELECT symbol, ts, 'baseline' AS rule, {BASE} AS fixed FROM zl UNION ALL SELECT symbol, ts, 'hysteresis', CASE WHEN zp < -1.5 THEN 1.0 WHEN zp > 0.5 THEN 0.0 END FROM zl UNION ALL SELECT symbol, ts, 'continuous', {CONTINUOUS} FROM zl),
    ps AS (SELECT symbol, rule, coalesce(last_value(fixed IGNORE NULLS) OVER (PARTITION BY rule, symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), 0.0) AS position FROM fx) SELECT symbol, rule, sum(position) AS position FROM ps GROUP BY ALL""", "symbol rule", "position", 4)  # fmt: skip
def f08(spark, d):
    z = z20(T.bars(spark, d)).cache()
    parts = [rules.hold(z, r, ["z"], ["symbol"], "ts").withColumn("rule", F.lit(n)) for n, r in rules.RULES.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("symbol", "rule").agg(F.sum("position").alias("position"))


# Prices of these bars swing too much to compound; the index follows a damped path.
DAMP = f"ix AS (SELECT symbol, ts, z, 1000 * exp(sum(coalesce(z, 0) / 200) OVER ({W} ROWS UNBOUNDED PRECEDING)) AS index_close, zp FROM zl)"
NAV = f"""WITH {Z20}, {DAMP}, fx AS (SELECT *, CASE WHEN zp IS NOT NULL THEN {BASE} END AS fixed FROM ix),
    ps AS (SELECT *, coalesce(last_value(fixed IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING), 0.0) AS position, index_close / lag(index_close) OVER ({W}) - 1 AS ret FROM fx),
    mv AS (SELECT *, position - coalesce(lag(position) OVER ({W}), position) AS move FROM ps),
    cs AS (SELECT *, CASE WHEN ret IS NULL THEN 0 ELSE abs(move) * 0.0002 + greatest(-move, 0) * 0.001 END AS cost FROM mv), ne AS (SELECT *, coalesce(position * ret - cost, 0) AS net FROM cs),
    nv AS (SELECT *, 1000000.0 * product(1 + net) OVER ({W} ROWS UNBOUNDED PRECEDING) AS nav, 1000000.0 * product(1 + coalesce(ret, 0)) OVER ({W} ROWS UNBOUNDED PRECEDING) AS benchmark FROM ne)"""


def nav(b: DataFrame) -> DataFrame:
    z = z20(b).withColumn("index_close", 1000 * F.exp(F.sum(F.coalesce("z", F.lit(0.0)) / 200).over(R.cum(X.W))))
    return B.nav_backtest(rules.hold(z, rules.baseline(-1, 1), ["z"], ["symbol"], "ts"), ["symbol"], "ts")


simple("f09_run_backtest", nav, NAV + " SELECT * FROM nv", "position cost net nav benchmark", digits=4)
simple("f10_trading_cost", lambda b: nav(b).groupBy("symbol").agg(F.sum("cost").alias("x")), NAV + " SELECT symbol, sum(cost) AS x FROM nv GROUP BY symbol", "x", "symbol")
NAV_DUAL = NAV.replace(Z20, Z2).replace("AS index_close, zp FROM zl)", "AS index_close, zp, yp FROM zl)").replace(f"CASE WHEN zp IS NOT NULL THEN {BASE} END AS fixed", "CASE WHEN zp IS NOT NULL AND yp IS NOT NULL THEN CASE WHEN zp > 1 OR yp > 1 THEN 0.0 WHEN zp < -0.5 AND yp < -0.5 THEN 1.0 END END AS fixed")
simple("f11_dual_backtest", lambda b: B.nav_backtest(rules.hold(z20(b).withColumn("y", F.lag("z", 5).over(X.W)).withColumn("index_close", 1000 * F.exp(F.sum(F.coalesce("z", F.lit(0.0)) / 200).over(R.cum(X.W)))), rules.both_to_enter(-0.5, 1.0), ["z", "y"], ["symbol"], "ts"), ["symbol"], "ts"), NAV_DUAL + " SELECT * FROM nv", "position net nav", digits=4)
SUM = """sd AS (SELECT *, nav / max(nav) OVER (PARTITION BY {k} ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1 AS dd, abs(position - lag(position) OVER (PARTITION BY {k} ORDER BY ts)) > 1e-9 AS moved FROM {t})
    SELECT {k}, count(*) AS n_days, max_by(nav, ts) / min_by(nav, ts) - 1 AS total_return, max_by(benchmark, ts) / min_by(benchmark, ts) - 1 AS benchmark_return, min(dd) AS max_drawdown,
      avg(net) / NULLIF(stddev_pop(net), 0) * sqrt(252.0) AS sharpe, CAST(count(*) FILTER (WHERE moved) AS BIGINT) AS n_trades, avg(position) AS avg_position, pow(product(1 + net), 252.0 / count(*)) - 1 AS annualized_return FROM sd GROUP BY {k}"""
simple("a15_summarize_performance", lambda b: B.nav_summary(nav(b), ["symbol"], "ts"), f"{NAV}, {SUM.format(k='symbol', t='nv')}", "total_return benchmark_return max_drawdown sharpe avg_position annualized_return", "symbol n_days n_trades")
simple("a16_performance_by_split", lambda b: B.nav_summary(B.split_rows(nav(b), ["symbol"], names=("train", "valid", "final")), ["symbol", "split"], "ts"),
       f"{NAV}, sq AS (SELECT *, row_number() OVER ({W}) - 1 AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM nv), sp AS (SELECT *, CASE WHEN rn < floor(n * 6 / 10) THEN 'train' WHEN rn < floor(n * 8 / 10) THEN 'valid' ELSE 'final' END AS split FROM sq), {SUM.format(k='symbol, split', t='sp')}",
       "total_return benchmark_return max_drawdown sharpe avg_position annualized_return", "symbol split n_days n_trades")


def exits(b: DataFrame) -> DataFrame:
    """All five exit modes at once, on a damped path with a target from the z-score."""
    z = z20(b).withColumn("p", 1000 * F.exp(F.sum(F.coalesce("z", F.lit(0.0)) / 50).over(R.cum(X.W))))
    z = z.select("symbol", "ts", F.col("p").alias("close"), (F.col("p") * (1 + F.abs("z") / 100)).alias("high"), (F.col("p") * (1 - F.abs("z") / 100)).alias("low"), F.when(F.col("z") < -0.5, 1.0).when(F.col("z") > 0.5, -1.0).otherwise(0.0).alias("target"))
    z = X.average_true_range(z, 24, "atr").withColumn("ret", R.change("close", 1, X.W)).where("ret is not null and high is not null")
    modes = b.sparkSession.createDataFrame([(m,) for m in ("none", "fixed", "atr", "time", "trailing")], "mode string")
    return folds.exit_rules(z.crossJoin(F.broadcast(modes)), ["symbol", "mode"])


EXITS = f"""WITH RECURSIVE {Z20}, px AS (SELECT symbol, ts, z, 1000 * exp(sum(coalesce(z, 0) / 50) OVER ({W} ROWS UNBOUNDED PRECEDING)) AS c FROM zl),
    hl AS (SELECT symbol, ts, c AS close, c * (1 + abs(z) / 100) AS high, c * (1 - abs(z) / 100) AS low, CASE WHEN z < -0.5 THEN 1.0 WHEN z > 0.5 THEN -1.0 ELSE 0.0 END AS target, c / lag(c) OVER ({W}) - 1 AS ret, lag(c) OVER ({W}) AS before FROM px),
    tr AS (SELECT *, greatest(abs(high - low), abs(high - before), abs(low - before)) AS t FROM hl),
    aa AS (SELECT *, CASE WHEN count(t) OVER f >= 6 THEN avg(t) OVER f END AS atr FROM tr WINDOW f AS ({W} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)),
    nm AS (SELECT *, row_number() OVER ({W}) AS rn FROM aa WHERE ret IS NOT NULL AND high IS NOT NULL),
    md AS (SELECT n.*, m.mode FROM nm n, (VALUES ('none'), ('fixed'), ('atr'), ('time'), ('trailing')) m(mode)),
    st AS (SELECT symbol, mode, ts, rn, target AS position, CASE WHEN target <> 0 THEN close END AS entry_price, CAST(0 AS BIGINT) AS hold_bars, CASE WHEN target <> 0 THEN close END AS best, CASE WHEN target <> 0 THEN 'enter' ELSE '' END AS exit_reason FROM md WHERE rn = 1
      UNION ALL SELECT symbol, mode, ts, rn, CASE WHEN fresh THEN target WHEN why <> '' THEN 0.0 ELSE pos END, CASE WHEN fresh THEN close WHEN why = '' THEN entry END,
        CASE WHEN fresh OR why <> '' OR pos = 0 THEN 0 ELSE held END, CASE WHEN fresh THEN close WHEN why = '' AND pos <> 0 THEN far END, CASE WHEN fresh THEN CASE WHEN pos = 0 THEN 'enter' ELSE 'flip' END ELSE why END
      FROM (SELECT *, CASE WHEN fresh OR pos = 0 THEN '' WHEN sgn * against <= sgn * stop THEN CASE WHEN mode = 'trailing' THEN 'trailing_stop' ELSE 'stop_loss' END WHEN sgn * along >= sgn * gain THEN 'take_profit'
          WHEN mode = 'time' AND held >= 24 THEN 'time_stop' WHEN target = 0 THEN 'signal_flat' ELSE '' END AS why
        FROM (SELECT *, CASE mode WHEN 'fixed' THEN entry * (1 - sgn * 0.01) WHEN 'atr' THEN CASE WHEN atr > 0 THEN entry - sgn * atr END WHEN 'trailing' THEN far * (1 - sgn * 0.1) END AS stop,
            CASE mode WHEN 'fixed' THEN entry * (1 + sgn * 0.02) WHEN 'atr' THEN CASE WHEN atr > 0 THEN entry + sgn * 2 * atr END END AS gain
          FROM (SELECT n.symbol, n.mode, n.ts, n.rn, n.target, n.close, n.atr, p.position AS pos, p.entry_price AS entry, p.hold_bars + 1 AS held, sign(p.position) AS sgn,
              n.target <> 0 AND (p.position = 0 OR sign(n.target) <> sign(p.position)) AS fresh, CASE WHEN p.position > 0 THEN n.low ELSE n.high END AS against, CASE WHEN p.position > 0 THEN n.high ELSE n.low END AS along,
              CASE WHEN p.position > 0 THEN greatest(p.best, n.high) ELSE least(p.best, n.low) END AS far
            FROM st p JOIN md n ON n.symbol = p.symbol AND n.mode = p.mode AND n.rn = p.rn + 1) q1) q2) q3)"""
query("f13_exit_rules", EXITS + " SELECT * FROM st", "symbol mode ts hold_bars exit_reason", "position entry_price")(lambda s, d: exits(T.bars(s, d)))
MODE = "PARTITION BY symbol, mode ORDER BY ts"
COMPARED = EXITS + f""", jr AS (SELECT s.symbol, s.mode, s.ts, s.position, n.ret, n.target AS signal, s.rn - 1 AS r0, count(*) OVER (PARTITION BY s.symbol, s.mode) AS n FROM st s JOIN nm n ON n.symbol = s.symbol AND n.rn = s.rn),
    js AS (SELECT *, CASE WHEN r0 < floor(n * 6 / 10) THEN 'train' WHEN r0 < floor(n * 8 / 10) THEN 'valid' ELSE 'test' END AS split, coalesce(lag(position) OVER ({MODE}), 0) * ret - {turn('position', MODE)} * 2 / 10000 AS pnl FROM jr),
    je AS (SELECT *, 1 + sum(pnl) OVER (PARTITION BY symbol, mode, split ORDER BY ts ROWS UNBOUNDED PRECEDING) AS eq FROM js), jd AS (SELECT *, eq - max(eq) OVER (PARTITION BY symbol, mode, split ORDER BY ts ROWS UNBOUNDED PRECEDING) AS dd FROM je)
    SELECT symbol, mode, split, avg(pnl) * 8760 AS ann_return, stddev_samp(pnl) * sqrt(8760.0) AS ann_vol, avg(pnl) * 8760 / NULLIF(stddev_samp(pnl) * sqrt(8760.0), 0) AS sharpe, min(dd) AS max_drawdown, sum(pnl) AS total_return FROM jd GROUP BY symbol, mode, split"""
query("f14_compare_exit_rules", COMPARED, "symbol mode split", "ann_return ann_vol sharpe max_drawdown total_return", 4)(
    lambda s, d: B.signal_metrics(B.split_rows(B.lagged_pnl(exits(T.bars(s, d)), ["symbol", "mode"]).withColumn("signal", F.col("target")), ["symbol", "mode"]), ["symbol", "mode", "split"]))
BOOK = f"""WITH RECURSIVE {Z20}, bk AS (SELECT symbol, ts, 100 + close / 500 AS price, coalesce(z < -1, false) AS buy, row_number() OVER ({W}) AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM zz),
    st AS (SELECT symbol, ts, rn, CASE WHEN buy AND n > 1 THEN 0.0::DOUBLE ELSE 10000.0 END AS cash, CASE WHEN buy AND n > 1 THEN (10000 - price * 1.0005 * 0.001) / (price * 1.0005) ELSE 0.0::DOUBLE END AS shares,
        CASE WHEN buy AND n > 1 THEN rn END AS bought, CASE WHEN buy AND n > 1 THEN 'buy' ELSE '' END AS event, price FROM bk WHERE rn = 1
      UNION ALL SELECT symbol, ts, rn, CASE WHEN sells THEN cash + shares * (price * (1 - 0.0005) - price * 0.001) WHEN buys THEN 0.0 ELSE cash END,
        CASE WHEN sells THEN 0.0 WHEN buys THEN (cash - price * 1.0005 * 0.001) / (price * 1.0005) ELSE shares END, CASE WHEN buys THEN rn WHEN NOT sells THEN bought END, CASE WHEN sells THEN 'sell' WHEN buys THEN 'buy' ELSE '' END, price
      FROM (SELECT n.symbol, n.ts, n.rn, n.price, p.cash, p.shares, p.bought, p.shares > 0 AND n.rn - p.bought >= HOLD AS sells, p.shares = 0 AND n.buy AND n.rn < n.n AS buys FROM st p JOIN bk n ON n.symbol = p.symbol AND n.rn = p.rn + 1) q)
    SELECT symbol, ts, event, cash + shares * price AS equity, shares FROM st"""
for _h, _id in ((1, "f17_cash_book"), (3, "f18_cash_book_holding")):
    query(_id, BOOK.replace("HOLD", str(_h)), "symbol ts event", "equity shares", 4)(lambda s, d, h=_h: folds.scan(z20(T.bars(s, d)).withColumn("buy", F.when(F.col("z") < -1, 1.0).otherwise(0.0)).withColumn("price", 100 + F.col("close") / 500), ["symbol"], "ts", lambda c, h=h: folds.all_in_book(c["buy"], c["price"], h, 10_000.0, 0.0005, 0.001), ["buy", "price"], {"equity": "double", "shares": "double", "event": "string"}))

PAIR = "pj AS (SELECT 'p' AS symbol, date AS ts, y, x FROM v2), "


def pair(s, d) -> DataFrame:
    return T.pair(s, d).select(F.lit("p").alias("symbol"), F.col("date").alias("ts"), "y", "x")


def held(s, d) -> DataFrame:
    p = pair(s, d).withColumn("e", F.col("y") - F.col("x"))
    return folds.positions(X.zscore(p, "e", 20, "z"), "z", 1.0, 0.0, ["symbol"], "ts")


HELD = f"""WITH RECURSIVE {PAIR} pe AS (SELECT *, y - x AS e FROM pj), pz AS (SELECT *, CASE WHEN count(e) OVER f = 20 THEN (e - avg(e) OVER f) / NULLIF(stddev_samp(e) OVER f, 0) END AS z, row_number() OVER ({W}) AS rn FROM pe WINDOW f AS ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
    st AS (SELECT symbol, ts, y, x, rn, 0.0::DOUBLE AS position FROM pz WHERE rn = 1 UNION ALL SELECT n.symbol, n.ts, n.y, n.x, n.rn, CASE WHEN n.z IS NULL THEN p.position WHEN p.position = 0 THEN CASE WHEN n.z >= 1 THEN -1.0 WHEN n.z <= -1 THEN 1.0 ELSE 0.0 END
      WHEN p.position > 0 AND n.z >= 0 THEN 0.0 WHEN p.position < 0 AND n.z <= 0 THEN 0.0 ELSE p.position END FROM st p JOIN pz n ON n.symbol = p.symbol AND n.rn = p.rn + 1),
    bk AS (SELECT *, coalesce(lag(position) OVER ({W}), 0) * (y - lag(y) OVER ({W}) - 0.5 * (x - lag(x) OVER ({W}))) / NULLIF(abs(lag(y) OVER ({W})) + abs(0.5 * lag(x) OVER ({W})), 0) - 2 * {turn()} * 5 / 10000 AS pnl FROM st)"""
query("f15_pairs_backtest", HELD + " SELECT ts, position, pnl FROM bk", "ts!", "position pnl")(lambda s, d: B.pair_backtest(held(s, d), ["symbol"], "ts", 0.5))
query("f16_beta_path_backtest", HELD.replace("0.5 * (x - lag(x)", "lag(x / y / 10) OVER (PARTITION BY symbol ORDER BY ts) * (x - lag(x)").replace("abs(0.5 * lag(x)", "abs(lag(x / y / 10) OVER (PARTITION BY symbol ORDER BY ts) * lag(x)") + " SELECT ts, position, pnl FROM bk", "ts!", "position pnl")(lambda s, d: B.pair_backtest(held(s, d).withColumn("b", F.col("x") / F.col("y") / 10), ["symbol"], "ts", "b"))
query("a27_value_at_risk", HELD + " SELECT symbol, -quantile_cont(pnl, 0.05) AS x FROM bk GROUP BY symbol", "symbol", "x")(lambda s, d: B.pair_backtest(held(s, d), ["symbol"], "ts", 0.5).groupBy("symbol").agg(E.value_at_risk("pnl").alias("x")))
query("f19_rolling_adf_gate", None, "ts!", "tau", 4)(lambda s, d: E.rolling_adf(pair(s, d).withColumn("e", F.col("y") - F.col("x")), ["symbol"], "ts", "e", 60))

# --- information coefficients ------------------------------------------------------------------------------

IC = f"""WITH {RSI_T}, lf AS (SELECT 'f' AS factor, f AS value, t FROM fac WHERE t IS NOT NULL UNION ALL SELECT 'ret', ret, t FROM fac WHERE t IS NOT NULL), ok AS (SELECT * FROM lf WHERE value IS NOT NULL),
    cl AS (SELECT *, greatest(least(value, quantile_cont(value, 0.95) OVER p), quantile_cont(value, 0.05) OVER p) AS clipped, rank() OVER (PARTITION BY factor ORDER BY value) + (count(*) OVER (PARTITION BY factor, value) - 1) / 2.0 AS rv,
      rank() OVER (PARTITION BY factor ORDER BY t) + (count(*) OVER (PARTITION BY factor, t) - 1) / 2.0 AS rt FROM ok WINDOW p AS (PARTITION BY factor)),
    ics AS (SELECT factor, corr(value, t) AS pearson_ic, corr(clipped, t) AS clipped_ic, corr(rv, rt) AS spearman_ic, count(*) AS n_obs FROM cl GROUP BY factor)"""


def factors(s, d) -> DataFrame:
    return X.rsi(T.bars(s, d), 14, "f").withColumns({"ret": R.change("close", 1, X.W), "t": R.ahead("close", 1, X.W)})


query("a07_ic_table", IC + " SELECT * FROM ics", "factor n_obs", "pearson_ic clipped_ic spearman_ic", 5)(lambda s, d: S.ic_table(factors(s, d), ["f", "ret"], "t"))
query("t01_sort_by_abs", IC + " SELECT factor, row_number() OVER (ORDER BY abs(pearson_ic) DESC) AS place FROM ics", "factor place")(lambda s, d: S.ic_table(factors(s, d), ["f", "ret"], "t").withColumn("place", F.row_number().over(Window.orderBy(F.abs("pearson_ic").desc())).cast("long")))
query("t02_top_factors", IC + " SELECT row_number() OVER (ORDER BY abs(clipped_ic) DESC) AS rank, factor, abs(clipped_ic) AS score, CAST(CASE WHEN pearson_ic < 0 THEN -1 ELSE 1 END AS BIGINT) AS direction FROM ics", "rank factor direction", "score", 5)(lambda s, d: S.top_factors(S.ic_table(factors(s, d), ["f", "ret"], "t"), 1000, 5, 100))
RANKED = "rank() OVER (PARTITION BY {p} ORDER BY {c}) + (count(*) OVER (PARTITION BY {p}, {c}) - 1) / 2.0"
query("a08_rank_ic", f"WITH {RSI_T}, k AS (SELECT symbol, {RANKED.format(p='symbol', c='f')} AS a, {RANKED.format(p='symbol', c='t')} AS b FROM fac WHERE f IS NOT NULL AND t IS NOT NULL) SELECT symbol, corr(a, b) AS ic, count(*) AS n FROM k GROUP BY symbol", "symbol n", "ic", 5)(lambda s, d: S.rank_ic(factors(s, d), "f", "t", ["symbol"]))
DAILY = f"WITH {RSI_T}, k AS (SELECT CAST(ts AS DATE) AS day, {RANKED.format(p='CAST(ts AS DATE)', c='f')} AS a, {RANKED.format(p='CAST(ts AS DATE)', c='t')} AS b FROM fac WHERE f IS NOT NULL AND t IS NOT NULL), md AS (SELECT day, CASE WHEN count(*) >= 3 THEN corr(a, b) END AS ic, count(*) AS n FROM k GROUP BY day)"

def by_day(s, d) -> DataFrame:
    return S.rank_ic(factors(s, d).withColumn("day", F.col("ts").cast("date")), "f", "t", ["day"])


query("a09_monthly_rank_ic", DAILY + " SELECT * FROM md", "day! n", "ic", 5)(by_day)
query("a10_ic_summary", DAILY + " SELECT avg(ic) AS mean_ic, stddev_pop(ic) AS std_ic, count(ic) AS months, avg(ic) / NULLIF(stddev_pop(ic), 0) AS ir FROM md", "months", "mean_ic std_ic ir", 5)(lambda s, d: S.ic_summary(by_day(s, d)))
query("a11_ic_score", f"WITH {RSI_T} SELECT symbol, (0.6 * corr(f, t) + 0.4 * corr(ret, t)) / 1.0 AS score FROM fac GROUP BY symbol", "symbol", "score", 5)(lambda s, d: factors(s, d).groupBy("symbol").agg(F.corr("f", "t").alias("a"), F.corr("ret", "t").alias("b"), F.lit(None).cast("double").alias("c")).select("symbol", S.weighted_mean([(F.col("a"), 0.6), (F.col("b"), 0.4), (F.col("c"), 1.0)]).alias("score")))
query("a12_event_study", f"WITH {Z20}, e AS (SELECT CASE WHEN z > 1 THEN 'overheated' WHEN z < -1 THEN 'overcooled' ELSE 'neutral' END AS regime, lead(close) OVER ({W}) - close AS t, z FROM zz) SELECT regime, avg(t) AS mean, count(t) AS n FROM e WHERE z IS NOT NULL GROUP BY regime", "regime n", "mean", 5)(
    lambda s, d: z20(T.bars(s, d)).withColumn("t", F.lead("close").over(X.W) - F.col("close")).where("z is not null").groupBy(F.when(F.col("z") > 1, "overheated").when(F.col("z") < -1, "overcooled").otherwise("neutral").alias("regime")).agg(F.avg("t").alias("mean"), F.count("t").alias("n")))
query("a13_quintiles", "WITH e AS (SELECT quantile_cont(close, [0.2, 0.4, 0.6, 0.8]) AS q FROM v1), b AS (SELECT 1 + CAST(close > q[1] AS INT) + CAST(close > q[2] AS INT) + CAST(close > q[3] AS INT) + CAST(close > q[4] AS INT) AS bin, volume FROM v1, e) SELECT CAST(bin AS BIGINT) AS bin, count(*) AS n, avg(volume) AS x FROM b GROUP BY bin", "bin n", "x")(lambda s, d: S.quantile_bin(T.bars(s, d), "close", 5).groupBy("bin").agg(F.count("*").alias("n"), F.avg("volume").alias("x")))
query("a14_split_date_range", f"{SIGNAL} SELECT symbol, split, min(ts) AS a, max(ts) AS b FROM sp GROUP BY symbol, split", "symbol split a b")(lambda s, d: signal_frame(s, d).groupBy("symbol", "split").agg(F.min("ts").alias("a"), F.max("ts").alias("b")))
query("a18_data_quality", "SELECT symbol, min(ts) AS a, max(ts) AS b, count(*) AS n, count(*) - count(DISTINCT ts) AS duplicates, CAST(date_diff('hour', min(ts), max(ts)) + 1 - count(DISTINCT ts) AS BIGINT) AS missing FROM v1 GROUP BY symbol", "symbol a b n duplicates missing")(
    lambda s, d: T.bars(s, d).groupBy("symbol").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("n"), (F.count("*") - F.count_distinct("ts")).alias("duplicates"), (F.timestamp_diff("HOUR", F.min("ts"), F.max("ts")) + 1 - F.count_distinct("ts")).alias("missing")))

# --- tabular -----------------------------------------------------------------------------------------------

source("a19_completeness", lambda s, d: T.labelled(s, d).agg(F.avg(F.col("quality").isNotNull().cast("int")).alias("full"), F.avg("quality").alias("share"), F.count("*").alias("n")), "SELECT avg(CAST(quality IS NOT NULL AS INT)) AS \"full\", avg(quality) AS share, count(*) AS n FROM v7".replace('"full"', "complete"), "n", "share")
FACTS = " UNION ALL ".join(f"SELECT '{c}' AS name, min({c}) AS lo, max({c}) AS hi, CASE WHEN stddev_pop({c}) > 0 THEN skewness({c}) END AS skew, count(DISTINCT {c}) AS d, count({c}) AS n FROM v7" for c in ("n_chars", "quality", "toxic"))
query("a20_distributions", f"""WITH fc AS ({FACTS}) SELECT name, CASE WHEN lo >= 0 AND hi <= 1 THEN 'ratio' WHEN lo >= 0 AND hi <= 5 THEN 'rating' WHEN lo >= 0 AND hi <= 6 THEN 'weekday' WHEN lo >= 0 AND hi <= 30 THEN 'date' WHEN lo >= 0 AND hi <= 100 THEN 'percentage'
      WHEN lo >= 1990 AND hi <= 2100 THEN 'year' WHEN d / n < 0.15 THEN 'discrete' WHEN skew > 1 THEN 'right_skewed' WHEN abs(skew) < 0.5 THEN 'normal' ELSE 'general' END AS distribution,
    CASE WHEN d <= 10 THEN 'low' WHEN d <= 50 AND d / n < 0.85 THEN 'medium' ELSE 'high' END AS cardinality FROM fc""", "name distribution cardinality")(lambda s, d: S.kinds_of(T.labelled(s, d), ["n_chars", "quality", "toxic"]).withColumnRenamed("column", "name"))
source("a21_cardinality", lambda s, d: T.labelled(s, d).agg(F.count_distinct("lang").alias("lang"), F.count_distinct("source").alias("source"), F.count_distinct("doc_id").alias("doc")), "SELECT count(DISTINCT lang) AS lang, count(DISTINCT source) AS source, count(DISTINCT doc_id) AS doc FROM v7", "lang source doc")
source("a22_tukey_fences", lambda s, d: Tb.fences(T.labelled(s, d), ["n_chars"]), "SELECT quantile_cont(n_chars, 0.25) - 1.5 * (quantile_cont(n_chars, 0.75) - quantile_cont(n_chars, 0.25)) AS n_chars_lo, quantile_cont(n_chars, 0.75) + 1.5 * (quantile_cont(n_chars, 0.75) - quantile_cont(n_chars, 0.25)) AS n_chars_hi FROM v7", "", "n_chars_lo n_chars_hi", 3)
source("a23_feature_rank", lambda s, d: S.feature_gap(T.labelled(s, d).select("quality", F.col("n_chars").cast("double").alias("n_chars"), F.col("toxic").cast("double").alias("toxic")), "quality", ["n_chars", "toxic"], 0.0), "SELECT * FROM (SELECT 'n_chars' AS factor, abs(avg(n_chars) FILTER (WHERE quality = 0) - avg(n_chars) FILTER (WHERE quality = 1)) / stddev_samp(n_chars) AS gap FROM v7 UNION ALL SELECT 'toxic', abs(avg(toxic) FILTER (WHERE quality = 0) - avg(toxic) FILTER (WHERE quality = 1)) / stddev_samp(toxic) FROM v7) WHERE gap > 0", "factor", "gap")
source("a24_constant_columns", lambda s, d: T.labelled(s, d).withColumn("c", F.lit(1)).agg(F.count_distinct("c").alias("c"), F.count_distinct("lang").alias("lang")), "SELECT CAST(1 AS BIGINT) AS c, count(DISTINCT lang) AS lang FROM v7", "c lang")
query("a25_redundant_columns", "SELECT * FROM (VALUES ('n_chars', 'twice')) t(a, b)", "a b")(lambda s, d: S.redundant_pairs(T.labelled(s, d).select(F.col("n_chars").cast("double").alias("n_chars"), (F.col("n_chars") * 2.0).alias("twice"), F.col("quality").cast("double").alias("quality")), ["n_chars", "twice", "quality"]))
source("a26_frequency_codes", lambda s, d: Tb.frequency_codes(T.labelled(s, d), "source"), "SELECT source AS value, count(*) / sum(count(*)) OVER () AS code FROM v7 GROUP BY source", "value", "code")
simple("a32_covariance", lambda b: P.covariance(b, "symbol", "close"), "SELECT a.symbol AS a, b.symbol AS b, covar_samp(a.close, b.close) AS cov FROM v1 a JOIN v1 b USING (ts) GROUP BY 1, 2", "cov", "a b", 4)
simple("a33_parameter_impact", lambda b: b.groupBy("symbol", F.hour("ts").alias("h")).agg(F.avg("close").alias("m")).groupBy("symbol").agg((F.max("m") - F.min("m")).alias("x")), "SELECT symbol, max(m) - min(m) AS x FROM (SELECT symbol, hour(ts) AS h, avg(close) AS m FROM v1 GROUP BY 1, 2) GROUP BY symbol", "x", "symbol")
simple("a34_pivot", lambda b: b.groupBy("symbol").pivot("volume", [1, 2, 3]).agg(F.avg("close")).withColumnsRenamed({"1": "v_1", "2": "v_2", "3": "v_3"}), "SELECT symbol, avg(close) FILTER (WHERE volume = 1) AS v_1, avg(close) FILTER (WHERE volume = 2) AS v_2, avg(close) FILTER (WHERE volume = 3) AS v_3 FROM v1 GROUP BY symbol", "v_1 v_2 v_3", "symbol", 5)
source("a35_describe", lambda s, d: T.labelled(s, d).groupBy("quality").agg(F.count("*").alias("n"), F.min("n_chars").alias("lo"), F.max("n_chars").alias("hi"), F.avg("n_chars").alias("mean")), "SELECT quality, count(*) AS n, min(n_chars) AS lo, max(n_chars) AS hi, avg(n_chars) AS mean FROM v7 GROUP BY quality", "quality n lo hi", "mean", 4)
source("a37_hedge_median", lambda s, d: T.pair(s, d).agg(F.percentile(-0.5 * F.col("y") / F.col("x"), F.lit(0.5)).alias("x")), "SELECT quantile_cont(-0.5 * y / x, 0.5) AS x FROM v2", "", "x")
query("a38_trade_list", HELD + ", nw AS (SELECT *, CASE WHEN position = lag(position) OVER (PARTITION BY symbol ORDER BY ts) THEN 0 ELSE 1 END AS fresh FROM bk), ru AS (SELECT *, sum(fresh) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM nw), tr AS (SELECT run, sum(pnl) AS r, count(*) AS n FROM ru WHERE position <> 0 GROUP BY run) SELECT count(*) AS trades, avg(CAST(r > 0 AS INT)) AS win_rate, avg(r) AS mean_return, avg(n) AS mean_hold FROM tr", "trades", "win_rate mean_return mean_hold", 5)(
    lambda s, d: B.pair_backtest(held(s, d), ["symbol"], "ts", 0.5).withColumn("fresh", F.coalesce((F.col("position") != F.lag("position").over(X.W)).cast("int"), F.lit(1))).withColumn("run", F.sum("fresh").over(R.cum(X.W))).where("position <> 0").groupBy("run").agg(F.sum("pnl").alias("r"), F.count("*").alias("n")).agg(F.count("*").alias("trades"), F.avg((F.col("r") > 0).cast("int")).alias("win_rate"), F.avg("r").alias("mean_return"), F.avg("n").alias("mean_hold")))
source("a40_distinct_counts", lambda s, d: T.labelled(s, d).agg(F.count_distinct("source").alias("a"), F.count_distinct("n_chars").alias("b")), "SELECT count(DISTINCT source) AS a, count(DISTINCT n_chars) AS b FROM v7", "a b")
FENCED = "WITH fe AS (SELECT quantile_cont(n_chars, 0.25) AS a, quantile_cont(n_chars, 0.75) AS b FROM v7) SELECT doc_id, least(greatest(n_chars, a - 1.5 * (b - a)), b + 1.5 * (b - a)) AS n_chars FROM v7, fe"
source("m06_scale_clip", lambda s, d: (lambda t: Tb.clip(t, Tb.fences(t, ["n_chars"]), ["n_chars"]))(T.labelled(s, d)), FENCED, "doc_id", "n_chars", 3)
source("m06_log_clip", lambda s, d: (lambda t: Tb.log_clip(t, t, "n_chars"))(T.labelled(s, d)), "WITH l AS (SELECT doc_id, ln(1 + n_chars) AS l FROM v7), fe AS (SELECT quantile_cont(l, 0.25) AS a, quantile_cont(l, 0.75) AS b FROM l) SELECT doc_id, exp(least(l, b + 1.5 * (b - a))) - 1 AS n_chars FROM l, fe", "doc_id", "n_chars", 3)
source("m07_encoding", lambda s, d: (lambda t: Tb.encode(t, Tb.label_codes(t.where("lang <> 'fr'"), "lang"), "lang"))(T.labelled(s, d)), "WITH c AS (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS code FROM (SELECT DISTINCT lang FROM v7 WHERE lang <> 'fr')) SELECT doc_id, CAST(floor(coalesce(c.code, (SELECT quantile_cont(code, 0.5) FROM c))) AS BIGINT) AS lang FROM v7 LEFT JOIN c USING (lang)", "doc_id lang")
source("m08_standard_scaler", lambda s, d: (lambda t: Tb.standard_scale(t, ["n_chars"], t))(T.labelled(s, d).withColumn("n_chars", F.col("n_chars").cast("double"))), "SELECT doc_id, (n_chars - avg(n_chars) OVER ()) / stddev_pop(n_chars) OVER () AS n_chars FROM v7", "doc_id", "n_chars")
source("m09_stratified_split", lambda s, d: Tb.stratified_split(T.labelled(s, d), "quality", "doc_id").select("doc_id", "quality", "split"), "SELECT doc_id, quality, CASE WHEN row_number() OVER (PARTITION BY quality ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) <= floor(count(*) OVER (PARTITION BY quality) * 0.8) THEN 'train' ELSE 'test' END AS split FROM v7", "doc_id quality split")
source("m16_confusion", lambda s, d: Tb.confusion(T.labelled(s, d).withColumn("p", (F.col("n_chars") > 1000).cast("int")), "quality", "p"), "SELECT quality, CAST(n_chars > 1000 AS INT) AS p, count(*) AS n FROM v7 GROUP BY 1, 2", "quality p n")
source("m16_auc", lambda s, d: S.auc(T.labelled(s, d), "n_chars", "quality"), "WITH k AS (SELECT quality, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS r FROM v7) SELECT (sum(r) FILTER (WHERE quality = 1) - count(*) FILTER (WHERE quality = 1) * (count(*) FILTER (WHERE quality = 1) + 1) / 2.0) / (count(*) FILTER (WHERE quality = 1) * count(*) FILTER (WHERE quality = 0)) AS auc FROM k", "", "auc")
source("m17_anova_f", lambda s, d: S.f_statistic(T.labelled(s, d).select("quality", F.col("n_chars").cast("double").alias("n_chars"), F.col("toxic").cast("double").alias("toxic")), "quality", ["n_chars", "toxic"]),
       "WITH l AS (SELECT quality, 'n_chars' AS factor, CAST(n_chars AS DOUBLE) AS v FROM v7 UNION ALL SELECT quality, 'toxic', toxic FROM v7), g AS (SELECT factor, quality, count(*) AS n, avg(v) AS m, var_pop(v) AS s FROM l GROUP BY 1, 2), a AS (SELECT factor, avg(v) AS m, count(*) AS n FROM l GROUP BY 1) SELECT g.factor, sum(g.n * pow(g.m - a.m, 2)) / (count(*) - 1) / (sum(g.n * g.s) / (any_value(a.n) - count(*))) AS f FROM g JOIN a USING (factor) GROUP BY g.factor", "factor", "f", 5)
BINNED = """WITH l AS (SELECT quality AS y, 'n_chars' AS factor, CAST(n_chars AS DOUBLE) AS v FROM v7 UNION ALL SELECT quality, 'toxic', toxic FROM v7),
    e AS (SELECT factor, quantile_cont(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM l GROUP BY factor), b AS (SELECT factor, y, len(list_filter(q, lambda x: v > x)) AS bin FROM l JOIN e USING (factor)),
    c AS (SELECT factor, bin, y, count(*) AS n FROM b GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY factor, bin) AS r, sum(n) OVER (PARTITION BY factor, y) AS k, sum(n) OVER (PARTITION BY factor) AS a FROM c)
    SELECT factor, sum(n / a * ln(n * a / (r * k))) AS mi FROM t GROUP BY factor"""
query("m18_mutual_information", BINNED, "factor", "mi")(lambda s, d: S.mutual_information(T.labelled(s, d).select("quality", F.col("n_chars").cast("double").alias("n_chars"), F.col("toxic").cast("double").alias("toxic")), "quality", ["n_chars", "toxic"]))
