"""Queries of the window operators over hourly bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import rolling as R
from tidemark.functions import technical as X
from tidemark.operators import folds
from tidemark.plans.registry import query
from tidemark.sources.tables import bars

W = "PARTITION BY symbol ORDER BY ts"


def roll(agg: str, x: str, n: int, least: int | None = None) -> str:
    """SQL of a gated rolling aggregate."""
    frame = f"OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {frame} >= {least or n} THEN {agg}({x}) {frame} END"


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER ({W})"


CHANGE = f"close / NULLIF({lag('close')}, 0) - 1"


def simple(name: str, fn, sql: str, values: str = "x", keys: str = "symbol ts", digits: int = 6) -> None:
    """A query that applies fn to the bars."""
    query(name, sql, keys, values, digits)(lambda spark, d, fn=fn: fn(bars(spark, d)))


simple("w01_zscore", lambda b: X.zscore(b, "close", 20, "x"), f"SELECT symbol, ts, (close - {roll('avg', 'close', 20)}) / NULLIF({roll('stddev_samp', 'close', 20)}, 0) AS x FROM v1")
simple("w02_momentum", lambda b: X.momentum(b, 24, "x"), f"SELECT symbol, ts, close / NULLIF({lag('close', 24)}, 0) - 1 AS x FROM v1")
simple("w03_pct_change_reversal", lambda b: X.reversal(X.momentum(b, 3, "x"), 12, "y"), f"SELECT symbol, ts, close / NULLIF({lag('close', 3)}, 0) - 1 AS x, -(close / NULLIF({lag('close', 12)}, 0) - 1) AS y FROM v1", "x y")
simple(
    "w04_volume_price_trend",
    lambda b: X.volume_price_trend(b, 24, "x"),
    f"""WITH r AS (SELECT *, {CHANGE} AS ret, (volume - {roll('avg', 'volume', 24)}) / NULLIF({roll('stddev_samp', 'volume', 24)}, 0) AS z FROM v1)
    SELECT symbol, ts, ({roll('sum', 'ret', 24)}) * z AS x FROM r""",
)
simple("w05_range_position", lambda b: X.range_position(b, 48, "x"), f"SELECT symbol, ts, (close - {roll('min', 'low', 48)}) / NULLIF({roll('max', 'high', 48)} - {roll('min', 'low', 48)}, 0) - 0.5 AS x FROM v1")
simple(
    "w06_rsi",
    lambda b: X.rsi(b, 14, "x"),
    f"""WITH r AS (SELECT *, {CHANGE} AS ret FROM v1),
    g AS (SELECT *, CASE WHEN ret IS NOT NULL THEN greatest(ret, 0) END AS up, CASE WHEN ret IS NOT NULL THEN greatest(-ret, 0) END AS down FROM r),
    m AS (SELECT *, {roll('avg', 'up', 14)} AS gain, {roll('avg', 'down', 14)} AS loss FROM g)
    SELECT symbol, ts, CASE WHEN loss = 0 AND gain > 0 THEN 100 ELSE 100 - 100 / NULLIF(1 + gain / NULLIF(loss, 0), 0) END AS x FROM m""",
)
simple("w07_rolling_volatility", lambda b: X.volatility(b, 24, "x"), f"WITH r AS (SELECT *, {CHANGE} AS ret FROM v1) SELECT symbol, ts, {roll('stddev_samp', 'ret', 24)} AS x FROM r", digits=5)
simple(
    "w08_rolling_autocorrelation",
    lambda b: X.autocorrelation(b, 48, "x"),
    f"""WITH r AS (SELECT *, {CHANGE} AS ret FROM v1), s AS (SELECT *, {lag('ret')} AS before FROM r),
    t AS (SELECT *, CASE WHEN ret IS NOT NULL AND before IS NOT NULL THEN 1 END AS ok FROM s)
    SELECT symbol, ts, CASE WHEN count(ok) OVER f = 48 THEN corr(ret, before) OVER f END AS x FROM t WINDOW f AS ({W} ROWS BETWEEN 47 PRECEDING AND CURRENT ROW)""",
    digits=5,
)
simple("w09_bollinger_position", lambda b: X.bollinger_position(b, 20, "x"), f"SELECT symbol, ts, (close - ({roll('avg', 'close', 20)} - 2 * {roll('stddev_samp', 'close', 20)})) / NULLIF(4 * {roll('stddev_samp', 'close', 20)}, 0) AS x FROM v1")


def ewm_sql(source: str, x: str, alpha: float, name: str) -> str:
    """Recursive CTEs name_n, name: EWM of a null-free column over rows numbered rn."""
    return f"""{name} AS (SELECT symbol, rn, CAST({x} AS DOUBLE) AS y FROM {source} WHERE rn = 1
      UNION ALL SELECT s.symbol, s.rn, p.y + {alpha!r} * (s.{x} - p.y) FROM {name} p JOIN {source} s ON s.symbol = p.symbol AND s.rn = p.rn + 1)"""


NUMBERED = f"b AS (SELECT *, row_number() OVER ({W}) AS rn FROM v1)"
simple(
    "w10_macd_normalized",
    lambda b: X.macd_normalized(b, "x"),
    f"""WITH RECURSIVE {NUMBERED}, {ewm_sql('b', 'close', 2 / 13, 'fast')}, {ewm_sql('b', 'close', 2 / 27, 'slow')},
    macd AS (SELECT f.symbol, f.rn, f.y - s.y AS m FROM fast f JOIN slow s USING (symbol, rn)), {ewm_sql('macd', 'm', 2 / 10, 'sig')}
    SELECT b.symbol, b.ts, (m.m - s.y) / NULLIF(b.close, 0) AS x FROM b JOIN macd m USING (symbol, rn) JOIN sig s USING (symbol, rn)""",
)
simple("w11_distance_from_ma", lambda b: X.distance_from_ma(X.distance_from_ma(b, 10, "x"), 50, "y"), f"SELECT symbol, ts, close / NULLIF({roll('avg', 'close', 10)}, 0) - 1 AS x, close / NULLIF({roll('avg', 'close', 50)}, 0) - 1 AS y FROM v1", "x y")
simple(
    "w12_money_flow_index",
    lambda b: X.money_flow(b, 14, "x"),
    f"""WITH t AS (SELECT *, (high + low + close) / 3.0 AS tp FROM v1), l AS (SELECT *, {lag('tp')} AS before FROM t),
    f AS (SELECT *, CASE WHEN tp > before THEN tp * volume ELSE 0 END AS up, CASE WHEN tp < before THEN tp * volume ELSE 0 END AS down FROM l)
    SELECT symbol, ts, 100 - 100 / (1 + ({roll('sum', 'up', 14)}) / NULLIF({roll('sum', 'down', 14)}, 0)) AS x FROM f""",
)
simple("w13_stochastic", lambda b: X.stochastic(b, "close", 10, "x"), f"SELECT symbol, ts, (close - {roll('min', 'close', 10)}) / NULLIF({roll('max', 'close', 10)} - {roll('min', 'close', 10)}, 0) * 100 AS x FROM v1")


def _equity(b: DataFrame) -> DataFrame:
    b = b.withColumn("ret", R.change("close", 1, X.W) / 1000)
    b = b.withColumn("added", 1 + F.sum(F.coalesce("ret", F.lit(0.0))).over(R.cum(X.W))).withColumn("grown", F.product(1 + F.coalesce("ret", F.lit(0.0))).over(R.cum(X.W)))
    return b.withColumn("peak", F.max("added").over(R.cum(X.W)))


simple(
    "w14_running_equity",
    _equity,
    f"""WITH r AS (SELECT symbol, ts, ({CHANGE}) / 1000 AS ret FROM v1),
    e AS (SELECT symbol, ts, 1 + sum(coalesce(ret, 0)) OVER c AS added, product(1 + coalesce(ret, 0)) OVER c AS grown FROM r WINDOW c AS ({W} ROWS UNBOUNDED PRECEDING))
    SELECT *, max(added) OVER ({W} ROWS UNBOUNDED PRECEDING) AS peak FROM e""",
    "added grown peak",
)


def later_ewm(source: str, x: str, alpha: float, name: str, first: int) -> str:
    """As ewm_sql for a column whose first value stands in row first."""
    return f"""{name} AS (SELECT symbol, rn, CAST({x} AS DOUBLE) AS y FROM {source} WHERE rn = {first}
      UNION ALL SELECT s.symbol, s.rn, CASE WHEN s.{x} IS NULL THEN p.y ELSE p.y + {alpha!r} * (s.{x} - p.y) END FROM {name} p JOIN {source} s ON s.symbol = p.symbol AND s.rn = p.rn + 1)"""


def stochastic_sql(source: str, name: str) -> str:
    frame = "OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"
    return f"{name} AS (SELECT symbol, rn, CASE WHEN count(y) {frame} = 10 THEN (y - min(y) {frame}) / NULLIF(max(y) {frame} - min(y) {frame}, 0) * 100 END AS k FROM {source})"


simple(
    "w15_schaff_trend_cycle",
    lambda b: X.schaff_trend_cycle(b, "x"),
    f"""WITH RECURSIVE {NUMBERED}, {ewm_sql('b', 'close', 2 / 13, 'fast')}, {ewm_sql('b', 'close', 2 / 27, 'slow')},
    macd AS (SELECT f.symbol, f.rn, f.y - s.y AS y FROM fast f JOIN slow s USING (symbol, rn)), {stochastic_sql('macd', 'k1')}, {later_ewm('k1', 'k', 0.5, 'p1', 10)},
    {stochastic_sql('p1', 'k2')}, {later_ewm('k2', 'k', 0.5, 'stc', 19)}
    SELECT b.symbol, b.ts, stc.y AS x FROM b LEFT JOIN stc ON stc.symbol = b.symbol AND stc.rn = b.rn""",
)
simple(
    "w16_directional_movement",
    lambda b: X.directional_movement(b),
    f"""WITH RECURSIVE b AS (SELECT *, row_number() OVER ({W}) AS rn, high - {lag('high')} AS up, {lag('low')} - low AS dn, greatest(abs(high - low), abs(high - {lag('close')}), abs(low - {lag('close')})) AS tr FROM v1),
    c AS (SELECT symbol, ts, rn, tr, CASE WHEN up > dn AND up > 0 THEN up ELSE 0.0 END AS p, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0.0 END AS m FROM b),
    e AS (SELECT symbol, ts, rn, CAST(tr AS DOUBLE) AS t, CAST(p AS DOUBLE) AS ps, CAST(m AS DOUBLE) AS ms FROM c WHERE rn = 1
      UNION ALL SELECT c.symbol, c.ts, c.rn, e.t + {1 / 14!r} * (c.tr - e.t), e.ps + {1 / 14!r} * (c.p - e.ps), e.ms + {1 / 14!r} * (c.m - e.ms) FROM e JOIN c ON c.symbol = e.symbol AND c.rn = e.rn + 1),
    d AS (SELECT symbol, ts, rn, CASE WHEN rn >= 14 THEN 100 * ps / NULLIF(t, 0) END AS plus_di, CASE WHEN rn >= 14 THEN 100 * ms / NULLIF(t, 0) END AS minus_di FROM e),
    x AS (SELECT *, 100 * abs(plus_di - minus_di) / NULLIF(plus_di + minus_di, 0) AS dx FROM d),
    g AS (SELECT symbol, rn, dx AS y FROM x WHERE rn = 14 UNION ALL SELECT x.symbol, x.rn, g.y + {1 / 14!r} * (x.dx - g.y) FROM g JOIN x ON x.symbol = g.symbol AND x.rn = g.rn + 1)
    SELECT x.symbol, x.ts, plus_di, minus_di, CASE WHEN x.rn >= 27 THEN g.y END AS adx FROM x LEFT JOIN g ON g.symbol = x.symbol AND g.rn = x.rn""",
    "plus_di minus_di adx",
)


def _w17(b: DataFrame) -> DataFrame:
    b = X.rsi(b, 14, "f").withColumn("t", R.ahead("close", 1, X.W))
    b = X.rolling_correlation(b, "f", "t", 48, "x")
    b = b.withColumn("rf", R.average_rank("f", "symbol")).withColumn("rt", R.average_rank("t", "symbol"))
    return X.rolling_correlation(b, "rf", "rt", 48, "y")


RSI_T = f"""r AS (SELECT *, {CHANGE} AS ret, lead(close) OVER ({W}) / NULLIF(close, 0) - 1 AS t FROM v1),
    g AS (SELECT *, CASE WHEN ret IS NOT NULL THEN greatest(ret, 0) END AS up, CASE WHEN ret IS NOT NULL THEN greatest(-ret, 0) END AS down FROM r),
    m AS (SELECT *, {roll('avg', 'up', 14)} AS gain, {roll('avg', 'down', 14)} AS loss FROM g),
    fac AS (SELECT symbol, ts, close, ret, t, CASE WHEN loss = 0 AND gain > 0 THEN 100 ELSE 100 - 100 / NULLIF(1 + gain / NULLIF(loss, 0), 0) END AS f FROM m)"""
RANKS = """ranked AS (SELECT *, CASE WHEN f IS NOT NULL THEN rank() OVER (PARTITION BY symbol, f IS NULL ORDER BY f) + (count(*) OVER (PARTITION BY symbol, f) - 1) / 2.0 END AS rf,
      CASE WHEN t IS NOT NULL THEN rank() OVER (PARTITION BY symbol, t IS NULL ORDER BY t) + (count(*) OVER (PARTITION BY symbol, t) - 1) / 2.0 END AS rt FROM fac)"""
simple(
    "w17_rolling_ic",
    _w17,
    f"""WITH {RSI_T}, {RANKS}, k AS (SELECT *, CASE WHEN f IS NOT NULL AND t IS NOT NULL THEN 1 END AS ok FROM ranked)
    SELECT symbol, ts, CASE WHEN count(ok) OVER w = 48 THEN corr(f, t) OVER w END AS x, CASE WHEN count(ok) OVER w = 48 THEN corr(rf, rt) OVER w END AS y
    FROM k WINDOW w AS ({W} ROWS BETWEEN 47 PRECEDING AND CURRENT ROW)""",
    "x y",
    digits=5,
)
simple("w18_average_rank", lambda b: b.withColumn("x", R.average_rank("volume", "symbol")), "SELECT symbol, ts, rank() OVER (PARTITION BY symbol ORDER BY volume) + (count(*) OVER (PARTITION BY symbol, volume) - 1) / 2.0 AS x FROM v1")
PAST = "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


def past_q(x: str, n: int, q: float, least: int) -> str:
    frame = PAST.format(n=n)
    return f"CASE WHEN count({x}) {frame} >= {least} THEN quantile_cont({x}, {q}) {frame} END"


simple("w19_past_quantiles", lambda b: X.past_quantiles(b, "close", 60, {"x": 0.8, "y": 0.2}, 10), f"SELECT symbol, ts, {past_q('close', 60, 0.8, 10)} AS x, {past_q('close', 60, 0.2, 10)} AS y FROM v1", "x y")
simple("w20_past_quantiles_quarter", lambda b: X.past_quantiles(b, "close", 48, {"x": 0.9, "y": 0.1}, 12), f"SELECT symbol, ts, {past_q('close', 48, 0.9, 12)} AS x, {past_q('close', 48, 0.1, 12)} AS y FROM v1", "x y")
