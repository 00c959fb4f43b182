"""Queries of cleaning, joins, breadth, rules and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import rolling as R
from tidemark.functions import technical as X
from tidemark.operators import alignment as J
from tidemark.operators import backtest as B
from tidemark.operators import breadth as H
from tidemark.operators import cleaning as C
from tidemark.operators import rules
from tidemark.operators import statistics as S
from tidemark.plans.registry import query
from tidemark.queries.windows import CHANGE, RSI_T, W, simple
from tidemark.sources import tables as T

# --- sources -----------------------------------------------------------------------------------------------


def source(name: str, fn, sql: str, keys: str, values: str = "", digits: int = 6) -> None:
    query(name, sql, keys, values, digits)(fn)


source("s05_price_history", lambda s, d: T.bars(s, d).select("symbol", "ts", "open", "high", "low", "close", "volume").na.drop("all"), "SELECT * FROM v1", "symbol ts volume", "open high low close")
source("s07_close_series", lambda s, d: T.closes(T.bars(s, d)).select("symbol", "ts", "close"), "SELECT symbol, ts, CAST(close AS DOUBLE) AS close FROM v1 WHERE close IS NOT NULL", "symbol ts", "close")


@query("s08_all_pairs", "SELECT p.a || '/' || p.b AS pair, y.ts, y.close AS y, x.close AS x FROM (VALUES ('click', 'view'), ('purchase', 'signup')) p(a, b) JOIN v1 y ON y.symbol = p.a JOIN v1 x ON x.symbol = p.b AND x.ts = y.ts", "pair ts", "y x")
def s08(spark, d):
    pairs = spark.createDataFrame([("click", "view"), ("purchase", "signup")], "a string, b string")
    b = T.bars(spark, d).select("symbol", "ts", "close")
    legs = pairs.join(b.withColumnsRenamed({"symbol": "a", "close": "y"}), "a").join(b.withColumnsRenamed({"symbol": "b", "close": "x"}), ["b", "ts"])
    return legs.withColumn("pair", F.concat_ws("/", "a", "b"))


source("s09_trading_calendar", lambda s, d: T.calendar(s, d), "SELECT date FROM v4", "date!")
source("s10_constituents", lambda s, d: T.members(s, d), "SELECT * FROM v6", "symbol in_date! out_date!")
source("s11_index", lambda s, d: T.index_level(s, d), "SELECT * FROM v5", "date!", "close", -1)
source("s12_prices_long", lambda s, d: T.prices(s, d), "SELECT * FROM v3", "date! symbol", "close", -1)
source("s13_market_bundle", lambda s, d: T.calendar(s, d).agg(F.count("*").alias("n_dates")).crossJoin(T.prices(s, d).agg(F.count("*").alias("n_prices"), F.count_distinct("symbol").alias("n_symbols"))).crossJoin(T.members(s, d).agg(F.count("*").alias("n_spells"))),
       "SELECT (SELECT count(*) FROM v4) AS n_dates, (SELECT count(*) FROM v3) AS n_prices, (SELECT count(DISTINCT symbol) FROM v3) AS n_symbols, (SELECT count(*) FROM v6) AS n_spells", "n_dates n_prices n_symbols n_spells")
source("s17_labelled_table", lambda s, d: T.labelled(s, d), "SELECT * FROM v7", "doc_id lang source n_chars quality toxic")
NORMALS = """WITH a AS (SELECT range AS id FROM range(1000)),
    b AS (SELECT id, ((2*id+1)*48271 + 11) % 2147483647 AS p, ((2*id+2)*48271 + 11) % 2147483647 AS q FROM a),
    c AS (SELECT id, (p*p + 12345) % 2147483647 AS p, (q*q + 12345) % 2147483647 AS q FROM b),
    d AS (SELECT id, (p*69621 + 7) % 2147483647 AS p, (q*69621 + 7) % 2147483647 AS q FROM c),
    e AS (SELECT id, (p*p + 777) % 2147483647 AS p, (q*q + 777) % 2147483647 AS q FROM d)
    SELECT id, sqrt(-2*ln((p + 0.5e0)/2147483648e0)) * cos(2*pi()*((q + 0.5e0)/2147483648e0)) AS z FROM e"""
source("s03_normals", lambda s, d: T.normals(s, 1000), NORMALS, "id", "z")
query("s03_demo_bars")(lambda s, d: T.demo_bars(s, ["BTC/USDT", "ETH/USDT"], 500))
query("s04_source_with_fallback")(lambda s, d: T.first_available(lambda: s.read.parquet(f"{d}/no_such_table.parquet"), lambda: T.demo_bars(s, ["BTC/USDT"], 100)))

# --- projections and cleaning ------------------------------------------------------------------------------


@query("p01_parse_timestamp_auto", "SELECT event_id, date_trunc('second', ts) AS ms_ts, date_trunc('second', ts) AS iso_ts FROM events", "event_id ms_ts iso_ts")
def p01(spark, d):
    e = T.table(spark, d, "events").select("event_id", F.date_trunc("second", "ts").alias("t"))
    e = e.select("event_id", (F.unix_timestamp("t") * 1000).cast("string").alias("ms"), F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))
    return C.auto_timestamp(C.auto_timestamp(e, "ms", "ms_ts"), "iso", "iso_ts")


@query("p02_clean_ohlcv", "SELECT event_type AS symbol, ts, min_by(value, event_id) AS close FROM (SELECT event_type, event_id, value, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts FROM events) GROUP BY 1, 2", "symbol ts", "close")
def p02(spark, d):
    e = T.table(spark, d, "events").select("event_id", F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), F.col("value").cast("string").alias("close"))
    return C.clean_bars(e, "event_id", values=("close",))


source("p03_parse_numeric", lambda s, d: T.table(s, d, "orders").select("o_orderkey", C.number(F.concat(F.format_number("o_totalprice", 2), F.when(F.col("o_orderkey") % 7 == 0, "x").otherwise(""))).alias("x")), "SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS x FROM orders", "o_orderkey", "x", 2)
source("p04_parse_dates", lambda s, d: T.table(s, d, "orders").select("o_orderkey", C.mixed_date(F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy/MM/dd")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyyMMdd")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))).alias("date")), "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date FROM orders", "o_orderkey date!")
query("p05_column_types", "SELECT kind, name FROM (VALUES ('number', 'doc_id'), ('number', 'n_chars'), ('number', 'quality'), ('number', 'toxic'), ('other', 'lang'), ('other', 'source')) t(kind, name)", "kind name")(lambda s, d: s.createDataFrame([(k, c) for k, cs in zip(("number", "other"), C.numeric_columns(T.labelled(s, d)), strict=True) for c in cs], "kind string, name string"))


@query("p06_infer_types", "SELECT * FROM (VALUES ('doc_id', 'number'), ('lang', 'text'), ('n_chars', 'number'), ('day', 'date'), ('tag', 'id')) t(name, kind)", "name kind")
def p06(spark, d):
    rows = T.labelled(spark, d).select(F.col("doc_id").cast("string").alias("doc_id"), "lang", F.col("n_chars").cast("string").alias("n_chars"), F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 500).cast("int")), "yyyy-MM-dd").alias("day"), F.concat(F.lit("t"), F.col("doc_id")).alias("tag"))
    return C.column_kinds(rows, ["doc_id", "lang", "n_chars", "day", "tag"]).select(F.col("column").alias("name"), "kind")


source("p06_date_parts", lambda s, d: C.date_parts(T.table(s, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d")), "d"), "SELECT o_orderkey, year(d) AS d_year, month(d) AS d_month, day(d) AS d_day, isodow(d) - 1 AS d_weekday FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)", "o_orderkey", "d_year d_month d_day d_weekday")
source("p07_drop_duplicates", lambda s, d: T.table(s, d, "orders").select("o_orderpriority", "o_orderstatus").dropDuplicates(), "SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders", "o_orderpriority o_orderstatus")
source("p08_binary_label", lambda s, d: T.table(s, d, "orders").select("o_orderkey", C.binary_label(F.when(F.col("o_orderstatus") == "F", "Completed").when(F.col("o_orderstatus") == "P", "In Progress").when(F.col("o_orderkey") % 5 != 0, "open")).cast("long").alias("label")).where("label is not null"), "SELECT o_orderkey, CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS BIGINT) AS label FROM orders WHERE o_orderstatus <> 'P'", "o_orderkey label")


@query("p09_fill_missing", "WITH h AS (SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN n_chars END AS n_chars, CASE WHEN doc_id % 3 <> 0 THEN lang END AS lang FROM v7) SELECT doc_id, coalesce(n_chars, (SELECT quantile_cont(n_chars, 0.5) FROM h)) AS n_chars, coalesce(lang, 'Missing') AS lang FROM h", "doc_id lang", "n_chars")
def p09(spark, d):
    h = T.labelled(spark, d).select("doc_id", F.when(F.col("doc_id") % 5 != 0, F.col("n_chars")).alias("n_chars"), F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("lang"))
    return C.fill_missing(h, C.medians(h, ["n_chars"]), ["n_chars"], ["lang"])


source("p10_drop_null_label", lambda s, d: T.table(s, d, "documents").select("doc_id").join(T.table(s, d, "labels").select("doc_id", "quality"), "doc_id", "left").na.drop(subset=["quality"]), "SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL", "doc_id quality")
source("p11_align_schema", lambda s, d: C.align(T.labelled(s, d).withColumn("extra", F.lit(1)), T.table(s, d, "labels")), "SELECT doc_id, quality, toxic FROM v7", "doc_id quality toxic")
source("p12_infinite_to_null", lambda s, d: T.table(s, d, "events").select("event_id", F.try_divide(F.col("value"), F.col("value") - F.col("value")).alias("x"), F.try_divide(F.lit(1.0), F.col("value")).alias("y")), "SELECT event_id, value / NULLIF(value - value, 0) AS x, 1.0 / NULLIF(value, 0) AS y FROM events", "event_id", "x y")
simple("p13_horizon_targets", lambda b: b.withColumns({f"t{h}": R.ahead("close", h, X.W) for h in (1, 24, 48)}), "SELECT symbol, ts, " + ", ".join(f"lead(close, {h}) OVER ({W}) / NULLIF(close, 0) - 1 AS t{h}" for h in (1, 24, 48)) + " FROM v1", "t1 t24 t48")
simple("p14_directed_factors", lambda b: X.rsi(b, 14, "f").select("symbol", "ts", (F.col("f") * -1).alias("combo_rsi"), (R.change("close", 12, X.W) * 1).alias("combo_mom")), f"WITH {RSI_T} SELECT symbol, ts, -f AS combo_rsi, close / NULLIF(lag(close, 12) OVER ({W}), 0) - 1 AS combo_mom FROM fac", "combo_rsi combo_mom")
simple("p15_model_data", lambda b: B.split_rows(X.rsi(b, 14, "f").withColumns({"ret": R.change("close", 1, X.W), "t": R.ahead("close", 1, X.W)}).select("symbol", "ts", "f", "t", "ret").na.drop(), ["symbol"]),
       f"""WITH {RSI_T}, k AS (SELECT symbol, ts, f, t, ret, row_number() OVER ({W}) - 1 AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM fac WHERE f IS NOT NULL AND t IS NOT NULL AND ret IS NOT NULL)
       SELECT *, CASE WHEN rn < floor(n * 6 / 10) THEN 'train' WHEN rn < floor(n * 8 / 10) THEN 'valid' ELSE 'test' END AS split FROM k""", "f t ret", "symbol ts split")  # fmt: skip
simple("p16_analysis_rows", lambda b: X.zscore(b, "close", 20, "z").where("z is not null and close is not null").select("symbol", "ts"), f"SELECT symbol, ts FROM (SELECT *, count(close) OVER ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS n, stddev_samp(close) OVER ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS s FROM v1) WHERE n = 20 AND s > 0", "")
source("p18_split_by_periods", lambda s, d: J.periods(T.pair(s, d), ["1997-01-01", "1999-01-01"]).groupBy("period").agg(F.count("*").alias("n"), F.avg("y").alias("y")), "SELECT (CASE WHEN date >= DATE '1997-01-01' THEN 1 ELSE 0 END + CASE WHEN date >= DATE '1999-01-01' THEN 1 ELSE 0 END) AS period, count(*) AS n, avg(y) AS y FROM v2 GROUP BY 1", "period n", "y", 5)
simple("p19_next_up_target", lambda b: b.withColumn("n", R.ahead("close", 1, X.W)).where("n is not null").select("symbol", "ts", (F.col("n") > 0.0015).cast("long").alias("y")), f"SELECT symbol, ts, CAST(n > 0.0015 AS BIGINT) AS y FROM (SELECT symbol, ts, lead(close) OVER ({W}) / NULLIF(close, 0) - 1 AS n FROM v1) WHERE n IS NOT NULL", "", "symbol ts y")
simple("p20_regime", lambda b: X.zscore(b, "close", 20, "z").withColumn("regime", C.regime(F.col("z"))), f"SELECT symbol, ts, CASE WHEN z > 1 THEN 'overheated' WHEN z < -1 THEN 'overcooled' WHEN z IS NOT NULL THEN 'neutral' END AS regime FROM (SELECT *, CASE WHEN count(close) OVER f = 20 THEN (close - avg(close) OVER f) / NULLIF(stddev_samp(close) OVER f, 0) END AS z FROM v1 WINDOW f AS ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))", "", "symbol ts regime")
source("p21_enrich", lambda s, d: (lambda t: t.crossJoin(F.broadcast(t.agg(F.max("n_chars").alias("mx"), F.avg("n_chars").alias("mean")))).select("doc_id", F.bround(F.col("n_chars") / F.greatest("mx", F.lit(1)) * 0.3 + F.col("quality") * 0.7, 3).alias("x"), F.bround(F.col("n_chars") / F.greatest("mean", F.lit(1.0)), 3).alias("y")))(T.labelled(s, d)),
       "SELECT doc_id, round_even(n_chars / greatest((SELECT max(n_chars) FROM v7), 1) * 0.3 + quality * 0.7, 3) AS x, round_even(n_chars / greatest((SELECT avg(n_chars) FROM v7), 1), 3) AS y FROM v7", "doc_id", "x y", 3)
source("p22_ordinal", lambda s, d: T.labelled(s, d).select("doc_id", C.ordinal(F.col("lang"), ("en", "de", "fr")).cast("long").alias("x")), "SELECT doc_id, CAST(CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 2 WHEN 'fr' THEN 3 ELSE 1 END AS BIGINT) AS x FROM v7", "doc_id x")
source("p24_residual", lambda s, d: T.pair(s, d).select("date", (F.col("y") - 1000 - 0.5 * F.col("x")).alias("e")), "SELECT date, y - 1000 - 0.5 * x AS e FROM v2", "date!", "e", -1)
source("p25_zscore", lambda s, d: T.pair(s, d).select("date", ((F.col("y") - 1000 - 0.5 * F.col("x") - 10) / 500).alias("z")), "SELECT date, (y - 1000 - 0.5 * x - 10) / 500 AS z FROM v2", "date!", "z", -1)
source("x06_slug", lambda s, d: T.table(s, d, "part").select("p_partkey", C.slug(F.concat("p_brand", F.lit(" / Size #"), F.col("p_partkey").cast("string"), F.lit("!!"))).alias("slug")), "SELECT p_partkey, trim(regexp_replace(lower(p_brand || ' / Size #' || p_partkey || '!!'), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM part", "p_partkey slug")

# --- joins and sets ----------------------------------------------------------------------------------------

simple("j01_pair_panel", lambda b: J.pair_panel(b.where("symbol = 'click'").withColumn("k", F.lit("p")).withColumnRenamed("ts", "date"), b.where("symbol = 'view'").withColumn("k", F.lit("p")).withColumnRenamed("ts", "date"), "k"),
       "SELECT 'p' AS k, y.ts AS date, y.close AS y, x.close AS x, y.close / NULLIF(lag(y.close) OVER (ORDER BY y.ts), 0) - 1 AS y_ret, x.close / NULLIF(lag(x.close) OVER (ORDER BY y.ts), 0) - 1 AS x_ret FROM v1 y JOIN v1 x ON y.ts = x.ts WHERE y.symbol = 'click' AND x.symbol = 'view' QUALIFY count(*) OVER () >= 252", "y x y_ret x_ret", "k date")
source("j02_left_index", lambda s, d: T.pair(s, d).join(T.index_level(s, d).withColumn("ln", F.log("close")), "date", "left"), "SELECT v2.date, y, ln(v5.close) AS ln FROM v2 LEFT JOIN v5 ON v2.date = v5.date", "date!", "y ln", -1)
source("j03_split_labels", lambda s, d: (lambda t: t.join(B.split_rows(t.withColumn("k", F.lit(1)), ["k"], "date").select("date", "split"), "date"))(T.pair(s, d)), "SELECT date, CASE WHEN rn < floor(n * 6 / 10) THEN 'train' WHEN rn < floor(n * 8 / 10) THEN 'valid' ELSE 'test' END AS split FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS rn, count(*) OVER () AS n FROM v2)", "date! split")
simple("j05_alpha_matrix", lambda b: b.where("symbol in ('click', 'view', 'signup')").groupBy("ts").pivot("symbol", ["click", "view", "signup"]).agg(F.first("close")).na.drop(), "SELECT a.ts, a.close AS click, b.close AS view, c.close AS signup FROM v1 a JOIN v1 b ON a.ts = b.ts JOIN v1 c ON a.ts = c.ts WHERE a.symbol = 'click' AND b.symbol = 'view' AND c.symbol = 'signup'", "click view signup", "ts")
simple("j04_dual_signal", lambda b: b.where("symbol = 'click'").select("ts", F.col("close").alias("a")).join(b.where("symbol = 'view'").select("ts", F.col("close").alias("b")), "ts").na.drop(), "SELECT x.ts, x.close AS a, y.close AS b FROM v1 x JOIN v1 y ON x.ts = y.ts WHERE x.symbol = 'click' AND y.symbol = 'view'", "a b", "ts")
simple("j06_bars_target_atr", lambda b: b.join(X.zscore(b, "close", 20, "z").where("z is not null").select("symbol", "ts", "z"), ["symbol", "ts"]).join(X.average_true_range(b, 24, "atr").select("symbol", "ts", "atr"), ["symbol", "ts"], "left"),
       f"""WITH t AS (SELECT *, greatest(abs(high - low), abs(high - lag(close) OVER ({W})), abs(low - lag(close) OVER ({W}))) AS tr FROM v1),
       z AS (SELECT *, CASE WHEN count(close) OVER f = 20 THEN (close - avg(close) OVER f) / NULLIF(stddev_samp(close) OVER f, 0) END AS z, CASE WHEN count(tr) OVER g >= 6 THEN avg(tr) OVER g END AS atr FROM t
         WINDOW f AS ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), g AS ({W} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)) SELECT * FROM z WHERE z IS NOT NULL""", "z atr")  # fmt: skip
SPELLS = "SELECT DISTINCT c.date, m.symbol FROM v4 c JOIN v6 m ON c.date BETWEEN coalesce(m.in_date, (SELECT min(date) FROM v4)) AND coalesce(m.out_date, (SELECT max(date) FROM v4))"
source("j07_interval_join", lambda s, d: J.members_by_day(T.calendar(s, d), T.members(s, d)), SPELLS, "date! symbol")


def panel(s, d, n: int = 20) -> DataFrame:
    out = J.on_calendar(T.calendar(s, d), T.prices(s, d), n, n // 2)
    return out.join(J.members_by_day(T.calendar(s, d), T.members(s, d)).withColumn("_in", F.lit(True)), ["date", "symbol"], "left").withColumn("valid", F.col("valid") & F.coalesce("_in", F.lit(False))).drop("_in")


PANEL = f"""grid AS (SELECT c.date, s.symbol, p.close FROM v4 c CROSS JOIN (SELECT DISTINCT symbol FROM v3) s LEFT JOIN v3 p ON p.date = c.date AND p.symbol = s.symbol),
    counted AS (SELECT *, count(close) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS seen FROM grid), inside AS ({SPELLS}),
    pan AS (SELECT g.date, g.symbol, g.close, (g.close IS NOT NULL AND seen >= 10 AND i.symbol IS NOT NULL) AS valid FROM counted g LEFT JOIN inside i ON i.date = g.date AND i.symbol = g.symbol)"""
source("j08_calendar_reindex", lambda s, d: panel(s, d).withColumn("valid", F.col("valid").cast("long")), f"WITH {PANEL} SELECT date, symbol, close, CAST(valid AS BIGINT) AS valid FROM pan", "date! symbol valid", "close", -1)
simple("j09_semi_join", lambda b: b.join(b.where("symbol = 'click'").select("ts"), "ts", "left_semi").groupBy("symbol").agg(F.count("*").alias("n")), "SELECT symbol, count(*) AS n FROM v1 WHERE ts IN (SELECT ts FROM v1 WHERE symbol = 'click') GROUP BY symbol", "", "symbol n")
simple("j10_missing_bars", lambda b: J.missing_bars(b), "SELECT symbol, ts FROM (SELECT symbol, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM v1 GROUP BY symbol) g ANTI JOIN v1 USING (symbol, ts)", "")
source("j11_as_of", lambda s, d: (lambda p: J.last_known(p.withColumn("k", F.lit(1)), p.where(F.dayofmonth("date") <= 2).select(F.lit(1).alias("k"), "date", F.col("y").alias("beta")), ["k"], "date", ["beta"]))(T.pair(s, d)), "SELECT a.date, b.y AS beta FROM v2 a ASOF LEFT JOIN (SELECT date, y FROM v2 WHERE day(date) <= 2) b ON a.date >= b.date", "date!", "beta", -1)
simple("j13_allocation_alignment", lambda b: b.where("symbol in ('click', 'view')").groupBy("ts").pivot("symbol", ["click", "view"]).agg(F.first("close")).na.fill(0.0), "SELECT ts, coalesce(max(close) FILTER (WHERE symbol = 'click'), 0) AS click, coalesce(max(close) FILTER (WHERE symbol = 'view'), 0) AS view FROM v1 WHERE symbol IN ('click', 'view') GROUP BY ts", "click view", "ts")
simple("j14_standardise_by_train", lambda b: J.standardise_by(B.split_rows(b, ["symbol"]), ["close"], ["symbol"], "split = 'train'"), f"""WITH n AS (SELECT *, row_number() OVER ({W}) - 1 AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM v1), f AS (SELECT *, CASE WHEN rn < floor(n * 6 / 10) THEN close END AS t FROM n)
    SELECT symbol, ts, (close - avg(t) OVER p) / NULLIF(stddev_samp(t) OVER p, 0) AS close FROM f WINDOW p AS (PARTITION BY symbol)""", "close")  # fmt: skip
source("j15_position_reindexed", lambda s, d: T.pair(s, d).join(T.pair(s, d).where("y > x").select("date", F.lit(1.0).alias("position")), "date", "left").withColumn("position", F.coalesce("position", F.lit(0.0))), "SELECT date, CASE WHEN y > x THEN 1.0 ELSE 0.0 END AS position FROM v2", "date!", "position")
source("j17_dictionary_lookup", lambda s, d: (lambda t: t.join(F.broadcast(s.createDataFrame([("en", 0), ("de", 1), ("fr", 2)], "lang string, code int")), "lang", "left").select("doc_id", F.coalesce("code", F.lit(1)).cast("long").alias("code")))(T.labelled(s, d)), "SELECT doc_id, CAST(CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 WHEN 'fr' THEN 2 ELSE 1 END AS BIGINT) AS code FROM v7", "doc_id code")
simple("j18_grid_cross", lambda b: b.crossJoin(F.broadcast(b.sparkSession.createDataFrame([(0.5,), (1.0,), (2.0,)], "fee double"))).groupBy("symbol", "fee").agg((F.sum("close") * F.col("fee")).alias("x")), "SELECT symbol, fee, sum(close) * fee AS x FROM v1, (VALUES (0.5::DOUBLE), (1.0), (2.0)) g(fee) GROUP BY symbol, fee", "x", "symbol fee", 3)
simple("x01_union_all", lambda b: b.where("symbol = 'click'").select("symbol", "ts").unionByName(b.where("symbol = 'view'").select("symbol", "ts")), "SELECT symbol, ts FROM v1 WHERE symbol = 'click' UNION ALL SELECT symbol, ts FROM v1 WHERE symbol = 'view'", "")
simple("x02_union_distinct", lambda b: b.where("symbol = 'click'").select("ts").union(b.where("symbol = 'view'").select("ts")).distinct(), "SELECT ts FROM v1 WHERE symbol = 'click' UNION SELECT ts FROM v1 WHERE symbol = 'view'", "", "ts")
simple("x03_except", lambda b: b.where("symbol = 'click'").select("ts").subtract(b.where("symbol = 'error'").select("ts")), "SELECT ts FROM v1 WHERE symbol = 'click' EXCEPT SELECT ts FROM v1 WHERE symbol = 'error'", "", "ts")
simple("x04_intersect", lambda b: b.where("symbol = 'click'").select("ts").intersect(b.where("symbol = 'view'").select("ts")), "SELECT ts FROM v1 WHERE symbol = 'click' INTERSECT SELECT ts FROM v1 WHERE symbol = 'view'", "", "ts")
