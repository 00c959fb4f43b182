"""Queries of the smaller operators: aliases, sinks and reloads, selections, further grids and model protocols."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import rolling as R
from tidemark.functions import technical as X
from tidemark.operators import arena as A
from tidemark.operators import backtest as B
from tidemark.operators import boosting
from tidemark.operators import breadth as H
from tidemark.operators import econometrics as E
from tidemark.operators import folds
from tidemark.operators import models as Md
from tidemark.operators import rules
from tidemark.operators import statistics as S
from tidemark.operators import tabular as Tb
from tidemark.operators.alignment import standardise_by
from tidemark.plans.registry import QUERIES, query
from tidemark.queries.panels import source
from tidemark.queries.research import HELD, IC, NAV, breadth, factors, held, nav, pair, z20
from tidemark.queries.studies import THRESHOLDS, features, grid_trades, levels, positive, threshold_grid, z_grid
from tidemark.queries.windows import RSI_T, W, simple
from tidemark.sources import scratch
from tidemark.sources import tables as T

# --- sources and sinks -------------------------------------------------------------------------------------


def reloaded(df: DataFrame, name: str, partition_by: str | None = None, kind: str = "parquet") -> DataFrame:
    spark = df.sparkSession
    path = scratch.folder(spark, name)
    T.write_table(df, path, partition_by, kind)
    reader = spark.read.option("header", True).schema(df.schema)
    return reader.format(kind).load(path).select(*df.columns)


simple("s06_partitioned_cache", lambda b: reloaded(b, "bars", "symbol"), "SELECT * FROM v1", "open close", "symbol ts volume")
simple("s14_reload_composite", lambda b: reloaded(X.zscore(b, "close", 20, "z").select("symbol", "ts", F.col("z").alias("sentiment_z")), "composite").where("sentiment_z is not null").select("symbol", "ts", F.col("sentiment_z").alias("signal_z")),
       f"SELECT symbol, ts, (close - a) / s AS signal_z FROM (SELECT *, count(close) OVER f AS n, avg(close) OVER f AS a, stddev_samp(close) OVER f AS s FROM v1 WINDOW f AS ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) WHERE n = 20 AND s > 0", "signal_z")
query("s15_selected_factors", IC + " SELECT factor FROM ics ORDER BY abs(clipped_ic) DESC LIMIT 1", "factor")(lambda s, d: S.top_factors(S.ic_table(factors(s, d), ["f", "ret"], "t"), 1000, 2, 100).orderBy("rank").limit(1))


@query("s16_backtest_config", "SELECT 'leverage' AS name, 1.0 AS value UNION ALL SELECT 'slippage', 0.0 UNION ALL SELECT 'capital', 500000.0", "name", "value")
def s16(spark, d):
    path = scratch.folder(spark, "config")
    lines = spark.createDataFrame([("capital: 500000  # start",), ("other: 3",), ("no pair",)], "value string")
    lines.coalesce(1).write.mode("overwrite").text(path)
    found = T.read_config(spark, path, {"capital": 1e6, "leverage": 1.0, "slippage": 0.0})
    return spark.createDataFrame(list(found.items()), "name string, value double")


query("s19_csv_cache", "SELECT date, close FROM v5", "date!", "close", -1)(lambda s, d: T.first_available(lambda: s.read.schema("date date, close double").csv(f"{d}/no_such_cache.csv").limit(0).crossJoin(s.read.parquet(f"{d}/no_such_cache.parquet")), lambda: T.index_level(s, d)))
query("s20_replay_cache", NAV + " SELECT symbol, count(*) AS n FROM nv GROUP BY symbol", "symbol n")(lambda s, d: reloaded(nav(T.bars(s, d)).select("symbol", "ts", "nav"), "replay").groupBy("symbol").agg(F.count("*").alias("n")))
simple("k01_csv_sink", lambda b: reloaded(b.select("symbol", F.col("ts").cast("string").alias("ts"), "volume"), "csv", kind="csv").groupBy("symbol").agg(F.sum("volume").alias("n")), "SELECT symbol, CAST(sum(volume) AS BIGINT) AS n FROM v1 GROUP BY symbol", "", "symbol n")
simple("k02_parquet_sink", lambda b: reloaded(b, "parquet", "symbol").groupBy("symbol").agg(F.count("*").alias("n")), "SELECT symbol, count(*) AS n FROM v1 GROUP BY symbol", "", "symbol n")
simple("k03_stage_snapshot", lambda b: reloaded(X.momentum(b, 3, "m").where("m is not null").select("symbol", "ts", "m"), "stage"), f"SELECT symbol, ts, m FROM (SELECT symbol, ts, close / NULLIF(lag(close, 3) OVER ({W}), 0) - 1 AS m FROM v1) WHERE m IS NOT NULL", "m")
simple("k07_summary_text", lambda b: b.groupBy("symbol").agg(F.count("*").alias("n"), F.max("volume").alias("v")).select("symbol", F.format_string("%s: %d bars, at most %d a bar", "symbol", "n", "v").alias("line")), "SELECT symbol, symbol || ': ' || count(*) || ' bars, at most ' || max(volume) || ' a bar' AS line FROM v1 GROUP BY symbol", "", "symbol line")

# --- projections, joins, aggregates ------------------------------------------------------------------------

query("p17_valid_pairs", f"WITH {RSI_T} SELECT symbol, count(*) AS n FROM fac WHERE f IS NOT NULL AND t IS NOT NULL GROUP BY symbol", "symbol n")(lambda s, d: factors(s, d).where("f is not null and t is not null").groupBy("symbol").agg(F.count("*").alias("n")))
simple("p23_weighted_percentiles", lambda b: b.select("symbol", "ts", (0.5 * F.col("open") + 0.3 * F.col("high") + 0.2 * F.col("low")).alias("raw")), "SELECT symbol, ts, 0.5 * open + 0.3 * high + 0.2 * low AS raw FROM v1", "raw")
query("j12_label_alignment", f"WITH {RSI_T} SELECT symbol, ts, f, t FROM fac WHERE f IS NOT NULL AND t IS NOT NULL", "symbol ts", "f t")(lambda s, d: (lambda r: r.select("symbol", "ts", "f").join(r.select("symbol", "ts", "t"), ["symbol", "ts"], "full").na.drop(subset=["f", "t"]))(factors(s, d)))
simple("j16_version_comparison", lambda b: X.zscore(b, "close", 20, "a").where("a is not null").select("symbol", "ts", "a").join(X.zscore(b, "close", 40, "b").where("b is not null").select("symbol", "ts", "b"), ["symbol", "ts"]),
       f"SELECT symbol, ts, (close - a20) / s20 AS a, (close - a40) / s40 AS b FROM (SELECT *, count(close) OVER g AS n, avg(close) OVER f AS a20, stddev_samp(close) OVER f AS s20, avg(close) OVER g AS a40, stddev_samp(close) OVER g AS s40 FROM v1 WINDOW f AS ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), g AS ({W} ROWS BETWEEN 39 PRECEDING AND CURRENT ROW)) WHERE n = 40", "a b")
simple("a17_guarded_metrics", lambda b: B.nav_summary(nav(b), ["symbol"], "ts"), NAV + """, dd AS (SELECT *, nav / max(nav) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM nv)
    SELECT symbol, pow(product(1 + net), 252.0 / count(*)) - 1 AS annualized_return, avg(net) / NULLIF(stddev_pop(net), 0) * sqrt(252.0) AS sharpe, min(dd) AS max_drawdown FROM dd GROUP BY symbol""", "annualized_return sharpe max_drawdown", "symbol")  # fmt: skip
source("a39_cube", lambda s, d: T.labelled(s, d).cube("lang", "quality").agg(F.count("*").alias("n")), "SELECT lang, quality, count(*) AS n FROM v7 GROUP BY CUBE (lang, quality)", "lang quality! n")
source("a39_rollup", lambda s, d: T.labelled(s, d).rollup("lang", "quality").agg(F.count("*").alias("n")), "SELECT lang, quality, count(*) AS n FROM v7 GROUP BY ROLLUP (lang, quality)", "lang quality! n")
simple("w31_split_labels", lambda b: B.split_rows(b, ["symbol"], names=("train", "valid", "final")).groupBy("symbol", "split").agg(F.count("*").alias("n"), F.min("ts").alias("a")), f"SELECT symbol, split, count(*) AS n, min(ts) AS a FROM (SELECT *, CASE WHEN rn < floor(n * 6 / 10) THEN 'train' WHEN rn < floor(n * 8 / 10) THEN 'valid' ELSE 'final' END AS split FROM (SELECT *, row_number() OVER ({W}) - 1 AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM v1)) GROUP BY 1, 2", "", "symbol split n a")
source("t05_best_by_group", lambda s, d: T.labelled(s, d).groupBy("lang").agg(F.max_by("doc_id", F.struct("n_chars", "doc_id")).alias("doc_id")), "SELECT lang, doc_id FROM v7 QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id DESC) = 1", "lang doc_id")
source("t06_largest_ten", lambda s, d: T.labelled(s, d).orderBy(F.col("n_chars").desc(), "doc_id").limit(10), "SELECT doc_id, n_chars FROM v7 ORDER BY n_chars DESC, doc_id LIMIT 10", "doc_id n_chars")
query("t07_top_archive", THRESHOLDS + " SELECT * FROM su WHERE split = 'valid' ORDER BY round(total_return, 9) DESC, symbol, buy, sell LIMIT 10", "symbol buy sell", "total_return", 4)(lambda s, d: threshold_grid(s, d).where("split = 'valid'").orderBy(F.round("total_return", 9).desc(), "symbol", "buy", "sell").limit(10))
query("t08_union_of_tops", IC + " SELECT factor FROM (SELECT factor FROM ics ORDER BY abs(pearson_ic) DESC LIMIT 1) UNION SELECT factor FROM (SELECT factor FROM ics ORDER BY abs(spearman_ic) DESC LIMIT 1)", "factor")(
    lambda s, d: (lambda t: t.orderBy(F.abs("pearson_ic").desc()).limit(1).select("factor").union(t.orderBy(F.abs("spearman_ic").desc()).limit(1).select("factor")).distinct())(S.ic_table(factors(s, d), ["f", "ret"], "t")))
simple("x05_overlap_counts", lambda b: b.groupBy("symbol").agg(F.collect_set("volume").alias("v")).alias("x").crossJoin(b.where("symbol = 'click'").agg(F.collect_set("volume").alias("w"))).select("symbol", F.size(F.array_intersect("v", "w")).cast("long").alias("n")), "SELECT symbol, CAST(count(DISTINCT volume) AS BIGINT) AS n FROM v1 WHERE volume IN (SELECT volume FROM v1 WHERE symbol = 'click') GROUP BY symbol", "", "symbol n")
simple("f12_long_only_alias", nav, NAV + " SELECT * FROM nv", "position nav", digits=4)

COURSE = {"Login_Frequency": "n_chars % 50", "Discussion_Participation": "n_chars % 7", "Assignments_Submitted": "doc_id % 9", "Quiz_Score_Avg": "n_chars % 100", "Progress_Percentage": "doc_id % 100", "Hours_Spent_Per_Week": "n_chars % 20",
          "Course_Duration_Weeks": "doc_id % 12", "Completion_Percentage": "n_chars % 97", "Satisfaction_Score": "doc_id % 5", "nplay_video": "n_chars % 300", "nchapters": "doc_id % 20", "nforum_posts": "n_chars % 11", "ndays_act": "doc_id % 30", "nevents": "n_chars % 900"}
MADE = {"engagement_score": "0.3 * Login_Frequency / greatest((SELECT max(Login_Frequency) FROM cs), 1) + 0.3 * Discussion_Participation / greatest((SELECT max(Discussion_Participation) FROM cs), 1) + 0.4 * Assignments_Submitted / greatest((SELECT max(Assignments_Submitted) FROM cs), 1)",
        "efficiency": "Quiz_Score_Avg * Progress_Percentage / 10000", "time_invested": "Hours_Spent_Per_Week * Course_Duration_Weeks", "completion_satisfaction_alignment": "Completion_Percentage * Satisfaction_Score / 500",
        "workload_alignment": "Hours_Spent_Per_Week / greatest((SELECT avg(Hours_Spent_Per_Week) FROM cs), 1) * CASE lang WHEN 'en' THEN 2 WHEN 'de' THEN 3 ELSE 1 END",
        "engagement_intensity": "Completion_Percentage / greatest((SELECT avg(Completion_Percentage) FROM cs), 1) * (Hours_Spent_Per_Week / greatest((SELECT avg(Hours_Spent_Per_Week) FROM cs), 1))",
        "video_per_chapter": "nplay_video / (nchapters + 1)", "forum_per_day": "nforum_posts / (ndays_act + 1)", "participation_ratio": "(nplay_video + nforum_posts) / (nevents + 1)"}


@query("p21_enrich_schema_conditional", f"WITH cs AS (SELECT doc_id, lang, {', '.join(f'{v} AS {k}' for k, v in COURSE.items())} FROM v7) SELECT doc_id, " + ", ".join(f"round_even({v}, 3) AS {k}" for k, v in MADE.items()) + " FROM cs", "doc_id", " ".join(MADE), 3)
def p21(spark, d):
    rows = T.labelled(spark, d)
    rows = rows.select("doc_id", F.when(F.col("lang") == "en", "Student").when(F.col("lang") == "de", "Working Professional").otherwise(F.col("lang")).alias("Experience_Level"), *[F.expr(v).alias(k) for k, v in COURSE.items()])
    return Tb.enrich(rows, rows)


# --- grids and studies -------------------------------------------------------------------------------------


#: Weights of high-low, above-average and positive-return shares by preset, and spans of the average.
PRESETS = {"equal": (1 / 3, 1 / 3, 1 / 3), "high_low_heavy": (0.5, 0.3, 0.2), "ma_heavy": (0.2, 0.5, 0.3), "momentum_heavy": (0.2, 0.3, 0.5), "balanced_trend": (0.25, 0.5, 0.25), "balanced_momentum": (0.25, 0.25, 0.5)}
SPANS = (60, 90, 120)
#: Entry and exit levels, penalties, horizons and tree sizes of the combined signals.
COMBINED_BUYS, COMBINED_SELLS, PENALTIES, HORIZONS = (-1.2, -1.0, -0.8), (1.2, 1.5, 2.0), (0.1, 1.0, 10.0, 100.0), (20, 60)
TREES = [(depth, leaf) for depth in (2, 3, 4) for leaf in (50, 100, 200)]


def weight_grid(s, d) -> DataFrame:
    """Presets of weights x EMA spans on expanding percentile ranks; spans are groups of one scan."""
    rows = breadth(s, d).where("above_ma is not null").withColumn("k", F.lit(1))
    for x in ("new_high_low_net", "above_ma", "positive_return"):
        rows = H.expanding_rank(rows, x, f"{x}_pct", "k", "date")
    grid = s.createDataFrame([(name, *w, span) for name, w in PRESETS.items() for span in SPANS], "preset string, a double, b double, c double, span int")
    rows = rows.crossJoin(F.broadcast(grid)).withColumn("raw", F.col("a") * F.col("new_high_low_net_pct") + F.col("b") * F.col("above_ma_pct") + F.col("c") * F.col("positive_return_pct"))
    keys = ["preset", "span"]
    rows = folds.scan(rows, keys, "date", lambda c: {"slow": folds.ewm_values(c["raw"], 2 / (float(c["span"][0]) + 1))}, ["raw", "span"], {"slow": "double"})
    rows = H.expanding_z(rows, "slow", "z", keys, "date")
    return rows.join(T.index_level(s, d).withColumnRenamed("close", "index_close"), "date").withColumn("t", R.ahead("index_close", 5, R.series(keys, "date")))


query("g03_weight_grid", None, "preset span n", "z", 4)(lambda s, d: weight_grid(s, d).groupBy("preset", "span").agg(F.count("z").alias("n"), F.avg("z").alias("z")))
query("g04_config_evaluation", None, "preset span n", "ic", 4)(lambda s, d: S.rank_ic(weight_grid(s, d), "z", "t", ["preset", "span"]))
def combined(s, d) -> DataFrame:
    """The standardised score of 16 ways to combine three signals: equal, by IC at two horizons, four ridges, nine trees."""
    names = ["a", "b", "c"]
    rows = features(s, d).withColumn("index_close", 1000 * F.exp(F.sum(F.coalesce("a", F.lit(0.0)) / 200).over(R.cum(X.W))))
    rows = rows.withColumns({f"t{h}": R.ahead("close", h, X.W) / 100 for h in HORIZONS}).withColumn("equal", (F.col("a") + F.col("b") + F.col("c")) / 3)
    made = ["equal"]
    for h in HORIZONS:
        rows = Md.linear_score(rows, Md.ic_weights(rows, names, f"t{h}"), f"ic_{h}")
        made.append(f"ic_{h}")
    for penalty in PENALTIES:
        rows = Md.linear_score(rows, Md.ridge(rows, names, "t20", penalty, intercept=True), f"ridge_{penalty:g}".replace(".", "_"))
        made.append(f"ridge_{penalty:g}".replace(".", "_"))
    for depth, leaf in TREES:
        rows = Md.tree_score(rows, names, "t20", f"tree_{depth}_{leaf}", depth, leaf)
        made.append(f"tree_{depth}_{leaf}")
    rows = standardise_by(rows, made, ["symbol"], "split = 'train'")
    return rows.unpivot(["symbol", "ts", "index_close"], made, "spec", "score")


def combination_grid(s, d) -> DataFrame:
    grid = s.createDataFrame([(b, c) for b in COMBINED_BUYS for c in COMBINED_SELLS], "buy double, sell double")
    key = ["symbol", "spec", "buy", "sell"]
    rows = rules.hold(combined(s, d).crossJoin(F.broadcast(grid)), rules.baseline(F.col("buy"), F.col("sell")), ["score"], key, "ts")
    return B.nav_summary(B.nav_backtest(rows, key, "ts"), key, "ts")


query("g07_combination_grid", None, "symbol spec buy sell n_trades", "total_return", 4)(combination_grid)
query("g10_hedge_alternatives", None, "spec", "beta tau", 3)(
    lambda s, d: (lambda lv, ps: E.engle_granger(lv, ["symbol"], "ts").select(F.lit("levels").alias("spec"), "beta", "tau")
                  .unionByName(E.adf(lv.withColumn("e", F.col("y") - F.col("x")), ["symbol"], "ts", "e").select(F.lit("naive").alias("spec"), F.lit(1.0).alias("beta"), "tau"))
                  .unionByName(E.adf(ps.join(E.johansen(ps, ["symbol"], "ts").select("symbol", F.col("beta").alias("j")), "symbol").withColumn("e", F.log("y") - F.col("j") * F.log("x")), ["symbol"], "ts", "e").select(F.lit("johansen").alias("spec"), F.lit(None).cast("double").alias("beta"), "tau")))(levels(s, d), positive(s, d)))
query("g11_report_tables", HELD + " SELECT year(ts) AS y, count(*) AS n, -quantile_cont(pnl, 0.05) AS var95, stddev_samp(pnl) * sqrt(252.0) AS vol FROM bk GROUP BY 1", "y n", "var95 vol", 5)(
    lambda s, d: B.pair_backtest(held(s, d), ["symbol"], "ts", 0.5).groupBy(F.year("ts").cast("long").alias("y")).agg(F.count("*").alias("n"), E.value_at_risk("pnl").alias("var95"), (F.stddev_samp("pnl") * F.sqrt(F.lit(252.0))).alias("vol")))
query("g14_sensitivity_export", None, "study level", "value", 4)(lambda s, d: QUERIES["g09_cost_sensitivity"](s, d).select(F.lit("cost").alias("study"), F.col("cost").alias("level"), F.col("total").alias("value")).unionByName(grid_trades(s, d).select(F.lit("entry").alias("study"), F.col("entry").alias("level"), F.col("per_year").alias("value"))))
query("g15_pair_screen", None, "symbol by entry", "value", 4)(
    lambda s, d: (lambda g: g.where("split = 'train'").groupBy("symbol", "entry").agg(F.try_divide(F.avg("pnl"), F.stddev_samp("pnl")).alias("sharpe")).withColumn("r", F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("sharpe").desc(), "entry"))).where("r = 1").select("symbol", F.lit("sharpe").alias("by"), "entry", F.col("sharpe").alias("value")).unionByName(
        grid_trades(s, d).withColumn("r", F.row_number().over(Window.partitionBy("symbol").orderBy(F.abs(F.col("per_year") - 4), "entry"))).where("r = 1").select("symbol", F.lit("trades").alias("by"), "entry", F.col("per_year").alias("value"))))(B.pair_backtest(z_grid(s, d, ["symbol", "split"]), ["symbol", "split", "entry"], "ts", 0.5)))
query("m25_fit_guards", f"WITH {RSI_T} SELECT symbol, count(*) AS n, CAST(count(*) >= 4 AS BIGINT) AS ridge_ok, CAST(count(*) >= 200 AS BIGINT) AS tree_ok FROM fac WHERE t IS NOT NULL AND f IS NOT NULL GROUP BY symbol", "symbol n ridge_ok tree_ok")(lambda s, d: factors(s, d).where("t is not null and f is not null").groupBy("symbol").agg(F.count("*").alias("n"), (F.count("*") >= 4).cast("long").alias("ridge_ok"), (F.count("*") >= 200).cast("long").alias("tree_ok")))

# --- model protocols ---------------------------------------------------------------------------------------


def tabular(s, d) -> DataFrame:
    return Tb.stratified_split(T.labelled(s, d).withColumn("len", F.log1p("n_chars")).withColumn("lang_code", F.ascii("lang").cast("double")), "quality", "doc_id")


#: The grid of the boosting search (3 x 3 x 2 x 3 x 2 = 108), and the parameters of the stability study.
ROUNDS, RATES, DEPTHS, LEAVES, SAMPLES = [60, 100, 150], [0.02, 0.05, 0.08], [2, 3], [10, 20, 30], [0.7, 0.85]
STABLE = {"rounds": 120, "rate": 0.05, "depth": 3, "leaf": 20, "subsample": 0.8}
CURVE = [round(0.2 + 0.1 * i, 1) for i in range(9)]
NAMES = ["len", "lang_code", "toxic"]


def by_time(s, d) -> boosting.Cube:
    return boosting.time_cube(tabular(s, d), NAMES, "quality", "doc_id")


def searched(s, d) -> DataFrame:
    """Mean AUC over five expanding folds of 108 boosting configurations."""
    found = boosting.grid_search(s, by_time(s, d), ROUNDS, RATES, DEPTHS, LEAVES, SAMPLES)
    return found.groupBy("rounds", "rate", "depth", "leaf", "subsample").agg(F.avg(F.when(~F.isnan("auc"), F.col("auc"))).alias("auc"), F.count("*").alias("folds"))


def best_found(s, d) -> dict:
    r = searched(s, d).orderBy(F.round("auc", 9).desc_nulls_last(), "rounds", "rate", "depth", "leaf", "subsample").first()
    return {k: r[k] for k in ("rounds", "rate", "depth", "leaf", "subsample")}


def stable(s, d) -> DataFrame:
    found = boosting.stability(by_time(s, d), best_found(s, d))
    return s.createDataFrame([(m, *[float(v[k]) for k in ("train_mean", "train_std", "test_mean", "test_std", "gap")], boosting.gap_label(found["auc"]["gap"])) for m, v in found.items()], "measure string, train_mean double, train_std double, test_mean double, test_std double, gap double, label string")


def hashed_folds(s, d, n: int = 3) -> DataFrame:
    w = Window.partitionBy("quality").orderBy(F.md5(F.col("doc_id").cast("string")))
    return tabular(s, d).withColumn("fold", (F.row_number().over(w) % n + 1).cast("int"))


query("m10_stratified_folds", "SELECT fold, quality, count(*) AS n FROM (SELECT quality, row_number() OVER (PARTITION BY quality ORDER BY md5(CAST(doc_id AS VARCHAR))) % 3 + 1 AS fold FROM v7) GROUP BY 1, 2", "fold quality n")(lambda s, d: hashed_folds(s, d).groupBy(F.col("fold").cast("long").alias("fold"), "quality").agg(F.count("*").alias("n")))
query("m12_random_forest", None, "doc_id split", "forest", 4)(lambda s, d: boosting.ensembles(tabular(s, d), NAMES, "quality"))
query("m13_boosting", None, "doc_id split", "boosting", 4)(lambda s, d: boosting.ensembles(tabular(s, d), NAMES, "quality"))
query("m14_soft_vote", None, "doc_id split", "vote", 4)(lambda s, d: QUERIES["m11_classifiers"].run(s, d))
query("m20_importance_stability", None, "feature kept", "mean deviation least greatest", 3)(lambda s, d: s.createDataFrame(boosting.importance_stability(by_time(s, d), STABLE), "feature string, mean double, deviation double, least double, greatest double, kept boolean"))
query("m22_grid_search", None, "rounds depth leaf folds", "rate subsample auc", 4)(searched)
query("m24_stability", None, "measure label", "train_mean train_std test_mean test_std gap", 3)(stable)
query("m24_learning_curve", None, "", "share rows train_auc train_std test_auc test_std", 3)(lambda s, d: s.createDataFrame(boosting.learning_curve(by_time(s, d), best_found(s, d), CURVE), "share double, rows double, train_auc double, train_std double, test_auc double, test_std double"))

# --- battles -----------------------------------------------------------------------------------------------

query("b05_cooldown", "SELECT k, greatest(3 - k, 0) AS cooldown FROM range(5) t(k)", "k cooldown")(lambda s, d: s.range(5).select(F.col("id").alias("k"), F.greatest(3 - F.col("id"), F.lit(0)).alias("cooldown")))
query("b06_skills", "SELECT name, greatest(hp - greatest(50 - defence, 0), 0) AS hp, 50 + 10 * CAST(hp <= greatest(50 - defence, 0) AS INT) AS attack FROM (VALUES ('Goblin', 55, 15), ('Wolf', 40, 5)) t(name, hp, defence)", "name hp attack")(
    lambda s, d: A.units(s).where("name in ('Goblin', 'Wolf')").withColumn("left", A.after_hit(F.col("hp"), A.damage(F.lit(50), F.col("defence")))).select("name", F.col("left").alias("hp"), (50 + 10 * (F.col("left") == 0).cast("int")).alias("attack")))
query("b10_use_item", "SELECT 'bomb,potion' AS items, 'bomb' AS kept", "items kept")(lambda s, d: s.range(1).select(F.array_join(A.use_item(F.array(F.lit("potion"), F.lit("bomb"), F.lit("potion")), "potion"), ",").alias("items"), F.array_join(A.use_item(A.use_item(F.array(F.lit("potion"), F.lit("bomb"), F.lit("potion")), "potion"), "potion"), ",").alias("kept")))
