"""Queries of econometrics, allocations, simulation, grids, models and battles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import rolling as R
from tidemark.functions import technical as X
from tidemark.operators import arena as A
from tidemark.operators import backtest as B
from tidemark.operators import econometrics as E
from tidemark.operators import folds
from tidemark.operators import models as Md
from tidemark.operators import montecarlo as M
from tidemark.operators import allocation as P
from tidemark.operators import rules
from tidemark.operators import tabular as Tb
from tidemark.operators.alignment import last_known, standardise_by
from tidemark.plans.registry import query
from tidemark.queries.backtests import CUM, LAGGED, METRIC_COLUMNS, QPOS, SIGNAL, ma_sql, signal_bt, signal_frame, turn
from tidemark.queries.panels import source
from tidemark.queries.research import BASE, CONTINUOUS, DAMP, HELD, PAIR, Z20, exits, held, nav, pair, z20
from tidemark.queries.windows import CHANGE, W, past_q, roll, simple
from tidemark.sources import tables as T

# --- econometrics ------------------------------------------------------------------------------------------

LEVELS = f"WITH {PAIR} wk AS (SELECT symbol, ts, sum(x - (SELECT avg(x) FROM pj)) OVER (ORDER BY ts) / 1e6 AS x, y / 1e5 AS n FROM pj), lv AS (SELECT symbol, ts, x, 0.5 + 1.2 * x + n AS y FROM wk)"


def levels(s, d) -> DataFrame:
    """A random walk x, summed from one leg of the pair, and a y tied to it up to noise from the other leg."""
    p = pair(s, d)
    p = p.withColumn("c", F.col("x") - F.avg("x").over(Window.partitionBy("symbol")))
    p = p.withColumn("w", F.sum("c").over(R.cum(X.W)) / 1e6)
    return p.select("symbol", "ts", F.col("w").alias("x"), (0.5 + 1.2 * F.col("w") + F.col("y") / 1e5).alias("y"))


query("e01_ols", LEVELS + " SELECT symbol, count(*) AS nobs, regr_intercept(y, x) AS const_b, regr_slope(y, x) AS x_b, regr_r2(y, x) AS r2, sqrt((regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) / (count(*) - 2) / regr_sxx(y, x)) AS x_se FROM lv GROUP BY symbol", "symbol nobs", "const_b x_b r2 x_se", 5)(lambda s, d: E.ols(levels(s, d), ["symbol"], "y", ["x"]))
query("e02_intercept", LEVELS + " SELECT ts, 1.0 AS const, x FROM lv", "ts!", "const x")(lambda s, d: levels(s, d).withColumn("const", F.lit(1.0)))
RES = LEVELS + ", fi AS (SELECT regr_intercept(y, x) AS a, regr_slope(y, x) AS b FROM lv), re AS (SELECT symbol, ts, y, x, y - a - b * x AS e FROM lv, fi)"
ADF = """, d1 AS (SELECT *, e - lag(e) OVER w AS d, lag(e) OVER w AS l FROM re WINDOW w AS (ORDER BY ts)), d2 AS (SELECT *, lag(d) OVER (ORDER BY ts) AS p FROM d1), ok AS (SELECT * FROM d2 WHERE p IS NOT NULL),
    mo AS (SELECT count(*) AS n, covar_pop(l, l) * count(*) AS ll, covar_pop(p, p) * count(*) AS pp, covar_pop(l, p) * count(*) AS lp, covar_pop(d, l) * count(*) AS dl, covar_pop(d, p) * count(*) AS dp, covar_pop(d, d) * count(*) AS dd FROM ok),
    be AS (SELECT *, ll * pp - lp * lp AS det, (pp * dl - lp * dp) / (ll * pp - lp * lp) AS phi, (ll * dp - lp * dl) / (ll * pp - lp * lp) AS gam FROM mo),
    ad AS (SELECT n AS nobs, phi, phi / sqrt((dd - phi * dl - gam * dp) / (n - 3) * pp / det) AS tau FROM be)"""
query("e03_adf", RES + ADF + " SELECT * FROM ad", "nobs", "phi tau", 4)(lambda s, d: E.adf(E.residuals(levels(s, d), ["symbol"]), ["symbol"], "ts", "residual"))
query("e04_adf_decision", RES + ADF + " SELECT CAST(tau < -3.34 AS BIGINT) AS rejected FROM ad", "rejected")(lambda s, d: E.adf(E.residuals(levels(s, d), ["symbol"]), ["symbol"], "ts", "residual").select(E.decide(F.col("tau")).cast("long").alias("rejected")))
query("e05_engle_granger", RES + ADF + """, ec AS (SELECT y - lag(y) OVER w AS dy, x - lag(x) OVER w AS dx, lag(e) OVER w AS el FROM re WINDOW w AS (ORDER BY ts)), em AS (SELECT covar_pop(el, el) AS ll, covar_pop(dx, dx) AS pp, covar_pop(el, dx) AS lp, covar_pop(dy, el) AS dl, covar_pop(dy, dx) AS dp FROM ec WHERE el IS NOT NULL)
    SELECT a AS alpha, b AS beta, tau, phi, (pp * dl - lp * dp) / (ll * pp - lp * lp) AS ecm_lambda, (ll * dp - lp * dl) / (ll * pp - lp * lp) AS ecm_gamma FROM fi, ad, em""", "", "alpha beta tau phi ecm_lambda ecm_gamma", 4)(lambda s, d: E.engle_granger(levels(s, d), ["symbol"], "ts"))  # fmt: skip
query("e06_engle_granger_by_period", None, "symbol period cointegrated", "alpha beta tau", 4)(lambda s, d: E.engle_granger(levels(s, d).withColumn("period", F.year("ts") - 1995), ["symbol", "period"], "ts"))
query("e07_kpss", None, "symbol lags", "stat p_value", 4)(lambda s, d: E.kpss(levels(s, d), ["symbol"], "ts", "x"))
query("e08_integration_order", None, "series looks_i1", "stat tau", 4)(lambda s, d: (lambda t: E.kpss(t, ["series"], "ts", "v").join(E.adf(t, ["series"], "ts", "v"), "series").withColumn("looks_i1", (~E.decide(F.col("tau"), table="adf")) & (F.col("p_value") < 0.05)))(levels(s, d).withColumns({"dy": F.col("y") - F.lag("y").over(X.W)}).unpivot(["ts"], ["y", "x", "dy"], "series", "v").where("v is not null")))
query("e09_fit_ou", RES + """, pr AS (SELECT e, lag(e) OVER (ORDER BY ts) AS l FROM re), ar AS (SELECT regr_slope(e, l) AS b, regr_intercept(e, l) AS a, sqrt((regr_syy(e, l) - regr_slope(e, l) * regr_sxy(e, l)) / (count(l) - 2)) AS s, avg(e) AS m, stddev_samp(e) AS sd FROM pr)
    SELECT a, b, s AS sigma_eps, CASE WHEN b > 0 AND b < 1 THEN -ln(b) END AS theta, CASE WHEN b > 0 AND b < 1 THEN a / (1 - b) ELSE m END AS mu, CASE WHEN b > 0 AND b < 1 THEN s / sqrt(1 - b * b) ELSE sd END AS sigma_eq FROM ar""", "", "a b sigma_eps theta mu sigma_eq", 4)(lambda s, d: E.ou_fit(E.residuals(levels(s, d), ["symbol"]), ["symbol"], "ts"))  # fmt: skip


def positive(s, d) -> DataFrame:
    return levels(s, d).select("symbol", "ts", F.exp(F.col("y") / 50).alias("y"), F.exp(F.col("x") / 50).alias("x"))


query("e10_johansen", None, "symbol rank", "trace0 trace1 max0 max1 beta", 3)(lambda s, d: E.johansen(positive(s, d), ["symbol"], "ts"))
query("e11_rank_and_beta", None, "symbol cointegrated", "beta", 3)(lambda s, d: E.johansen(positive(s, d), ["symbol"], "ts").withColumn("cointegrated", F.col("rank") >= 1))
query("e12_var_lags", None, "symbol aic_lag bic_lag")(lambda s, d: E.johansen(positive(s, d), ["symbol"], "ts"))
query("e13_var_stability", None, "symbol stable", "max_root", 3)(lambda s, d: E.johansen(positive(s, d), ["symbol"], "ts").withColumn("stable", F.col("max_root") < 1))


def z_grid(s, d, by: list[str]) -> DataFrame:
    """Positions of a pair for every entry level."""
    z = X.zscore(pair(s, d).withColumn("e", F.col("y") - F.col("x")), "e", 20, "z")
    z = B.split_rows(z, ["symbol"], "ts", 7, 0, ("train", "-", "test"))
    grid = z.sparkSession.createDataFrame([(float(i) / 4,) for i in range(2, 10)], "entry double")
    return folds.positions(z.crossJoin(F.broadcast(grid)), "z", "entry", 0.0, [*by, "entry"], "ts")


def grid_trades(s, d) -> DataFrame:
    rows = z_grid(s, d, ["symbol"])
    years = rows.groupBy("symbol", "entry").agg((F.count("z") / 252).alias("years"))
    return B.round_trips(rows, ["symbol", "entry"], "ts").join(years, ["symbol", "entry"]).withColumn("per_year", F.try_divide("n_trades", "years"))


ISLANDS = """, nw AS (SELECT *, CASE WHEN position = lag(position) OVER ({w}) THEN 0 ELSE 1 END AS fresh FROM {t}), ru AS (SELECT *, sum(fresh) OVER ({w} ROWS UNBOUNDED PRECEDING) AS run FROM nw),
    il AS (SELECT {k}, run, min(position) AS position, count(*) AS bars FROM ru GROUP BY ALL),
    tr AS (SELECT {k}, count(*) FILTER (WHERE position <> 0) AS n_trades, coalesce(avg(bars) FILTER (WHERE position <> 0), 0) AS avg_holding, coalesce(sum(bars) FILTER (WHERE position <> 0), 0) / sum(bars) AS time_in_market FROM il GROUP BY {k})"""
GRID_HELD = f"""WITH RECURSIVE {PAIR} pe AS (SELECT *, y - x AS e FROM pj), pz AS (SELECT *, CASE WHEN count(e) OVER f = 20 THEN (e - avg(e) OVER f) / NULLIF(stddev_samp(e) OVER f, 0) END AS z, row_number() OVER ({W}) AS rn FROM pe WINDOW f AS ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
    pg AS (SELECT pz.*, g.i / 4.0::DOUBLE AS entry FROM pz, range(2, 10) g(i)),
    st AS (SELECT symbol, entry, ts, rn, z, 0.0::DOUBLE AS position FROM pg WHERE rn = 1 UNION ALL SELECT n.symbol, n.entry, n.ts, n.rn, n.z, CASE WHEN n.z IS NULL THEN p.position WHEN p.position = 0 THEN CASE WHEN n.z >= n.entry THEN -1.0 WHEN n.z <= -n.entry THEN 1.0 ELSE 0.0 END
      WHEN p.position > 0 AND n.z >= 0 THEN 0.0 WHEN p.position < 0 AND n.z <= 0 THEN 0.0 ELSE p.position END FROM st p JOIN pg n ON n.entry = p.entry AND n.rn = p.rn + 1){ISLANDS.format(w="PARTITION BY entry ORDER BY ts", t="st", k="entry")},
    gt AS (SELECT 'p' AS symbol, tr.*, n_trades / NULLIF((SELECT count(z) / 252 FROM pz), 0) AS per_year FROM tr)"""
query("e14_scan_z_grid", GRID_HELD + " SELECT *, CAST(row_number() OVER (ORDER BY abs(per_year - 4), entry) = 1 AS BIGINT) AS chosen FROM gt", "symbol entry n_trades chosen", "per_year avg_holding time_in_market", 4)(lambda s, d: grid_trades(s, d).withColumn("chosen", (F.row_number().over(Window.partitionBy("symbol").orderBy(F.abs(F.col("per_year") - 4), "entry")) == 1).cast("long")))
query("t10_closest_to_target", GRID_HELD + " SELECT * FROM gt ORDER BY abs(per_year - 4), entry LIMIT 1", "symbol entry")(lambda s, d: grid_trades(s, d).orderBy(F.abs(F.col("per_year") - 4), "entry").limit(1))
query("e15_evaluate_z", HELD + ISLANDS.format(w="PARTITION BY symbol ORDER BY ts", t="bk", k="symbol") + " SELECT * FROM tr", "symbol n_trades", "avg_holding time_in_market", 4)(lambda s, d: B.round_trips(held(s, d), ["symbol"], "ts"))


def train_test(s, d) -> DataFrame:
    """Fit on the first 70 %, trade both segments with the frozen fit."""
    rows = B.split_rows(levels(s, d), ["symbol"], "ts", 7, 0, ("train", "-", "test"))
    train = E.residuals(rows.where("split = 'train'"), ["symbol"])
    fit = train.groupBy("symbol").agg(F.first("alpha").alias("a0"), F.first("beta").alias("b0")).join(E.ou_fit(train, ["symbol"], "ts").select("symbol", "mu", "sigma_eq"), "symbol")
    rows = rows.join(F.broadcast(fit), "symbol").withColumn("z", (F.col("y") - F.col("a0") - F.col("b0") * F.col("x") - F.col("mu")) / F.col("sigma_eq"))
    rows = folds.positions(rows, "z", 1.0, 0.0, ["symbol", "split"], "ts")
    return B.pair_backtest(rows, ["symbol", "split"], "ts", "b0")


query("e16_train_test_backtest", None, "symbol split n", "total_return", 4)(lambda s, d: train_test(s, d).groupBy("symbol", "split").agg(F.count("*").alias("n"), F.sum("pnl").alias("total_return")))
query("w32_train_split_date", f"WITH {PAIR} n AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS rn, count(*) OVER () AS n FROM pj) SELECT min(ts) AS cut FROM n WHERE rn >= floor(n * 7 / 10)", "cut!")(lambda s, d: B.split_rows(levels(s, d), ["symbol"], "ts", 7, 0, ("train", "-", "test")).where("split = 'test'").agg(F.min("ts").alias("cut")))
BETA = f"WITH {PAIR} r AS (SELECT ts, row_number() OVER ({W}) AS rn, regr_intercept(y, x) OVER f AS alpha, regr_slope(y, x) OVER f AS beta FROM pj WINDOW f AS ({W} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)), st AS (SELECT ts, alpha, beta FROM r WHERE rn >= 60 AND (rn - 60) % 12 = 0)"
query("w44_rolling_regression", BETA + " SELECT * FROM st", "ts!", "alpha beta", 3)(lambda s, d: E.rolling_beta(pair(s, d), ["symbol"], "ts", 60, 12))
query("e17_rolling_beta_experiment", None, "symbol n", "fixed rolling", 4)(
    lambda s, d: (lambda h: B.pair_backtest(B.pair_backtest(last_known(h, E.rolling_beta(pair(s, d), ["symbol"], "ts", 60, 12), ["symbol"], "ts", ["beta"]).withColumn("beta", F.coalesce("beta", F.lit(0.5))), ["symbol"], "ts", "beta").withColumnRenamed("pnl", "moving").drop("equity", "turnover"), ["symbol"], "ts", 0.5)
                  .groupBy("symbol").agg(F.count("*").alias("n"), F.sum("pnl").alias("fixed"), F.sum("moving").alias("rolling")))(held(s, d)))
query("e18_ridge_moments", f"{SIGNAL} SELECT symbol, sum(signal * t) / (sum(signal * signal) + 20) AS beta FROM sp WHERE split = 'train' AND t IS NOT NULL GROUP BY symbol", "symbol", "beta")(lambda s, d: signal_frame(s, d).where("split = 'train' and t is not null").groupBy("symbol").agg((F.sum(F.col("signal") * F.col("t")) / (F.sum(F.col("signal") * F.col("signal")) + 20)).alias("beta")))

# --- allocation ---------------------------------------------------------------------------------------------

BTS = f"{SIGNAL}, {QPOS}, {LAGGED}"
query("o01_allocation_weights", BTS + ", m AS (SELECT symbol, avg(pnl) AS mu, stddev_samp(pnl) AS vol FROM bt WHERE split = 'train' GROUP BY symbol), k AS (SELECT symbol, greatest(coalesce(mu / NULLIF(vol, 0), 0), 0) AS s, coalesce(1 / NULLIF(vol, 0), 0) AS v FROM m)".replace(", m AS (SELECT symbol, avg", ", mw AS (SELECT symbol, avg").replace("FROM m)", "FROM mw)") + " SELECT symbol, 1.0 / count(*) OVER () AS equal, coalesce(s / NULLIF(sum(s) OVER (), 0), 1.0 / count(*) OVER ()) AS sharpe, v / sum(v) OVER () AS risk_target FROM k", "symbol", "equal sharpe risk_target", 5)(lambda s, d: P.moment_weights(signal_bt(s, d).where("split = 'train'")))
query("o01_mean_variance", None, "symbol", "weight", 4)(lambda s, d: s.createDataFrame(list(P.optimal(signal_bt(s, d).where("split = 'train'")).items()), "symbol string, weight double"))
query("o02_allocation_returns", BTS + " SELECT ts, sum(coalesce(pnl, 0) * 0.2) AS pnl FROM bt GROUP BY ts", "ts", "pnl")(lambda s, d: P.allocation_returns(signal_bt(s, d), P.moment_weights(signal_bt(s, d)), "equal"))


RISK = BTS + """, mw AS (SELECT symbol, avg(pnl) AS mu, stddev_samp(pnl) AS vol FROM bt WHERE split = 'train' GROUP BY symbol), kw AS (SELECT symbol, greatest(coalesce(mu / NULLIF(vol, 0), 0), 0) AS s, coalesce(1 / NULLIF(vol, 0), 0) AS v FROM mw),
    wt AS (SELECT symbol, 'equal' AS method, 1.0 / count(*) OVER () AS w FROM kw UNION ALL SELECT symbol, 'sharpe', coalesce(s / NULLIF(sum(s) OVER (), 0), 1.0 / count(*) OVER ()) FROM kw UNION ALL SELECT symbol, 'risk_target', v / sum(v) OVER () FROM kw),
    pf AS (SELECT method, ts, sum(coalesce(pnl, 0) * w) AS pnl FROM bt JOIN wt USING (symbol) GROUP BY method, ts), pe AS (SELECT *, 1 + sum(pnl) OVER (PARTITION BY method ORDER BY ts ROWS UNBOUNDED PRECEDING) AS eq FROM pf),
    pd AS (SELECT *, eq - max(eq) OVER (PARTITION BY method ORDER BY ts ROWS UNBOUNDED PRECEDING) AS dd FROM pe)
    SELECT method, avg(pnl) * 8760 AS ann_return, stddev_samp(pnl) * sqrt(8760.0) AS ann_vol, avg(pnl) * 8760 / NULLIF(stddev_samp(pnl) * sqrt(8760.0), 0) AS sharpe, min(dd) AS max_drawdown FROM pd GROUP BY method"""


@query("o03_risk_layer", RISK, "method", "ann_return ann_vol sharpe max_drawdown", 4)
def o03(spark, d):
    returns = signal_bt(spark, d)
    w = P.moment_weights(returns.where("split = 'train'"))
    out = None
    for method in ("equal", "sharpe", "risk_target"):
        part = P.allocation_returns(returns, w, method).withColumns({"method": F.lit(method), "position": F.lit(1.0), "signal": F.lit(1.0), "ret": F.col("pnl")})
        out = part if out is None else out.unionByName(part)
    return B.signal_metrics(out, ["method"])


# --- simulation --------------------------------------------------------------------------------------------

N, STEPS = 400, 12
Z_SQL = """za AS (SELECT range AS id FROM range({n})), zb AS (SELECT id, ((2*id+1)*48271 + 11) % 2147483647 AS p, ((2*id+2)*48271 + 11) % 2147483647 AS q FROM za),
    zc AS (SELECT id, (p*p + 12345) % 2147483647 AS p, (q*q + 12345) % 2147483647 AS q FROM zb), zd AS (SELECT id, (p*69621 + 7) % 2147483647 AS p, (q*69621 + 7) % 2147483647 AS q FROM zc),
    ze AS (SELECT id, (p*p + 777) % 2147483647 AS p, (q*q + 777) % 2147483647 AS q FROM zd), zn AS (SELECT id, sqrt(-2*ln((p + 0.5e0)/2147483648e0)) * cos(2*pi()*((q + 0.5e0)/2147483648e0)) AS z FROM ze)"""
PATHS = f"WITH {Z_SQL.format(n=N * STEPS)}, st AS (SELECT id // {STEPS} AS path, z, sqrt(1.0 / {STEPS}) * z AS dw, 1.0 / {STEPS} AS dt FROM zn)"
EULER = "(1 + 0.05 * dt + 0.2 * dw)"
MILSTEIN = "(1 + 0.05 * dt + 0.2 * dw + 0.02 * (dw * dw - dt))"
query("o04_euler_maruyama", PATHS + f" SELECT CAST(path AS BIGINT) AS path, 100 * product({EULER}) AS price FROM st GROUP BY path", "path", "price")(lambda s, d: M.terminal(s, N, STEPS, "euler"))
query("o05_milstein", PATHS + f" SELECT CAST(path AS BIGINT) AS path, 100 * product({MILSTEIN}) AS price FROM st GROUP BY path", "path", "price")(lambda s, d: M.terminal(s, N, STEPS, "milstein"))
EXACT = f"WITH {Z_SQL.format(n=N)}, ex AS (SELECT id AS path, 100 * exp(0.03 + 0.2 * z) AS price FROM zn)"
query("o06_exact_gbm", EXACT + " SELECT * FROM ex", "path", "price")(lambda s, d: M.terminal(s, N, STEPS, "exact"))
query("o07_payoffs", EXACT + " SELECT path, greatest(price - 100, 0) AS european, CASE WHEN price > 100 THEN 1.0 ELSE 0.0 END AS binary_call FROM ex", "path", "european binary_call")(lambda s, d: M.terminal(s, N, 1, "exact").select("path", M.call_payoff(F.col("price"), 100.0).alias("european"), M.binary_payoff(F.col("price"), 100.0).alias("binary_call")))
MC = "exp(-0.05) * avg(v) AS price, exp(-0.05) * stddev_pop(v) / sqrt(count(*)) AS se, 1.96 * exp(-0.05) * stddev_pop(v) / sqrt(count(*)) AS half_width"
query("o08_monte_carlo_price", EXACT + f", po AS (SELECT greatest(price - 100, 0) AS v FROM ex) SELECT {MC} FROM po", "", "price se half_width")(lambda s, d: M.terminal(s, N, 1, "exact").agg(*M.discounted(M.call_payoff(F.col("price"), 100.0), 0.05, 1.0)))
query("o09_antithetic", PATHS + f" SELECT CAST(path AS BIGINT) AS path, 100 * product({EULER}) AS price, 100 * product(1 + 0.05 * dt - 0.2 * dw) AS mirror FROM st GROUP BY path", "path", "price mirror")(lambda s, d: M.antithetic(s, N, STEPS))
PHI = "CASE WHEN {x} >= 0 THEN 1 - {t} ELSE {t} END"
TAIL = "exp(-{x} * {x} / 2) / 2.5066282746310002 * ({k} * (0.319381530 + {k} * (-0.356563782 + {k} * (1.781477937 + {k} * (-1.821255978 + {k} * 1.330274429)))))"


def phi(x: str) -> str:
    k = f"(1 / (1 + 0.2316419 * abs({x})))"
    return PHI.format(x=x, t=TAIL.format(x=x, k=k))


BLACK_SCHOLES = f"""WITH g AS (SELECT s0, (ln(s0 / 100) + 0.07) / 0.2 AS d1, (ln(s0 / 100) + 0.07) / 0.2 - 0.2 AS d2 FROM (VALUES (90.0::DOUBLE), (100.0), (110.0)) t(s0))
    SELECT s0, s0 * ({phi('d1')}) - 100 * exp(-0.05) * ({phi('d2')}) AS european, exp(-0.05) * ({phi('d2')}) AS binary_call FROM g"""
query("o10_black_scholes", BLACK_SCHOLES, "s0", "european binary_call", 3)(
    lambda s, d: s.createDataFrame([(90.0,), (100.0,), (110.0,)], "s0 double").select("s0", *[c.alias(n) for c, n in zip(M.black_scholes(F.col("s0"), *[F.lit(v) for v in (100.0, 0.05, 0.2, 1.0)]), ("european", "binary_call"), strict=True)]))
#: Sizes of the published sweeps; path counts from a thousand up are the same shares of the paths here.
PATH_COUNTS = [round(10 ** (k * 3 / 7)) for k in range(8)]
STEP_COUNTS = [10, 20, 50, 100, 250, 500, 1000]
SPOTS, SIGMAS, TIMES = ([a + (b - a) * i / (n - 1) for i in range(n)] for a, b, n in ((80.0, 120.0, 15), (0.05, 0.5, 15), (0.1, 5.0, 12)))
SCHEMES = ("euler", "milstein", "exact")


def convergence(s, d, paths: int = 1000, n: int = STEPS) -> DataFrame:
    """Price by scheme over the first 1 / 1000 .. all of the paths; paths are simulated once for all counts."""
    rows = reduce(DataFrame.unionByName, [M.terminal(s, paths, n, k).select("path", "price", F.lit(k).alias("scheme")) for k in SCHEMES])
    counts = s.createDataFrame([(paths * c // 1000,) for c in PATH_COUNTS], "n int")
    return rows.crossJoin(F.broadcast(counts)).where("path < n").groupBy("scheme", "n").agg((F.exp(F.lit(-0.05)) * F.avg(M.call_payoff(F.col("price"), 100.0))).alias("price"))


def price_sql(n: int, growth: str) -> str:
    return f"SELECT path, 100 * product({growth}) AS price FROM (SELECT id // {n} AS path, z, sqrt(1.0 / {n}) * z AS dw, 1.0 / {n} AS dt FROM zn WHERE id < {n} * {{paths}}) GROUP BY path"


_CONVERGED = " UNION ALL ".join(f"SELECT '{k}' AS scheme, path, price FROM ({q})" for k, q in (("euler", price_sql(STEPS, EULER).format(paths=1000)), ("milstein", price_sql(STEPS, MILSTEIN).format(paths=1000)), ("exact", "SELECT id AS path, 100 * exp(0.03 + 0.2 * z) AS price FROM zn WHERE id < 1000")))
query("o11_convergence", f"WITH {Z_SQL.format(n=1000 * STEPS)}, pr AS ({_CONVERGED}) SELECT scheme, n, exp(-0.05) * avg(greatest(price - 100, 0)) AS price FROM pr, (VALUES {', '.join(f'({c})' for c in PATH_COUNTS)}) g(n) WHERE path < n GROUP BY scheme, n", "scheme n", "price")(convergence)
query("o11_time_steps", f"WITH {Z_SQL.format(n=40 * 1000)}, pr AS (" + " UNION ALL ".join(f"SELECT '{k}' AS scheme, {n} AS n, price FROM ({price_sql(n, g).format(paths=40)})" for n in STEP_COUNTS for k, g in (("euler", EULER), ("milstein", MILSTEIN))) + ") SELECT scheme, n, exp(-0.05) * avg(greatest(price - 100, 0)) AS price FROM pr GROUP BY scheme, n", "scheme n", "price")(
    lambda s, d: reduce(DataFrame.unionByName, [M.terminal(s, 40, n, k).select(F.lit(k).alias("scheme"), F.lit(n).alias("n"), "price") for n in STEP_COUNTS for k in SCHEMES[:2]]).groupBy("scheme", "n").agg((F.exp(F.lit(-0.05)) * F.avg(M.call_payoff(F.col("price"), 100.0))).alias("price")))
SWEEPS = [("s0", v, v, 0.2, 1.0) for v in SPOTS] + [("sigma", v, 100.0, v, 1.0) for v in SIGMAS] + [("t", v, 100.0, 0.2, v) for v in TIMES]
query("o12_sensitivity", f"WITH {Z_SQL.format(n=N)} SELECT what, value, exp(-0.05 * t) * avg(greatest(s0 * exp((0.05 - sigma * sigma / 2) * t + sigma * sqrt(t) * z) - 100, 0)) AS price FROM zn, (VALUES {', '.join(f'({w!r}, {v!r}::DOUBLE, {a!r}::DOUBLE, {b!r}::DOUBLE, {c!r}::DOUBLE)' for w, v, a, b, c in SWEEPS)}) g(what, value, s0, sigma, t) GROUP BY what, value, t", "what", "value price")(
    lambda s, d: T.normals(s, N).crossJoin(F.broadcast(s.createDataFrame(SWEEPS, "what string, value double, s0 double, sigma double, t double"))).groupBy("what", "value", "t").agg((F.exp(-0.05 * F.col("t")) * F.avg(F.greatest(F.col("s0") * F.exp((0.05 - F.col("sigma") * F.col("sigma") / 2) * F.col("t") + F.col("sigma") * F.sqrt("t") * F.col("z")) - 100, F.lit(0.0)))).alias("price")))
query("o13_variance_reduction", PATHS + f", pr AS (SELECT greatest(100 * product({EULER}) - 100, 0) AS a, greatest(100 * product(1 + 0.05 * dt - 0.2 * dw) - 100, 0) AS b FROM st GROUP BY path) SELECT var_pop(a) AS plain, var_pop((a + b) / 2) AS paired, var_pop(a) / var_pop((a + b) / 2) AS ratio FROM pr", "", "plain paired ratio")(
    lambda s, d: M.antithetic(s, N, STEPS).select(M.call_payoff(F.col("price"), 100.0).alias("a"), M.call_payoff(F.col("mirror"), 100.0).alias("b")).agg(F.var_pop("a").alias("plain"), F.var_pop((F.col("a") + F.col("b")) / 2).alias("paired"), (F.var_pop("a") / F.var_pop((F.col("a") + F.col("b")) / 2)).alias("ratio")))

# --- grids -------------------------------------------------------------------------------------------------


@query("g01_strategy_scenarios", " UNION ALL ".join(f"SELECT {f} AS fast, {s} AS slow, fee, symbol, total FROM (WITH {ma_sql(f, s, -1.0)}, tt AS (SELECT *, {turn()} AS tn FROM p) SELECT symbol, fee, sum(coalesce(position * ret - tn * fee / 10000, 0)) AS total FROM tt, (VALUES (0.5::DOUBLE), (2.0), (10.0)) g(fee) GROUP BY symbol, fee)" for f, s in ((5, 20), (10, 40))), "fast slow fee symbol", "total", 4)
def g01(spark, d):
    b = T.bars(spark, d)
    fees = spark.createDataFrame([(0.5,), (2.0,), (10.0,)], "fee double")
    out = None
    for fast, slow in ((5, 20), (10, 40)):
        p = B.ma_signal(b, fast, slow).withColumn("turnover", R.first_turn("position", X.W))
        # Cost is linear in turnover: one pass serves every fee.
        p = p.crossJoin(F.broadcast(fees)).groupBy("symbol", "fee").agg(F.sum(F.coalesce(F.col("position") * F.col("ret") - F.col("turnover") * F.col("fee") / 10_000, F.lit(0.0))).alias("total"))
        p = p.withColumns({"fast": F.lit(fast), "slow": F.lit(slow)})
        out = p if out is None else out.unionByName(p)
    return out


_QS = ((0.6, None), (0.6, 48), (0.6, 96), (0.7, None), (0.7, 48), (0.7, 96), (0.8, None), (0.8, 48), (0.8, 96))


def _bands(q: float, lookback: int | None) -> str:
    if lookback is None:
        level = lambda p: f"quantile_cont(CASE WHEN split = 'train' THEN signal END, {p}) OVER (PARTITION BY symbol)"
    else:
        level = lambda p: past_q("signal", lookback, p, max(5, lookback // 4))
    return f"SELECT symbol, ts, split, signal, ret, {q} AS q, {lookback or -1} AS lookback, {level(q)} AS hi, {level(round(1 - q, 6))} AS lo FROM sp"


CELL = "PARTITION BY symbol, q, lookback ORDER BY ts"
FEED = "PARTITION BY symbol, q, lookback, fee_bps, split ORDER BY ts"
CELLS = SIGNAL + ", bd AS (" + " UNION ALL ".join(_bands(*c) for c in _QS) + f"""), bp AS (SELECT *, CASE WHEN signal < lo THEN -1.0 WHEN signal > hi THEN 1.0 ELSE 0.0 END AS position FROM bd),
    bq AS (SELECT *, {turn('position', CELL)} AS tn, coalesce(lag(position) OVER ({CELL}), 0) AS held FROM bp), bf AS (SELECT *, held * ret - tn * fee_bps / 10000 AS pnl FROM bq, (VALUES (2.0::DOUBLE), (5.0), (10.0)) g(fee_bps)),
    be AS (SELECT *, 1 + sum(pnl) OVER ({FEED} ROWS UNBOUNDED PRECEDING) AS eq FROM bf), bx AS (SELECT *, eq - max(eq) OVER ({FEED} ROWS UNBOUNDED PRECEDING) AS dd FROM be)
    SELECT symbol, CAST(q AS DOUBLE) AS q, lookback, fee_bps, split, avg(pnl) * 8760 AS ann_return, avg(pnl) * 8760 / NULLIF(stddev_samp(pnl) * sqrt(8760.0), 0) AS sharpe, min(dd) AS max_drawdown, sum(pnl) AS total_return FROM bx GROUP BY symbol, q, lookback, fee_bps, split"""


@query("g02_combination_sensitivity", CELLS, "symbol q lookback fee_bps split", "ann_return sharpe max_drawdown total_return", 4)
def g02(spark, d):
    rows = signal_frame(spark, d)
    fees = spark.createDataFrame([(2.0,), (5.0,), (10.0,)], "fee_bps double")
    out = None
    for q in (0.6, 0.7, 0.8):
        for lookback in (None, 48, 96):
            p = B.quantile_position(rows, "signal", q, ["symbol"], lookback).withColumns({"q": F.lit(q), "lookback": F.lit(lookback or -1)})
            out = p if out is None else out.unionByName(p)
    out = B.lagged_pnl(out.crossJoin(F.broadcast(fees)), ["symbol", "q", "lookback", "fee_bps"], fee_bps=F.col("fee_bps"))
    return B.signal_metrics(out, ["symbol", "q", "lookback", "fee_bps", "split"])


#: Entry and exit levels of the rule families, and cold and hot edges of the continuous one.
BUYS, SELLS = (-2.0, -1.5, -1.2, -1.0, -0.8, -0.5, -0.3), (0.3, 0.5, 0.8, 1.0, 1.2, 1.5, 2.0)
COLDS, HOTS = (-1.5, -1.2, -1.0, -0.8, -0.5), (0.5, 0.8, 1.0, 1.2, 1.5)
FAMILIES = [(f, b, c, i) for b in BUYS for c in SELLS for f, i in (("overcooled_entry", 0.0), ("default_long", 1.0), ("hysteresis", 0.0))] + [("continuous", b, c, 0.0) for b in COLDS for c in HOTS]
RULE_KEY = ["symbol", "family", "buy", "sell"]


def damped(s, d) -> DataFrame:
    """z-scores and an index that follows a damped path."""
    return z20(T.bars(s, d)).withColumn("index_close", 1000 * F.exp(F.sum(F.coalesce("z", F.lit(0.0)) / 200).over(R.cum(X.W))))


def split_books(rows: DataFrame, key: list[str]) -> DataFrame:
    return B.nav_summary(B.split_rows(B.nav_backtest(rows, key, "ts"), key, names=("train", "valid", "final")), [*key, "split"], "ts")


def threshold_grid(s, d) -> DataFrame:
    """Every rule family under every pair of its levels, as groups of one window pass."""
    grid = s.createDataFrame(FAMILIES, "family string, buy double, sell double, initial double")
    rule = lambda z: F.when(F.col("family") == "continuous", rules.continuous(F.col("buy"), F.col("sell"))(z)).otherwise(rules.baseline(F.col("buy"), F.col("sell"))(z))
    return split_books(rules.hold(damped(s, d).crossJoin(F.broadcast(grid)), rule, ["z"], RULE_KEY, "ts", initial=F.col("initial")), RULE_KEY)


def dual_grid(s, d) -> DataFrame:
    """Two signals under every pair of levels: both to enter, the lesser of two positions, the mean of two positions."""
    grid = s.createDataFrame([(b, c) for b in BUYS for c in SELLS], "buy double, sell double")
    z = damped(s, d).withColumn("y", F.lag("z", 5).over(X.W)).crossJoin(F.broadcast(grid))
    both, key = rules.both_to_enter(F.col("buy"), F.col("sell")), ["symbol", "buy", "sell"]
    held_ = rules.hold(z, both, ["z", "y"], key, "ts").withColumn("family", F.explode(F.array(F.lit("and_entry_or_exit"), F.lit("min_position"))))
    before = z.withColumns({c: F.lag(c).over(R.series(key, "ts")) for c in ("z", "y")})
    mean = folds.scan(before, key, "ts", lambda c: {"position": folds.average_rule(c["z"], c["y"], float(c["buy"][0]), float(c["sell"][0]))}, ["z", "y", "buy", "sell"], {"position": "double"}).withColumn("family", F.lit("avg_position"))
    columns = [*RULE_KEY, "ts", "index_close", "position"]
    return split_books(held_.select(*columns).unionByName(mean.select(*columns)), RULE_KEY)


def nav_grid_sql(key: str, grid: str, fixed: str, initial: str = "0.0") -> str:
    """CTEs up to nv (daily books) and su (their summary by key and split) of a rule under every row of a grid."""
    by = f"PARTITION BY {key} ORDER BY ts"
    seg = f"PARTITION BY {key}, split ORDER BY ts"
    return f"""WITH {Z20}, {DAMP}, gx AS (SELECT ix.*, g.* FROM ix, {grid}), fx AS (SELECT *, CASE WHEN zp IS NOT NULL THEN {fixed} END AS fixed FROM gx),
    ps AS (SELECT *, coalesce(last_value(fixed IGNORE NULLS) OVER ({by} ROWS UNBOUNDED PRECEDING), {initial}) AS position, index_close / lag(index_close) OVER ({by}) - 1 AS ret FROM fx),
    mv AS (SELECT *, position - coalesce(lag(position) OVER ({by}), position) AS move FROM ps), cs AS (SELECT *, CASE WHEN ret IS NULL THEN 0 ELSE abs(move) * 0.0002 + greatest(-move, 0) * 0.001 END AS cost FROM mv),
    ne AS (SELECT *, coalesce(position * ret - cost, 0) AS net FROM cs),
    nv AS (SELECT *, 1000000.0 * product(1 + net) OVER ({by} ROWS UNBOUNDED PRECEDING) AS nav, 1000000.0 * product(1 + coalesce(ret, 0)) OVER ({by} ROWS UNBOUNDED PRECEDING) AS benchmark, row_number() OVER ({by}) - 1 AS r0, count(*) OVER (PARTITION BY {key}) AS n0 FROM ne),
    sp AS (SELECT *, CASE WHEN r0 < floor(n0 * 6 / 10) THEN 'train' WHEN r0 < floor(n0 * 8 / 10) THEN 'valid' ELSE 'final' END AS split FROM nv),
    sd AS (SELECT *, nav / max(nav) OVER ({seg} ROWS UNBOUNDED PRECEDING) - 1 AS dd, abs(position - lag(position) OVER ({seg})) > 1e-9 AS moved FROM sp),
    su AS (SELECT {key}, split, CAST(count(*) FILTER (WHERE moved) AS BIGINT) AS n_trades, max_by(nav, ts) / min_by(nav, ts) - 1 AS total_return, avg(net) / NULLIF(stddev_pop(net), 0) * sqrt(252.0) AS sharpe, min(dd) AS max_drawdown,
      max_by(nav, ts) / min_by(nav, ts) - max_by(benchmark, ts) / min_by(benchmark, ts) AS excess_return FROM sd GROUP BY {key}, split)"""


FAMILY_ROWS = ", ".join(f"('{f}', {b}::DOUBLE, {c}::DOUBLE, {i}::DOUBLE)" for f, b, c, i in FAMILIES)
THRESHOLDS = nav_grid_sql("symbol, family, buy, sell", f"(VALUES {FAMILY_ROWS}) g(family, buy, sell, initial)", "CASE WHEN family = 'continuous' THEN CASE WHEN zp > sell THEN 0.0 WHEN zp <= buy THEN least(greatest((-zp - abs(buy)) / 2, 0), 1) END WHEN zp < buy THEN 1.0 WHEN zp > sell THEN 0.0 END", "initial")
_LEVELS = ", ".join(f"({b}::DOUBLE, {c}::DOUBLE)" for b in BUYS for c in SELLS)
_STEP = "CASE WHEN n.{x} < n.buy THEN 1::DOUBLE WHEN n.{x} > n.sell THEN 0::DOUBLE ELSE p.position END"
_DUAL = "PARTITION BY symbol, family, buy, sell ORDER BY ts"
DUALS = f"""WITH RECURSIVE {Z20}, {DAMP}, iy AS (SELECT *, lag(z, 5) OVER ({W}) AS y, row_number() OVER ({W}) AS rn FROM ix), iz AS (SELECT *, lag(y) OVER ({W}) AS yp FROM iy), gy AS (SELECT iz.*, g.* FROM iz, (VALUES {_LEVELS}) g(buy, sell)),
    av AS (SELECT symbol, buy, sell, ts, rn, index_close, 0.0::DOUBLE AS position FROM gy WHERE rn = 1 UNION ALL SELECT n.symbol, n.buy, n.sell, n.ts, n.rn, n.index_close, CASE WHEN n.zp IS NULL OR n.yp IS NULL THEN p.position::DOUBLE ELSE ({_STEP.format(x="zp")} + {_STEP.format(x="yp")}) / 2 END
      FROM av p JOIN gy n ON n.symbol = p.symbol AND n.buy = p.buy AND n.sell = p.sell AND n.rn = p.rn + 1),
    be AS (SELECT *, CASE WHEN zp > sell OR yp > sell THEN 0::DOUBLE WHEN zp < buy AND yp < buy THEN 1::DOUBLE END AS fixed FROM gy WHERE zp IS NOT NULL AND yp IS NOT NULL UNION ALL SELECT *, NULL FROM gy WHERE zp IS NULL OR yp IS NULL),
    bh AS (SELECT *, coalesce(last_value(fixed IGNORE NULLS) OVER (PARTITION BY symbol, buy, sell ORDER BY ts ROWS UNBOUNDED PRECEDING), 0::DOUBLE) AS position FROM be),
    dp AS (SELECT symbol, f AS family, buy, sell, ts, index_close, position FROM bh, (VALUES ('and_entry_or_exit'), ('min_position')) t(f) UNION ALL SELECT symbol, 'avg_position', buy, sell, ts, index_close, position FROM av),
    ps AS (SELECT *, index_close / lag(index_close) OVER ({_DUAL}) - 1 AS ret FROM dp), {THRESHOLDS[THRESHOLDS.index("mv AS") :]}"""
RULE_BOOKS = nav_grid_sql("symbol, rule", "(VALUES ('baseline'), ('hysteresis'), ('continuous')) g(rule)", f"CASE rule WHEN 'baseline' THEN {BASE} WHEN 'hysteresis' THEN CASE WHEN zp < -1.5 THEN 1.0 WHEN zp > 0.5 THEN 0.0 END ELSE {CONTINUOUS} END") + """,
    rm AS (SELECT symbol, rule, max_by(nav, ts) / min_by(nav, ts) - 1 AS total_return, avg(net) / NULLIF(stddev_pop(net), 0) * sqrt(252.0) AS sharpe FROM nv GROUP BY symbol, rule)"""
query("g06_dual_grid", DUALS + " SELECT * FROM su", "symbol family buy sell split n_trades", "total_return sharpe max_drawdown excess_return", 4)(dual_grid)
query("g06_threshold_grid", THRESHOLDS + " SELECT * FROM su", "symbol family buy sell split n_trades", "total_return sharpe max_drawdown excess_return", 4)(threshold_grid)
query("t03_select_on_valid", THRESHOLDS + ", wd AS (SELECT symbol, family, buy, sell, max(total_return) FILTER (WHERE split = 'train') AS train, max(total_return) FILTER (WHERE split = 'valid') AS valid FROM su GROUP BY ALL), r5 AS (SELECT * FROM wd QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY round(train, 9) DESC, family, buy, sell) <= 5) SELECT * FROM r5 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY round(valid, 9) DESC, family, buy, sell) = 1", "symbol family buy sell", "train valid", 4)(
    lambda s, d: (lambda g: g.groupBy(*RULE_KEY).pivot("split", ["train", "valid"]).agg(F.first("total_return")).withColumn("r", F.row_number().over(Window.partitionBy("symbol").orderBy(F.round("train", 9).desc(), "family", "buy", "sell"))).where("r <= 5").withColumn("v", F.row_number().over(Window.partitionBy("symbol").orderBy(F.round("valid", 9).desc(), "family", "buy", "sell"))).where("v = 1"))(threshold_grid(s, d)))
query("g05_rule_matrix", RULE_BOOKS + " SELECT * FROM rm", "symbol rule", "total_return sharpe", 4)(
    lambda s, d: (lambda z: __import__("functools").reduce(lambda a, b: a.unionByName(b), [B.nav_summary(B.nav_backtest(rules.hold(z, r, ["z"], ["symbol"], "ts"), ["symbol"], "ts"), ["symbol"], "ts").withColumn("rule", F.lit(n)) for n, r in rules.RULES.items()]))(z20(T.bars(s, d)).withColumn("index_close", 1000 * F.exp(F.sum(F.coalesce("z", F.lit(0.0)) / 200).over(R.cum(X.W))))))
query("g08_z_grid_out_of_sample", None, "symbol split entry n_trades", "total_return time_in_market", 4)(
    lambda s, d: (lambda g: B.round_trips(g, ["symbol", "split", "entry"], "ts").join(B.pair_backtest(g, ["symbol", "split", "entry"], "ts", 0.5).groupBy("symbol", "split", "entry").agg(F.sum("pnl").alias("total_return")), ["symbol", "split", "entry"]))(z_grid(s, d, ["symbol", "split"])))
query("g09_cost_sensitivity", HELD.replace("5 / 10000 AS pnl FROM st)", "0 / 10000 AS gross, 2 * " + turn() + " / 10000 AS unit FROM st)") + ", cs AS (SELECT cost, sum(gross - unit * cost) AS total, product(1 + gross - unit * cost) - 1 AS grown FROM bk, (VALUES (0.0::DOUBLE), (5.0), (20.0)) g(cost) WHERE gross IS NOT NULL GROUP BY cost) SELECT * FROM cs", "cost", "total", 5)(
    lambda s, d: B.pair_backtest(held(s, d).crossJoin(F.broadcast(s.createDataFrame([(0.0,), (5.0,), (20.0,)], "cost double"))), ["symbol", "cost"], "ts", 0.5, F.col("cost")).groupBy("cost").agg(F.sum("pnl").alias("total")))
query("g12_config_evaluation", THRESHOLDS + " SELECT *, CAST(excess_return > 0 AS BIGINT) AS beats FROM su WHERE split = 'valid'", "symbol family buy sell beats", "excess_return", 4)(lambda s, d: threshold_grid(s, d).where("split = 'valid'").withColumn("beats", (F.col("excess_return") > 0).cast("long")))
query("g13_threshold_pairs", f"SELECT * FROM (VALUES {_LEVELS}) g(buy, sell) WHERE buy < sell", "", "buy sell")(lambda s, d: s.createDataFrame([(b, c) for b in BUYS for c in SELLS if b < c], "buy double, sell double"))
query("t04_best_per_method", RULE_BOOKS + " SELECT * FROM rm QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY round(total_return, 4) + 0.0 DESC, rule) = 1", "symbol rule", "total_return", 4)(lambda s, d: QUERIES_RUN("g05_rule_matrix", s, d).withColumn("r", F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("total_return").desc(), "rule"))).where("r = 1"))


def QUERIES_RUN(name: str, s, d) -> DataFrame:  # noqa: N802
    from tidemark.plans.registry import QUERIES

    return QUERIES[name](s, d)


# --- models ------------------------------------------------------------------------------------------------


def features(s, d) -> DataFrame:
    rows = X.rsi(X.range_position(X.zscore(T.bars(s, d), "close", 20, "a"), 24, "b"), 14, "c").withColumn("t", R.ahead("close", 1, X.W) / 100)
    rows = B.split_rows(rows.na.drop(subset=["a", "b", "c", "t"]), ["symbol"])
    return standardise_by(rows, ["a", "b", "c"], ["symbol"], "split = 'train'")


query("m01_ic_weight_signal", None, "symbol ts", "ic_weight", 5)(lambda s, d: (lambda f: Md.linear_score(f, Md.ic_weights(f, ["a", "b", "c"], "t"), "ic_weight"))(features(s, d)))
query("m02_nonnegative_ic_weights", None, "feature", "weight", 5)(lambda s, d: s.createDataFrame(list(Md.ic_weights(features(s, d), ["a", "b", "c"], "t", keep_sign=False).items()), "feature string, weight double"))
query("m03_model_signals", None, "symbol ts", "linear ridge tree", 4)(lambda s, d: Md.combined_signals(features(s, d), ["a", "b", "c"], "t"))
query("m04_combination_signals", None, "method", "mean deviation", 4)(lambda s, d: Md.combined_signals(features(s, d), ["a", "b", "c"], "t").unpivot(["symbol", "ts"], ["equal_weight", "ic_weight", "linear", "ridge", "tree"], "method", "v").groupBy("method").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("deviation")))
query("m05_standardised_composite", None, "symbol ts", "equal_weight", 5)(lambda s, d: standardise_by(Md.combined_signals(features(s, d), ["a", "b", "c"], "t"), ["equal_weight"], ["symbol"], "split = 'train'", population=True))


def scored(s, d) -> DataFrame:
    rows = Tb.stratified_split(T.labelled(s, d).withColumn("len", F.log1p("n_chars")).withColumn("lang_code", F.length("lang").cast("double") + F.ascii("lang") / 100.0), "quality", "doc_id")
    return Md.classify_all(rows, ["len", "lang_code", "toxic"], "quality")


query("m11_classifiers", None, "doc_id split", "logistic forest boosting vote", 4)(scored)
query("m15_model_comparison", None, "model", "auc", 4)(lambda s, d: scored(s, d).where("split = 'test'").unpivot(["doc_id", "quality"], ["logistic", "forest", "boosting", "vote"], "model", "score").withColumn("r", R.average_rank("score", "model")).groupBy("model").agg(F.sum(F.when(F.col("quality") == 1, F.col("r"))).alias("r"), F.count_if(F.col("quality") == 1).alias("p"), F.count_if(F.col("quality") == 0).alias("q")).withColumn("auc", F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * F.col("q"))))
query("m19_importances", None, "feature", "importance", 4)(lambda s, d: s.createDataFrame(Md.importances(Tb.stratified_split(T.labelled(s, d).withColumn("len", F.log1p("n_chars")), "quality", "doc_id"), ["len", "toxic"], "quality"), "feature string, importance double"))
query("m21_chronological_split", "SELECT symbol, ts, CASE WHEN rn < floor(n * 8 / 10) THEN 'train' ELSE 'test' END AS split FROM (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM v1)", "symbol ts split")(lambda s, d: B.split_rows(T.bars(s, d), ["symbol"], "ts", 8, 0, ("train", "-", "test")))
query("m20_time_series_folds", "SELECT symbol, ts, CAST(greatest(0, floor((rn - (n - 5 * (n // 6))) / (n // 6)) + 1) AS INT) AS fold FROM (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM v1)", "symbol ts fold")(
    lambda s, d: T.bars(s, d).withColumns({"rn": F.row_number().over(X.W) - 1, "n": F.count("*").over(Window.partitionBy("symbol"))}).withColumn("fold", Tb.expanding_folds(5, F.col("rn"), F.col("n"))))
query("m23_threshold_tuning", "WITH g AS (SELECT 100.0 + range * 50.0 AS threshold FROM range(41)), r AS (SELECT threshold, avg(CAST(n_chars >= threshold AS INT)) FILTER (WHERE quality = 1) AS tpr, avg(CAST(n_chars < threshold AS INT)) FILTER (WHERE quality = 0) AS tnr FROM v7, g GROUP BY threshold) SELECT threshold, (tpr + tnr) / 2 AS balanced FROM r", "", "threshold balanced")(lambda s, d: Md.threshold_scan(T.labelled(s, d), "n_chars", "quality", [100.0 + 50.0 * i for i in range(41)]))
query("t09_best_threshold", "WITH g AS (SELECT 100.0 + range * 50.0 AS threshold FROM range(41)), r AS (SELECT threshold, avg(CAST(n_chars >= threshold AS INT)) FILTER (WHERE quality = 1) AS tpr, avg(CAST(n_chars < threshold AS INT)) FILTER (WHERE quality = 0) AS tnr FROM v7, g GROUP BY threshold) SELECT threshold FROM r ORDER BY tpr + tnr DESC, threshold LIMIT 1", "", "threshold")(lambda s, d: Md.threshold_scan(T.labelled(s, d), "n_chars", "quality", [100.0 + 50.0 * i for i in range(41)]).limit(1))

# --- battles -----------------------------------------------------------------------------------------------

query("b02_turn_order", "SELECT * FROM (VALUES ('Wolf', 1), ('Warrior', 2), ('Goblin', 3), ('Wizard', 4)) t(name, place)", "name place")(lambda s, d: A.turn_order(A.units(s).withColumns({"k": F.lit(1), "position": F.lit(0)}), ["k"]))
query("b03_damage", "SELECT a.name AS attacker, b.name AS target, greatest(b.hp - greatest(a.attack - b.defence, 0), 0) AS hp FROM (VALUES ('Warrior', 260, 40, 20), ('Wizard', 200, 50, 10), ('Goblin', 55, 35, 15), ('Wolf', 40, 45, 5)) a(name, hp, attack, defence), (VALUES ('Warrior', 260, 40, 20), ('Wizard', 200, 50, 10), ('Goblin', 55, 35, 15), ('Wolf', 40, 45, 5)) b(name, hp, attack, defence)", "attacker target hp")(
    lambda s, d: A.units(s).select(F.col("name").alias("attacker"), F.col("attack").alias("power")).crossJoin(A.units(s).withColumnRenamed("name", "target")).withColumn("hp", A.after_hit(F.col("hp"), A.damage(F.col("power"), F.col("defence")))))
_EFFECTS = "array(named_struct('name', 'defend', 'bonus', 10, 'duration', 2), named_struct('name', 'smoke', 'bonus', 0, 'duration', 1))"
query("b04_effects", "SELECT name, defence + 10 AS defence, 1 AS left_after FROM (VALUES ('Warrior', 20), ('Wizard', 10), ('Goblin', 15), ('Wolf', 5)) t(name, defence)", "name defence left_after")(lambda s, d: A.units(s).withColumn("e", F.expr(_EFFECTS)).select("name", A.effective_defence(F.col("defence"), F.col("e")).alias("defence"), F.size(A.expire(F.col("e"))).alias("left_after")))
query("b07_items", "SELECT 'potion,bomb,potion' AS before, 'bomb,potion' AS after, 200 AS hp", "before after hp")(lambda s, d: s.range(1).select(F.lit("potion,bomb,potion").alias("before"), F.array_join(A.use_item(F.split(F.lit("potion,bomb,potion"), ","), "potion"), ",").alias("after"), A.healed(F.lit(150), 100, F.lit(200)).alias("hp")))
query("b08_units", "SELECT * FROM (VALUES ('Warrior', 260, 40, 20, 30), ('Wizard', 200, 50, 10, 20), ('Goblin', 55, 35, 15, 25), ('Wolf', 40, 45, 5, 35)) t(name, hp, attack, defence, speed)", "name hp attack defence speed")(lambda s, d: A.units(s))
query("b01_battles", None, "battle rounds hero_hp won")(lambda s, d: A.battles(s.range(20).select(F.col("id").alias("battle"), F.when(F.col("id") % 2 == 0, "Warrior").otherwise("Wizard").alias("hero"), (F.col("id") % 4).cast("int").alias("goblins"), (F.col("id") % 3 + 1).cast("int").alias("wolves"))))
