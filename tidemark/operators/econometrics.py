"""Regressions from grouped moment sums, and the time-series tests built on them.

Normal equations need only sums of products, so any number of series is fitted in one aggregate; the small
systems are then solved per group in a grouped Arrow function of one row each.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.rolling import cum, roll, series

#: 5 % critical values.
CRITICAL = {"engle_granger": {"1%": -3.90, "5%": -3.34, "10%": -3.04}, "adf": {"1%": -3.43, "5%": -2.86, "10%": -2.57}}
TRACE_5 = (15.4943, 3.8415)
MAX_EIGEN_5 = (14.2639, 3.8415)
KPSS_LEVELS = ((0.347, 0.10), (0.463, 0.05), (0.574, 0.025), (0.739, 0.01))


def ols(df: DataFrame, keys: list[str], y: str, xs: list[str]) -> DataFrame:
    """Intercept and slopes with standard errors, r2 and nobs of every key: name_b, name_se for const and each x."""
    names = ["const", *xs]
    value = lambda n: F.lit(1.0) if n == "const" else F.col(n).cast("double")
    rows = df.where(" and ".join(f"{c} is not null" for c in (y, *xs)))
    moments = {f"m_{i}_{j}": F.sum(value(a) * value(b)) for i, a in enumerate(names) for j, b in enumerate(names) if i <= j}
    moments |= {f"v_{i}": F.sum(value(a) * F.col(y)) for i, a in enumerate(names)}
    sums = rows.groupBy(*keys).agg(*[c.alias(n) for n, c in moments.items()], F.sum(F.col(y) * F.col(y)).alias("yy"), F.avg(y).alias("ym"), F.count("*").alias("nobs"))
    out_names = [f"{n}_{s}" for n in names for s in ("b", "se")] + ["r2", "sigma2"]

    def solve(batches):
        for batch in batches:
            made = {n: [] for n in out_names}
            for r in batch.to_pylist():
                k = len(names)
                xx = np.array([[r[f"m_{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
                xy = np.array([r[f"v_{i}"] for i in range(k)])
                scale = np.sqrt(np.maximum(np.diag(xx), 1e-300))
                inverse = np.linalg.pinv(xx / np.outer(scale, scale)) / np.outer(scale, scale)
                beta = inverse @ xy
                rss = max(0.0, r["yy"] - beta @ xy)
                free = r["nobs"] - k
                s2 = rss / free if free > 0 else math.nan
                tss = r["yy"] - r["nobs"] * r["ym"] ** 2
                for i, n in enumerate(names):
                    made[f"{n}_b"].append(float(beta[i]))
                    made[f"{n}_se"].append(float(np.sqrt(s2 * inverse[i, i])) if free > 0 else None)
                made["r2"].append(1 - rss / tss if tss > 0 else None)
                made["sigma2"].append(s2 if free > 0 else None)
            keep = [batch.column(c) for c in (*keys, "nobs")]
            yield pa.record_batch(keep + [pa.array(made[n], pa.float64()) for n in out_names], names=[*keys, "nobs", *out_names])

    kinds = ", ".join(f"{k} {dict(df.dtypes)[k]}" for k in keys)
    return sums.mapInArrow(solve, f"{kinds}, nobs long, " + ", ".join(f"{n} double" for n in out_names))


def adf(df: DataFrame, keys: list[str], order: str, y: str, lag: int = 1) -> DataFrame:
    """tau, phi and nobs of the augmented Dickey-Fuller regression with constant and fixed lag."""
    w = series(keys, order)
    rows = df.where(F.col(y).isNotNull()).withColumn("_d", F.col(y) - F.lag(y).over(w))
    rows = rows.withColumns({"_level": F.lag(y).over(w), **{f"_d{i}": F.lag("_d", i).over(w) for i in range(1, lag + 1)}})
    fit = ols(rows, keys, "_d", ["_level", *[f"_d{i}" for i in range(1, lag + 1)]])
    return fit.where("nobs >= 10").select(*keys, "nobs", F.col("_level_b").alias("phi"), F.try_divide("_level_b", "_level_se").alias("tau"))


def decide(tau: Column, level: str = "5%", table: str = "engle_granger") -> Column:
    """Whether the unit root is rejected."""
    return tau < CRITICAL[table][level]


def residuals(df: DataFrame, keys: list[str], y: str = "y", x: str = "x", out: str = "residual") -> DataFrame:
    """y - alpha - beta x with the key's own levels regression; alpha and beta are added too."""
    fit = df.groupBy(*keys).agg(F.regr_intercept(y, x).alias("alpha"), F.regr_slope(y, x).alias("beta"))
    return df.join(fit, keys).withColumn(out, F.col(y) - F.col("alpha") - F.col("beta") * F.col(x))


def engle_granger(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Cointegrating regression, ADF(1) of its residual and the error-correction regression, one row per key."""
    w = series(keys, order)
    rows = residuals(df, keys)
    steps = rows.withColumns({"dy": F.col("y") - F.lag("y").over(w), "dx": F.col("x") - F.lag("x").over(w), "e_lag": F.lag("residual").over(w)})
    ecm = ols(steps, keys, "dy", ["e_lag", "dx"]).select(*keys, F.col("e_lag_b").alias("ecm_lambda"), F.try_divide("e_lag_b", "e_lag_se").alias("ecm_t"), F.col("dx_b").alias("ecm_gamma"))
    level = rows.groupBy(*keys).agg(F.first("alpha").alias("alpha"), F.first("beta").alias("beta"))
    test = adf(rows, keys, order, "residual").select(*keys, "tau", "phi")
    return level.join(test, keys).join(ecm, keys).withColumn("cointegrated", decide(F.col("tau")))


def ou_fit(df: DataFrame, keys: list[str], order: str, e: str = "residual", least: int = 30) -> DataFrame:
    """AR(1) of a residual as a mean-reverting process: mu, theta, half_life, sigma_eps, sigma_eq; outside 0 < b < 1
    theta and half-life are null and mu, sigma_eq are the plain moments."""
    w = series(keys, order)
    rows = df.where(F.col(e).isNotNull()).withColumn("_before", F.lag(e).over(w))
    b, x = F.regr_slope(e, "_before"), F.col("_before").isNotNull()
    out = rows.groupBy(*keys).agg(
        b.alias("b"), F.regr_intercept(e, "_before").alias("a"), F.sqrt(F.try_divide(F.regr_syy(e, "_before") - b * F.regr_sxy(e, "_before"), F.count_if(x) - 2)).alias("sigma_eps"),
        F.regr_r2(e, "_before").alias("r2"), F.avg(e).alias("_mean"), F.stddev_samp(e).alias("_std"), F.count("*").alias("n"),
    )
    ok = (F.col("b") > 0) & (F.col("b") < 1)
    theta = F.when(ok, -F.log("b"))
    return out.where(F.col("n") >= least).select(
        *keys, "a", "b", "sigma_eps", "r2", theta.alias("theta"), (F.log(F.lit(2.0)) / theta).alias("half_life"),
        F.when(ok, F.col("a") / (1 - F.col("b"))).otherwise(F.col("_mean")).alias("mu"), F.when(ok, F.col("sigma_eps") / F.sqrt(1 - F.col("b") * F.col("b"))).otherwise(F.col("_std")).alias("sigma_eq"),
    )


def rolling_beta(df: DataFrame, key: list[str], order: str, window: int, step: int) -> DataFrame:
    """alpha and beta of the window rows up to every step-th stamp."""
    w = series(key, order)
    frame = roll(w, window)
    rows = df.withColumns({"rn": F.row_number().over(w), "alpha": F.regr_intercept("y", "x").over(frame), "beta": F.regr_slope("y", "x").over(frame)})
    return rows.where((F.col("rn") >= window) & ((F.col("rn") - window) % step == 0)).select(*key, order, "alpha", "beta")


def rolling_adf(df: DataFrame, key: list[str], order: str, e: str, window: int, out: str = "tau") -> DataFrame:
    """tau of the ADF(1) regression on the window rows before each row (today excluded), from running moment sums
    and the closed inverse of a 3 x 3 matrix."""
    w = series(key, order)
    df = df.withColumn("_d", F.col(e) - F.lag(e).over(w)).withColumns({"_l": F.lag(e).over(w)}).withColumn("_p", F.lag("_d").over(w))
    frame = w.rowsBetween(-(window - 2), -1)  # the first two rows of a window give no observation
    s = lambda c: F.sum(c).over(frame)
    d, lev, p = F.col("_d"), F.col("_l"), F.col("_p")
    sums = {"n": F.count(F.when(p.isNotNull(), 1)).over(frame), "l": s(lev), "p": s(p), "ll": s(lev * lev), "pp": s(p * p), "lp": s(lev * p), "d": s(d), "dl": s(d * lev), "dp": s(d * p), "dd": s(d * d)}
    df = df.withColumns({f"_s{k}": c for k, c in sums.items()})
    g = {k: F.col(f"_s{k}") for k in sums}
    # Centred second moments reduce the problem to two regressors.
    c = lambda ab, a, b: g[ab] - g[a] * g[b] / g["n"]
    ll, pp, lp, dl, dp, dd = c("ll", "l", "l"), c("pp", "p", "p"), c("lp", "l", "p"), c("dl", "d", "l"), c("dp", "d", "p"), c("dd", "d", "d")
    det = ll * pp - lp * lp
    phi, gamma = F.try_divide(pp * dl - lp * dp, det), F.try_divide(ll * dp - lp * dl, det)
    s2 = F.try_divide(dd - phi * dl - gamma * dp, g["n"] - 3)
    tau = F.try_divide(phi, F.sqrt(F.greatest(s2 * F.try_divide(pp, det), F.lit(0.0))))
    return df.withColumn(out, F.when(g["n"] == window - 2, tau)).drop("_d", "_l", "_p", *[f"_s{k}" for k in sums])


def kpss(df: DataFrame, keys: list[str], order: str, y: str) -> DataFrame:
    """KPSS level statistic with the data-dependent Bartlett bandwidth, and its interpolated p-value, by key."""

    def test(key: tuple, rows: pa.Table) -> pa.Table:
        x = rows.sort_by([(order, "ascending")]).column(y).drop_null().to_numpy()
        n = len(x)
        e = x - x.mean()
        # Hobijn et al.: bandwidth from autocovariances up to 4 (n / 100)^(2/9).
        m = int(n ** (2 / 9))
        cov = lambda k: float(e[k:] @ e[: n - k]) / n
        s0, s1 = cov(0) + 2 * sum(cov(k) for k in range(1, m + 1)), 2 * sum(k * cov(k) for k in range(1, m + 1))
        bandwidth = min(n - 1, int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3))) if s0 else 0
        long_run = cov(0) + 2 * sum((1 - k / (bandwidth + 1)) * cov(k) for k in range(1, bandwidth + 1))
        stat = float((np.cumsum(e) ** 2).sum() / n**2 / long_run) if long_run else math.nan
        p = float(np.interp(stat, [a for a, _ in KPSS_LEVELS], [b for _, b in KPSS_LEVELS]))
        return pa.table({**{k: [v.as_py()] for k, v in zip(keys, key, strict=True)}, "stat": [stat], "p_value": [p], "lags": [bandwidth]})

    kinds = ", ".join(f"{k} {dict(df.dtypes)[k]}" for k in keys)
    return df.select(*keys, order, y).groupBy(*keys).applyInArrow(test, f"{kinds}, stat double, p_value double, lags long")


def var_order(data: np.ndarray, most: int) -> tuple[int, int, np.ndarray]:
    """AIC and BIC lag of a vector autoregression on a common sample, and the coefficients at the AIC lag."""
    n, k = len(data) - most, data.shape[1]
    best = {}
    for p in range(1, most + 1):
        x = np.concatenate([np.ones((n, 1))] + [data[most - i : len(data) - i] for i in range(1, p + 1)], axis=1)
        y = data[most:]
        coef, *_ = np.linalg.lstsq(x, y, rcond=None)
        u = y - x @ coef
        logdet = np.linalg.slogdet(u.T @ u / n)[1]
        size = k * (k * p + 1)
        best[p] = (logdet + 2 * size / n, logdet + math.log(n) * size / n, coef)
    aic = min(best, key=lambda p: best[p][0])
    return aic, min(best, key=lambda p: best[p][1]), best[aic][2]


DOUBLES = ("trace0", "trace1", "max0", "max1", "beta", "max_root")


def johansen(df: DataFrame, keys: list[str], order: str, most_lags: int = 8) -> DataFrame:
    """Johansen's test of log prices y, x: eigenvalues, trace and max-eigenvalue statistics, rank at 5 %, hedge ratio,
    with AIC and BIC lags of log returns and the largest companion root.

    Where the rows are too few or a moment matrix is singular (one series a multiple of the other, constant series)
    statistics, rank and hedge ratio are null. Non-positive and null prices are left out.
    """

    def test(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(order, "ascending")])
        price = np.stack([rows.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("y", "x")], axis=1)
        level = np.log(price[(price > 0).all(axis=1)])
        empty = pa.table({**{k: [v.as_py()] for k, v in zip(keys, key, strict=True)}, **{k: pa.nulls(1, pa.float64()) for k in DOUBLES}, **{k: pa.nulls(1, pa.int64()) for k in ("rank", "aic_lag", "bic_lag")}})
        if len(level) < 20:
            return empty
        diff = np.diff(level, axis=0)
        aic, bic, coef = var_order(diff, max(1, min(most_lags, len(diff) // 10)))  # ten rows a lag at least
        p = max(1, aic)
        companion = np.zeros((2 * p, 2 * p))
        companion[:2] = coef[1:].T
        companion[2:, :-2] = np.eye(2 * (p - 1))
        y, lagged = diff[p:], level[p:-1]
        z = np.concatenate([np.ones((len(y), 1))] + [diff[p - i : len(diff) - i] for i in range(1, p + 1)], axis=1)
        left = lambda a: a - z @ np.linalg.lstsq(z, a, rcond=None)[0]
        r0, r1 = left(y), left(lagged)
        n = len(r0)
        s00, s11, s01 = r0.T @ r0 / n, r1.T @ r1 / n, r0.T @ r1 / n
        lags = {"aic_lag": pa.array([aic], pa.int64()), "bic_lag": pa.array([bic], pa.int64())}
        # A residual is nothing but rounding where its variance is next to none of the series' own.
        own = [(a - a.mean(axis=0)).var(axis=0) for a in (y, lagged)]
        if n <= z.shape[1] + 2 or any((np.diag(m) <= 1e-12 * v).any() or np.linalg.cond(m) > 1e12 for m, v in zip((s00, s11), own, strict=True)):
            for k, v in lags.items():
                empty = empty.set_column(empty.schema.get_field_index(k), k, v)
            return empty
        values, vectors = np.linalg.eig(np.linalg.solve(s11, s01.T) @ np.linalg.solve(s00, s01))
        by = np.argsort(-values.real)
        values, vectors = np.clip(values.real[by], 0.0, 1 - 1e-15), vectors.real[:, by]
        trace = [-n * np.log(1 - values[i:]).sum() for i in range(2)]
        largest = [-n * math.log(1 - v) for v in values]
        rank = 0 if trace[0] < TRACE_5[0] else 1 if trace[1] < TRACE_5[1] else 2
        out = {"trace0": trace[0], "trace1": trace[1], "max0": largest[0], "max1": largest[1], "beta": -vectors[1, 0] / vectors[0, 0], "max_root": float(np.abs(np.linalg.eigvals(companion)).max())}
        return pa.table({**{k: [v.as_py()] for k, v in zip(keys, key, strict=True)}, **{k: [float(v)] for k, v in out.items()}, "rank": [rank], "aic_lag": [aic], "bic_lag": [bic]})

    kinds = ", ".join(f"{k} {dict(df.dtypes)[k]}" for k in keys)
    doubles = ", ".join(f"{c} double" for c in DOUBLES)
    return df.select(*keys, order, "y", "x").groupBy(*keys).applyInArrow(test, f"{kinds}, {doubles}, rank long, aic_lag long, bic_lag long")


def value_at_risk(pnl: str, alpha: float = 0.05) -> Column:
    """Historical loss quantile, positive for a loss."""
    return -F.percentile(pnl, F.lit(alpha))


def running_product(x: str, key: list[str], order: str) -> Column:
    return F.product(1 + F.coalesce(x, F.lit(0.0))).over(cum(series(key, order)))
