"""Allocation weights from grouped moments of asset returns, and allocation returns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def moment_weights(returns: DataFrame, asset: str = "symbol", ret: str = "pnl") -> DataFrame:
    """Weights of every asset: equal, sharpe (mean / deviation, negative as 0) and risk_target (1 / deviation)."""
    m = returns.groupBy(asset).agg(F.avg(ret).alias("mu"), F.stddev_samp(ret).alias("vol"))
    m = m.withColumn("_s", F.greatest(F.coalesce(F.try_divide("mu", "vol"), F.lit(0.0)), F.lit(0.0))).withColumn("_v", F.coalesce(F.try_divide(F.lit(1.0), F.col("vol")), F.lit(0.0)))
    everyone = Window.partitionBy()
    equal = 1.0 / F.count(F.lit(1)).over(everyone)
    share = lambda c: F.coalesce(F.try_divide(F.col(c), F.sum(c).over(everyone)), equal)
    return m.select(asset, equal.alias("equal"), share("_s").alias("sharpe"), share("_v").alias("risk_target"))


def covariance(returns: DataFrame, asset: str = "symbol", ret: str = "pnl", order: str = "ts") -> DataFrame:
    """(a, b, cov): sample covariances on common dates."""
    a = returns.select(F.col(asset).alias("a"), order, F.col(ret).alias("x"))
    b = returns.select(F.col(asset).alias("b"), order, F.col(ret).alias("y"))
    return a.join(b, order).groupBy("a", "b").agg(F.covar_samp("x", "y").alias("cov"))


def mean_variance(mu: np.ndarray, cov: np.ndarray, aversion: float = 5.0) -> np.ndarray:
    """Long-only weights of sum 1 that maximise w mu - aversion w cov w, by an active set of assets held at zero."""
    n = len(mu)
    held = list(range(n))
    while True:
        k = len(held)
        system = np.zeros((k + 1, k + 1))
        system[:k, :k] = 2 * aversion * cov[np.ix_(held, held)]
        system[:k, k], system[k, :k] = 1.0, 1.0
        solution = np.linalg.lstsq(system, np.append(mu[held], 1.0), rcond=None)[0]
        w = np.zeros(n)
        w[held] = solution[:k]
        if w.min() >= -1e-12 or k == 1:
            return np.clip(w, 0, None) / np.clip(w, 0, None).sum()
        held.remove(int(np.argmin(w)))


def optimal(returns: DataFrame, asset: str = "symbol", ret: str = "pnl", order: str = "ts", aversion: float = 5.0) -> dict[str, float]:
    """mean_variance on the moments of the returns; only the moments reach the driver."""
    mu = {r[asset]: r["m"] for r in returns.groupBy(asset).agg(F.avg(ret).alias("m")).collect()}
    names = sorted(mu)
    cov = {(r["a"], r["b"]): r["cov"] for r in covariance(returns, asset, ret, order).collect()}
    w = mean_variance(np.array([mu[n] for n in names]), np.array([[cov.get((a, b)) or 0.0 for b in names] for a in names]), aversion)
    return dict(zip(names, w.tolist(), strict=True))


def allocation_returns(returns: DataFrame, weights: DataFrame, weight: str, asset: str = "symbol", ret: str = "pnl", order: str = "ts") -> DataFrame:
    """Weighted sum by date; a missing return counts as 0."""
    return returns.join(F.broadcast(weights.select(asset, F.col(weight).alias("_w"))), asset).groupBy(order).agg(F.sum(F.coalesce(ret, F.lit(0.0)) * F.col("_w")).alias("pnl"))
