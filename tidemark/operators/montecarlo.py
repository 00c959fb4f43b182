"""Monte-Carlo pricing without loops: steps are rows, a path's terminal price is a product over its steps.

Path p, step k of an n-step simulation uses normal number p * n + k of a deterministic stream, so every price
can be reproduced and no path matrix is ever held.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.rolling import normal_cdf
from tidemark.sources.tables import normals


def steps(spark: SparkSession, paths: int, n: int) -> DataFrame:
    return normals(spark, paths * n).select((F.col("id") / n).cast("long").alias("path"), "z")


def factor(z: Column, scheme: str, r: float | Column, sigma: float | Column, dt: float | Column) -> Column:
    """Growth of one step under the Euler or the Milstein scheme."""
    dw = F.sqrt(F.lit(dt) if isinstance(dt, float) else dt) * z
    out = 1 + r * dt + sigma * dw
    return out + 0.5 * sigma * sigma * (dw * dw - dt) if scheme == "milstein" else out


def terminal(spark: SparkSession, paths: int, n: int, scheme: str, s0: float = 100.0, r: float = 0.05, sigma: float = 0.2, t: float = 1.0) -> DataFrame:
    """path and price; scheme euler, milstein or exact (the solution in one step)."""
    if scheme == "exact":
        return normals(spark, paths).select(F.col("id").alias("path"), (s0 * F.exp((r - sigma * sigma / 2) * t + sigma * (t**0.5) * F.col("z"))).alias("price"))
    return steps(spark, paths, n).groupBy("path").agg((s0 * F.product(factor(F.col("z"), scheme, r, sigma, t / n))).alias("price"))


def antithetic(spark: SparkSession, paths: int, n: int, s0: float = 100.0, r: float = 0.05, sigma: float = 0.2, t: float = 1.0) -> DataFrame:
    """path, price of the path and price of its mirror image (Euler), both from one aggregate."""
    up, down = factor(F.col("z"), "euler", r, sigma, t / n), factor(-F.col("z"), "euler", r, sigma, t / n)
    return steps(spark, paths, n).groupBy("path").agg((s0 * F.product(up)).alias("price"), (s0 * F.product(down)).alias("mirror"))


def call_payoff(price: Column, strike: float) -> Column:
    return F.greatest(price - strike, F.lit(0.0))


def binary_payoff(price: Column, strike: float) -> Column:
    return F.when(price > strike, 1.0).otherwise(0.0)


def discounted(payoff: Column, r: float, t: float) -> list[Column]:
    """price, se and half_width (95 %) as aggregates of a payoff."""
    d = F.exp(F.lit(-r * t))
    se = d * F.stddev_pop(payoff) / F.sqrt(F.count(payoff))
    return [(d * F.avg(payoff)).alias("price"), se.alias("se"), (1.96 * se).alias("half_width")]


def black_scholes(s: Column, strike: Column, r: Column, sigma: Column, t: Column) -> tuple[Column, Column]:
    """European and binary call."""
    d1 = (F.log(s / strike) + (r + sigma * sigma / 2) * t) / (sigma * F.sqrt(t))
    d2 = d1 - sigma * F.sqrt(t)
    df = F.exp(-r * t)
    return s * normal_cdf(d1) - strike * df * normal_cdf(d2), df * normal_cdf(d2)
