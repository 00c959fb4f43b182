"""Ordered windows over one key: trailing, cumulative and lagged expressions.

Every rolling aggregate follows one rule: a value appears once the window holds min_count non-null
inputs (the whole window unless stated), else null.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def series(key: str | list[str] = "symbol", order: str = "ts") -> WindowSpec:
    return Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(order)


def windowed(fn: Callable) -> Callable:
    """fn with w = series() where no window is given; windows need a session, so there is none at import."""
    names = list(inspect.signature(fn).parameters)
    at = names.index("w")

    @wraps(fn)
    def call(*args, **kwargs):
        if len(args) <= at and kwargs.get("w") is None:
            kwargs["w"] = series()
        return fn(*args, **kwargs)

    return call


def roll(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def past(w: WindowSpec, n: int) -> WindowSpec:
    """The n rows before the current one."""
    return w.rowsBetween(-n, -1)


def cum(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def full(agg: Callable[[Column], Column], x: Column | str, n: int, w: WindowSpec, min_count: int | None = None) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    frame = roll(w, n)
    return F.when(F.count(x).over(frame) >= (n if min_count is None else min_count), agg(x).over(frame))


def change(x: Column | str, k: int, w: WindowSpec) -> Column:
    """x / x k rows ago - 1."""
    x = F.col(x) if isinstance(x, str) else x
    return F.try_divide(x, F.lag(x, k).over(w)) - 1


def ahead(x: Column | str, k: int, w: WindowSpec) -> Column:
    """x k rows ahead / x - 1."""
    x = F.col(x) if isinstance(x, str) else x
    return F.try_divide(F.lead(x, k).over(w), x) - 1


def first_turn(position: Column | str, w: WindowSpec) -> Column:
    """Absolute change of a position; the first bar pays for its whole position."""
    p = F.col(position) if isinstance(position, str) else position
    return F.coalesce(F.abs(p - F.lag(p).over(w)), F.abs(p))


def average_rank(x: Column | str, *partition: str) -> Column:
    """Rank from 1 with ties at their mean; null for null."""
    x = F.col(x) if isinstance(x, str) else x
    by = Window.partitionBy(*partition, x.isNull()) if partition else Window.partitionBy(x.isNull())
    same = Window.partitionBy(*partition, x)
    return F.when(x.isNotNull(), F.rank().over(by.orderBy(x)) + (F.count(F.lit(1)).over(same) - 1) / 2)


def sample_skewness(x: Column | str) -> Column:
    """Bias-corrected skewness of a group; null below three values or without spread."""
    x = F.col(x) if isinstance(x, str) else x
    n = F.count(x).cast("double")
    return F.when((n >= 3) & (F.stddev_pop(x) > 0), F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function (Abramowitz and Stegun 26.2.17, error below 7.5e-8)."""
    t = 1 / (1 + 0.2316419 * F.abs(x))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) / F.lit(2.5066282746310002) * poly
    return F.when(x >= 0, 1 - tail).otherwise(tail)
