"""Causal position rules on a signal's z-score, as window expressions.

A rule that either fixes the position or keeps it needs no fold: the position is the last one that was fixed.
The position of a bar follows the z-score of the bar before; a missing z-score keeps the position.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.rolling import cum, series

#: A rule maps lagged z-scores to a position, or null to keep the one before.
Rule = Callable[..., Column]


def baseline(buy: Column | float, sell: Column | float) -> Rule:
    return lambda z: F.when(z < buy, 1.0).when(z > sell, 0.0)


def hysteresis(buy: Column | float, sell: Column | float) -> Rule:
    """The same map as baseline while buy < sell."""
    return baseline(buy, sell)


def default_long(buy: Column | float, sell: Column | float) -> Rule:
    """As baseline; differs only in the first position (use initial 1)."""
    return lambda z: F.when(z > sell, 0.0).when(z < buy, 1.0)


def continuous(cold: Column | float, hot: Column | float) -> Rule:
    def rule(z: Column) -> Column:
        edge = cold if isinstance(cold, Column) else F.lit(float(cold))
        return F.when(z > hot, 0.0).when(z <= edge, F.least(F.greatest((-z - F.abs(edge)) / 2, F.lit(0.0)), F.lit(1.0)))

    return rule


def both_to_enter(buy: Column | float, sell: Column | float) -> Rule:
    """Two signals: both cold to enter, either hot to leave (also the minimum of two baseline rules)."""
    return lambda z1, z2: F.when((z1 > sell) | (z2 > sell), 0.0).when((z1 < buy) & (z2 < buy), 1.0)


#: The thresholds of the named rules.
RULES: dict[str, Rule] = {"baseline": baseline(-1.0, 1.0), "hysteresis": hysteresis(-1.5, 0.5), "continuous": continuous(-1.0, 1.0)}


def hold(df: DataFrame, rule: Rule, z: list[str], key: list[str], order: str, initial: Column | float = 0.0, out: str = "position") -> DataFrame:
    """df with the position of a rule on the z-scores of the bar before."""
    w = series(key, order)
    df = df.withColumns({f"_z{i}": F.lag(c).over(w) for i, c in enumerate(z)})
    known = [F.col(f"_z{i}") for i in range(len(z))]
    fixed = rule(*known)
    for c in known:
        fixed = F.when(c.isNotNull(), fixed)
    df = df.withColumn("_fixed", fixed)
    return df.withColumn(out, F.coalesce(F.last("_fixed", ignorenulls=True).over(cum(w)), (initial if isinstance(initial, Column) else F.lit(float(initial))))).drop("_fixed", *[f"_z{i}" for i in range(len(z))])
