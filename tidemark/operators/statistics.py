"""Information coefficients, event studies and distribution facts as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.rolling import average_rank, sample_skewness


def long_factors(df: DataFrame, ids: list[str], factors: list[str]) -> DataFrame:
    return df.unpivot(ids, factors, "factor", "value")


def ic_table(df: DataFrame, factors: list[str], target: str) -> DataFrame:
    """pearson, clipped (factor limited to its 5-95 % range) and spearman IC of every factor, and n_obs."""
    rows = long_factors(df.where(F.col(target).isNotNull()), [target], factors).where("value is not null")
    w = Window.partitionBy("factor")
    low, high = F.percentile("value", F.lit(0.05)).over(w), F.percentile("value", F.lit(0.95)).over(w)
    rows = rows.withColumns({"_clip": F.greatest(F.least("value", high), low), "_rv": average_rank("value", "factor"), "_rt": average_rank(target, "factor")})
    return rows.groupBy("factor").agg(F.corr("value", target).alias("pearson_ic"), F.corr("_clip", target).alias("clipped_ic"), F.corr("_rv", "_rt").alias("spearman_ic"), F.count("*").alias("n_obs"))


def top_factors(ics: DataFrame, n_rows: int, k: int = 5, least: int = 1000) -> DataFrame:
    """The k factors of largest |clipped| (else |pearson|) IC among those with enough rows, or among all if none has."""
    scored = ics.withColumn("score", F.coalesce(F.abs("clipped_ic"), F.abs("pearson_ic"))).where("score is not null")
    scored = scored.withColumn("_ok", F.col("n_obs") >= max(least, n_rows // 5)).withColumn("_any", F.max("_ok").over(Window.partitionBy()))
    best = scored.where("_ok or not _any").orderBy(F.col("score").desc(), "factor").limit(k)
    rank = F.row_number().over(Window.orderBy(F.col("score").desc(), "factor"))
    return best.select(rank.cast("long").alias("rank"), "factor", "score", F.when(F.col("pearson_ic") < 0, -1).otherwise(1).cast("long").alias("direction"))


def rank_ic(df: DataFrame, x: str, y: str, keys: list[str], least: int = 3) -> DataFrame:
    """Spearman correlation by key of the rows that have both, null with fewer than least rows; ranks are within the key."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    rows = rows.withColumns({"_rx": average_rank(x, *keys), "_ry": average_rank(y, *keys)})
    return rows.groupBy(*keys).agg(F.when(F.count("*") >= least, F.corr("_rx", "_ry")).alias("ic"), F.count("*").alias("n"))


def ic_summary(monthly: DataFrame) -> DataFrame:
    """Mean, population deviation and ratio of monthly ICs; deviation and ratio need more than one month."""
    many = F.count("ic") > 1
    out = monthly.agg(F.avg("ic").alias("mean_ic"), F.when(many, F.stddev_pop("ic")).alias("std_ic"), F.count("ic").alias("months"))
    return out.withColumn("ir", F.try_divide("mean_ic", "std_ic"))


def weighted_mean(values: list[tuple[Column, float]]) -> Column:
    """Mean of the values that exist, by their weights."""
    top = sum((F.coalesce(c * w, F.lit(0.0)) for c, w in values), F.lit(0.0))
    return F.try_divide(top, sum((F.when(c.isNotNull(), w).otherwise(0.0) for c, w in values), F.lit(0.0)))


def quantile_bin(df: DataFrame, x: str, bins: int, out: str = "bin") -> DataFrame:
    """Bin by value edges (linear quantiles, right-closed); no rows if edges coincide."""
    edges = df.agg(F.percentile(x, F.array(*[F.lit(i / bins) for i in range(bins + 1)])).alias("_e"))
    rows = df.where(F.col(x).isNotNull()).crossJoin(F.broadcast(edges)).where(F.size(F.array_distinct("_e")) == bins + 1)
    place = sum(((F.col(x) > F.get("_e", F.lit(i))).cast("int") for i in range(1, bins)), F.lit(1))
    return rows.withColumn(out, place.cast("long")).drop("_e")


#: Upper ends of the value ranges that name a column, in the order of the rules.
RANGES = ((1, "ratio"), (5, "rating"), (6, "weekday"), (30, "date"), (11, "month"), (100, "percentage"))


def kinds_of(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, distribution, cardinality: rules on range first (in this order), then on distinct values and skew."""
    facts = [
        F.struct(F.lit(c).alias("column"), F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi"), sample_skewness(F.col(c).cast("double")).alias("skew"), F.count_distinct(c).alias("distinct"), F.count(c).alias("n"), F.lit(dict(df.dtypes)[c] in ("int", "bigint")).alias("whole"))
        for c in columns
    ]
    rows = df.agg(F.array(*facts).alias("f")).select(F.explode("f").alias("f")).select("f.*")
    lo, hi, d, ratio = F.col("lo"), F.col("hi"), F.col("distinct"), F.try_divide("distinct", "n")
    dist = F.when(F.col("whole") & (ratio < 0.15), "discrete").when(F.col("skew") > 1, "right_skewed").when(F.abs("skew") < 0.5, "normal").otherwise("general")
    dist = F.when((lo >= 1990) & (hi <= 2100), "year").otherwise(dist)
    for top, name in reversed(RANGES):
        dist = F.when((lo >= 0) & (hi <= top), name).otherwise(dist)
    card = F.when(d <= 10, "low").when((d <= 50) & (ratio < 0.85), "medium").otherwise("high")
    return rows.withColumns({"distribution": dist, "cardinality": card})


def tukey_fences(x: str, k: float = 1.5) -> tuple[Column, Column]:
    q1, q3 = F.percentile(x, F.lit(0.25)), F.percentile(x, F.lit(0.75))
    return q1 - k * (q3 - q1), q3 + k * (q3 - q1)


def feature_gap(df: DataFrame, label: str, features: list[str], least: float = 0.02) -> DataFrame:
    """|mean of label 0 - mean of label 1| / deviation of every feature that exceeds least."""
    rows = long_factors(df, [label], features)
    out = rows.groupBy("factor").agg(F.try_divide(F.abs(F.avg(F.when(F.col(label) == 0, F.col("value"))) - F.avg(F.when(F.col(label) == 1, F.col("value")))), F.stddev_samp("value")).alias("gap"))
    return out.where(F.col("gap") > least)


def f_statistic(df: DataFrame, label: str, features: list[str]) -> DataFrame:
    """One-way ANOVA F of every feature over the label's groups."""
    rows = long_factors(df, [label], features).where("value is not null")
    groups = rows.groupBy("factor", label).agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    w = Window.partitionBy("factor")
    groups = groups.withColumn("_all", F.sum(F.col("n") * F.col("m")).over(w) / F.sum("n").over(w))
    out = groups.groupBy("factor").agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("_all"), 2)).alias("between"), F.sum(F.col("n") * F.col("v")).alias("within"), F.count("*").alias("k"), F.sum("n").alias("n"))
    return out.withColumn("f", F.try_divide(F.col("between") / (F.col("k") - 1), F.col("within") / (F.col("n") - F.col("k"))))


def mutual_information(df: DataFrame, label: str, features: list[str], bins: int = 10) -> DataFrame:
    """Mutual information in nats of the label and each feature cut at its quantiles (a binned estimate)."""
    rows = long_factors(df, [label], features).where("value is not null")
    w = Window.partitionBy("factor")
    edges = F.percentile("value", F.array(*[F.lit(i / bins) for i in range(1, bins)])).over(w)
    rows = rows.withColumn("_e", edges).withColumn("_bin", F.aggregate("_e", F.lit(0), lambda a, e: a + (F.col("value") > e).cast("int")))
    cells = rows.groupBy("factor", "_bin", label).agg(F.count("*").alias("n"))
    cells = cells.withColumns({"_row": F.sum("n").over(Window.partitionBy("factor", "_bin")), "_col": F.sum("n").over(Window.partitionBy("factor", label)), "_all": F.sum("n").over(w)})
    p = F.col("n") / F.col("_all")
    return cells.groupBy("factor").agg(F.sum(p * F.log(p * F.col("_all") * F.col("_all") / (F.col("_row") * F.col("_col")))).alias("mi"))


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve by average ranks (ties count half)."""
    rows = df.withColumn("_r", average_rank(score))
    pos, neg = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    return rows.agg(F.try_divide(F.sum(F.when(F.col(label) == 1, F.col("_r"))) - pos * (pos + 1) / 2, pos * neg).alias("auc"))


def redundant_pairs(df: DataFrame, columns: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Pairs (a, b) of columns that are correlated to +-1 or map one to one, from one aggregate."""
    facts = []
    for i, a in enumerate(columns):
        for b in columns[i + 1 :]:
            facts.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.abs(F.corr(a, b)).alias("r"), F.count_distinct(F.struct(a, b)).alias("both"), F.count_distinct(a).alias("da"), F.count_distinct(b).alias("db")))
    rows = df.agg(F.array(*facts).alias("f")).select(F.explode("f").alias("f")).select("f.*")
    return rows.where((F.col("r") > 1 - tolerance) | ((F.col("both") == F.col("da")) & (F.col("both") == F.col("db"))))


def keep_first(columns: list[str], pairs: list[tuple[str, str]]) -> list[str]:
    """Greedy choice: a column goes if an earlier kept one makes it redundant."""
    kept: list[str] = []
    for c in columns:
        if not any((k, c) in pairs or (c, k) in pairs for k in kept):
            kept.append(c)
    return kept
