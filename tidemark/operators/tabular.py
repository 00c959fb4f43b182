"""Train-fitted preparation of labelled tables: clipping, scaling, encoding, splitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.statistics import tukey_fences


def clip(df: DataFrame, params: DataFrame, columns: list[str]) -> DataFrame:
    """Columns limited to fitted fences (one row with name_lo, name_hi)."""
    out = df.crossJoin(F.broadcast(params))
    return out.withColumns({c: F.least(F.greatest(F.col(c).cast("double"), F.col(f"{c}_lo")), F.col(f"{c}_hi")) for c in columns}).drop(*[f"{c}_{s}" for c in columns for s in ("lo", "hi")])


def fences(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*[x.alias(f"{c}_{s}") for c in columns for x, s in zip(tukey_fences(c), ("lo", "hi"), strict=True)])


def log_clip(df: DataFrame, fitted_on: DataFrame, column: str) -> DataFrame:
    """A right-skewed column limited on the log scale to the upper fence of the fitting rows."""
    shown = F.log1p(F.greatest(F.col(column).cast("double"), F.lit(0.0)))
    top = fitted_on.select(shown.alias("_l")).agg(tukey_fences("_l")[1].alias("_top"))
    return df.crossJoin(F.broadcast(top)).withColumn(column, F.expm1(F.least(F.greatest(shown, F.lit(0.0)), F.col("_top")))).drop("_top")


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """(value, code): categories numbered from 0 in sorted order; null is the text None."""
    values = df.select(F.coalesce(F.col(column).cast("string"), F.lit("None")).alias("value")).distinct()
    return values.withColumn("code", (F.row_number().over(Window.orderBy("value")) - 1).cast("double"))


def frequency_codes(df: DataFrame, column: str) -> DataFrame:
    """(value, code): the share of rows of each category."""
    values = df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("None")).alias("value")).agg(F.count("*").alias("n"))
    return values.select("value", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("code"))


def encode(df: DataFrame, codes: DataFrame, column: str, whole: bool = True) -> DataFrame:
    """Codes in place of categories; unseen ones get the median code, truncated to an integer if whole."""
    middle = codes.agg(F.percentile("code", F.lit(0.5)).alias("_m"))
    out = df.join(F.broadcast(codes), F.coalesce(F.col(column).cast("string"), F.lit("None")) == F.col("value"), "left").crossJoin(F.broadcast(middle))
    code = F.coalesce("code", "_m")
    return out.withColumn(column, code.cast("long") if whole else code).drop("value", "code", "_m")


def standard_scale(df: DataFrame, columns: list[str], fitted_on: DataFrame) -> DataFrame:
    """(x - mean) / population deviation of the fitting rows."""
    params = fitted_on.agg(*[f(c).alias(f"{c}{s}") for c in columns for f, s in ((F.avg, "_m"), (F.stddev_pop, "_s"))])
    return df.crossJoin(F.broadcast(params)).withColumns({c: F.try_divide(F.col(c) - F.col(f"{c}_m"), F.col(f"{c}_s")) for c in columns}).drop(*[f"{c}{s}" for c in columns for s in ("_m", "_s")])


def stratified_split(df: DataFrame, label: str, key: str, share: float = 0.8) -> DataFrame:
    """split train / test with the label's shares kept; rows are ordered by a hash of the key, so the split is stable."""
    order = Window.partitionBy(label).orderBy(F.md5(F.col(key).cast("string")), key)
    place, n = F.row_number().over(order), F.count(F.lit(1)).over(Window.partitionBy(label))
    return df.withColumn("_p", place).withColumn("_n", n).withColumn("split", F.when(F.col("_p") <= F.floor(F.col("_n") * share), "train").otherwise("test")).drop("_p", "_n")


def expanding_folds(n_splits: int, place: Column, n: Column) -> Column:
    """Fold (1..n_splits) that tests a row in chronological cross-validation, 0 for the first training block."""
    size = F.floor(n / (n_splits + 1))
    return F.greatest(F.lit(0), F.floor((place - (n - n_splits * size)) / size) + 1).cast("int")


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    return df.groupBy(label, predicted).agg(F.count("*").alias("n"))


#: Ordinal levels of two category columns; unknown levels count as 1.
COURSE_LEVELS = {"Beginner": 1, "Intermediate": 2, "Advanced": 3}
EXPERIENCE_LEVELS = {"Fresher": 1, "Student": 2, "Working Professional": 3}


def level(column: str, levels: dict[str, int]) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in levels.items() for x in pair]), F.col(column)), F.lit(1))


def _per(column: str, stat: str) -> Column:
    """A column per fitted statistic, which counts as 1 at least."""
    return F.col(column) / F.greatest(F.coalesce(F.col(stat).cast("double"), F.lit(1.0)), F.lit(1.0))


def derived() -> dict[str, tuple[list[str], Column, int]]:
    """Derived features: the columns each needs, its expression over them and the fitted statistics, its digits."""
    c = F.col
    return {
        "engagement_score": (["Login_Frequency", "Discussion_Participation", "Assignments_Submitted"], 0.3 * _per("Login_Frequency", "_max_login") + 0.3 * _per("Discussion_Participation", "_max_discuss") + 0.4 * _per("Assignments_Submitted", "_max_assign"), 3),
        "efficiency": (["Quiz_Score_Avg", "Progress_Percentage"], F.coalesce(c("Quiz_Score_Avg") * c("Progress_Percentage") / 10_000, F.lit(0.0)), 3),
        "instructor_level_interaction": (["Instructor_Rating", "Course_Level"], c("Instructor_Rating") * level("Course_Level", COURSE_LEVELS), 3),
        "total_session_time": (["Average_Session_Duration_Min", "Login_Frequency"], c("Average_Session_Duration_Min") * c("Login_Frequency"), 2),
        "video_quiz_alignment": (["Video_Completion_Rate", "Quiz_Score_Avg"], c("Video_Completion_Rate") * c("Quiz_Score_Avg") / 10_000, 3),
        "time_invested": (["Hours_Spent_Per_Week", "Course_Duration_Weeks"], c("Hours_Spent_Per_Week") * c("Course_Duration_Weeks"), 2),
        "completion_satisfaction_alignment": (["Completion_Percentage", "Satisfaction_Score"], c("Completion_Percentage") * c("Satisfaction_Score") / 500, 3),
        "workload_alignment": (["Experience_Level", "Hours_Spent_Per_Week"], _per("Hours_Spent_Per_Week", "_avg_hours") * level("Experience_Level", EXPERIENCE_LEVELS), 3),
        "engagement_intensity": (["Completion_Percentage", "Hours_Spent_Per_Week"], _per("Completion_Percentage", "_avg_completion") * _per("Hours_Spent_Per_Week", "_avg_hours"), 3),
        "video_per_chapter": (["nplay_video", "nchapters"], c("nplay_video") / (c("nchapters") + 1), 3),
        "forum_per_day": (["nforum_posts", "ndays_act"], c("nforum_posts") / (c("ndays_act") + 1), 3),
        "participation_ratio": (["nplay_video", "nforum_posts", "nevents"], (c("nplay_video") + c("nforum_posts")) / (c("nevents") + 1), 3),
    }


def enrich(df: DataFrame, fitted_on: DataFrame) -> DataFrame:
    """df with every derived feature whose columns it has; statistics come from the fitting rows, as one row."""
    wanted = {"_max_login": (F.max, "Login_Frequency"), "_max_discuss": (F.max, "Discussion_Participation"), "_max_assign": (F.max, "Assignments_Submitted"), "_avg_hours": (F.avg, "Hours_Spent_Per_Week"), "_avg_completion": (F.avg, "Completion_Percentage")}
    stats = fitted_on.agg(*[(f(c) if c in fitted_on.columns else F.lit(None).cast("double")).alias(name) for name, (f, c) in wanted.items()], F.count(F.lit(1)).alias("_n"))
    have = set(df.columns)
    made = {name: F.bround(expr.cast("double"), digits) for name, (needs, expr, digits) in derived().items() if have >= set(needs)}
    return df.crossJoin(F.broadcast(stats)).withColumns(made).drop(*wanted, "_n")
