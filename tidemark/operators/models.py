"""Signal combination and classifiers.

Linear and ridge models are closed forms on moment sums; trees and ensembles use pyspark.ml, whose split search
is binned, so their numbers approximate exact-split libraries.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import boosting


def ic_weights(df: DataFrame, features: list[str], target: str, keep_sign: bool = True) -> dict[str, float]:
    """Correlations with the target over the train split, scaled to absolute sum 1; equal weights if all are zero."""
    row = df.where("split = 'train'").agg(*[F.corr(c, target).alias(c) for c in features]).first()
    raw = {c: (row[c] or 0.0) if keep_sign else max(0.0, row[c] or 0.0) for c in features}
    total = sum(map(abs, raw.values()))
    return {c: v / total for c, v in raw.items()} if total else dict.fromkeys(features, 1 / len(features))


def ridge(df: DataFrame, features: list[str], target: str, penalty: float = 0.0, intercept: bool = False) -> dict[str, float]:
    """Coefficients (and const) of the train split from one aggregate of moments; the penalty spares the intercept."""
    value = lambda c: F.col(c).cast("double")
    names = [*features, target]
    sums = df.where("split = 'train'").na.drop(subset=names).agg(F.count("*").alias("n"), *[F.sum(value(a)).alias(f"s_{a}") for a in names], *[F.sum(value(a) * value(b)).alias(f"p_{a}_{b}") for i, a in enumerate(names) for b in names[i:]])
    r = sums.first()
    n = max(1, r["n"])
    pair = lambda a, b: r[f"p_{a}_{b}"] if f"p_{a}_{b}" in r.asDict() else r[f"p_{b}_{a}"]
    centre = (lambda a, b: pair(a, b) - r[f"s_{a}"] * r[f"s_{b}"] / n) if intercept else pair
    xx = np.array([[centre(a, b) for b in features] for a in features]) + penalty * np.eye(len(features))
    beta = np.linalg.lstsq(xx, np.array([centre(a, target) for a in features]), rcond=None)[0]
    out = dict(zip(features, beta.tolist(), strict=True))
    return out | {"const": (r[f"s_{target}"] - sum(beta[i] * r[f"s_{a}"] for i, a in enumerate(features))) / n if intercept else 0.0}


def linear_score(df: DataFrame, weights: dict[str, float], out: str) -> DataFrame:
    return df.withColumn(out, sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in weights.items() if c != "const"), F.lit(weights.get("const", 0.0))))


def tree_score(df: DataFrame, features: list[str], target: str, out: str, depth: int = 3, leaf: int = 100) -> DataFrame:
    made = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="skip").transform(df)
    model = DecisionTreeRegressor(featuresCol="_x", labelCol=target, predictionCol=out, maxDepth=depth, minInstancesPerNode=leaf, maxBins=256, seed=42)
    return model.fit(made.where("split = 'train'").na.drop(subset=[target])).transform(made).drop("_x")


def combined_signals(df: DataFrame, features: list[str], target: str, penalty: float = 20.0) -> DataFrame:
    """equal_weight, ic_weight, linear, ridge and tree scores of standardised features (train moments)."""
    df = df.withColumn("equal_weight", sum((F.col(c) for c in features), F.lit(0.0)) / len(features))
    df = linear_score(df, ic_weights(df, features, target), "ic_weight")
    df = linear_score(df, ridge(df, features, target), "linear")
    df = linear_score(df, ridge(df, features, target, penalty, intercept=True), "ridge")
    return tree_score(df, features, target, "tree")


def classifiers(trees: int = 300, rounds: int = 100) -> dict:
    """The three classifiers of the comparison; weights balance the classes."""
    shared = {"featuresCol": "features", "labelCol": "label", "weightCol": "weight"}
    return {
        "logistic": LogisticRegression(maxIter=200, **shared),
        "forest": RandomForestClassifier(numTrees=trees, maxDepth=8, minInstancesPerNode=2, featureSubsetStrategy="sqrt", seed=42, **shared),
        "boosting": GBTClassifier(maxIter=rounds, stepSize=0.05, maxDepth=5, subsamplingRate=0.9, seed=42, **shared),
    }


def classify(df: DataFrame, features: list[str], label: str, models: dict) -> DataFrame:
    """Rows with the probability of label 1 by every model and by their mean (soft vote); fitted on split = train."""
    data = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(df.withColumn("label", F.col(label).cast("double")))
    shares = data.where("split = 'train'").agg(F.count("*").alias("n"), F.sum("label").alias("p")).first()
    positive, n = shares["p"] or 0.0, shares["n"] or 0
    data = data.withColumn("weight", F.when(F.col("label") == 1, n / (2 * max(1.0, positive))).otherwise(n / (2 * max(1.0, n - positive))))
    for name, model in models.items():
        data = model.fit(data.where("split = 'train'")).transform(data).withColumn(name, vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")
    return data.withColumn("vote", sum((F.col(m) for m in models), F.lit(0.0)) / len(models)).drop("features")


def classify_all(df: DataFrame, features: list[str], label: str, trees: int = 300, depth: int = 12, rounds: int = 600) -> DataFrame:
    """logistic, forest, boosting and their mean (vote): the ensembles at full size on the cube of binned features."""
    logistic = classify(df, features, label, {"logistic": classifiers()["logistic"]})
    scored = boosting.ensembles(logistic, features, label, trees, depth, rounds)
    return scored.withColumn("vote", (F.col("logistic") + F.col("forest") + F.col("boosting")) / 3)


def importances(df: DataFrame, features: list[str], label: str, top: int = 15, rounds: int = 20) -> list[tuple[str, float]]:
    """Features by importance in a boosted ensemble on the train split."""
    data = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(df.withColumn("label", F.col(label).cast("double")))
    model = GBTClassifier(maxIter=rounds, maxDepth=3, seed=42).fit(data.where("split = 'train'"))
    return sorted(zip(features, model.featureImportances.toArray().tolist(), strict=True), key=lambda p: (-p[1], p[0]))[:top]


def threshold_scan(df: DataFrame, score: str, label: str, thresholds: list[float]) -> DataFrame:
    """Balanced accuracy at every threshold, best first; the lower threshold wins a tie."""
    grid = df.sparkSession.createDataFrame([(t,) for t in thresholds], "threshold double")
    hit = F.col(score) >= F.col("threshold")
    out = df.crossJoin(F.broadcast(grid)).groupBy("threshold").agg(F.avg(F.when(F.col(label) == 1, hit.cast("int"))).alias("tpr"), F.avg(F.when(F.col(label) == 0, (~hit).cast("int"))).alias("tnr"))
    return out.withColumn("balanced", (F.coalesce("tpr", F.lit(0.0)) + F.coalesce("tnr", F.lit(0.0))) / 2).orderBy(F.col("balanced").desc(), "threshold")
