"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

Document evidence: a logistic model of a text's shape (shares of upper case, digits, symbols and white space,
words and their lengths, share of distinct words and word pairs, most frequent word) gives a log likelihood ratio. It is
fitted on at most SAMPLE labelled documents (least hash of the id; only their feature vectors reach the driver).

Sites: grouped sums over all documents give each host and each path of a host its number of documents and its
expected number of good ones. Path rates are shrunk toward their host's, host rates toward the global one, by
beta priors whose strengths are estimated from the spread between groups (method of moments). A document's
posterior odds are its own likelihood ratio times the prior odds of its path without itself.

Cases: null and empty texts have shape zero and are judged like any other; null hosts and paths are groups of
their own; without labels of both kinds the likelihood ratio is 1; null labels are not used, and a document
labelled twice counts as good only if every label says so; rows that repeat are judged each; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import kernel
from tidemark.llm.storage import written

SAMPLE = 20_000
FEATURES = 12
KIND = np.zeros(256, np.int64)  # 0 letter, 1 upper case, 2 digit, 3 symbol, 4 white space
KIND[[c for c in range(128) if not chr(c).isalnum()]] = 3
KIND[[c for c in range(256) if not kernel.IS_WORD[c]]] = 4
KIND[[*range(ord("A"), ord("Z") + 1)]] = 1
KIND[[*range(ord("0"), ord("9") + 1)]] = 2


def shapes(words: kernel.Words) -> np.ndarray:
    """The feature vector of every text."""
    out = np.zeros((len(words.rows), FEATURES))
    kinds = KIND[words.data]
    pairs = kernel.window_hashes(words.hash, 2)
    length = words.end - words.start
    for k in range(len(words.rows)):
        a, b = int(words.first[k]), int(words.first[k + 1])
        if a == b:
            continue
        chars = np.bincount(kinds[words.start[a] : words.end[b - 1]], minlength=5)
        n = b - a
        values, count = np.unique(words.hash[a:b], return_counts=True)
        out[k] = [
            1.0,
            chars[1] / chars.sum(),
            chars[2] / chars.sum(),
            chars[3] / chars.sum(),
            chars[4] / chars.sum(),
            math.log1p(n),
            length[a:b].mean() / 10,
            length[a:b].std() / 10,
            len(values) / n,
            count.max() / n,
            len(np.unique(pairs[a : b - 1])) / max(1, n - 1),
            float(n < 20),
        ]
    return out


def shaper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: shape in place of the text."""
    for batch in batches:
        parts = [shapes(w) for w in kernel.slices(batch.column("text"))]
        shape = np.concatenate(parts) if parts else np.zeros((0, FEATURES))
        column = pa.ListArray.from_arrays(pa.array(np.arange(len(shape) + 1, dtype=np.int32) * FEATURES), pa.array(shape.ravel()))
        yield pa.record_batch([*(batch.column(c) for c in ("doc_id", "host", "path")), column], names=["doc_id", "host", "path", "shape"])


def expanded(x: np.ndarray) -> np.ndarray:
    """Features, their squares and a constant, standardised by fixed ranges (they lie in about 0..1 but for lengths)."""
    return np.concatenate([np.ones((len(x), 1)), x, x**2], axis=1)


def fit(x: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by damped Newton steps; the constant is set to an even prior."""
    z = expanded(x)
    w = np.zeros(z.shape[1])
    if not len(good) or good.min() == good.max():
        return w
    weight = np.where(good == 1, 0.5 / good.mean(), 0.5 / (1 - good.mean()))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (weight * (good - p)) - 0.1 * w
        hess = (z * (weight * p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w += step * min(1.0, 4.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-7:
            break
    return w


def strength(rates: DataFrame, rate: str, prior: str, n: str) -> float:
    """Number of documents a beta prior is worth, from the spread of group rates around the prior's."""
    row = rates.where(F.col(n) > 0).agg(
        F.sum(F.col(n) * F.pow(F.col(rate) - F.col(prior), 2)).alias("spread"),
        F.sum(F.col(n)).alias("n"),
        F.sum(F.col(n) * F.col(prior) * (1 - F.col(prior))).alias("binomial"),
        F.count("*").alias("groups"),
    ).first()
    if not row["n"] or row["groups"] < 2 or not row["binomial"]:
        return 1.0
    # E[spread] = groups * v + n * tau with v the binomial variance and tau the variance between groups.
    v = row["binomial"] / row["n"]
    tau = max((row["spread"] - row["groups"] * v) / row["n"], 0.0)
    return min(1e6, max(1.0, v / tau - 1)) if tau > 0 else 1e6


def odds(p: Column) -> Column:
    p = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), p))
    return F.log(p / (1 - p))


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", good: str = "quality", least: float = 0.5) -> DataFrame:
    """doc_id, evidence (log likelihood ratio), site_rate, score (posterior) and keep of every row."""
    kinds = dict(docs.dtypes)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), F.col(path).alias("path"), F.col(text).alias("text"))
    shaped = written(rows.mapInArrow(shaper, f"doc_id {kinds[doc_id]}, host {kinds[host]}, path {kinds[path]}, shape array<double>"), "shapes")
    known = labels.where(F.col(good).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(F.min(good).cast("int").alias("good"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    found = shaped.join(F.broadcast(sample), "doc_id").orderBy("doc_id").select("shape", "good").toArrow()
    x = np.array(found.column("shape").to_pylist(), dtype=float).reshape(-1, FEATURES)
    y = found.column("good").to_numpy().astype(float)
    weights = fit(x, y)
    share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
    base = math.log(share / (1 - share))
    term = lambda i: F.get("shape", F.lit(i))
    evidence = F.lit(float(weights[0]))
    for i in range(FEATURES):
        evidence = evidence + term(i) * float(weights[1 + i]) + term(i) * term(i) * float(weights[1 + FEATURES + i])
    scored = shaped.select("doc_id", "host", "path", F.greatest(F.lit(-12.0), F.least(F.lit(12.0), evidence)).alias("evidence"))
    scored = scored.withColumn("p", 1 / (1 + F.exp(-(F.col("evidence") + base))))

    paths = written(scored.groupBy("host", "path").agg(F.sum("p").alias("good"), F.count("*").alias("n")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("good").alias("host_good"), F.sum("n").alias("host_n"))
    total = hosts.agg(F.sum("host_good"), F.sum("host_n")).first()
    overall = float(np.clip((total[0] or 0.0) / max(1, total[1] or 0), 1e-4, 1 - 1e-4))
    hosts = hosts.withColumn("overall", F.lit(overall))
    at_host = strength(hosts.withColumn("rate", F.col("host_good") / F.col("host_n")), "rate", "overall", "host_n")
    hosts = hosts.withColumn("host_rate", (F.col("host_good") + at_host * overall) / (F.col("host_n") + at_host))
    both = paths.join(hosts.select(F.col("host").alias("host_"), "host_rate"), F.col("host").eqNullSafe(F.col("host_")))
    at_path = strength(both.withColumn("rate", F.col("good") / F.col("n")), "rate", "host_rate", "n")
    sites = both.select(F.col("host").alias("host_"), F.col("path").alias("path_"), "good", "n", "host_rate")
    out = scored.join(sites, F.col("host").eqNullSafe(F.col("host_")) & F.col("path").eqNullSafe(F.col("path_")))
    rate = (F.col("good") - F.col("p") + at_path * F.col("host_rate")) / (F.col("n") - 1 + at_path)
    out = out.withColumn("site_rate", rate)
    out = out.withColumn("score", 1 / (1 + F.exp(-(F.col("evidence") + odds(F.col("site_rate"))))))
    return out.select(F.col("doc_id").alias(doc_id), "evidence", "site_rate", "score", (F.col("score") >= least).alias("keep"))
