"""Tree ensembles and their studies on the cube of binned features.

Rows in one cell (a bin of every feature) get one prediction, so the rows and positives of the cells, by time block,
are all that a fit needs. Spark counts the cells in one aggregate; the cube has at most CELLS cells whatever the number
of rows and travels to the tasks, one configuration each. Bins make trees approximate, as in any histogram method;
samples without replacement are binomial draws from a cell's counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELLS = 1 << 16
BLOCKS_A_FOLD = 20


@dataclass
class Cube:
    """bins (cells x features), and rows and positives (blocks x cells)."""

    features: list[str]
    bins: np.ndarray
    rows: np.ndarray
    positives: np.ndarray

    def part(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and positives of the cells in blocks first..last - 1."""
        return self.rows[first:last].sum(axis=0), self.positives[first:last].sum(axis=0)


def edges(df: DataFrame, columns: list[str], parts: int) -> dict[str, list[float]]:
    """Distinct approximate quantiles of every column."""
    at = [i / parts for i in range(1, parts)]
    row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), at, 100_000).alias(c) for c in columns]).first()
    return {c: sorted(set(row[c] or [])) for c in columns}


def binned(df: DataFrame, cuts: dict[str, list[float]], prefix: str = "_bin_") -> DataFrame:
    """df with the number of cuts below the value of every column plus one; 0 for null."""
    number = lambda c: F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), 0).otherwise(sum(((F.col(c) > x).cast("int") for x in cuts[c]), F.lit(1)))
    return df.withColumns({prefix + c: number(c).cast("int") for c in cuts})


def cube(df: DataFrame, features: list[str], label: str, block: str, blocks: int, cuts: dict[str, list[float]]) -> Cube:
    """The cube of df; block is a column of numbers from 0 to blocks - 1."""
    names = [f"_bin_{c}" for c in features]
    counts = binned(df.where(F.col(label).isNotNull()), cuts).groupBy(block, *names).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("p"))
    found = counts.limit(blocks * CELLS + 1).toArrow()
    keys = np.stack([found.column(c).to_numpy() for c in names], axis=1) if names else np.empty((found.num_rows, 0))
    cells, at = np.unique(keys, axis=0, return_inverse=True)
    if len(cells) > CELLS:
        raise ValueError(f"{len(cells)} cells; use fewer bins or features")
    rows, positives = np.zeros((blocks, len(cells)), np.int64), np.zeros((blocks, len(cells)), np.int64)
    where = (found.column(block).to_numpy(), at.reshape(-1))
    np.add.at(rows, where, found.column("n").to_numpy())
    np.add.at(positives, where, found.column("p").to_numpy())
    return Cube(features, cells, rows, positives)


def time_cube(df: DataFrame, features: list[str], label: str, order: str, folds: int = 5, bins: int = 16) -> Cube:
    """The cube over (folds + 1) * BLOCKS_A_FOLD blocks of about equal size in time, for expanding folds."""
    blocks = (folds + 1) * BLOCKS_A_FOLD
    cuts = edges(df, [order], blocks)
    placed = binned(df, cuts).withColumn("_block", F.greatest(F.col(f"_bin_{order}") - 1, F.lit(0)))
    return cube(placed, features, label, "_block", blocks, edges(df, features, bins))


def grow(x: np.ndarray, n: np.ndarray, g: np.ndarray, depth: int, leaf: float, tries: int | None = None, rng=None) -> tuple[np.ndarray, np.ndarray]:
    """The leaf of every cell, and each feature's gain, in a tree that parts the means of g / n; tries: features looked at in a split."""
    node, gains, leaves = np.zeros(len(x), np.int64), np.zeros(x.shape[1]), 1
    todo = [(0, np.arange(len(x)), 0)]
    while todo:
        at, cells, level = todo.pop()
        best = (1e-12, -1, 0)
        total_n, total_g = n[cells].sum(), g[cells].sum()
        if level < depth and total_n >= 2 * leaf:
            looked = range(x.shape[1]) if tries is None else rng.choice(x.shape[1], min(tries, x.shape[1]), replace=False)
            for j in looked:
                left_n, left_g = (np.cumsum(np.bincount(x[cells, j], weights=v[cells]))[:-1] for v in (n, g))
                ok = (left_n >= leaf) & (total_n - left_n >= leaf)
                if ok.any():
                    a, b = left_n[ok], left_g[ok]
                    gain = b**2 / a + (total_g - b) ** 2 / (total_n - a) - total_g**2 / total_n
                    i = int(np.argmax(gain))
                    if gain[i] > best[0]:
                        best = (gain[i], int(j), int(np.flatnonzero(ok)[i]))
        if best[1] < 0:
            continue
        gains[best[1]] += best[0]
        right = x[cells, best[1]] > best[2]
        node[cells[right]] = leaves
        todo += [(at, cells[~right], level + 1), (leaves, cells[right], level + 1)]
        leaves += 1
    return node, gains


def boost(x: np.ndarray, rows: np.ndarray, positives: np.ndarray, rounds: int, rate: float, depth: int, leaf: float, subsample: float, positive: float = 1.0, seed: int = 42) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Log odds of every cell and gains of the features after each round of boosting a logistic loss; positive weighs label 1."""
    rng = np.random.default_rng(seed)
    p, q = positives, rows - positives
    start = math.log(max(positive * p.sum(), 1e-9) / max(q.sum(), 1e-9))
    score, gains = np.full(len(x), start), np.zeros(x.shape[1])
    for _ in range(rounds):
        a, b = (rng.binomial(p, subsample), rng.binomial(q, subsample)) if subsample < 1 else (p, q)
        prob = 1 / (1 + np.exp(-score))
        n, g = (a + b).astype(float), positive * a * (1 - prob) - b * prob
        h = (positive * a + b) * prob * (1 - prob)
        node, gain = grow(x, n, g, depth, leaf)
        gains += gain
        top, below = (np.bincount(node, weights=v) for v in (g, h))
        score = score + rate * np.where(below > 1e-12, top / np.maximum(below, 1e-12), 0.0)[node]
        yield score, gains


def forest(x: np.ndarray, rows: np.ndarray, positives: np.ndarray, trees: int, depth: int, leaf: float, positive: float = 1.0, seed: int = 42) -> np.ndarray:
    """Mean leaf share of label 1 over trees on bootstrap samples, the square root of the features looked at in a split."""
    rng = np.random.default_rng(seed)
    total, out = rows.sum(), np.zeros(len(x))
    share = np.concatenate([positives, rows - positives]) / max(1, total)
    for _ in range(trees):
        drawn = rng.multinomial(total, share)
        a, b = positive * drawn[: len(x)], drawn[len(x) :].astype(float)
        node, _ = grow(x, a + b, a, depth, leaf, max(1, math.isqrt(x.shape[1])), rng)
        top, below = np.bincount(node, weights=a), np.bincount(node, weights=a + b)
        out += np.where(below > 0, top / np.maximum(below, 1e-12), 0.5)[node]
    return out / trees


def auc(score: np.ndarray, rows: np.ndarray, positives: np.ndarray) -> float:
    """Area under the ROC curve of cells with counts; nan without both labels."""
    _, at = np.unique(score, return_inverse=True)
    p, q = np.bincount(at, weights=positives), np.bincount(at, weights=rows - positives)
    return float((p * (np.cumsum(q) - q / 2)).sum() / (p.sum() * q.sum())) if p.sum() and q.sum() else math.nan


def measures(score: np.ndarray, rows: np.ndarray, positives: np.ndarray) -> dict[str, float]:
    """AUC, and accuracy, precision, recall and F1 of log odds above 0."""
    yes = score > 0
    tp, fp, fn = positives[yes].sum(), (rows - positives)[yes].sum(), positives[~yes].sum()
    ratio = lambda a, b: float(a / b) if b else 0.0
    return {"auc": auc(score, rows, positives), "accuracy": ratio(rows.sum() - fp - fn, rows.sum()), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)}


def fold_parts(folds: int, share: float = 1.0) -> Iterator[tuple[int, tuple[int, int], tuple[int, int]]]:
    """Fold, blocks to train on (the most recent share of all before) and blocks to test, in time order."""
    for k in range(1, folds + 1):
        end = k * BLOCKS_A_FOLD
        yield k, (end - max(1, round(end * share)), end), (end, end + BLOCKS_A_FOLD)


def grid_search(spark, data: Cube, rounds: list[int], rates: list[float], depths: list[int], leaves: list[int], subsamples: list[float], folds: int = 5) -> DataFrame:
    """AUC of every configuration on every expanding fold; numbers of rounds share a fit. One task a fit."""
    sent = spark.sparkContext.broadcast(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cube_ = sent.value
        for batch in batches:
            out = []
            for c in batch.to_pylist():
                for k, train, test in fold_parts(folds):
                    if k != c["fold"]:
                        continue
                    stages = boost(cube_.bins, *cube_.part(*train), max(rounds), c["rate"], c["depth"], c["leaf"], c["subsample"])
                    for i, (score, _) in enumerate(stages, 1):
                        if i in rounds:
                            out.append(c | {"rounds": i, "auc": auc(score, *cube_.part(*test))})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("rate", pa.float64()), ("depth", pa.int64()), ("leaf", pa.int64()), ("subsample", pa.float64()), ("fold", pa.int64()), ("rounds", pa.int64()), ("auc", pa.float64())]))

    configs = [(r, d, m, s, k) for r in rates for d in depths for m in leaves for s in subsamples for k in range(1, folds + 1)]
    grid = spark.createDataFrame(configs, "rate double, depth long, leaf long, subsample double, fold long").repartition(len(configs), "rate", "depth", "leaf", "subsample", "fold")
    return grid.mapInArrow(run, "rate double, depth long, leaf long, subsample double, fold long, rounds long, auc double")


def stability(data: Cube, params: dict, folds: int = 5) -> dict[str, dict[str, float]]:
    """For every measure mean and deviation over the folds' train and test parts, and the gap of the means."""
    seen: dict[str, list[tuple[float, float]]] = {}
    for _, train, test in fold_parts(folds):
        *_, (score, _) = boost(data.bins, *data.part(*train), **params)
        a, b = measures(score, *data.part(*train)), measures(score, *data.part(*test))
        for m in a:
            seen.setdefault(m, []).append((a[m], b[m]))
    out = {}
    for m, pairs in seen.items():
        v = np.array(pairs)
        out[m] = dict(zip(("train_mean", "test_mean", "train_std", "test_std"), [*np.nanmean(v, axis=0), *np.nanstd(v, axis=0)], strict=True))
        out[m]["gap"] = out[m]["train_mean"] - out[m]["test_mean"]
    return out


#: The bounds of the gap between train and test AUC and their names.
GAPS = ((0.02, "excellent"), (0.05, "acceptable"), (0.10, "concerning"), (math.inf, "severe"))


def gap_label(gap: float) -> str:
    return next(name for most, name in GAPS if gap < most)


def learning_curve(data: Cube, params: dict, shares: list[float], folds: int = 5) -> list[tuple[float, float, float, float, float, float]]:
    """share, mean rows, mean and deviation of train AUC, mean and deviation of test AUC, on the most recent share of each fold."""
    out = []
    for share in shares:
        scored, size = [], []
        for _, train, test in fold_parts(folds, share):
            *_, (score, _) = boost(data.bins, *data.part(*train), **params)
            scored.append((auc(score, *data.part(*train)), auc(score, *data.part(*test))))
            size.append(data.part(*train)[0].sum())
        v = np.array(scored)
        (a, b), (x, y) = np.nanmean(v, axis=0), np.nanstd(v, axis=0)
        out.append((share, float(np.mean(size)), float(a), float(x), float(b), float(y)))
    return out


def importance_stability(data: Cube, params: dict, folds: int = 5) -> list[tuple[str, float, float, float, float, bool]]:
    """feature, mean, deviation, least and greatest importance over the folds, and whether all are above 0."""
    shares = []
    for _, train, _ in fold_parts(folds):
        *_, (_, gains) = boost(data.bins, *data.part(*train), **params)
        shares.append(gains / gains.sum() if gains.sum() else gains)
    v = np.array(shares)
    return [(f, float(v[:, j].mean()), float(v[:, j].std()), float(v[:, j].min()), float(v[:, j].max()), bool(v[:, j].min() > 0)) for j, f in enumerate(data.features)]


def ensembles(df: DataFrame, features: list[str], label: str, trees: int = 300, tree_depth: int = 12, rounds: int = 600, bins: int = 16) -> DataFrame:
    """df with forest and boosting, probabilities of label 1 fitted on split = train with balanced classes, by cell."""
    cuts = edges(df.where("split = 'train'"), features, bins)
    data = cube(df.withColumn("_block", (F.col("split") != "train").cast("int")), features, label, "_block", 2, cuts)
    rows, positives = data.part(0, 1)
    weight = float((rows.sum() - positives.sum()) / max(1, positives.sum()))
    *_, (odds, _) = boost(data.bins, rows, positives, rounds, 0.05, 5, 1, 0.9, weight)
    shares = forest(data.bins, rows, positives, trees, tree_depth, 2, weight)
    names = [f"_bin_{c}" for c in features]
    cells = df.sparkSession.createDataFrame([(*map(int, b), float(f), float(1 / (1 + math.exp(-o)))) for b, f, o in zip(data.bins, shares, odds, strict=True)], ", ".join(f"{c} int" for c in names) + ", forest double, boosting double")
    return binned(df, cuts).join(F.broadcast(cells), names, "left").drop(*names)
