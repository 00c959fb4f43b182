"""Exact top-k inner-product search over norm-bucketed candidates.

Components become floor(256 * x). Candidates stay in the partitions they are read in, where Spark sorts them by
length (norm), longest first, so that a bucket, BUCKET candidates in a row, is a narrow range of lengths. A query
keeps its k best so far; its first k-th score is that among the SEEDS longest vectors of the table. From it comes a
local cosine threshold for every bucket: score_k / (|query| * longest of the bucket). Above 1 the query skips the
bucket. A high threshold selects coordinate pruning: the product over the query's FOCUS largest coordinates plus the
lengths of both remainders bounds the cosine from above. A low one selects length pruning: the query's own prefix of
candidates long enough. Products of what is left are computed exactly, and only scores that reach score_k enter the
best-k lists, so ties are kept. Tasks return k rows per query at most, and a ranked window merges them.

Queries are taken in blocks of a bounded number of bytes; each block is one pass over the candidates, with the
block's vectors sent along, so neither side is ever collected whole. Inside a task PRODUCT cells are computed at once.

How much is pruned depends on the vectors. Where lengths spread or queries have k close neighbours most products are
spared; vectors of one length whose neighbours are far (cosine 0.4 in 64 dimensions) leave nothing to prune.

Cases: vectors that are null or hold a null or non-finite component take no part; shorter vectors count as padded
with zeros; components and scores beyond the range of a long saturate (scores are exact before that); rows that
repeat are candidates each; queries that share an id are one query (the smallest vector), and rows with the query's
id are its own; a null id takes no part; with fewer than k candidates all are returned; ties go to the smaller id; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.storage import written

SCALE = 256
BLOCK_BYTES = 16 << 20
BUCKET = 256
PRODUCT = 1 << 21
SEEDS = 1024
FOCUS = 4
COORDINATE_FROM = 0.75
SLACK = 1e-9
RESULT = "query_id long, vec_id long, score long"


def integer_vectors(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """vec_id and v (array<long>) of the vectors that take part."""
    x = F.col(vector)

    def finite(c: Column) -> Column:
        d = c.cast("double")
        return F.coalesce((d > float("-inf")) & (d < float("inf")) & ~F.isnan(d), F.lit(False))

    usable = F.col(vec_id).isNotNull() & x.isNotNull() & F.forall(x, finite)
    return df.where(usable).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * SCALE)).alias("v"))


def matrix(column: pa.Array, dim: int | None = None) -> np.ndarray:
    """Rows of an array column as an int64 matrix, shorter rows padded with zeros."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    width = max(int(lengths.max(initial=0)), dim or 0)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), dtype=np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


class Best:
    """The k best candidates of each query so far, by score, then smaller id; first: scores that k others are known to reach."""

    def __init__(self, n: int, k: int, first: np.ndarray | None = None):
        self.k, self.n = k, n
        self.q = np.empty(0, np.int64)
        self.score = np.empty(0, np.int64)
        self.id = np.empty(0, np.int64)
        self.least = np.full(n, -np.inf) if first is None else first.copy()  # nothing below it can enter
        self.pairs = self.products = 0

    def add(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(q):
            return
        q, score, ids = np.concatenate([self.q, q]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, ~score, q))  # ~ falls as the score rises and cannot overflow
        q, score, ids = q[order], score[order], ids[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < self.k
        self.q, self.score, self.id = q[keep], score[keep], ids[keep]
        full = rank[keep] == self.k - 1
        np.maximum.at(self.least, self.q[full], self.score[full].astype(np.float64))


def products(a: np.ndarray, b: np.ndarray, pairwise: bool = False) -> np.ndarray:
    """Exact a @ b.T of integer matrices (pairwise: of rows), in floating point where that is exact; saturates at the range of a long."""
    bound = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * max(1, a.shape[1])
    times = (lambda x, y: (x * y).sum(axis=1)) if pairwise else (lambda x, y: x @ y.T)
    if bound < 2**53:
        return np.rint(times(a.astype(np.float64), b.astype(np.float64))).astype(np.int64)
    if bound < 2**62:
        return times(a, b)
    whole = times(a.astype(object), b.astype(object))
    return np.clip(whole, -(2**63), 2**63 - 1).astype(np.int64)


def norms(v: np.ndarray) -> np.ndarray:
    return np.sqrt((v.astype(np.float64) ** 2).sum(axis=1))


def widened(v: np.ndarray, width: int) -> np.ndarray:
    return v if v.shape[1] >= width else np.pad(v, ((0, 0), (0, width - v.shape[1])))


def search_block(queries: np.ndarray, query_ids: np.ndarray, first: np.ndarray, k: int):
    """mapInArrow function: the k best of a task's candidates for each query of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(query_ids), k, first)
        for batch in batches:
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
            vectors = matrix(batch.column("v"), queries.shape[1])
            q, lengths = widened(queries, vectors.shape[1]), norms(vectors)
            order = np.argsort(-lengths, kind="stable")
            ids, vectors, lengths = ids[order], vectors[order], lengths[order]
            for a in range(0, len(ids), BUCKET):
                search_bucket(q, query_ids, vectors[a : a + BUCKET], ids[a : a + BUCKET], lengths[a : a + BUCKET], best)
        yield pa.record_batch([pa.array(query_ids[best.q]), pa.array(best.id), pa.array(best.score)], names=["query_id", "vec_id", "score"])

    return run


def search_bucket(q: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, lengths: np.ndarray, best: Best) -> None:
    """Offer a bucket's candidates, longest first, to every query."""
    q_length = norms(q)
    reach = q_length * lengths[0]
    with np.errstate(divide="ignore", invalid="ignore"):
        threshold = np.where(reach > 0, best.least / reach, np.where(best.least > 0, np.inf, -np.inf)) - SLACK
        needed = np.where(q_length > 0, best.least / q_length, -np.inf) - SLACK * np.maximum(lengths[0], 1)
    best.pairs += len(q) * len(ids)
    at_once = max(1, PRODUCT // len(ids))

    def offer(i: np.ndarray, j: np.ndarray, scores: np.ndarray) -> None:
        best.products += len(scores)
        ok = (scores >= best.least[i]) & (ids[j] != query_ids[i])
        i, j, scores = i[ok], j[ok], scores[ok]
        if len(i) > best.k * at_once:  # only what can be among the k best of this bucket
            kept = Best(best.n, best.k)
            kept.add(i, scores, ids[j])
            best.add(kept.q, kept.score, kept.id)
        else:
            best.add(i, scores, ids[j])

    # Each query needs a prefix; queries with prefixes of about one length are multiplied together.
    by_length = np.flatnonzero(threshold < COORDINATE_FROM)
    prefix = np.searchsorted(-lengths, -needed[by_length], side="right")
    order = np.argsort(prefix, kind="stable")
    by_length, prefix = by_length[order], prefix[order]
    start = 0
    while start < len(by_length):
        least = -(-int(prefix[start]) // 16) * 16
        stop = min(start + at_once, int(np.searchsorted(prefix, least, side="right")))
        part, size = by_length[start:stop], int(prefix[stop - 1])
        if size:
            scores = products(q[part], vectors[:size])
            i, j = np.nonzero(scores >= best.least[part, None])
            best.products += scores.size - len(i)
            offer(part[i], j, scores[i, j])
        start = stop
    by_coordinate = np.flatnonzero((threshold <= 1) & (threshold >= COORDINATE_FROM))
    if not len(by_coordinate):
        return
    unit_v = vectors / np.maximum(lengths, 1e-300)[:, None]
    few = min(FOCUS, q.shape[1])
    for start in range(0, len(by_coordinate), max(1, at_once // few)):
        part = by_coordinate[start : start + max(1, at_once // few)]
        unit_q = q[part] / q_length[part, None]
        focus = np.argpartition(-np.abs(unit_q), few - 1, axis=1)[:, :few]
        q_f, v_f = np.take_along_axis(unit_q, focus, axis=1), unit_v[:, focus]
        rest = np.sqrt(np.maximum(1 - (q_f**2).sum(axis=1), 0)) * np.sqrt(np.maximum(1 - (v_f**2).sum(axis=2), 0))
        j, i = np.nonzero((v_f * q_f).sum(axis=2) + rest + 1e-7 >= threshold[part])
        offer(part[i], j, products(q[part[i]], vectors[j], pairwise=True))


def top_k(df: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products of every query row with all other rows."""
    spark = df.sparkSession
    vectors = integer_vectors(df, vec_id, vector)
    length = F.aggregate("v", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double")).alias("length")
    queries = integer_vectors(df.where(is_query), vec_id, vector).groupBy("vec_id").agg(F.min("v").alias("v"))
    n_bytes = queries.agg(F.sum(F.size("v") * 8 + 16)).first()[0] or 0
    blocks = max(1, -(-n_bytes // BLOCK_BYTES))
    longest = vectors.select("vec_id", "v", length).orderBy(F.col("length").desc(), "vec_id").limit(SEEDS).toArrow().combine_chunks()
    seeds, seed_ids = matrix(longest.column("v").combine_chunks()), longest.column("vec_id").to_numpy()
    by_length = vectors.select("vec_id", "v", length).sortWithinPartitions(F.col("length").desc()).select("vec_id", "v")
    found = []
    for b in range(blocks):
        block = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)
        rows = block.orderBy("vec_id").toArrow().combine_chunks()
        if not len(rows):
            continue
        ids, q = rows.column("vec_id").to_numpy(), matrix(rows.column("v").combine_chunks())
        part = by_length.mapInArrow(search_block(q, ids, reached(q, ids, seeds, seed_ids, k), k), RESULT)
        found.append(part if blocks == 1 else written(part, "topk"))
    merged = spark.createDataFrame([], RESULT)
    for part in found:
        merged = part if len(found) == 1 else merged.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def reached(q: np.ndarray, query_ids: np.ndarray, seeds: np.ndarray, seed_ids: np.ndarray, k: int) -> np.ndarray:
    """The k-th score of every query among the seeds; -inf with fewer of them."""
    width = max(q.shape[1], seeds.shape[1])
    best, lengths = Best(len(q), k), norms(seeds)
    q, seeds = widened(q, width), widened(seeds, width)
    for a in range(0, len(seeds), BUCKET):
        search_bucket(q, query_ids, seeds[a : a + BUCKET], seed_ids[a : a + BUCKET], lengths[a : a + BUCKET], best)
    return best.least
