"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the bag of its hashed character n-grams (3 and 4 bytes of ``<word>``, A-Z lower-cased; not the word itself), so a
misspelling that never occurred in training shares most of its vectors with the right spelling. The vectors of
the n-grams are averaged over segments of SEGMENT words (one word: among more, the words beside a misspelt one
outweigh what is left of it) and go into a two-class softmax; embeddings and softmax are trained jointly in
numpy by Adagrad, each step without a random half of the n-grams, so that no word hangs on one of them. A document's label says only that some segment earns it, so
training repeats: score the segments, keep the strongest ones of toxic documents and the hardest ones of
clean documents, train on those. A document's score is a logistic function of its strongest segment and the
log of the number of segments, fitted on part of the sample that the embeddings did not see.

Training reads at most SAMPLE labelled documents of each class, by least hash of the id, whole texts of together at most
SAMPLE_BYTES; a text of over LONGEST bytes is passed over, never cut (a fixed, documented bound on what the driver
holds). Scoring reads every whole text of the table.

In the trained model a word's evidence is linear in its n-grams, so scoring needs one number per n-gram
bucket: 256 KB travel with the tasks, and the distinct words of about a MB of text are scored at a time.

Cases: null and empty texts have no segment and get the score of a segment without evidence; without both
classes among the labels every score is the share of toxic labels; labels that are null are not used, and a
document labelled twice counts as toxic if any label says so; ids that are null are not held out; of rows that share
an id the least text is trained on; rows that repeat are scored each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import kernel
from tidemark.llm.storage import discard, written

SEGMENT = 1
BUCKETS = 1 << 16
DIM = 8
GRAMS = (3, 4)
SAMPLE = 2000
SAMPLE_BYTES = 48 << 20
LONGEST = 1 << 20
ROUNDS = 7
DROPPED = 0.5
STEPS = 150
FIRST_SEGMENTS = 60_000
SEED = 20240


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def subwords(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of words, and where each word's begin (the marks give every word one at least)."""
    n = len(start)
    length = end - start + 2
    first = np.concatenate([[0], np.cumsum(length)])
    text = np.empty(first[-1], dtype=np.uint64)
    text[first[:-1]] = ord("<")
    text[first[1:] - 1] = ord(">")
    word = np.repeat(np.arange(n), length - 2)
    inner = np.arange(len(word)) - np.repeat(np.cumsum(length - 2) - (length - 2), length - 2)
    text[first[word] + 1 + inner] = data[start[word] + inner]
    owner, ids = [], []
    for g in GRAMS:
        count = np.maximum(length - g + 1, 0)
        own = np.repeat(np.arange(n), count)
        pos = first[own] + np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
        h = np.full(len(pos), np.uint64(g))
        for k in range(g):
            h = h * kernel.BASE + text[pos + k] + np.uint64(1)
        owner.append(own)
        ids.append(kernel.mix(h))
    owner_all = np.concatenate(owner)
    order = np.argsort(owner_all, kind="stable")
    buckets = (np.concatenate(ids)[order] % np.uint64(BUCKETS)).astype(np.int64)
    return buckets, np.searchsorted(owner_all[order], np.arange(n))


def segments(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments of texts whose words begin at first: start, end and text of each; the last of a text reaches back to be whole."""
    length = np.diff(first)
    count = -(-length // SEGMENT)
    text = np.repeat(np.arange(len(length)), count)
    k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    end = np.minimum((k + 1) * SEGMENT, length[text])
    start = np.maximum(end - SEGMENT, 0)
    return first[text] + start, first[text] + end, text


@dataclass
class Model:
    """evidence: of each bucket; bias; weights of (constant, strongest segment, log of segments) for the score."""

    evidence: np.ndarray
    bias: float
    weights: np.ndarray

    def strongest(self, words: kernel.Words) -> tuple[np.ndarray, np.ndarray]:
        """The strongest segment of every text, and its number of segments."""
        _, at, which = np.unique(words.hash, return_index=True, return_inverse=True)
        top, n = np.full(len(words.rows), self.bias), np.zeros(len(words.rows))
        if not len(at):
            return top, n
        buckets, first = subwords(words.data, words.start[at], words.end[at])
        size = np.diff(np.append(first, len(buckets)))
        of_word = (np.add.reduceat(self.evidence[buckets], first) / size)[which]
        total = np.concatenate([[0.0], np.cumsum(of_word)])
        a, b, text = segments(words.first)
        np.maximum.at(strong := np.full(len(words.rows), -np.inf), text, (total[b] - total[a]) / SEGMENT + self.bias)
        n = np.bincount(text, minlength=len(words.rows)).astype(float)
        return np.where(n > 0, strong, top), n

    def score(self, strongest: np.ndarray, n: np.ndarray) -> np.ndarray:
        z = self.weights[0] + self.weights[1] * strongest + self.weights[2] * np.log1p(n)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def softmax_train(bags: list[tuple[np.ndarray, np.ndarray]], word_grams, rows: np.ndarray, label: np.ndarray, params: dict, rng) -> None:
    """Joint Adagrad steps on embeddings and softmax over segments rows with label; small samples get more passes."""
    starts, ends, word = bags
    grams, first, size = word_grams
    emb, w, b, gsq_e, gsq_w = (params[k] for k in ("emb", "w", "b", "gsq_e", "gsq_w"))
    parts = max(1, len(rows) // 256)
    for _ in range(max(3, -(-STEPS // parts))):
        for part in np.array_split(rng.permutation(len(rows)), parts):
            seg, y = rows[part], label[part]
            n = ends[seg] - starts[seg]
            own = np.repeat(np.arange(len(seg)), n)
            ws = word[np.repeat(starts[seg], n) + np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)]
            count = size[ws]
            g_own = np.repeat(own, count)
            g = grams[np.repeat(first[ws], count) + np.arange(len(g_own)) - np.repeat(np.cumsum(count) - count, count)]
            share = np.repeat(1.0 / (count * SEGMENT), count) * (rng.random(len(g)) >= DROPPED) / (1 - DROPPED)
            used, local = np.unique(g, return_inverse=True)
            mix = np.zeros((len(seg), DIM))
            for d in range(DIM):
                mix[:, d] = np.bincount(g_own, weights=emb[g, d] * share, minlength=len(seg))
            z = mix @ w + b
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
            p[np.arange(len(seg)), y] -= 1
            p *= weight[:, None]
            d_mix, d_w = p @ w.T, mix.T @ p
            d_e = np.stack([np.bincount(local, weights=d_mix[g_own, d] * share, minlength=len(used)) for d in range(DIM)], axis=1)
            gsq_e[used] += d_e**2
            emb[used] -= 0.3 * d_e / (np.sqrt(gsq_e[used]) + 1e-8)
            gsq_w += d_w**2
            w -= 0.3 * d_w / (np.sqrt(gsq_w) + 1e-8)
            b -= 0.3 * p.sum(axis=0)


def train(texts: pa.Array, toxic: np.ndarray) -> Model:
    """Fit on whole texts with labels 0 and 1."""
    share = float(toxic.mean()) if len(toxic) else 0.0
    if not 0 < share < 1:
        odds = np.log(max(share, 1e-6) / max(1 - share, 1e-6))
        return Model(np.zeros(BUCKETS, np.float32), 0.0, np.array([odds, 0.0, 0.0]))
    rng = np.random.default_rng(SEED)
    # All words of the sample as numbers, and the n-grams of each distinct one.
    seen = np.empty(0, np.uint64)
    grams, sizes, fresh, hashed, length = [], [], [], [], []
    for words in kernel.slices(texts, lower=True):
        values, at = np.unique(words.hash, return_index=True)
        new = ~np.isin(values, seen, assume_unique=True)
        if new.any():
            buckets, first = subwords(words.data, words.start[at[new]], words.end[at[new]])
            grams.append(buckets.astype(np.int32))
            sizes.append(np.diff(np.append(first, len(buckets))).astype(np.int32))
            fresh.append(values[new])
            seen = np.union1d(seen, values[new])
        hashed.append(words.hash)
        length.append(np.diff(words.first))
    size = np.concatenate(sizes) if sizes else np.empty(0, np.int32)
    word_grams = (np.concatenate(grams) if grams else np.empty(0, np.int32), np.cumsum(size, dtype=np.int64) - size, size)
    number = np.argsort(np.concatenate(fresh)).astype(np.int32) if fresh else np.empty(0, np.int32)
    word = np.concatenate([number[np.searchsorted(seen, h)] for h in hashed])
    del hashed, grams, seen, fresh
    start, end, text = (x.astype(np.int32) for x in segments(np.concatenate([[0], np.cumsum(np.concatenate(length))])))
    if not len(text):
        return Model(np.zeros(BUCKETS, np.float32), 0.0, np.array([np.log(share / (1 - share)), 0.0, 0.0]))
    fold = rng.random(len(toxic)) < 0.25  # only for the last step
    params = {"emb": rng.normal(0, 0.1, (BUCKETS, DIM)), "w": rng.normal(0, 0.5, (DIM, 2)), "b": np.zeros(2), "gsq_e": np.zeros((BUCKETS, DIM)), "gsq_w": np.zeros((DIM, 2))}
    learns = ~fold[text]

    def logits() -> tuple[np.ndarray, np.ndarray, float]:
        evidence = params["emb"] @ (params["w"][:, 1] - params["w"][:, 0])
        of_word = np.add.reduceat(evidence[word_grams[0]], word_grams[1]) / size
        total = np.concatenate([[0.0], np.cumsum(of_word[word])])
        bias = float(params["b"][1] - params["b"][0])
        return evidence, (total[end] - total[start]) / SEGMENT + bias, bias

    z = rng.random(len(text))
    for step in range(ROUNDS):
        # Place of each segment within its text, strongest first.
        order = np.lexsort((-z, text))
        place = np.empty(len(text), np.int64)
        place[order] = np.arange(len(text)) - np.searchsorted(text[order], text[order])
        random = rng.permutation(len(text))
        extra = np.zeros(len(text), bool)
        extra[random[: len(text) // 20]] = True
        many = max(6, FIRST_SEGMENTS // len(toxic))
        chosen = learns & (place < many if step == 0 else np.where(toxic[text] == 1, place < 2, (place < 3) | extra))
        rows = np.flatnonzero(chosen)
        softmax_train((start, end, word), word_grams, rows, toxic[text[rows]].astype(np.int64), params, rng)
        evidence, z, bias = logits()
    top = np.full(len(toxic), bias)
    np.maximum.at(strong := np.full(len(toxic), -np.inf), text, z)
    n = np.bincount(text, minlength=len(toxic)).astype(float)
    top = np.where(n > 0, strong, top)
    x = np.stack([np.ones(len(top)), top, np.log1p(n)], axis=1)[fold]
    return Model(evidence.astype(np.float32), bias, logistic(x, toxic[fold].astype(float)))


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton's method with a small ridge, so that separable data stay finite."""
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6, 1e-2, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(w)), x.T @ (y - p) - ridge @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def scorer(model: Model):
    """mapInArrow function: doc_id and score of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.empty(batch.num_rows)
            for words in kernel.slices(batch.column("text"), lower=True):
                score[words.rows.start : words.rows.stop] = model.score(*model.strongest(words))
            yield pa.record_batch([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    return run


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", sample: int = SAMPLE) -> Model:
    """Train on at most sample labelled documents of each class that are not held out, SAMPLE_BYTES together."""
    known = labels.where(~held_out(F.col(doc_id)) & F.col(toxic).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(F.col(toxic)).cast("int").alias("toxic"))
    known = known.where("doc_id is not null")
    picked = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for c in (0, 1)]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).where(F.octet_length("text") <= LONGEST)
    rows = rows.join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    rows = written(rows, "sample")
    before = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id")
    fits = rows.select("doc_id", F.sum(F.octet_length("text")).over(before).alias("bytes")).where(F.col("bytes") <= SAMPLE_BYTES // 2).select("doc_id")
    found = rows.join(F.broadcast(fits), "doc_id").orderBy("doc_id").toArrow()
    discard(rows)
    return train(found.column("text").combine_chunks(), found.column("toxic").to_numpy())


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every row."""
    kind = dict(docs.dtypes)[doc_id]
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(scorer(model), f"doc_id {kind}, score double")


def dropper(model: Model, text: str, least: float):
    """mapInArrow function: the rows with a score below least, all columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for words in kernel.slices(batch.column(text), lower=True):
                keep[words.rows.start : words.rows.stop] = model.score(*model.strongest(words)) < least
            yield batch.filter(pa.array(keep))

    return run


def drop_toxic(docs: DataFrame, model: Model, text: str = "text", least: float = 0.3) -> DataFrame:
    """The rows of docs that score below least."""
    return docs.mapInArrow(dropper(model, text, least), docs.schema)
