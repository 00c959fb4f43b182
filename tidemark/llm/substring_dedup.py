"""Exact substring deduplication with an FM-index per shard.

A window is LENGTH consecutive words. Windows are chosen for comparison by content: of the k-word grams in
a window the one with the least hash is its minimizer, so equal windows have equal minimizers. Adjacent
windows with one minimizer occurrence form a context, whose text spans exactly those windows; contexts whose
minimizer occurs once in the corpus cannot hold a repeated window and are left out. What remains is dealt to
shards by minimizer, so windows that could be equal meet in one shard. There the distinct contexts become
the text of a compressed FM-index (truncated Burrows-Wheeler transform in a wavelet matrix of packed bits).
Contexts are streamed against it: backward search gives, window by window, whether a match of at least
LENGTH words occurs twice, and a failed search skips every window that holds the failing words. Matching
intervals go back to all places where the context stands.

Hot material: copies of whole texts are found first by a 128-bit hash, and one copy is indexed. Equal
contexts are stored once with their number. A minimizer with more than HOT distinct contexts (a passage cited
in very many different surroundings) does not go to a shard: its windows are counted one by one by a 128-bit
hash, with partial sums, which is exact and splits evenly.

Words are compared by 64-bit hashes within a shard and contexts by 128-bit hashes.

Result: one row per row of the input, in doc_id, n_words, n_removed, kept (kept words joined by one space).
Cases: null, empty and blank texts have no words and an empty kept text; rows that repeat are copies of each
other; rows that share an id but differ in text are documents of their own; null ids are allowed; texts
shorter than LENGTH words keep everything; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import kernel
from tidemark.llm.fm_index import FMIndex
from tidemark.llm.storage import discard, made, release, written

LENGTH = 35
GRAM = 8
SHARD_WORDS = 400_000
#: A minimizer's contexts (fewer than 2 * LENGTH words each) may fill a quarter of a shard.
HOT = SHARD_WORDS // (8 * LENGTH)


def long_hash(data: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(data)
    return (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63)


def minimizer_runs(words: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one minimizer occurrence: minimizer hash, first window, number of windows."""
    grams = kernel.window_hashes(words, gram)
    reach = length - gram + 1
    view = np.lib.stride_tricks.sliding_window_view(grams, reach)
    at = view.argmin(axis=1) + np.arange(len(view))
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return grams[at[first]], first, np.diff(np.append(first, len(at)))


def describe(length: int, gram: int):
    """mapInArrow function: the hash of each text's words and its minimizer runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in kernel.slices(batch.column("text")):
                n, h1, h2, m, at, count, size = [], [], [], [], [], [], [0]
                for a, b in zip(words.first.tolist(), words.first[1:].tolist(), strict=False):
                    own = words.hash[a:b]
                    x, y = long_hash(own.tobytes())
                    n.append(b - a)
                    h1.append(x)
                    h2.append(y)
                    if b - a >= length:
                        u, v, w = minimizer_runs(own, length, gram)
                        m.append(u.view(np.int64))
                        at.append(v)
                        count.append(w)
                    size.append(size[-1] + (len(m[-1]) if b - a >= length else 0))
                many = lambda parts, kind: pa.ListArray.from_arrays(pa.array(size, pa.int32()), pa.array(np.concatenate(parts) if parts else [], kind))  # noqa: E731, B023
                keys = [batch.column(c).slice(words.rows.start, len(words.rows)) for c in ("id", "t")]
                yield pa.record_batch(
                    [*keys, pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), many(m, pa.int64()), many(at, pa.int32()), many(count, pa.int32())],
                    names=["id", "t", "n", "h1", "h2", "m", "at", "count"],
                )

    return run


def cut_contexts(length: int):
    """mapInArrow function: a row for each context (m, at, count) of a text, with its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column("runs").to_pylist()
            for words in kernel.slices(batch.column("text")):
                which, m, at, count, x1, x2, context = [], [], [], [], [], [], []
                for k, row in enumerate(words.rows):
                    base = int(words.first[k])
                    for r in runs[row]:
                        a = base + r["at"]
                        body = words.joined(slice(a, a + r["count"] + length - 1))
                        x, y = long_hash(body)
                        which.append(row)
                        m.append(r["m"])
                        at.append(r["at"])
                        count.append(r["count"])
                        x1.append(x)
                        x2.append(y)
                        context.append(body)
                rows = pa.array(which, pa.int64())
                yield pa.record_batch(
                    [batch.column("id").take(rows), batch.column("t").take(rows), pa.array(m, pa.int64()), pa.array(at, pa.int32()), pa.array(count, pa.int32()), pa.array(x1, pa.int64()), pa.array(x2, pa.int64()), pa.array(context, pa.binary())],
                    names=["id", "t", "m", "at", "count", "x1", "x2", "context"],
                )

    return run


def search_shard(length: int):
    """applyInArrow function: for the contexts of a shard the interval of words that repeated windows cover."""

    def run(rows: pa.Table) -> pa.Table:
        column = rows.column("context").combine_chunks()
        hashes, sizes = [], []
        for words in kernel.slices(column):
            hashes.append(words.hash)
            sizes.append(np.diff(words.first))
        size = np.concatenate(sizes)
        _, symbol = np.unique(np.concatenate(hashes), return_inverse=True)
        first = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
        text = np.zeros(int((size + 1).sum()), np.int64)  # 0 ends every context
        inside = np.arange(len(symbol)) + np.repeat(np.arange(len(size)), size)
        text[inside] = symbol + 1
        windows = size - length + 1
        weight = rows.column("weight").to_numpy()
        low, high = np.zeros(len(size), np.int64), windows - 1  # of the repeated windows
        found = weight > 1
        live = np.flatnonzero(~found)
        if len(live):
            index = FMIndex(text, length)
            # The first repeated window, upwards; a failure at f rules out all windows up to f.
            at = np.zeros(len(live), np.int64)
            while len(live):
                failed = index.repeated(text, first[live] + at, length)
                hit = failed < 0
                found[live[hit]] = True
                low[live[hit]] = at[hit]
                at = at + failed + 1
                more = ~hit & (at < windows[live])
                live, at = live[more], at[more]
            # The last one, downwards.
            live = np.flatnonzero(found & (weight == 1) & (high > low))
            at = high[live]
            while len(live):
                failed = index.repeated(text, first[live] + at, length)
                hit = failed < 0
                high[live[hit]] = at[hit]
                at = at - 1
                more = ~hit & (at > low[live])
                high[live[~hit & ~more]] = low[live[~hit & ~more]]
                live, at = live[more], at[more]
        keep = pa.array(found, pa.bool_())
        out = pa.table({"x1": rows.column("x1"), "x2": rows.column("x2"), "low": pa.array(low.astype(np.int32)), "high": pa.array((high + length).astype(np.int32))})
        return out.filter(keep)

    return run


def window_rows(length: int):
    """mapInArrow function: the single windows of contexts, by 128-bit hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], [], [], [], []]
            for x1, x2, weight, context in zip(*(batch.column(c).to_pylist() for c in ("x1", "x2", "weight", "context")), strict=True):
                words = context.split(b" ")
                for i in range(len(words) - length + 1):
                    for values, v in zip(out, (x1, x2, i, weight, *long_hash(b" ".join(words[i : i + length]))), strict=True):
                        values.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names=["x1", "x2", "i", "weight", "w1", "w2"])

    return run


def remove_spans():
    """mapInArrow function: words without those in spans (low, high)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column("spans").to_pylist()
            n, removed, kept = [], [], []
            for words in kernel.slices(batch.column("text")):
                for k, row in enumerate(words.rows):
                    a, b = int(words.first[k]), int(words.first[k + 1])
                    n.append(b - a)
                    if not spans[row]:
                        removed.append(0)
                        kept.append(words.joined(slice(a, b)))
                        continue
                    keep = np.ones(b - a, bool)
                    for s in spans[row]:
                        keep[s["low"] : s["high"]] = False
                    removed.append(int((~keep).sum()))
                    kept.append(words.joined(a + np.flatnonzero(keep)))
            yield pa.record_batch([batch.column("row"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["row", "n_words", "n_removed", "kept"])

    return run


def repeated_spans(rows: DataFrame, kind: str, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """id, t, spans (array of low, high in words) of rows (id, t, text) in which anything repeats."""
    runs = written(rows.mapInArrow(describe(length, gram), f"id {kind}, t long, n long, h1 long, h2 long, m array<long>, at array<int>, count array<int>"), "runs")
    long_enough = runs.where(F.col("n") >= length)
    same = written(long_enough.groupBy("h1", "h2", "n").agg(F.min(F.struct("id", "t")).alias("rep"), F.count("*").alias("copies")), "copies")
    with_rep = long_enough.join(same, ["h1", "h2", "n"])
    whole = with_rep.where("copies > 1").select("id", "t", F.lit(0).alias("low"), F.col("n").cast("int").alias("high"))
    whole = written(whole, "whole")
    reps = with_rep.where(F.col("rep.id").eqNullSafe(F.col("id")) & (F.col("rep.t") == F.col("t")))
    places = written(reps.select("id", "t", F.explode(F.arrays_zip("m", "at", "count")).alias("r")).select("id", "t", "r.*"), "places")
    discard(runs, same)
    # Written, so that the join reads two plain exchanges and a hot minimizer's places can be split over tasks.
    often = written(places.groupBy("m").count().where("count > 1").select("m"), "often")
    chosen = places.join(often, "m").groupBy("id", "t").agg(F.collect_list(F.struct("m", "at", "count")).alias("runs"))
    chosen = chosen.select(F.col("id").alias("id_"), F.col("t").alias("t_"), "runs")
    of_text = rows.join(chosen, F.col("id").eqNullSafe(F.col("id_")) & (F.col("t") == F.col("t_"))).select("id", "t", "text", "runs")
    contexts = written(of_text.mapInArrow(cut_contexts(length), f"id {kind}, t long, m long, at int, count int, x1 long, x2 long, context binary"), "contexts")

    discard(places, often)
    distinct = written(contexts.groupBy("m", "x1", "x2").agg(F.count("*").alias("weight"), F.first("context").alias("context"), F.first("count").alias("count")), "distinct")
    hot = written(distinct.groupBy("m").agg(F.count("*").alias("variants")).where(F.col("variants") > HOT).select("m"), "hot")
    n_words = distinct.agg(F.sum(F.col("count") + length - 1)).first()[0] or 0
    shards = max(1, -(-n_words // SHARD_WORDS))
    cold = distinct.join(hot, "m", "left_anti").select("x1", "x2", "weight", "context", F.pmod(F.xxhash64("m"), F.lit(shards)).alias("shard"))
    by_index = cold.groupBy("shard").applyInArrow(search_shard(length), "x1 long, x2 long, low int, high int")
    single = distinct.join(hot, "m", "left_semi").select("x1", "x2", "weight", "context").mapInArrow(window_rows(length), "x1 long, x2 long, i int, weight long, w1 long, w2 long")
    single = written(single, "single")
    twice = single.groupBy("w1", "w2").agg(F.sum("weight").alias("n")).where("n > 1").select("w1", "w2")
    by_count = single.join(twice, ["w1", "w2"]).groupBy("x1", "x2").agg(F.min("i").alias("low"), (F.max("i") + length).alias("high"))
    found = by_index.unionByName(by_count)
    # Windows of a context overlap, so first to last covers every word between.
    spans = contexts.select("id", "t", "at", "x1", "x2").join(found, ["x1", "x2"]).select("id", "t", (F.col("at") + F.col("low")).alias("low"), (F.col("at") + F.col("high")).alias("high"))
    return spans.unionByName(whole).groupBy("id", "t").agg(F.collect_list(F.struct("low", "high")).alias("spans"))


def strip_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """row (struct of all columns), n_words, n_removed, kept of every row."""
    kind = dict(docs.dtypes)[doc_id]
    rows = docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("id"), F.coalesce(F.xxhash64(F.col(text)), F.lit(0).cast("long")).alias("t"), F.col(text).alias("text"))
    before = made()
    spans = written(repeated_spans(rows.select("id", "t", "text"), kind, length, gram), "spans")
    release(docs.sparkSession, {p for p in made() - before if "/spans-" not in p})
    spans = spans.select(F.col("id").alias("id_"), F.col("t").alias("t_"), "spans")
    # The text travels once, within row.
    joined = rows.drop("text").join(spans, F.col("id").eqNullSafe(F.col("id_")) & (F.col("t") == F.col("t_")), "left").select("row", F.col("row")[text].alias("text"), "spans")
    return joined.mapInArrow(remove_spans(), T.StructType([T.StructField("row", docs.schema)]).add("n_words", "long").add("n_removed", "long").add("kept", "string"))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept of every row."""
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return strip_repeats(narrow, "doc_id", "text", length, gram).select(F.col("row.doc_id").alias(doc_id), "n_words", "n_removed", "kept")
