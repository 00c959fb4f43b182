"""Benchmark decontamination by spaced seeds.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. Each fixed mask hashes the words at
its 1-positions, so a substituted word under a 0 does not hide a shared passage. Seeds of the benchmark are
joined with those of the documents by hash (a bitmap first, then a sorted table); every hit names a diagonal,
on which stretches of at least MIN_WORDS words, or of MIN_SHARE of the item, are sought of which MIN_SHARE of the
words are equal: the segment of greatest score (a match gains 1, a substitution loses 2), or where that falls short
the longest one with the share; then the same on what is left beside it. Every stretch is reported, where stretches
of one item overlap in the document the one with most equal words.

A replaced word at an end of a passage shortens it, and a short passage with replaced words may hold no seed. Found,
as tests measure it: 13 words with one replaced at random in five of six cases, with two in two of five; 20 words
with four in 19 of 20; 30 words with four and longer ones in all. Passages of 13 words copied word by word always.

The benchmark is taken in blocks of at most about BLOCK_BYTES of text, one pass over the documents each, so what
travels with the tasks is bounded and documents are not shuffled.

Cases: null and empty texts on either side match nothing; items of fewer words than a mask's span use the masks
that fit, items of fewer than the seed weight are matched whole from MIN_ITEM words on and ignored below that (so
short a phrase proves nothing); a very long text is worked through in blocks of hits; rows that repeat are judged each; null ids are carried along; empty tables give an empty result; other columns
are ignored by find_overlaps and kept by drop_contaminated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import kernel

# Seed masks of weight 8.
MASKS = ("11111111", "11011010111", "1110010110101", "1011000110010011")
WEIGHT = 8
MIN_WORDS = 13
MIN_SHARE = 0.8
MIN_ITEM = 5
BLOCK_BYTES = 2 << 20
BITMAP = 1 << 22
BLOCK_HITS = 1 << 20

SEPARATES = kernel.IS_WORD.copy()
SEPARATES[[c for c in range(128) if not chr(c).isalnum()]] = False


def words_in(column: pa.Array) -> Iterator[kernel.Words]:
    return kernel.slices(column, lower=True, is_word=SEPARATES)


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the words under the mask's ones, at every position where the mask fits."""
    m = len(words) - len(mask) + 1
    out = np.full(max(m, 0), np.uint64(len(mask)))
    for i in range(len(mask)):
        if mask[i] == "1" and m > 0:
            out = out * kernel.BASE + words[i : i + m]
    return kernel.mix(out)


class Benchmark:
    """Seed tables of a block of items (word-hash arrays)."""

    def __init__(self, items: list[np.ndarray]):
        self.items = items
        short = {"1" * len(w) for w in items if MIN_ITEM <= len(w) < WEIGHT}
        self.tables = []
        for mask in (*MASKS, *sorted(short)):
            key, item, at = [], [], []
            for k, words in enumerate(items):
                if (len(mask) < WEIGHT) != (len(words) < WEIGHT) or len(words) < WEIGHT and len(mask) != len(words):
                    continue
                h = seeds(words, mask)
                key.append(h)
                item.append(np.full(len(h), k))
                at.append(np.arange(len(h)))
            if not key:
                continue
            key = np.concatenate(key)
            order = np.argsort(key, kind="stable")
            key = key[order]
            bitmap = np.zeros(BITMAP, bool)
            bitmap[(key % np.uint64(BITMAP)).astype(np.int64)] = True
            self.tables.append((mask, key, np.concatenate(item)[order], np.concatenate(at)[order], bitmap))

    def hits(self, words: kernel.Words) -> np.ndarray:
        """Rows (text, item, diagonal) of the seeds in common, each once."""
        found = np.empty((0, 3), np.int64)
        for mask, key, item, at, bitmap in self.tables:
            h = seeds(words.hash, mask)
            pos = np.flatnonzero(bitmap[(h % np.uint64(BITMAP)).astype(np.int64)])
            text = np.searchsorted(words.first, pos, "right") - 1
            inside = pos + len(mask) <= words.first[text + 1]
            pos, text = pos[inside], text[inside]
            low, high = np.searchsorted(key, h[pos], "left"), np.searchsorted(key, h[pos], "right")
            total = np.cumsum(high - low)
            first = 0
            while first < len(pos):
                last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + BLOCK_HITS, "right")))
                n = (high - low)[first:last]
                entry = np.repeat(low[first:last], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                rows = np.stack([np.repeat(text[first:last], n), item[entry], np.repeat(pos[first:last], n) - at[entry]], axis=1)
                found = np.unique(np.concatenate([found, rows]), axis=0)
                first = last
        return found

    def overlaps(self, words: kernel.Words) -> list[tuple[int, int, int, int, int, int]]:
        """(text, item, start, end, item start, equal words) of every stretch; those of one text and item do not overlap."""
        out: dict = {}
        for text, k, diagonal in self.hits(words).tolist():
            item = self.items[k]
            a, b = int(words.first[text]), int(words.first[text + 1])
            low, high = max(a, diagonal), min(b, diagonal + len(item))
            same = words.hash[low:high] == item[low - diagonal : high - diagonal]
            for start, end in stretches(same, min(MIN_WORDS, -(-len(item) * 4 // 5))):
                out.setdefault((text, k), []).append((int(same[start:end].sum()), low + start - a, low + end - a, low + start - diagonal))
        chosen = []
        for (text, k), found in out.items():
            taken: list = []
            for equal, start, end, at in sorted(found, key=lambda x: (-x[0], x[1:])):
                if all(end <= x or y <= start for x, y in taken):
                    taken.append((start, end))
                    chosen.append((text, k, start, end, at, equal))
        return sorted(chosen)


def strongest(same: np.ndarray) -> tuple[int, int]:
    """The segment of greatest score."""
    gain = np.concatenate([[0], np.cumsum(np.where(same, 1, -2))])
    end = int(np.argmax(gain - np.minimum.accumulate(gain)))
    return int(np.argmin(gain[: end + 1])), end


def longest(same: np.ndarray) -> tuple[int, int]:
    """The longest segment with MIN_SHARE (four of five) equal, from an equal word to an equal word."""
    if not same.any():
        return 0, 0
    gain = np.concatenate([[0], np.cumsum(np.where(same, 1, -4))])
    starts = np.flatnonzero(same)
    # Greatest gain at an end from each place on, last place first: of the ends that gain enough, the last is sought.
    best = np.maximum.accumulate(np.where(same, gain[1:], gain.min() - 1)[::-1])
    ends = len(same) - np.searchsorted(best, gain[starts])
    at = int(np.argmax(ends - starts))
    return int(starts[at]), int(ends[at])


def stretches(same: np.ndarray, enough: int) -> list[tuple[int, int]]:
    """Segments of at least so many words, MIN_SHARE of them equal, that do not overlap."""
    found, todo = [], [(0, len(same))]
    while todo:
        a, b = todo.pop()
        if b - a < enough:
            continue
        for start, end in (strongest(same[a:b]), longest(same[a:b])):
            if end - start >= enough and same[a + start : a + end].sum() >= MIN_SHARE * (end - start):
                found.append((a + start, a + end))
                todo += [(a, a + start), (a + end, b)]
                break
    return found


def finder(ids: list, items: list[np.ndarray], id_kind: pa.DataType):
    """mapInArrow function: rows of find_overlaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Benchmark(items)
        for batch in batches:
            rows = []
            for words in words_in(batch.column("text")):
                rows += [(words.rows.start + text, *rest) for text, *rest in block.overlaps(words)]
            which, k, start, end, at, equal = zip(*rows, strict=True) if rows else [[]] * 6
            whole = pa.array([ids[i] for i in k], id_kind)
            numbers = [pa.array(v, pa.int32()) for v in (start, end, at, equal)]
            yield pa.record_batch([batch.column("doc_id").take(pa.array(which, pa.int64())), whole, *numbers], names=["doc_id", "item_id", "start", "end", "item_start", "equal_words"])

    return run


def dropper(items: list[np.ndarray], text: str):
    """mapInArrow function: the rows without an overlap, all columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Benchmark(items)
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for words in words_in(batch.column(text)):
                keep[[words.rows.start + x[0] for x in block.overlaps(words)]] = False
            yield batch.filter(pa.array(keep))

    return run


def blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[tuple[list, list[np.ndarray], pa.DataType]]:
    """ids and word hashes of the benchmark, some items at a time."""
    rows = benchmark.where(F.col(text).isNotNull()).select(F.col(item_id).alias("item_id"), F.col(text).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-int(total) // BLOCK_BYTES))
    for b in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        found = part.orderBy("item_id", "text").toArrow()
        column = found.column("text").combine_chunks()
        items = [w.hash[x:y] for w in words_in(column) for x, y in zip(w.first.tolist(), w.first[1:].tolist(), strict=False)]
        yield found.column("item_id").to_pylist(), items, found.column("item_id").type


def find_overlaps(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, start, end (words of the document), item_start, equal_words: every stretch that a document shares with an item."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = f"doc_id {dict(docs.dtypes)[doc_id]}, item_id {dict(benchmark.dtypes)[item_id]}, start int, end int, item_start int, equal_words int"
    out = None
    for ids, items, kind in blocks(benchmark, item_id, item_text):
        part = rows.mapInArrow(finder(ids, items, kind), schema)
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", between: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """The rows of docs that overlap with no item; between is applied after each block (to cut long plans)."""
    for _, items, _ in blocks(benchmark, item_id, item_text):
        docs = between(docs.mapInArrow(dropper(items, text), docs.schema))
    return docs
