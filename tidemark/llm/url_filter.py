"""URL filter: host word segmentation and naive Bayes over segmented host and path tokens.

Rules decide first: a rule is host/path-prefix, fits its host and all subdomains, and the longest fitting
rule wins. The URLs that rules decide are also the classifier's labelled rows; it judges the others.

Segmentation: names concatenated in hosts are split by Viterbi under a unigram model of words. Word counts
come from the running text of all pages (markup removed) and all paths; exact counts are kept of the words
that are substrings of names in hosts and paths, since no other word can be looked up. Those that stand in most
names are sent to the tasks, 16 bytes each, VOCABULARY at most. The others stay in a table: a name in which one
of them stands is joined to its own ones and split once, and its URLs are joined to that split, so the model is
whole whatever its size. A string that is no word costs more with each character, so unknown names stay whole or
split where known words begin.

Classifier: multinomial naive Bayes over the words of host labels (but the top-level domain's own rule
evidence stays a token) and path, counted over all rule-decided URLs into 2**16 hashed cells per class with
add-one smoothing, so again the model is bounded.

Cases: a null URL or one without :// has an empty host and path and no tokens, and gets the classifier's
prior; a very long name is worked through in pieces and not kept; a null page_id stays; an unknown top-level name is just another token; without labelled URLs everything is allowed; rows
that repeat are judged each; an empty table gives an empty result; columns of other names are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.ngram_join import sifted
from tidemark.llm.storage import discard, written

CELLS = 1 << 16
LONGEST_WORD = 24
CACHE = 1 << 16
CACHED_NAME = 64
PIECE = 4096
VOCABULARY = 1 << 22
SLOTS = 64
NO_MORE: Mapping[int, int] = {}
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWERED)


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.contains(url, F.lit("://")), F.substr(url, F.instr(url, F.lit("://")) + 3))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return lowered(host), path


def fitting_rule(host: Column, path: Column, rules: dict[str, bool]) -> Column:
    """The longest rule that fits, or null. rules: host/path-prefix to whether it allows."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        name, prefix = rule.split("/", 1)
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + prefix))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def words_of(text: Column) -> Column:
    """Lower-case runs of letters."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), 1)


class ExactCounts:
    """Counts of words by their hash, and the number of all occurrences."""

    def __init__(self, hashes: np.ndarray, n: np.ndarray, total: int):
        order = np.argsort(hashes)
        self.hashes, self.n = hashes[order], n[order]
        self.total = max(1.0, float(total))

    def count(self, word: str, more: Mapping[int, int] = NO_MORE) -> int:
        """The count of word; more has counts of further words by their hash."""
        h = xxhash.xxh64_intdigest(word.encode(), seed=42)
        if h in more:
            return more[h]
        at = int(self.hashes.searchsorted(np.uint64(h)))
        return int(self.n[at]) if at < len(self.hashes) and self.hashes[at] == h else 0


def names_of(host: str, path: str) -> set[str]:
    """The runs of letters that are split into words."""
    found = {r for label in host.split(".")[:-1] for r in _runs(label) if r.isalpha()}
    found.update(r for r in _runs(path.lower()) if r.isalpha())
    return found


def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: the runs of (host, path) that are split into words, distinct within a batch."""
    for batch in batches:
        found = set()
        for host, path in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True):
            found |= names_of(host, path)
        yield pa.record_batch([pa.array(list(found), pa.string())], names=["name"])


def names_by_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: the names of every row (at, host, path), distinct within the row."""
    for batch in batches:
        found = [names_of(h, p) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)]
        at = np.repeat(batch.column("at").to_numpy(), [len(x) for x in found])
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array([n for x in found for n in x], pa.string())], names=["at", "name"])


def stretches(name: str) -> Iterator[tuple[int, Iterator[str]]]:
    """For every PIECE characters of name: their number, and the substrings of up to LONGEST_WORD characters that begin there."""
    for first in range(0, len(name), PIECE):
        part = name[first : first + PIECE + LONGEST_WORD - 1]
        size = min(PIECE, len(name) - first)
        yield size, (part[s:e] for s in range(size) for e in range(s + 1, min(len(part), s + LONGEST_WORD) + 1))


def substrings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: substrings of up to LONGEST_WORD characters, distinct within about PIECE characters of names."""
    for batch in batches:
        found, done = set(), 0
        for name in batch.column("name").to_pylist():
            for size, inside in stretches(name):
                found.update(inside)
                done += size
                if done >= PIECE:
                    yield pa.record_batch([pa.array(list(found), pa.string())], names=["word"])
                    found, done = set(), 0
        yield pa.record_batch([pa.array(list(found), pa.string())], names=["word"])


def substring_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: hashes of the substrings of names (at, name), distinct within PIECE characters of a name."""
    rows = lambda at, h: pa.record_batch([pa.array(at, pa.int64()), pa.array(np.array(h, np.uint64).view(np.int64))], names=["at", "h"])
    for batch in batches:
        at, hashes = [], []
        for key, name in zip(batch.column("at").to_pylist(), batch.column("name").to_pylist(), strict=True):
            for _, inside in stretches(name):
                found = {xxhash.xxh64_intdigest(w.encode(), seed=42) for w in set(inside)}
                hashes += found
                at += repeat(key, len(found))
                if len(hashes) >= PIECE * LONGEST_WORD:
                    yield rows(at, hashes)
                    at, hashes = [], []
        yield rows(at, hashes)


def exact_counts(words: DataFrame, rows: DataFrame) -> tuple[ExactCounts, DataFrame | None]:
    """Counts of the words (word) that stand in names of rows (host, path).

    Of VOCABULARY words at most, those in most names, to be sent to the tasks; and a table (h, n; written) of the
    others, if there are any.
    """
    counts = written(words.groupBy("word").agg(F.count("*").alias("n")), "word_counts")
    inside = rows.select("host", "path").mapInArrow(names, "name string").distinct().mapInArrow(substrings, "word string")
    # Words in more names (by powers of two) come first, equal ones by their hash.
    inside = inside.groupBy("word").agg(F.floor(F.log2(F.count("*"))).cast("int").alias("spread"))
    known = counts.join(inside, "word").withColumn("h", F.xxhash64("word"))
    known = written(known.select("h", "n", (F.col("spread") * SLOTS + F.pmod("h", F.lit(SLOTS)).cast("int")).alias("rank")), "known_words")
    sizes = {r["rank"]: r["count"] for r in known.groupBy("rank").count().collect()}  # at most 63 * SLOTS rows
    sent, least = 0, max(sizes, default=0) + 1
    for rank in sorted(sizes, reverse=True):
        if sent + sizes[rank] > VOCABULARY:
            break
        sent, least = sent + sizes[rank], rank
    found = known.where(F.col("rank") >= least).select("h", "n").toArrow()
    total = counts.agg(F.sum("n")).first()[0] or 0
    whole = sent == sum(sizes.values())
    discard(counts, *([known] if whole else []))
    sendable = ExactCounts(found.column("h").to_numpy().astype(np.int64).view(np.uint64), found.column("n").to_numpy(), total)
    return sendable, None if whole else known.where(F.col("rank") < least)


class Segmenter:
    def __init__(self, counts: ExactCounts):
        self.counts = counts
        kept = lru_cache(maxsize=CACHE)(self._split)
        self.split = lambda name: kept(name) if len(name) <= CACHED_NAME else self._split(name)

    def cost(self, word: str, more: Mapping[int, int] = NO_MORE) -> float:
        n = self.counts.count(word, more)
        if n:
            return math.log(self.counts.total) - math.log(n)
        return math.log(self.counts.total) + 3.0 * len(word)

    def _split(self, name: str, more: Mapping[int, int] = NO_MORE) -> tuple[str, ...]:
        """Viterbi: the split of name with the least total cost; the longer last word wins a tie."""
        best, back = [0.0], [0]
        for end in range(1, len(name) + 1):
            cost, start = min((best[s] + self.cost(name[s:end], more), s) for s in range(max(0, end - LONGEST_WORD), end))
            best.append(cost)
            back.append(start)
        out, end = [], len(name)
        while end:
            out.append(name[back[end] : end])
            end = back[end]
        return tuple(reversed(out))


def split_names(counts: ExactCounts):
    """mapInArrow function: the words of every name (name, more), with its own further counts more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = Segmenter(counts)
        for batch in batches:
            words = []
            for name, more in zip(batch.column("name").to_pylist(), batch.column("more"), strict=True):
                h, n = more.values.flatten()
                words.append(segmenter._split(name, dict(zip(h.to_numpy().view(np.uint64).tolist(), n.to_pylist(), strict=True))))
            yield pa.record_batch([batch.column("name"), pa.array(words, pa.list_(pa.string()))], names=["name", "words"])

    return run


def with_splits(rows: DataFrame, counts: ExactCounts, rest: DataFrame) -> DataFrame:
    """rows (key, host, path, rule; written) with splits (name, words) of their names in which words of rest (h, n) stand."""
    held = written(rows.withColumn("at", F.monotonically_increasing_id()), "urls")
    found = held.select("host", "path").mapInArrow(names, "name string").distinct()
    found = written(found.select(F.monotonically_increasing_id().alias("at"), "name"), "names")
    hits = sifted(found.mapInArrow(substring_hashes, "at long, h long"), rest, ["h"]).join(rest.select("h", "n"), "h")
    more = hits.groupBy("at").agg(F.collect_set(F.struct("h", "n")).alias("more"))
    splits = found.join(more, "at").select("name", "more").mapInArrow(split_names(counts), "name string, words array<string>")
    splits = written(splits, "splits")
    parts = held.select("at", "host", "path").mapInArrow(names_by_row, "at long, name string")
    parts = parts.join(splits, "name").groupBy("at").agg(F.collect_list(F.struct("name", "words")).alias("splits"))
    out = written(held.join(parts, "at", "left").drop("at"), "split_urls")
    discard(held, found, splits, rest)
    return out


def splits_by_row(batch: pa.RecordBatch, split: Callable[[str], tuple[str, ...]]) -> Iterator[Callable]:
    """For every row the function that splits its names: by its splits (name, words), if it has any, else by split."""
    if "splits" not in batch.schema.names:
        yield from repeat(split, batch.num_rows)
        return
    for found in batch.column("splits").to_pylist():
        own = {x["name"]: x["words"] for x in found or ()}
        yield (lambda name, own=own: own.get(name) or split(name)) if own else split


def tokens_of(split, host: str, path: str) -> list[str]:
    """Tokens of a URL: h: words of host labels, d: the last label, p: words and numbers' lengths of the path."""
    labels = host.split(".") if host else []
    out = [f"d:{labels[-1]}"] if labels else []
    for label in labels[:-1]:
        for run in _runs(label):
            out += [f"h:{w}" for w in split(run)]
    for run in _runs(path.lower()):
        if run.isalpha():
            out += [f"p:{w}" for w in split(run)]
        else:
            out.append(f"p:#{len(run)}")
    return out


def _runs(text: str) -> list[str]:
    """Maximal runs of letters or of digits."""
    out, kind = [], ""
    for c in text:
        now = "a" if c.isalpha() else "0" if c.isdigit() else ""
        if now and now == kind:
            out[-1].append(c)
        elif now:
            out.append([c])
        kind = now
    return ["".join(x) for x in out]


def token_cells(counts: ExactCounts):
    """mapInArrow function: hashed cells of the tokens of (host, path, allowed; splits), already summed within a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Segmenter(counts).split
        for batch in batches:
            seen = np.zeros((2, CELLS), dtype=np.int64)
            for own, host, path, allowed in zip(splits_by_row(batch, split), *(batch.column(c).to_pylist() for c in ("host", "path", "allowed")), strict=True):
                for token in tokens_of(own, host, path):
                    seen[int(allowed), cell(token)] += 1
            kind, at = np.nonzero(seen)
            yield pa.record_batch([pa.array(kind.astype(bool)), pa.array(at.astype(np.int32)), pa.array(seen[kind, at])], names=["allowed", "cell", "n"])

    return run


def cell(token: str) -> int:
    return xxhash.xxh64_intdigest(token.encode()) % CELLS


def judge(counts: ExactCounts, weight: np.ndarray, prior: float):
    """mapInArrow function: log odds of allow for every row (key, host, path, rule; splits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Segmenter(counts).split
        for batch in batches:
            odds, shown = [], []
            for own, host, path in zip(splits_by_row(batch, split), batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True):
                tokens = tokens_of(own, host, path)
                odds.append(prior + sum(weight[cell(t)] for t in tokens))
                shown.append(" ".join(t[2:] for t in tokens if t[0] == "h"))
            yield pa.record_batch([*(batch.column(c) for c in ("key", "host", "path", "rule")), pa.array(odds, pa.float64()), pa.array(shown, pa.string())], names=["key", "host", "path", "rule", "odds", "host_words"])

    return run


def filter_urls(pages: DataFrame, rules: dict[str, bool], page_id: str = "page_id", url: str = "url", html: str | None = "html") -> DataFrame:
    """page_id, host, path, rule, verdict, odds and host_words of every row."""
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(page_id).alias("key"), host.alias("host"), path.alias("path")).withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules))
    texts = [words_of(F.col("path"))]
    running = pages.select(F.explode(words_of(F.regexp_replace(F.coalesce(F.col(html), F.lit("")), r"(?s)<(script|style).*?</\1>|<[^>]*>", " "))).alias("word")) if html else None
    words = rows.select(F.explode(texts[0]).alias("word"))
    counts, rest = exact_counts(words.unionByName(running) if running is not None else words, rows)
    if rest is not None:
        rows = with_splits(rows, counts, rest)
    allow = [r for r, ok in rules.items() if ok]
    labelled = rows.where("rule is not null").withColumn("allowed", F.col("rule").isin(allow))
    found = labelled.drop("key", "rule").mapInArrow(token_cells(counts), "allowed boolean, cell int, n long")
    found = found.groupBy("allowed", "cell").agg(F.sum("n").alias("n")).toArrow()  # at most 2 * CELLS rows
    by_class = np.ones((2, CELLS))
    by_class[found.column("allowed").to_numpy(zero_copy_only=False).astype(int), found.column("cell").to_numpy()] += found.column("n").to_numpy()
    weight = np.log(by_class[1] / by_class[1].sum()) - np.log(by_class[0] / by_class[0].sum())
    n = {r["allowed"]: r["count"] for r in labelled.groupBy("allowed").count().collect()}
    prior = math.log((n.get(True, 0) + 1) / (n.get(False, 0) + 1)) if n else 0.0
    kind = dict(pages.dtypes)[page_id]
    judged = rows.mapInArrow(judge(counts, weight, prior), f"key {kind}, host string, path string, rule string, odds double, host_words string")
    by_method = F.when(F.col("odds") >= 0, "allow").otherwise("block")
    by_rule = F.when(F.col("rule").isin(allow), "allow").otherwise("block")
    verdict = F.when(F.col("rule").isNotNull(), by_rule).otherwise(by_method)
    return judged.select(F.col("key").alias(page_id), "host", "path", "rule", verdict.alias("verdict"), "odds", "host_words")
