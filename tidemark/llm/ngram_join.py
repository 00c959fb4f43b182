"""N-gram Jaccard self-join by PartEnum signatures.

A document's set is its distinct n-word shingles. Sets with Jaccard similarity at least g differ in at most
k elements, k depending on their sizes, so the join runs in instances, one for each band of sizes (each
band's top is 1/g times the next lower band's). In an instance the hashed feature domain is cut into n1
parts and each part into n2 subparts. Two sets that differ in at most k elements have a part with at most k2
differing subparts if n1 * (k2 + 1) > k; for each part every choice of n2 - k2 subparts gives one signature
of the elements in them, so such sets share one. A pair's smaller set lies in the instance's band, the
larger one there or one band up, so each set signs for two instances.

Signatures over few elements would bring unrelated sets together (all that share a passage, or nothing). With E
parts more than needed, sets share E + 1 parts; a set with at most E parts in which a choice holds fewer than
`least` elements leaves those signatures out, and E is chosen so that hardly any set has more.

Sets that are equal are one node, named by a 128-bit hash of the set. In each group of a shared signature all
members are compared with one pivot (the member that shares most signatures), which joins groups of near copies
in one round; what stays apart within a group is then compared pair by pair, so no class is split. Before sets
are compared, sizes and parity sketches (about two bits an element) rule out pairs: every differing element flips
one bit, so more differing bits than k prove the distance. Sketches fold to half their length by exclusive or;
short folds travel with the signatures and are tested inside the join, the long ones with the pairs.

Most signatures stand alone and most texts are in no pair. A bitmap of fixed size, broadcast, sifts out most of
them before an exact join; once the keys fill it, more rows take the exact join. Pairs of a pivot with many
members are dealt to salts, and the pivot's row is repeated for each, so that no key holds more than 1 / PARTS of
the pairs (or DEAL_FROM of them). In the pair-by-pair step members of a group's largest component meet the others, never each other.

The number of links counts for every document all others that reach the similarity. Links lie inside classes,
so each class is cut into blocks by hash and every pair of blocks is one group: the elements' incidence
matrices are multiplied, which gives the exact intersection of every pair, and a link counts for as many
documents as its other set stands for. Tasks are bounded by blocks; work grows with the square of a class.

Result: one row per row of the input. Cases: every row is a document; texts without words (null, empty, blank)
have an empty set and link with nothing; with fewer than n words the whole sequence is one shingle; rows with a
null id link with nothing; rows that share an id and differ in text link each by its own text, and what any of
them reaches is reachable by the id; rows that repeat are kept; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import kernel
from tidemark.llm.components import connected
from tidemark.llm.storage import discard, written

FOLD_LONGS = 16
BLOCK_ROWS, BLOCK_CHARS = 256, 4 << 20
PARTS, DEAL_FROM = 1024, 1024
SIEVE_BITS = 1 << 25
NONE = np.empty(0, np.int64)


def band_of(size: int, num: int, den: int) -> tuple[int, int, int]:
    """Number, least and greatest size of the band that holds size."""
    low, i = 1, 0
    while True:
        nxt = low * den // num + 1
        if size < nxt:
            return i, low, nxt - 1
        low, i = nxt, i + 1


def below(mean: float, least: int) -> float:
    """Probability that a Poisson number is below least."""
    return math.exp(-mean) * sum(mean**j / math.factorial(j) for j in range(least))


@lru_cache(maxsize=4096)
def instance(i: int, num: int, den: int) -> tuple[int, int, int, int, int, int]:
    """k, n1, n2, k2, E and least of the instance whose smaller sets lie in band i."""
    low = 1
    for _ in range(i):
        low = low * den // num + 1
    top = low * den // num
    k = top * (den - num) // num
    k2 = 1 if 100 * num >= 85 * den and k else 0
    n2 = 3 if k2 else 1
    need = k // (k2 + 1) + 1
    for least in (4, 3, 2, 1):
        for n1 in range(need, need + need // 3 + 3):
            poor = n1 * math.comb(n2, k2) * below(low * (n2 - k2) / (n1 * n2), least)
            if poor + 4.5 * math.sqrt(poor) <= n1 - need + 1e-4:
                return k, n1, n2, k2, n1 - need, least
    return k, need, n2, k2, 0, 1


def signatures(elements: np.ndarray, num: int, den: int) -> np.ndarray:
    """The signatures of a set, for the instances of its band and of the band below."""
    if not len(elements):
        return np.empty(0, np.uint64)
    band, _, _ = band_of(len(elements), num, den)
    spread = kernel.mix(elements ^ np.uint64(0x5851F42D4C957F2D))
    out = []
    for i in (band, band - 1):
        if i < 0:
            continue
        k, n1, n2, k2, spare, least = instance(i, num, den)
        if not k:
            continue  # only equal sets can link, and they have been joined
        part = (spread % np.uint64(n1 * n2)).astype(np.int64)
        total = np.zeros(n1 * n2, np.uint64)
        np.add.at(total, part, elements * kernel.BASE + np.uint64(i + 1))
        count = np.bincount(part, minlength=n1 * n2).reshape(n1, n2)
        total = kernel.mix(total).reshape(n1, n2)
        names = kernel.mix(np.arange(n1, dtype=np.uint64) + np.uint64((i + 1) << 32))
        poor = []
        found = []
        for c, choice in enumerate(combinations(range(n2), n2 - k2)):
            h = names + np.uint64(c)
            for j in choice:
                h = kernel.mix(h * kernel.BASE + total[:, j])
            found.append(h)
            poor.append(count[:, choice].sum(axis=1) < least)
        found, poor = np.concatenate(found), np.stack(poor)
        if poor.any(axis=0).sum() <= spare:
            found = found[~poor.ravel()]
        out.append(found)
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def shingle_sets(words: kernel.Words, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    runs = kernel.window_hashes(words.hash, n)
    for a, b in zip(words.first.tolist(), words.first[1:].tolist(), strict=False):
        if b - a >= n:
            yield np.unique(runs[a : b - n + 1])
        elif b > a:
            yield kernel.window_hashes(words.hash[a:b], b - a) ^ np.uint64(b - a)
        else:
            yield np.empty(0, np.uint64)


def parity_sketch(elements: np.ndarray) -> np.ndarray:
    """Bits that each element flips one of, as longs; 2 to 4 bits an element, a power of two of FOLD_LONGS at least."""
    longs = FOLD_LONGS
    while 64 * longs < 2 * len(elements):
        longs *= 2
    bits = np.bincount((elements & np.uint64(64 * longs - 1)).astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def lists(arrays: list[np.ndarray]) -> pa.ListArray:
    at = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(arrays) if arrays else [], pa.int64()))


def describe(n: int, num: int, den: int):
    """mapInArrow function: id, mark, size and set hash of every text, signatures and sketch of the first of a task with this set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for words in kernel.slices(batch.column("text"), lower=True):
                size, h1, h2, signed, sketch = [], [], [], [], []
                for e in shingle_sets(words, n):
                    size.append(len(e))
                    h1.append(kernel.mix(e).sum(dtype=np.uint64).astype(np.int64))
                    h2.append(kernel.mix(e ^ np.uint64(0xDA942042E4DD58B5)).sum(dtype=np.uint64).astype(np.int64))
                    first = (h1[-1], h2[-1]) not in seen
                    seen.add((h1[-1], h2[-1]))
                    signed.append(signatures(e, num, den).view(np.int64) if first else NONE)
                    sketch.append(parity_sketch(e) if first else NONE)
                yield pa.record_batch(
                    [
                        *[batch.column(c).slice(words.rows.start, len(words.rows)) for c in ("id", "mark")],
                        pa.array(size, pa.int64()),
                        pa.array(h1, pa.int64()),
                        pa.array(h2, pa.int64()),
                        lists(signed),
                        lists(sketch),
                    ],
                    names=["id", "mark", "n", "h1", "h2", "signatures", "sketch"],
                )

    return run


def compare(n: int, num: int, den: int):
    """mapInArrow function: the pairs (a, b) whose texts' sets reach the similarity."""

    def sets(column: pa.Array) -> list[np.ndarray]:
        return [e for words in kernel.slices(column, lower=True) for e in shingle_sets(words, n)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 512):
                batch = whole.slice(first, 512)
                # A pivot's text stands in many rows of a batch; each distinct text becomes a set once.
                sides = []
                for name in ("text_a", "text_b"):
                    coded = batch.column(name).dictionary_encode()
                    made = sets(coded.dictionary)
                    sides.append([made[i] for i in coded.indices.to_pylist()])
                keep = []
                for x, y in zip(*sides, strict=True):
                    both = np.concatenate([x, y])
                    both.sort()
                    common = int((both[1:] == both[:-1]).sum())
                    keep.append(common > 0 and den * common >= num * (len(x) + len(y) - common))
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def sizes_fit(n_a: Column, n_b: Column, num: int, den: int) -> Column:
    return (F.least(n_a, n_b) * den >= F.greatest(n_a, n_b) * num) & (F.least(n_a, n_b) > 0)


def within(bits: Column, n_a: Column, n_b: Column, num: int, den: int) -> Column:
    """Whether so many differing bits leave the similarity possible."""
    return bits * (num + den) <= (n_a + n_b) * (den - num)


def fold(sketch: Column, longs: int = FOLD_LONGS) -> Column:
    """The sketch at a shorter length."""
    at = lambda i: F.aggregate(F.sequence(F.lit(i), F.size(sketch) - 1, F.lit(longs)), F.lit(0).cast("long"), lambda a, j: a.bitwiseXOR(F.get(sketch, j)))
    return F.array(*[at(i) for i in range(longs)])


def differing(a: Column, b: Column) -> Column:
    """Differing bits of two sketches, the longer one folded to the shorter (at most once)."""
    m = F.least(F.size(a), F.size(b))
    part = lambda x, i: F.get(x, i).bitwiseXOR(F.coalesce(F.get(x, i + m), F.lit(0).cast("long")))
    return F.aggregate(F.sequence(F.lit(0), m - 1), F.lit(0), lambda n, i: n + F.bit_count(part(a, i).bitwiseXOR(part(b, i))))


def sifted(rows: DataFrame, keys: DataFrame, on: list[str], out: bool = False) -> DataFrame:
    """rows without most of those whose columns `on` are not in keys; with out, only rows that are surely not.

    The broadcast bitmap has SIEVE_BITS bits, whatever the number of keys.
    """
    words = SIEVE_BITS // 64
    at, held = unused(rows, "line"), unused(rows, "bits")
    spot = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in on], F.lit(7)), F.lit(SIEVE_BITS))
    line, word = F.shiftright(spot, 12).cast("int"), F.shiftright(spot, 6).bitwiseAND(F.lit(63)).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), spot.bitwiseAND(F.lit(63)).cast("int"))
    # A line of the bitmap is one row with 64 words, so that the broadcast table is little more than its bits.
    bits = keys.select(line.alias(at), word.alias("word"), bit.alias("bit")).groupBy(at, "word").agg(F.bit_or("bit").alias("bit"))
    bits = bits.groupBy(at).agg(F.map_from_entries(F.collect_list(F.struct("word", "bit"))).alias("words"))
    bits = bits.select(at, F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.coalesce(F.try_element_at("words", i), F.lit(0).cast("long"))).alias(held))
    known = F.coalesce(F.get(F.col(held), word).bitwiseAND(bit), F.lit(0)) != 0
    return rows.join(F.broadcast(bits), line == F.col(at), "left").where(~known if out else known).drop(at, held)


def paired(pairs: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """pairs (a, b, ...; written) with the columns of both out of table (at, ...), as <column>_a and <column>_b."""
    total = pairs.count()
    each, out = max(total / PARTS, DEAL_FROM), pairs
    for side, other in (("a", "b"), ("b", "a")):
        if total <= each:  # no key can hold more
            out = out.join(table.select(F.col("at").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns]), side)
            continue
        many = pairs.groupBy(F.col(side).alias("at")).count().where(F.col("count") > each)
        many = F.broadcast(many.select("at", F.ceil(F.col("count") / each).cast("int").alias("salts")))
        salts = F.coalesce("salts", F.lit(1))
        left = out.join(many.withColumnRenamed("at", side), side, "left").withColumn("salt", F.pmod(F.xxhash64(other), salts).cast("int")).drop("salts")
        right = table.join(many, "at", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
        right = right.select(F.col("at").alias(side), "salt", *[F.col(c).alias(f"{c}_{side}") for c in columns])
        out = left.join(right, [side, "salt"]).drop("salt")
    return out


def plausible(pairs: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b, ...) that sizes and whole sketches leave possible."""
    n_a, n_b = F.col("n_a"), F.col("n_b")
    near = sizes_fit(n_a, n_b, num, den) & within(differing(F.col("sketch_a"), F.col("sketch_b")), n_a, n_b, num, den)
    return paired(pairs, sketches, ["n", "sketch"]).where(near).select(*pairs.columns)


def texts_of(nodes: DataFrame, sets: DataFrame, rows: DataFrame) -> DataFrame:
    """at and text of every node (at, h1, h2), by one row that holds the set."""
    held = sifted(sets.where("id is not null").select("id", "mark", "h1", "h2"), nodes, ["h1", "h2"]).join(nodes, ["h1", "h2"])
    one = written(held.groupBy("at").agg(F.min(F.struct("id", "mark")).alias("row")).select("at", "row.id", "row.mark"), "held")
    return written(sifted(rows, one, ["id", "mark"]).join(one, ["id", "mark"]).select("at", "text").dropDuplicates(["at"]), "texts")


def verified(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, rows: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that link, written."""
    needed = pairs.select(F.col("a").alias("at")).union(pairs.select("b")).distinct()
    texts = texts_of(nodes.join(needed, "at", "left_semi"), sets, rows)
    links = written(paired(pairs.select("a", "b"), texts, ["text"]).select("a", "b", "text_a", "text_b").mapInArrow(compare(n, num, den), "a long, b long"), "links")
    discard(texts)
    return links


def intersections(xs: list[np.ndarray], ys: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Number of common elements of every x and y, by products of incidence matrices of so many columns."""
    every = xs + ys
    values, column, seen = np.unique(np.concatenate(every), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(every)), [len(e) for e in every])
    order = np.argsort(column, kind="stable")
    order = order[seen[column[order]] > 1]
    row, column = row[order], column[order]
    out = np.zeros((len(xs), len(ys)))
    for first in range(0, len(values), width):
        a, b = np.searchsorted(column, [first, first + width])
        if a < b:
            at = np.zeros((len(every), width), np.float32)
            at[row[a:b], column[a:b] - first] = 1
            out += at[: len(xs)] @ at[len(xs) :].T
    return out.astype(np.int64)


def links_of_blocks(n: int, num: int, den: int):
    """applyInArrow function: node and number of documents linked with, for the two blocks (side 0 and 1) of a group or the one."""

    def run(rows: pa.Table) -> pa.Table:
        sets = [e for words in kernel.slices(rows.column("text").combine_chunks(), lower=True) for e in shingle_sets(words, n)]
        side, weight = rows.column("side").to_numpy(), rows.column("weight").to_numpy()
        size = np.array([len(e) for e in sets], np.int64)
        one = rows.column("low")[0].as_py() == rows.column("high")[0].as_py()
        x, y = (np.arange(len(sets)),) * 2 if one else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        common = intersections([sets[i] for i in x], [sets[i] for i in y])
        link = (common > 0) & (den * common >= num * (size[x][:, None] + size[y][None, :] - common))
        found = np.zeros(len(sets), np.int64)
        if one:
            np.fill_diagonal(link, False)
            found = link @ weight
        else:
            found[x], found[y] = link @ weight[y], link.T @ weight[x]
        return pa.table({"at": rows.column("at"), "n_links": pa.array(found, pa.int64())})

    return run


def links_between(members: DataFrame, texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """at and n_links of members (at, component, weight): how many documents the other members it links with stand for."""
    rows = written(members.join(texts, "at"), "members")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, F.sum(F.length("text")) / BLOCK_CHARS)).cast("int")
    rows = rows.join(rows.groupBy("component").agg(F.greatest(F.lit(1), blocks).alias("blocks")), "component")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("at"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = rows.select("at", "text", "weight", "component", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), (F.col("block") > F.col("other")).cast("int").alias("side"))
    return pairs.groupBy("component", "low", "high").applyInArrow(links_of_blocks(n, num, den), "at long, n_links long").groupBy("at").agg(F.sum("n_links").alias("n_links"))


def rows_of(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """id, mark (what tells texts of one id apart) and text."""
    return docs.select(F.col(doc_id).alias("id"), mark_of(F.col(text)).alias("mark"), F.col(text).alias("text"))


def mark_of(text: Column) -> Column:
    return F.coalesce(F.xxhash64(text), F.lit(0).cast("long"))


@dataclass
class Joined:
    """What the join finds: sets (id, mark, n, h1, h2) of every row; nodes (at, h1, h2), the sets that share signatures;
    parts (at, component), those that link with another; all written."""

    rows: DataFrame
    sets: DataFrame
    nodes: DataFrame
    parts: DataFrame

    def usable(self) -> DataFrame:
        return self.sets.where("n > 0 and id is not null")

    def components(self) -> DataFrame:
        """h1, h2 and the component's c1, c2 of every set that links with another."""
        named = self.parts.join(self.nodes, "at")
        root = self.nodes.select(F.col("at").alias("component"), F.col("h1").alias("c1"), F.col("h2").alias("c2"))
        return named.join(root, "component").select("h1", "h2", "c1", "c2")


def join(rows: DataFrame, n: int, num: int, den: int) -> Joined:
    """The similarity join of rows (id, mark, text)."""
    kind = dict(rows.dtypes)["id"]
    described = written(rows.mapInArrow(describe(n, num, den), f"id {kind}, mark long, n long, h1 long, h2 long, signatures array<long>, sketch array<long>"), "described")
    sets = written(described.select("id", "mark", "n", "h1", "h2"), "sets")
    signed = described.where((F.size("signatures") > 0) & F.col("id").isNotNull())
    each = signed.select("h1", "h2", F.explode("signatures").alias("s"))
    # Copies of a set share h1, so least and greatest tell whether different sets meet in a signature.
    often = written(each.groupBy("s").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low < high").select("s"), "often")
    met = written(sifted(each, often, ["s"]).distinct().join(often, "s", "left_semi"), "met")
    discard(often)
    shares = met.groupBy("h1", "h2").agg(F.count("*").alias("rank"))
    found = sifted(signed.select("h1", "h2", "n", "sketch"), shares, ["h1", "h2"]).dropDuplicates(["h1", "h2"]).join(shares, ["h1", "h2"])
    sketches = written(found.withColumn("at", F.monotonically_increasing_id()), "sketches")
    discard(described)
    nodes = sketches.select("at", "h1", "h2")
    shared = written(met.join(sketches.select("h1", "h2", "at", "rank"), ["h1", "h2"]).select("s", "at", "rank"), "shared")
    discard(met)
    pivots = shared.groupBy("s").agg(F.max(F.struct("rank", "at")).alias("p")).select("s", F.col("p.at").alias("pivot"))
    tries = written(shared.join(pivots, "s").where("at <> pivot").groupBy(F.col("at").alias("a"), F.col("pivot").alias("b")).agg(F.count("*").alias("in_common")), "tries")
    # One link joins a set to its group: the pivot it has most in common with is tried.
    first = plausible(tries, sketches, num, den).groupBy("a").agg(F.max(F.struct("in_common", "b")).alias("best"))
    first = written(first.select("a", F.col("best.b").alias("b")), "pairs")
    discard(tries)
    links = verified(first, nodes, sets, rows, n, num, den)
    parts = connected(links).withColumnRenamed("id", "at")

    # What one signature brings together but the pivots have not joined is compared pair by pair.
    of = written(shared.join(parts, "at", "left").select("s", "at", F.coalesce("component", "at").alias("component")), "of")
    discard(shared)
    sizes = of.groupBy("s", "component").agg(F.count("*").alias("size"))
    apart = sizes.groupBy("s").agg(F.count("*").alias("components"), F.max(F.struct("size", "component")).alias("top"))
    apart = apart.where("components > 1").select("s", F.col("top.component").alias("top"))
    folded = sketches.select("at", "n", fold(F.col("sketch")).alias("fold"))
    apart = written(of.join(apart, "s").join(folded, "at"), "apart")
    discard(of)
    a, b = apart.where("component <> top").alias("x"), apart.alias("y")
    bits = sum((F.bit_count(F.get("x.fold", F.lit(i)).bitwiseXOR(F.get("y.fold", F.lit(i)))) for i in range(FOLD_LONGS)), F.lit(0))
    n_a, n_b = F.col("x.n"), F.col("y.n")
    fits = sizes_fit(n_a, n_b, num, den) & within(bits, n_a, n_b, num, den)
    once = (F.col("y.component") == F.col("y.top")) | (F.col("x.at") < F.col("y.at"))
    on = (F.col("x.s") == F.col("y.s")) & (F.col("x.component") != F.col("y.component")) & once & fits
    rest = a.join(b, on).select(F.least("x.at", "y.at").alias("a"), F.greatest("x.at", "y.at").alias("b")).distinct()
    tried = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = written(rest.join(tried, ["a", "b"], "left_anti"), "rest")
    discard(apart)
    rest = written(plausible(rest, sketches, num, den), "pairs")
    if rest.limit(1).count():
        more = verified(rest, nodes, sets, rows, n, num, den)
        if more.limit(1).count():
            parts = connected(links.union(more)).withColumnRenamed("id", "at")
    return Joined(rows, sets, nodes, parts)


def near_duplicates(docs: DataFrame, n: int, similarity: tuple[int, int], doc_id: str = "doc_id", text: str = "text", count_links: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id (least id reachable by links of similarity num / den) of every row.

    With count_links also n_links, the number of other documents that the row's links with.
    """
    num, den = similarity
    joined = join(rows_of(docs, doc_id, text), n, num, den)
    sets, usable = joined.sets, joined.usable()
    root = [F.coalesce(f"c{i}", f"h{i}").alias(f"c{i}") for i in (1, 2)]
    # Copies are summed to classes before anything is joined with them.
    classes = usable.groupBy("h1", "h2").agg(F.min("id").alias("least"), F.count("*").alias("weight"))
    classes = written(classes.join(joined.components(), ["h1", "h2"], "left").select("h1", "h2", "least", "weight", *root), "classes")
    least = classes.groupBy("c1", "c2").agg(F.min("least").alias("component_id"))
    several = usable.groupBy("id").agg(F.min("mark").alias("low"), F.max("mark").alias("high")).where("low < high").select("id")
    if several.limit(1).count():
        # An id with several texts joins their components.
        nodes = written(least.withColumn("at", F.monotonically_increasing_id()), "roots")
        at = written(usable.join(several, "id").join(classes, ["h1", "h2"]).join(nodes, ["c1", "c2"]).select("id", "at").distinct(), "several")
        bridges = at.join(at.groupBy("id").agg(F.min("at").alias("first")), "id").select(F.col("at").alias("a"), F.col("first").alias("b"))
        up = nodes.join(connected(bridges).withColumnRenamed("id", "at"), "at", "left").withColumn("component", F.coalesce("component", "at"))
        least = up.join(up.groupBy("component").agg(F.min("component_id").alias("lowest")), "component").select("c1", "c2", F.col("lowest").alias("component_id"))
    classes = classes.join(least, ["c1", "c2"])
    columns = ["h1", "h2", "component_id"]
    if count_links:
        members = joined.parts.join(joined.nodes, "at").join(classes.select("h1", "h2", "weight"), ["h1", "h2"])
        texts = texts_of(members.select("at", "h1", "h2"), sets, joined.rows)
        between = written(links_between(members.select("at", "component", "weight"), texts, n, num, den), "n_links").join(joined.nodes, "at").drop("at")
        classes = classes.join(between, ["h1", "h2"], "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)) + F.col("weight") - 1)
        columns.append("n_links")
    out = sets.join(classes.select(*columns), ["h1", "h2"], "left")
    counts = (F.col("n") > 0) & F.col("id").isNotNull()
    component = F.when(counts, F.col("component_id")).otherwise(F.col("id"))
    result = [F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), component.alias("component_id")]
    if count_links:
        result.append(F.when(counts, F.col("n_links")).otherwise(0).cast("long").alias("n_links"))
    return out.select(*result)


def keep_one(docs: DataFrame, n: int = 5, similarity: tuple[int, int] = (80, 100), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs without those whose component has a smaller id (or the same with another text); of rows that repeat id and text, one.

    Rows without id or words stay. Sharing an id joins nothing here, so unrelated texts of one id both stay.
    """
    joined = join(rows_of(docs, doc_id, text), n, *similarity)
    root = [F.coalesce(f"c{i}", f"h{i}").alias(f"c{i}") for i in (1, 2)]
    usable = joined.usable()
    classes = usable.groupBy("h1", "h2").agg(F.min(F.struct("id", "mark")).alias("least"), F.count("*").alias("weight"))
    classes = written(classes.join(joined.components(), ["h1", "h2"], "left").select("h1", "h2", "least", "weight", *root), "classes")
    kept = classes.groupBy("c1", "c2").agg(F.min("least").alias("kept"), F.sum("weight").alias("rows")).where("rows > 1")
    several = written(classes.join(kept, ["c1", "c2"]).select("h1", "h2", "kept"), "several")
    named = written(sifted(usable.select("h1", "h2", "id", "mark"), several, ["h1", "h2"]).join(several, ["h1", "h2"]), "named")
    others = written(named.where(F.struct("id", "mark") != F.col("kept")).select("id", "mark").distinct(), "others")
    key = unused(docs, "key")
    keyed = docs.withColumn(key, F.struct(F.col(f"`{doc_id}`").alias("id"), mark_of(F.col(f"`{text}`")).alias("mark")))
    names = others.select(F.struct("id", "mark").alias(key))
    clear = sifted(keyed, names, [key], out=True)
    out = clear.unionByName(sifted(keyed, names, [key]).join(names, key, "left_anti"))
    again = written(named.groupBy("id", "mark").count().where("count > 1").select(F.struct("id", "mark").alias(key)), "again")
    if again.limit(1).count():
        out = out.join(again, key, "left_anti").unionByName(out.join(again, key, "left_semi").dropDuplicates([key]))
    return out.drop(key)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    names = {c.lower() for c in df.columns}
    while name in names:
        name += "_"
    return name
