"""Mixing sources to target token weights by entropy balancing.

Targets: weights repeat over the sources in code-point order (null last) and share a multiple of all
tokens; no target exceeds a multiple of its source, the excess being shared again by weight. That fixed
point is min(cap, weight * level); the level is found in one ordered pass over the source table.

Rates: the mix closest to the corpus in relative entropy that meets every source's token constraint tilts
documents exponentially, rate = exp(lambda of the source). The multipliers minimise the convex dual
sum(tokens * exp(lambda) - target * lambda); its Hessian is diagonal, so each source's Newton steps run on
its own row of grouped sums, in parallel over sources.

Copies: documents of a source are dealt by hash into groups of about GROUP_DOCS. A group takes its
documents from long to short, each as often as brings the group nearest to its expected tokens, from 0 to
the cap; what is left over is less than about half the shortest document. Groups bound memory whatever the
size of a source, and the result does not depend on the order of rows.

Cases: null or empty texts have size 0 and take nothing; a null source is a source; rows that repeat are
documents each; null ids are allowed; an empty table gives an empty result; columns other than those named
are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.storage import written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
TOTAL_SHARE = 1.5
CAP = 2
GROUP_DOCS = 1024
NEWTON_STEPS = 64
MIX_COLUMNS = ("mix_copy", "mix_size", "mix_source_size", "mix_target")


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mark_of(text: Column) -> Column:
    """What tells texts of rows with one id apart."""
    return F.coalesce(F.xxhash64(text), F.lit(0).cast("long"))


def source_targets(sources: DataFrame, weights: tuple = WEIGHTS, total_share: float = TOTAL_SHARE, cap: float = CAP) -> DataFrame:
    """Adds target to rows (source, source_size, n_docs), one per source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1
    out = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place)).withColumn("most", F.col("source_size") * float(cap))
    # In order of cap per weight, a prefix of the sources is capped.
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    out = out.withColumn("capped", F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    out = out.withColumn("open", F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    total = F.sum("source_size").over(Window.partitionBy()) * float(total_share)
    out = out.withColumn("level", (total - F.col("capped")) / F.col("open"))
    # Capping one more source raises the level as long as that source lies below it: the largest level is the right one.
    level = F.max("level").over(Window.partitionBy())
    out = out.withColumn("target", F.least(F.col("most"), level * F.col("weight")))
    return out.select("source", "source_size", "n_docs", "target")


def multiplier(tokens: Column, target: Column) -> Column:
    """Newton iterations for lambda in tokens * exp(lambda) = target; the step is bounded so that the first cannot overshoot."""
    step = lambda x, _: F.greatest(F.lit(-60.0), x - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - try_ratio(target, tokens) * F.exp(-x))))
    return F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON_STEPS)), F.lit(0.0), step)


def try_ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def round_group(rows: pa.Table) -> pa.Table:
    """Whole copies of one group's documents, from long to short."""
    rows = rows.sort_by([("size", "descending"), ("spread", "ascending")])
    copies, due, used = [], 0.0, 0
    for size, rate, most in zip(*(rows.column(c).to_pylist() for c in ("size", "rate", "cap")), strict=True):
        due += rate * size
        times = min(most, max(0, int((due - used) / size + 0.5))) if size else 0
        used += times * size
        copies.append(times)
    return rows.append_column("copies", pa.array(copies, pa.int64())).select(["doc_id", "source", "mark", "size", "source_size", "target", "rate", "copies"])


def balance(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple = WEIGHTS, total_share: float = TOTAL_SHARE, cap: int = CAP) -> DataFrame:
    """doc_id, source, mark (hash of the text), size, source_size, target, rate and copies of every row."""
    sizes = written(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size_of(F.col(text)).alias("size"), mark_of(F.col(text)).alias("mark")), "sizes")
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    tilted = source_targets(sources, weights, total_share, cap)
    tilted = tilted.withColumn("rate", F.least(F.lit(float(cap)), F.exp(multiplier(F.col("source_size"), F.col("target")))))
    tilted = tilted.withColumn("rate", F.when(F.col("target") <= 0, F.lit(0.0)).otherwise(F.col("rate"))).withColumnRenamed("source", "of")
    rows = sizes.join(written(tilted, "targets"), sizes["source"].eqNullSafe(F.col("of")))
    groups = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / GROUP_DOCS))
    rows = rows.select(
        "doc_id", "source", "mark", "size", "source_size", "target", "rate",
        F.lit(int(cap)).alias("cap"),
        F.xxhash64("doc_id", "mark", F.lit("copies")).alias("spread"),
        F.pmod(F.xxhash64("doc_id", "mark"), groups).alias("part"),
    )
    kinds = f"doc_id {dict(sizes.dtypes)['doc_id']}, source {dict(sizes.dtypes)['source']}, mark long, size long, source_size long, target double, rate double, copies long"
    return rows.groupBy("source", "part").applyInArrow(round_group, kinds)


def repeat_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix itself: every row of docs as often as the mix takes it, with copy (from 1) and the mix's figures.

    The columns mix_copy, mix_size, mix_source_size and mix_target replace those of docs that have these names.
    Rows that agree in id, source and text share the sum of their copies: each has its whole part, the first rows one more.
    """
    taken = balance(docs, doc_id, text, source, **options)
    taken = taken.groupBy("doc_id", "source", "mark", "size", "source_size", "target").agg(F.sum("copies").alias("copies"), F.count("*").alias("n")).where("copies > 0")
    taken = taken.select(*[F.col(c).alias(f"{c}_of_mix") for c in taken.columns])
    own = [F.col(f"`{c}`") for c in docs.columns]
    named = docs.select(F.struct(*own).alias("row"), F.col(doc_id).alias("id"), mark_of(F.col(text)).alias("mark"), F.col(source).alias("source"))
    on = F.col("id").eqNullSafe(F.col("doc_id_of_mix")) & (F.col("mark") == F.col("mark_of_mix")) & F.col("source").eqNullSafe(F.col("source_of_mix"))
    figures = [F.col(f"{c}_of_mix").alias(f"mix_{c}") for c in ("size", "source_size", "target")]
    rows = written(named.join(written(taken, "taken"), on).select("row", *[f"{c}_of_mix" for c in ("doc_id", "source", "mark", "n", "copies")], *figures, F.monotonically_increasing_id().alias("place")), "rows")
    least = F.floor(F.col("copies_of_mix") / F.col("n_of_mix"))
    more = F.col("copies_of_mix") % F.col("n_of_mix")
    once = rows.where("n_of_mix = 1 or copies_of_mix % n_of_mix = 0").withColumn("copies", least)
    # Repeated rows are numbered in parts of about GROUP_DOCS, so that no group lands in one task.
    key = ["doc_id_of_mix", "source_of_mix", "mark_of_mix"]
    part = F.pmod(F.xxhash64("place"), F.ceil(F.col("n_of_mix") / GROUP_DOCS)).alias("part")
    repeated = rows.where("n_of_mix > 1 and copies_of_mix % n_of_mix <> 0").select("*", part)
    parts = repeated.groupBy(*key, "part").agg(F.count("*").alias("in_part"))
    before = F.coalesce(F.sum("in_part").over(Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*[F.col(c).alias(f"{c}_") for c in (*key, "part")], before.alias("before"))
    same = F.col("part") == F.col("part_")
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_"))
    number = F.col("before") + F.row_number().over(Window.partitionBy(*key, "part").orderBy("place"))
    spread = repeated.join(parts, same).withColumn("copies", least + (number <= more).cast("long"))
    columns = ["row", "copies", *[f"mix_{c}" for c in ("size", "source_size", "target")]]
    each = once.select(*columns).unionByName(spread.select(*columns)).where("copies > 0")
    kept = [c for c in docs.columns if c.lower() not in MIX_COLUMNS]
    return each.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("mix_copy"), *columns[2:])
