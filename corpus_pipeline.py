"""Corpus pipeline: documents in, a clean and weighted training mix out.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read again as the
next stage's docs. All but the last return the columns of documents; the last repeats rows to the weights of
their sources and says so in columns that begin with mix_.

Cases, for every stage: a null or empty text is clean, is no duplicate, holds no passage and takes nothing in the
mix; rows with a null id are judged by their text and kept where a group has to name one by its id; rows that
repeat are judged each, of those that repeat id and text the second stage keeps one; null or unknown sources are a
source; an empty table gives an empty result; further columns, whatever their names, are carried along (mix_copy,
mix_size, mix_source_size and mix_target are replaced in the last stage).
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, ngram_join, source_mix, substring_dedup, toxicity
from tidemark.llm.storage import bound_batches, discard, made, release, table, written

#: No SQL: stages hold trained models. Tests hold every stage against a version by hand on its own input.
ORACLE_SQL = None


#: Tables that the stage before made on its way, by thread and folder; its result has been written when the next stage
#: of the same run starts. Runs over one folder at the same time must be in threads of their own.
_LEFT: dict[tuple[int, str], set[str]] = {}


def stage(fn: Callable) -> Callable:
    """Deletes what the stage before left in the shared folder, then runs this one."""

    @wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        run_of = (threading.get_ident(), sf_dir)
        release(spark, _LEFT.pop(run_of, set()))
        before = made()
        out = fn(spark, docs, sf_dir)
        _LEFT[run_of] = made() - before
        return out

    return run_stage


@stage
def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold, whole texts judged; without labels of both kinds all or none."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@stage
def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates (five-word shingles, Jaccard 0.8) the one with the least id; rows without id or words stay."""
    return ngram_join.keep_one(docs, n=5, similarity=(80, 100))


@stage
def strip_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 35 words or more that stand elsewhere too; other texts stay as they are."""
    out = substring_dedup.strip_repeats(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("row.text"))
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("row.n_chars"))
    changed = {"text": text, "n_chars": n_chars}
    return out.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


@stage
def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark; with an empty benchmark all."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, none to twice."""
    return source_mix.repeat_rows(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard_join", one_of_each_group),
    ("substring_dedup", strip_repeated_passages),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("source_mix", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again, and deleted once the next one stands."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, fn in STAGES[:-1]:
        result = written(fn(spark, docs, sf_dir), name)
        if last is not None:
            discard(last)
        docs = last = result
    return STAGES[-1][1](spark, docs, sf_dir)
