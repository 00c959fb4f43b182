"""The queries of this subpackage, one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chat_format, decontaminate, ngram_join, quality, source_mix, substring_dedup, token_count, topk_search, toxicity, url_filter
from tidemark.llm.storage import bound_batches, table


def tokenizer_file(name: str) -> bytes:
    """A public tokenizer's file, as bytes that travel with the tasks."""
    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_bytes()


RULES = {"org/": True, "example.org/es/": False, "example.org/en/1": False, "com/fr/": True, "com/de/": False}


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), RULES)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_count.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    # The digests are small beside the texts they come from: in partitions, and files, of their own size.
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")).hint("rebalance")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents carry no URL; source stands for the host and language for the path."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), host="source", path="lang")


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "\\### Assistant: </turn> ok"
    extra = spark.range(1).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(tricky).alias("text")) for i, r in enumerate(["user", "assistant"])])).alias("t"),
    )
    out = chat_format.format_conversations(rows.unionByName(extra.select("conv_id", "t.turn", "t.role", "t.text")))
    out = out.select("conv_id", "formatted", chat_format.parse_turns(F.col("formatted")).alias("turns"), chat_format.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    spelled = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spelled, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = source_mix.balance(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "rate", "copies")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scores = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scores.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"), n=3, similarity=(90, 100))


def op10_ngram_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The join with the number of links of every document."""
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"), n=3, similarity=(90, 100), count_links=True)


def bounded(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(run)
    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        return run(spark, sf_dir)

    return call


def queries() -> dict:
    """Query name to function of (spark, sf_dir)."""
    return {f.__name__: bounded(f) for f in (op1_url_filter, op2_decontamination, op3_token_counts, op4_substring_dedup, op5_quality, op6_chat_formatting, op7_exact_topk, op8_source_mix, op9_toxicity, op10_ngram_join, op10_ngram_links)}
