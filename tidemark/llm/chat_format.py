"""Chat formatting with Spark expressions only.

Turn structs of a conversation are collected, sorted by (turn, role, text), runs of
adjacent turns of one role are merged into one block, and blocks are concatenated:

    ### user:\\nfirst text<next/>second text</turn>\\n### assistant:\\n...</turn>\\n

Control strings cannot occur inside escaped texts: ``\\`` becomes ``\\b``, ``<`` becomes
``\\l``, ``#`` becomes ``\\h`` and, in roles, ``:`` becomes ``\\c``. Undoing l, h and c first
and b last restores every text.

Cases: null role or text counts as empty; rows with a null turn come first; rows that
repeat are kept; turns that tie are ordered by role, then text; a null conv_id is a
conversation of its own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEXT, END, HEAD, COLON = "<next/>", "</turn>\n", "### ", ":\n"


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l")), F.lit("#"), F.lit("\\h"))
    return F.replace(out, F.lit(":"), F.lit("\\c")) if role else out


def unescape(text: Column) -> Column:
    out = F.replace(F.replace(F.replace(text, F.lit("\\c"), F.lit(":")), F.lit("\\h"), F.lit("#")), F.lit("\\l"), F.lit("<"))
    return F.replace(out, F.lit("\\b"), F.lit("\\"))


def format_conversations(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = "assistant"
) -> DataFrame:
    """One row per conversation: conv, formatted, loss_spans array<struct<start,end>> (0-based code points of
    formatted that carry loss: each text of loss_role, without markers)."""
    rows = df.select(
        F.col(conv).alias("conv"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role), F.lit("")).alias("role"),
            F.coalesce(F.col(text), F.lit("")).alias("text"),
        ).alias("t"),
    )
    turns = rows.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    turns = turns.withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), escape(t["text"]).alias("text"))))
    n = F.size("turns")
    starts = F.filter(
        F.sequence(F.lit(1), n),
        lambda i: (i == 1) | (F.element_at("turns", i)["role"] != F.get("turns", i - 2)["role"]),
    )
    turns = turns.withColumn("starts", starts)
    # One struct per block: its role, its header, its merged texts.
    blocks = F.transform(
        F.arrays_zip(F.col("starts").alias("a"), F.concat(F.slice("starts", F.lit(2), F.size("starts")), F.array(n + 1)).alias("b")),
        lambda r: F.struct(
            F.element_at("turns", r["a"])["role"].alias("role"),
            F.concat(F.lit(HEAD), escape(F.element_at("turns", r["a"])["role"], role=True), F.lit(COLON)).alias("head"),
            F.transform(F.slice("turns", r["a"], r["b"] - r["a"]), lambda t: t["text"]).alias("texts"),
        ),
    )
    turns = turns.withColumn("blocks", blocks)
    formatted = F.array_join(F.transform("blocks", lambda b: F.concat(b["head"], F.array_join(b["texts"], NEXT), F.lit(END))), "")
    spans_type = "array<struct<start:bigint,end:bigint>>"

    def texts_spans(at: Column, b: Column) -> Column:
        """Fold over a block's texts: (position, spans so far)."""
        return F.aggregate(
            b["texts"],
            F.struct((at["pos"] + F.length(b["head"])).alias("pos"), at["spans"].alias("spans")),
            lambda s, x: F.struct(
                (s["pos"] + F.length(x) + len(NEXT)).alias("pos"),
                F.when(
                    b["role"] == loss_role,
                    F.concat(s["spans"], F.array(F.struct(s["pos"].alias("start"), (s["pos"] + F.length(x)).alias("end")))),
                )
                .otherwise(s["spans"])
                .alias("spans"),
            ),
        )

    folded = F.aggregate(
        "blocks",
        F.struct(F.lit(0).cast("bigint").alias("pos"), F.array().cast(spans_type).alias("spans")),
        lambda at, b: F.transform(
            F.array(texts_spans(at, b)), lambda s: F.struct((s["pos"] - len(NEXT) + len(END)).alias("pos"), s["spans"].alias("spans"))
        )[0],
    )
    return turns.select(F.col("conv").alias(conv), formatted.alias("formatted"), folded["spans"].alias("loss_spans"))


def parse_turns(formatted: Column) -> Column:
    """array<struct<role,text>> read back from a formatted conversation."""
    blocks = F.split(formatted, END, -1)
    return F.flatten(
        F.transform(
            F.slice(blocks, F.lit(1), F.size(blocks) - 1),
            lambda b: F.transform(
                F.split(F.substr(b, F.instr(b, F.lit(COLON)) + len(COLON)), NEXT, -1),
                lambda x: F.struct(
                    unescape(F.substr(b, F.lit(len(HEAD) + 1), F.instr(b, F.lit(COLON)) - len(HEAD) - 1)).alias("role"),
                    unescape(x).alias("text"),
                ),
            ),
        )
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(
        F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), ""
    )
