"""Token counts without token ids.

Each distinct pre-token is encoded once to count its pieces; a document's count is the sum over its pre-tokens of
frequency times pieces.

A sentencepiece BPE model whose pieces never hold a space mark after another character cannot merge across
"non-space, space", so texts are cut there (a model with other pieces is refused): each piece drops the one space
that the library's dummy prefix puts back.

The join has two tiers. Pre-tokens that make up much of the corpus are found by lossy counting: every task counts
what it reads and takes one off every count whenever 1 / HEAVY of that has passed, so it misses at most that share.
A pre-token whose counts still reach 1 / HEAVY of all occurrences is heavy: those of at least 2 / HEAVY are found for
sure, and there are at most HEAVY of them, whatever the corpus. They are broadcast, as text or by the digest of a
long one. All others go, counted per document, through one exchange by pre-token, are sorted, and each is encoded
where its occurrences meet. None has more than 2 / HEAVY of all occurrences, so no task gets a hot one.

Cases: each row is a document, rows that share an id (also null) or repeat included; a null text is empty and has no
tokens; an empty table gives an empty result; a text without spaces is one pre-token; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import discard, written

HEAVY = 1 << 20
LONG = 64
CUT = re.compile("(?<=[^ ]) ")


def pre_tokens(text: str) -> list[str]:
    """Pieces of text cut at each space that follows another character, without that space."""
    if not text:
        return []
    text = text.replace("▁", " ")
    return CUT.split(text) if "  " in text or text[0] == " " else text.split(" ")


def brief(p: str) -> str:
    """p, or the digest of a long one; a digest is longer than what stands for itself."""
    return p if len(p) < LONG else hashlib.sha256(p.encode()).hexdigest()


@lru_cache(maxsize=1)
def processor_of(model: bytes):
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_proto=model)
    if not splits_at_spaces(processor):
        raise ValueError("pieces of this model hold a space mark after another character")
    return processor


def splits_at_spaces(processor) -> bool:
    """Whether no piece of the model holds a space mark after another character."""
    pieces = (processor.id_to_piece(i) for i in range(processor.get_piece_size()))
    return not any("▁" in p.lstrip("▁") for p in pieces)


def pieces_of(processor, texts: list[str]) -> list[int]:
    """Number of pieces; an empty pre-token is what follows a text's last space, the space mark alone."""
    return [len(ids) if t else 1 for t, ids in zip(texts, processor.encode(texts, num_threads=1), strict=True)]


def frequent(heavy: int):
    """mapInArrow function: (p, n) of the pre-tokens lossy counting keeps, and the number of all under a null p."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, every, passed = Counter(), 0, 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                found = pre_tokens(text)
                for first in range(0, len(found), heavy):
                    part = found[first : first + heavy]
                    counts.update(part)
                    passed += len(part)
                    if passed >= heavy:
                        counts = Counter({p: n - 1 for p, n in counts.items() if n > 1})
                        passed -= heavy
                every += len(found)
        kept = list(counts.items())
        for first in range(0, len(kept), 1 << 16):
            part = kept[first : first + (1 << 16)]
            yield pa.record_batch([pa.array([p for p, _ in part], pa.string()), pa.array([n for _, n in part], pa.int64())], names=["p", "n"])
        yield pa.record_batch([pa.nulls(1, pa.string()), pa.array([every], pa.int64())], names=["p", "n"])

    return run


def count_pieces(model: bytes):
    """mapInArrow function: the brief form and number of pieces of every p."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("p").to_pylist()
            n = pieces_of(processor_of(model), texts)
            yield pa.record_batch([pa.array([brief(p) for p in texts], pa.string()), pa.array(n, pa.int32())], names=["p", "pieces"])

    return run


def frequencies(known):
    """mapInArrow function: for each document a row with its id, bytes and the tokens known so far, and (p, times) of its other pre-tokens.

    Rows of one document share a number made of the task's and the row's in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = known.value
        get, at = pieces.get, TaskContext.get().partitionId() << 33
        for batch in batches:
            ids = batch.column("doc_id")
            row, p, times = [], [], []
            n_bytes, n_tokens = [], []
            for text in batch.column("text").to_pylist():
                tokens = 0
                for q, n in Counter(pre_tokens(text)).items():
                    k = get(q if len(q) < LONG else brief(q))
                    if k is None:
                        row.append(at)
                        p.append(q)
                        times.append(n)
                    else:
                        tokens += n * k
                n_bytes.append(len(text.encode()))
                n_tokens.append(tokens)
                at += 1
            m, rest = len(ids), len(row)
            yield pa.record_batch(
                [
                    pa.array(np.concatenate([np.arange(at - m, at), np.array(row, np.int64)])),
                    pa.chunked_array([ids, pa.nulls(rest, ids.type)]).combine_chunks(),
                    pa.chunked_array([pa.nulls(m, pa.string()), pa.array(p, pa.string())]).combine_chunks(),
                    pa.array(np.concatenate([np.zeros(m, np.int64), np.array(times, np.int64)])),
                    pa.array(np.concatenate([np.array(n_bytes, np.int64), np.zeros(rest, np.int64)])),
                    pa.array(np.concatenate([np.array(n_tokens, np.int64), np.zeros(rest, np.int64)])),
                ],
                names=["row", "doc_id", "p", "times", "n_bytes", "n_tokens"],
            )

    return run


def resolve(model: bytes):
    """mapInArrow function over rows sorted by p: the tokens of each, every distinct p encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_n = None, 0
        for batch in batches:
            coded = batch.column("p").dictionary_encode()
            texts = coded.dictionary.to_pylist()
            new = [t for t in texts if t != last]
            found = dict(zip(new, pieces_of(processor_of(model), new), strict=True)) | {last: last_n}
            pieces = np.array([found[t] for t in texts] + [0], np.int64)
            tokens = batch.column("times").to_numpy() * pieces[coded.indices.fill_null(len(texts)).to_numpy()]
            if texts:
                last, last_n = texts[-1], int(pieces[len(texts) - 1])
            tokens = pa.array(tokens + batch.column("n_tokens").to_numpy())
            yield pa.record_batch([batch.column("row"), batch.column("doc_id"), batch.column("n_bytes"), tokens], names=["row", "doc_id", "n_bytes", "n_tokens"])

    return run


def heavy_pieces(docs: DataFrame, model: bytes) -> dict[str, int]:
    """Pieces of each heavy pre-token, under its brief form."""
    counts = written(docs.select("text").mapInArrow(frequent(HEAVY), "p string, n long"), "frequent")
    every = counts.where("p is null").agg(F.sum("n")).first()[0] or 0
    heavy = counts.where("p is not null").groupBy("p").agg(F.sum("n").alias("n")).where(F.col("n") >= every / HEAVY)
    found = heavy.select("p").mapInArrow(count_pieces(model), "p string, pieces int").toArrow()
    discard(counts)
    return dict(zip(found["p"].to_pylist(), found["pieces"].to_pylist(), strict=True))


def count_tokens(docs: DataFrame, model: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens for every row."""
    processor_of(model)
    kind = dict(docs.dtypes)[doc_id]
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    known = docs.sparkSession.sparkContext.broadcast(heavy_pieces(docs, model))
    rows = docs.mapInArrow(frequencies(known), f"row long, doc_id {kind}, p string, times long, n_bytes long, n_tokens long")
    met = rows.repartition(F.xxhash64(F.coalesce("p", F.col("row").cast("string")))).sortWithinPartitions("p")
    parts = met.mapInArrow(resolve(model), f"row long, doc_id {kind}, n_bytes long, n_tokens long")
    counts = parts.groupBy("row").agg(F.max("doc_id").alias(doc_id), F.sum("n_bytes").alias("n_bytes"), F.sum("n_tokens").alias("n_tokens"))
    return counts.drop("row")
