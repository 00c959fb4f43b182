"""Vectorised word arithmetic on Arrow string columns.

A word is a maximal run of bytes other than ASCII white space (0x20, 0x09-0x0D).
Words are turned into 64-bit hashes straight from the column's byte buffer, so no
Python object is made per word. Columns are worked through in slices of about a MB of
text to bound memory; a single longer text is one slice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))

IS_WORD = np.ones(256, dtype=bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64-bit result (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.empty(n + 1, dtype=np.uint64)
    out[0] = 1
    out[1:] = base
    return np.multiply.accumulate(out)


_POWERS = {"up": powers(BASE, 1 << 16), "down": powers(BASE_INVERSE, 1 << 16)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n >= len(_POWERS["up"]):
        return powers(BASE, n), powers(BASE_INVERSE, n)
    return _POWERS["up"], _POWERS["down"]


@dataclass
class Words:
    """Words of consecutive texts: words first[i]..first[i+1] belong to text i of rows."""

    rows: range
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows)), np.diff(self.first))

    @cached_property
    def raw(self) -> bytes:
        return self.data.tobytes()

    def joined(self, words: np.ndarray | slice) -> bytes:
        """The given words with one space between."""
        raw = self.raw
        return b" ".join([raw[a:b] for a, b in zip(self.start[words].tolist(), self.end[words].tolist(), strict=True)])


def plain(column: pa.Array) -> pa.Array:
    """The column as large_string or large_binary; nulls become empty texts."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        return pc.fill_null(column.cast(pa.large_binary()), b"")
    return pc.fill_null(column.cast(pa.large_string()), "")


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each data[start:end], by differences of one running polynomial."""
    if not len(start):
        return np.empty(0, dtype=np.uint64)
    out = np.empty(len(start), dtype=np.uint64)
    # The polynomial restarts every 2**15 bytes at a word start, to keep tables of powers small.
    cut = [0]
    limit = 1 << 15
    while cut[-1] < len(start):
        nxt = int(np.searchsorted(start, start[cut[-1]] + limit))
        cut.append(max(nxt, cut[-1] + 1))
    for a, b in zip(cut, cut[1:], strict=False):
        lo, hi = int(start[a]), int(end[min(b, len(end)) - 1])
        up, down = _powers(hi - lo + 1)
        run = np.empty(hi - lo + 1, dtype=np.uint64)
        run[0] = 0
        np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * up[: hi - lo], out=run[1:])
        s, e = start[a:b] - lo, end[a:b] - lo
        out[a:b] = (run[e] - run[s]) * down[s]
    return mix(out + (end - start).astype(np.uint64))


def slices(column: pa.Array, lower: bool = False, is_word: np.ndarray = IS_WORD) -> Iterator[Words]:
    """The words of a column of texts, about a MB of text at a time."""
    column = plain(column)
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    buffer = column.buffers()[2]
    raw = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None and buffer.size else np.empty(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, side="right")) - 1)
        j = min(j, n)
        data = raw[offsets[i] : offsets[j]]
        data = LOWER[data] if lower else data
        inside = is_word[data]
        bounds = offsets[i : j + 1] - offsets[i]
        # A text's first byte starts a word even where the previous text ended in one.
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[bounds] = True
        before = np.empty(len(data), dtype=bool)
        if len(data):
            before[0] = False
            before[1:] = inside[:-1]
        starts = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.zeros(len(data), dtype=bool)
        if len(data):
            after[:-1] = inside[1:]
        ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        first = np.searchsorted(starts, bounds)
        yield Words(range(i, j), data, starts, ends, hashes(data, starts, ends), first)
        i = j


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive word hashes (len(words) - n + 1 of them, none if fewer)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(m, dtype=np.uint64)
    for k in range(n):
        out = out * BASE + words[k : k + m]
    return mix(out)
