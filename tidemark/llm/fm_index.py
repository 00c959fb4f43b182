"""FM-index over integer tokens, with a wavelet matrix of packed bits and searches over many patterns at once."""

from __future__ import annotations

import numpy as np


def suffix_order(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes ordered by their first depth tokens at least (prefix doubling; the end counts as the least token)."""
    n = len(tokens)
    rank = tokens.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    have = 1
    while have < depth:
        after = np.zeros(n, np.int64)
        after[: n - have] = rank[have:] + 1
        key = rank * (max(int(after.max(initial=0)), 1) + 1) + after
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        have *= 2
        if n and rank[order[-1]] == n - 1:
            break
    return order


class FMIndex:
    """Counts occurrences of patterns of up to depth tokens.

    Tokens are integers from 0; a token no pattern holds separates texts and ends the last. The transform
    orders suffixes by depth tokens only: for shorter patterns the ranges are the same.
    """

    def __init__(self, tokens: np.ndarray, depth: int):
        self.n = len(tokens)
        order = suffix_order(tokens, depth)
        last = tokens[order - 1].astype(np.int64)  # the token before each suffix; before the first stands the last
        sigma = int(tokens.max(initial=0)) + 1
        self.bits = max(1, int(sigma - 1).bit_length())
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(tokens, minlength=sigma))]).astype(np.int64)
        self.words, self.before, self.zeros = [], [], []
        symbols = np.arange(sigma, dtype=np.int64)
        origin = np.zeros(sigma, np.int64)  # where position 0 goes on each symbol's way down
        for level in range(self.bits - 1, -1, -1):
            bit = (last >> level) & 1
            padded = np.zeros(-(-(self.n + 1) // 64) * 64, np.uint8)
            padded[: self.n] = bit
            word = np.packbits(padded, bitorder="little").view(np.uint64)
            self.words.append(word)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(word).astype(np.int64))]).astype(np.int32))
            self.zeros.append(int(self.n - bit.sum()))
            last = np.concatenate([last[bit == 0], last[bit == 1]])
            origin = self._down(len(self.words) - 1, origin, (symbols >> level) & 1)
        self.shift = self.begin[:sigma] - origin

    def _down(self, level: int, at: np.ndarray, bit: np.ndarray) -> np.ndarray:
        word = at >> 6
        inside = self.words[level][word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        ones = self.before[level][word] + np.bitwise_count(inside)
        return np.where(bit == 1, self.zeros[level] + ones, at - ones)

    def extend(self, token: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of token + pattern from ranges of pattern: one backward step of every search."""
        both = np.concatenate([low, high])
        twice = np.concatenate([token, token])
        for level in range(self.bits):
            both = self._down(level, both, (twice >> (self.bits - 1 - level)) & 1)
        both += self.shift[twice]
        return both[: len(low)], both[len(low) :]

    def repeated(self, text: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
        """For windows text[start:start+length]: -1 if one occurs twice at least, else the offset at which
        the backward search fell below two occurrences (the window's tokens from there on are not repeated)."""
        failed = np.full(len(start), -1, np.int64)
        live = np.arange(len(start))
        token = text[start + length - 1]
        low, high = self.begin[token], self.begin[token + 1]
        for offset in range(length - 1, -1, -1):
            if offset < length - 1:
                low, high = self.extend(text[start[live] + offset], low, high)
            ok = high - low >= 2
            if not ok.all():
                failed[live[~ok]] = offset
                live, low, high = live[ok], low[ok], high[ok]
            if not len(live):
                break
        return failed
