"""Words of many texts at once, as arrays: where they are and a 64-bit hash of each.

A word is a run of ``[^\\x20\\x09-\\x0D]``. Hashes are sums over a word's bytes of fixed random
numbers per (byte, place) (tabulation hashing); they are the same on every machine.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes hashed at once; longer texts go through in blocks that end at white space.
BLOCK = 1 << 21
_PLACES = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the one of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def draw(x: np.ndarray, n: int) -> np.ndarray:
    """The ``n``-th pseudo-random 64-bit number that belongs to each ``x``."""
    return mix(x + np.uint64((n + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))


_TABLE = mix(np.arange(256 * _PLACES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x1234567))


class Words(NamedTuple):
    data: np.ndarray  # the UTF-8 bytes of all texts
    at: np.ndarray  # where each text starts, and the end
    start: np.ndarray  # of each word
    end: np.ndarray
    doc: np.ndarray  # the text that each word is in
    hash: np.ndarray

    def count(self) -> np.ndarray:
        """Words of each text."""
        return np.bincount(self.doc, minlength=len(self.at) - 1)


def split(texts: pa.Array) -> Words:
    """The words of ``texts``; a null text is empty."""
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type)
    at = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]] if texts.buffers()[2] and at[-1] > at[0] else np.zeros(0, np.uint8)
    at = at - at[0]
    word = ~SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[at] = True
    start = np.flatnonzero(word & (np.r_[True, ~word[:-1]] | cut[:-1])) if len(data) else np.zeros(0, np.int64)
    end = np.flatnonzero(word & (np.r_[~word[1:], True] | cut[1:])) + 1 if len(data) else np.zeros(0, np.int64)
    doc = np.searchsorted(at, start, "right") - 1
    return Words(data, at, start, end, doc, _hashes(data, start, end))


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out, first = np.zeros(len(start), np.uint64), 0
    while first < len(start):
        last = max(first + 1, int(np.searchsorted(end, start[first] + BLOCK, "right")))
        a, lengths = start[first], end[first:last] - start[first:last]
        ends = np.cumsum(lengths)
        place = np.arange(ends[-1]) - np.repeat(ends - lengths, lengths)
        byte = data[a + np.repeat(start[first:last] - a, lengths) + place].astype(np.int64)
        value = _TABLE[byte + (place % _PLACES) * 256]
        if lengths.max() > _PLACES:
            far = place >= _PLACES
            value[far] = mix(value[far] + (place[far] // _PLACES).astype(np.uint64))
        out[first:last] = mix(np.add.reduceat(value, ends - lengths) + lengths.astype(np.uint64))
        first = last
    return out


def windows(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of the ``n`` words from each word on, and whether they lie in one text."""
    if len(words.hash) < n:
        return np.zeros(len(words.hash), np.uint64), np.zeros(len(words.hash), bool)
    out, size = words.hash.copy(), len(words.hash) - n + 1
    for k in range(1, n):
        out[:size] = mix(out[:size]) + words.hash[k : k + size]
    whole = np.zeros(len(out), bool)
    whole[:size] = words.doc[n - 1 :] == words.doc[:size]
    return mix(out), whole
