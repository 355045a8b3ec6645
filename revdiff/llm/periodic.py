"""Periodic runs in the word sequences of texts, from an enhanced suffix array.

A run with period q ends in a square (two equal halves of q words) whose halves are followed by
different words. Suffixes i and i + q have then exactly q words in common: both lie in an LCP
interval of depth q, in different children of it. So for each LCP interval it is enough to take
the suffixes of all children but the largest and look up, in the inverse suffix array, whether
the suffix ``depth`` words after or before lies in the interval as well. Each such square is
rotated to the left while words agree, which gives its run; squares of a run become one.

There is no suffix tree: intervals are pairs of places in the suffix array, found for all places
at once. The suffixes of a batch of texts are sorted together by prefix doubling; ranks of each
doubling are kept and answer how far two suffixes agree. Texts never share symbols.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from revdiff.llm.common import byte_slices

#: A run has at least this many words, and at least so many periods.
MIN_WORDS, MIN_PERIODS = 6, 4


class SuffixArray(NamedTuple):
    order: np.ndarray  # the suffixes, sorted
    place: np.ndarray  # of each suffix in ``order``
    common: np.ndarray  # words that a place's suffix shares with the place before; 0 at both ends
    ranks: list[np.ndarray]  # ranks by the first 1, 2, 4, ... words; one more entry, that equals nothing


def suffix_array(symbol: np.ndarray, stop: np.ndarray) -> SuffixArray:
    """Of ``symbol`` (whole numbers); ``stop[i]`` is the end of the text of place i, and no two texts share a symbol."""
    n = len(symbol)
    order = np.argsort(symbol, kind="stable")
    first = np.r_[True, symbol[order[1:]] != symbol[order[:-1]]]
    rank = np.full(n + 1, -1, np.int32)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    ranks, size = [rank], 1
    while True:
        alone = first & np.r_[first[1:], True]
        open_ = np.flatnonzero(~alone)  # groups of suffixes not told apart yet; each stays in its places
        if not len(open_):
            break
        suffix = order[open_]
        then = np.where(suffix + size < stop[suffix], rank[np.minimum(suffix + size, n)], -1).astype(np.int64)
        key = rank[suffix].astype(np.int64) * (n + 1) + then + 1
        by = np.argsort(key, kind="stable")
        key, suffix = key[by], suffix[by]
        order[open_], first[open_] = suffix, np.r_[True, key[1:] != key[:-1]]
        rank = rank.copy()
        rank[suffix] = np.maximum.accumulate(np.where(first[open_], open_, 0))
        ranks.append(rank)
        size *= 2
    common = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(ranks[0][order[1:]] == ranks[0][order[:-1]]) + 1
    common[at] = agreeing(ranks, order[at - 1], order[at])
    return SuffixArray(order, rank[:n], common, ranks)


def agreeing(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words the suffixes at ``a`` and ``b`` (never the same) have in common."""
    a, b, out = a.copy(), b.copy(), np.zeros(len(a), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        step = np.where(ranks[level][a] == ranks[level][b], 1 << level, 0)
        a, b, out = a + step, b + step, out + step
    return out


def _bounds(common: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each place in ``at``: the nearest places before and after it with fewer common words."""
    out = []
    for step in (-1, 1):
        near = np.clip(np.arange(len(common)) + step, 0, len(common) - 1)
        left = at
        while len(left):  # places in between have as many words at least, so their own bounds may be jumped to
            far = near[left]
            more = common[far] >= common[left]
            near[left[more]] = near[far[more]]
            left = left[more]
        out.append(near[at])
    return out[0], out[1]


def _smaller_children(sa: SuffixArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places in the suffix array of all suffixes in all but the largest child of each LCP
    interval, with the interval's bounds and depth. A suffix comes at most log2(n) times."""
    at = np.flatnonzero(sa.common)
    low, high = _bounds(sa.common, at)
    by = np.lexsort((at, high, low))
    at, low, high = at[by], low[by], high[by]
    new = np.flatnonzero(np.r_[True, (low[1:] != low[:-1]) | (high[1:] != high[:-1])]) if len(at) else at
    interval = np.repeat(np.arange(len(new)), np.diff(np.r_[new, len(at)]))
    # children start at the interval's lower bound and at each place with the interval's depth
    start = np.insert(at, new, low[new])
    owner = np.insert(interval, new, np.arange(len(new)))
    end = np.r_[start[1:], 0]
    last = np.flatnonzero(np.r_[owner[1:] != owner[:-1], True]) if len(owner) else owner
    end[last] = high[new]
    size = end - start
    heads = new + np.arange(len(new))
    by_size = np.lexsort((-size, owner))
    keep = np.ones(len(size), bool)
    keep[by_size[heads]] = False
    start, size, owner = start[keep], size[keep], owner[keep]
    place = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
    owner = np.repeat(owner, size)
    return place, low[new][owner], high[new][owner], sa.common[at[new]][owner]


def find_runs(symbol: np.ndarray, start: np.ndarray, stop: np.ndarray, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS):
    """``(start, end, period)`` of all runs, by start, then period; ``start[i], stop[i]`` are the
    bounds of the text of place i, and no two texts share a symbol."""
    n = len(symbol)
    none = np.zeros(0, np.int64)
    if not n:
        return none, none, none
    sa = suffix_array(symbol, stop)
    place, low, high, depth = _smaller_children(sa)
    i = sa.order[place]
    squares, periods = [], []
    for square, other in ((i, i + depth), (i - depth, i - depth)):  # the halves after, or before, suffix i
        inside = np.flatnonzero((other >= start[i]) & (other < stop[i]))
        there = sa.place[other[inside]]
        inside = inside[(there >= low[inside]) & (there < high[inside])]
        squares.append(square[inside])
        periods.append(depth[inside])
    square, period = np.concatenate(squares), np.concatenate(periods)
    end = square + 2 * period
    padded = np.r_[symbol, -1]
    branching = (end == stop[square]) | (padded[end] != padded[square + period])  # in different children
    long_ = (end - np.maximum(min_words, min_periods * period) >= start[square]) & branching
    square, period, end = square[long_], period[long_], end[long_]
    begin = _rotated(sa.ranks, square, period, start[square])
    whole = end - begin >= np.maximum(min_words, min_periods * period)
    begin, end, period = begin[whole], end[whole], period[whole]
    by = np.lexsort((period, end, begin))  # multiples of a period give the same bounds; the smallest is the run's
    begin, end, period = begin[by], end[by], period[by]
    once = np.flatnonzero(np.r_[True, (begin[1:] != begin[:-1]) | (end[1:] != end[:-1])]) if len(begin) else none
    begin, end, period = begin[once], end[once], period[once]
    by = np.lexsort((period, begin))
    return begin[by], end[by], period[by]


def _rotated(ranks: list[np.ndarray], square: np.ndarray, period: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The leftmost rotations of squares: how far the words before both halves agree, in steps of powers of two."""
    at = square.copy()

    def step(which: np.ndarray, level: int) -> np.ndarray:
        back = at[which] - (1 << level)
        fits = back >= start[which]
        same = np.zeros(len(which), bool)
        same[fits] = ranks[level][back[fits]] == ranks[level][back[fits] + period[which[fits]]]
        at[which[same]] = back[same]
        return which[same]

    top, left = len(ranks) - 1, np.arange(len(at))
    while len(left):
        left = step(left, top)
    for level in range(top - 1, -1, -1):
        step(np.arange(len(at)), level)
    return at


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 1 << 20) -> DataFrame:
    """``id_col, n_words, runs, collapsed``: one row per row of ``docs``.

    Words are runs of ``[^\\x20\\x09-\\x0D]``, numbered from 0. ``runs`` has ``start, length, period``
    of every longest stretch of words that repeats with that (smallest) period and has at least 6
    words and 4 periods, by start, then period. ``collapsed`` is the text without the words that a
    run holds after its first period, joined by one space.

    A null or empty text, or one without words, has no runs and an empty ``collapsed``. Null and
    repeated ids don't matter, each row stands for itself. A text is worked on as a whole, in about
    150 bytes a word. Nothing is shuffled, so no source or copied text is a hot key. An empty table
    gives no rows. Other columns are not read.
    """
    rows = docs.select(docs[id_col], docs[text_col])
    run = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    schema = T.StructType([
        T.StructField(id_col, rows.schema[0].dataType), T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(run)),
        T.StructField("collapsed", T.StringType()),
    ])

    def search(batches):
        for batch in byte_slices(batches, 1, batch_bytes):
            words = [x.encode().split() for x in batch.column(1).fill_null("").to_pylist()]  # bytes are split at [\x20\x09-\x0D] alone
            count = np.array([len(x) for x in words], np.int64)
            at = np.r_[0, np.cumsum(count)]
            word = pa.array([x for own in words for x in own], pa.binary()).dictionary_encode().indices.to_numpy()
            symbol = word.astype(np.int64) + np.repeat(np.arange(len(words)), count) * (len(word) + 1)
            begin, end, period = find_runs(symbol, np.repeat(at[:-1], count), np.repeat(at[1:], count))
            doc = np.searchsorted(at, begin, "right") - 1
            doubled = np.zeros(len(word) + 1, np.int64)
            np.add.at(doubled, begin + period, 1)
            np.add.at(doubled, end, -1)
            kept = np.cumsum(doubled[:-1]) == 0
            hit = set(doc.tolist())
            texts = [b" ".join(np.array(x, object)[kept[at[k] : at[k + 1]]] if k in hit else x).decode() for k, x in enumerate(words)]
            runs = pa.StructArray.from_arrays([pa.array(begin - at[doc]), pa.array(end - begin), pa.array(period)], names=["start", "length", "period"])
            offsets = pa.array(np.searchsorted(doc, np.arange(len(words) + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(count), pa.ListArray.from_arrays(offsets, runs), pa.array(texts, pa.string())], names=schema.names
            )

    return rows.mapInArrow(search, schema)
