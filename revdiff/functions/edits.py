"""Edit distances of one text against many, inside an Arrow task.

Spark's ``levenshtein`` fills a table cell by cell, about 10 ns per cell. Scoring a
block needs every record against every other, so the tasks use the bit-vector
formulation (Myers 1999, Hyyro 2003). A few texts of one side are laid out in one
big integer, and each character of the other side updates all of them at once. For
small blocks the calls cost more than the bits, so the pairs of many small blocks
advance side by side as words of numpy arrays.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def edit_distances(packed: list[str], probes: list[str]) -> np.ndarray:
    """Unit-cost edit distance of every probe against every packed text."""
    lengths = np.array([len(t) for t in packed], dtype=np.int64)
    starts = np.concatenate(([0], np.cumsum(lengths + 1)))  # one spare bit after each text stops carries
    letters = np.full(int(starts[-1]), -1, dtype=np.int64)
    for at, text in zip(starts, packed):
        letters[at : at + len(text)] = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")

    def bits(where: np.ndarray) -> int:
        return int.from_bytes(np.packbits(where, bitorder="little").tobytes(), "little")

    where_letter = {chr(c): bits(letters == c) for c in np.unique(letters) if c >= 0}
    inside = bits(letters >= 0)
    first = np.zeros(len(letters), dtype=bool)
    first[starts[:-1][lengths > 0]] = True
    first = bits(first)
    width = (len(letters) + 7) // 8

    out = np.empty((len(probes), len(packed)), dtype=np.int64)
    for k, probe in enumerate(probes):
        up, down = inside, 0  # +1 / -1 steps between neighbouring rows of the current column
        for ch in probe:
            equal = where_letter.get(ch, 0)
            flat = (((equal & up) + up) ^ up) | equal | down
            rise = ((down | (inside ^ (flat | up))) << 1) | first  # a spare bit can only spill into first
            up = (((flat & up) << 1) | (inside ^ (flat | rise))) & inside
            down = rise & flat
        steps = np.zeros(len(letters) + 1, dtype=np.int64)
        for sign, value in ((1, up), (-1, down & inside)):
            raw = np.frombuffer(value.to_bytes(width, "little"), dtype=np.uint8)
            steps[1:] += sign * np.unpackbits(raw, count=len(letters), bitorder="little").astype(np.int64)
        total = np.cumsum(steps)
        out[k] = len(probe) + total[starts[:-1] + lengths] - total[starts[:-1]]
    return out


#: Characters of rows that are compared side by side.
_TOGETHER_CHARS = 4_000_000


@F.pandas_udf(T.LongType())
def pair_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edit distance of two texts of a row; null if either is null. Rows are compared side by side, those with a
    text of ``_WIDE`` letters alone, with the longer one packed."""
    out, group, chars = [None] * len(a), [], 0

    def compare():
        if group:
            texts = [t for x, y, _ in group for t in (x, y)]
            found = some_distances(texts, np.arange(0, len(texts), 2), np.arange(1, len(texts), 2))
            for (_, _, at), distance in zip(group, found.tolist(), strict=True):
                out[at] = distance
            group.clear()

    for at, (x, y) in enumerate(zip(a, b, strict=True)):
        if x is None or y is None:
            continue
        if max(len(x), len(y)) >= _WIDE:
            out[at] = int(edit_distances([max(x, y, key=len)], [min(y, x, key=len)])[0, 0])
            continue
        group.append((x, y, at))
        chars += len(x) + len(y)
        if chars >= _TOGETHER_CHARS:
            compare()
            chars = 0
    compare()
    return pd.Series(out, dtype="Int64")


_TOP = np.uint64(63)
#: Words of 64 letters that advance together: long enough for numpy, short enough for a core's caches.
_WORDS = 16_384
#: With fewer words in all, or from so many letters on one side of a block, big integers are the faster way.
_FEW_WORDS = 2_048
_WIDE = 8_192
#: Places of the table of letters by pair.
_SLOTS = 4_000_000


def _letters(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")


def pair_distances(texts: list[str], first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Unit-cost edit distance of ``texts[first[k]]`` and ``texts[second[k]]`` for every k.

    Pairs of about equal lengths advance together, the words of the longer text as rows, the pairs as columns.
    """
    length = np.array([len(t) for t in texts], np.int64)
    swap = length[first] < length[second]
    long, short = np.where(swap, second, first), np.where(swap, first, second)
    out = length[long]
    words = (out + 63) // 64
    codes = np.unique(_letters(texts))
    order = np.flatnonzero(length[short])
    order = order[np.lexsort((-length[short[order]], -words[order]))]
    at = 0
    while at < len(order):
        w = int(words[order[at]])
        end = min(len(order), at + max(1, min(_WORDS // w, _SLOTS // (len(codes) + 1))))
        some = order[at:end][np.argsort(-length[short[order[at:end]]], kind="stable")]
        out[some] = _advance([texts[k] for k in long[some]], [texts[k] for k in short[some]], w)
        at = end
    return out


def some_distances(texts: list[str], first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The same; a few pairs are scored as big integers, which is faster then."""
    length = np.array([len(t) for t in texts], np.int64)
    if int((np.maximum(length[first], length[second]) + 63).sum()) >= 64 * _FEW_WORDS:
        return pair_distances(texts, first, second)
    out = np.zeros(len(first), np.int64)
    for k in np.unique(first):
        own = np.flatnonzero(first == k)
        out[own] = edit_distances([texts[j] for j in second[own]], [texts[k]])[0]
    return out


#: Counters of letters and of neighbouring letters, for bounds.
_ONES, _TWOS = 64, 512


def _counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    length = np.array([len(t) for t in texts], np.int64)
    letters, doc = _letters(texts).astype(np.int64), np.repeat(np.arange(len(texts)), length)
    two = (letters[:-1] * 31 + letters[1:]) % _TWOS
    inside = doc[:-1] == doc[1:]
    ones = np.bincount(doc * _ONES + letters % _ONES, minlength=len(texts) * _ONES).reshape(-1, _ONES)
    twos = np.bincount(doc[:-1][inside] * _TWOS + two[inside], minlength=len(texts) * _TWOS).reshape(-1, _TWOS)
    return length, ones.astype(np.int32), twos.astype(np.int32)


def similarity_bounds(rows: list[str], cols: list[str]) -> np.ndarray:
    """What ``similarity_matrix`` can't exceed: an edit changes one letter and two pairs of neighbouring letters."""
    m, ones_r, twos_r = _counts(rows)
    n, ones_c, twos_c = _counts(cols)
    out = np.empty((len(rows), len(cols)))
    for i in range(len(rows)):
        longer = np.maximum(m[i], n)
        least = longer - np.minimum(ones_r[i], ones_c).sum(axis=1)
        pairs = longer - 1 - np.minimum(twos_r[i], twos_c).sum(axis=1)
        out[i] = 1.0 - np.maximum(least, (pairs + 1) // 2) / np.maximum(longer, 1)
    return out


def _advance(packed: list[str], probes: list[str], w: int) -> np.ndarray:
    """Edit distance of each packed text, of at most ``w`` words, and its probe; longest probes first.

    Word j takes a probe's letter one step after word j - 1, whose carries it needs, so that a step is a few
    operations on whole arrays. Probes end together: shorter ones begin later, and until then a column
    without letters and carries stays as it is. Arrays grow in laps to the columns that have begun.
    """
    m, n = (np.array([len(t) for t in side], np.int64) for side in (packed, probes))
    size, steps = len(packed), int(n[0])
    letters, probe_letters = _letters(packed), _letters(probes)
    code = np.zeros(int(max(letters.max(), probe_letters.max())) + 1, np.int64)
    code[letters] = 1
    known = np.flatnonzero(code)
    code[known] = np.arange(1, len(known) + 1)

    # a row of w words for each letter of each packed text; row 0 is for letters it does not have
    slot = np.zeros((size, len(known) + 1), np.int64)
    place = np.arange(len(letters)) - np.repeat(np.cumsum(m) - m, m)
    flat = code[letters] + np.repeat(np.arange(size) * slot.shape[1], m)
    slot.ravel()[flat] = 1
    used = np.flatnonzero(slot)
    slot.ravel()[used] = np.arange(1, len(used) + 1) * w
    table = np.zeros((len(used) + 1) * w, np.uint64)
    np.add.at(table, slot.ravel()[flat] + (place >> 6), np.left_shift(np.uint64(1), (place & 63).astype(np.uint64)))

    # the row of each step and column
    begin = steps - n
    rows = np.zeros(steps * size, np.int64)
    place = np.arange(len(probe_letters)) + np.repeat(begin - (np.cumsum(n) - n), n)
    pair = np.repeat(np.arange(size), n)
    rows[place * size + pair] = slot.ravel()[code[probe_letters] + pair * slot.shape[1]]
    rows = rows.reshape(steps, size)
    begun = np.searchsorted(begin, np.arange(steps), side="right").tolist()
    del place, pair, flat, slot

    total, width = n.copy(), 0
    for step in range(0, steps, max(32, steps // 12)):
        stop = min(steps, step + max(32, steps // 12))

        def grown(old, empty, kind=np.uint64):
            new = np.empty((*old.shape[:-1], begun[stop - 1]), kind)
            new[..., width:] = empty
            new[..., :width] = old
            return new

        if not width:
            up = down = np.empty((w, 0))
            carry, at = np.empty((2, w, 0)), np.empty((w, 0))
        if begun[stop - 1] > width:
            up, down, carry = grown(up, ~np.uint64(0)), grown(down, 0), grown(carry, 0)
            carry[0, :, width:] = 1
            at = grown(at, np.arange(w)[:, None], np.int64)
            width = begun[stop - 1]
            after, flat, spare = np.empty_like(at), np.empty_like(up), np.empty_like(up)
            step_of, moved = np.empty_like(carry), np.empty_like(carry)
            no_rise, fall, no_rise_in, fall_in = *step_of, *moved
            tops, below, fall_carry = step_of[:, :-1], carry[:, 1:], carry[1]
        for s in range(step, steps + w - 1 if stop == steps else stop):
            np.add(at[:-1], 1, after[1:])
            after[0] = rows[s, :width] if s < steps else 0
            at, after = after, at
            if s < steps:
                carry[0, 0, : begun[s]] = 0
            equal = table.take(at)
            np.bitwise_or(equal, fall_carry, equal)
            np.bitwise_and(equal, up, flat)
            np.add(flat, up, flat)
            np.bitwise_xor(flat, up, flat)
            np.bitwise_or(flat, equal, flat)
            np.bitwise_or(flat, down, flat)
            np.bitwise_or(flat, up, no_rise)
            np.bitwise_xor(no_rise, down, no_rise)
            np.bitwise_and(flat, up, fall)
            np.add(step_of, step_of, moved)
            np.bitwise_or(moved, carry, moved)
            np.right_shift(tops, _TOP, below)
            np.bitwise_and(flat, no_rise_in, spare)
            np.bitwise_xor(flat, spare, down)
            np.bitwise_xor(no_rise_in, spare, up)
            np.bitwise_or(up, fall_in, up)
            if s >= steps - 1:  # a word is done
                j = s - steps + 1
                bits = np.clip(m - 64 * j, 0, 64)
                inside = np.where(bits < 64, np.left_shift(np.uint64(1), (bits & 63).astype(np.uint64)) - np.uint64(1), ~np.uint64(0))
                total += np.bitwise_count(up[j] & inside).astype(np.int64) - np.bitwise_count(down[j] & inside)
    return total


def similarity_matrices(blocks: list[tuple[list[str], list[str]]]) -> list[np.ndarray]:
    """``1 - distance / longer length`` of the normalised texts of each block's rows and columns; equal texts give 1.0.

    A pair of texts of small blocks is scored once, whatever its order and block.
    """
    small = [max(sum(map(len, rows)), sum(map(len, cols))) < _WIDE for rows, cols in blocks]
    together = iter(_together([block for block, is_small in zip(blocks, small) if is_small]))
    return [next(together) if is_small else _packed_similarity(*block) for block, is_small in zip(blocks, small)]


def _together(blocks: list[tuple[list[str], list[str]]]) -> list[np.ndarray]:
    if not blocks:
        return []
    ids: dict[str, int] = {}
    sides = [tuple(np.array([ids.setdefault(t, len(ids)) for t in side], np.int64) for side in block) for block in blocks]
    texts = list(ids)
    length = np.array([len(t) for t in texts], np.int64)
    words = (length + 63) // 64
    if sum(int(np.maximum(words[r][:, None], words[c][None, :]).sum()) for r, c in sides if len(r) and len(c)) < _FEW_WORDS:
        return [_packed_similarity(*block) for block in blocks]
    keys = [np.minimum(r[:, None], c[None, :]) * len(texts) + np.maximum(r[:, None], c[None, :]) for r, c in sides]
    pairs, where = np.unique(np.concatenate([k.ravel() for k in keys]), return_inverse=True)
    first, second = pairs // len(texts), pairs % len(texts)
    distance, unlike = np.zeros(len(pairs), np.int64), first != second
    distance[unlike] = pair_distances(texts, first[unlike], second[unlike])
    longer = np.maximum(length[first], length[second])
    sims = (1.0 - distance / np.where(longer > 0, longer, 1))[where]
    ends = np.cumsum([k.size for k in keys])
    return [sims[end - k.size : end].reshape(k.shape) for k, end in zip(keys, ends, strict=True)]


def similarity_matrix(rows: list[str], cols: list[str]) -> np.ndarray:
    """The same for one block."""
    return similarity_matrices([(rows, cols)])[0]


def _packed_similarity(rows: list[str], cols: list[str]) -> np.ndarray:
    """The same for a block alone: equal texts are scored once, and the side with more characters is packed."""
    r_texts, r_at = np.unique(np.array(rows, dtype=object), return_inverse=True)
    c_texts, c_at = np.unique(np.array(cols, dtype=object), return_inverse=True)
    r_len = np.array([len(t) for t in r_texts], dtype=np.float64)
    c_len = np.array([len(t) for t in c_texts], dtype=np.float64)
    if c_len.sum() >= r_len.sum():
        dist = edit_distances(list(c_texts), list(r_texts))
    else:
        dist = edit_distances(list(r_texts), list(c_texts)).T
    longer = np.maximum(r_len[:, None], c_len[None, :])
    sims = 1.0 - dist / np.where(longer > 0, longer, 1.0)
    return sims[r_at][:, c_at]
