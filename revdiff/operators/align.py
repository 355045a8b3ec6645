"""One-to-one alignment of the records of two revisions, block by block.

A block is one previous/current pair (``pair_id``). Every current record is scored
against every previous record of its block: normalised edit similarity plus 0.10 for
the same non-empty section and 0.10 for the same non-empty number, at most 1. The
alignment is the one-to-one assignment of largest total score over the *whole* score
matrix; assignments below the threshold are dropped afterwards. Scores themselves
are never shuffled: tasks receive records and return one row per record.

One rule holds for blocks of all sizes. Scores count in whole units of 2**-40, so totals are exact.
Records of a side with equal text, section and number form a class, numbered by first record.
Of assignments of equal total the one with the smallest sum of ``tie_cost`` over its pairs is
taken: partners at the nearest places. Copies pair up in order, the first ones first.

* Blocks up to ``max_rows`` records and ``max_chars`` characters per side are solved
  in one task each.
* Larger blocks are scored in tiles of bounded size that spread over the cluster;
  tiles return a few partners of each class only. See ``align_large``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revdiff.functions.edits import edit_distances, similarity_bounds, similarity_matrices, similarity_matrix, some_distances
from revdiff.functions.text import normalize_text
from revdiff.sources.session import cut_lineage, shuffled, task_slots

SECTION_BONUS = 0.10
NUMBER_BONUS = 0.10
MATCH_THRESHOLD = 0.5

MAX_ROWS = 1024
MAX_CHARS = 1_000_000
TILE = 128
#: Units of a score of 1.
UNIT = 1 << 40

ALIGNMENT = "pair_id string, n_ord bigint, o_ord bigint, similarity double, adj double, second_best double"
_RECORD = "struct(ord, txt, section, number)"


def _side(df: DataFrame, is_new: Column) -> DataFrame:
    return df.select(
        F.col("pair_id").cast("string").alias("pair_id"),
        is_new.alias("is_new"),
        F.col("ord").cast("bigint").alias("ord"),
        normalize_text(F.coalesce("text", F.lit(""))).alias("txt"),
        F.col("section").cast("string").alias("section"),
        F.col("number").cast("string").alias("number"),
    )


def _records(prev: DataFrame, curr: DataFrame) -> DataFrame:
    return _side(prev, F.lit(False)).unionByName(_side(curr, F.lit(True)))


def _large_blocks(records: DataFrame, max_rows: int, max_chars: int) -> DataFrame:
    """Ids of blocks beyond the bounds; at most one per ``max_rows`` records or ``max_chars`` characters."""
    per_side = records.groupBy("pair_id", "is_new").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("txt")).alias("chars")
    )
    return per_side.filter((F.col("n") > max_rows) | (F.col("chars") > max_chars)).select("pair_id").distinct()


def _texts(side: list[dict]) -> list[str]:
    return [r["txt"] for r in side]


def scores(new: list[dict], old: list[dict], base: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Scores without and with bonuses; ``base`` has the former, if they are known."""
    base = similarity_matrix(_texts(new), _texts(old)) if base is None else base
    bonus = np.zeros_like(base)
    for field, worth in (("section", SECTION_BONUS), ("number", NUMBER_BONUS)):
        ids: dict = {}
        a = np.array([ids.setdefault(r[field], len(ids)) if r[field] else -1 for r in new], dtype=np.int64)
        b = np.array([ids.setdefault(r[field], len(ids)) if r[field] else -2 for r in old], dtype=np.int64)
        bonus += np.where(a[:, None] == b[None, :], worth, 0.0)
    return base, np.where(bonus > 0, np.minimum(1.0, base + bonus), base)


def tie_cost(new: np.ndarray, old: np.ndarray, size: int) -> np.ndarray:
    """What pairs of class places cost among equal totals: the squared distance of the places, then
    ten hashed bits. ``size`` is the number of records of the block's longer side; beyond 2**17 places
    are scaled down, so that all costs of an assignment stay below 2**61."""
    bits = min(17, (51 - size.bit_length()) // 2)
    if size > 1 << bits:
        new, old = ((x << bits) // size for x in (new, old))
    mixed = (new.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (old.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return ((new - old) ** 2 << 10) + ((mixed * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(54)).astype(np.int64)


def _cheapest(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Column of each row of a square matrix of whole numbers, so that the sum is smallest, and the
    prices of rows and columns that prove it: they add up to no more than any cell, and to the chosen ones.

    Rows take their cheapest column where it is free. Each other row looks for the shortest
    path to a free column over the cells' excess cost (Jonker and Volgenant 1987); distances
    are from the row, and prices are settled once, when the path is found.
    """
    size = len(cost)
    row_price, col_price = cost.min(axis=1), np.zeros(size, np.int64)
    col_of, row_of = np.full(size, -1), np.full(size, -1)
    wanted, at = np.unique(cost.argmin(axis=1), return_index=True)
    col_of[at], row_of[wanted] = wanted, at
    for row in np.flatnonzero(col_of < 0):
        far = cost[row] - row_price[row] - col_price
        via = np.full(size, row)
        seen = np.zeros(size, bool)
        while True:
            col = int(np.where(seen, np.iinfo(np.int64).max, far).argmin())
            if row_of[col] < 0:
                break
            seen[col] = True
            step = far[col] + cost[row_of[col]] - row_price[row_of[col]] - col_price
            nearer = ~seen & (step < far)
            far[nearer], via[nearer] = step[nearer], row_of[col]
        gain = far[col] - far[seen]
        row_price[row_of[seen]] += gain
        col_price[seen] -= gain
        row_price[row] += far[col]
        while True:
            owner = via[col]
            row_of[col], col_of[owner], col = owner, col, col_of[owner]
            if owner == row:
                break
    return col_of, row_price, col_price


def _cost(weights: np.ndarray) -> np.ndarray:
    m, n = weights.shape
    cost = np.zeros((max(m, n), max(m, n)), np.int64)
    cost[:m, :n] = -weights
    return cost


def best_assignment(weights: np.ndarray, new: np.ndarray | None = None, old: np.ndarray | None = None) -> np.ndarray:
    """Column per row that maximises the total weight, -1 for rows left over.

    ``weights`` are in whole units; ``new`` and ``old`` are the class places of rows and columns
    (default: each its own). Where a row could have a partner of another class at the same
    total, the assignment is made again among such cells, by ``tie_cost``.
    """
    m, n = weights.shape
    if m == 0 or n == 0:
        return np.full(m, -1)
    new, old = (np.arange(k) if x is None else x for k, x in ((m, new), (n, old)))
    size = max(m, n)
    cost = _cost(weights)
    col, row_price, col_price = _cheapest(cost)
    optimal = cost == row_price[:, None] + col_price[None, :]
    place = np.full(size, -1)
    place[:n] = old
    if (np.where(optimal[:m], place, size).min(axis=1) != np.where(optimal[:m], place, -2).max(axis=1)).any():
        again = np.zeros((size, size), np.int64)
        again[:m, :n] = np.where(weights, tie_cost(new[:, None], old[None, :], size), 0)  # a pair of no worth is none
        col, _, _ = _cheapest(np.where(optimal, again, 1 << 56))
    return np.where(col[:m] < n, col[:m], -1)


def _classes(side: list[dict]) -> np.ndarray:
    """The class place of each record; ``side`` is in order."""
    seen: dict = {}
    return np.array([seen.setdefault((r["txt"], r["section"], r["number"]), len(seen)) for r in side], np.int64)


def _in_order(taken: np.ndarray, of: np.ndarray, partner: np.ndarray) -> np.ndarray:
    """Pairs ``taken`` by class, dealt to the first records of class ``of``, by the partner's class."""
    members = {k: iter(np.flatnonzero(of == k)) for k in np.unique(taken)}
    out = np.empty(len(taken), np.int64)
    for at in np.lexsort((partner, taken)):
        out[at] = next(members[taken[at]])
    return out


#: Pairs this near to the prices are scored at once, in parts of a score of 1; twice as near each round.
_NEAR = 0.02
#: A record's pairs of so many letters are scored as one big integer, not side by side with others.
_ALONE_CHARS = 8_192


class _Bounded:
    """Plain scores of a block as far as its assignment needs them, bounds from above for the rest.

    Prices that are right for bounds are right for scores, as these are no larger. Once all pairs that are
    worth exactly their prices are scored, no other pair is in any assignment of largest total.
    """

    def __init__(self, block: dict):
        self.new, self.old = block["new"], block["old"]
        a, b = _texts(self.new), _texts(self.old)
        self.base = similarity_bounds(a, b)
        self.known = np.array(a, object)[:, None] == np.array(b, object)[None, :]
        self.base[self.known] = 1.0
        self.near = _NEAR * UNIT
        self.first, self.again = True, False

    def wanted(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs to be scored next; none at the end, unless it is to be asked ``again``."""
        self.again = False
        if not self.base.size:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        adj = scores(self.new, self.old, self.base)[1]
        ask = np.zeros(adj.shape, bool)
        if self.first:
            self.first = False
            ask[np.arange(len(adj)), adj.argmax(axis=1)] = True
            ask[adj.argmax(axis=0), np.arange(adj.shape[1])] = True
            ask &= ~self.known
            if ask.any():
                return np.nonzero(ask)
        m, n = adj.shape
        cost = _cost(np.rint(adj * UNIT).astype(np.int64))
        _, row_price, col_price = _cheapest(cost)
        over = (cost - row_price[:, None] - col_price[None, :])[:m, :n]
        if not ((over == 0) & ~self.known).any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ask = (over <= self.near) & ~self.known
        self.near *= 2
        return self._alone(ask)

    def _alone(self, ask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores long rows and columns of ``ask`` at once; the pairs that are left."""
        for by_row in (True, False):
            side, other = (self.new, self.old) if by_row else (self.old, self.new)
            cells = ask if by_row else ask.T
            length = np.array([len(r["txt"]) for r in other])
            for k in np.flatnonzero(cells @ length >= _ALONE_CHARS):
                at, text = np.flatnonzero(cells[k]), side[k]["txt"]
                value = 1.0 - edit_distances([other[j]["txt"] for j in at], [text])[0] / np.maximum(length[at], max(len(text), 1))
                self.learn(*((k, at) if by_row else (at, k)), value)
                cells[k] = False
        self.again = True
        return np.nonzero(ask)

    def learn(self, row: np.ndarray, col: np.ndarray, value: np.ndarray) -> None:
        self.base[row, col], self.known[row, col] = value, True


def _bounded_scores(group: list[dict]) -> list[np.ndarray]:
    """``base`` of each block, right where an assignment may need it; pairs of all blocks are scored side by side."""
    blocks = [_Bounded(block) for block in group]
    open_ = blocks
    while open_:
        asked = [(block, *block.wanted()) for block in open_]
        asked = [(block, i, j) for block, i, j in asked if len(i) or block.again]
        ids: dict[str, int] = {}
        ends = np.cumsum([len(i) for _, i, _ in asked])
        x = np.array([ids.setdefault(block.new[k]["txt"], len(ids)) for block, i, _ in asked for k in i], np.int64)
        y = np.array([ids.setdefault(block.old[k]["txt"], len(ids)) for block, _, j in asked for k in j], np.int64)
        if len(x):
            texts = list(ids)
            pairs, where = np.unique(np.minimum(x, y) * len(texts) + np.maximum(x, y), return_inverse=True)
            x, y = pairs // len(texts), pairs % len(texts)
            length = np.array([len(t) for t in texts], np.int64)
            value = (1.0 - some_distances(texts, x, y) / np.maximum(length[x], length[y]))[where]
            for (block, i, j), part in zip(asked, np.split(value, ends[:-1]), strict=True):
                block.learn(i, j, part)
        open_ = [block for block, *_ in asked]
    return [block.base for block in blocks]


def _solve_block(new: list[dict], old: list[dict], base: np.ndarray, seconds: bool = True) -> list[tuple]:
    """Rows ``(n_ord, o_ord, similarity, adj, second_best)`` of one block in order, unmatched records included."""
    out, used_new, used_old = [], set(), set()
    if new and old:
        base, adj = scores(new, old, base)
        a, b = _classes(new), _classes(old)
        col = best_assignment(np.rint(adj * UNIT).astype(np.int64), a, b)
        row = np.flatnonzero(col >= 0)
        row = row[adj[row, col[row]] >= MATCH_THRESHOLD]
        x, y = a[row], b[col[row]]
        by = np.lexsort((y, x))
        x, y = x[by], y[by]
        for i, j in zip(_in_order(x, a, y), _in_order(y, b, x), strict=True):
            others = np.delete(base[i], j) if seconds else ()
            second = float(others.max()) if len(others) else None
            out.append((new[i]["ord"], old[j]["ord"], float(base[i, j]), float(adj[i, j]), second))
            used_new.add(i)
            used_old.add(j)
    out.extend((r["ord"], None, None, None, None) for i, r in enumerate(new) if i not in used_new)
    out.extend((None, r["ord"], None, None, None) for j, r in enumerate(old) if j not in used_old)
    return out


_FIELDS = [("pair_id", pa.string()), ("n_ord", pa.int64()), ("o_ord", pa.int64()), ("similarity", pa.float64()),
           ("adj", pa.float64()), ("second_best", pa.float64())]
_OUT_ROWS = 10_000
#: Characters and pairs of blocks that are scored side by side; a block beyond that is scored alone.
_GROUP_CHARS = 8_000_000
_GROUP_PAIRS = 250_000


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Blocks, a bounded number at a time, with the records of both sides in order."""
    group: list[dict] = []
    chars = pairs = 0
    for batch in batches:
        for at in range(batch.num_rows):
            block = batch.slice(at, 1).to_pylist()[0]
            for side in ("new", "old"):
                block[side].sort(key=lambda r: r["ord"])
            more = sum(len(r["txt"]) for side in ("new", "old") for r in block[side]), len(block["new"]) * len(block["old"])
            if group and (chars + more[0] > _GROUP_CHARS or pairs + more[1] > _GROUP_PAIRS):
                yield group
                group, chars, pairs = [], 0, 0
            group.append(block)
            chars, pairs = chars + more[0], pairs + more[1]
    if group:
        yield group


def _solve_batches(batches: Iterator[pa.RecordBatch], seconds: bool = True) -> Iterator[pa.RecordBatch]:
    def packed(rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, type=t) for c, (_, t) in zip(zip(*rows), _FIELDS)]
        return pa.RecordBatch.from_arrays(columns, schema=pa.schema(_FIELDS))

    rows: list[tuple] = []
    for group in _groups(batches):
        bases = similarity_matrices([(_texts(block["new"]), _texts(block["old"])) for block in group]) if seconds else _bounded_scores(group)
        for block, base in zip(group, bases, strict=True):
            rows.extend((block["pair_id"], *r) for r in _solve_block(block["new"], block["old"], base, seconds))
            if len(rows) >= _OUT_ROWS:
                yield packed(rows)
                rows = []
    if rows:
        yield packed(rows)


def _as_blocks(records: DataFrame, dealt: bool = False) -> DataFrame:
    """One row per block with its records as two arrays.

    Bytes say little about the work in a block, so the partition count is stated:
    adaptive execution would fold a few megabytes into one task. ``dealt`` records stay where they are.
    """
    record = F.expr(_RECORD)
    return (
        (records if dealt else records.repartition(task_slots(records.sparkSession), "pair_id"))
        .groupBy("pair_id")
        .agg(
            F.collect_list(F.when(F.col("is_new"), record)).alias("new"),
            F.collect_list(F.when(~F.col("is_new"), record)).alias("old"),
        )
    )


def align_small(records: DataFrame, seconds: bool = True, dealt: bool = False) -> DataFrame:
    return _as_blocks(records, dealt).mapInArrow(lambda batches: _solve_batches(batches, seconds), ALIGNMENT)


def align(
    prev: DataFrame,
    curr: DataFrame,
    max_rows: int = MAX_ROWS,
    max_chars: int = MAX_CHARS,
    tile: int = TILE,
    seconds: bool = True,
) -> DataFrame:
    """Align ``curr`` with ``prev``; both need ``pair_id, ord, text, section, number``.

    ``ord`` is the record order and unique per side of a block. The result has one row
    per match (``n_ord`` and ``o_ord`` set) and one per unmatched record (the other
    side null). ``similarity`` and ``second_best`` are without bonuses. The bounds choose the
    way, not the result: both ways give the same pairs. Without ``seconds`` the column ``second_best`` is null,
    and of small blocks only pairs are scored whose bounds don't rule them out.

    The inputs are read twice, first by an eager job that counts block sizes, so pass
    stored tables rather than long plans.
    """
    return _align(_records(prev, curr), max_rows, max_chars, tile, seconds)


def align_dealt(records: DataFrame, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS, tile: int = TILE, seconds: bool = True) -> DataFrame:
    """``align`` of the two sides in one table with ``side``, which is dealt out by ``pair_id`` to as many tasks as the scoring
    asks for: blocks are put together where they are, so that no text moves."""
    return _align(_side(records, F.col("side") == "curr"), max_rows, max_chars, tile, seconds, True)


def _align(records: DataFrame, max_rows: int, max_chars: int, tile: int, seconds: bool, dealt: bool = False) -> DataFrame:
    large = cut_lineage(_large_blocks(records, max_rows, max_chars))
    if large.isEmpty():
        return align_small(records, seconds, dealt)
    small = align_small(records.join(shuffled(large), "pair_id", "left_anti") if dealt else records.join(large, "pair_id", "left_anti"), seconds, dealt)
    big = cut_lineage(records.join(large, "pair_id", "left_semi"))
    from revdiff.operators.align_large import align_large

    tiled = align_large(big, tile)
    return small.unionByName(tiled if seconds else tiled.withColumn("second_best", F.lit(None).cast("double")))
