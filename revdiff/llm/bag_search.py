"""Ranked lexical search over bags: texts that look alike to the items are scored once.

All that a score needs of a text is how often it holds each term of the items, and its length
factor m. So every text is restricted to the items' vocabulary; texts with the same term counts
and m form a class (found by hash, told apart by comparing whole bags). Classes are scored
against the items; only the members of the best classes are looked up again, by ascending id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revdiff.llm.common import arrow_rows, byte_slices, cut_lineage
from revdiff.sources.session import task_slots

TOP = 50
#: Terms of the items that are searched together, about: their vocabulary goes to every task.
BLOCK_TERMS = 200_000
#: Up to so many class hashes (8 bytes each) are sent to every task; more are joined by shuffle.
SMALL = 200_000
#: Cells of a matrix of class scores, and bytes of the bags that are scored together.
CELLS, BAG_BYTES = 1 << 21, 1 << 18
TEXT_ROWS = 1000
_TERM = np.ones(256, bool)
for _a, _b in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    _TERM[_a : _b + 1] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of ``texts`` (letters A-Z lower-cased), and the text that each is in; null has none."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[at[0] : at[-1]] if raw and at[-1] > at[0] else np.zeros(0, np.uint8)
    at = at - at[0]
    inside = _TERM[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    start = np.flatnonzero(inside & (np.r_[True, ~inside[:-1]] | edge[:-1])) if len(data) else at[:0]
    end = np.flatnonzero(inside & (np.r_[~inside[1:], True] | edge[1:])) + 1 if len(data) else at[:0]
    offsets = np.r_[0, np.cumsum(end - start)]
    found = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(_LOWER[data[inside]]))
    return found, np.searchsorted(at, start, "right") - 1


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``id, terms``: the distinct terms of each item; rows of one id are one item. Items without terms are left out."""
    rows = items.select(items[id_col].alias("id"), items[text_col].alias("text"))
    schema = T.StructType([rows.schema[0], T.StructField("term", T.StringType())])

    def cut(batches):
        for batch in byte_slices(batches, 1, 1 << 20):
            found, of = terms(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), found.cast(pa.string())], names=schema.names)

    return rows.mapInArrow(cut, schema).distinct().groupBy("id").agg(F.sort_array(F.collect_list("term")).alias("terms"))


def bags(docs: DataFrame, vocabulary: list[str], id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 1 << 20) -> DataFrame:
    """``id, n, bag`` of every row: its number of terms, and which terms of ``vocabulary`` it has how
    often (pairs of 32-bit numbers, by term)."""
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    size = max(1, len(vocabulary))

    def count(batches):
        known = pa.array(vocabulary, pa.large_string())
        for batch in byte_slices(batches, 1, batch_bytes):
            found, of = terms(batch.column(1))
            term = pc.fill_null(pc.index_in(found, value_set=known), -1).to_numpy().astype(np.int64)
            key, times = np.unique((of * size + term)[term >= 0], return_counts=True)
            pairs = np.stack([key % size, times], 1).astype("<u4").reshape(-1).view(np.uint8)
            ends = np.searchsorted(key // size, np.arange(batch.num_rows + 1)).astype(np.int32) * 8
            bag = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(pairs)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.bincount(of, minlength=batch.num_rows)), bag], names=["id", "n", "bag"])

    return rows.mapInArrow(count, "id long, n long, bag binary")


def _pairs(bag: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and count of all entries of bags."""
    at = np.frombuffer(bag.buffers()[1], np.int32)[bag.offset : bag.offset + len(bag) + 1]
    raw = bag.buffers()[2]
    pairs = np.frombuffer(raw, np.uint8)[at[0] : at[-1]].view("<u4").reshape(-1, 2) if raw and at[-1] > at[0] else np.zeros((0, 2), "<u4")
    return np.repeat(np.arange(len(bag)), np.diff(at) // 8), pairs[:, 0].astype(np.int64), pairs[:, 1].astype(np.int64)


def _documents_with(counted: DataFrame, size: int) -> np.ndarray:
    """In how many rows each of ``size`` terms occurs, summed per task first."""

    def add(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(_pairs(batch.column(0))[1], minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["term", "n"])

    out = np.zeros(size, np.int64)
    for r in counted.select("bag").mapInArrow(add, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r.term] = r.n
    return out


def term_weights(n_docs: int, with_term: np.ndarray) -> np.ndarray:
    """floor(1000 * ln((2 N + 2) / (2 df + 1))) of each term."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in with_term], np.int64)


class _Best:
    """The best classes of each item so far: by score, then smallest id."""

    def __init__(self, top: int):
        self.top, self.rows = top, np.zeros((4, 0), np.int64)  # item, score, smallest id, class

    def add(self, item, score, low, cls) -> None:
        rows = np.concatenate([self.rows, np.stack([item, score, low, cls])], axis=1)
        rows = rows[:, np.lexsort((rows[2], -rows[1], rows[0]))]
        item = rows[0]
        first = np.maximum.accumulate(np.where(np.r_[True, item[1:] != item[:-1]], np.arange(len(item)), 0)) if len(item) else item
        self.rows = rows[:, np.arange(len(item)) - first < self.top]


def _score(classes: DataFrame, items: list[list[int]], weight: np.ndarray, top: int) -> DataFrame:
    """``item, score, low, cls``: the best classes of each task for each item (its place in ``items``)."""
    size = np.zeros(len(weight), np.int64)  # items of each term
    for own in items:
        size[own] += 1
    ends = np.cumsum(size)
    owner = np.array([k for _, k in sorted((t, k) for k, own in enumerate(items) for t in own)], np.int64)

    def score(batches):
        best, step = _Best(top), max(1, CELLS // max(1, len(items)))
        for whole in byte_slices(batches, 2, BAG_BYTES):
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                row, term, times = _pairs(batch.column(2))
                m = batch.column(1).to_numpy()
                worth = weight[term] * ((1_000_000_000 * times) // (1000 * times + 20 * m[row]))
                n = size[term]
                item = owner[np.repeat(ends[term] - np.cumsum(n), n) + np.arange(n.sum())]
                cell, worth = np.repeat(row, n) * len(items) + item, np.repeat(worth, n)
                cells = batch.num_rows * len(items)
                # sums of halves are exact in doubles
                total = np.bincount(cell, worth >> 24, cells).astype(np.int64) << 24
                total += np.bincount(cell, worth & 0xFFFFFF, cells).astype(np.int64)
                hit = np.flatnonzero(total)
                cls = batch.column(0).to_numpy()[hit // len(items)]
                low = batch.column(3).fill_null(np.iinfo(np.int64).max).to_numpy()[hit // len(items)]
                best.add(hit % len(items), total[hit], low, cls)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in best.rows], names=["item", "score", "low", "cls"])

    return classes.select("cls", "m", "bag", "low").mapInArrow(score, "item long, score long, low long, cls long")


def _first_members(members: DataFrame, wanted: DataFrame, top: int) -> DataFrame:
    """``cls, id``: of each class in ``wanted(cls, h, m, bag)`` the ``top`` members of smallest id.

    Members are found by hash and then checked against the whole bag. A class may hold most rows:
    its members are cut to ``top`` in each task and in each of 64 shares before they meet."""
    hashes = wanted.select("h").distinct()
    near = F.broadcast(hashes) if hashes.count() <= SMALL else hashes
    own = cut_lineage(members.join(near, "h", "left_semi").withColumn("share", F.pmod(F.xxhash64("id"), F.lit(64)).cast("int")))
    for keys in (["h", "m", "bag", "share"], ["h", "m", "bag"]):
        by_id = Window.partitionBy(*keys).orderBy(F.col("id").asc_nulls_last())
        own = own.withColumn("nth", F.row_number().over(by_id)).filter(F.col("nth") <= top).drop("nth")
    return own.join(wanted, ["h", "m", "bag"]).select("cls", "id")


def _search_block(docs: DataFrame, items: list, top: int, id_col: str, text_col: str) -> DataFrame:
    """``item, rank, id, score`` for a list of rows ``(no, terms)``."""
    spark = docs.sparkSession
    vocabulary = sorted({t for r in items for t in r.terms})
    number = {t: n for n, t in enumerate(vocabulary)}
    with arrow_rows(spark, TEXT_ROWS):
        counted = cut_lineage(bags(docs, vocabulary, id_col, text_col))
        n_docs, all_terms = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        weight = term_weights(n_docs, _documents_with(counted, max(1, len(vocabulary))))
    m = F.expr(f"50 + (50 * n * {n_docs}L) div {max(1, all_terms)}L")
    members = counted.filter("length(bag) > 0").select("id", m.alias("m"), "bag").withColumn("h", F.xxhash64("m", "bag"))
    classes = members.groupBy("h", "m", "bag").agg(F.min("id").alias("low"))
    classes = cut_lineage(classes.withColumn("cls", F.monotonically_increasing_id()))
    with arrow_rows(spark, TEXT_ROWS):
        scored = _score(classes.repartition(task_slots(spark)), [[number[t] for t in r.terms] for r in items], weight, top)
        best_first = Window.partitionBy("item").orderBy(F.desc("score"), "low")
        best = cut_lineage(scored.withColumn("nth", F.row_number().over(best_first)).filter(F.col("nth") <= top).select("item", "score", "cls"))
    wanted = classes.join(best.select("cls").distinct(), "cls").select("cls", "h", "m", "bag")
    rows = best.join(_first_members(members, cut_lineage(wanted), top), "cls")
    ranked = Window.partitionBy("item").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    numbers = spark.createDataFrame([(k, r.no) for k, r in enumerate(items)], "item long, no long")
    return rows.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top).join(numbers, "item").select("no", "rank", "id", "score")


def search(
    docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """``item_col, rank, id_col, score``: the ``top`` best rows of ``docs`` for each item, score above 0.

    Terms are runs of digits, letters and all characters beyond ASCII; only A-Z are lower-cased.
    The score is the sum over the item's terms of weight times saturated count, all in whole numbers
    (see ``term_weights`` and ``_score``); equal scores go by ascending id.

    A class's smallest id decides which classes can be among the best, so the ``top`` classes with
    ``top`` members each hold the result. Items are searched in blocks of about ``block_terms`` terms;
    a block reads all texts, and its vocabulary is all that a task holds of the items. The result of
    a task has at most ``top`` classes an item.

    A null or empty text has no terms and is in no result, and an item without terms has none. Rows
    of one item id are one item, null ids too. Ids of ``docs`` are whole numbers; a null id comes
    last among equals, and of repeated rows each is ranked. Without documents or items there are no
    rows. Other columns are not read.
    """
    spark = docs.sparkSession
    known = cut_lineage(item_terms(items, item_col, item_text_col).withColumn("no", F.monotonically_increasing_id()))
    blocks = -(-(known.agg(F.sum(F.size("terms"))).first()[0] or 0) // block_terms)
    out = spark.createDataFrame([], "no long, rank int, id long, score long")
    for block in range(blocks):
        own = known.filter(F.expr(f"pmod(xxhash64(no), {blocks}) = {block}")).select("no", "terms").collect()
        if own:
            out = out.union(_search_block(docs, own, top, id_col, text_col))
    kind = docs.schema[id_col].dataType
    return out.join(known.select("no", F.col("id").alias("item")), "no").select(
        F.col("item").alias(item_col), "rank", F.col("id").cast(kind).alias(id_col), "score"
    )
