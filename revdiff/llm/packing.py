"""Packing: best-fit decreasing over whole corpora.

Best fit decreasing looks sequential, but its state depends on lengths alone: which pieces of
one length go where is up to us. So the plan is made from the number of pieces of each length
(at most ``window`` numbers, whatever the corpus), for all pieces of a length at once, and each
piece then finds its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revdiff.llm.common import arrow_rows, byte_slices, cut_lineage, unused
from revdiff.llm.tokens import encoder

#: Texts in an Arrow batch, where token ids are kept.
TEXT_ROWS = 1000


class OpenWindows:
    """A segment tree over remaining capacities: leaf r tells whether a window with r left is open."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.tree = bytearray(2 * self.size)
        self.groups: list[list] = [[] for _ in range(window + 1)]

    def add(self, left: int, first: int, count: int) -> None:
        """``count`` windows, numbered from ``first``, with ``left`` tokens of room each."""
        self.groups[left].append((first, count))
        at = left + self.size
        while at and not self.tree[at]:
            self.tree[at] = 1
            at >>= 1

    def pop(self, length: int) -> tuple[int, int, int] | None:
        """A group of the tightest windows that have room for ``length``: room, first, count."""
        at = length + self.size
        if not self.tree[at]:
            while at > 1 and (at & 1 or not self.tree[at + 1]):  # up to a right sibling with an open leaf
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.tree[2 * at] else 2 * at + 1
        left = at - self.size
        first, count = self.groups[left].pop()
        if not self.groups[left]:
            self.tree[at] = 0
            at >>= 1
            while at:
                self.tree[at] = self.tree[2 * at] | self.tree[2 * at + 1]
                at >>= 1
        return left, first, count


def plan(counts: dict[int, int], window: int) -> np.ndarray:
    """Best fit decreasing for ``counts`` pieces of each length, in bulk.

    Columns: length, first rank, pieces per window, first window, offset of the first piece;
    sorted by length and rank. A window of room r takes r // length pieces in a row, since after
    each of them it is the tightest one that fits; windows of equal room are alike. A length adds
    at most four groups of windows, so the plan's size is bounded by the window, not the corpus.
    """
    windows, steps, opened = OpenWindows(window), [], 0
    for length in sorted(counts, reverse=True):
        rank, todo = 0, counts[length]
        while todo:
            found = windows.pop(length)
            if found is None:
                each = window // length
                found = (window, opened, -(-todo // each))
                opened += found[2]
            left, first, count = found
            each = left // length
            full, rest = min(count, todo // each), 0
            if full:
                steps.append((length, rank, each, first, window - left))
                if left - each * length:
                    windows.add(left - each * length, first, full)
                rank, todo = rank + full * each, todo - full * each
            if full < count and 0 < todo < each:
                rest = 1
                steps.append((length, rank, each, first + full, window - left))
                windows.add(left - todo * length, first + full, 1)
                rank, todo = rank + todo, 0
            if full + rest < count:
                windows.add(left, first + full + rest, count - full - rest)
    return np.array(sorted(steps), np.int64).reshape(-1, 5)


def pieces(
    docs: DataFrame, tokenizer: str, end_id: int = 2, window: int = 4096, keep_ids: bool = False, batch_bytes: int = 1 << 20,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Every document's token ids and ``end_id``, cut into full windows and one shorter rest.

    Per piece: ``id_col, start, length, ids_crc32, doc_tokens`` and, with ``keep_ids``, ``ids``.
    A null text is empty and gives the piece of ``end_id`` alone.
    """
    rows = docs.select(docs[id_col], docs[text_col])
    schema = T.StructType([
        T.StructField(id_col, rows.schema[0].dataType), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()), T.StructField("doc_tokens", T.LongType()),
        *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if keep_ids else []),
    ])
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches):
        for batch in byte_slices(batches, 1, batch_bytes):
            found = [x + end for x in encoder(tokenizer, False)([x or "" for x in batch.column(1).to_pylist()])]
            at = [(n, i) for n, x in enumerate(found) for i in range(0, len(x), 4 * window)]
            part = [found[n][i : i + 4 * window] for n, i in at]
            columns = [
                batch.column(0).take(pa.array([n for n, _ in at], pa.int32())), pa.array([i // 4 for _, i in at], pa.int64()),
                pa.array([len(x) // 4 for x in part], pa.int64()), pa.array([zlib.crc32(x) for x in part], pa.int64()),
                pa.array([len(found[n]) // 4 for n, _ in at], pa.int64()),
            ]
            if keep_ids:
                ends = np.cumsum([0, *(len(x) // 4 for x in part)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(part), "<i4"))))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(cut, schema)


def place(cut: DataFrame, window: int = 4096, id_col: str = "doc_id") -> DataFrame:
    """``cut`` (see ``pieces``; stored, as it is read twice) with ``sequence_id`` and ``offset``.

    Ranks: pieces of a length are dealt into bins by hash, since one length may hold most
    pieces; a piece's rank is the number of pieces in earlier bins and its row number in its own.
    """
    spark = cut.sparkSession
    bins = max(512, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    steps = plan({r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}, window)
    dealt = cut.withColumn("_bin", F.expr(f"pmod(xxhash64({id_col}, start, ids_crc32), {bins})"))
    before = (
        dealt.groupBy("length", "_bin").agg(F.count("*").alias("n"))
        .withColumn("_before", F.sum("n").over(Window.partitionBy("length").orderBy("_bin")) - F.col("n")).drop("n")
    )
    own = Window.partitionBy("length", "_bin").orderBy(id_col, "start", "ids_crc32")
    ranked = dealt.withColumn("_row", F.row_number().over(own)).join(before, ["length", "_bin"])
    ranked = ranked.select(*cut.columns, (F.col("_before") + F.col("_row") - 1).alias("_rank"))
    schema = T.StructType([*cut.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    first = np.searchsorted(steps[:, 0], np.arange(window + 2))

    def assign(batches):
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "_rank"))
            step = np.zeros(len(length), np.int64)
            for x in np.unique(length):
                own = length == x
                a, b = first[x], first[x + 1]
                step[own] = a + np.searchsorted(steps[a:b, 1], rank[own], "right") - 1
            nth = rank - steps[step, 1]
            sequence = steps[step, 3] + nth // steps[step, 2]
            offset = steps[step, 4] + nth % steps[step, 2] * length
            kept = [batch.column(n) for n in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=schema.names)

    return ranked.mapInArrow(assign, schema)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, window: int = 4096, keep_ids: bool = False, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """All documents packed into sequences of ``window`` tokens by best fit decreasing.

    Per piece: ``id_col, start`` (the document's ids before it), ``length, ids_crc32, doc_tokens,
    sequence_id, offset`` (its place there, without gaps from 0) and, with ``keep_ids``, ``ids``.
    Overlong documents are first cut into full windows; their rest is a piece like the others.

    A null text is empty: one piece of ``end_id``. Repeated rows are packed each; null ids stay
    null. Ties (pieces of one length) go by a hash of the id, then the id. An empty table gives
    no rows. Other columns are not read.
    """
    cut = pieces(docs, tokenizer, end_id, window, keep_ids, id_col=id_col, text_col=text_col)
    if not keep_ids:
        return place(cut_lineage(cut), window, id_col)
    (piece,) = unused(cut, "_piece")
    with arrow_rows(docs.sparkSession, TEXT_ROWS):
        cut = cut_lineage(cut.withColumn(piece, F.monotonically_increasing_id()))
    placed = place(cut.drop("ids"), window, id_col).join(cut.select(piece, "ids"), piece)  # ids move once, and not through the ranking
    return placed.select(id_col, "start", "length", "ids_crc32", "doc_tokens", "ids", "sequence_id", "offset")


def sequences(packed: DataFrame, window: int = 4096, pad_id: int = 0) -> DataFrame:
    """``sequence_id, ids, n_tokens`` of ``pack(..., keep_ids=True)``, filled up with ``pad_id``.

    A group holds one window at most. A sequence whose length is a power of two stays as it is.
    """
    rows = packed.groupBy("sequence_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"),
        F.sum("length").alias("n_tokens"),
    )
    fill = F.when(F.expr("(n_tokens & (n_tokens - 1)) = 0"), F.lit(0)).otherwise(F.lit(window) - F.col("n_tokens")).cast("int")
    return rows.select("sequence_id", F.concat("ids", F.array_repeat(F.lit(pad_id), fill)).alias("ids"), "n_tokens")
