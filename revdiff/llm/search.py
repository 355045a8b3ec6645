"""Exact top-k inner products with an impact-ordered, score-at-a-time index.

Vectors are dealt into shards. A shard's index has, for each dimension, its vectors in descending
order of absolute component, cut into segments of one quantised impact (a power of a ratio). A
block of queries adds up the segments of all dimensions in descending order of impact. What a
vector has not yet met is bounded by the next segments of the dimensions. A query leaves the block
when the bounds prove that all but a few vectors can't be among its best k; those few are scored
exactly, in integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revdiff.llm.common import cut_lineage

#: Vectors of a shard, queries of a block.
SHARD, BLOCK = 2048, 256
#: Impacts of a segment differ by this factor at most.
RATIO = 1.5
#: A block of queries looks at the bounds so often at most.
LOOKS = 8


def integer_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """``id, v`` with ``floor(scale * x)`` of each component; one row an id (the smallest vector).
    Vectors that are null or hold null or non-finite components are left out, and null ids."""
    v = F.transform(F.col("vector").cast("array<double>"), lambda x: F.floor(F.lit(float(scale)) * x).cast("long"))
    sound = F.col("id").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    picked = rows.select(rows[id_col].alias("id"), rows[vector_col].alias("vector")).filter(sound).select("id", v.alias("v"))
    return picked.groupBy("id").agg(F.min("v").alias("v"))


class Index:
    """One shard: ``ids``, exact ``vectors``, and posting segments by dimension and quantised impact."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        rows, values, dimension, begin, high, at = [], [], [], [], [], 0
        for d in range(vectors.shape[1]):
            c = vectors[:, d]
            order = np.argsort(-np.abs(c), kind="stable")
            order = order[c[order] != 0]
            size = np.abs(c[order]).astype(float)
            level = np.floor(np.log(size) / np.log(RATIO) + 1e-9)
            new = np.flatnonzero(np.r_[True, level[1:] != level[:-1]]) if len(order) else np.zeros(0, np.int64)
            rows.append(order)
            values.append(c[order].astype(float))
            dimension.append(np.full(len(new), d))
            begin.append(at + new)
            high.append(size[new])
            at += len(order)
        flat = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
        self.rows, self.values = flat(rows, np.int64), flat(values, float)
        self.dimension, self.begin, self.high = flat(dimension, np.int64), flat(begin, np.int64), flat(high, float)
        self.end = np.r_[self.begin[1:], at].astype(np.int64)[: len(self.begin)]
        last = np.r_[self.dimension[1:] != self.dimension[:-1], True][: len(self.begin)]
        self.next_high = np.where(last, 0.0, np.r_[self.high[1:], 0.0][: len(self.high)])

    def top(self, own: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the row numbers and exact scores of its best ``k`` (ties to smaller
        ids), leaving out the row whose id is the query's own."""
        width, n = self.vectors.shape[1], len(self.ids)
        q = np.zeros((len(queries), width))
        q[:, : queries.shape[1]] = queries[:, :width]
        found, todo = [None] * len(q), np.arange(len(q))
        score = np.zeros((n, len(q)))
        turn = np.argsort(-self.high, kind="stable")
        ahead = np.zeros(width)  # the largest impact of each dimension that is still to come
        np.maximum.at(ahead, self.dimension, self.high)
        step, few = max(1, -(-len(turn) // LOOKS)), 4 * k + n // 32
        for at in range(0, max(1, len(turn)), step):
            part = q[todo].T.copy()
            for s in turn[at : at + step].tolist():
                a, b, d = self.begin[s], self.end[s], self.dimension[s]
                score[self.rows[a:b]] += self.values[a:b, None] * part[d]
                ahead[d] = self.next_high[s]
            last = at + step >= len(turn)
            slack = ahead @ np.abs(part) * (1 + 1e-9) + 0.5  # no vector's score is further off
            seen = np.where(self.ids[:, None] == own[todo], -np.inf, score)
            if n > k:
                bar = np.partition(seen, n - k, axis=0)[n - k] - slack
                left = seen + slack >= bar
            else:
                left = seen > -np.inf
            done = (left.sum(axis=0) <= few) | last
            for c in np.flatnonzero(done):
                found[todo[c]] = self._exact(np.flatnonzero(left[:, c] & (seen[:, c] > -np.inf)), queries[todo[c]], k)
            if last or done.all():
                break
            todo, score = todo[~done], score[:, ~done]
        return found

    def _exact(self, rows: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        n = min(len(query), self.vectors.shape[1])
        scores = self.vectors[rows, :n] @ query[:n]
        best = np.lexsort((self.ids[rows], -scores))[:k]
        return rows[best], scores[best]


def _pack(rows: DataFrame, by: Column, name: str) -> DataFrame:
    """``name, ids, vectors, width``: one row of bytes for each value of ``by``; shorter vectors end in zeros."""

    def pack(batches):
        import itertools

        got = itertools.chain.from_iterable(zip(*(c.to_pylist() for c in b.columns), strict=True) for b in batches)
        for key, group in itertools.groupby(got, key=lambda r: r[0]):
            group = list(group)
            width = max(len(v) for _, _, v in group)
            table = np.zeros((len(group), width), "<i8")
            for i, (_, _, v) in enumerate(group):
                table[i, : len(v)] = v
            ids = np.array([i for _, i, _ in group], "<i8")
            yield pa.RecordBatch.from_arrays(
                [pa.array([key], pa.int64()), pa.array([ids.tobytes()], pa.binary()), pa.array([table.tobytes()], pa.binary()), pa.array([width], pa.int64())],
                names=[name, "ids", "vectors", "width"],
            )

    dealt = rows.select(by.cast("long").alias(name), "id", "v")
    return dealt.repartition(name).sortWithinPartitions(name, "id").mapInArrow(pack, f"{name} long, ids binary, vectors binary, width long")


def top_k(rows: DataFrame, every: int = 50, k: int = 5, shard: int = SHARD, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, id_col, score``: the ``k`` largest integer inner products of each query.

    Queries are the rows whose id is divisible by ``every``, candidates all rows of other ids;
    fewer than ``k`` candidates give all of them. Ties go to the smaller id.

    Each block of queries meets each shard once: a stated query set against all rows, in blocks.
    Only a block's best ``k`` of a shard are shuffled. Shards and blocks are dealt by a hash of
    the id, so equal vectors spread.

    Null vectors and those with null or non-finite components take no part, nor do null ids. Of
    rows with equal ids the smallest vector counts. Vectors of unequal length are compared over
    the shorter one. An empty table gives no rows. Other columns are not read.
    """
    vectors = cut_lineage(integer_vectors(rows, id_col, vector_col))
    n = vectors.count()
    asked = vectors.filter(F.col("id") % every == 0)
    shards, blocks = max(1, -(-n // shard)), max(1, -(-n // (every * block)))
    spread = F.xxhash64("id")
    held = cut_lineage(_pack(vectors, F.pmod(spread, F.lit(shards)), "shard"))
    queries = _pack(asked, F.pmod(spread, F.lit(blocks)), "block").toDF("block", "q_ids", "q_vectors", "q_width")
    tasks = 4 * shards  # searching is compute: a task for each shard, whatever its bytes
    queries = queries.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    met = held.repartition(tasks, "shard").join(queries.repartition(tasks, "shard"), "shard").select("shard", "ids", "vectors", "width", "q_ids", "q_vectors", "q_width")
    id_type = vectors.schema["id"].dataType
    schema = T.StructType([T.StructField("part", T.LongType()), T.StructField("query_id", id_type), T.StructField(id_col, id_type), T.StructField("score", T.LongType())])

    def search(batches):
        last, index = None, None
        for batch in batches:
            for r in batch.to_pylist():
                if r["shard"] != last:
                    last = r["shard"]
                    index = Index(np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["vectors"], "<i8").reshape(-1, r["width"]))
                ids, table = np.frombuffer(r["q_ids"], "<i8"), np.frombuffer(r["q_vectors"], "<i8").reshape(-1, r["q_width"])
                found = index.top(ids, table, k)
                out = [np.repeat(ids, [len(a) for a, _ in found]), np.concatenate([index.ids[a] for a, _ in found]), np.concatenate([s for _, s in found])]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(out[0]), last // 64)), *(pa.array(x) for x in out)], names=schema.names)

    def best(found, *by):
        ranked = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col(id_col).alias("i"))))
        return found.groupBy(*by).agg(F.slice(ranked, 1, k).alias("best")).select(*by, F.posexplode("best").alias("n", "b")).select(
            *by, (F.col("n") + 1).alias("rank"), F.col("b.i").alias(id_col), (-F.col("b.s")).alias("score")
        )

    # the best of 64 shards, then the best of those: groups stay small
    return best(best(met.mapInArrow(search, schema), "query_id", "part"), "query_id")
