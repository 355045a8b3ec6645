"""Alignment of blocks too large for one task.

Records that score alike are collapsed into classes, so a hot text counts once. All pairs of
classes are scored in tiles of bounded size that spread over the cluster. The assignment is found
on few pairs and proved on all of them:

1. Tiles return the best partners of each class. They are the first candidates.
2. One task per block finds the best flow between its classes over the candidates, with a price
   for each class. Prices of a candidate add up to its worth at least, those of a pair in the
   flow to its worth exactly; classes that are not used up are free. So the flow's worth equals the
   sum of prices, which no assignment over the candidates exceeds.
3. Tiles score all pairs against the prices. A pair worth more than its prices becomes a
   candidate, and 2. is repeated. Without such a pair the prices prove the flow for the whole matrix.
   Blocks whose pairs are all candidates are proved by 2. and not scored again.

A task holds two tiles, or the candidates of a block: numbers only, a few per class, which grows
with the block's records while the scoring grows with their square.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revdiff.operators.align import MATCH_THRESHOLD, NUMBER_BONUS, SECTION_BONUS, UNIT, scores, tie_cost
from revdiff.operators.ordering import ordinal, running_sum
from revdiff.sources.session import cut_lineage, shuffled, task_slots

CLASS = ["pair_id", "is_new", "place"]
#: Partners of each class that become candidates at a time.
NEAR = 8
#: A tile of the previous side is so many times as long as one of the current side.
STRIP = 8
#: Characters that count like one record when tiles are cut.
RECORD_CHARS = 256
#: Worth and prices are whole numbers with the tie cost in the lower bits.
LOW = 61
_PAIRS_DDL = "pair_id string, n_place bigint, o_place bigint, adj double, similarity double"


def classes(records: DataFrame) -> DataFrame:
    """Collapse copies: records of a side that score alike, with their number and the first ``ord``."""
    return records.groupBy("pair_id", "is_new", "txt", "section", "number").agg(F.min("ord").alias("cid"), F.count(F.lit(1)).alias("cnt"))


def _placed(records: DataFrame) -> DataFrame:
    """Classes with their place by first record, how many records' worth of text lies before them,
    and the records of their block's longer side."""
    sizes = records.groupBy("pair_id", "is_new").agg(F.count(F.lit(1)).alias("n")).groupBy("pair_id").agg(F.max("n").alias("size"))
    found = ordinal(classes(records), ["pair_id", "is_new"], "cid", "place").withColumn("place", F.col("place") - 1)
    share = F.greatest(F.lit(1), F.length("txt") / F.lit(RECORD_CHARS))
    return running_sum(found, ["pair_id", "is_new"], "cid", share, "upto").join(sizes, "pair_id")


def _units(live: DataFrame, tile: int) -> DataFrame:
    """All pairs of a tile of current and a strip of previous classes, as two arrays, spread over the cluster."""

    def side(is_new: bool, size: int, name: str) -> DataFrame:
        own = [c for c in live.columns if c not in ("pair_id", "is_new", "cid", "upto")]
        rows = live.filter(F.col("is_new") == is_new).groupBy("pair_id", F.floor(F.col("upto") / size).alias(f"{name}_tile"))
        return rows.agg(F.sort_array(F.collect_list(F.struct("place", *[c for c in own if c != "place"]))).alias(name))

    new, old = side(True, tile, "new"), side(False, tile * STRIP, "old")
    old_ids = old.groupBy("pair_id").agg(F.collect_set("old_tile").alias("old_tiles"))
    units = new.join(old_ids, "pair_id").withColumn("old_tile", F.explode("old_tiles")).drop("old_tiles").join(old, ["pair_id", "old_tile"])
    return units.repartition(task_slots(live.sparkSession), "pair_id", "old_tile", "new_tile").select("pair_id", "new", "old")


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(batch.num_rows):
            yield batch.slice(at, 1).to_pylist()[0]


def _places(side: list[dict]) -> np.ndarray:
    return np.array([r["place"] for r in side], np.int64)


def _best_of(ranked: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ``count`` largest cells of each row; equal ones by column."""
    cols = np.argsort(-ranked, axis=1, kind="stable")[:, :count]
    return np.repeat(np.arange(len(ranked)), cols.shape[1]), cols.ravel()


def _tile_tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best partners of every class of a pair of tiles: two by plain score, for current classes,
    and ``NEAR`` by adjusted score, for both sides."""
    for unit in _each(batches):
        base, adj = scores(unit["new"], unit["old"])
        new, old = _places(unit["new"]), _places(unit["old"])
        count = np.array([r["cnt"] for r in unit["old"]], np.int64)
        j, i = _best_of(adj.T, NEAR)
        for kind, (row, col) in (("base", _best_of(base, 2)), ("new", _best_of(adj, NEAR)), ("old", (i, j))):
            yield pa.RecordBatch.from_arrays(
                [pa.array([unit["pair_id"]] * len(row), pa.string()), pa.array([kind] * len(row)), pa.array(new[row]), pa.array(old[col]),
                 pa.array(adj[row, col]), pa.array(base[row, col]), pa.array(count[col])],
                names=["pair_id", "kind", "n_place", "o_place", "adj", "similarity", "o_cnt"],
            )


def _tops(live: DataFrame, tile: int) -> DataFrame:
    """The best partners over whole blocks: two by plain score (kind ``base``), ``NEAR`` by adjusted score."""
    found = _units(live, tile).mapInArrow(_tile_tops, "pair_id string, kind string, n_place bigint, o_place bigint, adj double, similarity double, o_cnt bigint")
    own = F.when(F.col("kind") == "old", F.col("o_place")).otherwise(F.col("n_place"))
    other = F.when(F.col("kind") == "old", F.col("n_place")).otherwise(F.col("o_place"))
    score = F.when(F.col("kind") == "base", F.col("similarity")).otherwise(F.col("adj"))
    ranked = Window.partitionBy("pair_id", "kind", own).orderBy(F.desc(score), other)
    return found.withColumn("rn", F.row_number().over(ranked)).filter(F.col("rn") <= F.when(F.col("kind") == "base", 2).otherwise(NEAR))


def best_flow(supply: np.ndarray, room: np.ndarray, edges: dict[int, list[tuple[int, int]]]) -> tuple[dict, list[int], list[int]]:
    """The flow ``{(i, j): amount}`` of largest worth from ``supply`` to ``room``, and the prices of both sides.

    ``edges[i]`` has ``(j, worth)``. Shortest augmenting paths over prices less worth, from
    one row after the other, to room that is left or to a row that is better left over.
    """
    row_price = [max([0, *(w for _, w in edges.get(i, ()))]) for i in range(len(supply))]
    col_price = [0] * len(room)
    left, users = room.tolist(), [{} for _ in room]
    for start, amount in enumerate(supply.tolist()):
        while amount and row_price[start]:
            dist, via, back, heap = {}, {}, {start: (0, None)}, []
            goal, end = row_price[start], ("row", start)
            reached = [start]
            while True:
                for i in reached:
                    d = back[i][0]
                    if d + row_price[i] < goal:
                        goal, end = d + row_price[i], ("row", i)
                    for j, worth in edges.get(i, ()):
                        new = d + row_price[i] + col_price[j] - worth
                        if new < goal and new < dist.get(j, goal):
                            dist[j], via[j] = new, i
                            heapq.heappush(heap, (new, j))
                while heap and heap[0][0] > dist[heap[0][1]]:
                    heapq.heappop(heap)
                if not heap or heap[0][0] >= goal:
                    break
                d, j = heapq.heappop(heap)
                if left[j]:
                    goal, end = d, ("col", j)
                    break
                reached = [i for i in users[j] if i not in back]
                for i in reached:
                    back[i] = (d, j)
            for i, (d, _) in back.items():
                if d < goal:
                    row_price[i] -= goal - d
            for j, d in dist.items():
                if d < goal:
                    col_price[j] += goal - d
            path, (kind, at) = [], end
            col = at if kind == "col" else back[at][1]
            step = amount if kind == "row" else min(amount, left[at])
            if kind == "row" and col is not None:
                step = min(step, users[col][at])
                path.append((at, col, -1))
            while col is not None:
                i = via[col]
                path.append((i, col, 1))
                before = back[i][1]
                if before is not None:
                    step = min(step, users[before][i])
                    path.append((i, before, -1))
                col = before
            for i, j, sign in path:
                users[j][i] = users[j].get(i, 0) + sign * step
                if not users[j][i]:
                    del users[j][i]
            if kind == "col":
                left[at] -= step
            amount -= step
    return {(i, j): x for j, own in enumerate(users) for i, x in own.items()}, row_price, col_price


def _solve(block):
    """Prices of all classes (kind 0 and 1: place, high and low part) and the flow (kind 2: places, amount) of one block."""
    import pandas as pd

    pair_id = block["pair_id"].iloc[0]
    kind, a, b, x = (block[c].to_numpy() for c in ("kind", "a", "b", "x"))
    sizes = []
    for k in (0, 1):
        own = np.zeros(int((kind == k).sum()), np.int64)
        own[a[kind == k]] = x[kind == k]
        sizes.append(own)
    a, b, x = a[kind == 2], b[kind == 2], x[kind == 2]
    tie = tie_cost(a, b, int(max(s.sum() for s in sizes)))
    edges: dict[int, list] = {}
    for i, j, w, t in zip(a.tolist(), b.tolist(), x.tolist(), tie.tolist(), strict=True):
        edges.setdefault(i, []).append((j, (w << LOW) - t))
    flow, row_price, col_price = best_flow(*sizes, edges)
    worth = {(i, j): w for i, own in edges.items() for j, w in own}
    prices = sum(p * int(n) for own, size in ((row_price, sizes[0]), (col_price, sizes[1])) for p, n in zip(own, size, strict=True))
    if prices != sum(worth[e] * n for e, n in flow.items()):
        raise ArithmeticError(f"block {pair_id}: prices do not prove the flow")
    rows = [(k, place, 0, p >> LOW, p & (1 << LOW) - 1) for k, own in ((0, row_price), (1, col_price)) for place, p in enumerate(own)]
    rows += [(2, i, j, n, 0) for (i, j), n in flow.items()]
    out = pd.DataFrame(np.array(rows, np.int64).reshape(-1, 5), columns=["kind", "a", "b", "x", "y"])
    out.insert(0, "pair_id", pair_id)
    return out


def _solved(live: DataFrame, pairs: DataFrame) -> DataFrame:
    nodes = live.select("pair_id", F.when(F.col("is_new"), 0).otherwise(1).alias("kind"), F.col("place").alias("a"), F.lit(0).cast("bigint").alias("b"), F.col("cnt").alias("x"))
    worth = F.rint(F.col("adj") * F.lit(float(UNIT))).cast("bigint")
    edges = pairs.select("pair_id", F.lit(2).alias("kind"), F.col("n_place").alias("a"), F.col("o_place").alias("b"), worth.alias("x"))
    numbers = nodes.unionByName(edges).repartition(task_slots(live.sparkSession), "pair_id")  # few bytes, much work
    return numbers.groupBy("pair_id").applyInPandas(_solve, "pair_id string, kind int, a bigint, b bigint, x bigint, y bigint")


def _bound(new: list[dict], old: list[dict]) -> np.ndarray:
    """No pair of the two sides scores more: texts differ by their lengths and letter counts at least."""

    def counted(side):
        out = np.zeros((len(side), 64), np.int32)
        for row, r in zip(out, side, strict=True):
            row += np.bincount(np.frombuffer(r["txt"].encode("utf-32-le", "surrogatepass"), "<u4") & 63, minlength=64).astype(np.int32)
        return out

    a, b = counted(new), counted(old)
    n, m = a.sum(axis=1)[:, None], b.sum(axis=1)[None, :]
    longer, common = np.maximum(n, m), np.stack([np.minimum(row, b).sum(axis=1) for row in a])
    best = np.where(longer > 0, common / np.maximum(longer, 1), 1.0)
    return np.minimum(1.0, best + SECTION_BONUS + NUMBER_BONUS)


def _tile_violations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a pair of tiles that are worth more than their prices, the ``NEAR`` worst ones of each class.

    Worth and prices are compared in two parts. The lower parts of both prices and the tie cost
    add up to less than 2**63; what they carry to the upper parts decides."""
    for unit in _each(batches):
        new, old = unit["new"], unit["old"]
        high = np.array([r["hi"] for r in new])[:, None] + np.array([r["hi"] for r in old])[None, :]
        able = np.rint(_bound(new, old) * UNIT).astype(np.int64) >= high
        rows, cols = np.flatnonzero(able.any(axis=1)), np.flatnonzero(able.any(axis=0))
        if not len(rows):
            continue
        new, old = [new[i] for i in rows], [old[j] for j in cols]
        base, adj = scores(new, old)
        a, b = _places(new), _places(old)
        low = np.array([r["lo"] for r in new])[:, None] + np.array([r["lo"] for r in old])[None, :]
        low += tie_cost(a[:, None], b[None, :], new[0]["size"])
        excess = np.rint(adj * UNIT).astype(np.int64) - high[np.ix_(rows, cols)] - (low >> LOW)
        j, i = _best_of(excess.T, NEAR)
        row, col = (np.concatenate(x) for x in zip(_best_of(excess, NEAR), (i, j), strict=True))
        row, col = np.unique(np.stack([row, col])[:, excess[row, col] > 0], axis=1)
        yield pa.RecordBatch.from_arrays(
            [pa.array([unit["pair_id"]] * len(row), pa.string()), pa.array(a[row]), pa.array(b[col]), pa.array(adj[row, col]), pa.array(base[row, col]),
             pa.array(excess[row, col])],
            names=["pair_id", "n_place", "o_place", "adj", "similarity", "excess"],
        )


def _violations(live: DataFrame, solved: DataFrame, tile: int) -> DataFrame:
    """The pairs that disprove the prices, ``NEAR`` or more of each class; none where the flow is optimal."""
    price = solved.filter("kind < 2").select("pair_id", (F.col("kind") == 0).alias("is_new"), F.col("a").alias("place"), F.col("x").alias("hi"), F.col("y").alias("lo"))
    found = _units(live.join(price, CLASS), tile).mapInArrow(_tile_violations, _PAIRS_DDL + ", excess bigint")
    worst = [Window.partitionBy("pair_id", c).orderBy(F.desc("excess"), o) for c, o in (("n_place", "o_place"), ("o_place", "n_place"))]
    ranked = found.withColumns({"_n": F.row_number().over(worst[0]), "_o": F.row_number().over(worst[1])})
    return ranked.filter((F.col("_n") <= NEAR) | (F.col("_o") <= NEAR)).drop("_n", "_o", "excess")


def _with_other_pairs(live: DataFrame, pairs: DataFrame) -> DataFrame:
    """Classes of blocks that have pairs besides the candidates. No candidate is worth more than its prices."""
    side = lambda is_new: F.count(F.when(F.col("is_new") == is_new, 1))
    blocks = live.groupBy("pair_id").agg((side(True) * side(False)).alias("all"))
    known = pairs.groupBy("pair_id").agg(F.count(F.lit(1)).alias("known"))
    some = blocks.join(shuffled(known), "pair_id", "left").filter(F.col("all") > F.coalesce("known", F.lit(0)))
    return live.join(shuffled(some.select("pair_id")), "pair_id", "left_semi")


def align_large(records: DataFrame, tile: int) -> DataFrame:
    """Align large blocks; ``records`` is a stored table. See the module's text for the way."""
    live = cut_lineage(_placed(records))
    tops = cut_lineage(_tops(live, tile))
    pairs = cut_lineage(tops.filter("kind <> 'base'").select("pair_id", "n_place", "o_place", "adj", "similarity").distinct())
    matched, open_ = None, live
    while True:
        solved = cut_lineage(_solved(open_, pairs))
        more = cut_lineage(_violations(_with_other_pairs(open_, pairs), solved, tile))
        ids = cut_lineage(more.select("pair_id").distinct())
        flow = solved.filter("kind = 2").join(ids, "pair_id", "left_anti").select("pair_id", F.col("a").alias("n_place"), F.col("b").alias("o_place"), F.col("x").alias("take"))
        flow = flow.join(pairs, ["pair_id", "n_place", "o_place"]).filter(F.col("adj") >= MATCH_THRESHOLD)
        matched = flow if matched is None else matched.unionByName(flow)
        if ids.isEmpty():
            return _to_records(records, live, tops, matched)
        open_ = live.join(ids, "pair_id", "left_semi")
        pairs = cut_lineage(pairs.join(ids, "pair_id", "left_semi").unionByName(more))


def _to_records(records: DataFrame, live: DataFrame, tops: DataFrame, flow: DataFrame) -> DataFrame:
    """From flows between classes back to records: each class deals out its members in order."""
    for of, by in (("n", "o"), ("o", "n")):
        earlier = Window.partitionBy("pair_id", f"{of}_place").orderBy(f"{by}_place")
        flow = flow.withColumn(f"{of}_used", F.sum("take").over(earlier) - F.col("take"))
    same = F.lit(True)
    for c in ("pair_id", "is_new", "txt", "section", "number"):
        same = same & F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}"))
    members = records.alias("r").join(live.alias("c"), same).select("r.pair_id", "r.is_new", "r.ord", "c.place")
    members = cut_lineage(ordinal(members, CLASS, "ord", "k"))
    new = members.filter("is_new").select("pair_id", F.col("place").alias("n_place"), F.col("ord").alias("n_ord"), "k")
    old = members.filter("NOT is_new").select("pair_id", F.col("place").alias("o_place"), F.col("ord").alias("o_ord"), F.col("k").alias("o_k"))
    best = [F.max(F.when(F.col("rn") == n, F.struct("o_place", "similarity", "o_cnt"))).alias(f"b{n}") for n in (1, 2)]
    plain = tops.filter("kind = 'base'").groupBy("pair_id", "n_place").agg(*best)
    alone = (F.col("b1.o_place") == F.col("o_place")) & (F.col("b1.o_cnt") < 2)
    pairs = cut_lineage(
        new.join(flow, ["pair_id", "n_place"]).filter("k > n_used AND k <= n_used + take")
        .withColumn("o_k", F.col("o_used") + F.col("k") - F.col("n_used")).join(old, ["pair_id", "o_place", "o_k"]).join(plain, ["pair_id", "n_place"])
        .withColumn("second_best", F.when(alone, F.col("b2.similarity")).otherwise(F.col("b1.similarity")))
        .select("pair_id", "n_ord", "o_ord", "similarity", "adj", "second_best")
    )
    out = pairs
    for is_new, mine, other in ((True, "n_ord", "o_ord"), (False, "o_ord", "n_ord")):
        left = members.filter(F.col("is_new") == is_new).select("pair_id", F.col("ord").alias(mine)).join(pairs, ["pair_id", mine], "left_anti")
        none = {c: F.lit(None).cast("double") for c in ("similarity", "adj", "second_best")}
        out = out.unionByName(left.withColumns({other: F.lit(None).cast("bigint"), **none}).select(*pairs.columns))
    return out
