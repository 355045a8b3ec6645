"""MinHash near-duplicates with DartMinHash signatures and banded joining.

The elements of a text are its five-word shingles (lower-cased words; a text of fewer words is
one shingle), weighted by how often they occur; similarity is the weighted Jaccard similarity,
the sum of smaller weights over the sum of larger ones.

DartMinHash: imagine darts thrown at the plane of (weight, rank), one per unit of area, for each
element; a signature coordinate is the dart of lowest rank among those that hit below their
element's weight. Only darts of low rank can win, so instead of drawing one value per element and
coordinate, the few low darts of each element are drawn from its hash, region by region:
weights are cut at powers of two, and in each strip darts come in rank order with exponential
gaps. About ``k (ln k + 2)`` darts per text fill ``k`` coordinates however long the text is; a
text with an empty coordinate is thrown again with twice the rank, which changes no earlier dart.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revdiff.llm import words
from revdiff.llm.common import arrow_rows, byte_slices, cut_lineage, stored, unused
from revdiff.llm.graph import components

SHINGLE = 5
BANDS, ROWS = 32, 5  # a pair at 0.8 shares no band with probability 3e-6
#: Fingerprint tables of so many rows are sent to every task; longer ones are joined by shuffle.
SMALL = 200_000
#: Texts whose shingles are in an Arrow batch, and texts that one task compares with a leader in a row.
PAIR_ROWS, FOLLOWERS = 64, 256
#: Times that leaders are chosen by unshared shingles; from the second on outside each bucket's main component.
ROUNDS = 1
#: Classes of mass for each factor of e.
MASS_CLASSES = 4
#: Texts in an Arrow batch.
TEXT_ROWS = 1000
_UNIT = 2.0**-53


class Shingles:
    """The distinct shingles of many texts: ``doc``, ``hash``, ``weight``, ordered by text and hash."""

    def __init__(self, texts: pa.Array, n: int = SHINGLE):
        self.words = words.split(pc.utf8_lower(pc.fill_null(texts, "")))
        found, count = self.words, self.words.count()
        hashes, whole = words.windows(found, n)
        first = np.r_[True, found.doc[1:] != found.doc[:-1]] if len(found.doc) else np.zeros(0, bool)
        for short in range(1, n):
            if (count == short).any():
                own, _ = words.windows(found, short)
                at = first & (count[found.doc] == short)
                hashes[at], whole[at] = words.mix(own[at] + np.uint64(short)), True
        doc, hashes = found.doc[whole], hashes[whole]
        order = np.lexsort((hashes, doc))
        doc, hashes = doc[order], hashes[order]
        new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])]) if len(doc) else np.zeros(0, np.int64)
        self.doc, self.hash = doc[new], hashes[new]
        self.weight = np.diff(np.r_[new, len(doc)])

    def keys(self) -> list[bytes | None]:
        """A 128-bit key of each text's word sequence; null without words."""
        ends = np.cumsum(self.words.count())
        data = self.words.hash.astype("<u8")
        return [hashlib.md5(data[a:b].tobytes()).digest() if b > a else None for a, b in zip(np.r_[0, ends[:-1]], ends, strict=True)]


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, k: int) -> np.ndarray:
    """DartMinHash: ``n_docs x k`` fingerprints; texts without elements have zeros."""
    out = np.zeros((n_docs, k), np.uint64)
    total = np.bincount(doc, weights=weight, minlength=n_docs)
    reach = k * (math.log(k) + 2) / np.maximum(total, 1)
    open_ = total > 0
    while open_.any():
        own = open_[doc]
        rank, mark = _throw(doc[own], element[own], weight[own], reach, n_docs, k)
        done = open_ & (rank < np.inf).all(axis=1)
        out[done] = mark[done]
        open_ &= ~done
        reach = reach * 2
    return out


def _throw(doc, element, weight, reach, n_docs, k):
    best, mark = np.full(n_docs * k, np.inf), np.zeros(n_docs * k, np.uint64)
    strips = 1 + np.ceil(np.log2(weight)).astype(np.int64)
    at = np.repeat(np.arange(len(doc)), strips)
    level = np.arange(len(at)) - np.repeat(np.cumsum(strips) - strips, strips)
    low = np.where(level > 0, 2.0 ** (level - 1), 0.0)
    width = np.where(level > 0, low, 1.0)
    seed = words.mix(element[at] + words.mix(level.astype(np.uint64) + np.uint64(7)))
    doc, weight = doc[at], weight[at].astype(float)
    rank, first = np.zeros(len(at)), 0
    while len(seed):
        n = int(np.clip(100_000 // len(seed), 1, 256))  # darts per strip in this step: many when few strips are left
        nth = (np.arange(first, first + n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
        bits = words.mix(seed[:, None] + nth)
        gap = -np.log(((bits >> np.uint64(11)).astype(float) + 0.5) * _UNIT) / width[:, None]
        ranks = rank[:, None] + np.cumsum(gap, axis=1)
        rank = ranks[:, -1].copy()
        row, col = np.nonzero(ranks <= reach[doc][:, None])
        bits = words.mix(bits[row, col] + np.uint64(0xD1B54A32D192ED03))
        height = low[row] + width[row] * (bits >> np.uint64(32)).astype(float) * 2.0**-32
        hit = height < weight[row]
        row, col, bits = row[hit], col[hit], bits[hit]
        slot = doc[row] * k + ((bits & np.uint64(0xFFFFFFFF)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
        ranked = ranks[row, col]
        np.minimum.at(best, slot, ranked)
        won = ranked == best[slot]
        mark[slot[won]] = words.mix(bits[won] ^ seed[row[won]])
        left = rank <= reach[doc]
        doc, weight, low, width, seed, rank = (x[left] for x in (doc, weight, low, width, seed, rank))
        first += n
    return best.reshape(n_docs, k), mark.reshape(n_docs, k)


def band_hashes(marks: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One hash per text and band; the band's number is part of it."""
    cut = marks.reshape(len(marks), bands, rows)
    out = np.broadcast_to(words.mix(np.arange(1, bands + 1, dtype=np.uint64)), (len(marks), bands)).copy()
    for r in range(rows):
        out = words.mix(out + cut[:, :, r])
    return out


def fingerprints(docs: DataFrame, id_col: str, text_col: str, batch_bytes: int = 1 << 19) -> DataFrame:
    """``id, h1, h2, key, bands`` of every row; ``h1, h2`` find its text again, ``key`` is its word sequence's."""
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).selectExpr("id", "text", "xxhash64(text) h1", "hash(text) h2")
    schema = T.StructType([
        rows.schema[0], T.StructField("h1", T.LongType()), T.StructField("h2", T.IntegerType()),
        T.StructField("key", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())),
    ])

    def sign(batches):
        for batch in byte_slices(batches, 1, batch_bytes):
            s = Shingles(batch.column(1))
            bands = band_hashes(signatures(s.doc, s.hash, s.weight, batch.num_rows, BANDS * ROWS)).view(np.int64)
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * BANDS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3), pa.array(s.keys(), pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(bands.ravel()))],
                names=schema.names,
            )

    return rows.mapInArrow(sign, schema)


def _shingle_rows(rows: DataFrame, batch_bytes: int = 1 << 19) -> DataFrame:
    """``key, elements, weights`` (as bytes, ordered by element) and ``mass`` of ``rows(key, text)``."""

    def cut(batches):
        for batch in byte_slices(batches, 1, batch_bytes):
            s = Shingles(batch.column(1))
            ends = np.cumsum(np.bincount(s.doc, minlength=batch.num_rows))
            at = list(zip(np.r_[0, ends[:-1]], ends, strict=True))
            element, weight = s.hash.astype("<u8"), s.weight.astype("<u4")
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([element[a:b].tobytes() for a, b in at], pa.binary()), pa.array([weight[a:b].tobytes() for a, b in at], pa.binary()),
                pa.array([int(weight[a:b].sum()) for a, b in at], pa.int64()),
            ], names=["key", "elements", "weights", "mass"])

    return rows.mapInArrow(cut, "key binary, elements binary, weights binary, mass long")


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (elements, weights), elements in order."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum(dtype=np.int64)
    return both / (a[1].sum(dtype=np.int64) + b[1].sum(dtype=np.int64) - both)


def _compared(pairs: DataFrame, shingles: DataFrame, threshold: float) -> DataFrame:
    """``a, b, similar`` of ``pairs(a, b)``, and what ``b`` has beside ``a``: ``rest``, ``rest_weights``.

    The shingles of an ``a`` are sent once for each ``FOLLOWERS`` of its ``b``, which follow them one by
    one: a hot ``a`` is spread over tasks, and a task holds the shingles of one ``a`` and one batch.
    """
    spark = pairs.sparkSession
    shares = pairs.groupBy("a").agg(F.ceil(F.count("*") / FOLLOWERS).alias("shares"))
    own = shingles.select("key", "elements", "weights")
    heads = shares.join(own, shares.a == own.key).select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"), F.lit(None).cast("binary").alias("b"), "elements", "weights")
    rows = pairs.join(shares, "a").withColumn("share", F.pmod(F.xxhash64("b"), "shares"))
    rows = rows.join(own, rows.b == own.key).select("a", "share", "b", "elements", "weights")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    joined = heads.union(rows).repartition(tasks, "a", "share").sortWithinPartitions("a", "share", F.col("b").asc_nulls_first())
    names = ["a", "b", "similar", "rest", "rest_weights"]

    def compare(batches):
        left = None
        for batch in batches:
            kept, similar, rest, weights = [], [], [], []
            for n in range(batch.num_rows):
                # copies: a buffer lives no longer than its batch
                one = np.frombuffer(batch.column(3)[n].as_buffer(), "<u8"), np.frombuffer(batch.column(4)[n].as_buffer(), "<u4")
                if not batch.column(2)[n].is_valid:
                    left = one[0].copy(), one[1].copy()
                    continue
                kept.append(n)
                similar.append(bool(similarity(left, one) >= threshold))
                beside = ~np.isin(one[0], left[0], assume_unique=True)
                rest.append(one[0][beside].view("<i8"))
                weights.append(one[1][beside].astype(np.int64))
            pair = batch.select([0, 2]).take(pa.array(kept, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [*pair.columns, pa.array(similar, pa.bool_()), pa.array(rest, pa.list_(pa.int64())), pa.array(weights, pa.list_(pa.int64()))], names=names
            )

    return joined.mapInArrow(compare, "a binary, b binary, similar boolean, rest array<long>, rest_weights array<long>")


def _own_tokens(checked: DataFrame, keys: DataFrame, shingles: DataFrame) -> DataFrame:
    """``key, x, w, n``: the shingles of each node in ``keys`` that no leader has, and how many nodes in
    ``keys`` have them.

    A node's shingles are those of the leader that it was compared with, and its rest. So only rests
    and leaders (with nodes that were compared with none) are looked through."""
    least = F.min_by(F.struct("a", "rest", "rest_weights"), F.size("rest")).alias("m")
    own = stored(checked.join(keys.select(F.col("key").alias("b")), "b").groupBy("b").agg(least).select("b", "m.*"))

    def elements(batches):
        for batch in batches:
            for e in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(e.as_buffer(), "<i8"))], names=["x"])

    first = keys.join(own.select(F.col("b").alias("key")), "key", "left_anti")
    leaders = own.select(F.col("a").alias("key")).union(first).distinct().join(shingles.select("key", "elements"), "key").select("elements")
    rests = own.select(F.col("b").alias("key"), F.inline(F.arrays_zip("rest", "rest_weights")).alias("x", "w"))
    every = rests.select("x", F.lit(1).alias("n"), F.lit(0).alias("h")).union(leaders.mapInArrow(elements, "x long").select("x", F.lit(0), F.lit(1)))
    free = every.groupBy("x").agg(F.sum("n").alias("n"), F.max("h").alias("h")).filter("h = 0 AND n > 0").drop("h")
    return stored(rests.join(free, "x"))


def _open(rows: DataFrame) -> DataFrame:
    """The rows ``(bucket, key, comp, mass, shared, ...)`` that can still link two components.

    With a similarity of 4/5, two nodes share at least 4/9 of their masses' sum; none shares more
    than its ``shared`` mass, and none has less mass than the bucket's smallest."""
    lowest = rows.groupBy("bucket").agg(F.min("mass").alias("lowest"))
    able = rows.join(lowest, "bucket").filter("9 * shared >= 4 * (mass + lowest)").drop("lowest")
    open_ = able.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("bucket")
    return able.join(open_, "bucket")


def _prefixes(nodes: DataFrame, tokens: DataFrame, shingles: DataFrame) -> DataFrame:
    """``key, comp, mass, token, cap``: the first shingles of each node, in an order common to all nodes.

    First come shingles that no leader has, rare ones before others, then the leaders' by hash. If
    a node's first shingle in common with another one has the mass P before it, they share its mass less P
    at most, which bounds the other one's mass by ``cap`` for a similarity of 4/5; shingles behind
    a fifth of the mass are first for none."""
    listed = tokens.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("n", "x", "w"))).alias("own"))
    rows = nodes.select("key", "comp", "mass").join(listed, "key", "left").join(shingles.select("key", "elements", "weights"), "key")

    def cut(batches):
        for batch in batches:
            for n in range(batch.num_rows):
                own = batch.column(3)[n].values
                x, w = (own.field(c).to_numpy().astype(t) for c, t in (("x", np.int64), ("w", np.int64))) if own is not None else (np.zeros(0, np.int64),) * 2
                e, v = np.frombuffer(batch.column(4)[n].as_buffer(), "<i8"), np.frombuffer(batch.column(5)[n].as_buffer(), "<u4").astype(np.int64)
                common = ~np.isin(e, x, assume_unique=True)
                x, w = np.r_[x, e[common]], np.r_[w, v[common]]
                before, mass = np.cumsum(w) - w, batch.column(2)[n].as_py()
                first = 5 * before <= mass
                x, before = x[first], before[first]
                node = batch.select([0, 1, 2]).take(pa.array(np.full(len(x), n, np.int32)))
                yield pa.RecordBatch.from_arrays([*node.columns, pa.array(x), pa.array((5 * mass - 9 * before) // 4)], names=["key", "comp", "mass", "token", "cap"])

    return rows.select("key", "comp", "mass", "own", "elements", "weights").mapInArrow(cut, "key binary, comp binary, mass long, token long, cap long")


def _cross_pairs(rows: DataFrame, tokens: DataFrame, shingles: DataFrame) -> DataFrame:
    """All pairs of nodes in ``rows`` of different components that may reach the threshold.

    In each bucket one component has most rows. A pair of a bucket that is in two components has a
    node outside it, so it is enough to look for partners of those: nodes with a first shingle in common
    (see ``_prefixes``) and a mass that allows the similarity. Masses are in the join's key, by
    class, so a shingle that a whole group shares brings only partners of the right mass."""
    asking = _outside(rows).select("key").distinct()
    first = stored(_prefixes(rows.select("key", "comp", "mass").distinct(), tokens, shingles))
    mass_class = lambda c: F.floor(F.log(c) * MASS_CLASSES)
    lowest, highest = F.ceil(F.col("mass") * 4 / 5), F.least("cap", F.floor(F.col("mass") * 5 / 4))
    asked = first.join(asking, "key").filter(lowest <= highest)
    asked = asked.withColumn("kind", F.explode(F.sequence(mass_class(lowest), mass_class(highest)))).alias("p")
    there = first.withColumn("kind", mass_class(F.col("mass"))).alias("q")
    fits = (F.col("p.comp") != F.col("q.comp")) & (F.col("q.mass") <= F.col("p.cap")) & (F.col("p.mass") <= F.col("q.cap"))
    pairs = asked.join(there, (F.col("p.token") == F.col("q.token")) & (F.col("p.kind") == F.col("q.kind")) & fits)
    return pairs.select(F.least("p.key", "q.key").alias("a"), F.greatest("p.key", "q.key").alias("b")).distinct()


def _leaders(rows: DataFrame, by: str) -> DataFrame:
    """``bucket, leader, led, top``: the node of each bucket that is largest ``by`` a column, and its component."""
    first = F.max(F.struct(by, "key", "comp")).alias("m")
    return rows.groupBy("bucket").agg(first).select("bucket", F.col("m.key").alias("leader"), F.col("m.comp").alias("led"), F.col(f"m.{by}").alias("top"))


def _joined_up(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` where components that ``links(comp, up)`` connects go by the name of one of them, as far as
    two steps up lead. What is connected may keep several names: they only save comparisons."""
    up = links.groupBy("comp").agg(F.min("up").alias("up"))
    top = up.alias("x").join(up.alias("y"), F.col("x.up") == F.col("y.comp"), "left").select("x.comp", F.coalesce("y.up", "x.up").alias("top"))
    return rows.join(top, "comp", "left").withColumn("comp", F.coalesce("top", "comp")).drop("top")


def _labelled(rows: DataFrame, label: DataFrame) -> DataFrame:
    known = rows.drop("comp").join(label, F.col("key") == F.col("node"), "left")
    return known.withColumn("comp", F.coalesce("comp", "key")).drop("node")


def _outside(rows: DataFrame) -> DataFrame:
    """The rows of each bucket that are not in the component that has most of its rows."""
    sizes = rows.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
    most = sizes.groupBy("bucket").agg(F.max(F.struct("n", "comp")).alias("m")).select("bucket", F.col("m.comp").alias("most"))
    return rows.join(most, "bucket").filter("comp <> most").drop("most")


def _components(members: DataFrame, shingles: DataFrame, threshold: float) -> DataFrame:
    """``node, comp``: the components of the whole graph of similar pairs; nodes without links may be missing.

    In each bucket the most central node leads: the one whose buckets hold most rows, as a rule
    the text that others were made from. Each node is compared with the most central of its
    leaders, or with that one's own leader, and linked ones go by one name. Nodes whose unshared
    shingles rule out any further link leave, and buckets of one component. Then in each bucket the node with the least share of unshared shingles leads (the
    text that others were made from has none), and all others are compared with it. What may
    still link two components is found by rare shingles (``_cross_pairs``) and compared pair by pair."""
    rows = members.withColumn("comp", F.col("key")).withColumn("shared", F.col("mass"))
    met = rows.select("bucket", "key").join(_leaders(rows, "central"), "bucket").filter("key <> leader")
    pairs = met.groupBy(F.col("key").alias("b")).agg(F.max(F.struct("top", "leader")).alias("m")).select(F.col("m.leader").alias("a"), "b")
    up = pairs.select(F.col("b").alias("a"), F.col("a").alias("top"))  # a leader that has one hands its nodes on: few lead
    pairs = pairs.join(up, "a", "left").select(F.coalesce("top", "a").alias("a"), "b")
    spark = members.sparkSession
    with arrow_rows(spark, PAIR_ROWS):
        checked = first = stored(_compared(pairs, shingles, threshold))
    links = checked.filter("similar").select("a", "b")
    rows = stored(_open(_joined_up(rows, links.select(F.col("b").alias("comp"), F.col("a").alias("up")))))
    if rows.isEmpty():
        return components(links)
    tokens = _own_tokens(first, rows.select("key").distinct(), shingles)
    alone = tokens.filter("n = 1").groupBy("key").agg(F.sum("w").alias("alone"))
    shared = F.col("mass") - F.coalesce("alone", F.lit(0))
    rows = stored(_open(rows.join(alone, "key", "left").withColumn("shared", shared).withColumn("part", shared / F.col("mass")).drop("alone")))
    if rows.isEmpty():
        return components(links)
    for turn in range(ROUNDS):
        pool = rows if turn == 0 else _outside(rows)
        met = pool.join(_leaders(pool, "part"), "bucket").filter("key <> leader AND comp <> led")
        met = met.select(F.col("leader").alias("a"), F.col("key").alias("b")).distinct().join(checked.select("a", "b"), ["a", "b"], "left_anti")
        with arrow_rows(spark, PAIR_ROWS):
            more = stored(_compared(met, shingles, threshold))
        checked, links = checked.union(more), links.union(more.filter("similar").select("a", "b"))
        label = components(links)
        rows = stored(_open(_labelled(rows, label)))
        if rows.isEmpty():
            return label
    with arrow_rows(spark, PAIR_ROWS):
        tokens = _own_tokens(first, rows.select("key").distinct(), shingles)
        last = stored(_cross_pairs(rows, tokens, shingles))
        flipped = checked.select("a", "b").union(checked.select(F.col("b").alias("a"), F.col("a").alias("b")))
        more = stored(_compared(last.join(flipped, ["a", "b"], "left_anti"), shingles, threshold).filter("similar").select("a", "b"))
    return components(links.union(more))


def near_duplicates(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, class_id, kept, h1, h2``: one row per row of ``docs``.

    ``class_id`` is the smallest id among all documents that are linked, directly or through
    others, by a similarity of ``threshold`` (0.8 or more) or above; one row of each class is
    kept. ``h1, h2`` are hashes of the row's text.

    Equal word sequences become one node first. Nodes that share a band are candidates; see
    ``_components`` for how they are compared, exactly, without listing the pairs of a large group.

    A text without words (null, empty, blank) is a class of its own. Rows with a null id take
    part; a class id is null only if all its ids are. Of repeated rows one is kept. An empty
    table gives no rows. Other columns are not read.
    """
    if threshold < 0.8:
        raise ValueError("bands and bounds are made for similarities of 0.8 or more")
    spark = docs.sparkSession
    with arrow_rows(spark, TEXT_ROWS):
        prints = cut_lineage(fingerprints(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    keeper = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row", "h1", "h2")).alias("keeper")
    nodes = stored(prints.filter("key IS NOT NULL").groupBy("key").agg(keeper, F.first("bands").alias("bands")))
    buckets = nodes.select("key", F.explode("bands").alias("bucket"))
    crowded = buckets.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    crowded = stored(buckets.join(crowded, "bucket"))
    central = crowded.groupBy("key").agg(F.sum("n").alias("central"))
    needed = stored(central.join(nodes.select("key", "keeper"), "key").select("key", "keeper.id", "keeper.h1", "keeper.h2", "central"))
    near = F.broadcast(needed) if needed.count() <= SMALL else needed
    texts = docs.select(docs[id_col].alias("own_id"), docs[text_col].alias("text")).selectExpr("own_id", "text", "xxhash64(text) t1", "hash(text) t2")
    texts = texts.join(near, (F.col("t1") == F.col("h1")) & (F.col("t2") == F.col("h2")) & F.col("own_id").eqNullSafe(F.col("id")))
    with arrow_rows(spark, TEXT_ROWS):
        shingles = cut_lineage(_shingle_rows(texts.select("key", "text").dropDuplicates(["key"])))
    sized = needed.select("key", "central").join(shingles.select("key", "mass"), "key")
    members = stored(crowded.select("bucket", "key").join(sized, "key"))
    label = _components(members, shingles, threshold)

    comp = nodes.select("key", "keeper").join(label, F.col("key") == F.col("node"), "left").select("key", "keeper", F.coalesce("comp", "key").alias("comp"))
    comp = stored(comp)
    best = comp.groupBy("comp").agg(F.min("keeper").alias("best"))
    of_key = comp.select("key", "comp").join(best, "comp").select("key", F.col("best.id").alias("class_id"), F.col("best.row").alias("kept_row"), F.lit(True).alias("in_class"))
    return prints.join(of_key, "key", "left").select(
        F.col("id").alias(id_col), F.when(F.col("in_class"), F.col("class_id")).otherwise(F.col("id")).alias("class_id"),
        F.coalesce(F.col("row") == F.col("kept_row"), F.lit(True)).alias("kept"), "h1", "h2",
    )


def drop_near_duplicates(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``near_duplicates`` keeps: one of each class.
    Rows of equal id and text count as one row."""
    h1, h2, k1, k2, own = unused(docs, "_h1", "_h2", "_k1", "_k2", "_id")
    kept = near_duplicates(docs, threshold, id_col, text_col).filter("kept").select(F.col(id_col).alias(own), F.col("h1").alias(k1), F.col("h2").alias(k2))
    rows = docs.withColumn(h1, F.xxhash64(docs[text_col])).withColumn(h2, F.hash(docs[text_col]))
    same = (F.col(h1) == F.col(k1)) & (F.col(h2) == F.col(k2)) & rows[id_col].eqNullSafe(F.col(own))
    return rows.join(kept.distinct(), same).dropDuplicates([h1, h2, own]).select(*docs.columns)
