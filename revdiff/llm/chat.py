"""Chat formatting as prefix trees: conversations that share initial turns share their tokens.

A turn's node is known by a hash of all turns up to it, so equal beginnings meet without
comparing conversations pairwise. The nodes of a tree are laid out depth first in one sequence,
each once, with position ids that count along its own path and the intervals of the sequence that
hold its ancestors: together with the node itself these are what its tokens may attend to.

A tree of many conversations (a common first turn) is cut along its prefixes: a turn that at most
``LEAVES`` different conversations pass keeps all of them in one sequence and is there once. Such
subtrees fill sequences in depth-first order, so a turn that n > ``LEAVES`` conversations pass is in
at most n / ``LEAVES`` + 1 of them, and a sequence has fewer than 2 * ``LEAVES`` conversations.

Units are code points. A turn is written ``<|role|>\\n`` + text + ``<|end|>\\n``; a backslash in
role or text is doubled, and one is put inside every control string, which undoes exactly.
"""

from __future__ import annotations

import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revdiff.llm.common import cut_lineage
from revdiff.sources.session import task_slots

#: Control strings of this and other common templates.
CONTROL = ("<|", "|>", "</s>", "<s>", "[/INST]", "[INST]", "<<SYS>>", "<</SYS>>")
END = "<|end|>\n"
TRAINED = "assistant"
LEAVES = 32
_TURN = re.compile(r"<\|(.*?)\|>\n(.*)", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escaped(c: Column) -> Column:
    out = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for x in CONTROL:
        out = F.replace(out, F.lit(x), F.lit(x[0] + "\\" + x[1:]))
    return out


def unescaped(s: str) -> str:
    return _ESCAPED.sub(r"\1", s)


def _layout(rows):
    """Depth-first layout of the paths of one sequence; rows come by path, then place in it."""
    children, first, is_end = {None: []}, {}, set()
    for _, path in itertools.groupby(rows, key=lambda r: r[1]):
        above = None
        for _, _, pos, k1, k2, n in path:
            key = (pos, k1, k2)
            if key not in first:
                first[key] = n
                children[key] = []
                children[above].append(key)
            above = key
        is_end.add(above)
    at, todo, place = 0, [(key, 0, ()) for key in reversed(children[None])], []
    while todo:
        key, position, ancestors = todo.pop()
        n = first[key]
        place.append((*key, at, n, position, ancestors, key in is_end))
        if ancestors and ancestors[-1][1] == at:  # follows its parent: one interval
            path = (*ancestors[:-1], (ancestors[-1][0], at + n))
        else:
            path = (*ancestors, (at, at + n))
        at += n
        todo += [(x, position + n, path) for x in reversed(children[key])]
    return place


def _groups(batches):
    """Rows of all batches, grouped by the first column; rows of a group lie together."""
    rows = itertools.chain.from_iterable(zip(*(c.to_pylist() for c in b.columns), strict=True) for b in batches)
    return itertools.groupby(rows, key=lambda r: r[0])


def _sequences(large: DataFrame, path: DataFrame, leaves: int) -> DataFrame:
    """``rep, part`` for conversations ``large(rep, r1, r2)`` of trees of more than ``leaves`` of them.

    A unit is a turn that at most ``leaves`` conversations pass below one that more pass, or a
    conversation that ends above. Units are put in depth-first order by their paths, in ranges over
    the cluster, and a tree's running number of conversations tells the sequence.
    """
    node = ["pos", "k1", "k2"]
    own = cut_lineage(path.join(large.select("rep"), F.col("conv").eqNullSafe(F.col("rep"))).select("rep", *node))
    hot = own.groupBy(*node).agg(F.count("*").alias("n")).filter(F.col("n") > leaves).select(*node, F.lit(1).alias("hot"))
    # more conversations pass a turn than any turn below it, so the hot turns of a path come first
    each = own.join(hot, node, "left").groupBy("rep").agg(F.count("hot").cast("int").alias("cut"), F.sort_array(F.collect_list(F.struct(*node))).alias("nodes"))
    each = cut_lineage(each.select("rep", F.slice("nodes", F.lit(1), F.col("cut") + 1).alias("unit")))
    units = cut_lineage(each.groupBy("unit").agg(F.count("*").alias("n")))
    first, last = F.element_at("unit", 1), F.element_at("unit", -1)
    ranges = units.repartitionByRange(task_slots(path.sparkSession), "unit").sortWithinPartitions("unit")
    ranges = ranges.select(F.spark_partition_id().alias("range"), "n", *(last[c].alias(c) for c in node), first["k1"].alias("r1"), first["k2"].alias("r2"))

    def count_up(batches):
        before = 0
        for batch in batches:
            upto = before + np.cumsum(batch.column(1).to_numpy())
            yield batch.append_column("upto", pa.array(upto, pa.int64()))
            before = int(upto[-1]) if len(upto) else before

    placed = cut_lineage(ranges.mapInArrow(count_up, "range int, n long, pos int, k1 long, k2 long, r1 long, r2 long, upto long"))
    earlier = placed.groupBy("range").agg(F.sum("n").alias("own"))  # a row for each range
    earlier = earlier.select("range", (F.sum("own").over(Window.partitionBy(F.lit(0)).orderBy("range")) - F.col("own")).alias("earlier"))
    placed = placed.join(F.broadcast(earlier), "range").withColumn("start", F.col("earlier") + F.col("upto") - F.col("n"))
    trees = placed.groupBy("r1", "r2").agg(F.min("start").alias("tree"))
    parts = placed.join(trees, ["r1", "r2"]).select(*node, F.expr(f"(start - tree) div {leaves}").alias("part"))
    return each.select("rep", *(last[c].alias(c) for c in node)).join(parts, node).select("rep", "part")


def format_conversations(convs: DataFrame, leaves: int = LEAVES, conv_col: str = "conv_id") -> tuple[DataFrame, DataFrame]:
    """``(nodes, ends)`` for ``convs(conv_col, turn, role, text)``.

    ``nodes``: ``sequence_id, start, length, position, ancestors`` (intervals of the sequence),
    ``depth, segment`` (the formatted turn), ``loss_start, loss_end`` (what of the sequence is
    trained on: assistant texts; empty otherwise), ``is_end``. A sequence is its segments by
    ``start``. ``ends``: ``conv_col, n_turns, sequence_id, start``, the conversation's last node.

    Turns go by ``turn``, then role, then text, nulls first. A null role or text is empty; a null
    conversation id is a conversation; repeated rows are turns each. Equal conversations end
    in one node. An empty table gives no rows. Other columns are not read.
    """
    conv = F.col("conv")
    turns = convs.select(
        convs[conv_col].alias("conv"), convs["turn"].alias("turn"), F.coalesce(convs["role"], F.lit("")).alias("role"), F.coalesce(convs["text"], F.lit("")).alias("text")
    )
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    numbered = turns.withColumn("pos", F.row_number().over(order) - 1)
    hashed = numbered.withColumn("h1", F.xxhash64("pos", "role", "text")).withColumn("h2", F.xxhash64(F.lit("2"), "text", "pos", "role"))
    by_pos = Window.partitionBy("conv").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    path = cut_lineage(hashed.select(
        "conv", "pos", "role", "text", F.bit_xor("h1").over(by_pos).alias("k1"), F.bit_xor("h2").over(by_pos).alias("k2"),
    ))
    head = F.concat(F.lit("<|"), escaped(F.col("role")), F.lit("|>\n"))
    segment = F.concat(head, escaped(F.col("text")), F.lit(END))
    each = path.groupBy("conv").agg(
        F.count("*").alias("n_turns"), F.max(F.struct("pos", "k1", "k2")).alias("end"), F.min(F.struct("pos", "k1", "k2")).alias("root")
    )
    each = cut_lineage(each.select("conv", "n_turns", "end.pos", "end.k1", "end.k2", F.col("root.k1").alias("r1"), F.col("root.k2").alias("r2")))
    distinct = each.groupBy("pos", "k1", "k2").agg(F.min("conv").alias("rep"), F.first("r1").alias("r1"), F.first("r2").alias("r2"))
    trees = distinct.groupBy("r1", "r2").agg(F.count("*").alias("ends"))
    distinct = cut_lineage(distinct.join(trees, ["r1", "r2"]))
    leaf = distinct.filter(F.col("ends") <= leaves).withColumn("part", F.lit(0).cast("long"))
    large = distinct.filter(F.col("ends") > leaves)
    if not large.isEmpty():
        parts = _sequences(large, path, leaves).withColumnRenamed("rep", "of")
        leaf = leaf.unionByName(large.join(parts, F.col("rep").eqNullSafe(F.col("of"))).drop("of"))
    leaf = cut_lineage(leaf.select("rep", "pos", "k1", "k2", F.xxhash64("r1", "r2", "part").alias("sequence_id")))
    rows = path.join(leaf.select("sequence_id", "rep"), conv.eqNullSafe(F.col("rep")))
    rows = rows.select("sequence_id", "rep", "pos", "k1", "k2", F.length(segment).cast("long").alias("n"))
    schema = T.StructType([
        T.StructField("sequence_id", T.LongType()), T.StructField("pos", T.IntegerType()), T.StructField("k1", T.LongType()),
        T.StructField("k2", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("position", T.LongType()),
        T.StructField("ancestors", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("is_end", T.BooleanType()),
    ])
    arrow = pa.schema([
        ("sequence_id", pa.int64()), ("pos", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
        ("position", pa.int64()), ("ancestors", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("is_end", pa.bool_()),
    ])

    def lay_out(batches):
        for sequence_id, group in _groups(batches):
            place = _layout(group)
            columns = list(zip(*place, strict=True))
            columns[6] = [[{"start": a, "end": b} for a, b in x] for x in columns[6]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([sequence_id] * len(place), pa.int64()), *(pa.array(c, f.type) for c, f in zip(columns, list(arrow)[1:], strict=True))], schema=arrow
            )

    laid = cut_lineage(rows.repartition("sequence_id").sortWithinPartitions("sequence_id", "rep", "pos").mapInArrow(lay_out, schema))
    texts = path.groupBy("pos", "k1", "k2").agg(F.first("role").alias("role"), F.first("text").alias("text"))
    texts = texts.withColumn("segment", segment).withColumn("_head", F.length(head)).withColumn("_loss", F.col("role") == TRAINED)
    nodes = laid.join(texts, ["pos", "k1", "k2"])
    loss_end = F.col("start") + F.col("length") - len(END)
    nodes = nodes.select(
        "sequence_id", "start", "length", "position", "ancestors", F.col("pos").alias("depth"), "segment",
        F.when(F.col("_loss"), F.col("start") + F.col("_head")).otherwise(loss_end).alias("loss_start"), loss_end.alias("loss_end"), "is_end",
    )
    at = leaf.join(laid.filter("is_end").select("sequence_id", "pos", "k1", "k2", "start"), ["sequence_id", "pos", "k1", "k2"])
    ends = each.join(at.select("pos", "k1", "k2", "sequence_id", "start"), ["pos", "k1", "k2"])
    return nodes, ends.select(conv.alias(conv_col), "n_turns", "sequence_id", "start")


def read_back(nodes: DataFrame) -> DataFrame:
    """What the end nodes' tokens say, read from the sequences alone: ``sequence_id, start,
    turns_sha256, loss_chars, loss_sha256, formatted_chars`` of each conversation there."""
    rows = nodes.select("sequence_id", "start", "length", "ancestors", "segment", "loss_start", "loss_end", "is_end")
    names = ["sequence_id", "start", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def read(batches):
        for sequence_id, group in _groups(batches):
            group = list(group)
            sequence = "".join(r[4] for r in group)
            masks = {r[1]: (r[5], r[6]) for r in group}  # by the start of each turn
            out = []
            for _, start, length, ancestors, _, _, _, is_end in group:
                if not is_end:
                    continue
                spans = [*((x["start"], x["end"]) for x in ancestors), (start, start + length)]
                turns, loss, chars = hashlib.sha256(), hashlib.sha256(), 0
                for a, b in spans:
                    while a < b:  # turn by turn: control strings can't occur inside one
                        z = sequence.index(END, a) + len(END)
                        role, text = _TURN.fullmatch(sequence[a : z - len(END)]).groups()
                        turns.update(f"{unescaped(role)}\n{unescaped(text)}\n".encode("utf-8", "surrogatepass"))
                        under = unescaped(sequence[slice(*masks[a])])
                        loss.update(under.encode("utf-8", "surrogatepass"))
                        chars += len(under)
                        a = z
                out.append((sequence_id, start, turns.hexdigest(), chars, loss.hexdigest(), sum(b - a for a, b in spans)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=names)

    read_rows = rows.repartition("sequence_id").sortWithinPartitions("sequence_id", "start")
    return read_rows.mapInArrow(read, "sequence_id long, start long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
