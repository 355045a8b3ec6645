"""Field and cell differences of aligned records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revdiff.functions.address import col_letters
from revdiff.functions.rules import cf_changed, dv_changed
from revdiff.functions.text import normalize_text, trim_ws
from revdiff.operators.scan import CELL, attach_rules, grid_tasks, range_errors, range_rectangles, rectangle_grid
from revdiff.sources.session import cut_lineage, shuffled, spread

FLAGS = [
    "text_changed", "number_changed", "dv_changed", "cf_changed",
    "explanation_changed", "answer_cells_changed", "explanation_cells_changed",
]


def _record(df: DataFrame, side: str) -> Column:
    return F.struct(*[F.col(f"{side}.{c}") for c in df.columns if c not in ("pair_id", "side", "ord")])


def diff_records(
    prev: DataFrame,
    curr: DataFrame,
    alignment: DataFrame,
    flags: Sequence[str],
    cell_flags: DataFrame | None = None,
) -> DataFrame:
    """Classify every record as added, removed, changed or unchanged.

    ``flags`` names the comparisons that make a matched record *changed*, out of
    ``text, number, dv, cf, explanation, answer_cells, explanation_cells``; the last two are
    read from ``cell_flags(pair_id, n_ord, o_ord, answer_cells_changed, explanation_cells_changed)``.
    Flags outside ``flags`` are null. ``prev`` and ``curr`` carry both records as structs.
    """
    a = alignment
    if cell_flags is not None:
        a = a.join(shuffled(cell_flags), ["pair_id", "n_ord", "o_ord"], "left")
    joined = (
        a.alias("a")
        .join(shuffled(curr.alias("n")), (F.col("a.pair_id") == F.col("n.pair_id")) & (F.col("a.n_ord") == F.col("n.ord")), "left")
        .join(shuffled(prev.alias("o")), (F.col("a.pair_id") == F.col("o.pair_id")) & (F.col("a.o_ord") == F.col("o.ord")), "left")
    )
    matched = F.col("a.n_ord").isNotNull() & F.col("a.o_ord").isNotNull()

    def both(name: str) -> tuple[Column, Column]:
        return F.col(f"o.{name}"), F.col(f"n.{name}")

    tests = {
        "text": lambda: F.col("a.similarity") < 1.0,
        "number": lambda: ~F.col("o.number").eqNullSafe(F.col("n.number")),
        "dv": lambda: dv_changed(*both("dv")),
        "cf": lambda: cf_changed(*both("cf")),
        # similarity below 1 is the same as different normalised texts
        "explanation": lambda: normalize_text(F.col("o.explanation")) != normalize_text(F.col("n.explanation")),
        "answer_cells": lambda: F.coalesce("a.answer_cells_changed", F.lit(False)),
        "explanation_cells": lambda: F.coalesce("a.explanation_cells_changed", F.lit(False)),
    }
    raised = {
        f"{name}_changed": (
            F.when(matched, test()) if name in flags else F.lit(None).cast("boolean")
        )
        for name, test in tests.items()
    }
    any_raised = F.lit(False)
    for name in flags:
        any_raised = any_raised | F.col(f"{name}_changed")
    out = joined.select(
        F.col("a.pair_id").alias("pair_id"),
        F.col("a.n_ord").alias("n_ord"),
        F.col("a.o_ord").alias("o_ord"),
        F.col("a.similarity").alias("similarity"),
        F.col("a.second_best").alias("second_best"),
        *[flag.alias(name) for name, flag in raised.items()],
        F.when(F.col("a.o_ord").isNotNull(), _record(prev, "o")).alias("prev"),
        F.when(F.col("a.n_ord").isNotNull(), _record(curr, "n")).alias("curr"),
    )
    status = (
        F.when(F.col("o_ord").isNull(), "added")
        .when(F.col("n_ord").isNull(), "removed")
        .when(any_raised, "changed")
        .otherwise("unchanged")
    )
    return out.select("pair_id", status.alias("status"), "n_ord", "o_ord", "similarity", "second_best", *FLAGS, "prev", "curr")


CONTROL_FLAGS = ("text", "number", "dv", "cf")
RISK_FLAGS = ("text", "explanation", "number", "dv", "cf")
GENERAL_FLAGS = ("text", "number", "answer_cells", "explanation_cells")


def added_rows(curr: DataFrame, alignment: DataFrame) -> DataFrame:
    matched = alignment.filter("n_ord IS NOT NULL AND o_ord IS NOT NULL").select("pair_id", F.col("n_ord").alias("ord"))
    return curr.join(shuffled(matched), ["pair_id", "ord"], "left_anti")


def removed_rows(prev: DataFrame, alignment: DataFrame) -> DataFrame:
    matched = alignment.filter("n_ord IS NOT NULL AND o_ord IS NOT NULL").select("pair_id", F.col("o_ord").alias("ord"))
    return prev.join(shuffled(matched), ["pair_id", "ord"], "left_anti")


def _paired(prev: DataFrame, curr: DataFrame, keys: Sequence[str], tasks: int | None = None) -> DataFrame:
    """Full outer pairing by key in one shuffle; ``_n`` is the most cells a side has for the key."""

    def side(df: DataFrame, is_new: bool) -> DataFrame:
        named = [F.upper(k).alias(k) if k == "address" else F.col(k) for k in keys]  # addresses ignore case
        return df.select(*named, F.lit(is_new).alias("_new"), F.struct("text", "dv", "cf").alias("_cell"))

    n = lambda flag: F.count(F.when(F.col("_new") == flag, 1))
    pick = lambda flag: F.max(F.when(F.col("_new") == flag, F.col("_cell")))
    both = side(prev, False).unionByName(side(curr, True))
    return spread(both, tasks, *keys).groupBy(*keys).agg(
        pick(False).alias("prev"), pick(True).alias("curr"), F.greatest(n(False), n(True)).alias("_n")
    )


def diff_cells(
    prev: DataFrame, curr: DataFrame, keys: Sequence[str], scope: str = "full", trim: bool = True, tasks: int | None = None
) -> DataFrame:
    """Cell-by-cell diff over the union of keys; a missing cell counts as an empty one.

    ``scope='value'`` compares text only, ``'full'`` also the rules. Text is compared with
    case, trimmed if ``trim``. A key that a side holds more than once gets status ``error``
    instead of stopping the job. ``tasks`` states the partitions of the pairing.
    """
    if scope not in ("value", "full"):
        raise ValueError(f"scope must be 'value' or 'full', not {scope!r}")
    clean = trim_ws if trim else (lambda c: c)
    text = [clean(F.coalesce(F.col(f"{s}.text"), F.lit(""))) for s in ("prev", "curr")]
    full = scope == "full"
    out = _paired(prev, curr, keys, tasks).withColumns(
        {
            "text_changed": text[0] != text[1],
            "dv_changed": dv_changed(F.col("prev.dv"), F.col("curr.dv")) if full else F.lit(False),
            "cf_changed": cf_changed(F.col("prev.cf"), F.col("curr.cf")) if full else F.lit(False),
        }
    )
    changed = F.col("text_changed") | F.col("dv_changed") | F.col("cf_changed")
    status = F.when(F.col("_n") > 1, "error").when(changed, "changed").otherwise("unchanged")
    return out.withColumn("status", status).drop("_n")


def cell_range_diff(args: DataFrame, cells: DataFrame, rules: DataFrame, scope: str = "full") -> DataFrame:
    """Diff of all addresses that ``args(pair_id, side, sheet, ranges)`` names, in address order.

    Blank addresses and those that only a rule covers are compared, too. ``cells`` and ``rules``
    hold both sides. A pair with a bad range on either side has no rows; ``range_errors`` says why.
    Every step has as many tasks as the addresses ask for. The ranges are taken apart once, by an eager job.
    """
    bad = range_errors(args).select("pair_id").distinct()
    rectangles = cut_lineage(range_rectangles(args.join(bad, "pair_id", "left_anti")))
    tasks = grid_tasks(rectangles)
    grid = attach_rules(rectangle_grid(rectangles, cells.select(*CELL, "text"), tasks), rules, tasks)
    address = F.concat(col_letters(F.col("col_idx")), F.col("row_num").cast("string"))
    sides = [grid.filter(F.col("side") == s).withColumn("address", address) for s in ("prev", "curr")]
    order = ["pair_id", "sheet", "row_num", "col_idx"]
    out = diff_cells(*sides, ["pair_id", "sheet", "address", "row_num", "col_idx"], scope, tasks=tasks)
    return out.repartitionByRange(tasks, *order).sortWithinPartitions(*order)


def question_cell_changes(prev_cells: DataFrame, curr_cells: DataFrame, alignment: DataFrame, kind: str) -> DataFrame:
    """Changed cells inside matched questions: key (row offset, column), or row offset for explanations.

    A cell on one side only always counts as a change. ``status`` is ``error`` for a key that a
    question holds twice.
    """
    matches = alignment.filter("n_ord IS NOT NULL AND o_ord IS NOT NULL").select("pair_id", "n_ord", "o_ord")
    o = prev_cells.filter(F.col("kind") == kind).withColumnRenamed("ord", "o_ord").join(shuffled(matches), ["pair_id", "o_ord"])
    n = curr_cells.filter(F.col("kind") == kind).withColumnRenamed("ord", "n_ord").join(shuffled(matches), ["pair_id", "n_ord"])
    keys = ["pair_id", "n_ord", "o_ord", "row_offset"] + (["col"] if kind == "answer" else [])
    diff = diff_cells(o, n, keys, "full", trim=False)
    return diff.filter((F.col("status") != "unchanged") | F.col("prev").isNull() | F.col("curr").isNull())


def cells_changed_flags(answer_changes: DataFrame, explanation_changes: DataFrame) -> DataFrame:
    """Per match: did any answer cell or any explanation cell change."""
    key = ["pair_id", "n_ord", "o_ord"]
    both = answer_changes.select(*key, F.lit(True).alias("a")).unionByName(
        explanation_changes.select(*key, F.lit(False).alias("a"))
    )
    return both.groupBy(*key).agg(
        F.bool_or("a").alias("answer_cells_changed"), F.bool_or(~F.col("a")).alias("explanation_cells_changed")
    )
