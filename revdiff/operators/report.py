"""Report tables of a question diff (``diff_records``) and of a cell diff."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revdiff.functions.address import col_index
from revdiff.functions.display import change_badges
from revdiff.functions.rules import cf_display, dv_display
from revdiff.operators.ordering import BIN, headings, ordinal, running_sum

_TIES = 1 << 20  # more than the records that can share a sheet row
STATUSES = ["added", "removed", "changed", "unchanged"]
# Badge texts.
BADGES = {
    "T": "text_changed", "#": "number_changed", "DV": "dv_changed", "CF": "cf_changed",
    "cells": "answer_cells_changed", "expl": "explanation_cells_changed",
}


def diff_summary(diff: DataFrame) -> DataFrame:
    """Counts by status per block, and ``compared``, the number of previous records."""
    count = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    return diff.groupBy("pair_id").agg(
        *[count(s) for s in STATUSES], F.count(F.when(F.col("status") != "added", 1)).alias("compared")
    )


def badges(diff: DataFrame) -> DataFrame:
    return diff.withColumn("badges", change_badges(**{b: F.col(c) for b, c in BADGES.items()}))


def bucket_order() -> Column:
    """Current order, and previous order for removed records."""
    return F.coalesce("n_ord", "o_ord")


def bucket_ordinal(diff: DataFrame) -> DataFrame:
    """1-based position of every record in its (block, status) table."""
    return ordinal(diff.withColumn("_o", bucket_order()), ["pair_id", "status"], "_o", "position").drop("_o")


def sheet_order(diff: DataFrame, side: str) -> DataFrame:
    """Rows of one side in sheet order: ``row_num``, then status rank, then ``ord``.

    A changed record shows the row, number and text of the asked side but always the
    section and chapter of the previous one. ``sheet_pos`` is a single sortable number. Records without ``chapter`` get
    an empty one; without ``number`` or ``text`` the view has no such column.
    """
    mine = {"current": "curr", "previous": "prev"}[side]
    gone = {"current": "removed", "previous": "added"}[side]
    placed = F.when(F.col("status") == "unchanged", F.col("curr")).when(F.col("status") == "changed", F.col("prev")).otherwise(F.col(mine))
    shown = F.when(F.col("status") == "unchanged", F.col("curr")).otherwise(F.col(mine))
    rank = F.when(F.col("status") == "changed", 1).when(F.col("status") == "unchanged", 2).otherwise(0)
    fields = diff.schema["curr"].dataType.names
    chapter = placed.getField("chapter") if "chapter" in fields else F.lit("")
    return diff.filter(F.col("status") != gone).select(
        "pair_id", "status",
        F.col(mine).getField("row_num").alias("row_num"),
        rank.alias("status_rank"),
        F.col("n_ord" if side == "current" else "o_ord").alias("ord"),
        chapter.alias("chapter"),
        placed.getField("section").alias("section"),
        *[shown.getField(c).alias(c) for c in ("number", "text") if c in fields],
    )


def sheet_breaks(sheet: DataFrame) -> DataFrame:
    """Adds ``position``, ``chapter_break`` and ``section_break`` to a ``sheet_order`` table.

    A chapter breaks when it is not empty and differs from the last non-empty one above;
    a section breaks when it differs from the row above, or when the chapter breaks.
    """
    # records that share a sheet row: one per section that covers it, so this window is small
    tie = Window.partitionBy("pair_id", "row_num").orderBy("status_rank", "ord")
    place = F.col("row_num").cast("bigint") * _TIES + F.row_number().over(tie)
    chapter = F.nullif("chapter", F.lit(""))
    rows = headings(sheet.withColumn("_o", place), ["pair_id"], "_o", F.col("section"), chapter, BIN * _TIES)
    chapter_break = chapter.isNotNull() & ~chapter.eqNullSafe(F.col("last_chapter"))
    section_break = chapter_break | F.col("above").isNull() | ~F.col("section").eqNullSafe(F.col("above.v"))
    return rows.withColumns({"chapter_break": chapter_break, "section_break": section_break}).drop("_o", "above", "last_chapter")


def search_rows(table: DataFrame, columns: list[str], query: str) -> DataFrame:
    """Rows whose visible columns, joined by blanks, contain the trimmed query, ignoring case."""
    needle = query.lower().strip()
    if not needle:
        return table
    hay = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))
    return table.filter(hay.contains(needle))


# ---------------------------------------------------------------- word diff


#: Bits of step tables, and best rows kept at a time, of one pair of texts.
STEP_BITS, KEPT_ROWS = 1 << 28, 64


def _next_steps(steps: int, kept: int) -> int:
    """Steps of the best row after one more old word, which stands at the bits ``kept`` of the new text.

    A best row is the longest common subsequence of the old words so far with every beginning of
    the new text; it rises by one at most at each new word, and bit j is set where it does not
    (Hyyro 2004). Bits beyond the new text are of no meaning.
    """
    both = steps & kept
    return (steps + both) | (steps - both)


def _word_ops(old: list[str], new: list[str]) -> tuple[list[str], list[str]]:
    """Operation per old word (eq/del) and per new word (eq/add) along a longest common subsequence.

    From the end, equal words are kept; otherwise the new word counts as added if that costs
    nothing, else the old word as dropped. The way back needs a bit per pair of words, but only
    for the old words it is passing: the best rows at the start of up to ``KEPT_ROWS`` stretches
    of old words are kept, and the stretches are gone through from the last to the first, each
    cut again until its bits fit. So memory grows with the new text, not with both.
    """
    marks = _marks(new, set(old))
    old_ops, new_ops = ["del"] * len(old), ["add"] * len(new)

    def back(first: int, last: int, steps: int, left: int) -> int:
        """Through old words ``last`` to ``first`` with ``left`` new words to go; ``steps`` is the row before them."""
        if not left:
            return 0
        inside = (1 << left) - 1
        steps &= inside
        rows = last - first
        if rows * left > STEP_BITS and rows > 1:
            size = -(-rows // min(KEPT_ROWS, rows))
            starts, kept = range(first, last, size), []
            for i in range(first, last):
                if (i - first) % size == 0:
                    kept.append(steps)
                steps = _next_steps(steps, marks(old[i]) & inside) & inside
            for start, row in zip(reversed(starts), reversed(kept), strict=True):
                left = back(start, min(start + size, last), row, left)
            return left
        halts = []  # bits of the new words at which an old word is kept or dropped
        for i in range(first, last):
            here = marks(old[i]) & inside
            steps = _next_steps(steps, here) & inside
            halts.append(here | (steps ^ inside))
        for i in range(last - 1, first - 1, -1):
            left = (halts[i - first] & (1 << left) - 1).bit_length()
            if left and old[i] == new[left - 1]:
                left -= 1
                old_ops[i] = new_ops[left] = "eq"
        return left

    back(0, len(old), (1 << len(new)) - 1, len(new))
    return old_ops, new_ops


def _marks(new: list[str], asked: set[str]) -> Callable[[str], int]:
    """The places of a word in ``new`` as bits, for words among ``asked``. The most frequent words' bits
    are kept, up to ``STEP_BITS`` in all; others are made anew each time."""
    places: dict[str, list[int]] = {word: [] for word in asked}
    for j, word in enumerate(new):
        if word in places:
            places[word].append(j)

    def bits(word: str) -> int:
        own = places[word]
        if len(own) < 2:
            return 1 << own[0] if own else 0
        out = bytearray(own[-1] // 8 + 1)
        for j in own:
            out[j >> 3] |= 1 << (j & 7)
        return int.from_bytes(out, "little")

    often = sorted(places, key=lambda word: -len(places[word]))[: STEP_BITS // max(1, len(new))]
    kept = {word: bits(word) for word in often}
    return lambda word: kept[word] if word in kept else bits(word)


def word_diff(pairs: DataFrame, keys: list[str], old: str, new: str) -> DataFrame:
    """One row per word of either text: ``keys, side, pos, op, word``; words split on whitespace."""
    words = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda t: F.length(t) > 0)
    source = pairs.select(*keys, words(F.col(old)).alias("old"), words(F.col(new)).alias("new"))
    schema = source.schema.simpleString()[len("struct<"):-1] + ",old_ops:array<string>,new_ops:array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [_word_ops(o.as_py(), n.as_py()) for o, n in zip(batch.column("old"), batch.column("new"))]
            kinds = [pa.array([d[k] for d in done], type=pa.list_(pa.string())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *kinds], names=[*batch.schema.names, "old_ops", "new_ops"]
            )

    solved = source.mapInArrow(run, schema)
    both = F.array(
        F.struct(F.lit("old").alias("side"), F.arrays_zip(F.col("old_ops").alias("op"), F.col("old").alias("word")).alias("w")),
        F.struct(F.lit("new").alias("side"), F.arrays_zip(F.col("new_ops").alias("op"), F.col("new").alias("word")).alias("w")),
    )
    sided = solved.select(*keys, F.explode(both).alias("s"))
    return sided.select(*keys, "s.side", F.posexplode("s.w").alias("pos", "w")).select(
        *keys, "side", "pos", "w.op", "w.word"
    )


# ---------------------------------------------------------------- nested cells


def _sorted_entries(order: list[str], entry: Column, when: Column, out: str) -> Column:
    """Aggregate: the entries where ``when`` holds, as an array in ``order``."""
    listed = F.array_sort(F.collect_list(F.when(when, F.struct(*order, entry.alias("entry")))))
    return F.transform(listed, lambda x: x["entry"]).alias(out)


def nest_cells(questions: DataFrame, cells: DataFrame) -> DataFrame:
    """Adds ``answer_cells`` and ``explanation_cells`` to questions, by row offset, then layout column order.

    A question holds at most its span times the layout's columns, so the arrays are small.
    """
    keys = ["pair_id", "side", "ord"]
    rules = [dv_display(F.col("dv")).alias("dvDisplay"), cf_display(F.col("cf")).alias("cfDisplay")]
    place = F.col("row_offset").alias("rowOffset")
    order = ["row_offset", "col_ord"]
    lists = cells.groupBy(*keys).agg(
        _sorted_entries(order, F.struct(place, F.col("col").alias("column"), "text", *rules), F.col("kind") == "answer", "answer_cells"),
        _sorted_entries(order, F.struct(place, "text", *rules), F.col("kind") == "explanation", "explanation_cells"),
    )
    return _with_lists(questions, lists, keys, ["answer_cells", "explanation_cells"])


def nest_changes(diff: DataFrame, answer_changes: DataFrame, explanation_changes: DataFrame) -> DataFrame:
    """Adds ``answer_cell_changes`` and ``explanation_cell_changes`` to a question diff, by offset, then column name."""
    keys = ["pair_id", "n_ord", "o_ord"]
    for changes, out, order in (
        (answer_changes, "answer_cell_changes", ["row_offset", "col"]),
        (explanation_changes, "explanation_cell_changes", ["row_offset"]),
    ):
        fields = [F.col("row_offset").alias("rowOffset")]
        if "col" in order:
            fields.append(F.col("col").alias("column"))
        fields += [F.col("prev.text").alias("oldText"), F.col("curr.text").alias("newText")]
        for rule, show in (("dv", dv_display), ("cf", cf_display)):
            fields += [show(F.col(f"{side}.{rule}")).alias(f"{name}{rule.capitalize()}Display") for side, name in (("prev", "old"), ("curr", "new"))]
        fields += [F.col(f"{f}_changed").alias(f"{f}Changed") for f in ("text", "dv", "cf")]
        lists = changes.groupBy(*keys).agg(_sorted_entries(order, F.struct(*fields), F.lit(True), out))
        diff = _with_lists(diff, lists, keys, [out])
    return diff


def _with_lists(df: DataFrame, lists: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    joined = df.join(lists, keys, "left")
    return joined.withColumns({n: F.coalesce(n, F.array().cast(lists.schema[n].dataType)) for n in names})


# ---------------------------------------------------------------- payload


#: Bytes of entries in a part of a report, about; one entry is never cut.
PART_BYTES = 1 << 20


def _camel(name: str) -> str:
    first, *rest = name.split("_")
    return first + "".join(w.capitalize() for w in rest)


def _shown(side: str, fields: list[str]) -> list[Column]:
    """What a report shows of a record by itself."""
    one = F.col(side)
    out = [one.getField("text").alias("questionText")]
    out += [F.col(f"_{rule}_{side}").alias(f"{rule}Display") for rule in ("dv", "cf") if rule in fields]
    for name, label in (("row_labels", "rowNumberLabels"), ("answer_cells", "answerCells"), ("explanation_cells", "explanationCells")):
        if name in fields:
            out.append(one.getField(name).alias(label))
    return out


def _entry(diff: DataFrame) -> Column:
    """One report entry as JSON, with the fields of its status; fields without a value are null."""
    fields = diff.schema["curr"].dataType.names
    prev, curr, status = F.col("prev"), F.col("curr"), F.col("status")

    def head(place: Column) -> list[Column]:
        return [place.getField(c).alias(c) for c in ("chapter", "section") if c in fields]

    def single(side: str) -> list[Column]:
        one = F.col(side)
        return [one.getField("number").alias("questionNumber"), *head(one), one.getField("row_num").alias("rowNumber"), *_shown(side, fields)]

    rows = [prev.getField("row_num").alias("previousRowNumber"), curr.getField("row_num").alias("currentRowNumber")]
    changed = [
        *head(prev), *rows, prev.getField("number").alias("previousNumber"), curr.getField("number").alias("currentNumber"),
        prev.getField("text").alias("oldText"), curr.getField("text").alias("newText"),
        F.col("similarity").alias("similarityScore"), F.col("second_best").alias("secondBestSimilarity"),
    ]
    for rule in ("dv", "cf"):
        if rule in fields:
            changed += [F.col(f"_{rule}_{side}").alias(f"{age}{rule.capitalize()}Display") for side, age in (("prev", "old"), ("curr", "new"))]
    nested = "answer_cells" in fields
    flags = ("text", "number", "answer_cells", "explanation_cells") if nested else ("text", "number", "dv", "cf")
    changed += [F.col(f"{flag}_changed").alias(_camel(f"{flag}_changed")) for flag in flags]
    if nested:
        changed += [F.col(c).alias(_camel(c)) for c in ("answer_cell_changes", "explanation_cell_changes") if c in diff.columns]
    else:
        told = [side.getField("explanation") if "explanation" in fields else F.lit(None).cast("string") for side in (prev, curr)]
        changed += [told[0].alias("oldExplanation"), told[1].alias("newExplanation"), F.coalesce("explanation_changed", F.lit(False)).alias("explanationChanged")]
    unchanged = [
        *head(curr), *rows, curr.getField("number").alias("questionNumber"), *_shown("curr", fields),
        F.lit(1.0).alias("similarityScore"), F.col("second_best").alias("secondBestSimilarity"),
    ]
    json = lambda cols: F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
    return (
        F.when(status == "changed", json(changed)).when(status == "unchanged", json(unchanged))
        .when(status == "removed", json(single("prev"))).otherwise(json(single("curr")))
    )


def report_entries(diff: DataFrame) -> DataFrame:
    """``pair_id, status, position, entry``: the report entries of a question diff, as JSON objects."""
    rules = [(rule, show) for rule, show in (("dv", dv_display), ("cf", cf_display)) if rule in diff.schema["curr"].dataType.names]
    shown = {f"_{rule}_{side}": show(F.col(f"{side}.{rule}")) for rule, show in rules for side in ("prev", "curr")}
    made = (diff.withColumns(shown) if shown else diff).withColumn("entry", _entry(diff)).select("pair_id", "status", "n_ord", "o_ord", "entry")
    return bucket_ordinal(made).select("pair_id", "status", "position", "entry")


def cell_entries(diff: DataFrame, scope: str = "full") -> DataFrame:
    """``pair_id, status, position, entry`` of a cell diff, as JSON objects, by row, then column."""
    report = cell_report(diff, scope).withColumn("_o", F.col("row_num").cast("bigint") * (1 << 14) + col_index(F.col("col")))
    both = [F.col("address"), F.col("col").alias("column"), F.col("row_num").alias("row")]
    changed = [*both, F.col("old_value").alias("file1Value"), F.col("new_value").alias("file2Value"), F.col("text_changed").alias("textChanged")]
    for rule in ("dv", "cf"):
        changed += [F.col(f"{age}_{rule}").alias(f"{file}{rule.capitalize()}Display") for age, file in (("old", "file1"), ("new", "file2"))]
        changed.append(F.col(f"{rule}_changed").alias(f"{rule}Changed"))
    unchanged = [*both, F.col("new_value").alias("value"), F.col("new_dv").alias("dvDisplay"), F.col("new_cf").alias("cfDisplay")]
    json = lambda cols: F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
    made = report.select("pair_id", "status", "_o", F.when(F.col("status") == "unchanged", json(unchanged)).otherwise(json(changed)).alias("entry"))
    return ordinal(made, ["pair_id", "status"], "_o", "position", BIN << 14).drop("_o")


def report_parts(entries: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """``pair_id, status, part, entries, payload``: entries in order, joined by commas, in parts of about
    ``part_bytes`` bytes. Parts are cut by the bytes before them, so a block of long texts has many."""
    size = F.octet_length("entry") + F.lit(1)
    cut = running_sum(entries, ["pair_id", "status"], "position", size, "before").withColumn("part", F.floor(F.col("before") / part_bytes))
    grouped = cut.groupBy("pair_id", "status", "part").agg(F.array_sort(F.collect_list(F.struct("position", "entry"))).alias("e"))
    return grouped.select("pair_id", "status", "part", F.size("e").alias("entries"), F.array_join(F.transform("e", lambda x: x["entry"]), ",").alias("payload"))


def report_payload(diff: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """Report entries as JSON arrays, one row per block, status and part (see ``report_parts``)."""
    parts = report_parts(report_entries(diff), part_bytes)
    return parts.withColumn("payload", F.concat(F.lit("["), "payload", F.lit("]")))


def document_lines(blocks: DataFrame, entries: DataFrame, buckets: list[str], part_bytes: int = PART_BYTES) -> DataFrame:
    """``pair_id, seq, line``: the lines of one JSON document per row of ``blocks``, for ``write_documents``.

    The other columns of ``blocks`` come first in the document, under their names; then each bucket
    with its entries, an empty one as an empty array. Lines follow ``seq``: bucket, part, end.
    """
    named = F.to_json(F.struct(*[c for c in blocks.columns if c != "pair_id"]), {"ignoreNullFields": "false"})
    head = named.substr(F.lit(1), F.length(named) - 1)  # without the closing brace
    seq = lambda k, part, place: F.struct(F.lit(k).alias("bucket"), part.cast("bigint").alias("part"), F.lit(place).alias("place")).alias("seq")
    zero = F.lit(0)
    lines = [blocks.select("pair_id", seq(-1, zero, 0), head.alias("line"))]
    for k, bucket in enumerate(buckets):
        lines.append(blocks.select("pair_id", seq(k, F.lit(-1), 0), F.lit(f',"{bucket}":[').alias("line")))
        lines.append(blocks.select("pair_id", seq(k, F.lit(1 << 62), 0), F.lit("]").alias("line")))
    lines.append(blocks.select("pair_id", seq(len(buckets), zero, 0), F.lit("}").alias("line")))
    index = F.array_position(F.array(*map(F.lit, buckets)), F.col("status")).cast("int") - 1
    body = report_parts(entries, part_bytes).select(
        "pair_id", F.struct(index.alias("bucket"), F.col("part"), F.lit(0).alias("place")).alias("seq"),
        F.concat(F.when(F.col("part") > F.min("part").over(Window.partitionBy("pair_id", "status")), ",").otherwise(""), "payload").alias("line"),
    )
    return reduce(DataFrame.unionByName, [*lines, body])


def cell_report(diff: DataFrame, scope: str = "full") -> DataFrame:
    """Cell diff as report entries; the rule displays are blanked out under ``scope='value'``."""
    show = (lambda f, c: f(F.col(c))) if scope == "full" else (lambda f, c: F.lit("—"))
    return diff.select(
        "pair_id", "status", "address", "col", "row_num",
        F.col("prev.text").alias("old_value"), F.col("curr.text").alias("new_value"), "text_changed",
        show(dv_display, "prev.dv").alias("old_dv"), show(dv_display, "curr.dv").alias("new_dv"), "dv_changed",
        show(cf_display, "prev.cf").alias("old_cf"), show(cf_display, "curr.cf").alias("new_cf"), "cf_changed",
    )
