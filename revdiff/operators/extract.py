"""From cells to questions, driven by layout tables.

``ord`` is the question order of a side: unique, ascending, not necessarily dense. Pairs
whose layout has a fault yield no questions; ``layout_errors`` lists them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revdiff.functions.text import extract_number, is_blank, strip_number_prefix, trim_ws
from revdiff.operators.layout import sound_specs
from revdiff.operators.ordering import asof_last
from revdiff.operators.scan import nonblank_rows
from revdiff.operators.spans import covering_join
from revdiff.sources.session import cut_lineage, shuffled

KEY = ["pair_id", "side"]
# A sheet has 2**20 rows at most, so (section, row) packs into one ordered number.
_ROWS = 1 << 21
DV = "struct<type:string,op:string,f1:string,f2:string>"
CF = "struct<type:string,op:string,v1:string,v2:string>"


def _sheet_cells(cells: DataFrame, layouts: DataFrame) -> DataFrame:
    """Cells of the laid-out sheets with the layout's columns alongside, blank rows removed."""
    for name, kind in (("dv", DV), ("cf", CF)):
        if name not in cells.columns:
            cells = cells.withColumn(name, F.lit(None).cast(kind))
    lay = layouts.drop("specs", "error").withColumn("sheet_key", F.col("sheet")).drop("sheet")
    on = [cells["pair_id"] == lay["pair_id"], cells["side"] == lay["side"], cells["sheet"] == lay["sheet_key"]]
    return nonblank_rows(cells).join(shuffled(lay), on).select(
        cells["pair_id"], cells["side"], "row_num", "col", "text", "dv", "cf",
        *[c for c in lay.columns if c not in (*KEY, "sheet_key")],
    )


def _in(col: str, value: str) -> Column:
    return F.max(F.when(F.col("col") == F.col(col), F.col(value)))


def _headers(rows: DataFrame, row: str, out: str) -> DataFrame:
    return rows.select(*KEY, F.col("row_num").alias(row), F.coalesce("text", F.lit("")).alias(out))


def _stored(df: DataFrame, buckets: int | None) -> DataFrame:
    return cut_lineage(df, buckets) if buckets else cut_lineage(df)


def extract_control(cells: DataFrame, layouts: DataFrame, sections: DataFrame, buckets: int | None = None) -> DataFrame:
    """Rows inside a section interval, not header rows, with text; first section in order wins.

    With ``buckets`` stages are stored by ``pair_id`` in so many buckets; where ``cells`` and ``layouts`` are dealt out
    so, too, texts are written once and never shuffled. The result has the stored rows and their places side by side, so
    that reading it again costs little.
    """
    good = _stored(sound_specs(layouts, sections).select(*KEY, "sec_ord", "section_row", "first_row", "last_row"), buckets)
    own = layouts.join(shuffled(good.select(*KEY).distinct()), KEY)
    rows = _sheet_cells(cells, own.drop("chapter_rows", "answer_cols")).groupBy(*KEY, "row_num").agg(
        _in("text_col", "text").alias("text"), _in("input_col", "dv").alias("dv"), _in("input_col", "cf").alias("cf")
    )
    rows = _stored(rows, buckets)  # read again for the header texts
    chapters = own.select(*KEY, F.explode("chapter_rows").alias("row_num")).distinct()
    headers = chapters.union(good.select(*KEY, "section_row")).distinct()
    if buckets:
        headers = cut_lineage(headers, buckets)
    points = rows.filter(~is_blank(F.col("text"))).join(shuffled(headers), [*KEY, "row_num"], "left_anti")
    # sections and headers are found by row number; question texts move once, in the last join
    marked = points.select(*KEY, "row_num", F.lit(False).alias("mark")).union(chapters.select("*", F.lit(True)))
    if buckets:
        marked = cut_lineage(marked, buckets)  # numbers only; the deal is lost in the union
    at = asof_last(marked, KEY, "row_num", F.col("mark"), F.col("row_num"), "chapter_row", null_keys=False).filter("NOT mark").drop("mark")
    found = covering_join(at, good, KEY, "row_num", "first_row", "last_row")
    first = F.min(F.col("sec_ord").cast("bigint") * _ROWS + F.col("section_row"))
    placed = found.groupBy(*KEY, "row_num", "chapter_row").agg((first % _ROWS).cast("int").alias("section_row"))
    heads = rows.select(*KEY, "row_num", "text").join(shuffled(headers), [*KEY, "row_num"])
    named = placed.join(shuffled(_headers(heads, "chapter_row", "chapter")), [*KEY, "chapter_row"], "left").join(
        shuffled(_headers(heads, "section_row", "section")), [*KEY, "section_row"], "left"
    )
    if buckets:
        named = cut_lineage(named, buckets)  # rows come out as often as they are asked for
    return (
        points.join(shuffled(named), [*KEY, "row_num"])
        .select(
            *KEY,
            F.col("row_num").cast("bigint").alias("ord"),
            F.coalesce("chapter", F.lit("")).alias("chapter"),
            F.coalesce("section", F.lit("")).alias("section"),
            extract_number(F.col("text")).alias("number"),
            strip_number_prefix(F.col("text")).alias("text"),
            F.col("text").alias("original_text"),
            "row_num", "dv", "cf",
        )
    )


def extract_risk(cells: DataFrame, layouts: DataFrame, sections: DataFrame) -> DataFrame:
    """Every row of every section with text, once per section that covers it."""
    good = cut_lineage(sound_specs(layouts, sections).select(*KEY, "sec_ord", "section_row", "first_row", "last_row"))
    rows = (
        _sheet_cells(cells, layouts)
        .groupBy(*KEY, "row_num")
        .agg(
            _in("text_col", "text").alias("text"),
            _in("number_col", "text").alias("number"),
            F.coalesce(_in("explanation_col", "text"), F.lit("")).alias("explanation"),
            _in("input_col", "dv").alias("dv"),
            _in("input_col", "cf").alias("cf"),
        )
    )
    rows = cut_lineage(rows)  # read again for the header texts
    points = rows.filter(~is_blank(F.col("text")))
    # sections and headers are found by row number; question texts move once, in the last join
    placed = covering_join(points.select(*KEY, "row_num"), good, KEY, "row_num", "first_row", "last_row")
    named = placed.join(shuffled(_headers(rows, "section_row", "section")), [*KEY, "section_row"], "left")
    return points.join(shuffled(named), [*KEY, "row_num"]).select(
        *KEY,
        (F.col("sec_ord").cast("bigint") * _ROWS + F.col("row_num")).alias("ord"),
        F.coalesce("section", F.lit("")).alias("section"),
        F.nullif(trim_ws(F.col("number")), F.lit("")).alias("number"),
        "text", "explanation", "row_num", "dv", "cf",
    )


def span_rows(spans: DataFrame) -> DataFrame:
    """One row per sheet row of a question: ``row_offset`` 0 .. span-1."""
    return (
        spans.filter("error IS NULL AND span >= 1")
        .select(*KEY, "sec_ord", "section_row", "q_ord", "first_row", F.explode(F.sequence(F.lit(0), F.col("span") - 1)).alias("row_offset"))
        .withColumn("row_num", F.col("first_row") + F.col("row_offset"))
    )


def extract_general(cells: DataFrame, layouts: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Multi-row questions and their non-blank answer and explanation cells.

    Returns ``questions`` (with ``row_labels``, one per spanned row) and ``question_cells``.
    """
    sheet = cut_lineage(_sheet_cells(cells, layouts))  # read by row and by cell
    by_row = (
        sheet.groupBy(*KEY, "row_num")
        .agg(_in("text_col", "text").alias("text"), _in("number_col", "text").alias("label"))
        .withColumns({c: trim_ws(F.coalesce(c, F.lit(""))) for c in ("text", "label")})
    )
    question = [*KEY, "sec_ord", "q_ord", "section_row", "first_row"]
    spanned = cut_lineage(span_rows(sound_specs(layouts, spans, cross=True)))
    at_zero = F.max(F.when(F.col("row_offset") == 0, F.col("text")))
    labels = F.array_sort(F.collect_list(F.struct("row_offset", F.coalesce("label", F.lit("")).alias("label"))))
    ordv = (F.col("sec_ord").cast("bigint") * _ROWS + F.col("first_row")).alias("ord")
    grouped = (
        spanned.join(shuffled(by_row), [*KEY, "row_num"], "left")
        .groupBy(*question)
        .agg(at_zero.alias("text"), F.transform(labels, lambda x: x["label"]).alias("row_labels"))
        .filter(~is_blank(F.col("text")))
    )
    questions = grouped.join(shuffled(_headers(by_row, "section_row", "section")), [*KEY, "section_row"], "left").select(
        *KEY, ordv,
        F.coalesce("section", F.lit("")).alias("section"),
        F.nullif(F.col("row_labels")[0], F.lit("")).alias("number"),
        "text", F.col("first_row").alias("row_num"), "row_labels",
    )
    is_answer = F.array_contains("answer_cols", F.col("col"))
    values = sheet.filter(~is_blank(F.col("text")) & (is_answer | (F.col("col") == F.col("explanation_col"))))
    kinds = F.array_compact(F.array(
        F.when(is_answer, F.lit("answer")), F.when(F.col("col") == F.col("explanation_col"), F.lit("explanation"))
    ))
    values = values.select(
        *KEY, "row_num", "col", trim_ws(F.col("text")).alias("text"), "dv", "cf",
        F.array_position("answer_cols", F.col("col")).cast("int").alias("col_ord"), F.explode(kinds).alias("kind"),
    )
    cells_out = (
        spanned.join(shuffled(grouped.select(*KEY, "sec_ord", "q_ord")), [*KEY, "sec_ord", "q_ord"], "left_semi")
        .join(shuffled(values), [*KEY, "row_num"])
        .select(*KEY, ordv, "kind", "row_offset", "col", "col_ord", "text", "dv", "cf")
    )
    return questions, cells_out
