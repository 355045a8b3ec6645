"""Registered queries: every operator over whole test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revdiff import functions as fn
from revdiff.operators import diff, extract, layout, ordering, report, scan, spans
from revdiff.operators.align import align, align_dealt
from revdiff.plans import corpus
from revdiff.plans.corpus import split_sides, table
from revdiff.sources.session import cut_lineage, distance_tasks, scratch_dir, shuffled
from revdiff.sources.sinks import read_documents, write_documents, write_documents_together
from revdiff.sources.sinks import write_tables as write_sheets
from revdiff.sources.workbook import parse_workbooks, workbook_files

RULE = ("dv_type", "dv_op", "dv_f1", "dv_f2", "cf_type", "cf_op", "cf_v1", "cf_v2")


def _flat_rules(prefix: str = "") -> list:
    return [F.col(f"{prefix}{c[:2]}.{c[3:]}").alias(c) for c in RULE]


# ---------------------------------------------------------------- scalars


def normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", fn.normalize_text(F.col("text")).alias("norm"))


def text_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """Each turn against its own revision."""
    key, tasks = ["pair_id", "turn"], distance_tasks(table(spark, sf, "conversations"))
    p, c = (corpus.turns(spark, sf, side).repartition(tasks, *key) for side in ("prev", "curr"))
    both = p.join(shuffled(c.select(*key, F.col("text").alias("new_text"))), key)
    score = fn.text_similarity(F.col("text"), F.col("new_text"))
    return both.select("pair_id", "turn", score.alias("similarity"))


def number_prefix(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    sep = F.when(F.col("p_type") == "PROMO", F.lit("  ")).when(F.col("p_type") == "SMALL", F.lit(" x ")).otherwise(F.lit(") "))
    body = F.concat(F.col("p_size").cast("string"), F.lit("."), F.col("p_partkey").cast("string"), sep, F.col("p_name"))
    raw = F.when(F.col("p_type") == "LARGE", F.col("p_name")).otherwise(F.concat(F.lit("  "), body))
    return part.select("p_partkey", fn.extract_number(raw).alias("number"), fn.strip_number_prefix(raw).alias("stripped"))


def _rule_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """An old and a new rule per part."""
    part = table(spark, sf, "part")
    size = F.col("p_size")
    text = size.cast("string")
    kind = (
        F.when(size < 10, "List").when(size < 20, "WholeNumber").when(size < 30, "Date").when(size < 35, "Time")
        .when(size < 40, "Custom").when(size < 45, "AnyValue").when(size < 48, "TextLength")
    )
    op = F.when(size % 2 == 0, "Between").otherwise("GreaterThan")
    a = F.split("p_name", " ")[0]
    b = F.split("p_name", " ")[1]
    inline = lambda x, y: F.concat(F.lit('"'), x, F.lit(" ,"), y, F.lit('"'))
    ref = F.concat(F.lit("=$A$1:$A$"), text)
    old_f1 = (
        F.when((kind == "List") & (size < 5), inline(a, b)).when(kind == "List", ref)
        .when(kind == "Time", F.concat(F.lit("0."), text)).when(kind == "Date", F.concat(F.lit("45"), F.lpad(text, 3, "1"), F.lit(".25")))
        .otherwise(text)
    )
    new_f1 = (
        F.when((kind == "List") & (size < 3), inline(b, a)).when((kind == "List") & (size < 5), inline(b, b))
        .when(kind == "List", F.lower(ref)).otherwise(old_f1)
    )
    f2 = F.when(op == "Between", F.lit("99"))
    new_kind = F.when((kind == "Custom") & (F.col("p_type") == "PROMO"), F.lit(None)).otherwise(kind)
    new_f2 = F.when(F.col("p_type") == "SMALL", F.lit("98")).otherwise(f2)
    cf_kind = F.when(size < 20, "CellIs").when(size < 35, "Expression").when(size < 45, "ColorScale")
    cf_op = F.when(size % 3 == 0, "NotBetween").otherwise("EqualOrLessThan")
    return part.select(
        "p_partkey",
        F.struct(kind.alias("type"), op.alias("op"), old_f1.alias("f1"), f2.alias("f2")).alias("old_dv"),
        F.struct(new_kind.alias("type"), op.alias("op"), new_f1.alias("f1"), new_f2.alias("f2")).alias("new_dv"),
        F.struct(cf_kind.alias("type"), cf_op.alias("op"), text.alias("v1"), f2.alias("v2")).alias("old_cf"),
        F.struct(cf_kind.alias("type"), cf_op.alias("op"), text.alias("v1"), new_f2.alias("v2")).alias("new_cf"),
    )


def dv_changed(spark: SparkSession, sf: str) -> DataFrame:
    return _rule_pairs(spark, sf).select("p_partkey", fn.dv_changed(F.col("old_dv"), F.col("new_dv")).alias("changed"))


def cf_changed(spark: SparkSession, sf: str) -> DataFrame:
    return _rule_pairs(spark, sf).select("p_partkey", fn.cf_changed(F.col("old_cf"), F.col("new_cf")).alias("changed"))


def dv_display(spark: SparkSession, sf: str) -> DataFrame:
    return _rule_pairs(spark, sf).select("p_partkey", fn.dv_display(F.col("old_dv")).alias("shown"))


def cf_display(spark: SparkSession, sf: str) -> DataFrame:
    return _rule_pairs(spark, sf).select("p_partkey", fn.cf_display(F.col("old_cf")).alias("shown"))


def serial_date(spark: SparkSession, sf: str) -> DataFrame:
    """Order dates as day serials, whole for dates and with a fraction for times."""
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1899-12-30").cast("date"))
    urgent = F.col("o_orderpriority") == "1-URGENT"
    raw = F.when(urgent, F.concat(days.cast("string"), F.lit(".75"))).when(
        F.col("o_orderpriority") == "5-LOW", F.lit("soon")
    ).otherwise(days.cast("string"))
    kind = F.when(F.col("o_orderstatus") == "F", "Time").when(F.col("o_orderstatus") == "O", "Date").otherwise("Decimal")
    return table(spark, sf, "orders").select("o_orderkey", fn.serial_date(raw, kind).alias("shown"))


def range_tokens(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    key = F.col("c_custkey").cast("string")
    raw = F.concat(F.lit(" B2:F"), key, F.lit(" ;; h"), key, F.lit(";"), F.col("c_mktsegment"), F.lit(";A1:"))
    tokens = fn.range_tokens(raw)
    return c.select(
        "c_custkey", F.array_join(tokens["good"], "|").alias("good"), F.array_join(tokens["bad"], "|").alias("bad")
    )


def _part_addresses(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses of both sides, the current ones in lower case."""
    size, key = F.col("p_size"), F.col("p_partkey").cast("string")
    letters = F.when(size <= 26, F.char(64 + size)).otherwise(F.concat(F.lit("A"), F.char(64 + size - 25)))
    part = table(spark, sf, "part")
    prev = part.select("p_brand", F.concat(letters, key).alias("address"))
    return prev.unionByName(part.filter("p_size > 10").select("p_brand", F.lower(F.concat(letters, key)).alias("address")))


def distinct_addresses(spark: SparkSession, sf: str) -> DataFrame:
    return _part_addresses(spark, sf).select("p_brand", F.upper("address").alias("address")).distinct()


def address_order(spark: SparkSession, sf: str) -> DataFrame:
    """Row and column number of every address, in sheet order."""
    a = F.col("address")
    return (
        distinct_addresses(spark, sf)
        .select("p_brand", "address", fn.address_row(a).alias("row_num"), fn.address_col(a).alias("col"),
                fn.col_index(fn.address_col(a)).alias("col_idx"))
        .orderBy("p_brand", "row_num", "col_idx")
    )


def base_name(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", fn.base_name(F.col("url")).alias("name"))


def escape_html(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", fn.escape_html(F.col("html")).alias("escaped"))


# ---------------------------------------------------------------- scans and layouts


def _event_cells(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    two = F.array(
        F.struct(F.lit("A").alias("col"), F.lit(1).alias("col_idx"), F.when(F.col("value") < 20, F.lit(" ")).otherwise(F.col("event_type")).alias("text")),
        F.struct(F.lit("B").alias("col"), F.lit(2).alias("col_idx"), F.when(F.col("value") < 40, F.lit("")).otherwise(F.col("props")).alias("text")),
    )
    return e.select(
        F.col("user_id").cast("string").alias("pair_id"), F.lit("prev").alias("side"), F.lit("S").alias("sheet"),
        F.col("event_id").cast("int").alias("row_num"), F.explode(two).alias("w"),
    ).select("pair_id", "side", "sheet", "row_num", "w.col", "w.col_idx", "w.text")


def nonblank_rows(spark: SparkSession, sf: str) -> DataFrame:
    return scan.nonblank_rows(_event_cells(spark, sf)).select("pair_id", "row_num", "col", "text")


def _range_args(spark: SparkSession, sf: str) -> DataFrame:
    """Ranges per customer; some nations name rows or columns that no sheet has."""
    n = F.col("c_nationkey")
    more = F.when(n % 5 == 0, ";bad range; A0:A2").when(n % 5 == 1, ";ZZZ3; B99999999999").otherwise("")
    ranges = F.concat(F.lit("A1:C"), (n + 2).cast("string"), F.lit("; D3:b2 ;Z9"), more)
    return table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("pair_id"), F.lit("prev").alias("side"), F.lit("S").alias("sheet"), ranges.alias("ranges")
    )


def range_errors(spark: SparkSession, sf: str) -> DataFrame:
    return scan.range_errors(_range_args(spark, sf)).select("pair_id", "error")


def range_grid(spark: SparkSession, sf: str) -> DataFrame:
    """A grid per customer; only two of its cells are filled."""
    c = table(spark, sf, "customer")
    who = [F.col("c_custkey").cast("string").alias("pair_id"), F.lit("prev").alias("side"), F.lit("S").alias("sheet")]
    args = _range_args(spark, sf)
    two = F.array(
        F.struct(F.lit(1).alias("row_num"), F.lit(1).alias("col_idx"), F.col("c_name").alias("text")),
        F.struct(F.lit(9).alias("row_num"), F.lit(26).alias("col_idx"), F.col("c_mktsegment").alias("text")),
    )
    cells = c.select(*who, F.explode(two).alias("w")).select("pair_id", "side", "sheet", "w.row_num", "w.col_idx", "w.text")
    return scan.range_grid(args, cells).select("pair_id", "row_num", "col_idx", "text")


def attach_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as cells of a sheet per brand, suppliers as rules over ranges of them."""
    two = F.array(
        F.struct(F.lit("C").alias("col"), F.lit(3).alias("col_idx"), F.col("p_name").alias("text")),
        F.struct(F.lit("D").alias("col"), F.lit(4).alias("col_idx"), F.col("p_type").alias("text")),
    )
    cells = table(spark, sf, "part").select(
        F.col("p_brand").alias("pair_id"), F.lit("prev").alias("side"), F.lit("S").alias("sheet"),
        F.col("p_partkey").cast("int").alias("row_num"), F.explode(two).alias("w"),
    ).select("pair_id", "side", "sheet", "row_num", "w.col", "w.col_idx", "w.text")
    key = F.col("s_suppkey").cast("int")
    dv = F.col("s_acctbal") < 5000
    rules = table(spark, sf, "supplier").select(
        F.concat(F.lit("Brand#"), (F.col("s_nationkey") + 1).cast("string")).alias("pair_id"),
        F.lit("prev").alias("side"), F.lit("S").alias("sheet"),
        F.when(dv, "dv").otherwise("cf").alias("kind"), (F.lit(0) - key).alias("rule_ord"), F.lit(0).alias("range_ord"),
        (key * 5).alias("r1"), F.lit(3).alias("c1"), (key * 5 + 700).alias("r2"), (3 + key % 2).alias("c2"),
        F.when(~dv, "CellIs").when(key % 4 == 0, "List").otherwise("Decimal").alias("type"),
        F.lit("Between").alias("op"), F.col("s_name").alias("v1"),
        F.when(key % 3 == 0, F.lit("")).otherwise(key.cast("string")).alias("v2"),
    )
    return scan.attach_rules(cells, rules).select("pair_id", "row_num", "col", "text", *_flat_rules())


def layout_scan(spark: SparkSession, sf: str) -> DataFrame:
    return layout.parse_layouts(corpus.control_configs(spark, sf), "control").select(
        "pair_id", "side", "sheet", "text_col", "input_col",
        F.array_join(F.col("chapter_rows").cast("array<string>"), "|").alias("chapter_rows"),
        F.array_join("specs", "|").alias("specs"),
    )


def layout_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Layouts of customers, some with fields of the wrong kind and some with faulty entries."""
    c, n = table(spark, sf, "customer"), F.col("c_nationkey")
    config = (
        F.when(n % 6 == 0, '{"sectionRows": "1:2-3"}').when(n % 6 == 1, '{"SectionRows": ["1:2-3"], "chapterRows": ["x"]}').when(n % 6 == 2, "[1]")
        .when(n % 6 == 3, F.concat(F.lit('{"sectionRows": ["'), n.cast("string"), F.lit(':2-9"]}'))).when(n % 6 == 4, '{"sectionRows": null}')
        .otherwise('{"sectionRows": ["1:2-3", "4:5"]}')
    )
    raw = c.select(F.col("c_custkey").cast("string").alias("pair_id"), F.lit("curr").alias("side"), config.alias("config"))
    layouts = layout.parse_layouts(raw, "control")
    return layout.layout_errors(layouts, layout.section_specs(layouts))


def _specs(df: DataFrame, key: str, spec) -> DataFrame:
    """Layout rows with one list of spec entries each."""
    return df.select(F.col(key).cast("string").alias("pair_id"), F.lit("prev").alias("side"), spec.alias("specs"))


def section_specs(spark: SparkSession, sf: str) -> DataFrame:
    """Two entries per order, well formed or not depending on status and priority."""
    o = table(spark, sf, "orders")
    k = F.col("o_custkey")
    s = lambda c: c.cast("string")
    good = F.concat(s(k + 1), F.lit(":"), s(k + 2), F.lit("-"), s(k + 9))
    second = (
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit(" +"), s(k + 1), F.lit(" : "), s(k + 2), F.lit("- "), s(k + 2)))
        .when(F.col("o_orderpriority") == "1-URGENT", F.concat(s(k), F.lit(":"), s(k + 1)))
        .when(F.col("o_orderpriority") == "2-HIGH", F.concat(s(k + 5), F.lit(":"), s(k + 5), F.lit("-"), s(k + 9)))
        .when(F.col("o_orderpriority") == "3-MEDIUM", F.concat(s(k + 5), F.lit(":"), s(k + 9), F.lit("-"), s(k + 8)))
        .when(F.col("o_orderstatus") == "O", F.concat(F.lit("x"), s(k), F.lit(":1-2")))
        .otherwise(F.concat(s(k + 1), F.lit(":"), s(k + 2), F.lit("-y")))
    )
    return layout.section_specs(_specs(o, "o_orderkey", F.array(good, second))).select(
        "pair_id", "sec_ord", "section_row", "first_row", "last_row", "error"
    )


def _span_layouts(spark: SparkSession, sf: str) -> DataFrame:
    """One entry per customer: three questions, overlapping or malformed for some segments."""
    c = table(spark, sf, "customer")
    n = F.col("c_nationkey")
    s = lambda x: x.cast("string")
    seg = F.col("c_mktsegment")
    second = F.when(seg == "MACHINERY", F.concat(s(n + 4), F.lit("(0)"))).when(
        seg == "HOUSEHOLD", F.concat(s(n + 4), F.lit(" ( 2 )"))
    ).otherwise(s(n + 4))
    third = F.when(seg == "BUILDING", s(n + 4)).otherwise(F.concat(s(n + 6), F.lit("(3)")))
    entry = F.concat(s(n + 1), F.lit(": "), s(n + 2), F.lit("(2), "), second, F.lit(" ,, "), third)
    last = F.when(seg == "FURNITURE", n + 7).otherwise(n + 20)
    other = F.concat(s(last), F.lit(":"), s(last + 1))
    return _specs(c, "c_custkey", F.array(entry, other))


def span_specs(spark: SparkSession, sf: str) -> DataFrame:
    return layout.span_specs(_span_layouts(spark, sf)).select(
        "pair_id", "sec_ord", "q_ord", "section_row", "first_row", "span", "error"
    )


def section_violations(spark: SparkSession, sf: str) -> DataFrame:
    return layout.section_violations(layout.span_specs(_span_layouts(spark, sf))).select("pair_id", "sec_ord", "q_ord", "error")


def span_expand(spark: SparkSession, sf: str) -> DataFrame:
    """Sheet rows of every valid question with the order text that sits on the row, if any."""
    rows = extract.span_rows(layout.span_specs(_span_layouts(spark, sf)))
    sheet = table(spark, sf, "orders").groupBy(
        F.col("o_custkey").cast("string").alias("pair_id"), (F.substring("o_orderpriority", 1, 1).cast("int") * 5).alias("row_num")
    ).agg(F.min("o_orderpriority").alias("label"))
    return rows.join(sheet, ["pair_id", "row_num"], "left").select(
        "pair_id", "sec_ord", "q_ord", "row_offset", "row_num", F.coalesce("label", F.lit("")).alias("label")
    )


def asof_header(spark: SparkSession, sf: str) -> DataFrame:
    """For every event the latest 'error' event of the same user at or before it."""
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    hour = 3_600_000_000.0
    out = ordering.asof_last(e, ["user_id"], "at", F.col("event_type") == "error", F.col("event_id"), "header_id", hour)
    return out.select("event_id", "header_id")


def interval_first(spark: SparkSession, sf: str) -> DataFrame:
    """Line items by the first quantity band of their supplier that holds them; bands overlap."""
    bands = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("key"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("band"), "s_nationkey"
    ).select("key", "band", (F.col("band") * 10 + 5).alias("lo"), (F.col("band") * 10 + 5 + F.col("s_nationkey")).alias("hi"))
    points = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("key"), F.col("l_quantity").cast("int").alias("at")
    ).groupBy("key", "at").agg(F.count(F.lit(1)).alias("items"))
    found = spans.covering_join(points, bands, ["key"], "at", "lo", "hi")
    return found.groupBy("key", "at", "items").agg(F.min("band").alias("band"))


# ---------------------------------------------------------------- extraction


def _question_columns(df: DataFrame, *extra: str) -> DataFrame:
    return df.select("pair_id", "side", "ord", "section", "number", "text", "row_num", *extra, *_flat_rules())


def extract_control(spark: SparkSession, sf: str) -> DataFrame:
    return _question_columns(corpus.control_questions(spark, sf), "chapter", "original_text")


def extract_risk(spark: SparkSession, sf: str) -> DataFrame:
    return _question_columns(corpus.risk_questions(spark, sf), "explanation")


def extract_general(spark: SparkSession, sf: str) -> DataFrame:
    """The answer and explanation cells of every question."""
    questions, cells = corpus.general_questions(spark, sf)
    key = ["pair_id", "side", "ord"]
    return questions.select(*key, "section", "number").join(cells, key).select(
        *key, "section", "number", "kind", "row_offset", "col", "col_ord", F.col("text").alias("cell_text")
    )


def row_labels(spark: SparkSession, sf: str) -> DataFrame:
    questions, _ = corpus.general_questions(spark, sf)
    return questions.select("pair_id", "side", "ord", "number", "text", F.array_join("row_labels", "|").alias("labels"))


# ---------------------------------------------------------------- question diff


def _risk(spark: SparkSession, sf: str, seconds: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    prev, curr = split_sides(cut_lineage(corpus.risk_questions(spark, sf)))
    return prev, curr, align(prev, curr, seconds=seconds)


def _risk_diff(spark: SparkSession, sf: str, seconds: bool = True) -> DataFrame:
    prev, curr, alignment = _risk(spark, sf, seconds)
    return diff.diff_records(prev, curr, alignment, diff.RISK_FLAGS)


def _control_diff(spark: SparkSession, sf: str, seconds: bool = True) -> DataFrame:
    questions = corpus.control_questions(spark, sf, all_pairs=True)
    return diff.diff_records(*split_sides(questions), align_dealt(questions, seconds=seconds), diff.CONTROL_FLAGS)


def _matched(alignment: DataFrame) -> DataFrame:
    return alignment.filter("n_ord IS NOT NULL AND o_ord IS NOT NULL")


def match_one_to_one(spark: SparkSession, sf: str) -> DataFrame:
    return _matched(_risk(spark, sf, seconds=False)[2]).select("pair_id", "n_ord", "o_ord")


def pair_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Plain score of every match, out of the best assignment of its block."""
    return _matched(_risk(spark, sf, seconds=False)[2]).select("pair_id", "n_ord", "o_ord", "similarity")


def adjusted_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Score with section and number bonuses of every match."""
    return _matched(_risk(spark, sf, seconds=False)[2]).select("pair_id", "n_ord", "o_ord", "adj")


def second_best(spark: SparkSession, sf: str) -> DataFrame:
    return _matched(_risk(spark, sf)[2]).select("pair_id", "n_ord", "second_best")


def added_rows(spark: SparkSession, sf: str) -> DataFrame:
    _, curr, alignment = _risk(spark, sf, seconds=False)
    return diff.added_rows(curr, alignment).select("pair_id", "ord", "number", "text")


def removed_rows(spark: SparkSession, sf: str) -> DataFrame:
    prev, _, alignment = _risk(spark, sf, seconds=False)
    return diff.removed_rows(prev, alignment).select("pair_id", "ord", "number", "text")


def question_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Cells, rules and layouts to extracted questions, aligned and classified (risk level)."""
    return _risk_diff(spark, sf).select(
        "pair_id", "status", "n_ord", "o_ord", "similarity", "second_best",
        "text_changed", "number_changed", "dv_changed", "cf_changed", "explanation_changed",
    )


def question_diff_tiled(spark: SparkSession, sf: str) -> DataFrame:
    """The same with every block taken for a large one: scored in tiles, matched and proved by prices."""
    prev, curr = split_sides(cut_lineage(corpus.risk_questions(spark, sf)))
    d = diff.diff_records(prev, curr, align(prev, curr, max_rows=1), diff.RISK_FLAGS)
    return d.select("pair_id", "status", "n_ord", "o_ord", "similarity", "second_best")


def _control_places(spark: SparkSession, sf: str) -> DataFrame:
    prev, curr = split_sides(corpus.control_questions(spark, sf))
    return diff.diff_records(prev, curr, corpus.row_alignment(prev, curr), diff.CONTROL_FLAGS)


def control_flags(spark: SparkSession, sf: str) -> DataFrame:
    """What changed in every line of every document, against the line at its place."""
    return _control_places(spark, sf).select("pair_id", "n_ord", "o_ord", "status", "text_changed", "number_changed", "dv_changed", "cf_changed")


def control_sheet_breaks(spark: SparkSession, sf: str) -> DataFrame:
    """Chapter and section breaks of the sheets of all documents, both views."""
    named = {s: F.struct(*[F.col(f"{s}.{c}").alias(c) for c in ("row_num", "chapter", "section")]) for s in ("prev", "curr")}
    d = cut_lineage(_control_places(spark, sf).select("pair_id", "status", "n_ord", "o_ord", *[F.when(F.col(s).isNotNull(), c).alias(s) for s, c in named.items()]))
    views = [report.sheet_breaks(report.sheet_order(d, side)).withColumn("view", F.lit(side)) for side in ("current", "previous")]
    return views[0].unionByName(views[1]).select("view", "pair_id", "row_num", "position", "chapter_break", "section_break")


def document_question_diff(spark: SparkSession, sf: str) -> DataFrame:
    """The control-level chain over every line of every document."""
    return _control_diff(spark, sf).select(
        "pair_id", "status", "n_ord", "o_ord", "similarity", "second_best",
        "text_changed", "number_changed", "dv_changed", "cf_changed",
    )


def diff_summary(spark: SparkSession, sf: str) -> DataFrame:
    return report.diff_summary(_risk_diff(spark, sf, seconds=False))


def document_diff_summary(spark: SparkSession, sf: str) -> DataFrame:
    return report.diff_summary(_control_diff(spark, sf, seconds=False))


def similarity_band(spark: SparkSession, sf: str) -> DataFrame:
    score = F.col("similarity")
    return _matched(_risk(spark, sf, seconds=False)[2]).select(
        "pair_id", "n_ord", fn.similarity_band(score).alias("band"), fn.similarity_pct(score).alias("pct")
    )


def ambiguous_matches(spark: SparkSession, sf: str) -> DataFrame:
    return _matched(_risk_diff(spark, sf)).select(
        "pair_id", "n_ord", fn.similarity_pct(F.col("second_best")).alias("second_pct"),
        fn.ambiguous(F.col("similarity"), F.col("second_best")).alias("ambiguous"),
    )


def change_badges(spark: SparkSession, sf: str) -> DataFrame:
    d = report.badges(_risk_diff(spark, sf).filter("status = 'changed'"))
    return d.select("pair_id", "n_ord", F.array_join("badges", ",").alias("badges"))


def bucket_ordinal(spark: SparkSession, sf: str) -> DataFrame:
    return report.bucket_ordinal(cut_lineage(_risk_diff(spark, sf, seconds=False))).select("pair_id", "status", "n_ord", "o_ord", "position")


def _sheet(spark: SparkSession, sf: str, make) -> DataFrame:
    d = cut_lineage(_risk_diff(spark, sf, seconds=False))
    parts = [make(report.sheet_order(d, side)).withColumn("view", F.lit(side)) for side in ("current", "previous")]
    return parts[0].unionByName(parts[1])


def sheet_order(spark: SparkSession, sf: str) -> DataFrame:
    rows = _sheet(spark, sf, lambda t: t.drop("chapter")).orderBy("pair_id", "view", "row_num", "status_rank", "ord")
    return rows.drop("status_rank", "ord")


def sheet_order_breaks(spark: SparkSession, sf: str) -> DataFrame:
    return _sheet(spark, sf, lambda t: report.sheet_breaks(t).select("pair_id", "row_num", "position", "chapter_break", "section_break"))


def search_rows(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return report.search_rows(part, ["p_name", "p_brand", "p_type"], "  ANVIL brand#1")


def word_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Words of every changed question, old and new."""
    d = _risk_diff(spark, sf, seconds=False).filter("status = 'changed'")
    pairs = d.select("pair_id", "n_ord", F.col("prev.text").alias("old"), F.col("curr.text").alias("new"))
    return report.word_diff(pairs, ["pair_id", "n_ord"], "old", "new")


def word_diff_counts(spark: SparkSession, sf: str) -> DataFrame:
    return word_diff(spark, sf).groupBy("pair_id", "n_ord", "side", "op").agg(F.count(F.lit(1)).alias("words"))


def report_payload(spark: SparkSession, sf: str) -> DataFrame:
    return report.report_payload(cut_lineage(_risk_diff(spark, sf)))


_ENTRY = """questionNumber string, section string, rowNumber int, previousRowNumber int, currentRowNumber int, previousNumber string, currentNumber string,
  questionText string, oldText string, newText string, similarityScore double, secondBestSimilarity double, textChanged boolean, numberChanged boolean,
  dvChanged boolean, cfChanged boolean, oldExplanation string, newExplanation string, explanationChanged boolean"""


def report_document(spark: SparkSession, sf: str) -> DataFrame:
    """The report of every conversation as one JSON document, written (small ones together), read back and
    taken apart; an empty bucket gives a row without an entry."""
    d = cut_lineage(_risk_diff(spark, sf))
    blocks = table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("pair_id")).distinct().select(
        "pair_id", F.lit("Risk level questions").alias("title"), F.concat("pair_id", F.lit(".prev.xlsx")).alias("previousWorkbookPath"),
        F.concat("pair_id", F.lit(".curr.xlsx")).alias("currentWorkbookPath"), F.lit("2025-01-31T08:00:00+00:00").alias("generatedAt"),
    )
    path = f"{scratch_dir(spark).rstrip('/')}/documents-{uuid.uuid4().hex}"
    single = write_documents_together(report.document_lines(blocks, report.report_entries(d), report.STATUSES), path)
    schema = "title string, previousWorkbookPath string, currentWorkbookPath string, generatedAt string, " + ", ".join(f"{s} array<struct<{_ENTRY}>>" for s in report.STATUSES)
    read = read_documents(spark, path, schema, single).withColumnRenamed("document", "d")
    buckets = F.explode(F.array(*[F.struct(F.lit(s).alias("status"), F.col(f"d.{s}").alias("e")) for s in report.STATUSES]))
    rows = read.select("pair_id", "d.title", F.col("d.previousWorkbookPath").alias("previous_path"), F.col("d.currentWorkbookPath").alias("current_path"),
                       F.col("d.generatedAt").alias("generated_at"), buckets.alias("b"))
    rows = rows.select(*rows.columns[:-1], "b.status", F.posexplode_outer("b.e").alias("at", "x"))
    named = {
        "question_number": "questionNumber", "section": "section", "row_number": "rowNumber", "previous_row": "previousRowNumber", "current_row": "currentRowNumber",
        "previous_number": "previousNumber", "current_number": "currentNumber", "question_text": "questionText", "old_text": "oldText", "new_text": "newText",
        "similarity": "similarityScore", "second_best": "secondBestSimilarity", "text_changed": "textChanged", "number_changed": "numberChanged", "dv_changed": "dvChanged",
        "cf_changed": "cfChanged", "old_explanation": "oldExplanation", "new_explanation": "newExplanation", "explanation_changed": "explanationChanged",
    }
    return rows.select(*rows.columns[:-2], (F.col("at") + 1).cast("long").alias("position"), *[F.col(f"x.{v}").alias(k) for k, v in named.items()])


def cell_report_document(spark: SparkSession, sf: str) -> DataFrame:
    """The cell report of every brand as one JSON document, written and read back: its entries per bucket."""
    d = cut_lineage(_cell_diff(spark, sf, "full"))
    blocks = d.select("pair_id").distinct().select(
        "pair_id", F.lit("Cell ranges").alias("title"), F.lit("old.xlsx").alias("file1Path"), F.lit("new.xlsx").alias("file2Path"), F.lit("Parts").alias("sheet1Name"),
        F.lit("Parts").alias("sheet2Name"), F.lit(True).alias("includeValidationFormatting"), F.lit("2025-01-31T08:00:00+00:00").alias("generatedAt"),
    )
    path = f"{scratch_dir(spark).rstrip('/')}/documents-{uuid.uuid4().hex}"
    write_documents(report.document_lines(blocks, report.cell_entries(d), ["changed", "unchanged"]), path)
    cell = "address string, `column` string, `row` int, file1Value string, file2Value string, value string, file1DvDisplay string, file2DvDisplay string, dvDisplay string, dvChanged boolean"
    read = spark.read.text(path, wholetext=True).select("pair_id", F.from_json("value", f"changed array<struct<{cell}>>, unchanged array<struct<{cell}>>").alias("d"))
    buckets = F.explode(F.array(*[F.struct(F.lit(s).alias("status"), F.col(f"d.{s}").alias("e")) for s in ("changed", "unchanged")]))
    rows = read.select("pair_id", buckets.alias("b")).select("pair_id", "b.status", F.posexplode("b.e").alias("at", "x"))
    return rows.select(
        "pair_id", "status", (F.col("at") + 1).cast("long").alias("position"), "x.address", F.col("x.column").alias("col"), F.col("x.row").alias("row_num"),
        F.col("x.file1Value").alias("old_value"), F.coalesce("x.file2Value", "x.value").alias("new_value"),
        F.col("x.file1DvDisplay").alias("old_dv"), F.coalesce("x.file2DvDisplay", "x.dvDisplay").alias("new_dv"), F.col("x.dvChanged").alias("dv_changed"),
    )


def write_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Summary and diff written as sheets of text, and read back."""
    d = cut_lineage(_risk_diff(spark, sf).drop("prev", "curr"))
    path = f"{scratch_dir(spark).rstrip('/')}/sheets-{uuid.uuid4().hex}"
    tables = {"summary": report.diff_summary(d), "questions": d.select("pair_id", "status", "n_ord", "o_ord")}
    write_sheets(tables, {"summary": ["pair_id"], "questions": ["pair_id", "status", "n_ord", "o_ord"]}, path)
    back = spark.read.parquet(path).orderBy("sheet", "row_key")
    return back.select("sheet", "row_key", F.array_join("header", "|").alias("header"), F.array_join("values", "|").alias("row"))


def ingest_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Every conversation packed as two workbooks, and all workbooks read back into cells."""
    return parse_workbooks(workbook_files(corpus.risk_cells(spark, sf)))[0]


def ingest_rules(spark: SparkSession, sf: str) -> DataFrame:
    """The rules of the same workbooks, read back."""
    return parse_workbooks(workbook_files(corpus.risk_cells(spark, sf), corpus.risk_rules(spark, sf)))[1]


def ingested_question_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Workbooks to cells and rules, to questions, to their diff: the whole chain from files."""
    cells, rules, _ = parse_workbooks(workbook_files(corpus.risk_cells(spark, sf), corpus.risk_rules(spark, sf)))
    prev, curr = split_sides(cut_lineage(corpus.extracted_risk(spark, sf, cells, rules)))
    d = diff.diff_records(prev, curr, align(prev, curr), diff.RISK_FLAGS)
    return d.select("pair_id", "status", "n_ord", "o_ord", "similarity", "text_changed", "number_changed", "dv_changed", "cf_changed", "explanation_changed")


def ingest_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Files that are no workbook, or whose name says no pair and side."""
    files = workbook_files(corpus.risk_cells(spark, sf).filter("side = 'prev'"))
    number = F.regexp_extract("path", "^[0-9]+", 0).cast("long")
    path = F.when(number % 7 == 0, F.concat(number.cast("string"), F.lit(".xlsx"))).otherwise(F.col("path"))
    content = F.when(number % 5 == 0, F.substring("content", 1, 40)).otherwise(F.col("content"))
    errors = parse_workbooks(files.select(path.alias("path"), content.alias("content")))[2]
    return errors.select("path", F.substring_index("error", ":", 1).alias("error"))


# ---------------------------------------------------------------- cell diff


def cell_range_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Ranges of a sheet per customer on both sides: filled, blank and rule-only addresses."""
    sides = F.explode(F.array(F.lit("prev"), F.lit("curr"))).alias("side")
    args = _range_args(spark, sf).drop("side").select("pair_id", sides, "sheet", "ranges")
    who = [F.col("c_custkey").cast("string").alias("pair_id"), sides, F.lit("S").alias("sheet")]
    c = table(spark, sf, "customer").select(*who, "c_name", "c_mktsegment", "c_nationkey", "c_acctbal")
    new = F.col("side") == "curr"
    cells = c.select("pair_id", "side", "sheet", F.explode(F.array(
        F.struct(F.lit(1).alias("row_num"), F.lit(1).alias("col_idx"), F.when(new, F.concat(F.lit(" "), "c_name")).otherwise(F.col("c_name")).alias("text")),
        F.struct(F.lit(9).alias("row_num"), F.lit(26).alias("col_idx"), F.when(new & (F.col("c_nationkey") > 12), F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")).alias("text")),
    )).alias("w")).select("pair_id", "side", "sheet", "w.row_num", "w.col_idx", "w.text")
    rules = c.select(
        "pair_id", "side", "sheet", F.lit("dv").alias("kind"), F.lit(0).alias("rule_ord"), F.lit(0).alias("range_ord"), F.lit(2).alias("r1"), F.lit(2).alias("c1"),
        F.lit(3).alias("r2"), F.lit(3).alias("c2"), F.lit("WholeNumber").alias("type"), F.lit("Between").alias("op"), F.lit("1").alias("v1"),
        F.when(new & (F.col("c_acctbal") > 5000), "10").otherwise("9").alias("v2"),
    )
    return diff.cell_range_diff(args, cells, rules).select("pair_id", "address", "row_num", "col_idx", "status", "text_changed", "dv_changed", "cf_changed")


def _cell_diff(spark: SparkSession, sf: str, scope: str) -> DataFrame:
    out = diff.diff_cells(
        corpus.part_cells(spark, sf, "prev"), corpus.part_cells(spark, sf, "curr"), ["pair_id", "address"], scope
    )
    a = F.col("address")
    return out.withColumns({"col": fn.address_col(a), "row_num": fn.address_row(a)})


def _cell_report(spark: SparkSession, sf: str, scope: str) -> DataFrame:
    return report.cell_report(_cell_diff(spark, sf, scope), scope)


def cell_diff_value(spark: SparkSession, sf: str) -> DataFrame:
    return _cell_report(spark, sf, "value")


def cell_diff_full(spark: SparkSession, sf: str) -> DataFrame:
    return _cell_report(spark, sf, "full")


def cell_diff_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _cell_diff(spark, sf, "full").groupBy("pair_id", "status").agg(F.count(F.lit(1)).alias("cells"))


def _general(spark: SparkSession, sf: str, nested: bool = False):
    questions, cells = (cut_lineage(t) for t in corpus.general_questions(spark, sf))
    if nested:
        questions = cut_lineage(report.nest_cells(questions, cells))
    prev, curr = split_sides(questions)
    alignment = cut_lineage(align(prev, curr))
    changes = {k: diff.question_cell_changes(*split_sides(cells), alignment, k) for k in ("answer", "explanation")}
    return prev, curr, alignment, changes


def answer_cell_diff(spark: SparkSession, sf: str) -> DataFrame:
    changes = _general(spark, sf)[3]["answer"]
    old, new = F.col("prev.text"), F.col("curr.text")
    return changes.select(
        "pair_id", "n_ord", "o_ord", fn.cell_label(F.col("col"), F.col("row_offset")).alias("cell"),
        old.alias("old_text"), new.alias("new_text"), "text_changed", fn.cell_marker(old, new).alias("marker"),
    )


def nested_cells(spark: SparkSession, sf: str) -> DataFrame:
    """The cell lists of every question, taken apart: their order and place."""
    questions, cells = (cut_lineage(t) for t in corpus.general_questions(spark, sf))
    nested = report.nest_cells(questions, cells)
    key = ["pair_id", "side", "ord"]
    answers = nested.select(*key, F.lit("answer").alias("kind"), F.posexplode("answer_cells").alias("at", "c"))
    answers = answers.select(*key, "kind", "at", "c.rowOffset", F.col("c.column").alias("col"), F.col("c.text").alias("cell_text"))
    told = nested.select(*key, F.lit("explanation").alias("kind"), F.posexplode("explanation_cells").alias("at", "c"))
    told = told.select(*key, "kind", "at", "c.rowOffset", F.lit("G").alias("col"), F.col("c.text").alias("cell_text"))
    return answers.unionByName(told).select(*key, "kind", (F.col("at") + 1).cast("long").alias("position"), F.col("rowOffset").alias("row_offset"), "col", "cell_text")


def cell_change_order(spark: SparkSession, sf: str) -> DataFrame:
    """The changed answer cells of every matched question, in the order of its report entry."""
    prev, curr, alignment, changes = _general(spark, sf)
    changes = {k: cut_lineage(c) for k, c in changes.items()}
    d = diff.diff_records(prev, curr, alignment, diff.GENERAL_FLAGS, diff.cells_changed_flags(changes["answer"], changes["explanation"]))
    listed = report.nest_changes(d, changes["answer"], changes["explanation"]).select("pair_id", "n_ord", "o_ord", F.posexplode("answer_cell_changes").alias("at", "c"))
    return listed.select(
        "pair_id", "n_ord", "o_ord", (F.col("at") + 1).cast("long").alias("position"), F.col("c.rowOffset").alias("row_offset"), F.col("c.column").alias("col"),
        F.col("c.oldText").alias("old_text"), F.col("c.newText").alias("new_text"), F.col("c.textChanged").alias("text_changed"),
    )


def explanation_cell_diff(spark: SparkSession, sf: str) -> DataFrame:
    changes = _general(spark, sf)[3]["explanation"]
    old, new = F.col("prev.text"), F.col("curr.text")
    return changes.select(
        "pair_id", "n_ord", "o_ord", fn.cell_label(F.lit("G"), F.col("row_offset")).alias("cell"),
        old.alias("old_text"), new.alias("new_text"), "text_changed", fn.cell_marker(old, new).alias("marker"),
    )


def cells_changed_flag(spark: SparkSession, sf: str) -> DataFrame:
    changes = _general(spark, sf)[3]
    return diff.cells_changed_flags(changes["answer"], changes["explanation"])


def general_question_diff(spark: SparkSession, sf: str) -> DataFrame:
    prev, curr, alignment, changes = _general(spark, sf)
    flags = diff.cells_changed_flags(changes["answer"], changes["explanation"])
    d = diff.diff_records(prev, curr, alignment, diff.GENERAL_FLAGS, flags)
    return d.select(
        "pair_id", "status", "n_ord", "o_ord", "similarity", "second_best",
        "text_changed", "number_changed", "answer_cells_changed", "explanation_cells_changed",
    )


def general_report_payload(spark: SparkSession, sf: str) -> DataFrame:
    """Report entries with their nested cells and cell changes."""
    prev, curr, alignment, changes = _general(spark, sf, nested=True)
    changes = {k: cut_lineage(c) for k, c in changes.items()}
    flags = diff.cells_changed_flags(changes["answer"], changes["explanation"])
    d = diff.diff_records(prev, curr, alignment, diff.GENERAL_FLAGS, flags)
    return report.report_payload(cut_lineage(report.nest_changes(d, changes["answer"], changes["explanation"])))


QUERIES = {
    f.__name__: f
    for f in (
        normalize_text, text_similarity, number_prefix, dv_changed, cf_changed, dv_display, cf_display, serial_date,
        range_tokens, distinct_addresses, address_order, base_name, escape_html,
        nonblank_rows, range_grid, range_errors, attach_rules, layout_scan, layout_errors, section_specs, span_specs, section_violations,
        span_expand, asof_header, interval_first,
        extract_control, extract_risk, extract_general, row_labels,
        pair_scores, adjusted_scores, match_one_to_one, second_best, added_rows, removed_rows,
        question_diff, question_diff_tiled, document_question_diff, control_flags, control_sheet_breaks, diff_summary, document_diff_summary,
        similarity_band, ambiguous_matches, change_badges, bucket_ordinal, sheet_order, sheet_order_breaks,
        search_rows, word_diff, word_diff_counts, report_payload, report_document, cell_report_document, write_tables, ingest_cells, ingest_rules, ingested_question_diff, ingest_errors,
        cell_diff_value, cell_diff_full, cell_diff_summary, cell_range_diff,
        answer_cell_diff, explanation_cell_diff, nested_cells, cell_change_order, cells_changed_flag, general_question_diff,
        general_report_payload,
    )
}
