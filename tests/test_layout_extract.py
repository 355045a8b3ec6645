import pytest
from pyspark.sql import functions as F

from revdiff.functions import col_index
from revdiff.operators import extract, layout, scan
from revdiff.operators.diff import cell_range_diff
from revdiff.operators.extract import extract_control, extract_general, extract_risk, span_rows
from revdiff.operators.scan import attach_rules, disjoint_rectangles, nonblank_rows, range_errors, range_grid
from revdiff.operators.spans import covering_join

CELLS = "pair_id string, side string, sheet string, row_num int, col string, text string"


def cells(spark, rows, sheet="S", side="prev", pair="p"):
    df = spark.createDataFrame([(pair, side, sheet, r, c, t) for r, c, t in rows], CELLS)
    return df.withColumn("col_idx", col_index(F.col("col")))


def layouts(spark, kind, config, pair="p", side="prev"):
    raw = spark.createDataFrame([(pair, side, config)], "pair_id string, side string, config string")
    return layout.parse_layouts(raw, kind)


def test_layout_defaults_and_case(spark):
    row = layouts(spark, "general", '{"SHEETNAME": "X", "answercolumns": ["d", "h"]}').first()
    assert (row["sheet"], row["text_col"], row["number_col"], row["explanation_col"]) == ("X", "C", "B", "G")
    assert row["answer_cols"] == ["D", "H"] and row["specs"] == [] and row["error"] is None
    assert layouts(spark, "control", "{}").first()["sheet"] == "Control Level Questions"
    assert layouts(spark, "risk", "not json").first()["error"] is not None


def test_read_layouts(spark, tmp_path):
    (tmp_path / "a.prev.json").write_text('{"chapterRows": [1],\n "sectionRows": ["2:3-4"]}')
    row = layout.read_layouts(spark, str(tmp_path), "control").first()
    assert (row["pair_id"], row["side"], row["chapter_rows"], row["specs"]) == ("a", "prev", [1], ["2:3-4"])


@pytest.mark.parametrize("spec,want", [
    ("2:3-9", (2, 3, 9, None)), (" 2 : +3 - 9 ", (2, 3, 9, None)),
    ("2", "format"), (":3-9", "format"), ("2:39", "format"), ("x:3-9", "section row"), ("0:3-9", "section row"),
    ("2:x-9", "first row"), ("2:3-", "last row"), ("2:-3-9", "first row"), ("2:2-9", "first row not below section row"),
    ("2:5-4", "last row above first row"), ("2:3-99999999999", "last row"),
])
def test_section_specs(spark, spec, want):
    import json

    row = layout.section_specs(layouts(spark, "control", json.dumps({"sectionRows": [spec]}))).first()
    if isinstance(want, str):
        assert row["error"] == want
    else:
        assert (row["section_row"], row["first_row"], row["last_row"], row["error"]) == want


@pytest.mark.parametrize("spec,want", [
    ("13:14(3), 18 ,, 20 ( 2 )", [(14, 3, None), (18, 1, None), (20, 2, None)]),
    ("13:", [(None, None, "no question")]), ("13:14(3),16", [(14, 3, "overlaps next question"), (16, 1, None)]),
    ("13:20,14", [(20, 1, "overlaps next question"), (14, 1, None)]), ("13:13", [(13, 1, "question not below section row")]),
    ("13:14(0)", [(14, None, "question row span")]), ("13:14(2", [(14, None, "question format")]), ("13:(2)", [(None, 2, "question format")]),
    ("13:x", [(None, 1, "question start row")]),
])
def test_span_specs(spark, spec, want):
    import json

    rows = layout.span_specs(layouts(spark, "general", json.dumps({"sectionRows": [spec]}))).orderBy("q_ord").collect()
    assert [(r["first_row"], r["span"], r["error"]) for r in rows] == want


def test_section_violations(spark):
    lay = layouts(spark, "general", '{"sectionRows": ["10:11(5)", "14:15", "12:16"]}')
    found = {(r["sec_ord"], r["error"]) for r in layout.section_violations(layout.span_specs(lay)).collect()}
    assert found == {(0, "question reaches next section"), (1, "sections not increasing"), (1, "question reaches next section")}
    quarantine = layout.layout_errors(lay, layout.span_specs(lay), cross=True)
    assert quarantine.count() == 3


def test_extract_control(spark):
    rows = [(1, "C", "Chapter"), (2, "C", "Section"), (3, "C", " 1.1) First "), (3, "D", ""), (4, "C", "outside"), (5, "C", "  "),
            (6, "C", "Other"), (7, "C", "1.2 Second"), (8, "D", "no text cell")]
    lay = layouts(spark, "control", '{"sheetName": "S", "chapterRows": [1, 90], "sectionRows": ["2:3-3", "6:7-9", "2:3-9"]}')
    got = extract_control(cells(spark, rows), lay, layout.section_specs(lay)).orderBy("ord").collect()
    assert [(r["row_num"], r["chapter"], r["section"], r["number"], r["text"], r["original_text"]) for r in got] == [
        (3, "Chapter", "Section", "1.1", "First", " 1.1) First "),
        (4, "Chapter", "Section", None, "outside", "outside"),
        (7, "Chapter", "Other", "1.2", "Second", "1.2 Second"),
    ]


def test_extract_control_missing_chapter_row(spark):
    lay = layouts(spark, "control", '{"sheetName": "S", "chapterRows": [1, 3], "sectionRows": ["2:4-4"]}')
    got = extract_control(cells(spark, [(1, "C", "Chapter"), (2, "C", "Sec"), (4, "C", "q")]), lay, layout.section_specs(lay)).first()
    assert (got["chapter"], got["section"]) == ("", "Sec")


def test_extract_risk(spark):
    rows = [(1, "C", "Sec"), (2, "B", " 4.1 "), (2, "C", " Text "), (2, "E", "why"), (3, "B", " "), (3, "C", "Plain"), (4, "C", " ")]
    lay = layouts(spark, "risk", '{"sheetName": "S", "sectionRows": ["1:2-4", "2:3-3"]}')
    got = extract_risk(cells(spark, rows), lay, layout.section_specs(lay)).orderBy("ord").collect()
    assert [(r["row_num"], r["section"], r["number"], r["text"], r["explanation"]) for r in got] == [
        (2, "Sec", "4.1", " Text ", "why"), (3, "Sec", None, "Plain", ""), (3, " Text ", None, "Plain", ""),
    ]


def test_extract_general(spark):
    rows = [(13, "C", " Title "), (14, "B", "5.a"), (14, "C", "Question"), (14, "D", "x"), (15, "B", "5.b"), (15, "D", "y"), (15, "E", " z "),
            (16, "B", "5.c"), (16, "D", "u"), (16, "E", "v"), (16, "F", "  "), (15, "G", "explain"), (21, "C", " "), (22, "C", "tail")]
    lay = layouts(spark, "general", '{"sheetName": "S", "sectionRows": ["13:14(3), 18(2), 21, 22(2)"]}')
    questions, parts = extract_general(cells(spark, rows), lay, layout.span_specs(lay))
    got = questions.orderBy("ord").collect()
    assert [(r["row_num"], r["section"], r["number"], r["text"], r["row_labels"]) for r in got] == [
        (14, "Title", "5.a", "Question", ["5.a", "5.b", "5.c"]), (22, "Title", None, "tail", ["", ""]),
    ]
    order = parts.orderBy("row_offset", "col_ord").filter("kind = 'answer'").collect()
    assert [(r["row_offset"], r["col"], r["text"]) for r in order] == [(0, "D", "x"), (1, "D", "y"), (1, "E", "z"), (2, "D", "u"), (2, "E", "v")]
    assert [(r["row_offset"], r["text"]) for r in parts.filter("kind = 'explanation'").collect()] == [(1, "explain")]
    assert span_rows(layout.span_specs(lay)).count() == 8


BAD_RANGES = [
    ("q", "prev", "S", "A1;bad one; A0:A2"), ("r", "prev", "S", "ZZZ3"), ("s", "prev", "S", "A99999999999"), ("t", "prev", "S", "XFE1;A1048577;XFD1048576"),
]


def test_bad_ranges_are_all_listed(spark):
    args = spark.createDataFrame([("p", "prev", "S", "XFD1048576"), *BAD_RANGES], "pair_id string, side string, sheet string, ranges string")
    assert {r.pair_id: r.error for r in range_errors(args).collect()} == {
        "q": "bad ranges: bad one; A0:A2", "r": "bad ranges: ZZZ3", "s": "bad ranges: A99999999999", "t": "bad ranges: XFE1; A1048577",
    }


@pytest.mark.parametrize(
    "config, error",
    [
        ('{"sectionRows":"1:2-3"}', "sectionRows is not a list of texts"), ('{"sectionRows":5}', "sectionRows is not a list of texts"),
        ('{"chapterRows":["x"]}', "chapterRows is not a list of whole numbers"), ('{"answerColumns":"D"}', "answerColumns is not a list of texts"),
        ('{"sectionRows":null}', None), ("{}", None), ("[]", "config is not a JSON object"),
    ],
)
def test_fields_of_the_wrong_kind_are_errors(spark, config, error):
    assert layouts(spark, "general", config).first().error == error


def test_layout_files_need_a_pair_and_a_side(spark, tmp_path):
    for name in ("a.prev.json", "notes.json"):
        (tmp_path / name).write_text("{}")
    got = {(r.pair_id, r.side): r.error for r in layout.read_layouts(spark, str(tmp_path), "risk").collect()}
    assert got == {("a", "prev"): None, ("notes.json", ""): "file name is not <pair>.<prev|curr>.json"}


def test_cell_range_diff_has_tasks_by_addresses(spark, monkeypatch):
    monkeypatch.setattr(scan, "TASK_ADDRESSES", 100)
    args = spark.createDataFrame([("p", s, "S", "A1:B1000") for s in ("prev", "curr")], "pair_id string, side string, sheet string, ranges string")
    cells = spark.createDataFrame([("p", "curr", "S", 1000, 2, "x")], "pair_id string, side string, sheet string, row_num int, col_idx int, text string")
    rules = spark.createDataFrame([("p", "prev", "S", "dv", 0, 0, 1, 1, 1000, 2, "List", None, "1", "")], "pair_id string, side string, sheet string, kind string, rule_ord int, range_ord int, r1 int, c1 int, r2 int, c2 int, type string, op string, v1 string, v2 string")
    out = cell_range_diff(args, cells, rules)
    assert scan.grid_tasks(scan.range_rectangles(args)) == 41
    sizes = out.rdd.glom().map(len).collect()
    assert sum(sizes) == 2000 and max(sizes) < 300  # not folded into a task for their few bytes
    rows = out.collect()
    assert [(r.row_num, r.col_idx) for r in rows] == [(r, c) for r in range(1, 1001) for c in (1, 2)]
    assert all(r.dv_changed for r in rows) and [r.address for r in rows if r.text_changed] == ["B1000"]


def test_cell_range_diff(spark):
    args = spark.createDataFrame([(p, s, "S", r) for p, r in (("p", "Z2:AA2;a1"), ("q", "A1;bad one")) for s in ("prev", "curr")], "pair_id string, side string, sheet string, ranges string")
    both = spark.createDataFrame([("p", "prev", "S", 1, 1, "x"), ("p", "curr", "S", 1, 1, " x "), ("p", "curr", "S", 2, 26, "new")], "pair_id string, side string, sheet string, row_num int, col_idx int, text string")
    rules = spark.createDataFrame([("p", "curr", "S", "cf", 0, 0, 2, 27, 2, 27, "CellIs", "Equal", "1", None)], RULES)
    got = [(r.address, r.status, r.text_changed, r.cf_changed) for r in cell_range_diff(args, both, rules).collect()]
    assert got == [("A1", "unchanged", False, False), ("Z2", "changed", True, False), ("AA2", "changed", False, True)]


def test_nonblank_rows_and_grid(spark):
    df = cells(spark, [(1, "A", "x"), (1, "B", " "), (2, "A", " "), (2, "B", None)])
    assert nonblank_rows(df).count() == 2
    args = spark.createDataFrame([("p", "prev", "S", "A1:A2; a1:B1"), *BAD_RANGES], "pair_id string, side string, sheet string, ranges string")
    got = range_grid(args, df).orderBy("row_num", "col_idx").collect()
    assert [(r["row_num"], r["col_idx"], r["text"]) for r in got] == [(1, 1, "x"), (1, 2, " "), (2, 1, " ")]


RULES = ("pair_id string, side string, sheet string, kind string, rule_ord int, range_ord int, r1 int, c1 int, r2 int, c2 int, "
         "type string, op string, v1 string, v2 string")


def test_attach_rules_first_wins(spark):
    rules = spark.createDataFrame([
        ("p", "prev", "S", "dv", 1, 0, 1, 1, 100, 5, "Decimal", "Between", "1", "2"),
        ("p", "prev", "S", "dv", 0, 1, 3, 1, 4, 1, "List", "Between", '"A"', ""),
        ("p", "prev", "S", "cf", 0, 0, 4, 1, 4, 1, "CellIs", "Equal", "7", None),
        ("q", "prev", "S", "dv", 0, 0, 1, 1, 9, 9, "Date", "Equal", "7", None),
    ], RULES)
    got = attach_rules(cells(spark, [(r, "A", str(r)) for r in (2, 3, 4, 101)]), rules).orderBy("row_num").collect()
    assert [r["dv"] and (r["dv"]["type"], r["dv"]["op"], r["dv"]["f2"]) for r in got] == [
        ("Decimal", "Between", "2"), ("List", None, None), ("List", None, None), None,
    ]
    assert [r["cf"] and r["cf"]["v1"] for r in got] == [None, None, "7", None]


def test_covering_join_against_all_pairs(spark):
    import random

    r = random.Random(3)
    points = [(k, p) for k in "ab" for p in r.sample(range(1, 3000), 60)]
    spans = [(r.choice("ab"), i, lo, lo + r.choice([0, 1, 7, 200, 2500])) for i, lo in enumerate(r.sample(range(1, 2500), 50))]
    p = spark.createDataFrame(points, "k string, at int")
    s = spark.createDataFrame(spans, "k string, id int, lo int, hi int")
    got = {(x["k"], x["at"], x["id"]) for x in covering_join(p, s, ["k"], "at", "lo", "hi").collect()}
    assert got == {(k, at, i) for k, at in points for k2, i, lo, hi in spans if k == k2 and lo <= at <= hi}


def test_covering_join_on_two_axes(spark):
    import random

    r = random.Random(4)
    points = [(k, r.randrange(1, 400), r.randrange(1, 60)) for k in "ab" for _ in range(150)]
    spans = []
    for i in range(60):
        r1, c1 = r.choice([1, r.randrange(1, 400)]), r.randrange(1, 60)
        spans.append((r.choice("ab"), i, r1, r1 + r.choice([0, 3, 50, 1 << 20]), c1, c1 + r.choice([0, 0, 2, 30])))
    p, s = spark.createDataFrame(points, "k string, y int, x int"), spark.createDataFrame(spans, "k string, id int, r1 int, r2 int, c1 int, c2 int")
    got = [(f.k, f.y, f.x, f.id) for f in covering_join(p, s, ["k"], ["y", "x"], ["r1", "c1"], ["r2", "c2"]).collect()]
    assert sorted(got) == sorted((k, y, x, i) for k, y, x in points for k2, i, r1, r2, c1, c2 in spans if k == k2 and r1 <= y <= r2 and c1 <= x <= c2)


def test_disjoint_rectangles(spark):
    import random

    r, rows = random.Random(5), []
    for sheet in "abcdef":
        for _ in range(r.randint(1, 9)):
            r1, c1 = r.randrange(1, 12), r.randrange(1, 12)
            rows.append(("p", "prev", sheet, r1, c1, r1 + r.choice([0, 1, 4]), c1 + r.choice([0, 1, 6])))
    made = disjoint_rectangles(spark.createDataFrame(rows + rows[:2], "pair_id string, side string, sheet string, r1 int, c1 int, r2 int, c2 int")).collect()
    inside = lambda x: [(x[2], y, z) for y in range(x[3], x[5] + 1) for z in range(x[4], x[6] + 1)]
    got = [a for m in made for a in inside(m)]
    assert len(got) == len(set(got)) and set(got) == {a for x in rows for a in inside(x)}


def test_faulty_pairs_are_kept_apart(spark):
    """A bad entry on one side takes its pair out of extraction and leaves others alone."""
    config = '{"sheetName": "S", "sectionRows": ["1:2-2"]}'
    raw = spark.createDataFrame(
        [("good", "prev", config), ("bad", "prev", config), ("bad", "curr", '{"sheetName": "S", "sectionRows": ["1:2-2", "x"]}'), ("gone", "prev", config)],
        "pair_id string, side string, config string",
    )
    lay = layout.parse_layouts(raw, "risk")
    specs = layout.section_specs(lay)
    both = cells(spark, [(2, "C", "q")], pair="good").unionByName(cells(spark, [(2, "C", "q")], pair="bad"))
    assert [r["pair_id"] for r in extract_risk(both, lay, specs).collect()] == ["good"]
    assert [(r["pair_id"], r["side"]) for r in layout.layout_errors(lay, specs).collect()] == [("bad", "curr")]
    assert sorted((r["pair_id"], r["side"]) for r in layout.missing_sheets(lay, both).collect()) == [("bad", "curr"), ("gone", "prev")]


def _plans(monkeypatch, module):
    """The plans of everything that ``module`` stores, in order."""
    seen, store = [], module.cut_lineage

    def noted(df):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return store(df)

    monkeypatch.setattr(module, "cut_lineage", noted)
    return seen


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_extraction_broadcasts_no_table_that_grows(spark, tmp_path, monkeypatch):
    """Stored rules, layouts and sections have small files, however many rows; none goes through the driver."""
    seen = _plans(monkeypatch, extract)
    sheet = cells(spark, [(1, "C", "Head"), (2, "C", "Part"), (3, "C", "1.1) one"), (4, "C", "1.2) two")], sheet="Control Level Questions")
    laid = layouts(spark, "control", '{"chapterRows": [1], "sectionRows": ["2:3-4"]}')
    rules = spark.sql("SELECT 'p' pair_id, 'prev' side, 'Control Level Questions' sheet, 'dv' kind, 0 rule_ord, 0 range_ord, 1 r1, 3 c1, 9 r2, 3 c2, 'List' type, 'Between' op, 'a' v1, '' v2")
    stored = []
    for name, df in (("sheet", sheet), ("laid", laid), ("rules", rules)):
        df.write.parquet(str(tmp_path / name))
        stored.append(spark.read.parquet(str(tmp_path / name)))
    sheet, laid, rules = stored
    ruled = attach_rules(sheet, rules)
    found = extract_control(ruled, laid, layout.section_specs(laid))
    assert [(r.text, r.chapter, r.section) for r in found.orderBy("ord").collect()] == [("one", "Head", "Part"), ("two", "Head", "Part")]
    assert len(seen) == 2 and not any("Broadcast" in p for p in [*seen, _plan(ruled), _plan(found)])


def test_row_alignment_and_diff_broadcast_nothing(spark, tmp_path):
    from revdiff.operators import diff
    from revdiff.plans.corpus import row_alignment

    from helpers import question

    sides = []
    for name, rows in (("prev", [("p", 1, "one"), ("p", 2, "two")]), ("curr", [("p", 1, "One"), ("p", 3, "three")])):
        question(spark, rows).write.parquet(str(tmp_path / name))
        sides.append(spark.read.parquet(str(tmp_path / name)))
    d = diff.diff_records(*sides, row_alignment(*sides), diff.CONTROL_FLAGS)
    assert sorted(r.status for r in d.collect()) == ["added", "removed", "unchanged"]
    assert "Broadcast" not in _plan(d) and "Broadcast" not in _plan(diff.added_rows(sides[1], row_alignment(*sides)))
