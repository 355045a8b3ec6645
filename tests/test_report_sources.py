import io
import itertools
import json
import random
import tracemalloc
import zipfile

import pyarrow as pa
from helpers import RULE_CF, RULE_DV, question
from pyspark.sql import functions as F

from revdiff.functions.address import address_col, address_row
from revdiff.operators import diff, ordering, report
from revdiff.operators.align import align
from revdiff.sources.session import cut_lineage
from revdiff.sources import workbook as books
from revdiff.sources.sinks import read_documents, write_documents, write_documents_together, write_tables
from revdiff.sources.workbook import ingest_cells


def cell_table(spark, rows):
    """Rows ``(address, text[, dv type, dv f1])`` keyed by address."""
    full = [("p", a, t, {"type": k, "op": None, "f1": f, "f2": None} if k else None) for a, t, k, f in ((*r, *([None] * (4 - len(r)))) for r in rows)]
    return spark.createDataFrame(full, f"pair_id string, address string, text string, dv {RULE_DV}").withColumn("cf", F.lit(None).cast(RULE_CF))


def test_cell_diff(spark):
    old = cell_table(spark, [("A1", "old"), ("B2", "x", "List", '"Yes,No"'), ("C3", " same "), ("D4", "Case"), ("E5", "")])
    new = cell_table(spark, [("A1", "new"), ("B2", "x", "List", '"Yes,No,N/A"'), ("C3", "same"), ("D4", "case"), ("F6", None), ("G7", "y")])
    value = {r["address"]: r for r in diff.diff_cells(old, new, ["pair_id", "address"], "value").collect()}
    full = {r["address"]: r for r in diff.diff_cells(old, new, ["pair_id", "address"]).collect()}
    assert {a for a, r in value.items() if r["status"] == "changed"} == {"A1", "D4", "G7"}
    assert {a for a, r in full.items() if r["status"] == "changed"} == {"A1", "B2", "D4", "G7"}
    assert full["B2"]["dv_changed"] and not full["B2"]["text_changed"] and len(full) == 7


def test_duplicate_cell_key_is_marked(spark):
    """One bad key is reported as an error; the rest of the corpus is still compared."""
    old, new = cell_table(spark, [("A1", "x"), ("A1", "y"), ("B1", "z")]), cell_table(spark, [("A1", "x"), ("B1", "z")])
    got = {r["address"]: r["status"] for r in diff.diff_cells(old, new, ["pair_id", "address"]).collect()}
    assert got == {"A1": "error", "B1": "unchanged"}


def test_question_cell_changes(spark):
    schema = f"pair_id string, ord bigint, kind string, row_offset int, col string, text string, dv {RULE_DV}, cf {RULE_CF}"
    rows = lambda items: spark.createDataFrame([("p", 1, k, o, c, t, None, None) for k, o, c, t in items], schema)
    old = rows([("answer", 1, "D", "same"), ("answer", 0, "D", "a"), ("answer", 1, "E", "gone"), ("explanation", 0, "G", "why")])
    new = rows([("answer", 1, "D", "same"), ("answer", 0, "D", "b"), ("answer", 1, "F", "come"), ("explanation", 0, "G", "why")])
    matches = spark.createDataFrame([("p", 1, 1)], "pair_id string, n_ord bigint, o_ord bigint")
    got = diff.question_cell_changes(old, new, matches, "answer").orderBy("row_offset", "col").collect()
    assert [(r["row_offset"], r["col"], r["prev"] and r["prev"]["text"], r["curr"] and r["curr"]["text"]) for r in got] == [
        (0, "D", "a", "b"), (1, "E", "gone", None), (1, "F", None, "come"),
    ]
    none = diff.question_cell_changes(old, new, matches, "explanation")
    flags = diff.cells_changed_flags(diff.question_cell_changes(old, new, matches, "answer"), none).first()
    assert none.count() == 0 and flags["answer_cells_changed"] and not flags["explanation_cells_changed"]


def test_ordering_against_plain_loops(spark):
    r = random.Random(4)
    rows = [(k, o, r.choice(["h", "r", "r"]), r.choice(["", "c1", "c2"]), r.choice(["s1", "s2"])) for k in "abc" for o in r.sample(range(5000), 200)]
    df = cut_lineage(spark.createDataFrame(rows, "k string, o bigint, what string, chapter string, section string"))
    asof = ordering.asof_last(df, ["k"], "o", F.col("what") == "h", F.col("o"), "h", 50)
    heads = ordering.headings(df, ["k"], "o", F.col("section"), F.nullif("chapter", F.lit("")), 50)
    numbered = ordering.ordinal(df, ["k"], "o", "n", 50)
    by_key = {k: sorted(x for x in rows if x[0] == k) for k in "abc"}
    for x in asof.collect():
        assert x["h"] == max((o for _, o, w, _, _ in by_key[x["k"]] if w == "h" and o <= x["o"]), default=None)
    for x in numbered.collect():
        assert x["n"] == 1 + sum(o < x["o"] for _, o, *_ in by_key[x["k"]])
    for x in heads.collect():
        before = [y for y in by_key[x["k"]] if y[1] < x["o"]]
        assert x["position"] == len(before) + 1
        assert (x["above"] and x["above"]["v"]) == (before[-1][4] if before else None)
        assert x["last_chapter"] == next((y[3] for y in reversed(before) if y[3]), None)


def _diffed(spark):
    prev = question(spark, [("p", 1, "alpha beta gamma", "S1"), ("p", 2, "to be removed", "S1"), ("p", 3, "delta epsilon zeta", "S2")])
    curr = question(spark, [("p", 1, "alpha beta gammas", "S2"), ("p", 2, "something else entirely 42", "S2"), ("p", 3, "delta epsilon zeta", "S2")])
    with_chapter = [t.withColumn("chapter", F.when(F.col("ord") == 3, "C").otherwise("")) for t in (prev, curr)]
    return cut_lineage(diff.diff_records(*with_chapter, align(*with_chapter), diff.CONTROL_FLAGS))


def test_report_tables(spark):
    d = _diffed(spark)
    assert report.diff_summary(d).first().asDict() == {"pair_id": "p", "added": 1, "removed": 1, "changed": 1, "unchanged": 1, "compared": 3}
    current = report.sheet_breaks(report.sheet_order(d, "current")).orderBy("position").collect()
    assert [(r["status"], r["section"], r["text"]) for r in current] == [
        ("changed", "S1", "alpha beta gammas"), ("added", "S2", "something else entirely 42"), ("unchanged", "S2", "delta epsilon zeta"),
    ]
    assert [(r["chapter_break"], r["section_break"]) for r in current] == [(False, True), (False, True), (True, True)]
    previous = report.sheet_order(d, "previous").orderBy("row_num").collect()
    assert [r["status"] for r in previous] == ["changed", "removed", "unchanged"]
    assert report.badges(d.filter("status = 'changed'")).first()["badges"] == ["T"]
    found = report.search_rows(report.sheet_order(d, "current"), ["text", "section"], " GAMMAS s2 ")
    assert found.count() == 0 and report.search_rows(report.sheet_order(d, "current"), ["text", "section"], " GAMMAS s1 ").count() == 1


def test_report_payload(spark):
    payload = report.report_payload(_diffed(spark))
    parts = {r["status"]: json.loads(r["payload"]) for r in payload.collect()}
    assert parts["added"] == [
        {"questionNumber": None, "chapter": "", "section": "S2", "rowNumber": 2, "questionText": "something else entirely 42", "dvDisplay": "—", "cfDisplay": "—"}
    ]
    changed = parts["changed"][0]
    assert changed["oldText"] == "alpha beta gamma" and changed["newText"] == "alpha beta gammas" and changed["section"] == "S1"
    assert changed["textChanged"] is True and changed["dvChanged"] is False and "questionText" not in changed
    assert changed["oldExplanation"] is None and changed["explanationChanged"] is False and changed["previousNumber"] is None
    assert parts["unchanged"][0]["similarityScore"] == 1.0 and parts["unchanged"][0]["previousRowNumber"] == 3


def test_documents(spark, tmp_path):
    """One document per block, whatever the size of its texts; empty buckets and null fields are there."""
    long_ = "é\n" * 1_100_000
    curr = question(spark, [("p", i, f"{i}" * 3) for i in range(1, 24)] + [("big/one", 1, long_), ("big/one", 2, "short")])
    prev = question(spark, [("q", 1, "gone")])
    d = cut_lineage(diff.diff_records(prev, curr, align(prev, curr), diff.RISK_FLAGS[:1]))
    blocks = spark.createDataFrame([(p, None, 'say "hi"') for p in ("p", "q", "big/one", "nothing")], "pair_id string, previousWorkbookPath string, title string")
    for part_bytes in (300, 1 << 20):
        path = str(tmp_path / f"out{part_bytes}")
        write_documents(report.document_lines(blocks, report.report_entries(d), report.STATUSES, part_bytes), path)
        read = {r.pair_id: json.loads(r.value) for r in spark.read.text(path, wholetext=True).collect()}
        assert set(read) == {"p", "q", "big/one", "nothing"}
        assert read["nothing"] == {"previousWorkbookPath": None, "title": 'say "hi"', "added": [], "removed": [], "changed": [], "unchanged": []}
        assert [e["rowNumber"] for e in read["p"]["added"]] == list(range(1, 24))
        assert read["q"]["removed"][0]["questionText"] == "gone" and read["q"]["added"] == []
        assert [e["questionText"] for e in read["big/one"]["added"]] == [long_, "short"]


def test_small_documents_share_files(spark, tmp_path):
    """Many small blocks make few files; a large one has a file of its own; all are read back whole."""
    texts = {f"{i:03d}": f'text "{i}"\n\té' for i in range(60)} | {"007/x y": "long " * 400}
    curr = question(spark, [(p, 1, t) for p, t in texts.items()])
    d = cut_lineage(diff.diff_records(question(spark, []), curr, align(question(spark, []), curr), diff.RISK_FLAGS[:1]))
    blocks = spark.createDataFrame([(p, f"of {p}") for p in [*texts, "nothing"]], "pair_id string, title string")
    path = str(tmp_path / "out")
    assert write_documents_together(report.document_lines(blocks, report.report_entries(d), report.STATUSES), path, 1500)
    schema = "title string, added array<struct<questionText string>>, removed array<struct<questionText string>>"
    read = {r.pair_id: r.document for r in read_documents(spark, path, schema, True).collect()}
    assert set(read) == {*texts, "nothing"} and all(read[p].title == f"of {p}" and read[p].removed == [] for p in read)
    assert {p: [e.questionText for e in read[p].added] for p in texts} == {p: [t] for p, t in texts.items()} and read["nothing"].added == []
    files = [f for f in (tmp_path / "out").rglob("part-*")]
    assert len([f for f in files if "single" in f.parts]) == 1 and len(files) < 30


def test_cell_documents(spark, tmp_path):
    cell = f"pair_id string, address string, text string, dv {RULE_DV}, cf {RULE_CF}"
    prev = spark.createDataFrame([("p", "B2", "x", None, None), ("p", "AA1", "y", None, None), ("p", "C2", "z", None, None)], cell)
    curr = spark.createDataFrame([("p", "B2", "x", None, None), ("p", "C2", None, None, None), ("p", "B1", "n", None, None)], cell)
    d = diff.diff_cells(prev, curr, ["pair_id", "address"])
    d = d.withColumns({"col": address_col(F.col("address")), "row_num": address_row(F.col("address"))})
    blocks = spark.createDataFrame([("p", "t")], "pair_id string, title string")
    write_documents(report.document_lines(blocks, report.cell_entries(d), ["changed", "unchanged"]), str(tmp_path / "cells"))
    (row,) = spark.read.text(str(tmp_path / "cells"), wholetext=True).collect()
    read = json.loads(row.value)
    assert [c["address"] for c in read["changed"]] == ["B1", "AA1", "C2"]
    assert read["changed"][0]["file1Value"] is None and read["changed"][0]["file2Value"] == "n" and read["changed"][0]["dvChanged"] is False
    assert read["unchanged"] == [{"address": "B2", "column": "B", "row": 2, "value": "x", "dvDisplay": "—", "cfDisplay": "—"}]


def test_general_payload_nests_cells(spark):
    schema = f"pair_id string, side string, ord bigint, kind string, row_offset int, col string, col_ord int, text string, dv {RULE_DV}, cf {RULE_CF}"
    rows = []
    for side, texts in (("prev", ["x", "y", "gone"]), ("curr", ["x", "z", None])):
        places = [(1, "D", 1), (0, "F", 3), (0, "E", 2)]
        rows += [("p", side, 1, "answer", o, c, k, t, None, None) for (o, c, k), t in zip(places, texts) if t]
        rows.append(("p", side, 1, "explanation", 0, "G", 0, "why", None, None))
    cells = spark.createDataFrame(rows, schema)
    base = spark.createDataFrame([("p", s, 1, "S", "1", "text", 5, ["1", ""]) for s in ("prev", "curr")],
                                 "pair_id string, side string, ord bigint, section string, number string, text string, row_num int, row_labels array<string>")
    nested = cut_lineage(report.nest_cells(base, cells))
    sides = [nested.filter(F.col("side") == s) for s in ("prev", "curr")]
    assert [(c["rowOffset"], c["column"]) for c in sides[0].first()["answer_cells"]] == [(0, "E"), (0, "F"), (1, "D")]
    alignment = align(*sides)
    changes = [diff.question_cell_changes(*[cells.filter(F.col("side") == s) for s in ("prev", "curr")], alignment, k) for k in ("answer", "explanation")]
    d = diff.diff_records(*sides, alignment, diff.GENERAL_FLAGS, diff.cells_changed_flags(*changes))
    entry = json.loads(report.report_payload(cut_lineage(report.nest_changes(d, *changes))).first()["payload"])[0]
    assert [(c["rowOffset"], c["column"], c.get("oldText"), c.get("newText")) for c in entry["answerCellChanges"]] == [
        (0, "E", "gone", None), (0, "F", "y", "z"),
    ]
    assert entry["explanationCellChanges"] == [] and entry["answerCellsChanged"] and not entry["explanationCellsChanged"]


def test_payload_parts_keep_order(spark):
    curr = question(spark, [("p", i, f"{i}" * 3) for i in range(1, 24)])
    prev = question(spark, [])
    d = cut_lineage(diff.diff_records(prev, curr, align(prev, curr), diff.CONTROL_FLAGS))
    parts = report.report_payload(d, part_bytes=500).orderBy("part").collect()
    assert len(parts) > 3 and all(r.entries > 1 for r in parts[:-1]) and max(len(r.payload) for r in parts) < 800
    assert [e["rowNumber"] for r in parts for e in json.loads(r["payload"])] == list(range(1, 24))


def _common(a, b):
    """Length of a longest common subsequence."""
    line = [0] * (len(b) + 1)
    for x in a:
        line = list(itertools.accumulate([0, *(max(line[j + 1], line[j] + (x == y)) for j, y in enumerate(b))], max))
    return line[-1]


def check_ops(old, new, ops):
    """The kept words are a longest common subsequence, and of all the one that the tie rule gives: each new
    word added from the end on could not be kept, or the same length is reached without it."""
    kept_old, kept_new = ([w for w, o in zip(ws, own) if o == "eq"] for ws, own in zip((old, new), ops))
    assert kept_old == kept_new and len(kept_old) == _common(old, new)
    assert set(ops[0]) <= {"eq", "del"} and set(ops[1]) <= {"eq", "add"}
    i, j = len(old), len(new)
    while i and j:
        if old[i - 1] == new[j - 1]:
            assert ops[0][i - 1] == ops[1][j - 1] == "eq"
            i, j = i - 1, j - 1
        elif ops[1][j - 1] == "add":
            assert _common(old[:i], new[: j - 1]) == _common(old[:i], new[:j])
            j -= 1
        else:
            assert ops[0][i - 1] == "del" and _common(old[:i], new[: j - 1]) < _common(old[:i], new[:j])
            i -= 1


def test_word_diff(spark):
    r = random.Random(9)
    texts = [(str(i), " ".join(r.choice("abcD") for _ in range(r.randint(0, 14))), " ".join(r.choice("abcd") for _ in range(r.randint(0, 14)))) for i in range(80)]
    rows = report.word_diff(spark.createDataFrame(texts, "k string, a string, b string"), ["k"], "a", "b").collect()
    for k, a, b in texts:
        ops = []
        for side, words in (("old", a.split()), ("new", b.split())):
            mine = sorted((x["pos"], x["op"], x["word"]) for x in rows if x["k"] == k and x["side"] == side)
            assert [(i, w) for i, _, w in mine] == list(enumerate(words))
            ops.append([o for _, o, _ in mine])
        check_ops(a.split(), b.split(), ops)


def test_word_diff_in_stretches(monkeypatch):
    """However often the way back is cut, it is the same way."""
    r = random.Random(10)
    for _ in range(60):
        a, b = ([r.choice("abcde") for _ in range(r.randint(0, 70))] for _ in range(2))
        whole = report._word_ops(a, b)
        for bits, rows in ((1, 2), (60, 3), (500, 64)):
            monkeypatch.setattr(report, "STEP_BITS", bits)
            monkeypatch.setattr(report, "KEPT_ROWS", rows)
            assert report._word_ops(a, b) == whole
        monkeypatch.undo()


def test_word_diff_steps_are_bits():
    """Each old word updates the best row of the whole new text at once: words kept rise by one at most."""
    r = random.Random(12)
    for _ in range(100):
        a, b = ([r.choice("abcd") for _ in range(r.randint(0, 20))] for _ in range(2))
        steps, marks = (1 << len(b)) - 1, report._marks(b, set(a))
        for i, word in enumerate(a, 1):
            steps = report._next_steps(steps, marks(word))
            assert [(steps >> j) & 1 for j in range(len(b))] == [1 - (_common(a[:i], b[: j + 1]) - _common(a[:i], b[:j])) for j in range(len(b))]


def test_word_diff_of_long_texts():
    r = random.Random(11)
    a = [r.choice("abcdefghij") + str(r.randrange(300)) for _ in range(12_000)]
    b = [w for w in a if r.random() < 0.9] + a[:3000]
    tracemalloc.start()
    ops = report._word_ops(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    kept = [w for w, o in zip(a, ops[0]) if o == "eq"]
    assert kept == [w for w, o in zip(b, ops[1]) if o == "eq"] and len(kept) >= len(b) - 3000 and peak < 60 << 20


def test_write_tables(spark, tmp_path):
    path = str(tmp_path / "book")
    many = spark.range(3000).withColumn("id", F.col("id") * 7 % 3000).repartition(7)
    tables = {"one": many, "two": spark.createDataFrame([("x", None)], "a string, b string"), "none": spark.range(0)}
    for _ in range(2):
        write_tables(tables, {"one": ["id"], "two": ["a"], "none": ["id"]}, path)
    back = spark.read.parquet(path)
    one = back.filter("sheet = 'one'").orderBy("row_key").collect()
    assert [r.row_key for r in one] == list(range(1, 3001)) and [r["values"][0] for r in one] == [str(i) for i in range(3000)]
    assert back.filter("sheet = 'two'").first()["values"] == ["x", ""] and back.filter("sheet = 'none'").count() == 0
    for f in (tmp_path / "book" / "sheet=one").glob("part-*"):
        keys = [r.row_key for r in spark.read.parquet(str(f)).collect()]
        assert keys == list(range(keys[0], keys[0] + len(keys)))  # a file is a stretch of the sheet


MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def workbook(sheet_xml, strings=""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets><sheet name="Data" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/worksheets/s.xml", f'<worksheet xmlns="{MAIN}">{sheet_xml}</worksheet>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">{strings}</sst>')
    return out.getvalue()


def test_ingest_workbooks(spark, tmp_path):
    sheet = (
        '<sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="AB1"><v>4.5</v></c><c r="C1" t="b"><v>1</v></c></row>'
        '<row r="2"><c r="A2" t="inlineStr"><is><t>in &amp; line</t></is></c><c r="B2"/><c r="C2" t="str"><f>A1</f><v>calc</v></c></row></sheetData>'
        '<conditionalFormatting sqref="A1:A2 C:C"><cfRule type="cellIs" operator="greaterThanOrEqual"><formula>5</formula></cfRule></conditionalFormatting>'
        '<dataValidations><dataValidation type="list" sqref="A1"><formula1>"Yes,No"</formula1></dataValidation>'
        '<dataValidation type="whole" operator="notBetween" sqref="B1:B9 D4"><formula1>1</formula1><formula2>9</formula2></dataValidation></dataValidations>'
    )
    strings = "<si><r><t>rich </t></r><r><t>text</t></r><rPh><t>no</t></rPh></si>"
    (tmp_path / "p1.prev.xlsx").write_bytes(workbook(sheet, strings))
    (tmp_path / "p1.curr.xlsx").write_bytes(b"not a zip archive")
    cells, rules, errors = ingest_cells(spark, str(tmp_path))
    got = {(r["row_num"], r["col"]): r["text"] for r in cells.collect()}
    assert got == {(1, "A"): "rich text", (1, "AB"): "4.5", (1, "C"): "TRUE", (2, "A"): "in & line", (2, "B"): "", (2, "C"): "calc"}
    assert cells.filter("col = 'AB'").first()["col_idx"] == 28 and cells.first()["pair_id"] == "p1"
    listed = {(r["kind"], r["rule_ord"], r["range_ord"]): r for r in rules.collect()}
    assert listed["dv", 0, 0]["type"] == "List" and listed["dv", 0, 0]["v1"] == '"Yes,No"'
    assert (listed["dv", 1, 0]["op"], listed["dv", 1, 0]["v2"], listed["dv", 1, 1]["r1"]) == ("NotBetween", "9", 4)
    assert (listed["cf", 0, 0]["op"], listed["cf", 0, 1]["r2"], listed["cf", 0, 1]["c1"]) == ("EqualOrGreaterThan", 1 << 20, 3)
    assert [r["path"].split("/")[-1] for r in errors.collect()] == ["p1.curr.xlsx"]


def test_other_workbooks(spark, tmp_path):
    """The strict namespace, cells without places, odd names and workbooks without sheets."""
    strict = "http://purl.oclc.org/ooxml/spreadsheetml/main"
    sheet = '<sheetData><row><c t="str"><v>a</v></c><c r="D1"><v>1</v></c><c><v>2</v></c></row><row r="5"><c><v>3</v></c></row><row><c r="B6"><v>4</v></c></row></sheetData>'
    made = workbook(sheet)
    (tmp_path / "p.curr.xlsx").write_bytes(made)
    for name, old, new in (("s.prev.xlsx", MAIN, strict), ("none.prev.xlsx", "<sheet ", "<other ")):
        out = io.BytesIO()
        with zipfile.ZipFile(io.BytesIO(made)) as a, zipfile.ZipFile(out, "w") as b:
            for part in a.namelist():
                b.writestr(part, a.read(part).decode().replace(old, new) if name[0] == "s" or part == "xl/workbook.xml" else a.read(part))
        (tmp_path / name).write_bytes(out.getvalue())
    (tmp_path / "report.xlsx").write_bytes(made)
    cells, _, errors = ingest_cells(spark, str(tmp_path))
    want = [("A", 1, "a"), ("B", 6, "4"), ("A", 5, "3"), ("D", 1, "1"), ("E", 1, "2")]
    got = [(r.pair_id, r.col, r.row_num, r.text) for r in cells.collect()]
    assert sorted(got) == sorted((p, *w) for p in ("p", "s") for w in want)
    assert sorted((r.path.rpartition("/")[2], r.error) for r in errors.collect()) == [
        ("none.prev.xlsx", "ValueError: the workbook has no sheet"), ("report.xlsx", "ValueError: file name is not <pair>.<prev|curr>.xlsx"),
    ]


def test_workbook_tasks_hand_on_a_little_at_a_time(monkeypatch):
    """However many sheets a batch holds and however long their texts are, what is handed on is small, and whole."""
    monkeypatch.setattr(books, "_BATCH_BYTES", 5000)
    texts = {f"{i}": [f"{i} " + "long " * 150 for _ in range(4)] for i in range(40)}
    xml = lambda ts: "<sheetData>" + "".join(f'<row><c t="inlineStr"><is><t>{t}</t></is></c></row>' for t in ts) + "</sheetData>"
    sheets = pa.RecordBatch.from_pylist([{"pair_id": p, "side": "prev", "sheet": "S", "xml": xml(ts)} for p, ts in texts.items()])
    files = list(books._pack(iter([sheets])))
    assert len(files) > 3 and all(f.num_rows < 40 for f in files)
    rows = list(books._parse(iter(files)))
    assert all(sum(len(t) for t in r.column("text").to_pylist()) < 6000 for r in rows)
    got = [(r["path"], r["text"].strip()) for batch in rows for r in batch.to_pylist()]
    assert got == [(f"{p}.prev.xlsx", t.strip()) for p, ts in texts.items() for t in ts]
    (one,) = books._pack(iter([pa.RecordBatch.from_pylist([{"pair_id": "x", "side": "curr", "sheet": "S", "xml": xml(["a" * 3000] * 9)}])]))
    assert [b.num_rows for b in books._parse(iter([one]))] == [2, 2, 2, 2, 1]
