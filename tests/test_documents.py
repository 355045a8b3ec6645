"""The control-level chain over documents: what is stored and shuffled on the way, and what comes of it."""

import random

import numpy as np
import pandas as pd
from helpers import levenshtein, similarity

from revdiff.functions import edits
from revdiff.operators import extract, report
from revdiff.plans import catalog, corpus
from revdiff.sources import session

LINE = " the words of a line that is long enough to stay and be compared, number "


def documents(spark, tmp_path, rows=None):
    rows = rows or [(i, "\n".join([f"head {i}"] + [f"{i}{LINE}{k}" for k in range(i % 14)] + ["  "]), "en", f"src{i % 8}") for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _stored(monkeypatch, *modules):
    seen = []

    def noted(df, buckets=None):
        seen.append((df.columns, _plan(df), df.schema.simpleString()))
        return session.cut_lineage(df, buckets)

    for module in modules:
        monkeypatch.setattr(module, "cut_lineage", noted)
    return seen


def test_texts_are_shuffled_as_documents_only(spark, tmp_path, monkeypatch):
    seen = _stored(monkeypatch, corpus, extract)
    found = corpus.control_questions(spark, documents(spark, tmp_path))
    (rows,) = [plan for columns, plan, _ in seen if "text" in columns]
    exchanges = [line for line in rows.splitlines() if "Exchange" in line]
    assert exchanges and all("REPARTITION_BY_NUM" in line for line in exchanges)  # no join, window or grouping moves lines
    assert "Exchange" not in _plan(found)
    assert not [columns for columns, _, _ in seen if "original_text" in columns]
    got = found.filter("pair_id = '5' AND side = 'prev'").orderBy("ord").collect()
    assert [(r.row_num, r.text, r.chapter, r.section) for r in got] == [
        (3, "head 5", "Document in en from src5", "Part 1"), *[(4 + k, f"5{LINE}{k}", "Document in en from src5", "Part 1") for k in range(5)],
        (9, "", "Document in en from src5", "Part 1")]


def test_places_are_aligned_without_moving_texts(spark, tmp_path):
    prev, curr = corpus.split_sides(corpus.control_questions(spark, documents(spark, tmp_path)))
    out = corpus.row_alignment(prev, curr)
    assert "Exchange" not in _plan(out)
    old, new = ({(r.pair_id, r.ord): r.text for r in df.collect()} for df in (prev, curr))
    for r in out.collect():
        if r.n_ord is not None and r.o_ord is not None:
            assert r.similarity == similarity(old[r.pair_id, r.o_ord], new[r.pair_id, r.n_ord])
        else:
            assert r.similarity is None


def test_odd_documents(spark, tmp_path):
    """Null ids and texts, repeated rows and an empty table go through; repeated documents count once."""
    line = f"one{LINE}1"
    rows = [(None, line, "en", "a"), (1, None, "en", "a"), (2, line, None, None), (3, line, "en", "a"), (3, line, "en", "a"), (4, "", "en", "a")]
    d = catalog.control_flags(spark, documents(spark, tmp_path / "odd", rows)).collect()
    assert sorted((r.pair_id, r.n_ord, r.status) for r in d if r.pair_id == "3") == [("3", 3, "changed"), ("3", 4, "added")]
    assert {r.pair_id for r in d} == {"2", "3", "4"}
    none = documents(spark, tmp_path / "none", [(1, "x", "en", "a")])
    spark.read.parquet(f"{none}/documents.parquet").limit(0).write.parquet(str(tmp_path / "empty" / "documents.parquet"))
    assert catalog.control_sheet_breaks(spark, str(tmp_path / "empty")).count() == 0


def test_sheet_breaks_store_no_texts(spark, tmp_path, monkeypatch):
    path = documents(spark, tmp_path)
    places = catalog._control_places(spark, path)
    want = report.sheet_breaks(report.sheet_order(places, "previous")).select("pair_id", "row_num", "position", "chapter_break", "section_break")
    seen = _stored(monkeypatch, catalog)
    got = catalog.control_sheet_breaks(spark, path).filter("view = 'previous'").select(*want.columns)
    assert len(seen) == 1 and "text:" not in seen[0][2] and "section:" in seen[0][2]
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() > 40


def test_summary_scores_without_second_best(spark, tmp_path, monkeypatch):
    path, asked = documents(spark, tmp_path), []
    align = catalog.align_dealt

    def noted(questions, **more):
        asked.append((more.get("seconds"), _plan(align(questions, **more))))
        return align(questions, **more)

    monkeypatch.setattr(catalog, "align_dealt", noted)
    got = {tuple(r) for r in catalog.document_diff_summary(spark, path).collect()}
    ((seconds, plan),) = asked
    assert seconds is False and "Exchange" not in plan
    monkeypatch.undo()
    assert got == {tuple(r) for r in report.diff_summary(catalog._control_diff(spark, path)).collect()} and len(got) == 40


def test_large_documents_are_scored_in_tiles(spark, tmp_path):
    from revdiff.operators.align import align, align_dealt

    q = corpus.control_questions(spark, documents(spark, tmp_path), all_pairs=True)
    some = align_dealt(q, max_rows=6)
    assert sorted(map(repr, some.collect())) == sorted(map(repr, align(*corpus.split_sides(q)).collect()))


def test_pairs_of_rows_are_compared_side_by_side(monkeypatch):
    random.seed(5)
    some = ["".join(random.choices("abc é𝄞", k=random.randrange(90))) for _ in range(300)]
    other = [x[: len(x) // 2] + random.choice(some)[:20] for x in some]
    calls = []
    many = edits.some_distances
    monkeypatch.setattr(edits, "some_distances", lambda *a: calls.append(1) or many(*a))
    compare = edits.pair_distance.func
    got = compare(pd.Series([None, *some, "x" * 9000]), pd.Series(["a", *other, "x" * 8999 + "yy"]))
    assert got.isna().tolist() == [True] + [False] * 301
    assert got.tolist()[1:] == [levenshtein(x, y) for x, y in zip(some, other, strict=True)] + [2] and len(calls) == 1
    monkeypatch.setattr(edits, "_TOGETHER_CHARS", 500)
    assert np.array_equal(compare(pd.Series(some), pd.Series(other)), got.tolist()[1:-1]) and len(calls) > 10
