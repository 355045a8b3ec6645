import hashlib
import string

from revdiff.llm import exact_dedup
from revdiff.llm.exact_dedup import DigestIndex, digest_rows

from . import cases

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def digest(text):
    return hashlib.sha256((text or "").translate(LOWER).encode()).hexdigest()


def check(rows, got):
    """Every row of ``rows`` is in ``got``, with the largest id of its text and one row kept."""
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(digest(text), []).append(doc_id)
    largest = {d: max((i for i in ids if i is not None), default=None) for d, ids in groups.items()}
    want = sorted((str(i), str(largest[digest(t)]), len(groups[digest(t)]), digest(t)) for i, t in rows)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    kept = [(r.text_sha256, r.doc_id) for r in got if r.kept]
    assert sorted(kept, key=str) == sorted(largest.items(), key=str)


def test_rows_of_equal_texts(spark):
    rows = [(r[0], r[1]) for r in cases.ODD] + [(20 + i, "One TEXT\nÄÖÉ İ") for i in range(50)] + [(90, "one text\nÄÖÉ İ"), (91, "one text\näöé İ"), (92, "one text \nÄÖÉ İ")]
    rows += [(i, cases.LONG.upper()) for i in (99, 97, 98)]
    check(rows, exact_dedup.exact_dedup(cases.documents(spark, rows)).collect())
    assert exact_dedup.exact_dedup(cases.documents(spark, rows).limit(0)).count() == 0


def test_ids_that_are_not_numbers(spark):
    docs = spark.createDataFrame([("b", "x"), ("a", "X"), (None, "x"), ("c", "y")], "doc_id string, text string")
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs).collect()}
    assert got == {("b", "b", 3, True), ("a", "b", 3, False), (None, "b", 3, False), ("c", "c", 1, True)}


def test_new_data_meets_the_index(spark, tmp_path):
    path = str(tmp_path / "index")
    first = cases.documents(spark, [(i, f"text {i % 7}") for i in range(40)])
    again = cases.documents(spark, [(100 + i, f"Text {i}") for i in range(10)])
    exact_dedup.exact_dedup(first, DigestIndex(spark, path, 4))
    index = DigestIndex(spark, path, 4)  # found again, as in a new session
    assert index.table().count() == 7
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(again, index).collect()}
    assert got == {100 + i: ((max(k for k in range(40) if k % 7 == i), 1, False) if i < 7 else (100 + i, 1, True)) for i in range(10)}
    assert index.table().count() == 10
    exact_dedup.exact_dedup(again, index)  # repeated: nothing new
    assert index.table().count() == 10
    whole = index.compacted(str(tmp_path / "whole"))
    assert sorted(whole.table().collect()) == sorted(index.table().collect())
    assert len(list((tmp_path / "whole").glob("part-*.parquet"))) <= 4


def test_files_are_bucketed_and_sorted_and_the_index_is_not_shuffled(spark, tmp_path):
    index = DigestIndex(spark, str(tmp_path / "index"), 4)
    rows = digest_rows(cases.documents(spark, [(i, f"text {i}") for i in range(500)]))
    index.add(rows)
    files = sorted((tmp_path / "index").glob("part-*.parquet"))
    assert len(files) == 4
    for f in files:
        digests = [bytes(r.digest) for r in spark.read.parquet(str(f)).collect()]
        assert digests == sorted(digests)
    plan = index.unknown(rows)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan and "Bucketed: true" in plan
    assert plan.count("Exchange hashpartitioning") == 1  # of the new digests alone
