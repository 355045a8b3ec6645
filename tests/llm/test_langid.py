import random
import zlib

from revdiff.llm import langid

from . import cases

WORDS = {"en": "the of and to with which have from", "de": "der die und nicht mit einer werden auf", "fr": "les des une dans pour avec être où"}


def labelled(n):
    rng = random.Random(1)
    return [(i, " ".join(rng.choices(WORDS[lang].split(), k=rng.randint(4, 30))), lang, "s") for i, lang in enumerate(rng.choices(list(WORDS), k=n))]


def test_held_out_accuracy(spark):
    rows = labelled(400)
    got = {r.doc_id: r for r in langid.identify(cases.documents(spark, rows)).collect()}
    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sorted(held) == sorted(i for i, r in got.items() if r.held_out)
    assert sum(got[i].lang_pred == rows[i][2] for i in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_labels_of_held_out_rows_and_other_columns_count_for_nothing(spark):
    rows = labelled(200)
    other = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 5 == 0 else lang, "t") for i, t, lang, _ in rows]
    a, b = (sorted(map(tuple, langid.identify(cases.documents(spark, x)).collect())) for x in (rows, other))
    assert a == b


def test_odd_rows(spark):
    docs = cases.documents(spark, cases.ODD)
    got = langid.identify(docs).collect()
    assert len(got) == len(cases.ODD)
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in got if r.doc_id in (1, 2, 3)) and all(r.held_out for r in got if r.doc_id is None)
    assert langid.identify(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identify(cases.documents(spark, [(1, "text without labels")])).collect()} == {"und"}
    kept = langid.keep_identified(docs, min_score=0.0)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {4, 5, 6, 7, 8, 9, 10, None}


def test_letters():
    assert langid.has_letter("1 ½ é") and not langid.has_letter("1 ½ ² _ 😀 ٣")


def test_identified_texts_go_to_python_in_small_batches(spark, monkeypatch):
    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    usual = spark.conf.get(name)
    frequencies = langid.document_frequencies
    monkeypatch.setattr(langid, "document_frequencies", lambda rows: seen.append(int(spark.conf.get(name))) or frequencies(rows))
    rows = [*labelled(300), (900, "12 34", "en", "s"), (901, "12 34", "en", "s"), (902, None, "en", "s")]
    docs = cases.documents(spark, rows + rows[:2])
    kept = langid.keep_identified(docs)
    judged = {r.doc_id: r for r in langid.identify(docs).collect()}
    want = sorted(i for i, *_ in rows + rows[:2] if judged[i].lang_pred != "und" and judged[i].score >= 0.5)
    assert sorted(r.doc_id for r in kept.collect()) == want
    assert max(seen) <= 1000 and spark.conf.get(name) == usual
    # what is written later, with batches of the usual size, sends no text to Python
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "MapInArrow" not in plan
