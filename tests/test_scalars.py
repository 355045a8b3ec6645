import pytest
from pyspark.sql import functions as F

from revdiff import functions as fn


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def dv(kind, op=None, f1=None, f2=None):
    return F.struct(*[F.lit(v).cast("string").alias(k) for k, v in zip(("type", "op", "f1", "f2"), (kind, op, f1, f2))])


def cf(kind, op=None, v1=None, v2=None):
    return F.struct(*[F.lit(v).cast("string").alias(k) for k, v in zip(("type", "op", "v1", "v2"), (kind, op, v1, v2))])


@pytest.mark.parametrize("a,b,want", [
    ("", "", 1.0), ("hello", "", 0.0), ("foo bar", "foo  bar", 1.0), ("Hello World", "hello world", 1.0),
    ("a\u00a0b", " A B ", 1.0), ("é", "e", 0.0), ("abcd", "abcx", 0.75),
])
def test_text_similarity(spark, a, b, want):
    assert one(spark, fn.text_similarity(F.lit(a), F.lit(b))) == want


@pytest.mark.parametrize("raw,number,rest", [
    ("3.5) Some text", "3.5", "Some text"), ("1.2 What is the risk?", "1.2", "What is the risk?"), ("Some text", None, "Some text"),
    ("10.3) Multi-digit prefix", "10.3", "Multi-digit prefix"), ("3.5  Two spaces after", "3.5", "Two spaces after"),
    ("\u00a07.1)\u00a0x ", "7.1", "x"), ("3) no minor", None, "3) no minor"),
])
def test_number_prefix(spark, raw, number, rest):
    assert one(spark, fn.extract_number(F.lit(raw))) == number
    assert one(spark, fn.strip_number_prefix(F.lit(raw))) == rest


@pytest.mark.parametrize("old,new,want", [
    (("Decimal", "GreaterThan", "0"), ("Decimal", "LessThan", "0"), True),
    (("List", None, '"Yes,No,N/A"'), ("List", None, '"N/A,Yes,No"'), False),
    (("List", None, '"Yes,No"'), ("List", "Between", '"Yes, No"', "9"), False),
    (("List", None, '"Yes,No"'), ("List", None, '"yes,No"'), True),
    (("List", None, '"A,A,B"'), ("List", None, '"A,B,B"'), True),
    (("List", None, "=$A$1"), ("List", None, "=$a$1"), False),
    (("List",), ("List", None, '"A"'), True),
    (("List",), ("List",), False),
    ((None,), (None,), False),
    ((None,), ("List", None, "x"), True),
    (("Date", "Between", "1", "2"), ("Date", "Between", "1", None), True),
    (("Date", "Between", "1", ""), ("Date", "Between", "1", None), True),
])
def test_dv_changed(spark, old, new, want):
    assert one(spark, fn.dv_changed(dv(*old), dv(*new))) is want


def test_dv_changed_missing_struct(spark):
    missing = F.lit(None).cast("struct<type:string,op:string,f1:string,f2:string>")
    assert one(spark, fn.dv_changed(missing, missing)) is False
    assert one(spark, fn.dv_changed(missing, dv("Date", "EqualTo", "1"))) is True


@pytest.mark.parametrize("old,new,want", [
    (("CellIs", "Equal", "1"), ("CellIs", "Equal", "1"), False), (("CellIs", "Equal", "1"), ("CellIs", "Equal", None), True),
    (("CellIs", "Equal", "1"), ("CellIs", "Equal", "1", "2"), True), ((None,), (None,), False), (("cellis",), ("CellIs",), True),
])
def test_cf_changed(spark, old, new, want):
    assert one(spark, fn.cf_changed(cf(*old), cf(*new))) is want


@pytest.mark.parametrize("rule,want", [
    (("Date", "GreaterThan", "45292"), "Date, greater than, 2024-01-01"),
    (("Time", "GreaterThan", "0.5"), "Time, greater than, 12:00:00"),
    (("Date", "EqualTo", "45458.3958333333"), "Date, equal to, 2024-06-15 09:30:00"),
    (("Date", "GreaterThan", "not-a-number"), "Date, greater than, not-a-number"),
    (("Date", "LessThan", "-1.25"), "Date, less than, 1899-12-29 06:00:00"), (("Date", "LessThan", "9e9"), "Date, less than, 9e9"),
    (("Time", "Between", "0.999999999", "0"), "Time, between, 00:00:00 and 00:00:00"),
    (("WholeNumber", "NotBetween", "1", "10"), "Whole number, not between, 1 and 10"),
    (("wholenumber", "EQUALTO", "1"), "Whole number, equal to, 1"),
    (("AnyValue",), "—"), ((None,), "—"), (("List",), "List"), (("List", None, '"A, B,,C"'), "List: A | B | C"),
    (("List", None, "=$A$1:$A$3"), "List: =$A$1:$A$3"), (("Custom", None, "=LEN(A1)>2"), "Custom: =LEN(A1)>2"),
    (("TextLength", None, None), "Text length, , "), (("Odd", "Weird", "1"), "Odd, Weird, 1"),
])
def test_dv_display(spark, rule, want):
    assert one(spark, fn.dv_display(dv(*rule))) == want


@pytest.mark.parametrize("rule,want", [
    ((None,), "—"), (("CellIs", "EqualOrGreaterThan", "5"), "greater than or equal to 5"),
    (("CellIs", "Between", "1", "2"), "between 1 and 2"), (("Expression", "Equal", "A1>2"), "Formula: A1>2"),
    (("ColorScale", "Equal"), "ColorScale"), (("CellIs", None, "5"), " 5"),
])
def test_cf_display(spark, rule, want):
    assert one(spark, fn.cf_display(cf(*rule))) == want


def test_addresses(spark):
    assert one(spark, fn.col_index(F.lit("AB"))) == 28
    assert one(spark, fn.address_row(F.lit("b12"))) == 12
    assert one(spark, fn.address_row(F.lit("nonsense"))) == 0
    assert one(spark, fn.address_col(F.lit("b12"))) == "B"
    tokens = one(spark, fn.range_tokens(F.lit(" B2:F40;; H2 ;x;A1:")))
    assert (tokens["good"], tokens["bad"]) == (["B2:F40", "H2"], ["x", "A1:"])


def test_display_values(spark):
    assert [one(spark, fn.similarity_band(F.lit(s))) for s in (0.8, 0.79, 0.6, 0.59)] == ["green", "amber", "amber", "red"]
    assert [one(spark, fn.similarity_pct(F.lit(s))) for s in (0.125, 0.494, 1.0)] == [13, 49, 100]
    assert one(spark, fn.ambiguous(F.lit(0.9), F.lit(0.85))) is True
    assert one(spark, fn.ambiguous(F.lit(0.9), F.lit(0.7))) is False
    assert one(spark, fn.ambiguous(F.lit(0.9), F.lit(None).cast("double"))) is False
    assert one(spark, fn.base_name(F.lit(r"C:\x\y.xlsx"))) == "y.xlsx"
    assert one(spark, fn.escape_html(F.lit('<a b="1">&'))) == "&lt;a b=&quot;1&quot;&gt;&amp;"
    assert one(spark, fn.cell_label(F.lit("D"), F.lit(2))) == "D[2]"


def test_text_similarity_of_long_texts(spark, monkeypatch):
    """Long texts take another way to the same number; the built-in ``levenshtein`` never sees them."""
    import random

    from pyspark.sql import functions as F

    from revdiff.functions import text

    r = random.Random(4)
    old = ["".join(r.choice("ab cdé語😀") for _ in range(r.choice([1, 40, 300, 900]))) for _ in range(40)]
    new = [a if r.random() < 0.1 else a[: len(a) // 2] + "x" + a[len(a) // 2 + r.choice([0, 3]) :][:: r.choice([1, -1])] for a in old]
    df = spark.createDataFrame([*zip(old, new), (None, "a" * 400), ("a" * 400, None), (None, None)], "a string, b string")
    got = [x[0] for x in df.select(text.text_similarity(F.col("a"), F.col("b"))).collect()]
    with monkeypatch.context() as m:
        m.setattr(text, "LONG_CELLS", 1 << 40)
        want = [x[0] for x in df.select(text.text_similarity(F.col("a"), F.col("b"))).collect()]
    assert got == want
    assert "pair_distance" in df.select(text.text_similarity(F.col("a"), F.col("b")))._jdf.queryExecution().executedPlan().toString()


def test_distance_tasks_follow_the_work(spark):
    from revdiff.sources.session import distance_tasks, task_slots

    assert distance_tasks(spark.createDataFrame([("a",), (None,)], "text string")) == task_slots(spark)
    assert distance_tasks(spark.range(300).selectExpr("repeat('a', 100000) text")) == 151


def test_revisions_are_compared_in_tasks_sized_by_work(spark):
    """Bytes would put all turns into one task, whatever their edit distances cost."""
    from revdiff.plans.catalog import text_similarity

    plan = text_similarity(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning(pair_id" in x]
    assert len(dealt) == 2 and all("REPARTITION_BY_NUM" in x for x in dealt) and "Broadcast" not in plan
