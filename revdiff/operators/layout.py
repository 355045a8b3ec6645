"""Layout configurations: which rows of a sheet are sections and questions.

A bad entry never stops the job. It yields a row with ``error`` set, and callers keep
such pairs apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revdiff.functions.text import trim_ws
from revdiff.sources.session import shuffled

# Defaults of the three layout kinds.
DEFAULTS = {
    "control": {"sheetName": "Control Level Questions", "textColumn": "C", "inputColumn": "D"},
    "risk": {
        "sheetName": "Risk Level Questions", "numberColumn": "B", "textColumn": "C",
        "answerColumn": "D", "explanationColumn": "E",
    },
    "general": {
        "sheetName": "General Data", "numberColumn": "B", "textColumn": "C",
        "answerColumns": ["D", "E", "F"], "explanationColumn": "G",
    },
}
KEY = ["pair_id", "side"]


def read_layouts(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Layout files, one JSON object per file, named ``<pair_id>.<side>.json``. A file with another
    name is a pair of its own, under its whole name, with an error."""
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    parts = r"^(.+)\.(prev|curr)\.json$"
    known = name.rlike(parts)
    raw = spark.read.text(path, wholetext=True).select(
        F.when(known, F.regexp_extract(name, parts, 1)).otherwise(name).alias("pair_id"),
        F.when(known, F.regexp_extract(name, parts, 2)).otherwise("").alias("side"),
        F.col("value").alias("config"), F.when(~known, F.lit("file name is not <pair>.<prev|curr>.json")).alias("fault"),
    )
    return parse_layouts(raw, kind)


def parse_layouts(raw: DataFrame, kind: str) -> DataFrame:
    """``raw(pair_id, side, config[, fault])`` to one row per layout; property names ignore case.

    An absent or null field takes its default. One that is there but is no list of the right kind
    is an error, as is a config that is no JSON object."""
    fault = F.col("fault") if "fault" in raw.columns else F.lit(None).cast("string")
    raw = raw.select(*KEY, F.from_json("config", "map<string,string>").alias("fields"), fault.alias("fault"))  # parse once
    fields = F.col("fields")
    defaults = DEFAULTS[kind]

    def value(name: str) -> Column:
        hits = F.filter(F.map_entries(fields), lambda e: F.lower(e["key"]) == name.lower())
        return F.try_element_at(hits, F.lit(-1))["value"]

    def word(name: str) -> Column:
        found = F.coalesce(value(name), F.lit(defaults.get(name)).cast("string"))
        return found if name == "sheetName" else F.upper(found)

    def wrong(name: str, kind: str, what: str) -> Column:
        items = F.from_json(value(name), f"array<{kind}>")
        bad = value(name).isNotNull() & (items.isNull() | F.exists(items, lambda x: x.isNull()))
        return F.when(bad, F.lit(f"{name} is not a list of {what}"))

    faults = [("answerColumns", "string", "texts"), ("chapterRows", "int", "whole numbers"), ("sectionRows", "string", "texts")]
    answers = F.transform(
        F.coalesce(
            F.from_json(value("answerColumns"), "array<string>"),
            F.array(*[F.lit(c) for c in defaults.get("answerColumns", [])]).cast("array<string>"),
        ),
        F.upper,
    )
    return raw.select(
        *KEY,
        word("sheetName").alias("sheet"),
        word("textColumn").alias("text_col"),
        F.coalesce(word("inputColumn"), word("answerColumn")).alias("input_col"),
        word("numberColumn").alias("number_col"),
        word("explanationColumn").alias("explanation_col"),
        answers.alias("answer_cols"),
        F.coalesce(F.from_json(value("chapterRows"), "array<int>"), F.array().cast("array<int>")).alias("chapter_rows"),
        F.coalesce(F.from_json(value("sectionRows"), "array<string>"), F.array().cast("array<string>")).alias("specs"),
        F.coalesce(
            F.col("fault"), F.when(fields.isNull(), F.lit("config is not a JSON object")), *(wrong(*x) for x in faults)
        ).alias("error"),
    )


def _positive(c: Column) -> Column:
    """Integer with optional sign and surrounding blanks, above zero; else null."""
    number = F.when(c.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(c).try_cast("int"))
    return F.when(number > 0, number)


def section_specs(layouts: DataFrame) -> DataFrame:
    """Entries ``"<sectionRow>:<first>-<last>"`` to ``sec_ord, section_row, first_row, last_row, error``."""
    spec = F.col("spec")
    colon = F.instr(spec, ":")
    tail = F.expr("substring(spec, instr(spec, ':') + 1)")
    dash = F.instr(tail, "-")
    parsed = layouts.select(*KEY, F.posexplode("specs").alias("sec_ord", "spec")).select(
        *KEY, "sec_ord", "spec",
        ((colon > 1) & (dash > 0)).alias("_shape"),
        _positive(F.substring_index(spec, ":", 1)).alias("section_row"),
        _positive(F.substring_index(tail, "-", 1)).alias("first_row"),
        _positive(F.expr("substring(substring(spec, instr(spec, ':') + 1), instr(substring(spec, instr(spec, ':') + 1), '-') + 1)")).alias("last_row"),
    )
    error = (
        F.when(~F.col("_shape"), "format")
        .when(F.col("section_row").isNull(), "section row")
        .when(F.col("first_row").isNull(), "first row")
        .when(F.col("last_row").isNull(), "last row")
        .when(F.col("first_row") <= F.col("section_row"), "first row not below section row")
        .when(F.col("last_row") < F.col("first_row"), "last row above first row")
    )
    return parsed.withColumn("error", error).drop("_shape")


def span_specs(layouts: DataFrame) -> DataFrame:
    """Entries ``"<sectionRow>:<start>(<span>), <start>, ..."`` to one row per question.

    Columns ``sec_ord, section_row, q_ord, first_row, span, last_row, error``. A bare start
    has span 1, empty tokens are dropped, and questions of a section may not overlap or go
    backwards.
    """
    tail = F.expr("substring(spec, instr(spec, ':') + 1)")
    tokens = F.filter(F.transform(F.split(tail, ","), trim_ws), lambda t: F.length(t) > 0)
    entries = layouts.select(*KEY, F.posexplode("specs").alias("sec_ord", "spec")).select(
        *KEY, "sec_ord", "spec",
        (F.instr("spec", ":") > 1).alias("_shape"),
        _positive(F.substring_index("spec", ":", 1)).alias("section_row"),
        F.posexplode_outer(tokens).alias("q_ord", "token"),
    )
    spanned = F.col("token").contains("(")
    shape = F.col("token").rlike(r"^[^()]+\([^)]+\)$") | ~spanned
    start = F.substring_index("token", "(", 1)
    span = F.when(spanned, F.regexp_extract("token", r"\(([^)]*)\)$", 1)).when(F.col("token").isNotNull(), "1")
    parsed = entries.select(
        *KEY, "sec_ord", "spec", "section_row", "q_ord", "token", "_shape",
        shape.alias("_token_shape"),
        _positive(start).alias("first_row"),
        _positive(span).alias("span"),
    ).withColumn("last_row", F.col("first_row") + F.col("span") - 1)
    following = F.lead("first_row").over(Window.partitionBy(*KEY, "sec_ord").orderBy("q_ord"))
    error = (
        F.when(~F.col("_shape"), "format")
        .when(F.col("section_row").isNull(), "section row")
        .when(F.col("token").isNull(), "no question")
        .when(~F.col("_token_shape"), "question format")
        .when(F.col("first_row").isNull(), "question start row")
        .when(F.col("span").isNull(), "question row span")
        .when(F.col("first_row") <= F.col("section_row"), "question not below section row")
        .when(F.col("last_row") >= F.col("following"), "overlaps next question")
    )
    return parsed.withColumn("following", following).withColumn("error", error).drop("_shape", "_token_shape", "following")


def section_violations(spans: DataFrame) -> DataFrame:
    """Cross-section faults: section rows not increasing, or a question reaching the next section."""
    sections = spans.groupBy(*KEY, "sec_ord").agg(F.max("section_row").alias("section_row"))
    w = Window.partitionBy(*KEY).orderBy("sec_ord")
    nxt = sections.withColumn("next_row", F.lead("section_row").over(w))
    order = nxt.filter("section_row >= next_row").select(
        *KEY, "sec_ord", F.lit(None).cast("int").alias("q_ord"), F.lit("sections not increasing").alias("error")
    )
    reach = spans.join(shuffled(nxt.select(*KEY, "sec_ord", "next_row")), [*KEY, "sec_ord"]).filter("last_row >= next_row").select(
        *KEY, "sec_ord", "q_ord", F.lit("question reaches next section").alias("error")
    )
    return order.unionByName(reach)


def layout_errors(layouts: DataFrame, specs: DataFrame, cross: bool = False) -> DataFrame:
    """Quarantine table ``pair_id, side, error`` of bad configs, bad entries and, if ``cross``, section faults."""
    out = layouts.filter("error IS NOT NULL").select(*KEY, "error").unionByName(
        specs.filter("error IS NOT NULL").select(*KEY, "error")
    )
    return out.unionByName(section_violations(specs).select(*KEY, "error")) if cross else out


def missing_sheets(layouts: DataFrame, cells: DataFrame) -> DataFrame:
    """Quarantine table ``pair_id, side, error`` of pairs whose laid-out sheet has no cells."""
    seen = cells.select(*KEY, "sheet").distinct()
    gone = layouts.join(seen, [*KEY, "sheet"], "left_anti")
    return gone.select(*KEY, F.concat(F.lit("no sheet "), "sheet").alias("error"))


def sound_specs(layouts: DataFrame, specs: DataFrame, cross: bool = False) -> DataFrame:
    """``specs`` without the pairs that have a fault on either side: one bad entry fails its pair, not the job."""
    bad = layout_errors(layouts, specs, cross).select("pair_id").distinct()
    return specs.join(shuffled(bad), "pair_id", "left_anti")
