"""Revision corpora derived from the test tables.

The tables hold one version of everything, so the current revision is derived from the
previous one by plain text edits: words replaced, short records dropped, a record added.
Each conversation, document or brand is one block (``pair_id``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revdiff.functions.text import normalize_text, normalized_similarity
from revdiff.operators.extract import extract_control, extract_general, extract_risk
from revdiff.operators.layout import parse_layouts, section_specs, span_specs
from revdiff.operators.scan import attach_rules
from revdiff.sources.session import TASK_CELLS, TASK_CHARS, cut_lineage, keep_deals, shuffled, task_slots

REWORDED = [(" the ", " this "), (" la ", " sa "), (" die ", " jene "), (" de ", " del ")]
SHORT = 60
RISK_SHEET, GENERAL_SHEET, CONTROL_SHEET = "Risk Level Questions", "General Data", "Control Level Questions"
# Layouts follow the turns: the closing row comes after the last one, and not before row 12.
RISK_CONFIG = """'{"sectionRows": ["1:2-5", "5:6-' || closing || '"]}'"""
GENERAL_CONFIG = """'{"sectionRows": ["1:' || array_join(transform(sequence(2, greatest(8, closing - 2), 2), r -> r || '(2)'), ', ') || '"]}'"""
SECTION_LINES = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of long texts. Fewer files than tasks would leave the per-row work to few
    tasks, so the rows are spread then; a table of many files is read as it is."""
    df = table(spark, sf_dir, name)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks) if len(df.inputFiles()) < tasks else df


def reword(c: str) -> str:
    for old, new in REWORDED:
        c = f"replace({c}, '{old}', '{new}')"
    return c


def _cells(spark: SparkSession, sheet: str, rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Unpivot ``rows(pair_id, side, row_num, ...)`` into cells; null values give no cell."""
    entries = ", ".join(f"'{c}', {ord(c) - 64}, CAST({v} AS STRING)" for c, v in columns.items())
    return spark.sql(
        f"""SELECT CAST(pair_id AS STRING) pair_id, side, '{sheet}' sheet, CAST(row_num AS INT) row_num, col, col_idx, value text
        FROM {{rows}} LATERAL VIEW stack({len(columns)}, {entries}) w AS col, col_idx, value WHERE value IS NOT NULL""",
        rows=rows,
    )


# ---------------------------------------------------------------- conversations


def turns(spark: SparkSession, sf_dir: str, side: str | None = None) -> DataFrame:
    """``pair_id, side, row_num, turn, role, text``; ``row_num`` is turn + 2."""
    both = spark.sql(
        f"""SELECT CAST(conv_id AS STRING) pair_id, side, CAST(turn + 2 AS INT) row_num, CAST(turn AS INT) turn, role,
          CASE WHEN side = 'prev' THEN text WHEN role = 'system' THEN reverse(text) ELSE {reword("text")} END text
        FROM {{c}} LATERAL VIEW explode(array('prev', 'curr')) s AS side WHERE side = 'prev' OR length(text) >= {SHORT}""",
        c=text_table(spark, sf_dir, "conversations"),
    )
    return both if side is None else both.filter(F.col("side") == side).drop("side")


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation on both sides, with its number of turns and the row of its closing remarks."""
    return spark.sql(
        """SELECT CAST(conv_id AS STRING) pair_id, side, count(*) turns, CAST(greatest(12, max(turn) + 3) AS INT) closing FROM {c} LATERAL VIEW explode(array('prev', 'curr')) s AS side
        GROUP BY conv_id, side""",
        c=table(spark, sf_dir, "conversations"),
    )


def risk_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheet with number (B), text (C), input (D) and explanation (E) per turn, and a closing row."""
    body = _cells(spark, RISK_SHEET, turns(spark, sf_dir), {
        "B": "substring(role, 1, 1) || '.' || turn || IF(side = 'curr' AND role = 'assistant' AND length(text) > 1000, 'x', '')",
        "C": "text",
        "D": "''",
        "E": """CASE WHEN side = 'prev' THEN 'Explain ' || role WHEN role = 'user' THEN 'EXPLAIN  user'
                WHEN role = 'assistant' AND length(text) > 500 THEN 'Explain assistant reply' ELSE 'Explain ' || role END""",
    })
    blocks = spark.sql(
        """SELECT pair_id, side, row_num, CASE row_num WHEN 1 THEN 'Conversation' ELSE 'Closing remarks after ' || turns || ' turns.' END text
        FROM {b} LATERAL VIEW explode(IF(side = 'prev', array(1), array(1, closing))) r AS row_num""",
        b=_blocks(spark, sf_dir),
    )
    return body.unionByName(_cells(spark, RISK_SHEET, blocks, {"C": "text"}))


def risk_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per turn: users a list of choices, assistants a length range, long replies a highlight."""
    return spark.sql(
        f"""SELECT pair_id, side, '{RISK_SHEET}' sheet, w.kind, turn rule_ord, 0 range_ord, row_num r1, 4 c1, row_num r2, 4 c2, w.type, w.op, w.v1, w.v2
        FROM {{t}} LATERAL VIEW inline(array(
          named_struct('kind', IF(role = 'user', 'dv', NULL), 'type', 'List', 'op', 'Between',
            'v1', IF(side = 'prev', '"Yes,No,' || turn || '"', '"' || turn || ', No,Yes"'), 'v2', ''),
          named_struct('kind', IF(role = 'assistant', 'dv', NULL), 'type', 'WholeNumber', 'op', 'Between', 'v1', '1', 'v2', CAST(length(text) AS STRING)),
          named_struct('kind', IF(role = 'assistant' AND length(text) > 800, 'cf', NULL), 'type', 'Expression', 'op', 'Equal',
            'v1', '=LEN(C' || row_num || ')>800', 'v2', NULL)
        )) w AS kind, type, op, v1, v2 WHERE w.kind IS NOT NULL""",
        t=turns(spark, sf_dir),
    )


def _configs(spark: SparkSession, sf_dir: str, config: str) -> DataFrame:
    return _blocks(spark, sf_dir).select("pair_id", "side", F.expr(config).alias("config"))


def split_sides(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.filter("side = 'prev'"), df.filter("side = 'curr'")


def risk_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted_risk(spark, sf_dir, risk_cells(spark, sf_dir), risk_rules(spark, sf_dir))


def extracted_risk(spark: SparkSession, sf_dir: str, cells: DataFrame, rules: DataFrame) -> DataFrame:
    cells = attach_rules(cells, cut_lineage(rules))
    layouts = cut_lineage(parse_layouts(_configs(spark, sf_dir, RISK_CONFIG), "risk"))
    return extract_risk(cells, layouts, section_specs(layouts))


def general_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheet with label (B), text (C), three answer columns (D, E, F) and explanation (G) per turn; the whole
    text is an answer as well, so that turns between the questions are compared in full."""
    body = _cells(spark, GENERAL_SHEET, turns(spark, sf_dir), {
        "B": "role || '.' || turn",
        "C": "text",
        "D": "text",
        "E": "length(text)",
        "F": "IF(length(text) > IF(side = 'curr', 310, 300), IF(side = 'curr' AND role = 'user', 'LONG', 'long'), NULL)",
        "G": "IF(role <> 'system', 'See ' || role, NULL)",
    })
    head = _blocks(spark, sf_dir).selectExpr("pair_id", "side", "1 row_num")
    return body.unionByName(_cells(spark, GENERAL_SHEET, head, {"C": "' Dialogue '"}))


def general_questions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    layouts = cut_lineage(parse_layouts(_configs(spark, sf_dir, GENERAL_CONFIG), "general"))
    return extract_general(general_cells(spark, sf_dir), layouts, span_specs(layouts))


# ---------------------------------------------------------------- documents


def document_lines(spark: SparkSession, sf_dir: str, tasks: int) -> DataFrame:
    """Every line of every document as a sheet row, dealt out by document. Header rows are added: the chapter in row 1,
    and before each ten lines a section header (rows 2, 13, 24, ...)."""
    documents = table(spark, sf_dir, "documents").selectExpr("CAST(doc_id AS STRING) pair_id", "lang", "source", "text")
    return spark.sql(
        f"""SELECT pair_id, side, lang, source, pos, pos + pos DIV {SECTION_LINES} + 3 row_num, IF(side = 'prev' OR pos = size(lines), line, {reword("line")}) line
        FROM (
          SELECT pair_id, lang, source, split(text, '\n') lines FROM {{d}}
        ) LATERAL VIEW explode(array('prev', 'curr')) s AS side
        LATERAL VIEW posexplode(IF(side = 'prev', lines, array_append(lines, 'Reviewed ' || lang || ' ' || source))) l AS pos, line
        WHERE side = 'prev' OR pos = size(lines) OR length(line) NOT BETWEEN 30 AND {SHORT}""",
        d=documents.repartition(tasks, "pair_id"),
    )


def control_cells(spark: SparkSession, sf_dir: str, sizes: DataFrame, tasks: int) -> DataFrame:
    lines = _cells(spark, CONTROL_SHEET, document_lines(spark, sf_dir, tasks), {
        "C": f"(pos DIV {SECTION_LINES} + 1) || '.' || (row_num + IF(side = 'curr' AND source = 'src7', 1, 0)) || ') ' || line", "D": "''",
    })
    heads = spark.sql(
        f"""SELECT pair_id, side, h.row_num, IF(h.row_num = 1, 'Document in ' || lang || ' from ' || source, 'Part ' || ((h.row_num - 2) DIV {SECTION_LINES + 1} + 1)) text
        FROM {{s}} LATERAL VIEW explode(array_prepend(sequence(2, last_row, {SECTION_LINES + 1}), 1)) h AS row_num""",
        s=sizes,
    )
    return lines.unionByName(_cells(spark, CONTROL_SHEET, heads, {"C": "text"}))


def _text_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pair_id, lang, source, n, chars, cells`` of every document: its lines, its characters, and the table cells of
    comparing each line with one of its length. Texts are measured where they are read, they don't move."""
    return spark.sql(
        r"""SELECT CAST(doc_id AS STRING) pair_id, lang, source, size(lines) n, CAST(length(text) AS BIGINT) chars,
          aggregate(lines, 0D, (c, l) -> c + pow(length(l), 2)) cells FROM (SELECT *, split(text, '\n') lines FROM {d})""",
        d=table(spark, sf_dir, "documents"),
    )


def _document_sizes(spark: SparkSession, sizes: DataFrame) -> DataFrame:
    """Every document on both sides, with the row of its last line; the current side has a line more."""
    return spark.sql(
        f"""SELECT pair_id, side, lang, source, n - 1 + (n - 1) DIV {SECTION_LINES} + 3 last_row FROM (
          SELECT pair_id, side, lang, source, n + IF(side = 'curr', 1, 0) n FROM {{d}} LATERAL VIEW explode(array('prev', 'curr')) s AS side
        )""",
        d=sizes,
    )


def _document_tasks(sizes: DataFrame, all_pairs: bool) -> int:
    """Partition count for the lines of all documents: by their characters, as they are sorted, and by the cells of comparing
    them with lines of their length, or each with ``all_pairs`` of its document. No fewer than a shuffle has."""
    cells = F.pow(F.col("chars").cast("double"), 2.0) if all_pairs else F.col("cells")
    chars, cells = sizes.agg(F.sum("chars"), F.sum(cells)).first()
    return max(task_slots(sizes.sparkSession), int((chars or 0) // TASK_CHARS) + 1, int((cells or 0) // TASK_CELLS) + 1)


def row_alignment(prev: DataFrame, curr: DataFrame) -> DataFrame:
    """An alignment by place: records of equal ``ord`` match, the others stay alone.

    Sides that are dealt out alike meet where they are; others are shuffled by place."""
    key = ["pair_id", "ord"]
    old, new = (df.select(*key, F.col("text").alias(name)) for df, name in ((prev, "old"), (curr, "new")))
    both = old.join(shuffled(new), key, "full")
    texts = {f"{c}_norm": normalize_text(F.coalesce(c, F.lit(""))) for c in ("old", "new")}
    n, o = F.when(F.col("new").isNotNull(), F.col("ord")), F.when(F.col("old").isNotNull(), F.col("ord"))
    score = F.when(F.col("new").isNotNull() & F.col("old").isNotNull(), normalized_similarity(F.col("old_norm"), F.col("new_norm")))
    return both.withColumns(texts).select("pair_id", n.alias("n_ord"), o.alias("o_ord"), score.alias("similarity"), F.lit(None).cast("double").alias("second_best"))


def control_rules(spark: SparkSession, sizes: DataFrame) -> DataFrame:
    """Per document: a list for rows 1-8 before a length limit for all rows, and one highlight."""
    return spark.sql(
        f"""SELECT pair_id, side, '{CONTROL_SHEET}' sheet, w.kind, w.rule_ord, 0 range_ord, w.r1, 4 c1, w.r2, 4 c2, w.type, w.op, w.v1, w.v2
        FROM {{s}} LATERAL VIEW inline(array(
          named_struct('kind', 'dv', 'rule_ord', 0, 'r1', 1, 'r2', 8, 'type', 'List', 'op', 'Between',
            'v1', IF(side = 'prev', '"Yes,No"', '"No, Yes"'), 'v2', ''),
          named_struct('kind', 'dv', 'rule_ord', 1, 'r1', 1, 'r2', last_row, 'type', 'TextLength', 'op', 'LessThan',
            'v1', IF(side = 'prev', '500', CAST(length(lang) AS STRING)), 'v2', ''),
          named_struct('kind', 'cf', 'rule_ord', 0, 'r1', 2, 'r2', last_row, 'type', 'CellIs', 'op', 'Equal', 'v1', lang, 'v2', NULL)
        )) w AS kind, rule_ord, r1, r2, type, op, v1, v2""",
        s=sizes,
    )


def control_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _control_configs(spark, _document_sizes(spark, _text_sizes(spark, sf_dir)))


def _control_configs(spark: SparkSession, sizes: DataFrame) -> DataFrame:
    """A layout per document and side, as JSON, with a section for every ten lines."""
    return spark.sql(
        f"""SELECT pair_id, side, to_json(named_struct('chapterRows', array(1), 'SectionRows', transform(
            sequence(2, last_row, {SECTION_LINES + 1}), h -> h || ':' || (h + 1) || '-' || least(h + {SECTION_LINES}, last_row)))) config FROM {{s}}""",
        s=sizes,
    )


def control_questions(spark: SparkSession, sf_dir: str, all_pairs: bool = False) -> DataFrame:
    """Questions of all documents, dealt out by document: texts are shuffled once, as documents, before they are taken apart.
    ``all_pairs`` says that the lines of a document are to be compared with one another."""
    keep_deals(spark)
    measured = cut_lineage(_text_sizes(spark, sf_dir))
    tasks = _document_tasks(measured, all_pairs)
    sizes = _document_sizes(spark, cut_lineage(measured, tasks))
    cells = attach_rules(control_cells(spark, sf_dir, sizes, tasks), cut_lineage(control_rules(spark, sizes), tasks))
    layouts = cut_lineage(parse_layouts(_control_configs(spark, sizes), "control"), tasks)
    return extract_control(cells, layouts, section_specs(layouts), tasks)


# ---------------------------------------------------------------- parts


def part_cells(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """Cells keyed by address within a brand: name (C), type (D), price (AA); rules on C and D."""
    new = "true" if side == "curr" else "false"
    return spark.sql(
        f"""SELECT p_brand pair_id, upper(col) || p_partkey address, w.text,
          IF(w.col = 'D', named_struct('type', 'WholeNumber', 'op', 'Between', 'f1', '1', 'f2', CAST(p_size + IF({new} AND p_size > 40, 1, 0) AS STRING)), NULL) dv,
          IF(w.col = 'C' AND p_size > 25, named_struct('type', 'CellIs', 'op', 'Equal', 'v1', IF({new} AND p_size = 30, 'new', 'old'), 'v2', CAST(NULL AS STRING)), NULL) cf
        FROM {{p}} LATERAL VIEW inline(array(
          named_struct('col', 'C', 'text', IF(p_type = 'PROMO', upper(p_name), p_name)),
          named_struct('col', 'D', 'text', IF({new} AND p_size < 5, 'SMALL', p_type)),
          named_struct('col', IF({new}, 'aa', 'AA'), 'text', CAST(CAST(p_retailprice AS INT) AS STRING))
        )) w AS col, text WHERE NOT ({new} AND p_size = 50)""",
        p=table(spark, sf_dir, "part").withColumn("p_name", F.expr(f"IF({new}, ' ' || p_name || '\t', p_name)")),
    )
