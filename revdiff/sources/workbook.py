"""Corpus ingest: a folder of .xlsx workbooks into the ``cells`` and ``rules`` tables.

A workbook is a zip archive and cannot be split, so it is the unit of work; workbooks
spread over the cluster. Sheets are streamed, rows leave the task in bounded batches, and
a file that cannot be read yields an error row instead of failing the job.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revdiff.functions.address import col_letters
from revdiff.sources.session import cut_lineage, task_slots

# Names of rule types and operators in the file format, and in the tables.
DV_TYPES = {
    "none": "AnyValue", "whole": "WholeNumber", "decimal": "Decimal", "list": "List", "date": "Date",
    "time": "Time", "textLength": "TextLength", "custom": "Custom",
}
DV_OPERATORS = {
    "between": "Between", "notBetween": "NotBetween", "equal": "EqualTo", "notEqual": "NotEqualTo",
    "greaterThan": "GreaterThan", "lessThan": "LessThan",
    "greaterThanOrEqual": "EqualOrGreaterThan", "lessThanOrEqual": "EqualOrLessThan",
}
CF_TYPES = {
    "cellIs": "CellIs", "expression": "Expression", "colorScale": "ColorScale", "dataBar": "DataBar",
    "iconSet": "IconSet", "top10": "Top10", "uniqueValues": "IsUnique", "duplicateValues": "IsDuplicate",
    "containsText": "ContainsText", "notContainsText": "NotContainsText", "beginsWith": "StartsWith",
    "endsWith": "EndsWith", "containsBlanks": "IsBlank", "notContainsBlanks": "NotBlank",
    "containsErrors": "IsError", "notContainsErrors": "NotError", "timePeriod": "TimePeriod",
    "aboveAverage": "AboveAverage",
}
CF_OPERATORS = {
    "equal": "Equal", "notEqual": "NotEqual", "greaterThan": "GreaterThan", "lessThan": "LessThan",
    "greaterThanOrEqual": "EqualOrGreaterThan", "lessThanOrEqual": "EqualOrLessThan",
    "between": "Between", "notBetween": "NotBetween", "containsText": "Contains", "notContains": "NotContains",
    "beginsWith": "StartsWith", "endsWith": "EndsWith",
}
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_LAST_ROW, _LAST_COL = 1 << 20, 1 << 14

_ROWS = (
    "path string, what string, sheet string, row_num int, col string, col_idx int, text string, kind string, "
    "rule_ord int, range_ord int, r1 int, c1 int, r2 int, c2 int, type string, op string, v1 string, v2 string, error string"
)
_SCHEMA = pa.schema([(name, pa.int32() if kind == "int" else pa.string()) for name, kind in (c.split() for c in _ROWS.split(", "))])
_BATCH = 20_000
#: Bytes of files, or characters of cells, that a task hands on at a time.
_BATCH_BYTES = 4 << 20
_NAME = re.compile(r".+\.(prev|curr)\.xlsx", re.S)


def _index(letters: str) -> int:
    n = 0
    for ch in letters.upper():
        n = n * 26 + ord(ch) - 64
    return n


def _letters(index: int) -> str:
    out = ""
    while index:
        index, digit = divmod(index - 1, 26)
        out = chr(65 + digit) + out
    return out


def _ranges(refs: str) -> Iterator[tuple[int, int, int, int]]:
    """``"A1:B2 D4 C:C 3:5"`` as (r1, c1, r2, c2); whole columns and rows are open-ended."""
    for ref in refs.split():
        corners = [re.fullmatch(r"\$?([A-Za-z]*)\$?(\d*)", c).groups() for c in ref.split(":")]
        (c1, r1), (c2, r2) = corners[0], corners[-1]
        yield int(r1 or 1), _index(c1) if c1 else 1, int(r2 or _LAST_ROW), _index(c2) if c2 else _LAST_COL


def _plain(node: ElementTree.Element | None) -> str:
    """Text of a rich-text node, phonetic hints left out."""
    if node is None:
        return ""
    runs = [node.find("{*}t"), *[r.find("{*}t") for r in node.findall("{*}r")]]
    return "".join(t.text or "" for t in runs if t is not None)


def _cell_text(cell: ElementTree.Element, strings: list[str]) -> str:
    kind, value = cell.get("t", "n"), cell.findtext("{*}v") or ""
    if kind == "s":
        return strings[int(value)]
    if kind == "inlineStr":
        return _plain(cell.find("{*}is"))
    if kind == "b":
        return "TRUE" if value == "1" else "FALSE"
    return value


def _sheet_rows(stream, sheet: str, strings: list[str]) -> Iterator[dict]:
    """Cells and rules of a sheet. A row or cell without ``r`` follows the one before it."""
    dv_ord = cf_ord = row = col = 0
    data = None
    for event, node in ElementTree.iterparse(stream, events=("start", "end")):
        tag = node.tag.rpartition("}")[2]  # either namespace of the format
        if event == "start":
            if tag == "sheetData":
                data = node
            elif tag == "row":
                row, col = int(node.get("r", row + 1)), 0
            continue
        if tag == "c":
            if node.get("r"):
                letters, at = re.fullmatch(r"([A-Za-z]+)(\d+)", node.get("r")).groups()
                row, col = int(at), _index(letters)
            else:
                col += 1
            yield {"what": "cell", "sheet": sheet, "row_num": row, "col": _letters(col), "col_idx": col, "text": _cell_text(node, strings)}
        elif tag == "row" and data is not None:
            data.clear()  # finished rows would stay with their parent
        elif tag == "dataValidation":
            rule = {"kind": "dv", "rule_ord": dv_ord, "type": DV_TYPES.get(node.get("type", "none")),
                    "op": DV_OPERATORS[node.get("operator", "between")],
                    "v1": node.findtext("{*}formula1") or "", "v2": node.findtext("{*}formula2")}
            dv_ord += 1
            yield from _rule_rows(sheet, node.get("sqref", ""), rule)
        elif tag == "conditionalFormatting":
            for child in node.findall("{*}cfRule"):
                values = [f.text or "" for f in child.findall("{*}formula")] + [None, None]
                kind = child.get("type", "")
                rule = {"kind": "cf", "rule_ord": cf_ord, "type": CF_TYPES.get(kind, kind),
                        "op": CF_OPERATORS.get(child.get("operator", "equal")), "v1": values[0], "v2": values[1]}
                cf_ord += 1
                yield from _rule_rows(sheet, node.get("sqref", ""), rule)


def _rule_rows(sheet: str, refs: str, rule: dict) -> Iterator[dict]:
    for at, (r1, c1, r2, c2) in enumerate(_ranges(refs)):
        yield {"what": "rule", "sheet": sheet, "range_ord": at, "r1": r1, "c1": c1, "r2": r2, "c2": c2, **rule}


def _workbook_rows(content: bytes) -> Iterator[dict]:
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        strings: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            for _, node in ElementTree.iterparse(book.open("xl/sharedStrings.xml")):
                if node.tag.rpartition("}")[2] == "si":
                    strings.append(_plain(node))
                    node.clear()
        links = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
        target = {r.get("Id"): r.get("Target") for r in links}
        sheets = list(ElementTree.fromstring(book.read("xl/workbook.xml")).findall(".//{*}sheet"))
        if not sheets:
            raise ValueError("the workbook has no sheet")
        for entry in sheets:
            part = target[next(v for k, v in entry.items() if k.endswith("}id"))]
            part = part.lstrip("/") if part.startswith("/") else "xl/" + part
            with book.open(part) as stream:
                yield from _sheet_rows(stream, entry.get("name"), strings)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content")):
            path, rows, size = path.as_py(), [], 0
            try:
                if not _NAME.fullmatch(path.rpartition("/")[2]):
                    raise ValueError("file name is not <pair>.<prev|curr>.xlsx")
                for row in _workbook_rows(content.as_py()):
                    rows.append({"path": path, **row})
                    size += len(row.get("text") or "")
                    if len(rows) >= _BATCH or size >= _BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)
                        rows, size = [], 0
            except Exception as broken:  # one unreadable file must not stop the corpus
                rows.append({"path": path, "what": "error", "error": f"{type(broken).__name__}: {broken}"})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)


def parse_workbooks(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``files(path, content)`` named ``<pair_id>.<side>.xlsx`` to ``cells``, ``rules`` and ``errors``.

    Cells and rules of a file with an error are left out.
    """
    spread = files.select("path", "content").repartition(task_slots(files.sparkSession))
    name = F.element_at(F.split("path", "/"), -1)
    parts = r"^(.+)\.(prev|curr)\.xlsx$"
    rows = cut_lineage(
        spread.mapInArrow(_parse, _ROWS).select(
            F.regexp_extract(name, parts, 1).alias("pair_id"), F.regexp_extract(name, parts, 2).alias("side"), "*"
        )
    )
    errors = rows.filter("what = 'error'").select("path", "error")
    sound = rows.join(errors.select("path"), "path", "left_anti")
    cells = sound.filter("what = 'cell'").select("pair_id", "side", "sheet", "row_num", "col", "col_idx", "text")
    rules = sound.filter("what = 'rule'").select(
        "pair_id", "side", "sheet", "kind", "rule_ord", "range_ord", "r1", "c1", "r2", "c2", "type", "op", "v1", "v2"
    )
    return cells, rules, errors


def ingest_cells(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``cells``, ``rules`` and ``errors`` of every workbook below a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", "true").load(folder)
    return parse_workbooks(files)


# ---------------------------------------------------------------- writing


_PARTS = {
    "[Content_Types].xml": '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
    '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
    '<Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
    '<Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/_rels/workbook.xml.rels": '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
    '<Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}


def _escaped(c):
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def _rule_xml(rules: DataFrame) -> DataFrame:
    """``pair_id, side, sheet, rules``: the rules of each sheet in order, as the XML behind its cells."""
    place = F.concat(col_letters(F.col("c1")), F.col("r1").cast("string"), F.lit(":"), col_letters(F.col("c2")), F.col("r2").cast("string"))
    one = rules.groupBy("pair_id", "side", "sheet", "kind", "rule_ord", "type", "op", "v1", "v2").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("range_ord", place.alias("ref")))), lambda r: r["ref"]), " ").alias("refs")
    )
    named = lambda words, c: F.create_map(*[F.lit(x) for pair in words.items() for x in reversed(pair)])[F.col(c)]
    given = lambda tag, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"<{tag}>"), _escaped(F.col(c)), F.lit(f"</{tag}>"))).otherwise("")
    kind = lambda types, ops: F.concat(F.lit('type="'), named(types, "type"), F.lit('"'), F.coalesce(F.concat(F.lit(' operator="'), named(ops, "op"), F.lit('"')), F.lit("")))
    dv = F.concat(F.lit("<dataValidation "), kind(DV_TYPES, DV_OPERATORS), F.lit(' sqref="'), "refs", F.lit('">'), given("formula1", "v1"), given("formula2", "v2"), F.lit("</dataValidation>"))
    cf = F.concat(
        F.lit('<conditionalFormatting sqref="'), "refs", F.lit('"><cfRule '), kind(CF_TYPES, CF_OPERATORS), F.lit(">"), given("formula", "v1"), given("formula", "v2"),
        F.lit("</cfRule></conditionalFormatting>"),
    )
    both = one.select("pair_id", "side", "sheet", "kind", "rule_ord", F.when(F.col("kind") == "dv", dv).otherwise(cf).alias("xml"))
    listed = lambda k: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("rule_ord", "xml")))), lambda r: r["xml"]), "")
    return both.groupBy("pair_id", "side", "sheet").agg(F.concat(listed("cf"), F.lit("<dataValidations>"), listed("dv"), F.lit("</dataValidations>")).alias("rules"))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Zips one sheet at a time, as a batch may hold thousands."""
    def handed_on(files: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(files, schema=pa.schema([("path", pa.string()), ("content", pa.binary())]))

    for batch in batches:
        out, size = [], 0
        for values in zip(*(batch.column(c) for c in ("pair_id", "side", "sheet", "xml")), strict=True):
            pair_id, side, sheet, xml = (v.as_py() for v in values)
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as book:
                for name, part in _PARTS.items():
                    book.writestr(name, part)
                title = sheet.replace("&", "&amp;").replace("<", "&lt;").replace('"', "&quot;")
                book.writestr(
                    "xl/workbook.xml",
                    f'<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets><sheet name="{title}" sheetId="1" r:id="r1"/></sheets></workbook>',
                )
                book.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{_MAIN}">{xml}</worksheet>')
            out.append({"path": f"{pair_id}.{side}.xlsx", "content": buffer.getvalue()})
            size += len(out[-1]["content"])
            if size >= _BATCH_BYTES:
                yield handed_on(out)
                out, size = [], 0
        if out:
            yield handed_on(out)


def workbook_files(cells: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """One-sheet workbooks ``(path, content)`` from cells and their rules, one per (pair, side, sheet).

    The sheet XML is put together by Spark; a task only zips it. One workbook is one row, as
    large as its file; sheets end at 2**20 rows. Rules of sheets without cells are left out.
    """
    text = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    cell = F.concat(
        F.lit('<c r="'), "col", F.col("row_num").cast("string"), F.lit('" t="inlineStr"><is><t xml:space="preserve">'), text, F.lit("</t></is></c>")
    )
    row = cells.filter(F.col("text").isNotNull()).groupBy("pair_id", "side", "sheet", "row_num").agg(
        F.array_sort(F.collect_list(F.struct("col_idx", cell.alias("xml")))).alias("cells")
    )
    body = F.concat(
        F.lit('<row r="'), F.col("row_num").cast("string"), F.lit('">'),
        F.array_join(F.transform("cells", lambda c: c["xml"]), ""), F.lit("</row>"),
    )
    sheets = row.select("pair_id", "side", "sheet", "row_num", body.alias("xml")).groupBy("pair_id", "side", "sheet").agg(
        F.array_sort(F.collect_list(F.struct("row_num", "xml"))).alias("rows")
    ).select("pair_id", "side", "sheet", F.concat(F.lit("<sheetData>"), F.array_join(F.transform("rows", lambda r: r["xml"]), ""), F.lit("</sheetData>")).alias("xml"))
    if rules is not None:
        sheets = sheets.join(_rule_xml(rules), ["pair_id", "side", "sheet"], "left").withColumn("xml", F.concat("xml", F.coalesce("rules", F.lit("")))).drop("rules")

    return sheets.mapInArrow(_pack, "path string, content binary")
