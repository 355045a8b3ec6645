"""Writing result tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revdiff.sources.session import cut_lineage, shuffled


def numbered(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds ``row_key``, the position from 1 in ``order`` (ties in any order).

    Rows are sorted by ranges, and numbered in each range by its first position: only the numbers of
    rows per range meet, one for each task.
    """
    rows = cut_lineage(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()))
    rows = rows.withColumn("_range", F.shiftright("_id", 33))
    counts = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    key = F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1) + 1
    return rows.join(F.broadcast(before), "_range").withColumn("row_key", key).drop("_id", "_range", "_before")


def as_sheets(tables: dict[str, DataFrame], order: dict[str, Sequence[str]]) -> DataFrame:
    """Tables as rows of text: ``sheet, row_key, header, values``; null becomes ''. ``order`` names the
    columns that each table is sorted by."""

    def one(name: str, df: DataFrame) -> DataFrame:
        texts = F.array(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns])
        header = F.array(*map(F.lit, df.columns)).alias("header")
        return numbered(df, order[name]).select(F.lit(name).alias("sheet"), "row_key", header, texts.alias("values"))

    return reduce(DataFrame.unionByName, [one(n, d) for n, d in tables.items()])


def write_tables(tables: dict[str, DataFrame], order: dict[str, Sequence[str]], path: str) -> None:
    """Write text tables below ``path``, one ``sheet=<name>`` folder each; what was there is replaced.

    A sheet's files follow each other in ``row_key``, and so do the rows in a file."""
    rows = as_sheets(tables, order).repartitionByRange("sheet", "row_key").sortWithinPartitions("sheet", "row_key")
    rows.write.mode("overwrite").partitionBy("sheet").parquet(path)


def write_payload(payload: DataFrame, path: str) -> None:
    """Write report parts as JSON lines, one folder per status."""
    payload.write.mode("overwrite").partitionBy("status").json(path)


def write_documents(lines: DataFrame, path: str) -> None:
    """Write the lines of ``report.document_lines`` as one text file per block, ``pair_id=<id>``.

    A block's lines go through one task, in order and one at a time, so a document may be larger than
    memory. Files appear when the whole job commits; what was below ``path`` is replaced.
    """
    placed = lines.repartition("pair_id").sortWithinPartitions("pair_id", "seq")
    placed.select("pair_id", "line").write.mode("overwrite").partitionBy("pair_id").text(path)


#: Bytes up to which a document shares a file with others.
SHARED_BYTES = 16 << 20


def write_documents_together(lines: DataFrame, path: str, shared_bytes: int = SHARED_BYTES) -> bool:
    """Write the same documents, small ones many to a file: a corpus of small blocks would be as many files,
    each of which costs more to make, commit and list than its document.

    ``shared`` has one line per block of up to ``shared_bytes`` bytes, a JSON object with ``pair_id`` and ``document``;
    ``single`` has a file for each other block, as ``write_documents`` writes it.
    Returns whether there are any of the latter.
    """
    lines = cut_lineage(lines)
    sizes = lines.groupBy("pair_id").agg(F.sum(F.octet_length("line").cast("long")).alias("bytes"))
    large = cut_lineage(sizes.filter(F.col("bytes") > shared_bytes).select("pair_id"))
    small = lines.join(shuffled(large), "pair_id", "left_anti").groupBy("pair_id")
    listed = small.agg(F.array_sort(F.collect_list(F.struct("seq", "line"))).alias("lines"))
    named = F.to_json(F.struct("pair_id"))
    head = F.concat(named.substr(F.lit(1), F.length(named) - 1), F.lit(',"document":'))  # without the closing brace
    document = F.array_join(F.transform("lines", lambda x: x["line"]), "")
    listed.select(F.concat(head, document, F.lit("}")).alias("value")).write.mode("overwrite").text(f"{path}/shared")
    single = not large.isEmpty()
    if single:
        write_documents(lines.join(shuffled(large), "pair_id", "left_semi"), f"{path}/single")
    return single


def read_documents(spark: SparkSession, path: str, schema: str, single: bool) -> DataFrame:
    """``pair_id, document`` of what ``write_documents_together`` wrote; ``schema`` is a document's, ``single``
    says whether there are blocks with files of their own."""
    both = F.from_json("value", f"pair_id string, document struct<{schema}>")
    read = spark.read.text(f"{path}/shared").select(both.alias("d")).select("d.pair_id", "d.document")
    if not single:
        return read
    whole = spark.read.schema("value string, pair_id string").text(f"{path}/single", wholetext=True)
    return read.unionByName(whole.select("pair_id", F.from_json("value", schema).alias("document")))
