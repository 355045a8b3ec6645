"""Exact duplicates against a persistent digest index.

The index is a table of one row per different text: its digest, the id that stays, and where that
row came from. It is bucketed and sorted by digest, in a folder of its own, so it outlives the
session. New data is digested and grouped; a sort-merge anti-join, which shuffles the new digests
but never the index, leaves those that the index lacks; these are appended.
"""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revdiff.llm.common import cut_lineage
from revdiff.sources.session import scratch_dir


def normalized(text: Column) -> Column:
    """The text with A-Z in lower case and nothing else changed; null is empty."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)  # lower() is several times faster and the same there
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


class DigestIndex:
    """The digest index in the folder ``path``, which is made if it is not there.

    ``buckets`` belongs to the folder: give the number that it was made with. One writer at a
    time. An ``add`` that was cut off may be repeated: what it had appended is known then.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, id_type: T.DataType | None = None):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = f"digest_index_{uuid.uuid4().hex}"  # the folder's name in this session
        kind = (id_type or T.LongType()).simpleString()
        spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id {kind}, batch STRING, row BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def unknown(self, rows: DataFrame) -> DataFrame:
        """``digest, keep_id, batch, row`` of the texts in ``rows`` that the index lacks: of equal
        texts the row with the largest id (a null id is the smallest; then the last row)."""
        new = rows.groupBy("digest").agg(F.max(F.struct("id", "batch", "row")).alias("k"))
        new = new.select("digest", F.col("k.id").alias("keep_id"), "k.batch", "k.row")
        return new.hint("merge").join(self.table(), "digest", "left_anti")

    def add(self, rows: DataFrame) -> None:
        """Append what is new in ``rows`` (see ``digest_rows``)."""
        self.unknown(rows).repartition(self.buckets, "digest").write.insertInto(self.name)

    def compacted(self, path: str) -> DigestIndex:
        """The same index in a new folder with one sorted file a bucket, after many small appends."""
        out = DigestIndex(self.spark, path, self.buckets, self.table().schema["keep_id"].dataType)
        files = self.spark.read.schema(self.table().schema).parquet(self.path)  # plain files: the table's own buckets would stand for the shuffle
        files.repartition(self.buckets, "digest").write.insertInto(out.name)
        return out


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, digest, batch, row`` of every row, stored; ``batch`` and ``row`` name the row."""
    batch = F.lit(uuid.uuid4().hex)
    digest = F.unhex(F.sha2(normalized(docs[text_col]), 256))
    return cut_lineage(docs.select(docs[id_col].alias("id"), digest.alias("digest")).select("*", batch.alias("batch"), F.monotonically_increasing_id().alias("row")))


def membership(rows: DataFrame, index: DigestIndex) -> DataFrame:
    """``id, keep_id, group_size, kept, digest`` of every row of ``rows`` after they were added.

    ``group_size`` counts the rows with that text among ``rows``. Sizes are summed before they are
    shuffled and meet the index one row a text; what comes of it is stored, so that in the join
    back to the rows a text that many rows share can be split."""
    sizes = rows.groupBy("digest").agg(F.count("*").alias("group_size"))
    verdict = cut_lineage(sizes.hint("merge").join(index.table(), "digest"))
    verdict = verdict.select("digest", "keep_id", "group_size", F.col("batch").alias("kept_batch"), F.col("row").alias("kept_row"))
    kept = (F.col("batch") == F.col("kept_batch")) & (F.col("row") == F.col("kept_row"))
    return rows.join(verdict, "digest").select("id", "keep_id", "group_size", kept.alias("kept"), "digest")


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, keep_id, group_size, kept, text_sha256``: one row per row of ``docs``.

    Texts are equal if they are identical after A-Z were lower-cased; a null text is empty. A text
    that ``index`` has already keeps the id it has there, and none of these rows. Otherwise the row
    with the largest id stays; of repeated rows, one. Without an ``index`` a new one is made in the
    shared folder.

    Numeric ids go in two halves, the larger first: the index knows these when the others come, and
    the first to come stays. A null id is smaller than any other; if all ids of a text are null,
    ``keep_id`` is null and one row stays. An empty table gives no rows. Other columns are not read.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType
    if index is None:
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        index = DigestIndex(spark, f"{scratch_dir(spark).rstrip('/')}/revdiff-index-{uuid.uuid4().hex}", buckets, kind)
    rows = digest_rows(docs, id_col, text_col)
    if isinstance(kind, T.IntegralType):
        middle = rows.select(F.expr("min(id) div 2 + max(id) div 2")).first()[0]
        later = F.coalesce(F.col("id") >= F.lit(middle), F.lit(False))
        index.add(rows.filter(later))
        index.add(rows.filter(~later))
    else:
        index.add(rows)
    out = membership(rows, index)
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
