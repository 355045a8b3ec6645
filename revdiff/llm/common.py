"""What the operators share: reading tables, stage tables, and batches balanced by bytes."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from revdiff.sources.session import cut_lineage

__all__ = ["arrow_rows", "byte_slices", "cut_lineage", "read", "stored", "text_bytes", "unused"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """``cut_lineage`` into at most two files for each core: many small files cost more than they hold."""
    return cut_lineage(df.coalesce(2 * df.sparkSession.sparkContext.defaultParallelism))


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Arrow batches of at most ``rows`` rows while stages with wide rows are written: the usual
    10,000 would be hundreds of megabytes, in the JVM and in Python."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, usual)


def text_bytes(texts: pa.Array) -> np.ndarray:
    """UTF-8 length of every text; a null text is empty."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def byte_slices(batches: Iterator[pa.RecordBatch], column: int, size: int) -> Iterator[pa.RecordBatch]:
    """The rows again in slices of about ``size`` bytes of text; a longer text has a slice to itself."""
    for batch in batches:
        ends = np.cumsum(text_bytes(batch.column(column)))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + size, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added until ``df`` has no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
