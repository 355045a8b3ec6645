"""Session settings the operators rely on."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def task_slots(spark: SparkSession) -> int:
    """Partition count for stages whose work is compute, not bytes: four per core, so that
    uneven partitions even out, and no fewer than a shuffle has."""
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(shuffle, min(4 * shuffle, 4 * spark.sparkContext.defaultParallelism))


#: Table cells of edit distances for one task, about ten seconds.
TASK_CELLS = 20_000_000_000


def distance_tasks(texts: DataFrame, text_col: str = "text") -> int:
    """Partition count for a stage that compares each of ``texts`` with one of about its length. Its work
    is the sum of squared lengths, so bytes are no measure of it. Runs a job over ``texts``."""
    cells = texts.agg(F.sum(F.pow(F.length(text_col).cast("double"), 2.0))).first()[0] or 0.0
    return max(task_slots(texts.sparkSession), int(cells / TASK_CELLS) + 1)


def spread(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """``df`` dealt out by ``keys`` to a stated number of tasks, if there is one; a join's other side follows.

    Adaptive execution counts compressed bytes. Addresses take a byte each there and a hundred in a sort, so
    that a task it thinks small may take gigabytes.
    """
    return df.repartition(tasks, *keys) if tasks else df


#: Characters of text for one task that sorts both sides of it, some 200 MB.
TASK_CHARS = 16_000_000


def keep_deals(spark: SparkSession) -> None:
    """Let joins on more keys use rows that are dealt out by some of them, as groupings do by default.

    Blocks are stored by ``pair_id`` (``cut_lineage`` with ``buckets``), and every key of theirs has it. With this
    setting, which holds for the session from then on, joins of such tables move no rows.
    """
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``; if that is unset, one in the
    warehouse, which driver and executors share as well."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/revdiff-stages"


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is not to be broadcast, because its rows grow with the corpus.

    Catalyst judges a stored table by its files. Keys and rules that repeat take a byte or two a row
    there and a hundred in the driver, so that a few megabytes would unfold to gigabytes.
    """
    return df.hint("merge")


def cut_lineage(df: DataFrame, buckets: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    What follows does not recompute it, also when executors are lost, and Catalyst sees
    its real size when it picks join strategies.

    With ``buckets`` rows are dealt out by ``pair_id`` to so many files, and what is read is known to be dealt out so: tables
    of the same number of buckets are joined and grouped by ``pair_id`` and more without a shuffle (see ``keep_deals``).
    """
    spark = df.sparkSession
    name = f"revdiff-{uuid.uuid4().hex}"
    path = f"{scratch_dir(spark).rstrip('/')}/{name}"
    if buckets is None:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    table = name.replace("-", "_")
    dealt = df.repartition(buckets, "pair_id")  # one file a bucket; no shuffle where rows are dealt out so already
    dealt.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, "pair_id").saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the name only: the table is external, its files stay
    return out
