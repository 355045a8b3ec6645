"""Order-based operators that never put one key's rows into a single task.

A plain window over a key sorts all rows of that key in one task. Here a key's rows
are cut into bins of the order column; windows run per (key, bin), and only one
summary row per bin is carried along the key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revdiff.sources.session import shuffled

BIN = 4096
Carry = tuple[Column, Callable[[Column], Column]]


def _carry(df: DataFrame, keys: Sequence[str], order: str, bin_size: float, summaries: dict[str, Carry], null_keys: bool = True) -> DataFrame:
    """Adds ``_bin`` and, per entry ``name: (summary, fold)``, the fold of all earlier bins of the key. Without ``null_keys``
    rows are joined on the keys themselves, which needs no shuffle where they are dealt out by some of these."""
    binned = df.withColumn("_bin", F.floor(F.col(order) / F.lit(bin_size)))
    earlier = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = binned.groupBy(*keys, "_bin").agg(*[s.alias(name) for name, (s, _) in summaries.items()])
    bins = bins.select(*keys, "_bin", *[fold(F.col(name)).over(earlier).alias(name) for name, (_, fold) in summaries.items()])
    a, b = binned.alias("a"), bins.alias("b")
    cond = F.lit(True)
    for k in (*keys, "_bin"):
        cond = cond & (F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) if null_keys else F.col(f"a.{k}") == F.col(f"b.{k}"))
    return a.join(shuffled(b), cond, "left").select("a.*", *[F.col(f"b.{name}") for name in summaries])


def _in_bin(keys: Sequence[str], order: str):
    return Window.partitionBy(*keys, "_bin").orderBy(order)


def _hit(order: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.struct(F.col(order).alias("o"), value.alias("v")))


def _before(w):
    return w.rowsBetween(Window.unboundedPreceding, -1)


def asof_last(
    df: DataFrame, keys: Sequence[str], order: str, is_header: Column, value: Column, out: str, bin_size: float = BIN, null_keys: bool = True
) -> DataFrame:
    """As-of lookup: ``value`` of the latest header row at or before each row, else null.

    Rows that share an order value see the header among them. Without ``null_keys`` a row with a null in a key or in
    ``order`` sees no header of an earlier bin.
    """
    df = df.withColumn("_h", _hit(order, F.when(is_header, value)))
    rows = _carry(df, keys, order, bin_size, {"_c": (F.max("_h"), F.max)}, null_keys)
    upto = _in_bin(keys, order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    latest = F.coalesce(F.max("_h").over(upto), F.col("_c"))
    return rows.withColumn(out, latest.getField("v")).drop("_bin", "_h", "_c")


def ordinal(df: DataFrame, keys: Sequence[str], order: str, out: str, bin_size: float = BIN) -> DataFrame:
    """1-based row number per key in ``order`` (unique per key)."""
    rows = _carry(df, keys, order, bin_size, {"_c": (F.count(F.lit(1)), F.sum)})
    n = F.coalesce(F.col("_c"), F.lit(0)) + F.row_number().over(_in_bin(keys, order))
    return rows.withColumn(out, n.cast("bigint")).drop("_bin", "_c")


def running_sum(
    df: DataFrame, keys: Sequence[str], order: str, value: Column, out: str, bin_size: float = BIN
) -> DataFrame:
    """Sum of ``value`` over the rows of the key before each row in ``order`` (unique per key)."""
    rows = _carry(df.withColumn("_v", value), keys, order, bin_size, {"_c": (F.sum("_v"), F.sum)})
    before = F.coalesce(F.sum("_v").over(_before(_in_bin(keys, order))), F.lit(0))
    return rows.withColumn(out, F.coalesce(F.col("_c"), F.lit(0)) + before).drop("_bin", "_v", "_c")


def headings(
    df: DataFrame, keys: Sequence[str], order: str, section: Column, chapter: Column, bin_size: float = BIN
) -> DataFrame:
    """Adds ``position``, ``above`` and ``last_chapter`` to rows in ``order`` (unique per key).

    ``above`` is ``struct(v)`` with the section of the row above, null on the first row;
    ``last_chapter`` is the nearest non-null chapter above.
    """
    df = df.withColumns({"_s": F.struct(section.alias("v")), "_h": _hit(order, chapter)})
    rows = _carry(df, keys, order, bin_size, {
        "_n": (F.count(F.lit(1)), F.sum),
        "_a": (F.max_by("_s", order), lambda c: F.last(c, ignorenulls=True)),
        "_c": (F.max("_h"), F.max),
    })
    w = _in_bin(keys, order)
    return rows.withColumns({
        "position": (F.coalesce(F.col("_n"), F.lit(0)) + F.row_number().over(w)).cast("bigint"),
        "above": F.coalesce(F.lag("_s").over(w), F.col("_a")),
        "last_chapter": F.coalesce(F.max("_h").over(_before(w)), F.col("_c")).getField("v"),
    }).drop("_bin", "_s", "_h", "_n", "_a", "_c")
