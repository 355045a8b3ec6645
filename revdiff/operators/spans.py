"""Range joins: which spans cover a point."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revdiff.sources.session import shuffled, spread


def _width(level: Column) -> Column:
    return F.pow(F.lit(2.0), level).cast("bigint")


def covering_join(points: DataFrame, spans: DataFrame, keys: Sequence[str], at: str | Sequence[str], lo: str | Sequence[str], hi: str | Sequence[str],
                  tasks: int | None = None) -> DataFrame:
    """Join each point to every span of its key with ``lo <= at <= hi``, on one axis or on several at once.

    A span of length up to 2**k lies in at most two bins of width 2**k, so spans are
    filed under (k, bin) and points look up one bin for each k that occurs under their
    key. The join is on (key, k, bin): a hot key spreads over its bins, and a point
    meets few spans that do not cover it. With several axes a span has a (k, bin) on each, so that a span
    that is long on one axis alone is met by points near it on the other. Points without a span drop out. ``tasks`` states the partitions of points.
    """
    at, lo, hi = ([x] if isinstance(x, str) else list(x) for x in (at, lo, hi))
    names = [c for c in spans.columns if c not in keys]
    axes = range(len(at))
    filed, asked_levels = spans, F.struct(*[F.col(f"_k{n}") for n in axes])
    for n in axes:
        level = F.ceil(F.log2(F.col(hi[n]) - F.col(lo[n]) + F.lit(1))).cast("int")
        filed = filed.filter(F.col(hi[n]) >= F.col(lo[n])).withColumn(f"_k{n}", level)
        width = _width(F.col(f"_k{n}"))
        filed = filed.withColumn(f"_b{n}", F.explode(F.sequence(F.floor(F.col(lo[n]) / width), F.floor(F.col(hi[n]) / width))))
    levels = filed.groupBy(*keys).agg(F.collect_set(asked_levels).alias("_ks"))
    asked = spread(points, tasks, *keys).join(shuffled(levels), list(keys)).withColumn("_k", F.explode("_ks")).drop("_ks")
    for n in axes:
        asked = asked.withColumn(f"_k{n}", F.col(f"_k._k{n}")).withColumn(f"_b{n}", F.floor(F.col(at[n]) / _width(F.col(f"_k._k{n}"))))
    binned = [*keys, *(f"_{c}{n}" for n in axes for c in "kb")]
    a, s = spread(asked.drop("_k"), tasks, *binned).alias("a"), filed.alias("s")
    cond = F.lit(True)
    for n in axes:
        cond = cond & F.col(f"a.{at[n]}").between(F.col(f"s.{lo[n]}"), F.col(f"s.{hi[n]}"))
    for key in binned:
        cond = cond & (F.col(f"a.{key}") == F.col(f"s.{key}"))
    kept = [F.col(f"a.{c}") for c in points.columns] + [F.col(f"s.{c}") for c in names]
    return a.join(shuffled(s), cond).select(*kept)
