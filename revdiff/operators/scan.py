"""Operators over the long-form ``cells`` table.

``cells(pair_id, side, sheet, row_num, col, col_idx, text[, dv, cf])``
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revdiff.functions.address import address_col, address_row, col_index, range_tokens
from revdiff.functions.text import is_blank
from revdiff.operators.spans import covering_join
from revdiff.sources.session import shuffled, spread

SHEET = ["pair_id", "side", "sheet"]
CELL = [*SHEET, "row_num", "col_idx"]

_RANGES = 1 << 31
#: Addresses for one task, about 300 MB in a sort or an aggregation.
TASK_ADDRESSES = 1_000_000
# Validation types whose operator has no meaning.
DV_WITHOUT_OPERATOR = ["List", "Custom", "AnyValue"]


def nonblank_rows(cells: DataFrame) -> DataFrame:
    """All cells of the rows that have text somewhere. A row is one window: 16,384 columns at most."""
    row = Window.partitionBy(*SHEET, "row_num")
    return (
        cells.withColumn("_any", F.max(~is_blank(F.col("text"))).over(row)).filter("_any").drop("_any")
    )


def split_ranges(args: DataFrame, ranges: str = "ranges") -> DataFrame:
    """Adds ``good`` and ``bad`` token arrays."""
    return args.withColumn("_t", range_tokens(F.col(ranges))).select("*", "_t.good", "_t.bad").drop("_t")


def range_errors(args: DataFrame) -> DataFrame:
    """``pair_id, side, sheet, error`` of every entry with bad tokens, all of them listed; such an entry has no grid."""
    bad = split_ranges(args).filter(F.size("bad") > 0)
    return bad.select(*SHEET, F.concat(F.lit("bad ranges: "), F.array_join("bad", "; ")).alias("error"))


def range_rectangles(args: DataFrame) -> DataFrame:
    """Disjoint rectangles of the addresses of ``args``; entries with a bad token are left out."""
    a, b = F.split("token", ":")[0], F.element_at(F.split("token", ":"), -1)
    corners = (
        split_ranges(args).filter(F.size("bad") == 0)
        .select(*SHEET, F.explode("good").alias("token"))
        .select(
            *SHEET,
            address_row(a).alias("ra"), address_row(b).alias("rb"),
            col_index(address_col(a)).alias("ca"), col_index(address_col(b)).alias("cb"),
        )
    )
    return disjoint_rectangles(corners.selectExpr(*SHEET, "least(ra, rb) r1", "least(ca, cb) c1", "greatest(ra, rb) r2", "greatest(ca, cb) c2"))


def grid_tasks(rectangles: DataFrame) -> int:
    """Partition count for the grid of ``rectangles``, by its addresses. Runs a job over them, not over the grid."""
    area = F.expr("sum((r2 - r1 + 1) * CAST(c2 - c1 + 1 AS BIGINT))")
    return max(rectangles.sparkSession.sparkContext.defaultParallelism, (rectangles.agg(area).first()[0] or 0) // TASK_ADDRESSES + 1)


def range_grid(args: DataFrame, cells: DataFrame) -> DataFrame:
    """Every address of ``args(pair_id, side, sheet, ranges)``, blank ones included, each once.
    Entries with a bad token are left out; ``range_errors`` lists them."""
    return rectangle_grid(range_rectangles(args), cells)


def rectangle_grid(rectangles: DataFrame, cells: DataFrame, tasks: int | None = None) -> DataFrame:
    """Every address of disjoint ``rectangles`` with its cell, if any. ``tasks`` states the partitions."""
    grid = (
        rectangles.select(*SHEET, "c1", "c2", F.explode(F.sequence("r1", "r2")).alias("row_num"))
        .select(*SHEET, "row_num", F.explode(F.sequence("c1", "c2")).alias("col_idx"))
    )
    return spread(grid, tasks, *CELL).join(shuffled(cells) if tasks else cells, CELL, "left")


def disjoint_rectangles(rectangles: DataFrame) -> DataFrame:
    """Rectangles ``r1, c1, r2, c2`` that cover the same addresses of each sheet, each address once.

    A sweep over the rows at which a rectangle begins or ends: in the bands between them the
    column ranges of the rectangles that span the band are joined where they touch. So addresses
    need not be made distinct afterwards. A sheet's rectangles meet in one row, its addresses never.
    """
    sheets = rectangles.groupBy(*SHEET).agg(F.collect_set(F.struct("r1", "c1", "r2", "c2")).alias("all"))
    bands = sheets.withColumn("cuts", F.expr("array_sort(array_distinct(concat(transform(all, x -> x.r1), transform(all, x -> x.r2 + 1))))")).select(
        *SHEET, "all", F.expr("explode(transform(slice(cuts, 2, size(cuts)), (hi, i) -> struct(cuts[i] AS r1, hi - 1 AS r2)))").alias("band")
    )
    spans = bands.select(*SHEET, "band", F.expr(
        "array_sort(transform(filter(all, x -> x.r1 <= band.r1 AND x.r2 >= band.r2), x -> struct(x.c1, x.c2)))"
    ).alias("spans"))
    joined = spans.select(*SHEET, "band", F.expr("""explode(aggregate(spans, slice(spans, 1, 0), (done, x) -> IF(
        size(done) > 0 AND element_at(done, -1).c2 >= x.c1 - 1,
        concat(slice(done, 1, size(done) - 1), array(struct(element_at(done, -1).c1 AS c1, greatest(element_at(done, -1).c2, x.c2) AS c2))),
        concat(done, array(x)))))""").alias("span"))
    return joined.select(*SHEET, "band.r1", "span.c1", "band.r2", "span.c2")


def attach_rules(cells: DataFrame, rules: DataFrame, tasks: int | None = None) -> DataFrame:
    """Adds ``dv`` and ``cf``: for each cell the first rule of each kind that covers it.

    ``rules(pair_id, side, sheet, kind, rule_ord, range_ord, r1, c1, r2, c2, type, op, v1, v2)``;
    first means lowest (rule_ord, range_ord). ``tasks`` states the partitions of addresses.
    """
    # only addresses and ranks take part in the range join, on both axes at once; text moves once, in the join back
    rank = (F.col("rule_ord").cast("bigint") * _RANGES + F.col("range_ord")).alias("rank")
    where = rules.select(*SHEET, "kind", rank, "r1", "c1", "r2", "c2")
    covered = covering_join(cells.select(*CELL), where, SHEET, ["row_num", "col_idx"], ["r1", "c1"], ["r2", "c2"], tasks)
    first = spread(covered, tasks, *CELL).groupBy(*CELL).agg(
        *[F.min(F.when(F.col("kind") == kind, F.col("rank"))).alias(f"{kind}_rank") for kind in ("dv", "cf")]
    )
    op = F.when(F.col("type").isin(DV_WITHOUT_OPERATOR), F.lit(None)).otherwise(F.col("op"))
    struct = {
        "dv": F.struct("type", op.alias("op"), F.col("v1").alias("f1"), F.nullif("v2", F.lit("")).alias("f2")),
        "cf": F.struct("type", "op", "v1", "v2"),
    }
    for kind, rule in struct.items():
        named = rules.filter(F.col("kind") == kind).select(*SHEET, rank.alias(f"{kind}_rank"), rule.alias(kind))
        first = spread(first, tasks, *SHEET, f"{kind}_rank").join(shuffled(named.dropDuplicates([*SHEET, f"{kind}_rank"])), [*SHEET, f"{kind}_rank"], "left")
    return cells.join(shuffled(spread(first.select(*CELL, "dv", "cf"), tasks, *CELL)), CELL, "left")
