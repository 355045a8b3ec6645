"""Small display values of the report tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def similarity_band(score: Column) -> Column:
    return F.when(score >= 0.80, "green").when(score >= 0.60, "amber").otherwise("red")


def similarity_pct(score: Column) -> Column:
    """Half-up percentage, as a browser rounds it."""
    return F.floor(score * F.lit(100.0) + F.lit(0.5)).cast("int")


def ambiguous(score: Column, second_best: Column) -> Column:
    return F.coalesce((score - second_best) < F.lit(0.10), F.lit(False))


def change_badges(**flags: Column) -> Column:
    """Badges of the raised flags, in argument order."""
    return F.array_compact(F.array(*[F.when(flag, F.lit(badge)) for badge, flag in flags.items()]))


def cell_label(col: Column, row_offset: Column) -> Column:
    return F.concat(col, F.lit("["), row_offset.cast("string"), F.lit("]"))


def cell_marker(old_text: Column, new_text: Column) -> Column:
    return F.when(old_text.isNull(), "new").when(new_text.isNull(), "gone")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def escape_html(c: Column) -> Column:
    """Escape ``& < > "``; null gives ''."""
    out = F.coalesce(c, F.lit(""))
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out
