"""Text scalars. All are plain column expressions that stay inside the JVM, but for the distance of long texts.

``(?U)`` makes the whitespace and digit classes Unicode-aware, so a no-break
space counts as blank.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from revdiff.functions.edits import pair_distance

#: Table cells from which the bit-vector form in Python is faster than the built-in ``levenshtein``.
LONG_CELLS = 1 << 11
NUMBER_PREFIX = r"(?U)^\s*(\d+\.\d+)\)?\s*"
#: What ``(?U)\s`` matches.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def trim_ws(c: Column) -> Column:
    """Strip Unicode whitespace at both ends; the text between is not looked at."""
    return F.trim(c, F.lit(SPACES))


def is_blank(c: Column) -> Column:
    """Null, empty, or whitespace only."""
    return ~F.coalesce(c.rlike(r"(?U)\S"), F.lit(False))


def normalize_text(c: Column) -> Column:
    """Trim, collapse whitespace runs to one space, lower-case."""
    return F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))


def text_similarity(a: Column, b: Column) -> Column:
    """``1 - edit distance / longer length`` of the normalised texts."""
    return normalized_similarity(normalize_text(F.coalesce(a, F.lit(""))), normalize_text(F.coalesce(b, F.lit(""))))


def normalized_similarity(x: Column, y: Column) -> Column:
    """The same of texts that are normalised already. Best given as columns of a table: they are named several times, and
    an expression in their place is worked out each time."""
    longer = F.greatest(F.length(x), F.length(y))
    long = (x != y) & (F.length(x).cast("bigint") * F.length(y) >= LONG_CELLS)
    distance = F.when(long, pair_distance(F.when(long, x), F.when(long, y))).otherwise(F.levenshtein(x, y).cast("bigint"))
    return (
        F.when(x == y, F.lit(1.0))
        .when((F.length(x) == 0) | (F.length(y) == 0), F.lit(0.0))
        .otherwise(F.lit(1.0) - distance.cast("double") / longer.cast("double"))
    )


def strip_number_prefix(c: Column) -> Column:
    """``"3.5) Some text"`` -> ``"Some text"``."""
    return trim_ws(F.regexp_replace(c, NUMBER_PREFIX, ""))


def extract_number(c: Column) -> Column:
    """``"3.5) Some text"`` -> ``"3.5"``; null when there is no prefix."""
    return F.nullif(F.regexp_extract(c, NUMBER_PREFIX, 1), F.lit(""))
