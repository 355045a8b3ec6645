"""A1-style cell addresses and range lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What an address and a range token look like, and the last row and column of a sheet.
ADDRESS = r"^([A-Za-z]+)(\d+)$"
RANGE_TOKEN = r"^[A-Za-z]{1,3}[0-9]+(:[A-Za-z]{1,3}[0-9]+)?$"
LAST_ROW, LAST_COL = 1_048_576, 16_384


def address_col(address: Column) -> Column:
    """Column letters, upper-cased; the input itself when it is no address."""
    return F.when(address.rlike(ADDRESS), F.upper(F.regexp_extract(address, ADDRESS, 1))).otherwise(address)


def address_row(address: Column) -> Column:
    """Row number, 0 when the input is no address or the number overflows."""
    return F.coalesce(F.regexp_extract(address, ADDRESS, 2).try_cast("int"), F.lit(0))


def col_index(col: Column) -> Column:
    """Base-26 index of the column letters: A=1, Z=26, AA=27."""
    letters = F.split(F.upper(col), "")
    return F.aggregate(letters, F.lit(0), lambda acc, x: acc * 26 + F.ascii(x) - F.lit(64))


def range_tokens(ranges: Column) -> Column:
    """Split ``"B2:F40; H2"`` into ``struct(good, bad)`` arrays of tokens; a corner outside the sheet is bad."""
    from revdiff.functions.text import trim_ws

    tokens = F.filter(F.transform(F.split(ranges, ";"), trim_ws), lambda t: F.length(t) > 0)

    def sound(t: Column) -> Column:
        inside = lambda a: address_row(a).between(1, LAST_ROW) & col_index(address_col(a)).between(1, LAST_COL)
        return F.when(t.rlike(RANGE_TOKEN), F.forall(F.split(t, ":"), inside)).otherwise(F.lit(False))

    return F.struct(F.filter(tokens, sound).alias("good"), F.filter(tokens, lambda t: ~sound(t)).alias("bad"))


def col_letters(index: Column) -> Column:
    """Letters of a column index up to ``LAST_COL``; the inverse of ``col_index``."""
    digit = lambda n: F.char(65 + n % 26)
    n = index - 1
    return F.concat(
        F.when(n >= 702, digit(F.floor((n - 702) / 676))).otherwise(F.lit("")),
        F.when(n >= 26, digit(F.floor((n - 26) / 26))).otherwise(F.lit("")), digit(n),
    )
