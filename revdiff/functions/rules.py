"""Comparing and rendering data-validation (dv) and conditional-format (cf) rules.

A rule is a nullable struct: ``dv<type, op, f1, f2>`` or ``cf<type, op, v1, v2>``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from revdiff.functions.text import trim_ws

# Display words of rule types and operators.
DV_TYPE_WORDS = {
    "WholeNumber": "Whole number",
    "Decimal": "Decimal",
    "Date": "Date",
    "Time": "Time",
    "TextLength": "Text length",
}
DV_OPERATOR_WORDS = {
    "EqualTo": "equal to",
    "NotEqualTo": "not equal to",
    "GreaterThan": "greater than",
    "LessThan": "less than",
    "EqualOrGreaterThan": "greater than or equal to",
    "EqualOrLessThan": "less than or equal to",
    "Between": "between",
    "NotBetween": "not between",
}
CF_OPERATOR_WORDS = {
    "Equal": "equal to",
    "NotEqual": "not equal to",
    "GreaterThan": "greater than",
    "LessThan": "less than",
    "EqualOrGreaterThan": "greater than or equal to",
    "EqualOrLessThan": "less than or equal to",
    "Between": "between",
    "NotBetween": "not between",
}
NO_RULE = "—"

_DAY = 86_400_000  # milliseconds


def _words(table: dict[str, str], key: Column) -> Column:
    """Case-insensitive lookup; unknown keys pass through, null gives ''."""
    pairs = [F.lit(x) for k, v in table.items() for x in (k.lower(), v)]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.lower(key)), key, F.lit(""))


def _is(c: Column, word: str) -> Column:
    return F.coalesce(F.lower(c) == word.lower(), F.lit(False))


def _inline(formula: Column) -> Column:
    return ~formula.startswith("=") & ~formula.contains("$")


def _items(formula: Column) -> Column:
    bare = F.regexp_replace(trim_ws(formula), r'^"+|"+$', "")
    return F.filter(F.transform(F.split(bare, ","), trim_ws), lambda x: F.length(x) > 0)


def list_values_equal(a: Column, b: Column) -> Column:
    """Inline lists compare as multisets of items; references ignore case."""
    both_inline = _inline(a) & _inline(b)
    return (
        F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull())
        .when(both_inline, F.array_sort(_items(a)) == F.array_sort(_items(b)))
        .otherwise(F.lower(a) == F.lower(b))
    )


def dv_changed(old: Column, new: Column) -> Column:
    o, n = (lambda k: old.getField(k)), (lambda k: new.getField(k))
    same_rest = o("op").eqNullSafe(n("op")) & o("f1").eqNullSafe(n("f1")) & o("f2").eqNullSafe(n("f2"))
    return (
        F.when(~o("type").eqNullSafe(n("type")), F.lit(True))
        .when(o("type").isNull(), F.lit(False))
        .when(_is(o("type"), "List"), ~list_values_equal(o("f1"), n("f1")))
        .otherwise(~same_rest)
    )


def cf_changed(old: Column, new: Column) -> Column:
    same = F.lit(True)
    for k in ("type", "op", "v1", "v2"):
        same = same & old.getField(k).eqNullSafe(new.getField(k))
    return ~same


def serial_date(raw: Column, kind: Column) -> Column:
    """Render a day-count serial as date, date and time, or time of day; no time zone is involved.

    Rounded to milliseconds first: 45458.3958333333 is 09:30:00, not 09:29:59. Below zero
    the fraction still counts forward: -1.25 is 06:00 on the day before day zero. Text that
    is no number, or no day in years 100 to 9999, passes through; null gives ''.
    """
    number = raw.try_cast("double")
    serial = F.when((number > -657435) & (number < 2958466), number)
    signed = F.round(serial * _DAY).cast("bigint")
    millis = F.when(signed < 0, signed - (signed % _DAY) * 2).otherwise(signed)
    days = F.floor(millis / F.lit(_DAY))
    seconds = F.floor((millis - days * _DAY) / 1000)
    clock = F.format_string("%02d:%02d:%02d", F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60)
    day = F.date_add(F.lit("1899-12-30").cast("date"), days.cast("int")).cast("string")
    shown = F.when(_is(kind, "Time"), clock).when(millis == days * _DAY, day).otherwise(F.concat_ws(" ", day, clock))
    dated = _is(kind, "Date") | _is(kind, "Time")
    return F.coalesce(F.when(dated & serial.isNotNull(), shown), raw, F.lit(""))


def dv_display(dv: Column) -> Column:
    kind, op, f1, f2 = (dv.getField(k) for k in ("type", "op", "f1", "f2"))
    listed = F.when(_inline(f1), F.array_join(_items(f1), " | ")).otherwise(f1)
    ranged = _is(op, "Between") | _is(op, "NotBetween")
    value = F.when(
        ranged, F.concat(serial_date(f1, kind), F.lit(" and "), serial_date(f2, kind))
    ).otherwise(serial_date(f1, kind))
    return (
        F.when(kind.isNull() | _is(kind, "AnyValue"), F.lit(NO_RULE))
        .when(_is(kind, "List"), F.when(f1.isNull(), F.lit("List")).otherwise(F.concat(F.lit("List: "), listed)))
        .when(_is(kind, "Custom"), F.concat(F.lit("Custom: "), F.coalesce(f1, F.lit(""))))
        .otherwise(
            F.concat(_words(DV_TYPE_WORDS, kind), F.lit(", "), _words(DV_OPERATOR_WORDS, op), F.lit(", "), value)
        )
    )


def cf_display(cf: Column) -> Column:
    kind, op = cf.getField("type"), cf.getField("op")
    v1, v2 = (F.coalesce(cf.getField(k), F.lit("")) for k in ("v1", "v2"))
    ranged = _is(op, "Between") | _is(op, "NotBetween")
    value = F.when(ranged, F.concat(v1, F.lit(" and "), v2)).otherwise(v1)
    return (
        F.when(kind.isNull(), F.lit(NO_RULE))
        .when(_is(kind, "CellIs"), F.concat(_words(CF_OPERATOR_WORDS, op), F.lit(" "), value))
        .when(_is(kind, "Expression"), F.concat(F.lit("Formula: "), v1))
        .otherwise(kind)
    )
