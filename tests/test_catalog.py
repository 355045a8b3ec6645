"""Registered queries against their SQL on the smallest test tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as registered

DATA = Path("/root/testdata/sf0.001")
CHECKED = [
    "number_prefix", "dv_changed", "dv_display", "cf_display", "serial_date", "range_tokens", "address_order", "nonblank_rows",
    "range_grid", "attach_rules", "section_specs", "span_specs", "span_expand", "asof_header", "interval_first",
    "cell_diff_full", "extract_risk", "question_diff", "general_question_diff",
]


def test_every_sql_has_a_query():
    assert set(registered.oracle_sql()) <= set(registered.queries())


def _rows(names, rows):
    at = [names.index(c) for c in sorted(names)]
    shown = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(shown(r[i]) for i in at) for r in rows)


@pytest.mark.skipif(not DATA.exists(), reason="test tables are not there")
@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for file in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    want = con.execute(registered.oracle_sql()[name])
    names = [d[0] for d in want.description]
    df = registered.queries()[name](spark, str(DATA))
    assert sorted(df.columns) == sorted(names)
    assert _rows(df.columns, df.collect()) == _rows(names, want.fetchall())
