"""Registered queries against their SQL, and the pipeline's stages, on the smallest tables."""

import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from revdiff.llm import near_dup, queries

from . import cases

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="test tables are not there")


def rows(names, found):
    at = [names.index(c) for c in sorted(names)]
    return sorted(tuple(f"{r[i]:.9g}" if isinstance(r[i], float) else str(r[i]) for i in at) for r in found)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for file in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    want = con.execute(queries.SQL[name])
    names = [d[0] for d in want.description]
    df = queries.QUERIES[name](spark, str(DATA))
    assert rows(df.columns, df.collect()) == rows(names, want.fetchall())


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(str(DATA / "documents.parquet"))
    columns, n = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        path = str(tmp_path / str(k))
        stage(spark, docs, str(DATA)).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns and docs.count() > 0.5 * n, name
        if k == 1:
            assert near_dup.near_duplicates(docs).filter("NOT kept").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(DATA))
    assert packed.selectExpr("sum(length) n").first().n == packed.filter("start = 0").selectExpr("sum(doc_tokens) n").first().n


def test_pipeline_ends_in_token_ids(spark):
    docs = spark.read.parquet(str(DATA / "documents.parquet")).limit(20)
    docs = docs.union(docs)  # a document may come several times
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(DATA)).collect()
    by = {}
    for r in packed:
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        by.setdefault(r.doc_id, []).extend(r.ids)
    tokens = Tokenizer.from_file(queries.WORD_BPE)
    for r in docs.distinct().collect():
        assert sorted(by[r.doc_id]) == sorted(2 * [*tokens.encode(r.text or "", add_special_tokens=False).ids, 2])
    places = [(r.sequence_id, r.offset) for r in packed]
    assert len(set(places)) == len(places)


def test_pipeline_of_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows and clashing columns go through; so does an empty table."""
    docs = cases.documents(spark, [r for r in cases.ODD if r[0] != 7] + [(100 + i, f"{i} the quick brown fox and some more words of it {i}", "en", "a") for i in range(12)])
    none, columns = docs.limit(0), docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, "").collect(), docs.schema)
        assert docs.columns == columns and stage(spark, none, "").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert len({(r.sequence_id, r.offset) for r in packed}) == len(packed) >= docs.count() > 5
    assert corpus_pipeline.STAGES[-1][1](spark, none, "").count() == 0
