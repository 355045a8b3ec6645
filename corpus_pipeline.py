"""From raw documents to packed sequences: the training-data operators in a row.

Each stage takes what its predecessor kept (written as Parquet and read again) and returns the
columns of documents; the last one returns the packed pieces with their token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revdiff.llm import langid, mixing, near_dup, packing, pii
from revdiff.llm.common import cut_lineage, read
from revdiff.llm.queries import WORD_BPE


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told go on; others (no letters, unlike any language) are rejected."""
    return langid.keep_identified(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class goes on."""
    return near_dup.drop_near_duplicates(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become their kind in brackets; ``n_chars`` follows the text."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the one at which a quota ends in part."""
    mixed = mixing.mixed_documents(docs)
    return mixed.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else mixed


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their token ids and places in sequences of 4096 tokens;
    ``packing.sequences`` makes the padded sequences of them."""
    return packing.pack(docs, WORD_BPE, keep_ids=True)


STAGES = [
    ("language identification", identify_language),
    ("near-duplicate removal", drop_copies),
    ("personal data", redact_personal_data),
    ("source mixing", mix_sources),
    ("packing", pack),
]
#: SQL can express neither the trained models nor the tokenizer; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
