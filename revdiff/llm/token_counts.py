"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from revdiff.llm.common import byte_slices, text_bytes
from revdiff.llm.tokens import encoder


def token_counts(
    docs: DataFrame, tokenizer: str, limit: int = 2048, batch_bytes: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id_col, n_bytes, n_tokens, over_limit``: one row per row of ``docs``.

    ``tokenizer`` is a vocabulary file (``.json`` or ``.model``) that every executor can open.
    Tokens are counted without begin, end or added tokens and without truncation.
    Batches hold about ``batch_bytes`` of text, whatever the number of rows; longer texts are
    encoded in parts that end at safe boundaries (see ``tokens``). No shuffle, one scan.

    A null text counts as empty: 0 bytes, 0 tokens, not over the limit. A null id stays null.
    Repeated rows are counted row by row. An empty table gives no rows. Other columns are
    not read, whatever their names.
    """
    rows = docs.select(docs[id_col], docs[text_col])
    schema = T.StructType([
        T.StructField(id_col, rows.schema[0].dataType), T.StructField("n_bytes", T.LongType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType()),
    ])

    def count(batches):
        for batch in byte_slices(batches, 1, batch_bytes):
            texts = batch.column(1)
            counts = encoder(tokenizer, True)([x or "" for x in texts.to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(text_bytes(texts)), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())],
                names=schema.names,
            )

    return rows.mapInArrow(count, schema)
