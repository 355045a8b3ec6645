"""Awkward tables: nulls everywhere, empty and long texts, ties, repeated rows, clashing names."""

from pathlib import Path

DATA = Path("/root/testdata/sf0.001")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, _text string, _h1 long, n_words long, size long, row long, bucket long"


def documents(spark, rows):
    """``rows``: (doc_id, text[, lang, source]); the other columns only get in the way."""
    full = []
    for r in rows:
        doc_id, text, lang, source = (*r, *([None] * (4 - len(r))))
        full.append((doc_id, text, lang, source, None, 7, "k", "other", 1, 2, 3, 4, 5))
    return spark.createDataFrame(full, SCHEMA)


LONG = " ".join(f"word{i % 977} and, then." for i in range(40_000))
ODD = [
    (1, None, "en", "a"), (2, "", "en", None), (3, " \t\n ", None, "a"), (4, "one", "en", "a"), (4, "one", "en", "a"), (None, "no id at all", "en", "b"),
    (None, None, None, None), (5, "the same text twice over here", "en", "b"), (6, "the same text twice over here", "de", "b"), (7, LONG, "en", "a"),
    (8, "é😀 Ünï​ code　points\x1cand\x85more", "fr", "b"), (9, "x" * 70_000, "en", "a"), (10, "<|endoftext|> a<|startoftext|>b", "en", "a"),
]
