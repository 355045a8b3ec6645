import zlib
from functools import cache

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from revdiff.llm import packing, tokens
from revdiff.llm.token_counts import token_counts

from . import cases

WORD, PIECE, BYTES = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "piece_bpe_32k.model", "byte_bpe_50k.json"))


@cache
def library(path):
    return SentencePieceProcessor(model_file=path) if path == PIECE else Tokenizer.from_file(path)


@cache
def ids(text, path=WORD):
    return library(path).encode(text) if path == PIECE else library(path).encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("aàAÉzσΣ' .,<|endoftx>\n\t\x1c\x85　́İß9½😀中"), max_size=60))
def test_words_alone_give_the_ids_of_the_text(text):
    assert np.frombuffer(tokens.encoder(WORD, False)([text])[0], "<u4").tolist() == ids(text)
    assert tokens.encoder(WORD, True)([text]) == [len(ids(text))]


def test_tables_start_anew(monkeypatch):
    monkeypatch.setattr(tokens, "WORDS", 20)
    encode = tokens._WordEncoder(WORD, False)
    for n in range(60):
        text = " ".join(f"{'abcdefghijklmnop'[n % 16]}word{'xyz'[k % 3] * (k % 7)}{'.' * (k % 2)} The é{n}" for k in range(n % 9))
        assert np.frombuffer(encode([text])[0], "<u4").tolist() == ids(text)
        assert len(encode.words) <= 40 and len(encode.cores) <= 40


@pytest.mark.parametrize("path", [WORD, PIECE, BYTES])
def test_parts_give_the_ids_of_the_text(path, monkeypatch):
    monkeypatch.setattr(tokens, "PART_CHARS", 40)
    monkeypatch.setattr(tokens, "split_safe", lambda text, size=40, f=tokens.split_safe: f(text, size))
    text = cases.LONG[:3000] + "  two  spaces \n\n lines\n and 'tis don't  end " + "y" * 300 + " z" * 50
    assert len(tokens.split_safe(text)) > 30
    assert np.frombuffer(tokens.encoder(path, False)([text])[0], "<u4").tolist() == ids(text, path)


def test_token_counts_of_odd_rows(spark):
    docs = cases.documents(spark, cases.ODD)
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(docs, WORD, batch_bytes=50).collect())
    want = sorted((i or 0, len((t or "").encode()), len(ids(t or "")), len(ids(t or "")) > 2048) for i, t, *_ in cases.ODD)
    assert got == want
    assert token_counts(docs.limit(0), WORD).count() == 0


def best_fit_decreasing(lengths, window):
    left = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(left) if r >= n]
        if fits:
            left[min(fits)[1]] -= n
        else:
            left.append(window - n)
    return sorted(left)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 24), max_size=80))
def test_plan_is_best_fit_decreasing(lengths):
    counts = {n: lengths.count(n) for n in lengths}
    steps, used = packing.plan(counts, 24), {}
    for n, many in counts.items():
        own = steps[steps[:, 0] == n]
        for rank in range(many):
            _, a, each, first, offset = own[np.searchsorted(own[:, 1], rank, "right") - 1]
            nth = rank - a
            place = used.setdefault(first + nth // each, set())
            taken = set(range(offset + nth % each * n, offset + nth % each * n + n))
            assert not place & taken
            place |= taken
    assert all(p == set(range(len(p))) for p in used.values())
    assert sorted(24 - len(p) for p in used.values()) == best_fit_decreasing(lengths, 24)


def test_packing_keeps_every_id(spark):
    docs = cases.documents(spark, cases.ODD)
    packed = packing.pack(docs, WORD, window=512, keep_ids=True)
    rows = packed.collect()
    texts = {i: t for i, t, *_ in cases.ODD if i is not None}
    for r in rows:
        if r.doc_id is not None:
            whole = [*ids(texts[r.doc_id] or ""), 2]
            assert r.ids == whole[r.start : r.start + r.length] and r.doc_tokens == len(whole)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids) <= 512
    assert sum(r.length for r in rows) == sum(len(ids(t or "")) + 1 for _, t, *_ in cases.ODD)
    fill = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
    whole = {r.sequence_id: r for r in packing.sequences(packed, 512).collect()}
    assert {k: r.n_tokens for k, r in whole.items()} == fill
    assert all(len(r.ids) == (512 if r.n_tokens & (r.n_tokens - 1) else r.n_tokens) for r in whole.values())
    assert packing.pack(docs.limit(0), WORD).count() == 0
