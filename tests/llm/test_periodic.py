import hashlib
import random
import zlib

import pytest

from revdiff.llm import periodic, queries

from . import cases


def runs(words):
    """All runs, by comparing each word with the one a period later, for every period."""
    out, seen = [], set()
    for q in range(1, len(words) // 4 + 1):
        k = 0
        while k + q < len(words):
            j = k
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > k and j + q - k >= max(6, 4 * q) and (k, j + q) not in seen:
                seen.add((k, j + q))
                out.append((k, j + q - k, q))
            k = max(j, k + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, found):
    dropped = {i for s, n, q in found for i in range(s + q, s + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in dropped)


def texts():
    rng, out = random.Random(7), []
    for n in range(400):
        words = [rng.choice("abcde"[: 1 + n % 5]) for _ in range(rng.randrange(70))]
        if n % 2 and words:
            p = rng.randrange(1, 9)
            words = [words[k % min(p, len(words))] for k in range(len(words))]
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = rng.choice("abz")
        out.append((n, rng.choice((" ", "\n", " \t\x0b")).join(words)))
    loop = [f"w{i}" for i in range(300)]
    return out + [(1000, " ".join(loop * 5)), (1001, " ".join(loop * 4)), (1002, " ".join((loop * 4)[:-1])), (1003, "x " * 5000 + "y " * 6), (1004, "a\x1ca a a a a a a")]


def test_runs_and_collapsed_texts(spark):
    rows = texts() + [(r[0], r[1]) for r in cases.ODD if r[0] != 7]
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.periodic_runs(cases.documents(spark, rows), batch_bytes=700).collect()), key=str)
    want = []
    for doc_id, text in rows:
        words = (text or "").encode().split()
        found = runs(words)
        want.append((doc_id, len(words), found, collapsed(words, found).decode()))
    assert got == sorted(want, key=str)
    assert periodic.periodic_runs(cases.documents(spark, rows).limit(0)).count() == 0


def test_long_text(spark):
    period = 977 * 3  # the words of LONG come again after 977 repetitions of three
    (got,) = periodic.periodic_runs(cases.documents(spark, [(7, cases.LONG)])).collect()
    assert [tuple(r) for r in got.runs] == [(0, 120_000, period)] and len(got.collapsed.split()) == period


@pytest.mark.skipif(not cases.DATA.exists(), reason="test tables are not there")
def test_query(spark):
    want = {}
    for r in spark.read.parquet(str(cases.DATA / "documents.parquet")).collect():
        words = (r.text or "").encode().split()
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        found = runs(words)
        s, length, q = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
        text = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        want[r.doc_id] = (len(found), s, length, q, 1000 * length // q if q else None, hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(collapsed(words, found)).hexdigest())
    got = queries.op13_periodic_runs(spark, str(cases.DATA))
    assert {r.doc_id: tuple(r)[1:] for r in got.collect()} == want
    assert sum(1 for x in want.values() if x[0]) > 5
