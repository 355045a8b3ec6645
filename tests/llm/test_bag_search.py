import math
import re

from revdiff.llm import bag_search

from . import cases

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string, id long, no long, bag string"


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, top):
    found = [(i, terms(t)) for i, t in docs]
    n_docs, total = sum(1 for _, t in found if t), sum(len(t) for _, t in found)
    df = {}
    for _, t in found:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    own = {}
    for item, text in items:
        own.setdefault(item, set()).update(terms(text))
    out = []
    for item, wanted in own.items():
        scored = []
        for doc_id, t in found:
            m = 50 + (50 * len(t) * n_docs) // max(1, total)
            score = 0
            for x in wanted & set(t):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1)))
                score += w * (10**9 * t.count(x) // (1000 * t.count(x) + 20 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item, rank, doc_id, -s) for rank, (s, _, _, doc_id) in enumerate(sorted(scored, key=lambda r: r[:3])[:top], 1)]
    return sorted(out, key=str)


def items(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], ITEMS)


ASKED = [(1, "One, THE same text twice"), (2, "word3 word976 Ünï"), (3, "no such thing xyzzy"), (4, ""), (5, None), (None, "id at all"), (6, "the text"), (6, "over points x"), (7, "a b endoftext")]


def test_odd_rows(spark):
    rows = [(r[0], r[1]) for r in cases.ODD] + [(30, "THE TEXT. the-text_the"), (31, "ÄB äb Äb"), (32, "K kelvin K")]
    for top in (2, 50):
        got = bag_search.search(cases.documents(spark, rows), items(spark, ASKED), top).collect()
        assert sorted((tuple(r) for r in got), key=str) == brute(rows, ASKED, top)


def test_hot_classes_blocks_and_hash_collisions(spark, monkeypatch):
    rows = [(1000 - i, "the same text twice" if i % 3 else f"the other text {i % 5} one") for i in range(300)]
    rows += [(2000 + i, f"The SAME; text twice {i} word") for i in range(120)] + [(-5, "text twice same the"), (None, "the same text twice")]
    docs = cases.documents(spark, rows)
    want = brute(rows, ASKED, 50)
    monkeypatch.setattr(bag_search, "SMALL", 0)  # classes are joined by shuffle
    got = bag_search.search(docs, items(spark, ASKED), block_terms=4).collect()  # many blocks
    assert sorted((tuple(r) for r in got), key=str) == want
    monkeypatch.setattr(bag_search.F, "xxhash64", lambda *c: bag_search.F.lit(7).cast("long"))  # all bags collide
    got = bag_search.search(docs, items(spark, ASKED)).collect()
    assert sorted((tuple(r) for r in got), key=str) == want


def test_classes_are_scored_once(spark):
    docs = cases.documents(spark, [(i, f"{'one two' if i % 2 else 'Two-ONE'} x{i}") for i in range(100)])
    members = bag_search.bags(docs, ["one", "two"])
    assert members.count() == 100 and members.select("n", "bag").distinct().count() == 1


def test_no_documents_or_items(spark):
    docs, asked = cases.documents(spark, [(1, "a b"), (2, None)]), items(spark, [(1, "a")])
    assert bag_search.search(docs, asked.limit(0)).count() == 0
    assert bag_search.search(docs.limit(0), asked).count() == 0
    assert bag_search.search(docs, items(spark, [(1, "?"), (2, None)])).count() == 0
