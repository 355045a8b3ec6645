import random
from collections import Counter

import numpy as np
import pyarrow as pa

from revdiff.llm import near_dup
from revdiff.llm.graph import components

from . import cases


def shingles(text):
    words = (text or "").lower().split()
    return Counter(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else Counter()


def classes(rows):
    """Smallest id of each document's component, comparing all pairs."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = sum((a & sets[j]).values())
            if both and both / (sum(a.values()) + sum(sets[j].values()) - both) >= 0.8:
                root[find(i)] = find(j)
    out = {}
    for i, (doc_id, _) in enumerate(rows):
        out.setdefault(find(i), []).append((doc_id is None, doc_id or 0, doc_id))
    return [min(out[find(i)])[2] for i in range(len(rows))]


def family(rng, first_id, size, words=120, most=0.06):
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    rows = [(first_id, " ".join(base))]
    for n in range(1, size):
        copy = list(base)
        for _ in range(int(rng.random() * most * words)):
            copy[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        rows.append((first_id + n, " ".join(copy)))
    return rows


def test_families_of_near_copies(spark):
    rng = random.Random(3)
    rows = family(rng, 100, 90) + family(rng, 300, 12, words=30, most=0.2) + family(rng, 400, 2) + family(rng, 500, 60, most=0.12)
    rows += [(1000 + i, " ".join(f"u{rng.randrange(9000)}" for _ in range(60))) for i in range(30)]
    rows += [(2000 + i, rows[5][1].upper()) for i in range(40)] + [(3000, "a b c"), (3001, "A  b c"), (3002, "a b d"), (3003, "a a a a a a a a"), (3004, "a a a a a a a a a")]
    rng.shuffle(rows)
    got = {r.doc_id: (r.class_id, r.kept) for r in near_dup.near_duplicates(cases.documents(spark, rows)).collect()}
    want = dict(zip((i for i, _ in rows), classes(rows), strict=True))
    assert {i: c for i, (c, _) in got.items()} == want
    assert {i for i, (_, kept) in got.items() if kept} == set(want.values())


def test_hot_group(spark):
    """Hundreds of near copies around one text, a third of them too far from it to be linked to it
    directly, copies of those, and cut-off versions: no link is lost, and few pairs are compared."""
    rng = random.Random(12)
    rows = family(rng, 1, 400, words=100, most=0.09)
    for i in range(60):  # near copies of copies
        words = rows[rng.randrange(400)][1].split()
        words[rng.randrange(100)] = f"y{i}"
        rows.append((1000 + i, " ".join(words[: rng.choice((100, 100, 78, 82, 70))])))
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(cases.documents(spark, rows)).collect()}
    want = dict(zip((i for i, _ in rows), classes(rows), strict=True))
    assert len(set(want.values())) > 10
    lost = sum(got[i] != c for i, c in want.items())
    assert lost <= 1, lost  # a pair at 0.8 shares no band with probability 3e-6


def test_odd_rows(spark):
    docs = cases.documents(spark, [r for r in cases.ODD if r[0] != 7])
    got = near_dup.near_duplicates(docs).collect()
    assert len(got) == len(cases.ODD) - 1
    assert sorted((r.doc_id, r.class_id, r.kept) for r in got if r.doc_id in (1, 2, 3, 5, 6)) == [
        (1, 1, True), (2, 2, True), (3, 3, True), (5, 5, True), (6, 5, False)
    ]
    assert sorted(r.kept for r in got if r.doc_id == 4) == [False, True]
    kept = near_dup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, i) for i in (1, 2, 3, 4, 5, 8, 9, 10)] + [(True, 0)] * 2
    assert near_dup.near_duplicates(docs.limit(0)).count() == 0


def test_signatures_agree_as_often_as_texts_are_similar():
    rng, shares, truth = random.Random(5), [], []
    for n in range(60):
        (_, a), (_, b) = family(rng, 0, 2, words=200, most=0.1)
        s = near_dup.Shingles(pa.array([a, b + f" {n}"]))
        marks = near_dup.signatures(s.doc, s.hash, s.weight, 2, 160)
        shares.append((marks[0] == marks[1]).mean())
        truth.append(near_dup.similarity(*((s.hash[s.doc == d], s.weight[s.doc == d]) for d in (0, 1))))
    assert abs(np.mean(np.array(shares) - np.array(truth))) < 0.015


def test_weights_follow_counts():
    elements, weights = np.arange(1, 400, dtype=np.uint64), np.arange(399) % 9 + 1
    more = weights + (np.arange(399) % 3 == 0) * 2
    marks = near_dup.signatures(np.repeat([0, 1], 399), np.tile(elements, 2), np.r_[weights, more], 2, 2000)
    assert abs((marks[0] == marks[1]).mean() - np.minimum(weights, more).sum() / np.maximum(weights, more).sum()) < 0.03


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100), (7, 60), (200, 201), (None, 3)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 60: 0, 100: 100, 200: 200, 201: 200}
