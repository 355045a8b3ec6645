import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import best_total, levenshtein, question, similarity

from revdiff.functions import edits
from revdiff.functions.edits import edit_distances, similarity_matrices, similarity_matrix
from revdiff.operators import align as align_module
from revdiff.operators import align_large
from revdiff.operators.align import UNIT, align, best_assignment, tie_cost
from revdiff.operators.align_large import best_flow
from revdiff.operators.diff import CONTROL_FLAGS, added_rows, diff_records, removed_rows


def test_edit_distances_against_table():
    r = random.Random(1)
    for _ in range(200):
        packed = ["".join(r.choice("abcé") for _ in range(r.randint(0, 9))) for _ in range(r.randint(1, 6))]
        probes = ["".join(r.choice("abcé😀") for _ in range(r.randint(0, 9))) for _ in range(r.randint(1, 6))]
        got = edit_distances(packed, probes)
        assert [[levenshtein(p, t) for t in packed] for p in probes] == got.tolist()


def _blocks(rng, count):
    def text():
        letters = rng.choice(["ab", "abcdefgh", "aé漢😀x"])
        return "".join(rng.choices(letters, k=rng.choice([0, 1, 5, 63, 64, 65, 128, 129, 200, 400, 1300])))

    blocks = [([text() for _ in range(rng.choice([0, 1, 4]))], [text() for _ in range(rng.choice([0, 2, 5]))]) for _ in range(count)]
    return [(new + old[:1], old) for new, old in blocks]


def test_blocks_side_by_side_score_as_alone():
    blocks = _blocks(random.Random(5), 120)
    for got, (new, old) in zip(similarity_matrices(blocks), blocks, strict=True):
        assert got.shape == (len(new), len(old))
        dist = edit_distances(old, new) if new and old else np.zeros(got.shape)
        longer = np.array([[max(len(a), len(b), 1) for b in old] for a in new]).reshape(got.shape)
        assert np.array_equal(got, 1.0 - dist / longer)


def test_pairs_of_all_blocks_are_scored_once_and_together(monkeypatch):
    blocks, calls = _blocks(random.Random(6), 60), []
    advance = edits._advance
    monkeypatch.setattr(edits, "_advance", lambda packed, probes, w: calls.append(len(packed)) or advance(packed, probes, w))
    similarity_matrices(blocks + [(old, new) for new, old in blocks])
    unlike = {frozenset((a, b)) for new, old in blocks for a in new for b in old if a and b and a != b}
    assert sum(calls) == len(unlike) and len(calls) <= 3


def test_groups_are_bounded_and_lose_no_block(monkeypatch):
    monkeypatch.setattr(align_module, "_GROUP_CHARS", 40)
    record = lambda o, txt: {"ord": o, "txt": txt, "section": None, "number": None}
    blocks = [{"pair_id": str(k), "new": [record(2, "b" * k), record(1, "a" * k)], "old": [record(1, "a" * k)]} for k in (1, 4, 9, 30, 2)]
    groups = list(align_module._groups(iter(pa.RecordBatch.from_pylist([b]) for b in blocks)))
    assert [[b["pair_id"] for b in g] for g in groups] == [["1", "4"], ["9"], ["30"], ["2"]]
    assert [r["ord"] for r in groups[0][0]["new"]] == [1, 2]


def test_similarity_matrix_empty_texts():
    assert similarity_matrix(["", "ab"], ["", "ab"]).tolist() == [[1.0, 0.0], [0.0, 1.0]]


def units(weights):
    return np.rint(np.array(weights) * UNIT).astype(np.int64)


@pytest.mark.parametrize("weights,want", [
    ([[0.9, 0.8], [0.7, 0.1]], [1, 0]),
    ([[0.1, 0.9, 0.5], [0.8, 0.2, 0.4]], [1, 0]),
    ([[0.1, 0.2, 0.9], [0.9, 0.1, 0.2], [0.2, 0.9, 0.1]], [2, 0, 1]),
    ([[0.90, 0.60], [0.75, 0.49]], [0, 1]),
])
def test_best_assignment_known(weights, want):
    assert best_assignment(units(weights)).tolist() == want


def test_best_assignment_leaves_one_row_over():
    got = best_assignment(units([[0.9, 0.1], [0.2, 0.8], [0.3, 0.3]]))
    assert got.tolist() == [0, 1, -1]


def _optima(w):
    """All assignments of largest total, with their tie costs; w in whole units."""
    m, n = len(w), len(w[0])
    found = []
    for cols in itertools.permutations([*range(n), *[-1] * m], m):
        if len({c for c in cols if c >= 0}) == sum(c >= 0 for c in cols):
            total = sum(w[i][c] for i, c in enumerate(cols) if c >= 0)
            tie = sum(int(tie_cost(np.array([i]), np.array([c]), max(m, n))[0]) for i, c in enumerate(cols) if c >= 0 and w[i][c])
            found.append((-total, tie, [c if c >= 0 and w[i][c] else -1 for i, c in enumerate(cols)]))
    return min(found)


def test_best_assignment_brute_force():
    r = random.Random(2)
    for _ in range(150):
        m, n = r.randint(1, 4), r.randint(1, 4)
        w = [[r.choice([0.25, 0.5, 0.75, r.random()]) for _ in range(n)] for _ in range(m)]
        whole = units(w).tolist()
        got = best_assignment(np.array(whole)).tolist()
        assert got == _optima(whole)[2]


def test_flow_brute_force():
    """The sparse solver gives the assignment of the dense one, and proves it by prices."""
    r = random.Random(4)
    for _ in range(400):
        m, n = r.randint(1, 7), r.randint(1, 7)
        w = units([[r.choice([0.0, 0.25, 0.5, 0.75, r.random()]) for _ in range(n)] for _ in range(m)])
        supply, room = (np.array([r.choice([1, 1, 1, 2, 5]) for _ in range(k)]) for k in (m, n))
        size = int(max(supply.sum(), room.sum()))
        tie = tie_cost(np.arange(m)[:, None], np.arange(n)[None, :], size)
        edges = {i: [(j, (int(w[i, j]) << 61) - int(tie[i, j])) for j in range(n) if r.random() < 0.95 or w[i, j] > 0.6 * UNIT] for i in range(m)}
        flow, row_price, col_price = best_flow(supply, room, edges)
        worth = {(i, j): x for i, own in edges.items() for j, x in own}
        assert all(row_price[i] + col_price[j] >= x for (i, j), x in worth.items()) and min(row_price + col_price) >= 0
        assert sum(worth[e] * x for e, x in flow.items()) == sum(p * int(k) for p, k in zip(row_price + col_price, [*supply, *room], strict=True))
        a, b = np.repeat(np.arange(m), supply), np.repeat(np.arange(n), room)
        if all(len(edges[i]) == n for i in range(m)):
            got = {}
            for i, c in enumerate(best_assignment(w[a][:, b], a, b)):
                if c >= 0 and w[a[i], b[c]] > 0:
                    got[a[i], b[c]] = got.get((a[i], b[c]), 0) + 1
            assert got == {e: x for e, x in flow.items()}


def _statuses(spark, old, new):
    prev, curr = question(spark, old), question(spark, new)
    rows = diff_records(prev, curr, align(prev, curr), CONTROL_FLAGS).collect()
    return sorted(((r["status"], r["prev"] and r["prev"]["text"], r["curr"] and r["curr"]["text"]) for r in rows), key=str), rows


def test_optimum_beats_greedy(spark):
    got, _ = _statuses(
        spark,
        [("p", 1, "abcde fghij"), ("p", 2, "zyxwv utsrq")],
        [("p", 1, "abcde fghij klmno"), ("p", 2, "abcde fghij p")],
    )
    assert got == [
        ("added", None, "abcde fghij klmno"), ("changed", "abcde fghij", "abcde fghij p"), ("removed", "zyxwv utsrq", None),
    ]


def test_bonus_matches_but_is_not_reported(spark):
    got, rows = _statuses(spark, [("p", 1, "abcdefghij", "S", "1.1")], [("p", 1, "123456ghij", "S", "1.1")])
    assert got == [("changed", "abcdefghij", "123456ghij")]
    assert rows[0]["similarity"] == pytest.approx(0.4) and rows[0]["second_best"] is None
    got, _ = _statuses(spark, [("p", 1, "abcdefghij", "S")], [("p", 1, "123456ghij", "T")])
    assert [g[0] for g in got] == ["added", "removed"]


def test_second_best_can_be_any_other_row(spark):
    _, rows = _statuses(spark, [("p", 1, "abcde"), ("p", 2, "fghij", "S", "1")], [("p", 1, "abcde", "S", "1")])
    matched = [r for r in rows if r["status"] == "changed"]
    assert len(matched) == 1 and matched[0]["second_best"] == 0.0 and matched[0]["number_changed"]


def test_flags(spark):
    listed = lambda items: {"type": "List", "op": None, "f1": items, "f2": None}
    fmt = lambda v: {"type": "CellIs", "op": "Equal", "v1": v, "v2": None}
    got, rows = _statuses(
        spark,
        [("a", 1, "Same text", "", "1.1"), ("b", 1, "x y", "", None, listed('"Y,N"')), ("c", 1, "x y", "", None, listed('"Y,N"'), fmt("1")),
         ("d", 1, "Case ONLY"), ("e", 1, "moved", "S1"), ("f", 1, "gone")],
        [("a", 1, "Same text", "", "1.2"), ("b", 1, "x y", "", None, listed('"N, Y"')), ("c", 1, "x y", "", None, listed('"Y,N"'), fmt("2")),
         ("d", 1, "case  only"), ("e", 9, "moved", "S2"), ("g", 1, "come")],
    )
    status = {r["pair_id"]: r for r in rows}
    assert status["a"]["status"] == "changed" and status["a"]["number_changed"] and not status["a"]["text_changed"]
    assert status["b"]["status"] == "unchanged"
    assert status["c"]["status"] == "changed" and status["c"]["cf_changed"]
    assert status["d"]["status"] == "unchanged" and status["e"]["status"] == "unchanged"
    assert status["f"]["status"] == "removed" and status["g"]["status"] == "added"


def test_identical_text_is_not_always_matched(spark):
    """The whole-matrix optimum may pair an identical text with another record."""
    prev = question(spark, [("p", 1, "abcdefghij", "S2", "2"), ("p", 2, "Zbcdefghij", "S1", "1")])
    curr = question(spark, [("p", 1, "abcdefghij", "S1", "1"), ("p", 2, "abcdefghiQ", "S2", "2")])
    got = {(r["n_ord"], r["o_ord"]) for r in align(prev, curr).collect()}
    assert got == {(1, 2), (2, 1)}


def _corpus(seed, blocks, size, vocabulary, shuffle=True):
    r = random.Random(seed)
    old, new = [], []
    for b in range(blocks):
        texts = [" ".join(r.choice(vocabulary) for _ in range(r.randint(4, 9))) for _ in range(r.randint(1, size))]
        texts += [texts[0]] * r.randint(0, 2)
        for i, t in enumerate(texts):
            old.append((str(b), i, t, r.choice(["", "S1", "S2"]), r.choice([None, f"1.{i}"])))
        kept = [t if r.random() < 0.6 else t.replace("a", "o", 1) for t in texts if r.random() < 0.9]
        kept += [" ".join(r.choice(vocabulary) for _ in range(5))]
        for i, t in enumerate(kept):
            new.append((str(b), i, t, r.choice(["", "S1", "S2"]), r.choice([None, f"1.{i}"])))
    return old, new


WORDS = ["alpha", "brook", "candle", "drift", "ember", "fjord", "glacier", "harbor", "island", "juniper", "kestrel", "lagoon"]


def test_blocks_against_brute_force(spark):
    old, new = _corpus(5, 12, 4, WORDS)
    prev, curr = question(spark, old), question(spark, new)
    rows = align(prev, curr).collect()
    for b in {o[0] for o in old}:
        o, n = [x for x in old if x[0] == b], [x for x in new if x[0] == b]
        base = [[similarity(x[2], y[2]) for y in o] for x in n]
        adj = [[min(1.0, base[i][j] + 0.1 * (bool(x[3]) and x[3] == y[3]) + 0.1 * (bool(x[4]) and x[4] == y[4])) for j, y in enumerate(o)] for i, x in enumerate(n)]
        mine = [r for r in rows if r["pair_id"] == b]
        pairs = [r for r in mine if r["n_ord"] is not None and r["o_ord"] is not None]
        assert len(mine) - len(pairs) == len(o) + len(n) - 2 * len(pairs)
        assert len({r["o_ord"] for r in pairs}) == len(pairs) == len({r["n_ord"] for r in pairs})
        strong = sum(r["adj"] for r in pairs)
        assert strong <= best_total(adj) + 1e-9
        for r in pairs:
            i, j = [x[1] for x in n].index(r["n_ord"]), [y[1] for y in o].index(r["o_ord"])
            assert r["similarity"] == pytest.approx(base[i][j]) and r["adj"] == pytest.approx(adj[i][j]) and r["adj"] >= 0.5
            others = [v for k, v in enumerate(base[i]) if k != j]
            assert r["second_best"] == (pytest.approx(max(others)) if others else None)


def _rows(alignment):
    return sorted(((r.pair_id, str(r.n_ord), str(r.o_ord), *(x if x is None else round(x, 9) for x in (r.similarity, r.adj, r.second_best))) for r in alignment.collect()), key=str)


def test_large_path_gives_the_pairs_of_the_small_path(spark):
    old, new = _corpus(6, 5, 30, WORDS)
    prev, curr = question(spark, old).cache(), question(spark, new).cache()
    assert _rows(align(prev, curr, max_rows=8, tile=3)) == _rows(align(prev, curr))


def test_blocks_proved_by_their_candidates_are_not_scored_again(spark, monkeypatch):
    """All pairs of a block with a side of up to NEAR classes are candidates; only block ``b`` has others."""
    old = [("a", i, f"{w} old") for i, w in enumerate(WORDS[:align_large.NEAR])] + [("b", i, f"{w} old") for i, w in enumerate(WORDS)]
    new = [(b, i, f"{w} new") for b in "ab" for i, w in enumerate(WORDS)]
    seen, found = [], align_large._violations

    def noted(live, *rest):
        seen.append({r.pair_id for r in live.select("pair_id").distinct().collect()})
        return found(live, *rest)

    monkeypatch.setattr(align_large, "_violations", noted)
    prev, curr = question(spark, old), question(spark, new)
    assert _rows(align(prev, curr, max_rows=1, tile=3)) == _rows(align(prev, curr))
    assert seen[0] == {"b"}


def test_hot_copies(spark):
    """One text holds a third of all records on both sides; every copy is paired once, in order."""
    r = random.Random(8)
    other = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(40)) for _ in range(80)]
    old = [("p", i, "the same boilerplate line on every page") for i in range(40)] + [("p", 100 + i, t) for i, t in enumerate(other)]
    new = [("p", i, "the same boilerplate line on every page") for i in range(37)] + [("p", 100 + i, t) for i, t in enumerate(other)]
    rows = align(question(spark, old), question(spark, new), max_rows=20, tile=4).toPandas()
    matched = rows.dropna(subset=["adj"])
    assert len(matched) == 117 and matched["adj"].eq(1.0).all() and rows["n_ord"].isna().sum() == 3
    assert (matched["n_ord"] == matched["o_ord"]).all()
    assert matched[matched["n_ord"] < 100]["second_best"].eq(1.0).all()


CROSSED = (
    [("p", 1, "abcdefghij"), ("p", 2, "YYcdefghiX")], [("p", 1, "abcdefghiX"), ("p", 2, "abcdefZZij")],
)


@pytest.mark.parametrize("bounds", [{}, {"max_chars": 5}, {"max_rows": 1}, {"max_rows": 1, "tile": 1}])
def test_one_optimum_at_every_bound(spark, bounds):
    """Scores 0.9 and 0.8 over 0.8 and 0.5: the optimum is crossed."""
    rows = align(question(spark, CROSSED[0]), question(spark, CROSSED[1]), **bounds).collect()
    assert {(r.n_ord, r.o_ord, round(r.adj, 6)) for r in rows} == {(1, 2, 0.8), (2, 1, 0.8)}


def test_contested_blocks(spark):
    """Records that all resemble each other: ties everywhere, and more candidates than a task returns at first."""
    old = [("p", i, f"item number {i:03d}") for i in range(40)] + [("q", i, "same text") for i in range(9)]
    new = [("p", i, f"item numbers {i + 3:03d}") for i in range(39)] + [("q", i, "same text") for i in range(9)]
    new += [("r", i, f"{'ab' * i}") for i in range(5)]
    prev, curr = question(spark, old), question(spark, new)
    small = _rows(align(prev, curr))
    assert _rows(align(prev, curr, max_rows=4, tile=2)) == small
    assert {(r[1], r[2]) for r in small if r[0] == "q"} == {(str(i), str(i)) for i in range(9)}


def test_empty_sides_and_anti_joins(spark):
    old, new = question(spark, [("only-old", 1, "a")]), question(spark, [("only-new", 1, "b")])
    alignment = align(old, new)
    assert [r["pair_id"] for r in added_rows(new, alignment).collect()] == ["only-new"]
    assert [r["pair_id"] for r in removed_rows(old, alignment).collect()] == ["only-old"]
    assert align(question(spark, []), question(spark, [])).count() == 0


@pytest.mark.parametrize("alone", [40, 10_000_000])
def test_bounded_scores_find_the_same_assignment(monkeypatch, alone):
    monkeypatch.setattr(align_module, "_ALONE_CHARS", alone)
    rng = random.Random(11)

    def side(texts):
        return [{"ord": k, "txt": t, "section": rng.choice([None, "", "s", "t"]), "number": rng.choice([None, "1", "2"])} for k, t in enumerate(texts)]

    blocks = [{"pair_id": "none", "new": [], "old": side(["a"])}]
    for k in range(150):
        letters = rng.choice(["ab", "abcdefgh tuvw", "aé漢😀x"])
        old = ["".join(rng.choices(letters, k=rng.choice([0, 1, 2, 5, 30, 90]))) for _ in range(rng.randint(0, 9))]
        new = [t[::-1] if rng.random() < 0.2 else t[: rng.randint(0, 90)] for t in old if rng.random() < 0.9] + old[:1] * rng.randint(0, 2) + [""]
        rng.shuffle(new)
        blocks.append({"pair_id": str(k), "new": side(new), "old": side(old)})
    bases = align_module._bounded_scores(blocks)
    for block, base in zip(blocks, bases, strict=True):
        new, old = block["new"], block["old"]
        whole = similarity_matrix([r["txt"] for r in new], [r["txt"] for r in old])
        assert base.shape == whole.shape and (base >= whole).all()
        want = [r[:4] for r in align_module._solve_block(new, old, whole)]
        assert [r[:4] for r in align_module._solve_block(new, old, base, seconds=False)] == want


def test_without_second_best_few_pairs_are_scored(spark, monkeypatch):
    rng, scored = random.Random(12), []
    words = [f"w{k:x}" for k in range(400)]
    old = [" ".join(rng.choices(words, k=30)) for _ in range(40)]
    block = {side: [{"ord": k, "txt": t + more, "section": None, "number": None} for k, t in enumerate(old)] for side, more in (("new", " end"), ("old", ""))}
    distances, alone = align_module.some_distances, align_module.edit_distances
    monkeypatch.setattr(align_module, "some_distances", lambda t, a, b: scored.append(len(a)) or distances(t, a, b))
    monkeypatch.setattr(align_module, "edit_distances", lambda a, b: scored.append(len(a)) or alone(a, b))
    base = align_module._bounded_scores([block])[0]
    assert [r[:2] for r in align_module._solve_block(block["new"], block["old"], base, False)] == [(k, k) for k in range(40)]
    assert 0 < sum(scored) < 40 * 40 / 4
    from revdiff.plans import catalog

    asked = []
    monkeypatch.setattr(catalog, "align", lambda prev, curr, seconds=True: asked.append(seconds) or align(prev, curr, seconds=seconds))
    for name in ("match_one_to_one", "removed_rows", "diff_summary", "similarity_band", "sheet_order_breaks"):
        catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert asked == [False] * 5
