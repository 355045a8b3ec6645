from itertools import product

import pytest

from revdiff.llm import mixing

from . import cases


def test_targets_stop_at_three_times_and_share_again():
    sizes = {"a": 100, "b": 10, None: 390, "c": 0}
    got = mixing.source_targets(sizes)
    # weights a 1, b 2, c 3, null 1: b stops at 30, c at 0; 470 are left for a and null, evenly
    assert got == {"b": 30.0, "c": 0.0, "a": 235.0, None: 235.0}
    assert mixing.source_targets({"a": 0}) == {"a": 0.0}


def cheapest(patterns, quotas, costs):
    """Least cost of the largest flow, by trying everything."""
    arcs = [(p, s) for p in patterns for s in p]
    best = (0, 0)
    for amounts in product(*(range(min(quotas[s], patterns[p] * len(costs)) + 1) for p, s in arcs)):
        given = {p: sum(x for (q, _), x in zip(arcs, amounts, strict=True) if q == p) for p in patterns}
        got = {s: sum(x for (_, t), x in zip(arcs, amounts, strict=True) if t == s) for s in quotas}
        if any(given[p] > patterns[p] * len(costs) for p in patterns) or any(got[s] > quotas[s] for s in quotas):
            continue
        cost = sum(costs[u // patterns[p]] for p in patterns for u in range(given[p]))
        best = max(best, (sum(amounts), -cost))
    return best


@pytest.mark.parametrize(
    "patterns, quotas",
    [
        ({("a",): 2, ("a", "b"): 3}, {"a": 4, "b": 4}),
        ({("a", "b"): 2, ("b",): 1, ("a",): 1}, {"a": 5, "b": 3}),
        ({("a",): 1, ("b",): 3}, {"a": 4, "b": 2}),
        ({("a", "b"): 0, ("b",): 2}, {"a": 3, "b": 6}),
    ],
)
def test_route_is_cheapest(patterns, quotas):
    flows = mixing.route(patterns, quotas)
    total = sum(x for f in flows.values() for x in f.values())
    cost = sum(mixing.REPEAT_COSTS[u // patterns[p]] for p, f in flows.items() for u in range(sum(f.values())))
    assert (total, -cost) == cheapest(patterns, quotas, mixing.REPEAT_COSTS)


def test_mix_of_odd_rows(spark):
    docs = cases.documents(spark, cases.ODD)
    got = mixing.mix(docs).collect()
    assert len(got) == len(cases.ODD)
    by = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        by.setdefault(r.sources[0], [0, r.target, r.source_size])[0] += r.taken
    for taken, target, _ in by.values():
        assert abs(taken - target) <= 0.5
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(3)).collect()))
    assert mixing.mix(docs.limit(0)).count() == 0
    again = mixing.mixed_documents(docs)
    assert again.columns == docs.columns
    texts = {r[1] for r in cases.ODD}
    rows = again.collect()
    assert {r.text for r in rows} <= texts  # whole documents only
    for source, (taken, _, _) in by.items():
        own = [len((r.text or "").encode().split()) for r in rows if r.source == source]
        largest = max(len((t or "").encode().split()) for _, t, _, s in cases.ODD if s == source)
        assert abs(sum(own) - taken) <= largest / 2 + 3  # repeated rows count once there
