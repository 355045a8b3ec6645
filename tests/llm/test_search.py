import numpy as np

from revdiff.llm import search


def brute(rows, every=50, k=5):
    sound = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        ints = [int(np.floor(256.0 * np.float32(x))) for x in v]
        sound[i] = min(sound.get(i, ints), ints)
    out = []
    for q, v in sound.items():
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in sound.items() if i != q)
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def test_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in rng.normal(size=12) * rng.choice([0.02, 0.3])]) for i in range(400)]
    rows += [(400 + i, rows[50][1]) for i in range(120)]  # many equal vectors
    rows += [(600, None), (650, [1.0, None] * 6), (700, [float("nan")] * 12), (750, [float("inf")] * 12), (None, rows[0][1]), (50, rows[50][1]), (800, [0.0] * 12), (850, [0.5, -0.5]), (900, [])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, score int, shard int")
    for shard in (64, 10_000):
        got = search.top_k(df, shard=shard, block=3)
        assert got.columns == ["query_id", "rank", "vec_id", "score"]
        assert sorted(map(tuple, got.collect())) == brute(rows)
    assert search.top_k(df.limit(0)).count() == 0
    few = df.filter("vec_id in (0, 1, 2)")
    assert sorted(map(tuple, search.top_k(few).collect())) == brute(rows[:3])
