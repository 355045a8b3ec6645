import hashlib
from collections import Counter

from pyspark.sql import functions as F

from revdiff.llm import chat

MARKED = "</s>[INST] ok \\ \\\\ <|end|>\n<|user|>\n <\\|end|> [/INST] <<SYS>> |>"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def conversations():
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello"), (2, 0, "system", "be kind"), (2, 1, "user", "hi"), (2, 2, "assistant", "no"),
            (3, 0, "system", "be kind"), (3, 1, "user", "hi"), (4, 0, "user", MARKED), (4, 1, "assistant", MARKED), (5, 0, MARKED, None), (5, None, None, "x"),
            (5, 0, "user", "tie"), (5, 0, "user", "tie"), (None, 1, "assistant", "é😀"), (6, 0, "user", "é" * 5000)]
    rows += [(100 + i, t, r, x) for i in range(90) for t, r, x in ((0, "user", "same first turn"), (1, "assistant", f"reply {i % 70}"), (2, "user", f"more {i % 7}"))]
    rows += [(300, t, "user", f"turn {t}") for t in range(200)]
    return rows


def test_read_back(spark):
    rows = conversations()
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, pos int, start int")
    nodes, ends = chat.format_conversations(df, leaves=8)
    got = {r.conv_id: r for r in ends.join(chat.read_back(nodes), ["sequence_id", "start"]).collect()}
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append(((t is not None, t or 0), role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns = [(r, x) for _, r, x in sorted(turns)]
        loss = "".join(x for r, x in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), sha(loss))
    assert chat.format_conversations(df.limit(0))[1].count() == 0


def test_shared_turns_are_laid_out_once_with_positions_and_ancestors(spark):
    df = spark.createDataFrame(conversations(), "conv_id long, turn long, role string, text string")
    nodes, ends = chat.format_conversations(df, leaves=1000)
    first = nodes.filter(F.col("segment").contains("be kind")).collect()
    assert len(first) == 1
    tree = sorted(nodes.filter(F.col("sequence_id") == first[0].sequence_id).collect(), key=lambda r: r.start)
    assert len(tree) == 4 and [r.start for r in tree] == [sum(x.length for x in tree[:n]) for n in range(4)]
    shared = tree[0].length + tree[1].length
    assert [r.position for r in tree] == [0, tree[0].length, shared, shared]
    assert [[(a.start, a.end) for a in r.ancestors] for r in tree] == [[], [(0, tree[0].length)], [(0, shared)], [(0, shared)]]
    whole = "".join(r.segment for r in tree)
    assert sorted(whole[r.loss_start : r.loss_end] for r in tree) == ["", "", "hello", "no"]
    assert {r.conv_id: r.start for r in ends.collect() if r.conv_id in (1, 2, 3)}[3] == tree[1].start


def test_a_large_tree_is_cut_along_its_prefixes(spark):
    talks = [["sys", f"q{i % 30}", *(f"t{k}" for k in range(8)), f"end {i}"] for i in range(600)]  # 20 conversations share ten turns
    talks += [["sys", "hot", f"only {i}"] for i in range(100)] + [["sys"], ["sys", "hot"], ["sys", "hot"]]
    talks += [["sys", "long", *(f"x{k}" for k in range(n))] for n in range(150)]  # an end at every turn
    talks += [["other", f"end {i}"] for i in range(32)]
    rows = [(i, k, "user", "/".join(talk[: k + 1])) for i, talk in enumerate(talks) for k in range(len(talk))]  # a text tells its path
    nodes, ends = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    passing = Counter("/".join(p[: k + 1]) for p in set(map(tuple, talks)) for k in range(len(p)))
    found = nodes.select("sequence_id", "start", "segment", "is_end").collect()
    times = Counter(r.segment.removeprefix("<|user|>\n").removesuffix(chat.END) for r in found)
    assert set(times) == set(passing)
    for path, n in passing.items():
        assert times[path] == 1 if n <= chat.LEAVES else times[path] <= n / chat.LEAVES + 1, path
    assert max(Counter(r.sequence_id for r in found if r.is_end).values()) < 2 * chat.LEAVES
    text = {(r.sequence_id, r.start): r.segment for r in found}
    got = {r.conv_id: text[r.sequence_id, r.start] for r in ends.collect()}
    assert got == {i: f"<|user|>\n{'/'.join(talk)}{chat.END}" for i, talk in enumerate(talks)}
