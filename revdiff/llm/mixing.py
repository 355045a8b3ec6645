"""Mixing sources to target weights: min-cost flow from documents, grouped by the set of sources
they belong to, to the sources' quotas, with convex costs for repetition."""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revdiff.llm.common import cut_lineage, unused

WORD = r"[^\x20\x09-\x0D]+"
MAX_REPEATS = 3
#: Cost of a word's first, second, third ... use: each costs more than the one before.
REPEAT_COSTS = (0, 1, 3)
#: About so many documents are put in order by one task.
BIN_ROWS = 4096


def source_targets(sizes: dict[str | None, int], total: int | None = None, weights: dict | None = None, repeats: int = MAX_REPEATS) -> dict:
    """What each source should give of ``total`` words (default: all sizes).

    Shares go by weight: by default 1, 2, 3, repeating, over the sources by code point, null
    last. A target stops at ``repeats`` times its source's size; the excess is shared again by
    weight until none is above. That is a common level: ``min(cap, level * weight)``.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = weights or {s: 1 + n % 3 for n, s in enumerate(order)}
    left = sum(sizes.values()) if total is None else total
    heavy, targets = sum(weights[s] for s in order), {}
    for s in sorted(order, key=lambda s: (repeats * sizes[s] / weights[s])):  # those that stop come first
        if repeats * sizes[s] * heavy <= left * weights[s]:
            targets[s] = float(repeats * sizes[s])
            left, heavy = left - repeats * sizes[s], heavy - weights[s]
        else:
            targets[s] = left * weights[s] / heavy
    return targets


def route(patterns: dict[tuple, int], quotas: dict, costs: tuple[int, ...] = REPEAT_COSTS) -> dict[tuple, dict]:
    """Min-cost flow: how many words each pattern (set of sources) gives to each of its sources.

    A pattern has its words once for each cost in ``costs``. Successive shortest paths with
    potentials, on a network of one node per pattern and source; parts of it without a common
    source are solved apart. As many words flow as quotas and capacities allow.
    """
    group = {s: s for s in quotas}

    def root(s):
        while group[s] != s:
            s = group[s]
        return s

    for pattern in patterns:
        for s in pattern[1:]:
            group[root(s)] = root(pattern[0])
    parts = defaultdict(list)
    for pattern in patterns:
        if pattern:
            parts[root(pattern[0])].append(pattern)
    out = {}
    for own in parts.values():
        out |= _route_part({p: patterns[p] for p in own}, quotas, costs)
    return out


def _route_part(patterns, quotas, costs):
    sources = list(dict.fromkeys(s for p in patterns for s in p))
    node = {("p", p): n + 2 for n, p in enumerate(patterns)} | {("s", s): n + 2 + len(patterns) for n, s in enumerate(sources)}
    to, cap, cost, out = [], [], [], defaultdict(list)

    def arc(a, b, room, price):
        for x, y, r, c in ((a, b, room, price), (b, a, 0, -price)):
            out[x].append(len(to))
            to.append(y)
            cap.append(r)
            cost.append(c)

    given = {}
    for p, n in patterns.items():
        for price in costs:
            arc(0, node["p", p], n, price)
        for s in p:
            given[p, s] = len(to) + 1  # the arc back holds what flows
            arc(node["p", p], node["s", s], n * len(costs), 0)
    for s in sources:
        arc(node["s", s], 1, quotas[s], 0)
    height = defaultdict(int)
    while True:
        far, by, heap = {0: 0}, {}, [(0, 0)]
        while heap:
            d, x = heapq.heappop(heap)
            if d > far[x]:
                continue
            for e in out[x]:
                if cap[e] and (new := d + cost[e] + height[x] - height[to[e]]) < far.get(to[e], 1 << 62):
                    far[to[e]], by[to[e]] = new, e
                    heapq.heappush(heap, (new, to[e]))
        if 1 not in far:
            break
        for x in range(len(node) + 2):
            height[x] += min(far.get(x, far[1]), far[1])
        path, x = [], 1
        while x:
            path.append(by[x])
            x = to[by[x] ^ 1]
        amount = min(cap[e] for e in path)
        for e in path:
            cap[e] -= amount
            cap[e ^ 1] += amount
    return {p: {s: cap[given[p, s]] for s in p} for p in patterns}


def mix(
    docs: DataFrame, total: int | None = None, weights: dict | None = None, seed: int = 0, id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """What the mix takes of every document: ``id_col, size, sources, source_size, target, taken``.

    ``source_col`` is a string, or an array of strings for documents of several sources
    (``sources`` then has them in order; ``source_size`` and ``target`` are of the first).
    ``size`` counts runs of ``[^\\x20\\x09-\\x0D]``. ``taken`` is in words and counts repeats: a
    document is used whole one or more times, but for the one at which a quota ends, which gives
    the rest. None gives more than three times its size. Documents are chosen by a hash of
    ``seed`` and id, so reruns agree.

    Only the number of words per pattern comes to the driver: its size is that of the mix, not
    of the corpus. A source may hold most documents: its order is made in bins of the hash.

    A null text has size 0 and gives nothing. A null source is a source, the last; a null or empty
    array is of the null source. Ties of the hash go by id and size; repeated rows count each.
    An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    many = dict(docs.dtypes)[source_col].startswith("array")
    member = F.array_sort(F.array_distinct(docs[source_col])) if many else F.array(docs[source_col])
    member = F.when(F.size(F.coalesce(member, F.array())) > 0, member).otherwise(F.array(F.lit(None).cast("string")))
    ticket = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(docs[id_col].cast("string"), F.lit("null")))), 1, 15), 16, 10)
    light = cut_lineage(docs.select(
        docs[id_col].alias("id"), F.coalesce(F.regexp_count(docs[text_col], F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        member.alias("sources"), ticket.cast("long").alias("ticket"),
    ))
    patterns, rows = {}, {}
    for r in light.groupBy("sources").agg(F.sum("size").alias("words"), F.count("*").alias("n")).collect():
        patterns[tuple(r.sources)], rows[tuple(r.sources)] = r.words, r.n
    sizes = defaultdict(int)
    for pattern, n in patterns.items():
        for s in pattern:
            sizes[s] += n
    targets = source_targets(dict(sizes), sum(patterns.values()) if total is None else total, weights) if sizes else {}
    flows = route(patterns, {s: int(t + 0.5) for s, t in targets.items()})
    plan = [
        (list(p), patterns[p], sum(flows[p].values()), max(1, -(-rows[p] // BIN_ROWS)), sizes[p[0]], targets[p[0]], n) for n, p in enumerate(patterns)
    ]
    table = spark.createDataFrame(plan, "sources array<string>, words long, flow long, bins long, source_size long, target double, pattern long")
    a, b = light.alias("a"), F.broadcast(table).alias("b")
    dealt = a.join(b, F.col("a.sources").eqNullSafe(F.col("b.sources"))).select("a.*", "b.words", "b.flow", "b.bins", "b.source_size", "b.target", "b.pattern")
    dealt = dealt.withColumn("bin", F.expr("shiftright(shiftright(ticket, 28) * bins, 32)"))
    before = (
        dealt.groupBy("pattern", "bin").agg(F.sum("size").alias("own"))
        .withColumn("before", F.sum("own").over(Window.partitionBy("pattern").orderBy("bin")) - F.col("own")).drop("own")
    )
    within = Window.partitionBy("pattern", "bin").orderBy("ticket", "id", "size")
    placed = dealt.withColumn("upto", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0))).join(before, ["pattern", "bin"])
    start = F.col("before") + F.col("upto") - F.col("size")
    rest = F.greatest(F.lit(0), F.least(F.expr("flow % nullif(words, 0)") - start, F.col("size")))
    taken = F.coalesce(F.expr("flow div nullif(words, 0)") * F.col("size") + rest, F.lit(0)).cast("long")
    return placed.select(F.col("id").alias(id_col), "size", "sources", "source_size", "target", taken.alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: each document as often as the mix uses it.

    Documents stay whole. The one at which a quota ends is taken or left, whichever is nearer, so
    each set of sources gives its quota to within half a document. A document without words is
    in no mix. Rows of equal id and text are one document here."""
    key, of, times = unused(docs, "_key", "_of", "_times")
    same = F.struct(docs[id_col].alias("id"), F.xxhash64(docs[text_col], docs[text_col].isNull()).alias("hash"))
    unique = docs.withColumn(key, same).dropDuplicates([key])
    amounts = mix(unique, id_col=key, text_col=text_col, **options).withColumn(times, F.expr("(2 * taken + size) div nullif(2 * size, 0)"))
    amounts = amounts.filter(F.col(times) > 0).select(F.col(key).alias(of), times)
    rows = unique.join(amounts, F.col(key).eqNullSafe(F.col(of)))
    return rows.withColumn(times, F.explode(F.array_repeat(F.lit(0), F.col(times).cast("int")))).select(*docs.columns)
