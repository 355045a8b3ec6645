"""Connected components of an edge table, as joins in a number of rounds that grows with the
logarithm of the longest chain."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revdiff.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """``node, comp`` of every node in ``edges(a, b)``, a stored table; ``comp`` is the smallest
    node of its component.

    Each round passes the smallest label to neighbours, then (from the third on) lets each node
    take its label's label. Labels live in the shared folder; only the number of changes comes to the driver.
    Edges with nulls are left out; repeated edges and loops don't matter.
    """
    pairs = edges.select("a", "b").dropna()
    both = pairs.union(pairs.select("b", "a"))
    label = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")))
    for turn in itertools.count():
        low = both.join(label, both.b == label.node).groupBy(both.a.alias("node")).agg(F.min("comp").alias("m"))
        label = stored(label.join(low, "node").select("node", F.col("comp").alias("old"), F.least("comp", "m").alias("comp")))
        if turn > 1:  # only chains need more than two rounds; there labels jump
            next_ = label.select(F.col("node").alias("comp"), F.col("comp").alias("jump"))
            label = stored(label.join(next_, "comp").select("node", "old", F.least("comp", "jump").alias("comp")))
        changed = label.filter("comp <> old").limit(1).count()
        label = label.drop("old")
        if not changed:
            return label
