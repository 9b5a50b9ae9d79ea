"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import cut


def large_star(edges: DataFrame) -> DataFrame:
    """Link each node's greater neighbours to the least node around it."""
    both = edges.union(edges.select("low", "high")).toDF("node", "other")
    least = both.groupBy(F.col("node").alias("center")).agg(F.min("other").alias("near"))
    joined = both.where("other > node").join(least.hint("merge"), F.col("node") == F.col("center"))
    return joined.select(F.col("other").alias("high"), F.least("near", "node").alias("low")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Link each node and its lesser neighbours to the least of these."""
    least = edges.groupBy(F.col("high").alias("center")).agg(F.min("low").alias("near"))
    joined = edges.join(least.hint("merge"), F.col("high") == F.col("center"))
    around = joined.where("low != near").select(F.col("low").alias("high"), F.col("near").alias("low"))
    return around.union(least.select(F.col("center").alias("high"), F.col("near").alias("low"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Component of each node that has an edge: ``node`` and ``component``, the smallest node reachable.

    ``edges`` has long columns ``a`` and ``b``; direction, order and repetition do not matter, null ends and loops are no edges.
    Large-star and small-star steps alternate until nothing changes (Kiveris et al., Connected Components in MapReduce and
    Beyond, 2014), which takes O(log^2 n) rounds at most, whatever the graph; there is no cap.  Each round is kept in the
    shared folder.  Minima are made before rows are exchanged, and the joins are plain sort-merge joins, which
    adaptive execution splits where a node has very many edges.
    """
    pairs = edges.where("a is not null and b is not null and a != b")
    now = cut(pairs.select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct())
    mark = F.xxhash64("high", "low")
    state = lambda e: tuple(e.agg(F.count(F.lit(1)), F.bit_xor(mark), F.sum(F.shiftright(mark, 24))).first())
    before, after = None, state(now)
    while before != after and after[0]:
        now = cut(small_star(large_star(now)))
        before, after = after, state(now)
    own = now.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct()
    return now.select(F.col("high").alias("node"), F.col("low").alias("component")).union(own)
