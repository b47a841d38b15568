"""Connected components of a graph given as edges between integers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Neighbours from which a node may count as hot, and the number of hot nodes at most, about: a bound on what is broadcast.
HOT = 200
MAX_HOT = 4000


def _hung(edges: DataFrame, least: DataFrame, hot_from: int) -> DataFrame:
    """Each edge (a, b) with m, what `least` (n, m, degree) has for a.

    The edges of a hot node would all meet in one task; hot nodes are at most MAX_HOT, and are broadcast.
    """
    hot = F.broadcast(least.where(F.col("degree") >= hot_from).select(F.col("n").alias("hn"), F.col("m").alias("hm")))
    marked = edges.join(hot, F.col("a") == F.col("hn"), "left")
    cold = marked.where("hn IS NULL").select("a", "b").join(least.where(F.col("degree") < hot_from), F.col("a") == F.col("n"))
    return marked.where("hn IS NOT NULL").select("a", "b", F.col("hm").alias("m")).union(cold.select("a", "b", "m"))


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of each node in `edges` (a, b).

    Large-star and small-star steps alternate until nothing changes: each
    hangs a node's neighbours on the least of them. Least neighbours are found by
    aggregation with partial sums, and joined back, so no neighbourhood is
    held in one task's memory. Every round is cut into the shared folder.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    n = now.count()
    seen = None
    while True:
        hot_from = max(HOT, -(-2 * n // MAX_HOT))  # a round has at most 2n ends of edges
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("degree")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"), "degree")
        large = _hung(both, least, hot_from).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("degree")).withColumnRenamed("a", "n")
        small = _hung(large, down, hot_from).select(F.col("b").alias("a"), F.col("m").alias("b")).union(down.select("n", "m")).where("a <> b")
        now = cut(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen, n = state, state["n"]
    # A fixpoint is a set of stars whose centres are the least nodes.
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
