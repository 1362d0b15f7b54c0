"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import written
from quern.sources.places import forget

#: Edges of a node from which on its least neighbour is told to all tasks, and how many such nodes there may be at most.
HUB, MOST_HUBS = 64, 100_000


def _with_least(rows: DataFrame, least: DataFrame, hub: int) -> DataFrame:
    """rows (u, v) with m of least (u, m, n: rows of u).

    A hub's rows stay where they are: its least neighbour comes to them. There are at most
    twice as many hubs as edges over hub, so what is broadcast is bounded; other nodes have few rows each.
    """
    many, few = F.broadcast(least.where(F.col("n") > hub).select("u", "m")), least.where(F.col("n") <= hub).select("u", "m")
    return rows.join(many, "u").unionByName(rows.join(many, "u", "left_anti").join(few, "u"))


def _large_star(e: DataFrame, hub: int) -> DataFrame:
    """Each neighbour above u is tied to the least of u and all its neighbours."""
    both = e.union(e.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n"))
    return _with_least(both.where("v > u"), least, hub).select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(e: DataFrame, hub: int) -> DataFrame:
    """Each node and its lower neighbours are tied to the least of them."""
    down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    rest = _with_least(down, least, hub).where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return rest.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, *, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (a, b: long): the least node that it reaches, for all but those least nodes.

    Self-loops, repeats and either direction are fine; no edges give no rows. Every round is
    written to the shared folder, so the lineage stays short and a lost executor costs one
    round; the round before goes once the next one is there. Only two counts a round come to the driver.
    """
    spark = edges.sparkSession
    now, path = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    for _ in range(most_rounds):
        mark = tuple(now.agg(F.count("*"), F.expr("coalesce(bit_xor(xxhash64(a, b)), 0)")).first())
        if mark == seen or not mark[0]:
            return now.toDF("node", "component")
        seen = mark
        hub = max(HUB, 2 * mark[0] // MOST_HUBS)
        after, new = written(_small_star(_large_star(now, hub), hub), "edges")
        forget(spark, path)
        now, path = after, new
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")
