"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is a partial aggregation (the smallest neighbour of a node) and a join, so a hub costs
no more than its edges; no component is gathered anywhere. Edges and labels are written to the
shared folder each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import few_tasks, forget, written


def _nearest(edges: DataFrame, rows: int) -> DataFrame:
    """The smallest of each node and its neighbours; written, so that the join behind it is a stage of its own,
    in which Spark can split a hub's edges."""
    return written(few_tasks(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), rows), "nearest")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, label) of every node in edges (a, b), label the smallest node it reaches. Steps over few edges run in few tasks."""
    edges = written(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b").distinct(), "edges")
    mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    if not mark[0]:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    for _ in range(max_rounds):
        rows = 2 * mark[0]
        both = edges.union(edges.select("b", "a"))
        first = _nearest(both, rows)
        star = both.join(first, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))  # a row an edge at most
        down = star.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        near = _nearest(down, rows)
        small = down.join(near, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(near.select("a", F.col("m").alias("b")))
        before, edges = edges, written(few_tasks(small.filter("a <> b").distinct(), rows), "edges")
        forget(before, first, near)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = edges.groupBy("a").agg(F.min("b").alias("label")).withColumnRenamed("a", "node")
    return few_tasks(stars.union(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()), 2 * now[0])
