"""Connected components of a distributed edge list by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.shared import discard, stored


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """Takes an undirected edge list in its two columns (longs). Returns a stored table (node, root): each node of an
    edge between different nodes, and the smallest node that it reaches.

    Each round hooks every neighbour onto the smallest node near it (logarithmically many rounds); rounds read and
    write tables in the shared folder. The side that may be skewed, a hub's edges, meets a stored table of one row per
    node, so adaptive execution can split the hub."""
    a, b = edges.columns[:2]
    now = stored(edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).where("lo < hi").distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        near = now.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(now.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = stored(near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = stored(now.join(least, now.lo == least.u).select(F.col("m").alias("lo"), "hi").where("lo < hi").distinct(), "large-star")
        nearest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(nearest, "hi").select(F.col("m").alias("a"), F.col("lo").alias("b")).where("a < b")
        after = stored(moved.unionByName(nearest.select(F.col("m").alias("a"), F.col("hi").alias("b"))).distinct().select(F.col("a").alias("lo"), F.col("b").alias("hi")), "small-star")
        mark, before = _mark(after), mark
        for old in (now, least, large):
            discard(old)
        now = after
        if mark == before:
            break
    roots = now.select(F.col("lo").alias("node")).distinct()
    out = stored(now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(roots.select("node", F.col("node").alias("root"))), "components")
    discard(now)
    return out
