"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskloom.llm import store


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) for every node of the edges `a`, `b`.

    Rounds of large-star and small-star steps: every node's neighbours are linked to
    the smallest of them, until nothing changes; the rounds grow with the logarithm
    of the longest path. A hub's neighbours are only ever aggregated, never listed.
    Each round is written, so a lost executor costs one step. Self-edges keep a node
    in the result.
    """
    links = edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    links = store.written(links)
    nodes = links.select(F.explode(F.array("hi", "lo")).alias("node")).distinct()
    links, before = links.where("hi != lo"), None
    while True:
        both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(links.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi != lo").distinct()
        large = store.written(large)
        root = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(root, "hi").select(
            F.explode(F.array(F.struct(F.col("hi").alias("hi"), F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e")
        ).select("e.*").where("hi != lo").distinct()
        small = store.written(small)
        # Equal sets of edges have equal counts and digests: nothing changed any more.
        now = tuple(small.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first())
        if now == before:
            break
        links, before = small, now
    return nodes.join(small.withColumnRenamed("hi", "node"), "node", "left").select("node", F.coalesce("lo", "node").alias("component"))
