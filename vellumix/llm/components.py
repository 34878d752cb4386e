"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vellumix.llm.scratch import Scratch


def components(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node with an edge; root is the least node of its component.

    edges: columns a and b of one orderable type; loops and repeats don't matter.
    Each round points neighbours at the least node seen, once towards larger and
    once towards smaller nodes, so depth shrinks by half or better.  Minima are
    pre-aggregated before the shuffle, and each join reads two written tables, so
    a hub's rows can be split among tasks.
    """
    pair = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = scratch.put(pair, "edges")
    seen = None
    for _ in range(most_rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = scratch.put(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = scratch.put(large, "large")
        small = scratch.put(large.groupBy("a").agg(F.min("b").alias("m")), "small")
        hops = large.join(small, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = scratch.put(hops.union(small.select("a", F.col("m").alias("b"))).distinct(), "edges")
        scratch.drop(now, least, large, small)
        now = after
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def near_labels(edges: DataFrame, scratch: Scratch, hops: int = 3) -> DataFrame:
    """(node, root) with the least node within a few hops as root: part of a component, often all of it."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    near = scratch.put(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("root")), "near")
    both = both.union(near.select(F.col("node").alias("u"), F.col("node").alias("v")))
    for _ in range(hops - 1):
        seen = both.join(near.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("root").alias("root"))
        near = scratch.put(seen.select(F.col("u").alias("node"), "root"), "near")
    return near
