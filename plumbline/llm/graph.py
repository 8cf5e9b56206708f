"""Connected components of a link table, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import common


def components(links: DataFrame, folder: str, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of ``links`` (left, right longs): the
    smallest node that can be reached.

    Large-star and small-star steps in turn (Kiveris and others, 2014): each
    node's greater neighbours move to its smallest one, then each node's
    smaller ones do. Rounds grow with the logarithm of the nodes, each round is
    a written table, and a node of many links is pre-aggregated, not gathered.
    """
    spark = links.sparkSession
    edges = links.where("left <> right").select(F.greatest("left", "right").alias("a"), F.least("left", "right").alias("b")).distinct()
    edges = common.written(spark, edges, f"{folder}/edges")
    before = None
    for k in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        # large star: neighbours above a node go to its smallest
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        large = common.written(spark, large, f"{folder}/large{k}")
        # small star: a node and its neighbours below it go to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        edges = common.written(spark, small, f"{folder}/small{k}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40)), F.count_if(F.col("a") == F.col("b"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components didn't settle")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
