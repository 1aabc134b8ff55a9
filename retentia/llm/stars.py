"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import hold, release


def _least(edges: DataFrame) -> DataFrame:
    """(u, m): the smallest of u and its neighbours."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    own = least.select("u", F.col("m").alias("v"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return own.unionByName(moved).where("u <> v").distinct()


def _mark(edges: DataFrame):
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v); a component is named by its smallest node.

    Each round is written out; rounds go on until the edges are stars around the
    smallest nodes, which a row count and a checksum of the edge set show.
    """
    now = hold(edges.select("u", "v").where("u <> v").distinct())
    mark = _mark(now)
    while mark[0]:
        then, before = now, mark
        now = hold(_small_star(_large_star(then).distinct()))
        mark = _mark(now)
        release(then)
        if mark == before:
            break
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.withColumn("component", F.col("node")))
