"""Connected components of links by alternating large-star and small-star steps, all in joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``links(a, b)`` of comparable keys to ``(node, root)``: root is the smallest key reachable; roots are listed too.

    Links of a null end and loops are no links. Each round writes its links to the shared folder, so lineage stays
    short and a lost executor costs one round at most. Minima are aggregated map-side before they are shuffled, and
    joined from behind an exchange of their own so that adaptive execution may split the rows of a hub.
    """
    edges = common.materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    seen = None
    for _ in range(max_rounds):
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = tuple(state)
        # large star: what hangs on v moves to the smallest neighbour of v, if that is smaller than v
        least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k").hint("rebalance")
        large = edges.join(least, edges.v == F.col("k"), "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
        large = common.materialize(large, "large-star")
        # small star: all smaller neighbours of u meet at the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.withColumnRenamed("u", "k").hint("rebalance"), large.u == F.col("k")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = common.materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
    raise RuntimeError("components did not settle")
