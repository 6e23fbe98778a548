"""Connected components of a large edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (u long, v long): the smallest node reachable.

    Every step pre-aggregates the smallest neighbour per node and joins it back, so a node with very many
    neighbours is a skewed join key that Spark splits; each step is a written table, so nothing of an
    earlier one is computed again. Null ends and loops are ignored. Ends after about log(diameter) steps.
    """
    pairs = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    while not pairs.isEmpty():
        both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written before the join, so that Spark can split the rows of a node with very many neighbours.
        low = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-low")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.withColumnRenamed("m", "v")).distinct()
        pairs = materialise(small, "cc")
        # Done when every node hangs on one other that hangs on none.
        ends = pairs.select(F.col("u").alias("x"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(pairs.select(F.col("v").alias("x"), F.lit(0).alias("below"), F.lit(1).alias("above")))
        if ends.groupBy("x").agg(F.sum("below").alias("below"), F.max("above").alias("above")).where("below + above > 1").isEmpty():
            break
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
