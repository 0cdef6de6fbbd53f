"""Connected components by alternating stars, on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.session import compact, materialise


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node of an edge: root is the smallest node that it reaches.

    Each round hangs the larger neighbours of every node on the smallest of its neighbours, then the smaller ones; the
    number of rounds grows with the logarithm of the longest path. Rounds are written to the shared folder. Loops and
    repeated edges do no harm; no edges give no rows.
    """
    lo, hi = F.least(a, b), F.greatest(a, b)
    forest = materialise(compact(edges.select(hi.alias("hi"), lo.alias("lo")).where("hi > lo").distinct()))
    before = None
    while (now := forest.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()) != before:
        before = now
        both = forest.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(forest.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e")).select("e.hi", "e.lo")
        forest = materialise(compact(small.where("hi > lo").distinct()))
    return forest.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(forest.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
