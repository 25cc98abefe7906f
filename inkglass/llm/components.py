"""Connected components of an undirected edge table by alternating stars.

Every round is two aggregations and two joins over the edge table, and its
result goes to shared storage, so no lineage builds up; the driver learns only whether
stars are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkglass.session import scratch_dir, stored


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    hop = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hop.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _stars(e: DataFrame) -> bool:
    """Whether every u has one v, and no v is a u: nothing is left to do."""
    ends = e.select("u", F.lit(1).alias("n")).unionByName(e.select(F.col("v").alias("u"), F.lit(0).alias("n")).distinct())
    return ends.groupBy("u").agg(F.sum("n").alias("s"), F.min("n").alias("m")).where("s > 1 or s = 1 and m = 0").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): every node of ``edges`` with the smallest node it reaches.

    Null ends and loops are left out; repeated edges count once.
    """
    spark = edges.sparkSession
    where = scratch_dir(spark)
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e, k = stored(e, where, "e0"), 0
    while not _stars(e):
        k += 1
        e = stored(_small_star(_large_star(e)), where, f"e{k}")
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
