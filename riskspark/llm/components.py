"""Connected components of an edge table, by alternating star rounds.

Each round points nodes at the smallest neighbour they know (large star, then small star); the
number of rounds follows the logarithm of the longest path. Minima are taken by map-side
combinable aggregates, so a node with very many edges is reduced in every task before the
shuffle. Each round is written to the shared folder, which also cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.session import landed


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component: the smallest node reachable, for every node of ``edges``.

    Rows with a null end and loops are ignored; repeated edges count once.
    """
    state = landed(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                   .filter("u is not null and v is not null and u <> v").distinct(), "edges")
    while True:
        # large star: larger neighbours of a node are linked to its smallest neighbour or itself
        both = state.union(state.select(F.col("v"), F.col("u"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.join(least, "u").filter("v > u and v <> m")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small star: smaller neighbours and the node itself are linked to the smallest neighbour
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
                 .filter("u <> v").distinct())
        after = landed(small, "edges")
        if _same(state, after):
            break
        state = after
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        state.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def _same(before: DataFrame, after: DataFrame) -> bool:
    marks = [F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))]
    return tuple(before.agg(*marks).first()) == tuple(after.agg(*marks).first())
