"""Row numbers over a whole table without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark.session import cut_lineage

_POSITION_BITS = 33  # layout of monotonically_increasing_id: partition, then position


def number_rows(df: DataFrame, order: list[Column | str], name: str = "row_seq") -> DataFrame:
    """Dense numbers from 1 in the given order, which must not have ties.

    A range sort spreads the rows, the checkpoint fixes which partition each row is
    in, and one count per partition turns local positions into global ones.
    """
    placed = cut_lineage(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", _POSITION_BITS)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition of the sort, so this side stays small
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_offset"))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(
            name,
            F.col("_offset") + F.col("_id").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)) + F.lit(1),
        )
        .drop("_part", "_offset", "_id")
    )


def first_per_key(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    return top_per_key(df, keys, order, 1).drop("_rank")


def top_per_key(
    df: DataFrame, keys: list[str], order: list[Column | str], k: int, rank: str = "_rank"
) -> DataFrame:
    """The first ``k`` rows of each key. Spark cuts every task's share of a key to ``k``
    rows before the shuffle, so a key that holds most rows stays small."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)
