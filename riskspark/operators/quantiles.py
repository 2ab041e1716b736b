"""Exact quantiles by narrowing value ranges.

``percentile`` keeps every distinct value of a column in one task. Here each pass
only counts values per range, a histogram of bounded width that every task adds up before
the shuffle, and the next pass looks inside the ranges that hold the wanted ranks. A range
with a single distinct value ends the search, so columns with few values need one pass, and
no more than five or so are ever needed. Like ``approxQuantile`` this runs jobs and returns
plain numbers; at most one row per wanted rank reaches the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_LOG_STEPS = 512  # ranges per e-fold of the absolute value
_SPLIT = 65536  # equal parts of a range in the later passes


def _log_range(v: Column) -> Column:
    # log1p never decreases, so the range number never decreases with the value
    return F.floor(F.signum(v) * F.log1p(F.abs(v) * 1e6) * _LOG_STEPS)


def _holding(hist: DataFrame, keys: list[str], by: str, wanted: list[tuple]) -> list:
    """The ranges that hold a wanted rank: hist has ``n`` rows per range of the same keys in
    the order of ``by``. ``wanted`` are (key values..., rank within these keys)."""
    w = Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    placed = hist.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    tests = []
    for *values, rank in sorted(set(wanted)):
        same = " AND ".join(f"{k} = {v!r}" for k, v in zip(keys, values))
        tests.append(f"({same} AND {rank} >= before AND {rank} < before + n)")
    return placed.filter(" OR ".join(tests)).collect()


def order_statistics(df: DataFrame, columns: dict[str, Column], ranks: dict[str, list[int]]) -> dict:
    """{(name, rank): value} for 0-based ranks among the non-null values of each column."""
    wanted = [(m, int(r)) for m, rs in ranks.items() for r in rs]
    if not wanted:
        return {}
    long = df.select(
        F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), c.alias("v")) for n, c in columns.items()]))
    ).filter(F.col("v").isNotNull())
    bounds = [F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")]

    long = long.withColumn("k", _log_range(F.col("v")))
    found, open_ = {}, {}
    for h in _holding(long.groupBy("metric", "k").agg(*bounds), ["metric"], "k", wanted):
        for m, rank in wanted:
            if m == h.metric and h.before <= rank < h.before + h.n:
                if h.low == h.high:
                    found[m, rank] = h.low
                else:
                    open_[m, rank] = (h.low, h.high, rank - h.before)
    if not open_:
        return found

    # look inside the ranges that hold a rank, each split into equal parts, until a range has one value:
    # its least and greatest value fall into different parts, so every pass narrows all ranges left
    while open_:
        ranges = sorted({(m, low, high) for (m, _), (low, high, _) in open_.items()})
        parts = F.lit(None).cast("bigint")
        for i, (m, low, high) in enumerate(ranges):
            inside = (F.col("metric") == m) & F.col("v").between(low, high)
            part = F.floor((F.col("v") - low) / (high - low) * (_SPLIT - 1)) + i * _SPLIT
            parts = F.when(inside, part).otherwise(parts)
        hist = long.withColumn("part", parts).filter(F.col("part").isNotNull()).withColumn(
            "place", F.floor(F.col("part") / _SPLIT)).groupBy("metric", "place", "part").agg(*bounds)
        wanted = [(m, ranges.index((m, low, high)), r) for (m, _), (low, high, r) in open_.items()]
        held = _holding(hist, ["metric", "place"], "part", wanted)
        after = {}
        for (m, rank), (low, high, r) in open_.items():
            for h in held:
                if (m, ranges.index((m, low, high))) == (h.metric, h.place) and h.before <= r < h.before + h.n:
                    if h.low == h.high:
                        found[m, rank] = h.low
                    else:
                        after[m, rank] = (h.low, h.high, r - h.before)
        open_ = after
    return found


def interpolated(n: int, p: float) -> tuple[int, int, float]:
    """Lower rank, upper rank and weight of the upper one for linear interpolation."""
    position = p * (n - 1)
    low = math.floor(position)
    return low, math.ceil(position), position - low
