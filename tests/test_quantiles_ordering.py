from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskspark.operators.ordering import number_rows, top_per_key
from riskspark.operators.quantiles import interpolated, order_statistics

rng = np.random.default_rng(11)
SHAPES = {
    "uniform": rng.uniform(0, 100, 4000),
    "few": rng.integers(0, 5, 4000).astype(float),
    "constant": np.full(300, 7.25),
    "outlier": np.append(rng.normal(50, 0.001, 4000), [1e18, -1e18]),
    "tiny": rng.uniform(1e-13, 2e-13, 2000),
    "signed": rng.normal(0, 1e6, 4000),
    "hot": np.append(np.zeros(3000), rng.uniform(0, 1, 1500)),
    "one": np.array([3.5]),
    "dense": 1 + rng.uniform(0, 1e-9, 30_000),
    "neighbours": 1 + np.arange(5000) * 2.0 ** -52,
    "extremes": np.array([1.7e308, -1.7e308, 5e-324, -5e-324, 0.0, 1.0, 1e300]),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_quantiles_are_exact(spark, shape):
    data = SHAPES[shape]
    df = spark.createDataFrame([(float(x),) for x in data], "x double").repartition(4)
    points = {p: interpolated(len(data), p) for p in (0.0, 0.1, 0.5, 0.75, 0.9, 1.0)}
    ranks = [r for low, high, _ in points.values() for r in (low, high)]
    found = order_statistics(df, {"x": F.col("x")}, {"x": ranks})
    ordered = np.sort(data)
    for p, (low, high, weight) in points.items():
        assert (found["x", low], found["x", high]) == (ordered[low], ordered[high])
        if shape != "extremes":  # whose differences overflow
            value = found["x", low] + (found["x", high] - found["x", low]) * weight
            assert value == pytest.approx(np.quantile(data, p))


def test_no_pass_lists_distinct_values(spark, monkeypatch):
    from riskspark.operators import quantiles

    seen = []
    holding = quantiles._holding

    def watched(hist, keys, by, wanted):
        seen.append(max((r["count"] for r in hist.groupBy(*keys).count().collect()), default=0))
        return holding(hist, keys, by, wanted)

    monkeypatch.setattr(quantiles, "_holding", watched)
    monkeypatch.setattr(quantiles, "_SPLIT", 64)
    data = np.sort(1 + rng.uniform(0, 1e-9, 20_000))
    df = spark.createDataFrame([(float(x),) for x in data], "x double").repartition(4)
    assert order_statistics(df, {"x": F.col("x")}, {"x": [9999, 3]}) == {("x", 9999): data[9999], ("x", 3): data[3]}
    assert len(seen) > 3 and max(seen) <= 64


def test_several_columns_at_once(spark):
    df = spark.createDataFrame([(float(i), float(i % 3)) for i in range(1000)], "a double, b double")
    found = order_statistics(df, {"a": F.col("a"), "b": F.col("b")}, {"a": [0, 999, 500], "b": [0, 999]})
    assert found == {("a", 0): 0.0, ("a", 500): 500.0, ("a", 999): 999.0, ("b", 0): 0.0, ("b", 999): 2.0}


def test_row_numbers_are_dense_and_ordered(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k"), (F.col("id") % 2).alias("hot"))
    rows = number_rows(df.repartition(7), ["hot", "k"]).orderBy("row_seq").collect()
    assert [r.row_seq for r in rows] == list(range(1, 5001))
    assert [(r.hot, r.k) for r in rows] == sorted((r.hot, r.k) for r in rows)


def test_top_per_key_limits_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    top = top_per_key(df, ["k"], [F.col("id").desc()], 2)
    assert sorted((r.k, r.id) for r in top.collect()) == [(0, 996), (0, 999), (1, 994), (1, 997), (2, 995), (2, 998)]
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_scratch_is_cleared(spark):
    from riskspark.session import clear_scratch, landed, scratch_path

    kept = landed(spark.range(3))
    assert kept.count() == 3
    clear_scratch(spark)
    clear_scratch(spark)
    folder = scratch_path(spark, "x").rsplit("/", 1)[0].removeprefix("file://")
    assert not Path(folder).exists()
