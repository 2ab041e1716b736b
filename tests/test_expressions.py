import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskspark import schema
from riskspark.functions import columns as c
from riskspark.functions import rules
from riskspark.functions.similarity import AliasMatcher


def values(spark, exprs, rows=1):
    return spark.range(rows).select(*exprs).first()


def test_fixed_and_exact_round_follow_binary_values(spark):
    rng = random.Random(3)
    xs = [0.125, 2.675, 1.005, 2.5, 3.5, -0.5, 1234567.891] + [rng.uniform(-1e4, 1e4) for _ in range(200)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = df.select("x", c.fixed(F.col("x"), 2).alias("f"), c.exact_round(F.col("x"), 2).alias("r"),
                    c.grouped(F.col("x"), 0).alias("g")).collect()
    for row in got:
        assert float(row.f) == float(f"{row.x:.2f}")
        assert row.r == round(row.x, 2)
        assert row.g.replace("-0", "0") == f"{row.x:,.0f}".replace("-0", "0")


def test_header_normalisation(spark):
    for raw in ["  Supplier_ID ", "lead--time", "Lead Time (days)", "a \t_-b"]:
        got = values(spark, [c.normalise_header(F.lit(raw))])[0]
        assert got == re.sub(r"[\s_\-]+", " ", raw.lower().strip())


def test_text_helpers(spark):
    row = values(spark, [
        c.slug(F.lit("--Acme & Sons (EU)!")).alias("slug"),
        c.text_or(F.lit("  ")).alias("na"),
        c.float_or(F.lit(" 7 ")).alias("seven"),
        c.float_or(F.lit("NaN"), 100.0).alias("nan"),
        c.tokens(F.lit("SUP-003: 12% Late!")).alias("tokens"),
        c.contains_text(F.lit("50% OFF_x"), "% off_").alias("literal"),
    ])
    assert (row.slug, row.na, row.seven, row.nan) == ("acme-sons-eu", "N/A", 7.0, 100.0)
    assert row.tokens == ["sup", "003", "12", "late"]
    assert row.literal


def test_parse_time(spark):
    texts = ["2024-06-01", "2024-06-01T10:11:12", "6/1/2024", "never", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(c.iso_time(c.parse_time(F.col("t")))).collect()]
    assert got == ["2024-06-01T00:00:00", "2024-06-01T10:11:12", "2024-06-01T00:00:00", None, None]


@pytest.mark.parametrize("delay,stock,demand,expected", [
    (18.0, 120.0, 800.0, "critical"), (0.0, 900.0, 800.0, "low"), (5.0, 400.0, 800.0, "medium"),
    (14.0, 900.0, 800.0, "high"), (7.0, 900.0, 800.0, "medium"), (3.0, 900.0, 800.0, "low"),
    (0.0, 160.0, 800.0, "high"), (0.0, 0.0, 0.0, "low"), (0.0, 10.0, -1.0, "low"),
])
def test_rule_severity(spark, delay, stock, demand, expected):
    sql = rules.rule_severity(f"{delay}D", f"{stock}D", f"{demand}D")
    assert values(spark, [F.expr(sql)])[0] == expected


def test_status_bands(spark):
    bands = {-0.1: "Early", 0.0: "On-Time", 3.0: "In-Transit", 7.0: "Delayed", 7.1: "Critical"}
    for delay, expected in bands.items():
        assert values(spark, [F.expr(rules.shipment_status(f"{delay}D"))])[0] == expected


def test_supplier_risk(spark):
    for (critical, high, delay), expected in {
        (3, 0, 0.0): "critical", (2, 3, 0.0): "high", (0, 0, 10.1): "high", (0, 0, 10.0): "medium",
        (0, 0, 3.0): "low",
    }.items():
        assert values(spark, [F.expr(rules.supplier_risk(str(critical), str(high), f"{delay}D"))])[0] == expected


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
        row = new
    return row[-1]


def test_alias_table():
    table = schema.aliases()
    norms = [a for a, _ in table]
    assert len(norms) == len(set(norms))
    assert dict(table)["vendorid"] == "supplier_id" and "vendorcode" not in norms
    assert dict(table)["lead time (days)"] == "lead_time_days"
    assert max(len(a) for a in norms) <= 64


def test_matcher_equals_brute_force():
    matcher, table, rng = AliasMatcher(), schema.aliases(), random.Random(5)
    texts = ["suplier nme", "", "x", "delivry dely", "é stock", "warehouse location of the north depot " * 3]
    for _ in range(25):
        alias = list(rng.choice(table)[0])
        for _ in range(rng.randint(0, 4)):
            alias[rng.randrange(len(alias))] = rng.choice("abcxyz _")
        texts.append("".join(alias))
    for text in texts:
        expected = [2 * lcs(text, a) / (len(text) + len(a)) for a, _ in table]
        assert np.allclose(matcher.ratios(text), expected)
    assert matcher.best("suplier nme") == ("supplier_name", pytest.approx(22 / 24))


def test_only_texts_of_a_layout_are_parsed_as_dates(spark):
    texts = ["3/4/2024", "2024/3/4", "4-Mar-2024", "4-mar-2024", "3/4/2024 5:06", "Mar 4, 2024", "March 4, 2024", "4 Mar 2024",
             "4 March 2024", "04.03.2024", "20240304", "2024-03-04", "note 3", "note 3 of 4", "a/b/1", "3/4/2024x", "", " ",
             " 3/4/2024", "3/4/2024\n", "1.5", "-20240304", "+20240304", "2024030", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    tried = F.coalesce(F.col("t").try_cast("timestamp_ntz"),
                       *[F.try_to_timestamp("t", F.lit(f)).cast("timestamp_ntz") for f in c.DATE_FORMATS])
    for row in df.select("t", c.parse_time(F.col("t")).cast("string").alias("got"), tried.cast("string").alias("want")).collect():
        assert row.got == row.want, row.t
    shapes = F.array(*[F.rlike("t", F.lit(s)) for s in c.DATE_FORMATS.values()])
    assert not any(df.filter("t = 'note 3'").select(shapes).first()[0])
