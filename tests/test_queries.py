"""A cross-section of the registered queries against their SQL; ``check.py`` runs them all."""

import pytest

import __spark_entry__ as entry
from check import compare, duck

SF = "/root/testdata/sf0.001"
NAMES = [
    "upsert_suppliers", "upsert_incidents", "map_infer", "map_registry_match", "derive_thresholds", "derive_quantiles",
    "derive_risk_score", "derive_description", "validate_summary", "anomaly_all", "docs_summary_text", "docs_link",
    "bm25_search", "retrieve_cosine", "retrieve_hybrid", "ops_incident_kpis", "ops_supplier_detail", "log_agent_stats",
    "log_repeats", "eval_write_back", "report_mitigation", "stream_agent_metrics",
]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) == 10 and sum(r.critical for r in rows) == 1124 and sum(r.low for r in rows) == 1377


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    message, _, good = compare(spark, con, name, entry.queries(), entry.oracle_sql(), SF)
    assert good, message
