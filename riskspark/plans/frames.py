"""Frames the registered queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.operators import derive, incidents
from riskspark.operators.ordering import first_per_key
from riskspark.sources import fixtures as fx

# Canonical columns that come from the line table alone and that derivations read.
CORE = [
    "supplier_id", "sku", "inventory_level", "lead_time_days", "delivery_delay_days", "shipment_status",
    "transportation_cost", "defect_rate", "severity", "risk_score", "timestamp",
]
TEXTS = ["supplier_name", "product_type", "demand_forecast", "warehouse_location", "inspection_status"]


def enriched(spark: SparkSession, sf: str, extra: list[str] | None = None, one_per_code: bool = False) -> DataFrame:
    """Derived fields over the canonical fixture. Joins add no lines and drop none, so the
    batch statistics are taken from the line table. With ``one_per_code``, of the first line of each code."""
    stats = derive.batch_stats(fx.canonical(spark, sf, CORE))
    wanted = CORE + [c for c in extra or [] if c not in CORE]
    early = one_per_code and not derive.needs_row_numbers(stats)  # those count all lines
    found = derive.derive_fields(fx.canonical(spark, sf, wanted, early), fx.AS_OF, fx.ORDER, stats=stats)[0]
    return first_per_key(found, ["sku"], fx.ORDER) if one_per_code and not early else found


_FORMATTED = TEXTS + ["region", "reliability_score", "resolution_status"]


def formatted(spark: SparkSession, sf: str, keep: list[str] | None = None) -> DataFrame:
    return _format(enriched(spark, sf, _FORMATTED + list(keep or [])))


def _format(df: DataFrame) -> DataFrame:
    return derive.to_pipeline(
        df.withColumnsRenamed(
            {"region": "Region", "reliability_score": "ReliabilityScore", "resolution_status": "ResolutionStatus"}))


def incident_table(spark: SparkSession, sf: str) -> DataFrame:
    """The first line of each code is chosen from the line table; fields and texts are made after that."""
    first = enriched(spark, sf, _FORMATTED, one_per_code=True)
    return incidents.incident_rows(_format(first), fx.ORDER, unique=True)


def supplier_table(spark: SparkSession, sf: str) -> DataFrame:
    return incidents.supplier_rows(formatted(spark, sf), fx.ORDER)

