"""Supplier and incident tables built from the pipeline frame, and their upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.functions.text import exact_round, quoted
from riskspark.operators import documents as docs
from riskspark.operators.ordering import first_per_key

# Domains of the enumerated columns and what other values become.
SEVERITIES = ["critical", "high", "medium", "low"]
CATEGORIES = ["supplier", "shipment", "inventory", "demand"]
RESOLUTIONS = ["open", "in_progress", "resolved", "closed"]
OPEN = ["open", "in_progress"]


def _one_of(e: str, domain: list[str], default: str) -> str:
    known = ", ".join(quoted(d) for d in domain)
    return f"CASE WHEN lower({e}) IN ({known}) THEN lower({e}) ELSE {quoted(default)} END"


def supplier_rows(df: DataFrame, order: list[str]) -> DataFrame:
    return docs.supplier_stats(df, order).selectExpr(
        "sha2(supplier_id, 256) AS id",
        "supplier_id",
        "name",
        "region",
        "category",
        f"{exact_round('avg_reliability', 2)} AS reliability_score",
        f"{exact_round('avg_delay', 2)} AS avg_delay_days",
        "total AS active_orders",
        f"{_one_of('risk_level', SEVERITIES, 'low')} AS risk_level",
    )


def upsert_suppliers(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Known suppliers get new figures and keep name, region and category; others are added."""
    kept = ["id", "name", "region", "category"]
    updated = ["reliability_score", "avg_delay_days", "active_orders", "risk_level"]
    old, new = existing.alias("o"), batch.alias("n")
    return old.join(new, "supplier_id", "full_outer").select(
        "supplier_id",
        *[F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c) for c in kept],
        *[
            F.when(F.col("n.id").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
            for c in updated
        ],
    ).select(*existing.columns)


def incident_rows(df: DataFrame, order: list[str], unique: bool = False) -> DataFrame:
    """Incidents of one batch: the first row of each code, severity by the fixed rules. With
    ``unique``, the caller has chosen one row of each code already."""
    r = docs.Record(df)
    first = r.frame.withColumn("_code", F.expr(r.code))
    first = first if unique else first_per_key(first, ["_code"], order)
    impact = f"CASE WHEN {r.severity} = 'critical' THEN 9D ELSE 5D END"
    if "ImpactScore" in r.columns:
        impact = f"coalesce(try_cast(ImpactScore AS DOUBLE), {impact})"
    return first.select(
        *[
            F.expr(e).alias(name)
            for name, e in {
                "id": "sha2(_code, 256)",
                "incident_code": "_code",
                "title": f"coalesce(nullif({r.text('Title', '')}, ''), _code)",
                "description": r.text("Description"),
                "severity": r.severity,
                "category": _one_of(r.text("IncidentCategory", "supplier"), CATEGORIES, "supplier"),
                "supplier_id": f"sha2({r.supplier}, 256)",
                "supplier_ref": r.supplier,
                "warehouse_location": r.text("WarehouseLocation"),
                "shipment_status": r.text("ShipmentStatus"),
                "delivery_delay_days": exact_round(r.delay, 2),
                "transportation_cost": exact_round(r.number("TransportationCost"), 2),
                "inventory_level": exact_round(r.stock, 2),
                "demand_forecast": exact_round(r.demand, 2),
                "impact_score": exact_round(impact, 2),
                "resolution_status": _one_of(r.text("ResolutionStatus", "open"), RESOLUTIONS, "open"),
            }.items()
        ],
        r.occurred().alias("occurred_at"),
    )


def insert_new(existing: DataFrame, batch: DataFrame, key: str = "incident_code") -> DataFrame:
    """Adds the rows whose key is not there yet."""
    return existing.unionByName(accepted(existing, batch, key))


def accepted(existing: DataFrame, batch: DataFrame, key: str = "incident_code") -> DataFrame:
    return batch.join(existing.select(key), key, "left_anti").select(*batch.columns)


def rejected(existing: DataFrame, batch: DataFrame, key: str = "incident_code") -> DataFrame:
    return batch.join(existing.select(key), key, "left_semi").select(*batch.columns)


def patch(table: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Overwrites the columns a patch row gives a value for."""
    changed = [c for c in changes.columns if c != key]
    t, p = table.alias("t"), changes.alias("p")
    return t.join(p, key, "left").select(
        *[
            F.coalesce(F.col(f"p.{c}"), F.col(f"t.{c}")).alias(c) if c in changed
            else (F.col(key) if c == key else F.col(f"t.{c}"))
            for c in table.columns
        ]
    )


def delete_rows(table: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    return table.join(keys.select(key), key, "left_anti").select(*table.columns)


def latest(batch: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key by row order."""
    return first_per_key(batch, [key], [F.col(c).desc() for c in order])


def upsert_latest(existing: DataFrame, batch: DataFrame, key: str, order: list[str] | None = None) -> DataFrame:
    """Rows of the batch replace rows with the same key. Where keys repeat inside the batch,
    ``order`` names the columns by which its last row wins; they are not kept."""
    if order:
        batch = latest(batch, key, order).drop(*order)
    return batch.unionByName(existing.join(batch.select(key), key, "left_anti").select(*existing.columns))
