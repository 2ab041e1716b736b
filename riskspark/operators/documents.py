"""Text documents with metadata: one per record, one summary per supplier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.functions import rules
from riskspark.functions.columns import iso_time, parse_time
from riskspark.functions.text import exact_round, filled, fixed, float_or, grouped, num, quoted, text_or
from riskspark.operators.ordering import first_per_key, number_rows, top_per_key
from riskspark.session import landed

RECENT_INCIDENTS = 5

# Label texts of a supplier summary.
RISK_LABELS = {
    "critical": "CRITICAL SUPPLIER — Multiple critical incidents detected",
    "high": "HIGH RISK SUPPLIER — Frequent high-severity delays",
    "medium": "MEDIUM RISK SUPPLIER — Some delivery issues",
    "low": "LOW RISK SUPPLIER — Generally reliable performance",
}


class Record:
    """The values of a pipeline row, missing ones replaced by their defaults.

    The attributes are SQL texts; numbers and severity are helper columns of ``frame``,
    so that they are computed once per row.
    """

    def __init__(self, df: DataFrame):
        self.columns = set(df.columns)
        self.delay, self.stock, self.demand = "_delay", "_stock", "_demand"
        self.cover, self.severity = "_cover", "_severity"
        self.code = self.text("IncidentCode", "")
        self.supplier = self.text("SupplierID")
        self.frame = (
            df.selectExpr(
                "*",
                f"{self.number('DeliveryDelayDays')} AS _delay",
                f"{self.number('InventoryLevel', 100.0)} AS _stock",
                f"{self.number('DemandForecast', 100.0)} AS _demand",
            )
            .selectExpr(
                "*",
                f"{rules.coverage('_stock', '_demand')} AS _cover",
                f"{rules.rule_severity('_delay', '_stock', '_demand')} AS _severity",
            )
        )

    def number(self, name: str, default: float = 0.0) -> str:
        return float_or(name, default) if name in self.columns else num(default)

    def text(self, name: str, default: str = "N/A") -> str:
        return text_or(name, default) if name in self.columns else quoted(default)

    @property
    def chunk_id(self) -> str:
        return f"concat('record_', {self.code}, '_', {self.supplier})"

    def occurred(self) -> Column:
        if "OccurredAt" not in self.columns:
            return F.lit(None).cast("timestamp_ntz")
        return parse_time(F.col("OccurredAt").cast("string"))


def fill_codes(df: DataFrame, order: list[str], upload: str | None = None) -> DataFrame:
    """Gives rows without a code INC- and their 0-based row number, within each ``upload`` if that
    column is named. Rows are numbered only when some code is missing."""
    code = F.expr(Record(df).code)
    if "IncidentCode" in df.columns and df.filter(code == "").isEmpty():
        return df
    numbered = number_rows(df.drop("row_seq"), order)
    if upload:
        starts = numbered.groupBy(upload).agg((F.min("row_seq") - 1).alias("_before"))
        numbered = numbered.join(starts, upload).withColumn("row_seq", F.col("row_seq") - F.col("_before")).drop("_before")
    number = (F.col("row_seq") - 1).cast("string")
    padded = F.when(F.length(number) < 5, F.lpad(number, 5, "0")).otherwise(number)
    return numbered.withColumn(
        "IncidentCode", F.when(code == "", F.concat(F.lit("INC-"), padded)).otherwise(code))


# Fixed value: the text of a record; names in braces are slots.
RECORD_TEXT = """SUPPLY CHAIN INCIDENT REPORT
Incident Code: {code}
Supplier: {name} (ID: {supplier})
Region: {region} | Category: {category}
Reliability Score: {reliability}/100

Logistics:
  Warehouse Location: {location}
  Shipment Status: {status}
  Delivery Delay: {delay} days
  Transportation Cost: ${cost}

Inventory:
  Current Level: {stock} units
  Demand Forecast: {demand} units
  Coverage Ratio: {cover} ({stock_status})

Incident:
  Title: {title}
  Description: {description}
  Severity: {severity}
  Category: {incident_category}
  Date: {date}
  Resolution: {resolution}
"""


def record_text(r: Record) -> Column:
    return F.expr(filled(RECORD_TEXT, {
        "code": r.code,
        "name": r.text("SupplierName"),
        "supplier": r.supplier,
        "region": r.text("Region"),
        "category": r.text("SupplierCategory"),
        "reliability": fixed(r.number("ReliabilityScore"), 1),
        "location": r.text("WarehouseLocation"),
        "status": r.text("ShipmentStatus"),
        "delay": fixed(r.delay, 1),
        "cost": grouped(r.number("TransportationCost"), 2),
        "stock": fixed(r.stock, 0),
        "demand": fixed(r.demand, 0),
        "cover": fixed(r.cover, 2),
        "stock_status": f"CASE WHEN {r.cover} < 0.5D THEN 'STOCKOUT RISK' ELSE 'ADEQUATE' END",
        "title": r.text("Title"),
        "description": r.text("Description"),
        "severity": f"upper({r.severity})",
        "incident_category": r.text("IncidentCategory"),
        "date": r.text("OccurredAt"),
        "resolution": r.text("ResolutionStatus", "open"),
    }))


METADATA_TYPES = {
    **{c: "string" for c in (
        "supplier_id", "supplier_name", "region", "supplier_category", "severity", "incident_category",
        "warehouse_location", "shipment_status")},
    **{c: "double" for c in (
        "delivery_delay_days", "transportation_cost", "inventory_level", "demand_forecast", "coverage_ratio")},
    "resolution_status": "string",
    "incident_code": "string",
    "occurred_at": "string",
    "year": "int",
    "month": "int",
    # only on summaries
    "avg_delay_days": "double",
    "avg_reliability_score": "double",
    "total_incidents": "bigint",
    "critical_incidents": "bigint",
    "high_incidents": "bigint",
    "chunk_type": "string",
}


def _chunk(df: DataFrame, kind: str, chunk_id: str, text: Column, metadata: dict[str, str | Column]) -> DataFrame:
    full = {**metadata, "chunk_type": quoted(kind)}
    fields = []
    for name, kind_ in METADATA_TYPES.items():
        value = full.get(name, "NULL")
        value = F.expr(f"CAST({value} AS {kind_})") if isinstance(value, str) else value.cast(kind_)
        fields.append(value.alias(name))
    return df.select(
        F.expr(chunk_id).alias("chunk_id"),
        text.alias("text"),
        F.struct(*fields).alias("metadata"),
        F.expr(metadata["supplier_id"]).alias("supplier_ref"),
        F.lit(kind).alias("chunk_type"),
    )


def record_documents(df: DataFrame) -> DataFrame:
    r = Record(df)
    when = r.occurred()
    metadata = {
        "supplier_id": r.supplier,
        "supplier_name": r.text("SupplierName"),
        "region": r.text("Region"),
        "supplier_category": r.text("SupplierCategory"),
        "severity": r.severity,
        "incident_category": r.text("IncidentCategory", "supplier"),
        "warehouse_location": r.text("WarehouseLocation"),
        "shipment_status": r.text("ShipmentStatus"),
        "delivery_delay_days": exact_round(r.delay, 2),
        "transportation_cost": exact_round(r.number("TransportationCost"), 2),
        "inventory_level": exact_round(r.stock, 2),
        "demand_forecast": exact_round(r.demand, 2),
        "coverage_ratio": exact_round(r.cover, 4),
        "resolution_status": r.text("ResolutionStatus", "open"),
        "incident_code": r.code,
        "occurred_at": iso_time(when),
        "year": F.year(when),
        "month": F.month(when),
    }
    return _chunk(r.frame, "record", r.chunk_id, record_text(r), metadata)


def supplier_stats(df: DataFrame, order: list[str]) -> DataFrame:
    """One row per supplier: first name, region and category in row order, means and counts.

    Only map-side combinable aggregates, so a supplier that holds most rows is reduced
    in every task before the shuffle. Rows without a supplier have no summary.
    """
    r = Record(df)
    first = (
        f"struct({r.text('SupplierName')} AS name, {r.text('Region')} AS region, "
        f"{r.text('SupplierCategory')} AS category)"
    )
    stats = r.frame.filter("SupplierID IS NOT NULL").groupBy("SupplierID").agg(
        F.expr(f"min_by({first}, struct({', '.join(order)}))").alias("first"),
        F.expr(f"avg({r.delay})").alias("avg_delay"),
        F.expr(f"avg({r.number('ReliabilityScore')})").alias("avg_reliability"),
        F.expr(f"count_if({r.severity} = 'critical')").alias("critical_count"),
        F.expr(f"count_if({r.severity} = 'high')").alias("high_count"),
        F.count("*").alias("total"),
    )
    return stats.selectExpr(
        "SupplierID AS supplier_id", "first.name", "first.region", "first.category", "avg_delay", "avg_reliability",
        "critical_count", "high_count", "total",
        f"{rules.supplier_risk('critical_count', 'high_count', 'avg_delay')} AS risk_level")


def recent_incidents(df: DataFrame, order: list[str]) -> DataFrame:
    """The first five incidents of each supplier in row order, as lines of text."""
    r = Record(df)
    line = f"concat('  [', {r.text('OccurredAt')}, '] ', {r.text('Title')}, ' (', upper({r.severity}), ')')"
    rows = r.frame.filter("SupplierID IS NOT NULL").select(
        F.col("SupplierID").alias("supplier_id"), *order, F.expr(line).alias("line"))
    top = top_per_key(rows, ["supplier_id"], order, RECENT_INCIDENTS)
    lines = F.array_sort(F.collect_list(F.struct("_rank", "line")))
    return top.groupBy("supplier_id").agg(
        F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("recent"))


def risk_label(level: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {quoted(v)}" for k, v in RISK_LABELS.items())
    return f"CASE {level} {cases} END"


# Fixed value: the text of a supplier summary; names in braces are slots.
SUMMARY_TEXT = """SUPPLIER PERFORMANCE SUMMARY
Supplier: {name} (ID: {supplier})
Region: {region} | Category: {category}
Total Incidents on Record: {total}

Performance Metrics:
  Average Reliability Score: {reliability}/100
  Average Delivery Delay: {delay} days
  Critical Incidents: {critical}
  High-Severity Incidents: {high}

Recent Incident History:
{recent}

Risk Assessment: {assessment}
"""


def supplier_documents(df: DataFrame, order: list[str]) -> DataFrame:
    # one row per supplier, written first: the shuffles behind the figures are gone when the lines are cut to five
    s = landed(supplier_stats(df, order), "supplier_stats").join(recent_incidents(df, order), "supplier_id", "left")
    text = F.expr(filled(SUMMARY_TEXT, {
        "name": "name",
        "supplier": "supplier_id",
        "region": "region",
        "category": "category",
        "total": "total",
        "reliability": fixed("avg_reliability", 1),
        "delay": fixed("avg_delay", 1),
        "critical": "critical_count",
        "high": "high_count",
        "recent": "coalesce(recent, '')",
        "assessment": risk_label("risk_level"),
    }))
    metadata = {
        "supplier_id": "supplier_id",
        "supplier_name": "name",
        "region": "region",
        "supplier_category": "category",
        "avg_delay_days": exact_round("avg_delay", 2),
        "avg_reliability_score": exact_round("avg_reliability", 2),
        "total_incidents": "total",
        "critical_incidents": "critical_count",
        "high_incidents": "high_count",
        "severity": "risk_level",
    }
    return _chunk(s, "supplier_summary", "concat('supplier_summary_', supplier_id)", text, metadata)


def latest_records(df: DataFrame, order: list[str]) -> DataFrame:
    """The last row of each code and supplier by row order, chosen before any text is built."""
    r = Record(df)
    keyed = df.withColumns({"_code": F.expr(r.code), "_supplier": F.expr(r.supplier)})
    return first_per_key(keyed, ["_code", "_supplier"], [F.col(c).desc() for c in order]).drop("_code", "_supplier")


def documents(df: DataFrame, order: list[str], latest: bool = False, of_suppliers: DataFrame | None = None) -> DataFrame:
    """All chunks of a batch. With ``latest``, rows that share a chunk id leave one record, the last.
    Summaries are made of ``of_suppliers`` if given."""
    records = record_documents(latest_records(df, order) if latest else df)
    return records.unionByName(supplier_documents(df if of_suppliers is None else of_suppliers, order))


def link_incidents(incidents: DataFrame, df: DataFrame, order: list[str], upload: str | None = None) -> DataFrame:
    """Adds the id of the record document; the last row of a code wins, or the last of the first
    ``upload`` that has the code."""
    r = Record(df)
    code, last = F.expr(r.code).alias("incident_code"), F.max_by(F.expr(r.chunk_id), F.struct(*order)).alias("document_id")
    if upload:
        links = df.groupBy(code, upload).agg(last).groupBy("incident_code").agg(F.min_by("document_id", upload).alias("document_id"))
    else:
        links = df.groupBy(code).agg(last)
    return incidents.join(links, "incident_code", "left")
