"""Listings, paging and KPIs over incidents, suppliers and sessions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.functions.columns import contains_text
from riskspark.operators.incidents import OPEN
from riskspark.operators.ordering import top_per_key


def _and(df: DataFrame, conditions: list[Column]) -> DataFrame:
    for c in conditions:
        df = df.filter(c)
    return df


def is_open() -> Column:
    return F.col("resolution_status").isin(*OPEN)


def day_start(as_of: datetime) -> Column:
    return F.date_trunc("day", F.lit(as_of)).cast("timestamp_ntz")


def at(as_of: datetime) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def filter_incidents(
    df: DataFrame, severity: str | None = None, category: str | None = None, supplier_ref: str | None = None,
    warehouse: str | None = None, resolution: str | None = None, search: str | None = None,
) -> DataFrame:
    """Incidents that meet all conditions given. The search comes last: its hit is made as a generated
    column, since a plain condition on texts is moved below the step that makes them, where every mention
    of a text makes it anew."""
    conditions = []
    if severity:
        conditions.append(F.col("severity") == severity)
    if category:
        conditions.append(F.col("category") == category)
    if supplier_ref:
        conditions.append(F.col("supplier_ref") == supplier_ref)
    if warehouse:
        conditions.append(contains_text(F.col("warehouse_location"), warehouse))
    if resolution:
        conditions.append(F.col("resolution_status") == resolution)
    found = _and(df, conditions)
    if search:
        hit = contains_text(F.col("title"), search) | contains_text(F.col("description"), search)
        found = found.select("*", F.explode(F.array(hit)).alias("_hit")).filter("_hit").drop("_hit")
    return found


def page(df: DataFrame, order: list[Column], skip: int = 0, limit: int = 50) -> DataFrame:
    """One page in the given order; ``total`` counts the rows before paging."""
    total = df.agg(F.count("*")).scalar()
    paged = df.orderBy(*order)
    if skip:
        paged = paged.offset(skip)
    return paged.limit(limit).withColumn("total", total)


def newest_first(key: str) -> list[Column]:
    return [F.col("occurred_at").desc_nulls_last(), F.col(key)]


def incident_stats(df: DataFrame) -> DataFrame:
    """Counts per severity; the totals repeat on every row."""
    by = df.groupBy("severity").agg(F.count("*").alias("n"), F.count_if(is_open()).alias("n_open"))
    # one row per severity at this point
    sums = by.agg(F.sum("n").alias("total"), F.sum("n_open").alias("open")).select(F.struct("*")).scalar()
    return by.select("severity", "n", sums["total"].alias("total"), sums["open"].alias("open"))


def find_incident(df: DataFrame, ident: str) -> DataFrame:
    return df.filter((F.col("id") == ident) | (F.col("incident_code") == ident))


def filter_suppliers(
    df: DataFrame, risk_level: str | None = None, region: str | None = None, category: str | None = None,
    search: str | None = None,
) -> DataFrame:
    conditions = []
    if risk_level:
        conditions.append(F.col("risk_level") == risk_level)
    if region:
        conditions.append(contains_text(F.col("region"), region))
    if category:
        conditions.append(contains_text(F.col("category"), category))
    if search:
        conditions.append(contains_text(F.col("name"), search) | contains_text(F.col("supplier_id"), search))
    return _and(df, conditions)


def least_reliable_first() -> list[Column]:
    return [F.col("reliability_score").asc_nulls_first(), F.col("supplier_id")]


def supplier_risk_summary(df: DataFrame) -> DataFrame:
    by = df.groupBy("risk_level").agg(
        F.count("*").alias("n"), F.sum("reliability_score").alias("s"), F.count("reliability_score").alias("c"))
    sums = by.agg(
        F.sum("n").alias("total_suppliers"),
        F.coalesce(F.try_divide(F.sum("s"), F.sum("c")), F.lit(0.0)).alias("mean"),
    ).select(F.struct("*")).scalar()
    return by.select(
        "risk_level", "n", sums["total_suppliers"].alias("total_suppliers"),
        F.round(sums["mean"], 2).alias("avg_reliability_score"))


_HISTORY = [
    "occurred_at", "delivery_delay_days", "transportation_cost", "inventory_level", "severity", "shipment_status"]


def supplier_history(suppliers: DataFrame, incidents: DataFrame, supplier: str, limit: int = 30) -> DataFrame:
    """Incidents of one supplier, given by id or code, oldest first."""
    one = suppliers.filter((F.col("id") == supplier) | (F.col("supplier_id") == supplier)).select(
        F.col("id").alias("supplier_id"))
    rows = incidents.join(one, "supplier_id", "left_semi")
    return rows.orderBy(F.col("occurred_at").asc_nulls_first(), "incident_code").limit(limit).select(
        "incident_code", *_HISTORY)


def all_histories(suppliers: DataFrame, incidents: DataFrame, limit: int = 30) -> DataFrame:
    """The oldest incidents of every supplier, numbered from 1."""
    known = suppliers.select(F.col("id").alias("supplier_id"))
    rows = incidents.select("supplier_id", "supplier_ref", "incident_code", *_HISTORY)
    top = top_per_key(
        rows, ["supplier_id"], [F.col("occurred_at").asc_nulls_first(), "incident_code"], limit, rank="position")
    return top.join(known, "supplier_id", "left_semi")


def supplier_details(suppliers: DataFrame, incidents: DataFrame, limit: int = 10) -> DataFrame:
    """Every supplier with its newest incidents nested, newest first."""
    fields = [
        "incident_code", "title", "severity", "delivery_delay_days", "occurred_at", "resolution_status"]
    rows = incidents.select(F.col("supplier_id").alias("id"), *fields)
    top = top_per_key(rows, ["id"], newest_first("incident_code"), limit)
    nested = top.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("_rank", *fields))).alias("r"))
    empty = F.array().cast(nested.schema["r"].dataType)
    recent = F.transform(F.coalesce("r", empty), lambda x: x.dropFields("_rank"))
    return suppliers.join(nested, "id", "left").select(*suppliers.columns, recent.alias("recent_incidents"))


def open_by_severity(df: DataFrame) -> DataFrame:
    return df.filter(is_open()).groupBy("severity").agg(F.count("*").alias("n"))


def incident_kpis(df: DataFrame) -> DataFrame:
    """All single-figure KPIs of the incident table in one pass."""
    on_time = F.col("shipment_status").isin("On-Time", "Early")
    impact = F.avg(F.when(F.col("resolution_status") == "open", F.col("impact_score")))
    return df.agg(
        F.count("*").alias("total_incidents"),
        F.count_if(is_open()).alias("open_incidents"),
        F.round(F.least(F.greatest(F.coalesce(impact, F.lit(50.0)), F.lit(0.0)), F.lit(100.0)), 1)
        .alias("overall_risk_score"),
        F.count("shipment_status").alias("shipments"),
        F.round(F.count_if(on_time) / F.greatest(F.count("shipment_status"), F.lit(1)) * 100, 1)
        .alias("on_time_rate"),
    )


def supplier_kpis(df: DataFrame) -> DataFrame:
    healthy = F.count_if(F.col("risk_level").isin("low", "medium"))
    return df.agg(
        F.count("*").alias("total_suppliers"),
        F.round(healthy / F.greatest(F.count("*"), F.lit(1)) * 100, 1).alias("pct_healthy"),
        F.round(F.coalesce(F.avg("reliability_score"), F.lit(0.0)), 1).alias("avg_reliability_score"),
    )


def status_distribution(df: DataFrame) -> DataFrame:
    known = F.col("shipment_status").isNotNull() & (F.col("shipment_status") != "")
    return df.filter(known).groupBy("shipment_status").agg(F.count("*").alias("n"))


def sessions_today(df: DataFrame, as_of: datetime) -> DataFrame:
    return df.filter(F.col("created_at") >= day_start(as_of)).agg(
        F.count("*").alias("today"), F.round(F.avg("evaluation_score"), 2).alias("avg_quality_score"))


def snippet(c: Column, size: int = 80, mark: str = "...") -> Column:
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, size), F.lit(mark))).otherwise(c)


def newest_sessions() -> list[Column]:
    return [F.col("created_at").desc_nulls_last(), F.col("session_id")]


def recent_sessions(df: DataFrame, limit: int = 5) -> DataFrame:
    return df.orderBy(*newest_sessions()).limit(limit).select(
        "session_id", snippet(F.col("query_text")).alias("query_text"),
        F.col("evaluation_score").alias("risk_score"), "tokens_used", "latency_ms", "created_at")


def alert_condition() -> Column:
    return is_open() & F.col("severity").isin("critical", "high", "medium")


ALERT_COLUMNS = [
    "id", "incident_code", "title", "severity", "category", "supplier_ref", "warehouse_location",
    "shipment_status", "delivery_delay_days", "impact_score", "occurred_at", "resolution_status"]


def alerts(df: DataFrame, limit: int = 20) -> DataFrame:
    rows = df.filter(alert_condition()).orderBy(*newest_first("incident_code")).limit(limit)
    return rows.select(*ALERT_COLUMNS)
