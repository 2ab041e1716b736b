"""Risk reports computed from the enriched frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.functions import rules

# A mean delay that moved by more than this share counts as a trend.
TREND_SHARE = 0.05
REPORT_ROWS = 2


def _band(score: Column) -> Column:
    return (
        F.when(score >= 75, "critical").when(score >= 50, "high").when(score >= 25, "medium").otherwise("low"))


def _main_issue(delay: Column, defect: Column, cover: Column) -> Column:
    return (
        F.when(delay > 7, "delivery delays")
        .when(defect > 0.05, "defect rate")
        .when(cover < 0.5, "low stock")
        .otherwise("none")
    )


def supplier_scores(df: DataFrame, split: Column) -> DataFrame:
    """One row per supplier: mean score, main issue and delay trend before and after ``split``."""
    recent = F.avg(F.when(F.col("occurred_at") >= split, F.col("delivery_delay_days")))
    prior = F.avg(F.when(F.col("occurred_at") < split, F.col("delivery_delay_days")))
    cover = F.expr(rules.coverage("inventory_level", "demand_forecast"))
    means = df.groupBy("supplier_id").agg(
        F.min("supplier_name").alias("name"),
        F.min("region").alias("region"),
        F.avg("risk_score").alias("score"),
        F.avg("delivery_delay_days").alias("mean_delay"),
        F.avg("defect_rate").alias("mean_defect"),
        F.avg(cover).alias("mean_coverage"),
        F.count("*").alias("records"),
        recent.alias("recent_delay"),
        prior.alias("prior_delay"),
    )
    return means.select(
        "*",
        _main_issue(F.col("mean_delay"), F.col("mean_defect"), F.col("mean_coverage")).alias("primary_issue"),
        trend(F.col("recent_delay"), F.col("prior_delay")).alias("trend"),
    )


def trend(recent: Column, prior: Column) -> Column:
    margin = F.abs(prior) * TREND_SHARE
    return (
        F.when(recent > prior + margin, "degrading").when(recent < prior - margin, "improving")
        .otherwise("stable")
    )


def supplier_report(df: DataFrame, split: Column) -> DataFrame:
    """The two suppliers at highest risk with overall level and trend on every row."""
    scores = supplier_scores(df, split)
    recent = F.avg(F.when(F.col("occurred_at") >= split, F.col("delivery_delay_days")))
    prior = F.avg(F.when(F.col("occurred_at") < split, F.col("delivery_delay_days")))
    whole = df.agg(
        _band(F.avg("risk_score")).alias("risk_level"), trend(recent, prior).alias("trend")
    ).select(F.struct("*")).scalar()
    top = scores.orderBy(F.round("score", 9).desc(), "supplier_id").limit(REPORT_ROWS)
    return top.select(
        "supplier_id", "name", F.round("score", 9).alias("risk_score"), "primary_issue",
        whole["risk_level"].alias("risk_level"), whole["trend"].alias("trend"))


def region_hotspots(df: DataFrame, limit: int = REPORT_ROWS) -> DataFrame:
    return (
        df.groupBy("region")
        .agg(F.round(F.avg("risk_score"), 6).alias("risk_score"), F.count("*").alias("records"))
        .orderBy(F.col("risk_score").desc(), "region")
        .limit(limit)
    )


def shipment_report(df: DataFrame) -> DataFrame:
    """One row: delay probability, expected delay and the extra cost of late shipments."""
    late = F.col("delivery_delay_days") > 0
    cost = F.col("transportation_cost")
    mean, late_mean = F.avg(cost), F.avg(F.when(late, cost))
    return df.agg(
        F.round(F.avg(late.cast("double")), 6).alias("delay_probability"),
        F.round(F.avg(F.greatest(F.col("delivery_delay_days"), F.lit(0.0))), 6).alias("estimated_delay_days"),
        F.round(F.sum(F.when(late, cost)) - mean * F.count_if(late), 2).alias("additional_cost_usd"),
        F.round(F.try_divide(late_mean - mean, mean) * 100, 6).alias("cost_increase_pct"),
    )


def congested(df: DataFrame, by: str, limit: int = REPORT_ROWS) -> DataFrame:
    """Routes or locations with the highest mean delay and how congested they are."""
    delay = F.col("avg_delay_days")
    return (
        df.groupBy(by)
        .agg(
            F.round(F.avg("delivery_delay_days"), 6).alias("avg_delay_days"),
            F.count("*").alias("records"),
        )
        .orderBy(delay.desc(), by)
        .limit(limit)
        .withColumn("level", F.when(delay > 7, "high").when(delay > 3, "medium").otherwise("low"))
    )


def inventory_items(df: DataFrame) -> DataFrame:
    """Items whose stock covers less than half the demand, with urgency."""
    cover = F.expr(rules.coverage("inventory_level", "demand_forecast"))
    items = df.withColumn("coverage_ratio", cover).filter(F.col("coverage_ratio") < 0.5)
    level = F.expr(rules.rule_severity("0D", "inventory_level", "demand_forecast"))
    return items.select(
        F.col("sku").alias("item"),
        "supplier_id",
        F.col("inventory_level").alias("current_inventory"),
        "demand_forecast",
        F.round("coverage_ratio", 6).alias("coverage_ratio"),
        # a month of demand is forecast
        F.round(F.col("coverage_ratio") * 30, 4).alias("days_until_stockout"),
        level.alias("risk_level"),
        F.when(F.col("coverage_ratio") < 0.20, "immediate").otherwise("soon").alias("urgency"),
    )


def inventory_report(df: DataFrame) -> DataFrame:
    """One row: share of items at risk, health and whether demand outgrew stock."""
    cover = F.expr(rules.coverage("inventory_level", "demand_forecast"))
    share = F.avg((cover < 0.5).cast("double"))
    return df.agg(
        F.count_if(cover < 0.5).alias("stockout_items"),
        F.round(share, 6).alias("at_risk_share"),
        (F.sum("demand_forecast") > F.sum("inventory_level")).alias("demand_surge_detected"),
        F.when(share > 0.5, "critical").when(share > 0.25, "at_risk").when(share > 0.1, "adequate")
        .otherwise("healthy").alias("overall_inventory_health"),
    )


# What each of the three ranked actions is labelled with.
ACTION_LABELS = [("REC-001", "P1", "48 hours"), ("REC-002", "P2", "1 week"), ("REC-003", "P3", "2 weeks")]


def mitigation_queue(df: DataFrame, split: Column) -> DataFrame:
    """Exactly three actions, ranked by the score of their cause: the riskiest supplier, the
    most delayed route and the least covered location."""
    supplier = supplier_scores(df, split).orderBy(F.round("score", 9).desc(), "supplier_id").limit(1).select(
        F.lit("supplier").alias("domain"), F.col("supplier_id").alias("target"),
        F.round("score", 9).alias("score"), F.lit("Procurement").alias("responsible_team"))
    route = congested(df, "route", 1).select(
        F.lit("shipment"), "route", F.round(F.least(F.col("avg_delay_days") / 20.0, F.lit(1.0)) * 100, 6),
        F.lit("Logistics"))
    cover = F.expr(rules.coverage("inventory_level", "demand_forecast"))
    place = (
        df.groupBy("warehouse_location")
        .agg(F.round(F.avg((cover < 0.5).cast("double")) * 100, 6).alias("s"))
        .orderBy(F.col("s").desc(), "warehouse_location")
        .limit(1)
        .select(F.lit("inventory"), "warehouse_location", "s", F.lit("Operations"))
    )
    three = supplier.union(route).union(place)
    overall = df.agg(F.round(F.avg("risk_score"), 6)).scalar()
    # three rows, so ranking them as one array costs nothing
    ranked = F.sort_array(
        F.collect_list(F.struct("score", "domain", "target", "responsible_team")), asc=False)
    labels = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(p).alias("priority"), F.lit(t).alias("timeline"))
                       for i, p, t in ACTION_LABELS])
    pairs = three.agg(ranked.alias("r")).select(F.inline(F.arrays_zip(F.col("r"), labels.alias("l"))))
    return pairs.select(
        "l.id", "l.priority", "l.timeline", "r.domain", "r.target", F.col("r.score").alias("score"),
        "r.responsible_team", overall.alias("overall_risk_score"))
