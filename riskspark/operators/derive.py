"""Casts and derived risk features (data-driven severity and score)."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark import schema
from riskspark.functions import rules
from riskspark.functions.columns import iso_time, parse_time, scaled_round, slug, strip, to_double
from riskspark.functions.text import fixed, grouped, num
from riskspark.operators.ordering import number_rows
from riskspark.operators.quantiles import interpolated, order_statistics

# Quantiles behind the thresholds.
TAIL_QUANTILES = {"p50": 0.50, "p75": 0.75, "p90": 0.90}
STOCK_QUANTILES = {"p10": 0.10, "p25": 0.25, "p50": 0.50}


def cast_types(df: DataFrame) -> DataFrame:
    """Numbers by coercion with 0.0 for the rest, texts trimmed with '' for null."""
    out = {}
    for name in schema.FIELDS:
        if name not in df.columns:
            continue
        if schema.FIELD_TYPES[name] == "double":
            out[name] = F.coalesce(to_double(F.col(name)), F.lit(0.0))
        else:
            out[name] = strip(F.coalesce(F.col(name).cast("string"), F.lit("")))
    return df.withColumns(out)


@dataclass
class BatchStats:
    """Whole-batch facts the derivations depend on; a handful of numbers."""

    n: int = 0
    max_defect: float = 0.0
    mean_cost: float = 1.0
    max_inventory: float = 0.0
    blank: dict[str, bool] = field(default_factory=dict)
    zero_delay: bool = False
    thresholds: dict[str, float] = field(default_factory=dict)


# Columns whose absence over the whole batch triggers a derivation.
_BLANKABLE = ["supplier_id", "supplier_name", "shipment_status", "timestamp", "sku"]


def _has(df: DataFrame, name: str) -> bool:
    return name in df.columns


def _number(df: DataFrame, name: str, default: float = 0.0) -> Column:
    return F.coalesce(F.col(name), F.lit(default)) if _has(df, name) else F.lit(default)


def _value(df: DataFrame, name: str, default: float = 0.0) -> str:
    return f"coalesce({name}, {num(default)})" if _has(df, name) else num(default)


def estimated_delay(lead: Column) -> Column:
    return scaled_round(lead - lead * 0.80, 2)


def batch_stats(df: DataFrame, recompute: bool = False) -> BatchStats:
    """One aggregate for the scalars, one narrowing search for the quantiles.

    Thresholds use the delay as delivered; ``recompute`` makes them use the estimated
    delay when the batch has none.
    """
    defect, cost = _number(df, "defect_rate"), _number(df, "transportation_cost")
    delay, stock = _number(df, "delivery_delay_days"), _number(df, "inventory_level", 100.0)
    aggs = [
        F.count("*").alias("n"),
        F.max(defect).alias("max_defect"),
        F.max(cost).alias("max_cost"),
        F.avg(cost).alias("mean_cost"),
        F.max(stock).alias("max_inventory"),
        F.bool_and(delay == 0).alias("zero_delay"),
    ]
    aggs += [F.bool_and(F.col(c) == "").alias(f"blank_{c}") for c in _BLANKABLE if _has(df, c)]
    row = df.agg(*aggs).first()
    if row.n == 0:
        return BatchStats(blank={c: True for c in _BLANKABLE}, zero_delay=True)
    stats = BatchStats(
        n=row.n,
        max_defect=row.max_defect,
        mean_cost=row.mean_cost if row.max_cost > 0 else 1.0,
        max_inventory=row.max_inventory,
        blank={c: row[f"blank_{c}"] if _has(df, c) else True for c in _BLANKABLE},
        zero_delay=row.zero_delay,
    )
    if recompute and stats.zero_delay and _has(df, "lead_time_days"):
        delay = estimated_delay(F.col("lead_time_days"))
    stats.thresholds = thresholds(df, stats, {"delay": delay, "defect": defect, "stock": stock})
    return stats


def thresholds(df: DataFrame, stats: BatchStats, columns: dict[str, Column]) -> dict[str, float]:
    """Linear-interpolated quantiles of delay (early counted as 0), defect rate and stock.

    Clipping and scaling keep the order of values, so they are applied to the order
    statistics rather than to the rows.
    """
    scale = stats.max_defect if stats.max_defect > 1.0 else None
    adjust = {
        "delay": lambda v: max(v, 0.0),
        "defect": lambda v: round(v / scale * 1e6) / 1e6 if scale else v,
        "stock": lambda v: v,
    }
    quantiles = {"delay": TAIL_QUANTILES, "defect": TAIL_QUANTILES, "stock": STOCK_QUANTILES}
    points = {
        (m, q): interpolated(stats.n, p) for m, qs in quantiles.items() for q, p in qs.items()
    }
    ranks = {m: [r for (pm, _), point in points.items() if pm == m for r in point[:2]] for m in quantiles}
    values = order_statistics(df, columns, ranks)
    out = {}
    for (m, q), (low, high, weight) in points.items():
        a, b = adjust[m](values[(m, low)]), adjust[m](values[(m, high)])
        out[f"{m}_{q}"] = a + (b - a) * weight
    return out


def normalised_defect(c: Column, max_defect: float) -> Column:
    return scaled_round(c / max_defect, 6) if max_defect > 1.0 else c


def spread_timestamp(row_seq: Column, n: int, as_of: datetime) -> Column:
    """Row 1 gets ``as_of``; later rows go back evenly to 30 days before."""
    i = row_seq - 1
    days = F.floor(i / max(n - 1, 1) * 30).cast("int")
    hours = (i % 24).cast("int")
    return iso_time(
        F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(days=days, hours=hours)
    )


def needs_row_numbers(stats: BatchStats) -> bool:
    no_names = stats.blank["supplier_id"] and stats.blank["supplier_name"]
    return no_names or stats.blank["timestamp"] or stats.blank["sku"]


def derive_fields(
    df: DataFrame,
    as_of: datetime,
    order: list[Column | str] | None = None,
    recompute: bool = False,
    stats: BatchStats | None = None,
) -> tuple[DataFrame, list[str]]:
    """All derivations in dependency order; returns the frame and the derived field names.

    ``order`` gives the row order and is used only when a batch has no supplier
    identity, no codes or no dates, and does not carry ``row_seq`` already.
    """
    s = stats or batch_stats(df, recompute)
    derived: list[str] = []
    if needs_row_numbers(s) and not _has(df, "row_seq"):
        if not order:
            raise ValueError("this batch needs a row order to derive identifiers or dates")
        df = number_rows(df, order)

    if _has(df, "defect_rate") and s.max_defect > 1.0:
        df = df.withColumn("defect_rate", normalised_defect(F.col("defect_rate"), s.max_defect))
        derived.append(f"defect_rate (normalised from 0–{s.max_defect:.2f} scale)")
    if s.blank["supplier_id"]:
        if s.blank["supplier_name"]:
            code = F.concat(F.lit("SUP-"), _padded(F.col("row_seq"), 4))
        else:
            code = slug(F.col("supplier_name"))
        df = df.withColumn("supplier_id", code)
        derived.append("supplier_id")
    if s.zero_delay and _has(df, "lead_time_days"):
        df = df.withColumn("delivery_delay_days", estimated_delay(F.col("lead_time_days")))
        derived.append("delivery_delay_days")
    delay, stock = _value(df, "delivery_delay_days"), _value(df, "inventory_level", 100.0)
    defect, cost = _value(df, "defect_rate"), _value(df, "transportation_cost")
    added = {"severity": F.lit("low"), "risk_score": F.lit(0.0)}
    if s.n:
        added = {
            "severity": F.expr(rules.percentile_severity(delay, defect, stock, s.thresholds)),
            "risk_score": F.expr(
                rules.relative_risk(delay, defect, stock, cost, s.thresholds, s.mean_cost, s.max_inventory)),
        }
    if s.blank["shipment_status"]:
        status = rules.shipment_status(delay) if _has(df, "delivery_delay_days") else "'On-Time'"
        added["shipment_status"] = F.expr(status)
        derived.append("shipment_status")
    df = df.withColumns(added)
    derived += ["severity", "risk_score"]
    if s.blank["timestamp"]:
        df = df.withColumn("timestamp", spread_timestamp(F.col("row_seq"), s.n, as_of))
        derived.append("timestamp")
    else:
        parsed = iso_time(parse_time(F.col("timestamp")))
        fallback = iso_time(F.lit(as_of).cast("timestamp_ntz"))
        df = df.withColumn("timestamp", F.coalesce(parsed, fallback))
    if s.blank["sku"]:
        df = df.withColumn("sku", F.concat(F.lit("INC-ETL-"), _padded(F.col("row_seq"), 5)))
        derived.append("sku")
    return df, derived


def _padded(number: Column, width: int) -> Column:
    text = number.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def distributions(df: DataFrame) -> DataFrame:
    """Counts per severity and per shipment status, both in one pass."""
    pairs = [
        F.struct(F.lit(c).alias("field"), F.col(c).alias("value"))
        for c in ("severity", "shipment_status")
        if _has(df, c)
    ]
    return df.select(F.inline(F.array(*pairs))).groupBy("field", "value").agg(F.count("*").alias("n"))


def field_audit(df: DataFrame) -> DataFrame:
    """One row per canonical field: is it empty in every row?"""
    flags = []
    for name in schema.FIELDS:
        if not _has(df, name):
            flags.append(F.lit(True).alias(name))
        elif schema.FIELD_TYPES[name] == "string":
            flags.append(F.bool_and(F.coalesce(F.col(name), F.lit("")) == "").alias(name))
        else:
            flags.append(F.bool_and(F.col(name).isNull()).alias(name))
    one = df.agg(*flags)
    return one.unpivot([], schema.FIELDS, "field", "is_empty").select(
        "field", F.coalesce("is_empty", F.lit(True)).alias("is_empty"))


# --- pipeline format -------------------------------------------------------------


class _Texts:
    """The values a pipeline row is described with, computed once per row in ``frame``.

    The attributes are SQL texts: names of helper columns of ``frame``.
    """

    HELPERS = ["_defect", "_stock", "_delay", "_lead", "_cost", "_demand", "_bad", "_cover"]

    def __init__(self, df: DataFrame):
        self.df = df
        self.defect, self.stock, self.delay, self.lead, self.cost, self.demand, self.bad, self.cover = self.HELPERS
        failed = f"contains(lower({self.text('InspectionStatus')}), 'fail')"
        values = {
            "_defect": _value(df, "DefectRate"),
            "_stock": _value(df, "InventoryLevel"),
            "_delay": _value(df, "DeliveryDelayDays"),
            "_lead": _value(df, "LeadTimeDays"),
            "_cost": _value(df, "TransportationCost"),
            # a demand of 0 counts as 1 in the texts and triggers
            "_demand": f"coalesce(nullif({_value(df, 'DemandForecast')}, 0D), 1D)",
            "_bad": f"({_value(df, 'DefectRate')} > 0.05D OR {failed})",
        }
        staged = df.selectExpr("*", *[f"{e} AS {n}" for n, e in values.items()])
        self.frame = staged.selectExpr("*", f"{rules.coverage('_stock', '_demand')} AS _cover")

    def text(self, name: str) -> str:
        return f"coalesce(CAST({name} AS STRING), '')" if _has(self.df, name) else "''"


def primary_reason(t: _Texts) -> str:
    return f"""CASE
      WHEN {t.bad} THEN concat('Defect rate ', {fixed(f'{t.defect} * 100', 1)}, '% critical')
      WHEN {t.cover} < 0.3D THEN concat('Stock level ', {fixed(t.stock, 0)}, ' units, stockout imminent')
      WHEN {t.delay} > 7 THEN concat('Delivery delay ', {fixed(t.delay, 0)}, ' days, critical')
      WHEN {t.lead} > 20 THEN concat('Lead time ', {fixed(t.lead, 0)}, ' days, severe delay')
      WHEN {t.delay} > 3 THEN concat('Delivery delay ', {fixed(t.delay, 0)}, ' days')
      WHEN {t.cover} < 0.5D THEN concat('Low stock ', {fixed(t.stock, 0)}, '/', {fixed(t.demand, 0)}, ' units')
      ELSE 'Supply chain risk detected' END"""


def title(t: _Texts) -> Column:
    code = "coalesce(IncidentCode, 'SKU?')" if _has(t.df, "IncidentCode") else "'SKU?'"
    who = f"coalesce(nullif({t.text('SupplierName')}, ''), nullif({t.text('SupplierID')}, ''), 'Unknown')"
    place = t.text("WarehouseLocation")
    where = f"CASE WHEN {place} IN ('', 'N/A') THEN '' ELSE concat(', ', {place}) END"
    return F.expr(f"concat({code}, ': ', {primary_reason(t)}, ' — ', {who}, {where})")


def description(t: _Texts) -> Column:
    ratio = f"{t.stock} / {t.demand}"
    return F.expr(f"""coalesce(nullif(concat_ws(' ',
      CASE WHEN {t.defect} > 0 THEN concat('Defect rate: ', {fixed(f'{t.defect} * 100', 2)}, '%.') END,
      CASE WHEN {t.demand} > 0 THEN concat('Stock: ', {fixed(t.stock, 0)}, ' units vs ', {fixed(t.demand, 0)},
        ' forecast (ratio: ', {fixed(ratio, 2)}, ').') END,
      CASE WHEN {t.delay} < 0 THEN concat('Early delivery: ', {fixed(f'abs({t.delay})', 1)}, ' days ahead.')
        WHEN {t.delay} > 0 THEN concat('Delay: ', {fixed(t.delay, 1)}, ' days.') END,
      CASE WHEN {t.lead} > 0 THEN concat('Lead time: ', {fixed(t.lead, 0)}, ' days.') END,
      CASE WHEN {t.cost} > 0 THEN concat('Transport cost: $', {grouped(t.cost, 0)}, '.') END), ''),
      'Automated ETL record.')""")


def incident_category(t: _Texts) -> Column:
    """The trigger that fired; two or more make it a supplier incident."""
    low, late = f"({t.cover} < 0.5D)", f"({t.delay} > 5)"
    return F.expr(f"""CASE
      WHEN {t.bad} OR ({low} AND {late}) THEN 'supplier'
      WHEN {low} THEN 'inventory' WHEN {late} THEN 'shipment' ELSE 'supplier' END""")


def to_pipeline(df: DataFrame) -> DataFrame:
    """Pipeline column names, texts, category and defaults."""
    out = df.withColumnsRenamed({c: p for c, p in schema.PIPELINE_NAMES.items() if _has(df, c)})
    t = _Texts(out)
    added = {"IncidentCategory": incident_category(t)}
    if not _has(out, "Title"):
        added["Title"] = title(t)
    if not _has(out, "Description"):
        added["Description"] = description(t)
    if not _has(out, "ResolutionStatus"):
        added["ResolutionStatus"] = F.lit("open")
    if not _has(out, "Region"):
        added["Region"] = F.lit("")
    return t.frame.withColumns(added).drop(*t.HELPERS)
