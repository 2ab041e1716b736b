"""Business rules as SQL expressions.

Arguments and results are SQL text, so a rule is one parsed expression however many
branches it has; use them through ``F.expr``.
"""

from __future__ import annotations

from riskspark.functions.text import exact_round, num


def shipment_status(delay: str) -> str:
    return (
        f"CASE WHEN {delay} < 0 THEN 'Early' WHEN {delay} = 0 THEN 'On-Time' "
        f"WHEN {delay} <= 3 THEN 'In-Transit' WHEN {delay} <= 7 THEN 'Delayed' ELSE 'Critical' END"
    )


def coverage(stock: str, demand: str) -> str:
    return f"(CASE WHEN {demand} > 0 THEN {stock} / {demand} ELSE 1D END)"


def _levels(critical: str, high: str, medium: str) -> str:
    return f"CASE WHEN {critical} THEN 'critical' WHEN {high} THEN 'high' WHEN {medium} THEN 'medium' ELSE 'low' END"


def rule_severity(delay: str, stock: str, demand: str) -> str:
    cover = coverage(stock, demand)
    return _levels(
        f"{delay} > 14 OR {cover} < 0.20D", f"{delay} > 7 OR {cover} < 0.50D", f"{delay} > 3 OR {cover} < 0.70D")


def percentile_severity(delay: str, defect: str, stock: str, t: dict[str, float]) -> str:
    """Severity against the distribution of the batch; early deliveries are always low."""

    def beyond(upper: str, lower: str) -> str:
        return (
            f"{delay} > {num(t[f'delay_{upper}'])} OR {defect} > {num(t[f'defect_{upper}'])} "
            f"OR {stock} < {num(t[f'stock_{lower}'])}"
        )

    levels = _levels(beyond("p90", "p10"), beyond("p75", "p25"), beyond("p50", "p50"))
    return f"CASE WHEN {delay} < 0 THEN 'low' ELSE {levels} END"


def _weighted(delay: str, stock: str, defect: str, cost: str) -> str:
    return exact_round(f"({delay} * 0.35D + {stock} * 0.25D + {defect} * 0.20D + {cost} * 0.20D) * 100", 2)


def _cost_part(cost: str, mean_cost: float) -> str:
    ratio = f"{cost} / {num(mean_cost)}" if mean_cost > 0 else "1D"
    return f"least(greatest({ratio} - 1D, 0D) / 2D, 1D)"


def relative_risk(
    delay: str, defect: str, stock: str, cost: str, t: dict[str, float], mean_cost: float, max_stock: float
) -> str:
    """Score 0-100 relative to the batch: delay, stock, defects, cost."""
    top_delay, top_defect = max(t["delay_p90"] * 1.5, 1.0), max(t["defect_p90"] * 1.5, 0.001)
    return _weighted(
        f"greatest(0D, least({delay} / {num(top_delay)}, 1D))",
        f"(1D - least({stock} / {num(max(max_stock, 1.0))}, 1D))",
        f"least({defect} / {num(top_defect)}, 1D)",
        _cost_part(cost, mean_cost),
    )


def static_status(delay: str) -> str:
    return (
        f"CASE WHEN {delay} > 14 THEN 'Critical' WHEN {delay} > 7 THEN 'Delayed' "
        f"WHEN {delay} > 0 THEN 'In-Transit' ELSE 'On-Time' END"
    )


def static_severity(delay: str, stock: str, demand: str, defect: str) -> str:
    cover = coverage(stock, demand)
    return _levels(
        f"{defect} > 0.10D OR {delay} > 14 OR {cover} < 0.20D",
        f"{defect} > 0.05D OR {delay} > 7 OR {cover} < 0.50D",
        f"{defect} > 0.02D OR {delay} > 3 OR {cover} < 0.70D",
    )


def static_risk(delay: str, stock: str, demand: str, defect: str, cost: str, mean_cost: float) -> str:
    return _weighted(
        f"least({delay} / 20D, 1D)", f"greatest(0D, 1D - {coverage(stock, demand)})",
        f"least({defect} / 0.15D, 1D)", _cost_part(cost, mean_cost))


def supplier_risk(critical: str, high: str, mean_delay: str) -> str:
    return _levels(f"{critical} >= 3", f"{high} >= 3 OR {mean_delay} > 10", f"{mean_delay} > 3")

