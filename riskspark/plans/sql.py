"""Building blocks of the check SQL: common table expressions and their dependencies."""

from __future__ import annotations

import re

AS_OF = "TIMESTAMP '2024-01-04 12:00:00'"
TODAY = "TIMESTAMP '2024-01-04 00:00:00'"
SPLIT = "TIMESTAMP '1995-07-01 00:00:00'"

BLOCKS: dict[str, str] = {}


def oracle(body: str) -> str:
    """The body with a WITH clause for every block it uses."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in BLOCKS:
            if name not in order and re.search(rf"\b(?:FROM|JOIN|,)\s+{name}\b", text):
                visit(BLOCKS[name])
                order.append(name)

    visit(body)
    body = body.strip()
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS (\n{BLOCKS[n].strip()}\n)" for n in order)
    if body.startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def coverage(stock: str, demand: str) -> str:
    return f"(CASE WHEN {demand} > 0 THEN {stock} / {demand} ELSE 1.0 END)"


def rule_severity(delay: str, stock: str, demand: str) -> str:
    c = coverage(stock, demand)
    return (
        f"(CASE WHEN {delay} > 14 OR {c} < 0.20 THEN 'critical' WHEN {delay} > 7 OR {c} < 0.50 THEN 'high' "
        f"WHEN {delay} > 3 OR {c} < 0.70 THEN 'medium' ELSE 'low' END)"
    )


def status(delay: str) -> str:
    return (
        f"(CASE WHEN {delay} < 0 THEN 'Early' WHEN {delay} = 0 THEN 'On-Time' WHEN {delay} <= 3 THEN 'In-Transit' "
        f"WHEN {delay} <= 7 THEN 'Delayed' ELSE 'Critical' END)"
    )


SEVERITY = """(CASE WHEN delivery_delay_days < 0 THEN 'low'
  WHEN delivery_delay_days > d90 OR defect_rate > f90 OR inventory_level < s10 THEN 'critical'
  WHEN delivery_delay_days > d75 OR defect_rate > f75 OR inventory_level < s25 THEN 'high'
  WHEN delivery_delay_days > d50 OR defect_rate > f50 OR inventory_level < s50 THEN 'medium' ELSE 'low' END)"""

RISK = """CAST(printf('%.2f', (
  greatest(0.0, least(delivery_delay_days / greatest(d90 * 1.5, 1.0), 1.0)) * 0.35
  + (1.0 - least(inventory_level / greatest(max_stock, 1.0), 1.0)) * 0.25
  + least(defect_rate / greatest(f90 * 1.5, 0.001), 1.0) * 0.20
  + least(greatest(transportation_cost / mean_cost - 1.0, 0.0) / 2.0, 1.0) * 0.20) * 100) AS DOUBLE)"""

STATS = """SELECT count(*) AS n, max(defect_rate) AS max_defect, avg(transportation_cost) AS mean_cost,
  max(inventory_level) AS max_stock,
  quantile_cont(greatest(delivery_delay_days, 0.0), 0.50) AS d50,
  quantile_cont(greatest(delivery_delay_days, 0.0), 0.75) AS d75,
  quantile_cont(greatest(delivery_delay_days, 0.0), 0.90) AS d90,
  quantile_cont(defect_rate, 0.50) AS f50, quantile_cont(defect_rate, 0.75) AS f75,
  quantile_cont(defect_rate, 0.90) AS f90,
  quantile_cont(inventory_level, 0.10) AS s10, quantile_cont(inventory_level, 0.25) AS s25,
  quantile_cont(inventory_level, 0.50) AS s50 FROM """

BLOCKS["canonical"] = """
SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice,
         l_quantity) AS row_seq,
  l_orderkey, l_linenumber, l_partkey, l_suppkey,
  printf('SUP-%04d', l_suppkey) AS supplier_id, s_name AS supplier_name, r_name AS region,
  p_type AS product_type,
  'INC-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS sku,
  l_quantity * 10.0 AS inventory_level, l_quantity AS order_quantity, CAST(p_size * 10 AS DOUBLE) AS demand_forecast,
  CAST(l_partkey % 30 + 1 AS DOUBLE) AS lead_time_days,
  CAST((l_orderkey * 7 + l_partkey) % 25 - 3 AS DOUBLE) AS delivery_delay_days,
  '' AS shipping_carrier, '' AS transportation_mode, 'R-' || n_name AS route, n_name AS warehouse_location,
  l_extendedprice * l_tax AS transportation_cost, p_retailprice AS manufacturing_cost, l_extendedprice AS revenue,
  l_discount AS defect_rate,
  CASE l_returnflag WHEN 'R' THEN 'Fail' WHEN 'A' THEN 'Pass' ELSE 'Pending' END AS inspection_status,
  CAST(0.0 AS DOUBLE) AS production_volume, strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') AS ts_text,
  CAST(s_suppkey * 37 % 101 AS DOUBLE) AS reliability_score,
  CASE WHEN o_orderstatus = 'O' THEN 'open' WHEN o_orderstatus = 'P' THEN 'in_progress'
       WHEN l_linestatus = 'F' THEN 'closed' ELSE 'resolved' END AS resolution_status,
  l_shipdate AS occurred_at, l_linestatus
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey"""

BLOCKS["stats"] = STATS + "canonical"

BLOCKS["enriched"] = f"""
SELECT c.*, {status('delivery_delay_days')} AS shipment_status, {SEVERITY} AS severity, {RISK} AS risk_score
FROM canonical c, stats"""

# Faults and anomalies, as the fixture variants make them.


def every(n: int, salt: int = 1) -> str:
    return f"((l_orderkey * 3 + l_linenumber * 5 + l_partkey * {salt}) % {n} = 0)"


BLOCKS["odd"] = f"""
SELECT * REPLACE (
  CASE WHEN {every(101)} THEN 1.0 ELSE inventory_level END AS inventory_level,
  transportation_cost * CASE WHEN {every(103, 2)} THEN 10.0 ELSE 1.0 END AS transportation_cost,
  defect_rate * CASE WHEN supplier_id = 'SUP-0003' THEN 5.0 ELSE 1.0 END AS defect_rate,
  CASE WHEN row_seq > (SELECT max(row_seq) - 10 FROM canonical) THEN l_orderkey / 1000.0
       ELSE delivery_delay_days END AS delivery_delay_days)
FROM canonical"""

BLOCKS["faulty"] = f"""
SELECT * REPLACE (
  CASE WHEN {every(97)} THEN '' ELSE supplier_id END AS supplier_id,
  CASE WHEN {every(97)} THEN '' ELSE supplier_name END AS supplier_name,
  CASE WHEN {every(89, 2)} THEN -0.1 WHEN {every(83, 3)} THEN 1.5 ELSE defect_rate END AS defect_rate,
  CASE WHEN {every(79, 4)} THEN 'Odd' ELSE inspection_status END AS inspection_status),
  CASE WHEN {every(73, 5)} THEN 'Extreme' ELSE 'low' END AS severity
FROM canonical"""

BLOCKS["checked"] = """
SELECT *, (supplier_id = '' AND supplier_name = '') AS no_identity,
  concat_ws('; ',
    CASE WHEN delivery_delay_days < 0 THEN 'delivery_delay_days=' || printf('%.1f', delivery_delay_days)
      || ' (early delivery — kept as LOW risk)' END,
    CASE WHEN defect_rate < 0 THEN 'defect_rate is negative (' || defect_rate || ') — clamped to 0.'
         WHEN defect_rate > 1 THEN 'defect_rate still > 1 (' || printf('%.3f', defect_rate)
           || ') after normalisation — clamped to 1.' END,
    CASE WHEN severity = 'Extreme' THEN 'Unrecognised severity ''extreme'' — defaulting to ''medium''.' END,
    CASE WHEN inspection_status = 'Odd' THEN 'Unusual inspection_status ''Odd''.' END) AS warnings,
  CASE WHEN supplier_id = '' AND supplier_name = ''
    THEN 'Both supplier_id and supplier_name are empty — cannot identify supplier.' ELSE '' END AS errors
FROM faulty"""

_D, _F, _I, _M = "delivery_delay_days", "defect_rate", "inventory_level", "demand"
BLOCKS["texts"] = f"""
SELECT *, CASE WHEN demand_forecast = 0 THEN 1.0 ELSE demand_forecast END AS demand,
  (defect_rate > 0.05 OR contains(lower(inspection_status), 'fail')) AS bad
FROM enriched"""

BLOCKS["formatted"] = f"""
SELECT *,
  CASE WHEN (bad::INT + ({coverage(_I, _M)} < 0.5)::INT + ({_D} > 5)::INT) >= 2 OR bad THEN 'supplier'
       WHEN {coverage(_I, _M)} < 0.5 THEN 'inventory' WHEN {_D} > 5 THEN 'shipment' ELSE 'supplier' END AS category,
  sku || ': ' || CASE
    WHEN bad THEN 'Defect rate ' || printf('%.1f', {_F} * 100) || '% critical'
    WHEN {coverage(_I, _M)} < 0.3 THEN 'Stock level ' || printf('%.0f', {_I}) || ' units, stockout imminent'
    WHEN {_D} > 7 THEN 'Delivery delay ' || printf('%.0f', {_D}) || ' days, critical'
    WHEN lead_time_days > 20 THEN 'Lead time ' || printf('%.0f', lead_time_days) || ' days, severe delay'
    WHEN {_D} > 3 THEN 'Delivery delay ' || printf('%.0f', {_D}) || ' days'
    WHEN {coverage(_I, _M)} < 0.5 THEN 'Low stock ' || printf('%.0f', {_I}) || '/' || printf('%.0f', {_M}) || ' units'
    ELSE 'Supply chain risk detected' END
    || ' — ' || supplier_name || ', ' || warehouse_location AS title,
  concat_ws(' ',
    CASE WHEN {_F} > 0 THEN 'Defect rate: ' || printf('%.2f', {_F} * 100) || '%.' END,
    CASE WHEN {_M} > 0 THEN 'Stock: ' || printf('%.0f', {_I}) || ' units vs ' || printf('%.0f', {_M})
      || ' forecast (ratio: ' || printf('%.2f', {_I} / {_M}) || ').' END,
    CASE WHEN {_D} < 0 THEN 'Early delivery: ' || printf('%.1f', abs({_D})) || ' days ahead.'
         WHEN {_D} > 0 THEN 'Delay: ' || printf('%.1f', {_D}) || ' days.' END,
    CASE WHEN lead_time_days > 0 THEN 'Lead time: ' || printf('%.0f', lead_time_days) || ' days.' END,
    CASE WHEN transportation_cost > 0 THEN 'Transport cost: $' || format('{{:,.0f}}', transportation_cost) || '.' END
  ) AS description,
  {rule_severity(_D, _I, 'demand_forecast')} AS rule_severity,
  {coverage(_I, 'demand_forecast')} AS cover
FROM texts"""

BLOCKS["incidents"] = """
SELECT sha256(sku) AS id, sku AS incident_code, title, description, rule_severity AS severity, category,
  sha256(supplier_id) AS supplier_id, supplier_id AS supplier_ref, warehouse_location, shipment_status,
  round(delivery_delay_days, 2) AS delivery_delay_days,
  CAST(printf('%.2f', transportation_cost) AS DOUBLE) AS transportation_cost,
  inventory_level, demand_forecast, risk_score AS impact_score, resolution_status, occurred_at, row_seq, l_linestatus
FROM formatted QUALIFY row_number() OVER (PARTITION BY sku ORDER BY row_seq) = 1"""

SUPPLIER_AGG = """
SELECT supplier_id, arg_min(supplier_name, row_seq) AS name, arg_min(region, row_seq) AS region,
  arg_min(product_type, row_seq) AS category, avg(delivery_delay_days) AS avg_delay,
  avg(reliability_score) AS avg_reliability, count(*) FILTER (rule_severity = 'critical') AS critical_count,
  count(*) FILTER (rule_severity = 'high') AS high_count, count(*) AS total FROM formatted"""

RISK_LEVEL = """CASE WHEN critical_count >= 3 THEN 'critical' WHEN high_count >= 3 OR avg_delay > 10 THEN 'high'
  WHEN avg_delay > 3 THEN 'medium' ELSE 'low' END"""

BLOCKS["supplier_stats"] = f"""
SELECT *, {RISK_LEVEL} AS risk_level FROM ({SUPPLIER_AGG} GROUP BY supplier_id)"""

BLOCKS["suppliers"] = """
SELECT sha256(supplier_id) AS id, supplier_id, name, region, category, CAST(printf('%.2f', avg_reliability) AS DOUBLE) AS reliability_score,
  CAST(printf('%.2f', avg_delay) AS DOUBLE) AS avg_delay_days, total AS active_orders, risk_level FROM supplier_stats"""

# --- uploads


def _headers(names: list[str]) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


def written(h: str, style: str) -> str:
    return (
        f"CASE {style} WHEN 1 THEN upper({h}) WHEN 2 THEN replace({h}, ' ', '_') "
        f"WHEN 3 THEN replace({h}, ' ', '') ELSE {h} END"
    )


NORM = "regexp_replace(regexp_replace(lower({0}), '^\\s+|\\s+$', '', 'g'), '[\\s_\\-]+', ' ', 'g')"


def define_uploads(upload_headers: list[str], value_headers: list[str], aliases: list[tuple[str, str]]) -> None:
    BLOCKS["headers"] = f"""
SELECT upload_id, position,
  CASE WHEN upload_id % 5 = 4 AND position % 2 = 0 THEN substr(w, 2) ELSE w END AS header
FROM (SELECT upload_id, position, {written('h', '(upload_id % 4)')} AS w
  FROM (SELECT s_suppkey AS upload_id, unnest(range({len(upload_headers)})) AS position,
          unnest({_headers(upload_headers)}) AS h FROM supplier))"""
    BLOCKS["aliases"] = "SELECT * FROM (VALUES " + ", ".join(
        f"({i}, '{a}', '{f}')" for i, (a, f) in enumerate(aliases)) + ") t(alias_no, norm, field)"
    BLOCKS["norm_headers"] = f"SELECT *, {NORM.format('header')} AS norm FROM headers"
    BLOCKS["exact_headers"] = """
SELECT h.upload_id, h.position, h.header, h.norm, a.field AS exact
FROM norm_headers h LEFT JOIN aliases a ON h.norm = a.norm"""
    # common subsequence by dynamic programming: one row of the table for each character of the header
    BLOCKS["fuzzy_headers"] = f"""
WITH RECURSIVE pairs AS (
  SELECT norm, alias_no, alias, field FROM (
    SELECT DISTINCT norm FROM norm_headers UNION SELECT DISTINCT {NORM.format('header')} FROM value_headers)
  CROSS JOIN (SELECT alias_no, norm AS alias, field FROM aliases)),
steps(norm, alias_no, alias, i, best) AS (
  SELECT norm, alias_no, alias, 0, list_transform(range(length(alias) + 1), lambda j: 0) FROM pairs
  UNION ALL
  SELECT norm, alias_no, alias, i + 1, list_transform(range(1, length(alias) + 2), lambda j: list_max(grown[1:j]))
  FROM (SELECT *, list_transform(range(1, length(alias) + 2), lambda j:
          CASE WHEN j > 1 AND alias[j - 1] = norm[i + 1] THEN best[j - 1] + 1 ELSE best[j] END) AS grown
        FROM steps WHERE i < length(norm)))
SELECT norm, field AS fuzzy, score AS fuzzy_score FROM (
  SELECT norm, field, alias_no,
    2.0::DOUBLE * best[length(alias) + 1]::DOUBLE / (length(norm) + length(alias))::DOUBLE AS score
  FROM steps JOIN pairs USING (norm, alias_no, alias) WHERE i = length(norm))
WHERE score >= 0.6 QUALIFY row_number() OVER (PARTITION BY norm ORDER BY score DESC, alias_no) = 1"""
    BLOCKS["cells"] = f"""
SELECT l_suppkey AS upload_id, unnest(range({len(value_headers)})) AS position, row_seq, unnest([
    CASE l_linenumber % 4 WHEN 0 THEN 'Road' WHEN 1 THEN 'Air' WHEN 2 THEN 'Rail' ELSE 'Sea' END,
    CASE l_returnflag WHEN 'R' THEN 'Fail' WHEN 'A' THEN 'Pass' ELSE 'Pending' END,
    CASE WHEN l_linestatus = 'F' THEN 'Delayed' ELSE ' On-Time ' END,
    CAST(l_discount AS VARCHAR), CAST(l_quantity AS VARCHAR), CAST(l_extendedprice AS VARCHAR),
    CAST(l_extendedprice AS VARCHAR), CAST(l_partkey % 30 + 1 AS VARCHAR), CAST(l_orderkey % 20 AS VARCHAR),
    strftime(l_shipdate, '%Y-%m-%d'), CASE WHEN l_linenumber > 1 THEN 'note ' || l_linenumber END]) AS value
FROM (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate,
        l_extendedprice, l_quantity) AS row_seq FROM lineitem)"""
    BLOCKS["value_headers"] = f"""
SELECT s_suppkey AS upload_id, unnest(range({len(value_headers)})) AS position,
  unnest({_headers(value_headers)}) AS header FROM supplier"""
    domain = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"
    from riskspark import schema

    sets = {"transport": schema.TRANSPORT_MODES, "inspection": schema.INSPECTION_VALUES,
            "shipment": schema.SHIPMENT_STATUSES}
    parts = ", ".join(
        f"coalesce(bool_and(lower(trim(value)) IN {domain(w)}), false) AS {n}_only, "
        f"count(DISTINCT CASE WHEN lower(trim(value)) IN {domain(w)} THEN lower(trim(value)) END) AS {n}_seen"
        for n, w in sets.items())
    BLOCKS["profiles"] = f"""
SELECT upload_id, position, count(value) AS filled, count(TRY_CAST(value AS DOUBLE)) AS numbers,
  min(TRY_CAST(value AS DOUBLE)) AS low, max(TRY_CAST(value AS DOUBLE)) AS high,
  stddev_samp(TRY_CAST(value AS DOUBLE)) AS std,
  count(TRY_CAST(value AS TIMESTAMP))::DOUBLE / nullif(count(value), 0) AS date_share, {parts} FROM cells GROUP BY upload_id, position"""
    registry = upload_headers[1:] + ["comment"]
    BLOCKS["registry"] = f"""
SELECT sha256(n_name) AS id, n_name AS company_id, n_nationkey / 25.0 AS confidence_score,
  list_transform({_headers(registry)}, lambda h: {written('h', '(n_nationkey % 4)')}) AS source_columns,
  TIMESTAMP '2024-01-01' AS created_at, TIMESTAMP '2024-01-01' + to_days(n_nationkey * 7 % 25) AS last_used_at
FROM nation"""


# --- logs

BLOCKS["sessions"] = """
SELECT 'S-' || conv_id AS session_id, 'U-' || (conv_id % 7) AS user_id,
  min(text) FILTER (role = 'user') AS query_text, CAST(sum(length(text)) AS BIGINT) AS tokens_used,
  count(*) * 850 AS latency_ms, CASE WHEN conv_id % 5 <> 0 THEN conv_id * 13 % 101 / 10 END AS evaluation_score,
  TIMESTAMP '2024-01-01' + to_hours(conv_id) AS created_at
FROM conversations GROUP BY conv_id"""

BLOCKS["traces"] = """
SELECT event_id, 'S-' || user_id AS session_id,
  (['retrieval', 'supplier_risk', 'shipment_analysis', 'inventory_intel', 'recommendation', 'evaluator'])
    [user_id % 6 + 1] AS agent,
  CASE WHEN event_type = 'error' THEN 'agent_error' ELSE 'agent_completed' END AS type,
  value * 10 AS elapsed_ms, CAST(json_extract(props, '$.k') AS BIGINT) AS tokens_used, ts
FROM events"""

BLOCKS["evaluations"] = """
SELECT 'E-' || doc_id AS result_id, 'S-' || CAST(floor(doc_id / 10) AS BIGINT) AS session_id,
  CASE WHEN doc_id % 13 <> 0 THEN (quality * 6 + doc_id % 5) / 10.0 END AS answer_relevancy,
  1.0 - toxic * 0.5 - doc_id % 3 * 0.125 AS faithfulness, doc_id % 11 / 10.0 AS contextual_recall,
  CASE WHEN doc_id % 7 <> 0 THEN doc_id % 9 / 8.0 END AS contextual_precision,
  CAST(doc_id * 7 % 11 AS DOUBLE) AS feasibility,
  CASE WHEN doc_id % 17 <> 0 THEN CAST(doc_id * 3 % 11 AS DOUBLE) END AS specificity,
  CAST(doc_id * 5 % 11 AS DOUBLE) AS impact, CAST(quality * 10 AS DOUBLE) AS timeline_realism,
  CASE WHEN doc_id % 4 <> 0 THEN doc_id * 13 % 101 / 10 END AS overall_score,
  TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS created_at
FROM labels"""

_METRICS = ["answer_relevancy", "faithfulness", "contextual_recall", "contextual_precision"]
_SUM = " + ".join(f"coalesce({m}, 0)" for m in _METRICS)
_KNOWN = " + ".join(f"(CASE WHEN {m} IS NULL THEN 0 ELSE 1 END)" for m in _METRICS)

BLOCKS["judged"] = f"""
SELECT *, CAST(printf('%.2f', o) AS DOUBLE) AS overall,
  CASE WHEN o >= 7.5 THEN 'APPROVED' WHEN o >= 5 THEN 'NEEDS_REVISION' ELSE 'REJECTED' END AS verdict,
  CASE WHEN {_KNOWN} > 0 THEN CAST(printf('%.4f', ({_SUM}) / ({_KNOWN})) AS DOUBLE) END AS average_score,
  coalesce(answer_relevancy >= 0.7, true) AND coalesce(faithfulness >= 0.8, true)
    AND coalesce(contextual_recall >= 0.7, true) AND coalesce(contextual_precision >= 0.7, true) AS passed
FROM (SELECT *, coalesce(overall_score, (coalesce(feasibility, 5) + coalesce(specificity, 5) + coalesce(impact, 5)
        + coalesce(timeline_realism, 5)) / 4) AS o FROM evaluations)"""

# --- search

TOKENS = "regexp_extract_all(lower(text), '[a-z0-9]+')"
BLOCKS["doc_tokens"] = f"SELECT doc_id, len({TOKENS}) AS dl, {TOKENS} AS terms FROM documents"
BLOCKS["postings"] = """
SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, dl, unnest(terms) AS term FROM doc_tokens)
GROUP BY doc_id, dl, term"""
BLOCKS["raw_terms"] = """
SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw
FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), (SELECT count(*) AS n FROM documents)"""
BLOCKS["terms"] = """
SELECT term, df, CASE WHEN raw < 0 THEN m * 0.25 ELSE raw END AS idf
FROM raw_terms, (SELECT avg(raw) AS m FROM raw_terms)"""
BLOCKS["query_terms"] = f"""
SELECT query_id, term, count(*) AS qtf
FROM (SELECT item_id AS query_id, unnest({TOKENS}) AS term FROM benchmark) GROUP BY query_id, term"""
BLOCKS["keyword"] = """
SELECT query_id, doc_id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM (
    SELECT query_id, doc_id,
      round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / mean_dl))), 9) AS score
    FROM postings JOIN query_terms USING (term) JOIN terms USING (term),
      (SELECT avg(dl) AS mean_dl FROM doc_tokens) GROUP BY query_id, doc_id) WHERE score > 0) WHERE rank < 15"""


def _hashed(source: str, ident: str) -> str:
    return f"""
SELECT {ident}, dim, val, sqrt(sum(val * val) OVER (PARTITION BY {ident})) AS norm FROM (
  SELECT {ident}, ('0x' || substr(md5(term), 1, 8))::BIGINT % 64 AS dim,
    sum(CASE WHEN substr(md5(term), 9, 1) < '8' THEN n ELSE -n END) AS val
  FROM (SELECT {ident}, term, {'tf' if ident == 'doc_id' else 'qtf'} AS n FROM {source}) GROUP BY 1, 2)"""


BLOCKS["doc_vectors"] = _hashed("postings", "doc_id")
BLOCKS["query_vectors"] = _hashed("query_terms", "query_id")
BLOCKS["semantic"] = """
SELECT query_id, doc_id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM (
    SELECT q.query_id, d.doc_id, round(coalesce(s.score, 0), 9) AS score
    FROM (SELECT item_id AS query_id FROM benchmark) q CROSS JOIN (SELECT doc_id FROM documents) d
    LEFT JOIN (SELECT query_id, doc_id, sum(d.val / d.norm * q.val / q.norm) AS score
      FROM doc_vectors d JOIN query_vectors q USING (dim) WHERE d.norm > 0 AND q.norm > 0
      GROUP BY query_id, doc_id) s ON s.query_id = q.query_id AND s.doc_id = d.doc_id))
WHERE rank < 15"""
BLOCKS["fused"] = """
SELECT query_id, doc_id, score,
  row_number() OVER (PARTITION BY query_id ORDER BY score DESC, list_no, r) - 1 AS rank
FROM (SELECT query_id, doc_id, sum(1.0 / (61 + rank)) AS score, min(list_no) AS list_no, arg_min(rank, list_no) AS r
  FROM (SELECT 0 AS list_no, * FROM semantic UNION ALL SELECT 1, * FROM keyword) GROUP BY query_id, doc_id)"""
BLOCKS["reranked"] = """
SELECT query_id, doc_id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before) - 1 AS rank FROM (
    SELECT p.query_id, p.doc_id, p.rank AS before, round(coalesce(sum(idf), 0), 9) AS score
    FROM (SELECT * FROM fused WHERE rank < 20) p
    LEFT JOIN (SELECT query_id, doc_id, idf FROM query_terms JOIN postings USING (term) JOIN terms USING (term)) t
      ON p.query_id = t.query_id AND p.doc_id = t.doc_id
    GROUP BY p.query_id, p.doc_id, p.rank)) WHERE rank < 10"""
# the same search with the vector side restricted to some documents
BLOCKS["semantic_some"] = BLOCKS["semantic"].replace(
    "FROM documents) d", "FROM documents WHERE lang IN ('de', 'fr') AND source = 'src0') d")
BLOCKS["fused_some"] = BLOCKS["fused"].replace("FROM semantic UNION", "FROM semantic_some UNION")
BLOCKS["reranked_some"] = BLOCKS["reranked"].replace("FROM fused ", "FROM fused_some ")
BLOCKS["keyword_texts"] = """
SELECT k.query_id, k.doc_id, k.score, k.rank, d.text, d.source FROM keyword k JOIN documents d USING (doc_id)
WHERE k.rank < 10"""
