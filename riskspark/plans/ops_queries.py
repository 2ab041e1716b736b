"""Registered queries: operations, query log, evaluation, reports, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskspark import schema
from riskspark.functions import rules
from riskspark.operators import analytics as a
from riskspark.operators import incidents as inc
from riskspark.operators import querylog as q
from riskspark.operators import reports
from riskspark.plans import etl, frames
from riskspark.plans.registry import query
from riskspark.plans.sql import AS_OF, SPLIT, TODAY, oracle
from riskspark.session import scratch_path
from riskspark.sources import files
from riskspark.sources import fixtures as fx
from riskspark.streaming import streams

R6 = lambda c: F.round(c, 6).alias(c)


# --- H: operations ---------------------------------------------------------------

_LISTED = ["incident_code", "severity", "category", "supplier_ref", "warehouse_location", "resolution_status"]


@query("ops_incident_list", oracle(f"""
SELECT {', '.join(_LISTED)} FROM incidents
WHERE severity = 'high' AND category = 'supplier' AND contains(lower(warehouse_location), 'nation_1')
  AND resolution_status = 'open'"""))
def ops_incident_list(spark, sf):
    found = a.filter_incidents(
        frames.incident_table(spark, sf), severity="high", category="supplier", warehouse="Nation_1",
        resolution="open")
    return found.select(*_LISTED)


@query("ops_incident_search", oracle("""
SELECT incident_code FROM incidents
WHERE contains(lower(title), 'early delivery') OR contains(lower(description), 'early delivery')"""))
def ops_incident_search(spark, sf):
    return a.filter_incidents(frames.incident_table(spark, sf), search="Early Delivery").select("incident_code")


@query("ops_incident_page", oracle("""
SELECT incident_code, occurred_at, (SELECT count(*) FROM incidents WHERE severity = 'critical') AS total FROM incidents
WHERE severity = 'critical' ORDER BY occurred_at DESC, incident_code LIMIT 50 OFFSET 100"""))
def ops_incident_page(spark, sf):
    found = a.filter_incidents(frames.incident_table(spark, sf), severity="critical")
    return a.page(found.select("incident_code", "occurred_at"), a.newest_first("incident_code"), 100, 50)


@query("ops_incident_stats", oracle("""
SELECT severity, count(*) AS n, (SELECT count(*) FROM incidents) AS total,
  (SELECT count(*) FROM incidents WHERE resolution_status IN ('open', 'in_progress')) AS open
FROM incidents GROUP BY severity"""))
def ops_incident_stats(spark, sf):
    return a.incident_stats(frames.incident_table(spark, sf))


@query("ops_incident_lookup", oracle("""
SELECT incident_code, title, impact_score FROM incidents WHERE incident_code = (SELECT min(incident_code) FROM incidents)"""))
def ops_incident_lookup(spark, sf):
    table = frames.incident_table(spark, sf)
    code = fx.canonical(spark, sf, ["sku"]).agg(F.min("sku")).first()[0]
    return a.find_incident(table, code).select("incident_code", "title", "impact_score")


def _reported(spark, sf):
    """Incidents reported by hand: one per order line flagged returned, with the code of the
    line, and one per order with a code of its own."""
    lines = fx.canonical(spark, sf, ["sku", "supplier_id", "inspection_status"])
    known = lines.filter(F.col("inspection_status") == "Fail").select(
        F.col("sku").alias("incident_code"), F.lit("high").alias("severity")).dropDuplicates(["incident_code"])
    fresh = fx.table(spark, sf, "orders").select(
        F.concat(F.lit("MAN-"), F.col("o_orderkey").cast("string")).alias("incident_code"),
        F.lit("low").alias("severity"))
    return known.unionByName(fresh)


_REPORTED = """
SELECT DISTINCT sku AS incident_code, 'high' AS severity FROM canonical WHERE inspection_status = 'Fail'
UNION ALL SELECT 'MAN-' || o_orderkey, 'low' FROM orders"""


@query("ops_incident_create", oracle(f"""
SELECT incident_code, severity, NOT EXISTS (SELECT 1 FROM canonical c WHERE c.sku = incident_code) AS accepted
FROM ({_REPORTED})"""))
def ops_incident_create(spark, sf):
    table = fx.canonical(spark, sf, ["sku"]).select(F.col("sku").alias("incident_code"))
    new = _reported(spark, sf)
    return inc.accepted(table, new).withColumn("accepted", F.lit(True)).unionByName(
        inc.rejected(table, new).withColumn("accepted", F.lit(False)))


@query("ops_incident_update", oracle("""
SELECT i.incident_code, CASE WHEN i.severity = 'critical' THEN 'in_progress' ELSE i.resolution_status END AS resolution_status,
  i.severity FROM incidents i"""))
def ops_incident_update(spark, sf):
    table = frames.incident_table(spark, sf).select("id", "incident_code", "severity", "resolution_status")
    changes = table.filter(F.col("severity") == "critical").select(
        "id", F.lit("in_progress").alias("resolution_status"), F.lit(None).cast("string").alias("severity"))
    return inc.patch(table, changes).select("incident_code", "resolution_status", "severity")


@query("ops_incident_delete", oracle("""
SELECT incident_code FROM incidents WHERE NOT (severity = 'low' AND resolution_status = 'closed')"""))
def ops_incident_delete(spark, sf):
    table = frames.incident_table(spark, sf).select("id", "incident_code", "severity", "resolution_status")
    gone = table.filter((F.col("severity") == "low") & (F.col("resolution_status") == "closed"))
    return inc.delete_rows(table, gone).select("incident_code")


@query("ops_supplier_list", oracle("""
SELECT supplier_id, reliability_score, count(*) OVER () AS total FROM suppliers
WHERE contains(lower(region), 'a') AND contains(lower(name), 'supplier') ORDER BY reliability_score, supplier_id LIMIT 50"""))
def ops_supplier_list(spark, sf):
    found = a.filter_suppliers(frames.supplier_table(spark, sf), region="A", search="supplier")
    return a.page(found.select("supplier_id", "reliability_score"), a.least_reliable_first())


@query("ops_supplier_risk", oracle("""
SELECT risk_level, count(*) AS n, (SELECT count(*) FROM suppliers) AS total_suppliers,
  (SELECT round(avg(reliability_score), 2) FROM suppliers) AS avg_reliability_score FROM suppliers GROUP BY risk_level"""))
def ops_supplier_risk(spark, sf):
    return a.supplier_risk_summary(frames.supplier_table(spark, sf))


@query("ops_supplier_history", oracle("""
SELECT supplier_ref, incident_code, position, occurred_at, delivery_delay_days, transportation_cost, inventory_level, severity,
  shipment_status FROM (SELECT *, CAST(row_number() OVER (PARTITION BY supplier_id ORDER BY occurred_at, incident_code) AS INT)
    AS position FROM incidents) WHERE position <= 30"""))
def ops_supplier_history(spark, sf):
    found = a.all_histories(frames.supplier_table(spark, sf), frames.incident_table(spark, sf))
    return found.drop("supplier_id")


@query("ops_supplier_history_one", oracle("""
SELECT incident_code, occurred_at, severity FROM incidents WHERE supplier_ref = 'SUP-0003'
ORDER BY occurred_at, incident_code LIMIT 30"""))
def ops_supplier_history_one(spark, sf):
    found = a.supplier_history(frames.supplier_table(spark, sf), frames.incident_table(spark, sf), "SUP-0003")
    return found.select("incident_code", "occurred_at", "severity")


@query("ops_supplier_detail", oracle("""
SELECT s.supplier_id, s.name, s.risk_level, r.recent FROM suppliers s LEFT JOIN (
  SELECT supplier_id, string_agg(incident_code || ':' || severity, ',' ORDER BY rn) AS recent FROM (
    SELECT *, row_number() OVER (PARTITION BY supplier_id ORDER BY occurred_at DESC, incident_code) AS rn FROM incidents)
  WHERE rn <= 10 GROUP BY supplier_id) r ON r.supplier_id = s.id"""))
def ops_supplier_detail(spark, sf):
    found = a.supplier_details(frames.supplier_table(spark, sf), frames.incident_table(spark, sf))
    text = F.transform("recent_incidents", lambda x: F.concat(x["incident_code"], F.lit(":"), x["severity"]))
    return found.select("supplier_id", "name", "risk_level", F.array_join(text, ",").alias("recent"))


@query("ops_open_by_severity", oracle("""
SELECT severity, count(*) AS n FROM incidents WHERE resolution_status IN ('open', 'in_progress') GROUP BY severity"""))
def ops_open_by_severity(spark, sf):
    return a.open_by_severity(frames.incident_table(spark, sf))


@query("ops_incident_kpis", oracle("""
SELECT count(*) AS total_incidents, count(*) FILTER (resolution_status IN ('open', 'in_progress')) AS open_incidents,
  round(least(greatest(coalesce(avg(impact_score) FILTER (resolution_status = 'open'), 50.0), 0.0), 100.0), 1)
    AS overall_risk_score, count(shipment_status) AS shipments,
  round(count(*) FILTER (shipment_status IN ('On-Time', 'Early')) / greatest(count(shipment_status), 1) * 100, 1)
    AS on_time_rate FROM incidents"""))
def ops_incident_kpis(spark, sf):
    return a.incident_kpis(frames.incident_table(spark, sf))


@query("ops_supplier_kpis", oracle("""
SELECT count(*) AS total_suppliers,
  round(count(*) FILTER (risk_level IN ('low', 'medium')) / greatest(count(*), 1) * 100, 1) AS pct_healthy,
  round(avg(reliability_score), 1) AS avg_reliability_score FROM suppliers"""))
def ops_supplier_kpis(spark, sf):
    return a.supplier_kpis(frames.supplier_table(spark, sf))


@query("ops_status_distribution", oracle(
    "SELECT shipment_status, count(*) AS n FROM incidents GROUP BY shipment_status"))
def ops_status_distribution(spark, sf):
    return a.status_distribution(frames.incident_table(spark, sf))


@query("ops_sessions_today", oracle(f"""
SELECT count(*) AS today, round(avg(evaluation_score), 2) AS avg_quality_score FROM sessions WHERE created_at >= {TODAY}"""))
def ops_sessions_today(spark, sf):
    return a.sessions_today(fx.sessions(spark, sf), fx.AS_OF)


@query("ops_recent_sessions", oracle("""
SELECT session_id, CASE WHEN length(query_text) > 80 THEN substr(query_text, 1, 80) || '...' ELSE query_text END AS query_text,
  evaluation_score AS risk_score, tokens_used, latency_ms, created_at FROM sessions ORDER BY created_at DESC, session_id LIMIT 5"""))
def ops_recent_sessions(spark, sf):
    return a.recent_sessions(fx.sessions(spark, sf))


@query("ops_alerts", oracle(f"""
SELECT {', '.join(c for c in a.ALERT_COLUMNS)} FROM incidents
WHERE resolution_status IN ('open', 'in_progress') AND severity IN ('critical', 'high', 'medium')
ORDER BY occurred_at DESC, incident_code LIMIT 20"""))
def ops_alerts(spark, sf):
    return a.alerts(frames.incident_table(spark, sf))


# --- I: query log ----------------------------------------------------------------

_GUARD = r"(?i)(--|;|\bDROP\b|\bSELECT\b|\bINSERT\b|\bDELETE\b|\bUPDATE\b|\bEXEC\b|\bUNION\b|<script|javascript:|onerror=)"


@query("log_guard", oracle(rf"""
SELECT doc_id, reason, CASE WHEN reason IS NULL THEN md5(regexp_replace(t, '\s{{3,}}', '  ', 'g')) END AS clean FROM (
  SELECT doc_id, t, CASE WHEN length(t) < 5 THEN 'too_short' WHEN length(t) > 2000 THEN 'too_long'
    WHEN regexp_matches(t, '{_GUARD}') THEN 'disallowed' END AS reason
  FROM (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents))"""))
def log_guard(spark, sf):
    texts = fx.documents(spark, sf).select("doc_id", F.col("text").alias("query_text"))
    return q.guard_queries(texts).select("doc_id", "reason", F.md5("clean").alias("clean"))


@query("log_cache_key", oracle("""
SELECT conv_id, turn, md5(regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g') || '{"role": "' || role || '"}') AS key
FROM conversations"""))
def log_cache_key(spark, sf):
    filters = F.concat(F.lit('{"role": "'), "role", F.lit('"}'))
    return fx.table(spark, sf, "conversations").select(
        "conv_id", "turn", q.cache_key(F.col("text"), filters).alias("key"))


_REPEATS = """
WITH RECURSIVE log AS (SELECT event_id, event_type AS key, ts FROM events),
misses AS (
  SELECT key, min(ts) AS ts FROM log GROUP BY key
  UNION ALL
  SELECT m.key, (SELECT min(l.ts) FROM log l WHERE l.key = m.key AND l.ts >= m.ts + INTERVAL 600 SECONDS) FROM misses m
  WHERE EXISTS (SELECT 1 FROM log l WHERE l.key = m.key AND l.ts >= m.ts + INTERVAL 600 SECONDS))
SELECT l.event_id, l.key, NOT (m.ts IS NOT NULL AND row_number() OVER (PARTITION BY l.key, l.ts ORDER BY l.event_id) = 1)
  AS hit FROM log l LEFT JOIN misses m ON m.key = l.key AND m.ts = l.ts"""


def _log_keys(spark, sf):
    return fx.table(spark, sf, "events").select("event_id", F.col("event_type").alias("key"), "ts")


@query("log_repeats", _REPEATS)
def log_repeats(spark, sf):
    return q.mark_repeats(_log_keys(spark, sf)).select("event_id", "key", "hit")


def _final_events(spark, sf):
    return fx.sessions(spark, sf).withColumns(
        {
            "overall_score": F.col("evaluation_score"),
            "risk_score": F.col("evaluation_score") * 10,
            "final_response": F.col("query_text"),
            "recommendations": F.array(F.concat(F.lit("REC-"), "session_id")),
        }
    )


def _session_frame(spark, sf):
    return q.session_rows(_final_events(spark, sf))


@query("log_saved_sessions", oracle("""
SELECT s.session_id, user_id, final_response, tokens_used, coalesce(events, 0) AS events, coalesce(spent, 0) AS spent, last_agent,
  coalesce(context, '') AS context
FROM (SELECT session_id, user_id, query_text AS final_response, tokens_used FROM sessions) s
LEFT JOIN (SELECT session_id, count(*) AS events, CAST(sum(tokens_used) AS BIGINT) AS spent, arg_max(agent, ts) AS last_agent
  FROM traces GROUP BY session_id) t ON t.session_id = s.session_id
LEFT JOIN (SELECT 'S-' || CAST(floor(doc_id / 10) AS BIGINT) AS session_id,
  string_agg((doc_id % 10 + 1) || ':' || doc_id, ',' ORDER BY doc_id % 10) AS context FROM labels GROUP BY 1) c
ON c.session_id = s.session_id"""))
def log_saved_sessions(spark, sf):
    """Stored sessions, their traces and retrieval contexts told back."""
    stored = q.saved_sessions(_final_events(spark, sf), fx.trace_events(spark, sf), fx.retrieved(spark, sf))
    events = F.col("agent_trace.events")
    told = F.array_join(F.transform("retrieval_context", lambda d: F.concat_ws(":", d["rank"].cast("string"), d["doc_id"].cast("string"))), ",")
    parts = stored.select(
        "session_id", "user_id", F.col("result.final_response").alias("final_response"), "tokens_used", told.alias("context"),
        F.size(events).alias("n"), F.aggregate(events, F.lit(0).cast("bigint"), lambda s, e: s + F.coalesce(e["tokens_used"], F.lit(0).cast("bigint"))).alias("t"),
        F.get(events, F.size(events) - 1).alias("last"))
    return parts.groupBy("session_id", "user_id", "final_response", "tokens_used", "context").agg(
        F.sum("n").alias("events"), F.sum("t").alias("spent"), F.max_by("last.agent", "last.ts").alias("last_agent"))


@query("log_session_rows", oracle("""
SELECT session_id, user_id, round(evaluation_score * 10, 6) AS risk_score, query_text AS final_response,
  'REC-' || session_id AS recommendation,
  tokens_used, latency_ms, evaluation_score FROM sessions"""))
def log_session_rows(spark, sf):
    return _session_frame(spark, sf).select(
        "session_id", "user_id", F.round("result.risk_score", 6).alias("risk_score"), "result.final_response",
        F.element_at("result.recommendations", 1).alias("recommendation"),
        "tokens_used", "latency_ms", "evaluation_score")


@query("log_trace_parts", oracle("""
SELECT session_id, count(*) AS events, CAST(sum(tokens_used) AS BIGINT) AS tokens, min(ts) AS first_ts, max(ts) AS last_ts
FROM traces GROUP BY session_id"""))
def log_trace_parts(spark, sf):
    parts = q.trace_parts(fx.trace_events(spark, sf))
    events = F.col("events")
    one = parts.select(
        "session_id", F.size(events).alias("n"),
        F.aggregate(events, F.lit(0).cast("bigint"), lambda s, e: s + e["tokens_used"]).alias("t"),
        F.element_at(events, 1)["ts"].alias("lo"), F.element_at(events, -1)["ts"].alias("hi"))
    return one.groupBy("session_id").agg(
        F.sum("n").alias("events"), F.sum("t").alias("tokens"), F.min("lo").alias("first_ts"),
        F.max("hi").alias("last_ts"))


@query("log_user_sessions", oracle("""
SELECT session_id, created_at FROM sessions WHERE user_id = 'U-3' ORDER BY created_at DESC, session_id LIMIT 20 OFFSET 2"""))
def log_user_sessions(spark, sf):
    return q.user_sessions(fx.sessions(spark, sf), "U-3", skip=2).select("session_id", "created_at")


@query("log_session_lookup", oracle(
    "SELECT session_id, query_text, tokens_used FROM sessions WHERE session_id = 'S-3' AND user_id = 'U-3'"))
def log_session_lookup(spark, sf):
    return q.find_session(fx.sessions(spark, sf), "S-3", "U-3").select("session_id", "query_text", "tokens_used")


@query("log_feedback", oracle("""
SELECT 'S-' || conv_id AS session_id, CAST(conv_id % 7 AS INT) AS overall_rating, turn % 2 = 0 AS helpful,
  CASE WHEN role = 'user' THEN role END AS comment
FROM conversations WHERE conv_id % 7 BETWEEN 1 AND 5"""))
def log_feedback(spark, sf):
    new = fx.table(spark, sf, "conversations").select(
        F.concat(F.lit("S-"), F.col("conv_id").cast("string")).alias("session_id"),
        (F.col("conv_id") % 7).cast("int").alias("overall_rating"),
        (F.col("turn") % 2 == 0).alias("helpful"),
        F.when(F.col("role") == "user", F.col("role")).otherwise("").alias("comment"))
    return q.accept_feedback(new.limit(0), new)


@query("log_today", oracle(f"""
SELECT count(*) AS total_queries_today, round(coalesce(avg(latency_ms), 0), 0) AS avg_latency_ms,
  round(avg(evaluation_score), 2) AS avg_evaluation_score, coalesce(CAST(sum(tokens_used) AS BIGINT), 0) AS total_tokens_today,
  round(coalesce(CAST(sum(tokens_used) AS DOUBLE), 0) * 0.70 / 1000 * 0.005
    + coalesce(CAST(sum(tokens_used) AS DOUBLE), 0) * 0.30 / 1000 * 0.015, 4) AS estimated_cost_today_usd
FROM sessions WHERE created_at >= {TODAY}"""))
def log_today(spark, sf):
    return q.today_totals(fx.sessions(spark, sf), fx.AS_OF)


_MODELS = list(schema.MODEL_PRICES) + ["other"]


@query("log_model_cost", oracle("""
SELECT session_id, round(CASE m WHEN 0 THEN p * 0.005 + c * 0.015 WHEN 1 THEN p * 0.00015 + c * 0.0006
  WHEN 2 THEN p * 0.00002 ELSE p * 0.005 + c * 0.015 END, 6) AS cost
FROM (SELECT session_id, latency_ms // 850 % 4 AS m, tokens_used / 1000.0 AS p, latency_ms / 1000.0 AS c FROM sessions)"""))
def log_model_cost(spark, sf):
    model = F.element_at(
        F.array(*[F.lit(m) for m in _MODELS]), (F.floor(F.col("latency_ms") / 850) % 4 + 1).cast("int"))
    return fx.sessions(spark, sf).select(
        "session_id", F.round(q.model_cost(F.col("tokens_used"), F.col("latency_ms"), model), 6).alias("cost"))


@query("log_daily_series", oracle(f"""
SELECT CAST(created_at AS DATE) AS date, count(*) AS count, round(coalesce(avg(evaluation_score), 0), 2) AS score
FROM sessions WHERE created_at >= {AS_OF} - INTERVAL 7 DAYS GROUP BY 1"""))
def log_daily_series(spark, sf):
    return q.daily_series(fx.sessions(spark, sf), fx.AS_OF)


@query("log_agent_stats", oracle(f"""
WITH recent AS (SELECT session_id FROM sessions WHERE created_at >= {AS_OF} - INTERVAL 7 DAYS
    AND session_id IN (SELECT session_id FROM traces) ORDER BY created_at DESC, session_id LIMIT 50),
m AS (SELECT agent, avg(elapsed_ms) FILTER (type = 'agent_completed' AND elapsed_ms > 0) AS latency,
    count(*) FILTER (type = 'agent_completed' AND elapsed_ms > 0) AS calls, count(*) FILTER (type = 'agent_error') AS errors,
    avg(tokens_used) FILTER (tokens_used > 0) AS tokens FROM traces WHERE session_id IN (SELECT session_id FROM recent)
  GROUP BY agent),
t AS (SELECT count(*) AS today FROM sessions WHERE created_at >= {TODAY})
SELECT a.agent AS agent_name, coalesce(round(latency, 0), default_ms::DOUBLE) AS avg_latency_ms,
  coalesce(nullif(calls, 0), today) AS total_calls,
  round(coalesce(errors, 0) / greatest(coalesce(nullif(calls, 0), today), 1), 3) AS error_rate,
  coalesce(round(tokens, 0), 0.0) AS avg_tokens, latency IS NULL AS is_estimated
FROM (VALUES {', '.join(f"('{k}', {v})" for k, v in schema.AGENT_LATENCY.items())}) a(agent, default_ms)
LEFT JOIN m ON m.agent = a.agent, t"""))
def log_agent_stats(spark, sf):
    return q.agent_stats(fx.sessions(spark, sf), fx.trace_events(spark, sf), fx.AS_OF)


@query("log_agent_stats_all", oracle("""
SELECT agent AS agent_name, round(avg(elapsed_ms), 0) AS avg_latency_ms, count(*) AS total_calls,
  round(avg(tokens_used), 0) AS avg_tokens, CAST(0 AS DOUBLE) AS error_rate FROM traces
WHERE type = 'agent_completed' GROUP BY agent"""))
def log_agent_stats_all(spark, sf):
    return q.agent_stats_all_time(fx.sessions(spark, sf), fx.trace_events(spark, sf), limit=None)


@query("log_agent_stats_newest", oracle("""
SELECT agent AS agent_name, round(avg(elapsed_ms), 0) AS avg_latency_ms, count(*) AS total_calls,
  round(avg(tokens_used), 0) AS avg_tokens, CAST(0 AS DOUBLE) AS error_rate FROM traces
WHERE type = 'agent_completed' AND session_id IN (
  SELECT session_id FROM sessions ORDER BY created_at DESC, session_id LIMIT 200) GROUP BY agent"""))
def log_agent_stats_newest(spark, sf):
    return q.agent_stats_all_time(fx.sessions(spark, sf), fx.trace_events(spark, sf))


@query("log_runs", oracle("""
SELECT session_id AS run_id, 'supply-chain-query' AS name,
  CASE WHEN evaluation_score IS NOT NULL THEN 'success' ELSE 'completed' END AS status, created_at AS start_time, latency_ms,
  tokens_used AS total_tokens,
  CASE WHEN length(query_text) > 80 THEN substr(query_text, 1, 80) || '…' ELSE query_text END AS query_snippet,
  'local_db' AS source FROM sessions ORDER BY created_at DESC, session_id LIMIT 50"""))
def log_runs(spark, sf):
    return q.run_list(fx.sessions(spark, sf))


@query("log_latency", oracle("""
SELECT e.event_id, CASE WHEN event_type <> 'view'
  THEN date_diff('microsecond', date_trunc('hour', ts), ts) // 1000 END AS latency_ms FROM events e"""))
def log_latency(spark, sf):
    start = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    end = F.when(F.col("event_type") != "view", F.col("ts"))
    return fx.table(spark, sf, "events").select("event_id", q.latency_ms(start, end).alias("latency_ms"))


# --- I: evaluation ---------------------------------------------------------------


def _judged(spark, sf):
    return q.metric_rollup(q.judge(fx.evaluations(spark, sf)))


@query("eval_judge", oracle("SELECT result_id, overall, verdict FROM judged"))
def eval_judge(spark, sf):
    return q.judge(fx.evaluations(spark, sf)).select("result_id", "overall", "verdict")


_SESSION_VERDICTS = """
SELECT session_id, CAST(printf('%.2f', CAST(sum(CAST(round_even(overall * 100, 0) AS BIGINT)) AS DOUBLE) / (count(*) * 100.0))
    AS DOUBLE) AS overall_score,
  CASE WHEN bool_or(verdict = 'REJECTED') THEN 'REJECTED'
    WHEN bool_or(verdict = 'APPROVED') AND NOT bool_or(verdict = 'NEEDS_REVISION') THEN 'APPROVED' ELSE 'NEEDS_REVISION' END
    AS verdict FROM judged GROUP BY session_id"""


@query("eval_session_verdict", oracle(_SESSION_VERDICTS))
def eval_session_verdict(spark, sf):
    return q.session_verdict(q.judge(fx.evaluations(spark, sf)))


@query("eval_metrics", oracle("SELECT result_id, average_score, passed FROM judged"))
def eval_metrics(spark, sf):
    return q.metric_rollup(fx.evaluations(spark, sf)).select("result_id", "average_score", "passed")


def _evaluated(spark, sf):
    """One evaluation per session: mean of its rows, worst verdict."""
    rows = _judged(spark, sf)
    scores = rows.groupBy("session_id").agg(
        F.round(q.mean_of_decimals(F.col("average_score"), 4), 9).alias("average_score"), F.bool_and("passed").alias("passed"))
    return scores.join(q.session_verdict(rows), "session_id")


_EVALUATED = f"""
SELECT s.session_id, s.average_score, s.passed, v.verdict, v.overall_score FROM (
  SELECT session_id, round(CAST(sum(CAST(round_even(average_score * 1e4, 0) AS BIGINT)) AS DOUBLE)
    / (count(average_score) * 1e4), 9) AS average_score, bool_and(passed) AS passed FROM judged GROUP BY session_id) s
JOIN ({_SESSION_VERDICTS}) v USING (session_id)"""


@query("eval_write_back", oracle(f"""
SELECT s.session_id, coalesce(e.average_score, s.evaluation_score) AS evaluation_score, e.verdict AS judge_verdict,
  e.session_id IS NOT NULL AS has_result FROM sessions s LEFT JOIN ({_EVALUATED}) e USING (session_id)"""))
def eval_write_back(spark, sf):
    evaluated = _evaluated(spark, sf)
    stored = evaluated.select("session_id", "average_score", "verdict").limit(0)
    sessions, results = q.write_back(fx.sessions(spark, sf), stored, evaluated)
    known = results.select("session_id").distinct().withColumn("has_result", F.lit(True))
    return sessions.join(known, "session_id", "left").select(
        "session_id", "evaluation_score", "judge_verdict",
        F.coalesce("has_result", F.lit(False)).alias("has_result"))


@query("eval_summary", oracle(f"""
SELECT count(*) AS sessions, round(avg(average_score), 6) AS average_score,
  round(count(*) FILTER (passed) / greatest(count(*), 1), 6) AS pass_rate,
  count(*) FILTER (verdict = 'APPROVED') AS approved FROM ({_EVALUATED})"""))
def eval_summary(spark, sf):
    return q.evaluation_summary(_evaluated(spark, sf))


@query("eval_results", oracle("""
SELECT result_id, created_at, average_score, (SELECT count(*) FROM judged) AS total FROM judged
ORDER BY created_at DESC, result_id LIMIT 20 OFFSET 20"""))
def eval_results(spark, sf):
    rows = _judged(spark, sf).select("result_id", "created_at", "average_score")
    return a.page(rows, [F.col("created_at").desc_nulls_last(), F.col("result_id")], 20, 20)


@query("eval_lookup", oracle("SELECT result_id, verdict, passed FROM judged WHERE result_id = 'E-4'"))
def eval_lookup(spark, sf):
    return _judged(spark, sf).filter(F.col("result_id") == "E-4").select("result_id", "verdict", "passed")


@query("eval_radar", oracle("""
SELECT round(coalesce(sum(answer_relevancy), 0) / greatest(count(*), 1), 3) AS answer_relevancy,
  round(coalesce(sum(faithfulness), 0) / greatest(count(*), 1), 3) AS faithfulness,
  round(coalesce(sum(contextual_recall), 0) / greatest(count(*), 1), 3) AS contextual_recall FROM evaluations"""))
def eval_radar(spark, sf):
    return q.radar(fx.evaluations(spark, sf))


@query("eval_select", oracle("""
SELECT session_id, created_at FROM sessions ORDER BY created_at DESC, session_id LIMIT 20"""))
def eval_select(spark, sf):
    return q.sessions_to_evaluate(fx.sessions(spark, sf)).select("session_id", "created_at")


@query("eval_recommendation_counts", oracle("""
SELECT session_id, CAST(latency_ms // 850 AS INT) AS recommendations, CAST((latency_ms // 850 + 2) // 3 AS INT) AS p1
FROM sessions"""))
def eval_recommendation_counts(spark, sf):
    n = F.floor(F.col("latency_ms") / 850).cast("int")
    recs = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.struct(F.concat(F.lit("P"), ((i - 1) % 3 + 1).cast("string")).alias("priority")))
    return q.recommendation_counts(fx.sessions(spark, sf).withColumn("recommendations", recs))


# --- J: reports ------------------------------------------------------------------

_REPORT = ["supplier_name", "region", "route", "warehouse_location", "demand_forecast", "occurred_at"]


def _split():
    return F.lit(fx.SPLIT).cast("timestamp_ntz")


def _frame(spark, sf):
    return frames.enriched(spark, sf, _REPORT)


_TREND = """CASE WHEN recent > prior + abs(prior) * 0.05 THEN 'degrading' WHEN recent < prior - abs(prior) * 0.05
  THEN 'improving' ELSE 'stable' END"""
_COVER = "CASE WHEN demand_forecast > 0 THEN inventory_level / demand_forecast ELSE 1.0 END"
_SCORES = f"""
SELECT supplier_id, name, round(score, 9) AS risk_score, CASE WHEN d > 7 THEN 'delivery delays' WHEN f > 0.05 THEN 'defect rate'
  WHEN c < 0.5 THEN 'low stock' ELSE 'none' END AS primary_issue, {_TREND} AS trend FROM (
  SELECT supplier_id, min(supplier_name) AS name, avg(risk_score) AS score, avg(delivery_delay_days) AS d,
    avg(defect_rate) AS f, avg({_COVER}) AS c, avg(delivery_delay_days) FILTER (occurred_at >= {SPLIT}) AS recent,
    avg(delivery_delay_days) FILTER (occurred_at < {SPLIT}) AS prior FROM enriched GROUP BY supplier_id)"""


@query("report_supplier_scores", oracle(_SCORES))
def report_supplier_scores(spark, sf):
    return reports.supplier_scores(_frame(spark, sf), _split()).select(
        "supplier_id", "name", F.round("score", 9).alias("risk_score"), "primary_issue", "trend")


@query("report_supplier", oracle(f"""
SELECT s.supplier_id, s.name, s.risk_score, s.primary_issue, w.risk_level, {_TREND} AS trend FROM (
  SELECT * FROM ({_SCORES}) ORDER BY risk_score DESC, supplier_id LIMIT 2) s,
(SELECT CASE WHEN avg(risk_score) >= 75 THEN 'critical' WHEN avg(risk_score) >= 50 THEN 'high'
    WHEN avg(risk_score) >= 25 THEN 'medium' ELSE 'low' END AS risk_level,
  avg(delivery_delay_days) FILTER (occurred_at >= {SPLIT}) AS recent,
  avg(delivery_delay_days) FILTER (occurred_at < {SPLIT}) AS prior FROM enriched) w"""))
def report_supplier(spark, sf):
    return reports.supplier_report(_frame(spark, sf), _split())


@query("report_regions", oracle("""
SELECT region, round(avg(risk_score), 6) AS risk_score, count(*) AS records FROM enriched GROUP BY region
ORDER BY risk_score DESC, region LIMIT 2"""))
def report_regions(spark, sf):
    return reports.region_hotspots(_frame(spark, sf))


@query("report_shipment", oracle("""
SELECT round(avg(CASE WHEN delivery_delay_days > 0 THEN 1.0 ELSE 0.0 END), 6) AS delay_probability,
  round(avg(greatest(delivery_delay_days, 0.0)), 6) AS estimated_delay_days,
  round(sum(transportation_cost) FILTER (delivery_delay_days > 0)
    - avg(transportation_cost) * count(*) FILTER (delivery_delay_days > 0), 2) AS additional_cost_usd,
  round((avg(transportation_cost) FILTER (delivery_delay_days > 0) - avg(transportation_cost))
    / avg(transportation_cost) * 100, 6) AS cost_increase_pct FROM canonical"""))
def report_shipment(spark, sf):
    return reports.shipment_report(_frame(spark, sf))


def _congested(by):
    return f"""
SELECT {by}, avg_delay_days, records, CASE WHEN avg_delay_days > 7 THEN 'high' WHEN avg_delay_days > 3 THEN 'medium'
  ELSE 'low' END AS level FROM (SELECT {by}, round(avg(delivery_delay_days), 6) AS avg_delay_days, count(*) AS records
  FROM canonical GROUP BY {by} ORDER BY avg_delay_days DESC, {by} LIMIT 2)"""


@query("report_routes", oracle(_congested("route")))
def report_routes(spark, sf):
    return reports.congested(_frame(spark, sf), "route")


@query("report_locations", oracle(_congested("warehouse_location")))
def report_locations(spark, sf):
    return reports.congested(_frame(spark, sf), "warehouse_location")


@query("report_inventory_items", oracle(f"""
SELECT sku AS item, supplier_id, inventory_level AS current_inventory, demand_forecast, round(c, 6) AS coverage_ratio,
  round(c * 30, 4) AS days_until_stockout, CASE WHEN c < 0.20 THEN 'critical' WHEN c < 0.50 THEN 'high' END AS risk_level,
  CASE WHEN c < 0.20 THEN 'immediate' ELSE 'soon' END AS urgency FROM (SELECT *, {_COVER} AS c FROM canonical) WHERE c < 0.5"""))
def report_inventory_items(spark, sf):
    return reports.inventory_items(_frame(spark, sf))


@query("report_inventory", oracle(f"""
SELECT count(*) FILTER (c < 0.5) AS stockout_items, round(avg((c < 0.5)::INT::DOUBLE), 6) AS at_risk_share,
  sum(demand_forecast) > sum(inventory_level) AS demand_surge_detected,
  CASE WHEN avg((c < 0.5)::INT) > 0.5 THEN 'critical' WHEN avg((c < 0.5)::INT) > 0.25 THEN 'at_risk'
    WHEN avg((c < 0.5)::INT) > 0.1 THEN 'adequate' ELSE 'healthy' END AS overall_inventory_health
FROM (SELECT *, {_COVER} AS c FROM canonical)"""))
def report_inventory(spark, sf):
    return reports.inventory_report(_frame(spark, sf))


@query("report_mitigation", oracle(f"""
WITH three AS (
  SELECT 'supplier' AS domain, supplier_id AS target, risk_score AS score, 'Procurement' AS responsible_team FROM (
    SELECT * FROM ({_SCORES}) ORDER BY risk_score DESC, supplier_id LIMIT 1)
  UNION ALL SELECT 'shipment', route, round(least(avg_delay_days / 20.0, 1.0) * 100, 6), 'Logistics' FROM (
    SELECT route, round(avg(delivery_delay_days), 6) AS avg_delay_days FROM canonical GROUP BY route
    ORDER BY avg_delay_days DESC, route LIMIT 1)
  UNION ALL SELECT 'inventory', warehouse_location, s, 'Operations' FROM (
    SELECT warehouse_location, round(avg(({_COVER} < 0.5)::INT::DOUBLE) * 100, 6) AS s FROM canonical
    GROUP BY warehouse_location ORDER BY s DESC, warehouse_location LIMIT 1))
SELECT 'REC-00' || n AS id, 'P' || n AS priority, (['48 hours', '1 week', '2 weeks'])[n] AS timeline, domain, target, score,
  responsible_team, (SELECT round(avg(risk_score), 6) FROM enriched) AS overall_risk_score
FROM (SELECT *, row_number() OVER (ORDER BY score DESC, domain DESC) AS n FROM three)"""))
def report_mitigation(spark, sf):
    return reports.mitigation_queue(_frame(spark, sf), _split())


# --- K: streams ------------------------------------------------------------------


def _event_stream(spark, sf):
    schema_ = fx.table(spark, sf, "events").schema
    return streams.read_files(spark, sf, schema_, pattern="events.parquet")


@query("stream_agent_metrics", oracle("""
SELECT date_trunc('hour', ts) AS window_start, agent,
  count(*) FILTER (type = 'agent_completed' AND elapsed_ms > 0) AS calls, count(*) FILTER (type = 'agent_error') AS errors,
  round(avg(elapsed_ms) FILTER (type = 'agent_completed' AND elapsed_ms > 0), 6) AS avg_latency_ms,
  CAST(sum(tokens_used) AS BIGINT) AS tokens FROM traces GROUP BY 1, 2"""))
def stream_agent_metrics(spark, sf):
    # every window is written, also those the watermark has not closed
    metrics = streams.agent_metrics(fx.trace_columns(_event_stream(spark, sf)))
    return streams.drain_final(metrics).withColumn("avg_latency_ms", F.round("avg_latency_ms", 6))


@query("stream_repeats", _REPEATS)
def stream_repeats(spark, sf):
    log = _event_stream(spark, sf).select(F.col("event_type").alias("key"), F.col("event_id").alias("ident"), "ts")
    return streams.drain(streams.suppress_repeats(log)).select(F.col("ident").alias("event_id"), "key", "hit")


@query("stream_alerts", oracle("""
SELECT sku AS incident_code, rule_severity AS severity, resolution_status FROM formatted
WHERE resolution_status IN ('open', 'in_progress') AND rule_severity IN ('critical', 'high', 'medium')"""))
def stream_alerts(spark, sf):
    path = scratch_path(spark, "incident-feed")
    df = fx.canonical(spark, sf, [
        "sku", "delivery_delay_days", "inventory_level", "demand_forecast", "resolution_status"])
    rows = df.select(
        F.col("sku").alias("incident_code"),
        F.expr(rules.rule_severity("delivery_delay_days", "inventory_level", "demand_forecast")).alias("severity"),
        "resolution_status")
    rows.write.parquet(path)
    return streams.drain(streams.alert_feed(streams.read_files(spark, path, rows.schema)))


@query("stream_daily_volume", oracle("""
SELECT CAST(created_at AS DATE) AS date, count(*) AS count, round(avg(evaluation_score), 6) AS score FROM sessions GROUP BY 1"""))
def stream_daily_volume(spark, sf):
    path = scratch_path(spark, "session-feed")
    sessions = fx.sessions(spark, sf).select("session_id", "created_at", "evaluation_score")
    sessions.write.parquet(path)
    daily = streams.daily_volume(streams.read_files(spark, path, sessions.schema))
    return streams.drain_final(daily).withColumn("score", F.round("score", 6))


@query("stream_session_traces", oracle("""
SELECT s.session_id, s.created_at, count(*) AS events, CAST(sum(t.tokens_used) AS BIGINT) AS spent, max(ts) AS last_ts
FROM sessions s JOIN traces t ON s.session_id = t.session_id
  AND ts BETWEEN created_at - INTERVAL 2 DAY AND created_at + INTERVAL 2 DAY GROUP BY s.session_id, s.created_at"""))
def stream_session_traces(spark, sf):
    """Trace events and final events arrive as two streams and are joined."""
    path = scratch_path(spark, "runs")
    final = fx.sessions(spark, sf).select("session_id", "created_at", "evaluation_score")
    traces = fx.trace_events(spark, sf)
    final.write.parquet(f"{path}/final")
    traces.write.parquet(f"{path}/traces")
    joined = streams.session_traces(streams.read_files(spark, f"{path}/final", final.schema),
                                    streams.read_files(spark, f"{path}/traces", traces.schema), within="2 DAYS")
    return streams.drain(joined).groupBy("session_id", "created_at").agg(
        F.count("*").alias("events"), F.sum("tokens_used").alias("spent"), F.max("ts").alias("last_ts"))


@query("stream_uploads", oracle("""
SELECT sku AS incident_code, supplier_id AS supplier_ref, round(delivery_delay_days, 2) AS delivery_delay_days,
  product_type AS supplier_category
FROM canonical WHERE floor(inventory_level / 10) % 3 <> 2"""))
def stream_uploads(spark, sf):
    """Files with headers of three styles arrive in a folder; those without a required group are
    rejected whole."""
    styles = [
        {"sku": "incident code", "supplier_id": "Supplier ID", "supplier_name": "supplier_name", "product_type": "category",
         "inventory_level": "InventoryLevel", "shipment_status": "shipment status", "timestamp": "Date",
         "warehouse_location": "Warehouse Location", "delivery_delay_days": "delivery_delay", "demand_forecast": "order quantity",
         "transportation_cost": "transportation cost"},
        {"sku": "IncidentCode", "supplier_id": "SUPPLIERID", "supplier_name": "Supplier Name", "product_type": "Supplier Category",
         "inventory_level": "inventory_level", "shipment_status": "ShipmentStatus", "timestamp": "occurred_at",
         "warehouse_location": "warehouselocation", "delivery_delay_days": "Delivery Delay Days",
         "demand_forecast": "demand_forecast", "transportation_cost": "TransportationCost"},
    ]
    styles.append({**styles[0], "shipment_status": "remarks"})
    home, path = scratch_path(spark, "warehouse"), scratch_path(spark, "folder")
    lines = fx.canonical(spark, sf, list(styles[0])).withColumns(
        {"shipment_status": F.lit("In-Transit"), "pick": F.floor(F.col("inventory_level") / 10) % 3})
    for i, style in enumerate(styles):
        rows = lines.filter(F.col("pick") == i).select(*[F.col(c).alias(h) for c, h in style.items()])
        files.write_csv(rows, f"{path}/upload-{i}")
    warehouse, log = etl.Warehouse.at(spark, home), []
    streams.ingest_folder(spark, path, warehouse, scratch_path(spark, "offsets"), log).awaitTermination()
    if any((e["status"] == "failed") != ("/upload-2/" in e["path"]) for e in log):
        raise RuntimeError(f"uploads: {log}")
    chunks = warehouse.chunks.read().filter("chunk_type = 'record'")
    category = chunks.select(F.col("metadata.incident_code").alias("incident_code"),
                             F.col("metadata.supplier_category").alias("supplier_category"))
    return warehouse.incidents.read().select("incident_code", "supplier_ref", "delivery_delay_days").join(
        category, "incident_code")


@query("stream_ingest", oracle("""
SELECT incident_code, supplier_ref, severity FROM incidents"""))
def stream_ingest(spark, sf):
    """CSV files arriving in a folder go through the ETL into warehouse tables."""
    columns = ["supplier_id", "supplier_name", "sku", "inventory_level", "demand_forecast", "delivery_delay_days",
               "transportation_cost", "defect_rate", "warehouse_location", "timestamp"]
    path, home = scratch_path(spark, "uploads"), scratch_path(spark, "warehouse")
    # the key goes along as text so that the row order survives the file
    keyed = fx.canonical(spark, sf, columns).select(
        F.col("row_key.l_orderkey").alias("o"), F.col("row_key.l_linenumber").alias("n"), F.col("sku").alias("code"), *columns)
    files.write_csv(keyed, path)
    arriving = streams.read_files(
        spark, path, ", ".join(f"`{c}` string" for c in keyed.columns), fmt="csv").withColumns(
        {"o": F.col("o").cast("bigint"), "n": F.col("n").cast("int")})
    same = {c: {"source_column": c, "transform": "direct"} for c in columns}
    warehouse = etl.Warehouse.at(spark, home)
    streams.ingest_uploads(
        arriving, same, warehouse, fx.AS_OF, ["o", "n", "code"], scratch_path(spark, "offsets")).awaitTermination()
    table = warehouse.incidents.read().filter(~F.col("incident_code").startswith("ANO-"))
    return table.select("incident_code", "supplier_ref", "severity")
