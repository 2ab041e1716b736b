import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from riskspark.operators import analytics, querylog
from riskspark.plans import etl
from riskspark.session import scratch_path
from riskspark.streaming import streams

T0 = datetime(2024, 1, 1)


def test_guard(spark):
    texts = ["What are the supplier risks?", "hi", "x" * 2001, "SELECT * FROM incidents; DROP TABLE users;",
             "risks <script>alert(1)</script>", "What     are    the    risks?", "the selection of unions"]
    df = spark.createDataFrame([(t,) for t in texts], "query_text string")
    got = [(r.reason, r.clean) for r in querylog.guard_queries(df).collect()]
    assert [g[0] for g in got] == [None, "too_short", "too_long", "disallowed", "disallowed", None, None]
    assert got[5][1] == "What  are  the  risks?"


def brute_repeats(rows, ttl=600):
    last, hits = {}, {}
    for key, ts, ident in sorted(rows, key=lambda r: (r[1], r[2])):
        hit = key in last and ts < last[key] + timedelta(seconds=ttl)
        hits[ident] = hit
        if not hit:
            last[key] = ts
    return hits


@pytest.mark.parametrize("chunk, fan", [(600, 64), (600, 2), (700, 3), (1700, 64), (3600, 2)])
def test_repeats_equal_brute_force(spark, monkeypatch, chunk, fan):
    """With a small fan, no task sees more than a few of a key's reductions."""
    monkeypatch.setattr(querylog, "FAN", fan)
    rng = random.Random(chunk)
    rows = []
    for i in range(3000):
        # one key holds most of the log; seconds repeat so that ties occur
        key = "hot" if rng.random() < 0.7 else rng.choice("abc")
        rows.append((key, T0 + timedelta(seconds=rng.randrange(0, 40000)), i))
    rows += [("edge", T0 + timedelta(seconds=s), 9000 + s) for s in (0, 599, 600, 1199, 1200, 1201)]
    df = spark.createDataFrame(rows, "key string, ts timestamp_ntz, event_id long").repartition(5)
    got = {r.event_id: r.hit for r in querylog.mark_repeats(df, chunk_seconds=chunk).collect()}
    assert got == brute_repeats(rows)


def test_repeats_of_an_empty_log(spark):
    df = spark.createDataFrame([], "key string, ts timestamp_ntz, event_id long")
    assert querylog.mark_repeats(df).count() == 0


def test_judge_and_metrics(spark):
    df = spark.createDataFrame(
        [("s", 9.0, 8.0, 8.0, 9.0, None), ("s", None, None, None, None, None), ("t", 1.0, 1.0, 1.0, 1.0, 7.5),
         ("u", 1.0, 1.0, 1.0, 1.0, 3.0)],
        "session_id string, feasibility double, specificity double, impact double, timeline_realism double, "
        "overall_score double")
    judged = querylog.judge(df)
    assert [(r.overall, r.verdict) for r in judged.collect()] == [
        (8.5, "APPROVED"), (5.0, "NEEDS_REVISION"), (7.5, "APPROVED"), (3.0, "REJECTED")]
    got = {r.session_id: (r.overall_score, r.verdict) for r in querylog.session_verdict(judged).collect()}
    assert got == {"s": (6.75, "NEEDS_REVISION"), "t": (7.5, "APPROVED"), "u": (3.0, "REJECTED")}
    m = spark.createDataFrame(
        [(0.85, 0.9, 0.78, None), (None, None, None, None), (0.7, 0.79, 0.9, 0.9)],
        "answer_relevancy double, faithfulness double, contextual_recall double, contextual_precision double")
    assert [(r.average_score, r.passed) for r in querylog.metric_rollup(m).collect()] == [
        (0.8433, True), (None, True), (0.8225, False)]
    assert querylog.radar(m).first().answer_relevancy == round(1.55 / 3, 3)


def test_costs_and_latency(spark):
    row = spark.range(1).select(
        querylog.model_cost(F.lit(1000), F.lit(500), F.lit("gpt-4o")).alias("a"),
        querylog.model_cost(F.lit(1000), F.lit(500), F.lit("unknown")).alias("b"),
        querylog.latency_ms(F.lit(T0).cast("timestamp_ntz"),
                            F.lit(T0 + timedelta(seconds=1.5)).cast("timestamp_ntz")).alias("ms"),
        querylog.latency_ms(F.lit(T0).cast("timestamp_ntz"), F.lit(None).cast("timestamp_ntz")).alias("none"),
    ).first()
    assert row.a == row.b == pytest.approx(0.0125) and row.ms == 1500 and row.none is None


def test_agent_stats_defaults(spark):
    sessions = spark.createDataFrame(
        [("s1", T0, 5.0), ("s2", T0 - timedelta(days=30), None)],
        "session_id string, created_at timestamp_ntz, evaluation_score double")
    traces = spark.createDataFrame(
        [("s1", "retrieval", "agent_completed", 100.0, 10), ("s1", "retrieval", "agent_completed", 0.0, 0),
         ("s1", "retrieval", "agent_error", 0.0, 0), ("s2", "evaluator", "agent_completed", 5.0, 1)],
        "session_id string, agent string, type string, elapsed_ms double, tokens_used long")
    got = {r.agent_name: r for r in querylog.agent_stats(sessions, traces, T0 + timedelta(hours=3)).collect()}
    assert len(got) == 6
    assert (got["retrieval"].avg_latency_ms, got["retrieval"].total_calls, got["retrieval"].error_rate,
            got["retrieval"].is_estimated) == (100.0, 1, 1.0, False)
    assert (got["evaluator"].avg_latency_ms, got["evaluator"].total_calls, got["evaluator"].is_estimated) == (
        2500.0, 1, True)


def test_trace_parts_round_trip(spark):
    rows = [(i, "hot" if i % 10 else "cold", "retrieval", "agent_completed", "completed", 1.0, i, T0) for i in range(500)]
    traces = spark.createDataFrame(
        rows, "event_id long, session_id string, agent string, type string, status string, elapsed_ms double, "
              "tokens_used long, ts timestamp_ntz")
    parts = querylog.trace_parts(traces, size=50)
    assert parts.filter("session_id = 'hot'").count() > 5
    assert parts.agg(F.max(F.size("events"))).first()[0] < 100
    assert querylog.trace_events(parts).agg(F.sum("tokens_used")).first()[0] == sum(range(500))


def test_kpis_of_empty_tables(spark):
    inc = spark.createDataFrame([], "resolution_status string, impact_score double, shipment_status string, severity string")
    row = analytics.incident_kpis(inc).first()
    assert (row.total_incidents, row.overall_risk_score, row.on_time_rate) == (0, 50.0, 0.0)
    sup = spark.createDataFrame([], "risk_level string, reliability_score double")
    assert analytics.supplier_kpis(sup).first().pct_healthy == 0.0


def test_page_total(spark):
    df = spark.range(100)
    rows = analytics.page(df.filter("id >= 10"), [F.col("id").desc()], 5, 3).collect()
    assert [(r.id, r.total) for r in rows] == [(94, 90), (93, 90), (92, 90)]


EVENTS = "key string, ident long, ts timestamp_ntz"


def write_batches(spark, path, batches, schema):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_stream_repeats_span_batches(spark):
    path = scratch_path(spark, "in")
    rng = random.Random(8)
    rows = [(rng.choice("ab"), i, T0 + timedelta(seconds=i * 40)) for i in range(300)]
    batches = [rows[i:i + 60] for i in range(0, 300, 60)]
    write_batches(spark, path, batches, EVENTS)
    schema = spark.read.parquet(path).schema
    stream = streams.read_files(spark, path, schema, files_per_trigger=1)
    got = {r.ident: r.hit for r in streams.drain(streams.suppress_repeats(stream)).collect()}
    assert got == brute_repeats([(k, t, i) for k, i, t in rows])


def test_stream_drops_late_events(spark):
    path = scratch_path(spark, "in")
    row = lambda h, n: ("retrieval", "agent_completed", 10.0, n, T0 + timedelta(hours=h))
    write_batches(spark, path, [[row(0, 1), row(5, 2)], [row(9, 4)], [row(0, 100), row(20, 8)]],
                  "agent string, type string, elapsed_ms double, tokens_used long, ts timestamp_ntz")
    stream = streams.read_files(spark, path, spark.read.parquet(path).schema, files_per_trigger=1)
    rows = streams.drain_final(streams.agent_metrics(stream)).collect()
    # the event of hour 0 that comes after hour 9 was seen is dropped
    assert sorted((r.window_start.hour, r.tokens) for r in rows) == [(0, 1), (5, 2), (9, 4), (20, 8)]


def test_drop_folder_ingest(spark, tmp_path):
    columns = ["supplier_id", "supplier_name", "sku", "inventory_level", "demand_forecast", "delivery_delay_days",
               "defect_rate", "transportation_cost", "warehouse_location", "timestamp"]
    header = ",".join(["n", *columns])
    (tmp_path / "in").mkdir()
    line = lambda n, s, k: f"{n},{s},Name {s},{k},10,100,{n},0.1,5,Oslo,2024-01-0{n}"
    (tmp_path / "in" / "1.csv").write_text("\n".join([header, line(1, "A", "K1"), line(2, "A", "K2")]) + "\n")
    same = {c: {"source_column": c, "transform": "direct"} for c in columns}
    home = etl.Warehouse.at(spark, str(tmp_path / "home"))

    def run():
        ddl = ", ".join(f"`{c}` string" for c in ["n", *columns])
        arriving = streams.read_files(spark, str(tmp_path / "in"), ddl, fmt="csv", files_per_trigger=1)
        streams.ingest_uploads(arriving, same, home, T0, ["n"], str(tmp_path / "offsets")).awaitTermination()

    run()
    assert sorted(r.incident_code for r in home.incidents.read().collect()) == ["K1", "K2"]
    (tmp_path / "in" / "2.csv").write_text("\n".join([header, line(3, "B", "K2"), line(4, "B", "K3")]) + "\n")
    run()
    codes = {r.incident_code: r.supplier_ref for r in home.incidents.read().collect()}
    assert codes == {"K1": "A", "K2": "A", "K3": "B"}
    assert home.suppliers.count() == 2


def test_saved_sessions_keep_trace_and_context(spark, monkeypatch):
    final = spark.createDataFrame(
        [("a", 0.5, T0), ("b", None, T0), ("none", 0.1, T0)], "session_id string, overall_score double, created_at timestamp_ntz").withColumns(
        {c: F.lit("x") for c in ("user_id", "query_text", "final_response", "risk_score", "recommendations")}
        | {"tokens_used": F.lit(1), "latency_ms": F.lit(2)})
    traces = spark.createDataFrame(
        [(i, "a" if i < 2500 else "b", T0 + timedelta(seconds=i), "done", "retrieval", "ok", 1.0, i) for i in range(2510)],
        "event_id long, session_id string, ts timestamp_ntz, type string, agent string, status string, elapsed_ms double, tokens_used long")
    retrieved = spark.createDataFrame([("a", r, r * 10, 1.0 / r) for r in range(1, 31)], "session_id string, rank int, doc_id long, score double")
    rows = querylog.saved_sessions(final, traces, retrieved).collect()
    found = {}
    for r in rows:
        found.setdefault(r.session_id, []).extend(e.event_id for e in r.agent_trace.events)
        # no array grows with the session
        assert len(r.agent_trace.events) < 1500
    assert {k: sorted(v) for k, v in found.items()} == {"a": list(range(2500)), "b": list(range(2500, 2510)), "none": []}
    context = {r.session_id: [d.doc_id for d in r.retrieval_context] for r in rows}
    assert context == {"a": [10 * i for i in range(1, 21)], "b": [], "none": []}


def test_streams_of_runs_and_events_are_joined(spark):
    final_path, trace_path = scratch_path(spark, "final"), scratch_path(spark, "traces")
    at = lambda m: T0 + timedelta(minutes=m)
    write_batches(spark, final_path, [[("a", at(10))], [("b", at(200))]], "session_id string, created_at timestamp_ntz")
    write_batches(spark, trace_path, [[("a", at(5), 1), ("b", at(190), 2), ("a", at(120), 3)], [("c", at(1), 4), ("b", at(201), 5)]],
                  "session_id string, ts timestamp_ntz, event_id long")
    streams_ = [streams.read_files(spark, p, spark.read.parquet(p).schema, files_per_trigger=1) for p in (final_path, trace_path)]
    rows = streams.drain(streams.session_traces(*streams_, within="1 HOUR")).collect()
    # event 3 is too far from its run, and run c never finished
    assert sorted((r.session_id, r.event_id) for r in rows) == [("a", 1), ("b", 2), ("b", 5)]
