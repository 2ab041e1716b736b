"""Query log: guarding, repeats, sessions, costs, agent statistics, evaluation roll-ups."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark import schema
from riskspark.functions.columns import exact_round, strip
from riskspark.operators.analytics import at, day_start, newest_sessions, snippet
from riskspark.operators.incidents import patch
from riskspark.operators.ordering import top_per_key
from riskspark.session import landed

# Limits and patterns a query text is checked against.
QUERY_MIN, QUERY_MAX = 5, 2000
DISALLOWED = (
    r"(?i)(--|;|\bDROP\b|\bSELECT\b|\bINSERT\b|\bDELETE\b|\bUPDATE\b|\bEXEC\b|\bUNION\b"
    r"|<script|javascript:|onerror=)"
)
CACHE_SECONDS = 600


def guard_queries(df: DataFrame, text: str = "query_text") -> DataFrame:
    """Adds ``reason`` (null when accepted) and ``clean`` (null when rejected)."""
    trimmed = strip(F.col(text))
    reason = (
        F.when(F.length(trimmed) < QUERY_MIN, "too_short")
        .when(F.length(trimmed) > QUERY_MAX, "too_long")
        .when(trimmed.rlike(DISALLOWED), "disallowed")
    )
    return df.withColumns(
        {"reason": reason, "clean": F.when(reason.isNull(), F.regexp_replace(trimmed, r"\s{3,}", "  "))})


def cache_key(query: Column, filters_json: Column | None = None) -> Column:
    """Key of a query: lower-cased trimmed text and the filters as JSON with sorted keys."""
    return F.md5(F.concat(strip(F.lower(query)), filters_json if filters_json is not None else F.lit("{}")))


def filters_json(filters: dict | None) -> str:
    return json.dumps(filters or {}, sort_keys=True)


# --- repeats ---------------------------------------------------------------------

_MICROS = 1_000_000


def _chain(ts: np.ndarray, ttl: int) -> np.ndarray:
    """For sorted times: index of the first event at least ``ttl`` later."""
    return np.searchsorted(ts, ts + ttl, side="left")


def _last_in_chunk(ts: np.ndarray, ttl: int) -> np.ndarray:
    """For each event taken as a miss: the last miss of the same chain in this chunk."""
    nxt, last = _chain(ts, ttl), np.arange(len(ts))
    step = np.append(nxt, len(ts))
    while True:
        ahead = step[last]
        moved = np.where(ahead < len(ts), ahead, last)
        if (moved == last).all():
            return last
        last = moved


def _whole_groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Batches of rows sorted by ``keys``, cut so that no group spans two batches, each with
    the positions where its groups begin and end."""
    rest: list[pd.DataFrame] = []  # the last group so far, joined once it has ended

    def borders(pdf: pd.DataFrame) -> np.ndarray:
        changed = np.ones(len(pdf), dtype=bool)
        changed[1:] = False
        for k in keys:
            values = pdf[k].to_numpy()
            changed[1:] |= values[1:] != values[:-1]
        return np.append(np.flatnonzero(changed), len(pdf))

    for pdf in frames:
        if pdf.empty:
            continue
        if rest and (pdf[keys].iloc[-1] == rest[0][keys].iloc[-1]).all():
            rest.append(pdf)
            continue
        pdf = pd.concat([*rest, pdf], ignore_index=True)
        cuts = borders(pdf)
        if len(cuts) > 2:
            yield pdf.iloc[: cuts[-2]], cuts[:-1]
        rest = [pdf.iloc[cuts[-2]:]]
    if rest:
        last = pd.concat(rest, ignore_index=True)
        yield last, np.array([0, len(last)])


FAN = 64  # reductions that one task composes or follows


def _chunks_of(pdf: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(chunk, enter, leave) of the rows of one group, which are sorted by chunk and entry."""
    chunk, enter, leave = (pdf[c].to_numpy() for c in ("_chunk", "enter", "leave"))
    borders = np.flatnonzero(np.diff(chunk)) + 1
    yield from zip(chunk[np.r_[0, borders]].tolist(), np.split(enter, borders), np.split(leave, borders))


def _composed(parts: list[tuple[int, np.ndarray, np.ndarray]], ttl: int) -> tuple[np.ndarray, np.ndarray]:
    """The reduction of neighbouring chunks. A chain that passes the first chunk by enters the
    second at its first entry: chunks are no shorter than the lifetime."""
    (_, enter, last), rest = parts[0], parts[1:]
    if rest:
        enter, last = np.append(enter, rest[0][1][0]), np.append(last, rest[0][1][0] - ttl)
    for _, begins, ends in rest:
        at = np.searchsorted(begins, last + ttl)
        on = at < len(begins)
        last[on] = ends[at[on]]
    keep = np.append(last[1:] != last[:-1], True)
    return enter[keep], last[keep]


def _entries(exits: DataFrame, ttl: int) -> DataFrame:
    """(_key, _chunk, _last): the last miss before each chunk, null if there is none."""

    def compose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, cuts in _whole_groups(frames, ["_key", "_group"]):
            out = []
            for begin, end in zip(cuts[:-1], cuts[1:]):
                part = pdf.iloc[begin:end]
                enter, leave = _composed(list(_chunks_of(part)), ttl)
                out.append(pd.DataFrame({"_key": part["_key"].iloc[0], "_chunk": part["_group"].iloc[0], "enter": enter,
                                         "leave": leave}))
            yield pd.concat(out)

    def follow(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, cuts in _whole_groups(frames, ["_key", "_group"]):
            out = []
            for begin, end in zip(cuts[:-1], cuts[1:]):
                part = pdf.iloc[begin:end]
                key, last = part["_key"].iloc[0], part["_last"].iloc[0]
                last = None if pd.isna(last) else int(last)
                for chunk, enter, leave in _chunks_of(part):
                    out.append((key, chunk, last))
                    at = 0 if last is None else int(np.searchsorted(enter, last + ttl))
                    last = int(leave[at]) if at < len(leave) else last
            yield pd.DataFrame(out, columns=["_key", "_chunk", "_last"]).astype({"_last": "Int64"})

    def grouped(level: DataFrame) -> DataFrame:
        return level.withColumn("_group", F.floor(F.col("_chunk") / FAN))

    def in_order(level: DataFrame) -> DataFrame:
        return level.repartition("_key", "_group").sortWithinPartitions("_key", "_group", "_chunk", "enter")

    levels = [exits]
    low, high = exits.agg(F.min("_chunk"), F.max("_chunk")).first()
    while high is not None and high - low >= FAN:
        up = in_order(grouped(levels[-1])).mapInPandas(compose, "_key string, _chunk bigint, enter bigint, leave bigint")
        levels.append(landed(up, "exits"))
        low, high = low // FAN, high // FAN
    entries = None
    for level in reversed(levels):
        if entries is None:  # few enough to be followed from the start
            rows = level.withColumns({"_group": F.lit(0).cast("bigint"), "_last": F.lit(None).cast("bigint")})
        else:
            rows = grouped(level).join(entries.withColumnRenamed("_chunk", "_group"), ["_key", "_group"])
        entries = in_order(rows).mapInPandas(follow, "_key string, _chunk bigint, _last bigint")
    return entries


def mark_repeats(
    df: DataFrame, key: str = "key", ts: str = "ts", ident: str = "event_id",
    ttl_seconds: int = CACHE_SECONDS, chunk_seconds: int = 3600,
) -> DataFrame:
    """Adds ``hit``: the last miss of the same key is less than ``ttl_seconds`` ago.

    A hit does not extend the lifetime, so each answer depends on the one before. The
    log is cut into chunks of time per key. Every chunk is first reduced to "if the
    chain enters here, it leaves there". ``FAN`` neighbouring reductions are composed into one,
    and these again, until a key has few; the times at which the chain enters are then handed
    down the same tree, and the chunks are marked independently. No task sees a key's whole log
    or all its reductions. ``ident`` breaks ties in time.
    """
    ttl, size = ttl_seconds * _MICROS, max(chunk_seconds, ttl_seconds) * _MICROS
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = df.withColumns({"_key": F.col(key).cast("string"), "_us": micros, "_chunk": F.floor(micros / size)})
    group = ["_key", "_chunk"]

    def reduce(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, cuts in _whole_groups(frames, group):
            us, chunks, names = pdf["_us"].to_numpy(), pdf["_chunk"].to_numpy(), pdf["_key"].to_numpy()
            out: dict[str, list] = {"_key": [], "_chunk": [], "enter": [], "leave": []}
            for begin, end in zip(cuts[:-1], cuts[1:]):
                t = np.unique(us[begin:end])
                n = min(len(t), int(np.searchsorted(t, chunks[begin] * size + ttl)) + 1)
                leave = t[_last_in_chunk(t, ttl)[:n]]
                # neighbouring entries with the same exit share one row, named by the later entry
                keep = np.append(leave[1:] != leave[:-1], True)
                out["enter"].append(t[:n][keep])
                out["leave"].append(leave[keep])
                out["_key"].append(np.repeat(names[begin], keep.sum()))
                out["_chunk"].append(np.repeat(chunks[begin], keep.sum()))
            yield pd.DataFrame({c: np.concatenate(parts) for c, parts in out.items()})

    columns = df.columns

    def mark(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, cuts in _whole_groups(frames, group):
            us, lasts, hit = pdf["_us"].to_numpy(), pdf["_last"].to_numpy(), np.ones(len(pdf), dtype=bool)
            for begin, end in zip(cuts[:-1], cuts[1:]):
                t, last = us[begin:end], lasts[begin]
                i = 0 if pd.isna(last) else int(np.searchsorted(t, int(last) + ttl))
                while i < len(t):
                    hit[begin + i] = False
                    i = int(np.searchsorted(t, t[i] + ttl))
            yield pdf[columns].assign(hit=hit)

    exits = landed(
        rows.select(*group, "_us").repartition(*group).sortWithinPartitions(*group, "_us")
        .mapInPandas(reduce, "_key string, _chunk bigint, enter bigint, leave bigint"), "exits")
    entries = _entries(exits, ttl)
    out = T.StructType([*df.schema.fields, T.StructField("hit", T.BooleanType())])
    return (
        rows.join(entries, group).repartition(*group).sortWithinPartitions(*group, "_us", ident)
        .mapInPandas(mark, out)
    )


# --- sessions --------------------------------------------------------------------

TRACE_PART = 1000  # events kept in one array


def session_rows(final_events: DataFrame) -> DataFrame:
    """Session rows from the final event of each run.

    final_events: session_id, user_id, query_text, tokens_used, latency_ms,
    overall_score, final_response, risk_score, recommendations, created_at.
    """
    return final_events.select(
        "session_id", "user_id", "query_text",
        F.struct("recommendations", "risk_score", "final_response").alias("result"),
        "tokens_used", "latency_ms",
        F.col("overall_score").cast("double").alias("evaluation_score"),
        "created_at",
    )


def trace_parts(traces: DataFrame, size: int = TRACE_PART) -> DataFrame:
    """(session_id, part, events): the trace of each session as arrays in time order.

    A long trace is split by a hash into parts of about ``size`` events, so no array
    grows with the session. traces: event_id, session_id and the trace fields.
    """
    counts = traces.groupBy("session_id").agg(F.ceil(F.count("*") / size).alias("parts"))
    part = F.pmod(F.xxhash64("event_id"), F.col("parts")).alias("part")
    events = F.array_sort(F.collect_list(F.struct(*TRACE_FIELDS)))
    return (
        traces.join(counts, "session_id")
        .select("session_id", part, *TRACE_FIELDS)
        .groupBy("session_id", "part")
        .agg(events.alias("events"))
    )


TRACE_FIELDS = ["ts", "event_id", "type", "agent", "status", "elapsed_ms", "tokens_used"]


def trace_events(parts: DataFrame) -> DataFrame:
    """Trace arrays back to one row per event."""
    return parts.select("session_id", F.inline("events"))


CONTEXT_DOCUMENTS = 20  # a session keeps as many of its retrieved documents


def saved_sessions(final_events: DataFrame, traces: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Session rows as they are stored, with the trace of the run and what was retrieved for it.

    traces: event_id, session_id and the trace fields; retrieved: session_id, rank, doc_id, score. A
    session with a long trace has a row for each part of it, numbered by ``part``; one without events
    or documents has one row with empty arrays. ``retrieval_context`` holds the best documents by rank.
    """
    best = top_per_key(retrieved, ["session_id"], ["rank", "doc_id"], CONTEXT_DOCUMENTS)
    context = best.groupBy("session_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "doc_id", "score"))).alias("retrieval_context"))
    parts = trace_parts(traces).withColumnRenamed("events", "_events")
    stored = session_rows(final_events).join(parts, "session_id", "left").join(context, "session_id", "left")
    empty = lambda c: F.coalesce(F.col(c), F.array().cast(stored.schema[c].dataType))
    return stored.select(
        *[c for c in session_rows(final_events).columns], F.coalesce("part", F.lit(0)).alias("part"),
        F.struct(empty("_events").alias("events")).alias("agent_trace"), empty("retrieval_context").alias("retrieval_context"))


def user_sessions(df: DataFrame, user_id: str, skip: int = 0, limit: int = 20) -> DataFrame:
    rows = df.filter(F.col("user_id") == user_id).orderBy(*newest_sessions())
    return (rows.offset(skip) if skip else rows).limit(limit)


def find_session(df: DataFrame, session_id: str, user_id: str) -> DataFrame:
    return df.filter((F.col("session_id") == session_id) & (F.col("user_id") == user_id))


def accept_feedback(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Appends feedback with a rating from 1 to 5; an empty comment becomes null."""
    valid = new.filter(F.col("overall_rating").between(1, 5) & F.col("helpful").isNotNull())
    return existing.unionByName(valid.withColumn("comment", F.nullif("comment", F.lit(""))))


# --- totals and series -----------------------------------------------------------


def token_cost(tokens: Column) -> Column:
    """Cost in USD with 70 % input and 30 % output tokens at the default prices."""
    price_in, price_out = schema.MODEL_PRICES["gpt-4o"]
    return tokens * 0.70 / 1000 * price_in + tokens * 0.30 / 1000 * price_out


def model_cost(prompt: Column, completion: Column, model: Column) -> Column:
    """Cost by model; an unknown model has the default prices."""
    default = schema.MODEL_PRICES["gpt-4o"]
    price_in, price_out = F.lit(default[0]), F.lit(default[1])
    for name, (i, o) in schema.MODEL_PRICES.items():
        price_in = F.when(model == name, i).otherwise(price_in)
        price_out = F.when(model == name, o).otherwise(price_out)
    return prompt / 1000 * price_in + completion / 1000 * price_out


def today_totals(df: DataFrame, as_of: datetime) -> DataFrame:
    tokens = F.coalesce(F.sum("tokens_used"), F.lit(0))
    return df.filter(F.col("created_at") >= day_start(as_of)).agg(
        F.count("*").alias("total_queries_today"),
        F.round(F.coalesce(F.avg("latency_ms"), F.lit(0.0)), 0).alias("avg_latency_ms"),
        F.round(F.avg("evaluation_score"), 2).alias("avg_evaluation_score"),
        tokens.alias("total_tokens_today"),
        F.round(token_cost(tokens), 4).alias("estimated_cost_today_usd"),
    )


def daily_series(df: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    since = df.filter(F.col("created_at") >= at(as_of - timedelta(days=days)))
    return since.groupBy(F.to_date("created_at").alias("date")).agg(
        F.count("*").alias("count"),
        F.round(F.coalesce(F.avg("evaluation_score"), F.lit(0.0)), 2).alias("score"),
    )


def agent_stats(
    sessions: DataFrame, traces: DataFrame, as_of: datetime, days: int = 7, newest: int = 50
) -> DataFrame:
    """Per-agent statistics from the newest traced sessions; defaults where nothing was measured."""
    today = sessions.filter(F.col("created_at") >= day_start(as_of)).agg(F.count("*")).scalar()
    recent = (
        sessions.filter(F.col("created_at") >= at(as_of - timedelta(days=days)))
        .join(traces.select("session_id").distinct(), "session_id", "left_semi")
        .orderBy(*newest_sessions())
        .limit(newest)
        .select("session_id")
    )
    elapsed, tokens = F.coalesce("elapsed_ms", F.lit(0.0)), F.coalesce("tokens_used", F.lit(0))
    timed = (F.col("type") == "agent_completed") & (elapsed > 0)
    # the session side has at most ``newest`` rows
    measured = traces.join(F.broadcast(recent), "session_id").groupBy("agent").agg(
        F.avg(F.when(timed, elapsed)).alias("latency"),
        F.count_if(timed).alias("calls"),
        F.count_if(F.col("type") == "agent_error").alias("errors"),
        F.avg(F.when(tokens > 0, tokens)).alias("tokens"),
    )
    agents = sessions.sparkSession.createDataFrame(
        list(schema.AGENT_LATENCY.items()), "agent string, default_ms int")
    calls = F.coalesce(F.nullif("calls", F.lit(0)), today)
    return agents.join(measured, "agent", "left").select(
        F.col("agent").alias("agent_name"),
        F.coalesce(F.round("latency", 0), F.col("default_ms").cast("double")).alias("avg_latency_ms"),
        calls.alias("total_calls"),
        F.round(F.coalesce("errors", F.lit(0)) / F.greatest(calls, F.lit(1)), 3).alias("error_rate"),
        F.coalesce(F.round("tokens", 0), F.lit(0.0)).alias("avg_tokens"),
        F.col("latency").isNull().alias("is_estimated"),
    )


def agent_stats_all_time(sessions: DataFrame, traces: DataFrame, limit: int | None = 200) -> DataFrame:
    """Statistics of completed events over the newest sessions, or all with ``limit=None``."""
    done = traces.filter(F.col("type") == "agent_completed")
    if limit is not None:
        newest = sessions.orderBy(*newest_sessions()).limit(limit).select("session_id")
        done = done.join(newest, "session_id", "left_semi")
    return done.groupBy(F.coalesce("agent", F.lit("unknown")).alias("agent_name")).agg(
        F.round(F.avg(F.coalesce("elapsed_ms", F.lit(0.0))), 0).alias("avg_latency_ms"),
        F.count("*").alias("total_calls"),
        F.round(F.avg(F.coalesce("tokens_used", F.lit(0))), 0).alias("avg_tokens"),
        F.lit(0.0).alias("error_rate"),
    )


def run_list(df: DataFrame, limit: int = 50) -> DataFrame:
    """The newest sessions in the shape of a run list."""
    run_id = F.coalesce("run_id", "session_id") if "run_id" in df.columns else F.col("session_id")
    return df.orderBy(*newest_sessions()).limit(limit).select(
        run_id.alias("run_id"),
        F.lit("supply-chain-query").alias("name"),
        F.when(F.col("evaluation_score").isNotNull(), "success").otherwise("completed").alias("status"),
        F.col("created_at").alias("start_time"),
        "latency_ms",
        F.col("tokens_used").alias("total_tokens"),
        snippet(F.col("query_text"), mark="…").alias("query_snippet"),
        F.lit("local_db").alias("source"),
    )


def latency_ms(start: Column, end: Column) -> Column:
    """Whole milliseconds between two times, null when one is missing."""
    return F.timestamp_diff("MILLISECOND", start, end)


# --- evaluation ------------------------------------------------------------------

JUDGE_SCORES = ["feasibility", "specificity", "impact", "timeline_realism"]


def _verdict(overall: Column) -> Column:
    return F.when(overall >= 7.5, "APPROVED").when(overall >= 5.0, "NEEDS_REVISION").otherwise("REJECTED")


def judge(df: DataFrame) -> DataFrame:
    """Adds ``overall`` and ``verdict``; a missing score counts 5, a missing overall is the mean."""
    scores = [F.coalesce(F.col(c), F.lit(5.0)) for c in JUDGE_SCORES]
    overall = F.coalesce(F.col("overall_score"), (scores[0] + scores[1] + scores[2] + scores[3]) / 4)
    return df.withColumns({"overall": exact_round(overall, 2), "verdict": _verdict(overall)})


def mean_of_decimals(c: Column, digits: int) -> Column:
    """Mean of numbers with few decimals, added up as integers so that the order of rows
    cannot move it across a rounding border."""
    factor = 10.0**digits
    return F.sum(F.rint(c * factor).cast("bigint")) / (F.count(c) * factor)


def session_verdict(judged: DataFrame) -> DataFrame:
    """One row per session from its judged recommendations; the worst verdict decides."""
    seen = lambda v: F.coalesce(F.bool_or(F.coalesce(F.col("verdict"), F.lit("NEEDS_REVISION")) == v), F.lit(False))
    rejected, approved, revise = seen("REJECTED"), seen("APPROVED"), seen("NEEDS_REVISION")
    return judged.groupBy("session_id").agg(
        exact_round(mean_of_decimals(F.coalesce("overall", F.lit(5.0)), 2), 2).alias("overall_score"),
        F.when(rejected, "REJECTED").when(approved & ~revise, "APPROVED").otherwise("NEEDS_REVISION")
        .alias("verdict"),
    )


def metric_rollup(df: DataFrame) -> DataFrame:
    """Adds ``average_score`` over the known metrics and ``passed`` against the thresholds."""
    metrics = list(schema.METRIC_THRESHOLDS)
    known = F.filter(F.array(*metrics), lambda x: x.isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda a, x: a + x)
    passed = F.lit(True)
    for m, threshold in schema.METRIC_THRESHOLDS.items():
        passed = passed & F.coalesce(F.col(m) >= threshold, F.lit(True))
    return df.withColumns(
        {"average_score": F.when(F.size(known) > 0, exact_round(total / F.size(known), 4)), "passed": passed})


def write_back(
    sessions: DataFrame, results: DataFrame, evaluated: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(sessions with score and verdict updated, results with the new rows appended)."""
    changes = evaluated.select(
        "session_id", F.col("average_score").alias("evaluation_score"), F.col("verdict").alias("judge_verdict"))
    base = sessions if "judge_verdict" in sessions.columns else sessions.withColumn(
        "judge_verdict", F.lit(None).cast("string"))
    return patch(base, changes, "session_id"), results.unionByName(evaluated.select(*results.columns))


def evaluation_summary(evaluated: DataFrame) -> DataFrame:
    return evaluated.agg(
        F.count("*").alias("sessions"),
        F.round(F.avg("average_score"), 6).alias("average_score"),
        F.round(F.count_if("passed") / F.greatest(F.count("*"), F.lit(1)), 6).alias("pass_rate"),
        F.count_if(F.col("verdict") == "APPROVED").alias("approved"),
    )


def radar(df: DataFrame) -> DataFrame:
    """Metric sums over all rows, so a missing score counts as 0."""
    metrics = ["answer_relevancy", "faithfulness", "contextual_recall"]
    return df.agg(
        *[
            F.round(F.coalesce(F.sum(m), F.lit(0.0)) / F.greatest(F.count("*"), F.lit(1)), 3).alias(m)
            for m in metrics
        ]
    )


def sessions_to_evaluate(df: DataFrame, session_id: str | None = None, limit: int = 20) -> DataFrame:
    if session_id:
        return df.filter(F.col("session_id") == session_id)
    return df.orderBy(*newest_sessions()).limit(limit)


def recommendation_counts(sessions: DataFrame) -> DataFrame:
    recs = F.col("recommendations")
    return sessions.select(
        "session_id",
        F.size(recs).alias("recommendations"),
        F.size(F.filter(recs, lambda r: r["priority"] == "P1")).alias("p1"),
    )
