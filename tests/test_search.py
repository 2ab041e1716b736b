import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskspark.operators import retrieval as r
from riskspark.session import scratch_path

TEXTS = [
    "Supplier SUP-001 has critical delivery delays in Shanghai.",
    "Inventory stockout risk for electronics components, electronics demand is high.",
    "Weather disruption at the port delays shipment of supplier goods. Delays, delays!",
    "",
    "Supplier audit passed.",
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


@pytest.fixture(scope="module")
def index(spark, docs):
    return r.build_index(docs, scratch_path(spark, "idx"))


def brute_bm25(query):
    words = [re.findall("[a-z0-9]+", t.lower()) for t in TEXTS]
    n, mean = len(words), sum(map(len, words)) / len(words)
    df = Counter(w for ws in words for w in set(ws))
    raw = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    idf = {w: floor if x < 0 else x for w, x in raw.items()}
    out = []
    for i, ws in enumerate(words):
        tf = Counter(ws)
        score = sum(
            idf.get(q, 0) * tf[q] * 2.5 / (tf[q] + 1.5 * (0.25 + 0.75 * len(ws) / mean))
            for q in re.findall("[a-z0-9]+", query.lower()))
        if score > 0:
            out.append((-round(score, 9), i))
    return [(i, -s) for s, i in sorted(out)]


def test_bm25_equals_brute_force(spark, index):
    asked = ["supplier delays delays", "electronics stockout", "nothing here matches xyz", "!!!", "port"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")
    rows = r.bm25_search(queries, index, 3).collect()
    for i, q in enumerate(asked):
        got = [(x.doc_id, x.score) for x in sorted(rows, key=lambda x: x.rank) if x.query_id == i]
        assert got == [(d, pytest.approx(s)) for d, s in brute_bm25(q)[:3]]


def test_empty_index(spark, docs):
    index = r.build_index(docs.limit(0), scratch_path(spark, "idx"))
    queries = spark.createDataFrame([(1, "supplier")], "query_id long, text string")
    assert r.bm25_search(queries, index).count() == 0


def ranked(spark, *lists):
    schema = "query_id int, doc_id string, rank int"
    return [spark.createDataFrame([(1, d, i) for i, d in enumerate(ids)], schema) for ids in lists]


def test_fusion(spark):
    fused = r.fuse(ranked(spark, ["a", "b", "c"], ["c", "d"])).orderBy("rank").collect()
    # c is in both lists; b and d tie at 1/62 and b came first
    assert [x.doc_id for x in fused] == ["c", "a", "b", "d"]
    assert fused[0].score == pytest.approx(1 / 63 + 1 / 61)
    scores = [x.score for x in fused]
    assert scores == sorted(scores, reverse=True)
    assert r.fuse(ranked(spark, [], [])).count() == 0


def test_metadata_filter(spark):
    df = spark.createDataFrame(
        [("a", "critical", 2024), ("b", "high", 2024), ("c", "critical", 2023), ("d", None, 2024)],
        "doc_id string, severity string, year int").select("doc_id", F.struct("severity", "year").alias("metadata"))
    ids = lambda f: sorted(x.doc_id for x in r.apply_filter(df, f).collect())
    assert ids({"severity": "critical", "year": 2024}) == ["a"]
    assert ids({"severity": ["critical", "high"]}) == ["a", "b", "c"]
    assert ids({"severity": None, "date_from": "x", "year": 2023}) == ["c"]
    assert ids({}) == ids(None) == ["a", "b", "c", "d"]
    assert r.metadata_filter({"severity": None}) is None


def test_cosine_small_and_blocked_paths_agree(spark):
    rng = np.random.default_rng(2)
    d = [(i, rng.normal(size=8).tolist()) for i in range(300)] + [(300, [0.0] * 8)]
    d[17] = (17, d[5][1])
    q = [(i, rng.normal(size=8).tolist()) for i in range(30)] + [(30, d[5][1])]
    docs = spark.createDataFrame(d, "doc_id long, embedding array<double>")
    queries = spark.createDataFrame(q, "query_id long, embedding array<double>")
    in_order = lambda rows: sorted(rows, key=lambda x: (x.query_id, x.rank))
    small = in_order(r.cosine_search(queries, docs, 5).collect())
    blocked = in_order(r.cosine_search(queries, docs, 5, max_shipped=50).collect())
    assert small == blocked
    m = np.array([v for _, v in d[:-1]])
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    for qid, v in q:
        s = np.round(unit @ (np.array(v) / np.linalg.norm(v)), 9)
        best = sorted(range(300), key=lambda i: (-s[i], i))[:5]
        assert [x.doc_id for x in small if x.query_id == qid] == best
    # equal vectors tie and the smaller id comes first
    assert [x.doc_id for x in small if x.query_id == 30][:2] == [5, 17]
    assert r.cosine_search(queries.limit(0), docs).count() == 0


def test_pivots_out_of_reach_are_left_out():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(10, 16))
    docs = r._unit((centres[rng.integers(0, 10, 500)] + rng.normal(size=(500, 16)) * 0.02).tolist())
    pivots = docs[:32]
    near = docs @ pivots.T
    at = near.argmax(axis=1)
    widest = np.array([np.arccos(np.clip(near[at == i, i].min(initial=1), -1, 1)) if (at == i).any() else -np.inf for i in range(32)])
    pdf = pd.DataFrame({"query_id": range(100), "embedding": docs[:100].tolist()})
    met = next(iter(r._reaching(docs, pivots, widest, 5)([pdf])))
    assert met["pivots"].map(len).mean() < 10
    for i in range(100):
        best = np.argsort(-(docs @ docs[i]))[:5]
        assert set(at[best]) <= set(met["pivots"][i])


@pytest.mark.parametrize("shipped, vectors", [(1000, 40), (50, 1000)])
def test_cosine_of_clustered_vectors(spark, shipped, vectors):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 6))
    d = [(f"d{i:04}", v) for i, v in enumerate((centres[rng.integers(0, 12, 1500)] + rng.normal(size=(1500, 6)) * 0.05).tolist())]
    docs = spark.createDataFrame(d, "doc_id string, embedding array<double>").repartition(5)
    q = [(i, v) for i, v in enumerate(centres.tolist())]
    rows = r.cosine_search(spark.createDataFrame(q, "query_id int, embedding array<double>"), docs, 7, shipped, vectors).collect()
    unit = r._unit([v for _, v in d])
    for i, v in q:
        s = np.round(unit @ r._unit([v])[0], 9)
        best = sorted(range(1500), key=lambda j: (-s[j], d[j][0]))[:7]
        assert [x.doc_id for x in sorted(rows, key=lambda x: x.rank) if x.query_id == i] == [d[j][0] for j in best]


def test_embedding(spark, docs):
    vectors = {x.doc_id: np.array(x.embedding) for x in r.embed(docs).collect()}
    assert all(np.isclose(np.linalg.norm(v), 1) for i, v in vectors.items() if i != 3)
    assert not vectors[3].any()
    custom = r.embed(docs, lambda texts: np.array([[len(t)] for t in texts], dtype=float), max_chars=10)
    assert {x.doc_id: x.embedding for x in custom.collect()}[0] == [10.0]


def test_rerank_with_scorer(spark, docs, index):
    queries = spark.createDataFrame([(1, "supplier")], "query_id long, text string")
    pool = spark.createDataFrame([(1, i, i) for i in range(5)], "query_id long, doc_id long, rank int")

    def shorter_is_better(q: pd.Series, d: pd.Series) -> pd.Series:
        return -d.str.len().astype(float)

    got = r.rerank(queries, pool, index, 2, docs=docs, scorer=shorter_is_better).orderBy("rank").collect()
    assert [x.doc_id for x in got] == [3, 4]
    plain = r.rerank(queries, pool, index, 5).orderBy("rank").collect()
    # documents with the word come first, each group in the order of the pool
    assert [x.doc_id for x in plain] == [0, 2, 4, 1, 3]


def test_hybrid_and_agent_rows(spark, docs, index):
    queries = spark.createDataFrame([(1, "supplier delays"), (2, "zzz")], "query_id long, text string")
    q = queries.join(r.embed(queries, key="query_id"), "query_id")
    d = docs.join(r.embed(docs), "doc_id").withColumn(
        "metadata", F.struct(F.when(F.col("doc_id") < 2, "record").otherwise("summary").alias("chunk_type")))
    found = r.hybrid_search(q, d, index, 3)
    assert found.filter("query_id = 1").count() == 3
    only = r.hybrid_search(q, d, index, 5, filters={"chunk_type": "record"}, filter_both=True)
    assert {x.doc_id for x in only.collect()} <= {0, 1}
    rows = {x.query_id: x for x in r.for_agent(found.filter("query_id = 1"), queries).collect()}
    assert rows[1].total_retrieved == 3 and rows[2].total_retrieved == 0 and rows[2].documents == []


def test_topic_filter(spark):
    rows = [(1, 0, "nothing", 0), (1, 1, "the SUPPLIER", 1), (2, 2, "x", 0), (2, 3, "y", 1)]
    df = spark.createDataFrame(rows, "query_id int, doc_id int, text string, rank int")
    got = r.topic_filter(df, "supplier_risk").collect()
    assert sorted(x.doc_id for x in got) == [1, 2, 3]


def brute_context(docs, prefer, limit):
    if not docs:
        return r.NO_CONTEXT
    ordered = sorted(docs, key=lambda d: (d[3] != prefer, -d[2])) if prefer else docs
    parts, total = [], 0
    for text, _, _, _ in ordered:
        if total + len(text) > limit:
            if limit - total > 300:
                parts.append(text[:limit - total] + "\n[...truncated]")
            break
        parts.append(text)
        total += len(text)
    return "\n\n" + "─" * 60 + "\n\n".join(parts)


@pytest.mark.parametrize("prefer", [None, "b"])
@pytest.mark.parametrize("limit", [3000, 1000, 700, 100])
def test_context_budget(spark, prefer, limit):
    docs = [("a" * 600, 0, 0.9, "a"), ("b" * 90, 1, 0.8, "b"), ("c" * 900, 2, 0.7, "a"), ("d", 3, 0.6, "b")]
    df = spark.createDataFrame([(1, *d) for d in docs],
                               "query_id int, text string, rank int, score double, incident_category string")
    queries = spark.createDataFrame([(1,), (2,)], "query_id int")
    got = {x.query_id: x.context for x in r.build_context(queries, df, prefer, limit).collect()}
    assert got == {1: brute_context(docs, prefer, limit), 2: r.NO_CONTEXT}


def test_token_budget(spark):
    df = spark.createDataFrame(
        [(1, "one two, three", 0), (1, "four five six", 1), (1, "seven", 2)], "query_id int, text string, rank int")
    got = r.pack_to_budget(df, 6).first()
    assert got.packed == "one two, three\n\n---\n\nfour five\n[...truncated to fit context budget]" and got.used == 6
    assert r.pack_to_budget(df, 100).first().packed.count("---") == 2
    counts = spark.range(1).select(r.count_tokens(F.lit("")), r.count_tokens(F.lit("a-b c"))).first()
    assert tuple(counts) == (0, 4)


def test_search_reads_only_partitions_of_its_terms(spark):
    docs = spark.createDataFrame([(i, f"word{i} common text") for i in range(300)], "doc_id long, text string")
    index = r.build_index(docs, scratch_path(spark, "index"))
    queries = spark.createDataFrame([(1, "word7")], "query_id int, text string")
    found = r.bm25_search(queries, index)
    assert [x.doc_id for x in found.collect()] == [7]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan)
