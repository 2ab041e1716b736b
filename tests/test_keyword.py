"""Keyword search by upper bounds against plain sums over all postings."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from riskspark.operators import keyword as kw
from riskspark.session import scratch_path

N = 600


def corpus():
    rng = random.Random(5)
    rare = [f"r{i}" for i in range(150)]
    texts = []
    for i in range(N):
        words = ["all"] * rng.randrange(1, 4) + ["most"] * (rng.random() < 0.8) + ["some"] * (rng.random() < 0.3)
        words += [rare[min(int(rng.expovariate(0.05)), 149)] for _ in range(rng.randrange(1, 30))]
        rng.shuffle(words)
        texts.append(" ".join(words))
    return [*texts, "", texts[3], texts[3]]


TEXTS = corpus()
ASKED = ["all most r120", "all", "all all r1 r2", "r140 r141 r142 most some", "most some", "unknown", "", "r3 r5 all some r60"]


def plain(query, k):
    words = [t.split() for t in TEXTS]
    mean = sum(map(len, words)) / len(words)
    df = Counter(w for ws in words for w in set(ws))
    raw = {w: math.log(len(words) - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    idf = {w: floor if x < 0 else x for w, x in raw.items()}
    scored = []
    for i, ws in enumerate(words):
        tf = Counter(ws)
        score = sum(idf.get(q, 0) * tf[q] * 2.5 / (tf[q] + 1.5 * (0.25 + 0.75 * len(ws) / mean)) for q in query.split() if tf[q])
        if round(score, 9) > 0:
            scored.append((-round(score, 9), i))
    return [(i, -s) for s, i in sorted(scored)[:k]]


@pytest.fixture(scope="module")
def index(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    return kw.build_index(docs, scratch_path(spark, "idx"))


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame(list(enumerate(ASKED)), "query_id long, text string")


@pytest.mark.parametrize("k, seeds", [(5, 2000), (5, 40), (15, 0), (700, 2000)])
def test_bounded_search_equals_plain_sums(index, queries, k, seeds):
    found = {}
    for row in kw.bm25_search(queries, index, k, seeds).orderBy("query_id", "rank").collect():
        found.setdefault(row.query_id, []).append((row.doc_id, pytest.approx(row.score, abs=2e-9)))
    assert found == {i: want for i, q in enumerate(ASKED) if (want := plain(q, k))}


def test_blocks_bound_their_postings(index):
    postings = index.postings.join(index.blocks, ["term", "level"])
    assert postings.filter("tf > max_tf or dl < min_dl").count() == 0
    per_term = index.blocks.groupBy("term").agg(F.sum("n").alias("n")).join(index.term_stats, "term")
    assert per_term.filter("n <> df").count() == 0
    assert index.blocks.agg(F.sum("n")).first()[0] == index.postings.count()


def test_postings_of_a_frequent_term_meet_only_candidates(spark, index, monkeypatch):
    monkeypatch.setattr(kw, "OPTIONAL_SHARE", 0.8)
    asked = spark.createDataFrame([(0, "all r40 r45")], "query_id long, text string")
    plan = kw.search_plan(asked, index, k=3)
    optional = {r.term for r in plan.terms.filter("optional").collect()}
    assert "all" in optional and "r45" not in optional
    with_term = index.postings.filter("term = 'all'").count()
    candidates = plan.candidates.count()
    assert with_term == N + 2 and 3 <= candidates < with_term / 10
    # one posting for each candidate and optional term, whatever the term's number of postings
    assert plan.optional_postings.count() <= candidates * len(optional)
    by_doc = plan.optional_postings.select("doc_id").distinct()
    assert by_doc.join(plan.candidates, "doc_id", "left_anti").count() == 0


def test_blocks_of_low_impact_are_left_out(spark):
    # every document has the term; in 20 short ones it fills half of the text
    rows = [(i, "goods goods x" if i < 20 else "goods " + " ".join(f"w{j}" for j in range(200))) for i in range(300)]
    rows += [(i, "other") for i in range(300, 2000)]
    index = kw.build_index(spark.createDataFrame(rows, "doc_id long, text string"), scratch_path(spark, "idx"))
    plan = kw.search_plan(spark.createDataFrame([(0, "goods")], "query_id long, text string"), index, k=5)
    assert plan.candidates.count() == 20


def test_words_are_counted_where_the_text_is(spark):
    rows = [(1, "b a B, a"), (2, None), (None, "a"), (3, "é-x9 X9 K")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    postings = kw.index_frames(docs).postings
    assert "Exchange" not in postings._jdf.queryExecution().executedPlan().toString()
    found = {(r.term, r.doc_id, r.tf, r.dl) for r in postings.collect()}
    assert found == {("a", 1, 2, 4), ("b", 1, 2, 4), ("a", None, 1, 1), ("x9", 3, 2, 3), ("k", 3, 1, 3)}


def test_repeated_ids_add_up_by_length(spark):
    rows = [(1, "a b"), (1, "a c"), (1, "a"), (None, "a"), (None, "a")]
    postings = kw.index_frames(spark.createDataFrame(rows, "doc_id long, text string")).postings
    found = sorted(((r.term, r.doc_id, r.tf, r.dl) for r in postings.collect()), key=str)
    assert found == sorted([("a", 1, 2, 2), ("b", 1, 1, 2), ("c", 1, 1, 2), ("a", 1, 1, 1), ("a", None, 2, 1)], key=str)


def test_postings_of_a_bucket_are_dealt_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(kw, "TASK_WORDS", 10)
    docs = spark.range(2000).selectExpr("id AS doc_id", "'all same words' AS text")
    postings, lengths = kw.posting_frames(docs)
    sizes = kw.laid_out(postings, lengths).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.max("bucket")).collect()
    assert sum(r.n for r in sizes) == 6000 and max(r.n for r in sizes) < 600


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_term_counts_shuffle_one_row_per_term(spark):
    rows = [(1, "b a B, a"), (2, None), (None, "a"), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = kw.term_counts(docs)
    assert plan_of(found).count("Exchange") == 1  # by term
    assert sorted(map(tuple, found.collect())) == [("a", 3, 2), ("b", 2, 1)]


def test_term_counts_of_repeated_ids(spark):
    rows = [(1, "a b"), (1, "a c"), (1, "a"), (None, "a"), (None, "a x")]
    found = kw.term_counts(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, found.collect())) == [("a", 5, 2), ("b", 1, 1), ("c", 1, 1), ("x", 1, 1)]


def test_lengths_of_null_and_empty_texts(spark):
    rows = [(1, "b a B, a"), (2, None), (None, "é-x"), (3, "")]
    _, lengths = kw.posting_frames(spark.createDataFrame(rows, "doc_id long, text string"))
    assert "regexp" not in plan_of(lengths)
    assert {tuple(r) for r in lengths.collect()} == {(1, 4), (2, None), (None, 1), (3, 0)}


def test_pairs_of_queries_and_documents_are_not_shuffled(spark, index, queries):
    mean = index.doc_stats.agg(F.avg("dl")).first()[0]
    weighted = kw.query_terms(queries).join(index.term_stats, "term").withColumn("weight", F.col("qtf") * F.col("idf"))
    needed = weighted.join(index.blocks, "term").select("query_id", "term", "level", "weight")
    rest = queries.select("query_id", F.lit(0.0).alias("rest_most"), F.lit(0.0).alias("all_least"), F.lit(0.0).alias("bound"))
    impact = kw._impact(F.col("tf"), F.col("dl"), mean)
    sums = kw._able_sums(index.postings, needed, rest, impact, N, 5, block_queries=3, block_docs=100)
    found = {}
    for r in sums.collect():
        found.setdefault(r.query_id, {})[r.doc_id] = r.partial
    every = {}
    for r in kw._sums(index.postings, needed, impact).collect():
        every.setdefault(r.query_id, {})[r.doc_id] = r.partial
    assert found.keys() == every.keys()
    for q, of in every.items():
        kth = sorted(of.values())[-5]
        assert found[q] == {d: pytest.approx(of[d]) for d in found[q]}
        assert found[q].keys() >= {d for d, x in of.items() if x >= kth}
        # of some seven blocks of documents each gives back its best five and what ties with them
        assert len(of) < 100 or len(found[q]) < len(of) / 3
