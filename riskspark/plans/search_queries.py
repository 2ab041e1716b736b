"""Registered queries: tokens, keyword index, vectors, fusion, rerank, context."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskspark import schema
from riskspark.operators import retrieval as r
from riskspark.operators.keyword import term_counts
from riskspark.plans import etl, sql
from riskspark.plans.registry import query
from riskspark.plans.sql import oracle
from riskspark.session import landed, scratch_exists, scratch_path
from riskspark.sources import fixtures as fx

R6 = lambda c: F.round(c, 6).alias(c)


_INDEXES: dict[tuple[str, str], str] = {}


def _index(spark, sf):
    """The index of a folder's documents, built once for an application while its files are there."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _INDEXES or not scratch_exists(spark, f"{_INDEXES[key]}/term_stats/_SUCCESS"):
        _INDEXES[key] = scratch_path(spark, "index")
        r.build_index(fx.documents(spark, sf), _INDEXES[key])
    return r.KeywordIndex.load(spark, _INDEXES[key])


def _keyword(spark, sf, k=r.KEYWORD_K):
    return r.bm25_search(fx.search_queries(spark, sf), _index(spark, sf), k)


@query("bm25_tokens", oracle("""
SELECT term, count(*) AS n, count(DISTINCT doc_id) AS docs
FROM (SELECT doc_id, unnest(terms) AS term FROM doc_tokens) GROUP BY term"""))
def bm25_tokens(spark, sf):
    return term_counts(fx.documents(spark, sf))


@query("bm25_statistics", oracle("SELECT term, df, round(idf, 6) AS idf FROM terms"))
def bm25_statistics(spark, sf):
    return r.index_frames(fx.documents(spark, sf)).term_stats.select("term", "df", R6("idf"))


@query("bm25_postings", oracle("SELECT term, doc_id, tf, dl FROM postings"))
def bm25_postings(spark, sf):
    return r.index_frames(fx.documents(spark, sf)).postings.select("term", "doc_id", "tf", "dl")


@query("bm25_search", oracle("SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM keyword"))
def bm25_search(spark, sf):
    return _keyword(spark, sf).withColumn("score", F.round("score", 6))


@query("search_warehouse", oracle(
    "SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM keyword"))
def search_warehouse(spark, sf):
    """Searches the loaded index after two uploads, of which the second replaces every third document."""
    docs = fx.documents(spark, sf).select(F.col("doc_id").alias("chunk_id"), F.lit("record").alias("chunk_type"), "text")
    third = F.pmod(F.xxhash64("chunk_id"), F.lit(3)) == 0
    warehouse = etl.Warehouse.at(spark, scratch_path(spark, "warehouse"))
    before = docs.withColumn("text", F.when(third, F.concat_ws(" ", F.lit("old text of"), F.reverse("text"))).otherwise(F.col("text")))
    etl.replace_documents(before, warehouse)
    etl.replace_documents(docs.filter(third), warehouse)
    return warehouse.search(fx.search_queries(spark, sf)).withColumn("score", F.round("score", 6))


@query("embed_hash", oracle("""
SELECT d.doc_id, i AS dim, round(coalesce(v.val / v.norm, 0), 6) + 0.0 AS x
FROM (SELECT doc_id, unnest(range(64)) AS i FROM documents) d
LEFT JOIN (SELECT * FROM doc_vectors WHERE norm > 0) v ON v.doc_id = d.doc_id AND v.dim = d.i"""))
def embed_hash(spark, sf):
    vectors = r.embed(fx.documents(spark, sf))
    return vectors.select("doc_id", F.posexplode("embedding").alias("dim", "x")).select(
        "doc_id", F.col("dim").cast("bigint").alias("dim"), (F.round("x", 6) + 0.0).alias("x"))


_CENTROIDS = """
SELECT label AS query_id, list(m ORDER BY i) AS v FROM (
  SELECT label, i, avg(x::DOUBLE) AS m FROM (
    SELECT label, unnest(range(64)) AS i, unnest(embedding) AS x FROM embeddings) GROUP BY label, i) GROUP BY label"""
_COSINE = f"""
SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) - 1 AS rank FROM (
    SELECT query_id, vec_id AS doc_id, list_cosine_similarity(v, embedding::DOUBLE[]) AS score
    FROM ({_CENTROIDS}) CROSS JOIN embeddings WHERE {{where}})) WHERE rank < 15"""


@query("retrieve_cosine", _COSINE.format(where="true"))
def retrieve_cosine(spark, sf):
    found = r.cosine_search(fx.label_centroids(spark, sf), fx.vectors(spark, sf))
    return found.select(F.col("query_id").cast("int").alias("query_id"), "doc_id", R6("score"), "rank")


@query("retrieve_filtered", _COSINE.format(where="label % 4 IN (0, 1) AND 2020 + label % 3 = 2021"))
def retrieve_filtered(spark, sf):
    filters = {"severity": ["critical", "high"], "year": 2021, "region": None, "colour": "red"}
    docs = r.apply_filter(fx.vectors(spark, sf), filters)
    found = r.cosine_search(fx.label_centroids(spark, sf), docs)
    return found.select(F.col("query_id").cast("int").alias("query_id"), "doc_id", R6("score"), "rank")


def _semantic(spark, sf):
    return r.cosine_search(
        r.embed(fx.search_queries(spark, sf), key="query_id"), r.embed(fx.documents(spark, sf)))


@query("retrieve_semantic", oracle(
    "SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM semantic"))
def retrieve_semantic(spark, sf):
    return _semantic(spark, sf).withColumn("score", F.round("score", 6))


@query("retrieve_rrf", oracle(
    "SELECT query_id, doc_id, round(score, 9) AS score, CAST(rank AS INT) AS rank FROM fused"))
def retrieve_rrf(spark, sf):
    return r.fuse([_semantic(spark, sf), _keyword(spark, sf)]).select(
        "query_id", "doc_id", F.round("score", 9).alias("score"), "rank")


@query("rerank_overlap", oracle("""
SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before) - 1 AS rank FROM (
    SELECT p.query_id, p.doc_id, p.rank AS before, round(sum(idf), 9) AS score FROM keyword p
    JOIN (SELECT query_id, doc_id, idf FROM query_terms JOIN postings USING (term) JOIN terms USING (term)) t
      ON p.query_id = t.query_id AND p.doc_id = t.doc_id GROUP BY p.query_id, p.doc_id, p.rank)) WHERE rank < 10"""))
def rerank_overlap(spark, sf):
    index = _index(spark, sf)
    queries = fx.search_queries(spark, sf)
    return r.rerank(queries, r.bm25_search(queries, index), index).withColumn("score", F.round("score", 6))


def _hybrid(spark, sf):
    queries = fx.search_queries(spark, sf)
    vectors = r.embed(queries, key="query_id")
    return r.hybrid_search(queries.join(vectors, "query_id"), r.embed(fx.documents(spark, sf)), _index(spark, sf))


@query("retrieve_hybrid", oracle(
    "SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM reranked"))
def retrieve_hybrid(spark, sf):
    return _hybrid(spark, sf).withColumn("score", F.round("score", 6))


def _hybrid_some(spark, sf):
    """Hybrid search whose vector side sees chunks of one type from some suppliers only."""
    queries = fx.search_queries(spark, sf)
    vectors = r.embed(queries, key="query_id")
    docs = fx.documents(spark, sf)
    metadata = F.struct(F.col("lang").alias("region"), F.col("source").alias("chunk_type"))
    docs = r.embed(docs).join(docs.select("doc_id", metadata.alias("metadata")), "doc_id")
    filters = {"region": ["de", "fr"], "chunk_type": "src0"}
    return r.hybrid_search(queries.join(vectors, "query_id"), docs, _index(spark, sf), filters=filters)


@query("retrieve_hybrid_filtered", oracle(
    "SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM reranked_some"))
def retrieve_hybrid_filtered(spark, sf):
    return _hybrid_some(spark, sf).withColumn("score", F.round("score", 6))


@query("retrieve_for_agent", oracle("""
SELECT item_id AS query_id, text AS query, coalesce(documents, '') AS documents, coalesce(scores, '') AS scores,
  coalesce(n, 0) AS total_retrieved
FROM benchmark LEFT JOIN (SELECT query_id, string_agg(doc_id::VARCHAR, ',' ORDER BY rank) AS documents,
    string_agg(printf('%.4f', score), ',' ORDER BY rank) AS scores, CAST(count(*) AS INT) AS n
  FROM reranked_some GROUP BY query_id) ON query_id = item_id"""))
def retrieve_for_agent(spark, sf):
    packed = r.for_agent(_hybrid_some(spark, sf), fx.search_queries(spark, sf))
    ids = F.array_join(F.transform("documents", lambda x: x.cast("string")), ",")
    scores = F.array_join(F.transform("scores", lambda x: F.format_string("%.4f", x)), ",")
    return packed.select("query_id", "query", ids.alias("documents"), scores.alias("scores"), "total_retrieved")


def _texts(spark, sf):
    """Ten best keyword matches per query with their whole texts."""
    docs = fx.documents(spark, sf).select("doc_id", "text", F.col("source").alias("incident_category"))
    # written, so that the join with the texts is planned by its size
    return landed(_keyword(spark, sf, 10), "found").join(docs, "doc_id")


def _topic(agent):
    words, limit = schema.AGENT_TOPICS[agent]
    return f"""
SELECT query_id, doc_id, on_topic FROM (
  SELECT *, max(on_topic) OVER (PARTITION BY query_id) AS any_topic FROM (
    SELECT query_id, doc_id, rank, regexp_matches(lower(text), '{"|".join(words)}') AS on_topic FROM keyword_texts))
WHERE on_topic OR NOT any_topic QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= {limit}"""


for _agent in schema.AGENT_TOPICS:

    @query(f"retrieve_topic_{_agent}", oracle(_topic(_agent)))
    def retrieve_topic(spark, sf, agent=_agent):
        return r.topic_filter(_texts(spark, sf), agent).select("query_id", "doc_id", "on_topic")


_RULE = "chr(10) || chr(10) || repeat('─', 60)"


@query("retrieve_context", oracle(f"""
SELECT item_id AS query_id, CASE WHEN parts IS NULL THEN '{r.NO_CONTEXT}' ELSE context END AS context,
  coalesce(parts, 0) AS parts
FROM benchmark LEFT JOIN (
SELECT query_id, {_RULE} || string_agg(part, chr(10) || chr(10) ORDER BY pos) AS context,
  CAST(count(part) AS INT) AS parts
FROM (SELECT query_id, pos, CASE WHEN used + length(text) <= 3000 THEN text WHEN 3000 - used > 300
      THEN substr(text, 1, CAST(3000 - used AS BIGINT)) || chr(10) || '[...truncated]' END AS part FROM (
  SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY query_id ORDER BY (source = 'src3') DESC, score DESC, rank
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
    row_number() OVER (PARTITION BY query_id ORDER BY (source = 'src3') DESC, score DESC, rank) AS pos
  FROM keyword_texts)) GROUP BY query_id) ON query_id = item_id"""))
def retrieve_context(spark, sf):
    queries, found = fx.search_queries(spark, sf), _texts(spark, sf)
    return r.build_context(queries, found, prefer="src3")


_TOK = r"\s*(?:[A-Za-z0-9_]+|[^A-Za-z0-9_\s])"


@query("pack_tokens", oracle(rf"""
SELECT query_id, string_agg(part, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS packed,
  CAST(sum(least(n, lft)) AS BIGINT) AS used
FROM (SELECT *, CASE WHEN n <= lft THEN text ELSE array_to_string(list_slice(toks, 1, CAST(lft AS BIGINT)), '')
      || chr(10) || '[...truncated to fit context budget]' END AS part FROM (
  SELECT *, 500 - coalesce(sum(n) OVER (PARTITION BY query_id ORDER BY rank
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft FROM (
    SELECT *, regexp_extract_all(text, '{_TOK}') AS toks, len(regexp_extract_all(text, '{_TOK}')) AS n
    FROM keyword_texts)) WHERE lft > 0) GROUP BY query_id"""))
def pack_tokens(spark, sf):
    return r.pack_to_budget(_texts(spark, sf), 500)
