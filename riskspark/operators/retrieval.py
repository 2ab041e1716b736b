"""Keyword, vector and hybrid search over batches of queries."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark import schema
from riskspark.operators.keyword import (  # noqa: F401  (the index is part of this module's surface)
    _SCORE_DIGITS, KEYWORD_K, KeywordIndex, _ranked, bm25_search, build_index, index_frames, query_terms)
from riskspark.operators.ordering import top_per_key
from riskspark.session import landed

# Fixed value: the rank-fusion constant.
RRF_K = 60
SEMANTIC_K, RERANK_POOL, TOP_K = 15, 20, 10


# --- vectors ---------------------------------------------------------------------

Encoder = Callable[[list[str]], np.ndarray]


class HashingEncoder:
    """Signed feature hashing of word counts, scaled to unit length."""

    def __init__(self, dims: int = 64):
        self.dims = dims

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims))
        seen: dict[str, tuple[int, float]] = {}
        for i, text in enumerate(texts):
            for word, n in Counter(re.findall("[a-z0-9]+", text.lower())).items():
                if word not in seen:
                    digest = hashlib.md5(word.encode()).hexdigest()
                    seen[word] = (int(digest[:8], 16) % self.dims, 1.0 if digest[8] < "8" else -1.0)
                dim, sign = seen[word]
                out[i, dim] += sign * n
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norms, out=out, where=norms > 0)


def embed(
    docs: DataFrame, encoder: Encoder | None = None, key: str = "doc_id", text: str = "text",
    max_chars: int | None = None, batch_size: int = 100,
) -> DataFrame:
    """(key, embedding). The encoder gets texts in batches inside the tasks; ``max_chars``
    serves encoders that cannot take whole texts."""
    encode = encoder or HashingEncoder()
    out = T.StructType([docs.schema[key], T.StructField("embedding", T.ArrayType(T.DoubleType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            texts = [t[:max_chars] if max_chars else t for t in pdf[text].fillna("")]
            vectors = [
                v.tolist() for i in range(0, len(texts), batch_size) for v in encode(texts[i:i + batch_size])]
            yield pd.DataFrame({key: pdf[key], "embedding": vectors})

    return docs.select(key, text).mapInPandas(run, out)


def _unit(rows) -> np.ndarray:
    m = np.array([np.asarray(r, dtype=np.float64) for r in rows])
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)


MAX_SHIPPED_VALUES = 1_000_000  # numbers of the queries that one task compares at a time (8 MB)
MAX_VECTORS = 1 << 15  # documents that one task compares at a time
PIVOTS, PIVOT_SAMPLE = 32, 1024
_MARGIN = 1e-8
MAX_SCORES = 2_000_000  # scores of a tile in a task's memory (16 MB)


def _best(doc_ids: np.ndarray, docs: np.ndarray, query_ids: list, queries: np.ndarray, k: int) -> pd.DataFrame:
    """The best k rows of one batch for every query, with ties to the smaller id. Queries are
    taken in slices, so that a tile of scores is bounded whatever their number."""
    tile = max(1, MAX_SCORES // max(1, len(doc_ids)))
    found = []
    for at in range(0, len(queries), tile):
        scores = np.round(queries[at:at + tile] @ docs.T, _SCORE_DIGITS)
        least = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else np.full(len(scores), -np.inf)
        row, col = np.nonzero(scores >= least[:, None])  # ties with the k-th best included
        order = np.lexsort((doc_ids[col], -scores[row, col], row))
        row, col = row[order], col[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        row, col = row[rank < k], col[rank < k]
        found.append(pd.DataFrame({"query_id": [query_ids[at + r] for r in row], "doc_id": doc_ids[col],
                                   "score": scores[row, col]}))
    return pd.concat(found, ignore_index=True)


def cosine_search(
    queries: DataFrame, docs: DataFrame, k: int = SEMANTIC_K, max_shipped: int = MAX_SHIPPED_VALUES,
    max_vectors: int = MAX_VECTORS,
) -> DataFrame:
    """(query_id, doc_id, score, rank from 0) by cosine similarity, exact.

    queries: query_id, embedding; docs: doc_id, embedding. Documents are kept by their nearest pivot, of
    a few taken from a bounded sample. A query's k-th best in that sample bounds its k-th best of all;
    pivots whose documents lie within too small an angle to reach it are left out. The others
    meet the query in blocks of at most ``max_vectors`` documents and ``max_shipped`` numbers of queries,
    dealt by a shuffle; each keeps its best k per query, so pairs never leave a task.
    """
    spark = docs.sparkSession
    out = T.StructType(
        [queries.schema["query_id"], docs.schema["doc_id"], T.StructField("score", T.DoubleType())])
    queries = landed(queries.select("query_id", "embedding"), "queries")
    vectors = landed(docs.select("doc_id", "embedding"), "vectors")  # encoded once
    size = queries.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dims")).first()
    sample = [r.embedding for r in vectors.orderBy(F.xxhash64("doc_id"), "doc_id").limit(PIVOT_SAMPLE).collect()]
    if not size.n or not sample:
        return _ranked(spark.createDataFrame([], out), k)
    sample = _unit(sample)
    pivots = sample[:PIVOTS]

    placed_as = T.StructType([*vectors.schema.fields, T.StructField("pivot", T.IntegerType()), T.StructField("near", T.DoubleType())])
    placed = vectors.mapInPandas(_placing(pivots), placed_as)
    # one row per pivot
    cells = {r.pivot: r for r in placed.groupBy("pivot").agg(F.count("*").alias("n"), F.min("near").alias("near")).collect()}
    widest = np.array([np.arccos(np.clip(cells[i].near, -1, 1)) if i in cells else -np.inf for i in range(len(pivots))])
    parts = np.array([-(-cells[i].n // max_vectors) if i in cells else 0 for i in range(len(pivots))])
    groups = math.ceil(size.n * size.dims / max_shipped)

    group = F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int").alias("group")
    reach_as = T.StructType([*queries.schema.fields, T.StructField("pivots", T.ArrayType(T.IntegerType()))])
    asked = queries.mapInPandas(_reaching(sample, pivots, widest, k), reach_as).select(
        "query_id", "embedding", group, F.explode("pivots").alias("pivot"))
    counts = F.array(*[F.lit(int(n)) for n in parts])
    asked = asked.select("query_id", "embedding", "group", "pivot", F.explode(
        F.sequence(F.lit(0), F.get(counts, F.col("pivot")) - 1)).alias("part"))
    held = placed.select(
        "doc_id", "embedding", "pivot", F.pmod(F.xxhash64("doc_id"), F.greatest(F.get(counts, F.col("pivot")), F.lit(1))).cast("int").alias("part"),
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))

    def compare(some: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        if not len(some) or not len(others):
            return pd.DataFrame({"query_id": some["query_id"][:0], "doc_id": others["doc_id"][:0], "score": np.zeros(0)})
        return _best(others["doc_id"].to_numpy(), _unit(others["embedding"]), list(some["query_id"]), _unit(some["embedding"]), k)

    block = ["pivot", "part", "group"]
    return _ranked(asked.groupBy(*block).cogroup(held.groupBy(*block)).applyInPandas(compare, out), k)


def _placing(pivots: np.ndarray):
    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                near = _unit(pdf["embedding"]) @ pivots.T
                pivot = near.argmax(axis=1)
                yield pdf.assign(pivot=pivot.astype(np.int32), near=near[np.arange(len(pdf)), pivot])

    return place


def _reaching(sample: np.ndarray, pivots: np.ndarray, widest: np.ndarray, k: int):
    """Adds to queries the pivots whose documents can be among their best k."""

    def reach(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if not len(pdf):
                continue
            unit = _unit(pdf["embedding"])
            bound = np.full(len(unit), -np.inf)
            if len(sample) >= k:
                bound = np.partition(unit @ sample.T, -k, axis=1)[:, -k] - _MARGIN
            angle = np.arccos(np.clip(unit @ pivots.T, -1, 1))
            most = np.where(np.isfinite(widest), np.cos(np.maximum(angle - widest, 0)), -np.inf) + _MARGIN
            able = (most >= bound[:, None]) & np.isfinite(widest)
            yield pdf.assign(pivots=[np.flatnonzero(row).astype(np.int32) for row in able])

    return reach


# --- filters, fusion, rerank -----------------------------------------------------


def metadata_filter(filters: dict | None, metadata: str = "metadata") -> Column | None:
    """Equality for a scalar, IN for a list; other keys and nulls are ignored."""
    out = None
    for key, value in (filters or {}).items():
        if key not in schema.FILTER_KEYS or value is None:
            continue
        c = F.col(f"{metadata}.{key}" if metadata else key)
        part = c.isin(*value) if isinstance(value, list) else c == value
        out = part if out is None else out & part
    return out


def apply_filter(docs: DataFrame, filters: dict | None, metadata: str = "metadata") -> DataFrame:
    condition = metadata_filter(filters, metadata)
    return docs if condition is None else docs.filter(condition)


def fuse(ranked_lists: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of (query_id, doc_id, rank from 0) lists. Equal scores keep
    first-seen order: earlier list first, then the rank in it."""
    fused, score, seen = None, F.lit(0.0), []
    for i, ranked in enumerate(ranked_lists):
        rank = f"rank_{i}"
        part = ranked.select("query_id", "doc_id", F.col("rank").alias(rank))
        fused = part if fused is None else fused.join(part, ["query_id", "doc_id"], "full_outer")
        score = score + F.coalesce(1.0 / (k + F.col(rank) + 1), F.lit(0.0))
        seen.append(F.when(F.col(rank).isNotNull(), F.struct(F.lit(i).alias("list_no"), F.col(rank).alias("rank"))))
    fused = fused.withColumns({"score": score, "seen": F.coalesce(*seen)})
    # a query has no more rows here than its lists are long
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("seen"))
    return fused.select("query_id", "doc_id", "score", (F.row_number().over(w) - 1).alias("rank"))


Scorer = Callable[[pd.Series, pd.Series], pd.Series]


def rerank(
    queries: DataFrame, pool: DataFrame, index: KeywordIndex, k: int = TOP_K,
    docs: DataFrame | None = None, scorer: Scorer | None = None, max_chars: int | None = None,
) -> DataFrame:
    """Re-scores a pool (query_id, doc_id, rank) and returns the best k.

    Default score: added idf of the query terms a document contains. With ``scorer``
    the texts of the pool go to a vectorised function; ``docs`` then gives doc_id, text.
    """
    base = pool.select("query_id", "doc_id", F.col("rank").alias("before"))
    if scorer is None:
        weighted = query_terms(queries).join(index.term_stats.select("term", "idf"), "term")
        found = base.join(weighted, "query_id").join(index.postings.select("term", "doc_id"), ["term", "doc_id"])
        scores = found.groupBy("query_id", "doc_id").agg(F.sum("idf").alias("score"))
        scored = base.join(scores, ["query_id", "doc_id"], "left").withColumn(
            "score", F.round(F.coalesce("score", F.lit(0.0)), _SCORE_DIGITS))
    else:
        score = F.pandas_udf(scorer, "double")
        text = F.substring("d.text", 1, max_chars) if max_chars else F.col("d.text")
        scored = (
            base.join(queries.select("query_id", F.col("text").alias("query_text")), "query_id")
            .join(docs.select("doc_id", "text").alias("d"), "doc_id")
            .select("query_id", "doc_id", "before", score(F.col("query_text"), text).alias("score"))
        )
    return _ranked(scored, k, ties="before")


def hybrid_search(
    queries: DataFrame, docs: DataFrame, index: KeywordIndex, k: int = TOP_K,
    filters: dict | None = None, filter_both: bool = False, scorer: Scorer | None = None,
) -> DataFrame:
    """Vector and keyword search, fusion, rerank of the best 20.

    queries: query_id, text, embedding; docs: doc_id, text, embedding and ``metadata``
    when filters are used. Filters restrict the vector search only, unless
    ``filter_both`` is set.
    """
    pool = candidate_pool(queries, docs, index, filters, filter_both)
    return rerank(queries, pool, index, k, docs=docs, scorer=scorer)


def candidate_pool(
    queries: DataFrame, docs: DataFrame, index: KeywordIndex, filters: dict | None = None,
    filter_both: bool = False,
) -> DataFrame:
    allowed = apply_filter(docs, filters)
    semantic = cosine_search(queries, allowed, SEMANTIC_K)
    if filter_both:
        ids = allowed.select("doc_id")
        # the blocks bound all postings, so also these
        index = replace(index, postings=index.postings.join(ids, "doc_id", "left_semi"))
    keyword = bm25_search(queries, index, KEYWORD_K)
    return fuse([semantic, keyword]).filter(F.col("rank") < RERANK_POOL)


def for_agent(results: DataFrame, queries: DataFrame) -> DataFrame:
    """One row per query: ids and scores in rank order and their count."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "doc_id", "score")))
    packed = results.groupBy("query_id").agg(ordered.alias("r"))
    empty = F.coalesce(F.col("r"), F.array().cast(packed.schema["r"].dataType))
    return queries.select("query_id", F.col("text").alias("query")).join(packed, "query_id", "left").select(
        "query_id",
        "query",
        F.transform(empty, lambda x: x["doc_id"]).alias("documents"),
        F.transform(empty, lambda x: x["score"]).alias("scores"),
        F.size(empty).alias("total_retrieved"),
    )


# --- context ---------------------------------------------------------------------


def topic_filter(results: DataFrame, agent: str) -> DataFrame:
    """Documents that mention a topic word of the agent, or all when none does; the first few.

    results: query_id, doc_id, text, rank with a bounded number of rows per query.
    """
    words, limit = schema.AGENT_TOPICS.get(agent, ([], 5))
    flag = F.lower("text").rlike("|".join(words)) if words else F.lit(True)
    w = Window.partitionBy("query_id")
    flagged = results.withColumn("on_topic", flag).withColumn("any_topic", F.max("on_topic").over(w))
    kept = flagged.filter(F.col("on_topic") | ~F.col("any_topic")).drop("any_topic")
    return top_per_key(kept, ["query_id"], ["rank"], limit)


NO_CONTEXT = "No relevant historical incidents found."
CONTEXT_CHARS, CONTEXT_MIN_PART = 3000, 300


def build_context(
    queries: DataFrame, results: DataFrame, prefer: str | None = None, max_chars: int = CONTEXT_CHARS
) -> DataFrame:
    """(query_id, context, parts): texts up to a character budget, preferred category first.

    results: query_id, text, rank, score and ``incident_category`` when ``prefer`` is set.
    """
    order = [F.col("rank")]
    if prefer:
        match = F.coalesce(F.col("incident_category") == prefer, F.lit(False))
        order = [match.desc(), F.col("score").desc(), F.col("rank")]
    w = Window.partitionBy("query_id").orderBy(*order)
    size = F.length("text")
    placed = results.withColumns(
        {
            "pos": F.row_number().over(w),
            "used": F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        }
    )
    left = F.lit(max_chars) - F.col("used")
    part = F.when(size <= left, F.col("text")).when(
        left > CONTEXT_MIN_PART,
        F.concat(F.substring(F.col("text"), F.lit(1), left.cast("int")), F.lit("\n[...truncated]")),
    )
    parts = F.array_sort(F.collect_list(F.when(part.isNotNull(), F.struct("pos", part.alias("part")))))
    packed = placed.groupBy("query_id").agg(parts.alias("p"))
    rule = "\n\n" + "─" * 60
    return queries.select("query_id").join(packed, "query_id", "left").select(
        "query_id",
        F.when(F.col("p").isNull(), NO_CONTEXT)
        .otherwise(F.concat(F.lit(rule), F.array_join(F.transform("p", lambda x: x["part"]), "\n\n")))
        .alias("context"),
        F.when(F.col("p").isNull(), 0).otherwise(F.size("p")).alias("parts"),
    )


# A token is a run of word characters or one other visible character.
_TOKEN = r"\s*(?:[A-Za-z0-9_]+|[^A-Za-z0-9_\s])"
PACK_SEPARATOR = "\n\n---\n\n"
PACK_CUT = "\n[...truncated to fit context budget]"


def count_tokens(c: Column) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit(_TOKEN), F.lit(0)))


def pack_to_budget(results: DataFrame, budget: int) -> DataFrame:
    """(query_id, packed, used): texts in rank order up to a token budget, the last one cut.

    results: query_id, text, rank with a bounded number of rows per query.
    """
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    placed = results.withColumn("n", count_tokens(F.col("text"))).withColumn(
        "left", F.lit(budget) - F.coalesce(F.sum("n").over(w), F.lit(0))).filter(F.col("left") > 0)
    pieces = F.slice(F.regexp_extract_all("text", F.lit(_TOKEN), F.lit(0)), F.lit(1), F.col("left").cast("int"))
    part = F.when(F.col("n") <= F.col("left"), F.col("text")).otherwise(
        F.concat(F.array_join(pieces, ""), F.lit(PACK_CUT)))
    ordered = F.array_sort(F.collect_list(F.struct("rank", part.alias("part"))))
    return placed.groupBy("query_id").agg(
        F.array_join(F.transform(ordered, lambda x: x["part"]), PACK_SEPARATOR).alias("packed"),
        F.sum(F.least("n", "left")).alias("used"),
    )
