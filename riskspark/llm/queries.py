"""Registered queries of the corpus operators, each over its whole tables, with check SQL where
SQL can say the same."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.llm import (alignment, decontamination, exact_dedup, mixing, neighbours, quality, repeats, runs, scoring,
                           secrets, simhash, token_counts, toxicity)
from riskspark.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

#: labelled rows with this remainder are held out of training
FOLDS, HELD_OUT_TOXICITY, HELD_OUT_SCORING = 5, 0, 1
#: every row of embeddings whose id this number divides asks for so many neighbours
EVERY, NEIGHBOURS = 20, 20


def fold(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS


def decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item: a row for each document and item."""
    found = decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id").distinct()
    # both sides are shuffled at every size: the labels grow with the documents
    model = quality.fit(docs.select("doc_id", "text").join(good.hint("merge"), "doc_id", "left_semi"))
    trusted = quality.scored(docs, model).join(good.withColumn("trusted", F.lit(True)), "doc_id", "left")
    return quality.judged(trusted.withColumn("trusted", F.coalesce("trusted", F.lit(False))))


def toxicity_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> toxicity.Model:
    """Fitted on the labelled rows that are not held out."""
    labels = table(spark, sf_dir, "labels").filter(fold() != HELD_OUT_TOXICITY)
    return toxicity.fit(docs, labels)


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scores = toxicity.toxicity(docs, toxicity_model(spark, sf_dir, docs))
    return scores.select(F.col("id").alias("doc_id"), F.coalesce(fold("id") == HELD_OUT_TOXICITY, F.lit(False))
                         .alias("held_out"), "score", "predicted")


def count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(token_counts.MODEL))
    return found.withColumnRenamed("id", "doc_id")


def remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.coalesce(fold() == HELD_OUT_SCORING, F.lit(False)).alias("held_out"))
    return scoring.scores(docs).withColumnRenamed("id", "doc_id")


def near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def find_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", "copies", "taken")


def align_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path(alignment.BYTE_MODEL),
                            public_tokenizers.path(alignment.PIECE_MODEL))
    return alignment.agreement(found).withColumnRenamed("id", "doc_id")


def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    index = neighbours.build_index(vectors, keep=NEIGHBOURS + 1)
    return neighbours.nearest(index, vectors.filter(f"vec_id % {EVERY} = 0"))


def repeat_from(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of one document in ten, chosen by its id, repeat periodically from some place on."""
    if doc_id is None or not words:
        return words
    g, chosen = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if chosen:
        return words
    start = g % len(words)
    period = 1 + (len(words) - start) // (3 + g % 8)
    return words[:start] + [words[start + i % period] for i in range(len(words) - start)]


def find_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.periodic_runs(table(spark, sf_dir, "documents"), rewrite=repeat_from).withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Query] = {
    "op1_benchmark_decontamination": decontaminate,
    "op2_quality_classifier": quality_scores,
    "op3_toxicity": toxicity_scores,
    "op4_token_counts": count_tokens,
    "op5_suffix_array_dedup": remove_repeats,
    "op6_exact_dedup": exact_copies,
    "op7_lm_scoring": model_scores,
    "op8_simhash_near_dedup": near_copies,
    "op9_secret_scans": find_secrets,
    "op10_mixing_sources": mix_sources,
    "op11_cross_tokenizer_alignment": align_tokens,
    "op12_nearest_neighbours": nearest_vectors,
    "op13_periodic_runs": find_runs,
}

ORACLES: dict[str, str] = {
    "op6_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
        FROM d JOIN g USING (t)""",
    "op9_secret_scans": r"""
        WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
        k(place, kind, pattern, value, least) AS (VALUES
            (0, 'assign', '(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1, 12),
            (1, 'access', 'AKIA[A-Z0-9]+', 0, 18),
            (2, 'hex', '[0-9a-f]+', 0, 16),
            (3, 'mixed', '[A-Za-z0-9+/_-]+', 0, 24)),
        m AS (
            SELECT doc_id, source, 0 AS place, ASSIGN_GAPS AS gaps, ASSIGN_HITS AS hits, ASSIGN_VALUES AS vals FROM d
            UNION ALL SELECT doc_id, source, 1, ACCESS_GAPS, ACCESS_HITS, ACCESS_HITS FROM d
            UNION ALL SELECT doc_id, source, 2, HEX_GAPS, HEX_HITS, HEX_HITS FROM d
            UNION ALL SELECT doc_id, source, 3, MIXED_GAPS, MIXED_HITS, MIXED_HITS FROM d),
        p AS (
            SELECT doc_id, source, place, gaps, hits, vals, unnest(range(1, len(hits) + 1)) AS i FROM m),
        s AS (
            SELECT doc_id, source, place, vals[i] AS v,
                   (list_sum(list_transform(gaps[1:i], lambda x: length(x)))
                    + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0))::BIGINT AS a,
                   length(hits[i]) AS n
            FROM p),
        f AS (
            SELECT s.doc_id, s.source, s.place, kind, v, a, a + n AS b FROM s JOIN k USING (place)
            WHERE length(v) >= least
              AND (s.place < 3 OR (regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')))),
        c AS (
            SELECT * FROM f WHERE place < 3 OR NOT EXISTS (
                SELECT 1 FROM f AS o WHERE o.doc_id = f.doc_id AND o.place < 3 AND o.a < f.b AND f.a < o.b)),
        w AS (
            SELECT v, count(DISTINCT coalesce(source, chr(1))) AS owners,
                   count(DISTINCT coalesce(doc_id::VARCHAR, chr(1))) AS repositories
            FROM c GROUP BY v),
        j AS (SELECT c.*, repositories, owners <= 2 AND repositories <= 20 AS live, kind || ':' || a || ':' || b AS span FROM c JOIN w USING (v)),
        r AS (
            SELECT doc_id, count(*) FILTER (place = 0) AS n_assign, count(*) FILTER (place = 1) AS n_access,
                   count(*) FILTER (place = 2) AS n_hex,
                   coalesce(string_agg(span, ',' ORDER BY a, place) FILTER (place < 3), '') AS base,
                   coalesce(string_agg(span, ',' ORDER BY a, place) FILTER (place < 3 OR live), '') AS spans,
                   coalesce(string_agg(repositories::VARCHAR, ',' ORDER BY a, place) FILTER (place < 3 OR live), '') AS repositories,
                   count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied
            FROM j GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
               coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
               coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied, coalesce(repositories, '') AS repositories
        FROM d LEFT JOIN r USING (doc_id)""",
    "op10_mixing_sources": r"""
        WITH d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size
            FROM documents),
        s AS (
            SELECT source, sum(size)::BIGINT AS n, row_number() OVER (ORDER BY source NULLS LAST) AS place
            FROM d GROUP BY source),
        w AS (SELECT source, n, (place - 1) % 3 + 1 AS weight FROM s),
        b AS (
            SELECT *, sum(n) OVER () - coalesce(sum(3 * n) OVER before, 0) AS words_left,
                   sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS weight_left,
                   row_number() OVER (ORDER BY 3.0 * n / weight, source NULLS LAST) AS step
            FROM w
            WINDOW before AS (ORDER BY 3.0 * n / weight, source NULLS LAST
                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        free AS (SELECT * FROM b WHERE 3 * n * weight_left >= weight * words_left ORDER BY step LIMIT 1),
        t AS (
            SELECT b.source, b.n AS source_size,
                   CASE WHEN b.step < free.step THEN (3 * b.n)::DOUBLE
                        ELSE b.weight * free.words_left::DOUBLE / free.weight_left::DOUBLE END AS target
            FROM b, free),
        r AS (
            SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size::DOUBLE, 3.0) ELSE 0.0 END AS rate
            FROM t),
        c AS (
            SELECT d.doc_id, size, source_size, target,
                   floor(rate)::BIGINT + CASE WHEN ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT
                       / 4294967296.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END AS copies
            FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
        SELECT doc_id, size, source_size, target, copies, copies * size AS taken FROM c""",
    # exact, as the query is where its sample holds all vectors
    "op12_nearest_neighbours": """
        WITH v AS (
            SELECT DISTINCT vec_id, embedding::DOUBLE[] AS x FROM embeddings
            WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
              AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
        c AS (SELECT len(x) AS n FROM v GROUP BY n ORDER BY count(*) DESC, n DESC LIMIT 1),
        u AS (SELECT v.* FROM v JOIN c ON len(x) = n),
        p AS (
            SELECT q.vec_id AS query_id, u.vec_id,
                   list_reduce(list_transform(list_zip(q.x, u.x), lambda z: z[1] * z[2]), lambda a, b: a + b) AS score
            FROM u AS q JOIN u ON q.vec_id <> u.vec_id WHERE q.vec_id % 20 = 0)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
        FROM p QUALIFY rank <= 20""",
}


def _with_patterns(sql: str) -> str:
    patterns = {
        "ASSIGN": """(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)""",
        "ACCESS": "AKIA[A-Z0-9]+", "HEX": "[0-9a-f]+", "MIXED": "[A-Za-z0-9+/_-]+"}
    for name, pattern in patterns.items():
        sql = (sql.replace(f"{name}_GAPS", f"string_split_regex(t, '{pattern}')")
               .replace(f"{name}_HITS", f"regexp_extract_all(t, '{pattern}', 0)")
               .replace(f"{name}_VALUES", f"regexp_extract_all(t, '{pattern}', 1)"))
    return sql


ORACLES["op9_secret_scans"] = _with_patterns(ORACLES["op9_secret_scans"])
