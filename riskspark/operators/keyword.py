"""Keyword index and BM25 search with upper bounds.

A posting's contribution to a score is the query's weight of the term times the posting's impact,
which grows with its count of the term and falls with the document's length. The postings of a term
are kept in blocks of like impact, and for each block the index holds how many there are, the largest
count and the smallest length: these bound the impact of all of them, whatever the mean length.

A search takes the blocks of highest impact first, up to a fixed number of postings, and scores the
documents with the best sums: their k-th best is a score that the last result cannot fall short of. Terms whose bounds together stay
below it are optional: no document enters by them alone, so their postings are joined only to
documents that can still enter. Blocks of the other terms that cannot lift a document to that score
are not read at all. The postings read are dealt to blocks of documents; each adds up the scores of all
queries in one array and gives back only documents that can still enter, so that pairs of queries and
documents are never shuffled.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark.functions.columns import tokens
from riskspark.operators.ordering import top_per_key
from riskspark.session import END_SHUFFLES, configured, landed

# Okapi BM25 parameters.
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25
KEYWORD_K = 15

# Equal documents must tie whatever the order of addition was.
_SCORE_DIGITS = 9
_SLACK = 1e-8

#: impacts are below k1 + 1; blocks divide that range as it is for documents of the usual length
LEVELS, USUAL_LENGTH = 8, 256
POSTING_BUCKETS = 64
#: the bucket of rows that say which document a number stands for, and the numbers a task has for its documents
NAMES_BUCKET, TASK_NUMBERS = -1, 1 << 33
#: words whose postings one task sorts and writes, and texts counted at a time
TASK_WORDS, COUNTED_TEXTS = 1 << 21, 256
#: postings a query's first bound is taken from
SEED_POSTINGS = 2000
#: optional terms reach at most this share of the bound, so that documents must get the rest from other terms;
#: at 1 fewest documents are met, but in long queries most of those are then looked up for every optional term
OPTIONAL_SHARE = 0.25
#: documents scored for that bound, as a multiple of the results wanted
LIKELY = 4
#: queries and documents whose scores one task adds up at a time (8 bytes each pair)
BLOCK_QUERIES, BLOCK_DOCS = 256, 1 << 13
_POSTINGS_AT_ONCE = 1 << 14
_GONE = -1


@dataclass
class KeywordIndex:
    postings: DataFrame  # term, level, doc_id, tf, dl
    doc_stats: DataFrame  # doc_id, dl
    term_stats: DataFrame  # term, df, idf
    blocks: DataFrame  # term, level, n, max_tf, min_dl
    #: if given, postings call documents by numbers: doc, doc_id
    names: DataFrame | None = None
    #: numbers of documents that postings still hold but that count no more: doc_id
    gone: DataFrame | None = None

    @staticmethod
    def load(spark, path: str) -> "KeywordIndex":
        read = spark.read.parquet
        doc_stats = read(f"{path}/doc_stats")
        kinds = {f.name: f.dataType.simpleString() for f in doc_stats.schema.fields}
        layout = f"term string, level int, doc_id {kinds['doc_id']}, tf bigint, dl {kinds['dl']}, bucket int"
        return KeywordIndex(spark.read.schema(layout).parquet(f"{path}/postings"), doc_stats,
                            read(f"{path}/term_stats"), read(f"{path}/blocks"))


def _impact(tf: Column, dl: Column, mean_length: Column | float) -> Column:
    return tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * dl / mean_length))


_WORD = re.compile("[a-z0-9]+")


def _lengths(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, dl: the number of words; null for a null text."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (t.as_py() for t in batch.column("text"))
            lengths = [None if t is None else len(_WORD.findall(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lengths, pa.int32())], ["doc_id", "dl"])

    rows = _lowered(docs, doc_id, text)
    return rows.mapInArrow(measure, T.StructType([rows.schema["doc_id"], T.StructField("dl", T.IntegerType())]))


def _lowered(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.lower(F.col(text)).alias("text"))


def _words(texts: pa.Array) -> tuple[list[str], list[int], list[int], pa.Array]:
    """The distinct words of each text, how often it has them, how many there are, and its length."""
    terms, counts, sizes, lengths = [], [], [], []
    for text in texts.to_pylist():
        words = _WORD.findall(text or "")
        found = Counter(words)
        terms.extend(found)
        counts.extend(found.values())
        sizes.append(len(found))
        lengths.append(len(words))
    return terms, counts, sizes, pa.array(lengths, pa.int32())


def _counting(texts: int):
    """Makes of (doc_id, lower-case text) rows of (term, doc_id, tf, dl), a number of texts at a time."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, texts):
                some = batch.slice(at, texts)
                terms, counts, sizes, lengths = _words(some.column("text"))
                owner = pa.array(np.repeat(np.arange(len(sizes)), sizes))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(terms, pa.string()), some.column("doc_id").take(owner), pa.array(counts, pa.int64()),
                     lengths.take(owner)], ["term", "doc_id", "tf", "dl"])

    return count


def _numbering(texts: int, first: int):
    """Makes of (doc_id, lower-case text) rows of (term, doc, doc_id, tf, dl): first one without a term for each
    text, which gives its number and length, then its words, with the number in place of the id."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = first + TaskContext.get().partitionId() * TASK_NUMBERS
        names = ["term", "doc", "doc_id", "tf", "dl"]
        for batch in batches:
            for at in range(0, batch.num_rows, texts):
                some = batch.slice(at, texts)
                ids, of = some.column("doc_id"), some.column("text")
                terms, counts, sizes, lengths = _words(of)
                docs = np.arange(number, number + len(sizes))
                number += len(sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(len(sizes), pa.string()), pa.array(docs, pa.int64()), ids, pa.nulls(len(sizes), pa.int64()),
                     pc.if_else(of.is_valid(), lengths, pa.scalar(None, pa.int32()))], names)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(terms, pa.string()), pa.array(np.repeat(docs, sizes), pa.int64()), pa.nulls(len(terms), ids.type),
                     pa.array(counts, pa.int64()), lengths.take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))], names)

    return count


def _counted(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """term, doc_id, tf, dl of every row, counted in the task that holds the text."""
    rows = _lowered(docs, doc_id, text)
    layout = T.StructType([T.StructField("term", T.StringType()), rows.schema["doc_id"],
                           T.StructField("tf", T.LongType()), T.StructField("dl", T.IntegerType())])
    return rows.mapInArrow(_counting(COUNTED_TEXTS), layout)


def _level() -> Column:
    level = F.floor(_impact(F.col("tf"), F.col("dl"), F.lit(USUAL_LENGTH)) * LEVELS / (BM25_K1 + 1))
    return level.cast("int").alias("level")


def _postings(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Only where ids repeat are the counts of rows with one id and length added up by a shuffle."""
    counted = _counted(docs, doc_id, text)
    if not _unique(docs.select(doc_id)):
        counted = counted.groupBy("doc_id", "dl", "term").agg(F.sum("tf").alias("tf"))
    return counted.select("term", _level(), "doc_id", "tf", "dl")


def posting_frames(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Postings and lengths of documents, for an index that is kept up document by document."""
    return _postings(docs, doc_id, text), _lengths(docs, doc_id, text)


def stored_postings(docs: DataFrame, first: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """bucket, term, level, doc, doc_id, tf, dl, as a load stores them: postings call their document by a number,
    from ``first`` on, and the bucket of names has a row for each text with its number, id and length.
    An id is thus stored once, not with each word. Where ids repeat, postings have the id and no number."""
    if _unique(docs.select(doc_id)):
        rows = _lowered(docs, doc_id, text)
        layout = T.StructType([T.StructField("term", T.StringType()), T.StructField("doc", T.LongType()), rows.schema["doc_id"],
                               T.StructField("tf", T.LongType()), T.StructField("dl", T.IntegerType())])
        held = F.when(F.col("term").isNull(), NAMES_BUCKET).otherwise(posting_bucket(F.col("term"))).alias("bucket")
        found = rows.mapInArrow(_numbering(COUNTED_TEXTS, first), layout).select(held, "term", _level(), "doc", "doc_id", "tf", "dl")
    else:
        none = lambda kind: F.lit(None).cast(kind)
        found = _postings(docs, doc_id, text).select(
            posting_bucket(F.col("term")).alias("bucket"), "term", "level", none("bigint").alias("doc"), "doc_id", "tf", "dl")
        found = found.unionByName(_lengths(docs, doc_id, text).select(
            F.lit(NAMES_BUCKET).alias("bucket"), none("string").alias("term"), none("int").alias("level"), none("bigint").alias("doc"), "doc_id",
            none("bigint").alias("tf"), "dl"))
    return found.sortWithinPartitions("bucket", "term", "level", "doc", "doc_id")


def laid_out(postings: DataFrame, doc_stats: DataFrame) -> DataFrame:
    """Postings with their bucket, dealt to tasks and sorted as they are stored: a bucket is divided by
    document, so that what one task sorts and writes is bounded."""
    words = doc_stats.agg(F.sum("dl")).first()[0] or 0
    parts = max(1, math.ceil(words / (POSTING_BUCKETS * TASK_WORDS)))
    task = F.col("bucket") * parts + F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")
    return (postings.withColumn("bucket", posting_bucket(F.col("term"))).repartitionById(POSTING_BUCKETS * parts, task)
            .sortWithinPartitions("bucket", "term", "level"))


def term_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """term, n, docs: how often a term occurs and in how many documents. Words are counted in the task that
    holds the text; of those counts only what is added up per term is shuffled, unless ids repeat."""
    per_doc = _counted(docs, doc_id, text).select("term", "doc_id", "tf")
    if not _unique(docs.select(doc_id)):
        per_doc = per_doc.groupBy("term", "doc_id").agg(F.sum("tf").alias("tf"))
    return per_doc.groupBy("term").agg(F.sum("tf").alias("n"), F.count(F.lit(1)).alias("docs"))


def _unique(ids: DataFrame) -> bool:
    with configured(ids.sparkSession, END_SHUFFLES):
        return ids.groupBy(*ids.columns).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()


def block_stats(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term", "level").agg(
        F.count("*").alias("n"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"))


def add_blocks(parts: DataFrame) -> DataFrame:
    """Blocks of several batches as one. A negative n takes postings away; the bounds stay those of all
    postings there ever were, and so hold."""
    return parts.groupBy("term", "level").agg(
        F.sum("n").alias("n"), F.max("max_tf").alias("max_tf"), F.min("min_dl").alias("min_dl")).filter("n > 0")


def term_stats(blocks: DataFrame, doc_stats: DataFrame) -> DataFrame:
    n_docs = doc_stats.agg(F.count("*").alias("n")).scalar()
    counts = blocks.groupBy("term").agg(F.sum("n").alias("df")).withColumn(
        "raw", F.ln(n_docs - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5))
    mean_idf = counts.agg(F.avg("raw")).scalar()
    return counts.select(
        "term", "df", F.when(F.col("raw") < 0, mean_idf * BM25_EPSILON).otherwise(F.col("raw")).alias("idf"))


def index_frames(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> KeywordIndex:
    """The index as lazy frames, for a single use."""
    postings, doc_stats = posting_frames(docs, doc_id, text)
    blocks = block_stats(postings)
    return KeywordIndex(postings, doc_stats, term_stats(blocks, doc_stats), blocks)


def posting_bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(POSTING_BUCKETS)).cast("int")


def build_index(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> KeywordIndex:
    """Writes the index tables and returns them. Each table is made from the one before, so
    texts are split once for postings and once for lengths.

    Postings are partitioned by a hash of the term and laid out by term and block: a search reads
    the partitions of its terms, and the postings of a frequent term in many documents spread over
    several files. They are shuffled once.
    """
    spark = docs.sparkSession
    postings, lengths = posting_frames(docs, doc_id, text)
    lengths.write.mode("overwrite").parquet(f"{path}/doc_stats")
    doc_stats = spark.read.parquet(f"{path}/doc_stats")
    laid_out(postings, doc_stats).write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/postings")
    layout = "term string, level int, tf bigint, dl int"
    block_stats(spark.read.schema(layout).parquet(f"{path}/postings")).write.mode("overwrite").parquet(f"{path}/blocks")
    term_stats(spark.read.parquet(f"{path}/blocks"), doc_stats).write.mode("overwrite").parquet(f"{path}/term_stats")
    return KeywordIndex.load(spark, path)


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, qtf) of a batch with columns query_id, text."""
    return (
        queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term"))
        .groupBy("query_id", "term")
        .agg(F.count("*").alias("qtf"))
    )


def bm25_search(queries: DataFrame, index: KeywordIndex, k: int = KEYWORD_K, seeds: int = SEED_POSTINGS) -> DataFrame:
    """(query_id, doc_id, score, rank from 0): the best k documents with a positive score.

    Of a stored index, only the partitions that hold query terms are read.
    """
    plan = search_plan(queries, index, k, seeds)
    scores = plan.scores().filter(F.col("score") > 0)
    if index.names is not None:
        # documents that tie with the last one stay: their ids decide
        best = scores.withColumn("_place", F.rank().over(Window.partitionBy("query_id").orderBy(F.desc("score"))))
        best = landed(best.filter(F.col("_place") <= k).select("query_id", F.col("doc_id").alias("doc"), "score"), "best")
        scores = best.join(index.names.select("doc", "doc_id"), "doc").select("query_id", "doc_id", "score")
    return _ranked(scores, k)


@dataclass
class SearchPlan:
    """What a batch of queries reads. All frames are small or written in the shared folder.

    terms: query_id, term, weight, optional. candidates: query_id, doc_id, partial, of the terms that
    are not optional. optional_postings: query_id, doc_id, weight, tf, dl."""

    terms: DataFrame
    candidates: DataFrame
    optional_postings: DataFrame
    mean_length: float

    def scores(self) -> DataFrame:
        added = F.col("weight") * _impact(F.col("tf"), F.col("dl"), self.mean_length)
        more = self.optional_postings.select("query_id", "doc_id", added.alias("part"))
        parts = self.candidates.select("query_id", "doc_id", F.col("partial").alias("part")).unionByName(more)
        return parts.groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), _SCORE_DIGITS).alias("score"))


def search_plan(queries: DataFrame, index: KeywordIndex, k: int = KEYWORD_K, seeds: int = SEED_POSTINGS) -> SearchPlan:
    """Bounds, thresholds and candidates of a batch of queries."""
    mean = index.doc_stats.agg(F.avg("dl")).first()[0] or 1.0
    weighted = query_terms(queries).join(index.term_stats.select("term", "idf"), "term").select(
        "query_id", "term", (F.col("qtf") * F.col("idf")).alias("weight"))
    reach = F.col("weight") * _impact(F.col("max_tf"), F.col("min_dl"), mean)
    # a weight may be negative: such a term adds nothing at best and its reach at worst
    blocks = landed(weighted.join(index.blocks, "term").select(
        "query_id", "term", "level", "n", "weight", F.greatest(reach, F.lit(0.0)).alias("most"),
        F.least(reach, F.lit(0.0)).alias("least")), "query_blocks")
    postings = _of_terms(index.postings, blocks)
    impact = _impact(F.col("tf"), F.col("dl"), mean)

    by_reach = Window.partitionBy("query_id").orderBy(F.desc("most"), "n", "term", "level")
    first = blocks.filter((F.col("n") <= seeds) & (F.col("most") > 0)).withColumn("read", F.sum("n").over(by_reach)).filter(F.col("read") <= seeds)
    seen = _sums(postings, first, impact)
    if index.gone is not None:
        seen = landed(seen, "seen").join(index.gone, "doc_id", "left_anti")
    likely = top_per_key(seen, ["query_id"], [F.desc("partial")], LIKELY * k)
    terms = blocks.groupBy("query_id", "term", "weight").agg(F.max("most").alias("most"), F.min("least").alias("least"))
    likely = landed(likely.select("query_id", "doc_id").join(terms.select("query_id", "term", "weight"), "query_id"), "likely")
    whole = (postings.join(likely, ["term", "doc_id"]).groupBy("query_id", "doc_id")
             .agg(F.sum(F.col("weight") * impact).alias("partial")))
    totals = terms.groupBy("query_id").agg(F.sum("most").alias("all_most"), F.sum("least").alias("all_least"))
    bound = _kth(whole, k).join(totals, "query_id", "right").select(
        "query_id", "all_most", "all_least", F.greatest(F.coalesce("kth", F.lit(0.0)) - _SLACK, F.lit(0.0)).alias("bound"))
    rising = Window.partitionBy("query_id").orderBy("most", "term")
    terms = landed(terms.join(bound, "query_id").withColumn("sum_most", F.sum("most").over(rising)).select(
        "query_id", "term", "weight", "most", "least", "all_most", "all_least", "bound",
        (F.col("sum_most") < F.col("bound") * OPTIONAL_SHARE).alias("optional")), "query_terms")

    needed = blocks.join(terms.filter("not optional").select("query_id", "term", F.col("most").alias("term_most"), "all_most", "bound"),
                         ["query_id", "term"]).filter(F.col("all_most") - F.col("term_most") + F.col("most") >= F.col("bound"))
    rest = landed(terms.groupBy("query_id").agg(
        F.first("all_least").alias("all_least"), F.first("bound").alias("bound"),
        F.sum(F.when(F.col("optional"), F.col("most")).otherwise(0.0)).alias("rest_most")), "rest")
    partial = landed(_able_sums(postings, needed, rest, impact, index.doc_stats.count(), k, gone=index.gone), "partials")
    better = _kth(partial, k).withColumnRenamed("kth", "partial_kth")
    limits = rest.join(better, "query_id", "left").select(
        "query_id", "rest_most", F.greatest("bound", F.col("partial_kth") + F.col("all_least") - _SLACK).alias("bound"))
    candidates = landed(partial.join(limits, "query_id").filter(F.col("partial") + F.col("rest_most") >= F.col("bound"))
                        .select("query_id", "doc_id", "partial"), "candidates")
    # written, so that the join with the postings is planned by its size
    wanted = landed(candidates.select("query_id", "doc_id").join(
        terms.filter("optional").select("query_id", "term", "weight"), "query_id"), "wanted")
    optional = postings.select("term", "doc_id", "tf", "dl").join(wanted, ["term", "doc_id"]).select(
        "query_id", "doc_id", "weight", "tf", "dl")
    return SearchPlan(terms, candidates, optional, mean)


def _able_sums(postings: DataFrame, needed: DataFrame, rest: DataFrame, impact: Column, docs: int, k: int,
               block_queries: int = BLOCK_QUERIES, block_docs: int = BLOCK_DOCS, gone: DataFrame | None = None) -> DataFrame:
    """query_id, doc_id, partial: the sums over the needed blocks of the documents that can be among the
    best k of a query by its limits in ``rest`` and by the k-th best sum among the documents they are
    dealt with. Documents that are ``gone`` are dealt out beside the postings, and have no sums."""
    blocks = landed(needed.select("query_id", "term", "level", "weight"), "needed")
    named = landed(blocks.select("term", "level").distinct().withColumn("block", F.monotonically_increasing_id()), "named")
    parts = max(1, math.ceil(docs / block_docs))
    groups = max(1, math.ceil(rest.count() / block_queries))
    group = F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int").alias("group")
    asked = blocks.join(named, ["term", "level"]).join(rest, "query_id").select(
        "query_id", "block", "weight", "rest_most", "all_least", "bound", group,
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int").alias("part")
    # a posting goes to the groups that ask for its block
    wanted = landed(blocks.join(named, ["term", "level"]).groupBy("term", "level", "block").agg(
        F.collect_set(group).alias("groups")), "wanted")
    held = postings.join(wanted, ["term", "level"]).select(
        "block", "doc_id", impact.alias("impact"), part, F.explode("groups").alias("group"))
    if gone is not None:
        held = held.unionByName(gone.select(
            F.lit(_GONE).cast("bigint").alias("block"), "doc_id", F.lit(0.0).alias("impact"), part,
            F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group")))
    out = T.StructType([blocks.schema["query_id"], postings.schema["doc_id"], T.StructField("partial", T.DoubleType())])
    dealt = ["group", "part"]
    return asked.groupBy(*dealt).cogroup(held.groupBy(*dealt)).applyInArrow(_adding(k), out)


def _adding(k: int):
    def add(asked: pa.Table, held: pa.Table) -> pa.Table:
        queries, docs = (t.column(name).combine_chunks().dictionary_encode("encode")
                         for t, name in ((asked, "query_id"), (held, "doc_id")))
        n_docs = len(docs.dictionary)
        query = queries.indices.to_numpy()
        block, weight = asked.column("block").to_numpy(), asked.column("weight").to_numpy()
        order = np.argsort(block, kind="stable")
        block, weight, query = block[order], weight[order], query[order]
        sums, met = np.zeros(len(queries.dictionary) * n_docs), np.zeros(len(queries.dictionary) * n_docs, bool)
        at, impact = held.column("block").to_numpy(), held.column("impact").to_numpy()
        doc = docs.indices.to_numpy()
        gone = doc[at == _GONE]
        for i in range(0, len(at), _POSTINGS_AT_ONCE):
            some = slice(i, i + _POSTINGS_AT_ONCE)
            first, last = np.searchsorted(block, at[some]), np.searchsorted(block, at[some], "right")
            times = last - first
            mine = np.repeat(first - np.r_[0, np.cumsum(times)[:-1]], times) + np.arange(times.sum())
            cell = query[mine] * np.int64(n_docs) + np.repeat(doc[some], times)
            np.add.at(sums, cell, weight[mine] * np.repeat(impact[some], times))
            met[cell] = True
        sums, met = (x.reshape(len(queries.dictionary), n_docs) for x in (sums, met))
        met[:, gone] = False
        limits = {name: np.zeros(len(sums)) for name in ("rest_most", "all_least", "bound")}
        for name, values in limits.items():
            values[queries.indices.to_numpy()] = asked.column(name).to_numpy()
        rows, columns = [], []
        for q in range(len(sums)):
            of = np.flatnonzero(met[q])
            least = limits["bound"][q]
            if len(of) >= k:
                kth = np.partition(sums[q, of], len(of) - k)[len(of) - k]
                least = max(least, kth + limits["all_least"][q] - _SLACK)
            of = of[sums[q, of] + limits["rest_most"][q] >= least]
            rows.append(np.full(len(of), q))
            columns.append(of)
        row, column = (np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (rows, columns))
        return pa.table({"query_id": queries.dictionary.take(pa.array(row)), "doc_id": docs.dictionary.take(pa.array(column)),
                         "partial": pa.array(sums[row, column])})

    return add


def _of_terms(postings: DataFrame, blocks: DataFrame) -> DataFrame:
    """Of stored postings those in the partitions of the queries' terms."""
    if "bucket" not in postings.columns:
        return postings
    held = blocks.select(posting_bucket(F.col("term")).alias("b")).distinct().collect()
    return postings.filter(F.col("bucket").isin([r.b for r in held]))


def _sums(postings: DataFrame, blocks: DataFrame, impact: Column) -> DataFrame:
    """query_id, doc_id, partial: the sums over some blocks, added up per task before the shuffle."""
    return (postings.join(blocks.select("query_id", "term", "level", "weight"), ["term", "level"])
            .groupBy("query_id", "doc_id").agg(F.sum(F.col("weight") * impact).alias("partial")))


def _kth(sums: DataFrame, k: int) -> DataFrame:
    """query_id, kth: the k-th best sum of the queries that have so many."""
    top = top_per_key(sums, ["query_id"], [F.desc("partial")], k)
    return top.filter(F.col("_rank") == k).select("query_id", F.col("partial").alias("kth"))


def _ranked(scored: DataFrame, k: int, ties: str = "doc_id") -> DataFrame:
    top = top_per_key(scored, ["query_id"], [F.col("score").desc(), F.col(ties)], k)
    return top.select("query_id", "doc_id", "score", (F.col("_rank") - 1).cast("int").alias("rank"))
