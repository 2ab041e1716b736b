"""Nearest neighbours by inner product: randomly rotated one-bit codes, then reranking.

Vectors are normalised about the centre of their cell and rotated at random into at least 256
dimensions; of each coordinate only the sign is kept. A code and two scalars (the residual's length
and the code's correction, its inner product with the rotated unit residual) give an unbiased
estimate of an inner product, and the correction also bounds its error, up to a chance set by
``SPREAD``. Estimates decide which vectors are compared exactly, in double precision.

A first bound on each query's k-th best comes from a sample: a k-th best among some rows is never
above that among all. These sampled neighbours are candidates too, so that a query never gets too
few. Cells whose radius keeps all their vectors below the bound are left out, so
on clustered data a query meets few cells; on data without clusters it meets all of them. Every row
is indexed. Queries and cells are dealt to a grid of blocks, each worked on by one task, which
raises the bounds as it finds better vectors.

Equal vectors are compared once: only the k + 1 smallest ids of a vector can be among the first k.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskspark.session import landed

LEAST_BITS = 256
#: errors of estimates are bounded by this many of their standard deviations, on the side where a neighbour is lost
SPREAD = 2.5
#: most rows that centres and first bounds are taken from
SAMPLE = 4096
CELLS, ROUNDS, SEED = 64, 8, 42
#: most vectors and queries of one block of the grid
VECTORS, QUERIES = 1 << 16, 1 << 14
_TILE_VECTORS, _TILE_QUERIES = 2048, 512


class Model(NamedTuple):
    """What tasks need to know of an index; bounded by the sample. ``blocks`` counts those of each cell."""
    keep: int
    sample: np.ndarray
    sample_ids: pa.Array
    centres: np.ndarray
    radii: np.ndarray
    blocks: np.ndarray
    rotation: np.ndarray


class Index(NamedTuple):
    """``rows``: uid, ids (smallest first), vector, cell, block, code, length and correction, written
    in the shared folder."""
    rows: DataFrame
    model: Model


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Distinct id and vector of the rows that take part, whatever the vector's length."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(F.col("id").isNotNull() & finite & F.exists("vector", lambda x: x != 0)).distinct()


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def _centres(sample: np.ndarray, cells: int) -> np.ndarray:
    """Means of the sample's parts after some rounds of nearest-centre assignment."""
    rng = np.random.default_rng(SEED)
    if not len(sample):
        return sample
    centres = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)].copy()
    for _ in range(ROUNDS):
        cell = _nearest(sample, centres)
        for i in np.unique(cell):
            centres[i] = sample[cell == i].mean(axis=0)
    return centres


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (rows @ centres.T - 0.5 * (centres * centres).sum(axis=1)).argmax(axis=1)


def _exact(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Inner products row by row, summed from the first component to the last: equal pairs give equal
    numbers wherever they stand."""
    return np.cumsum(one * other, axis=1)[:, -1]


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", keep: int = 21,
                cells: int = CELLS, bits: int = LEAST_BITS) -> Index:
    """Indexes every vector; ``keep`` ids of each are kept (one more than neighbours wanted).

    Rows with a null id, and vectors that are null, zero, hold null or non-finite numbers or have
    another length than most, take no part. A repeated row counts once. Centres are fitted on at
    most ``SAMPLE`` distinct vectors, chosen by a hash."""
    rows = _usable(vectors, id_col, vector_col)
    sizes = rows.groupBy(F.size("vector").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    common = sizes.orderBy(F.desc("n"), F.desc("size")).first()
    rows = rows.filter(F.size("vector") == F.lit(common.size if common else 0))
    by_vector = Window.partitionBy(F.xxhash64("vector"), "vector").orderBy("id")
    first = rows.withColumn("place", F.row_number().over(by_vector)).filter(F.col("place") <= keep)
    # uid: the smallest id need not be unique, as one id may stand at several vectors
    held = landed(first.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids"))
                  .withColumn("uid", F.monotonically_increasing_id()), "vectors")
    chosen = held.orderBy(F.xxhash64("vector"), "vector").limit(SAMPLE).select("vector", "ids").toArrow()
    sample = _matrix(chosen["vector"]) if chosen.num_rows else np.zeros((0, 1))
    size = sample.shape[1]
    width = max(LEAST_BITS, bits, size)
    width += -width % 8
    rotation = np.linalg.qr(np.random.default_rng(SEED).standard_normal((width, size)))[0].T
    centres = _centres(sample, cells)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            matrix = _matrix(batch.column(2))
            cell = _nearest(matrix, centres)
            residual = matrix - centres[cell]
            length = np.sqrt((residual * residual).sum(axis=1))
            turned = (residual / np.where(length > 0, length, 1)[:, None]) @ rotation
            signs = turned > 0
            correction = np.abs(turned).sum(axis=1) / np.sqrt(width)
            codes = np.packbits(signs, axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()),
                 pa.array(length), pa.array(correction)],
                ["uid", "ids", "vector", "cell", "code", "length", "correction"])

    coded = landed(held.select("uid", "ids", "vector").mapInArrow(
        encode, "uid long, ids array<long>, vector array<double>, cell int, code binary, length double, correction double"), "codes")
    sums = {r.cell: r for r in coded.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("radius")).collect()}
    radii = np.array([sums[i].radius if i in sums else 0.0 for i in range(len(centres))])
    blocks = np.array([-(-sums[i].n // VECTORS) if i in sums else 0 for i in range(len(centres))], np.int64)
    first_block = F.array(F.lit(0), *[F.lit(int(b)) for b in np.cumsum(blocks)])
    parts = F.array(F.lit(1), *[F.lit(int(b)) for b in blocks])  # a cell of many vectors is dealt to several blocks
    block = F.get(first_block, F.col("cell")) + F.pmod(F.xxhash64("uid"), F.get(parts, F.col("cell") + 1)).cast("int")
    return Index(coded.withColumn("block", block), Model(keep, sample, chosen["ids"].combine_chunks(), centres, radii, blocks, rotation))


def _best(owner: np.ndarray, score: np.ndarray, first_id: np.ndarray, keep: int) -> np.ndarray:
    """Places of the best ``keep`` entries of each owner: greatest score, then smallest first id."""
    if not len(owner):
        return np.zeros(0, np.int64)
    order = np.lexsort((first_id, -score, owner))
    sorted_owner = owner[order]
    starts = np.flatnonzero(np.r_[True, sorted_owner[1:] != sorted_owner[:-1]])
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return order[rank < keep]


def _search_block(queries: pa.Table, vectors: pa.Table, index: Model, spread: float) -> pa.Table:
    """The best vectors of one block for each of its queries: query, score, ids."""
    if not queries.num_rows or not vectors.num_rows:
        return pa.table({"query": queries["query"].slice(0, 0), "score": pa.array([], pa.float64()), "ids": vectors["ids"].slice(0, 0)})
    wanted, bound = _matrix(queries["vector"]), queries["bound"].to_numpy()
    rows, cell = _matrix(vectors["vector"]), vectors["cell"].to_numpy()
    first_id = pc.list_element(vectors["ids"], 0).to_numpy()
    length, correction = vectors["length"].to_numpy(), vectors["correction"].to_numpy()
    codes = np.frombuffer(b"".join(vectors["code"].to_pylist()), np.uint8).reshape(len(rows), -1)
    width = codes.shape[1] * 8
    turned = (wanted @ index.rotation).astype(np.float32)
    norms = np.sqrt((wanted * wanted).sum(axis=1))
    centre_part = wanted @ index.centres.T
    # <query, vector> = <query, centre> + length * <query, unit residual>; the code estimates the last product
    share = np.where(length > 0, length / np.where(length > 0, correction, 1), 0)
    scale = share / np.sqrt(width)
    error = spread * share * np.sqrt(np.maximum(1 - correction * correction, 0) / (width - 1))
    owner, score, place = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
    for at in range(0, len(rows), _TILE_VECTORS):
        some = slice(at, at + _TILE_VECTORS)
        signs = (np.unpackbits(codes[some], axis=1).astype(np.float32) * 2 - 1).T
        found = [(owner, score, place)]
        for q in range(0, len(wanted), _TILE_QUERIES):
            ask = slice(q, q + _TILE_QUERIES)
            most = (turned[ask] @ signs) * scale[some] + centre_part[ask][:, cell[some]] + norms[ask, None] * error[some]
            # written so that what leaves single precision's range is compared exactly
            a, b = np.nonzero(~(most < bound[ask, None]))
            a, b = a + q, b + at
            exact = _exact(wanted[a], rows[b])
            good = exact >= bound[a]
            found.append((a[good], exact[good], b[good]))
        owner, score, place = (np.concatenate(x) for x in zip(*found))
        stay = _best(owner, score, first_id[place], index.keep)
        owner, score, place = owner[stay], score[stay], place[stay]
        least = np.full(len(wanted), np.inf)
        np.minimum.at(least, owner, score)
        full = np.bincount(owner, minlength=len(wanted)) == index.keep
        bound = np.where(full, np.maximum(bound, least), bound)
    return pa.table({"query": queries["query"].take(pa.array(owner)), "score": pa.array(score),
                     "ids": vectors["ids"].take(pa.array(place))})


def _deal(index: Model):
    """Adds to queries their best vectors of the sample, which bound their last neighbour's score, and
    the blocks that can reach it."""
    blocks_before = np.cumsum(index.blocks) - index.blocks
    of_cell = [np.arange(at, at + n, dtype=np.int32) for at, n in zip(blocks_before, index.blocks)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _TILE_QUERIES):
                some = batch.slice(at, _TILE_QUERIES)
                matrix = _matrix(some.column(1))
                near = np.argsort(-(matrix @ index.sample.T), axis=1)[:, :index.keep]
                scores = np.array([_exact(matrix, index.sample[column]) for column in near.T])
                bound = scores.min(axis=0) if len(scores) == index.keep else np.full(len(matrix), -np.inf)
                seeds = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(matrix) + 1) * len(scores), pa.int32()),
                    pa.StructArray.from_arrays([pa.array(scores.T.ravel()), index.sample_ids.take(pa.array(near.ravel()))], ["score", "ids"]))
                reach = np.sqrt((matrix * matrix).sum(axis=1))[:, None] * index.radii
                most = matrix @ index.centres.T + reach
                met = ~(most + 1e-9 * (np.abs(most) + reach) < bound[:, None])
                lists = [np.concatenate([of_cell[c] for c in np.flatnonzero(row)] or [np.zeros(0, np.int32)]) for row in met]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(bound), seeds, pa.array(lists, pa.list_(pa.int32()))],
                                                 ["query", "vector", "bound", "seeds", "blocks"])

    return work


def nearest(index: Index, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
            spread: float = SPREAD) -> DataFrame:
    """The nearest indexed rows (one fewer than the index keeps) of every query: query_id, rank (from 1), vec_id, score.

    * Nearest first by inner product in double precision, ties to the smaller id; fewer rows if
      fewer take part. Rows with the query's own id are not among its neighbours.
    * Queries that could not be indexed, or have another length than the index, give no rows; a
      repeated query counts once. Other columns are not read. An empty index or no queries give an
      empty result.
    * A neighbour outside the sample is lost, and a later one found in its place, only if its estimate
      falls short by more than ``spread`` standard deviations.
    """
    model = index.model
    size = model.sample.shape[1] if len(model.sample) else 0
    asked = landed(_usable(queries, id_col, vector_col).filter(F.size("vector") == size), "asked")
    named = landed(asked.select("vector").distinct().withColumn("query", F.monotonically_increasing_id()), "queries")
    bounded = landed(named.select("query", "vector").mapInArrow(
        _deal(model), "query long, vector array<double>, bound double, "
                      "seeds array<struct<score:double,ids:array<long>>>, blocks array<int>"), "bounded")
    groups = max(1, -(-bounded.count() // QUERIES))
    left = bounded.select(F.explode("blocks").alias("block"), F.pmod(F.xxhash64("query"), F.lit(groups)).cast("int").alias("part"),
                          "query", "vector", "bound")
    right = index.rows.select("block", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"),
                              "ids", "vector", "cell", "code", "length", "correction")
    found = (left.groupBy("block", "part").cogroup(right.groupBy("block", "part"))
             .applyInArrow(lambda q, v: _search_block(q, v, model, spread), "query long, score double, ids array<long>"))
    seeds = bounded.select("query", F.explode("seeds").alias("seed")).select("query", "seed.score", "seed.ids")
    # a vector of the sample may be found again: equal rows share one place
    by_query = Window.partitionBy("query").orderBy(F.desc("score"), F.get("ids", F.lit(0)))
    first = found.union(seeds).withColumn("place", F.dense_rank().over(by_query)).filter(F.col("place") <= model.keep)
    # by score, then id: the scores are turned round, so that one ascending sort orders both
    listed = F.flatten(F.transform(F.collect_list(F.struct("score", "ids")), lambda x: F.transform(
        x["ids"], lambda i: F.struct((-x["score"]).alias("turned"), i.alias("vec_id")))))
    best = first.groupBy("query").agg(F.slice(F.array_sort(F.array_distinct(listed)), 1, model.keep).alias("best"))
    others = F.filter("best", lambda x: x["vec_id"] != F.col("id"))
    rows = asked.join(named, "vector").select("id", "query").join(best, "query")
    return (rows.select(F.col("id").alias("query_id"), F.posexplode(F.slice(others, 1, model.keep - 1)).alias("at", "near"))
            .select("query_id", (F.col("at") + 1).alias("rank"), "near.vec_id", (-F.col("near.turned")).alias("score")))
