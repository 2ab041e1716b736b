"""Near duplicates by 64-bit fingerprints of word shingles, candidates by the pigeonring rule.

A fingerprint has eight segments of one byte, seen as a ring. Two fingerprints that differ in at
most 3 bits have a start from which every chain of l consecutive segments differs in at most
3 l / 8 bits: none in the first two, one in the first five, two in the first seven. So at one
start the first two segments are equal, and so are two of the next three. These four bytes are
the key under which candidates meet: 24 keys for a fingerprint, 32 bits each. Candidates that
break the chain's budget further on are pruned before the full count of differing bits.

Only distinct fingerprints are compared, so copies cost nothing, and each group of candidates
emits a spanning star of its connected parts, not its pairs. A key with more than ``GROUP``
fingerprints is dealt to pairs of parts of that size, each compared in a task of its own; every
pair of its fingerprints still meets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import byte_batches, row_key, text_of, without_keys, words_of
from riskspark.llm.components import components
from riskspark.session import landed

BITS, SEGMENTS, BUDGET = 64, 8, 3
SEED = 42
SHINGLE = 3
GROUP = 512
_ROWS_AT_ONCE = 1 << 16


def fingerprint(text: str, width: int = SHINGLE) -> int:
    """The text's fingerprint as a signed 64-bit number; 0 if it has no words."""
    words = words_of(text.encode("utf-8"))
    if not words:
        return 0
    if len(words) < width:
        words, width = [b" ".join(words)], 1
    digests = map(lambda shingle: xxhash.xxh64_digest(shingle, SEED),
                  map(b" ".join, zip(*(words[i:] for i in range(width)))) if width > 1 else words)
    hashes = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, BITS // 8)
    ones = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), _ROWS_AT_ONCE):
        ones += np.unpackbits(hashes[start:start + _ROWS_AT_ONCE], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text_hash (tells rows with equal ids apart) and fp of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_batches(batches, "text"):
            found = [fingerprint(text) for text in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int64())],
                                             ["id", "text_hash", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_of(text_col)).alias("text_hash"),
                       text_of(text_col).alias("text"))
    return rows.mapInArrow(work, "id long, text_hash long, fp long")


def _segment(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * (i % SEGMENTS)).bitwiseAND(F.lit(255))


def _keys(fp: Column) -> Column:
    keys = []
    for start in range(SEGMENTS):
        for left_out in (2, 3, 4):
            key = F.lit(start * SEGMENTS + left_out).cast("long")
            for step in (0, 1, *(s for s in (2, 3, 4) if s != left_out)):
                key = F.shiftleft(key, 8).bitwiseOR(_segment(fp, start + step))
            keys.append(key)
    return F.array(*keys)


def _chain(start: int, length: int) -> np.uint64:
    return np.uint64(sum(255 << (8 * ((start + i) % SEGMENTS)) for i in range(length)))


def _stars(fps: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Links every fingerprint to the first of its connected part within one group."""
    differ = fps[:, None] ^ fps[None, :]
    near = np.ones(differ.shape, bool)
    for length in range(3, SEGMENTS):
        near &= np.bitwise_count(differ & _chain(start, length)) <= BUDGET * length // SEGMENTS
    near &= np.bitwise_count(differ) <= BUDGET
    label = np.arange(len(fps))
    while True:
        least = np.where(near, label[None, :], len(fps)).min(axis=1)
        if (least == label).all():
            break
        label = least
    linked = label != np.arange(len(fps))
    return fps[linked], fps[label[linked]]


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads rows sorted by (key, part); a group may go on in the next batch."""
    rest = np.empty((0, 3), np.int64)
    for batch in batches:
        rows = np.column_stack([column.to_numpy(zero_copy_only=False) for column in batch.columns])
        rows = np.concatenate([rest, rows])
        yield from _linked(rows, last := _last_group(rows))
        rest = rows[last:]
    yield from _linked(rest, len(rest))


def _last_group(rows: np.ndarray) -> int:
    changes = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1))
    return int(changes[-1]) + 1 if len(changes) else 0


def _linked(rows: np.ndarray, end: int) -> Iterator[pa.RecordBatch]:
    rows = rows[:end]
    if len(rows) < 2:
        return
    borders = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1
    starts, ends = np.r_[0, borders], np.r_[borders, len(rows)]
    a, b = [], []
    for i in np.flatnonzero(ends - starts > 1):
        group = rows[starts[i]:ends[i]]
        ring_start = int(group[0, 0] >> 32) // SEGMENTS
        found = _stars(group[:, 2].astype(np.uint64), ring_start)
        a.append(found[0])
        b.append(found[1])
    if a and sum(map(len, a)):
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(x).astype(np.int64), pa.int64()) for x in (a, b)], ["a", "b"])


def near_links(fps: DataFrame, group: int = GROUP) -> DataFrame:
    """Edges (a, b) that connect distinct fingerprints ``fp`` exactly as links of at most three
    differing bits do; not all links are listed."""
    entries = fps.select("fp", F.explode(_keys(F.col("fp"))).alias("key"))
    busy = (entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > group)
            .select("key", F.ceil(F.col("n") / F.lit(group)).cast("int").alias("parts")))
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    met = F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1),
                    lambda other: F.least(part, other).cast("long") * F.col("parts") + F.greatest(part, other)))
    dealt = entries.join(busy, "key", "left").select("key", F.explode(met).alias("part"), "fp")
    sorted_rows = dealt.repartition("key", "part").sortWithinPartitions("key", "part", "fp")
    return sorted_rows.mapInArrow(_link, "a long, b long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, text_hash, fp, component_id and first_hash.

    * component_id is the smallest id reachable over links of at most three differing bits; null
      only if all ids of the component are null. first_hash belongs to the row that stays: the
      smallest text_hash among the rows with that id.
    * A text without words, and so a null one, has fingerprint 0 and is linked like any other; a
      text with fewer than three words is one shingle.
    * Repeated rows share a component. Other columns are not read; an empty table gives an
      empty result.
    """
    return grouped(landed(fingerprints(docs, id_col, text_col), "fingerprints"), near_links)


def grouped(rows: DataFrame, links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``rows`` (id, text_hash, fp) with the component of each over the edges that ``links`` gives
    for the distinct values of fp, as ``near_groups`` returns them."""
    first = F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash")
    distinct = landed(rows.groupBy("fp").agg(F.min(first).alias("first")), "distinct")
    linked = components(links(distinct.select("fp")))
    rooted = landed(distinct.join(linked.select(F.col("node").alias("fp"), "component"), "fp", "left")
                    .select("fp", F.coalesce("component", "fp").alias("root"), "first"), "roots")
    firsts = rooted.groupBy("root").agg(F.min("first").alias("first"))
    named = rooted.select("fp", "root").join(firsts, "root").select("fp", "first")
    return rows.join(named, "fp").select("id", "text_hash", "fp", F.col("first.id").alias("component_id"),
                                         F.col("first.text_hash").alias("first_hash"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their group of near duplicates, all columns kept."""
    return without_near_copies(docs, near_groups(docs, id_col, text_col), id_col, text_col)


def without_near_copies(docs: DataFrame, groups: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that stay by ``groups``, all columns kept."""
    stays = F.col("id").eqNullSafe(F.col("component_id")) & (F.col("text_hash") == F.col("first_hash"))
    dropped = groups.filter(~stays).select(row_key("id", F.col("text_hash")).alias("_key")).distinct()
    rows = docs.select(row_key(id_col, F.xxhash64(text_of(text_col))).alias("_key"), F.struct("*").alias("_row"))
    return without_keys(rows, dropped)
