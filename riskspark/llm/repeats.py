"""Removal of repeated byte strings across a corpus, by a difference cover.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts anywhere else. Suffixes
need to be told apart up to that depth only, so the difference cover algorithm runs to that
depth:

* Sampled suffixes start where the position modulo 133 lies in a perfect difference set of 12
  residues: for any two positions, one shift below 133 puts both on sampled positions. Their
  first 68 bytes are named by 64-bit fingerprints, the names are sorted, and adjacent equal ones
  tell which names repeat. Two equal strings of 200 bytes share a repeated name within their
  first 133 positions, so only strings that hold one can repeat.
* These remaining suffixes are merged the same way: the fingerprints of their first 200 bytes are
  sorted, and adjacent equal ones are the repeated strings.

Blocks get back one bit for each name they sent.

Names say where equal strings start; no order beyond the depth is made, so no ranks of the whole
corpus are shuffled in rounds of recursion.

Texts are dealt to blocks of bounded size by their hash, once; three steps read that same
exchange. A block sends each distinct name once, with a mark if it holds it several times, so a
passage that a third of all documents hold costs one name per block. Equal documents are reduced
to one before, in the same way. Names travel as sorted binary runs per block and range.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import text_of
from riskspark.llm.rolling import BYTE_VALUES, window_hashes
from riskspark.session import landed

LENGTH = 200
#: a perfect difference set: the differences of its members are all residues modulo 133
PERIOD = 133
COVER = (1, 10, 11, 13, 27, 31, 68, 75, 83, 110, 115, 121)
BLOCK_BYTES = 2 << 20
#: distinct names of one range that a task sorts, about
RANGE_NAMES = 1_500_000
#: bytes of a name that travel: the range takes further bits
SAMPLE_BYTES, STRING_BYTES = 5, 8


class Block:
    """Texts of a block laid end to end."""

    def __init__(self, texts: list[bytes], length: int):
        self.length = length
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = np.r_[0, np.cumsum(self.sizes)[:-1]] if len(texts) else np.empty(0, np.int64)
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)

    def values(self) -> np.ndarray:
        return BYTE_VALUES[self.bytes]

    def begins(self, width: int) -> np.ndarray:
        """Marks the positions at which a window of ``width`` bytes lies within one text."""
        marks = np.zeros(len(self.bytes), bool)
        for start, size in zip(self.starts.tolist(), self.sizes.tolist()):
            if size >= width:
                marks[start:start + size - width + 1] = True
        return marks

    def sampled(self) -> np.ndarray:
        """Positions of the difference cover, counted from each text's start."""
        marks = np.zeros(len(self.bytes), bool)
        for start, size in zip(self.starts.tolist(), self.sizes.tolist()):
            for residue in COVER:
                marks[start + residue:start + size:PERIOD] = True
        return np.flatnonzero(marks & self.begins(self.length - PERIOD + 1))

    def candidates(self, repeated: np.ndarray) -> np.ndarray:
        """Starts of strings that hold a repeated name at a sampled position of their first 133."""
        change = np.zeros(len(self.bytes) + 1, np.int32)
        text = np.searchsorted(self.starts, repeated, side="right") - 1
        np.add.at(change, np.maximum(repeated - PERIOD + 1, self.starts[text]), 1)
        np.add.at(change, repeated + 1, -1)
        return np.flatnonzero((np.cumsum(change[:-1]) > 0) & self.begins(self.length))

    def names(self, at: np.ndarray, width: int) -> np.ndarray:
        return window_hashes(self.values(), width, at)


def _runs(names: np.ndarray, ranges: int, kept: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(range, names held once, names held several times) as sorted binary runs."""
    names, times = np.unique(names, return_counts=True)
    place = _range_of(names, ranges)
    borders = np.searchsorted(place, np.arange(ranges + 1))
    short = _shortened(names, kept)
    for i in np.flatnonzero(np.diff(borders)):
        part = slice(borders[i], borders[i + 1])
        once = times[part] == 1
        yield int(i), _packed(short[part][once], kept), _packed(short[part][~once], kept)


def _range_of(names: np.ndarray, ranges: int) -> np.ndarray:
    """The upper 24 bits of a name choose its range, in order."""
    return ((names >> np.uint64(40)) * np.uint64(ranges) >> np.uint64(24)).astype(np.int64)


def _shortened(names: np.ndarray, kept: int) -> np.ndarray:
    return names & np.uint64(2 ** (8 * kept) - 1)


def _packed(names: np.ndarray, kept: int) -> bytes:
    return np.ascontiguousarray(names.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :kept]).tobytes()


def _unpacked(data: bytes, kept: int) -> np.ndarray:
    rows = np.frombuffer(data, np.uint8).reshape(-1, kept)
    full = np.zeros((len(rows), 8), np.uint8)
    full[:, :kept] = rows
    return full.view("<u8").ravel()


Key = tuple[pa.Scalar, ...]
_RUNS = pa.schema([("range", pa.int64()), ("block", pa.int64()), ("once", pa.binary()), ("several", pa.binary())])
_FOUND = pa.schema([("block", pa.int64()), ("range", pa.int64()), ("marks", pa.binary())])


def _repeated(kept: int):
    """For each block of a range, one bit for each name that it holds once: it stands in another
    block too. Groups below 0 are notes of a block to itself."""

    def work(key: Key, group: pa.Table) -> pa.Table:
        place = key[0].as_py()
        if place < 0:
            return pa.table([group["block"], group["range"], group["once"]], schema=_FOUND)
        once = [_unpacked(b, kept) for b in group["once"].to_pylist()]
        several = [_unpacked(b, kept) for b in group["several"].to_pylist()]
        names = np.sort(np.concatenate([*once, *several, *several]))
        again = names[1:][names[1:] == names[:-1]]
        rows = []
        for block, held in zip(group["block"].to_pylist(), once):
            marks = _among(held, again)
            if marks.any():
                rows.append((block, place, np.packbits(marks).tobytes()))
        columns = list(zip(*rows)) if rows else [[], [], []]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, _FOUND)], schema=_FOUND)

    return work


def _among(names: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(names), bool)
    return table[np.minimum(np.searchsorted(table, names), len(table) - 1)] == names


def _stand_elsewhere(names: np.ndarray, found: pa.Table, ranges: int) -> np.ndarray:
    """Which of a block's names stand anywhere else, from the bits reported back for the runs that
    ``_runs`` makes of the same names."""
    held, inverse, times = np.unique(names, return_inverse=True, return_counts=True)
    borders = np.searchsorted(_range_of(held, ranges), np.arange(ranges + 1))
    marks = times > 1
    for i, data in zip(found["range"].to_pylist(), found["marks"].to_pylist()):
        if i >= 0:
            once = borders[i] + np.flatnonzero(times[borders[i]:borders[i + 1]] == 1)
            marks[once] = np.unpackbits(np.frombuffer(data, np.uint8), count=len(once)).astype(bool)
    return marks[inverse]


def _block(texts: pa.Table, length: int) -> tuple[pa.Table, Block]:
    """The block of the distinct texts of a group, in the order of their hashes, which is the same
    in every step and attempt; each map task sent a text once."""
    order = {key: i for i, key in enumerate(zip(texts["h1"].to_pylist(), texts["h2"].to_pylist()))}
    texts = texts.take(pa.array([i for _, i in sorted(order.items())], pa.int64()))
    return texts, Block(texts["content"].to_pylist(), length)


def _once_per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = set()
    for batch in batches:
        keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        new = []
        for key in keys:
            new.append(key not in seen)
            seen.add(key)
        yield batch.filter(pa.array(new, pa.bool_()))


_EMPTY = hashlib.sha256().hexdigest()
_CHANGED = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                      ("kept_sha256", pa.string()), ("kept", pa.binary())])


def _cut(texts: pa.Table, block: Block, begins: np.ndarray, with_kept: bool) -> pa.Table:
    """Texts of a block that lose bytes to the repeated strings that start at ``begins``."""
    change = np.zeros(len(block.bytes) + 1, np.int32)
    change[begins] += 1
    change[begins + block.length] -= 1
    gone = np.cumsum(change[:-1]) > 0
    rows = []
    hit = np.unique(np.searchsorted(block.starts, begins, side="right") - 1)
    h1, h2 = texts["h1"], texts["h2"]
    for i in hit.tolist():
        part = slice(block.starts[i], block.starts[i] + block.sizes[i])
        lost = gone[part]
        kept = block.bytes[part][~lost].tobytes()
        spans = int(lost[0]) + int((lost[1:] & ~lost[:-1]).sum())
        rows.append((h1[i].as_py(), h2[i].as_py(), int(lost.sum()), spans, hashlib.sha256(kept).hexdigest(),
                     kept if with_kept else None))
    columns = list(zip(*rows)) if rows else [[] for _ in _CHANGED]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, _CHANGED)], schema=_CHANGED)


def _changed(dealt: DataFrame, ranges: int, length: int, with_kept: bool) -> DataFrame:
    """(h1, h2) of the texts that lose bytes, with what is left."""
    width = length - PERIOD + 1

    def names(key: Key, texts: pa.Table) -> pa.Table:
        _, block = _block(texts, length)
        return _run_table(key, _runs(block.names(block.sampled(), width), ranges, SAMPLE_BYTES))

    def strings(key: Key, texts: pa.Table, found: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return _RUNS.empty_table()
        _, block = _block(texts, length)
        at = block.sampled()
        repeated = _stand_elsewhere(block.names(at, width), found, ranges)
        at = block.candidates(at[repeated])
        if not len(at):
            return _RUNS.empty_table()
        note = (-1 - key[0].as_py(), np.packbits(repeated).tobytes(), b"")
        return _run_table(key, [note, *_runs(block.names(at, length), ranges, STRING_BYTES)])

    def cut(key: Key, texts: pa.Table, found: pa.Table) -> pa.Table:
        notes = [m for i, m in zip(found["range"].to_pylist(), found["marks"].to_pylist()) if i < 0]
        if not notes or not texts.num_rows:
            return _CHANGED.empty_table()
        texts, block = _block(texts, length)
        at = block.sampled()
        repeated = np.unpackbits(np.frombuffer(notes[0], np.uint8), count=len(at)).astype(bool)
        at = block.candidates(at[repeated])
        marks = _stand_elsewhere(block.names(at, length), found, ranges)
        return _cut(texts, block, at[marks], with_kept)

    by_block = lambda df: df.groupBy("block")
    runs = by_block(dealt).applyInArrow(names, "range long, block long, once binary, several binary")
    found = runs.groupBy("range").applyInArrow(_repeated(SAMPLE_BYTES), "block long, range long, marks binary")
    more = by_block(dealt).cogroup(by_block(found)).applyInArrow(
        strings, "range long, block long, once binary, several binary")
    again = more.groupBy("range").applyInArrow(_repeated(STRING_BYTES), "block long, range long, marks binary")
    return by_block(dealt).cogroup(by_block(again)).applyInArrow(
        cut, "h1 long, h2 long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def _run_table(key, runs) -> pa.Table:
    rows = [(i, key[0].as_py(), once, several) for i, once, several in runs]
    columns = list(zip(*rows)) if rows else [[], [], [], []]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, _RUNS)], schema=_RUNS)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                    block_bytes: int = BLOCK_BYTES, with_kept: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for,
    kept (the bytes left).

    * A byte goes if it is covered by a string of ``length`` bytes that starts at another place too,
      in the same or another row; strings never cross rows and are judged on the input.
    * A null text is empty; empty and short texts lose nothing. Equal texts of ``length`` bytes
      or more go whole. Repeated rows are rows like any other. Null ids are kept as they are.
    * Other columns are not read. An empty table gives an empty result.

    ``length`` must exceed the period of the difference cover.
    """
    if length <= PERIOD:
        raise ValueError(f"length must be more than {PERIOD}")
    hashes = [F.xxhash64("content"), F.xxhash64(F.lit(1), "content")]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).cast("binary").alias("content"))
    keyed = rows.select("id", F.octet_length("content").cast("long").alias("n_bytes"), hashes[0].alias("h1"),
                        hashes[1].alias("h2"), F.sha2("content", 256).alias("sha"),
                        *([F.col("content")] if with_kept else []))
    same = landed(keyed.filter(F.col("n_bytes") >= length).groupBy("h1", "h2")
                  .agg(F.count(F.lit(1)).alias("n"), F.max("n_bytes").alias("size")), "texts")
    total = same.agg(F.sum("size")).first()[0] or 0
    blocks = 1 + total // block_bytes
    ranges = 1 + total * len(COVER) // PERIOD // RANGE_NAMES
    # one row of each text from each map task, dealt to blocks
    dealt = (rows.filter(F.octet_length("content") >= length)
             .select(hashes[0].alias("h1"), hashes[1].alias("h2"), "content")
             .mapInArrow(_once_per_task, "h1 long, h2 long, content binary")
             .withColumn("block", F.pmod(F.xxhash64(F.lit(2), "h1", "h2"), F.lit(blocks))).repartition("block"))
    lost = _changed(dealt, ranges, length, with_kept)
    whole = F.col("n") > 1
    decided = same.join(lost, ["h1", "h2"], "left").filter(whole | F.col("n_removed").isNotNull()).select(
        "h1", "h2", F.when(whole, F.col("size")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.col("n_spans")).cast("long").alias("n_spans"),
        F.when(whole, F.lit(_EMPTY)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        F.when(whole, F.lit(b"")).otherwise(F.col("kept")).alias("kept"))
    # written, so that the join shuffles both sides itself and can split a text with very many copies
    decided = landed(decided if with_kept else decided.drop("kept"), "decided")
    out = keyed.join(decided.hint("merge"), ["h1", "h2"], "left")
    return out.select("id", "n_bytes", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
                      F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"),
                      F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
                      *([F.coalesce("kept", "content").alias("kept")] if with_kept else []))
