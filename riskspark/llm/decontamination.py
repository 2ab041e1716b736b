"""Benchmark decontamination by the q-gram lemma.

A document leaks an item if some stretch of it lies within the item's edit budget: at most
``MAX_ERROR`` of the item's length. Two strings within k edits share at least m + 1 - q (k + 1)
q-grams of the m characters' own, on diagonals that lie at most k apart. So the q-grams that a
document shares with an item are counted in overlapping diagonal bands of k + 1 diagonals, only
bands that meet the bound are retained, and each retained region is verified by a banded
alignment of the item against it.

The documents are never shuffled. The benchmark is indexed in blocks of at most ``BLOCK_CHARS``
characters, one after the other; only one block's index is in a task's memory at a time, whatever
the size of the benchmark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import byte_batches, packed_texts, text_of
from riskspark.llm.rolling import window_hashes

Q = 9
MAX_ERROR = 0.08
BLOCK_CHARS = 4_000_000
_FILTER_BITS = 22
_OTHER = re.compile(r"[\W_]+")


def normalised(text: str) -> str:
    """Lower case, one space for every run of other characters than letters and digits."""
    return _OTHER.sub(" ", text.lower()).strip()


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def budget(length: int, q: int = Q, max_error: float = MAX_ERROR) -> int:
    """Edits allowed for an item: its share, or fewer where the lemma's bound would reach 0."""
    return max(0, min(int(length * max_error), (length + 1) // q - 2))


class Index:
    """The q-grams of a block of items, sorted, with the items and places they stand at."""

    def __init__(self, items: list[tuple[int, str]], q: int = Q, max_error: float = MAX_ERROR):
        self.q = q
        self.items = [(i, t) for i, t in ((i, normalised(t or "")) for i, t in items) if len(t) >= q]
        self.lengths = np.array([len(t) for _, t in self.items], np.int64)
        self.budgets = np.array([budget(len(t), q, max_error) for _, t in self.items], np.int64)
        self.bounds = self.lengths + 1 - q * (self.budgets + 1)
        grams = [window_hashes(_codes(t).astype(np.uint64) + np.uint64(1), q) for _, t in self.items]
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams] or [np.empty(0, np.int64)])
        hashes = np.concatenate(grams or [np.empty(0, np.uint64)])
        order = np.argsort(hashes, kind="stable")
        self.item, self.place = item[order], place[order]
        self.grams, self.first, self.times = np.unique(hashes[order], return_index=True, return_counts=True)
        self.seen = np.zeros(1 << _FILTER_BITS, bool)
        self.seen[(self.grams >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text position, item and item position of every shared q-gram."""
        hashes = window_hashes(codes.astype(np.uint64) + np.uint64(1), self.q)
        at = np.flatnonzero(self.seen[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        gram = np.minimum(np.searchsorted(self.grams, hashes[at]), len(self.grams) - 1)
        true = self.grams[gram] == hashes[at]
        at, gram = at[true], gram[true]
        times = self.times[gram]
        entry = np.repeat(self.first[gram] - np.cumsum(times) + times, times) + np.arange(times.sum())
        return np.repeat(at, times), self.item[entry], self.place[entry]

    def find(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, int]]:
        """(text number, item id, edits, start, end) of the best stretch of each leaked item, in
        characters of the normalised text."""
        if not self.items or not texts:
            return
        plain = [normalised(t) for t in texts]
        gap = "\0" * self.q
        ends = np.cumsum([len(t) + self.q for t in plain])
        starts = np.r_[0, ends[:-1]]
        at, item, place = self.hits(_codes(gap.join(plain)))
        if not len(at):
            return
        text = np.searchsorted(ends, at, side="right")
        longest = int(self.lengths.max())
        diagonal = at - starts[text] - place + longest
        band = diagonal // (self.budgets[item] + 1)
        bands = int(band.max()) + 2
        key = (text * len(self.items) + item) * bands + band + 1
        key, shared = np.unique(np.concatenate([key, key - 1]), return_counts=True)
        pair, band = key // bands, key % bands - 1
        kept = shared >= self.bounds[pair % len(self.items)]
        best: dict[int, tuple[int, int, int]] = {}
        for pair, band in zip(pair[kept].tolist(), band[kept].tolist()):
            if best.get(pair, (1,))[0] == 0:
                continue
            number, which = divmod(pair, len(self.items))
            wanted, allowed = self.items[which][1], int(self.budgets[which])
            low = band * (allowed + 1) - longest  # the region's first diagonal
            start = max(0, low - allowed)
            region = plain[number][start:max(0, low + 3 * allowed + 2 + len(wanted))]
            found = aligned(wanted, region, allowed, low - start)
            if found and (pair not in best or found[0] < best[pair][0]):
                best[pair] = (found[0], start + found[1], start + found[2])
        for pair, (edits, start, end) in sorted(best.items()):
            number, which = divmod(pair, len(self.items))
            yield number, self.items[which][0], edits, start, end


def aligned(wanted: str, region: str, allowed: int, low: int) -> tuple[int, int, int] | None:
    """Fewest edits that turn ``wanted`` into a stretch of ``region``, with that stretch; None if
    more than ``allowed``. Only cells on diagonals ``low - allowed`` to ``low + 3 allowed + 1`` are
    filled: those an alignment on the band's diagonals can reach."""
    at = region.find(wanted)
    if at >= 0:
        return 0, at, at + len(wanted)
    if not allowed:
        return None
    a, b = _codes(wanted), _codes(region)
    first, width = low - allowed, 4 * allowed + 2
    far = len(wanted) + 1
    offsets = np.arange(width)
    columns = first + offsets
    cost = np.where((columns >= 0) & (columns <= len(b)), 0, far)
    begin = columns.copy()
    for i, letter in enumerate(a, 1):
        columns = i + first + offsets
        inside = (columns >= 0) & (columns <= len(b))
        equal = np.zeros(width, bool)
        here = inside & (columns >= 1)
        equal[here] = b[columns[here] - 1] == letter
        straight = np.where(here, cost + ~equal, far)
        down = np.append(cost[1:] + 1, far)
        use = down < straight
        now = np.where(inside, np.where(use, down, straight), far)
        source = np.where(use, np.append(begin[1:], 0), begin)
        # steps to the right add one edit for each column
        level = now - offsets
        reach = np.minimum.accumulate(level)
        origin = np.maximum.accumulate(np.where(level == reach, offsets, 0))
        begin = source[origin]
        cost = np.where(inside, reach + offsets, far)
    best = int(cost.argmin())
    if cost[best] > allowed:
        return None
    return int(cost[best]), int(begin[best]), int(len(a) + first + best)


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    items = benchmark.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = 1 + chars // block_chars
    for block in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block).collect()
        if rows:
            yield [(r.id, r.text) for r in rows]


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text_col: str = "text", q: int = Q, max_error: float = MAX_ERROR,
          block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document row and item that it leaks: id, item_id, edits, item_chars, start, end
    (in characters of the normalised text).

    * Texts are compared after lower-casing and turning runs of other characters than letters
      and digits into one space. Null texts are empty; empty documents leak nothing.
    * Items with fewer than ``q`` characters left are too short to show a leak and are ignored.
    * Repeated documents are reported each; repeated items too. An empty table of either kind
      gives an empty result. Other columns are not read.
    """
    schema = "id long, item_id long, edits int, item_chars int, start int, end int"
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    parts = [rows.mapInArrow(_reporter(items, q, max_error), schema)
             for items in _blocks(benchmark, item_col, item_text_col, block_chars)]
    return reduce(DataFrame.union, parts) if parts else docs.sparkSession.createDataFrame([], schema)


def _reporter(items, q, max_error):
    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(items, q, max_error)
        chars = {i: len(t) for i, t in index.items}
        for batch in byte_batches(batches, "text"):
            ids = batch.column(0).to_pylist()
            found = [(ids[n], item, edits, chars[item], start, end)
                     for n, item, edits, start, end in index.find(batch.column(1).to_pylist())]
            if found:
                types = (pa.int64(), pa.int64(), *[pa.int32()] * 4)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)],
                                                 ["id", "item_id", "edits", "item_chars", "start", "end"])

    return report


def drop_leaking(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                 item_text_col: str = "text", q: int = Q, max_error: float = MAX_ERROR,
                 block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` that leak no item, all columns kept; nothing is shuffled."""

    def sieve(items):
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(items, q, max_error)
            for batch in byte_batches(batches, text_col, packed=True):
                good = np.ones(batch.num_rows, bool)
                good[[n for n, *_ in index.find([t or "" for t in packed_texts(batch, text_col).to_pylist()])]] = False
                yield batch.filter(pa.array(good))

        return keep

    rows = docs.select(F.struct("*").alias("_row"))
    for items in _blocks(benchmark, item_col, item_text_col, block_chars):
        rows = rows.mapInArrow(sieve(items), rows.schema)
    return rows.select("_row.*")
