"""Periodic runs of words: maximal stretches that repeat with their smallest period.

Per text, a suffix automaton is built over word numbers; its suffix links form a tree in which the
path from a prefix's state to the root lists all suffixes of that prefix. The prefixes are visited
in order. Each visit recolours its path with the prefix's end, by link-cut access: paths of one
colour are splay trees, and a visit joins the pieces it crosses. A piece with colour j and deepest
length L says that the last L words before end i stood before end j too, and nowhere in between. If
i - j <= L, the two copies touch: L + (i - j) words ending at i have the smallest period i - j, and
cannot grow to the left. The last i that reports the same start and period is the run's end. There
are O(n log n) pieces, so time follows the text's length up to logarithms, whatever its periods.

Only stretches in which runs are possible go through the automaton. Every run of 12 words or more
is covered, without a gap, by groups of six words that occur again in the same text; these are found
by sorting hashes, whose collisions can only add stretches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import byte_batches, text_of

SHORTEST = 12
GROUP = 6
_FACTORS = [np.uint64(pow(0x9E3779B97F4A7C15, i, 1 << 64)) for i in range(1, GROUP + 1)]

Words = list[bytes]
Run = tuple[int, int, int]


def _automaton(ids: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Suffix links and lengths of the states, counted from 1 (the root; 0 is none), and the state
    of each prefix."""
    link, length, nexts, prefixes = [0, 0], [0, 0], [{}, {}], []
    last = 1
    for word in ids:
        state = len(link)
        length.append(length[last] + 1)
        nexts.append({})
        link.append(1)
        p = last
        while p and word not in nexts[p]:
            nexts[p][word] = state
            p = link[p]
        if p:
            q = nexts[p][word]
            if length[p] + 1 == length[q]:
                link[state] = q
            else:
                clone = len(link)
                length.append(length[p] + 1)
                nexts.append(dict(nexts[q]))
                link.append(link[q])
                while p and nexts[p].get(word) == q:
                    nexts[p][word] = clone
                    p = link[p]
                link[q] = link[state] = clone
        last = state
        prefixes.append(state)
    return link, length, prefixes


class _Paths:
    """Coloured paths of a rooted forest. ``up`` is a node's parent inside its splay tree or, at the
    top of one, the node above its path; ``colour`` holds at the top of a splay tree."""

    def __init__(self, link: list[int]):
        self.up = list(link)
        self.low = [0] * len(link)  # nearer to the root of the forest
        self.high = [0] * len(link)
        self.colour = [-1] * len(link)

    def _rotate(self, x: int) -> None:
        up, low, high = self.up, self.low, self.high
        y = up[x]
        z = up[y]
        if low[z] == y:
            low[z] = x
        elif high[z] == y:
            high[z] = x
        else:
            self.colour[x] = self.colour[y]
        up[x] = z
        if low[y] == x:
            low[y] = moved = high[x]
            high[x] = y
        else:
            high[y] = moved = low[x]
            low[x] = y
        if moved:
            up[moved] = y
        up[y] = x

    def splay(self, x: int) -> None:
        up, low, high, rotate = self.up, self.low, self.high, self._rotate
        while (y := up[x]) and (low[y] == x or high[y] == x):
            z = up[y]
            if z and (low[z] == y or high[z] == y):
                rotate(y if (low[z] == y) == (low[y] == x) else x)
            rotate(x)

    def visit(self, node: int, colour: int) -> list[tuple[int, int]]:
        """Gives the path from the root to ``node`` one colour; returns (colour before, deepest node)
        of its pieces, deepest first."""
        pieces = []
        x, joined = node, 0
        while x:
            self.splay(x)
            old = self.colour[x]
            if beyond := self.high[x]:
                self.colour[beyond] = old
            if old >= 0 and (not pieces or pieces[-1][0] != old):
                pieces.append((old, x))
            self.high[x] = joined
            joined, x = x, self.up[x]
        self.colour[joined] = colour
        self.splay(node)
        return pieces


def _runs_of(ids: list[int], shift: int) -> list[Run]:
    link, length, prefixes = _automaton(ids)
    paths, ends = _Paths(link), {}
    for end, state in enumerate(prefixes):
        for before, node in paths.visit(state, end):
            period = end - before
            if period <= length[node]:
                ends[end - length[node] - period + 1, period] = end
    return [(shift + start, end - start + 1, period) for (start, period), end in ends.items()
            if end - start + 1 >= SHORTEST]


def _stretches(words: Words) -> list[tuple[int, int]]:
    """Maximal stretches of words covered by groups of six words that occur more than once."""
    n = len(words) - GROUP + 1
    if n < 2:
        return []
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    groups = np.zeros(n, np.uint64)
    for i, factor in enumerate(_FACTORS):
        groups += hashes[i:n + i] * factor
    order = np.argsort(groups, kind="stable")
    same = groups[order[1:]] == groups[order[:-1]]
    if not same.any():
        return []
    again = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    cuts = np.flatnonzero(np.diff(again) > GROUP)  # farther apart than a group reaches: a word between is not covered
    starts, lasts = again[np.r_[0, cuts + 1]], again[np.r_[cuts, len(again) - 1]]
    return [(int(a), int(b) + GROUP) for a, b in zip(starts, lasts) if b + GROUP - a >= SHORTEST]


def runs(words: Words) -> list[Run]:
    """(start, length, period) of every run of at least 12 words and two periods, by start, then period."""
    found = []
    for a, b in _stretches(words):
        numbers: dict[bytes, int] = {}
        found += _runs_of([numbers.setdefault(w, len(numbers)) for w in words[a:b]], a)
    return sorted(found, key=lambda run: (run[0], run[2]))


def collapsed(words: Words, found: list[Run]) -> Words:
    """The words that stand in no run behind its first period."""
    if not found:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]


FIELDS = ("id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
          "collapsed_sha256 string")


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  rewrite: Callable[[int | None, Words], Words] | None = None, with_details: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, n_runs, the greatest run (start, length, period and
    exponent_milli, its length over its period in thousandths), runs_sha256, collapsed_sha256.

    * Words are split at ASCII white space and compared byte by byte. ``rewrite`` may change a row's
      words first.
    * Of runs of one length the first start, then the smallest period is the greatest; without runs
      the four columns are null. runs_sha256 digests ``start,length,period`` lines of all runs,
      collapsed_sha256 the words that remain if each run is cut to its first period, joined by spaces.
    * ``with_details`` adds runs (all of them) and collapsed (the remaining text).
    * A null text is empty; empty texts have no runs. Repeated rows and null ids are reported each;
      other columns are not read; an empty table gives an empty result. Memory follows the longest
      text: some 500 bytes for each of its words that repeat.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_batches(batches, "text"):
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                words = text.split()
                if rewrite:
                    words = rewrite(key, words)
                found = runs(words)
                left = b" ".join(collapsed(words, found))
                lines = "".join(f"{s},{n},{p}\n" for s, n, p in found).encode()
                start, length, period = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
                row = {"id": key, "n_runs": len(found), "start": start, "length": length, "period": period,
                       "exponent_milli": 1000 * length // period if found else None,
                       "runs_sha256": hashlib.sha256(lines).hexdigest(),
                       "collapsed_sha256": hashlib.sha256(left).hexdigest()}
                if with_details:
                    row["runs"] = [{"start": s, "length": n, "period": p} for s, n, p in found]
                    row["collapsed"] = left.decode()
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema)

    fields = [pa.field(f.split()[0], {"long": pa.int64(), "string": pa.string()}[f.split()[1]]) for f in FIELDS.split(", ")]
    details = ""
    if with_details:
        run = pa.struct([(name, pa.int64()) for name in ("start", "length", "period")])
        fields += [pa.field("runs", pa.list_(run)), pa.field("collapsed", pa.string())]
        details = ", runs array<struct<start:long,length:long,period:long>>, collapsed string"
    schema = pa.schema(fields)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(work, FIELDS + details)
