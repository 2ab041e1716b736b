"""Alignment of two tokenizers' tokens on the bytes of the same texts.

Each task encodes a slice of texts with both tokenizers and goes on in Arrow: token lists are
flattened beside their parent indices, byte lengths are taken from the vocabulary, and cumulative
sums per document give the byte at which each token ends. An Acero hash join on (document, end)
yields the links, and a group_by the number of times a document links two ids. Spark sums these
partial counts over the corpus and joins the sums back to the documents.

Tokenizers get texts in parts, cut at single spaces between characters that are neither white
space nor the space mark. No token of either kind crosses such a place, and the mark that the piece
encoder puts before a part stands for the space, so the tokens are those of the whole text.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain, count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskspark.llm.common import byte_batches, text_of
from riskspark.session import landed

BYTE_MODEL, PIECE_MODEL = "byte_bpe_50k.json", "piece_bpe_32k.model"
SPACE_MARK = "▁"
SAFE = re.compile(f"(?<=[^\\s{SPACE_MARK}]) (?=[^\\s{SPACE_MARK}])")
#: bounds of the parts whose tokens a task keeps
KNOWN_PARTS, KNOWN_CHARS = 500_000, 1 << 23
#: rows of pair counts (24 bytes each) up to which they are sent to every executor; more are joined by a shuffle
SMALL_COUNTS = 1_000_000


class Vocabulary(NamedTuple):
    """A tokenizer's encoder and, by id, the bytes of its tokens."""
    model: object
    content: pa.Array
    lengths: pa.Array
    names: pa.Array


def _vocabulary(model: object, content: list[bytes]) -> Vocabulary:
    held = pa.array(content, pa.large_binary())
    return Vocabulary(model, held, pc.cast(pc.binary_length(held), pa.int64()), pa.array(map(str, range(len(content))), pa.large_string()))


@lru_cache(maxsize=2)
def byte_vocabulary(path: str) -> Vocabulary:
    """A byte-level tokenizer: characters of its entries stand for single bytes."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.encode_special_tokens = True
    # the byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    of_char = {chr(b): b for b in plain}
    of_char |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    entries = (model.id_to_token(i) or "" for i in range(model.get_vocab_size()))
    return _vocabulary(model, [bytes(of_char[c] for c in entry) if all(c in of_char for c in entry) else entry.encode()
                               for entry in entries])


@lru_cache(maxsize=2)
def piece_vocabulary(path: str) -> Vocabulary:
    """A tokenizer of pieces with byte fallback, in which a mark stands for a space."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any(SPACE_MARK in piece.lstrip(SPACE_MARK) for piece in pieces):
        raise ValueError(f"{path}: a piece holds a space mark behind another character; texts cannot be cut at spaces")
    return _vocabulary(model, [bytes([int(piece[1:-1], 16)]) if model.is_byte(i) else
                               piece.replace(SPACE_MARK, " ").encode() for i, piece in enumerate(pieces)])


class Encoder:
    """Token lists of text parts by both tokenizers. A corpus repeats most of its parts, so they are
    kept, up to a bound, and encoded once."""

    def __init__(self, one: Vocabulary, other: Vocabulary):
        self.vocabularies = one, other
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.chars = 0
        self.ids, self.borders = (array("i"), array("i")), (array("i", [0]), array("i", [0]))

    def lists(self, parts: list[str]) -> tuple[pa.ListArray, pa.ListArray]:
        """One list of ids per part from each tokenizer."""
        if len(self.known) > KNOWN_PARTS or self.chars > KNOWN_CHARS:
            self._forget()  # the frequent parts come back at once
        new = list({part for part in parts if part not in self.known})
        self.known.update(zip(new, count(len(self.known))))
        self.chars += sum(map(len, new))
        one, other = (v.model for v in self.vocabularies)
        encoded = ([e.ids for e in one.encode_batch_fast([" " + part for part in new], add_special_tokens=False)],
                   other.encode(new, num_threads=1)) if new else ([], [])
        places = pa.array(np.fromiter(map(self.known.__getitem__, parts), np.int32, len(parts)))
        found = []
        for lists, ids, borders in zip(encoded, self.ids, self.borders):
            ids.extend(chain.from_iterable(lists))
            borders.extend(accumulate(map(len, lists), initial=borders.pop()))
            kept = pa.ListArray.from_arrays(pa.array(np.array(borders)), pa.array(np.array(ids)))
            found.append(kept.take(places))
        return found[0], found[1]


class _Tokens(NamedTuple):
    ids: pa.Array
    parents: np.ndarray
    ends: np.ndarray
    ok: np.ndarray


def _tokens(lists: pa.ListArray, owners: np.ndarray, want: list[bytes], vocabulary: Vocabulary) -> _Tokens:
    """Tokens of all parts as flat columns: id, document, end in the document's bytes; and which
    documents the tokens spell byte by byte."""
    ids = pc.list_flatten(lists)
    parents = owners[pc.list_parent_indices(lists).to_numpy()]
    sums = pc.cumulative_sum(vocabulary.lengths.take(ids)).to_numpy()
    borders = np.searchsorted(parents, np.arange(len(want) + 1))
    before = np.concatenate([[0], sums])[borders]
    spelled = pc.binary_join(pa.ListArray.from_arrays(pa.array(borders, pa.int32()), vocabulary.content.take(ids)),
                             pa.scalar(b"", pa.large_binary()))
    ok = pc.equal(spelled, pa.array(want, pa.large_binary())).to_numpy(zero_copy_only=False)
    return _Tokens(ids, parents, sums - before[parents], ok)


def _table(tokens: _Tokens, ok: np.ndarray, name: str) -> pa.Table:
    keep = ok[tokens.parents]
    return pa.table({"doc": pa.array(tokens.parents[keep], pa.int64()), "end": pa.array(tokens.ends[keep], pa.int64()),
                     name: tokens.ids.filter(pa.array(keep))})


def _keys(table: pa.Table, width: int) -> np.ndarray:
    return table["doc"].to_numpy() * width + table["end"].to_numpy()


def _joined(texts: pa.Array, borders: np.ndarray, by: str) -> pa.Array:
    lists = pa.ListArray.from_arrays(pa.array(borders, pa.int32()), texts)
    return pc.binary_join(lists, pa.scalar(by, pa.large_string()))


def _group_texts(tokens: pa.Table, column: str, cuts: np.ndarray, width: int, names: pa.Array) -> pa.Array:
    """The decimal ids of each group, comma-joined; a group ends at each of ``cuts``."""
    group = np.searchsorted(cuts, _keys(tokens, width))
    borders = np.searchsorted(group, np.arange(len(cuts) + 1))
    return _joined(names.take(tokens[column].combine_chunks()), borders, ",")


def _aligned(texts: list[str | None], encoder: Encoder) -> dict[str, pa.Array]:
    """The columns of ``align`` behind id for a slice of texts."""
    n = len(texts)
    one, other = encoder.vocabularies
    cut = [SAFE.split(text) if text else [] for text in texts]
    owners = np.repeat(np.arange(n), [len(c) for c in cut])
    want = [b" " + text.encode() if text else b"" for text in texts]
    in_one, in_other = encoder.lists(list(chain.from_iterable(cut)))
    first, second = _tokens(in_one, owners, want, one), _tokens(in_other, owners, want, other)
    ok = first.ok & second.ok
    a, b = _table(first, ok, "a"), _table(second, ok, "b")
    links = a.join(b, ["doc", "end"], join_type="inner", use_threads=False)
    size = len(other.content)
    pair = pc.add(pc.multiply(links["a"].cast(pa.int64()), size), links["b"].cast(pa.int64()))
    counts = (pa.table({"doc": links["doc"], "pair": pair}).group_by(["doc", "pair"], use_threads=False)
              .aggregate([([], "count_all")]).sort_by([("doc", "ascending"), ("pair", "ascending")]))
    width = max(map(len, want), default=0) + 1
    keys = np.sort(_keys(links, width))
    cuts = keys[np.diff(keys, prepend=-1) > 0]
    groups = pc.binary_join_element_wise(_group_texts(a, "a", cuts, width, one.names),
                                         _group_texts(b, "b", cuts, width, other.names), pa.scalar("|", pa.large_string()))
    group_borders = np.searchsorted(cuts, np.arange(n + 1) * width)
    joined = _joined(groups, group_borders, ";")
    digests = [hashlib.sha256(text.encode()).hexdigest() if text else "" for text in joined.to_pylist()]
    per_doc = lambda table: pa.array(np.bincount(table["doc"].to_numpy(), minlength=n).astype(np.int64))
    borders = pa.array(np.searchsorted(counts["doc"].to_numpy(), np.arange(n + 1)), pa.int32())
    return {"n_a": per_doc(a), "n_b": per_doc(b), "n_groups": pa.array(np.diff(group_borders), pa.int64()), "n_links": per_doc(links),
            "groups_sha256": pa.array(digests, pa.string()),
            "pairs": pa.ListArray.from_arrays(borders, counts["pair"].combine_chunks()),
            "times": pa.ListArray.from_arrays(borders, counts["count_all"].combine_chunks().cast(pa.int64()))}


class Alignment(NamedTuple):
    """Both tables are written in the shared folder.

    documents: row, id, n_a, n_b, n_groups, n_links, groups_sha256, pairs (a * ids of B + b) and
    times (how often the document links each). counts: pair, a, b, n (links of the corpus), best
    (n is the highest of its b)."""
    documents: DataFrame
    counts: DataFrame


def align(docs: DataFrame, byte_model: str, piece_model: str, id_col: str = "doc_id", text_col: str = "text") -> Alignment:
    """Aligns the tokens of space + text by ``byte_model`` (A) with those of text by ``piece_model`` (B).

    * A link is a token of A and one of B that end at the same byte of a text; these bytes cut the
      tokens into groups.
    * A text that is null or empty, or that the tokens of A or B do not spell byte by byte, has no
      tokens: zeros, no pairs, and '' for groups_sha256.
    * Of ids with one count all are best. Repeated rows and null ids count each; other columns are
      not read; an empty table gives empty results. Both files must be readable on every executor.
      Memory follows the longest text.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(byte_vocabulary(byte_model), piece_vocabulary(piece_model))
        for batch in byte_batches(batches, "text"):
            columns = {"row": batch.column(0), "id": batch.column(1)} | _aligned(batch.column(2).to_pylist(), encoder)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"),
                       text_of(text_col).alias("text"))
    found = landed(rows.mapInArrow(work, "row long, id long, n_a long, n_b long, n_groups long, n_links long, "
                                         "groups_sha256 string, pairs array<long>, times array<long>"), "aligned")
    ids = F.lit(len(piece_vocabulary(piece_model).content)).cast("long")
    sums = _exploded(found).groupBy("pair").agg(F.sum("times").alias("n"))
    named = sums.select("pair", F.floor(F.col("pair") / ids).alias("a"), (F.col("pair") % ids).alias("b"), "n")
    counts = named.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b")))
    return Alignment(found, landed(counts, "pair_counts"))


def _exploded(documents: DataFrame) -> DataFrame:
    both = F.explode(F.arrays_zip(F.col("pairs").alias("pair"), F.col("times").alias("times"))).alias("both")
    return documents.select("row", both).select("row", "both.pair", "both.times")


def agreement(found: Alignment, small: int = SMALL_COUNTS) -> DataFrame:
    """One row per row of the aligned table: its counts and digest, n_best (links whose pair is
    best) and count_sum (over links, the corpus count of their pair).

    Counts of up to ``small`` pairs are broadcast, after counting them; more are joined by a shuffle."""
    few = found.counts.limit(small + 1).count() <= small
    counts = found.counts.select("pair", "n", "best").hint("broadcast" if few else "merge")
    summed = (_exploded(found.documents).join(counts, "pair").groupBy("row")
              .agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
                   F.sum(F.col("times") * F.col("n")).alias("count_sum")))
    kept = found.documents.select("row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    zero = F.lit(0).cast("long")
    return kept.join(summed, "row", "left").select(
        "id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
