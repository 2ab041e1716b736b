"""Token counts of whole texts by a public tokenizer, lengths only.

Texts are cut where no token can cross: before a single space that stands between two other
characters. Pieces never hold a space mark behind another character (checked when the model is
loaded), and the mark that the encoder puts before a piece of text stands for the space that was
cut away, so the parts' counts add up to the count of the whole text. Parts repeat a lot, so
each task counts a part once and keeps the count in a table of bounded size; batches are cut by
bytes, and a text of any length is worked on part by part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import byte_batches, text_of

MODEL = "piece_bpe_32k.model"
KNOWN_PARTS = 300_000
LONGEST_KNOWN = 64
SPACE_MARK = "▁"
#: a space between two characters of which neither is a space or reads like one
SAFE = re.compile(f"(?<=[^ {SPACE_MARK}]) (?=[^ {SPACE_MARK}])")


@lru_cache(maxsize=2)
def encoder(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    if any(SPACE_MARK in piece.lstrip(SPACE_MARK) for piece in pieces):
        raise ValueError(f"{path}: a piece holds a space mark behind another character; texts cannot be cut at spaces")
    return model


class Counter:
    """Counts tokens, remembering the counts of short parts."""

    def __init__(self, path: str):
        self.model = encoder(path)
        self.known: dict[str, int] = {}

    def counts(self, texts: list[str]) -> list[int]:
        if len(self.known) > KNOWN_PARTS:
            self.known = {}  # the frequent parts come back at once
        cut = [SAFE.split(text) if text else [] for text in texts]
        new = list({part for parts in cut for part in parts if part not in self.known})
        lengths = dict(zip(new, map(len, self.model.encode(new, num_threads=1)))) if new else {}
        known = self.known
        totals = [sum(known[part] if part in known else lengths[part] for part in parts) for parts in cut]
        known.update((part, n) for part, n in lengths.items() if len(part) <= LONGEST_KNOWN)
        return totals


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 4096) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``).

    Begin, end and other added tokens are not counted, and nothing is truncated. A null text is
    empty and has no tokens. Repeated rows are counted each; other columns are not read; an empty
    table gives an empty result. ``model_path`` must be readable on every executor.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(model_path)
        for batch in byte_batches(batches, "text"):
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pc.binary_length(batch.column(1).cast(pa.binary())).cast(pa.int64()),
                 pa.array(counter.counts(texts), pa.int64())], ["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    return (rows.mapInArrow(count, "id long, n_bytes long, n_tokens long")
            .withColumn("over_limit", F.col("n_tokens") > F.lit(limit)))
