"""Shared helpers: null-safe texts, packed rows, Arrow batches of bounded size, words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space separates words: ``bytes.split()`` cuts at exactly these
WORD = r"[^\x20\x09-\x0D]+"

#: bytes of text handled at a time inside a task
BATCH_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column) -> Column:
    """A text column in which null counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def row_key(id_col: str, of_text: Column) -> Column:
    """One key for a row's id, null included, and its text."""
    return F.concat_ws(":", F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("-")), of_text.cast("string"))


def without_keys(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows (_key, _row) whose key is not in ``dropped``, unpacked; of rows with one key the
    first stays. Both steps use one shuffle by the key, the same at every size."""
    left = rows.join(dropped.hint("merge"), "_key", "left_anti")
    return left.dropDuplicates(["_key"]).select("_row.*")


def words_of(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text with A-Z lower-cased; every other character stays as it is."""
    return text.lower().split()


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """``words_of`` all texts of an array of UTF-8 in binary, one after the other, and the text each word is of."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.view(pa.string())))
    words = lists.flatten().view(pa.binary())
    full = pc.greater(pc.binary_length(words), 0)  # white space at an end leaves an empty part
    owner = np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy(zero_copy_only=False))
    return words.filter(full), owner[full.to_numpy(zero_copy_only=False)]


def packed_texts(batch: pa.RecordBatch, text_col: str) -> pa.Array:
    """The texts of a batch of whole rows, packed as its first column."""
    return pc.struct_field(batch.column(0), text_col)


def byte_batches(batches: Iterator[pa.RecordBatch], column: str, limit: int = BATCH_BYTES, packed: bool = False
                 ) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that the texts of one slice hold about ``limit`` bytes; one text
    longer than that is a slice of its own. With ``packed``, rows are structs in the first column."""
    for batch in batches:
        texts = packed_texts(batch, column) if packed else batch.column(batch.schema.get_field_index(column))
        lengths = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
        start = size = 0
        for i, n in enumerate(lengths):
            if size and size + n > limit:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if start < batch.num_rows:
            yield batch.slice(start)


def tasks_of(spark: SparkSession) -> int:
    """Number of partitions that shuffles of this session use."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
