"""Exact deduplication by most-significant-digit radix partitioning.

Documents are split by their leading bytes into groups; a group of one document is settled,
and so is a group whose documents end within those bytes: they are equal byte by byte. The
others are split again by more of their bytes. A digit is a run of bytes that grows from round
to round, so that the number of rounds follows the logarithm of the longest text. No digest
decides equality.

Only documents that share all bytes so far are carried on, so later rounds are small. Groups
are counted by map-side combinable aggregates, and the join that tells each document its group
has one row per group on its other side: a group that holds a third of all rows is counted in
every task, and its rows may be split over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import row_key, text_of, without_keys
from riskspark.session import landed

FIRST_DIGIT = 64
DIGIT_GROWTH = 16


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256, text_bytes.

    * A null text is empty; all empty texts are equal.
    * Of equal texts the row with the largest id stays; a null id is smaller than any other. In a
      group with null ids only, keep_id is null and all its rows are kept.
    * Rows that repeat id and text count in group_size and are kept or dropped together.
    * Other columns of ``docs`` are not read. An empty table gives an empty result.
    """
    state = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.sha2(text_of(text_col).cast("binary"), 256).alias("text_sha256"),
        F.octet_length(text_of(text_col)).cast("long").alias("text_bytes"),
        text_of(text_col).cast("binary").alias("content"))
    settled, width = [], FIRST_DIGIT
    while True:
        keyed = state.select("*", F.substring("content", 1, width).alias("digits"),
                             (F.col("text_bytes") <= width).alias("ended"))
        # written, so that the join shuffles both sides itself and can split a hot group
        groups = landed(keyed.groupBy("digits", "ended").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("largest"))
                        .filter("n > 1"), "groups")
        shared = F.col("n").isNotNull() & ~F.col("ended")
        step = landed(keyed.join(groups.hint("merge"), ["digits", "ended"], "left").select(
            "id", "text_sha256", "text_bytes", "n", "largest", shared.alias("shared"),
            F.when(shared, F.col("content")).alias("content")), "radix")
        alone = F.col("n").isNull()
        settled.append(step.filter(~F.col("shared")).select(
            "id",
            F.when(alone, F.col("id")).otherwise(F.col("largest")).alias("keep_id"),
            F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
            (alone | F.col("id").eqNullSafe(F.col("largest"))).alias("kept"),
            "text_sha256", "text_bytes"))
        state = step.filter("shared").select("id", "text_sha256", "text_bytes", "content")
        if state.isEmpty():
            break
        width *= DIGIT_GROWTH
    result = settled[0]
    for part in settled[1:]:
        result = result.unionByName(part)
    return result


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without exact copies, all columns kept; of rows that repeat id and
    text one stays."""
    dropped = (exact_groups(docs, id_col, text_col).filter(~F.col("kept"))
               .select(row_key("id", F.col("text_sha256")).alias("_key")).distinct())
    rows = docs.select(row_key(id_col, F.sha2(text_of(text_col).cast("binary"), 256)).alias("_key"),
                       F.struct("*").alias("_row"))
    return without_keys(rows, dropped)
