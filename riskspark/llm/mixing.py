"""Mixing sources to target weights.

Words are added up per source, every source gets a target, and a document is emitted
floor(rate) times plus once more with a probability equal to the fraction of its source's rate
(target / words of the source). The draw is a hash of the document's id, so reruns agree.

DataFrame functions only. The per-source table is one map-side combinable aggregate; its join
back to the documents is an equi-join on the source, which Spark broadcasts when the table is
small and splits where one source is hot. Only scalars reach the driver: one pair of sums for
each round of capping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import WORD, text_of
from riskspark.operators.ordering import number_rows
from riskspark.session import landed

MOST_REPEATS = 3
WEIGHTS = (1, 2, 3)
SEED = "mix"


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def draw(id_col: str, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the id and the seed alone."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(2 ** 32))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """``sizes`` (source, source_size) with weight and target.

    Sources in code point order, null last, weigh ``weights`` in turn and share all words. A
    target stops at ``most`` times its source's words; the excess is shared again by weight over
    the others, until none is above. Each round caps at least one source or is the last.
    """
    ranked = landed(number_rows(sizes, [F.col("source").asc_nulls_last()], "rank").select(
        "source", "source_size",
        F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1)
                     .cast("int")).cast("long").alias("weight")), "sources")
    top = F.col("source_size") * F.lit(most)
    words, weights_sum = (x or 0 for x in ranked.agg(F.sum("source_size"), F.sum("weight")).first())
    left, weight = words, weights_sum
    while weight:
        # above its top at the present share: a comparison of whole numbers
        above = top * F.lit(weight).cast("decimal(38,0)") < F.col("weight") * F.lit(left).cast("decimal(38,0)")
        capped, their_weight = ranked.filter(above).agg(F.sum(top), F.sum("weight")).first()
        now = (words - (capped or 0), weights_sum - (their_weight or 0))
        if now == (left, weight):
            break
        left, weight = now
    share = F.col("weight") * F.lit(float(left)) / F.lit(float(weight or 1))
    above = top * F.lit(weight).cast("decimal(38,0)") < F.col("weight") * F.lit(left).cast("decimal(38,0)")
    return ranked.select("source", "source_size", "weight",
                         F.when(above, top.cast("double")).otherwise(share).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS, seed: str = SEED) -> DataFrame:
    """Every row of ``docs`` as struct ``row`` with size, source_size, target, rate, copies, taken.

    * size is the number of words of the text; a null or empty text has none and gets no copies
      beyond what its source's rate gives, which take no words.
    * A null source is a source of its own, last in order. A source without words has rate 0.
    * Rows that repeat an id get the same draw; a null id draws like an empty one.
    * An empty table gives an empty result.
    """
    sized = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                        word_count(text_of(text_col)).alias("size"))
    sizes = (docs.select(F.col(source_col).alias("source"), word_count(text_of(text_col)).alias("size"))
             .groupBy("source").agg(F.sum("size").alias("source_size")))
    targets = source_targets(sizes, weights, most).select(
        F.col("source").alias("of"), "source_size", "target",
        F.coalesce(F.least(F.try_divide("target", "source_size"), F.lit(float(most))), F.lit(0.0)).alias("rate"))
    whole = F.floor("rate")
    extra = (draw("id", seed) < F.col("rate") - whole).cast("long")
    return (sized.join(targets, sized["source"].eqNullSafe(targets["of"]))
            .withColumn("copies", whole.cast("long") + extra)
            .withColumn("taken", F.col("copies") * F.col("size")).drop("of"))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of the mix itself: each row of ``docs`` as often as it is taken, with column
    ``mix_copy`` counting from 1 (``mix_copy_`` and so on where ``docs`` has that column)."""
    name = "mix_copy"
    while name in docs.columns:
        name += "_"
    taken = mix(docs, **options).filter("copies > 0")
    return taken.select("row.*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias(name))
