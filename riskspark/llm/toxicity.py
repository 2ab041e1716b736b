"""Toxicity scores: gradient-boosted trees over dense features, calibrated isotonically.

Terms (words, and beginnings of words, since languages inflect) that mark toxic texts are
learned from labelled rows by their weighted log-odds; the features are densities of these
terms, their distance to words of the second person, capitals, punctuation, and signs of
obfuscation. Terms and trees are fitted on a sample of at most ``SAMPLE`` labelled rows, taken
by a hash of the id; counts of its terms are aggregated by Spark, and only the chosen terms (at
most ``TERMS``) and one short feature row for each sampled text reach the driver. Scoring is a
single pass over the documents without a shuffle.

A sampled text's own label is taken out of the counts before its features are computed, so the
trees see terms as they would be seen for a new text. A fifth of the sample is kept from the
trees and calibrates their margins.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import byte_batches, packed_texts, text_of
from riskspark.llm.trees import BoostedTrees, Isotonic

SAMPLE = 20_000
TERMS = 400
LEAST_TOXIC = 3
LEAST_Z = 3.0
CALIBRATION_FOLDS = 5
BEGINNINGS = (4, 5, 6, 7, 8)
KNOWN_WORDS = 150_000
LONGEST_WORD = 40
#: words of the second person in the languages of the corpus
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre "
                          "vos usted ustedes tú ti tus vosotros vuestro".split())
#: characters that stand for letters in obfuscated words
STAND_INS = str.maketrans("013457@$!", "oieastasi")
_LETTERS = re.compile(r"[^\W\d_]+")
_INSIDE = re.compile(r"[^\W\d_][0-9@$!*]+[^\W\d_]")
_MARKS = re.compile(r"[^\w\s]")
FAR = 50


def plain(word: str) -> str:
    """A word's letters in lower case, stand-ins inside a word read as letters."""
    low = word.lower()
    core = low.strip("!$@*.,;:?\"'()[]{}|#%&-")
    if core.isalpha():
        return core[:LONGEST_WORD]
    return "".join(_LETTERS.findall(core.translate(STAND_INS)))[:LONGEST_WORD]


def terms_of(word: str) -> list[str]:
    """The word itself, marked by a final space, and its beginnings."""
    return [word + " ", *(word[:n] for n in BEGINNINGS if len(word) >= n)]


def log_odds(toxic, clean, all_toxic, all_clean):
    return np.log((toxic + 0.5) / (all_toxic + 1.0)) - np.log((clean + 0.5) / (all_clean + 1.0))


class Lexicon:
    """Terms with their document counts among toxic and clean texts."""

    def __init__(self, counts: dict[str, tuple[int, int]], toxic: int, clean: int):
        # weights as they are, and without one clean (0) or one toxic (1) text
        self.of_terms = {own: {term: float(w) for term, (t, c) in counts.items()
                               if (w := log_odds(max(0, t - (own == 1)), max(0, c - (own == 0)), toxic, clean)) > 0}
                         for own in (-1, 0, 1)}
        self.of_words: dict[int, dict[str, float]] = {own: {} for own in self.of_terms}

    def weights(self, words: list[str], own: int) -> list[float]:
        """The largest log-odds of each word's terms, 0 if none is known; ``own`` is the label of
        the text at hand if it was counted, else -1."""
        known, terms = self.of_words[own], self.of_terms[own]
        if len(known) > KNOWN_WORDS:
            known.clear()
        for word in [w for w in set(words) if w not in known]:
            term = plain(word)
            best = terms.get(term + " ", 0.0)
            for n in BEGINNINGS:
                if len(term) >= n and (found := terms.get(term[:n])) and found > best:
                    best = found
            known[word] = best
        return list(map(known.__getitem__, words))

    def __getstate__(self):
        return {"of_terms": self.of_terms, "of_words": {own: {} for own in self.of_terms}}


FEATURES = ("length", "hit_rate", "hits", "weight_rate", "largest", "second", "kinds", "you_rate", "you_distance",
            "capitals", "shouted", "marks", "loud_marks", "obfuscated", "obfuscated_hits")
_NONE, _CAPITAL, _MARK, _LOUD = range(4)


def _classes() -> np.ndarray:
    table = np.zeros(1 << 16, np.uint8)
    for code in range(1 << 16):
        c = chr(code)
        table[code] = _CAPITAL if c.isupper() else _LOUD if c in "!?" else _MARK if _MARKS.match(c) else _NONE
    return table


_CLASSES = _classes()


def features(text: str, lexicon: Lexicon, own: int = -1) -> list[float]:
    words = text.split()
    n, size = len(words) or 1, len(text) or 1
    weights = lexicon.weights(words, own)
    hits = [i for i, w in enumerate(weights) if w]
    found = {words[i]: weights[i] for i in hits}
    strongest = sorted(found.values(), reverse=True)[:2] + [0.0, 0.0]
    second = [i for i, w in enumerate(words) if w.lower().strip(".,!?") in SECOND_PERSON] if hits else []
    distance = FAR
    if second:
        places = np.asarray(second)
        after = np.searchsorted(places, hits)
        both = np.minimum(np.abs(places[np.minimum(after, len(places) - 1)] - hits),
                          np.abs(places[np.maximum(after - 1, 0)] - hits))
        distance = min(FAR, int(both.min()))
    units = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2")
    _, capitals, marks, loud = np.bincount(_CLASSES[units], minlength=4).tolist()
    return [np.log1p(len(words)), 100 * len(hits) / n, np.log1p(len(hits)), 100 * sum(weights) / n, strongest[0],
            strongest[1], np.log1p(len(found)), 100 * len(second) / n, 1 / (1 + distance), capitals / size,
            sum(map(str.isupper, words)) / n, (marks + loud) / size, loud / size, len(_INSIDE.findall(text)) / n,
            float(sum(1 for w in found if _INSIDE.search(w)))]


class Model:
    """Lexicon, trees and calibration; small enough to travel with each task."""

    def __init__(self, lexicon: Lexicon, trees: BoostedTrees | None, calibration: Isotonic | None, share: float):
        self.lexicon, self.trees, self.calibration, self.share = lexicon, trees, calibration, share

    def score(self, texts: list[str]) -> np.ndarray:
        if self.trees is None or not texts:
            return np.full(len(texts), self.share)
        x = np.array([features(t, self.lexicon) for t in texts])
        margin = self.trees.margin(x)
        # a hundredth of the uncalibrated score orders texts within one calibrated step
        return np.clip(0.99 * self.calibration.at(margin) + 0.01 / (1 + np.exp(-margin)), 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        sample: int = SAMPLE, seed: int = 7) -> Model:
    """Fits on the rows of ``docs`` whose id has a label 0 or 1 in ``labels``.

    Null ids and labels are ignored; a repeated label row counts once, repeated documents count
    each. If there are no texts of both labels, every text scores 1 if all known labels are 1,
    else 0.
    """
    marked = (labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("toxic"))
              .filter("id is not null and toxic in (0, 1)").distinct()
              .withColumn("place", F.xxhash64(F.lit(seed), "id")))
    total = marked.count()
    if total > sample:  # an even cut of the hash range; the margin is five standard deviations
        share = (sample - 5 * sample ** 0.5) / total
        marked = marked.filter(F.col("place") < F.lit(int(-2 ** 63 + share * 2 ** 64)))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    # at most ``sample`` rows of three numbers
    rows = texts.join(F.broadcast(marked), "id").select("place", "toxic", "text")
    sizes = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Model(Lexicon({}, toxic, clean), None, None, float(toxic > 0))
    lexicon = Lexicon(_chosen_terms(rows, toxic, clean), toxic, clean)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_batches(batches, "text"):
            x = [features(t, lexicon, own) for t, own in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float64()))],
                                             ["place", "toxic", "x"])

    points = rows.mapInArrow(described, "place long, toxic int, x array<double>").orderBy("place").collect()
    x, y = np.array([p.x for p in points]), np.array([p.toxic for p in points], float)
    fold = np.arange(len(points)) % CALIBRATION_FOLDS == 0  # points come in order of a hash
    if len(set(y[~fold])) < 2 or not fold.any():
        fold = np.ones(len(points), bool)
        trees = BoostedTrees().fit(x, y)
    else:
        trees = BoostedTrees().fit(x[~fold], y[~fold])
    return Model(lexicon, trees, Isotonic().fit(trees.margin(x[fold]), y[fold]), toxic / (toxic + clean))


def _chosen_terms(rows: DataFrame, toxic: int, clean: int) -> dict[str, tuple[int, int]]:
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_batches(batches, "text"):
            seen = (Counter(), Counter())
            for text, label in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist()):
                seen[label].update({t for w in {plain(w) for w in set(text.split())} if w for t in terms_of(w)})
            terms = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(terms), *(pa.array([seen[k][t] for t in terms], pa.int64()) for k in (1, 0))],
                ["term", "toxic", "clean"])

    counts = (rows.mapInArrow(counted, "term string, toxic long, clean long").groupBy("term")
              .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).filter(F.col("toxic") >= LEAST_TOXIC))
    weight = (F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (clean + 1.0)))
    z = weight / F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    best = counts.withColumn("z", z).filter(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "term").limit(TERMS)
    return {r.term: (r.toxic, r.clean) for r in best.collect()}


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
             threshold: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: id, score (0 to 1), predicted (1 if score >= ``threshold``).

    A null text is empty; empty texts are scored like any other. Repeated rows get equal scores.
    Only the text is an input of the score. An empty table gives an empty result.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_batches(batches, "text"):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(model.score(batch.column(1).to_pylist()), pa.float64())], ["id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(work, "id long, score double").withColumn(
        "predicted", (F.col("score") >= F.lit(threshold)).cast("int"))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, all columns kept; nothing is shuffled."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_batches(batches, text_col, packed=True):
            texts = [t or "" for t in packed_texts(batch, text_col).to_pylist()]
            yield batch.filter(pa.array(model.score(texts) < threshold))

    rows = docs.select(F.struct("*").alias("_row"))
    return rows.mapInArrow(keep, rows.schema).select("_row.*")
