"""Log-probabilities of whole texts under a causal self-attention model over subword ids.

A word is its head subword, the longest beginning that the public vocabulary has as a word's
first piece, and its rest. The attention model gives the probability of the next word's head
from the heads before it (frequent heads have an id each, the others share one); counts over all
training texts give the word within its head's group. Their product is the word's probability.
Each word is scored once, in windows that overlap by their context.

Counts come from all training texts, by map-side combined aggregates. Frequent words, at most
``KNOWN_WORDS``, travel with the tasks; the others, a few of each text, meet their counts in a
join by word. The attention weights are trained in numpy where the texts are: the rounds deal all
training rows among them, each row to one; in each round every task follows the gradient over its
rows of that round, and the weights are averaged by Spark. No text reaches the driver.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.attention import Adam, Attention, windows
from riskspark.llm.common import byte_batches, split_words, text_of
from riskspark.session import landed

MODEL = "piece_bpe_32k.model"
KINDS = 128
KNOWN_WORDS = 100_000
LONGEST_KNOWN = 64
LONGEST_HEAD = 16
#: lengths of beginnings that can settle a word's head
STEMS = (4, 6, LONGEST_HEAD)
ROUNDS = 2
BATCH = 64
_COUNTED_AT_ONCE = 300_000
_HEADS_KEPT = 300_000


class Heads:
    """First subwords of words by the vocabulary of a public tokenizer."""

    def __init__(self, path: str):
        self.path = path
        self.ids: dict[bytes, int] | None = None

    def _load(self) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=self.path)
        pieces = ((model.id_to_piece(i), i) for i in range(model.get_piece_size()))
        self.ids = {p[1:].encode("utf-8"): i for p, i in pieces if p.startswith("▁") and len(p) > 1}
        # for each length: beginnings that a longer piece goes on from, and the heads of the others
        self.stems = [(n, {p[:n] for p in self.ids if n < len(p) and n < LONGEST_HEAD}, {}) for n in STEMS]

    def of(self, word: bytes) -> int:
        """The id of the word's head; words that begin with no known piece share -1."""
        if self.ids is None:
            self._load()
        for n, _, heads in self.stems:
            found = heads.get(word[:n])
            if found is not None:
                return found
        found = -1
        for n in range(min(len(word), LONGEST_HEAD), 0, -1):
            if word[:n] in self.ids:
                found = self.ids[word[:n]]
                break
        n, _, heads = next(stem for stem in self.stems if word[:stem[0]] not in stem[1])
        if len(heads) > _HEADS_KEPT:
            heads.clear()
        heads[word[:n]] = found
        return found

    def __getstate__(self):
        return {"path": self.path, "ids": None}


def _listed(values: pa.Array) -> list:
    """``to_pylist`` in a thirtieth of its time."""
    return values.to_numpy(zero_copy_only=False).tolist()


class Vocabulary:
    """Ids of heads, sizes of their groups, and the frequent words."""

    def __init__(self, heads: Heads, sizes: list[tuple[int, int, int]], texts: int, kinds: int = KINDS):
        """``sizes``: (head, tokens, distinct words) of the training texts; ``texts``: their number,
        which is that of end tokens."""
        self.heads, self.kinds, self.end, self.other = heads, kinds, kinds - 1, kinds - 2
        order = sorted(sizes, key=lambda s: (-s[1], s[0]))
        self.id_of = {head: i for i, (head, _, _) in enumerate(order[:kinds - 2])}
        self.tokens, self.types = np.zeros(kinds), np.zeros(kinds)
        for head, tokens, types in order:
            i = self.id_of.get(head, self.other)
            self.tokens[i] += tokens
            self.types[i] += types
        self.tokens[self.end], self.types[self.end] = texts, min(texts, 1)
        self.texts = texts
        self.all_tokens, self.all_types = int(self.tokens.sum()), int(self.types.sum())
        self.base_norm = float(np.log10(self.all_tokens + 0.5 * (self.all_types + 1)))
        self.group_norm = np.log10(self.tokens + 0.5 * (self.types + 1))
        self.group_norm[self.end] = 0.0
        #: the frequent words; their ids and the logs of their counts lie at the same places
        self.known = pa.array([], pa.binary())
        self.known_ids, self.known_logs = np.zeros(0, np.int64), np.zeros(0)

    def learn(self, words: list[tuple[bytes, int]]) -> None:
        self.known = pa.array([word for word, _ in words], pa.binary())
        self.known_ids = np.array([self._id(word) for word, _ in words], np.int64)
        self.known_logs = np.array([float(np.log10(n + 0.5)) for _, n in words])

    def _id(self, word: bytes) -> int:
        return self.id_of.get(self.heads.of(word), self.other)

    def places(self, words: pa.Array) -> np.ndarray:
        """The place of each word among the frequent ones; -1: none."""
        return pc.index_in(words, value_set=self.known).fill_null(-1).to_numpy(zero_copy_only=False)

    def sequences(self, words: pa.Array, owner: np.ndarray, places: np.ndarray, texts: int) -> list[np.ndarray]:
        """The ids of the words of each text and its end."""
        ids, rare = np.empty(len(words), np.int64), places < 0
        ids[~rare] = self.known_ids[places[~rare]]
        others = words.filter(pa.array(rare)).dictionary_encode()
        ids[rare] = np.array([self._id(w) for w in _listed(others.dictionary)], np.int64)[others.indices.to_numpy()]
        ends = np.cumsum(np.bincount(owner, minlength=texts))
        return np.split(np.insert(ids, ends, self.end), ends[:-1] + np.arange(1, texts))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0

    def merged() -> pa.Table:
        return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).select(
            ["word", "n_sum"]).rename_columns(["word", "n"])

    for batch in byte_batches(batches, "text"):
        found = split_words(batch.column(0))[0].value_counts()
        held.append(pa.table({"word": found.field(0), "n": found.field(1)}))
        rows += len(found)
        if rows > 2 * _COUNTED_AT_ONCE:
            held = [merged()]
            rows = held[0].num_rows
            if rows > _COUNTED_AT_ONCE:
                yield from held[0].to_batches()
                held, rows = [], 0
    if held:
        yield from merged().to_batches()


def word_counts(texts: DataFrame) -> DataFrame:
    """word, n over all rows of ``texts`` (text binary)."""
    return texts.select("text").mapInArrow(_counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _vocabulary(counts: DataFrame, texts: int, heads: Heads) -> Vocabulary:
    def by_head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, types = Counter(), Counter()
        for batch in batches:
            for word, n in zip(_listed(batch.column(0)), _listed(batch.column(1))):
                head = heads.of(word)
                tokens[head] += n
                types[head] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(tokens), pa.int64()), pa.array(list(tokens.values()), pa.int64()),
                                          pa.array([types[h] for h in tokens], pa.int64())], ["head", "tokens", "types"])

    sizes = (counts.mapInArrow(by_head, "head long, tokens long, types long").groupBy("head")
             .agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types")))
    # one row for each piece of the vocabulary at most
    vocabulary = Vocabulary(heads, [tuple(r) for r in sizes.collect()], texts)
    short = counts.filter(F.octet_length("word") <= LONGEST_KNOWN)
    power = F.floor(F.log2("n")).cast("int")
    left, least = KNOWN_WORDS, None
    for r in sorted(short.groupBy(power.alias("power")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):
        if r.n > left:
            break
        left, least = left - r.n, 2 ** r.power
    if least:
        vocabulary.learn([(bytes(r.word), r.n) for r in short.filter(F.col("n") >= least).collect()])
    return vocabulary


def _train(texts: DataFrame, vocabulary: Vocabulary, rounds: int) -> Attention:
    """Every row of ``texts`` (id, text) is learned from in one of the rounds."""
    model = Attention(vocabulary.kinds, vocabulary.tokens)
    for turn in range(rounds):
        start = model.flat()

        def follow(batches: Iterator[pa.RecordBatch], start=start, seed=turn) -> Iterator[pa.RecordBatch]:
            local = Attention(vocabulary.kinds).load(start)
            adam, weight = Adam(local), 0
            for batch in byte_batches(batches, "text"):
                words, owner = split_words(batch.column(0))
                sequences = vocabulary.sequences(words, owner, vocabulary.places(words), batch.num_rows)
                rng = np.random.default_rng(seed)
                for inputs, targets, wanted, _ in windows(sequences, vocabulary.kinds, 0):
                    order = rng.permutation(len(inputs))
                    for at in range(0, len(order), BATCH):
                        some = order[at:at + BATCH]
                        adam.step(local.gradients(inputs[some], targets[some], wanted[some]))
                        weight += int(wanted[some].sum())
            if weight:
                values = local.flat()
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values * weight),
                                                  pa.array(np.full(len(values), float(weight)))], ["place", "value", "weight"])

        # by id too, so that the copies of one text are dealt to all rounds
        mine = texts.filter(F.pmod(F.xxhash64("id", "text"), F.lit(rounds)) == turn).select("text")
        mean = (mine.mapInArrow(follow, "place long, value double, weight double").groupBy("place")
                .agg((F.sum("value") / F.sum("weight")).alias("value")).orderBy("place").collect())
        if mean:
            model.load(np.array([r.value for r in mean]))
    return model


_SCORED = ("id long, held_out boolean, n_tokens long, n_known long, model double, logs double, norms double, "
           "rare array<struct<word:binary,n:long>>")


def _scorer(vocabulary: Vocabulary, model: Attention):
    rare_type = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_batches(batches, "text"):
            texts, (words, owner) = batch.num_rows, split_words(batch.column(2))
            places = vocabulary.places(words)
            sequences, known = vocabulary.sequences(words, owner, places, texts), places >= 0
            logs = np.bincount(owner[known], vocabulary.known_logs[places[known]], texts).astype(float)  # of no words: whole numbers
            norms = [float(vocabulary.group_norm[ids].sum()) for ids in sequences]
            # each rare word of a text once
            others = words.filter(pa.array(~known)).dictionary_encode()
            kinds = max(1, len(others.dictionary))
            pairs, times = np.unique(owner[~known] * kinds + others.indices.to_numpy(), return_counts=True)
            offsets = np.searchsorted(pairs, np.arange(texts + 1) * kinds)
            rare = pa.StructArray.from_arrays([others.dictionary.take(pa.array(pairs % kinds)), pa.array(times, pa.int64())],
                                              fields=list(rare_type.value_type))
            total = np.zeros(len(sequences))
            for inputs, targets, wanted, text in windows(sequences, vocabulary.kinds):
                found = model.log10(inputs, targets, wanted)
                np.add.at(total, np.repeat(text, wanted.sum(axis=1)), found)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(ids) for ids in sequences], pa.int64()),
                 pa.array(np.bincount(owner[known], minlength=texts), pa.int64()), pa.array(total), pa.array(logs),
                 pa.array(norms, pa.float64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rare, type=rare_type)],
                ["id", "held_out", "n_tokens", "n_known", "model", "logs", "norms", "rare"])

    return work


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out_col: str = "held_out",
           model_path: str | None = None, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Training texts are those of rows whose held_out is not true. Words are lower-cased in A-Z; every
    text ends in one end token, which counts.

    * base_score: each token has probability (c + 0.5) / (N + 0.5 (V + 1)), from training counts.
    * score: the model's log10 probability. Within its head's group a word has probability
      (c + 0.5) / (C + 0.5 (T + 1)), C tokens and T distinct words of the group; a word that no
      training text has counts 0, as in the base.
    * A null text is empty: one end token. Repeated rows are scored and learned from each. Without
      training rows all ids are equally likely. Other columns are not read; an empty table gives an
      empty result. ``model_path`` (default: the public vocabulary's) must be readable by executors.
    """
    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path(MODEL)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(held_out_col), F.lit(False))
                       .alias("held_out"), text_of(text_col).cast("binary").alias("text"))
    training = rows.filter("not held_out")
    counts = landed(word_counts(training), "counts")
    vocabulary = _vocabulary(counts, training.count(), Heads(model_path))
    model = _train(training, vocabulary, rounds)
    scored = landed(rows.mapInArrow(_scorer(vocabulary, model), _SCORED)
                    .withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = scored.select("row", F.explode("rare").alias("r")).select("row", "r.word", F.col("r.n").alias("times"))
    c = F.coalesce("n", F.lit(0))
    sums = rare.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(c + 0.5)).alias("more_logs"),
        F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("more_known"))
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0))
    end, texts = float(np.log10(vocabulary.texts + 0.5)), vocabulary.texts
    return scored.drop("rare").join(sums, "row", "left").select(
        "id", "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0)) + (1 if texts else 0)).alias("n_known"),
        F.lit(vocabulary.all_tokens).cast("long").alias("train_tokens"),
        (logs + end - F.col("n_tokens") * vocabulary.base_norm).alias("base_score"),
        (F.col("model") + logs - F.col("norms")).alias("score"))
