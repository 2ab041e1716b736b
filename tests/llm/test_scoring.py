"""Scores of the attention model, the whole pipeline, and the registered queries."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from check import compare, duck
from riskspark.llm import attention, decontamination, queries, scoring, toxicity
from riskspark.llm.common import split_words, table

SF = "/root/testdata/sf0.001"


def test_windows_want_each_id_once():
    rng = np.random.default_rng(1)
    sequences = [rng.integers(0, 9, n) for n in (1, 5, 32, 33, 56, 57, 200)]
    seen = [[] for _ in sequences]
    for inputs, targets, wanted, owner in attention.windows(sequences, 9):
        for i, t, w, o in zip(inputs, targets, wanted, owner):
            assert len(seen[o]) == 0 or w[:attention.CONTEXT].sum() == 0
            begin = len(seen[o]) - (~w[:attention.CONTEXT]).sum() if seen[o] else 0
            assert i[0] == (9 if begin == 0 else sequences[o][begin - 1])
            seen[o] += t[w].tolist()
    assert all(s.tolist() == got for s, got in zip(sequences, seen))


def test_attention_is_causal_and_normalised():
    model = attention.Attention(5)
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 5, (1, attention.WINDOW))
    every = np.ones(ids.shape, bool)
    total = sum(10 ** model.log10(ids, np.full(ids.shape, k), every) for k in range(5))
    assert np.allclose(total, 1, atol=1e-5)
    other = ids.copy()
    other[0, 20:] = (other[0, 20:] + 1) % 5
    a, b = (model.log10(x, np.zeros_like(ids), every) for x in (ids, other))
    assert np.allclose(a[:20], b[:20]) and not np.allclose(a[20:], b[20:])


def test_gradients_match_differences():
    model = attention.Attention(4)
    rng = np.random.default_rng(3)
    ids, targets = rng.integers(0, 5, (2, attention.WINDOW)), rng.integers(0, 4, (2, attention.WINDOW))
    wanted = rng.random(ids.shape) < 0.7
    found = np.concatenate([model.gradients(ids, targets, wanted)[k].ravel() for k in model.params])
    start = model.flat()

    def loss(values):
        return -model.load(values).log10(ids, targets, wanted).mean() * math.log(10)

    for at in rng.choice(len(start), 25, replace=False):
        step = np.zeros_like(start)
        step[at] = 1e-2
        assert abs((loss(start + step) - loss(start - step)) / 2e-2 - found[at]) < 2e-3


def test_scores_on_edge_cases(spark):
    texts = ["the cat sat", "THE Cat", None, "", "new words only", "the the the " * 200, " the"]
    rows = [(i, t, i in (4, 5), 7) for i, t in enumerate(texts)] + [(None, "the", None, 7), (0, "the cat sat", False, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean, score int")
    got = scoring.scores(docs).collect()
    assert len(got) == len(rows)
    counts = Counter()
    for _, t, held, _ in rows:
        if not held:
            counts.update((t or "").encode().lower().split() + ["end"])
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for i, t, held, _ in rows:
        words = (t or "").encode().lower().split() + ["end"]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        want[i, bool(held), len(words), sum(counts[w] > 0 for w in words), n, round(base, 6)] += 1
    assert want == Counter((r.id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got)
    assert all(r.score < 0 for r in got)


def test_words_of_batches_match_plain_ones():
    import pyarrow as pa
    import public_tokenizers

    texts = ["", " a\x0b\x1c b\u00a0C \x85Q\x0c", "\t", "İA the THE thereafter xqz", "the cat\n" * 3, "über-Straße ab abc abcd"]
    lists = [t.encode().lower().split() for t in texts]
    words, owner = split_words(pa.array([""] + [t.encode() for t in texts], pa.binary()).slice(1))
    assert words.to_pylist() == [w for found in lists for w in found]
    assert owner.tolist() == [i for i, found in enumerate(lists) for _ in found]
    heads = scoring.Heads(public_tokenizers.path(scoring.MODEL))
    heads.of(b"a")
    longest = {w: next((heads.ids[w[:n]] for n in range(min(len(w), scoring.LONGEST_HEAD), 0, -1) if w[:n] in heads.ids), -1)
               for found in lists for w in (*found, *(f[:-1] for f in found), *(f + b"s" for f in found))}
    for _ in range(2):  # found, then kept by their beginnings
        assert {w: heads.of(w) for w in longest} == longest
    vocabulary = scoring.Vocabulary(heads, [(i, 1, 1) for i in set(longest.values())], len(texts))
    vocabulary.learn([(b"the", 5), (b"cat", 3)])
    got = vocabulary.sequences(words, owner, vocabulary.places(words), len(texts))
    assert [g.tolist() for g in got] == [[vocabulary.id_of[longest[w]] for w in found] + [vocabulary.end] for found in lists]


def test_counts_are_merged_and_whole(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(scoring, "_COUNTED_AT_ONCE", 3)
    batch = pa.RecordBatch.from_arrays([pa.array([b"a b a", b"", b"c d e F f", b"a g"] * 2, pa.binary())], ["text"])
    counts, rows = Counter(), 0
    for found in scoring._counted(iter([batch.slice(i, 1) for i in range(8)])):
        for r in found.to_pylist():
            counts[r["word"]] += r["n"]
            rows += 1
    assert counts == {b"a": 6, b"b": 2, b"c": 2, b"d": 2, b"e": 2, b"f": 4, b"g": 2} and rows < 16


def test_steps_write_over_their_arrays():
    model, rng = attention.Attention(5), np.random.default_rng(4)
    few, many = rng.integers(0, 5, (2, attention.WINDOW)), rng.integers(0, 5, (7, attention.WINDOW))
    every = np.ones(many.shape, bool)
    first = model.log10(many, many, every)
    room = model._attend(many)["weights"]
    assert np.shares_memory(room, model._attend(few)["weights"])
    model.gradients(few, few, every[:2])
    assert (model.log10(many, many, every) == first).all()


def test_scores_of_nothing(spark):
    schema = "doc_id long, text string, held_out boolean"
    assert scoring.scores(spark.createDataFrame([], schema)).count() == 0
    only = scoring.scores(spark.createDataFrame([(1, "a b", True)], schema)).first()
    assert (only.n_known, only.train_tokens, only.n_tokens) == (0, 0, 3)


def test_every_training_text_reaches_the_weights(spark):
    # alone in its table, a text of any hash must move the weights and so its own score
    for i in range(4):
        docs = spark.createDataFrame([(i, "some words go on and on " * 5 + str(i), False)],
                                     "doc_id long, text string, held_out boolean")
        assert scoring.scores(docs).first().score > scoring.scores(docs, rounds=0).first().score


def test_held_out_texts_score_above_the_base(spark):
    # 800 training texts; a sixteenth of them in each round is the least that teaches the weights
    rows = queries.model_scores(spark, "/root/testdata/sf0.01").filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert rows[0] > rows[1]


def test_pipeline_stages_match_brute_force(spark):
    docs = table(spark, SF, "documents")
    model = queries.toxicity_model(spark, SF, docs)
    toxic = {r.id for r in toxicity.toxicity(docs, model).collect() if r.predicted}
    kept = {r.doc_id: r for r in docs.collect() if r.doc_id not in toxic}
    last = {}
    for i, r in kept.items():
        last[r.text] = max(i, last.get(r.text, -1))
    kept = {i: r for i, r in kept.items() if last[r.text] == i}
    sets = {}
    for i, r in kept.items():
        w = r.text.lower().split()
        sets[i] = {tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))}
    alike = {i: [j for j in kept if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])] for i in kept}
    label = {i: i for i in kept}
    while True:
        new = {i: min(label[j] for j in alike[i]) for i in kept}
        if new == label:
            break
        label = new
    kept = {i: r for i, r in kept.items() if label[i] == i}
    items = [decontamination.normalised(r.text) for r in table(spark, SF, "benchmark").collect()]
    kept = {i: r for i, r in kept.items() if not any(t in decontamination.normalised(r.text) for t in items)}
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in out} <= set(kept)
    words = {i: len(r.text.split()) for i, r in kept.items()}
    copies = Counter(r.doc_id for r in out)
    assert max(copies.values()) <= 3 and all(r.text == kept[r.doc_id].text for r in out)
    assert abs(sum(words[i] * n for i, n in copies.items()) - sum(words.values())) < 0.25 * sum(words.values())
    frames = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frames = stage(spark, frames, SF)
        assert frames.columns == docs.columns, name
    assert {r.doc_id for r in frames.collect()} == set(kept)


def test_stages_on_odd_documents(spark):
    rows = [(None, None, None, None, None), (1, None, "en", "s", 0), (1, None, "en", "s", 0), (2, "", None, None, 0)]
    schema = table(spark, SF, "documents").schema
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema),
                 spark.createDataFrame(rows, schema).withColumn("_row", F.lit(1)).withColumn("kept", F.lit(2))):
        for name, stage in corpus_pipeline.STAGES[1:]:
            got = stage(spark, docs, SF)
            assert got.columns[:len(docs.columns)] == docs.columns, name
            assert got.count() <= 3 * len(rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_check_sql(spark, name):
    message, _, good = compare(spark, duck(SF), name, entry.queries(), entry.oracle_sql(), SF)
    assert good, message


def test_queries_are_registered():
    found = entry.queries()
    assert len({n.split("_")[0] for n in found if n.startswith("op") and n[2].isdigit()}) == 13 and "pipeline" in found
