"""Cross-tokenizer alignment, nearest neighbours and periodic runs against brute force."""

import bisect
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from riskspark.llm import alignment, neighbours, queries, runs

A_PATH, B_PATH = (public_tokenizers.path(m) for m in (alignment.BYTE_MODEL, alignment.PIECE_MODEL))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 7, 8) for i, t in rows], "doc_id long, text string, row int, pairs int")


# ---- alignment

ALPHABET = "ab cd  \n\t▁é😀1,.'s你 \x85\x1c"
ODD = ["", None, "a", " ", "  a  b ", "<s> x </s> <|endoftext|>", "x <0x41> ▁y ▁ z", "tab\there\n\n new", "\x00nul",
       "café 😀 你好", "ﬁ ligature é", "word " * 30_000, "x" * 3000, "the cat", "the cat", "the dog"]


def brute_tokens(text):
    """(a, end), (b, end) of a text's tokens; none if they do not spell it."""
    a, b = alignment.byte_vocabulary(A_PATH), alignment.piece_vocabulary(B_PATH)
    found = []
    for ids, vocabulary in ((a.model.encode(" " + text, add_special_tokens=False).ids, a), (b.model.encode(text), b)):
        spelled, tokens = b"", []
        for i in ids:
            spelled += vocabulary.content[i].as_py()
            tokens.append((i, len(spelled)))
        if spelled != b" " + text.encode():
            return [], []
        found.append(tokens)
    return found


def brute_alignment(texts):
    links, rows = [], []
    for text in texts:
        a, b = brute_tokens(text) if text else ([], [])
        ends = Counter(e for _, e in b)
        by_end = {}
        for i, e in b:
            by_end.setdefault(e, []).append(i)
        links.append([(i, j) for i, e in a for j in by_end.get(e, [])])
        cuts = sorted({e for _, e in a} & set(ends))
        groups = [([], []) for _ in cuts]
        for side, tokens in enumerate((a, b)):
            for i, e in tokens:
                groups[bisect.bisect_left(cuts, e)][side].append(str(i))
        told = ";".join(f"{','.join(x)}|{','.join(y)}" for x, y in groups)
        rows.append((len(a), len(b), len(cuts), len(links[-1]), hashlib.sha256(told.encode()).hexdigest() if cuts else ""))
    count = Counter(link for some in links for link in some)
    best = {}
    for (_, j), n in count.items():
        best[j] = max(best.get(j, 0), n)
    for row, some in zip(rows, links):
        yield (*row[:4], sum(count[link] == best[link[1]] for link in some), sum(count[link] for link in some), row[4])


@pytest.mark.parametrize("known, small", [(300_000, alignment.SMALL_COUNTS), (3, 0)])
def test_alignment(spark, monkeypatch, known, small):
    monkeypatch.setattr(alignment, "KNOWN_PARTS", known)
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(120))) for _ in range(150)]
    found = alignment.align(frame(spark, [*enumerate(texts), (None, "null id")]).repartition(3), A_PATH, B_PATH)
    got = {r.id: tuple(r)[1:] for r in alignment.agreement(found, small).collect()}
    assert len(got) == len(texts) + 1
    for i, want in zip([*range(len(texts)), None], brute_alignment([*texts, "null id"])):
        assert got[i] == want, texts[i or 0]
    assert found.counts.filter("a is null or b is null or n < 1").count() == 0


def test_alignment_of_repeated_rows_and_none(spark):
    twice = alignment.agreement(alignment.align(frame(spark, [(1, "one two"), (1, "one two")]), A_PATH, B_PATH)).collect()
    assert len(twice) == 2 and twice[0] == twice[1] and twice[0].count_sum == 2 * twice[0].n_links
    assert alignment.agreement(alignment.align(frame(spark, []), A_PATH, B_PATH)).count() == 0


def test_parts_are_cut_where_no_token_crosses():
    vocabularies = alignment.byte_vocabulary(A_PATH), alignment.piece_vocabulary(B_PATH)
    rng = random.Random(8)
    for _ in range(300):
        text = "".join(rng.choice(ALPHABET + "    ") for _ in range(80))
        lists = alignment.Encoder(*vocabularies).lists(alignment.SAFE.split(text))
        assert lists[0].flatten().to_pylist() == vocabularies[0].model.encode(" " + text, add_special_tokens=False).ids
        assert lists[1].flatten().to_pylist() == vocabularies[1].model.encode(text)


# ---- neighbours

def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<float>, uid int, score double")


def brute_nearest(rows, wanted, k):
    """Of rows of one length."""
    usable = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)})
    for i, v in usable:
        if wanted(i):
            scored = [(float(np.cumsum(np.array(v) * np.array(w))[-1]), j) for j, w in usable if j != i]
            for rank, (score, j) in enumerate(sorted(scored, key=lambda x: (-x[0], x[1]))[:k], 1):
                yield i, rank, j, score


def floats(matrix):
    return [[float(np.float32(x)) for x in row] for row in matrix]


ODD_VECTORS = [(900, None), (901, []), (902, [0.0] * 8), (903, [1.0, None] + [1.0] * 6), (904, [float("nan")] * 8),
               (905, [float("inf")] * 8), (906, [1.0] * 5), (None, [9.0] * 8), (920, floats([[5e30] * 8])[0])]


def test_neighbours_on_edge_cases(spark):
    rng = np.random.default_rng(3)
    rows = list(enumerate(floats(rng.standard_normal((80, 8)))))
    rows += [(100 + i, rows[3][1]) for i in range(40)] + [(200, rows[5][1]), (200, rows[5][1])] + ODD_VECTORS
    index = neighbours.build_index(vectors(spark, rows), keep=11)
    got = neighbours.nearest(index, vectors(spark, rows).filter("vec_id % 20 = 0"))
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    kept = [(i, v) for i, v in rows if i != 906]
    want = sorted(brute_nearest(kept, lambda i: i % 20 == 0, 10))
    assert sorted(tuple(r) for r in got.collect()) == want


@pytest.mark.parametrize("clusters", [1, 30])
def test_recall_where_the_sample_is_small(spark, monkeypatch, clusters):
    monkeypatch.setattr(neighbours, "SAMPLE", 200)
    monkeypatch.setattr(neighbours, "VECTORS", 300)
    monkeypatch.setattr(neighbours, "QUERIES", 40)
    rng = np.random.default_rng(clusters)
    centres = rng.standard_normal((clusters, 48)) * 3 * (clusters > 1)
    rows = list(enumerate(floats(centres[rng.integers(0, clusters, 2000)] + rng.standard_normal((2000, 48)))))
    df = vectors(spark, rows)
    got = neighbours.nearest(neighbours.build_index(df, keep=11, cells=16), df.filter("vec_id % 20 = 0")).collect()
    want = {(i, j): s for i, _, j, s in brute_nearest(rows, lambda i: i % 20 == 0, 10)}
    found = {(r.query_id, r.vec_id): r.score for r in got}
    assert len(got) == len(found) == len(want)
    assert len(found.keys() & want.keys()) >= 0.97 * len(want)
    assert all(found[x] == want[x] for x in found.keys() & want.keys())


def test_clustered_queries_meet_few_cells():
    rng = np.random.default_rng(2)
    sample = (rng.standard_normal((8, 16)) * 40)[rng.integers(0, 8, 400)] + rng.standard_normal((400, 16))
    centres = neighbours._centres(sample, 8)
    cell = neighbours._nearest(sample, centres)
    radii = np.array([np.sqrt(((sample[cell == i] - centres[i]) ** 2).sum(axis=1)).max(initial=0) for i in range(8)])
    import pyarrow as pa

    ids = pa.array([[i] for i in range(400)], pa.list_(pa.int64()))
    model = neighbours.Model(5, sample, ids, centres, radii, np.ones(8, np.int64), np.eye(16))
    batch = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array(list(sample), pa.list_(pa.float64()))], ["query", "vector"])
    met = [len(x) for out in neighbours._deal(model)([batch]) for x in out.column(4).to_pylist()]
    assert np.mean(met) < 2.5 and min(met) >= 1


def test_no_vectors(spark):
    none = vectors(spark, [])
    assert neighbours.nearest(neighbours.build_index(none), none).count() == 0
    one = vectors(spark, [(20, [1.0, 2.0]), (20, [1.0, 2.0])])
    assert neighbours.nearest(neighbours.build_index(one), one).count() == 0


# ---- runs

def brute_runs(words):
    n, found = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - start
            same = lambda p: all(words[start + x] == words[start + x + p] for x in range(length - p))  # noqa: B023, E731
            if i > start and length >= max(12, 2 * q) and not any(map(same, range(1, q))):
                found.append((start, length, q))
            i += i == start
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_runs():
    rng, total = random.Random(3), 0
    for _ in range(1500):
        kinds, n = rng.choice([1, 2, 3, 5]), rng.randrange(90)
        words = [b"w%d" % rng.randrange(kinds) for _ in range(n)]
        if n > 5 and rng.random() < 0.5:
            period, start = rng.randrange(1, 12), rng.randrange(n)
            words = words[:start] + [words[min(start + i % period, n - 1)] for i in range(n - start)]
        found = runs.runs(words)
        assert found == brute_runs(words), words
        total += len(found)
    assert total > 500


TEXTS = ["", None, " \t", "a " * 11, "a " * 12, "a b " * 6, "x " + "a b c " * 5 + "a y", "A a " * 5, "é\x0bé  " * 13, "q w e r t y " * 2]


def test_periodic_runs_of_documents(spark):
    rows = [*enumerate(TEXTS), (None, "a " * 20), (4, "a " * 12)] + [(i, " ".join(f"w{j}" for j in range(i))) for i in range(50, 110)]
    got = runs.periodic_runs(frame(spark, rows), rewrite=queries.repeat_from, with_details=True).collect()
    assert len(got) == len(rows)
    by_id = {(r.id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in got}
    chosen = 0
    for i, text in rows:
        words = (text or "").encode().split()
        if i is not None and words and zlib.crc32(str(i).encode()) % 10 == 0:
            g = zlib.crc32(str(i).encode()) // 10
            a = g % len(words)
            p = 1 + (len(words) - a) // (3 + g % 8)
            words = [w if j < a else words[a + (j - a) % p] for j, w in enumerate(words)]
            chosen += 1
        found = brute_runs(words)
        gone = {j for s, n, p in found for j in range(s + p, s + n)}
        left = b" ".join(w for j, w in enumerate(words) if j not in gone)
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in found).encode()
        s, n, p = max(found, key=lambda r: (r[1], -r[0], -r[2])) if found else (None,) * 3
        assert (i, len(found), s, n, p, 1000 * n // p if found else None, hashlib.sha256(lines).hexdigest(),
                hashlib.sha256(left).hexdigest()) in by_id, i
    assert chosen > 2
    assert all(r.n_runs == len(r.runs) for r in got)
    assert runs.periodic_runs(frame(spark, [])).count() == 0


def test_time_of_runs_follows_the_length():
    import time

    def took(n):
        started = time.process_time()
        assert runs.runs([b"a"] * n) == [(0, n, 1)]
        assert runs.runs([b"%d" % (i % 5000) for i in range(n)]) == [(0, n, 5000)]
        return time.process_time() - started

    took(1000 * 11)
    assert took(80_000) < 4 * took(40_000) + 0.5
