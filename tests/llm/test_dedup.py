"""Exact and near copies, repeated strings."""

import hashlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from riskspark.llm import components as parts
from riskspark.llm import exact_dedup, minhash, repeats, simhash

SCHEMA = "doc_id long, text string, kept int, id string"
LONG = "word " * 300


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA)


EDGES = [(1, None), (2, ""), (3, LONG + "a"), (4, LONG + "b"), (5, LONG + "a"), (6, "é"), (7, "e"), (8, LONG),
         (None, "lost"), (9, "lost"), (None, None), (10, "twice"), (10, "twice")]


def test_exact_groups_on_edge_cases(spark):
    got = {(r.id, r.text_sha256): r for r in exact_dedup.exact_groups(frame(spark, EDGES)).collect()}
    rows = [(i, t or "") for i, t in EDGES]
    for i, t in rows:
        same = [j for j, u in rows if u == t]
        row = got[i, hashlib.sha256(t.encode()).hexdigest()]
        largest = max((j for j in same if j is not None), default=None)
        assert (row.keep_id, row.group_size, row.kept) == (largest, len(same), i == largest), (i, t)
    assert exact_dedup.exact_groups(frame(spark, EDGES)).count() == len(EDGES)


def test_exact_copies_dropped_with_all_columns(spark):
    left = exact_dedup.drop_exact_copies(frame(spark, EDGES))
    assert left.columns == ["doc_id", "text", "kept", "id"]
    texts = Counter(r.text or "" for r in left.collect())
    assert set(texts) == {t or "" for _, t in EDGES} and set(texts.values()) == {1}


def brute_fingerprint(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < 3 else [b" ".join(w) for w in zip(words, words[1:], words[2:])]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


@pytest.mark.parametrize("text", ["", " \t\n", "One", "ONE two", "a b a b a b", "É é x y", "a\x1cb c d", LONG])
def test_fingerprint(text):
    assert simhash.fingerprint(text) % 2 ** 64 == brute_fingerprint(text)


def brute_components(values):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in values:
        for b in values:
            if (a ^ b).bit_count() <= 3:
                root[find(max(a, b))] = find(min(a, b))
    groups = {}
    for v in values:
        groups.setdefault(find(v), set()).add(v)
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("group", [512, 4])
def test_links_connect_what_three_bits_connect(spark, group):
    rng = np.random.default_rng(5)
    centres = [int(x) for x in rng.integers(0, 2 ** 63, 12)]
    values = set(centres)
    for c in centres[:6]:
        for _ in range(25):
            flips = rng.choice(64, int(rng.integers(1, 7)), replace=False)
            values.add(c ^ sum(1 << int(b) for b in flips))
    signed = [v - 2 ** 64 if v >= 2 ** 63 else v for v in values]
    edges = simhash.near_links(spark.createDataFrame([(v,) for v in signed], "fp long"), group)
    found = parts.components(edges).collect()
    groups = {}
    for r in found:
        groups.setdefault(r.component, set()).add(r.node % 2 ** 64)
    alone = values - {v for g in groups.values() for v in g}
    assert {frozenset(g) for g in groups.values()} | {frozenset([v]) for v in alone} == brute_components(sorted(values))


def test_near_groups_on_edge_cases(spark):
    rows = {(r.id, r.component_id) for r in simhash.near_groups(frame(spark, EDGES)).collect()}
    assert {(1, 1), (2, 1), (None, 1), (3, 3), (5, 3), (None, 9), (9, 9), (10, 10)} <= rows
    left = simhash.drop_near_copies(frame(spark, EDGES))
    assert left.columns == ["doc_id", "text", "kept", "id"]
    assert sorted(r.doc_id for r in left.collect() if r.doc_id in (1, 2, 9, 10)) == [1, 9, 10]


def test_pipeline_drops_what_is_alike_in_five_word_shingles(spark):
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(12):
        words = [f"w{n}" for n in rng.integers(0, 5000, 200)]
        for edits in (0, 2, 4, 30):
            some = list(words)
            for at in rng.choice(len(some), edits, replace=False):
                some[at] = "X" + some[at]
            rows.append((len(rows), " ".join(some)))
    rows += [(100, None), (101, " \t"), (102, "one two"), (103, "ONE  two"), (104, "one three"), (None, "one two")]
    sets = []
    for _, text in rows:
        words = (text or "").lower().split()
        sets.append({tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))})
    label = list(range(len(rows)))
    for _ in rows:
        label = [min(label[j] for j in range(len(rows)) if 5 * len(s & sets[j]) >= 4 * len(s | sets[j])) for s in sets]
    want = {rows[i][0] for i in label}
    got = corpus_pipeline.remove_near_copies(spark, frame(spark, rows), "")
    assert got.columns == ["doc_id", "text", "kept", "id"]
    assert sorted(r.doc_id for r in got.collect()) == sorted(want) and len(want) < 36


def test_members_of_one_group_unlike_its_leaders_are_linked(spark):
    # every text in one group of candidates, so that most families are unlike its first and last
    rng = np.random.default_rng(9)
    rows = []
    for family in range(14):
        words = [f"w{n}" for n in rng.integers(0, 900, 40 if family else 400)]
        for at in range(1 + family % 5):
            rows.append((len(rows), " ".join([*words[:at * 3], *["Y" + w for w in words[at * 3:at * 3 + 1]], *words[at * 3 + 1:]])))
    rows += [(100, None), (101, "a b c d e"), (102, "a b c d e"), (None, "a b c d e f")]
    docs = frame(spark, rows)
    sketches = minhash.sketches(docs, "doc_id", "text").withColumn("keys", F.array(F.lit(7).cast("long")))
    sets = {m - 2 ** 64 if m >= 2 ** 63 else m: set(s.tolist())
            for s in (minhash.shingles(t or "") for _, t in rows) for m in [minhash._mark(s)]}
    alike = {f: {g for g in sets if 5 * len(sets[f] & sets[g]) >= 4 * len(sets[f] | sets[g])} for f in sets}
    label = {f: f for f in sets}
    for _ in sets:
        label = {f: min(label[g] for g in alike[f]) for f in sets}
    edges = minhash.similar_links(sketches, docs)
    assert all(e.b in alike[e.a] for e in edges.collect())
    found = {r.node: r.component for r in parts.components(edges).collect()}
    assert {f: found.get(f, f) for f in sets} == label and len(set(label.values())) > 14
    none = minhash.similar_links(sketches.limit(0), docs)
    assert none.columns == ["a", "b"] and none.isEmpty()


def test_groups_cut_into_blocks_keep_their_links_and_give_no_pairs(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*base[:i], f"x{i}", *base[i + 1:]])) for i in range(0, 60, 2)]  # each like all others
    rows += [(100 + i, " ".join(base[:12] + [f"y{i}.{j}" for j in range(48)])) for i in range(30)]  # unlike, with a common line
    docs = frame(spark, rows)
    keys = F.array(F.lit(7).cast("long"), F.lit(8).cast("long"))
    sketches = minhash.sketches(docs, "doc_id", "text").withColumn("keys", keys)
    blocks = minhash._blocks(sketches, 8, 1 << 20)
    # two bands with the same members are one group, of 8 parts that meet in pairs
    assert blocks.select("key").distinct().count() == 1
    assert blocks.count() == 60 * 8 and blocks.groupBy("part").count().agg({"count": "max"}).first()[0] < 60
    of = {r.fp: r.id for r in sketches.collect()}
    for group in (8, 1000):
        edges = [(of[e.a], of[e.b]) for e in minhash.similar_links(sketches, docs, group=group).collect()]
        assert all(a < 100 and b < 100 for a, b in edges)
        found = spark.createDataFrame(edges, "a long, b long")
        assert {r.component for r in parts.components(found).collect()} == {0}
        # no more links than join the members of each block
        assert len(edges) <= (30 * 8 if group == 8 else 29)


def test_empty_tables(spark):
    none = frame(spark, [])
    assert exact_dedup.exact_groups(none).count() == simhash.near_groups(none).count() == 0
    assert repeats.without_repeats(none).count() == exact_dedup.drop_exact_copies(none).count() == 0


@pytest.mark.parametrize("edges", [[(1, 2), (2, 3), (5, 4), (None, 7), (6, 6)], [(i, i + 1) for i in range(60)],
                                   [(0, i) for i in range(1, 50)], []])
def test_components(spark, edges):
    got = {r.node: r.component for r in parts.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges for x in e if None not in e and e[0] != e[1]}
    smallest = {n: n for n in nodes}
    for _ in nodes:
        for a, b in edges:
            if a in nodes and b in nodes and a is not None:
                smallest[a] = smallest[b] = min(smallest[a], smallest[b])
    assert got == smallest


def test_difference_cover():
    assert {(a - b) % repeats.PERIOD for a in repeats.COVER for b in repeats.COVER} == set(range(repeats.PERIOD))


def brute_repeats(texts, length):
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = [True] * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        yield len(t), sum(gone), sum(g and not p for g, p in zip(gone, [False] + gone)), kept


@pytest.mark.parametrize("block", [repeats.BLOCK_BYTES, 700])
def test_repeats_match_brute_force(spark, block):
    rng = np.random.default_rng(11)
    fresh = lambda n: "".join(rng.choice(list("abcdéñ \n"), n))
    passage, line, whole = fresh(260), fresh(199), fresh(400)
    texts = [fresh(500) + passage + fresh(90), passage + fresh(40), fresh(300) + line + fresh(300), line + "x", whole,
             whole, whole, fresh(150), fresh(150) + passage[:230] + fresh(20) + passage[20:], "ab" * 200, "q" * 199,
             "q" * 200, "q" * 201, "", None, fresh(20), fresh(700)]
    got = repeats.without_repeats(frame(spark, list(enumerate(texts))), block_bytes=block, with_kept=True)
    rows = {r.id: r for r in got.collect()}
    for i, want in enumerate(brute_repeats([(t or "").encode() for t in texts], repeats.LENGTH)):
        r = rows[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want, i
        assert r.kept_sha256 == hashlib.sha256(want[3]).hexdigest()


def test_repeats_of_repeated_and_null_ids(spark):
    df = frame(spark, [(1, LONG), (1, LONG), (None, "z" * 300), (None, "short")]).withColumn("n_removed", F.lit(5))
    rows = sorted((r.id or 0, r.n_bytes, r.n_removed) for r in repeats.without_repeats(df).collect())
    assert rows == [(0, 5, 0), (0, 300, 300), (1, len(LONG), len(LONG)), (1, len(LONG), len(LONG))]


@pytest.mark.parametrize("few", [0, 100])
def test_shingle_sets_by_either_join(spark, few):
    docs = frame(spark, [(1, "a b c d e f"), (2, "a b c d e f"), (3, None), (4, "other words"), (None, "x")])
    hashes = docs.filter("doc_id in (1, 3)").select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    sets = {bytes(r.shingles) for r in minhash.shingle_sets(docs, hashes, "text", few).collect()}
    assert sets == {minhash.shingles(t).tobytes() for t in ("a b c d e f", "")}
