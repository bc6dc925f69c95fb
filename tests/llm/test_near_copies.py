import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusmill.llm import nearcopies, simhash


def slow_jaccard(a, b):
    sets = []
    for t in (a, b):
        w = (t or "").lower().split()
        sets.append({" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def edited(seed=3):
    """Texts and copies with a few words changed, so that similarities run from 0.6 to 1."""
    rng = random.Random(seed)
    out = []
    for k in range(30):
        words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(rng.randint(60, 300))]
        out.append(" ".join(words))
        for _ in range(k % 4):
            copy = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 40))):
                copy[rng.randrange(len(copy))] = "changed"
            out.append(" ".join(copy))
    return out + [None, "", "x y", "X y", "a b c d e", out[0].upper()]


def components_by_brute_force(texts, ids):
    root = {i: i for i in ids}
    for _ in ids:
        for a, x in zip(ids, texts):
            for b, y in zip(ids, texts):
                if slow_jaccard(x, y) >= 0.8:
                    root[a] = root[b] = min(root[a], root[b])
    return root


@pytest.fixture(scope="module")
def case():
    texts = edited()
    ids = [500 - i for i in range(len(texts))]
    return texts, ids, components_by_brute_force(texts, ids)


def test_pipeline_stage_keeps_one_of_near_copies(spark, case):
    texts, ids, root = case
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts)], "doc_id long, text string, lang string, source string, n_chars long")
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    assert sorted(r["doc_id"] for r in stage(spark, docs, "").collect()) == sorted(set(root.values()))


def test_components_equal_brute_force(spark, case):
    texts, ids, root = case
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in nearcopies.near_copies(docs).collect()} == root
    assert nearcopies.near_copies(docs.limit(0)).count() == 0


def test_links_of_a_unit_join_what_is_alike_and_nothing_else():
    sets = [np.arange(k, k + 100, dtype=np.uint64) for k in (0, 10, 20, 400, 1000, 405)]
    root = list(range(len(sets)))
    for a, b in nearcopies.unit_links(sets, 0.8):
        assert len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))
        root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
    assert root == [0, 0, 0, 3, 4, 3]


def test_large_clusters_and_shards_meet_in_parts(spark, case, monkeypatch):
    texts, ids, root = case
    monkeypatch.setattr(nearcopies, "HELD_TEXTS", 2)
    monkeypatch.setattr(simhash, "HELD", 3)
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in nearcopies.near_copies(docs).collect()} == root


def test_fingerprint_bits_are_majorities_of_hashes():
    rng = np.random.default_rng(4)
    for n in (1, 2, 7, 3000):
        x = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        got = nearcopies.wide_fingerprint(x).view(np.uint64)
        for w, salt in enumerate(nearcopies.SALTS.tolist()):
            ones = [0] * 64
            for v in x.tolist():
                h = (v + salt) % 2**64
                for m in nearcopies.MIX:
                    h = (h ^ h >> 33) * int(m) % 2**64
                h ^= h >> 33
                ones = [o + (h >> k & 1) for k, o in enumerate(ones)]
            assert int(got[w]) == sum(1 << k for k, o in enumerate(ones) if 2 * o > n)


def test_recall_by_similarity():
    """Pairs of sets of a given Jaccard similarity that meet in a shard and are near there."""
    rng = np.random.default_rng(8)
    found = {}
    for similarity in (0.8, 0.85, 0.9):
        hits = 0
        for _ in range(120):
            both = round(300 * 2 * similarity / (1 + similarity))
            x = rng.integers(0, 1 << 63, 600 - both, dtype=np.uint64)
            codes = np.stack([nearcopies.wide_fingerprint(np.unique(s)).view(np.uint64) for s in (x[:300], x[300 - both :])])
            for w in range(nearcopies.WIDE):
                pair = np.ascontiguousarray(codes[:, w])
                blocks = (pair[0] ^ pair[1]) >> np.arange(0, 64, 16, dtype=np.uint64) & np.uint64(0xFFFF)
                if (blocks == 0).any() and nearcopies.near_positions(np.zeros(2, dtype=np.int64), pair, np.ascontiguousarray(codes[:, (w + 1) % nearcopies.WIDE]))[1] == 0:
                    hits += 1
                    break
        found[similarity] = hits / 120
    assert found[0.8] >= 0.95 and found[0.85] >= 0.98 and found[0.9] >= 0.99, found


def test_unlike_texts_of_one_id_both_stay(spark):
    rows = [(1, "one two three four five six", "a"), (1, "quite another text with other words", "b"), (2, "One two three four five six", "c"), (None, "one two three four five six", "d"), (2, "One two three four five six", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hash string")
    assert sorted(r["hash"] for r in nearcopies.keep_one(docs).collect()) in (["a", "b", "d"],)
    names = ["key", "row", "own", "id", "th", "node", "__id"]
    clashing = docs.select("doc_id", "text", *[F.lit(k).alias(k) for k in names])
    assert nearcopies.keep_one(clashing).columns == ["doc_id", "text", *names]


def test_very_long_texts(spark):
    words = [f"w{i * 7919 % 70_001}" for i in range(70_000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:35_000], "new", *words[35_000:]])), (3, " ".join(words[:35_000]))]
    got = nearcopies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 2: 1, 3: 3}
