"""Digests against slow entropies, and every column of the query against plain Python."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import common, digests, queries
from test_text_ops import strange


def prose(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    return " ".join(rng.choice(words) for _ in range(n))


def slow_bin(window):
    total = sum(round(c * math.log2(c) * (1 << 20)) for c in Counter(window).values())
    top = round(32 * 5 * (1 << 20))
    return (top - total) * 1000 // top


def slow_features(text, ranks):
    b = bytes(24) + text.encode()
    windows = [b[i : i + 32] for i in range(len(b) - 31)]
    rank = [ranks[slow_bin(w)] for w in windows]
    votes = Counter()
    for j in range(-31, len(windows)):
        block = range(max(j, 0), min(j + 32, len(windows)))
        votes[min(block, key=lambda i: (rank[i], i))] += 1
    return {windows[i] for i in votes if votes[i] >= 8}


RANKS = np.random.default_rng(5).permutation(1001)


@pytest.mark.parametrize("text", [prose(300, 1), "aaaaaaaa", "é" * 50, "abcdefgh" * 30, prose(3, 2), "\U0001f600 x" * 9])
def test_features_are_those_of_a_slow_walk(text):
    b = digests._bytes(text)
    assert digests.entropy_bins(b).tolist() == [slow_bin(b[i : i + 32].tobytes()) for i in range(len(b) - 31)]
    assert len(digests.features(text, RANKS)) == len(slow_features(text, RANKS))


def test_stretches_change_nothing(monkeypatch):
    text = prose(3000, 3)
    whole = digests.features(text, RANKS)
    monkeypatch.setattr(digests, "STRETCH", 97)
    assert digests.features(text, RANKS).tolist() == whole.tolist()


def test_likeness_follows_shared_text():
    ranks = np.arange(1001)
    of = lambda t: digests.Digest.of(t, ranks)
    a, b = prose(6000, 4), prose(6000, 5)
    assert len(of(a).filters) > 5
    assert of(a).likeness(of(a)) == 1 and of(a).likeness(of(b)) < 0.02
    for part in (0.2, 0.5, 0.9):
        cut = int(len(a) * part)
        assert abs(of(a).likeness(of(b[: len(a) - cut] + a[:cut])) - part) < 0.08
    assert of("").likeness(of("")) == 1 and of("").likeness(of(a)) == 0 and of("tiny").likeness(of("tiny")) == 1 and of("tiny").likeness(of("else")) == 0
    again = digests.Digest.parse(str(of(a)))
    assert str(again) == str(of(a)) and again.likeness(of(a)) == 1


def texts():
    out = [prose(200, 7), prose(50_000, 6), None, "", "same", "same", prose(80, 8), prose(80, 8) + " more", "A\n" * 4000, "\U0001f600" * 100 + "abc", "x", "abc", "abcd"]
    return out + strange(30, 9)


def expected(rows):
    """(doc_id, n_chars, sha, next text) of distinct (doc_id, text) in order; ids are unique here."""
    rows = sorted({(i, t or "") for i, t in rows})
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        q = len(t) // 4
        changed = t[: len(t) - q] + following[:q]
        yield i, len(t), hashlib.sha256(changed.encode()).hexdigest(), t, changed, following


@pytest.mark.parametrize("parts,most", [(1, 1000), (5, 1000), (5, 10)])
def test_op11(spark, tmp_path, monkeypatch, parts, most):
    monkeypatch.setattr(common, "HOT_KEYS", most)
    rows = [(7 * i - 20, t) for i, t in enumerate(texts())]
    frame = spark.createDataFrame([*rows, *rows[:3], *[rows[0]] * 30], "doc_id long, text string").withColumn("run", F.lit("clash")).withColumn("n", F.lit("clash"))
    frame.repartition(parts).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op11_digests"](spark, str(tmp_path)).collect()
    copies = Counter([*(i for i, _ in rows), *(i for i, _ in rows[:3]), *[rows[0][0]] * 30])
    assert Counter(r["doc_id"] for r in got) == copies
    ranks = digests.rarity(frame)
    for i, n, sha, t, changed, following in expected(rows):
        own, other, after = (digests.Digest.of(x, ranks) for x in (t, changed, following))
        for r in (r for r in got if r["doc_id"] == i):
            assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (n, sha, str(own), str(other))
            assert (r["near_edited"], r["near_next"]) == (own.likeness(other), own.likeness(after))


def test_missing_ids_and_texts_of_one_id(spark):
    rows = [(None, "first of none"), (None, "second of none"), (3, "three"), (3, "three again"), (1, "one")]
    got = digests.with_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "3", "3", "None", "None"]
    nexts = {"one": {"three", "three again"}}
    sha = next(r["edited_sha256"] for r in got if r["doc_id"] == 1)
    assert sha in {hashlib.sha256(digests.edited("one", x).encode()).hexdigest() for x in nexts["one"]}


def test_one_document_and_none(spark):
    one = digests.with_edits(spark.createDataFrame([(5, prose(40, 1))], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1
    assert digests.with_edits(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_columns(spark):
    frame = spark.createDataFrame([(prose(100, 1), prose(100, 1)), (prose(100, 1), prose(100, 2)), (None, "")], "a string, b string")
    marked = frame.select(digests.fingerprint(F.col("a"), RANKS).alias("a"), digests.fingerprint(F.col("b"), RANKS).alias("b"))
    assert [round(r[0], 2) for r in marked.select(digests.likeness(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 1.0]


def test_edited_texts_are_nearer_than_next_ones(spark):
    got = queries.QUERIES["op11_digests"](spark, "/root/testdata/sf0.01").where("n_chars >= 32").collect()
    assert sum(r["near_edited"] > r["near_next"] for r in got) > 0.99 * len(got)
    assert abs(np.median([r["near_edited"] for r in got]) - 0.75) < 0.05
