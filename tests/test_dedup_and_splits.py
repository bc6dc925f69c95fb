import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import dedup, profile, splits


def rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "row_pos long, text string")


def slow_cosines(texts):
    import re

    grams = []
    for t in texts:
        w = re.findall(r"\w{2,}", t.lower())
        grams.append(Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])]))
    df = Counter(g for c in grams for g in c)
    vocabulary = sorted(df)
    x = np.array([[c[g] * (math.log((1 + len(texts)) / (1 + df[g])) + 1) for g in vocabulary] for c in grams])
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
    return x @ x.T


def variants(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(4))
    out = []
    for _ in range(12):
        base = [word() for _ in range(40)]
        for k in range(rng.randint(1, 4)):
            out.append(" ".join(base + [word() for _ in range(k)]))
    rng.shuffle(out)
    return out + ["", "a", "x y"]


def test_exact_keeps_first(spark):
    got = dedup.exact_keep(rows(spark, ["aaa", "bbb", "aaa", "ccc", "bbb"])).orderBy("row_pos").collect()
    assert [r["keep"] for r in got] == [True, True, False, True, False]


@pytest.mark.parametrize("threshold", [0.8, 0.9, 0.95])
def test_similar_pairs_equal_brute_force(spark, threshold):
    texts = variants()
    c = slow_cosines(texts)
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if c[i, j] >= threshold}
    got = {(r["a"], r["b"]): r["cosine"] for r in dedup.similar_pairs(rows(spark, texts), threshold).collect()}
    assert set(got) == want and all(abs(v - c[k]) < 1e-9 for k, v in got.items())


@pytest.mark.parametrize("across", [False, True])
def test_many_blocks_meet_without_a_shuffle_of_rows(spark, monkeypatch, across):
    monkeypatch.setattr(dedup, "BLOCK_ROWS", 4)
    texts = variants(5)
    c = slow_cosines(texts)
    df = rows(spark, texts)
    if across:
        odd = F.col("row_pos") % 2 == 1
        out = dedup.across_dropped(df.where(~odd), df.where(odd))
        assert sorted(r["row_pos"] for r in out.collect()) == [j for j in range(1, len(texts), 2) if (c[j, ::2] >= 0.9).any()]
    else:
        out = dedup.similar_pairs(df, 0.9)
        want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if c[i, j] >= 0.9}
        found = [(r["a"], r["b"]) for r in out.collect()]
        assert set(found) == want and len(found) == len(want)
    plan = out._jdf.queryExecution().toString()
    assert "InArrow" not in plan and "ranks" not in plan  # links are read where they were stored


def test_greedy_lets_only_kept_rows_suppress(spark):
    edges = [(0, 1), (1, 2), (2, 3), (5, 6), (5, 7), (6, 8), (4, 8)]
    dropped, near = set(), {b: [a for a, x in edges if x == b] for _, b in edges}
    for b in sorted(near):
        if any(a not in dropped for a in near[b]):
            dropped.add(b)
    got = {r["row_pos"] for r in dedup.greedy_dropped(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == dropped == {1, 3, 6, 7, 8}


def test_exact_then_near(spark):
    base = " ".join(f"token{i}" for i in range(40))
    df = rows(spark, [base, base, base + " extra", "something wholly different here"])
    flags = dedup.dedup_flags(df)
    assert [(r["exact_dup"], r["near_dup"]) for r in flags.orderBy("row_pos").collect()] == [(False, False), (True, False), (False, True), (False, False)]
    out = dedup.deduplicate(df).orderBy("row_pos").collect()
    assert [(r["row_pos"], r["pre_dedup_index"]) for r in out] == [(0, 0), (1, 3)]
    assert tuple(dedup.dedup_report(flags, "D").first()) == ("D", 4, 1, 1, 2, 50.0)


def test_across_depends_on_direction(spark):
    a, b = " ".join(f"alpha{i}" for i in range(30)), " ".join(f"beta{i}" for i in range(30))
    train, test = rows(spark, [a, b]), rows(spark, [a + " more", "other words in here", b])
    assert sorted(r["row_pos"] for r in dedup.across_dropped(train, test).collect()) == [0, 2]
    assert [r["row_pos"] for r in dedup.decontaminate(train, test).collect()] == [1]
    assert sorted(r["row_pos"] for r in dedup.across_dropped(test, train).collect()) == [0, 1]
    report = dedup.overlap_report("A", "B", test, dedup.across_dropped(train, test)).first()
    assert tuple(report)[2:6] == (3, 2, 1, 66.6667)


def test_pairs(spark):
    ids = spark.createDataFrame([("DS1", "transfer", "x"), ("DS2", "transfer", "x"), ("DS3", "transfer", "y"), ("DS4", "probe", "z")], "dataset_id string, role string, source string")
    got = dedup.transfer_pairs(ids).collect()
    assert len(got) == 9 and sum(r["note"] != "" for r in got) == 2


def frame(spark, n=200, labels=2):
    return spark.range(n).select(F.lit("D").alias("dataset_id"), F.col("id").alias("row_pos"), F.concat(F.lit("D_"), F.col("id")).alias("uid"), (F.col("id") % labels).cast("int").alias("label"), F.concat(F.lit("s"), F.col("id") % 20).alias("source"))


@pytest.mark.parametrize("n", [1, 7, 200, 1001])
def test_stratified_sizes(spark, n):
    df = frame(spark, n)
    got = splits.stratified(df, 13).join(df, "row_pos").groupBy("part", "label").count().collect()
    size = Counter()
    for r in got:
        size[r["part"]] += r["count"]
    held = math.ceil((0.15 + 0.15) * n)
    want = {"train": n - held, "val": held - math.ceil(0.5 * held), "test": math.ceil(0.5 * held)}
    assert size == Counter({k: v for k, v in want.items() if v})
    for r in got:
        assert abs(r["count"] - size[r["part"]] / min(2, n)) <= 1


def test_split_is_a_partition_and_repeats(spark):
    df = frame(spark)
    out = splits.all_regimes(df, [13, 42], "source")
    checks = splits.partition_check(out, df.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n"))).collect()
    assert len(checks) == 4 and all(r["ok"] for r in checks)
    one = splits.stratified(df, 13)
    assert one.exceptAll(splits.stratified(df.repartition(7), 13)).count() == 0
    assert one.exceptAll(splits.stratified(df, 42)).count() > 0
    assert splits.shared_sources(splits.source_disjoint(df, 13), df).count() == 0


def test_temporal_puts_unknown_dates_last(spark):
    df = spark.range(100).select(F.col("id").alias("row_pos"), F.when(F.col("id") >= 20, F.timestamp_seconds(F.col("id") * 100_000)).alias("ts"))
    part = {r["row_pos"]: r["part"] for r in splits.temporal(df).collect()}
    assert all(part[i] == "train" for i in range(20, 90)) and {part[i] for i in range(20)} == {"val", "test"}
    assert Counter(part.values()) == {"train": 70, "val": 15, "test": 15}


def test_columns_decide_regimes(spark):
    df = frame(spark, 3)
    assert splits.timestamp_column(df.withColumn("Publish_Date", F.lit(None))) == "Publish_Date"
    assert [a["applicable"] for a in splits.applicability("D", df, {"source_field_available": "source"})] == [True, True, False]


def test_resample_keeps_class_sizes(spark):
    df = frame(spark, 90, 3).select("row_pos", "label")
    out = splits.stratified_resample(df, 5)
    assert {r["label"]: r["count"] for r in out.groupBy("label").count().collect()} == {0: 30, 1: 30, 2: 30}
    assert 1 < out.distinct().count() < 90


def test_profile(spark):
    df = spark.createDataFrame([("D", "v", 0, "ab", "c d", 1), ("D", "v", 1, None, "xyz", 0)], "dataset_id string, version string, row_pos long, title string, text string, label int")
    assert tuple(profile.profile(df).first()) == (2, 1, 1, 0.5, 4.5, 4.5, 2.0, 2.0)
    parts = spark.createDataFrame([("D", 1, "train", 0), ("D", 1, "val", 1)], "dataset_id string, seed int, part string, row_pos long")
    grid = spark.createDataFrame([("D", "v", None, "full"), ("D", "v", 1, "train"), ("D", "v", 1, "test")], "dataset_id string, version string, seed int, part string")
    got = {r["part"]: (r["n"], r["fake_ratio"]) for r in profile.profile_parts(df, parts, grid).collect()}
    assert got == {"full": (2, 0.5), "train": (1, 1.0), "test": (0, None)}


@pytest.mark.parametrize("threshold", [0.5, 0.9, 0.95])
def test_links_of_blocks_against_dense_products(threshold):
    """Rows of 60 terms with copies that differ in a few; a row of a block that is not wanted is not looked at."""
    rng = np.random.default_rng(5)
    tf = rng.integers(0, 4, (40, 60)) * (rng.random((40, 60)) < 0.4)
    tf[20:] = tf[:20]
    tf[20:, 3] += 1
    tf[:, 0] += tf.sum(axis=1) == 0
    idf = np.sort(rng.uniform(1, 6, 60))[::-1]
    x = tf * idf / np.linalg.norm(tf * idf, axis=1)[:, None]

    def block(rows):
        table = pa.table({
            "row_pos": pa.array(rows, pa.int64()), "ranks": pa.array([np.flatnonzero(tf[r]).tolist() for r in rows], pa.list_(pa.int32())),
            "tfs": pa.array([tf[r][tf[r] > 0].tolist() for r in rows], pa.list_(pa.int32())), "norm": np.linalg.norm(tf[rows] * idf, axis=1),
        })
        return dedup.Block(table, idf, threshold)

    left, right = block(list(range(0, 25))), block(list(range(10, 40)))
    wanted = np.arange(30) % 3 > 0
    for mark in (None, wanted):
        a, b, cosine, _ = dedup.block_links(left, right, threshold, mark)
        want = {(i, j) for i in range(25) for j in range(30) if x[i] @ x[10 + j] >= threshold and (mark is None or mark[j])}
        assert set(zip(a.tolist(), b.tolist(), strict=True)) == want and len(a) == len(want) and want
        assert np.allclose(cosine, [x[i] @ x[10 + j] for i, j in zip(a, b, strict=True)])
    a, b, _, _ = dedup.block_links(left, left, threshold)
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == {(i, j) for i in range(25) for j in range(i + 1, 25) if x[i] @ x[j] >= threshold}
