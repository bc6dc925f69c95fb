"""Hash trees: what they bind, and that comparing two finds the ranges that differ and no others."""

import random

from corpusmill.functions import hashing

KEYS = [None, -(1 << 63), -5, -1, 0, 1023, 1024, 5000, 1 << 40, (1 << 63) - 1]


def table(spark, rows):
    return spark.createDataFrame(rows, "k long, text string, n int")


def root(tree):
    return tree.where(f"level = {hashing.LEVELS - 1}").collect()


def test_root_binds_rows_and_nothing_else(spark):
    rows = [(k, f"text {i}", i) for i, k in enumerate(KEYS)] + [(5000, "text 7", 7)] * 50
    df = table(spark, rows)
    whole = root(hashing.hash_tree(df, "k"))
    assert len(whole) == 1 and whole[0]["n"] == len(rows) and whole[0]["node"] == 0
    random.Random(1).shuffle(rows)
    assert root(hashing.hash_tree(table(spark, rows).repartition(7).select("n", "text", "k"), "k")) == whole
    for changed in (rows[:-1], [*rows, rows[0]], [(k, (t or "") + " ", n) if i == 3 else (k, t, n) for i, (k, t, n) in enumerate(rows)]):
        assert root(hashing.hash_tree(table(spark, changed), "k"))[0]["digest"] != whole[0]["digest"]
    halves = table(spark, [(1, "ab", None), (2, "1:c", 1)]), table(spark, [(1, "ab", None), (2, "1:c", None)])
    assert root(hashing.hash_tree(halves[0], "k")) != root(hashing.hash_tree(halves[1], "k"))


def test_differing_ranges(spark):
    rows = [(k, f"text {i}", i) for i, k in enumerate(KEYS)]
    trees = lambda other: [hashing.hash_tree(table(spark, r), "k") for r in (rows, other)]
    found = lambda other: sorted((r["low"], r["n_left"], r["n_right"]) for r in hashing.differing_ranges(*trees(other)).collect())
    assert found(rows) == []
    other = [(k, "new" if k in (-1, 5000) else t, n) for k, t, n in rows if k != 1 << 40] + [(7, "more", 0), (1 << 50, "far", 0)]
    assert found(other) == [(-1024, 2, 2), (0, 2, 3), (4096, 1, 1), (1 << 40, 1, 0), (1 << 50, 0, 1)]
    assert found([]) == sorted((r[0], r[1], 0) for r in [(-(1 << 63), 2), (-1024, 2), (0, 2), (1024, 1), (4096, 1), (1 << 40, 1), ((1 << 63) - 1024, 1)])


def test_an_empty_table(spark):
    assert hashing.hash_tree(table(spark, []), "k").count() == 0
