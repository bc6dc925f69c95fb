"""Line dedup against a direct comparison of all suffixes, and the cases that its docstring settles."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusmill.llm import common, linededup
from test_table_ops import texts_with_repeats


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 0) for i, t in enumerate(texts_with_repeats())] + [(500, None, None, None), (None, "A\nA\nA\nA", "y", 1), (7, "another\ntext\nwith\nthe\nsame id", "z", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, row string, owner int")


def slow(spark, table, least):
    """Counter of (doc_id, text, n_lines, n_removed)."""
    h = {r["t"]: r["h"] for r in spark.createDataFrame([(t,) for _, t in table], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    owner = {}
    for i, t in table:
        if t is not None and (t not in owner or owner[t] is None or (i is not None and i < owner[t])):
            owner[t] = i
    texts = [t.split("\n") for t in sorted(owner, key=lambda t: (owner[t] is None, owner[t] or 0, h[t]))]
    first, gone = {}, {}
    for d, lines in enumerate(texts):
        for s in range(len(lines) - least + 1):
            e, t = first.setdefault(tuple(lines[s : s + least]), (d, s))
            if e != d or s - t >= least:
                gone.setdefault("\n".join(lines), set()).update(range(s, s + least))
    out = Counter()
    for i, t in table:
        if t is None:
            out[i, None, 0, 0] += 1
        elif i != owner[t]:
            out[i, "", t.count("\n") + 1, t.count("\n") + 1] += 1
        else:
            cut = gone.get(t, set())
            out[i, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in cut), t.count("\n") + 1, len(cut)] += 1
    return out


def found(out):
    return Counter((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in out.collect())


@pytest.mark.parametrize("least", [1, 3])
def test_against_all_suffixes(spark, docs, least):
    out = linededup.drop_repeated_lines(docs, least)
    assert out.columns == docs.columns + ["n_lines", "n_removed"]
    assert found(out) == slow(spark, [(r["doc_id"], r["text"]) for r in docs.collect()], least)


def test_hot_keys_take_the_other_way(spark, docs, monkeypatch):
    monkeypatch.setattr(common, "HOT_KEYS", 10**9)
    rows = [(i, "x\ny\nz\n" + "\n".join(random.Random(i).choices("pqr", k=9))) for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(linededup.drop_repeated_lines(table)) == slow(spark, rows, 3)


def test_of_a_period_the_first_copies_stay(spark):
    rows = [(1, "A\nA\nA\nA\nA\nB"), (2, "0\n1\n2\n1\n2\n1\n2\n1\n2\n1\n3"), (3, "short\npair"), (4, "short\npair"), (5, ""), (6, ""), (7, "\n".join("x" * 100)), (8, "\n".join("abc" * 40))]
    rows += [(9, "\n".join(["q", *"defghijk" * 30, "r"])), (10, "\n".join("uv" * 3 + "w" * 7 + "uv" * 4))]
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in linededup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    lines = lambda x: "\n".join(x)
    want = {1: (lines("AAAAAB"), 0), 2: (lines("012123"), 5), 3: ("short\npair", 0), 4: ("", 2), 5: ("", 0), 6: ("", 1), 7: (lines("xxx"), 97), 8: (lines("abc"), 117)}
    assert got == want | {9: (lines("qdefghijkr"), 232), 10: (lines("uvuvuvwww"), 12)}


def test_random_texts_of_few_lines(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 5))) for _ in range(40)]
    rows = [(i, "\n".join(w * rng.randint(1, 9) + rng.choice(words) * rng.randint(0, 4) + rng.choice(words))) for i, w in enumerate(words)]
    rows += [(100 + i, "\n".join("".join(rng.choices(words, k=4)) + str(i) + rng.choice(rows)[1].replace("\n", ""))) for i in range(30)]
    for least in (1, 2, 3, 5):
        assert found(linededup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"), least)) == slow(spark, rows, least)


def test_repeated_rows_empty_tables_and_names(spark, docs):
    once = docs.where("doc_id = 3")
    assert [r["n_removed"] for r in linededup.drop_repeated_lines(once.union(once)).collect()] == [0, 0]
    assert linededup.drop_repeated_lines(docs.limit(0)).count() == 0
    names = ["h1", "h2", "n", "gone", "lines", "first", "own", "id", "__id", "__th"]
    clashing = once.select("doc_id", "text", *[F.lit(k).alias(k) for k in names])
    out = linededup.drop_repeated_lines(clashing)
    assert out.columns == ["doc_id", "text", *names, "n_lines", "n_removed"] and list(out.first())[2:-2] == names


def test_very_long_texts(spark):
    block = "\n".join(f"line {i}" for i in range(66_000))
    rows = [(1, block), (2, "head\n" + block + "\ntail")]
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in linededup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (block, 0), 2: ("head\ntail", 66_000)}
