"""The audit against filters applied one after another to odd documents."""

import re
from itertools import permutations

import pytest

from corpusmill.llm import filteraudit

DOCS = "doc_id long, text string, source string, good string, part string, n string"


def brute(docs, labels):
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    rows = []
    for i, t, s in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and first[t] < i,
        }
        mark = lambda k: any(x[0] == i and x[k] == 1 for x in labels) if i is not None else False  # noqa: E731, B023
        rows.append((s or "", fails, mark(1), mark(2)))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                gone = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                total[f] += len(gone)
                out[part, "".join(order), k + 1] = [
                    len(left), len(gone), sum(r[1][f] for r in own) - len(gone), sum(r[1][f] and sum(r[1].values()) == 1 for r in own),
                    sum(r[2] for r in gone), sum(r[3] for r in gone),
                ]
        for (p, order, k), v in out.items():
            if p == part:
                v.append(total[order[k - 1]])
    return out


@pytest.fixture(scope="module")
def docs():
    clean = " ".join(f"word{i}" for i in range(60))
    dull = "a b " * 40
    rows = [
        (1, clean, "x"), (2, clean, "y"), (2, clean, "y"), (1, clean, "x"), (3, None, "x"), (4, "", None), (5, "", ""), (6, dull, "x"), (7, dull.upper() + "$", "x"),
        (8, clean + " 5%", "y"), (9, "LOUD " * 10, "y"), (10, "\x0b    ", "y"), (11, clean.replace("word", "\U0001f600É"), "x"), (None, clean, "x"), (None, None, None),
        (12, "w " * 70_000 + "Z", "x"), (13, clean.replace(" ", "\x1c"), "y"), (2, "other text of the same id", "x"), (-5, clean, "z"),
    ]
    labels = [(1, 1, 0), (1, 0, 1), (2, None, 1), (6, 1, 1), (9, 0, 0), (None, 1, 1), (99, 1, 1), (8, 1, None)]
    return rows, labels


def test_against_filters_in_order(spark, docs):
    rows, labels = docs
    got = filteraudit.audit(
        spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], DOCS),
        spark.createDataFrame([(*r, "clash") for r in labels], "doc_id long, quality int, toxic int, source string"),
    ).collect()
    want = brute(rows, labels)
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert len(got) == len(want)
    assert {(r["part"], r["filter_order"], r["step"]): [r[c] for c in names] for r in got} == want


def test_shapley_values_share_what_all_filters_remove(spark, docs):
    rows, labels = docs
    out = filteraudit.audit(spark.createDataFrame(rows, "doc_id long, text string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    for part in out.groupBy("part", "filter_order").agg({"shapley": "sum", "removed": "sum"}).collect():
        assert part["sum(shapley)"] == 120 * part["sum(removed)"]


def test_empty_table(spark):
    out = filteraudit.audit(spark.createDataFrame([], "doc_id long, text string, source string"), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert out.count() == 0
