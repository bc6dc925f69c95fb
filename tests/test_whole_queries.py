"""Registered queries against brute force over all rows of a small table."""

import pytest

from corpusmill.operators import dedup
from corpusmill.plans import registry
from corpusmill.plans.inputs import labelled
from test_dedup_and_splits import slow_cosines

LANGS = ["en", "de", "fr", "es"]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A folder with documents of all languages; of three texts the second is a near copy of the first, the third has its words in another order."""
    texts = []
    for k in range(12):
        base = [f"w{k}x{i % 23}" for i in range(40)]
        texts += [" ".join(base), " ".join([*base, f"more{k}"]), " ".join([*base[:20], *base[20:][::-1]])]
    d = str(tmp_path_factory.mktemp("small"))
    rows = [(i, t, LANGS[i // 3 % 4], "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(0, len(texts), 2)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{d}/labels.parquet")
    return d, texts


def test_near_duplicate_queries_cover_all_languages_with_bigrams(spark, small):
    d, texts = small
    c = slow_cosines(texts)
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if c[i, j] >= 0.9}
    assert any(LANGS[i // 3 % 4] == "en" for i, _ in want)
    got = {(r["a"], r["b"]): r["cosine"] for r in registry.QUERIES["dedup_similar_pairs"](spark, d).collect()}
    assert set(got) == want and all(abs(v - c[k]) < 1e-6 for k, v in got.items())
    gone = set()
    for j in range(len(texts)):
        if any((i, j) in want and i not in gone for i in range(j)):
            gone.add(j)
    assert {r["row_pos"] for r in registry.QUERIES["dedup_greedy"](spark, d).collect()} == gone


def test_across_covers_all_rows_with_bigrams(spark, small):
    d, _ = small
    texts = [r["text"] for r in dedup.with_text(labelled(spark, d)).orderBy("row_pos").collect()]
    c = slow_cosines(texts)
    want = {j for j in range(1, len(texts), 2) if any(c[i, j] >= 0.9 for i in range(0, len(texts), 2))}
    assert {LANGS[j // 3 % 4] for j in want} & {"en", "es"}
    assert {r["row_pos"] for r in registry.QUERIES["dedup_across"](spark, d).collect()} == want
