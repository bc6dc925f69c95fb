"""Substring dedup, top-k, pivots, url rules, classifier and pipeline against brute force and odd tables."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from corpusmill.llm import graph, pivots, quality, queries, substring, topk, urlrules

SF = "/root/testdata/sf0.001"


def texts_with_repeats(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abc") for _ in range(3))
    line = lambda: " ".join(word() for _ in range(rng.randint(1, 6)))
    passage = [line() for _ in range(12)]
    out = ["\n".join([line() for _ in range(rng.randint(0, 5))] + passage[a : a + rng.randint(0, 12)] + [line()]) for a in [rng.randint(0, 6) for _ in range(30)]]
    return out + ["", "one line", "A\nA\nA\nA\nA\nA", "\n\n\n\n", " \t ", "For " * 60, " ".join(passage) * 2]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 0) for i, t in enumerate(texts_with_repeats())] + [(500, None, None, None), (None, "A\nA\nA\nA", "y", 1), (7, "another\ntext\nwith\nthe\nsame id", "z", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, anchor string, rank int")


def slow_removed(rows, window):
    starts = Counter()
    for _, words in rows:
        starts.update(tuple(words[s : s + window]) for s in range(len(words) - window + 1))
    for i, words in rows:
        hit = set()
        for s in range(len(words) - window + 1):
            if starts[tuple(words[s : s + window])] > 1:
                hit |= set(range(s, s + window))
        yield i, " ".join(w for k, w in enumerate(words) if k not in hit), len(words), len(hit)


@pytest.mark.parametrize("window,anchor", [(6, 2), (8, 8), (12, 5)])
def test_substring_dedup(docs, window, anchor):
    docs = docs.union(docs.where("doc_id = 4"))  # a row that repeats is a second document
    rows = [(r["doc_id"], (r["text"] or "").split()) for r in docs.collect()]
    got = Counter(map(tuple, substring.remove_repeats(docs, window, anchor).collect()))
    assert got == Counter(slow_removed(rows, window))
    kept = substring.without_repeats(docs, window, anchor)
    assert kept.columns == docs.columns
    for r in kept.where("text is not null").collect():
        assert any(r["doc_id"] == i and r["text"].split() == t.split() for i, t, _, _ in got)
    assert substring.remove_repeats(docs.limit(0)).count() == 0


def test_automaton_counts_every_substring():
    rng = random.Random(4)
    texts = [[rng.choice("ab") for _ in range(rng.randint(1, 14))] for _ in range(6)]
    a = substring.SuffixAutomaton()
    for t in texts:
        a.add(t, 2)
    a.close()
    seen = Counter(tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1))
    for s, n in seen.items():
        v = 0
        for w in s:
            v = a.next[v][w]
        assert a.count[v] == 2 * n


@pytest.fixture(scope="module")
def embeddings(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(40, 8))
    x = np.repeat(base, 6, axis=0) + rng.normal(size=(240, 8)) * np.repeat(rng.choice([0, 0.02, 0.1], 40), 6)[:, None]
    rows = [(i, [float(v) for v in x[i]], int(i % 3), "clash") for i in range(240)]
    odd = [(300, None, 1, ""), (301, [0.0] * 8, 1, ""), (302, [float("nan")] * 8, 1, ""), (303, [1.0, None] * 4, 1, ""), (304, [1.0, 2.0], 1, ""), (305, rows[0][1], None, ""), (306, [], 1, ""), (None, rows[3][1], 0, ""), (307, [float("inf")] * 8, 1, "")]
    return spark.createDataFrame(rows + odd + [rows[9]], "vec_id long, embedding array<float>, label int, v string")


def usable(r):
    return r["embedding"] and all(x is not None and np.isfinite(x) for x in r["embedding"])


@pytest.mark.parametrize("block,shared", [(1024, 4), (3, 4), (1024, 1), (3, 1)])
def test_embedding_links(embeddings, block, shared):
    rows = embeddings.collect()
    got = sorted(pivots.near_duplicates(embeddings, shared=shared, block=block).collect(), key=str)
    n, root = [0] * len(rows), list(range(len(rows)))
    for i, a in enumerate(rows):
        for j, b in enumerate(rows[:i]):
            if not (usable(a) and usable(b)) or a["label"] is None or a["label"] != b["label"] or len(a["embedding"]) != len(b["embedding"]):
                continue
            x, y = np.array(a["embedding"], dtype=float), np.array(b["embedding"], dtype=float)
            if x.any() and y.any() and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.98:
                n[i] += 1
                n[j] += 1
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    least = {r: min((rows[k]["vec_id"] for k in range(len(rows)) if root[k] == r and rows[k]["vec_id"] is not None), default=None) for r in set(root)}
    want = sorted(((r["vec_id"], n[i], least[root[i]], r["vec_id"] is not None and least[root[i]] == r["vec_id"]) for i, r in enumerate(rows)), key=str)
    assert len(got) == len(want)
    if shared == 1:  # everything that is near meets
        assert [tuple(r) for r in got] == want
    assert 0.9 * sum(n) <= sum(r["n_links"] for r in got) <= sum(n)  # recall of the index, and nothing below the threshold
    whole = {w[0]: w[2] for w in want}
    assert all(whole.get(r["component_id"]) == whole[r["vec_id"]] for r in got if r["vec_id"] is not None)


def test_recall_of_64_dimensions(spark):
    rng = np.random.default_rng(12)
    base = rng.normal(size=(150, 64)) / 8
    size = rng.integers(1, 40, 150)
    x = np.repeat(base, size, axis=0) + rng.normal(size=(size.sum(), 64)) / 8 * np.repeat(rng.uniform(0, 0.16, 150), size)[:, None]
    x = x.astype(np.float32)
    e = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    same = np.arange(len(x))[:, None] % 2 == np.arange(len(x))[None, :] % 2
    links = (u @ u.T >= 0.98) & same & ~np.eye(len(x), dtype=bool)
    found = pivots.near_duplicates(e).agg({"n_links": "sum"}).first()[0]
    assert links.sum() > 10_000 and 0.9 * links.sum() <= found <= links.sum()


@pytest.mark.parametrize("count", [128, 256, 257, 512, 1024, 2048, 4096])
def test_recall_at_the_threshold_for_every_number_of_pivots(count):
    """Pairs of cosine 0.98 exactly, in 64 random dimensions, by the index's own nearest pivots."""
    rng = np.random.default_rng(count)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    a, b = unit(rng.standard_normal((1500, 64))), rng.standard_normal((1500, 64))
    b = unit(b - (a * b).sum(axis=1, keepdims=True) * a)
    rows = pa.array([*a.tolist(), *(0.98 * a + np.sqrt(1 - 0.98**2) * b).tolist()])
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array([0] * 3000), rows], ["fold", "label", "v"])
    made = next(pivots._permutations(list(unit(rng.standard_normal((count, 64)))), pivots.NEAREST)(iter([batch])))
    near = [set(x) for x in made["near"].to_pylist()]
    met = [len(near[i] & near[i + 1500]) >= pivots.shared_count(count) for i in range(1500)]
    assert np.mean(met) > 0.92


def test_embeddings_of_odd_and_long_vectors(spark):
    long = [float(i % 13 - 6) for i in range(20_000)]
    rows = [(1, long, 0, "x"), (2, [v * 2 for v in long], 0, "x"), (3, [1.0, 0.0], 0, "x"), (4, [1.0, 0.01], 0, "x"), (5, [1e300, 0.0], 0, "x"), (6, [1.0, 0.0], None, "x"), (6, [1.0, 0.0], None, "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, fold string")
    got = {(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in pivots.near_duplicates(table).collect()}
    assert got == {(1, 1, 1, True), (2, 1, 1, False), (3, 2, 3, True), (4, 2, 3, False), (5, 2, 3, False), (6, 0, 6, True)}
    assert pivots.near_duplicates(table.limit(0)).count() == 0


@pytest.mark.parametrize("lists", [1, 2, 3])
def test_top_k(embeddings, lists, monkeypatch):
    monkeypatch.setattr(topk, "AT_ONCE", 500)
    rows = [(r["vec_id"], [int(np.floor(1024 * float(x))) for x in r["embedding"]]) for r in embeddings.collect() if usable(r) and r["vec_id"] is not None]
    got = topk.top_k_counted(embeddings, F.col("vec_id") % 10 == 0, k=5, lists=lists, query_block=7).drop("resolved").collect()
    want = []
    for q, v in {i: v for i, v in rows if i % 10 == 0}.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q and len(w) == len(v))
        want += [(q, k, i, -s) for k, (s, i) in enumerate(scored[:5], 1)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert topk.top_k(embeddings.where("vec_id = 20"), F.col("vec_id") % 10 == 0).count() == 0
    assert topk.top_k(embeddings.limit(0), F.col("vec_id") == 1).count() == 0


def test_few_entries_are_resolved(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = topk.top_k_counted(e, F.col("vec_id") % 100 == 0).agg(F.max("resolved"), F.avg("resolved")).first()
    assert got[0] < 0.3 * 2000 and got[1] < 0.1 * 2000


def test_top_k_of_long_vectors_and_clashing_names(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(30, 20_000))
    docs = spark.createDataFrame([(i, v.tolist(), "a", 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, v string, rank int")
    q = np.floor(1024 * x).astype(np.int64)
    scores = q[7] @ q.T
    want = sorted((-int(s), i) for i, s in enumerate(scores) if i != 7)[:10]
    assert [(r["vec_id"], r["score"]) for r in sorted(topk.top_k(docs, F.col("vec_id") == 7).collect(), key=lambda r: r["rank"])] == [(i, -s) for s, i in want]


RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "net", ""), ("allow", "a.net", ""), ("block", "b.a.net", "/x"), ("block", "", "/zz"), ("allow", "com", "/en/"), (None, None, "/none")]
URLS = [
    None, "", "no scheme/en/", "http://", "HTTP://WWW.Example.COM/en/7?x=/en/", "https://example.com/en/8#top", "http://xcom/en/1", "http://com/en/1", "http://a.net", "http://c.b.a.net/x/y",
    "http://c.b.a.net/y", "http://ba.net?/x", "http://q.org/zz1", "http://q.org/none", "a://b://com/en/", "http://é.com/en/é", "http://com.:80/en/", "http://..com/en/",
]


@pytest.mark.parametrize("range_rows", [50_000, 4])
def test_url_rules(spark, range_rows, monkeypatch):
    monkeypatch.setattr(urlrules, "RANGE_ROWS", range_rows)
    urls = URLS + ["http://hot.net/same"] * 25
    pages = spark.createDataFrame([(i if i else None, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    want = []
    for i, u in enumerate(urls):
        rest = u.partition("://")[2] if u and "://" in u else ""
        cut = next((k for k, c in enumerate(rest) if c in "/?#"), len(rest))
        end = next((k for k, c in enumerate(rest) if k >= cut and c in "?#"), len(rest))
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:end]
        fits = [(len(h or "") + len(p), len(h or ""), v == "block", (h or "") + p, v) for v, h, p in RULES if path.startswith(p) and (not h or host == h or host.endswith("." + h))]
        best = max(fits, key=lambda f: f[:3], default=None)
        want.append((i or None, host, path, best[3] if best else None, best[4] if best else "allow"))
    got = urlrules.judge(pages, rules).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert urlrules.judge(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in urlrules.judge(pages, rules.limit(0)).collect()} == {"allow"}


def test_url_query_has_the_rules_of_its_contract(spark, tmp_path):
    urls = {"http://a.com/en/1": "block", "http://www.example.com/en/71": "allow", "http://a.net/de/1": "allow", "http://net/de/": "allow", "http://www.example.net/de/7": "allow",
            "http://www.example.net/de/81": "block", "http://a.org/es/": "block", "http://a.net/fr/": "allow"}
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.op8_urls(spark, str(tmp_path)).collect()
    assert {r["page_id"]: r["verdict"] for r in got} == dict(enumerate(urls.values()))
    assert {r["rule"] for r in got} == {"com/en/", "example.com/en/7", "net/de/", "example.net/de/8", "org/es/", None}


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(160)] + [(500 + i, 501 + i) for i in range(30)] + [(1, 1)]
    got = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(40):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: r for x, r in root.items() if x in linked}


def test_quality(spark):
    rng = random.Random(9)
    good = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "the", "of"]) for _ in range(40)) + "."
    bad = lambda: " ".join(rng.choice(["alpha", "beta"]) + "%%%" for _ in range(40))
    texts = [good() if i % 4 else bad() for i in range(400)]
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)] + [(1000, None, 1), (1001, "", 1), (None, "alpha", 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, int(bool(i % 4)), 0) for i in range(400)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.score(docs, labels).collect()
    assert len(got) == 403 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 400]
    assert len(held) > 80 and np.mean([r["predicted"] == int(bool(r["doc_id"] % 4)) for r in held]) >= 0.95
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] for r in got)
    assert {r["score"] for r in quality.score(docs.limit(3), labels.limit(0)).collect()} == {0.5}
    assert quality.score(docs.limit(0), labels).count() == 0


def test_context_sums_and_pooling_by_hand(monkeypatch):
    rng = np.random.default_rng(3)
    index = quality.index_vectors().astype(int)
    texts = [rng.integers(0, 40, n).astype("<u2") for n in (0, 1, 2, 9, 200)]
    want = np.zeros((quality.BUCKETS, quality.DIM), dtype=int)
    for t in texts:
        for i, a in enumerate(t):
            for j, b in enumerate(t):
                if 0 < abs(i - j) <= quality.WINDOW:
                    want[a] += index[b]
    assert (quality.context_sums(texts) == want).all()
    vectors = (want / np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-9)).astype(np.float32)
    monkeypatch.setattr(quality, "STEP", 7)  # stretches join without a seam
    for t in texts:
        v = [vectors[w].astype(float) for w in t]
        mean = sum(v) / len(v) if v else np.zeros(quality.DIM)
        spread = np.sqrt(sum((x - mean) ** 2 for x in v) / len(v)) if v else mean
        beside = sum(x * y for x, y in zip(v, v[1:])) / (len(v) - 1) if len(v) > 1 else np.zeros(quality.DIM)
        assert np.allclose(quality.pooled(t, vectors), np.r_[mean, spread, beside], atol=2e-4)


def test_buckets_tell_tokens_apart(monkeypatch):
    import re

    texts = ["The cat, the CAT -- 3 été_x!? " * 3, "", None, "a" * 50, " \t\n", "x  y\u2026z"]
    names = {}
    for size in (1 << 20, 16):
        monkeypatch.setattr(quality, "BYTES_AT_ONCE", size)
        for t in texts if size > 16 else texts[:1]:
            tokens = re.findall(rb"[A-Za-z0-9_\x80-\xff]+|[^A-Za-z0-9_\x80-\xff\x20\x09-\x0d]+", (t or "").encode())
            got = quality.word_buckets(t).tolist()
            assert len(got) == len(tokens) and all(names.setdefault(w, k) == k for w, k in zip(tokens, got))
    assert len(set(names.values())) == len(names)


def test_long_texts_are_counted_in_stretches(monkeypatch):
    import pyarrow as pa

    texts = [" ".join(random.Random(5).choices(["alpha", "beta", "gamma", "delta"], k=500)), "alpha beta", None]
    monkeypatch.setattr(quality, "HELD_TOKENS", 64)
    sums = np.zeros((quality.BUCKETS, quality.DIM), dtype=int)
    for b in quality._contexts(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])])):
        for k, some, got in zip(*(b.column(c).to_pylist() for c in ("slice", "buckets", "sums"))):
            sums[k * quality.SLICE + np.frombuffer(some, "<u2")] += np.frombuffer(got, "<i4").reshape(-1, quality.DIM)
    assert (sums == quality.context_sums([quality.word_buckets(t) for t in texts])).all()


def test_network_and_temperature():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, quality.FEATURES)).astype(np.float32)
    y = (x[:, 0] + 0.5 * rng.normal(size=900) > 0).astype(int)
    net = quality.fit_network(x, y)
    for row in x[:5].astype(float):
        hidden = [max(0.0, sum((row - net.centre) / net.scale * net.w1[:, k]) + net.b1[k]) for k in range(quality.HIDDEN)]
        logit = sum(h * w for h, w in zip(hidden, net.w2)) + net.b2
        assert np.isclose(net.probability(row[None])[0], 1 / (1 + np.exp(-logit / net.temperature)))
    aside = np.random.default_rng(5).permutation(900)[:180]
    loss = lambda t: np.mean(np.logaddexp(0, np.where(y[aside] == 1, -1, 1) * net.logit(x[aside]) / t))
    assert all(loss(net.temperature) <= loss(t) + 1e-12 for t in np.geomspace(0.25, 8, 121))


def test_repeated_rows_change_no_score(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    even = docs.where("doc_id % 2 = 0")
    once = {r["doc_id"]: r["score"] for r in quality.score(docs, labels).collect()}
    thrice = quality.score(docs.union(even).union(even), labels.union(labels)).collect()
    assert len(thrice) > len(once) and all(r["score"] == once[r["doc_id"]] for r in thrice)


def test_labels_of_held_out_documents_change_nothing(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    used = {r["doc_id"] for r in quality.training_labels(labels).collect()}
    import zlib

    assert used == {i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1}


def test_pipeline_stages(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in c.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SF)
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.select("doc_id").subtract(before.select("doc_id")).count() == 0
        if name in ("line_dedup", "substring_dedup"):
            assert docs.count() == before.count()
    packed = c.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in docs.collect()}
    rows = c.run(spark, SF)
    key = lambda r: (r["doc_id"], r["start"], bytes(r["ids"]))
    assert sum(len(r["ids"]) for r in rows.collect()) == sum(len(r["ids"]) for r in packed) and {key(r)[0] for r in rows.collect()} == {key(r)[0] for r in packed}


def test_pipeline_takes_odd_tables(spark):
    import corpus_pipeline as c

    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    odd = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", "s", 0), (2, "", "en", "s", 0), (2, "", "en", "s", 0)], empty.schema)
    for name, stage in c.STAGES:
        assert stage(spark, empty, SF).count() == 0, name
        assert stage(spark, odd, SF).count() <= 4, name


def test_registered_queries():
    assert {n.split("_")[0] for n in queries.QUERIES} == {"pipeline", *(f"op{k}" for k in range(1, 14))}
    assert set(queries.ORACLE) <= set(queries.QUERIES)
