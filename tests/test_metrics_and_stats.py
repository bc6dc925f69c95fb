import math
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import inference, metrics, results, training, windows
from corpusmill.schema import SequenceParams

Y, P, S = [1, 0, 0, 1, 1, 0, 1, 0, 0, 1], [1, 0, 1, 1, 0, 0, 1, 0, 0, 0], [0.95, 0.05, 0.6, 0.7, 0.45, 0.3, 0.55, 0.15, 0.25, 0.35]


def predictions(spark, y=Y, p=P, s=S):
    return spark.createDataFrame([("m", a, b, c) for a, b, c in zip(y, p, s)], "model_id string, y_true int, y_pred int, y_prob double")


def test_metrics_by_hand(spark):
    r = metrics.all_metrics(predictions(spark), ["model_id"]).first()
    # three hits, one false alarm, two misses, four true negatives
    assert (r["n"], r["accuracy"]) == (10, 0.7) and r["f1_fake"] == pytest.approx(2 / 3) and r["f1_real"] == pytest.approx(8 / 11)
    assert r["macro_f1"] == pytest.approx((2 / 3 + 8 / 11) / 2) and r["macro_precision"] == pytest.approx((3 / 4 + 4 / 6) / 2) and r["macro_recall"] == pytest.approx((3 / 5 + 4 / 5) / 2)
    wins = sum((a > b) + 0.5 * (a == b) for a, y in zip(S, Y) if y for b, z in zip(S, Y) if not z)
    assert r["roc_auc"] == pytest.approx(wins / 25)
    ranked = [y for _, y in sorted(zip(S, Y), reverse=True)]
    assert r["pr_auc"] == pytest.approx(sum(sum(ranked[: i + 1]) / (i + 1) for i, y in enumerate(ranked) if y) / 5)


def test_one_class_only(spark):
    r = metrics.all_metrics(predictions(spark, [1, 1], [1, 1], [0.9, 0.8]), ["model_id"]).first()
    assert (r["macro_f1"], r["roc_auc"], r["pr_auc"]) == (1.0, None, None)


def test_ece_by_hand(spark):
    # one bin holds all: mean confidence 0.71, and four of five are right
    df = predictions(spark, [1, 1, 0, 0, 1], [1, 1, 1, 0, 1], [0.8, 0.7, 0.75, 0.3, 0.6])
    assert metrics.ece(df, ["model_id"], 2).first()["ece"] == pytest.approx(0.09)
    assert metrics.all_metrics(df.withColumn("model_id", F.lit("llm_zero_shot")), ["model_id"]).first()["ece"] is None


def test_transfer_and_robustness(spark):
    t = spark.createDataFrame([("m", k, 0.86, v) for k, v in zip("xyz", (0.8, 0.5, 0.74))], "model_id string, target string, in_f1 double, cross_f1 double")
    r = metrics.transfer_metrics(t, ["model_id"]).first()
    assert (r["delta_f1_mean"], r["cross_f1_std"]) == (pytest.approx(0.18), pytest.approx(math.sqrt((0.12**2 + 0.18**2 + 0.06**2) / 3)))
    b = spark.createDataFrame([(1, 1, 1, 0.97), (1, 1, 0, 0.81), (0, 0, 1, 0.93), (0, 1, 1, 0.5), (0, 0, 0, 0.88)], "y_true int, clean_pred int, attacked_pred int, similarity double")
    assert [round(v, 6) for v in metrics.robustness_metrics(b, []).first()] == [0.8, 0.4, 0.5, 0.87]


def test_seed_aggregates_skip_what_is_not_finite(spark):
    df = spark.createDataFrame([("m", 0.5, 1.0), ("m", 0.7, float("nan")), (None, 0.2, None)], "model_id string, a double, b double")
    got = {(r["model_id"], r["metric"]): (r["mean"], r["std"], r["n"]) for r in metrics.aggregate_metrics(df, ["model_id"], ["a", "b"]).collect()}
    assert got["m", "a"] == (pytest.approx(0.6), pytest.approx(0.1414213), 2)
    assert got["m", "b"] == (1.0, 0.0, 1) and got[None, "a"] == (0.2, 0.0, 1) and got[None, "b"][2] == 0


def paired(spark, b, c, both=20):
    rows = [(1, 1, 0)] * b + [(1, 0, 1)] * c + [(0, 0, 0)] * both
    return spark.createDataFrame(rows, "y_true int, pred_a int, pred_b int")


@pytest.mark.parametrize("b,c", [(3, 14), (0, 0), (12, 12), (30, 10), (40, 41), (5, 300)])
def test_mcnemar(spark, b, c):
    r = inference.mcnemar(paired(spark, b, c), []).first()
    n, k = b + c, min(b, c)
    if n < 25:
        want = min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)
        assert (r["statistic"], r["exact"]) == (k, True)
    else:
        x = max(abs(b - c) - 1, 0) ** 2 / n
        want = math.erfc(math.sqrt(x / 2))
        assert r["statistic"] == pytest.approx(x) and not r["exact"]
    assert r["p_value"] == pytest.approx(want, rel=1e-8, abs=1e-300) and (r["n_b"], r["n_c"]) == (b, c)


def test_erfc(spark):
    xs = [0.0, 0.1, 1.0, 1.99, 2.0, 3.0, 5.0, 10.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(inference.erfc(F.col("x"))).collect()]
    assert got == pytest.approx([math.erfc(x) for x in xs], rel=1e-9)


def test_cliffs_delta(spark):
    a, b = [1, 2, 2, 5], [2, 3, 1]
    df = spark.createDataFrame([("a", float(x)) for x in a] + [("b", float(x)) for x in b], "side string, value double")
    want = sum((x > y) - (x < y) for x in a for y in b) / 12
    assert inference.cliffs_delta(df, []).first()[0] == pytest.approx(want)


def test_bh(spark):
    p = [0.03, 0.002, 0.6, 0.012, 0.012, 0.3]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(p)] + [(9, None)], "i int, p_value double")
    got = {r["i"]: (r["p_adjusted"], r["significant"]) for r in inference.bh_fdr(df).collect()}
    # raw steps in order of p: .012, .036, .024, .045, .36, .6; each takes the least of those after it
    assert [got[i][0] for i in range(6)] == pytest.approx([0.045, 0.012, 0.6, 0.024, 0.024, 0.36])
    assert [got[i][1] for i in (0, 1, 2, 3, 4, 5, 9)] == [True, True, False, True, True, False, False] and got[9][0] is None


def test_claims(spark):
    df = spark.createDataFrame([("x", 0.1, 0.001, 0.5), ("y", 0.1, 0.9, 0.5), ("z", float("nan"), 0.001, 0.5), ("w", 0.1, 0.001, None)], "comparison string, diff double, p_value double, effect double")
    assert {r["comparison"]: r["claim_allowed"] for r in inference.confirmatory(df).collect()} == {"x": True, "y": False, "z": False, "w": False}
    with pytest.raises(ValueError):
        inference.confirmatory(df.drop("effect"))


def test_bootstrap(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 400)
    good, bad = np.where(rng.random(400) < 0.95, y, 1 - y), np.where(rng.random(400) < 0.6, y, 1 - y)
    df = spark.createDataFrame([(int(a), int(b), int(c)) for a, b, c in zip(y, good, bad)], "y_true int, pred_a int, pred_b int").withColumn("k", F.lit(1))
    one = inference.paired_bootstrap(df, ["k"], 1000, seed=7).first()
    assert one == inference.paired_bootstrap(df.repartition(5), ["k"], 1000, seed=7).first()
    assert one["ci_low"] < one["observed_diff"] < one["ci_high"] and one["ci_low"] > 0.2 and one["p_value"] == 0
    same = inference.paired_bootstrap(df.withColumn("pred_b", F.col("pred_a")), ["k"], 500).first()
    assert (same["mean_diff"], same["p_value"]) == (0.0, 1.0)
    loose = inference.paired_bootstrap(df, ["k"], 1000, stratified=False).first()
    assert loose["mean_diff"] == pytest.approx(one["mean_diff"], abs=0.02)


def test_bootstrap_equals_resampling_of_rows():
    """Drawing joint cells has the distribution of drawing rows."""
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 300)
    a, b = np.where(rng.random(300) < 0.8, y, 1 - y), np.where(rng.random(300) < 0.7, y, 1 - y)
    cells = np.zeros((2, 2, 2))
    np.add.at(cells, (y, a, b), 1)
    got = inference.bootstrap_cells(cells, 4000, True, 0.95, "3")
    counts = lambda p, pick: np.array([[((y[pick] == i) & (p[pick] == j)).sum() for j in (0, 1)] for i in (0, 1)], dtype=float)
    drawn = []
    for _ in range(4000):
        pick = np.concatenate([rng.choice(np.flatnonzero(y == k), (y == k).sum()) for k in (0, 1)])
        drawn.append(float(inference.macro_f1_of_counts(counts(a, pick)) - inference.macro_f1_of_counts(counts(b, pick))))
    assert got["mean_diff"] == pytest.approx(np.mean(drawn), abs=0.004)
    assert [got["ci_low"], got["ci_high"]] == pytest.approx(np.quantile(drawn, [0.025, 0.975]).tolist(), abs=0.012)


def test_friedman_and_nemenyi(spark):
    x = [[0.9, 0.8, 0.7], [0.8, 0.85, 0.6], [0.95, 0.9, 0.7], [0.9, 0.9, 0.5], [0.7, 0.6, 0.65]]
    df = spark.createDataFrame([(i, "abc"[j], v) for i, r in enumerate(x) for j, v in enumerate(r)], "block int, t string, value double")
    got = inference.friedman(df, "block", "t", "value").first()
    ranks = np.array([[1, 2, 3], [2, 1, 3], [1, 2, 3], [1.5, 1.5, 3], [1, 3, 2]])
    raw = 12 / (5 * 3 * 4) * (ranks.sum(0) ** 2).sum() - 3 * 5 * 4
    stat = raw / (1 - 6 / (5 * 24))
    assert got["statistic"] == pytest.approx(stat) and got["p_value"] == pytest.approx(math.exp(-stat / 2))
    pairs = {(r["a"], r["b"]): r["p_value"] for r in inference.nemenyi(df, "block", "t", "value").collect()}
    assert len(pairs) == 3 and pairs["a", "c"] < pairs["a", "b"]
    assert inference.studentized_range_tail(3.314, 3) == pytest.approx(0.05, abs=1e-3)
    assert inference.chi2_tail(7.815, 3) == pytest.approx(0.05, abs=1e-4) and inference.chi2_tail(9.488, 4) == pytest.approx(0.05, abs=1e-4)


def test_pairwise(spark):
    rng = np.random.default_rng(3)
    rows = [(m, s, i, int(i % 2), int(i % 2 if rng.random() < q else 1 - i % 2)) for m, q in (("a", 0.95), ("b", 0.6)) for s in (1, 2) for i in range(60)]
    p = spark.createDataFrame(rows, "model_id string, seed int, row_pos int, y_true int, y_pred int")
    scores = spark.createDataFrame([("a", 1, 0.9), ("a", 2, 0.92), ("b", 1, 0.6), ("b", 2, 0.61)], "model_id string, seed int, value double")
    order = spark.createDataFrame([("a", 0), ("b", 1)], "model_id string, ord int")
    r = inference.pairwise_comparisons(p, order, scores, 500).collect()
    assert len(r) == 1 and (r[0]["a_id"], r[0]["b_id"], r[0]["n"], r[0]["cliffs_delta"], r[0]["significant"]) == ("a", "b", 120, 1.0, True)
    wrong = p.withColumn("y_true", F.when((F.col("model_id") == "b") & (F.col("row_pos") == 3), 0).otherwise(F.col("y_true")))
    with pytest.raises(Exception, match="truths differ"):
        inference.align(wrong, inference.model_pairs(order)).collect()


def spans(n, content, stride):
    out, at = [], 0
    while True:
        out.append((at, min(at + content, n)))
        if at + content >= n:
            return out
        at += stride


def test_window_spans(spark):
    ns = [0, 1, 9, 10, 11, 12, 13, 30, 31]
    df = spark.createDataFrame([(n,) for n in ns], "n int")
    for r in df.select("n", windows.window_spans(F.col("n"), 10, 3).alias("s"), windows.n_windows(F.col("n"), 10, 3).alias("k")).collect():
        assert [(x["start"], x["end"]) for x in r["s"]] == spans(r["n"], 10, 3) and r["k"] == len(r["s"])
    with pytest.raises(ValueError):
        windows.window_spans(F.col("n"), 10, 11)


def test_token_windows_and_pooling(spark):
    docs = spark.createDataFrame([(0, 1, " ".join("abcdefghij")), (1, 0, None)], "doc_idx int, label int, text string")
    p = SequenceParams(window_tokens=6, stride_tokens=2, title_only_tokens=5)
    got = windows.token_windows(docs, p).orderBy("doc_idx", "window_idx").collect()
    assert [(r["start"], r["end"]) for r in got] == [(0, 4), (2, 6), (4, 8), (6, 10), (0, 0)]
    assert all(len(r["input_ids"]) == 6 and r["input_ids"][0] == 101 for r in got) and got[-1]["attention_mask"] == [1, 1, 0, 0, 0, 0]
    assert [len(r["input_ids"]) for r in windows.token_windows(docs, p, title_only=True).collect()] == [5, 5]
    logits = spark.createDataFrame([(0, [1.0, 3.0]), (0, [3.0, 1.0]), (1, [0.0, 2.0])], "doc_idx int, logits array<double>")
    out = {r["doc_idx"]: (r["n_windows"], round(r["y_prob"], 6), r["y_pred"]) for r in windows.document_predictions(logits).collect()}
    assert out == {0: (2, 0.5, 1), 1: (1, round(1 / (1 + math.exp(-2)), 6), 1)}


def test_training_logic(spark):
    w = {r["label"]: r["weight"] for r in training.class_weights(spark.createDataFrame([(0,), (0,), (0,)], "label int")).collect()}
    assert w == {0: 0.5, 1: 1.5}
    rate = [r["factor"] for r in training.schedule(spark, 100, 0.1).orderBy("step").collect()]
    assert rate[0] == 0 and rate[5] == 0.5 and rate[10] == 1 and rate[55] == pytest.approx(0.5) and rate[99] < 0.01
    scores = [0.5, 0.6, 0.6, 0.55, 0.7, 0.1, 0.2, 0.3, 0.9]
    df = spark.createDataFrame([("r", i, v) for i, v in enumerate(scores)], "run_id string, epoch int, score double")
    assert tuple(training.early_stopping(df).first()) == ("r", 4, 0.7, 7)
    with pytest.raises(ValueError):
        training.assert_no_smote({"use_smote": True})


def result(spark, **over):
    base = dict(experiment_id="E", run_id="r1", model_id="LR", dataset_id="D", train_version="v", test_version="v", split_regime="S-RAND", seed=13, macro_f1=0.5)
    return spark.createDataFrame([tuple((base | over).values())], "experiment_id string, run_id string, model_id string, dataset_id string, train_version string, test_version string, split_regime string, seed int, macro_f1 double")


def test_result_rows(spark):
    assert results.validate(result(spark)).count() == 1
    with pytest.raises(results.ResultSchemaError):
        results.validate(result(spark).drop("seed"))
    with pytest.raises(Exception, match="invalid result row"):
        results.validate(result(spark, model_id=" ")).collect()
    with pytest.raises(Exception, match="invalid result row"):
        results.validate(result(spark, test_version="w"), same_version=True).collect()
    both = results.append(result(spark), result(spark, run_id="r2").withColumn("extra", F.lit(1)))
    assert both.columns[-1] == "extra" and both.count() == 2 and results.latest(both).first()["run_id"] == "r2"
    assert results.column_order(["x", "seed", "run_id"]) == ["run_id", "seed", "x"]
    assert [(r["metric"], r["mean"], r["n"]) for r in results.over_seeds(both).collect()] == [("extra", 1.0, 1), ("macro_f1", 0.5, 2)]


def test_selection_and_resume(spark):
    rows = [("A", 1, 0.9, 0.1, 10), ("A", 2, 0.7, 0.1, 10), ("B", 1, 0.8, 0.05, 20), ("B", 2, 0.8, 0.05, 20), ("C", 1, 0.8, 0.05, 5), ("C", 2, 0.8, 0.05, 5)]
    df = spark.createDataFrame(rows, "model_id string, seed int, macro_f1 double, ece double, n_params long")
    assert results.best_model(df).first()["model_id"] == "C"
    cells = results.sweep_cells(spark, ["A", "B", "D"], [1, 2])
    assert sorted(map(tuple, results.missing_cells(cells, df).collect())) == [("D", 1), ("D", 2)]
    assert results.is_complete(cells.where("model_id <> 'D'"), df) and not results.is_complete(cells, df)


def test_draws_by_inverse_transform():
    u = inference.uniforms("13:x", 20_000)
    assert u.min() > 0 and u.max() < 1 and abs(u.mean() - 0.5) < 0.01 and (u == inference.uniforms("13:x", 20_000)).all()
    for n, p in ((1, 0.5), (40, 0.1), (900, 0.97), (12_000, 0.3)):
        x = inference.binomial_draws(np.full(20_000, n), p, u)
        assert abs(x.mean() - n * p) < 5 * np.sqrt(n * p * (1 - p) / 20_000) and abs(x.var() / (n * p * (1 - p)) - 1) < 0.06 and 0 <= x.min() <= x.max() <= n
    assert inference.binomial_draws(np.array([7, 0]), 0.0, u[:2]).tolist() == [0, 0] and inference.binomial_draws(np.array([7, 0]), 1.0, u[:2]).tolist() == [7, 0]
    drawn = inference.multinomial_draws(np.array([10, 0, 30, 60]), "13:y", 5_000)
    assert (drawn.sum(axis=1) == 100).all() and not drawn[:, 1].any() and np.allclose(drawn.mean(axis=0), [10, 0, 30, 60], atol=0.5)
    assert not inference.multinomial_draws(np.zeros(4, dtype=int), "13:z", 3).any()


def test_draws_of_many_rows_take_little_memory_and_are_exact():
    f = inference.log_factorials(0, 400)
    assert np.allclose(f, [math.lgamma(n + 1) for n in range(401)], rtol=1e-14, atol=1e-14) and abs(inference.log_factorials(10**9, 10**9)[0] / math.lgamma(10**9 + 1) - 1) < 1e-14
    tracemalloc.start()
    x = inference.binomial_draws(np.array([4 * 10**7, 4 * 10**7 + 2]), 0.5, np.array([0.5, 0.5]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert x.tolist() == [2 * 10**7, 2 * 10**7 + 1] and peak < 50e6


def test_models_of_a_row_meet_in_one_shuffle(spark):
    rows = [("A", 1, 5, 1, 1), ("B", 1, 5, 1, 0), ("C", 1, 5, 1, 1), ("A", 1, 6, 0, 0), ("B", 2, 6, 0, 0), ("A", None, 7, 0, 0), ("B", None, 7, 0, 0), ("B", 1, 6, 0, 1), ("B", 1, 6, 0, 0)]
    p = spark.createDataFrame(rows, "model_id string, seed int, row_pos long, y_true int, y_pred int")
    pairs = spark.createDataFrame([("A", "B"), ("B", "C")], "a_id string, b_id string")
    out = inference.align(p, pairs)
    assert sorted(map(tuple, out.collect())) == [("A", "B", 1, 5, 1, 1, 0), ("A", "B", 1, 6, 0, 0, 0), ("A", "B", 1, 6, 0, 0, 1), ("B", "C", 1, 5, 1, 0, 1)]
    assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(Exception, match="truths differ"):
        inference.align(p.unionByName(p.where("model_id = 'C'").withColumns({"row_pos": F.lit(6).cast("long")})), pairs).collect()


def test_length_buckets_and_error_kinds(spark):
    rows = [(i, n) for i, n in enumerate([5, 5, 5, 5, 1, 9, 40_000, None, 7, 20_000])]
    got = {r["row_pos"]: r["bucket"] for r in metrics.length_buckets(spark.createDataFrame(rows, "row_pos long, n long"), "n", 3).collect()}
    assert got == {4: 0, 0: 0, 1: 0, 2: 1, 3: 1, 8: 1, 5: 2, 9: 2, 6: 2, 7: None}
    assert metrics.length_buckets(spark.createDataFrame([], "row_pos long, n long"), "n").count() == 0
    seen = [("m", 1, 1, 0.95), ("m", 1, 0, 0.3), ("m", 0, 1, 0.6), ("m", 0, 0, 0.05), ("m", 0, 0, None), (None, 1, 1, 0.9)]
    out = metrics.error_taxonomy(spark.createDataFrame(seen, "model string, y_true int, y_pred int, y_prob double"), ["model"]).collect()
    assert {(r["model"], r["kind"], r["confident"]): (r["n"], r["share"]) for r in out} == {
        ("m", "hit", True): (1, 0.2), ("m", "miss", False): (1, 0.2), ("m", "false alarm", False): (1, 0.2), ("m", "correct rejection", True): (1, 0.2),
        ("m", "correct rejection", None): (1, 0.2), (None, "hit", True): (1, 1.0),
    }
