import numpy as np
import pytest

from corpusmill.operators import encoder, metrics, training
from corpusmill.plans import experiment
from corpusmill.schema import SequenceParams

SMALL = SequenceParams(window_tokens=8, stride_tokens=4)


@pytest.fixture(scope="module")
def features(spark):
    rng = np.random.default_rng(2)
    words = [["red", "blue", "green"], ["cat", "dog", "cow"]]
    rows = [(i, i % 3 == 0, " ".join(rng.choice(words[int(i % 3 == 0)], rng.integers(1, 20)))) for i in range(60)] + [(60, False, "")]
    docs = spark.createDataFrame([(i, int(y), t) for i, y, t in rows], "doc_idx long, label int, text string")
    return encoder.encode(docs, encoder.averaged_embedding(12), SMALL, batch=5)


def weighted_loss(x, y, w, weight, bias):
    z = x @ weight + bias
    z = z - z.max(axis=1, keepdims=True)
    log_p = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
    return -(w * log_p[np.arange(len(y)), y]).sum() / w.sum()


def test_gradient_is_that_of_the_weighted_loss(features):
    rows = features.collect()
    x, y = np.array([r["vector"] for r in rows]), np.array([r["label"] for r in rows])
    weights = {0: 0.7, 1: 1.9}
    w = np.array([weights[k] for k in y])
    rng = np.random.default_rng(1)
    head = encoder.Head(rng.normal(size=(12, 2)), rng.normal(size=2))
    g_weight, g_bias, loss = encoder.gradient(features, head, weights)
    assert loss == pytest.approx(weighted_loss(x, y, w, head.weight, head.bias))
    for i, j in ((0, 0), (5, 1), (11, 0)):
        step = np.zeros_like(head.weight)
        step[i, j] = 1e-5
        slope = (weighted_loss(x, y, w, head.weight + step, head.bias) - weighted_loss(x, y, w, head.weight - step, head.bias)) / 2e-5
        assert g_weight[i, j] == pytest.approx(slope, abs=1e-7)
    assert g_bias.sum() == pytest.approx(0, abs=1e-9)


def test_training_learns_stops_early_and_repeats(features):
    train, val = features.where("doc_idx % 2 = 0"), features.where("doc_idx % 2 = 1")
    settings = encoder.HeadSettings(epochs=8, batches=2, patience=2)
    head, log = encoder.train(train, val, settings)
    rows = log.orderBy("epoch").collect()
    scores = [r["val_macro_f1"] for r in rows]
    assert encoder.validation_f1(val, head) == max(scores) > 0.9 and rows[-1]["train_loss"] < rows[0]["train_loss"]
    best = scores.index(max(scores))
    assert len(rows) == min(8, best + 3) and rows[-1]["stop"] == (len(rows) == best + 3) and [r["improved"] for r in rows][best:] == [True] + [False] * (len(rows) - best - 1)
    again, _ = encoder.train(train, val, settings)
    assert np.allclose(again.weight, head.weight) and np.allclose(again.bias, head.bias)
    out = {r["doc_idx"]: r["n_windows"] for r in encoder.predict(features, head).collect()}
    assert len(out) == 61 and out[60] == 1


def test_rate_factor_equals_the_schedule(spark):
    rows = training.schedule(spark, 50, 0.1).collect()
    assert all(r["factor"] == pytest.approx(encoder.rate_factor(r["step"], 5, 50)) for r in rows)


def test_pareto_keeps_equals_and_leaves_nulls(spark):
    rows = [("a", 1.0, 5.0), ("b", 1.0, 5.0), ("c", 2.0, 5.0), ("d", 2.0, 7.0), ("e", 3.0, 6.0), ("f", 0.5, 1.0), ("g", None, 9.0), ("h", 0.1, None)]
    df = spark.createDataFrame(rows, "m string, cost double, value double")
    assert sorted(r["m"] for r in metrics.pareto(df, "cost", "value").collect()) == ["a", "b", "d", "f"]
    assert metrics.pareto(df.limit(0), "cost", "value").count() == 0


def test_ranking_metrics_without_groups_and_with_null_groups(spark):
    rows = [(None, 1, 0.9), (None, 0, 0.2), ("m", 0, 0.9), ("m", 1, 0.2), ("m", 1, 0.2)]
    df = spark.createDataFrame(rows, "model_id string, y_true int, y_prob double")
    got = {r["model_id"]: (r["roc_auc"], r["pr_auc"]) for r in metrics.ranking_metrics(df, ["model_id"]).collect()}
    assert got == {None: (1.0, 1.0), "m": (0.0, pytest.approx(2 / 3))}
    # positives 0.9, 0.2, 0.2 against negatives 0.9, 0.2: one and a half, and twice a half, of six pairs
    assert metrics.ranking_metrics(df, []).first()["roc_auc"] == pytest.approx(2.5 / 6)


def test_tasks_have_generators_of_their_own(spark):
    def draw(batches):
        rng = experiment.seed_task(7)
        for b in batches:
            yield b.assign(x=rng.random(len(b)))

    run = lambda: spark.range(8, numPartitions=4).mapInPandas(draw, "id long, x double").collect()
    first = run()
    assert first == run() and len({r["x"] for r in first}) == 8


def test_run_record_has_all_columns(spark):
    names = [c.split()[0] for c in experiment.RUN_SCHEMA.split(", ")]
    run = experiment.start_run(spark, {"experiment_id": "E", "model_id": "LR", "dataset_id": "D", "seed": 1, "split_regime": "S", "train_version": "v", "test_version": "v"}, "h")
    assert {"run_id", "cell", "settings", "versions", "remark"} <= set(names) and set(run) <= set(names)
    assert run["versions"]["protocol"] == experiment.PROTOCOL and run["settings"]["spark.sql.session.timeZone"] == "UTC"
