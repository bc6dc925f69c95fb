import hashlib
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from corpusmill.operators import ml, results
from corpusmill.plans import experiment as X
from corpusmill.sources import corpora, snapshots, tables
from corpusmill.streaming import incremental


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)


def test_snapshot_hash(spark, tmp_path):
    put(f"{tmp_path}/a/one.txt", "1")
    put(f"{tmp_path}/a/sub/two.txt", "22")
    put(f"{tmp_path}/a/.hidden", "x")
    shots = snapshots.snapshots(spark, {"DS1": f"{tmp_path}/a", "DS2": None})
    got = {r["dataset_id"]: r for r in shots.collect()}
    lines = "\n".join(f"{n}\t{hashlib.sha256(t.encode()).hexdigest()}" for n, t in (("one.txt", "1"), ("sub/two.txt", "22")))
    assert tuple(got["DS1"]) == ("DS1", "ok", hashlib.sha256(lines.encode()).hexdigest(), 2, 3) and got["DS2"]["status"] == "missing"
    assert tuple(snapshots.manifest(shots).first())[:2] == (1, 1)
    assert [r[0].split("\t")[0] for r in snapshots.ledger_lines(shots).collect()] == ["DS1", "DS2"]
    assert {r["n_files"] for r in snapshots.folder_report(snapshots.input_files(spark, f"{tmp_path}/a")).collect()} <= {1, 2}


def test_path_resolution(tmp_path):
    for d in ("fake-news-x", "owner/liar"):
        put(f"{tmp_path}/{d}/f.csv", "")
    found = snapshots.list_inputs(str(tmp_path))
    assert [os.path.basename(p) for p in found] == ["fake-news-x", "liar"]
    assert snapshots.resolve("D", {"kaggle_slug": "owner/liar"}, str(tmp_path), found).endswith("owner/liar")
    assert snapshots.resolve("D", {"input_dirname": "fake-news"}, str(tmp_path), found).endswith("fake-news-x")
    assert snapshots.resolve("D", {"input_dirname": "news"}, str(tmp_path), found) is None


def test_readers(spark, tmp_path):
    root = str(tmp_path)
    put(f"{root}/1/W.csv", 'Title,Text,Label\nT,"a ""q""\nb",1\nU,,0\n')
    put(f"{root}/2/True.csv", "title,text\nt,x\n")
    put(f"{root}/2/Fake.csv", "title,text\nf,y\n")
    put(f"{root}/3/p/a_fake.csv", "id,title\n1,only title\n")
    put(f"{root}/3/p/b_real.csv", "id,title,text\n1,t, \n")
    put(f"{root}/4/c.csv", "id,tweet,label\n1,hello,real\n")
    put(f"{root}/5/train.tsv", "\t".join(["i", "pants-fire", 'said "so'] + ["x"] * 11) + "\n")
    put(f"{root}/5/valid.tsv", "")
    get = lambda k, entry: sorted((r["title"] or "", r["text"] or "", r["label_raw"]) for r in corpora.load_raw(spark, f"DS{k}", entry, f"{root}/{k}").collect())
    assert get(1, {}) == [("T", 'a "q"\nb', "1"), ("U", "", "0")]
    assert get(2, {}) == [("f", "y", "fake"), ("t", "x", "real")]
    assert get(3, {"source_files": ["p/a_fake.csv"]}) == [("only title", "only title", "fake")]
    assert get(4, {"source_files": ["sub/c.csv"], "text_columns": {"body": "tweet"}}) == [("", "hello", "real")]
    assert get(5, {}) == [("", 'said "so', "pants-fire")]
    with pytest.raises(KeyError):
        corpora.load_raw(spark, "DS9", {}, root)


def test_tables(spark, tmp_path):
    idx = spark.createDataFrame([(5,), (1,), (3,)], "row_pos long")
    tables.write_indices(idx, f"{tmp_path}/i")
    assert sorted(r[0] for r in tables.read_indices(spark, f"{tmp_path}/i").collect()) == [1, 3, 5]
    split = spark.createDataFrame([("D", "S-RAND", 13, "train", 0), ("D", "S-RAND", 13, "test", 1)], "dataset_id string, regime string, seed int, part string, row_pos long")
    tables.write_splits(split, f"{tmp_path}/s")
    assert tables.read_split(spark, f"{tmp_path}/s", "D", "S-RAND", 13).count() == 2
    assert os.path.isdir(tables.split_path(f"{tmp_path}/s", "D", "S-RAND", 13, "train"))
    row = spark.createDataFrame([("E", "r", "LR", "D", "v", "v", "S", 1, 0.5)], "experiment_id string, run_id string, model_id string, dataset_id string, train_version string, test_version string, split_regime string, seed int, macro_f1 double")
    tables.append_results(row, f"{tmp_path}/r")
    tables.append_results(row.withColumn("best_params_json", F.lit("{}")), f"{tmp_path}/r")
    assert tables.read_results(spark, f"{tmp_path}/r").where("best_params_json is null").count() == 1
    tables.append_csv(idx, f"{tmp_path}/c")
    tables.append_csv(idx, f"{tmp_path}/c")
    assert tables.read_csv(spark, f"{tmp_path}/c", "row_pos long").count() == 6
    tables.write_json({"b": 1, "a": 2}, f"{tmp_path}/x/j.json")
    assert list(tables.read_json(f"{tmp_path}/x/j.json")) == ["a", "b"]
    tables.write_line(spark, "LR", f"{tmp_path}/best")
    assert spark.read.text(f"{tmp_path}/best").first()[0] == "LR"


def test_config(tmp_path):
    put(f"{tmp_path}/c.json", json.dumps({"datasets": [{"dataset_id": "DS1", "entry": {}}], "seeds": [1]}))
    config, digest = X.load_config(f"{tmp_path}/c.json")
    assert config.seeds == (1,) and len(digest) == 64 and X.composite_hash([f"{tmp_path}/c.json"]) != digest
    for bad in ({"nope": 1}, {"smote": True}, {"near_threshold": 1.5}, {"seeds": []}):
        with pytest.raises(ValueError):
            X.PipelineConfig.load(bad)


def test_run_registry(spark, tmp_path):
    run = X.start_run(spark, {"experiment_id": "E 1", "model_id": "LR", "dataset_id": "D", "seed": 13, "split_regime": "S", "train_version": "v", "test_version": "v"}, "abc", str(tmp_path))
    X.finish_run(spark, run, f"{tmp_path}/runs")
    got = spark.read.parquet(f"{tmp_path}/runs").first()
    assert got["outcome"] == "ok" and got["seconds"] >= 0 and got["run_id"].endswith("E-1_LR_s13") and got["cell"]["seed"] == "13"
    assert json.loads(spark.read.text(f"{tmp_path}/runs-metadata/{run['run_id']}").first()[0])["versions"]["numpy"] == np.__version__
    log = X.logger("t", f"{tmp_path}/l/x.log")
    assert len(X.logger("t", f"{tmp_path}/l/x.log").handlers) == len(log.handlers) == 2
    assert X.module_version("no-such-module") == "not-installed"


def corpus(n=240):
    rng = np.random.default_rng(4)
    fake, real = [f"hoax{i}" for i in range(30)], [f"fact{i}" for i in range(30)]
    out = []
    for i in range(n):
        words = [*rng.choice(fake if i % 2 else real, 14), *rng.choice(["common", "news", "today"], 4), f"unique{i}"]
        out.append(("t" if i % 3 else "", " ".join(words), i % 2))
    return out + [out[0]]


def test_data_pipeline_and_experiment(spark, tmp_path):
    root, versions, split_root = f"{tmp_path}/raw", f"{tmp_path}/v", f"{tmp_path}/s"
    put(f"{root}/a.csv", "title,text,label\n" + "\n".join(f"{t},{x},{y}" for t, x, y in corpus()) + "\n,blank,maybe\n")
    entry = {"source_binary_map": {"fake": [1], "real": [0]}}
    config = X.PipelineConfig.load({"datasets": [{"dataset_id": "DS1", "entry": entry}], "seeds": [13], "near_threshold": 0.95})
    report = X.binarize_stage(spark, config, {"DS1": root}, versions).first()
    assert (report["n_raw"], report["n_ambiguous"], report["n_kept"]) == (242, 1, 241)
    X.clean_stage(spark, config, versions)
    counts = X.dedup_stage(spark, config, versions).first()
    assert (counts["n_before"], counts["n_exact_removed"], counts["n_kept"]) == (241, 1, 240)
    X.split_stage(spark, config, versions, split_root)
    stats = {(r["version"], r["part"]): r["n"] for r in X.stats_stage(spark, config, versions, split_root).collect()}
    assert stats["vBIN", "full"] == 241 and stats["vDEDUP", "full"] == 240 and stats["vBIN", "test"] == stats["vDEDUP", "test"] == 36
    parts = tables.read_split(spark, split_root, "DS1", "S-RAND", 13)
    kept = tables.read_version(spark, versions, "DS1", "vDEDUP")
    bundle = X.split_bundle(kept, None, parts)
    neural = X.split_bundle(kept, tables.read_version(spark, versions, "DS1", "vCLEAN-N"), parts)
    assert bundle.count() == neural.count() == 240
    paths = (f"{tmp_path}/results", f"{tmp_path}/pred")
    provenance = dict(experiment_id="EXP-1", dataset_id="DS1", train_version="vDEDUP", test_version="vDEDUP", split_regime="S-RAND")
    grids = {"LR": {"C": [1.0], "maxIter": [20]}, "SVM": {"C": [1.0], "maxIter": [10]}}
    assert X.run_sweep(spark, {13: bundle}, ["LR", "SVM"], *paths, provenance, grids) == [("LR", 13), ("SVM", 13)]
    assert X.run_sweep(spark, {13: bundle}, ["LR", "SVM"], *paths, provenance, grids) == []
    compared, best = X.finalize(spark, ["LR", "SVM"], [13], *paths, resamples=200)
    assert compared.count() == 1 and best.first()["macro_f1"] > 0.9
    with pytest.raises(RuntimeError):
        X.finalize(spark, ["LR", "RF"], [13], *paths)


@pytest.mark.parametrize("model,grid", [("RF", {"numTrees": [5], "maxDepth": [4], "minInstancesPerNode": [1]}), ("GBT", {"maxIter": [15], "maxDepth": [3], "stepSize": [0.1]})])
def test_tree_models_and_no_leakage(spark, model, grid):
    rows = spark.createDataFrame([(i, x, y) for i, (_, x, y) in enumerate(corpus(80))], "row_pos long, text string, label int")
    train, val = rows.where("row_pos < 60"), rows.where("row_pos >= 60").withColumn("text", F.concat("text", F.lit(" leaked leaked")))
    vectors = ml.fit_tfidf(train, 200, 2)
    assert "leaked" not in vectors.stages[0].vocabulary
    data = [ml.vectorize(vectors, d).select("row_pos", "features", "label") for d in (train, val)]
    fitted, outcome = ml.train_classical(*data, model, 13, grid)
    assert outcome.val_macro_f1 > 0.8 and ml.predict(fitted, data[1]).where("y_prob between 0 and 1").count() == val.count()


def test_tfidf_weights(spark):
    df = spark.createDataFrame([("aa bb aa",), ("aa cc",), ("bb",)], "text string")
    model = ml.fit_tfidf(df, 10, 1)
    got = ml.vectorize(model, df.limit(1)).first()["features"]
    idf = lambda d: np.log(4 / (1 + d)) + 1
    want = {"aa": 2 * idf(2), "bb": idf(2), "aa bb": idf(1), "bb aa": idf(1)}
    norm = np.sqrt(sum(v * v for v in want.values()))
    assert {model.stages[0].vocabulary[i]: v for i, v in zip(got.indices, got.values)} == {k: pytest.approx(v / norm) for k, v in want.items()}


def test_batch_logits(spark):
    rows = spark.createDataFrame([(0, 0, [1, 2], [1, 1]), (1, 0, [3, 0], [1, 0])], "doc_idx int, window_idx int, input_ids array<int>, attention_mask array<int>")
    got = ml.batch_logits(rows, lambda: (lambda ids, mask: np.stack([ids.sum(1), mask.sum(1)], 1)))
    assert sorted((r["doc_idx"], r["logits"]) for r in got.collect()) == [(0, [3.0, 2.0]), (1, [3.0, 1.0])]


def test_streams(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text{i % 3}", i % 2, (i // 2) % 2) for i in range(12)], "i long, text string, y_true int, y_pred int").withColumn("ts", F.timestamp_seconds(F.col("i") * 60))
    df.repartition(2).write.parquet(f"{tmp_path}/in")
    stream = incremental.read_stream(spark, f"{tmp_path}/in", df.schema)

    def finish(out, name, mode):
        q = out.writeStream.format("memory").queryName(name).outputMode(mode).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name)

    assert finish(incremental.first_seen(stream, "ts"), "seen", "append").count() == 3
    r = finish(incremental.running_confusion(stream, []), "conf", "complete").orderBy(F.desc(F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))).first()
    assert tuple(r) == (3, 3, 3, 3)
    assert finish(incremental.windowed_metrics(stream, "ts", [], "2 minutes", "1 minute"), "win", "update").count() >= 6


def test_entry_points(spark):
    assert __spark_entry__.entry(spark).columns[0] == "label"
    queries, oracle = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracle) <= set(queries) and len(queries) >= 50
    assert results.PROVENANCE[0] == "experiment_id"
