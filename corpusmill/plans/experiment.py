"""Configuration, run registry and the data and experiment pipelines that tie the operators together."""

from __future__ import annotations

import hashlib
import json
import logging
import os
import platform
import random
import subprocess
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone
from importlib import metadata

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.hashing import sha256_json
from corpusmill.functions.lineage import cut
from corpusmill.functions.text import sanitize
from corpusmill.operators import clean, dedup, finetune, inference, labels, metrics, ml, profile, results, splits
from corpusmill.schema import SequenceParams
from corpusmill.sources import corpora, tables

PROTOCOL = "v1.0"
#: A run's record: what was run on which versions, by which code and engine, and how it ended.
RUN_SCHEMA = (
    "run_id string, cell map<string,string>, config_hash string, code_commit string, code_changed boolean, application_id string, parallelism int, "
    "settings map<string,string>, versions map<string,string>, began timestamp, ended timestamp, seconds double, outcome string, remark string"
)
#: Session settings that change how a plan runs; a run's record keeps them.
NOTED_SETTINGS = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.session.timeZone", "spark.sql.ansi.enabled", "spark.sql.files.maxPartitionBytes")


@dataclass(frozen=True)
class DatasetConfig:
    dataset_id: str
    entry: dict
    role: str = "transfer"
    source: str = ""


@dataclass(frozen=True)
class PipelineConfig:
    """Everything the data pipeline needs; unknown keys are refused by ``load``."""

    datasets: tuple[DatasetConfig, ...] = ()
    near_threshold: float = dedup.NEAR
    across_threshold: float = dedup.ACROSS
    seeds: tuple[int, ...] = tuple(splits.SEEDS)
    max_features: int = 50_000
    smote: bool = False
    lemmas: tuple[str, ...] = ()
    extra: dict = field(default_factory=dict)

    @staticmethod
    def load(value: dict) -> PipelineConfig:
        known = set(PipelineConfig.__dataclass_fields__)
        if unknown := set(value) - known:
            raise ValueError(f"unknown settings {sorted(unknown)}")
        datasets = tuple(DatasetConfig(**d) for d in value.get("datasets", ()))
        made = PipelineConfig(**{**value, "datasets": datasets, "seeds": tuple(value.get("seeds", splits.SEEDS)), "lemmas": tuple(value.get("lemmas", ()))})
        if made.smote or not 0 < made.near_threshold <= 1 or not 0 < made.across_threshold <= 1 or not made.seeds:
            raise ValueError("thresholds lie in (0, 1], seeds are needed, and SMOTE is prohibited")
        return made


def load_config(path: str) -> tuple[PipelineConfig, str]:
    """A JSON configuration and the hash of its bytes."""
    with open(path, "rb") as f:
        raw = f.read()
    return PipelineConfig.load(json.loads(raw)), hashlib.sha256(raw).hexdigest()


def composite_hash(paths: Iterable[str]) -> str:
    """One hash of several files by name and content."""
    found = {}
    for p in sorted(paths):
        with open(p, "rb") as f:
            found[os.path.basename(p)] = hashlib.sha256(f.read()).hexdigest()
    return sha256_json(found)


def module_version(name: str) -> str:
    try:
        return metadata.version(name)
    except metadata.PackageNotFoundError:
        return "not-installed"


def environment(spark: SparkSession) -> dict[str, str]:
    """Versions and machine, for the registry."""
    return {
        "spark": spark.version, "python": platform.python_version(), "platform": platform.platform(),
        **{m: module_version(m) for m in ("pyspark", "numpy", "pandas", "pyarrow", "tokenizers")},
    }


def git_state(folder: str = ".") -> tuple[str | None, bool | None]:
    """Commit and whether the tree differs from it; nulls outside a repository."""
    try:
        run = lambda *a: subprocess.run(["git", "-C", folder, *a], capture_output=True, text=True, check=True, timeout=20).stdout.strip()
        return run("rev-parse", "HEAD"), bool(run("status", "--porcelain"))
    except (OSError, subprocess.SubprocessError):
        return None, None


def now() -> datetime:
    return datetime.now(timezone.utc)


def make_run_id(experiment_id: str, model_id: str, seed: int, at: datetime) -> str:
    return sanitize(f"{at:%Y%m%dT%H%M%S}_{experiment_id}_{model_id}_s{seed}")


def start_run(spark: SparkSession, cell: dict, config_hash: str, folder: str = ".") -> dict:
    """The record of a run that begins now; ``cell`` names experiment, model, seed and versions."""
    at, (commit, changed) = now(), git_state(folder)
    return {
        "run_id": make_run_id(cell["experiment_id"], cell["model_id"], cell["seed"], at), "cell": {k: str(v) for k, v in cell.items()}, "config_hash": config_hash,
        "code_commit": commit, "code_changed": changed, "application_id": spark.sparkContext.applicationId, "parallelism": spark.sparkContext.defaultParallelism,
        "settings": {k: spark.conf.get(k) for k in NOTED_SETTINGS}, "versions": {**environment(spark), "protocol": PROTOCOL}, "began": at,
    }


def finish_run(spark: SparkSession, run: dict, path: str, outcome: str = "ok", remark: str | None = None) -> None:
    """The finished record, appended to the registry, and as JSON to ``path``-metadata, in a folder of the run's own."""
    end = now()
    row = run | {"ended": end, "outcome": outcome, "seconds": (end - run["began"]).total_seconds(), "remark": remark}
    names = [c.split()[0] for c in RUN_SCHEMA.split(", ")]
    record = spark.createDataFrame([tuple(row.get(n) for n in names)], RUN_SCHEMA)
    record.write.mode("append").parquet(path)
    record.coalesce(1).write.mode("overwrite").json(f"{path}-metadata/{run['run_id']}")


def logger(name: str, path: str | None = None) -> logging.Logger:
    """A logger with one stream handler, and one file handler for ``path``, however often it is asked for."""
    log = logging.getLogger(name)
    log.setLevel(logging.INFO)
    if not any(type(h) is logging.StreamHandler for h in log.handlers):
        log.addHandler(logging.StreamHandler())
    if path and not any(isinstance(h, logging.FileHandler) and h.baseFilename == os.path.abspath(path) for h in log.handlers):
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        log.addHandler(logging.FileHandler(path))
    return log


def seed_driver(seed: int) -> int:
    """Seeds the driver's generators; plans take their seed as a salt and need no global state."""
    random.seed(seed)
    np.random.seed(seed % 2**32)
    return seed


def seed_task(seed: int) -> np.random.Generator:
    """A generator of a task's own: the same for the same seed and partition, another for any other partition.

    For functions of ``mapInArrow`` and the like; where no task runs it is the driver's, partition 0.
    """
    context = TaskContext.get()
    part = 0 if context is None else context.partitionId()
    random.seed(f"{seed}:{part}")
    return np.random.default_rng([seed, part])


# --- data pipeline: each stage reads and writes tables, so each can be run alone -------------------


def binarize_stage(spark: SparkSession, config: PipelineConfig, roots: dict[str, str], out: str) -> DataFrame:
    """Reads and maps every corpus, writes version vBIN and returns the mapping report."""
    reports = []
    for d in config.datasets:
        raw = corpora.load_raw(spark, d.dataset_id, d.entry, roots[d.dataset_id])
        rows = labels.standardise(raw, d.dataset_id, "order")
        spec = labels.mapping_spec(d.dataset_id, d.entry)
        reports.append(labels.mapping_report(rows, spec))
        tables.write_version(labels.binarize(rows, spec, "row_pos").withColumn("version", F.lit("vBIN")), out)
    return corpora.union_all(reports)


def clean_stage(spark: SparkSession, config: PipelineConfig, out: str) -> None:
    """Both tracks of every vBIN version."""
    for d in config.datasets:
        df = tables.read_version(spark, out, d.dataset_id, "vBIN").drop("version")
        for track in clean.TRACKS:
            tables.write_version(clean.preprocess(df, track, lemmas=config.lemmas or None), out)


def dedup_stage(spark: SparkSession, config: PipelineConfig, out: str) -> DataFrame:
    """Survivors of the classical track as vDEDUP; returns the counts."""
    reports = []
    for d in config.datasets:
        df = tables.read_version(spark, out, d.dataset_id, "vCLEAN-C").drop("version")
        flags = cut(dedup.dedup_flags(df, config.near_threshold, max_features=config.max_features))  # read by the report and by what stays
        reports.append(dedup.dedup_report(flags, d.dataset_id))
        tables.write_version(dedup.survivors(df, flags).withColumn("version", F.lit("vDEDUP")), out)
    return corpora.union_all(reports)


def split_stage(spark: SparkSession, config: PipelineConfig, versions: str, out: str) -> None:
    for d in config.datasets:
        df = tables.read_version(spark, versions, d.dataset_id, "vDEDUP")
        ok = {a["regime"] for a in splits.applicability(d.dataset_id, df, d.entry) if a["applicable"]}
        made = splits.all_regimes(df, config.seeds, "source" if "S-SRC" in ok else None, splits.timestamp_column(df) if "S-TEMP" in ok else None)
        tables.write_splits(made, out)


def stats_stage(spark: SparkSession, config: PipelineConfig, versions: str, split_root: str) -> DataFrame:
    """Statistics of vBIN and vDEDUP, whole and by seed and part; parts of vBIN follow the lineage."""
    out = []
    for d in config.datasets:
        kept = tables.read_version(spark, versions, d.dataset_id, "vDEDUP")
        parts = spark.read.parquet(split_root).where((F.col("dataset_id") == d.dataset_id) & (F.col("regime") == "S-RAND")).select("dataset_id", "seed", "part", "row_pos")
        before = parts.join(kept.select("row_pos", "pre_dedup_index"), "row_pos").select("dataset_id", "seed", "part", F.col("pre_dedup_index").alias("row_pos"))
        out.append(profile.profile_parts(tables.read_version(spark, versions, d.dataset_id, "vBIN"), before))
        out.append(profile.profile_parts(kept, parts))
    return corpora.union_all(out)


def across_stage(spark: SparkSession, config: PipelineConfig, versions: str, out: str) -> DataFrame:
    """Test rows that stay for every transfer pair; returns the overlap report."""
    known = spark.createDataFrame([(d.dataset_id, d.role, d.source or d.dataset_id) for d in config.datasets], "dataset_id string, role string, source string")
    reports = []
    for r in dedup.transfer_pairs(known).orderBy("train_id", "test_id").collect():  # a row for each pair of datasets
        train, test = (tables.read_version(spark, versions, r[f"{s}_id"], "vDEDUP") for s in ("train", "test"))
        dropped = dedup.across_dropped(train, test, config.across_threshold, config.max_features)
        kept = test.join(dropped, "row_pos", "left_anti").select(F.lit(r["train_id"]).alias("train_id"), F.lit(r["test_id"]).alias("test_id"), "row_pos")
        tables.write_pairs(kept, out)
        reports.append(dedup.overlap_report(r["train_id"], r["test_id"], test, dropped, r["note"]))
    return corpora.union_all(reports)


# --- experiment 1: models by seeds within one corpus ---------------------------------------------------


def split_bundle(versions: DataFrame, neural: DataFrame | None, parts: DataFrame) -> DataFrame:
    """(row_pos, part, text, label) for one split; with ``neural`` the text is that version's, found by lineage."""
    rows = versions.join(parts.select("row_pos", "part"), "row_pos")
    if neural is None:
        return rows.select("row_pos", "part", "text", "label")
    texts = neural.select(F.col("row_pos").alias("pre_dedup_index"), F.col("text").alias("neural_text"))
    return rows.join(texts, "pre_dedup_index").select("row_pos", "part", F.col("neural_text").alias("text"), "label")


def run_cell(bundle: DataFrame, model_id: str, seed: int, max_features: int = ml.MAX_FEATURES, min_df: int = ml.MIN_DF, grid: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """One model and seed: (metrics, predictions) on the test part; the vectoriser sees the training part only."""
    train = bundle.where("part = 'train'")
    vectors = cut(ml.vectorize(ml.fit_tfidf(train, max_features, min_df), bundle).select("row_pos", "part", "label", "features"))
    part = lambda p: vectors.where(F.col("part") == p).select("row_pos", "label", "features")
    fitted, outcome = ml.train_classical(part("train"), part("val"), model_id, seed, grid)
    predicted = ml.predict(fitted, part("test")).select(F.lit(model_id).alias("model_id"), F.lit(seed).alias("seed"), "row_pos", F.col("label").alias("y_true"), "y_pred", "y_prob")
    measured = metrics.all_metrics(predicted, ["model_id", "seed"]).withColumns({"best_params_json": F.lit(json.dumps(outcome.best_params, sort_keys=True)), "val_macro_f1": F.lit(outcome.val_macro_f1)})
    return measured, predicted


def run_encoder_cell(
    bundle: DataFrame, model_id: str, seed: int, folder: str, ids: Callable[[Column], Column], params: SequenceParams, settings: finetune.Settings = finetune.Settings(), tasks: int = 4,
) -> tuple[DataFrame, DataFrame]:
    """One encoder and seed, trained on the training part: (metrics, predictions) on the test part.

    The vocabulary comes from the training part only. States of the epochs stay in ``folder``, so a call that was
    cut off goes on there; the metrics name the best epoch and the number of weights.
    """
    docs = bundle.where(F.col("label").isNotNull()).select("part", F.col("row_pos").alias("doc_idx"), "label", "text")
    part = lambda p: docs.where(F.col("part") == p).drop("part")
    s = replace(settings, seed=seed)
    known = finetune.vocabulary(part("train"), ids, s.vocabulary)
    train, val, test = (finetune.encoded_windows(part(p), ids, known, params) for p in ("train", "val", "test"))
    weights, log = finetune.train(train, val, params, folder, s, tasks)
    truth = part("test").select("doc_idx", F.col("label").alias("y_true"))
    predicted = finetune.predict(test, s.shape(params), weights).join(truth, "doc_idx")
    predicted = predicted.select(F.lit(model_id).alias("model_id"), F.lit(seed).alias("seed"), F.col("doc_idx").alias("row_pos"), "y_true", "y_pred", "y_prob")
    best = log.where("improved").orderBy(F.desc("epoch")).first()
    measured = metrics.all_metrics(predicted, ["model_id", "seed"]).withColumns({
        "n_params": F.lit(len(weights)).cast("long"), "best_epoch": F.lit(best["epoch"]), "val_macro_f1": F.lit(best["val_macro_f1"]), "checkpoint_path": F.lit(f"{folder}/epoch={best['epoch']}/state"),
    })
    return measured, predicted


def run_sweep(spark: SparkSession, bundles: dict[int, DataFrame], models: Sequence[str], results_path: str, predictions_path: str, provenance: dict, grids: dict | None = None, force: bool = False) -> list[tuple[str, int]]:
    """Runs the cells that have no result yet (all with ``force``) and appends what they give; returns them."""
    cells = results.sweep_cells(spark, models, list(bundles))
    try:
        have = tables.read_results(spark, results_path)
        todo = cells if force else results.missing_cells(cells, have)
    except Exception as e:  # no result was ever written
        if "PATH_NOT_FOUND" not in str(e):
            raise
        todo = cells
    done = []
    for r in todo.orderBy("model_id", "seed").collect():  # a row for each model and seed
        measured, predicted = run_cell(bundles[r["seed"]], r["model_id"], r["seed"], grid=(grids or {}).get(r["model_id"]))
        tables.append_results(results.result_rows(measured, **provenance, run_id=make_run_id(provenance["experiment_id"], r["model_id"], r["seed"], now())), results_path)
        tables.write_predictions(predicted, predictions_path)
        done.append((r["model_id"], r["seed"]))
    return done


def finalize(spark: SparkSession, models: Sequence[str], seeds: Sequence[int], results_path: str, predictions_path: str, resamples: int = inference.RESAMPLES) -> tuple[DataFrame, DataFrame]:
    """(comparisons of all pairs, best model), once every cell has a result; else raises."""
    rows = results.latest(tables.read_results(spark, results_path))
    if not results.is_complete(results.sweep_cells(spark, models, seeds), rows):
        raise RuntimeError("the sweep is not complete")
    order = spark.createDataFrame(list(zip(models, range(len(models)))), "model_id string, ord int")
    compared = inference.pairwise_comparisons(tables.read_predictions(spark, predictions_path, models), order, rows.select("model_id", "seed", F.col("macro_f1").alias("value")), resamples)
    ranked = rows if "n_params" in rows.columns else rows.withColumn("n_params", F.lit(None).cast("long"))
    return compared, results.best_model(ranked)
