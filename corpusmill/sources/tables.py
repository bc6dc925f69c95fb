"""Sinks and sources of tables, index files, results and predictions."""

from __future__ import annotations

import json
import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators.results import column_order, validate
from corpusmill.schema import PREDICTION, SPLIT


def write_version(df: DataFrame, root: str) -> None:
    """Canonical rows below ``root``, by dataset and version, so readers prune both."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset_id", "version").parquet(root)


def read_version(spark: SparkSession, root: str, dataset_id: str, version: str) -> DataFrame:
    """One version with its own columns (versions differ in theirs); only its directory is listed."""
    return spark.read.option("basePath", root).parquet(f"{root}/dataset_id={dataset_id}/version={version}")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, quoteAll=False, escape='"')


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.csv(path, header=True, multiLine=True, escape='"')


def append_csv(df: DataFrame, path: str) -> None:
    """More rows of the same columns; every part file has its own header line."""
    df.write.mode("append").csv(path, header=True, escape='"')


def write_json(value: dict, path: str) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(value, f, sort_keys=True, indent=2, default=str)


def read_json(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def write_json_rows(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_indices(df: DataFrame, path: str, column: str = "row_pos") -> None:
    """One integer a line, ascending over the part files in order of their names."""
    df.orderBy(column).select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def read_indices(spark: SparkSession, path: str) -> DataFrame:
    """(row_pos) of an index file; blank lines are skipped."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.trim("value").cast("long").alias("row_pos"))


def write_splits(split: DataFrame, root: str) -> None:
    """All parts of all splits in one write, found again by directory."""
    split.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset_id", "regime", "seed", "part").parquet(root)


def read_split(spark: SparkSession, root: str, dataset_id: str, regime: str, seed: int) -> DataFrame:
    return spark.read.schema(SPLIT).parquet(root).where((F.col("dataset_id") == dataset_id) & (F.col("regime") == regime) & (F.col("seed") == seed))


def split_path(root: str, dataset_id: str, regime: str, seed: int, part: str) -> str:
    return f"{root}/dataset_id={dataset_id}/regime={regime}/seed={seed}/part={part}"


def pair_path(root: str, train_id: str, test_id: str) -> str:
    return f"{root}/train_id={train_id}/test_id={test_id}"


def write_pairs(kept: DataFrame, root: str) -> None:
    """(train_id, test_id, row_pos) of every transfer pair."""
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("train_id", "test_id").parquet(root)


def append_results(df: DataFrame, path: str) -> None:
    """Validated rows, columns in order; sets of columns may differ between writes."""
    validate(df).select(*column_order(df.columns)).write.mode("append").parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path)


def write_predictions(df: DataFrame, root: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model_id", "seed").parquet(root)


def read_predictions(spark: SparkSession, root: str, models: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.schema(PREDICTION).parquet(root)
    return df if models is None else df.where(F.col("model_id").isin(*models))


def write_line(spark: SparkSession, text: str, path: str) -> None:
    """A one-line text file, such as the name of the chosen model."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
