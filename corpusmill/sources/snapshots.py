"""Raw snapshots: listing, content hashes, path resolution, ledger and manifest."""

from __future__ import annotations

import os
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.hashing import directory_hash
from corpusmill.schema import SNAPSHOT

GENERIC = {"data", "dataset", "datasets", "news", "fake", "real"}


def input_files(spark: SparkSession, root: str) -> DataFrame:
    """``binaryFile`` rows of everything below ``root``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)


def list_inputs(root: str) -> list[str]:
    """Leaf directories below ``root`` that hold files, hidden ones aside, each real path once, in order."""
    found: dict[str, str] = {}
    for folder, names, files in os.walk(root):
        names[:] = sorted(n for n in names if not n.startswith("."))
        if any(not f.startswith(".") for f in files) and not names:
            found.setdefault(os.path.realpath(folder), folder)
    return sorted(found.values())


def resolve(dataset_id: str, entry: dict, root: str, attached: Sequence[str]) -> str | None:
    """Where a corpus is: its configured path, owner/name, directory name, then a name that its hint is part of.

    Hints made only of generic words never match.
    """
    slug, name = str(entry.get("kaggle_slug") or ""), str(entry.get("input_dirname") or "")
    for path in (entry.get("input_path"), os.path.join(root, slug) if slug else None, os.path.join(root, name) if name else None):
        if path and os.path.isdir(path):
            return path
    for path in attached:
        if name and os.path.basename(path) == name:
            return path
    hints = [h for h in (name, slug.rpartition("/")[2], str(entry.get("name") or "").lower()) if h and h not in GENERIC]
    return next((p for p in attached for h in hints if h in os.path.basename(p).lower()), None)


def snapshots(spark: SparkSession, catalog: dict[str, str | None]) -> DataFrame:
    """(dataset_id, status, digest, n_files, n_bytes) for each corpus; one without a path is ``missing``."""
    ids = spark.createDataFrame([(k,) for k in catalog], "dataset_id string")
    made = [
        directory_hash(input_files(spark, path), path).select(F.lit(k).alias("dataset_id"), F.lit("ok").alias("status"), "digest", "n_files", F.col("n_bytes").cast("long").alias("n_bytes"))
        for k, path in catalog.items() if path
    ]
    found = reduce(DataFrame.unionByName, made) if made else spark.createDataFrame([], SNAPSHOT)
    return ids.join(found, "dataset_id", "left").withColumn("status", F.coalesce("status", F.lit("missing")))


def ledger_lines(shots: DataFrame) -> DataFrame:
    """One text line for each snapshot, in order of its id: for ``df.write.text``."""
    return shots.orderBy("dataset_id").select(F.concat_ws("\t", "dataset_id", F.coalesce("digest", F.lit("-")), F.coalesce(F.col("n_files").cast("string"), F.lit("0")), F.coalesce(F.col("n_bytes").cast("string"), F.lit("0")), "status").alias("value"))


def manifest(shots: DataFrame) -> DataFrame:
    """(n_ok, n_missing, snapshots): one JSON document of a handful of snapshots."""
    return shots.agg(F.count_if(F.col("status") == "ok").alias("n_ok"), F.count_if(F.col("status") == "missing").alias("n_missing"), F.array_sort(F.collect_list(F.struct("dataset_id", "status", "digest", "n_files", "n_bytes"))).alias("snapshots"))


def folder_report(files: DataFrame) -> DataFrame:
    """(folder, n_files, n_bytes) of a ``binaryFile`` frame."""
    return files.groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("n_bytes")).orderBy("folder")
