"""Readers of the five kinds of raw corpora; each gives (order, title, text, label_raw, source_file)."""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.text import strip
from corpusmill.schema import STATEMENT


def find_file(root: str, name: str) -> str | None:
    """``name`` below ``root``, then without its first directory, then anywhere by its base name."""
    for n in (name, name.partition("/")[2]):
        if n and os.path.isfile(os.path.join(root, n)):
            return os.path.join(root, n)
    want = os.path.basename(name)
    return next((os.path.join(d, want) for d, _, files in sorted(os.walk(root)) if want in files), None)


def column_or_null(df: DataFrame, name: str) -> Column:
    """A column by name, whatever its case, or nulls."""
    have = {c.lower(): c for c in df.columns}
    return F.col(f"`{have[name.lower()]}`") if name.lower() in have else F.lit(None)


def read_csv(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """CSV with a header; quoted fields may hold line ends and doubled quotes."""
    return spark.read.csv(list(paths), header=True, multiLine=True, quote='"', escape='"')


def _rows(df: DataFrame, title: Column, text: Column, label: Column) -> DataFrame:
    path = F.col("_metadata.file_path")
    order = F.struct(path.alias("file"), F.monotonically_increasing_id().alias("at"))
    return df.select(
        order.alias("__place"), title.cast("string").alias("title"), text.cast("string").alias("text"), label.cast("string").alias("label_raw"),
        F.col("_metadata.file_name").alias("source_file"),
    )


def _numbered(df: DataFrame) -> DataFrame:
    """Rows of raw files get their number once, where they are read; ids of one file ascend with its lines."""
    return df.select(F.col("__place.at").alias("order"), "title", "text", "label_raw", "source_file")


def load_articles(spark: SparkSession, root: str, entry: dict) -> DataFrame:
    """One CSV with title, text and label columns; the first one found unless it is configured."""
    names = entry.get("source_files") or sorted(f for f in os.listdir(root) if f.lower().endswith(".csv"))
    df = read_csv(spark, [find_file(root, names[0]) or os.path.join(root, names[0])])
    c = entry.get("text_columns", {})
    return _numbered(_rows(df, column_or_null(df, c.get("title", "title")), column_or_null(df, c.get("body", "text")), column_or_null(df, entry.get("label_column", "label"))))


def load_true_fake(spark: SparkSession, root: str, entry: dict) -> DataFrame:
    """Two CSVs whose names say the class."""
    df = read_csv(spark, [p for p in (find_file(root, "True.csv"), find_file(root, "Fake.csv")) if p])
    label = F.when(F.lower("_metadata.file_name").startswith("true"), "real").otherwise("fake")
    return _numbered(_rows(df, column_or_null(df, "title"), column_or_null(df, "text"), label))


def load_named_classes(spark: SparkSession, root: str, entry: dict) -> DataFrame:
    """CSVs named ``*_fake`` and ``*_real``; a null or blank body falls back to the title."""
    files = [p for f in entry.get("source_files", []) if (p := find_file(root, f))] or [os.path.join(d, f) for d, _, fs in sorted(os.walk(root)) for f in sorted(fs) if f.endswith(("_fake.csv", "_real.csv"))]
    df = read_csv(spark, files)
    title = column_or_null(df, "title").cast("string")
    body = column_or_null(df, entry.get("text_columns", {}).get("body", "text")).cast("string")
    label = F.regexp_extract("_metadata.file_name", r"_(fake|real)\.", 1)
    return _numbered(_rows(df, title, F.coalesce(F.when(strip(body) != "", body), title), label))


def load_posts(spark: SparkSession, root: str, entry: dict) -> DataFrame:
    """CSVs of short posts without a title."""
    df = read_csv(spark, [p for f in entry["source_files"] if (p := find_file(root, f))])
    return _numbered(_rows(df, F.lit(None), column_or_null(df, entry.get("text_columns", {}).get("body", "tweet")), column_or_null(df, entry.get("label_column", "label"))))


def load_statements(spark: SparkSession, root: str, entry: dict) -> DataFrame:
    """Headerless tab-separated files of 14 string columns, quotes taken literally; empty files are skipped."""
    files = [p for f in entry.get("tsv_files", ["train.tsv", "valid.tsv", "test.tsv"]) if (p := find_file(root, f)) and os.path.getsize(p)]
    df = spark.read.schema(STATEMENT).csv(files, sep="\t", quote="", header=False)
    return _numbered(_rows(df, F.lit(None), F.col("statement"), F.col("label")))


LOADERS: dict[str, Callable[[SparkSession, str, dict], DataFrame]] = {
    "DS1": load_articles, "DS2": load_true_fake, "DS3": load_named_classes, "DS4": load_posts, "DS5": load_statements,
}


def load_raw(spark: SparkSession, dataset_id: str, entry: dict, root: str) -> DataFrame:
    if dataset_id not in LOADERS:
        raise KeyError(f"no reader for {dataset_id!r}")
    return LOADERS[dataset_id](spark, root, entry)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
