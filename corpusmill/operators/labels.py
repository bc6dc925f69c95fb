"""Raw labels to the binary label space {real: 0, fake: 1}."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.numbering import long_bucket, positions
from corpusmill.functions.text import label_token
from corpusmill.schema import MappingSpec

REAL, FAKE = 0, 1
# Six grades of truth and the class they count as.
SIX_WAY = MappingSpec("DS5", ("pants-fire", "false", "barely-true"), ("half-true", "mostly-true", "true"))
DEFAULT = MappingSpec("*", ("1", "fake", "false"), ("0", "real", "true"), explicit=False)


def token(value: object) -> str:
    """Driver-side twin of ``label_token`` for configured tokens."""
    text = str(int(value)) if isinstance(value, float) and value.is_integer() else str(value)
    return text.strip().lower().replace("_", "-").replace(" ", "-")


def token_map(fake: Iterable[object], real: Iterable[object]) -> dict[str, int]:
    """Token to class; a token on both sides is fake."""
    return {token(t): REAL for t in real} | {token(t): FAKE for t in fake}


def mapping_spec(dataset_id: str, entry: dict) -> MappingSpec:
    """The mapping of a corpus: six-way if configured, else explicit, else the default; DS1 must be explicit."""
    for key in ("liar_binary_map", "source_binary_map"):
        if chosen := entry.get(key):
            return MappingSpec(dataset_id, tuple(map(token, chosen["fake"])), tuple(map(token, chosen["real"])))
    if dataset_id == "DS1":
        raise ValueError("DS1 needs an explicit map: published descriptions of its polarity disagree")
    return MappingSpec(dataset_id, DEFAULT.fake, DEFAULT.real, explicit=False)


def map_label(raw: Column, spec: MappingSpec) -> Column:
    """The class of a raw label; null if it is missing or not mapped."""
    key = label_token(raw)
    pairs = token_map(spec.fake, spec.real)
    return F.when(key.isin(*[t for t, y in pairs.items() if y == FAKE]), FAKE).when(key.isin(*[t for t, y in pairs.items() if y == REAL]), REAL).cast("int")


def apply_binary_map(df: DataFrame, spec: MappingSpec, raw: str = "label_raw") -> DataFrame:
    """``df`` with label, is_missing (no token) and is_ambiguous (a token that is not mapped)."""
    key = label_token(F.col(raw))
    label = map_label(F.col(raw), spec)
    return df.withColumns({"label": label, "is_missing": key.isNull(), "is_ambiguous": key.isNotNull() & label.isNull()})


def standardise(df: DataFrame, dataset_id: str, order: str) -> DataFrame:
    """The canonical columns: missing ones null, a constant id, and uid numbered by ``order``."""
    have = {c.lower(): c for c in df.columns}
    pick = lambda c: F.col(have[c]).cast("string") if c in have else F.lit(None).cast("string")
    out = df.select(F.col(order).alias("__order"), *[pick(c).alias(c) for c in ("title", "text", "label_raw", "source_file")])
    return numbered(out.withColumn("dataset_id", F.lit(dataset_id)), "__order").drop("__order")


def numbered(df: DataFrame, order: str) -> DataFrame:
    """Adds row_pos (0, 1, ... within a dataset by the integer column ``order``) and uid."""
    out = positions(df.drop("row_pos", "uid") if order not in ("row_pos", "uid") else df, [order], long_bucket(order), ["dataset_id"], "__pos")
    out = out.withColumn("row_pos", F.col("__pos")).drop("__pos")
    return out.withColumn("uid", F.concat_ws("_", "dataset_id", F.col("row_pos").cast("string")))


def binarize(df: DataFrame, spec: MappingSpec, order: str) -> DataFrame:
    """Rows whose label maps, with label and a new numbering."""
    kept = apply_binary_map(df, spec).where(~(F.col("is_missing") | F.col("is_ambiguous"))).drop("is_missing", "is_ambiguous")
    return numbered(kept, order)


def mapping_report(df: DataFrame, spec: MappingSpec) -> DataFrame:
    """Per dataset: rows, missing, ambiguous, kept, and kept by class."""
    kept = ~(F.col("is_missing") | F.col("is_ambiguous"))
    return (
        apply_binary_map(df, spec).groupBy("dataset_id").agg(
            F.count(F.lit(1)).alias("n_raw"), F.count_if("is_missing").alias("n_missing"), F.count_if("is_ambiguous").alias("n_ambiguous"),
            F.count_if(kept).alias("n_kept"), F.count_if(kept & (F.col("label") == FAKE)).alias("n_fake"), F.count_if(kept & (F.col("label") == REAL)).alias("n_real"),
        )
    )


def label_domain_ok(df: DataFrame) -> DataFrame:
    """One row: whether every label is 0 or 1."""
    return df.agg(F.coalesce(F.bool_and(F.coalesce(F.col("label").isin(REAL, FAKE), F.lit(False))), F.lit(True)).alias("ok"))
