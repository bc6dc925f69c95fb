"""Statistics of dataset versions and their parts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import char_length, combined_text, word_count


def with_lengths(df: DataFrame) -> DataFrame:
    """``df`` with n_chars and n_words of title and text together."""
    text = combined_text(F.col("title") if "title" in df.columns else F.lit(None).cast("string"), F.col("text"))
    return df.withColumn("__text", text).withColumns({"n_chars": char_length(F.col("__text")), "n_words": word_count(F.col("__text"))}).drop("__text")


def class_counts() -> list[Column]:
    """n, n_fake, n_real and the share of fake rounded to 6 digits, null where there are no rows."""
    n, fake = F.count(F.lit(1)), F.count_if(F.col("label") == 1)
    return [n.alias("n"), fake.alias("n_fake"), F.count_if(F.col("label") == 0).alias("n_real"), F.round(fake / F.nullif(n, F.lit(0)), 6).alias("fake_ratio")]


def length_stats() -> list[Column]:
    """Exact mean and median of characters and words, rounded to 3 digits."""
    out = []
    for c, name in (("n_chars", "chars"), ("n_words", "words")):
        out += [F.round(F.avg(c), 3).alias(f"mean_{name}"), F.round(F.median(c).cast("double"), 3).alias(f"median_{name}")]
    return out


def profile(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Class counts and length statistics of each group of ``by``."""
    return with_lengths(df).groupBy(*by).agg(*class_counts(), *length_stats())


def profile_parts(full: DataFrame, parts: DataFrame, dimension: DataFrame | None = None) -> DataFrame:
    """Statistics of each whole version and of each seed and part of it.

    ``full``: (dataset_id, version, row_pos, title, text, label); ``parts``: (dataset_id, seed, part, row_pos).
    ``dimension`` (dataset_id, version, seed, part) adds empty parts with n = 0.
    """
    measured = with_lengths(full).select("dataset_id", "version", "row_pos", "label", "n_chars", "n_words")
    keys = ["dataset_id", "version", "seed", "part"]
    whole = measured.withColumns({"seed": F.lit(None).cast("int"), "part": F.lit("full")})
    split = measured.join(parts.select("dataset_id", F.col("seed").cast("int").alias("seed"), "part", "row_pos"), ["dataset_id", "row_pos"])
    rows = whole.select(*keys, "label", "n_chars", "n_words").unionByName(split.select(*keys, "label", "n_chars", "n_words"))
    out = rows.groupBy(*keys).agg(*class_counts(), *length_stats())
    if dimension is None:
        return out
    counts = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n", "n_fake", "n_real")}
    d = dimension.select(*[F.col(c).alias(f"__{c}") for c in keys])
    on = F.lit(True)
    for c in keys:
        on &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    return d.join(out, on, "left").drop(*keys).withColumnsRenamed({f"__{c}": c for c in keys}).withColumns(counts).select(out.columns)


def surface_features(df: DataFrame) -> DataFrame:
    """Length, share of punctuation and share of capitals of each text: what a shortcut baseline sees."""
    n = F.greatest(F.length("text"), F.lit(1))
    return df.select(
        "row_pos", F.length("text").alias("n_chars"),
        F.round(F.length(F.regexp_replace("text", r"[^\p{P}]", "")) / n, 6).alias("punctuation_rate"),
        F.round(F.length(F.regexp_replace("text", r"[^\p{Lu}]", "")) / n, 6).alias("capital_rate"),
    )
