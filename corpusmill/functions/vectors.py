"""TF-IDF weights as a long table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]{2,}"
MAX_FEATURES = 50_000


def ngrams(text: Column, largest: int = 2) -> Column:
    """Lower-cased runs of two or more word characters, and pairs of neighbours joined by a space."""
    words = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    if largest == 1:
        return words
    n = F.greatest(F.size(words) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(words, pairs)


def term_counts(docs: DataFrame, key: str = "row_pos", largest: int = 2) -> DataFrame:
    """(key, term, tf)."""
    words = docs.select(key, ngrams(F.coalesce(F.col("text"), F.lit("")), largest).alias("terms"))
    return words.select(key, F.explode("terms").alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def vocabulary(counts: DataFrame, max_features: int = MAX_FEATURES, min_df: int = 1) -> DataFrame:
    """(term, df, rank): the terms of highest collection frequency, ties by term; at most ``max_features`` rows.

    ``rank`` counts them from 0, rare before common, ties by term: in one task, as the rows are bounded.
    """
    terms = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")).where(F.col("df") >= min_df)
    top = terms.orderBy(F.desc("cf"), "term").limit(max_features)
    return top.select("term", "df", (F.row_number().over(Window.orderBy("df", "term")) - 1).alias("rank"))


def tfidf(counts: DataFrame, terms: DataFrame, n_docs: DataFrame, key: str = "row_pos") -> DataFrame:
    """(key, term, df, rank, w): tf * (ln((1 + n) / (1 + df)) + 1), not yet scaled to unit length per row.

    ``terms`` has at most the configured number of features and ``n_docs`` one row (n), so both are sent whole.
    """
    idf = F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1
    return counts.join(F.broadcast(terms), "term").crossJoin(F.broadcast(n_docs)).select(key, "term", "df", "rank", (F.col("tf") * idf).alias("w"))
