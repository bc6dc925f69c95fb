"""The two cleaning tracks over whole tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import morphology
from corpusmill.functions import text as T
from corpusmill.functions.lineage import cut

TRACKS = {"classical": ("vCLEAN-C", T.CLASSICAL), "neural": ("vCLEAN-N", T.NEURAL)}


def clean_columns(df: DataFrame, steps: Sequence[str], columns: Sequence[str] = ("title", "text"), registry: dict | None = None) -> DataFrame:
    """The cleaning steps on each of ``columns`` that ``df`` has."""
    have = [c for c in columns if c in df.columns]
    return df.withColumns({c: T.apply_steps(F.col(c), steps, registry) for c in have})


def _english(language: str) -> Column:
    return F.coalesce(F.lower(F.col(language).cast("string")) == "en", F.lit(True))


def corpus_lemmas(df: DataFrame, columns: Sequence[str] = ("title", "text"), language: str | None = None) -> DataFrame:
    """(word, lemma, gain): noun forms of the columns' words and what they are forms of; see ``morphology.noun_lemmas``.

    Where a ``language`` column is named, only rows of it that say *en*, or nothing, are looked at. Runs actions.
    """
    before = [n for n in T.CLASSICAL if n not in T.CLASSICAL_ONLY]
    rows = df if language is None else df.where(_english(language))
    texts = F.array(*[T.apply_steps(F.col(c), before) for c in columns if c in df.columns])
    return cut(morphology.noun_lemmas(rows.select(F.explode(texts).alias("text"))))


def preprocess(df: DataFrame, track: str, steps: Sequence[str] | None = None, registry: dict | None = None, lemmas: Sequence[str] | None = None, language: str | None = None) -> DataFrame:
    """``df`` cleaned for a track; the neural one may neither drop stop words nor lemmatise.

    Nouns are reduced to what ``lemmas`` lists, by default to what the corpus itself shows to be their other forms
    (``corpus_lemmas``, which runs actions). English rules apply to rows that ``language`` names as such, without it
    to all.
    """
    if track not in TRACKS:
        raise ValueError(f"unknown track {track!r}")
    steps = TRACKS[track][1] if steps is None else list(steps)
    if track == "neural" and (wrong := T.CLASSICAL_ONLY & set(steps)):
        raise ValueError(f"not for the neural track: {sorted(wrong)}")
    if T.LEMMAS in steps and T.LEMMAS not in (registry or {}):
        change = T.with_lemmas(lemmas)[T.LEMMAS] if lemmas else morphology.lemmatizer(corpus_lemmas(df, language=language))
        own = change if language is None else lambda c: F.when(_english(language), change(c)).otherwise(c)
        registry = {**(T.STEPS if registry is None else registry), T.LEMMAS: own}
    return clean_columns(df, steps, registry=registry).withColumn("version", F.lit(TRACKS[track][0]))


def both_tracks(df: DataFrame, lemmas: Sequence[str] | None = None, language: str | None = None) -> DataFrame:
    """Classical and neural versions of every row, told apart by version; ``lemmas`` and ``language`` as in ``preprocess``."""
    return preprocess(df, "classical", lemmas=lemmas, language=language).unionByName(preprocess(df, "neural"))


def resource_fingerprints(spark: SparkSession, stopwords: Sequence[str] | None = None, lemmas: Sequence[str] = ()) -> DataFrame:
    """(resource, n_words, sha256) of the word lists in use."""
    rows = [("stopwords", w) for w in sorted(set(T.default_stopwords() if stopwords is None else stopwords))] + [("lemmas", w) for w in sorted(set(lemmas))]
    words = spark.createDataFrame(rows, "resource string, word string")
    return words.groupBy("resource").agg(F.count(F.lit(1)).alias("n_words"), F.sha2(F.array_join(F.array_sort(F.collect_list("word")), "\n"), 256).alias("sha256"))
