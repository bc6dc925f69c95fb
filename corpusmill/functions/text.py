"""Column functions for cleaning and measuring text, spelt with explicit Unicode classes.

Java, Python and RE2 disagree on what the short classes for words and spaces cover, so every pattern
names its class: letters, numbers and underscore; and all separators, controls U+001C to U+001F and U+0085.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable, Iterable, Sequence
from functools import reduce

import pandas as pd
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]"
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
NOT_WORD_OR_SPACE = r"[^\p{L}\p{N}_\s\x1c-\x1f\x85\p{Z}]"
URL = r"(?i)\b(?:https?://|www\.)[^\s\x1c-\x1f\x85\p{Z}]+"

Step = Callable[[Column], Column]


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def collapse(c: Column) -> Column:
    """Runs of white space to one space, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def combined_text(title: Column, body: Column) -> Column:
    """Title, a space and body, stripped; a null part is empty."""
    return strip(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(body, F.lit(""))))


def _by_text(change: Callable[[str], str]) -> Step:
    """A vectorised function of strings; made when it is used, as workers import this module without a session."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else change(x))

    return lambda c: F.pandas_udf(run, "string")(c)


def unicode_nfc(c: Column) -> Column:
    return _by_text(lambda x: x if x.isascii() else unicodedata.normalize("NFC", x))(c)


def lowercase(c: Column) -> Column:
    return F.lower(c)


def remove_urls(c: Column) -> Column:
    return F.regexp_replace(c, URL, " ")


def remove_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", " ")


def remove_html(c: Column) -> Column:
    """Tags first, entities after, so an escaped tag survives as text."""
    return _by_text(lambda x: html.unescape(x) if "&" in x else x)(remove_tags(c))


def remove_mentions(c: Column) -> Column:
    return F.regexp_replace(c, f"@{WORD}+", " ")


def remove_hashtags(c: Column) -> Column:
    return F.regexp_replace(c, f"#{WORD}+", " ")


def remove_symbols(c: Column) -> Column:
    return collapse(F.regexp_replace(c, f"{NOT_WORD_OR_SPACE}+", " "))


def tokens(c: Column) -> Column:
    """White-space tokens in order; none for an empty text."""
    return F.filter(F.split(collapse(c), " "), lambda t: t != "")


# Spark's own English stop words, in its order.
ENGLISH_STOPWORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs
themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or
because as until while of at by for with about against between into through during before after above below to from up down in out on off over under
again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t
can will just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've
we've you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't couldn't
cannot could here's how's let's ought that's there's what's when's where's who's why's would
""".split()


def default_stopwords(language: str = "english") -> list[str]:
    """Spark's own list; pass another where a different one is wanted."""
    return ENGLISH_STOPWORDS if language == "english" else StopWordsRemover.loadDefaultStopWords(language)


def remove_stopwords(c: Column, stopwords: Iterable[str] | None = None) -> Column:
    """Drops stop words; order and repeats of the others stay."""
    stop = F.array(*[F.lit(w) for w in sorted(set(default_stopwords() if stopwords is None else stopwords))])
    return F.array_join(F.filter(tokens(c), lambda t: ~F.array_contains(stop, t)), " ")


# Noun endings and what replaces them, in the order they are tried.
NOUN_ENDINGS = [("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y"), ("s", "")]


def lemma_of(word: str, lemmas: frozenset[str]) -> str:
    """The shortest listed form among the word itself and those that detaching an ending gives; without any, the word."""
    forms = [word, *(word[: -len(end)] + new for end, new in NOUN_ENDINGS if word.endswith(end) and word != "s")]
    return min((f for f in forms if f in lemmas), key=len, default=word)


def by_word(change: Callable[[str], str]) -> Step:
    """A step that changes each word of white-space tokens by itself."""
    return _by_text(lambda x: " ".join(change(w) for w in x.split()))


def lemmatize(c: Column, lemmas: Iterable[str]) -> Column:
    """Noun lemmas by rule, accepted only if ``lemmas`` lists the result; an empty list raises, as nothing would change."""
    known = frozenset(lemmas)
    if not known:
        raise ValueError("noun lemmas need a list of accepted forms")
    return by_word(lambda w: lemma_of(w, known))(c)


def identity(c: Column) -> Column:
    """Marks that a model's own tokenizer takes over."""
    return c


STEPS: dict[str, Step] = {
    "unicode_nfc": unicode_nfc,
    "lowercase": lowercase,
    "remove_urls": remove_urls,
    "remove_html": remove_html,
    "remove_mentions": remove_mentions,
    "remove_hashtags": remove_hashtags,
    "remove_symbols": remove_symbols,
    "stopword_removal": remove_stopwords,
    "model_native_subword_tokenization": identity,
}
#: A step that needs a list or a corpus: see ``with_lemmas`` and ``clean.preprocess``.
LEMMAS = "noun_lemmatization"


def with_lemmas(lemmas: Iterable[str], steps: dict[str, Step] | None = None) -> dict[str, Step]:
    """The registry of all ten steps, with nouns reduced to what ``lemmas`` lists."""
    listed = list(lemmas)
    return {**(STEPS if steps is None else steps), LEMMAS: lambda c: lemmatize(c, listed)}


CLASSICAL = ["unicode_nfc", "lowercase", "remove_urls", "remove_html", "remove_mentions", "remove_hashtags", "remove_symbols", "stopword_removal", "noun_lemmatization"]
NEURAL = ["unicode_nfc", "remove_urls", "remove_html", "model_native_subword_tokenization"]
CLASSICAL_ONLY = {"stopword_removal", "noun_lemmatization"}


def apply_steps(c: Column, names: Sequence[str], steps: dict[str, Step] | None = None) -> Column:
    """The named steps in order, then white space collapsed; null becomes empty; an unknown name raises."""
    steps = STEPS if steps is None else steps
    if unknown := [n for n in names if n not in steps]:
        raise KeyError(f"unknown cleaning steps: {unknown}")
    return collapse(reduce(lambda text, n: steps[n](text), names, F.coalesce(c, F.lit(""))))


def clean_classical(c: Column, lemmas: Iterable[str]) -> Column:
    """The classical track with a list of accepted noun forms; ``clean.preprocess`` learns them from the corpus instead."""
    return apply_steps(c, CLASSICAL, with_lemmas(lemmas))


def clean_neural(c: Column) -> Column:
    return apply_steps(c, NEURAL)


def char_length(c: Column) -> Column:
    """Code points."""
    return F.length(c)


def word_count(c: Column) -> Column:
    return F.size(tokens(c))


def sanitize_id(c: Column) -> Column:
    """Anything but letters, digits, dot, underscore and hyphen becomes one hyphen; none at the ends."""
    return F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9._-]+", "-"), "^-+|-+$", "")


def sanitize(text: str) -> str:
    return re.sub("[^A-Za-z0-9._-]+", "-", text).strip("-")


def label_token(c: Column) -> Column:
    """Normal form of a raw label: lower case, stripped, ``_`` and space to ``-``; empty, nan, none and null are null.

    A number without a fraction reads as an integer, so 1, 1.0 and '1.0' are one token.
    """
    text = F.lower(strip(c.cast("string")))
    text = F.when(text.rlike(r"^[+-]?[0-9]+\.0*$"), F.regexp_replace(text, r"\.0*$", "")).otherwise(text)
    text = F.regexp_replace(text, "[_ ]", "-")
    return F.when(~text.isin("", "nan", "none", "null"), text)


def parse_timestamp(c: Column) -> Column:
    """UTC timestamps; what cannot be parsed is null."""
    return F.try_to_timestamp(c.cast("string"))


def slug_parts(c: Column) -> Column:
    """owner and name of ``owner/name``."""
    parts = F.split(c, "/")
    return F.struct(F.element_at(parts, 1).alias("owner"), F.element_at(parts, -1).alias("name"))


def run_id(experiment: Column, model: Column, seed: Column, at: Column) -> Column:
    """Stamp, experiment, model and seed as one identifier."""
    return sanitize_id(F.concat_ws("_", F.date_format(at, "yyyyMMdd'T'HHmmss"), experiment, model, F.concat(F.lit("s"), seed.cast("string"))))
