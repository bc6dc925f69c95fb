"""Noun lemmas from a list, and learnt from how words are used in a corpus."""

import random

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import morphology
from corpusmill.functions import text as T
from corpusmill.operators import clean
from corpusmill.plans.experiment import PipelineConfig


def test_a_supplied_list_reaches_the_classical_track(spark):
    df = spark.createDataFrame([(0, "Cats chase boxes")], "row_pos long, text string")
    config = PipelineConfig.load({"lemmas": ["cat", "box"]})
    got = {r["version"]: r["text"] for r in clean.both_tracks(df, config.lemmas).collect()}
    assert got == {"vCLEAN-C": "cat chase box", "vCLEAN-N": "Cats chase boxes"}
    assert clean.preprocess(df, "classical").first()["text"] == "cats chase boxes"  # the corpus shows nothing of them
    assert df.select(T.clean_classical(F.col("text"), ["cat"])).first()[0] == "cat chase boxes"
    assert set(T.with_lemmas(["cat"])) == {*T.STEPS, T.LEMMAS} and len(T.with_lemmas(["cat"])) == 10
    with pytest.raises(ValueError):
        T.lemmatize(df["text"], ())


def plural(noun):
    return noun[:-1] + "ies" if noun.endswith("y") else noun + ("es" if noun.endswith(("ch", "sh", "x", "s")) else "s")


@pytest.fixture(scope="module")
def corpus(spark):
    """Sentences about 450 made-up regular nouns and the irregular ones, and words that only look like plurals."""
    rng = random.Random(1)
    syllable = lambda: rng.choice("bcdfglmnprtv") + rng.choice("aeiou")
    nouns = set()
    while len(nouns) < 450:
        nouns.add(syllable() + "".join(syllable() for _ in range(rng.randint(0, 1))) + rng.choice("bcdfglmnprtv") + rng.choice(["", "", "", "ch", "sh", "x", "y"]))
    known = {n: plural(n) for n in sorted(nouns)} | {b: f for f, b in morphology.IRREGULAR.items()}
    bases, adjectives = list(known), ["big", "new", "old", "red", "small", "late"]
    rows = []
    for _ in range(16_000):
        a, b, adjective = rng.choice(bases), rng.choice(bases), rng.choice(adjectives)
        one, many = [f"the {a}", f"a {a}", f"the {adjective} {a}", f"my {a}"], [f"the {known[a]}", f"many {known[a]}", f"the {adjective} {known[a]}", f"my {known[a]}"]
        subject = rng.choice(one if rng.random() < 0.5 else many)
        thing = rng.choice([f"the {b}", f"a {b}", f"the {known[b]}", f"two {known[b]}"])
        rows.append(f"{subject} {rng.choice(['saw', 'liked', 'moved', 'found', 'held', 'took'])} {rng.choice(['in', 'on', 'near', 'with', 'under'])} {thing}")
    rows += 40 * [
        "the news is late and the news was old", "he will pass by and pass on", "a lens in the lens of it", "this species and that species differ", "a series of the series",
        "the new red thing", "il ne va pas la et pas ici", "len went home and len came", "specie was paid", "serie was seen",
    ]
    return known, spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "row_pos long, text string")


def test_lemmas_follow_the_use_of_words(spark, corpus):
    known, df = corpus
    learnt = clean.corpus_lemmas(df)
    step = morphology.lemmatizer(learnt)
    words = spark.createDataFrame([(f, b) for b, f in known.items()], "form string, base string")
    got = words.select("base", step(F.col("form")).alias("lemma")).collect()
    assert len(got) > 500 and sum(r["base"] == r["lemma"] for r in got) > 0.9 * len(got)
    forms = {f: b for b, f in known.items()}
    assert [r for r in learnt.collect() if forms.get(r["word"]) != r["lemma"]] == []  # and nothing else is changed
    for w in ("news", "pass", "lens", "species", "series", "virus", "basis"):
        assert spark.createDataFrame([(w,)], "w string").select(step(F.col("w"))).first()[0] == w


def test_slices_give_what_one_does(spark, corpus):
    learnt = clean.corpus_lemmas(corpus[1])
    df = corpus[1].limit(300)
    one, many = (df.select("row_pos", morphology.lemmatizer(learnt, n)(F.col("text")).alias("t")) for n in (10**6, 97))
    assert sorted(one.collect()) == sorted(many.collect())


def test_other_languages_are_left_alone(spark, corpus):
    known, df = corpus
    form = next(f for b, f in known.items() if f == b + "s")
    mixed = df.withColumn("lang", F.lit("en")).unionByName(spark.createDataFrame([(-1, form, "es"), (-2, "Women", "es"), (-3, "Women", None), (-4, None, "en")], "row_pos long, text string, lang string"))
    got = {r["row_pos"]: r["text"] for r in clean.preprocess(mixed, "classical", language="lang").where("row_pos < 0").collect()}
    assert got == {-1: form, -2: "women", -3: "woman", -4: ""}
    nothing = df.where("false")
    assert clean.corpus_lemmas(nothing).count() == 0 and clean.preprocess(nothing, "classical").count() == 0
