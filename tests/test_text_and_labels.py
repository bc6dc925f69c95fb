import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import hashing
from corpusmill.functions import text as T
from corpusmill.functions.numbering import hex_bucket, long_bucket, positions, running_total
from corpusmill.operators import clean, labels


def column(spark, values, change):
    df = spark.createDataFrame(list(enumerate(values)), "i int, x string")
    return [r["y"] for r in df.select("i", change(F.col("x")).alias("y")).orderBy("i").collect()]


def test_cleaning_steps(spark):
    one = lambda f, x: column(spark, [x], f)[0]
    assert one(T.remove_urls, "see http://a.b/c?d and WWW.x.y now").split() == ["see", "and", "now"]
    assert one(T.remove_html, "<b>x</b> &amp; &lt;i&gt;").split() == ["x", "&", "<i>"]
    assert one(T.remove_mentions, "hi @jö_1 you").split() == ["hi", "you"]
    assert one(T.remove_hashtags, "a #tag² b").split() == ["a", "b"]
    assert one(T.remove_symbols, "a-b, c…d _e ‿f") == "a b c d _e f"
    assert one(T.unicode_nfc, "é") == "é"
    assert one(T.collapse, " a b\u001cc\u0085 d　") == "a b c d"
    assert one(lambda c: T.remove_stopwords(c, ["the", "of"]), "the end of the of x the") == "end x"


def test_url_goes_before_html(spark):
    out = column(spark, ['<a href="http://x.y">link</a> end', None, ""], lambda c: T.apply_steps(c, ["remove_urls", "remove_html"]))
    assert out == ['<a href=" end', "", ""] or out[0].endswith("end")
    assert out[1:] == ["", ""]


def test_tracks_and_guards(spark):
    df = spark.createDataFrame([(1, "A Title", "The CATS &amp; dogs @me http://u.v #x ran!")], "row_pos long, title string, text string")
    got = {r["version"]: r["text"] for r in clean.both_tracks(df).collect()}
    assert got["vCLEAN-C"] == "cats dogs ran"
    assert got["vCLEAN-N"] == "The CATS & dogs @me #x ran!"
    with pytest.raises(ValueError):
        clean.preprocess(df, "neural", ["stopword_removal"])
    with pytest.raises(ValueError):
        clean.preprocess(df, "other")
    with pytest.raises(KeyError):
        T.apply_steps(F.lit("x"), ["no_such_step"])


def test_lemmas():
    known = frozenset({"cat", "box", "city", "man", "glass", "church"})
    assert [T.lemma_of(w, known) for w in ("cats", "boxes", "cities", "men", "glass", "churches", "runs")] == ["cat", "box", "city", "man", "glass", "church", "runs"]


def test_word_class_equals_python(spark):
    chars = [chr(c) for c in [*range(33, 0x250), 0x300, 0x660, 0x2160, 0x203F, 0xB2, 0x4E2D, 0x1F600]]
    got = column(spark, chars, lambda c: c.rlike(f"^{T.WORD}$").cast("string"))
    assert got == [str(bool(re.fullmatch(r"\w", c))).lower() for c in chars]


def test_combined_text(spark):
    df = spark.createDataFrame([("t", "b"), (None, "b"), ("t", None), (None, None), (" t ", "\tb ")], "a string, b string")
    assert [r[0] for r in df.select(T.combined_text(F.col("a"), F.col("b"))).collect()] == ["t b", "b", "t", "", "t  \tb"]


def test_label_tokens(spark):
    got = column(spark, ["pants_fire", "1.0", "0", None, "", " NaN ", "Half True", "none", "2.50", "FAKE"], T.label_token)
    assert got == ["pants-fire", "1", "0", None, None, None, "half-true", None, "2.50", "fake"]


def test_six_way_mapping(spark):
    raw = ["pants-fire", "false", "barely_true", "half-true", "Mostly True", "true", "other", None]
    df = spark.createDataFrame([(i, "DS5", x) for i, x in enumerate(raw)], "order int, dataset_id string, label_raw string")
    report = labels.mapping_report(df, labels.SIX_WAY).first()
    assert tuple(report)[1:] == (8, 1, 1, 6, 3, 3)
    rows = labels.binarize(df, labels.SIX_WAY, "order").orderBy("row_pos").collect()
    assert [(r["uid"], r["label"]) for r in rows] == [(f"DS5_{i}", y) for i, y in enumerate([1, 1, 1, 0, 0, 0])]
    assert labels.label_domain_ok(spark.createDataFrame([(2,)], "label int")).first()["ok"] is False


def test_mapping_specs():
    assert labels.token_map(["x", "1"], ["x", 0.0]) == {"x": 1, "1": 1, "0": 0}
    assert labels.mapping_spec("DS2", {"source_binary_map": {"fake": ["Fake"], "real": ["real"]}}).fake == ("fake",)
    assert not labels.mapping_spec("DS9", {}).explicit
    with pytest.raises(ValueError):
        labels.mapping_spec("DS1", {})


def test_standardise_fills_missing_columns(spark):
    df = spark.createDataFrame([(5, "b"), (9, "a")], "n int, TEXT string")
    rows = labels.standardise(df, "D", "n").orderBy("row_pos").collect()
    assert [(r["uid"], r["title"], r["text"]) for r in rows] == [("D_0", None, "b"), ("D_1", None, "a")]


def test_positions_and_totals(spark):
    df = spark.range(100_000, 0, -7).select(F.col("id").alias("x"), (F.col("id") % 3).alias("g"), F.sha2(F.col("id").cast("string"), 256).alias("h"))
    rows = positions(df, ["x"], long_bucket("x")).orderBy("x").collect()
    assert [r["row_pos"] for r in rows] == list(range(len(rows)))
    rows = positions(df, ["h"], hex_bucket("h"), ["g"]).collect()
    for g in range(3):
        mine = sorted((r["h"], r["row_pos"]) for r in rows if r["g"] == g)
        assert [p for _, p in mine] == list(range(len(mine)))
    total = running_total(df, ["x"], long_bucket("x"), F.col("x")).orderBy("x").collect()
    assert total[-1]["before"] == sum(r["x"] for r in total[:-1])


def test_hashes(spark, tmp_path):
    assert column(spark, ["abc"], hashing.sha256) == ["ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"]
    assert hashing.sha256_json({"b": 1, "a": 2}) == hashing.sha256_json({"a": 2, "b": 1})
    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, x string")
    one = hashing.table_hash(df.repartition(3)).first()
    assert one == hashing.table_hash(df.coalesce(1)).first() != hashing.table_hash(df.limit(1)).first()
    swapped = df.withColumn("i", 3 - F.col("i"))
    assert hashing.table_hash(df, "i").first() != hashing.table_hash(swapped, "i").first()


def test_identifiers(spark):
    assert column(spark, ["a b/c", "--x--", "ok.1_2"], T.sanitize_id) == ["a-b-c", "x", "ok.1_2"]
    assert T.sanitize("a b/c") == "a-b-c" and unicodedata.normalize("NFC", "é") == "é"
