"""Registered queries of encoders and attacks on the labelled documents; training cannot be written in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.functions.lineage import cut, scratch
from corpusmill.operators import attacks, encoder, finetune, metrics, ml, splits
from corpusmill.plans import experiment
from corpusmill.plans.inputs import with_label
from corpusmill.plans.registered import query
from corpusmill.plans.registry import STRATIFIED_SQL
from corpusmill.schema import SequenceParams

PARAMS = SequenceParams(window_tokens=64, stride_tokens=48)
SEED = 13


def subwords():
    """Ids of a public tokenizer; its file's path is all that this needs."""
    import public_tokenizers

    return finetune.subword_ids(public_tokenizers.path("word_bpe_49k.json"))


def bundle(spark: SparkSession, d: str, clean: bool = True) -> DataFrame:
    """(row_pos, part, text, label): labelled documents of the neural track in a stratified split."""
    rows = with_label(spark, d)
    text: Column = T.clean_neural(F.col("text")) if clean else F.col("text")
    parts = splits.stratified(rows, SEED, "row_pos").select("row_pos", "part")
    return cut(rows.select("row_pos", "label", text.alias("text")).join(parts, "row_pos").select("row_pos", "part", "text", "label"))


@query()
def model_encoder_head(spark, d):
    """Test documents under a linear head over fixed embeddings, averaged over windows of all their words."""
    rows = bundle(spark, d).withColumnRenamed("row_pos", "doc_idx")
    of = lambda p: encoder.encode(rows.where(F.col("part") == p).drop("part"), encoder.averaged_embedding(), PARAMS)
    head, _ = encoder.train(of("train"), of("val"))
    return encoder.predict(of("test"), head).join(rows.select("doc_idx", F.col("label").alias("y_true")), "doc_idx").select(F.col("doc_idx").alias("row_pos"), "y_true", "y_pred", "y_prob")


@query()
def model_encoder_trained(spark, d):
    """Test documents under an encoder whose own weights were trained on all windows of the training documents."""
    folder = f"{scratch(spark)}/encoder-{uuid.uuid4().hex}"
    _, predicted = experiment.run_encoder_cell(bundle(spark, d), "ENC", SEED, folder, subwords(), PARAMS)
    return predicted.select("row_pos", "y_true", "y_pred", "y_prob")


# --- attacks on a linear model (K6) -------------------------------------------------------------------------


def attacked_tests(spark: SparkSession, d: str) -> DataFrame:
    """(row_pos, y_true, clean_pred, attacked_pred, similarity, n_edits): test documents as they are and attacked.

    The model is logistic regression on TF-IDF with the best C of its grid; both predictions are the model's own.
    """
    rows = bundle(spark, d)
    train = rows.where("part = 'train'")
    features = ml.fit_tfidf(train)
    vectors = cut(ml.vectorize(features, rows).select("row_pos", "part", "label", "features"))
    part = lambda p: vectors.where(F.col("part") == p).select("row_pos", "label", "features")
    model, _ = ml.train_classical(part("train"), part("val"), "LR", SEED)
    victim = attacks.prepared(attacks.Victim.of(features, model), train.select("text"))
    test = rows.where("part = 'test'")
    out = cut(attacks.attacked(test.select("row_pos", "text"), victim))
    again = ml.vectorize(features, out.join(test.select("row_pos", "label"), "row_pos").select("row_pos", "label", F.col("attacked").alias("text")))
    after = ml.predict(model, again).select("row_pos", F.col("y_pred").alias("attacked_pred"))
    before = ml.predict(model, part("test")).select("row_pos", F.col("label").alias("y_true"), F.col("y_pred").alias("clean_pred"))
    return before.join(after, "row_pos").join(out.select("row_pos", "similarity", "n_edits"), "row_pos")


@query(f"{STRATIFIED_SQL} SELECT row_pos, true AS similar FROM split WHERE part = 'test'")
def attack_similarity(spark, d):
    """Every test document, and that its attacked version is as similar as is asked."""
    return attacked_tests(spark, d).select("row_pos", (F.col("similarity") >= attacks.MIN_SIMILARITY).alias("similar"))


@query()
def attack_robustness(spark, d):
    """Accuracy before and under attack, success rate, and similarity of the successes."""
    rows = attacked_tests(spark, d).withColumn("model_id", F.lit("LR"))
    return metrics.robustness_metrics(rows, ["model_id"])


# --- estimators on the documents themselves (M1-M6, G3) -------------------------------------------------------


def tested(spark: SparkSession, d: str, model_id: str) -> DataFrame:
    """Predictions of the test documents by the best model of the estimator's whole grid, chosen on the validation part."""
    rows = bundle(spark, d)
    vectors = cut(ml.vectorize(ml.fit_tfidf(rows.where("part = 'train'")), rows).select("row_pos", "part", "label", "features"))
    part = lambda p: vectors.where(F.col("part") == p).select("row_pos", "label", "features")
    fitted, _ = ml.train_classical(part("train"), part("val"), model_id, SEED)
    return ml.predict(fitted, part("test")).withColumnRenamed("label", "y_true")


@query()
def model_boosting_documents(spark, d):
    """Leaf-wise histogram boosting on TF-IDF, 200 and 500 rounds, 31 and 63 leaves, rates 0.05 and 0.1."""
    return tested(spark, d, "HGB")


@query()
def model_logistic_documents(spark, d):
    """Logistic regression on TF-IDF, every C of the grid."""
    return tested(spark, d, "LR")


@query()
def model_svm_documents(spark, d):
    """Linear SVM on TF-IDF, every C of the grid, with probabilities from margins out of three folds."""
    return tested(spark, d, "SVM")


@query()
def model_forest_documents(spark, d):
    """Random forests on TF-IDF, 200 and 500 trees of depth 30."""
    return tested(spark, d, "RF")
