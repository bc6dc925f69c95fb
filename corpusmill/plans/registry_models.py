"""Registered queries of models, selection and lineage: features against SQL, estimators on classes that words tell apart."""

from __future__ import annotations

import json

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import hashing
from corpusmill.functions.numbering import long_bucket, positions
from corpusmill.operators import clean, dedup, encoder, inference, metrics, ml, profile, results, splits, training
from corpusmill.plans import experiment
from corpusmill.plans.inputs import PREDICTIONS_SQL, labelled, predictions, table
from corpusmill.plans.registered import query, sql_collapse, sql_tags, sql_unescape, sql_urls
from corpusmill.plans.registry import BODY_SQL, LABELLED_SQL, STRATIFIED_SQL
from corpusmill.schema import SequenceParams

# --- features (I2, D12) ---------------------------------------------------------------------------
SEGMENTS_SQL = "SELECT c_custkey AS row_pos, lower(c_mktsegment) || ' no ' || (c_custkey % 7) || 'x' AS text, (c_mktsegment IN ('BUILDING', 'MACHINERY'))::INTEGER AS label FROM customer"


def segments(spark: SparkSession, d: str) -> DataFrame:
    """(row_pos, text, label): a few words for each customer, of which the first decides the class."""
    text = F.concat(F.lower("c_mktsegment"), F.lit(" no "), (F.col("c_custkey") % 7).cast("string"), F.lit("x"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("row_pos"), text.alias("text"), F.col("c_mktsegment").isin("BUILDING", "MACHINERY").cast("int").alias("label"))


@query(f"""WITH r AS ({SEGMENTS_SQL}), w AS (SELECT row_pos, regexp_extract_all(text, '[a-z0-9]{{2,}}') AS ws, row_pos % 2 = 0 AS train FROM r),
t AS (SELECT row_pos, train, unnest(ws || list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS term FROM w),
c AS (SELECT row_pos, train, term, count(*) AS tf FROM t GROUP BY ALL), v AS (SELECT term, count(*) AS df FROM c WHERE train GROUP BY term HAVING count(*) >= 5),
x AS (SELECT row_pos, term, tf * (ln((1.0 + (SELECT count(*) FROM w WHERE train)) / (1 + df)) + 1) AS x FROM c JOIN v USING (term))
SELECT row_pos, count(*) AS n, round(max(x) / sqrt(sum(x * x)), 9) AS largest, round(sum(x) / sqrt(sum(x * x)), 9) AS total FROM x GROUP BY row_pos""")
def model_features(spark, d):
    """TF-IDF vectors of a vectoriser that has seen even rows only."""
    rows = segments(spark, d)
    vectors = ml.vectorize(ml.fit_tfidf(rows.where("row_pos % 2 = 0")), rows).select("row_pos", vector_to_array("features").alias("x"))
    real = F.filter("x", lambda v: v > 0)
    return vectors.select("row_pos", F.size(real).cast("long").alias("n"), F.round(F.array_max("x"), 9).alias("largest"), F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + v), 9).alias("total"))


@query("""WITH s AS (SELECT DISTINCT source AS a FROM documents WHERE source IS NOT NULL), l AS (SELECT DISTINCT lang AS b FROM documents WHERE lang IS NOT NULL)
SELECT row_number() OVER (ORDER BY a, b) - 1 AS place, a, b FROM s, l""")
def model_grid(spark, d):
    """Every combination of what two columns hold, the last key changing fastest."""
    docs = table(spark, d, "documents")
    seen = lambda c: sorted(r[0] for r in docs.where(F.col(c).isNotNull()).select(c).distinct().collect())  # noqa: E731  a few sources and languages
    rows = ml.expand_grid({"a": seen("source"), "b": seen("lang")})
    return spark.createDataFrame([(k, r["a"], r["b"]) for k, r in enumerate(rows)], "place long, a string, b string")


# --- estimators and grid search (M1-M6, G3, K2) ---------------------------------------------------
GRIDS = {"LR": {"C": [1.0, 10.0]}, "SVM": {"C": [1.0], "maxIter": [20]}, "RF": {"numTrees": [5, 9], "maxDepth": [8]}, "GBT": {"maxIter": [3], "maxDepth": [3, 4]}}
RIGHT_SQL = f"SELECT row_pos, label AS y_true, label AS y_pred, true AS sure FROM ({SEGMENTS_SQL}) WHERE row_pos % 5 = 4"


def fitted(spark: SparkSession, d: str, model_id: str) -> tuple[object, ml.ClassicalResult, DataFrame]:
    rows = segments(spark, d)
    train = rows.where("row_pos % 5 < 3")
    vectors = ml.vectorize(ml.fit_tfidf(train), rows).select("row_pos", "label", "features")
    model, outcome = ml.train_classical(vectors.where("row_pos % 5 < 3"), vectors.where("row_pos % 5 = 3"), model_id, 13, GRIDS[model_id])
    return model, outcome, vectors.where("row_pos % 5 = 4")


def right(spark: SparkSession, d: str, model_id: str) -> DataFrame:
    """Predictions of rows that were not seen, and whether the probability is on the side of the class."""
    model, _, test = fitted(spark, d, model_id)
    out = ml.predict(model, test)
    return out.select("row_pos", F.col("label").alias("y_true"), "y_pred", ((F.col("y_prob") >= 0.5) == (F.col("label") == 1)).alias("sure"))


@query(RIGHT_SQL)
def model_logistic(spark, d):
    return right(spark, d, "LR")


@query(RIGHT_SQL)
def model_svm(spark, d):
    return right(spark, d, "SVM")


@query(RIGHT_SQL)
def model_forest(spark, d):
    return right(spark, d, "RF")


@query(RIGHT_SQL)
def model_boosting(spark, d):
    return right(spark, d, "GBT")


@query(f"SELECT row_pos AS doc_idx, 1 AS n_windows, label AS y_pred FROM ({SEGMENTS_SQL}) WHERE row_pos % 5 = 4")
def model_encoder(spark, d):
    """A head over averaged embeddings of token windows, trained with early stopping on validation documents."""
    docs = segments(spark, d).withColumnRenamed("row_pos", "doc_idx")
    params = SequenceParams(window_tokens=16, stride_tokens=8)
    features = encoder.encode(docs, encoder.averaged_embedding(), params)
    head, _ = encoder.train(features.where("doc_idx % 5 < 3"), features.where("doc_idx % 5 = 3"), encoder.HeadSettings(epochs=4, batches=2))
    return encoder.predict(features.where("doc_idx % 5 = 4"), head).select("doc_idx", F.col("n_windows").cast("int").alias("n_windows"), "y_pred")


@query("SELECT 'LR' AS model_id, '{\"C\": 1.0}' AS best, 1.0::DOUBLE AS val_macro_f1, 2::BIGINT AS trials")
def model_grid_search(spark, d):
    """Of combinations that are equally good the first is kept."""
    _, outcome, _ = fitted(spark, d, "LR")
    return spark.createDataFrame([(outcome.model_id, json.dumps(outcome.best_params), outcome.val_macro_f1, len(outcome.trials))], "model_id string, best string, val_macro_f1 double, trials long")


@query(f"SELECT model_id, round(avg(y_prob), 9) AS mean_prob, model_id <> 'M2' AS probabilistic FROM ({PREDICTIONS_SQL}) GROUP BY model_id")
def model_probabilities(spark, d):
    """P(fake) out of pairs of probabilities, and which models have any."""
    p = predictions(spark, d).withColumn("pair", F.array(1 - F.col("y_prob"), F.col("y_prob")))
    named = F.when(F.col("model_id") == "M2", "llm_zero_shot").otherwise(F.col("model_id"))
    return p.groupBy("model_id").agg(F.round(F.avg(metrics.prob_positive(F.col("pair"), True)), 9).alias("mean_prob"), F.bool_and(metrics.ece_eligible(named)).alias("probabilistic"))


# --- lineage (D3, D4, B12, B13, J4, J5) --------------------------------------------------------------
KEPT_SQL = f"""SELECT *, row_number() OVER (ORDER BY pre_dedup_index) - 1 AS row_pos FROM (SELECT row_pos AS pre_dedup_index, text, label FROM ({LABELLED_SQL}) QUALIFY row_number() OVER (PARTITION BY sha256({BODY_SQL}) ORDER BY row_pos) = 1)"""
KEPT_SPLIT_SQL = STRATIFIED_SQL.replace(f"({LABELLED_SQL})", f"({KEPT_SQL})")


def kept_rows(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents without exact duplicates, renumbered, each with its place before."""
    df = labelled(spark, d).where(F.col("label_raw").isNotNull()).withColumn("label", (1 - F.col("label_raw").cast("int")).cast("int"))
    keep = dedup.exact_keep(dedup.with_text(df)).where("keep").select("row_pos")
    kept = df.join(keep, "row_pos", "left_semi").withColumnRenamed("row_pos", "pre_dedup_index")
    return positions(kept, ["pre_dedup_index"], long_bucket("pre_dedup_index"))


@query(f"""{KEPT_SPLIT_SQL}, z AS ({KEPT_SQL})
SELECT row_pos, part, sha256({sql_collapse(sql_unescape(sql_tags(sql_urls("nfc_normalize(text)"))))}) AS sha, label FROM z JOIN split USING (row_pos)""")
def lineage_bundle(spark, d):
    """A split of the deduplicated rows with the neural track's texts, found by their places before."""
    kept = kept_rows(spark, d)
    neural = clean.preprocess(labelled(spark, d).select("row_pos", "text"), "neural")
    parts = splits.stratified(kept, 13, "row_pos")
    out = experiment.split_bundle(kept, neural, parts)
    return out.select("row_pos", "part", hashing.sha256(F.col("text")).alias("sha"), "label")


@query(f"""{KEPT_SPLIT_SQL}, z AS ({KEPT_SQL}) SELECT part, count(*) AS n, count_if(label = 1)::BIGINT AS n_fake, sum(pre_dedup_index)::BIGINT AS ids FROM z JOIN split USING (row_pos) GROUP BY part""")
def lineage_parts(spark, d):
    """Parts of a split as rows of the version before dedup."""
    kept = kept_rows(spark, d)
    rows = splits.stratified(kept, 13, "row_pos").join(kept.select("row_pos", "pre_dedup_index", "label"), "row_pos")
    return rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("n_fake"), F.sum("pre_dedup_index").alias("ids"))


@query("""SELECT 'none' AS part, 0::BIGINT AS n, 0::BIGINT AS n_fake, 0::BIGINT AS n_real, NULL::DOUBLE AS fake_ratio, NULL::DOUBLE AS mean_chars, NULL::DOUBLE AS median_chars,
  NULL::DOUBLE AS mean_words, NULL::DOUBLE AS median_words""")
def profile_empty_part(spark, d):
    """A part that no document is in: no counts, no statistics."""
    df = labelled(spark, d).where("length(lang) > 10").withColumn("label", F.lit(None).cast("int"))
    return profile.profile(df, []).withColumn("part", F.lit("none"))


@query("""SELECT * FROM (VALUES ('documents', 'S-RAND', true), ('documents', 'S-SRC', true), ('documents', 'S-TEMP', false), ('events', 'S-RAND', true), ('events', 'S-SRC', false), ('events', 'S-TEMP', true)) v(name, regime, applicable)""")
def split_applicability(spark, d):
    """Which regimes the columns of a table allow."""
    rows = []
    docs = labelled(spark, d)
    events = table(spark, d, "events").withColumnRenamed("ts", "Timestamp")
    for name, df, entry in (("documents", docs, {"source_field_available": True}), ("events", events, {})):
        rows += [(name, a["regime"], bool(a["applicable"])) for a in splits.applicability(name, df, entry)]
    return spark.createDataFrame(rows, "name string, regime string, applicable boolean")


# --- claims and completeness (L6, L7, H3, M7, N8) -----------------------------------------------------
@query("""WITH p AS (SELECT n_name AS comparison, CASE WHEN n_nationkey % 6 = 5 THEN NULL ELSE n_regionkey / 10.0::DOUBLE END AS diff, ((n_nationkey * 37 + 11) % 101) / 2000.0::DOUBLE AS p_value, CASE WHEN n_nationkey % 7 = 3 THEN NULL ELSE 0.5::DOUBLE END AS effect FROM nation),
r AS (SELECT *, p_value * count(*) OVER () / row_number() OVER (ORDER BY p_value) AS raw FROM p), a AS (SELECT *, least(1.0, min(raw) OVER (ORDER BY p_value DESC ROWS UNBOUNDED PRECEDING)) AS adj FROM r)
SELECT comparison, round(adj, 9) AS p_adjusted, diff IS NOT NULL AND effect IS NOT NULL AND adj < 0.05 AS claim_allowed FROM a""")
def inference_claims(spark, d):
    """A family of comparisons, some without a difference or an effect."""
    n = F.col("n_nationkey")
    family = table(spark, d, "nation").select(
        F.col("n_name").alias("comparison"), F.when(n % 6 != 5, F.col("n_regionkey") / 10.0).alias("diff"), (((n * 37 + 11) % 101) / 2000.0).alias("p_value"), F.when(n % 7 != 3, 0.5).alias("effect"))
    return inference.confirmatory(family).select("comparison", F.round("p_adjusted", 9).alias("p_adjusted"), "claim_allowed")


@query("SELECT true AS whole, false AS more")
def results_complete(spark, d):
    """All cells of the sweep are there, and not all of a larger one."""
    p = predictions(spark, d)
    whole = results.is_complete(results.sweep_cells(spark, ["M1", "M2"], list(range(5))), p)
    more = results.is_complete(results.sweep_cells(spark, ["M1", "M2", "M3"], list(range(5))), p)
    return spark.createDataFrame([(whole, more)], "whole boolean, more boolean")


@query("""SELECT p_partkey, lower(p_type) LIKE '%brushed%' AND p_size % 2 = 1 AS refused FROM part""")
def training_guard(spark, d):
    """Settings made of parts, one of whose words names oversampling: refused where it is named and set."""
    rows = []
    for r in table(spark, d, "part").select("p_partkey", "p_type", "p_size").toLocalIterator():
        setting = r["p_type"].lower().replace("brushed", "use_smote").replace(" ", "_")
        try:
            training.assert_no_smote({setting: r["p_size"] % 2})
            rows.append((r["p_partkey"], False))
        except ValueError:
            rows.append((r["p_partkey"], True))
    return spark.createDataFrame(rows, "p_partkey long, refused boolean")
