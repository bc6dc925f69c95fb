"""Classical text models on Spark ML: TF-IDF features, grid search over a given validation part, calibration."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import replace
from itertools import product

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.lineage import cut, scratch
from corpusmill.functions.vectors import ngrams
from corpusmill.operators import boosting, forest, linear
from corpusmill.operators.metrics import core_metrics
from corpusmill.operators.training import assert_no_smote, class_weights
from corpusmill.schema import ClassicalResult

MODELS = ["LR", "SVM", "RF", "GBT", "HGB"]
MAX_FEATURES, MIN_DF = 20_000, 5
PASSES = {"LR": 1000, "SVM": 5000}
# An unlimited depth reads as 30, as Spark would have it; GBT is Spark's, RF and HGB grow on histograms of sparse rows.
GRIDS: dict[str, dict[str, list]] = {
    "LR": {"C": [0.01, 0.1, 1.0, 10.0]},
    "SVM": {"C": [0.01, 0.1, 1.0, 10.0]},
    "RF": {"numTrees": [200, 500], "maxDepth": [30], "minInstancesPerNode": [1, 2]},
    "GBT": {"maxIter": [200, 500], "maxDepth": [5, 6], "stepSize": [0.05, 0.1]},
    "HGB": {"rounds": [200, 500], "leaves": [31, 63], "rate": [0.05, 0.1]},
}


def expand_grid(grid: dict[str, Sequence]) -> list[dict]:
    """Every combination, the last key changing fastest."""
    return [dict(zip(grid, values)) for values in product(*grid.values())]


def fit_tfidf(train: DataFrame, max_features: int = MAX_FEATURES, min_df: int = MIN_DF, text: str = "text") -> PipelineModel:
    """Vectoriser fitted on ``train`` only: 1- and 2-grams, smoothed idf (ln((1+n)/(1+df)) + 1), unit length."""
    terms = train.select(ngrams(F.coalesce(F.col(text), F.lit(""))).alias("terms"))
    counts: CountVectorizerModel = CountVectorizer(inputCol="terms", outputCol="tf", vocabSize=max_features, minDF=min_df).fit(terms)
    n = terms.count()
    index = train.sparkSession.createDataFrame(list(enumerate(counts.vocabulary)), "i int, term string")  # at most max_features rows
    df = terms.select(F.explode(F.array_distinct("terms")).alias("term")).join(F.broadcast(index), "term").groupBy("i").agg(F.count(F.lit(1)).alias("df"))
    idf = [r["idf"] for r in df.select("i", (F.log(F.lit(1.0 + n) / (1 + F.col("df"))) + 1).alias("idf")).orderBy("i").collect()]
    scale = ElementwiseProduct(inputCol="tf", outputCol="weighted", scalingVec=Vectors.dense(idf))
    return PipelineModel([counts, scale, Normalizer(inputCol="weighted", outputCol="features", p=2.0)])


def vectorize(model: PipelineModel, df: DataFrame, text: str = "text") -> DataFrame:
    return model.transform(df.withColumn("terms", ngrams(F.coalesce(F.col(text), F.lit(""))))).drop("terms", "tf", "weighted")


def estimator(model_id: str, params: dict, seed: int):
    if model_id == "GBT":
        return GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", seed=seed, **params)
    raise ValueError(f"unknown model {model_id!r}")


def balanced(df: DataFrame) -> DataFrame:
    weights = class_weights(df).select(F.col("label"), "weight")
    return df.join(F.broadcast(weights), "label")  # a row for each class


def class_weight_of(rows: DataFrame) -> dict[int, float]:
    return {r["label"]: r["weight"] for r in rows.select("label", "weight").distinct().collect()}  # a row for each class


def fit_linear(rows: DataFrame, grid: dict[str, Sequence], model_id: str, folds: int = 3) -> Callable[[dict], linear.Linear]:
    """The linear model of each combination, all fitted in the same passes.

    An SVM gets probabilities from a one-dimensional logistic map of margins out of ``folds`` folds, whose models are
    fitted along.
    """
    cs, passes = list(grid["C"]), max(grid.get("maxIter", [PASSES[model_id]]))
    platt = folds if model_id == "SVM" else 0
    ws, _, _ = linear.fit(rows, "logistic" if model_id == "LR" else "squared hinge", cs, class_weight_of(rows), platt, passes)
    maps = [(1.0, 0.0)] * len(cs)
    if platt:
        held = F.pmod(F.xxhash64("row_pos"), F.lit(folds)).cast("int")
        out = cut(linear.margins(rows, ws, ("row_pos", "label", "weight")))
        for k in range(len(cs)):
            one = out.select("label", "weight", array_to_vector(F.array(F.element_at("margins", len(cs) + k * folds + held + 1))).alias("features"))
            fitted = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight").fit(one)
            maps[k] = (float(fitted.coefficients[0]), float(fitted.intercept))
    return lambda params: linear.Linear(ws[k := cs.index(params["C"])][:-1], float(ws[k][-1]), *maps[k])


def fit_boosted(rows: DataFrame, grid: dict[str, Sequence]) -> Callable[[dict], boosting.Boosted]:
    """The boosted model of each combination: what differs in rounds only is grown once, to the most of them."""
    weights = class_weight_of(rows)
    folder, most, made = f"{scratch(rows.sparkSession)}/boosting-{uuid.uuid4().hex}", max(grid["rounds"]), {}

    def of(params: dict) -> boosting.Boosted:
        other = {k: v for k, v in params.items() if k != "rounds"}
        key = json.dumps(other, sort_keys=True)
        if key not in made:
            made[key] = boosting.fit(rows, weights, f"{folder}/{len(made)}", boosting.Settings(rounds=most, **other))
        return replace(made[key], trees=made[key].trees[: params["rounds"]])

    return of


def fit_forest(rows: DataFrame, grid: dict[str, Sequence], seed: int) -> Callable[[dict], forest.Forest]:
    """The forest of each combination: what differs in the number of trees only is grown once, to the most of them."""
    weights, train = class_weight_of(rows), forest.prepared(rows)
    folder, most, made = f"{scratch(rows.sparkSession)}/forest-{uuid.uuid4().hex}", max(grid["numTrees"]), {}

    def of(params: dict) -> forest.Forest:
        other = {k: v for k, v in params.items() if k != "numTrees"}
        key = json.dumps(other, sort_keys=True)
        if key not in made:
            made[key] = forest.fit(train, weights, f"{folder}/{len(made)}", forest.Settings(numTrees=most, **other), seed)
        return replace(made[key], trees=params["numTrees"])

    return of


def predict(fitted, df: DataFrame, keep: Sequence[str] = ("row_pos", "label")) -> DataFrame:
    """(keep, y_pred, y_prob): probability of class 1 and the class at one half."""
    if isinstance(fitted, boosting.Boosted):
        return boosting.predict(fitted, df).select(*keep, "y_pred", "y_prob")
    if isinstance(fitted, forest.Forest):
        return forest.predict(fitted, df).select(*keep, "y_pred", "y_prob")
    if isinstance(fitted, linear.Linear):
        return linear.predict(fitted, df, keep)
    prob = F.element_at(vector_to_array("probability"), 2)
    return fitted.transform(df).select(*keep, prob.alias("y_prob")).withColumn("y_pred", (F.col("y_prob") >= 0.5).cast("int")).select(*keep, "y_pred", "y_prob")


def macro_f1(predictions: DataFrame) -> float:
    row = core_metrics(predictions.withColumnRenamed("label", "y_true"), []).first()
    return float(row["macro_f1"] or 0.0)


def train_classical(train: DataFrame, val: DataFrame, model_id: str, seed: int = 13, grid: dict | None = None, settings: dict | None = None) -> tuple[object, ClassicalResult]:
    """Grid search by macro F1 on the given validation rows; the first best combination is kept, fitted on train only.

    ``train`` and ``val``: (row_pos, features, label). Runs actions.
    """
    assert_no_smote(settings or {})
    rows = balanced(train)
    best, trials = None, []
    grid = grid or GRIDS[model_id]
    made = fit_linear(rows, grid, model_id) if model_id in ("LR", "SVM") else fit_boosted(rows, grid) if model_id == "HGB" else fit_forest(rows, grid, seed) if model_id == "RF" else None
    for params in expand_grid(grid):
        fitted = made(params) if made else estimator(model_id, params, seed).fit(rows)
        score = macro_f1(predict(fitted, val))
        trials.append({"params": params, "val_macro_f1": score})
        if best is None or score > best[1]:
            best = (fitted, score, params)
    return best[0], ClassicalResult(model_id, best[2], best[1], trials)


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_pipeline(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def batch_logits(docs: DataFrame, make_predictor: Callable[[], Callable], keep: Sequence[str] = ("doc_idx", "window_idx"), batch: int = 32) -> DataFrame:
    """(keep, logits) from windows (input_ids, attention_mask) by any model that numpy can feed.

    ``make_predictor`` is called once in each worker and returns (ids, mask) -> array of logits.
    """
    import numpy as np
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make_predictor()
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                ids, mask = (np.array(part.column(c).to_pylist()) for c in ("input_ids", "attention_mask"))
                out = np.asarray(model(ids, mask), dtype=float)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(out.tolist(), pa.list_(pa.float64()))], [*keep, "logits"])

    types = dict(docs.dtypes)
    return docs.select(*keep, "input_ids", "attention_mask").mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in keep) + ", logits array<double>")


__all__ = ["Pipeline", "batch_logits", "fit_tfidf", "predict", "train_classical", "vectorize"]
