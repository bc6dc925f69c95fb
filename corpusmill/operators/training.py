"""Scalar logic around training: class weights, learning-rate schedule, early stopping."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def class_weights(df: DataFrame, label: str = "label", classes: int = 2) -> DataFrame:
    """(label, n, weight) for each of the classes: N / (classes * max(n, 1))."""
    every = df.sparkSession.range(classes).select(F.col("id").cast("int").alias(label))
    counts = df.groupBy(F.col(label).cast("int").alias(label)).agg(F.count(F.lit(1)).alias("n"))
    out = every.join(counts, label, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy())  # a row for each class
    return out.withColumn("weight", total / (F.lit(classes) * F.greatest("n", F.lit(1))))


def warmup_cosine(step: Column, warmup: int, total: int) -> Column:
    """Learning-rate factor: linear up to 1 over the warm-up, then half a cosine down to 0."""
    progress = (step - warmup) / F.lit(float(max(1, total - warmup)))
    down = F.greatest(F.lit(0.0), 0.5 * (1 + F.cos(F.lit(math.pi) * F.least(F.lit(1.0), progress))))
    return F.when(step < warmup, step / F.lit(float(max(1, warmup)))).otherwise(down)


def schedule(spark: SparkSession, total: int, warmup_ratio: float = 0.06, rate: float = 2e-5) -> DataFrame:
    """(step, factor, learning_rate) of every step; the warm-up is int(total * ratio) steps."""
    factor = warmup_cosine(F.col("step"), int(total * warmup_ratio), total)
    return spark.range(total).select(F.col("id").alias("step")).select("step", factor.alias("factor"), (factor * rate).alias("learning_rate"))


def early_stopping(df: DataFrame, by: str = "run_id", patience: int = 3) -> DataFrame:
    """(by, best_epoch, best_score, stopped_epoch) of (by, epoch, score); epochs after the stop are not looked at.

    A higher score resets the count of bad epochs; at ``patience`` of them in a row the run stops there, else null.
    """
    runs = df.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("epoch", F.col("score").cast("double").alias("score")))).alias("es"))  # a run's own epochs
    start = F.struct(F.lit(None).cast("double").alias("best"), F.lit(None).cast("int").alias("at"), F.lit(0).alias("bad"), F.lit(None).cast("int").alias("stop"))

    def step(s: Column, e: Column) -> Column:
        better = s["best"].isNull() | (e["score"] > s["best"])
        epoch = e["epoch"].cast("int")
        bad = F.when(better, 0).otherwise(s["bad"] + 1)
        moved = F.struct(
            F.when(better, e["score"]).otherwise(s["best"]).alias("best"), F.when(better, epoch).otherwise(s["at"]).alias("at"), bad.alias("bad"),
            F.when(bad >= patience, epoch).alias("stop"),
        )
        return F.when(s["stop"].isNotNull(), s).otherwise(moved)

    end = F.aggregate("es", start, step)
    return runs.select(by, end["at"].alias("best_epoch"), end["best"].alias("best_score"), end["stop"].alias("stopped_epoch"))


def assert_no_smote(settings: dict) -> None:
    """Oversampling is prohibited wherever it is named."""
    if any("smote" in str(k).lower() and bool(v) for k, v in settings.items()):
        raise ValueError("SMOTE is prohibited")
