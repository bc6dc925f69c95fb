"""Classification, calibration, transfer and robustness metrics of whole groups of runs at once.

Undefined values are null. Every metric groups by any columns, so a sweep of models and seeds is one plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.lineage import cut
from corpusmill.functions.numbering import long_bucket, positions, running_total

ECE_BINS = 15
NOT_PROBABILISTIC = {"llm_zero_shot"}


def ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0))


def confusion(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """tp, fp, fn, tn of class 1, per group."""
    y, p = F.col("y_true"), F.col("y_pred")
    cell = lambda a, b: F.count_if((y == a) & (p == b))
    return df.groupBy(*by).agg(cell(1, 1).alias("tp"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(0, 0).alias("tn"))


def from_confusion() -> dict[str, Column]:
    """Metrics of tp, fp, fn, tn. Macro averages go over the classes that occur as truth or prediction."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    fake, real = tp + fp + fn > 0, tn + fn + fp > 0
    k = F.when(fake, 1).otherwise(0) + F.when(real, 1).otherwise(0)
    zero = lambda a, b: F.coalesce(ratio(a, b), F.lit(0.0))
    over = lambda f, r: ratio(F.when(fake, f).otherwise(0.0) + F.when(real, r).otherwise(0.0), k)
    f1_fake, f1_real = zero(2 * tp, 2 * tp + fp + fn), zero(2 * tn, 2 * tn + fp + fn)
    return {
        "n": (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")),
        "accuracy": ratio(tp + tn, tp + fp + fn + tn),
        "macro_f1": over(f1_fake, f1_real),
        "macro_precision": over(zero(tp, tp + fp), zero(tn, tn + fn)),
        "macro_recall": over(zero(tp, tp + fn), zero(tn, tn + fp)),
        "f1_fake": f1_fake,
        "f1_real": f1_real,
    }


def core_metrics(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return confusion(df, by).select(*by, *[c.alias(n) for n, c in from_confusion().items()])


def score_curve(df: DataFrame, by: Sequence[str], prob: str = "y_prob") -> DataFrame:
    """Rows by distinct score with positives and negatives at it: everything ranking metrics need.

    Scores are counted before any ordering, so the windows above see distinct scores, not rows.
    """
    return df.where(F.col(prob).isNotNull()).groupBy(*by, F.col(prob).alias("score")).agg(F.count_if(F.col("y_true") == 1).alias("pos"), F.count_if(F.col("y_true") == 0).alias("neg"))


def ranking_metrics(df: DataFrame, by: Sequence[str], prob: str = "y_prob") -> DataFrame:
    """roc_auc (ties count half) and pr_auc (average precision) per group; null where a class is missing.

    What lies below each score is summed bucket by bucket, so a group with many distinct scores is not one task.
    """
    bucket = F.floor(F.col("score") * 4096).cast("long")
    placed = running_total(score_curve(df, by, prob), ["score"], bucket, F.col("neg"), by, "neg_below")
    placed = running_total(placed, ["score"], bucket, F.col("pos"), by, "pos_below")
    sizes = placed.groupBy(*[F.col(c).alias(f"__{c}") for c in by]).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))  # a row for each group
    same = F.lit(True)
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    placed = placed.join(F.broadcast(sizes), same) if by else placed.crossJoin(F.broadcast(sizes))
    at_least = (F.col("p") - F.col("pos_below")) / (F.col("p") - F.col("pos_below") + F.col("n") - F.col("neg_below"))
    p, n = F.max("p"), F.max("n")
    both = (p > 0) & (n > 0)
    won = F.sum(F.col("pos") * (F.col("neg_below") + 0.5 * F.col("neg")))
    return placed.groupBy(*by).agg(F.when(both, won / (p * n)).alias("roc_auc"), F.when(both, F.sum(F.col("pos") * at_least) / p).alias("pr_auc"))


def prob_positive(c: Column, is_array: bool) -> Column:
    """P(fake) out of a scalar or of (P(real), P(fake))."""
    return F.element_at(c, -1) if is_array else c


def confidence(prob: Column) -> Column:
    return F.greatest(prob, 1 - prob)


def calibration_bins(df: DataFrame, by: Sequence[str], bins: int = ECE_BINS, prob: str = "y_prob") -> DataFrame:
    """Per group and bin: n, mean confidence and accuracy of the predicted class; bins are equal, half-open, the last closed."""
    p = F.col(prob)
    conf = confidence(p)
    bin_no = F.least(F.floor(conf * bins), F.lit(bins - 1)).cast("int")
    right = F.when((p >= 0.5).cast("int") == F.col("y_true"), 1.0).otherwise(0.0)
    return df.where(p.isNotNull()).groupBy(*by, bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(conf).alias("confidence"), F.avg(right).alias("accuracy"))


def ece(df: DataFrame, by: Sequence[str], bins: int = ECE_BINS, prob: str = "y_prob") -> DataFrame:
    """Expected calibration error per group."""
    table = calibration_bins(df, by, bins, prob)
    gap = F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence")))
    return table.groupBy(*by).agg((gap / F.sum("n")).alias("ece"))


def ece_eligible(model_id: Column) -> Column:
    return ~model_id.isin(*NOT_PROBABILISTIC)


def all_metrics(df: DataFrame, by: Sequence[str], bins: int = ECE_BINS) -> DataFrame:
    """Core, ranking and calibration metrics side by side; ece only where the model has probabilities."""
    out = core_metrics(df, by).join(ranking_metrics(df, by), list(by), "left").join(ece(df, by, bins), list(by), "left")
    return out.withColumn("ece", F.when(ece_eligible(F.col("model_id")), F.col("ece"))) if "model_id" in by else out


def transfer_metrics(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """From (by, target, in_f1, cross_f1): mean loss, the spread of the cross scores (population) and the losses by target."""
    loss = F.col("in_f1") - F.col("cross_f1")
    return df.groupBy(*by).agg(
        F.avg(loss).alias("delta_f1_mean"), F.stddev_pop("cross_f1").alias("cross_f1_std"),
        F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("target", F.round(loss, 9).alias("delta")))), lambda s: s)).alias("deltas"),  # one entry for each target
    )


def robustness_metrics(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """From (y_true, clean_pred, attacked_pred, similarity): accuracies, success rate over what was right, similarity of successes."""
    right = F.col("clean_pred") == F.col("y_true")
    fooled = right & (F.col("attacked_pred") != F.col("y_true"))
    return df.groupBy(*by).agg(
        F.avg(right.cast("double")).alias("clean_accuracy"), F.avg((F.col("attacked_pred") == F.col("y_true")).cast("double")).alias("attacked_accuracy"),
        ratio(F.count_if(fooled), F.count_if(right)).alias("attack_success_rate"), F.avg(F.when(fooled, F.col("similarity"))).alias("success_similarity"),
    )


def mean_std(value: str) -> list[Column]:
    """Mean, sample deviation (0 for one value) and count of finite values."""
    v = F.when(~F.isnan(value) & (F.abs(value) != float("inf")), F.col(value))
    return [F.avg(v).alias("mean"), F.when(F.count(v) == 1, 0.0).otherwise(F.stddev_samp(v)).alias("std"), F.count(v).alias("n")]


def aggregate_metrics(df: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """(by, metric, mean, std, n) over seeds; what is null, NaN or infinite is left out, null keys are kept."""
    long = df.unpivot(list(by), [F.col(m).cast("double").alias(m) for m in metrics], "metric", "value")
    return long.groupBy(*by, "metric").agg(*mean_std("value"))


def pareto(df: DataFrame, cost: str, value: str) -> DataFrame:
    """Rows that no row of at most their cost beats; rows equal in both stand together, nulls in either take no part.

    The best value of each cost is compared with those of lower costs: inside its range partition, and with the
    best of the partitions before, of which there is one row each. The ranges are written first.
    """
    best = df.where(F.col(cost).isNotNull() & F.col(value).isNotNull()).groupBy(F.col(cost).alias("__cost")).agg(F.max(value).alias("__value"))
    placed = cut(best.repartitionByRange("__cost").withColumn("__part", F.spark_partition_id()))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    tops = placed.groupBy("__part").agg(F.max("__value").alias("__top")).select("__part", F.max("__top").over(before).alias("__ahead"))
    inside = F.max("__value").over(Window.partitionBy("__part").orderBy("__cost").rowsBetween(Window.unboundedPreceding, -1))
    seen = placed.withColumn("__inside", inside).join(F.broadcast(tops), "__part").withColumn("__best", F.greatest("__inside", "__ahead"))
    edge = seen.where(F.col("__best").isNull() | (F.col("__value") > F.col("__best"))).select("__cost", "__value")
    return df.join(edge, (F.col(cost) == F.col("__cost")) & (F.col(value) == F.col("__value")), "left_semi")


def length_buckets(df: DataFrame, length: str, k: int = 4, key: str = "row_pos") -> DataFrame:
    """``df`` with ``bucket``, 0 to k - 1: parts of equal size by rank of an integer ``length``, ties by ``key``.

    Rows without a length have no bucket. Ranks come from ranges of lengths, so no task sees all rows.
    """
    known = positions(df.where(F.col(length).isNotNull()), [length, key], long_bucket(length), name="__place")
    n = known.agg(F.count(F.lit(1)).alias("__n"))
    bucket = F.least(F.floor(F.col("__place") * k / F.col("__n")), F.lit(k - 1)).cast("int")
    out = known.crossJoin(F.broadcast(n)).withColumn("bucket", bucket).drop("__place", "__n")  # one row
    return out.unionByName(df.where(F.col(length).isNull()).withColumn("bucket", F.lit(None).cast("int")))


def error_taxonomy(df: DataFrame, by: Sequence[str], sure: float = 0.9) -> DataFrame:
    """(by, kind, confident, n, share) of (y_true, y_pred, y_prob): what kinds of outcome there are, and how sure.

    Kinds are hit, correct rejection, false alarm and miss; confident is whether the predicted class has
    probability ``sure`` or more, null without a probability. Shares are of a group's rows.
    """
    right = F.col("y_pred") == F.col("y_true")
    kind = F.when(F.col("y_pred") == 1, F.when(right, "hit").otherwise("false alarm")).otherwise(F.when(right, "correct rejection").otherwise("miss"))
    p = F.when(F.col("y_pred") == 1, F.col("y_prob")).otherwise(1 - F.col("y_prob"))
    counts = df.groupBy(*by, kind.alias("kind"), (p >= sure).alias("confident")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*by))  # at most twelve rows a group
    return counts.withColumn("share", F.col("n") / total)
