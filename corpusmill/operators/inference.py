"""Paired tests, effect sizes, rank tests and multiple-comparison control.

Row data is reduced to counts by grouped aggregation; what follows works on a few numbers for each pair.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.lineage import cut
from corpusmill.operators.metrics import ratio

RESAMPLES, CI, Q = 10_000, 0.95, 0.05
EXACT_BELOW = 25


def paired_cells(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, y, a, b, n): joint counts of truth and two models' predictions; at most 8 rows a group."""
    return df.groupBy(*by, F.col("y_true").alias("y"), F.col("pred_a").alias("a"), F.col("pred_b").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def align(predictions: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a_id, b_id, seed, row_pos, y_true, pred_a, pred_b) for pairs (a_id, b_id), met on keys; rows whose truths differ raise.

    All models of a key come together in one shuffle; ``pairs``, a handful, are sent to the tasks.
    """
    known = predictions.where(F.col("seed").isNotNull() & F.col("row_pos").isNotNull())
    met = known.groupBy("seed", "row_pos").agg(F.collect_list(F.struct("model_id", "y_true", "y_pred")).alias("ms"))  # a row's models
    each = met.select("seed", "row_pos", "ms", F.explode("ms").alias("a")).select("seed", "row_pos", "a", F.explode("ms").alias("b"))
    both = each.select(F.col("a.model_id").alias("a_id"), F.col("b.model_id").alias("b_id"), "seed", "row_pos", "a", "b").join(F.broadcast(pairs), ["a_id", "b_id"])
    same = F.when(F.col("a.y_true") == F.col("b.y_true"), F.col("a.y_true")).otherwise(F.raise_error(F.lit("the models' truths differ")).cast("int"))
    return both.select("a_id", "b_id", "seed", "row_pos", same.alias("y_true"), F.col("a.y_pred").alias("pred_a"), F.col("b.y_pred").alias("pred_b"))


def model_pairs(models: DataFrame) -> DataFrame:
    """(a_id, b_id) of unordered pairs from (model_id, ord): a self-join of a handful of models."""
    return models.alias("l").join(models.alias("r"), F.col("l.ord") < F.col("r.ord")).select(F.col("l.model_id").alias("a_id"), F.col("r.model_id").alias("b_id"))


def macro_f1_of_counts(c: np.ndarray) -> np.ndarray:
    """Macro F1 of arrays of counts [..., y, p], over the classes that occur."""
    total, k = np.zeros(c.shape[:-2]), np.zeros(c.shape[:-2])
    for i in (0, 1):
        tp, seen = c[..., i, i], c[..., i, :].sum(-1) + c[..., :, i].sum(-1)
        total += np.divide(2 * tp, seen, out=np.zeros_like(total), where=seen > 0)
        k += seen > 0
    return np.divide(total, k, out=np.full_like(total, np.nan), where=k > 0)


def uniforms(stream: str, draws: int) -> np.ndarray:
    """Numbers in (0, 1): the 60 bits that begin SHA-256 of stream:draw. Any engine can replay them."""
    bits = [int(hashlib.sha256(f"{stream}:{k}".encode()).hexdigest()[:15], 16) for k in range(draws)]
    return (np.array(bits, dtype=np.float64) + 0.5) / 2.0**60


def log_factorials(low: int, high: int) -> np.ndarray:
    """Logarithms of the factorials from low to high: sums below 256, then Stirling's series (relative error about 1e-16)."""
    n = np.arange(max(low, 256), high + 1, dtype=np.float64)
    series = n * np.log(n) - n + 0.5 * np.log(2 * math.pi * n) + (1 / 12 - (1 / 360 - 1 / (1260 * n * n)) / (n * n)) / n
    return np.r_[np.cumsum(np.r_[0.0, np.log(np.arange(1, 256))])[low : high + 1], series]


def binomial_draws(n: np.ndarray, p: float, u: np.ndarray) -> np.ndarray:
    """For each draw the smallest x whose binomial(n, p) distribution function reaches u.

    Only x within twelve standard deviations of the mean can be drawn; the largest of them takes what is beyond.
    Work and memory grow with the square root of n.
    """
    if p <= 0 or p >= 1:
        return np.zeros_like(n) if p <= 0 else n.copy()
    out = np.zeros_like(n)
    order = np.argsort(n, kind="stable")
    sizes, begin = np.unique(n[order], return_index=True)
    mid = np.floor(sizes * p).astype(np.int64)
    reach = np.ceil(12 * np.sqrt(sizes * p * (1 - p)) + 5).astype(np.int64)
    low, high = np.maximum(0, mid - reach), np.minimum(sizes, mid + reach)
    if not len(sizes):
        return out
    ours, theirs = int(low.min()), int((sizes - high).min())
    took, left = log_factorials(ours, int(high.max())), log_factorials(theirs, int((sizes - low).max()))
    took = took - np.arange(ours, ours + len(took)) * math.log(p)
    left = (left - np.arange(theirs, theirs + len(left)) * math.log1p(-p))[::-1]
    top = theirs + len(left) - 1
    for m, lo, hi, own in zip(sizes.tolist(), low.tolist(), high.tolist(), np.split(order, begin[1:])):
        rest = left[top - (m - lo) : top - (m - hi) + 1]  # of m - x, x from lo to hi
        cdf = np.cumsum(np.exp(log_factorials(m, m)[0] - took[lo - ours : hi - ours + 1] - rest))
        out[own] = lo + np.minimum(np.searchsorted(cdf, u[own]), hi - lo)
    return out


def multinomial_draws(cells: np.ndarray, stream: str, draws: int) -> np.ndarray:
    """Draws of as many rows as the cells hold, by their shares: a binomial for each cell out of what the ones before left."""
    out, left, rest = np.zeros((draws, len(cells)), dtype=np.int64), np.full(draws, cells.sum()), int(cells.sum())
    for j, c in enumerate(cells.tolist()):
        last = j == len(cells) - 1
        out[:, j] = left if last else binomial_draws(left, c / rest if rest else 0.0, uniforms(f"{stream}:{j}", draws))
        left, rest = left - out[:, j], rest - c
    return out


def bootstrap_cells(cells: np.ndarray, resamples: int, stratified: bool, ci: float, stream: str) -> dict[str, float]:
    """Paired bootstrap of macro F1(a) - macro F1(b) from counts [y, a, b].

    Drawing rows with replacement only moves the counts of the joint cells, which are multinomial, so a
    resample costs one draw whatever the number of rows. Stratified: one multinomial for each class. The numbers
    behind the draws are those of ``uniforms`` for the stream, class and cell.
    """
    cells = cells.astype(np.int64)
    if stratified:
        drawn = np.stack([multinomial_draws(cells[y].ravel(), f"{stream}:{y}", resamples).reshape(-1, 2, 2) for y in (0, 1)], axis=1)
    else:
        drawn = multinomial_draws(cells.ravel(), stream, resamples).reshape(-1, 2, 2, 2)
    diff = macro_f1_of_counts(drawn.sum(-1).astype(float)) - macro_f1_of_counts(drawn.sum(-2).astype(float))
    seen = macro_f1_of_counts(cells.sum(-1).astype(float)) - macro_f1_of_counts(cells.sum(-2).astype(float))
    low, high = np.quantile(diff, [(1 - ci) / 2, (1 + ci) / 2])
    p = min(1.0, 2 * min(float((diff <= 0).mean()), float((diff >= 0).mean())))
    return {"observed_diff": float(seen), "mean_diff": float(diff.mean()), "ci_low": float(low), "ci_high": float(high), "p_value": p}


def paired_bootstrap(df: DataFrame, by: Sequence[str], resamples: int = RESAMPLES, stratified: bool = True, ci: float = CI, seed: int = 13) -> DataFrame:
    """Per group of (y_true, pred_a, pred_b) rows: observed and mean difference, percentile interval, two-sided p.

    A group's stream of random numbers is named by the seed and its keys, joined by colons.
    """
    return bootstrap_of(paired_cells(df, by), by, resamples, stratified, ci, seed)


def bootstrap_of(cells: DataFrame, by: Sequence[str], resamples: int = RESAMPLES, stratified: bool = True, ci: float = CI, seed: int = 13) -> DataFrame:
    """``paired_bootstrap`` of rows that ``paired_cells`` has counted."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cells.select(*by).schema)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        c = np.zeros((2, 2, 2))
        for y, a, b, n in zip(rows["y"], rows["a"], rows["b"], rows["n"]):
            c[int(y), int(a), int(b)] = n
        return pd.DataFrame([dict(zip(by, key)) | {"n": int(c.sum())} | bootstrap_cells(c, resamples, stratified, ci, ":".join(map(str, (seed, *key))))])

    return cells.groupBy(*by).applyInPandas(run, f"{fields}, n long, observed_diff double, mean_diff double, ci_low double, ci_high double, p_value double")


def mcnemar(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """n_b (only a right), n_c (only b right), the statistic, whether it is the exact test, and p.

    Fewer than 25 discordant rows: the two-sided binomial test, statistic min(b, c). Else the continuity-corrected
    chi-square with one degree of freedom, whose tail is erfc(sqrt(x / 2)).
    """
    return mcnemar_of(paired_cells(df, by), by)


def mcnemar_of(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """``mcnemar`` of rows that ``paired_cells`` has counted."""
    a, b = F.col("a") == F.col("y"), F.col("b") == F.col("y")
    counted = lambda which: F.coalesce(F.sum(F.when(which, F.col("n"))), F.lit(0))
    counts = cells.groupBy(*by).agg(counted(a & ~b).alias("n_b"), counted(b & ~a).alias("n_c"))
    n, k = F.col("n_b") + F.col("n_c"), F.least("n_b", "n_c")
    exact = n < EXACT_BELOW
    # sum of binomial coefficients up to k, by the ratio of neighbours
    terms = F.aggregate(F.sequence(F.lit(0), k.cast("int")), F.struct(F.lit(1.0).alias("c"), F.lit(0.0).alias("s")),
                        lambda acc, i: F.struct((acc["c"] * (n - i) / (i + 1)).alias("c"), (acc["s"] + acc["c"]).alias("s")))["s"]
    p_exact = F.least(F.lit(1.0), 2 * terms * F.pow(F.lit(0.5), n))
    chi = F.pow(F.greatest(F.abs(F.col("n_b") - F.col("n_c")) - 1, F.lit(0)), 2) / F.nullif(n, F.lit(0))
    return counts.select(*by, "n_b", "n_c", F.when(exact, k.cast("double")).otherwise(chi).alias("statistic"), exact.alias("exact"), F.when(exact, p_exact).otherwise(erfc(F.sqrt(chi / 2))).alias("p_value"))


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0 as a continued fraction beyond 2 and a series below (about 1e-12)."""
    t = x * x
    series = F.aggregate(F.sequence(F.lit(0), F.lit(60)), F.struct(x.alias("term"), F.lit(0.0).alias("sum")),
                         lambda acc, i: F.struct((acc["term"] * 2 * t / (2 * i + 3)).alias("term"), (acc["sum"] + acc["term"]).alias("sum")))["sum"]
    small = 1 - 2 / math.sqrt(math.pi) * F.exp(-t) * series
    fraction = F.aggregate(F.sequence(F.lit(80), F.lit(1)), x, lambda acc, i: x + (i / F.lit(2.0)) / acc)
    large = F.exp(-t) / math.sqrt(math.pi) / fraction
    return F.when(x < 2, small).otherwise(large)


def cliffs_delta(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """From (by, side 'a' or 'b', value): (#a > b - #a < b) / (n m), by ranks of counted values rather than pairs."""
    counted = df.groupBy(*by, "value").agg(F.count_if(F.col("side") == "a").alias("na"), F.count_if(F.col("side") == "b").alias("nb"))
    w = Window.partitionBy(*by).orderBy("value")
    placed = counted.withColumn("below", F.coalesce(F.sum("nb").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    n, m, b = F.sum("na"), F.sum("nb"), F.sum(F.col("na") * F.col("below"))
    tied = F.sum(F.col("na") * F.col("nb"))
    return placed.groupBy(*by).agg(ratio(2 * b + tied - n * m, n * m).alias("cliffs_delta"))


def bh_fdr(df: DataFrame, by: Sequence[str] = (), p: str = "p_value", q: float = Q) -> DataFrame:
    """``df`` with p_adjusted (Benjamini-Hochberg step-up, at most 1) and significant; a family is one group of ``by``.

    A family is a list of comparisons, so one window holds it. Null p-values stay null and are not counted.
    """
    family = Window.partitionBy(*by)
    known = F.col(p).isNotNull()
    m = F.count(p).over(family)
    rank = F.row_number().over(family.orderBy(F.col(p).asc_nulls_last()))
    out = df.withColumn("__raw", F.when(known, F.col(p) * m / rank)).withColumn("__rank", rank)
    adjusted = F.least(F.lit(1.0), F.min("__raw").over(family.orderBy(F.desc("__rank")).rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumn("p_adjusted", F.when(known, adjusted)).withColumn("significant", F.coalesce(F.col("p_adjusted") < q, F.lit(False))).drop("__raw", "__rank")


def average_ranks(df: DataFrame, block: str, treatment: str, value: str) -> DataFrame:
    """(block, treatment, rank): rank of each treatment in its block, best (highest) first, ties averaged."""
    w = Window.partitionBy(block)
    rank = F.rank().over(w.orderBy(F.desc(value)))
    peers = F.count(F.lit(1)).over(Window.partitionBy(block, value))
    return df.select(block, treatment, (rank + (peers - 1) / 2).alias("rank"))


def friedman(df: DataFrame, block: str, treatment: str, value: str) -> DataFrame:
    """(n, k, statistic, p_value): Friedman's chi-square over blocks, corrected for ties."""
    ranks = average_ranks(df, block, treatment, value)
    sums = ranks.groupBy(treatment).agg(F.sum("rank").alias("r"), F.count(F.lit(1)).alias("n"))
    ties = df.groupBy(block, value).agg(F.count(F.lit(1)).alias("t")).agg(F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("ties"))
    one = sums.agg(F.sum(F.col("r") * F.col("r")).alias("ss"), F.count(F.lit(1)).alias("k"), F.max("n").alias("n")).crossJoin(ties)  # one row each
    n, k = F.col("n"), F.col("k")
    raw = 12 / (n * k * (k + 1)) * F.col("ss") - 3 * n * (k + 1)
    stat = raw / F.nullif(1 - F.col("ties") / (n * (k * k * k - k)), F.lit(0.0))
    def tails(x: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) else chi2_tail(a, int(b)) for a, b in zip(x, d)], dtype=float)

    tail = F.pandas_udf(tails, "double")  # one row
    return one.select("n", "k", stat.alias("statistic"), tail(stat, k - 1).alias("p_value"))


def chi2_tail(x: float, df: int) -> float:
    """P(chi-square with ``df`` degrees of freedom > x), by the recurrence in steps of two degrees."""
    if x <= 0:
        return 1.0
    tail, at = (math.erfc(math.sqrt(x / 2)), 1) if df % 2 else (math.exp(-x / 2), 2)
    while at < df:
        tail += math.exp(at / 2 * math.log(x / 2) - x / 2 - math.lgamma(at / 2 + 1))
        at += 2
    return min(1.0, tail)


def studentized_range_tail(q: float, k: int, points: int = 4001) -> float:
    """P(range of k standard normals > q), by numeric integration."""
    z = np.linspace(-8, 8, points)
    cdf = np.vectorize(lambda v: 0.5 * math.erfc(-v / math.sqrt(2)))
    inside = k * np.exp(-z * z / 2) / math.sqrt(2 * math.pi) * (cdf(z + q) - cdf(z)) ** (k - 1)
    return float(min(1.0, max(0.0, 1 - np.trapezoid(inside, z))))


def nemenyi(df: DataFrame, block: str, treatment: str, value: str) -> DataFrame:
    """(a, b, rank_a, rank_b, p_value) for each pair of treatments: studentized range over mean ranks."""
    ranks = average_ranks(df, block, treatment, value).groupBy(F.col(treatment).cast("string").alias("t")).agg(F.avg("rank").alias("r"), F.count(F.lit(1)).alias("n"))
    k = ranks.agg(F.count(F.lit(1)).alias("k"))
    pairs = ranks.alias("x").join(ranks.alias("y"), F.col("x.t") < F.col("y.t")).crossJoin(k)  # a handful of treatments
    q = F.abs(F.col("x.r") - F.col("y.r")) / F.sqrt(F.col("k") * (F.col("k") + 1) / (6 * F.col("x.n"))) * math.sqrt(2)

    def tails(x: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([studentized_range_tail(float(a), int(b)) for a, b in zip(x, m)], dtype=float)

    tail = F.pandas_udf(tails, "double")
    return pairs.select(F.col("x.t").alias("a"), F.col("y.t").alias("b"), F.col("x.r").alias("rank_a"), F.col("y.r").alias("rank_b"), tail(q, F.col("k")).alias("p_value"))


def claim_allowed(diff: Column, p_raw: Column, p_adjusted: Column, q: float = Q) -> Column:
    """A claim needs a finite difference, raw and adjusted p, and an adjusted p below q."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return F.coalesce(finite(diff) & finite(p_raw) & finite(p_adjusted) & (p_adjusted < q), F.lit(False))


def confirmatory(family: DataFrame, q: float = Q, required: Sequence[str] = ("comparison", "diff", "p_value", "effect")) -> DataFrame:
    """The whole family with adjusted p and whether each claim may be made; a missing column raises, a null one blocks the claim."""
    if missing := [c for c in required if c not in family.columns]:
        raise ValueError(f"the family lacks {missing}")
    out = bh_fdr(family, (), "p_value", q)
    return out.withColumn("claim_allowed", claim_allowed(F.col("diff"), F.col("p_value"), F.col("p_adjusted"), q) & F.col("effect").isNotNull())


def pairwise_comparisons(predictions: DataFrame, models: DataFrame, seed_scores: DataFrame, resamples: int = RESAMPLES, q: float = Q) -> DataFrame:
    """Bootstrap, McNemar and Cliff's delta of every pair of models over all their seeds, with the family's BH.

    ``predictions``: (model_id, seed, row_pos, y_true, y_pred); ``models``: (model_id, ord); ``seed_scores``: (model_id, seed, value).
    An action counts the pairs' cells once.
    """
    pairs = model_pairs(models)
    by = ["a_id", "b_id"]
    cells = cut(paired_cells(align(predictions, pairs), by))
    side = lambda s: pairs.join(seed_scores.withColumnRenamed("model_id", f"{s}_id"), f"{s}_id").select(*by, F.lit(s).alias("side"), "value")
    effect = cliffs_delta(side("a").unionByName(side("b")), by)
    tested = mcnemar_of(cells, by).withColumnsRenamed({"p_value": "mcnemar_p", "statistic": "mcnemar_statistic", "exact": "mcnemar_exact"})
    out = bootstrap_of(cells, by, resamples).join(tested, by).join(effect, by)
    return bh_fdr(out, (), "p_value", q)
