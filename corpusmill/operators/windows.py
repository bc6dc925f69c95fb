"""Overlapping token windows over whole documents, and pooling of what a model says about them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import tokens
from corpusmill.schema import SequenceParams


def n_windows(n: Column, content: int, stride: int) -> Column:
    """1 + ceil(max(n - content, 0) / stride)."""
    return (1 + F.ceil(F.greatest(n - content, F.lit(0)) / F.lit(stride))).cast("int")


def window_spans(n: Column, content: int, stride: int) -> Column:
    """Array of (start, end) that cover 0..n with ``content`` tokens every ``stride``; the last one ends at n."""
    if content < 1 or not 0 < stride <= content:
        raise ValueError("a stride must be positive and no longer than a window")
    each = F.sequence(F.lit(0), n_windows(n, content, stride) - 1)
    return F.transform(each, lambda i: F.struct((i * stride).alias("start"), F.least(i * stride + content, n).cast("int").alias("end")))


def token_windows(
    docs: DataFrame, params: SequenceParams = SequenceParams(), title_only: bool = False, cls_id: int = 101, sep_id: int = 102, pad_id: int = 0,
    ids: Callable[[Column], Column] | None = None, keep: Sequence[str] = ("doc_idx", "label"),
) -> DataFrame:
    """(keep, window_idx, start, end, input_ids, attention_mask), a row per window, padded to the window length.

    ``ids`` turns the text column into an array of integer ids; the default numbers white-space tokens by hash.
    Title-only documents are one window of at most ``title_only_tokens``.
    """
    make = ids or (lambda c: F.transform(tokens(c), lambda t: F.pmod(F.hash(t), F.lit(30_000)).cast("int") + 1000))
    width = params.title_only_tokens if title_only else params.window_tokens
    content = width - params.special_tokens
    rows = docs.select(*keep, make(F.coalesce(F.col("text"), F.lit(""))).alias("__ids"))
    if title_only:
        rows = rows.withColumn("__ids", F.slice("__ids", 1, content))
    spans = window_spans(F.size("__ids"), content, content if title_only else min(params.stride_tokens, content))
    own = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.slice("__ids", s["start"] + 1, s["end"] - s["start"]).alias("body")))
    rows = rows.select(*keep, F.posexplode(own).alias("window_idx", "span"))  # a window's row does not carry all of its document
    full = F.concat(F.array(F.lit(cls_id)), F.col("span.body"), F.array(F.lit(sep_id)))
    pad = F.lit(width) - F.size(full)
    return rows.select(
        *keep, "window_idx", F.col("span.start").alias("start"), F.col("span.end").alias("end"),
        F.concat(full, F.array_repeat(F.lit(pad_id), pad)).alias("input_ids"), F.concat(F.array_repeat(F.lit(1), F.size(full)), F.array_repeat(F.lit(0), pad)).alias("attention_mask"),
    )


def mean_pool(df: DataFrame, key: str = "doc_idx", vector: str = "logits") -> DataFrame:
    """(key, n_windows, vector): element-wise mean of each document's vectors."""
    long = df.select(key, F.posexplode(vector).alias("dim", "x"))
    by_dim = long.groupBy(key, "dim").agg(F.avg("x").alias("m"), F.count(F.lit(1)).alias("n"))
    packed = by_dim.groupBy(key).agg(F.max("n").alias("n_windows"), F.array_sort(F.collect_list(F.struct("dim", "m"))).alias("v"))  # one entry for each dimension
    return packed.select(key, "n_windows", F.transform("v", lambda s: s["m"]).alias(vector))


def softmax(v: Column) -> Column:
    e = F.transform(v, lambda x: F.exp(x - F.array_max(v)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def document_predictions(windows: DataFrame, key: str = "doc_idx", vector: str = "logits") -> DataFrame:
    """(key, n_windows, y_prob, y_pred): logits pooled by document first, softmax after."""
    pooled = mean_pool(windows, key, vector)
    p = F.element_at(softmax(F.col(vector)), 2)
    return pooled.select(key, "n_windows", p.alias("y_prob"), (p >= 0.5).cast("int").alias("y_pred"))


def first_label(df: DataFrame, key: str = "doc_idx", order: str = "window_idx") -> DataFrame:
    """(key, label): the label of each document's first window."""
    return df.groupBy(key).agg(F.min_by("label", order).alias("label"))
