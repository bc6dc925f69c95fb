"""Ranks and running totals over a whole table without one task that sees all of it.

Rows are put into order-preserving buckets. The buckets' totals are small and get a running sum of their
own; inside a bucket an ordinary window counts on. Ordering by the bucket column must agree with ordering
by the order columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_BITS = 14


def long_bucket(order: str) -> Column:
    """Bucket of an integer order column: runs of 2**14 values."""
    return F.shiftright(F.col(order).cast("long"), BUCKET_BITS)


def hex_bucket(order: str) -> Column:
    """Bucket of a hash given in hex digits: its first three."""
    return F.conv(F.substring(order, 1, 3), 16, 10).cast("long")


def time_bucket(order: str) -> Column:
    """Bucket of a timestamp: its hour; nulls come after all."""
    return F.coalesce(F.floor(F.unix_timestamp(order) / 3600), F.lit(1 << 60)).cast("long")


def running_total(df: DataFrame, order: Sequence, bucket: Column, amount: Column | None = None, by: Sequence[str] = (), name: str = "before") -> DataFrame:
    """``df`` with the sum of ``amount`` (1 for each row if None) over the rows before each, within ``by``."""
    marked = df.withColumn("__bucket", bucket).withColumn("__amount", F.lit(1).cast("long") if amount is None else amount)
    totals = marked.groupBy(*by, "__bucket").agg(F.sum("__amount").alias("__total"))
    ahead = F.sum("__total").over(Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = totals.select(*[F.col(c).alias(f"__by_{c}") for c in by], F.col("__bucket").alias("__b"), F.coalesce(ahead, F.lit(0)).alias("__start"))
    on = F.col("__bucket") == F.col("__b")
    for c in by:
        on &= F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    inside = F.sum("__amount").over(Window.partitionBy(*by, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    out = marked.join(starts, on).withColumn(name, F.col("__start") + F.coalesce(inside, F.lit(0)))
    return out.drop("__bucket", "__amount", "__b", "__start", *[f"__by_{c}" for c in by])


def positions(df: DataFrame, order: Sequence, bucket: Column, by: Sequence[str] = (), name: str = "row_pos") -> DataFrame:
    """``df`` with each row's place, from 0, in the order given; ties must be broken by ``order`` itself."""
    return running_total(df, order, bucket, None, by, name).withColumn(name, F.col(name).cast("long"))
