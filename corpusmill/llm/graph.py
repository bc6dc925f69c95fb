"""Connected components of a graph whose edges never leave the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import durable


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (u, v): label is the smallest node it can reach.

    Alternates large-star and small-star steps (Kiveris et al., 2014), each a map-side combined
    minimum and an equi-join, and checkpoints every round, until the edges form stars. The number of
    rounds grows with the logarithm of the longest chain. Self-links and null ends are ignored, so a
    node without a link to another is not returned.
    """
    now = durable(
        edges.where(F.col("u") != F.col("v"))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if state == before or not state["n"]:
            break
        before = state
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = (
            both.join(least, "u").where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = durable(small.union(least.select("u", F.col("m").alias("v"))).distinct())
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return leaves.union(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
