"""The sample tables in the roles that the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dataset_id, row_pos, title, text, label_raw, source): every document, with its quality as raw label."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("label_raw"))
    docs = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    return docs.select(F.lit("DOC").alias("dataset_id"), F.col("doc_id").alias("row_pos"), F.lit(None).cast("string").alias("title"), "text", "label_raw", "source", "lang")


def with_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that carry a label: 1 for low quality."""
    df = labelled(spark, sf_dir).where(F.col("label_raw").isNotNull())
    return df.withColumn("label", (1 - F.col("label_raw").cast("int")).cast("int"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model_id, seed, row_pos, y_true, y_pred, y_prob) of two made-up models, a row per line item and model."""
    place = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(place).alias("k"), (F.col("l_returnflag") == "R").cast("int").alias("y_true"))
    models = F.array(*(F.struct(F.lit(name).alias("model_id"), (((F.col("l_orderkey") * a + F.col("l_linenumber") * b) % 1000) / 1000.0).alias("prob")) for name, a, b in (("M1", 31, 17), ("M2", 7, 13))))
    each = li.select("*", F.explode(models).alias("m"))  # one window for both
    return each.select(
        "m.model_id", (F.col("l_orderkey") % 5).cast("int").alias("seed"), (F.col("l_orderkey") * 1000 + F.col("k")).cast("long").alias("row_pos"),
        "y_true", (F.col("m.prob") >= 0.5).cast("int").alias("y_pred"), F.col("m.prob").alias("y_prob"),
    )


PREDICTIONS_SQL = """
  SELECT model_id, (l_orderkey % 5)::INTEGER AS seed, (l_orderkey * 1000 + k)::BIGINT AS row_pos,
    (l_returnflag = 'R')::INTEGER AS y_true, (p >= 0.5)::INTEGER AS y_pred, p AS y_prob
  FROM (
    WITH li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag) AS k FROM lineitem)
    SELECT 'M1' AS model_id, *, ((l_orderkey * 31 + l_linenumber * 17) % 1000) / 1000.0::DOUBLE AS p FROM li
    UNION ALL SELECT 'M2', *, ((l_orderkey * 7 + l_linenumber * 13) % 1000) / 1000.0::DOUBLE FROM li)
"""
