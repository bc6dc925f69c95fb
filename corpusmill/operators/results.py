"""Result rows: building, validation, aggregation over seeds, selection and resumable sweeps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.operators.metrics import mean_std
from corpusmill.schema import PROVENANCE

GROUP = ["experiment_id", "model_id", "dataset_id", "split_regime"]


class ResultSchemaError(ValueError):
    """A result row without what every row must have."""


def result_rows(metrics: DataFrame, **provenance) -> DataFrame:
    """``metrics`` with constant provenance columns, those first."""
    out = metrics.withColumns({k: F.lit(v) for k, v in provenance.items()})
    return out.select(*column_order(out.columns))


def column_order(columns: Sequence[str]) -> list[str]:
    """Provenance columns first, all others in the order they came."""
    return [c for c in PROVENANCE if c in columns] + [c for c in columns if c not in PROVENANCE]


def metric_columns(df: DataFrame) -> list[str]:
    """Every column that is not provenance."""
    return [c for c in df.columns if c not in PROVENANCE]


def valid_row() -> Column:
    """True where all provenance is present, not blank, and the seed is an integer."""
    ok = F.lit(True)
    for c in PROVENANCE:
        ok &= F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "")
    return ok & F.col("seed").cast("string").rlike(r"^-?\d+$")


def validate(df: DataFrame, same_version: bool = False) -> DataFrame:
    """``df``; reading a row that is not valid raises, as does a missing column here and now."""
    if missing := [c for c in PROVENANCE if c not in df.columns]:
        raise ResultSchemaError(f"missing columns {missing}")
    ok = valid_row()
    if same_version:
        ok &= F.col("train_version") == F.col("test_version")
    guard = F.when(ok, F.col("run_id")).otherwise(F.raise_error(F.concat(F.lit("invalid result row "), F.to_json(F.struct(*PROVENANCE)))).cast("string"))
    return df.withColumn("run_id", guard)


def append(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """Old and new rows together; columns that only one side has are null on the other."""
    new = validate(new)
    return new if old is None else old.unionByName(new, allowMissingColumns=True)


def latest(df: DataFrame, keys: Sequence[str] = ("experiment_id", "model_id", "seed"), order: str = "run_id") -> DataFrame:
    """The last run of each cell."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def over_seeds(df: DataFrame, metrics: Sequence[str] | None = None, by: Sequence[str] = GROUP) -> DataFrame:
    """(by, metric, mean, std, n) of the numeric metric columns over seeds; null keys are groups of their own."""
    numeric = {f.name for f in df.schema if f.dataType.typeName() in ("integer", "long", "double", "float", "decimal", "short", "byte")}
    use = [c for c in (metrics or metric_columns(df)) if c in numeric]
    long = df.unpivot(list(by), [F.col(m).cast("double").alias(m) for m in use], "metric", "value")
    return long.groupBy(*by, "metric").agg(*mean_std("value")).orderBy(*by, "metric")


def best_model(df: DataFrame) -> DataFrame:
    """One row: highest mean macro_f1, then lowest mean ece, then fewest parameters, then the smaller id."""
    means = df.groupBy("model_id").agg(F.avg("macro_f1").alias("macro_f1"), F.avg("ece").alias("ece"), F.first("n_params", ignorenulls=True).alias("n_params"))
    return means.orderBy(F.desc("macro_f1"), F.asc_nulls_last("ece"), F.asc_nulls_last("n_params"), "model_id").limit(1)


def sweep_cells(spark: SparkSession, models: Sequence[str], seeds: Sequence[int]) -> DataFrame:
    """(model_id, seed) of a whole sweep: a few names times a few seeds."""
    m = spark.createDataFrame([(x,) for x in models], "model_id string")
    s = spark.createDataFrame([(x,) for x in seeds], "seed int")
    return m.crossJoin(s)


def missing_cells(cells: DataFrame, results: DataFrame) -> DataFrame:
    """Cells without a result: what a resumed sweep has left to do."""
    return cells.join(results.select("model_id", F.col("seed").cast("int").alias("seed")).distinct(), ["model_id", "seed"], "left_anti")


def is_complete(cells: DataFrame, results: DataFrame) -> bool:
    return missing_cells(cells, results).isEmpty()
