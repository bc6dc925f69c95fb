"""Incremental versions of operators that make sense on streams: exact dedup, classification counts, windows of time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators.metrics import confusion, from_confusion


def read_stream(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """New parquet files below ``path``, a few for each trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def first_seen(stream: DataFrame, ts: str, within: str = "1 day") -> DataFrame:
    """One row for each text within the watermark; the state holds a hash per text and forgets it afterwards."""
    return stream.withColumn("text_sha", F.sha2("text", 256)).withWatermark(ts, within).dropDuplicatesWithinWatermark(["text_sha"])


def running_confusion(stream: DataFrame, by: Sequence[str]) -> DataFrame:
    """Confusion counts over all rows so far, for the ``complete`` or ``update`` output mode."""
    return confusion(stream, by)


def windowed_metrics(stream: DataFrame, ts: str, by: Sequence[str], length: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """Classification metrics of each tumbling window of event time, closed by the watermark."""
    timed = stream.withWatermark(ts, late).withColumn("window", F.window(ts, length))
    return confusion(timed, ["window", *by]).select("window", *by, *[c.alias(n) for n, c in from_confusion().items()])
