"""Cutting the lineage of a frame that is read more than once or built in rounds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[str] = []


def scratch(spark: SparkSession) -> str:
    """The shared folder ``spark.checkpoint.dir`` of the session; a local master that names none gets one made up."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
        folder = tempfile.mkdtemp(prefix="corpusmill-")
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a table written to the shared folder and read back (an action).

    A lost executor costs nothing afterwards. Unlike a checkpoint, which passes on the estimates of the plan
    that it replaces, a table has its own size: those of a chain of joins multiply round by round until the
    planner does nothing but arithmetic. The table stays until ``release`` or until the folder is emptied.
    """
    path = stored(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(spark: SparkSession) -> str:
    """A path in the shared folder for a table that is written in several parts; ``release`` deletes it as those of ``cut``."""
    path = f"{scratch(spark)}/cut-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def written() -> int:
    """How many tables ``cut`` has written so far: a mark for ``release``."""
    return len(_WRITTEN)


def release(spark: SparkSession, since: int = 0) -> None:
    """Delete the tables that ``cut`` has written after the mark; call it once all that was built on them is stored elsewhere."""
    while len(_WRITTEN) > since:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
