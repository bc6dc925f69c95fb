"""Helpers that several corpus operators share."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.lineage import cut as durable  # noqa: F401  (the operators' name for it)

#: At most so many keys of a join are sent by broadcast.
HOT_KEYS = 1000


def frequent(keyed: DataFrame) -> int | None:
    """How many rows a key of ``keyed`` may have before a join should treat it apart; None if no key has more (an action).

    ``keyed`` has the number ``n`` of its rows with each key. The limit is a HOT_KEYS-th of all rows, so fewer
    than HOT_KEYS keys pass it, whatever the size of the table.
    """
    total, most = keyed.agg(F.sum("n"), F.max("n")).first()
    limit = max((total or 0) // HOT_KEYS, 16)
    return limit if (most or 0) > limit else None


def attach(rows: DataFrame, keyed: DataFrame, keys: list[str], limit: int | None) -> DataFrame:
    """The inner join of ``rows`` and ``keyed`` on ``keys``, without one task for all rows of a frequent key.

    ``keyed`` has each key once, with the number ``n`` of its rows. Keys with more than ``limit`` rows (see
    ``frequent``) are joined by broadcast, the others are shuffled; without a limit this is a plain join. Both
    inputs are read twice, so they should be cheap to read.
    """
    if limit is None:
        return rows.join(keyed, keys)
    hot = keyed.where(F.col("n") > limit)
    crowded = rows.join(F.broadcast(hot), keys)
    calm = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(keyed.where(F.col("n") <= limit), keys)
    return crowded.unionByName(calm)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, th, text): ``th`` tells apart different texts that share a doc_id; null texts get one too."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("th"),
        F.col("text").cast("string").alias("text"),
    )


def once(docs: DataFrame) -> DataFrame:
    """(doc_id, th, text) with rows that repeat both doc_id and text folded to one.

    Only rows that repeat are shuffled. The table of what repeats is written first, so the planner knows its
    size when it picks a join.
    """
    rows = doc_rows(docs)
    again = durable(rows.groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("id"), F.col("th").alias("own")))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("th") == F.col("own"))
    folded = rows.join(again, same, "left_semi").groupBy("doc_id", "th").agg(F.first("text").alias("text"))
    return rows.join(again, same, "left_anti").unionByName(folded)


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def task_done(*caches: dict) -> None:
    """Give back what a Python worker held for one task: workers live on, and the stages after share their memory.

    Arrow's pool and the C library both keep what is freed; where the latter can be told to return it, it is.
    """
    for c in caches:
        c.clear()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def words_of(text: str | None) -> list[bytes]:
    """Runs of anything but U+0020 and U+0009 to U+000D, as UTF-8; bytes.split() cuts at exactly those."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").split()


class Components:
    """Union-find over positions 0..n-1 that takes links as arrays and keeps the smallest position as root."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        ra, rb = self.root[a], self.root[b]
        differ = ra != rb
        if not differ.any():
            return
        pairs = np.unique(np.stack([ra[differ], rb[differ]], 1), axis=0)
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            top = x
            while parent.get(top, top) != top:
                top = parent[top]
            while parent.get(x, x) != top:
                parent[x], x = top, parent[x]
            return top

        for x, y in pairs.tolist():
            x, y = find(x), find(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if parent:
            old = np.fromiter(parent, dtype=np.int64, count=len(parent))
            to = np.arange(len(self.root))
            to[old] = [find(x) for x in old.tolist()]
            self.root = to[self.root]
