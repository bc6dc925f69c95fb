"""Content hashes of columns, tables and configuration values."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.lineage import cut


def sha256(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def sha256_json(value: Any) -> str:
    """Hash of a value's JSON form with sorted keys."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def table_hash(df: DataFrame, order: str | None = None) -> DataFrame:
    """One row (n, digest) for all rows of ``df``; with ``order`` its value is bound to each row's place.

    Row hashes are folded by addition of two halves, which partial aggregation combines, so no task sees
    all rows. The digest belongs to this library and compares with nothing else.
    """
    columns = sorted(c for c in df.columns)
    row = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns], *([F.col(order)] if order else []))
    low, high = row.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(row, 32)
    folded = df.select(low.cast("decimal(20,0)").alias("a"), high.cast("decimal(20,0)").alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    return folded.select("n", F.sha2(F.concat_ws("|", F.col("n").cast("string"), F.col("a").cast("string"), F.col("b").cast("string")), 256).alias("digest"))


# --- hash tree over ranges of a key -----------------------------------------------------------

#: A leaf covers 2**10 keys, a node 2**10 nodes of the level below; the one node of the last level covers all keys.
RANGE_BITS, LEVELS = 10, 7


def row_digest(columns: list[str]) -> Column:
    """SHA-256 of a row: the columns by name, each as null, or as its length and its text."""
    part = lambda c: F.when(F.col(c).isNull(), "N").otherwise(F.concat(F.octet_length(F.col(c).cast("string")), F.lit(":"), F.col(c).cast("string")))
    return F.sha2(F.concat(*[part(c) for c in sorted(columns)]), 256)


def _node(key: Column, level: int) -> Column:
    """The node of a key: shifted by the bits of the levels below; all keys share the last level's."""
    return F.lit(0).cast("long") if level == LEVELS - 1 else F.shiftright(key, RANGE_BITS * (level + 1))


def hash_tree(df: DataFrame, key: str) -> DataFrame:
    """(level, node, n, digest): hashes of ranges of an integer key, from ranges of 1,024 keys (level 0) to all rows.

    A leaf adds up pieces of its rows' digests, which partial aggregation combines, so a key of any number of rows
    burdens no task; nodes above hash the list of their at most 1,024 children. The key is part of a row's
    digest, so its place counts. Rows without a key count as the smallest one. An empty table has no nodes. Anyone
    can work the digests out again: see the oracle of ``hash_table``.
    """
    at = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))
    rows = df.select(_node(at, 0).alias("node"), row_digest(df.columns).alias("h"))
    pieces = [F.sum(F.conv(F.substring("h", 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)")).cast("string") for k in range(4)]
    level = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.sha2(F.concat_ws("|", F.count(F.lit(1)).cast("string"), *pieces), 256).alias("digest"))
    out = level = cut(level.select(F.lit(0).alias("level"), "node", "n", "digest"))
    for k in range(1, LEVELS):
        above = F.lit(0).cast("long") if k == LEVELS - 1 else F.shiftright("node", RANGE_BITS)
        children = F.transform(F.array_sort(F.collect_list(F.struct("node", "digest"))), lambda c: F.concat(c["node"].cast("string"), F.lit(":"), c["digest"]))  # at most 1,024
        level = level.groupBy(above.alias("node")).agg(F.sum("n").alias("n"), F.sha2(F.array_join(children, "|"), 256).alias("digest"))
        level = level.select(F.lit(k).alias("level"), "node", "n", "digest")
        out = out.unionByName(level)
    return out


def differing_ranges(left: DataFrame, right: DataFrame) -> DataFrame:
    """(low, high, n_left, n_right): the ranges of 1,024 keys in which the tables of two hash trees differ.

    The trees are compared from the top, and only children of nodes that differ are looked at, so stored trees
    are enough: the tables themselves are not read.
    """
    of = lambda tree, k, side: tree.where(F.col("level") == k).select("node", F.col("n").alias(f"n_{side}"), F.col("digest").alias(f"digest_{side}"))
    found = None
    for k in reversed(range(LEVELS)):
        both = of(left, k, "left").join(of(right, k, "right"), "node", "full").where(~F.col("digest_left").eqNullSafe(F.col("digest_right")))
        if found is not None:
            above = F.lit(0).cast("long") if k == LEVELS - 2 else F.shiftright("node", RANGE_BITS)
            both = both.withColumn("above", above).join(found.select(F.col("node").alias("above")), "above", "left_semi").drop("above")
        found = both
    low = F.shiftleft("node", RANGE_BITS)
    return found.select(low.alias("low"), low.bitwiseOR(F.lit((1 << RANGE_BITS) - 1)).alias("high"), *[F.coalesce(f"n_{s}", F.lit(0)).cast("long").alias(f"n_{s}") for s in ("left", "right")])


def directory_hash(files: DataFrame, root: str) -> DataFrame:
    """(n_files, n_bytes, digest) of a ``binaryFile`` frame: the hash of its sorted ``relative path, tab, file hash`` lines.

    Hidden files, below ``root`` only, are skipped. The list has one short line for each file.
    """
    relative = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/+", "/"), "^" + root.rstrip("/") + "/", "")
    named = files.select(relative.alias("path"), F.sha2("content", 256).alias("sha"), F.length("content").alias("size"))
    shown = named.where(~F.col("path").rlike(r"(^|/)\."))
    lines = F.array_sort(F.collect_list(F.concat(F.col("path"), F.lit("\t"), F.col("sha"))))
    return shown.agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("n_bytes"), F.sha2(F.array_join(lines, "\n"), 256).alias("digest"))
