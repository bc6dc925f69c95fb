"""Deterministic train, validation and test splits: stratified, source-disjoint and temporal.

Membership follows from hashes of the seed and the row's id, so it does not depend on partitioning.
Parts are numbered and totalled by order-preserving buckets, so no task sees a whole class.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.numbering import hex_bucket, positions, running_total, time_bucket

SEEDS = [13, 42, 123, 2024, 3407]
TIMESTAMP_COLUMNS = ["date", "timestamp", "published", "publish_date", "created_at"]
PARTS = ["train", "val", "test"]
MISSING_SOURCE = "__MISSING_SOURCE__"


def part_sizes(n: Column) -> tuple[Column, Column, Column]:
    """Rows of train, val and test out of n: 30 % held out, rounded up, half of it, rounded up, as test."""
    held = F.ceil(F.lit(0.15 + 0.15) * n)
    test = F.ceil(F.lit(0.5) * held)
    return (n - held).cast("long"), (held - test).cast("long"), test.cast("long")


def _quotas(classes: DataFrame, sizes: Sequence[Column]) -> DataFrame:
    """(label, q_train, q_val, q_test): largest-remainder shares of each part, ties to the smaller label.

    ``classes`` has one row for each label, so its windows are small.
    """
    whole = Window.partitionBy()
    total = F.sum("n").over(whole)
    out = classes.withColumn("total", total)
    left = F.col("n")
    for part, size in zip(PARTS, sizes):
        if part == "test":
            out = out.withColumn("q_test", left)
            break
        pool = F.col("total") if part == "train" else F.sum("left").over(whole)
        out = out.withColumn("left", left)
        exact = F.col("left") * size / F.nullif(pool, F.lit(0))
        out = out.withColumn("exact", F.coalesce(exact, F.lit(0.0))).withColumn("base", F.floor("exact"))
        missing = size - F.sum("base").over(whole)
        rank = F.row_number().over(whole.orderBy(F.round(F.col("base") - F.col("exact"), 9), "label"))
        out = out.withColumn(f"q_{part}", F.col("base") + F.when(rank <= missing, 1).otherwise(0))
        left = F.col("left") - F.col(f"q_{part}")
    return out.select("label", "q_train", "q_val", "q_test")


def stratified(df: DataFrame, seed: int, key: str = "uid") -> DataFrame:
    """(row_pos, part): 70/15/15 with class shares kept, by the order of sha2(seed:key) within each class."""
    rows = df.select("row_pos", "label", F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256).alias("h"))
    classes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    quotas = _quotas(classes, part_sizes(F.col("total"))).withColumnRenamed("label", "__label")
    placed = positions(rows, ["h", "row_pos"], hex_bucket("h"), ["label"], "k").join(quotas, F.col("label").eqNullSafe(F.col("__label")))
    part = F.when(F.col("k") < F.col("q_train"), "train").when(F.col("k") < F.col("q_train") + F.col("q_val"), "val").otherwise("test")
    return placed.select("row_pos", part.alias("part"))


def source_disjoint(df: DataFrame, seed: int, source: str = "source") -> DataFrame:
    """(row_pos, part): whole sources, in hash order, go to train until it holds 70 % of the rows, then val, then test.

    A part that is not yet full takes a source whole, so it may overshoot. Rows without a source form one
    group. Val starts to fill only after train; what the running totals say decides, without a loop.
    """
    rows = df.select("row_pos", F.coalesce(F.col(source).cast("string"), F.lit(MISSING_SOURCE)).alias("src"))
    groups = rows.groupBy("src").agg(F.count(F.lit(1)).alias("size")).withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("src")), 256))
    total = groups.agg(F.sum("size").alias("total"))
    ran = running_total(groups, ["h", "src"], hex_bucket("h"), F.col("size")).crossJoin(F.broadcast(total))  # one row
    to_train = F.col("before") < F.floor(F.col("total") * 0.7)
    train = ran.agg(F.coalesce(F.sum(F.when(to_train, F.col("size"))), F.lit(0)).alias("n_train"))
    ran = ran.crossJoin(F.broadcast(train))  # one row
    to_val = F.col("before") - F.col("n_train") < F.floor(F.col("total") * 0.15)
    part = F.when(to_train, "train").when(to_val, "val").otherwise("test")
    return rows.join(ran.select("src", part.alias("part")), "src").select("row_pos", "part")


def temporal(df: DataFrame, ts: str = "ts") -> DataFrame:
    """(row_pos, part): the earliest 70 % are train, the next 15 % val; rows without a time come last."""
    rows = positions(df.select("row_pos", F.col(ts).alias("ts")), [F.asc_nulls_last("ts"), "row_pos"], time_bucket("ts"), (), "k")
    n = df.agg(F.count(F.lit(1)).alias("n"))
    first, second = F.round(F.col("n") * 0.7), F.round(F.col("n") * 0.85)
    part = F.when(F.col("k") < first, "train").when(F.col("k") < second, "val").otherwise("test")
    return rows.crossJoin(F.broadcast(n)).select("row_pos", part.alias("part"))  # n is one row


def timestamp_column(df: DataFrame, names: Sequence[str] = TIMESTAMP_COLUMNS) -> str | None:
    """The first column, whatever its case, that has one of the names."""
    have = {c.lower(): c for c in df.columns}
    return next((have[n] for n in names if n in have), None)


def recoverable_source(entry: dict, columns: Sequence[str]) -> tuple[bool, str]:
    """Whether sources can be told apart, and why."""
    field = entry.get("source_field_available", False)
    if not field:
        return False, "no publisher field in the snapshot"
    if field is True:
        return "source" in columns, "publisher field present" if "source" in columns else "publisher field is not carried along"
    return (field in columns), f"only {field!r} is available, which is no publisher" if field not in columns else f"uses {field!r}"


def all_regimes(df: DataFrame, seeds: Sequence[int] = SEEDS, source: str | None = None, ts: str | None = None) -> DataFrame:
    """(dataset_id, regime, seed, part, row_pos) of one dataset for every regime its columns allow."""
    def tag(split: DataFrame, regime: str, seed: int) -> DataFrame:
        return split.select(F.lit(regime).alias("regime"), F.lit(seed).alias("seed"), "part", "row_pos")

    made = [tag(stratified(df, s), "S-RAND", s) for s in seeds]
    if source:
        made += [tag(source_disjoint(df, s, source), "S-SRC", s) for s in seeds]
    if ts:
        made += [tag(temporal(df, ts), "S-TEMP", s) for s in seeds]
    dataset = df.select("dataset_id").limit(1)
    return reduce(DataFrame.unionByName, made).crossJoin(F.broadcast(dataset)).select("dataset_id", "regime", "seed", "part", "row_pos")  # one row


def partition_check(split: DataFrame, n: DataFrame, by: Sequence[str] = ("dataset_id", "regime", "seed")) -> DataFrame:
    """Per split: whether its parts are disjoint and cover 0..n-1 of ``n`` (dataset_id, n)."""
    got = split.groupBy(*by, "row_pos").agg(F.count(F.lit(1)).alias("k")).groupBy(*by).agg(
        F.count(F.lit(1)).alias("distinct"), F.sum("k").alias("rows"), F.min("row_pos").alias("low"), F.max("row_pos").alias("high")
    )
    ok = (F.col("rows") == F.col("n")) & (F.col("distinct") == F.col("n")) & (F.col("low") == 0) & (F.col("high") == F.col("n") - 1)
    return got.join(n, "dataset_id").select(*by, F.col("rows").alias("n_rows"), ok.alias("ok"))


def shared_sources(split: DataFrame, rows: DataFrame, source: str = "source") -> DataFrame:
    """Sources that occur in more than one part: empty for a source-disjoint split."""
    joined = split.join(rows.select("row_pos", F.coalesce(F.col(source), F.lit(MISSING_SOURCE)).alias("src")), "row_pos")
    return joined.groupBy("src").agg(F.count_distinct("part").alias("parts")).where(F.col("parts") > 1)


def applicability(dataset_id: str, df: DataFrame, entry: dict) -> list[dict]:
    """One record for each regime: whether the dataset's columns support it."""
    ok, note = recoverable_source(entry, df.columns)
    ts = timestamp_column(df)
    return [
        {"dataset_id": dataset_id, "regime": "S-RAND", "applicable": True, "note": "labels only"},
        {"dataset_id": dataset_id, "regime": "S-SRC", "applicable": ok, "note": note},
        {"dataset_id": dataset_id, "regime": "S-TEMP", "applicable": ts is not None, "note": f"uses {ts!r}" if ts else "no timestamp column"},
    ]


def stratified_resample(df: DataFrame, seed: int, label: str = "label") -> DataFrame:
    """A bootstrap sample with the same class sizes: as many draws with replacement as each class has rows.

    Draw j of a class picks the row whose place in it, by hash of row_pos, is the 60-bit number that begins
    SHA-256 of seed:label:j, modulo the size of the class: a generator of counters, without state, that any
    engine can replay.
    """
    rows = positions(df.withColumn("__h", F.sha2(F.col("row_pos").cast("string"), 256)), ["__h", "row_pos"], hex_bucket("__h"), [label], "__k")
    size = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    counter = F.concat_ws(":", F.lit(str(seed)), F.col(label).cast("string"), F.col("__k").cast("string"))
    drawn = F.conv(F.substring(F.sha2(counter, 256), 1, 15), 16, 10).cast("long")
    draws = rows.join(size, label).select(F.col(label), F.pmod(drawn, F.col("__n")).alias("__k"))
    return draws.join(rows, [label, "__k"]).drop("__k", "__h").select(df.columns)
