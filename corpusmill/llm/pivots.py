"""Embedding near-duplicates by a pivot-permutation index.

A bounded sample of vectors serves as pivots. Each vector is described by its nearest pivots in order
(the head of its permutation). Close vectors see nearly the same pivots, so candidates are vectors of
one label that share at least ``SHARED`` of their ``NEAREST`` pivots. The inverted lists are kept by
combinations of ``SHARED`` pivots: a vector is posted under each combination of its own, two vectors
meet exactly if their shared-pivot count reaches ``SHARED``, and they are counted in the first
combination that both have. What meets is verified by its exact cosine.

Equal vectors of one label are folded first and stand for all of their rows. The lists hold names of
vectors; only those in a list of two or more, one or two lists a vector, get their components joined. A list
with more than ``BLOCK`` vectors is dealt out as pairs of blocks, each its own unit of work, so a crowded list
is shared by many tasks. A unit sends on, for each vector, how many rows it linked with and a spanning forest
of the links, never all pairs. The number of pivots grows with the fourth root of that of the vectors, so that
lists grow more slowly than the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import Components, attach, durable, frequent
from corpusmill.llm.graph import components
from corpusmill.llm.vectors import matrix, usable

THRESHOLD = 0.98
PIVOTS, PIVOTS_AT, MOST_PIVOTS = 128, 100_000, 4096
NEAREST = 6
#: Of so many pivots on fewer shared ones are asked for: lists are as short then, and near vectors still meet.
SHARED, SHARED_OF_MANY, MANY_PIVOTS = 4, 3, 256
BLOCK = 1024


def pivot_count(n: int) -> int:
    return min(MOST_PIVOTS, max(PIVOTS, round(PIVOTS * (n / PIVOTS_AT) ** 0.25)))


def shared_count(pivots: int) -> int:
    """How many of their nearest pivots two vectors must share.

    More pivots lie closer together, so two near vectors agree on fewer of them; but sets of three out of 257 or more
    are about as many as sets of four out of 128.
    """
    return SHARED if pivots <= MANY_PIVOTS else SHARED_OF_MANY


def choose_pivots(vectors: DataFrame, count: int = PIVOTS) -> list[np.ndarray]:
    """At most ``count`` unit vectors, spread by hash (an action that reads at most ``count`` rows back)."""
    picked = vectors.select("fold", "v").orderBy(F.xxhash64("fold"), "fold").limit(count).collect()
    return [_scaled(pa.array([r["v"]], pa.list_(pa.float64())))[0] for r in picked]


def _scaled(column: pa.Array) -> np.ndarray:
    """Rows as unit vectors; scaled by the largest component first, so that no square overflows."""
    x = matrix(column, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _permutations(pivots: list[np.ndarray], nearest: int):
    """(fold, ..., v) -> (fold, label, dim, near): numbers of the nearest pivots in ascending order."""
    of_width = {d: np.flatnonzero([len(p) == d for p in pivots]) for d in {len(p) for p in pivots}}
    stacked = {d: np.array([pivots[k] for k in at]) for d, at in of_width.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            widths = pc.list_value_length(b.column("v")).to_numpy(zero_copy_only=False)
            near = np.zeros((len(widths), min(nearest, len(pivots))), dtype=np.int32)
            for d in np.unique(widths).tolist():
                rows = np.flatnonzero(widths == d)
                close = np.full((len(rows), len(pivots)), -np.inf)
                if d in stacked:
                    close[:, of_width[d]] = _scaled(b.column("v").take(pa.array(rows))) @ stacked[d].T
                near[rows] = np.sort(np.argsort(-close, axis=1, kind="stable")[:, : near.shape[1]], axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(near) + 1) * near.shape[1], pa.int32()), pa.array(near.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("fold"), b.column("label"), pa.array(widths, pa.int32()), lists], ["fold", "label", "dim", "near"])

    return run


def _first_shared(near: np.ndarray, a: np.ndarray, b: np.ndarray, shared: int) -> np.ndarray:
    """For pairs of rows of ``near`` (sorted pivot numbers): the ``shared`` smallest numbers both have, packed."""
    x, y = near[a], near[b]
    common = (x[:, :, None] == y[:, None, :]).any(axis=2)
    rank = np.cumsum(common, axis=1)
    out = np.zeros(len(a), dtype=np.int64)
    for k in range(1, min(shared, near.shape[1]) + 1):
        hit = common & (rank == k)
        out = out << 16 | np.where(hit.any(axis=1), np.take_along_axis(x, hit.argmax(axis=1)[:, None], 1)[:, 0], 0xFFFF)
    return out


def _verify(threshold: float, shared: int, block: int):
    """Per unit: rows linked with each vector and spanning links, as (fold, other, n); other is null for counts."""
    key_names = ["label", "dim", "combo", "i", "j"]

    def unit(key: tuple, rows: pa.Table) -> pa.RecordBatch | None:
        _, _, combo, i, j = key
        if rows.num_rows < 2:
            return None
        rows = rows.combine_chunks()
        flat = lambda c: rows[c].combine_chunks() if isinstance(rows[c], pa.ChunkedArray) else rows[c]
        fold, weight, first = flat("fold").to_numpy(), flat("n").to_numpy(), flat("block").to_numpy() == i
        x, near = _scaled(flat("v")), matrix(flat("near"), np.int64)
        linked, groups = np.zeros(len(fold), dtype=np.int64), Components(len(fold))
        for at in range(0, len(fold), block):
            a, b = np.nonzero(x[at : at + block] @ x.T >= threshold)
            a += at
            keep = (a < b) if i == j else first[a] & ~first[b]
            a, b = a[keep], b[keep]
            own = _first_shared(near, a, b, shared) == combo
            a, b = a[own], b[own]
            np.add.at(linked, a, weight[b])
            np.add.at(linked, b, weight[a])
            groups.link(a, b)
        some, tied = np.flatnonzero(linked), np.flatnonzero(groups.root != np.arange(len(fold)))
        if not len(some):
            return None
        other = pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(fold[groups.root[tied]])])
        counts = np.r_[linked[some], np.zeros(len(tied), dtype=np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(np.r_[fold[some], fold[tied]]), other, pa.array(counts)], ["fold", "other", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(c).to_numpy() for c in key_names], axis=1)
            starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
            for at, end in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)]):
                key = tuple(keys[at].tolist())
                if key != now:
                    if held and (made := unit(now, pa.Table.from_batches(held))) is not None:
                        yield made
                    now, held = key, []
                held.append(b.slice(at, end - at))
        if held and (made := unit(now, pa.Table.from_batches(held))) is not None:
            yield made

    return run


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD, nearest: int = NEAREST, shared: int | None = None, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``embeddings`` (vec_id, embedding, label).

    Vectors of equal, non-null label link if their cosine, in double precision, is at least ``threshold``
    and they share ``shared`` of their ``nearest`` pivots, by default as ``shared_count`` says (recall at the
    threshold is measured in the tests, for every number of pivots). Vectors that are null,
    empty, zero or hold null or non-finite components, and those without a label, link with nothing, and
    vectors of different length never link. Repeated rows are separate vectors with one id: each counts as
    a link of the other. A null vec_id takes part but is never the smallest id of a component. Vectors of any
    length are taken whole; an empty table gives an empty one; other columns are not read.
    """
    wide = embeddings.schema["embedding"].dataType.simpleString() != "array<float>"
    v = F.col("embedding").cast("array<double>") if wide else F.col("embedding")
    ok = usable() & F.col("label").isNotNull() & F.exists(F.coalesce("embedding", F.array().cast("array<double>")), lambda x: x != 0)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), F.col("label").cast("long").alias("label"), F.coalesce(ok, F.lit(False)).alias("ok"))
    # two 64-bit hashes name a folded vector; -0.0 and 0.0 are one number
    clean = F.transform("v", lambda x: x.cast("double") + F.lit(0.0))
    good = rows.where("ok").select("vec_id", "label", "v", F.xxhash64("label", clean).alias("fold"), F.xxhash64(clean, "label", F.lit(1)).alias("h2"))
    folds = good.groupBy("fold", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"), F.first("label").alias("label"), F.first("v").alias("v"))
    folds = durable(folds)
    pivots = choose_pivots(folds, pivot_count(folds.count()))
    shared = shared_count(len(pivots)) if shared is None else shared
    described = durable(folds.select("fold", "label", "v").mapInArrow(_permutations(pivots, nearest), "fold long, label long, dim int, near array<int>"))
    width = min(nearest, len(pivots))
    packed = []
    for c in combinations(range(width), min(shared, width)):
        code = F.lit(0).cast("long")
        for k in c:
            code = F.shiftleft(code, 16) + F.element_at(F.col("near"), k + 1)
        packed.append(code)
    keys = ["label", "dim", "combo"]
    posted = described.select("fold", "label", "dim", F.explode(F.array(*packed) if packed else F.array(F.lit(0).cast("long"))).alias("combo"))
    lists = posted.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    met = attach(posted, lists, keys, frequent(lists)).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    met = met.withColumn("block", F.pmod(F.xxhash64("fold", F.lit(5)), F.col("blocks")).cast("int")).drop("n")
    met = met.join(described.select("fold", "near"), "fold").join(folds.select("fold", "n", "v"), "fold")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    units = met.select("*", other).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    keys = [*keys, "i", "j"]
    units = units.select(*keys, "block", "fold", "n", "v", "near")
    found = durable(units.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_verify(threshold, shared, block), "fold long, other long, n long"))
    links = found.where("other is null").groupBy("fold").agg(F.sum("n").alias("links"))
    joined = components(found.where("other is not null").select(F.col("fold").alias("u"), F.col("other").alias("v")))
    labelled = folds.select("fold", "h2", "n", "least").join(joined.withColumnRenamed("node", "fold").withColumnRenamed("label", "root"), "fold", "left").withColumn("root", F.coalesce("root", "fold"))
    groups = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    per_fold = durable(labelled.join(groups, "root").join(links, "fold", "left").select("fold", "h2", "n", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"))
    out = attach(good.select("vec_id", "fold", "h2"), per_fold, ["fold", "h2"], frequent(per_fold)).select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    alone = rows.where("NOT ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
