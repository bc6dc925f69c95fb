"""Exact top-k by inner product with a three-phase uniform threshold.

The dimensions are dealt to ``LISTS`` groups; a score is the sum of its groups' local scores, and each task has
a local score list for each group of its candidates' dimensions. Phase 1: of each local list the HEADS * k
highest are taken and resolved, and a task sends its k best; the k-th best of all is a cutoff that the true k-th cannot fall
below. Phase 2: the cutoffs are broadcast; an entry none of whose local scores reaches cutoff / LISTS cannot
reach the cutoff, so only entries at or above that in some list are collected, and of these only those whose
seen local scores, with the least of cutoff / LISTS and the product of the norms for every unseen one, could
still reach it. Phase 3: what is left is resolved exactly, and a task sends its k best.

Candidates stay where they are read. The queries go to them in blocks of at most some ``QUERY_BLOCK`` rows by
broadcast, so no more is shuffled than k rows a query and task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import durable
from corpusmill.llm.vectors import matrix, usable

K = 10
SCALE = 1024
LISTS = 2
HEADS = 8
QUERY_BLOCK = 8192
AT_ONCE = 1_000_000
LEAST = np.iinfo(np.int64).min
SCHEMA = "query_id long, vec_id long, score long, resolved long"


def quantised(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): usable vectors as floor(scale * x), x as double."""
    good = embeddings.where(usable())
    v = F.transform(F.col("embedding"), lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return good.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def _product(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer products; through doubles where every partial sum is below 2**53."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if top < 2**53:
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    return q @ x.T


class Best:
    """The k highest (score, id) of each query, ties to the smaller id; a missing one has the score LEAST."""

    def __init__(self, n: int, k: int) -> None:
        self.score, self.ids = np.full((n, k), LEAST), np.zeros((n, k), dtype=np.int64)
        self.resolved = np.zeros(n, dtype=np.int64)

    def merge(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """``score`` and ``ids`` hold a line of new entries for each of ``rows``."""
        score, ids = np.hstack([self.score[rows], score]), np.hstack([self.ids[rows], ids])
        order = np.lexsort((ids, ~score), axis=1)[:, : self.score.shape[1]]
        self.score[rows], self.ids[rows] = np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)

    def table(self, queries: np.ndarray) -> pa.RecordBatch:
        at, k = np.nonzero(self.score != LEAST)
        columns = (queries[at], self.ids[at, k], self.score[at, k], np.where(k == 0, self.resolved[at], 0))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score", "resolved"])


def _groups(width: int, lists: int) -> list[np.ndarray]:
    return np.array_split(np.arange(width), min(lists, width))


def _heads(local: list[np.ndarray], others: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the k highest of each local list, each once, and the exact scores there; a query a line."""
    heads = []
    for part in local:
        part = np.where(others, part, LEAST)
        heads.append(np.argpartition(part, -k, axis=1)[:, -k:] if part.shape[1] > k else np.broadcast_to(np.arange(part.shape[1]), part.shape))
    at = np.sort(np.hstack(heads), axis=1)
    again = np.c_[np.zeros((len(at), 1), dtype=bool), at[:, 1:] == at[:, :-1]]
    score = sum(np.take_along_axis(part, at, 1) for part in local)
    return at, np.where(again | ~np.take_along_axis(others, at, 1), LEAST, score)


def _left(local: list[np.ndarray], others: np.ndarray, cutoff: np.ndarray, most: np.ndarray) -> np.ndarray:
    """True for the entries that could reach the cutoff of their query; ``most`` bounds each local score from above."""
    seen = [part * len(local) >= cutoff[:, None] for part in local]
    could = sum(np.where(s, part, np.minimum(cutoff[:, None] / len(local), m)) for s, part, m in zip(seen, local, most))
    return np.logical_or.reduce(seen) & others & (could >= cutoff[:, None] - 1e-6 * np.maximum(1, np.abs(cutoff[:, None])))


def _phase(queries, k: int, lists: int, cutoffs=None):
    """Phase 1 without cutoffs, phases 2 and 3 with them: the k best entries of a task for every query.

    ``queries`` is a broadcast of {dimensions: (ids, vectors)}, ``cutoffs`` one of {dimensions: a cutoff for each,
    or LEAST}.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {d: Best(len(ids), k) for d, (ids, _) in queries.value.items()}
        for b in batches:
            widths = pc.list_value_length(b.column("v")).to_numpy(zero_copy_only=False)
            for d in np.unique(widths).tolist():
                if d not in best:
                    continue
                some = b.filter(pa.array(widths == d))
                x, ids, (asked, q) = matrix(some.column("v"), np.int64), some.column("vec_id").to_numpy(), queries.value[d]
                step = max(1, AT_ONCE // len(ids))
                norms = [np.sqrt((x[:, g].astype(float) ** 2).sum(axis=1)) for g in _groups(d, lists)]
                for at in range(0, len(q), step):
                    rows = np.arange(at, min(at + step, len(q)))
                    local = [_product(q[rows][:, g], x[:, g]) for g in _groups(d, lists)]
                    others = asked[rows, None] != ids[None, :]
                    if cutoffs is None:
                        here, score = _heads(local, others, HEADS * k)
                        best[d].merge(rows, score, ids[here])
                        continue
                    cutoff = cutoffs.value[d][rows]
                    most = [np.sqrt((q[rows][:, g].astype(float) ** 2).sum(axis=1))[:, None] * n[None, :] for g, n in zip(_groups(d, lists), norms)]
                    keep = np.where(cutoff[:, None] == LEAST, others, _left(local, others, np.maximum(cutoff, -(1 << 61)), most))
                    best[d].resolved[rows] += keep.sum(axis=1)
                    width = int(keep.sum(axis=1).max(initial=0))
                    here = np.argsort(~keep, axis=1, kind="stable")[:, :width]
                    score = np.where(np.take_along_axis(keep, here, 1), sum(np.take_along_axis(part, here, 1) for part in local), LEAST)
                    best[d].merge(rows, score, ids[here])
        for d, found in best.items():
            yield found.table(queries.value[d][0])

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k_counted(embeddings: DataFrame, queries: Column, k: int = K, scale: int = SCALE, lists: int = LISTS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``top_k`` with one more column, resolved: how many entries phase 3 resolved for the query, of all it met."""
    rows = durable(quantised(embeddings, scale).where(F.col("vec_id").isNotNull()))
    asked = durable(rows.where(queries).groupBy("vec_id").agg(F.min("v").alias("v")))
    blocks = max(1, -(-asked.count() // query_block))
    sc, out = embeddings.sparkSession.sparkContext, None
    for i in range(blocks):
        table = asked.where(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(blocks)) == i).toArrow().combine_chunks()  # some query_block rows
        widths = pc.list_value_length(table["v"]).to_numpy()
        sent = {}
        for d in np.unique(widths).tolist():
            part = table.filter(pa.array(widths == d)).combine_chunks()
            sent[d] = (part["vec_id"].to_numpy(), matrix(part["v"].combine_chunks(), np.int64))
        shared = sc.broadcast(sent)
        first = _ranked(rows.mapInArrow(_phase(shared, k, lists), SCHEMA), k).where(F.col("rank") == k).select("query_id", "score")
        known = dict(first.toArrow().to_pandas().itertuples(index=False))  # a row a query of the block
        cutoffs = sc.broadcast({d: np.array([known.get(x, LEAST) for x in ids.tolist()], dtype=np.int64) for d, (ids, _) in sent.items()})
        found = rows.mapInArrow(_phase(shared, k, lists, cutoffs), SCHEMA)
        summed = found.withColumn("resolved", F.sum("resolved").over(Window.partitionBy("query_id")))
        ranked = _ranked(summed, k).select("query_id", "rank", "vec_id", "score", "resolved")
        out = ranked if out is None else out.unionByName(ranked)
    return out


def top_k(embeddings: DataFrame, queries: Column, k: int = K, scale: int = SCALE, lists: int = LISTS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products for each row picked by ``queries``.

    ``queries`` is a condition on vec_id. Candidates are all usable rows of the query's length but those
    with its own vec_id; fewer than k of them are all returned. Ties go to the smaller vec_id. Null vec_ids
    take no part. Rows that repeat a vec_id are candidates one by one and are asked once, as the least of
    their vectors. Products must fit a 64-bit integer. Vectors of any length are taken whole; an empty table
    gives an empty one; only vec_id and embedding are read. Actions find the cutoffs, one for each block of
    queries.
    """
    return top_k_counted(embeddings, queries, k, scale, lists).select("query_id", "rank", "vec_id", "score")
