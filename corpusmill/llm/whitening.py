"""Whitening of embeddings: a randomised range finder with power passes, then Rayleigh-Ritz.

Vectors become whole numbers, so the sums over all of them are exact. The covariance V is never formed unless it
has to be: a pass over all centred rows multiplies it by a narrow orthonormal basis Q (components + oversampling
columns), each task adding up its rows' share of V Q. Repeating the pass turns Q towards the leading eigenvectors;
the small matrix Q'VQ gives Ritz vectors and their residuals at no further pass. Once every residual is small
against the distance to the next Ritz value, these are the components. Where the spectrum is too flat for
that (the residuals shrink too slowly for the passes left), the basis is expanded to all dimensions, and one
more pass makes Rayleigh-Ritz exact.

The driver holds matrices of width x basis numbers, whatever the number of rows; rows stay where they are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import durable
from corpusmill.llm.vectors import matrix, usable

COMPONENTS = 8
OVERSAMPLING = 8
POWER_PASSES = 12
RESIDUAL = 1e-11
SCALE, SHIFT = 1024, 100_000
LARGEST = float(1 << 45)
ENTRIES_AT_ONCE = 1 << 20
BLOCK = 16
SEED = 13
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole_numbers(c: np.ndarray) -> np.ndarray:
    """floor(1024 * c) + 100000; entries beyond 2**45 of it in size count as that."""
    return np.clip(np.floor(SCALE * c), -LARGEST, LARGEST).astype(np.int64) + SHIFT


@dataclass(frozen=True)
class Centre:
    """The exact mean of n rows: ``base`` whole and ``rest`` / n."""

    n: int
    base: np.ndarray
    rest: np.ndarray

    @classmethod
    def of(cls, n: int, sums: list[int]) -> Centre:
        return cls(n, np.array([s // n for s in sums], dtype=np.int64), np.array([s % n for s in sums], dtype=np.int64))

    def from_mean(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base).astype(np.float64) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """For each row the exact sum of (n * x - sum)**2, None where it is beyond a long."""
        y, rest = x - self.base, self.rest
        top = int(np.abs(y).max(initial=0))
        if top * max(top, int(rest.max(initial=0))) * y.shape[1] >= 1 << 62:
            y, rest = y.astype(object), rest.astype(object)
        squares, cross, last = (y * y).sum(axis=1), (y * rest).sum(axis=1), sum(int(r) ** 2 for r in self.rest)
        exact = (self.n**2 * int(a) - 2 * self.n * int(b) + last for a, b in zip(squares, cross, strict=True))
        return [v if v < 1 << 63 else None for v in exact]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and whole-number vectors of bounded runs of rows."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            step = max(1, ENTRIES_AT_ONCE // max(1, len(batch["v"][at])))
            part = batch.slice(at, step)
            yield part["vec_id"], whole_numbers(matrix(part["v"], np.float64))
            at += step


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per width of this task's vectors: the number of rows and the sum of each dimension, as digits."""
    total: dict[int, list] = {}
    for batch in batches:
        size = batch["v"].value_lengths().to_numpy(zero_copy_only=False)
        for width in np.unique(size).tolist():
            for _, x in _slices(iter([batch.filter(pa.array(size == width))])):
                have = total.setdefault(width, [0, np.zeros(width, dtype=object)])
                have[0] += len(x)
                have[1] += x.sum(axis=0)
    rows = [(w, j, n, str(s)) for w, (n, sums) in total.items() for j, s in enumerate(sums.tolist())]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ([],) * 4, (pa.int32(), pa.int32(), pa.int64(), pa.string()), strict=True)], ["width", "j", "n", "total"])


def _usable(embeddings: DataFrame) -> DataFrame:
    return embeddings.where(usable()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))


def _added_up(partial: DataFrame, rows: int, columns: int) -> np.ndarray:
    """The sum over tasks of a matrix that each sends in pieces (j, block, v) of a row."""
    sums = partial.groupBy("j", "block").agg(F.array(*[F.sum(F.col("v")[k]) for k in range(BLOCK)]).alias("v"))
    out = np.zeros((rows, -(-columns // BLOCK) * BLOCK))
    for r in sums.collect():
        out[r["j"], r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = r["v"]
    return out[:, :columns]


def _pieces(total: np.ndarray) -> pa.RecordBatch:
    rows, columns = total.shape
    blocks = -(-columns // BLOCK)
    padded = np.zeros((rows, blocks * BLOCK))
    padded[:, :columns] = total
    return pa.RecordBatch.from_arrays([
        pa.array(np.repeat(np.arange(rows, dtype=np.int32), blocks)), pa.array(np.tile(np.arange(blocks, dtype=np.int32), rows)),
        pa.ListArray.from_arrays(pa.array(np.arange(0, padded.size + 1, BLOCK, dtype=np.int32)), pa.array(padded.ravel())),
    ], ["j", "block", "v"])


def covariance_times(vectors: DataFrame, centre: Centre, basis: np.ndarray) -> tuple[np.ndarray, float]:
    """V times ``basis``, and the trace of V, from one pass over all rows (an action)."""
    d, l = basis.shape
    sent = vectors.sparkSession.sparkContext.broadcast(basis)

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d + 1, l))
        for _, x in _slices(batches):
            y = centre.from_mean(x)
            total[:d] += y.T @ (y @ sent.value)
            total[d, 0] += np.einsum("ij,ij->", y, y)
        yield _pieces(total)

    out = _added_up(vectors.mapInArrow(share, "j int, block int, v array<double>"), d + 1, l) / centre.n
    sent.destroy()
    return out[:d], float(out[d, 0])


@dataclass(frozen=True)
class Whitening:
    """Unit components (a column each) with their eigenvalues, largest first."""

    centre: Centre
    components: np.ndarray
    values: np.ndarray
    trace: float
    passes: int
    expanded: bool

    def scales(self) -> np.ndarray:
        """1 / sqrt(eigenvalue); NaN for a direction without variance beyond rounding."""
        least = max(self.trace, 0.0) * len(self.components) * np.finfo(float).eps
        return np.where(self.values > least, 1 / np.sqrt(np.where(self.values > least, self.values, 1)), np.nan)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (self.centre.from_mean(x) @ self.components) * self.scales()

    def explained(self) -> np.ndarray:
        return self.values / self.trace if self.trace > 0 else np.zeros(len(self.values))


def _ritz(basis: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ritz values, falling, their vectors, and the norm of each residual V u - value u."""
    small = basis.T @ image
    values, turn = np.linalg.eigh((small + small.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    vectors = basis @ turn
    return values, vectors, np.linalg.norm(image @ turn - vectors * values, axis=0)


def _excess(values: np.ndarray, residuals: np.ndarray, k: int) -> float:
    """How far the worst of the first k Ritz vectors is beyond the residual allowed (1: just allowed).

    A residual turns a vector by at most its size over the distance to the other values.
    """
    gaps = np.abs(values[:, None] - values[None, :])
    np.fill_diagonal(gaps, np.inf)
    gap = gaps[:k].min(axis=1)
    return float(np.max(residuals[:k] / np.maximum(RESIDUAL * gap, np.finfo(float).tiny)))


def fit(vectors: DataFrame, k: int = COMPONENTS, oversampling: int = OVERSAMPLING, power_passes: int = POWER_PASSES) -> Whitening | None:
    """Components of all rows of ``vectors`` (vec_id, v); None if there is none. Runs one action for each pass.

    Vectors of another length than the most frequent one (the longer of equals) must not be among them.
    """
    parts = vectors.mapInArrow(_sums, "width int, j int, n long, total string")
    sums = durable(parts.groupBy("width", "j").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")))
    most = sums.where("j = 0").orderBy(F.desc("n"), F.desc("width")).first()
    if most is None:
        return None
    d, n = most["width"], most["n"]
    rows = sums.where(F.col("width") == d).orderBy("j").collect()
    centre = Centre.of(n, [int(r["total"]) for r in rows])
    vectors = of_width(vectors, d)
    k, l = min(k, d), min(k + oversampling, d)
    rng = np.random.default_rng(SEED)
    basis = np.linalg.qr(rng.standard_normal((d, l)))[0]
    passes, before, expanded = 0, None, l == d
    while True:
        image, trace = covariance_times(vectors, centre, basis)
        passes += 1
        values, ritz, residuals = _ritz(basis, image)
        if expanded:
            break
        excess = _excess(values, residuals, k)
        if excess <= 1:
            break
        shrink = 1.0 if before is None else excess / before
        hopeless = passes > 2 and (shrink >= 1 or passes + math.log(excess) / -math.log(shrink) > power_passes)
        if hopeless or passes >= power_passes:
            basis, expanded = np.linalg.qr(np.hstack([ritz, rng.standard_normal((d, d - l))]))[0], True
        else:
            basis, before = np.linalg.qr(image)[0], excess
    return Whitening(centre, ritz[:, :k], np.maximum(values[:k], 0), trace, passes, expanded)


def of_width(vectors: DataFrame, width: int) -> DataFrame:
    return vectors.where(F.size("v") == width)


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, over directions with variance (an action)."""
    k = len(model.values)

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for _, x in _slices(batches):
            w = np.nan_to_num(model.whitened(x))
            total[:k] += w.T @ w
            total[k] += w.sum(axis=0)
        yield _pieces(total)

    out = _added_up(vectors.mapInArrow(share, "j int, block int, v array<double>"), k + 1, k) / model.centre.n
    covariance = out[:k] - np.outer(out[k], out[k])  # the means are zero but for rounding
    return float(np.abs(covariance - np.diag(np.isfinite(model.scales()).astype(float))).max(initial=0))


def whiten(embeddings: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """The whitened coordinates of every usable vector: one row for each component.

    Vectors that are null, empty or hold null or non-finite entries are left out; so are those of another length
    than the most frequent one. Repeated rows count each, and null ids stay null. A component without
    variance (fewer rows than components, repeated rows only, constant dimensions) has null coordinates and explains
    nothing. ``deviation`` is null beyond the range of a long. No usable vector: no rows. Only vec_id and embedding
    are read. Fitting runs here; the result's own rows are lazy.
    """
    vectors = _usable(embeddings)
    model = fit(vectors, k)
    if model is None:
        return embeddings.sparkSession.createDataFrame([], SCHEMA)
    vectors = of_width(vectors, len(model.components))
    error, share, n, c = identity_error(vectors, model), model.explained(), model.centre.n, len(model.values)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _slices(batches):
            w = model.whitened(x).ravel()
            deviation = pa.array(model.centre.deviations(x), pa.int64())
            at = pa.array(np.repeat(np.arange(len(ids)), c))
            yield pa.RecordBatch.from_arrays([
                ids.take(at), pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), len(ids))), pa.array(np.full(len(w), n)), deviation.take(at),
                pa.array(w, from_pandas=True), pa.array(np.tile(share, len(ids))), pa.array(np.full(len(w), error)),
            ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(rows, SCHEMA)
