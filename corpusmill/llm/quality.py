"""Quality classifier: random-indexing word vectors, pooled per document, under a two-layer network.

Every word hashes to one of ``BUCKETS`` buckets, and every bucket has a fixed sparse index vector of a few +1
and -1. A word's vector is the sum of the index vectors of the words around it (random indexing) over all
documents, scaled to unit length. A document is the mean and the spread of its words' vectors and the mean
product of neighbouring ones, which says how well its words go together. A network of two layers in numpy turns
that into a logit, which a temperature fitted on documents kept aside from training calibrates.

The word vectors come from every document; rows that repeat doc_id and text count once. The sums of a task are
added up by ranges of buckets, so the driver gets BUCKETS x DIM numbers whatever the number of tasks. The
network is fitted on at most ``sample`` labelled documents, chosen by hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import once, task_done
from corpusmill.llm.substring import POWERS, mixed

BUCKETS = 1 << 14
DIM = 48
NONZERO = 6
WINDOW = 2
HIDDEN = 32
SAMPLE = 12_000
BYTES_AT_ONCE = 1 << 20
SLICE = 256
STEP = 1 << 16
HELD_TOKENS = 500_000
SENT_TOKENS = 1 << 27
FEATURES = 3 * DIM
SEED_WORD, SEED_INDEX = np.uint64(7), 11


@cache
def index_vectors() -> np.ndarray:
    """One sparse ternary vector for each bucket, the same wherever it is computed."""
    rng = np.random.default_rng(SEED_INDEX)
    out = np.zeros((BUCKETS, DIM), dtype=np.int8)
    at = np.argsort(rng.random((BUCKETS, DIM)), axis=1)[:, :NONZERO]
    np.put_along_axis(out, at, np.where(rng.random((BUCKETS, NONZERO)) < 0.5, -1, 1).astype(np.int8), axis=1)
    return out


#: Class of each byte: 0 white space, 1 part of a word (letters, digits, underscore, all beyond ASCII), 2 anything else.
CLASS = np.array([0 if c == 32 or 9 <= c <= 13 else 1 if c >= 128 or chr(c).isalnum() or c == 95 else 2 for c in range(256)], dtype=np.uint8)


def _stretch(b: np.ndarray) -> np.ndarray:
    kind = CLASS[b]
    edge = np.flatnonzero(np.r_[True, kind[1:] != kind[:-1]])
    end = np.r_[edge[1:], len(b)]
    real = kind[edge] > 0
    start, end = edge[real], end[real]
    up, down = POWERS.of(len(b))
    before = np.r_[np.zeros(1, dtype=np.uint64), np.cumsum((b.astype(np.uint64) + SEED_WORD) * up)]
    named = mixed((before[end] - before[start]) * down[start] + (end - start).astype(np.uint64))
    return (named % np.uint64(BUCKETS)).astype("<u2")


def word_buckets(text: str | None) -> np.ndarray:
    """The bucket of each token, in order: runs of word characters and runs of other signs, by a hash of their bytes.

    A long text is taken in stretches of at most BYTES_AT_ONCE that end at white space where there is any.
    """
    b = np.frombuffer(b"" if text is None else text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    out, at = [], 0
    while at < len(b):
        end = min(at + BYTES_AT_ONCE, len(b))
        if end < len(b) and len(space := np.flatnonzero(CLASS[b[at:end]] == 0)):
            end = at + int(space[-1]) + 1
        out.append(_stretch(b[at:end]))
        at = end
    return np.concatenate(out) if out else np.zeros(0, dtype="<u2")


def pooled(words: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the words' vectors and the mean product of neighbours; zeros for no words."""
    n = len(words)
    if not n:
        return np.zeros(FEATURES, dtype=np.float32)
    total, square, beside = np.zeros(DIM), np.zeros(DIM), np.zeros(DIM)
    for at in range(0, n, STEP):
        v = vectors[words[at : at + STEP + 1]]
        own = v[:STEP]
        total += own.sum(axis=0, dtype=np.float64)
        square += np.einsum("ij,ij->j", own, own, dtype=np.float64)
        beside += np.einsum("ij,ij->j", v[:-1], v[1:], dtype=np.float64)
    mean = total / n
    spread = np.sqrt(np.maximum(square / n - mean**2, 0))
    return np.r_[mean, spread, beside / max(n - 1, 1)].astype(np.float32)


@dataclass
class Network:
    """Two layers over standardised features; ``probability`` divides the logit by the temperature."""

    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.centre) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -60, 60)))


def constant(p: float) -> Network:
    """What is left without two classes to learn from: the share of label 1."""
    d = FEATURES
    p = min(max(p, 1e-6), 1 - 1e-6)
    return Network(np.zeros(d), np.ones(d), np.zeros((d, 1)), np.zeros(1), np.zeros(1), float(np.log(p / (1 - p))))


def fit_network(x: np.ndarray, y: np.ndarray, epochs: int = 60, seed: int = 5) -> Network:
    """Adam on the log loss with weight decay; a fifth of the rows is kept aside to fit the temperature."""
    if len(y) < 10 or y.min() == y.max():
        return constant(float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    aside, train = order[: len(y) // 5], order[len(y) // 5 :]
    centre, scale = x[train].mean(axis=0).astype(float), x[train].std(axis=0).astype(float) + 1e-3
    z, t = (x[train] - centre) / scale, y[train].astype(float)
    net = Network(centre, scale, rng.normal(0, np.sqrt(2 / z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.1, HIDDEN), 0.0)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (net.w1, net.b1, net.w2, np.zeros(1))]
    step = 0
    for epoch in range(epochs):
        rate = 3e-3 * (1 - epoch / epochs) + 1e-4
        shuffled = rng.permutation(len(t))
        for at in range(0, len(t), 128):
            b = shuffled[at : at + 128]
            h = np.maximum(z[b] @ net.w1 + net.b1, 0)
            d = (1 / (1 + np.exp(-np.clip(h @ net.w2 + net.b2, -60, 60))) - t[b]) / len(b)
            back = np.outer(d, net.w2) * (h > 0)
            grads = (z[b].T @ back + 1e-4 * net.w1, back.sum(axis=0), h.T @ d + 1e-4 * net.w2, np.array([d.sum()]))
            step += 1
            moves = []
            for (m, v), g in zip(state, grads):
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * g * g
                moves.append(rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8))
            net.w1 -= moves[0]
            net.b1 -= moves[1]
            net.w2 -= moves[2]
            net.b2 -= float(moves[3][0])
    logits, truth = net.logit(x[aside]), y[aside]
    grid = np.geomspace(0.25, 8, 121)
    loss = [np.logaddexp(0, np.where(truth == 1, -1, 1) * logits / s).mean() for s in grid]
    net.temperature = float(grid[int(np.argmin(loss))]) if len(truth) else 1.0
    return net


def training_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, y) of the labels that may be learnt from: crc32 of the id as text, mod 3, is not 1.

    A document labelled more than once counts as its lowest label; null ids and labels are left out.
    """
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("y"))
        .where(~held_out(F.col("doc_id")))
    )


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def context_sums(sequences: list[np.ndarray]) -> np.ndarray:
    """For each bucket the sum of the index vectors of the words up to WINDOW places away, over all sequences."""
    index = index_vectors()
    at = np.argsort(index == 0, axis=1, kind="stable")[:, :NONZERO]
    sign = np.take_along_axis(index, at, axis=1).astype(np.float64)
    apart = np.full(WINDOW, -1, dtype=np.int64)  # no context reaches into another text
    w = np.concatenate([x for s in sequences for x in (s.astype(np.int64), apart)])
    sums = np.zeros(BUCKETS * DIM)
    for gap in range(1, WINDOW + 1):
        a, b = w[:-gap], w[gap:]
        real = (a >= 0) & (b >= 0)
        pairs, times = np.unique(a[real] * BUCKETS + b[real], return_counts=True)
        a, b = pairs // BUCKETS, pairs % BUCKETS
        for own, other in ((a, b), (b, a)):
            for k in range(NONZERO):
                sums += np.bincount(own * DIM + at[other, k], times * sign[other, k], BUCKETS * DIM)
    return sums.reshape(BUCKETS, DIM).astype(np.int64)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(slice, buckets, sums) of a task, for the buckets that its texts have."""
    sums, held, size, sent = np.zeros((BUCKETS, DIM), dtype=np.int64), [], 0, 0

    def rows() -> pa.RecordBatch:
        out = []
        for k in range(0, BUCKETS, SLICE):
            some = np.flatnonzero(sums[k : k + SLICE].any(axis=1))
            if len(some):
                out.append((k // SLICE, some.astype("<u2").tobytes(), sums[k + some].astype("<i4").tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.binary(), pa.binary()))], ["slice", "buckets", "sums"])

    for b in batches:
        for text in b.column("text"):
            words = word_buckets(text.as_py())
            # a long text is taken in stretches that overlap by what a window reaches, less what was counted
            for at in range(0, len(words), HELD_TOKENS):
                held.append(words[max(0, at - WINDOW) : at + HELD_TOKENS])
                size += len(held[-1])
                if size >= HELD_TOKENS:
                    sums += context_sums(held)
                    sent, size, held = sent + size, 0, []
                if at:
                    sums -= context_sums([words[at - WINDOW : at]])
        if sent > SENT_TOKENS and sums.any():
            yield rows()
            sums, sent = np.zeros((BUCKETS, DIM), dtype=np.int64), 0
    if held:
        sums += context_sums(held)
    if sums.any():
        yield rows()
    task_done()


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for k, some, sums in zip(*(b.column(c).to_pylist() for c in ("slice", "buckets", "sums"))):
            some = np.frombuffer(some, dtype="<u2")
            total.setdefault(k, np.zeros((SLICE, DIM), dtype=np.int64))[some] += np.frombuffer(sums, dtype="<i4").reshape(-1, DIM)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["slice", "sums"])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """One unit vector a bucket, or zeros, from all rows of ``docs`` (an action)."""
    slices = BUCKETS // SLICE
    parts = docs.select("text").mapInArrow(_contexts, "slice int, buckets binary, sums binary").repartition(slices, "slice").mapInArrow(_added, "slice int, sums binary")
    sums = np.zeros((slices, SLICE, DIM))
    for r in parts.collect():  # at most a row per slice
        sums[r["slice"]] = np.frombuffer(r["sums"], dtype=np.int64).reshape(SLICE, DIM)
    sums = sums.reshape(BUCKETS, DIM)
    return (sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, Network]:
    """Word vectors of all documents, and a network from at most ``sample`` labelled ones (an action)."""
    rows = once(docs)
    vectors = word_vectors(rows)
    sent = docs.sparkSession.sparkContext.broadcast(vectors)
    chosen = training_labels(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [pooled(word_buckets(t.as_py()), sent.value).tobytes() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), b.column("th"), pa.array(x, pa.binary())], ["doc_id", "y", "th", "x"])
        task_done()

    labelled = rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "th", "text")  # at most ``sample`` ids
    made = labelled.mapInArrow(features, "doc_id long, y int, th long, x binary")
    # of different texts with one id the one with the smallest hash is learnt from
    got = sorted(made.groupBy("doc_id").agg(F.min_by("y", "th").alias("y"), F.min_by("x", "th").alias("x")).collect())
    x = np.array([np.frombuffer(r["x"], dtype=np.float32) for r in got]).reshape(-1, FEATURES)
    return vectors, fit_network(x, np.array([r["y"] for r in got], dtype=int))


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs``.

    score is the calibrated probability of label 1 from the whole text alone; predicted is 1 from 0.5 on.
    held_out marks the ids whose labels were never looked at. Null and empty texts are scored as texts
    without words. Texts of any length are scored whole, in stretches. Rows that repeat doc_id and text count
    once in all that is learnt, so repeating them changes no score; different texts with one id are scored each
    by itself. Without labels of both kinds every score is the share of label 1, or one half. An empty table
    gives an empty one; only doc_id and text are read.
    """
    vectors, network = fit(docs, labels, sample)
    sent = docs.sparkSession.sparkContext.broadcast((vectors, network))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, network = sent.value
        for b in batches:
            x = np.array([pooled(word_buckets(t.as_py()), vectors) for t in b.column("text")]).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(network.probability(x))], ["doc_id", "score"])
        task_done()

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that are predicted to be of quality 1, in one pass over the texts.

    Rows keep all their columns; those that repeat doc_id and text are all kept or all dropped. Null and empty texts
    are judged as texts without words, very long ones in stretches, as in ``score``; an empty table gives an empty one.
    """
    vectors, network = fit(docs, labels, sample)
    sent = docs.sparkSession.sparkContext.broadcast((vectors, network))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, network = sent.value
        for b in batches:
            x = np.array([pooled(word_buckets(t.as_py()), vectors) for t in b.column("text")]).reshape(-1, FEATURES)
            yield b.filter(pa.array(network.probability(x) >= 0.5))
        task_done()

    return docs.mapInArrow(run, docs.schema)
