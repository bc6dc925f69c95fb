"""A linear classification head over an encoder of token windows, trained by AdamW on summed gradients.

The encoder is any function of (ids, mask) that a worker can build; pretrained weights are not part of this
library, so the default is a fixed random embedding, averaged over a window. Its vectors are computed once and
stored. A step reads the windows of one batch, each task sends the sum of its gradients (as many numbers as the
head has), and the driver moves the head. Loss is cross entropy weighted by inverse class frequency, the rate
warms up and falls by a cosine, and training stops when macro F1 of the validation documents, after pooling,
has not risen for ``patience`` epochs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.lineage import cut
from corpusmill.operators import ml, training, windows
from corpusmill.schema import EPOCH_LOG, SequenceParams

IDS = 31_000


@dataclass(frozen=True)
class HeadSettings:
    epochs: int = 10
    batches: int = 4
    rate: float = 0.1
    weight_decay: float = 0.01
    warmup_ratio: float = 0.06
    patience: int = 3
    seed: int = 13


@dataclass
class Head:
    weight: np.ndarray  # (dimensions, 2)
    bias: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weight + self.bias


def averaged_embedding(dim: int = 64, seed: int = 13) -> Callable[[], Callable]:
    """An encoder without weights of its own: fixed random vectors by id, averaged over what the mask shows."""

    def make() -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        table = np.random.default_rng(seed).normal(size=(IDS, dim))
        return lambda ids, mask: (table[ids % IDS] * mask[..., None]).sum(axis=1) / np.maximum(mask.sum(axis=1, keepdims=True), 1)

    return make


def encode(docs: DataFrame, make_encoder: Callable[[], Callable], params: SequenceParams = SequenceParams(), batch: int = 32) -> DataFrame:
    """(doc_idx, window_idx, label, vector) of all windows of (doc_idx, label, text), written once (an action)."""
    rows = windows.token_windows(docs, params)
    return cut(ml.batch_logits(rows, make_encoder, ("doc_idx", "window_idx", "label"), batch).withColumnRenamed("logits", "vector"))


def rate_factor(step: int, warmup: int, total: int) -> float:
    """Driver-side twin of ``training.warmup_cosine``."""
    if step < warmup:
        return step / max(1, warmup)
    return max(0.0, 0.5 * (1 + math.cos(math.pi * min(1.0, (step - warmup) / max(1, total - warmup)))))


def gradient(rows: DataFrame, head: Head, weights: dict[int, float]) -> tuple[np.ndarray, np.ndarray, float]:
    """Weighted mean gradient of weight and bias, and the loss, over ``rows`` (vector, label); a row a task comes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(head.weight.size + 4)
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            y = b.column("label").to_numpy(zero_copy_only=False).astype(int)
            w = np.array([weights[k] for k in y.tolist()])
            z = head.logits(x)
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            loss = -np.log(np.maximum(p[np.arange(len(y)), y], 1e-300))
            p[np.arange(len(y)), y] -= 1
            p *= w[:, None]
            total += np.r_[(x.T @ p).ravel(), p.sum(axis=0), (w * loss).sum(), w.sum()]
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["total"])

    sums = np.sum([r["total"] for r in rows.select("vector", "label").mapInArrow(run, "total array<double>").collect()], axis=0)
    n = max(float(sums[-1]), 1e-12)
    d = head.weight.size
    return sums[:d].reshape(head.weight.shape) / n, sums[d : d + 2] / n, float(sums[-2] / n)


def predict(features: DataFrame, head: Head) -> DataFrame:
    """(doc_idx, n_windows, y_prob, y_pred): logits pooled by document first, softmax after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, len(head.weight)))
            yield pa.RecordBatch.from_arrays([b.column("doc_idx"), pa.array(head.logits(x).tolist(), pa.list_(pa.float64()))], ["doc_idx", "logits"])

    kind = dict(features.dtypes)["doc_idx"]
    return windows.document_predictions(features.select("doc_idx", "vector").mapInArrow(run, f"doc_idx {kind}, logits array<double>"))


def validation_f1(features: DataFrame, head: Head) -> float:
    """Macro F1 of documents, each with the label of its first window."""
    out = predict(features, head).join(windows.first_label(features), "doc_idx")
    return ml.macro_f1(out)


def train(train_features: DataFrame, val_features: DataFrame, settings: HeadSettings = HeadSettings()) -> tuple[Head, DataFrame]:
    """(best head, epoch log) from features as ``encode`` gives them. Runs an action a batch and one an epoch."""
    s = settings
    weights = {r["label"]: r["weight"] for r in training.class_weights(windows.first_label(train_features).select("label")).collect()}  # two classes
    width = train_features.select(F.max(F.size("vector"))).first()[0] or 1
    rng = np.random.default_rng(s.seed)
    head = Head(rng.normal(0, 0.02, (width, 2)), np.zeros(2))
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (head.weight, head.bias)]
    total, step, bad, best, log = s.epochs * s.batches, 0, 0, None, []
    for epoch in range(s.epochs):
        losses = []
        batch_no = F.pmod(F.xxhash64("doc_idx", "window_idx", F.lit(s.seed * 1000 + epoch)), F.lit(s.batches))
        for k in range(s.batches):
            g_weight, g_bias, loss = gradient(train_features.where(batch_no == k), head, weights)
            rate = s.rate * rate_factor(step, int(total * s.warmup_ratio), total)
            step += 1
            losses.append(loss)
            for p, g, (m, v), decay in ((head.weight, g_weight, moments[0], s.weight_decay), (head.bias, g_bias, moments[1], 0.0)):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8) + decay * p)
        score = validation_f1(val_features, head)
        better = best is None or score > best[0]
        bad = 0 if better else bad + 1
        if better:
            best = (score, Head(head.weight.copy(), head.bias.copy()))
        log.append((epoch, float(np.mean(losses)), score, rate, better, bad >= s.patience))
        if bad >= s.patience:
            break
    return best[1], train_features.sparkSession.createDataFrame(log, EPOCH_LOG)
