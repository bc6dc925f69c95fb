"""Similarity digests of improbable features: rare byte windows in chained Bloom filters, compared by shared bits.

Every window of ``WINDOW`` bytes has an entropy, sorted into bins of a thousandth of the largest one. How often a
bin occurs over all documents ranks its windows: the rarer, the better. Of every ``NEAR`` neighbouring windows the
first of the best rank gets a vote, and windows with ``VOTES`` votes are features, so a feature depends on the bytes
around it alone and survives edits elsewhere. Features are hashed into Bloom filters of ``BITS`` bits, in order
of their place; after ``PER_FILTER`` of them the next filter of the chain begins. Two digests are as
alike as the shares of each one's features that the bits of the other one's filters contain, less what chance gives.

A text is read with ``WINDOW - LEAST`` zero bytes before it, so short texts have windows too; a text of fewer than
LEAST bytes is one feature, an empty one has none.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import durable, frequent, shuffle_partitions, task_done

WINDOW = 32
LEAST = 8
NEAR = 32
VOTES = 8
BINS = 1000
BITS = 2048
HASHES = 5
PER_FILTER = 160
DEVIATIONS = 3
STRETCH = 1 << 20
FILTERS_AT_ONCE = 512
ROWS_AT_ONCE = 256
#: c * log2(c) in units of 2**-20, whole so that sums do not depend on where they begin.
PLOGP = np.array([0, *[round(c * np.log2(c) * (1 << 20)) for c in range(1, WINDOW + 1)]], dtype=np.int64)
ODD = (np.arange(1, WINDOW + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
PADDING = bytes(WINDOW - LEAST)
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(PADDING + text.encode("utf-8", "surrogatepass"), dtype=np.uint8)


def entropy_bins(b: np.ndarray) -> np.ndarray:
    """The entropy bin, 0 to BINS, of every window of ``b``, which has at least WINDOW bytes.

    As a window moves on, it loses one byte and gains another; what that does to its entropy depends on how often
    either is in it, which their places in the sorted list of equal bytes tell.
    """
    n, m = len(b), len(b) - WINDOW + 1
    order = np.argsort(b, kind="stable")
    key = b[order].astype(np.int64) * (n + WINDOW) + order
    at = np.arange(n)
    ahead, behind = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    ahead[order] = np.searchsorted(key, key + WINDOW) - at
    behind[order] = at + 1 - np.searchsorted(key, key - WINDOW, "right")
    lost, gained = ahead[: m - 1], behind[WINDOW : WINDOW + m - 1]
    change = PLOGP[gained] - PLOGP[gained - 1] - PLOGP[lost] + PLOGP[lost - 1]
    total = PLOGP[np.bincount(b[:WINDOW])].sum() + np.r_[np.int64(0), np.cumsum(change)]
    return (PLOGP[WINDOW] - total) * BINS // PLOGP[WINDOW]


def _stretches(b: np.ndarray, margin: int) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(first window, one past the last, where the bins begin, bins) for runs of windows, with a margin on both sides."""
    m = len(b) - WINDOW + 1
    for lo in range(0, m, STRETCH):
        hi = min(lo + STRETCH, m)
        first, last = max(0, lo - margin), min(m, hi + margin)
        yield lo, hi, first, entropy_bins(b[first : last + WINDOW - 1])


def rarity(docs: DataFrame) -> np.ndarray:
    """The rank of each entropy bin by the windows of all documents that are in it, rarest first (an action).

    Ties go to the lower bin. Tasks send BINS + 1 counts each.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BINS + 1, dtype=np.int64)
        for batch in batches:
            for text in batch["text"]:
                for _, _, _, bins in _stretches(_bytes(text.as_py()), 0):
                    total += np.bincount(bins, minlength=BINS + 1)
        task_done()
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["bin", "n"])

    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counts = np.zeros(BINS + 1, dtype=np.int64)
    for r in texts.mapInArrow(count, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        counts[r["bin"]] = r["n"]
    ranks = np.empty(BINS + 1, dtype=np.int64)
    ranks[np.argsort(counts, kind="stable")] = np.arange(BINS + 1)
    return ranks


def features(text: str, ranks: np.ndarray) -> np.ndarray:
    """Hashes of a text's features, each once, in order of their first place."""
    if not text:
        return np.zeros(0, dtype=np.uint64)
    b = _bytes(text)
    if len(b) < WINDOW:
        return _hashes(np.r_[b, np.zeros(WINDOW - len(b), dtype=np.uint8)][None, :])
    out = []
    m, margin = len(b) - WINDOW + 1, NEAR - 1
    for lo, hi, first, bins in _stretches(b, margin):
        best = (ranks[bins] << 32) | np.arange(len(bins))
        before, after = margin * (first == 0), margin * (first + len(bins) == m)
        best = np.pad(best, (before, after), constant_values=np.iinfo(np.int64).max)
        step = 1
        while step < NEAR:
            best = np.minimum(best[:-step], best[step:])
            step *= 2
        votes = np.bincount(best & 0xFFFFFFFF, minlength=len(bins))
        at = np.flatnonzero(votes[lo - first : hi - first] >= VOTES) + lo
        out.append(_hashes(np.lib.stride_tricks.sliding_window_view(b, WINDOW)[at]))
    hashes = np.concatenate(out)
    return hashes[np.sort(np.unique(hashes, return_index=True)[1])]


def _hashes(windows: np.ndarray) -> np.ndarray:
    x = (windows.astype(np.uint64) + np.uint64(1)) * ODD
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(32))).sum(axis=1, dtype=np.uint64)
    x ^= x >> np.uint64(31)
    return x * np.uint64(0x94D049BB133111EB)


class Digest:
    """A chain of Bloom filters over ``count`` features; all but the last hold PER_FILTER of them."""

    def __init__(self, count: int, filters: np.ndarray) -> None:
        self.count, self.filters = count, filters

    @classmethod
    def of(cls, text: str, ranks: np.ndarray) -> Digest:
        hashes = features(text, ranks)
        bits = np.zeros((-(-len(hashes) // PER_FILTER), BITS), dtype=np.uint8)
        chain = np.arange(len(hashes)) // PER_FILTER
        for k in range(HASHES):
            bits[chain, (hashes >> np.uint64(11 * k)) & np.uint64(BITS - 1)] = 1
        return cls(len(hashes), np.packbits(bits, axis=1))

    @classmethod
    def parse(cls, text: str) -> Digest:
        count, _, filters = text.partition(":")
        return cls(int(count), np.frombuffer(base64.b64decode(filters), dtype=np.uint8).reshape(-1, BITS // 8))

    def __str__(self) -> str:
        return f"{self.count}:{base64.b64encode(self.filters.tobytes()).decode()}"

    def sizes(self) -> np.ndarray:
        return np.minimum(PER_FILTER, self.count - PER_FILTER * np.arange(len(self.filters)))

    def likeness(self, other: Digest) -> float:
        """0 to 1: the features of both that the other's filters contain, over all features; 1 for two of none.

        Of two filters with a and b bits set, a * b / BITS are shared by chance. What is shared beyond that, over
        what could be, is the share of one's features in the other; overlaps within DEVIATIONS standard deviations of
        chance count as none. Shares in the filters of a chain add up, to 1 at most.
        """
        if not self.count or not other.count:
            return float(self.count == other.count)
        mine, theirs = np.zeros(len(self.filters)), np.zeros(len(other.filters))
        for i in range(0, len(mine), FILTERS_AT_ONCE):
            x = np.unpackbits(self.filters[i : i + FILTERS_AT_ONCE], axis=1).astype(np.float32)
            a = x.sum(axis=1, dtype=np.float64)[:, None]
            for j in range(0, len(theirs), FILTERS_AT_ONCE):
                y = np.unpackbits(other.filters[j : j + FILTERS_AT_ONCE], axis=1).astype(np.float32)
                b = y.sum(axis=1, dtype=np.float64)[None, :]
                chance = a * b / BITS
                spread = np.sqrt(chance * (1 - a / BITS) * (1 - b / BITS))
                shared = (x @ y.T).astype(np.float64) - chance
                shared[shared <= DEVIATIONS * spread] = 0
                mine[i : i + FILTERS_AT_ONCE] += (shared / (a - chance)).sum(axis=1)
                theirs[j : j + FILTERS_AT_ONCE] += (shared / (b - chance)).sum(axis=0)
        found = (np.minimum(mine, 1) * self.sizes()).sum() + (np.minimum(theirs, 1) * other.sizes()).sum()
        return min(1.0, float(found) / (self.count + other.count))


def fingerprint(text: Column, ranks: np.ndarray) -> Column:
    """The digest of a text column as a string; a null text is empty."""

    @F.arrow_udf("string")
    def one(texts: pa.Array) -> pa.Array:
        return pa.array([str(Digest.of(t.as_py() or "", ranks)) for t in texts], pa.string())

    return one(text.cast("string"))


def likeness(a: Column, b: Column) -> Column:
    """How alike the texts behind two fingerprints are, 0 to 1; null if either is."""

    @F.arrow_udf("double")
    def one(left: pa.Array, right: pa.Array) -> pa.Array:
        pairs = zip(left.to_pylist(), right.to_pylist(), strict=True)
        return pa.array([None if x is None or y is None else Digest.parse(x).likeness(Digest.parse(y)) for x, y in pairs], pa.float64())

    return one(a, b)


def _sortable(ids: np.ndarray, known: np.ndarray, th: np.ndarray) -> np.ndarray:
    """Keys of bytes that sort as (doc_id, th) do, rows without an id first."""
    out = np.zeros((len(ids), 17), dtype=np.uint8)
    out[:, 0] = 1 + known
    for k, v in ((1, np.where(known, ids, 0)), (9, th)):
        out[:, k : k + 8] = (v.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, 8)
    return out.reshape(-1).view("S17")


def _in_runs(docs: DataFrame, runs: int) -> DataFrame:
    """(run, guest, doc_id, th, n, text): documents in ``runs`` runs of the order (doc_id, th), sorted in each partition.

    A row stands for ``n`` that repeat its doc_id and text: where these are frequent they are folded before the
    shuffle, else they follow each other. Every run is followed by the first document of the next run (the first
    run's after the last) as a guest. Each text is shuffled once.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    keys = durable(rows.groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("n")))
    dealt = keys.repartitionByRange(runs, F.asc_nulls_first("doc_id"), F.asc("th")).select("doc_id", "th", F.spark_partition_id().alias("at"))
    firsts = [r["first"] for r in dealt.groupBy("at").agg(F.min(F.struct("doc_id", "th")).alias("first")).collect()]
    known = np.array([r["doc_id"] is not None for r in firsts], dtype=bool)
    bounds = np.sort(_sortable(np.array([r["doc_id"] or 0 for r in firsts], dtype=np.int64), known, np.array([r["th"] for r in firsts], dtype=np.int64)))

    @F.arrow_udf("int")
    def place(ids: pa.Array, th: pa.Array) -> pa.Array:
        """Twice the run, and one more for its first document."""
        own = _sortable(ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False), th.to_numpy(zero_copy_only=False))
        run = np.searchsorted(bounds, own, "right") - 1
        return pa.array((2 * run + (bounds[run] == own)).astype(np.int32))

    single = rows.withColumn("n", F.lit(1).cast("long"))
    if (limit := frequent(keys)) is not None:
        hot = F.broadcast(keys.where(F.col("n") > limit).select(F.col("doc_id").alias("id"), F.col("th").alias("own")))
        same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("th") == F.col("own"))
        folded = rows.join(hot, same, "left_semi").groupBy("doc_id", "th").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("n"))
        single = single.join(hot, same, "left_anti").unionByName(folded)
    placed = single.withColumn("place", place("doc_id", "th"))
    run, total = F.col("place").bitwiseAND(F.lit(-2)) / 2, max(1, len(bounds))
    home = F.struct(run.cast("int").alias("run"), F.lit(False).alias("guest"))
    visit = F.struct(((run + total - 1) % total).cast("int").alias("run"), F.lit(True).alias("guest"))
    spread = placed.withColumn("stay", F.explode(F.when(F.col("place") % 2 == 1, F.array(home, visit)).otherwise(F.array(home))))
    out = spread.select("stay.run", "stay.guest", "doc_id", "th", "n", "text")
    return out.repartitionById(total, F.col("run")).sortWithinPartitions("run", "guest", F.asc_nulls_first("doc_id"), "th")


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by as many of the first code points of the following one."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


def with_edits(docs: DataFrame) -> DataFrame:
    """The digest of every text and of its edited text, and how alike it is to that and to the next document's.

    The next document is that of the next larger doc_id, the first one's after the last; documents without an id come
    first, and different texts of one id follow each other by hash. Rows that repeat doc_id and text are one
    document and get the same result each. A null text is empty. An empty table gives no rows; a single document is
    its own next. Long texts are read in stretches. Only doc_id and text are read. The statistics of all documents
    and the bounds of the runs are computed here; the rows themselves are lazy.
    """
    ranks = rarity(docs)
    rows = _in_runs(docs, shuffle_partitions(docs))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        last = None
        for batch in batches:
            for run, guest, doc_id, th, n, text in zip(*(batch[c] for c in ("run", "guest", "doc_id", "th", "n", "text")), strict=True):
                run, key = run.as_py(), (doc_id.as_py(), th.as_py())
                if last and last[:2] == (run, key) and not guest.as_py():
                    last = (*last[:2], last[2] + n.as_py(), *last[3:])
                    continue
                text = text.as_py()
                digest = Digest.of(text, ranks)
                if last and last[0] == run:
                    _, (before_id, _), copies, before, own = last
                    other = edited(before, text)
                    changed = own if other == before else Digest.of(other, ranks)
                    sha = hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest()
                    row = (before_id, len(before), sha, str(own), str(changed), own.likeness(changed), own.likeness(digest))
                    while copies:
                        some = min(copies, ROWS_AT_ONCE)
                        out += [row] * some
                        copies -= some
                        if len(out) >= ROWS_AT_ONCE:
                            yield _table(out)
                            out = []
                last = None if guest.as_py() else (run, key, n.as_py(), text, digest)
        if out:
            yield _table(out)
        task_done()

    return rows.mapInArrow(compare, RESULT)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], columns)
