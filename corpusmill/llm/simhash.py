"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints are compared inside shards. A shard is the top node of the hierarchy: all fingerprints
that agree on one of four 16-bit blocks, one of which any two fingerprints within 3 bits must share.
Inside a shard they are sorted by Gray rank, so that neighbours differ in few bits; runs of neighbours
become nodes that hold the bits all of them share (a masked pattern), level upon level. A search walks
down from the top, adds the differences against the bits a node has beyond its parent, and drops the
node with all below it once the sum passes the threshold.

A shard with more than ``SPLIT_ABOVE`` fingerprints is split once more by four 12-bit blocks of its
other 48 bits, again without losing a pair, and what is still larger than a task should hold meets in pairs
of parts. Equal fingerprints are folded before any comparison, nodes all of whose fingerprints are linked with
the one that is searched for are skipped, and a shard sends on a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import Components, durable, words_of
from corpusmill.llm.graph import components

SEED = 42
SPLIT_ABOVE = 4096
HELD = 1 << 17
FANOUT = 8
FRONTIER = 500_000
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of one text: A-Z lower-cased, ``shingle`` words, repeats counted; no words: 0."""
    words = [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest, counts, n = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64), len(words) - shingle + 1
    for at in range(0, n, 65536):
        columns = [words[at + k : at + min(65536, n - at) + k] for k in range(shingle)]
        h = np.array([digest(s, SEED) for s in map(b" ".join, zip(*columns))], dtype=np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) per row of ``docs``; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column("text")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray sequence."""
    out = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


class GrayIndex:
    """Hierarchy of masked patterns over codes sorted by (shard, Gray rank)."""

    def __init__(self, shards: np.ndarray, codes: np.ndarray) -> None:
        order = np.lexsort((gray_rank(codes), shards))
        self.order, self.codes = order, codes[order]
        shards = shards[order]
        self.levels = [(self.codes, np.full(len(codes), ALL))]  # (values of the shared bits, mask of them)
        self.children: list[tuple[np.ndarray, np.ndarray]] = []  # first and last child of each node, by level
        self.last = [np.arange(len(codes))]  # last leaf below each node
        while True:
            starts = np.flatnonzero(np.r_[True, shards[1:] != shards[:-1]])
            sizes = np.diff(np.r_[starts, len(shards)])
            if sizes.max() == 1:
                break
            within = np.arange(len(shards)) - np.repeat(starts, sizes)
            first = np.flatnonzero(within % FANOUT == 0)
            end = np.r_[first[1:], len(shards)]
            value, mask = self.levels[-1]
            ones = np.bitwise_and.reduceat(value | ~mask, first)
            any_one = np.bitwise_or.reduceat(value & mask, first)
            shared = np.bitwise_and.reduceat(mask, first) & ~(any_one & ~ones)
            self.children.append((first, end))
            self.levels.append((any_one & shared, shared))
            self.last.append(self.last[-1][end - 1])
            shards = shards[first]
        self.root_of = np.repeat(np.arange(len(shards)), np.diff(np.r_[-1, self.last[-1]]))

    def neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions (before sorting) that follow each other in Gray order inside a shard."""
        last = np.r_[self.root_of[1:] != self.root_of[:-1], True]
        at = np.flatnonzero(~last)
        return self.order[at], self.order[at + 1]

    def links(self, distance: int, groups: Components | None = None, frontier: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of positions (before sorting) of one shard within ``distance``, in blocks.

        With ``groups``, nodes whose leaves all are in the query's own group are left out: what is linked
        already need not be found again.
        """
        most = FRONTIER if frontier is None else frontier
        size = np.diff(np.r_[-1, self.last[-1]])[self.root_of]
        ends = np.searchsorted(np.cumsum(size), np.arange(most, size.sum() + most, most), "right")
        at = 0
        for end in np.unique(np.r_[ends, len(size)]):
            if end == at and size[at] <= most:
                continue
            for lo in range(at, max(end, at + 1), max(1, most // int(size[at : max(end, at + 1)].max()))):
                hi = min(max(end, at + 1), lo + max(1, most // int(size[at : max(end, at + 1)].max())))
                yield from self._search(np.arange(lo, hi), distance, groups)
            at = max(end, at + 1)

    def _common_group(self, groups: Components) -> list[np.ndarray]:
        """For each level and node the group that all its leaves are in, or -1."""
        group = groups.root[self.order]
        levels = [group]
        for first, _ in self.children:
            low, high = np.minimum.reduceat(levels[-1], first), np.maximum.reduceat(levels[-1], first)
            levels.append(np.where(low == high, low, -1))
        return levels

    def _search(self, query: np.ndarray, distance: int, groups: Components | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        node, far = self.root_of[query], np.zeros(len(query), dtype=np.int64)
        same = None if groups is None else self._common_group(groups)
        for level in range(len(self.children) - 1, -1, -1):
            first, end = self.children[level]
            n = end[node] - first[node]
            child = np.repeat(first[node] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            parent_mask = np.repeat(self.levels[level + 1][1][node], n)
            query, far = np.repeat(query, n), np.repeat(far, n)
            value, mask = self.levels[level]
            far = far + np.bitwise_count((self.codes[query] ^ value[child]) & (mask[child] & ~parent_mask))
            keep = (far <= distance) & (self.last[level][child] > query)
            if same is not None:
                keep &= same[level][child] != same[0][query]
            query, node, far = query[keep], child[keep], far[keep]
        if self.children:
            yield self.order[query], self.order[node]


def _shard_links(distance: int):
    """Per partition, sorted by shard: spanning links (u, v) of each shard; holds one batch and one open shard."""

    def solve(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        same = keys[1:] == keys[:-1]
        pick = np.r_[False, same] | np.r_[same, False]
        keys, fps = keys[pick], fps[pick]
        if not len(keys):
            return
        codes = fps.view(np.uint64)
        groups, index = Components(len(fps)), GrayIndex(keys, codes)
        a, b = index.neighbours()
        near = np.bitwise_count(codes[a] ^ codes[b]) <= distance
        groups.link(a[near], b[near])
        for a, b in index.links(distance, groups):
            groups.link(a, b)
        u = np.flatnonzero(groups.root != np.arange(len(fps)))
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(fps[u]), pa.array(fps[groups.root[u]])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            if not b.num_rows:
                continue
            keys, fps = b.column("shard").to_numpy(), b.column("fp").to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut or (held and held[-1][0][-1] != keys[0]):
                done = [*held, (keys[:cut], fps[:cut])]
                yield from solve(np.concatenate([k for k, _ in done]), np.concatenate([f for _, f in done]))
                held = []
            held.append((keys[cut:], fps[cut:]))
        if held:
            yield from solve(np.concatenate([k for k, _ in held]), np.concatenate([f for _, f in held]))

    return run


def _bits(width: int, at: Column | int) -> Column:
    return F.shiftrightunsigned(F.col("fp"), at).bitwiseAND(F.lit((1 << width) - 1))


def _shards(distinct: DataFrame) -> DataFrame:
    """(shard, fp): four rows for each fingerprint, four more for each of its crowded shards instead."""
    top = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("i"), _bits(16, 16 * i).alias("x")) for i in range(4)])).alias("s"))
    top = top.select("fp", F.col("s.i").alias("i"), (F.shiftleft(F.col("s.x"), 2) + F.col("s.i")).alias("shard"))
    crowded = top.groupBy("shard").count().where(F.col("count") > SPLIT_ABOVE).select("shard", F.lit(True).alias("crowded"))
    marked = top.join(crowded, "shard", "left")
    pieces = []
    for i in range(4):
        # the 48 bits beside block i, closed up
        below = F.col("fp").bitwiseAND(F.lit((1 << (16 * i)) - 1)) if i else F.lit(0).cast("long")
        above = F.shiftrightunsigned(F.col("fp"), 16 * (i + 1)) if i < 3 else F.lit(0).cast("long")
        pieces.append(F.when(F.col("i") == i, below + F.shiftleft(above, 16 * i)))
    rest = F.coalesce(*pieces)
    sub = F.array(*[F.shiftleft(F.shiftleft(F.shiftrightunsigned(rest, 12 * j).bitwiseAND(F.lit(4095)), 2) + j, 18) + F.col("shard") + F.lit(1 << 40) for j in range(4)])
    return in_parts(marked.select(F.explode(F.when(F.col("crowded"), sub).otherwise(F.array("shard"))).alias("shard"), "fp"), "fp")


def in_parts(posted: DataFrame, node: str) -> DataFrame:
    """``posted`` with each shard of more than HELD rows dealt into parts, and one shard for each pair of parts.

    Every two rows of a shard still meet, and none has more than about 2 * HELD. The table of such shards is
    written first, so the planner knows its size when it picks the join.
    """
    large = durable(posted.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HELD).select(F.col("shard").alias("whole"), F.ceil(F.col("n") / HELD).cast("int").alias("parts")))
    told = posted.join(large, F.col("shard") == F.col("whole"), "left").withColumn("part", F.pmod(F.xxhash64(node, F.lit(5)), F.col("parts")).cast("int"))
    dealt = told.withColumn("other", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))))
    pair = F.xxhash64("shard", F.least("part", "other"), F.greatest("part", "other"))
    return dealt.withColumn("shard", F.when(F.col("parts").isNull(), F.col("shard")).otherwise(pair)).select(*posted.columns)


def linked_fingerprints(distinct: DataFrame, distance: int = 3) -> DataFrame:
    """(node, label): fingerprints of ``distinct`` (fp) that reach another one, and the smallest they reach."""
    if not 0 <= distance <= 3:
        raise ValueError("four blocks hold every pair only up to distance 3")
    shards = _shards(distinct)
    edges = shards.repartition("shard").sortWithinPartitions("shard").mapInArrow(_shard_links(distance), "u long, v long")
    return components(edges)


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 3) -> DataFrame:
    """Components of documents whose SimHash fingerprints differ in at most ``distance`` bits.

    Returns (doc_id, fingerprint, component_id) per row of ``docs``: 16 hex digits, and the smallest
    doc_id that can be reached. Texts without words, null ones too, have fingerprint zero and link
    like any other. A null doc_id is never the smallest (a component of nulls only has a null id).
    Repeated rows come back as often as they are given; an empty table gives an empty result. Texts of any
    length are taken whole, in stretches of shingles; only doc_id and text are read.
    """
    marked = durable(fingerprints(docs, shingle))
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    linked = linked_fingerprints(distinct.select("fp"), distance)
    labelled = distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    groups = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    owner = durable(labelled.join(groups, "label").select("fp", "component_id"))
    return marked.join(owner, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
