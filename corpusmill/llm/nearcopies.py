"""Near copies by the Jaccard similarity of word shingles: wide SimHash fingerprints over the Gray-order index.

``simhash`` links fingerprints up to 3 bits apart, which texts of similarity 0.8 seldom are. Here a text is the
set of its five-word shingles and has ``WIDE`` fingerprints of 64 bits, each of other hashes. Every 16-bit block
of each is a shard, as in ``simhash``: two texts of similarity 0.8 differ in some 15 % of the bits, so they agree
in a given block with probability 0.07 and in one of all 64 with 0.99 (0.85: 0.999). Inside a shard the
fingerprints lie in a Gray-order hierarchical index, which is searched with a wider radius (``NEAR``), and the
fingerprint beside must be near as well (``BESIDE``). What meets this way is a coarse cluster.

Inside a coarse cluster the similarity of whole sets decides, so nothing is linked that is less alike than
asked. Equal sets are folded before. A cluster too large for a task meets in pairs of parts, and from a unit a
spanning forest of its links is sent on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import Components, doc_rows, durable, once, task_done
from corpusmill.llm.graph import components
from corpusmill.llm.simhash import GrayIndex, in_parts
from corpusmill.llm.substring import MIX, mixed  # noqa: F401

SEED = 42
SHINGLE, SIMILARITY = 5, 0.8
WIDE, BLOCKS = 16, 4
NEAR, BESIDE = 14, 28
CHUNK = 1024
HELD_SHINGLES, HELD_TEXTS = 1 << 20, 8192
SENT_BYTES = 1 << 22
FRONTIER = 250_000
LINKS_AT_ONCE = 500_000
SALTS = np.arange(1, WIDE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)  # fixed value: an odd 64-bit multiplier


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct shingles, A-Z lower-cased; a shorter text is one shingle, no words are one too."""
    words = [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    joined = map(b" ".join, zip(*[words[k:] for k in range(shingle)]))
    return np.unique(np.fromiter((digest(s, SEED) for s in joined), dtype=np.uint64, count=len(words) - shingle + 1))


def wide_fingerprint(shingles: np.ndarray) -> np.ndarray:
    """WIDE words of 64 bits; a bit is 1 if it is in more than half of the shingles' hashes."""
    counts = np.zeros(WIDE * 64, dtype=np.int64)
    for at in range(0, len(shingles), CHUNK):
        hashes = mixed(shingles[at : at + CHUNK, None] + SALTS)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(len(hashes), -1), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint16)
    return np.packbits(counts * 2 > len(shingles), bitorder="little").view(np.int64)


def _node(shingles: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), SEED)).view(np.int64))


def _marks(shingle: int):
    """(doc_id, th, node, size, codes): node is a hash of the whole set, size the number of its shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, sizes, codes = [], [], []
            for t in b.column("text"):
                s = shingle_set(t.as_py(), shingle)
                nodes.append(_node(s))
                sizes.append(len(s))
                codes.append(wide_fingerprint(s))
            flat = pa.array(np.concatenate(codes) if codes else np.zeros(0, dtype=np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(nodes) + 1) * WIDE, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), lists], ["doc_id", "th", "node", "size", "codes"])
        task_done()

    return run


def _sets(shingle: int):
    """(shard, node, shingles) for each unit that a text is wanted in."""
    kinds = (pa.int64(), pa.int64(), pa.binary())

    def batch(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["shard", "node", "shingles"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for b in batches:
            for node, shards, text in zip(b.column("node").to_pylist(), b.column("shards"), b.column("text")):
                made = shingle_set(text.as_py(), shingle).tobytes()
                for k in shards.as_py():
                    out.append((k, node, made))
                    size += len(made)
                    if size > SENT_BYTES:
                        yield batch(out)
                        out, size = [], 0
        if out:
            yield batch(out)
        out = []
        task_done()

    return run


class Forest:
    """Links of one task, kept as a spanning forest: each node with the smallest one that it reaches in the task."""

    def __init__(self) -> None:
        self.u = self.v = np.zeros(0, dtype=np.int64)
        self.new: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, u: np.ndarray, v: np.ndarray) -> None:
        self.new.append((u, v))
        self.size += len(u)
        if self.size > LINKS_AT_ONCE:
            self.settle()

    def settle(self) -> pa.RecordBatch:
        u, v = (np.concatenate([x, *(n[k] for n in self.new)]) for k, x in enumerate((self.u, self.v)))
        nodes, at = np.unique(np.r_[u, v], return_inverse=True)
        groups = Components(len(nodes))
        groups.link(at[: len(u)], at[len(u) :])
        tied = np.flatnonzero(groups.root != np.arange(len(nodes)))
        self.u, self.v, self.new, self.size = nodes[tied], nodes[groups.root[tied]], [], 0
        return pa.RecordBatch.from_arrays([pa.array(self.u), pa.array(self.v)], ["u", "v"])


def near_positions(keys: np.ndarray, codes: np.ndarray, beside: np.ndarray) -> np.ndarray:
    """For each position (sorted by shard) the smallest one that it reaches over near fingerprints of its shard."""
    groups, index = Components(len(keys)), GrayIndex(keys, codes)

    def link(a: np.ndarray, b: np.ndarray) -> None:
        far = np.bitwise_count(codes[a] ^ codes[b])
        near = (far <= NEAR) & (far + np.bitwise_count(beside[a] ^ beside[b]) <= BESIDE)
        groups.link(a[near], b[near])

    link(*index.neighbours())
    for a, b in index.links(NEAR, groups, FRONTIER):
        link(a, b)
    return groups.root


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per partition, sorted by shard: links (u, v) of what is near in a shard; holds one batch and one open shard."""
    names, forest = ("shard", "node", "code", "beside"), Forest()

    def solve(keys: np.ndarray, nodes: np.ndarray, codes: np.ndarray, beside: np.ndarray) -> None:
        same = keys[1:] == keys[:-1]
        pick = np.r_[False, same] | np.r_[same, False]
        keys, nodes = keys[pick], nodes[pick]
        if len(keys):
            root = near_positions(keys, codes[pick].view(np.uint64), beside[pick].view(np.uint64))
            u = np.flatnonzero(root != np.arange(len(root)))
            forest.add(nodes[u], nodes[root[u]])

    held: list[list[np.ndarray]] = []
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(c).to_numpy() for c in names]
        keys = columns[0]
        cut = int(np.searchsorted(keys == keys[-1], True))
        if cut or (held and held[-1][0][-1] != keys[0]):
            held.append([c[:cut] for c in columns])
            solve(*(np.concatenate(c) for c in zip(*held)))
            held = []
        held.append([c[cut:] for c in columns])
    if held:
        solve(*(np.concatenate(c) for c in zip(*held)))
    held = []
    yield forest.settle()
    task_done()


def unit_links(sets: list[np.ndarray], similarity: float) -> Iterator[tuple[int, int]]:
    """A spanning forest of the positions that are at least so alike: breadth first, against what is not reached yet."""
    sizes = np.array([len(s) for s in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(sizes)
    own = lambda i: ids[ends[i] - sizes[i] : ends[i]]
    here = np.zeros(int(ids.max()) + 1, dtype=bool)
    left, flat, queue = np.arange(len(sets)), ids, []
    while len(left):
        if not queue:
            queue, flat, left = [int(left[0])], flat[sizes[left[0]] :], left[1:]
        while queue and len(left):
            x = queue.pop()
            here[own(x)] = True
            starts = np.r_[0, np.cumsum(sizes[left])[:-1]]
            common = np.add.reduceat(here[flat], starts, dtype=np.int64)
            here[own(x)] = False
            near = common >= similarity * (sizes[left] + sizes[x] - common) - 1e-9
            if near.any():
                found = left[near].tolist()
                yield from ((x, y) for y in found)
                queue += found
                flat, left = flat[np.repeat(~near, sizes[left])], left[~near]
        queue = []


def _links(similarity: float):
    """Per partition, sorted by unit: links (u, v) of each unit; holds one batch and one open unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, sets, forest = None, [], [], Forest()

        def solve() -> None:
            if len(nodes) > 1 and (links := list(unit_links(sets, similarity))):
                ids = np.array(nodes, dtype=np.int64)
                x, y = np.array(links).T
                forest.add(ids[x], ids[y])

        for b in batches:
            for k, node, s in zip(b.column("shard").to_pylist(), b.column("node").to_pylist(), b.column("shingles")):
                if k != key:
                    solve()
                    key, nodes, sets = k, [], []
                nodes.append(node)
                sets.append(np.frombuffer(s.as_py(), dtype=np.uint64))
        solve()
        nodes, sets = [], []
        yield forest.settle()
        task_done()

    return run


def _in_units(clustered: DataFrame) -> DataFrame:
    """(node, shard) of (node, label, size): one unit a cluster, or one for each pair of parts of a large one."""
    n, total = F.count(F.lit(1)), F.sum("size")
    parts = F.greatest(F.ceil(total / HELD_SHINGLES), F.ceil(n / HELD_TEXTS)).cast("int")
    large = durable(clustered.groupBy("label").agg(parts.alias("parts")).where("parts > 1").withColumnRenamed("label", "whole"))
    told = clustered.join(large, F.col("label") == F.col("whole"), "left").withColumn("part", F.pmod(F.xxhash64("node", F.lit(5)), F.col("parts")).cast("int"))
    dealt = told.withColumn("other", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))))
    pair = F.xxhash64("label", F.least("part", "other"), F.greatest("part", "other"))
    return dealt.select("node", F.when(F.col("parts").isNull(), F.col("label")).otherwise(pair).alias("shard"))


def _found(texts: DataFrame, shingle: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, th, node) per row of ``texts`` (doc_id, th, text), and (node, first) with the smallest
    (doc_id, th) that the node can reach over texts so alike; null if that holds null doc_ids only.

    ``texts`` is read twice, the second time only for texts in a coarse cluster of two or more.
    """
    marked = durable(texts.mapInArrow(_marks(shingle), "doc_id long, th long, node long, size long, codes array<long>"))
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "th")))
    same = [F.first(c).alias(c) for c in ("doc_id", "th", "size", "codes")]  # of one row; any will do
    rows = durable(marked.groupBy("node").agg(first.alias("first"), *same))
    posts = []
    for w in range(WIDE):
        code, beside = F.col("codes")[w], F.col("codes")[(w + 1) % WIDE]
        for j in range(BLOCKS):
            bits = F.shiftrightunsigned(code, 16 * j).bitwiseAND(F.lit(0xFFFF))
            posts.append(F.struct((bits + F.lit((w * BLOCKS + j) << 16)).alias("shard"), code.alias("code"), beside.alias("beside")))
    posted = rows.select("node", F.explode(F.array(*posts)).alias("p")).select(F.col("p.shard").alias("shard"), "node", F.col("p.code").alias("code"), F.col("p.beside").alias("beside"))
    coarse = in_parts(posted, "node").repartition("shard").sortWithinPartitions("shard").mapInArrow(_near, "u long, v long")
    clustered = durable(components(coarse).join(rows.select("node", "doc_id", "th", "size"), "node"))
    wanted = _in_units(clustered).groupBy("node").agg(F.collect_list("shard").alias("shards")).join(clustered.select("node", "doc_id", "th"), "node")
    wanted = durable(wanted.select("node", "shards", F.col("doc_id").alias("id"), F.col("th").alias("own")))
    held = once(texts).join(wanted, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("th") == F.col("own"))).select("node", "shards", "text")
    units = held.mapInArrow(_sets(shingle), "shard long, node long, shingles binary")
    edges = units.repartition("shard").sortWithinPartitions("shard").mapInArrow(_links(similarity), "u long, v long")
    labelled = rows.select("node", "first").join(components(edges), "node", "left").withColumn("label", F.coalesce("label", "node"))
    groups = labelled.groupBy("label").agg(F.min("first").alias("least"))
    return marked.select("doc_id", "th", "node"), durable(labelled.join(groups, "label").select("node", F.col("least").alias("first")))


def near_copies(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, component_id) per row of ``docs``: the smallest doc_id that can be reached over texts so alike.

    Texts without words, null ones too, are alike. Whole texts are compared, whatever their length. Repeated
    rows come back as often as they are given; a null doc_id is never the smallest. An empty table gives an
    empty one; only doc_id and text are read.
    """
    marked, owner = _found(doc_rows(docs), shingle, similarity)
    return marked.join(owner, "node").select("doc_id", F.col("first.doc_id").alias("component_id"))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without near copies: of each component the row with the smallest doc_id stays.

    Different texts with one doc_id are told apart by a hash of the text, which also orders them: unlike ones
    all stay. Rows that repeat doc_id and text are folded to one. Rows without a doc_id cannot be told apart,
    so they all stay. All columns come back, whatever their names; an empty table gives an empty one.
    """
    named = docs.where(F.col("doc_id").isNotNull())
    _, owner = _found(doc_rows(named), shingle, similarity)
    keep = owner.select("first.*").distinct().select(F.col("doc_id").alias("id"), F.col("th").alias("own"))
    rows = named.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("key"), F.xxhash64(F.col("text").cast("string")).alias("hash"))
    kept = rows.join(keep, (F.col("key") == F.col("id")) & (F.col("hash") == F.col("own")), "left_semi").dropDuplicates(["key", "hash"])
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns]).unionByName(docs.where(F.col("doc_id").isNull()))
