"""Substring dedup: words covered by a window that occurs more than once in the corpus are removed.

Reference shards are found first, so that no text is compared with the whole corpus. Each window of
``window`` words picks the smallest hash among its runs of ``ANCHOR`` words (the leftmost of equals), so
equal windows pick equal anchors at the same place. Consecutive windows with one anchor form a region, every
window lies in exactly one region, and the regions of one anchor are a reference shard. Anchors that occur
once are done with. Regions are named by a hash of their words; of a region that occurs twice or more every
window does, which needs no more than a count. What is left are shards with a region that occurs once beside
others. One copy of each of their regions is built into the shard's suffix automaton, which knows how often
each substring occurs, and the single regions are streamed through it for matching statistics: where the
longest suffix that occurs twice reaches the threshold, its span is removed.

A shard's automaton lives in the task that its regions are shuffled to and is not broadcast: all automata
together grow with the corpus (README has figures). A shard of more than ``CROWDED`` different regions is not
built; its regions are taken apart into their windows, which are counted by hash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import attach, doc_rows, durable, frequent, task_done, words_of

WINDOW = 35
ANCHOR = 10
CROWDED = 1024
SEED_WORD, SEED_LOW, SEED_HIGH = 3, 17, 18
CACHED = 100_000
STEP = 1 << 16
MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))  # fixed values: a 64-bit finaliser
BASE = np.uint64(0x9E3779B97F4A7C15)  # fixed value: an odd 64-bit multiplier
UNBASE = np.uint64(pow(int(BASE), -1, 1 << 64))
S33 = np.uint64(33)


class WordHashes:
    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def of(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        try:
            return np.array([known[w] for w in words], dtype=np.uint64)
        except KeyError:
            if len(known) > CACHED:
                known.clear()
            out = []
            for w in words:
                if (h := known.get(w)) is None:
                    h = xxhash.xxh64_intdigest(w, SEED_WORD)
                    if len(w) < 64:
                        known[w] = h
                out.append(h)
            return np.array(out, dtype=np.uint64)


_HASHES = WordHashes()


def mixed(x: np.ndarray) -> np.ndarray:
    for m in MIX:
        x = (x ^ (x >> S33)) * m
    return x ^ (x >> S33)


class Powers:
    """Powers of BASE and of its inverse, modulo 2**64, up to the longest text so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n >= len(self.up):
            size = max(2 * len(self.up), n + 1)
            self.up = np.cumprod(np.r_[np.ones(1, dtype=np.uint64), np.full(size - 1, BASE)])
            self.down = np.cumprod(np.r_[np.ones(1, dtype=np.uint64), np.full(size - 1, UNBASE)])
        return self.up[:n], self.down[: n + 1]


POWERS = Powers()


def regions(words: list[bytes], window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window start, last window start, hash of all words) of the regions of one text, in order."""
    n = len(words)
    if n < window:
        return (np.zeros(0, dtype=np.int64),) * 4
    h = _HASHES.of(words)
    runs = np.zeros(n - anchor + 1, dtype=np.uint64)
    for k in range(anchor):
        runs = runs * BASE + h[k : n - anchor + 1 + k]
    runs = mixed(runs)
    span = window - anchor + 1
    picked = np.empty(n - window + 1, dtype=np.int64)
    for at in range(0, len(picked), STEP):
        part = np.lib.stride_tricks.sliding_window_view(runs[at : at + STEP + span - 1], span)
        picked[at : at + len(part)] = part.argmin(axis=1) + np.arange(at, at + len(part))
    first = np.flatnonzero(np.r_[True, picked[1:] != picked[:-1]])
    last = np.r_[first[1:], len(picked)] - 1
    up, down = POWERS.of(n)
    before = np.r_[np.zeros(1, dtype=np.uint64), np.cumsum(h * up)]
    whole = (before[last + window] - before[first]) * down[first] + (last - first).astype(np.uint64) * MIX[0]
    return runs[picked[first]].view(np.int64), first, last, mixed(whole).view(np.int64)


class SuffixAutomaton:
    """Automaton of all substrings of several word sequences, with how often each occurs."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.len, self.count = [-1], [0], [0]

    def _new(self, length: int, nxt: dict[bytes, int], link: int) -> int:
        self.next.append(nxt)
        self.len.append(length)
        self.link.append(link)
        self.count.append(0)
        return len(self.len) - 1

    def _split(self, p: int, w: bytes, q: int) -> int:
        """The state for the longest string of state p followed by w, where q holds longer ones too."""
        nxt, link, length = self.next, self.link, self.len
        if length[q] == length[p] + 1:
            return q
        clone = self._new(length[p] + 1, dict(nxt[q]), link[q])
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = clone
            p = link[p]
        link[q] = clone
        return clone

    def add(self, words: list[bytes], times: int = 1) -> None:
        nxt, link, length, count, last = self.next, self.link, self.len, self.count, 0
        for w in words:
            if (q := nxt[last].get(w)) is not None:
                last = self._split(last, w, q)
            else:
                p, last = last, self._new(length[last] + 1, {}, 0)
                while p >= 0 and w not in nxt[p]:
                    nxt[p][w] = last
                    p = link[p]
                if p >= 0:
                    link[last] = self._split(p, w, nxt[p][w])
            count[last] += times

    def close(self) -> None:
        """Add up the counts; call it once, after the last ``add``."""
        for v in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            self.count[self.link[v]] += self.count[v]

    def repeated(self, words: list[bytes], least: int, times: int = 2) -> list[tuple[int, int]]:
        """Maximal spans [start, end) of ``words`` covered by matches of ``least`` words or more that occur ``times`` times."""
        nxt, link, length, count = self.next, self.link, self.len, self.count
        spans: list[tuple[int, int]] = []
        state = size = 0
        for i, w in enumerate(words, 1):
            while state and w not in nxt[state]:
                state = link[state]
                size = length[state]
            if (to := nxt[state].get(w)) is None:
                continue
            state, size = to, size + 1
            v, n = state, size
            while v and count[v] < times:
                v = link[v]
                n = length[v]
            if v and n >= least:
                if spans and i - n <= spans[-1][1]:
                    spans[-1] = (min(spans[-1][0], i - n), i)
                else:
                    spans.append((i - n, i))
        return spans


def keep(words: list[bytes], spans: list[int]) -> list[bytes]:
    """``words`` without the spans, packed as ``start << 32 | end``."""
    at, kept = 0, []
    for x in sorted(spans):
        kept += words[at : x >> 32]
        at = max(at, x & 0xFFFFFFFF)
    return kept + words[at:]


def _regions_of(window: int, anchor: int):
    """(dealt, known, anchor, doc_id, th, windows, whole, n, spans): regions, and what is known of them already.

    Equal regions of a batch are folded to one row with their number n; windows is ``first << 32 | last`` of the
    one that is kept. That they repeat is settled, so their spans go on, merged, as a row per document (n = 0).
    Rows whose anchor recurs in their batch are known to be shared and are dealt out evenly. For each such anchor
    one more row without a document goes where the anchor's other rows go, so a frequent anchor sends a row per
    batch there, not one per occurrence.
    """
    names = ["dealt", "known", "anchor", "doc_id", "th", "windows", "whole", "n", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [regions(words_of(t.as_py()), window, anchor) for t in b.column("text")]
            count = np.array([len(f[0]) for f in found], dtype=np.int64)
            cat = lambda k: np.concatenate([f[k] for f in found] or [np.zeros(0, dtype=np.int64)])
            key, windows, whole, doc = cat(0), cat(1) << 32 | cat(2), cat(3), np.repeat(np.arange(len(count)), count)
            _, kept, back, times = np.unique(mixed(whole.view(np.uint64) + key.view(np.uint64) * BASE), return_index=True, return_inverse=True, return_counts=True)
            again = np.flatnonzero(times[back] > 1)
            # regions that overlap in one document make one span
            start, end, of_doc = cat(1)[again], cat(2)[again] + window, doc[again]
            head = np.flatnonzero(np.r_[True, (of_doc[1:] != of_doc[:-1]) | (start[1:] > end[:-1])][: len(again)])
            merged = start[head] << 32 | end[np.r_[head[1:], len(again)][: len(head)] - 1]
            with_spans, sizes = np.unique(of_doc[head], return_counts=True)
            spans = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(merged))
            values, place = np.unique(key[kept], return_inverse=True)
            total = np.bincount(place, times, len(values))
            known, signs = total[place] > 1, values[total > 1]
            even = (key[kept] ^ (windows[kept] * 31 + b.column("th").to_numpy()[doc[kept]])) * np.int64(0x9E3779B97F4A7C1)
            none, rest = np.zeros(len(signs), dtype=np.int64), np.zeros(len(with_spans), dtype=np.int64)
            of = lambda c: pa.concat_arrays([b.column(c).take(pa.array(doc[kept])), pa.nulls(len(signs), pa.int64()), b.column(c).take(pa.array(with_spans))])
            columns = [
                np.r_[np.where(known, even, key[kept]), signs, b.column("th").to_numpy()[with_spans]], np.r_[known, none.astype(bool), rest == 0], np.r_[key[kept], signs, rest],
                of("doc_id"), of("th"), np.r_[windows[kept], none - 1, rest], np.r_[whole[kept], none, rest], np.r_[times, none, rest],
                pa.concat_arrays([pa.nulls(len(kept) + len(signs), pa.list_(pa.int64())), spans]),
            ]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)
        task_done(_HASHES.known)

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows, sorted by (known, anchor), that are known or whose anchor is also in another row; one row is held."""
    out = ["anchor", "doc_id", "th", "windows", "whole", "n", "spans"]
    held: pa.RecordBatch | None = None
    again = False  # the held row's anchor was in the row before it as well

    def real(rows: pa.RecordBatch) -> pa.RecordBatch:
        return rows.filter(pa.array(rows.column("windows").to_numpy() >= 0)).select(out)

    for b in batches:
        known = b.column("known").to_numpy(zero_copy_only=False)
        if known.any():
            yield b.filter(pa.array(known)).select(out)
            b = b.filter(pa.array(~known))
        if not b.num_rows:
            continue
        key = b.column("anchor").to_numpy()
        same = held is not None and held.column("anchor")[0].as_py() == key[0]
        if held is not None and (same or again):
            yield real(held)
        twin = key[1:] == key[:-1]
        pick = np.r_[same, twin] | np.r_[twin, False]
        yield real(b.slice(0, len(key) - 1).filter(pa.array(pick[:-1])))
        held, again = b.slice(len(key) - 1), bool(np.r_[same, twin][-1])
    if held is not None and again:
        yield real(held)
    held = b = None
    task_done()


def _texts_of_regions(window: int):
    """(anchor, doc_id, th, first, times, region) of the regions wanted of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, th, text, wanted in zip(*(b.column(c) for c in ("doc_id", "th", "text", "wanted"))):
                doc, th, words = doc.as_py(), th.as_py(), words_of(text.as_py())
                for w in wanted.as_py():
                    x = w["windows"]
                    out.append((w["anchor"], doc, th, x >> 32, w["times"], b" ".join(words[x >> 32 : (x & 0xFFFFFFFF) + window])))
            kinds = [pa.int64()] * 5 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)] if out else [pa.array([], t) for t in kinds], ["anchor", "doc_id", "th", "first", "times", "region"])
        task_done()

    return run


def _windows_of_regions(window: int):
    """(doc_id, th, first, times, low, high) of each window of the regions wanted: low and high name its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, th, text, wanted in zip(*(b.column(c) for c in ("doc_id", "th", "text", "wanted"))):
                doc, th, words = doc.as_py(), th.as_py(), words_of(text.as_py())
                for w in wanted.as_py():
                    for s in range(w["windows"] >> 32, (w["windows"] & 0xFFFFFFFF) + 1):
                        run_of = b" ".join(words[s : s + window])
                        out.append((doc, th, s, w["times"], *(xxhash.xxh64_intdigest(run_of, k) - (1 << 63) for k in (SEED_LOW, SEED_HIGH))))
            kinds = [pa.int64()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)] if out else [pa.array([], t) for t in kinds], ["doc_id", "th", "first", "times", "low", "high"])
        task_done()

    return run


def _matched(window: int):
    """Per partition, sorted by anchor: (doc_id, th, span) of what recurs in the single regions; holds one shard of at most CROWDED regions."""

    def solve(shard: Iterable[list]) -> Iterator[tuple[int | None, int, int]]:
        automaton = SuffixAutomaton()
        split = [r[4].split() for r in shard]
        for words, r in zip(split, shard):
            automaton.add(words, r[3])
        automaton.close()
        for words, (doc, th, first, times, _) in zip(split, shard):
            if times == 1:
                for start, end in automaton.repeated(words, window):
                    yield doc, th, (first + start) << 32 | (first + end)

    def batch(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["doc_id", "th", "span"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shard, out = None, {}, []
        for b in batches:
            for a, *r in zip(*(b.column(c).to_pylist() for c in ("anchor", "doc_id", "th", "first", "times", "region"))):
                if a != now:
                    out += solve(shard.values())
                    now, shard = a, {}
                shard[tuple(r[:3])] = r  # rows that repeat a document give its regions again
            if len(out) > 4096:
                yield batch(out)
                out = []
        out += solve(shard.values())
        if out:
            yield batch(out)
        shard = {}
        task_done()

    return run


def repeated_spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, crowded: int = CROWDED) -> DataFrame:
    """(doc_id, th, spans): per document with repeats, its removed spans as longs ``start << 32 | end``, in words."""
    if not 0 < anchor <= window:
        raise ValueError("the anchor must fit into the window")
    rows = doc_rows(docs)
    columns = "anchor long, doc_id long, th long, windows long, whole long, n long, spans array<long>"
    found = rows.mapInArrow(_regions_of(window, anchor), f"dealt long, known boolean, {columns}")
    told = durable(found.repartition("dealt").sortWithinPartitions("known", "anchor").mapInArrow(_shared, columns))
    places = told.where("n > 0")
    # of a region's places any will do: its words are the same everywhere
    some = [F.first(c).alias(c) for c in ("doc_id", "th", "windows")]
    classes = durable(places.groupBy("anchor", "whole").agg(F.sum("n").alias("times"), F.count_if(F.col("n") == 1).alias("ones"), *some))
    shards = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("times") == 1).alias("single"))
    open_ones = durable(attach(classes.select("anchor", "times", "doc_id", "th", "windows"), shards, ["anchor"], frequent(shards)).where("n > 1 AND single > 0"))

    def texts(wanted: DataFrame) -> DataFrame:
        """The texts that hold the regions ``wanted``, each with a list of them."""
        wanted = durable(wanted.groupBy("doc_id", "th").agg(F.collect_list(F.struct("anchor", "times", "windows")).alias("wanted")))
        return rows.join(wanted, rows["doc_id"].eqNullSafe(wanted["doc_id"]) & (rows["th"] == wanted["th"])).select(rows["doc_id"], rows["th"], "text", "wanted")

    built = texts(open_ones.where(F.col("n") <= crowded)).mapInArrow(_texts_of_regions(window), "anchor long, doc_id long, th long, first long, times long, region binary")
    matched = built.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_matched(window), "doc_id long, th long, span long")
    apart = texts(open_ones.where(F.col("n") > crowded)).mapInArrow(_windows_of_regions(window), "doc_id long, th long, first long, times long, low long, high long")
    apart = durable(apart.dropDuplicates())
    counted = apart.groupBy("low", "high").agg(F.count(F.lit(1)).alias("n"), F.sum("times").alias("total"))
    single = attach(apart, counted, ["low", "high"], frequent(counted)).where("times = 1 AND total > 1")
    span = lambda first, last: F.shiftleft(first, 32) + last + window
    alone = single.select("doc_id", "th", span(F.col("first"), F.col("first")).alias("span"))
    # what is alone in its batch and repeats elsewhere; the rest of what repeats is settled since it was read
    twice = classes.where("times > 1 AND ones > 0").select("anchor", "whole", F.col("ones").alias("n"))
    apart_ones = places.where("n = 1").select("anchor", "whole", "doc_id", "th", "windows")
    whole = attach(apart_ones, twice, ["anchor", "whole"], frequent(twice)).select("doc_id", "th", (F.col("windows") + window).alias("span"))
    settled = told.where("n = 0").select("doc_id", "th", F.explode("spans").alias("span"))
    return whole.unionByName(settled).unionByName(matched).unionByName(alone).groupBy("doc_id", "th").agg(F.collect_set("span").alias("spans"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, text, n_words, n_removed) per row of ``docs``; text has the kept words, joined by one space.

    Words are runs of anything but ASCII white space, unchanged. Removed is each word covered by a window
    of ``window`` words of one document whose words also start anywhere else, in the same document or in
    another row; windows are judged on the input. Repeated rows are two documents, so their windows repeat.
    A null text has no words and gives an empty one; a document shorter than a window keeps every word. Texts
    of any length are taken whole; arrays of a number per word are what a long one costs. An empty table gives
    an empty one; other columns are not read.
    """
    rows = doc_rows(docs)
    spans = repeated_spans(docs, window, anchor)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, totals, gone = [], [], []
            for t, spans in zip(b.column("text"), b.column("spans")):
                words = words_of(t.as_py())
                kept = keep(words, spans.as_py() or [])
                texts.append(b" ".join(kept).decode("utf-8", "replace"))
                totals.append(len(words))
                gone.append(len(words) - len(kept))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("th"), pa.array(texts, pa.string()), pa.array(totals, pa.int64()), pa.array(gone, pa.int64())],
                ["doc_id", "th", "text", "n_words", "n_removed"],
            )
        task_done()

    joined = rows.join(spans, rows["doc_id"].eqNullSafe(spans["doc_id"]) & (rows["th"] == spans["th"]), "left")
    made = joined.select(rows["doc_id"], rows["th"], "text", "spans").mapInArrow(apply, "doc_id long, th long, text string, n_words long, n_removed long")
    return made.select("doc_id", "text", "n_words", "n_removed")


def without_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``: see remove_repeats.

    Only texts that lose words change (their words are joined by one space); all other rows, null and empty texts
    too, stay as they are, with all their columns, whatever their names. Rows that repeat doc_id and text are two
    documents whose windows repeat, so both lose them; very long texts are taken whole, and an empty table gives an
    empty one.
    """
    others = [c for c in docs.columns if c != "text"]
    keyed = docs.select(F.struct(*others).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("own"), F.col("text").cast("string").alias("text"))
    spans = repeated_spans(docs, window, anchor)
    joined = keyed.join(spans, keyed["id"].eqNullSafe(spans["doc_id"]) & (keyed["own"] == spans["th"]), "left").select("row", "text", "spans")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [
                t.as_py() if not x.is_valid else b" ".join(keep(words_of(t.as_py()), x.as_py())).decode("utf-8", "replace")
                for t, x in zip(b.column("text"), b.column("spans"))
            ]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(texts, pa.string())], ["row", "text"])
        task_done()

    made = joined.mapInArrow(apply, joined.select("row", "text").schema)
    return made.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])
