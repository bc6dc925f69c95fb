"""Packing of token sequences by minimum bin slack.

Each partition is packed by itself as it streams past, so nothing is shuffled and memory is bounded.
A document's full windows stand alone; what is left of it (shorter than a window) joins a pool held as
counts by length. For each window the longest remainder is fixed and a subset-sum dynamic programme
over bitsets picks the multiset of other lengths that comes closest to the capacity; walking the
bitsets back gives the counts, and the pattern is used as often as the pool allows. Patterns that
leave slack are not padded: documents may be cut freely, so their remainders are laid end to end and
cut at the capacity, and the very last stretch is cut into sequences whose lengths are powers of two.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusmill.llm.bpe import byte_of_char, read_spec
from corpusmill.llm.common import task_done

CAPACITY = 2048
END_ID = 1
HELD_TOKENS = 4_000_000
CACHED = 400_000
#: Texts or chunks of these characters only are encoded here; the library itself encodes any other.
PLAIN = regex.compile(r"[ \t\n!-~\xa1-\xac\xae-\xb3\xb5-\xff]+")
# Fixed value: the vocabulary's pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = b"\xff"


class WordBpe:
    """Ids of the public library for a vocabulary of words with an end marker, by pre-token.

    No pre-token spans white space and normalising one white-space chunk never changes another. So a plain
    text is cut into pre-tokens as a whole, of which short ones are kept per worker, and of any other text the
    chunks that are not plain go to the library. ``WORD_END`` stands for the end marker: as a byte that
    UTF-8 never holds, which a first merge joins to a word's last byte.
    """

    def __init__(self, spec: str) -> None:
        self.library = Tokenizer.from_str(spec)
        model, chars = json.loads(spec)["model"], byte_of_char()
        vocab, end = model["vocab"], model["end_of_word_suffix"]

        def raw(token: str) -> bytes:
            return bytes(chars[c] for c in token.removesuffix(end)) + WORD_END * token.endswith(end)

        of_byte = {b: c for c, b in chars.items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        order = [bytes([b]) for b in range(256)] + [bytes([b]) + WORD_END for b in range(255)]
        ids = [vocab[of_byte[b]] for b in range(256)] + [vocab[of_byte[b] + end] for b in range(255)]
        for a, b in dict.fromkeys(map(tuple, merges)):
            order.append(raw(a + b))
            ids.append(vocab[a + b])
        self.ids = ids
        self.core = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks={t: i for i, t in enumerate(order)}, special_tokens={})
        self.encode_piece = self.core._core_bpe.encode_single_piece
        self.pieces = regex.compile(PATTERN)
        self.added = tuple(t["content"] for t in json.loads(spec)["added_tokens"])
        self.known: dict[str, bytes] = {}
        self.odd: dict[bytes, bytes] = {}

    def _plain(self, text: str) -> bytes:
        parts, known, long = self.pieces.findall(text.lower()), self.known, {}
        if len(known) > CACHED:
            known.clear()
        encode, ids = self.encode_piece, self.ids
        for p in set(parts).difference(known):
            (known if len(p) < 64 else long)[p] = array("I", [ids[i] for i in encode(p.encode() + WORD_END)]).tobytes()
        return b"".join(map(known.__getitem__, parts) if not long else [known[p] if p in known else long[p] for p in parts])

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; null and empty: none."""
        if not text:
            return b""
        own = lambda x: PLAIN.fullmatch(x) and not any(t in x for t in self.added)
        if own(text):
            return self._plain(text)
        chunks, odd, long = text.encode("utf-8", "surrogatepass").split(), self.odd, {}
        if len(odd) > CACHED:
            odd.clear()
        for c in set(chunks).difference(odd):
            t = c.decode("utf-8", "replace")
            ids = self._plain(t) if own(t) else np.array(self.library.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()
            (odd if len(c) < 64 else long)[c] = ids
        return b"".join([odd[c] if c in odd else long[c] for c in chunks])


_LOADED: dict[int, WordBpe] = {}


def loaded(spec: str) -> WordBpe:
    if (key := hash(spec)) not in _LOADED:
        _LOADED[key] = WordBpe(spec)
    return _LOADED[key]


def fill(counts: dict[int, int], target: int) -> tuple[int, dict[int, int]]:
    """The largest sum up to ``target`` of a multiset out of ``counts``, and how many of each length it takes.

    Bit s of a bitset says that s can be reached. A length that may be taken k times enters as lumps of
    1, 2, 4, ... copies; each lump's bitset is kept, and walking them back tells which lumps were used.
    """
    reach, full, mask = 1, 1 << target, (1 << (target + 1)) - 1
    lumps: list[tuple[int, int, int]] = []
    for length in sorted((x for x in counts if x <= target), reverse=True):
        left, size = min(counts[length], target // length), 1
        while left and not reach & full:
            n = min(size, left)
            lumps.append((length, n, reach))
            reach |= (reach << (length * n)) & mask
            left, size = left - n, size * 2
        if reach & full:
            break
    best = at = reach.bit_length() - 1
    used: dict[int, int] = {}
    for length, n, before in reversed(lumps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + n
            at -= length * n
    return best, used


def plan(counts: dict[int, int], capacity: int) -> Iterator[tuple[dict[int, int], int, int]]:
    """(lengths with their counts, times used, slack) until ``counts`` is used up."""
    counts = {k: n for k, n in counts.items() if n}
    while counts:
        longest = max(counts)
        rest = counts | {longest: counts[longest] - 1}
        total, use = fill({k: n for k, n in rest.items() if n}, capacity - longest)
        use[longest] = use.get(longest, 0) + 1
        times = min(counts[k] // n for k, n in use.items())
        for k, n in use.items():
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]
        yield use, times, capacity - longest - total


def pack_lengths(lengths: list[int], capacity: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(item, start, length, sequence, offset) of pieces that cover items of these lengths, sequences from 0."""
    sequence, pool = 0, {}
    for i, n in enumerate(lengths):
        for start in range(0, n - capacity + 1, capacity):
            yield i, start, capacity, sequence, 0
            sequence += 1
        if n % capacity:
            pool.setdefault(n % capacity, []).append(i)
    loose: list[int] = []
    for use, times, slack in plan({k: len(v) for k, v in pool.items()}, capacity):
        for _ in range(times):
            members = [pool[k].pop() for k, n in use.items() for _ in range(n)]
            if slack:
                loose += members
                continue
            offset = 0
            for i in members:
                n = lengths[i] % capacity
                yield i, lengths[i] - n, n, sequence, offset
                offset += n
            sequence += 1
    left = sum(lengths[i] % capacity for i in loose)
    room = size = 0
    for i in loose:
        start, n = lengths[i] - lengths[i] % capacity, lengths[i] % capacity
        while n:
            if not room:
                size = room = capacity if left >= capacity else 1 << (left.bit_length() - 1)
            take = min(n, room)
            yield i, start, take, sequence, size - room
            start, n, room, left = start + take, n - take, room - take, left - take
            if not room:
                sequence += 1


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents, arranged in sequences of at most ``capacity`` tokens.

    A row per piece: doc_id, start (ids of the document before it), ids (little-endian unsigned 32-bit),
    doc_tokens (with the closing ``end_id``), sequence_id, offset. A null or empty text is the closing id
    alone. No sequence needs padding: each is full or has a power of two tokens. sequence_id is unique
    over all partitions but not dense. Repeated rows are packed as often as they are given; texts of any length
    are encoded whole; an empty table gives an empty one; only doc_id and text are read.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(path))
    names = ["doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset"]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

    def flush(held: list[tuple[int | None, bytes]], base: int) -> Iterator[pa.RecordBatch]:
        lengths, rows = [len(ids) // 4 for _, ids in held], []
        for i, start, n, sequence, offset in pack_lengths(lengths, capacity):
            doc, ids = held[i]
            rows.append((doc, start, ids[4 * start : 4 * (start + n)], lengths[i], base + sequence, offset))
            if len(rows) == 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, last = loaded(spec.value), np.array([end_id], dtype="<u4").tobytes()
        base, held, tokens = TaskContext.get().partitionId() << 40, [], 0
        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                ids = bpe.encode(text.as_py()) + last
                held.append((doc, ids))
                tokens += len(ids) // 4
                if tokens >= HELD_TOKENS:
                    yield from flush(held, base)
                    base, held, tokens = base + tokens, [], 0
        if held:
            yield from flush(held, base)
        held = []
        task_done(bpe.known, bpe.odd)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long"
    )
