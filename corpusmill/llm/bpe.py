"""Byte-pair encoding and decoding with forced boundaries.

A pair of bytes that occurs inside no token of the vocabulary can never be joined by a merge, so a
token boundary is certain between them. After the pre-tokenizer's cuts (made first, as its pattern
looks ahead) pieces are cut at every such pair; the fragments are encoded independently and their ids
concatenated. Fragments recur far more often than pieces, and a text of any length is encoded in
bounded steps. Results equal those of the public tokenizers library for the same file.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The byte-level alphabet prints these bytes as themselves, the others from U+0100 on.
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
# The pre-tokenizer's pattern, with its white space spelt out.
SPACE = r"\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
CACHED = 200_000
ROWS = 1000


def byte_of_char() -> dict[str, int]:
    others = (b for b in range(256) if b not in set(PRINTED))
    return {chr(b): b for b in PRINTED} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteBpe:
    """Encoder and decoder for one byte-level vocabulary, given as the text of its JSON file."""

    def __init__(self, spec: str) -> None:
        self.file = json.loads(spec)
        chars, vocab = byte_of_char(), self.file["model"]["vocab"]
        raw = lambda token: bytes(chars[c] for c in token)
        merges = [m if isinstance(m, list) else m.split(" ") for m in self.file["model"]["merges"]]
        singles = [t for t in vocab if len(t) == 1]
        order = [*singles, *dict.fromkeys(a + b for a, b in merges)]
        self.ids = np.array([vocab[t] for t in order], dtype="<u4")  # by rank
        self.core = tiktoken.Encoding("fragments", pat_str=r"\S+", mergeable_ranks={raw(t): i for i, t in enumerate(order)}, special_tokens={})
        added = {t["content"]: t["id"] for t in self.file["added_tokens"]}
        self.added = {t: np.array([i], dtype="<u4").tobytes() for t, i in added.items()}
        self.cut_added = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.pieces = regex.compile(PATTERN)
        size = max([*vocab.values(), *added.values()]) + 1
        self.bytes_of = [b""] * size
        for t, i in vocab.items():
            self.bytes_of[i] = raw(t)
        for t, i in added.items():
            self.bytes_of[i] = t.encode()
        self.joined = np.zeros(1 << 16, dtype=bool)
        for t in order:
            b = np.frombuffer(raw(t), dtype=np.uint8).astype(np.int64)
            self.joined[b[:-1] << 8 | b[1:]] = True
        self.piece_ids: dict[str, bytes] = {}
        self.fragment_ids: dict[bytes, bytes] = {}

    def fragments(self, pieces: list[bytes]) -> tuple[list[bytes], list[int]]:
        """``pieces`` cut at each forced boundary, and how many fragments each gave."""
        text = b"".join(pieces)
        at = np.cumsum([len(p) for p in pieces])
        b = np.frombuffer(text, dtype=np.uint8).astype(np.int64)
        cut = ~self.joined[b[:-1] << 8 | b[1:]]
        cut[at[:-1] - 1] = True
        ends = np.r_[np.flatnonzero(cut) + 1, len(text)]
        starts = np.r_[0, ends[:-1]]
        count = np.diff(np.r_[0, np.searchsorted(ends, at, "right")])
        return [text[s:e] for s, e in zip(starts.tolist(), ends.tolist())], count.tolist()

    def _learn(self, pieces: Iterable[str]) -> dict[str, bytes]:
        """Ids of ``pieces``; those of short ones are kept."""
        new = list(pieces)
        if not new:
            return {}
        if len(self.fragment_ids) > CACHED:
            self.fragment_ids.clear()
        parts, count = self.fragments([p.encode("utf-8", "surrogatepass") for p in new])
        encode, known, ids = self.core._encode_single_piece, self.fragment_ids, self.ids
        out = []
        for f in parts:
            if (got := known.get(f)) is None:
                got = ids[encode(f)].tobytes()
                if len(f) < 64 and len(parts) > len(new):  # else pieces and fragments are the same
                    known[f] = got
            out.append(got)
        at, long = 0, {}
        for p, n in zip(new, count):
            (self.piece_ids if len(p) < 64 else long)[p] = out[at] if n == 1 else b"".join(out[at : at + n])
            at += n
        return long

    def _encode_plain(self, text: str) -> list[bytes]:
        pieces = self.pieces.findall(text)
        known = self.piece_ids
        if len(known) > CACHED:
            known.clear()
        long = self._learn(set(pieces).difference(known))
        return list(map(known.__getitem__, pieces)) if not long else [known[p] if p in known else long[p] for p in pieces]

    def encode(self, text: str | None) -> bytes:
        """The ids of ``text`` as little-endian unsigned 32-bit integers; null and empty: none."""
        if not text:
            return b""
        if self.cut_added is None or not self.cut_added.search(text):
            return b"".join(self._encode_plain(text))
        out: list[bytes] = []
        for i, part in enumerate(self.cut_added.split(text)):
            out += [self.added[part]] if i % 2 else self._encode_plain(part)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        table = self.bytes_of
        return b"".join([table[i] for i in np.frombuffer(ids, dtype="<u4").tolist()]).decode("utf-8", "replace")


_LOADED: dict[int, ByteBpe] = {}


def loaded(spec: str) -> ByteBpe:
    """The encoder for ``spec``, built once in each Python worker."""
    if (key := hash(spec)) not in _LOADED:
        _LOADED[key] = ByteBpe(spec)
    return _LOADED[key]


def read_spec(path: str) -> str:
    """The vocabulary file, read where the plan is made; it is a few MB whatever the corpus holds."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, path: str, decoded: bool = False) -> DataFrame:
    """(doc_id, ids) per row of ``docs``: ids as little-endian unsigned 32-bit integers; null text: none.

    With ``decoded`` a third column, text, has the ids decoded again by the same worker. Texts of any length are
    encoded whole, repeated rows as often as given; an empty table gives an empty one; only doc_id and text are read.
    """
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(path))
    names = ["doc_id", "ids", "text"][: 2 + decoded]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(spec.value)
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                ids = [bpe.encode(t.as_py()) for t in part.column("text")]
                columns = [part.column("doc_id"), pa.array(ids, pa.binary())]
                if decoded:
                    columns.append(pa.array([bpe.decode(i) for i in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, ids binary" + ", text string" * decoded
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text): the text of each row of ``encoded`` (doc_id, ids); null ids: null."""
    spec = encoded.sparkSession.sparkContext.broadcast(read_spec(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(spec.value)
        for b in batches:
            texts = [None if i.as_py() is None else bpe.decode(i.as_py()) for i in b.column("ids")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
