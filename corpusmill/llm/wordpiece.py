"""Counts of greedy word pieces by a linear longest-match automaton.

The vocabulary's trie gets failure links for longest-match-first splitting: where the next byte has no
child, the link of a node names the node that holds what is left after the pieces matched so far are
popped, and how many those are is stored with it. One pass over a word therefore adds up its number of
pieces without building any, in time linear in its length (Song et al., Fast WordPiece, 2021).
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.bpe import byte_of_char, read_spec
from corpusmill.llm.common import words_of

CACHED = 250_000
STUCK = -1


class LongestMatch:
    """Automaton over ``tokens`` (byte strings); a word that cannot be split counts as one unknown piece."""

    def __init__(self, tokens: Iterable[bytes]) -> None:
        child: list[dict[int, int]] = [{}]
        ends: list[bool] = [False]
        for t in tokens:
            node = 0
            for c in t:
                if (nxt := child[node].get(c)) is None:
                    nxt = child[node][c] = len(child)
                    child.append({})
                    ends.append(False)
                node = nxt
            ends[node] = node != 0
        fail, popped = [STUCK] * len(child), [0] * len(child)
        todo = deque((0, c, n) for c, n in child[0].items())
        while todo:
            parent, c, node = todo.popleft()
            if ends[node]:
                fail[node], popped[node] = 0, 1  # the whole of it is one piece
            else:
                at, n = fail[parent], popped[parent]
                while at != STUCK and c not in child[at]:
                    n += popped[at]
                    at = fail[at]
                if at != STUCK:
                    fail[node], popped[node] = child[at][c], n
            todo.extend((node, x, m) for x, m in child[node].items())
        self.child, self.fail, self.popped = child, fail, popped

    def count(self, word: bytes) -> int:
        child, fail, popped = self.child, self.fail, self.popped
        node = total = 0
        for c in word:
            while (nxt := child[node].get(c)) is None:
                total += popped[node]
                node = fail[node]
                if node == STUCK:
                    return 1
            node = nxt
        while node > 0:
            total += popped[node]
            node = fail[node]
        return 1 if node == STUCK else total


class PieceCounter:
    """Pieces of texts for a byte-level vocabulary in which a leading space marks the start of a word."""

    def __init__(self, spec: str) -> None:
        chars = byte_of_char()
        self.automaton = LongestMatch(bytes(chars[c] for c in t) for t in json.loads(spec)["model"]["vocab"])
        self.known: dict[bytes, int] = {}

    def count(self, text: str | None) -> tuple[int, int]:
        """(words, pieces) of ``text``."""
        words, known = words_of(text), self.known
        long = {}
        if len(known) > CACHED:
            known.clear()
        for w in set(words).difference(known):
            (known if len(w) < 64 else long)[w] = self.automaton.count(b" " + w)
        return len(words), sum(map(known.__getitem__, words) if not long else [known[w] if w in known else long[w] for w in words])


_LOADED: dict[int, PieceCounter] = {}


def loaded(spec: str) -> PieceCounter:
    if (key := hash(spec)) not in _LOADED:
        _LOADED[key] = PieceCounter(spec)
    return _LOADED[key]


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_words, n_tokens) per row of ``docs``.

    Words are runs of anything but ASCII white space. Each is split, with the word-start mark before
    it, into the longest vocabulary token at every point from the left; a word that gets stuck counts
    as one piece. Null and empty texts have no words; repeated rows come back as often as given; texts and
    words of any length are counted whole; an empty table gives an empty one; only doc_id and text are read.
    """
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = loaded(spec.value)
        for b in batches:
            got = np.array([counter.count(t.as_py()) for t in b.column("text")], dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(got[:, 0]), pa.array(got[:, 1])], ["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_words long, n_tokens long")
