"""Every column of the registered queries against the library or brute force, on a table with very long and odd texts."""

import hashlib
import json
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpusmill.llm import queries
from test_text_ops import slow_fingerprint, strange


def texts():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7)))
    long = [word() for _ in range(70_000)]  # beyond 65,536 words
    passage = [word() for _ in range(60)]
    out = [" ".join(long), " ".join(["new", *long[40_000:40_100], word()]), " ".join([word(), *passage]), " ".join([*passage, word()]), "A\n" * 40, "", None, "same", "same"]
    return out + strange(30, 3)


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("whole"))
    rows = list(enumerate(texts()))
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{d}/documents.parquet")
    return d, rows


def library(name, text):
    return Tokenizer.from_file(public_tokenizers.path(name)).encode(text or "", add_special_tokens=False).ids


def packed(ids):
    return np.array(ids, dtype="<u4").tobytes()


def test_op1(spark, table):
    d, rows = table
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.QUERIES["op1_simhash"](spark, d).collect()}
    code = {i: slow_fingerprint(t) for i, t in rows}
    root = {i: i for i in code}
    for _ in range(6):
        for a in code:
            for b in code:
                if bin(code[a] ^ code[b]).count("1") <= 3:
                    root[a] = root[b] = min(root[a], root[b])
    assert got == {i: (f"{c:016x}", root[i]) for i, c in code.items()}


def test_op4(spark, table):
    d, rows = table
    cut = {i: (t or "").encode().split() for i, t in rows}
    seen = Counter(hash(tuple(w[s : s + 35])) for w in cut.values() for s in range(len(w) - 34))
    want = set()
    for i, w in cut.items():
        gone = np.zeros(len(w), dtype=bool)
        for s in range(len(w) - 34):
            if seen[hash(tuple(w[s : s + 35]))] > 1:
                gone[s : s + 35] = True
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        want.add((i, len(w), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
    got = {(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in queries.QUERIES["op4_substring"](spark, d).collect()}
    assert got == want and sum(r[2] for r in want) > 200


def test_op5(spark, table):
    d, rows = table
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in queries.QUERIES["op5_packing"](spark, d).collect():
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in rows:
        ids, at = [*library("word_bpe_49k.json", t), 1], 0
        for r in sorted(pieces.pop(i), key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids)) and r["length"] > 0
            assert r["ids_crc32"] == zlib.crc32(packed(ids[at : at + r["length"]]))
            at += r["length"]
        assert at == len(ids)
    assert not pieces
    for held in sequences.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at == 2048 or (at < 2048 and at & (at - 1) == 0)


def test_op6(spark, table):
    d, rows = table
    vocabulary = json.load(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8"))["model"]["vocab"]
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    char = {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    longest = max(map(len, vocabulary))

    def count(word):
        text, at, n = "".join(char[b] for b in b" " + word), 0, 0
        while at < len(text):
            size = next((k for k in range(min(longest, len(text) - at), 0, -1) if text[at : at + k] in vocabulary), 0)
            if not size:
                return 1
            at, n = at + size, n + 1
        return n

    known = {}
    got = {(r["doc_id"], r["n_words"], r["n_tokens"]) for r in queries.QUERIES["op6_token_counts"](spark, d).collect()}
    want = {(i, len(w), sum(known.setdefault(x, None) or known.__setitem__(x, count(x)) or known[x] for x in w)) for i, t in rows for w in [(t or "").encode().split()]}
    assert got == want


def test_op10(spark, table):
    d, rows = table
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = set()
    for i, t in rows:
        ids = library("byte_bpe_50k.json", t)
        text = tokenizer.decode(ids, skip_special_tokens=False)
        want.add((i, len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.QUERIES["op10_bpe"](spark, d).collect()}
    assert got == want
