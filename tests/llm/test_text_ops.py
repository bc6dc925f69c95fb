"""Tokenizers, packing, word pieces and SimHash against the public library and brute force."""

import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from corpusmill.llm import bpe, packing, queries, simhash, wordpiece
from corpusmill.llm.common import Components

SF = "/root/testdata/sf0.001"
ODD = "abcXYZ 123  \n\t'sdlltre.,!?éüßñÀÉ中日😀́\x1c\x85\xa0 　<|endoftext|>Ⅷ٣क्षि‍Σσςİı"


def strange(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 40))) + "<|endoftext|>" * rng.randint(0, 1) for _ in range(n)]


LONG = ["", "a" * 3000, "ab " * 2000, "zq" * 1500 + " " * 1500 + "x", "the quick brown fox " * 300]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(strange(40, 7) + LONG)] + [(900, None, None, None), (None, "no id", "y", 2), (0, strange(40, 7)[0], "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, start int")


@pytest.mark.parametrize("name,make", [("byte_bpe_50k.json", bpe.ByteBpe), ("word_bpe_49k.json", packing.WordBpe)])
def test_ids_equal_the_library(name, make):
    path = public_tokenizers.path(name)
    library, own = Tokenizer.from_file(path), make(bpe.read_spec(path))
    for text in strange(600) + LONG:
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text), "<u4").tolist() == want, text[:60]
        if make is bpe.ByteBpe:
            assert own.decode(own.encode(text)) == library.decode(want, skip_special_tokens=False)
    assert own.encode(None) == b""


def test_forced_boundaries_never_lie_inside_a_token():
    own = bpe.ByteBpe(bpe.read_spec(public_tokenizers.path("byte_bpe_50k.json")))
    tokens = [t for t in own.bytes_of if len(t) > 1 and t != b"<|endoftext|>"]
    parts, count = own.fragments(tokens)
    assert set(count) == {1} and parts == tokens
    parts, count = own.fragments([b"ab\x00cd", b"x"])
    assert b"".join(parts) == b"ab\x00cdx" and sum(count) == len(parts) > 2


def test_encode_and_decode_rows(spark, docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = bpe.encode(docs, path, decoded=True).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((r["doc_id"], r["text"] or "") for r in docs.collect())
    again = bpe.decode(bpe.encode(docs, path), path).collect()
    assert Counter(r["text"] for r in again) == Counter(r["text"] for r in got)
    assert bpe.encode(docs.limit(0), path).count() == 0


def test_fill_finds_the_best_multiset():
    rng = random.Random(3)
    for _ in range(200):
        counts = {rng.randint(1, 12): rng.randint(1, 3) for _ in range(4)}
        target = rng.randint(1, 40)
        best, used = packing.fill(counts, target)
        sums = {0}
        for k, n in counts.items():
            sums |= {s + k * j for s in sums for j in range(n + 1) if s + k * j <= target}
        assert best == max(sums) == sum(k * n for k, n in used.items())
        assert all(n <= counts[k] for k, n in used.items())


@pytest.mark.parametrize("lengths", [[], [1], [2048], [5000, 1, 1], [1500] * 9, [random.Random(5).randint(1, 6000) for _ in range(300)]])
def test_pieces_cover_every_id_once(lengths):
    covered, sequences = defaultdict(list), defaultdict(list)
    for item, start, n, sequence, offset in packing.pack_lengths(lengths, 2048):
        covered[item].append((start, n))
        sequences[sequence].append((offset, n))
    for spans in [*covered.values(), *sequences.values()]:
        at = 0
        for start, n in sorted(spans):
            assert start == at and n > 0
            at += n
    assert {i: sum(n for _, n in s) for i, s in covered.items()} == dict(enumerate(lengths))
    assert all((t := sum(n for _, n in s)) == 2048 or t & (t - 1) == 0 for s in sequences.values())


def test_pack_rows(spark, docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    own = packing.WordBpe(bpe.read_spec(path))
    rows = packing.pack(docs, path).collect()
    parts = defaultdict(dict)
    for r in rows:
        parts[r["doc_id"], r["doc_tokens"]].setdefault(r["start"], bytes(r["ids"]))
    end = np.array([1], "<u4").tobytes()
    for r in docs.collect():
        want = own.encode(r["text"]) + end
        assert b"".join(parts[r["doc_id"], len(want) // 4][k] for k in sorted(parts[r["doc_id"], len(want) // 4])) == want
    assert sum(len(r["ids"]) // 4 for r in rows) == sum(len(own.encode(r["text"])) // 4 + 1 for r in docs.collect())
    assert packing.pack(docs.limit(0), path).count() == 0


def test_piece_counts_equal_greedy_matching(spark, docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    vocabulary = set(bpe.ByteBpe(bpe.read_spec(path)).bytes_of[:-1])
    longest = max(map(len, vocabulary))

    def greedy(word):
        n = at = 0
        while at < len(word):
            at = next(e for e in range(min(len(word), at + longest), at, -1) if word[at:e] in vocabulary)
            n += 1
        return n

    got = wordpiece.token_counts(docs, path).collect()
    want = [(r["doc_id"], w := (r["text"] or "").encode().split(), sum(greedy(b" " + x) for x in w)) for r in docs.collect()]
    assert Counter(map(tuple, got)) == Counter((i, len(w), n) for i, w, n in want)


def test_a_word_that_gets_stuck_is_one_piece():
    m = wordpiece.LongestMatch([b"ab", b"abc", b"d", b"bcd"])
    assert [m.count(w) for w in (b"abcd", b"abd", b"abx", b"", b"abcabd")] == [2, 2, 1, 0, 3]


def slow_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", text)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    for text in strange(100) + [None, "", " \t\n", "One", "one TWO", "É a b A B c"] + LONG:
        assert simhash.fingerprint(text) == slow_fingerprint(text)


def brute(codes, shards, distance):
    out = set()
    for i in range(len(codes)):
        for j in range(i):
            if shards[i] == shards[j] and bin(int(codes[i]) ^ int(codes[j])).count("1") <= distance:
                out.add((j, i))
    return out


@pytest.mark.parametrize("spread", [3, 12, 64])
def test_gray_index_finds_every_link(spread, monkeypatch):
    monkeypatch.setattr(simhash, "FRONTIER", 500)
    rng = np.random.default_rng(spread)
    codes = np.unique(rng.integers(0, 2**62, 6, dtype=np.uint64)[rng.integers(0, 6, 160)] ^ (np.uint64(1) << rng.integers(0, spread, 160).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, spread, 160).astype(np.uint64)))
    shards = rng.integers(0, 3, len(codes))
    found = {(min(a, b), max(a, b)) for x, y in simhash.GrayIndex(shards, codes).links(3) for a, b in zip(x.tolist(), y.tolist())}
    assert found == brute(codes, shards, 3)
    index, groups = simhash.GrayIndex(shards, codes), Components(len(codes))
    for a, b in index.links(3, groups):  # skips what is linked already, but no link between groups
        groups.link(a, b)
    root = np.arange(len(codes))
    for a, b in sorted(found) * 12:
        root[a] = root[b] = min(root[a], root[b])
    assert groups.root.tolist() == root.tolist()


def test_components_of_arrays():
    c = Components(6)
    c.link(np.array([3, 5]), np.array([4, 3]))
    c.link(np.array([4]), np.array([1]))
    assert c.root.tolist() == [0, 1, 2, 1, 1, 1]


@pytest.mark.parametrize("split_above", [4096, 2])
def test_near_duplicates(spark, split_above, monkeypatch):
    monkeypatch.setattr(simhash, "SPLIT_ABOVE", split_above)
    rng = random.Random(2)
    base = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(900)]
    texts = []
    for k in range(12):
        words = list(base)
        for _ in range(k % 4):
            words[rng.randrange(900)] = "changed"
        texts.append(" ".join(words))
    texts += [None, "", "x y", "x y", "something else entirely that is not near", texts[0].upper()]
    docs = spark.createDataFrame([(100 - i, t, "f") for i, t in enumerate(texts)] + [(100, texts[0], "f")], "doc_id long, text string, fp string")
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    ids, codes = [100 - i for i in range(len(texts))], [slow_fingerprint(t) for t in texts]
    root = {i: i for i in ids}
    for _ in ids:
        for a, x in zip(ids, codes):
            for b, y in zip(ids, codes):
                if bin(x ^ y).count("1") <= 3:
                    root[a] = root[b] = min(root[a], root[b])
    assert got == {i: (f"{c:016x}", root[i]) for i, c in zip(ids, codes)}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_sample_queries_run(spark):
    for name in ("op5_packing", "op6_token_counts", "op10_bpe"):
        assert queries.QUERIES[name](spark, SF).count() >= spark.read.parquet(os.path.join(SF, "documents.parquet")).count()
