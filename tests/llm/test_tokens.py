"""Pre-tokens, counts, packing and the piece codec against the libraries and brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import regex
import sentencepiece
from tokenizers import Tokenizer

from orbitrace.llm import packing as pk
from orbitrace.llm import sentencepiece_codec as sp
from orbitrace.llm.pretokens import Spans, scan
from orbitrace.llm.token_counts import TokenCounter, count_tokens

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LETTERS = "ab'sretvlmd  \n\t1²!?é中　\x1c\xa0zqthonig"


def odd_texts(n=400, seed=1, size=40):
    rng = random.Random(seed)
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, size))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BPE)


def test_pretokens_match_the_pattern():
    texts = [*odd_texts(), "a" * 1000 + "'s" + " " * 300 + "b", "'" * 700, "x" * 131 + "'re'st"]
    spans = Spans(texts)
    got = [[] for _ in texts]
    for i, row in enumerate(spans.row.tolist()):
        got[row].append(spans.text(i))
    pattern = regex.compile(public_tokenizers.PATTERN)
    assert got == [pattern.findall(t) for t in texts]


def test_scan_does_not_depend_on_chunks():
    rng = np.random.RandomState(0)
    stream = rng.choice([0, 0, 0, 1, 2, 5, 6, 7, 8, 9], size=3000).astype(np.uint8)
    assert np.array_equal(scan(stream, 7), scan(stream, 1000))


def test_counts_match_the_library(library):
    texts = [*odd_texts(), "a" * 3000, "-" * 300, " " * 500, "", "x<|endoftext|> y<|endoftext|><|endoftext|>"]
    assert TokenCounter(BPE).counts(texts).tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_counts_after_a_reset(library, monkeypatch):
    counter = TokenCounter(BPE)
    monkeypatch.setattr("orbitrace.llm.token_counts.MAX_TRANSITIONS", 50)
    texts = odd_texts(50, 2)
    assert counter.counts(texts).tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_count_query(docs, no_docs, library):
    got = sorted(((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(docs, BPE).collect()))
    want = []
    for r in docs.collect():
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        want.append((r.doc_id or -1, len((r.text or "").encode()), n, n > 512))
    assert got == sorted(want)
    assert count_tokens(no_docs, BPE).count() == 0


def best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits)[1]] -= n
        else:
            rooms.append(capacity - n)
    return rooms


@pytest.mark.parametrize("seed", range(30))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 17, 64])
    lengths = [min(capacity, 1 + int(rng.expovariate(1 / (capacity * rng.random() + 1)))) for _ in range(rng.randint(0, 150))]
    histogram = {n: lengths.count(n) for n in set(lengths)}
    bins = {}
    for n, _, used, first, offset in pk.plan_bins(histogram, capacity):
        for i in range(used):
            bins.setdefault(first + i, []).append((offset, n))
    for placed in bins.values():
        at = 0
        for offset, n in sorted(placed):
            assert offset == at
            at += n
        assert at <= capacity
    assert sum(map(len, bins.values())) == len(lengths)
    assert len(bins) == len(best_fit(lengths, capacity))


def test_tightest_bin():
    bins = pk.OpenBins(100)
    for room in (7, 30, 31, 99):
        bins.add(room, room, 1)
    assert [bins.tightest(n) for n in (1, 7, 8, 31, 32, 100)] == [7, 7, 30, 31, 99, None]


def test_packed_documents(docs, no_docs, library):
    out = pk.pack_documents(docs, BPE, capacity=64).collect()
    seqs, whole = {}, {}
    for r in out:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        whole.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
    for placed in seqs.values():
        at = 0
        for offset, n in sorted(placed):
            assert offset == at
            at += n
        assert at <= 64
    want = {}
    for r in docs.collect():
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        cuts = [0, *range(len(ids) % 64 or 64, len(ids) + 1, 64)]
        want.setdefault(r.doc_id, []).extend((a, b - a, zlib.crc32(ids[a:b].tobytes())) for a, b in zip(cuts[:-1], cuts[1:], strict=True))
    assert {k: sorted(v) for k, v in whole.items()} == {k: sorted(v) for k, v in want.items()}
    assert pk.pack_documents(no_docs, BPE).count() == 0


def unigram_library():
    """The model file read as a unigram model: one byte of its trainer options changed in memory."""
    raw = bytearray(open(PIECES, "rb").read())

    def varint(i):
        value = shift = 0
        while True:
            value |= (raw[i] & 127) << shift
            shift += 7
            i += 1
            if raw[i - 1] < 128:
                return value, i

    i = 0
    while i < len(raw):
        key, i = varint(i)
        size, i = varint(i)
        if key >> 3 == 2:
            j = i
            while raw[j] != 3 << 3:
                tag, k = varint(j)
                if tag & 7 == 2:
                    n, k = varint(k)
                    j = k + n
                else:
                    j = k + 4 if tag & 7 == 5 else varint(k)[1]
            raw[j + 1] = 1
        i += size
    return sentencepiece.SentencePieceProcessor(model_proto=bytes(raw))


@pytest.fixture(scope="module")
def codec():
    return sp.UnigramCodec(PIECES)


def test_viterbi_matches_the_library(codec):
    rng = random.Random(4)
    texts = [re.sub(" +", " ", "".join(rng.choice("abcdefghilmnoprstuvw  .,AEé") for _ in range(rng.randint(0, 30)))).strip() for _ in range(500)]
    lib = unigram_library()
    assert [ids.tolist() for ids, _ in codec.encode_batch(texts)] == [lib.encode(t) for t in texts]


def test_side_by_side_equals_one_by_one(codec):
    texts = ["漢🀄 x", "a" * 500, "  a  b", "", "\n\t x", *odd_texts(200, 8)]
    for text, (ids, score) in zip(texts, codec.encode_batch(texts), strict=True):
        paths = [codec.best_path(u) for u in codec.unit.findall(codec.model.normalize(text))]
        assert ids.tolist() == [i for p, _ in paths for i in p]
        assert score == pytest.approx(sum(s for _, s in paths))
        assert codec.decode(ids) == text
        assert codec.decode(ids) == codec.model.decode(ids.tolist())


def test_trie_finds_all_prefixes():
    keys = {k.encode(): i for i, k in enumerate(["a", "ab", "abc", "b", "bc", "é", "éa", "zzzz"])}
    trie = sp.DoubleArrayTrie(keys)
    for text in (b"abcd", "éab".encode(), b"zzz", b"", b"q"):
        assert trie.prefixes(text) == [(n, keys[text[:n]]) for n in range(1, len(text) + 1) if text[:n] in keys]


def test_codec_over_documents(docs, no_docs):
    out = sp.encode_documents(docs, PIECES, with_ids=True)
    assert out.where("NOT round_trip").count() == 0
    back = sorted((r.doc_id or -1, r.text) for r in sp.decode_documents(out, PIECES).collect())
    assert back == sorted((r.doc_id or -1, r.text or "") for r in docs.collect())
    assert sp.encode_documents(no_docs, PIECES).count() == 0


def regular_words(n, pairs=("ab", "tr", "xy")):
    """Thue-Morse words and their complements: polynomial hashes modulo 2**64 of these are equal."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return ["".join(p[b ^ flip] for b in bits) for p in pairs for flip in (0, 1)]


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_words_of_equal_hash_are_told_apart(library, n):
    words = regular_words(n)
    texts = [*words, " ".join(words), *words[::-1]]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    counter, encoder = TokenCounter(BPE), pk.Encoder(BPE)
    for _ in range(2):
        assert counter.counts(texts).tolist() == [len(ids) for ids in want]
        assert [ids.tolist() for ids in encoder.ids(texts)] == want
    # over batches: what is remembered is told apart too
    counter, encoder = TokenCounter(BPE), pk.Encoder(BPE)
    assert [counter.counts([t])[0] for t in words] == [len(ids) for ids in want[: len(words)]]
    assert [encoder.ids([t])[0].tolist() for t in words] == want[: len(words)]


@pytest.mark.parametrize("seed", range(40))
def test_loads_equal_best_fit_piece_by_piece(seed):
    rng = random.Random(1000 + seed)
    capacity = rng.choice([12, 40, 100, 1024])
    lengths = [300] * 4 + [250] * 2 + [220] if seed == 0 else [rng.randint(1, max(1, int(capacity * rng.random()))) for _ in range(rng.randint(1, 300))]
    capacity = 1024 if seed == 0 else capacity
    loads = Counter()
    for n, _, used, first, _ in pk.plan_bins(Counter(lengths), capacity):
        for i in range(used):
            loads[first + i] += n
    assert sorted(loads.values()) == sorted(capacity - r for r in best_fit(lengths, capacity))
