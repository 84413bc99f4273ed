"""Byte-level BPE against the rank files' library and plain merging."""

import base64
import hashlib
import os
import random

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from ranklake.llm import byte_bpe, queries
from ranklake.llm.blocks import blocks

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id long, text string, ids string, decoded string"


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return byte_bpe.Encoder(PATH, public_tokenizers.PATTERN)


def merged(ranks, raw):
    """Plain merging: the leftmost pair of the least rank, again and again."""
    parts = [raw[i : i + 1] for i in range(len(raw))]
    while True:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not pairs:
            return [ranks[p] for p in parts]
        i = min(pairs)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def toy(merges):
    ranks = {bytes([b]): b for b in range(256)}
    for m in merges:
        ranks[m.encode()] = len(ranks)
    return byte_bpe.Merges(ranks)


def test_follows_is_merging_of_both():
    merges = toy(["aa", "ab", "aab", "ba", "aaaa", "bb", "abba", "bab", "cc", "ccc"])
    tokens = [t for t in merges.raw if t >= 256 or bytes([t]) in (b"a", b"b", b"c")]
    for a in tokens:
        for b in tokens:
            assert merges.follows(a, b) == (merged(merges.ranks, merges.raw[a] + merges.raw[b]) == [a, b]), (merges.raw[a], merges.raw[b])


def test_small_vocabularies_equal_plain_merging():
    r = random.Random(3)
    for _ in range(60):
        made, known = [], ["a", "b", "c"]
        for _ in range(r.randint(1, 14)):
            new = r.choice(known) + r.choice(known)
            if len(new) <= 12 and new not in known:
                made.append(new)
                known.append(new)
        merges = toy(made)
        # Ranks must rise from parts to wholes, and merges must make every token, as training does.
        if any(not merges.made(t) or merges.halves(t) and max(merges.halves(t)) > t for t in merges.raw):
            continue
        transducer = byte_bpe.Transducer(merges, max_moves=r.choice([1, 5, 10_000]))
        for _ in range(200):
            raw = "".join(r.choice("abc") for _ in range(r.randint(1, 30))).encode()
            want = merged(merges.ranks, raw) if raw not in merges.ranks else [merges.ranks[raw]]
            assert list(transducer.tokens(raw)) == want


def test_tokens_come_after_a_bounded_lookahead(encoder):
    raw = ("the internationalisation of unbelievable" * 400).replace(" ", "").encode()
    sent = consumed = 0

    def counted():
        nonlocal consumed
        for byte in raw:
            consumed += 1
            yield byte

    worst = 0
    for group in encoder.transducer.run(counted()):
        sent += sum(len(encoder.transducer.merges.raw[t]) for t in group)
        worst = max(worst, consumed - sent)
    assert sent == len(raw) and worst < 64


def test_equal_to_the_library(encoder, library):
    r = random.Random(4)
    parts = ["a", "b", " ", "  ", "\n", "\r\n", "1", "=", "-", "é", "漢", "😀", "the", "ing", "'s", "'LL", "_", "x" * 9, "=" * 70, " " * 130, "\x1c", "\x85", "　", "﻿", "<|endoftext|>"]
    for _ in range(6000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 16)))
        assert encoder.encode(text) == library.encode_ordinary(text)
    for text in ("x" * 30_000, " " * 30_000, "=" * 30_001, "aab" * 9_999, "word " * 9_000):
        assert encoder.encode(text) == library.encode_ordinary(text)
    points = "".join(chr(c) + "a " for c in range(0x3000) if not 0xD800 <= c < 0xE000)
    assert encoder.encode(points) == library.encode_ordinary(points)


def block_ids(encoder, texts):
    """Ids of each text by blocks."""
    out = []
    for block in blocks(pa.array([t.encode() for t in texts]), 4000):
        ids, begins = encoder.encode_block(block)
        out += [ids[a:b].tolist() for a, b in zip(begins[:-1], begins[1:])]
    return out


def test_blocks_equal_the_library(library, monkeypatch):
    r = random.Random(6)
    parts = ["a", "b", " ", "  ", "\n", "1", "=", "é", "漢", "😀", "the", "ing", "'s", "'LL", "'", "_", " " * 20, "\x1c", "\x85", "　", "Word"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(1500)] + ["", "", "x" * 6000, "a b " * 3000]
    want = [library.encode_ordinary(t) for t in texts]
    assert block_ids(byte_bpe.Encoder(PATH, public_tokenizers.PATTERN), texts) == want
    # A small table, few moves, long texts piece by piece, another pattern's way: the same.
    small = byte_bpe.Encoder(PATH, public_tokenizers.PATTERN, max_pieces=50)
    small.transducer.max_moves = 7
    assert block_ids(small, texts) == want and len(small._pieces) <= 1000
    assert small.transducer.size <= 10
    monkeypatch.setattr(byte_bpe, "LONG", 50)
    assert block_ids(byte_bpe.Encoder(PATH, public_tokenizers.PATTERN), texts) == want
    other = byte_bpe.Encoder(PATH, "(?:" + public_tokenizers.PATTERN + ")")
    assert not other._at_once and block_ids(other, texts) == want


def test_pieces_of_one_key_are_told_apart(library, monkeypatch):
    hashes = byte_bpe.Encoder._hashes

    def alike(self, points, starts, ends):
        keys, checks = hashes(self, points, starts, ends)
        return keys % 5, checks

    monkeypatch.setattr(byte_bpe.Encoder, "_hashes", alike)
    texts = ["one two three four", "five six", "", "seven eight nine ten eleven twelve"] * 30
    assert block_ids(byte_bpe.Encoder(PATH, public_tokenizers.PATTERN), texts) == [library.encode_ordinary(t) for t in texts]


def test_decoder_holds_back_unfinished_code_points():
    r = random.Random(5)
    raw = {b: bytes([b]) for b in range(256)} | {256: "é漢".encode(), 257: "😀".encode()[:3], 258: b"\x80\x80", 259: b"ab\xe6"}
    for _ in range(3000):
        ids = [r.choice([*range(0x60, 0x66), 0xC3, 0xA9, 0xE6, 0xBC, 0xA2, 0xF0, 0x9F, 0xED, 0xA0, 0xF4, 0x90, 0xC0, 0xFF, 256, 257, 258, 259]) for _ in range(r.randint(0, 12))]
        stream, known, out = byte_bpe.StreamDecoder(raw, {}), [], ""
        for token in ids:
            out += stream.push([token])
            known.append(token)
            assert len(stream._held) <= 3
        data = b"".join(raw[t] for t in ids)
        assert out + stream.finish() == data.decode("utf-8", "replace")
        assert stream.replaced == 0 or byte_bpe.REPLACED in data.decode("utf-8", "replace")
    with pytest.raises(ValueError, match="99999"):
        byte_bpe.StreamDecoder(raw, {}).push([99_999])


def test_tables(spark, library):
    texts = [None, "", " ", "one two", "one two", "x" * 60_000, "word " * 30_000, "\x00", "ключ 漢字 😀"]
    docs = spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(texts)] + [(None, "no id", "c", "c"), (3, "one two", "c", "c")], DOCS)
    coded = byte_bpe.encode(docs, PATH, public_tokenizers.PATTERN)
    assert coded.columns == ["doc_id", "text", "decoded", "ids"]
    back = byte_bpe.decode(coded, PATH)
    assert back.columns == ["doc_id", "text", "ids", "decoded", "n_replaced"]
    rows = back.collect()
    assert len(rows) == len(texts) + 2
    for row in rows:
        assert row["ids"] == library.encode_ordinary(row["text"] or "")
        assert row["decoded"] == (row["text"] or "") and row["n_replaced"] == 0
    empty = byte_bpe.decode(byte_bpe.encode(docs.limit(0), PATH, public_tokenizers.PATTERN), PATH)
    assert empty.count() == 0
    nulls = spark.createDataFrame([(1, None), (2, [])], "k int, ids array<int>")
    assert [r["decoded"] for r in byte_bpe.decode(nulls, PATH).collect()] == ["", ""]


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_op12_digests(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = queries.op12_byte_bpe(spark, SF_DIR).collect()
    assert len(rows) == len(texts)
    for row in rows:
        ids = library.encode_ordinary(texts[row["doc_id"]])
        assert row["n_tokens"] == len(ids) and row["n_replaced"] == 0
        assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(texts[row["doc_id"]].encode()).hexdigest()
