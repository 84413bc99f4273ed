"""Packing: bounded-space online best fit into windows of at most ``size`` tokens.

Each task keeps ``open_windows`` windows open.  A document's token ids, closed by id 0, are cut into
full windows and a rest.  The rest goes into the open window that it fills best; when it fits in
none, the fullest window takes what it has room for and is emitted, and what remains goes on.  What is still open when a task's input
ends is written as leftover; afterwards leftovers of up to ``MERGE`` tasks at a time are merged whole,
the largest first, each into the fullest window that still takes it.

Nothing is shuffled but leftovers, which are at most ``open_windows`` per task.  The packed pieces are
one table in shared storage, so a lost executor repeats a task and not the job; a task's result
depends on its rows and partition number only.

Tokenisation: the vocabulary's split into words is done with numpy on code points; each distinct word
is encoded once per worker, behind a bounded cache.  Where the ``tokenizers`` file is a plain byte-level
BPE, its words are encoded by ``tiktoken`` with the ranks of that same file (5 instead of 18 microseconds
a word, equal ids); any other file of this word pattern is left to ``tokenizers``.  Tokens that the file
adds to its vocabulary (``<|endoftext|>``) are found in raw texts first, the longest of the leftmost, and
what lies between them is split into words on its own, as ``tokenizers`` does.

Defined cases: a null or empty text is the single id 0; rows with the same doc_id are packed each on
its own; no rows give no pieces.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranklake.llm.blocks import Block, blocks, mix
from ranklake.sources.storage import stored

SIZE = 1024
OPEN = 64
#: Tasks whose leftovers one merging task takes.
MERGE = 1024
#: Distinct words kept by a worker; beyond that it starts anew.
CACHE_WORDS = 1_000_000

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "sequence_length long, open boolean, part int"
)

#: The word pattern of the byte-level vocabularies this packs with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# Classes of code points in the vocabulary's word pattern.
_LETTER, _DIGIT, _SPACE, _OTHER = 0, 1, 2, 3
_CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Class and random value of every code point."""
    import regex

    every = "".join(map(chr, (i for i in range(0x110000) if not 0xD800 <= i < 0xE000)))
    kinds = np.full(0x110000, _OTHER, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}"), (_DIGIT, r"\p{N}"), (_SPACE, r"\s")):
        found = np.frombuffer("".join(regex.findall(pattern, every)).encode("utf-32-le"), np.uint32)
        kinds[found] = kind
    values = np.random.default_rng(20240602).integers(1, 1 << 63, 0x110000, dtype=np.uint64)
    return kinds, values


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        table = np.full(max(n, 1 << 20), base, np.uint64)
        table[0] = 1
        have = _powers[base] = np.multiply.accumulate(table)
    return have[:n]


def word_starts(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the words of the byte-level BPE pattern begin, in texts that begin at ``offsets``.

    The pattern: 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
    """
    n = len(points)
    kind = _tables()[0][points]
    begins = np.zeros(n + 1, bool)
    begins[offsets] = True
    text_start = begins[:n].copy()
    # A word begins where the class changes.
    begins[1:n] |= kind[1:] != kind[:-1]
    space = kind == _SPACE
    # The last space of a run before something else: a blank goes with the next word, others stand alone.
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & ~space[1:] & ~text_start[1:]
    at = np.flatnonzero(last)
    blank = points[at] == 0x20
    begins[at] = True
    begins[at[blank] + 1] = False
    # Contractions: an apostrophe that begins a word, then one of a few letter sequences.
    quotes = np.flatnonzero((points == 0x27) & begins[:n])
    if len(quotes):
        ends = offsets[np.searchsorted(offsets, quotes, "right")] if len(offsets) > 1 else np.full(len(quotes), n)
        for q, end in zip(quotes.tolist(), ends.tolist()):
            after = points[q + 1 : min(q + 3, end)].tobytes().decode("utf-32-le")
            for c in _CONTRACTIONS:
                if after.startswith(c):
                    begins[q + 1] = False
                    if q + 1 + len(c) < end:
                        stop = q + 1 + len(c)
                        # The letters after a contraction are a word of their own.
                        begins[stop] = begins[stop] or kind[stop] == _LETTER
                    break
    return np.flatnonzero(begins[:n])


def _byte_ranks(path: str) -> dict[bytes, int] | None:
    """Bytes to id of a byte-level BPE whose merges are numbered in order, else None."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    vocab = model["vocab"]
    if model["type"] != "BPE" or any(vocab.get("".join(m)) != 256 + i for i, m in enumerate(merges)):
        return None
    words = [c for c in byte_of] + ["".join(m) for m in merges]
    return {bytes(byte_of[c] for c in w): vocab[w] for w in words}


def _encode_words(path: str):
    """Function from a list of words to the list of their ids."""
    ranks = _byte_ranks(path)
    if ranks is not None:
        import tiktoken

        encoding = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda words: [encoding.encode_ordinary(w) for w in words]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return lambda words: [e.ids for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]


class WordEncoder:
    """Token ids of blocks of texts, word by word."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        self.encode_words = _encode_words(path)
        self.limit = cache_words
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.place = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        found = self.encode_words(words)
        count = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((x for ids in found for x in ids), np.uint32, int(count.sum()))
        place = len(self.ids) + np.cumsum(count) - count
        self.ids = np.concatenate((self.ids, flat))
        merged = np.concatenate((self.keys, keys))
        order = np.argsort(merged, kind="stable")
        self.keys = merged[order]
        self.place = np.concatenate((self.place, place))[order]
        self.count = np.concatenate((self.count, count))[order]

    def encode(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the block's texts, and where each text's begin (one more than texts)."""
        texts = [block.text(i).decode("utf-8", "replace") for i in range(block.hi - block.lo)]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        offsets = np.concatenate(([0], np.cumsum(lengths)))
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(points)
        if n == 0:
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        starts = word_starts(points, offsets)
        ends = np.append(starts[1:], n)
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_tables()[1][points] * _power(_BASE, n), out=sums[1:])
        keys = mix((sums[ends] - sums[starts]) * _power(_INVERSE, n)[starts])
        distinct, first, which = np.unique(keys, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, distinct)
        new = np.flatnonzero(at >= len(self.keys))
        known = np.flatnonzero(at < len(self.keys))
        new = np.sort(np.concatenate((new, known[self.keys[at[known]] != distinct[known]])))
        if len(new):
            if len(self.keys) + len(new) > self.limit:
                # The cache starts anew with all words of this block.
                self._clear()
                new = np.arange(len(distinct))
            whole = "".join(texts)
            self._learn(distinct[new], [whole[starts[i] : ends[i]] for i in first[new].tolist()])
            at = np.searchsorted(self.keys, distinct)
        count = self.count[at][which]
        place = self.place[at][which]
        into = np.concatenate(([0], np.cumsum(count)))
        ids = self.ids[np.repeat(place - into[:-1], count) + np.arange(into[-1])]
        return ids, into[np.searchsorted(starts, offsets)]


class TextEncoder:
    """Token ids of blocks of texts: the file's added tokens, and between them words."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        self.words = WordEncoder(path, cache_words)
        with open(path, encoding="utf-8") as file:
            added = [t for t in json.load(file).get("added_tokens") or [] if t["content"]]
        for t in added:
            if t.get("lstrip") or t.get("rstrip") or t.get("single_word"):
                raise ValueError(f"{path}: added token {t['content']!r} takes in its surroundings, which is not supported")
        self.added = {t["content"].encode(): t["id"] for t in added}
        longest = sorted(self.added, key=len, reverse=True)
        self.pattern = re.compile(b"(" + b"|".join(map(re.escape, longest)) + b")") if longest else None

    def encode(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the block's texts, and where each text's begin (one more than texts)."""
        texts = [block.text(i) for i in range(block.hi - block.lo)]
        if self.pattern is None or not any(map(self.pattern.search, texts)):
            return self.words.encode(block)
        # Pieces between added tokens stand at even places, the tokens at odd ones.
        parts = [self.pattern.split(t) for t in texts]
        between = pa.array([p for own in parts for p in own[::2]], pa.binary())
        encoded = (x for b in blocks(between) for x in self._pieces(b))
        ids, begin = [], [0]
        for own in parts:
            found = []
            for i, part in enumerate(own):
                found.append(np.array([self.added[part]], np.uint32) if i % 2 else next(encoded))
            ids += found
            begin.append(begin[-1] + sum(map(len, found)))
        return np.concatenate(ids), np.array(begin, np.int64)

    def _pieces(self, block: Block) -> list[np.ndarray]:
        ids, at = self.words.encode(block)
        return [ids[at[i] : at[i + 1]] for i in range(block.hi - block.lo)]


class OpenWindows:
    """A fixed number of windows being filled; each is a list of pieces."""

    def __init__(self, size: int, limit: int):
        self.size, self.limit = size, limit
        self.fill: list[int] = []
        self.pieces: list[list] = []

    def place(self, start: int, length: int, cut) -> list:
        """Puts ``length`` ids from ``start`` into the window they fill best; returns windows that are done.

        Where they fit in none, the fullest takes what it has room for and is emitted; the rest goes on.
        ``cut`` makes the piece of a start and a length.
        """
        best = -1
        for i, fill in enumerate(self.fill):
            if fill + length <= self.size and (best < 0 or fill > self.fill[best]):
                best = i
        done: list = []
        if best < 0:
            if len(self.fill) == self.limit:
                fullest = max(range(self.limit), key=self.fill.__getitem__)
                room = self.size - self.fill[fullest]
                self._add(fullest, start, room, cut)
                return self._pop(fullest) + self.place(start + room, length - room, cut)
            self.fill.append(0)
            self.pieces.append([])
            best = len(self.fill) - 1
        self._add(best, start, length, cut)
        if self.fill[best] == self.size:
            done = self._pop(best)
        return done

    def _add(self, i: int, start: int, length: int, cut) -> None:
        self.pieces[i].append((cut(start, length), self.fill[i], length))
        self.fill[i] += length

    def _pop(self, i: int) -> list:
        pieces = [(*p, self.fill[i], i_) for i_, p in enumerate(self.pieces[i])]
        self.fill[i], self.pieces[i] = self.fill[-1], self.pieces[-1]
        self.fill.pop()
        self.pieces.pop()
        return pieces

    def rest(self) -> Iterator[list]:
        while self.fill:
            yield self._pop(0)


def _packer(path: str, size: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, windows = _encoder(path), OpenWindows(size, limit)
        part, number = TaskContext.get().partitionId(), 0
        out: list[tuple] = []

        def emit(window: list, open: bool) -> None:
            nonlocal number
            for piece, offset, _, fill, i in window:
                if i == 0:
                    number += 1
                out.append((*piece, (part << 32) + number - 1, offset, fill, open, part))

        for batch in batches:
            names, done = batch.column(0).to_pylist(), 0
            for block in blocks(batch.column(1)):
                ids, begin = encoder.encode(block)
                for i in range(block.hi - block.lo):
                    own = np.append(ids[begin[i] : begin[i + 1]], np.uint32(0)).astype("<u4")

                    def cut(start, length, own=own, name=names[done + i]):
                        return (name, start, length, zlib.crc32(own[start : start + length].tobytes()), len(own))

                    full = len(own) - len(own) % size
                    for start in range(0, full, size):
                        emit([(cut(start, size), 0, size, size, 0)], False)
                    if full < len(own):
                        emit(windows.place(full, len(own) - full, cut), False)
                done += block.hi - block.lo
                if len(out) >= 8192:
                    yield _batch(out)
                    out.clear()
        for window in windows.rest():
            emit(window, True)
        if out:
            yield _batch(out)

    return run


_FIELDS = pa.schema(
    [(n, {"long": pa.int64(), "boolean": pa.bool_(), "int": pa.int32()}[t]) for n, t in (x.split() for x in PIECES.split(","))]
)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _FIELDS.types)], schema=_FIELDS)


_encoders: dict[str, TextEncoder] = {}


def _encoder(path: str) -> TextEncoder:
    """One per worker process, which may serve many tasks."""
    if path not in _encoders:
        _encoders[path] = TextEncoder(path)
    return _encoders[path]


def _merge(size: int):
    def run(table: pa.Table) -> pa.Table:
        """Leftover windows of some tasks, merged whole: the largest first, best fit."""
        rows = table.to_pandas().sort_values(["sequence_id", "offset"], kind="stable")
        lengths = rows.groupby("sequence_id")["sequence_length"].first().sort_values(ascending=False, kind="stable")
        by_fill: list[list[int]] = [[] for _ in range(size + 1)]
        into: dict[int, tuple[int, int]] = {}
        fills: dict[int, int] = {}
        for seq, length in lengths.items():
            room = next((f for f in range(size - length, 0, -1) if by_fill[f]), 0)
            target = by_fill[room].pop() if room else seq
            into[seq] = (target, room)
            fills[target] = room + length
            by_fill[room + length].append(target)
        rows["offset"] += rows["sequence_id"].map(lambda s: into[s][1])
        rows["sequence_id"] = rows["sequence_id"].map(lambda s: into[s][0])
        rows["sequence_length"] = rows["sequence_id"].map(fills)
        return pa.Table.from_pandas(rows, schema=table.schema, preserve_index=False)

    return run


def pack(docs: DataFrame, path: str, size: int = SIZE, open_windows: int = OPEN, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece of a document: where it lies in it and in which sequence.

    ``path`` names the tokenizer's file, which every executor must have.
    """
    source = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    packed = stored(source.mapInArrow(_packer(path, size, open_windows), PIECES), "packed")
    merged = (
        packed.filter("open")
        .withColumn("part", F.expr(f"part div {MERGE}").cast("int"))
        .groupBy("part")
        .applyInArrow(_merge(size), PIECES)
    )
    return packed.filter(~F.col("open")).unionByName(merged).drop("open", "part")
