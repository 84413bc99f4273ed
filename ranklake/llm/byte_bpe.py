"""Byte-level BPE as a lazily determinised finite-state transducer, and its streaming decoder.

Encoding.  Merges are compiled into a test of neighbours: token b may follow token a exactly where merging
their bytes ends in a and b again, which is read off the merges along their common border
(:meth:`Merges.follows`).  A sequence of tokens is the encoding of its bytes exactly where each token is
made by merging and may follow the one before it.  So the nondeterministic transducer guesses token
ends: a hypothesis is the tokens chosen so far and a node of the trie of tokens.  Every prefix of a
piece has one encoding, so few hypotheses live at a time, none older than the longest token.

Determinised, a state is the set of live hypotheses less the tokens on which all agree.  Those are emitted at
once, however long the piece; what is held back is the lookahead, and the hypothesis that stands at a
token's end supplies the rest when the piece ends.  States and moves are made when a text first needs
them and are dropped together at ``MAX_MOVES``, so memory is bounded whatever the texts.  A piece that is a
token as a whole is that token, merges or not, as in the rank files' library.

Short pieces' outputs are kept in a bounded table, found by 64 bits of a hash of their code points and held against 64
more; pieces that differ in these run by themselves.  Texts are split by the vocabulary's pattern: where it is
the usual one, blocks of texts are split at once with numpy, else, and in a long text, pieces are taken one at a time.

Decoding runs an incremental UTF-8 machine (states by rule: how many bytes are missing and which range the
next must lie in) over the tokens' bytes; complete code points come out, up to three bytes are held back.
A move for a whole token is kept once it was made.  Ill-formed sequences become U+FFFD each and are counted.

Nothing is shuffled.  Vocabulary and tables live in each Python worker.

Defined cases: a null or empty text has no ids; null ids are no ids; an id outside the vocabulary is an error that names
it; rows with the same id are encoded each on its own; no rows give no rows; of equal names the result's
column stays, and the input's goes.
"""

from __future__ import annotations

import base64
import gc
from array import array
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ranklake.llm.blocks import Block, blocks, mix
from ranklake.llm.packing import _BASE, _INVERSE, PATTERN, _power, word_starts

#: Moves kept by a worker, with their states about 700 bytes each; beyond that it starts anew.
MAX_MOVES = 400_000
#: Pieces kept by a worker, about 50 bytes each; beyond that it starts anew.
MAX_PIECES = 1_000_000
#: Longer texts are split piece by piece.
LONG = 1 << 20

_NEVER = 1 << 62
_ROOT = 0
#: Two hashes of a piece differ by these.
_SALTS = (np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344))
#: Keys of a state beside the bytes.
_END, _SELF = -1, -2


class Merges:
    """The ranks of a byte-level vocabulary, and which token may follow which."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.raw = {rank: raw for raw, rank in ranks.items()}
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._made: dict[int, bool] = {}
        self._borders: tuple[dict, dict] = ({}, {})
        self._follows: dict[tuple[int, int], bool] = {}

    @classmethod
    def read(cls, path: str) -> Merges:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(raw): int(rank) for raw, rank in (line.split() for line in lines if line.strip())})

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a byte and for a token that no merges make."""
        if token not in self._halves:
            self._halves[token] = self._split(self.raw[token])
        return self._halves[token]

    def _split(self, raw: bytes) -> tuple[int, int] | None:
        if len(raw) == 1:
            return None
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 2:
            costs = [self.ranks.get(a + b, _NEVER) for a, b in zip(parts, parts[1:])]
            least = min(costs)
            if least == _NEVER:
                return None
            at = costs.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def made(self, token: int) -> bool:
        """Whether merges make this token out of its bytes."""
        known = self._made.get(token)
        if known is None:
            known = self._made[token] = len(self.raw[token]) == 1 or self.halves(token) is not None
        return known

    def _border(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """What stands at an end of a token while it is merged, from its byte on, and the merge that ends it."""
        known = self._borders[side]
        if token not in known:
            pair = self.halves(token)
            if pair is None:
                inner = []
            else:
                inner = self._border(pair[side], side)
                inner = [*inner[:-1], (inner[-1][0], token)]
            known[token] = [*inner, (self.raw[token], _NEVER)]
        return known[token]

    def follows(self, left: int, right: int) -> bool:
        """Whether the bytes of both, merged, are ``left`` and ``right``: no merge comes across their border.

        What stands at the border on either side lives until a merge inside its own token takes it.  While
        two such parts live, a merge of both would come first if its rank is lower, or equal to
        that on the right (of equal ranks the leftmost goes first).
        """
        key = (left, right)
        known = self._follows.get(key)
        if known is None:
            known = self._follows[key] = self._apart(self._border(left, 1), self._border(right, 0))
        return known

    def _apart(self, ends: list, begins: list) -> bool:
        i = j = 0
        while True:
            (a, a_until), (b, b_until) = ends[i], begins[j]
            across = self.ranks.get(a + b, _NEVER)
            if across < a_until and across <= b_until and across != _NEVER:
                return False
            if a_until == b_until == _NEVER:
                return True
            if a_until <= b_until:
                i += 1
            else:
                j += 1

    def forget(self) -> None:
        self._follows.clear()


class Transducer:
    """Bytes of a piece in, tokens out."""

    def __init__(self, merges: Merges, max_moves: int = MAX_MOVES):
        self.merges = merges
        self.max_moves = max_moves
        #: The trie: children by byte (none below a leaf) and token of each node.
        self._children: list[dict[int, int] | None] = [{}]
        self._token = [-1]
        for raw, token in merges.ranks.items():
            node = _ROOT
            for byte in raw:
                below = self._children[node]
                if below is None:
                    below = self._children[node] = {}
                node = below.get(byte, -1)
                if node < 0:
                    node = below[byte] = len(self._token)
                    self._token.append(-1)
                    self._children.append(None)
            self._token[node] = token
        self._states = {}
        self._reset()

    def _reset(self) -> None:
        for moves in self._states.values():
            moves.clear()  # states refer to each other
        self.merges.forget()
        #: By its hypotheses, a state: its moves by byte, the tokens still to come under END, the hypotheses under SELF.
        self._states: dict[tuple, dict] = {}
        self._n_moves = 0
        self._start = self._state((-1, (((), _ROOT),)))

    @property
    def size(self) -> int:
        """States made so far."""
        return len(self._states)

    def _state(self, key: tuple) -> dict:
        state = self._states.get(key)
        if state is None:
            state = self._states[key] = {_END: self._end(key), _SELF: key}
        return state

    def _end(self, state: tuple) -> tuple:
        """Tokens still to come if the piece ends here."""
        last, hypotheses = state
        rest = ()
        for chosen, node in hypotheses:
            if last == -1 and not chosen and self._token[node] >= 0:
                return (self._token[node],)  # the whole piece
            if node == _ROOT:
                rest = chosen
        return rest

    def _move(self, state: dict, byte: int) -> tuple[dict, tuple]:
        last, hypotheses = state[_SELF]
        children, tokens, merges = self._children, self._token, self.merges
        live = []
        for chosen, node in hypotheses:
            below = children[node]
            node = below.get(byte, -1) if below else -1
            if node < 0:
                continue
            token = tokens[node]
            grows = children[node] is not None
            if token >= 0:
                if chosen:
                    fits = merges.follows(chosen[-1], token)
                elif last == -1:
                    fits = grows = True  # the piece so far
                else:
                    fits = merges.follows(last, token)
                if fits and merges.made(token):
                    live.append(((*chosen, token), _ROOT))
            if grows:
                live.append((chosen, node))
        agreed = min((chosen for chosen, _ in live), key=len)
        for n in range(len(agreed), 0, -1):
            head = agreed[:n]
            if all(chosen[:n] == head for chosen, _ in live):
                live = [(chosen[n:], node) for chosen, node in live]
                agreed, last = head, head[-1]
                break
        else:
            agreed = ()
        if last >= 0 and all(chosen for chosen, _ in live):
            last = -2  # nothing is compared with it any more
        live.sort()
        move = state[byte] = (self._state((last, tuple(live))), agreed)
        self._n_moves += 1
        return move

    def run(self, piece: bytes) -> Iterator[tuple]:
        """Groups of tokens, each as soon as it is certain."""
        state = self._start
        for byte in piece:
            move = state.get(byte)
            if move is None:
                if self._n_moves >= self.max_moves:
                    key = state[_SELF]
                    self._reset()
                    state = self._state(key)
                move = self._move(state, byte)
            state, certain = move
            if certain:
                yield certain
        if piece:
            yield state[_END]

    def tokens(self, piece: bytes) -> tuple[int, ...]:
        return tuple(token for group in self.run(piece) for token in group)


class PieceTable:
    """Outputs of pieces met before, by two hashes of 64 bits: sorted by the first, held against the second."""

    def __init__(self):
        self.keys = self.checks = np.zeros(0, np.uint64)
        self.place = self.count = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each key is, and whether it is there."""
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return at, self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)

    def add(self, keys: np.ndarray, checks: np.ndarray, outputs: list[tuple[int, ...]]) -> None:
        count = np.fromiter(map(len, outputs), np.int64, len(outputs))
        flat = np.fromiter((t for output in outputs for t in output), np.uint32, int(count.sum()))
        place = len(self.ids) + np.cumsum(count) - count
        into = np.searchsorted(self.keys, keys)
        self.ids = np.concatenate((self.ids, flat))
        self.keys, self.checks = np.insert(self.keys, into, keys), np.insert(self.checks, into, checks)
        self.place, self.count = np.insert(self.place, into, place), np.insert(self.count, into, count)


class Encoder:
    """Texts as ids: each match of ``pattern`` runs through the transducer."""

    def __init__(self, path: str, pattern: str, max_pieces: int = MAX_PIECES):
        self.transducer = Transducer(Merges.read(path))
        self._pattern = regex.compile(pattern)
        self._at_once = pattern == PATTERN
        self._max_pieces = max_pieces
        self._pieces = PieceTable()

    def encode(self, text: str) -> list[int]:
        """Ids of one text, piece by piece."""
        out = array("i")
        matches = self._pattern.findall(text) if len(text) <= LONG else (m[0] for m in self._pattern.finditer(text))
        for piece in matches:
            for group in self.transducer.run(piece.encode()):
                out.extend(group)
        return out.tolist()

    def encode_block(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block's texts, and where each text's begin (one more than texts)."""
        texts = [block.text(i).decode("utf-8", "replace") for i in range(block.hi - block.lo)]
        if not self._at_once or len(texts) == 1 and len(texts[0]) > LONG:
            ids = [self.encode(t) for t in texts]
            return np.array([t for own in ids for t in own], np.uint32), np.cumsum([0, *map(len, ids)])
        whole = "".join(texts)
        begins = np.cumsum([0, *map(len, texts)])
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(points):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        starts = word_starts(points, begins)
        ends = np.append(starts[1:], len(points))
        keys, checks = self._hashes(points, starts, ends)
        distinct, first, which = np.unique(keys, return_index=True, return_inverse=True)
        at, there = self._pieces.find(distinct)
        new = np.flatnonzero(~there)
        if len(new):
            if len(self._pieces) + len(new) > self._max_pieces:
                # The table starts anew with the pieces of this block.
                self._pieces, new = PieceTable(), np.arange(len(distinct))
            run = self.transducer.tokens
            outputs = [run(whole[starts[i] : ends[i]].encode()) for i in first[new].tolist()]
            self._pieces.add(distinct[new], checks[first[new]], outputs)
            at, _ = self._pieces.find(distinct)
        table, at = self._pieces, at[which]
        count, place = table.count[at], table.place[at]
        into = np.concatenate(([0], np.cumsum(count)))
        ids = table.ids[np.repeat(place - into[:-1], count) + np.arange(into[-1])]
        begins = np.searchsorted(starts, begins)
        odd = np.flatnonzero(table.checks[at] != checks)
        if len(odd):  # two pieces with one key
            own = np.split(ids, into[1:-1])
            for i in odd.tolist():
                own[i] = np.array(self.transducer.tokens(whole[starts[i] : ends[i]].encode()), np.uint32)
            ids, into = np.concatenate(own), np.cumsum([0, *map(len, own)])
        return ids, into[begins]

    def _hashes(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each piece, of its code points and their places in it."""
        out = []
        values = points.astype(np.uint64)
        for salt in _SALTS:
            sums = np.empty(len(points) + 1, np.uint64)
            sums[0] = 0
            np.cumsum(mix(values + salt) * _power(_BASE, len(points)), out=sums[1:])
            out.append(mix((sums[ends] - sums[starts]) * _power(_INVERSE, len(points))[starts] + salt))
        return out[0], out[1]


# -- decoding ----------------------------------------------------------------


def _utf8_rules() -> tuple[list[dict[int, int]], list[int]]:
    """Moves of the UTF-8 machine by state and byte (state 0: between code points), and missing bytes by state."""
    tail = range(0x80, 0xC0)
    one, two, three = 1, 2, 3
    # After some first bytes the second is restricted: no overlong forms, surrogates or beyond the last code point.
    after_e0, after_ed, after_f0, after_f4 = 4, 5, 6, 7
    begin = {byte: 0 for byte in range(0x80)}
    begin |= {byte: one for byte in range(0xC2, 0xE0)}
    begin |= {byte: two for byte in range(0xE0, 0xF0)} | {0xE0: after_e0, 0xED: after_ed}
    begin |= {byte: three for byte in range(0xF0, 0xF5)} | {0xF0: after_f0, 0xF4: after_f4}
    moves = [begin, dict.fromkeys(tail, 0), dict.fromkeys(tail, one), dict.fromkeys(tail, two)]
    moves += [dict.fromkeys(range(0xA0, 0xC0), one), dict.fromkeys(range(0x80, 0xA0), one)]
    moves += [dict.fromkeys(range(0x90, 0xC0), two), dict.fromkeys(range(0x80, 0x90), two)]
    return moves, [0, 1, 2, 3, 2, 2, 3, 3]


_UTF8, _MISSING = _utf8_rules()
REPLACED = "\N{REPLACEMENT CHARACTER}"


def utf8_step(state: int, held: bytes, raw: bytes) -> tuple[int, bytes, str, int]:
    """The machine over more bytes: state, bytes held back, completed text, sequences replaced."""
    text, replaced, begin = [], 0, 0
    data = held + raw
    at = len(held)
    while at < len(data):
        following = _UTF8[state].get(data[at])
        if following is None:
            # An ill-formed sequence ends before this byte, or is this byte alone.
            replaced += 1
            whole = at - (0 if state == 0 else at - begin)
            text.append(data[begin:whole].decode() + REPLACED)
            if state == 0:
                at += 1
            begin, state = at, 0
            continue
        if state == 0 and following:
            text.append(data[begin:at].decode())
            begin = at
        state = following
        at += 1
        if state == 0:
            text.append(data[begin:at].decode())
            begin = at
    return state, data[begin:], "".join(text), replaced


class StreamDecoder:
    """Ids in, completed text out; moves for whole tokens are kept in ``known``, shared by all streams."""

    def __init__(self, raw: dict[int, bytes], known: dict):
        self._raw, self._known = raw, known
        self._state, self._held = 0, b""
        self.replaced = 0

    def push(self, ids: Iterable[int]) -> str:
        out, known, state, held = [], self._known, self._state, self._held
        for token in ids:
            key = token if not held else (held, token)
            move = known.get(key)
            if move is None:
                if token not in self._raw:
                    raise ValueError(f"id {token} is not in the vocabulary")
                move = utf8_step(state, held, self._raw[token])
                if len(known) < MAX_MOVES:
                    known[key] = move
            state, held, text, replaced = move
            out.append(text)
            if replaced:
                self.replaced += replaced
        self._state, self._held = state, held
        return "".join(out)

    def finish(self) -> str:
        """What an unfinished sequence at the end becomes."""
        if not self._held:
            return ""
        self._state, self._held = 0, b""
        self.replaced += 1
        return REPLACED


# -- operators ---------------------------------------------------------------


@contextmanager
def _no_cycles() -> Iterator[None]:
    """The collector of cycles rests: tables grow by many small objects, and :meth:`Transducer._reset` unties its own."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


@lru_cache(maxsize=4)
def _encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


@lru_cache(maxsize=4)
def _vocabulary(path: str) -> tuple[dict[int, bytes], dict]:
    return Merges.read(path).raw, {}


def _plain(docs: DataFrame, made: dict[str, Column]) -> DataFrame:
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in made], *[c.alias(n) for n, c in made.items()])


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with ids: the tokens of each text, by the ranks in ``path``, which every executor must have."""

    def ids_of(texts: pa.Array) -> pa.Array:
        flat, ends, done = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)], 0
        with _no_cycles():
            encoder = _encoder(path, pattern)
            for block in blocks(texts.cast(pa.binary())):
                ids, begins = encoder.encode_block(block)
                flat.append(ids)
                ends.append(begins[1:] + done)
                done += len(ids)
        return pa.ListArray.from_arrays(pa.array(np.concatenate(ends), pa.int32()), pa.array(np.concatenate(flat).astype(np.int32)))

    return _plain(docs, {"ids": F.arrow_udf(ids_of, "array<int>")(F.col(f"`{text}`").cast("string"))})


#: Ids that a stream takes at a time.
CHUNK = 1 << 16


def decode(coded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``coded`` with decoded (the text of its ids) and n_replaced (ill-formed sequences in it)."""

    def text_of(column: pa.Array) -> pa.Array:
        raw, known = _vocabulary(path)
        texts, replaced = [], []
        for value in column:
            stream = StreamDecoder(raw, known)
            own = value.values.to_numpy(zero_copy_only=False) if value.is_valid else ()
            parts = [stream.push(own[lo : lo + CHUNK].tolist()) for lo in range(0, len(own), CHUNK)]
            texts.append("".join(parts) + stream.finish())
            replaced.append(stream.replaced)
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(replaced, pa.int64())], ["text", "replaced"])

    made = F.arrow_udf(text_of, "struct<text:string,replaced:long>")(F.col(f"`{ids}`"))
    held = coded.select(F.struct(*[F.col(f"`{c}`") for c in coded.columns]).alias("row"), made.alias("made"))
    kept = [F.col(f"row.`{c}`").alias(c) for c in coded.columns if c not in ("decoded", "n_replaced")]
    return held.select(*kept, F.col("made.text").alias("decoded"), F.col("made.replaced").alias("n_replaced"))
