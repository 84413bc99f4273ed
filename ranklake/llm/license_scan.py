"""License scan: short notices found by exact seeds, verified with bounded errors.

Each notice of ``NOTICES`` is split into one piece more than the errors it may have; by the pigeonhole
principle a text with a notice in at most that many edits holds at least one piece exactly.  One
Aho-Corasick pass over the words of a text, joined by single blanks, finds all pieces; around each,
the ``regex`` library matches the notice with bounded errors, from the beginning of a word to the end of one, and its
edits and span are reported.  A window is no longer than a notice, its edits and the words it ends in, so a
text of many notices takes time in proportion.  Of overlapping matches of one notice that with fewer edits counts.

Everything happens within a row, so nothing is shuffled.  Words are found with numpy on blocks of
about a megabyte; whole texts are searched.

Defined cases: a null text is empty; an empty text has no words, no labels and the score 0; rows with
the same id are scanned each; no rows give no rows.  Other columns pass through ``scan`` untouched; of equal names the
result's column stays, and the input's goes.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranklake.llm.blocks import ALNUM, blocks, joined_words, words

#: Phrases whose words must stand consecutively, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notices of the fuzzy search, in lower case with single blanks, and their labels.
NOTICES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("this work is licensed under the gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("licensed under cc by nc", "cc-by-nc"),
    ("licensed under cc by sa", "cc-by-sa"),
    ("licensed under cc by 4 0", "cc-by"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("mozilla public license version 2 0", "mpl"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("all rights reserved no part of this", "proprietary"),
)
#: Letters of a notice for each edit that it may have.
PER_EDIT = 12


@dataclass(frozen=True)
class Notice:
    text: str
    label: str
    edits: int
    seeds: tuple[tuple[int, str], ...]


def notice(text: str, label: str, per_edit: int = PER_EDIT) -> Notice:
    """The seeds are ``edits + 1`` pieces of nearly equal length, with their place in the notice."""
    edits = len(text) // per_edit
    cuts = [len(text) * i // (edits + 1) for i in range(edits + 2)]
    return Notice(text, label, edits, tuple((a, text[a:b]) for a, b in zip(cuts, cuts[1:])))


class NoticeFinder:
    """All fuzzy occurrences of notices in normalised text (latin-1 view of its bytes)."""

    def __init__(self, notices=NOTICES, per_edit: int = PER_EDIT):
        import ahocorasick
        import regex

        self.notices = [notice(t, label, per_edit) for t, label in notices]
        at: dict[str, list[tuple[int, int]]] = {}
        for k, n in enumerate(self.notices):
            for place, seed in n.seeds:
                at.setdefault(seed, []).append((k, place))
        self.seeds = ahocorasick.Automaton()
        for seed, places in at.items():
            self.seeds.add_word(seed, (len(seed), places))
        self.seeds.make_automaton()
        #: By notice, then by the edits allowed.
        self.patterns = [
            [regex.compile(rf"(?:{regex.escape(n.text, special_only=True)}){{e<={e}}}") for e in range(n.edits + 1)]
            for n in self.notices
        ]

    def seeds_in(self, text: str) -> list[tuple[int, int, int]]:
        """(end of the seed, notice, where the seed begins in the notice)."""
        return [(end + 1 - size, k, place) for end, (size, places) in self.seeds.iter(text) for k, place in places]

    def verify(self, text: str, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
        """(notice, start, end, edits) of the occurrences near these seeds, the best of overlapping ones."""
        by_notice: dict[int, set[int]] = {}
        for start, k, place in found:
            by_notice.setdefault(k, set()).add(start - place)
        hits = []
        for k, begins in by_notice.items():
            n, matches, first = self.notices[k], [], None
            for b in sorted(begins):
                if first is not None and b <= first + n.edits:
                    continue  # seeds of one occurrence: its edits shift them by that much at most
                first = b
                if best := self._best(k, text, b, 2 * n.edits):
                    matches.append(best)
            hits += [(k, lo, hi, edits) for edits, lo, hi in _apart(matches)]
        return sorted(hits, key=lambda h: (h[1], h[2], h[0]))

    def _best(self, k: int, text: str, begin: int, shift: int) -> tuple[int, int, int] | None:
        """(edits, start, end) of the run of whole words nearest to a notice that begins about here, the longest of equals."""
        n, best = self.notices[k], None
        # Runs are matched whole: the library misses edits that stand before a condition on what follows.
        allowed = n.edits
        for lo in _word_starts(text, begin - n.edits, begin + shift):
            for hi in _word_ends(text, lo + len(n.text) - n.edits, lo + len(n.text) + n.edits):
                while allowed >= 0 and (m := self.patterns[k][allowed].fullmatch(text, lo, hi)):
                    best = (sum(m.fuzzy_counts), lo, hi)
                    allowed = best[0] - 1
        return best


def _word_starts(text: str, lo: int, hi: int) -> list[int]:
    """Where words begin, from lo to hi."""
    return [i for i in range(max(0, lo), min(len(text) - 1, hi) + 1) if text[i] != " " and (i == 0 or text[i - 1] == " ")]


def _word_ends(text: str, lo: int, hi: int) -> list[int]:
    """Where words end, from the last to the first of lo to hi."""
    return [i for i in range(min(len(text), hi), max(1, lo) - 1, -1) if text[i - 1] != " " and (i == len(text) or text[i] == " ")]


def _apart(matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of (edits, start, end), those that overlap none of fewer edits."""
    starts: list[int] = []
    ends: dict[int, int] = {}
    kept = []
    for edits, lo, hi in sorted(set(matches)):
        at = bisect_left(starts, lo)
        if (at == len(starts) or hi <= starts[at]) and (at == 0 or ends[starts[at - 1]] <= lo):
            starts.insert(at, lo)
            ends[lo] = hi
            kept.append((edits, lo, hi))
    return kept


@lru_cache(maxsize=4)
def _finder(notices, per_edit) -> NoticeFinder:
    return NoticeFinder(notices, per_edit)


@lru_cache(maxsize=1)
def _phrases():
    import re

    return [(re.compile(rb"(?<![^ ])" + p.encode() + rb"(?![^ ])"), label) for p, label in PHRASES.items()]


SCAN = (
    "n_words:long,n_base:long,first_word:long,last_word:long,base_labels:string,labels:string,"
    "score:double,spans:array<struct<label:string,first_word:long,n_words:long,edits:int>>"
)
_SPANS = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("edits", pa.int32())]))
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), _SPANS]


def _scan_block(block, finder: NoticeFinder) -> list[tuple]:
    found = words(block, ALNUM, hashed=False)
    pieces, out = joined_words(block, found, ALNUM), []
    # A NUL between texts, which no notice or word holds.
    joined = b"\0".join(pieces)
    seeds = finder.seeds_in(joined.decode("latin-1"))
    begins = np.cumsum([0] + [len(p) + 1 for p in pieces])
    by_text: dict[int, list[tuple[int, int, int]]] = {}
    if seeds:
        owner = np.searchsorted(begins, [s[0] for s in seeds], "right") - 1
        for (start, k, place), i in zip(seeds, owner.tolist()):
            by_text.setdefault(i, []).append((start - int(begins[i]), k, place))
    counts = np.diff(found.first)
    with_license = {i for i, p in enumerate(pieces) if b" license" in p}
    for i, piece in enumerate(pieces):
        n = int(counts[i])
        if i not in by_text and i not in with_license:
            out.append((n, 0, None, None, "", "", 0.0, []))
            continue
        base, labels = [], set()
        for pattern, label in _phrases():
            at = [m.start() for m in _overlapping(pattern, piece)]
            if at:
                labels.add(label)
                base += at
        starts = sorted(piece.count(b" ", 0, b) for b in base)
        spans = []
        for k, lo, hi, edits in finder.verify(piece.decode("latin-1"), by_text.get(i, [])):
            first = piece.count(b" ", 0, lo + (piece[lo : lo + 1] == b" "))
            spans.append((finder.notices[k], first, piece[lo:hi].strip().count(b" ") + 1, edits))
        score = max([1 - e / len(n_.text) for n_, _, _, e in spans] + [1.0] * bool(base), default=0.0)
        every = labels | {s[0].label for s in spans}
        out.append((
            n, len(starts), starts[0] if starts else None, starts[-1] if starts else None,
            ",".join(sorted(labels)), ",".join(sorted(every)), score,
            [{"label": s[0].label, "first_word": s[1], "n_words": s[2], "edits": s[3]} for s in spans],
        ))
    return out


def _overlapping(pattern, piece: bytes):
    at = 0
    while m := pattern.search(piece, at):
        yield m
        at = m.start() + 1


def _scanner(notices, per_edit):
    def run(texts: pa.Array) -> pa.Array:
        finder, rows = _finder(notices, per_edit), []
        for block in blocks(texts):
            rows += _scan_block(block, finder)
        columns = list(zip(*rows)) if rows else [()] * len(_NAMES)
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], list(_NAMES))

    return run


_NAMES = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")


def scan(docs: DataFrame, notices=NOTICES, per_edit: int = PER_EDIT, text: str = "text") -> DataFrame:
    """``docs`` with word count, places of exact phrases, labels, best likeness of a notice, and its spans."""
    scanned = F.arrow_udf(_scanner(tuple(notices), per_edit), f"struct<{SCAN}>")
    found = "found"
    while found in docs.columns:
        found += "_"
    made = docs.withColumn(found, scanned(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary")))
    return made.select(*[F.col(f"`{c}`") for c in docs.columns if c not in _NAMES], f"{found}.*")
