"""Fill-in-the-middle: texts cut at two unit ranks, their parts rearranged for infilling.

A unit is a run of ASCII letters or any other single code point.  The units of a text are an indexable
skip list.  Lane 0 holds every unit; each lane above keeps about a quarter of the one below, and each
of its links carries how many units and how many code points it skips.  A cut rank is reached from the
top: a link is taken while the units passed so far and its width do not exceed the rank, else the
search goes one lane down; the code-point widths taken add up to the cut's place in the text.

The id alone draws the cuts and the form, so that a repeated or recovered task gives the same rows.
Only texts go to Python, and only three numbers come back; parts are cut and joined by built-in functions.  Nothing is
shuffled.  A block of texts takes bounded memory; a longer text is read in pieces and takes four bytes a unit.

Defined cases: a null text is empty; an empty text, or one that holds a marker, stays as it is; a null id draws as
the empty string; rows with the same id are cut each on its own; no rows give no rows; of equal names
the result's column stays, and the input's goes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ranklake.llm.blocks import blocks

#: Markers of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

#: Bytes of a text whose units are found at once.
PIECE = 1 << 22
#: A lane that is not longer than this has none above it.
TOP = 8

_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
#: Continuation bytes of UTF-8 begin no code point.
_CONTINUES = np.zeros(256, bool)
_CONTINUES[0x80:0xC0] = True

_COINS = np.random.default_rng(11).random(1 << 16) < 0.25


class SkipList:
    """Units given by their widths in code points, found by rank."""

    def __init__(self, widths: np.ndarray):
        self.size = len(widths)
        #: From the bottom: index in the lane below, units and code points skipped.
        self.lanes: list[tuple[np.ndarray | None, np.ndarray | None, np.ndarray]] = [(None, None, widths)]
        units, chars = None, widths
        while len(chars) > TOP:
            n, level = len(chars), len(self.lanes)
            coins = _COINS[level : level + n] if level + n <= len(_COINS) else np.resize(_COINS, n)
            below = np.flatnonzero(coins)
            if not len(below) or below[0]:
                below = np.concatenate(([0], below))  # each lane begins at the first unit
            if len(below) == n:
                break
            units = np.diff(below, append=n) if units is None else np.add.reduceat(units, below)
            chars = np.add.reduceat(chars, below, dtype=np.int64)
            self.lanes.append((below, units, chars))

    def locate(self, rank: int) -> int:
        """Code points of the first ``rank`` units, 0 to ``size``."""
        at = passed = place = 0
        for below, units, chars in reversed(self.lanes):
            end = len(chars)
            while at < end:
                width = 1 if units is None else units.item(at)
                if passed + width > rank:
                    break
                passed += width
                place += chars.item(at)
                at += 1
            if at == end:
                break  # past the last unit
            if below is not None:
                at = below.item(at)
        return place


def unit_widths(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Widths in code points of all units of texts in UTF-8, and the index of each text's first unit."""
    forced = np.unique(begins[begins < len(data)])
    widths, starts_of, pending, counted = [], [], None, 0
    for lo in range(0, len(data), PIECE):
        piece = data[lo : lo + PIECE]
        letter = _LETTER[piece]
        inside = _CONTINUES[piece]
        inside[1:] |= letter[1:] & letter[:-1]
        if lo:
            inside[0] |= letter[0] and _LETTER[data[lo - 1]]
        cut = forced[np.searchsorted(forced, lo) : np.searchsorted(forced, lo + len(piece))]
        inside[cut - lo] = False
        starts = np.flatnonzero(~inside) + lo
        starts_of.append(counted + np.searchsorted(starts, cut))
        counted += len(starts)
        if pending is not None:
            starts = np.concatenate(([pending], starts))
        if len(starts):
            widths.append(np.where(_LETTER[data[starts[:-1]]], np.diff(starts), 1).astype(np.int32))
            pending = starts[-1]
    if pending is not None:
        widths.append(np.array([len(data) - pending if _LETTER[data[pending]] else 1], np.int32))
    every = np.concatenate(widths) if widths else np.zeros(0, np.int32)
    firsts = np.concatenate(starts_of) if starts_of else np.zeros(0, np.int64)
    # An empty text begins where the next one does; at the end of the data, behind all units.
    known = np.append(firsts, len(every))
    return every, known[np.searchsorted(forced, begins)]


_CUT = "struct<n:long,first:long,second:long>"


def _cuts(texts: pa.Array, one: pa.Array, other: pa.Array) -> pa.Array:
    """Units of each text, and its code points before the smaller and the larger of two drawn ranks."""
    counts, firsts, seconds = [], [], []
    draws = list(zip(one.to_pylist(), other.to_pylist()))
    for block in blocks(texts):
        widths, begins = unit_widths(block.data, block.offsets)
        for (a, b), lo, hi in zip(draws[block.lo : block.hi], begins[:-1].tolist(), begins[1:].tolist()):
            units = SkipList(widths[lo:hi])
            low, high = sorted((a % (units.size + 1), b % (units.size + 1)))
            counts.append(units.size)
            firsts.append(units.locate(low))
            seconds.append(units.locate(high))
    return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (counts, firsts, seconds)], ["n", "first", "second"])


def _draw(id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of an id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transform(docs: DataFrame, id: str = "doc_id", text: str = "text", rate: int = 90, spm: int = 20, seed: int = 1) -> DataFrame:
    """``docs`` with n (units), form, prefix_chars, middle_chars and output.

    Of a hundred documents about ``rate`` are rearranged (form ``psm`` or ``spm``), of these ``spm`` in a
    hundred with the suffix first; the others are ``plain``.
    """
    cuts = F.arrow_udf(_cuts, _CUT)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    h1, h2, h3, h4 = _draw(F.col(id), seed)
    marked = F.contains(body, F.lit(PREFIX)) | F.contains(body, F.lit(SUFFIX)) | F.contains(body, F.lit(MIDDLE))
    plain = (body == "") | marked | (h3 % 100 >= rate)
    form = F.when(plain, "plain").when(h4 % 100 < spm, "spm").otherwise("psm")
    held = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        body.alias("body"),
        form.alias("form"),
        cuts(body.cast("binary"), h1, h2).alias("cut"),
    )
    first, second = F.col("cut.first").cast("int"), F.col("cut.second").cast("int")
    prefix = F.substring("body", F.lit(1), first)
    middle = F.substring("body", first + 1, second - first)
    suffix = F.substring("body", second + 1, F.length("body"))
    output = (
        F.when(F.col("form") == "plain", F.col("body"))
        .when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    )
    moved = F.col("form") != "plain"
    made = {
        "n": F.col("cut.n"),
        "form": F.col("form"),
        "prefix_chars": F.when(moved, F.col("cut.first")),
        "middle_chars": F.when(moved, F.col("cut.second") - F.col("cut.first")),
        "output": output,
    }
    kept = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in made]
    return held.select(*kept, *[c.alias(name) for name, c in made.items()])


def restore(output: Column, form: Column) -> Column:
    """The text that :func:`transform` made ``output`` of."""
    # The output begins with a marker of three characters; the other two lie between its parts.
    parts = F.split(F.substring(output, F.lit(4), F.length(output)), f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    psm, spm = (F.concat(*[parts[k] for k in order]) for order in ((0, 2, 1), (1, 2, 0)))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
