"""SpotSigs fingerprints: chains of content words that follow common-word anchors.

Each anchor of a text (a word of ``ANCHORS``) spots the next ``CHAIN`` content words, those that are no
anchors; anchor and chain are one signature, and a text's fingerprint is the set of its signatures.
A text without any takes every word as an anchor.  Two fingerprints are compared by Jaccard, after the
bound that their sizes set: ``min / max`` is the most it can be.

``matches`` finds all pairs of different fingerprints at or above a threshold: fingerprints are dealt
into partitions by set size such that only neighbours can match, and meet on the rarest signatures of
a set only, as many as the threshold leaves possible without an overlap.

Defined cases: a null or empty text, or one without a word, has the empty fingerprint; two empty
fingerprints are alike (1.0), an empty and another are not (0.0).  Equal texts have equal fingerprints.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranklake.llm.blocks import ALNUM, Block, Words, blocks, mix, word_hash, words

#: Common words of four languages.
ANCHORS = (
    "the a an and of to in is was are be been that this it by on at for with or as from not which "
    "le la les de des du un une et en que qui dans pour par sur au aux est avec pas ce se "
    "der die das und ist nicht ein eine von zu den dem des im mit für auf sich auch als "
    "el los las y es un una del por con para su al lo como más"
).split()
CHAIN = 3
#: A signature keeps 48 bits, eight characters of base64.
_BITS = np.uint64(0xFFFFFFFFFFFF)


@lru_cache(maxsize=1)
def _anchors() -> np.ndarray:
    return np.unique(np.array([word_hash(w) for w in ANCHORS], np.uint64))


def _chains(h: np.ndarray, anchors: np.ndarray, content: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Signature of each anchor position, whose text ends at word ``end``; 0 where no content follows."""
    at = np.searchsorted(content, anchors + 1)
    made = h[anchors].copy()
    for k in range(CHAIN):
        place = content[np.minimum(at + k, len(content) - 1)] if len(content) else anchors
        there = (at + k < len(content)) & (place < end)
        made = mix(made * np.uint64(0x9E3779B97F4A7C15) + np.where(there, h[place], np.uint64(k + 1)))
        if k == 0:
            spotted = there
    return np.where(spotted, (made & _BITS) | np.uint64(1), np.uint64(0))


def signature_sets(found: Words) -> list[np.ndarray]:
    """Sorted distinct signatures of each text of a block."""
    h, first = found.hash, found.first
    is_anchor = np.isin(h, _anchors())
    anchors, content = np.flatnonzero(is_anchor), np.flatnonzero(~is_anchor)
    owner = np.searchsorted(first, anchors, "right") - 1
    sigs = _chains(h, anchors, content, first[owner + 1])
    bounds = np.searchsorted(anchors, first)
    sets = []
    for i, (lo, hi) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        own = np.unique(sigs[lo:hi])
        own = own[own > 0]
        if not len(own) and first[i + 1] > first[i]:
            # No anchor is followed by content: every word is an anchor, every word content.
            every = np.arange(first[i], first[i + 1])
            ends = np.full(len(every), first[i + 1])
            own = np.unique(_chains(h, every, np.arange(len(h)), ends))
            own = own[own > 0] if len(every) > 1 else (h[every] & _BITS) | np.uint64(1)
        sets.append(own)
    return sets


def encode(signatures: np.ndarray) -> str:
    """A fingerprint as text: base64 of the sorted signatures, six bytes each."""
    raw = signatures.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
    return base64.b64encode(raw.tobytes()).decode()


def decode(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, 6)
    return np.pad(raw, ((0, 0), (0, 2))).copy().view("<u8").ravel().astype(np.uint64)


def likeness(a: np.ndarray, b: np.ndarray, floor: float = 0.0) -> float:
    """Jaccard of two sets of signatures; 0 where their sizes already keep it below ``floor``."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if min(len(a), len(b)) < floor * max(len(a), len(b)):
        return 0.0
    both = np.sort(np.concatenate((a, b)))
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(both) - common)


def sets_of_texts(texts: list[bytes]) -> list[np.ndarray]:
    return [s for b in blocks(pa.array(texts, pa.binary())) for s in signature_sets(words(b, ALNUM))]


def _fingerprinter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = batch.drop_columns(["_text"])
        for b in blocks(batch.column("_text")):
            sets = signature_sets(words(b, ALNUM))
            rows = own.slice(b.lo, b.hi - b.lo)
            columns = [pa.array([encode(s) for s in sets]), pa.array(list(map(len, sets)), pa.int64()), pa.array([s.astype(np.int64) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*rows.columns, *columns], names=[*own.schema.names, "fingerprint", "n_signatures", "signatures"])


def fingerprint(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, fingerprint, n_signatures, signatures (array of long), row by row."""
    source = docs.select(F.col(id), F.col(text).cast("binary").alias("_text"))
    kind = source.schema[id].dataType.simpleString()
    return source.mapInArrow(_fingerprinter, f"{id} {kind}, fingerprint string, n_signatures long, signatures array<long>")


def size_partition(n, threshold: float):
    """Partition of a set size (a column): sets two or more partitions apart can't reach the threshold."""
    return F.floor(F.log(n.cast("double")) / F.lit(-math.log(threshold)) + 1e-9).cast("int")


def matches(fingerprints: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Pairs a < b of different fingerprints with likeness at or above the threshold.

    ``fingerprints`` as from :func:`fingerprint`.  Equal fingerprints are one here; the documents of a
    class are found by joining on the fingerprint.
    """
    classes = fingerprints.filter("n_signatures > 0").dropDuplicates(["fingerprint"])
    classes = classes.select("fingerprint", "signatures", F.col("n_signatures").alias("n"))
    frequency = classes.select(F.explode("signatures").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("df"))
    ranked = (
        classes.select("fingerprint", "n", F.explode("signatures").alias("s"))
        .join(frequency, "s")
        .groupBy("fingerprint", "n")
        .agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("order"))
    )
    length = (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int")
    index = ranked.select(
        "fingerprint", "n", size_partition(F.col("n"), threshold).alias("part"), F.explode(F.slice("order", F.lit(1), length)).alias("o")
    ).select("fingerprint", "n", "part", "o.s")
    # The smaller set of a pair looks into its own partition and the next.
    probe = index.select(
        F.col("fingerprint").alias("a"), F.col("n").alias("na"), "s", F.explode(F.array("part", F.col("part") + 1)).alias("part")
    )
    pairs = (
        probe.join(index.select(F.col("fingerprint").alias("b"), F.col("n").alias("nb"), "s", "part"), ["part", "s"])
        .filter((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b"))))
        .filter(F.col("na") >= F.col("nb") * threshold)
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    left = classes.select(F.col("fingerprint").alias("a"), F.col("signatures").alias("sa"))
    right = classes.select(F.col("fingerprint").alias("b"), F.col("signatures").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    return (
        pairs.join(left, "a").join(right, "b")
        .withColumn("likeness", common / (F.size("sa") + F.size("sb") - common))
        .filter(F.col("likeness") >= threshold)
        .select("a", "b", "likeness")
    )
