"""N-gram Jaccard join: grouped prefix join of documents on word shingles, and its components.

A document's set is its distinct shingles of ``SIZE`` words (A-Z lower-cased, words between white
space); with fewer words the whole sequence is one.  Documents link when their sets' Jaccard is at
least ``PERCENT`` hundredths.

1. A count sketch of fixed size over all shingles orders them: rare ones first, then by hash.  Any order
   gives the same result; this one keeps frequent passages out of prefixes.
2. Of a set of n shingles the first ``n - ceil(PERCENT * n / 100) + 1`` are its prefix: sets that link
   share a prefix shingle.  Documents with identical prefix and size are one group.  Only groups are
   indexed by their prefix shingles, once per task; shingles of a single group are dropped.
3. Group pairs are filtered by size and by the position of a common shingle, then expanded to the
   distinct sets of their members.  Odd sketches bound a pair's difference from below: a bit says whether a part of the
   shingles' space holds an odd number of the set's, so two sets differ in at least as many shingles as
   their sketches in bits.  The joins themselves compare the sketches; what is left is verified on whole texts.
4. Pairs are not listed within large groups of copies.  Groups that share a shingle with many others are
   first tried against a few pivots, picked anew in each round, and what links is one component.  Rounds
   end when few pairs are left or the last one did not halve them (what is left then mostly does not link).  Then
   every remaining pair of sets in different components is verified, each set's least partner first, so that no link
   is missed.

Intermediate tables are deleted, and broadcasts released, as soon as what reads them is stored.

Skew: identical documents are one row from the start, in each task; a shingle that the sketch counts
above ``HOT_ROWS`` is salted; other joins on hot keys are split by adaptive execution.  Driver: the
sketch and a bit set, both of fixed size, and counts.

Defined cases: a null or empty text, or one without words, has no set and is its own component; a null
id is ignored as a component's name (null if it has no other); rows with the same id are documents of
their own; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ranklake.llm.blocks import SPACED, blocks, shingle_sets, words
from ranklake.llm.components import components
from ranklake.llm.names import unused
from ranklake.operators.sizing import stored_and_measured
from ranklake.sources.storage import discard, stored

SIZE = 5
PERCENT = 75
#: Counters of the sketch; 2 ** 26 (256 MB) suits 100 TB.
SKETCH_BITS = 22
SKETCH_BLOCKS = 64
#: Sketches that one task adds up.
FAN_IN = 128
#: Rows of one shingle in one window; more are salted.
HOT_ROWS = 200_000
#: Groups that share one shingle; where more do, pivots come before pairs.
LONG_LIST = 64
#: Pivots a group is tried against in a round, and rounds.
PIVOTS = 4
ROUNDS = 4
#: Numbers of groups that are broadcast, at most.
BROADCAST_BYTES = 16 << 20
#: Bits of a set's odd sketch.
BITS = 2048
#: First bits of a text's hash in the bit set of wanted texts.
WANTED_BITS = 24


# -- frequency order ---------------------------------------------------------


def _sketcher(size: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            for b in blocks(batch.column(0)):
                for s in shingle_sets(words(b, SPACED), size):
                    # A set's shingles rarely share a counter; where they do, one of them counts.
                    counts[(s >> np.uint64(64 - bits)).astype(np.int64)] += np.uint32(1)
        yield from _blocks_of(TaskContext.get().partitionId(), counts)

    return run


def _blocks_of(part: int, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for k, block in enumerate(counts.reshape(SKETCH_BLOCKS, -1)):
        if block.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([k], pa.int32()), pa.array([zlib.compress(block.tobytes(), 1)], pa.binary())],
                names=["part", "block", "counts"],
            )


def _add(table: pa.Table) -> pa.Table:
    total = None
    for raw in table.column("counts").to_pylist():
        counts = np.frombuffer(zlib.decompress(raw), np.uint32).astype(np.uint64)
        total = counts if total is None else total + counts
    total = np.minimum(total, 0xFFFFFFFF).astype(np.uint32)
    return pa.table(
        {"part": table.column("part").slice(0, 1), "block": table.column("block").slice(0, 1), "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())}
    )


def sketch(source: DataFrame, size: int, bits: int) -> np.ndarray:
    """How many documents hold a shingle, at most, by the first bits of its hash."""
    schema = "part int, block int, counts binary"
    found = stored(source.select("text").mapInArrow(_sketcher(size, bits), schema), "sketch")
    most = found.agg(F.max("part")).first()[0] or 0
    while True:
        before = found
        found = found.withColumn("part", F.expr(f"part div {FAN_IN}").cast("int")).groupBy("block", "part").applyInArrow(_add, schema)
        most //= FAN_IN
        if not most:
            break
        found = stored(found, "sketch")
        discard(before)
    counts = np.zeros((SKETCH_BLOCKS, (1 << bits) // SKETCH_BLOCKS), np.uint32)
    for row in found.collect():
        counts[row["block"]] = np.frombuffer(zlib.decompress(row["counts"]), np.uint32)
    discard(before)
    return counts.ravel()


def levels(counts: np.ndarray) -> np.ndarray:
    """Frequency class of each counter: 0 within the spread of what other shingles add to it, then by powers of two.

    They add the mean, and vary by its square root; so the class of a shingle depends little on the corpus' size.
    """
    mean = counts.sum(dtype=np.float64) / len(counts)
    unit = np.sqrt(mean) + 0.5
    return np.floor(np.log2(np.maximum(1.0, (counts - mean) / unit))).astype(np.uint8)


# -- sets, prefixes, groups --------------------------------------------------


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _prefix(s: np.ndarray, order: np.ndarray, bits: int, percent: int) -> np.ndarray:
    """The first shingles of a set by frequency class, then hash."""
    level = order[(s >> np.uint64(64 - bits)).astype(np.int64)]
    key = (level.astype(np.uint64) << np.uint64(58)) | (s >> np.uint64(6))
    return s[np.argsort(key, kind="stable")[: prefix_length(len(s), percent)]]


def _digest(raw: bytes, size: int) -> bytes:
    return hashlib.blake2b(raw, digest_size=size).digest()


def _group(prefix: np.ndarray, n: int) -> int:
    return int.from_bytes(_digest(prefix.tobytes() + n.to_bytes(8, "little"), 8), "little", signed=True)


def _text_hash(text: bytes) -> bytes:
    return hashlib.sha256(text).digest()[:16]


def text_hash(text: Column) -> Column:
    """The hash of a text by which :func:`representatives` names it."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)), 1, 16)


_MEMBERS = "doc_id long, n long, sid binary, gid long, tid binary, odd array<long>"
_MEMBER_TYPES = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary()]


def odd_sketch(s: np.ndarray) -> np.ndarray:
    """Of BITS parts of the shingles' space, which hold an odd number of the set's; as long numbers."""
    counts = np.bincount((s & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def _sketches(sets: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate([odd_sketch(s) for s in sets])
    return pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * (BITS // 64), pa.int32()), pa.array(flat))


def _near_enough(a: Column, b: Column, n: Column, m: Column, percent: int) -> Column:
    """Whether sets of these sketches (null: unknown) and sizes can link."""
    least = reduce(lambda x, y: x + y, [F.bit_count(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))) for k in range(BITS // 64)])
    return a.isNull() | b.isNull() | (least * (100 + percent) <= (n + m) * (100 - percent))


def _members(shared, size: int, bits: int, percent: int):
    """Per document: size and hash of its set, its group, and the hash of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shared.value
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for b in blocks(batch.column("text")):
                rows, sets = [], shingle_sets(words(b, SPACED), size)
                for i, s in enumerate(sets):
                    if len(s):
                        gid = _group(_prefix(s, order, bits, percent), len(s))
                        rows.append((ids[b.lo + i], len(s), _digest(s.tobytes(), 16), gid, _text_hash(b.text(i))))
                    else:
                        rows.append((ids[b.lo + i], 0, None, None, _text_hash(b.text(i))))
                made = [pa.array(c, t) for c, t in zip(zip(*rows), _MEMBER_TYPES)]
                yield pa.RecordBatch.from_arrays([*made, _sketches(sets)], names=["doc_id", "n", "sid", "gid", "tid", "odd"])

    return run


_ENTRIES = "token long, gid long, n int, i int, salt int"


def _entries(shared, size: int, bits: int, percent: int, hot_level: int):
    """Prefix shingles of each group, once per task; those of a hot class with a salt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, seen = shared.value, set()
        for batch in batches:
            for b in blocks(batch.column("text")):
                tokens, gids, ns = [], [], []
                for s in shingle_sets(words(b, SPACED), size):
                    if len(s):
                        prefix = _prefix(s, order, bits, percent)
                        gid = _group(prefix, len(s))
                        if gid not in seen:
                            seen.add(gid)
                            tokens.append(prefix)
                            gids.append(gid)
                            ns.append(len(s))
                if tokens:
                    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
                    token = np.concatenate(tokens)
                    gid = np.repeat(np.array(gids, np.int64), lengths)
                    i = np.arange(len(token)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                    level = order[(token >> np.uint64(64 - bits)).astype(np.int64)]
                    excess = np.maximum(0, level.astype(np.int64) - hot_level + 1)
                    salt = np.where(excess > 0, 1 + np.abs(gid) % (1 << excess), 0)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(token.astype(np.int64)), pa.array(gid), pa.array(np.repeat(np.array(ns, np.int32), lengths)), pa.array(i.astype(np.int32)), pa.array(salt.astype(np.int32))],
                        names=["token", "gid", "n", "i", "salt"],
                    )

    return run


# -- lists of groups by shingle ----------------------------------------------

_LISTS = "kind int, a long, b long, n int, i int"


def _lists(percent: int):
    """From entries sorted by shingle, salt and group: pairs (kind 0: a, b) of groups on short lists that
    may link, and the entries (kind 1: shingle, group, n, i) of long or salted ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("token", "salt", "gid", "n", "i")
        held = {k: np.zeros(0, np.int64) for k in names}
        # Whether the held rows are the last one of a long list, written already.
        written = False

        def emit(c: dict, final: bool):
            nonlocal held, written
            size = len(c["token"])
            if not size:
                return
            new = np.ones(size, bool)
            new[1:] = (c["token"][1:] != c["token"][:-1]) | (c["salt"][1:] != c["salt"][:-1]) | (c["gid"][1:] != c["gid"][:-1])
            c = {k: v[new] for k, v in c.items()}
            size = len(c["token"])
            change = np.flatnonzero((c["token"][1:] != c["token"][:-1]) | (c["salt"][1:] != c["salt"][:-1])) + 1
            begin = np.concatenate(([0], change))
            length = np.diff(np.append(begin, size))
            listed = (length > LONG_LIST) | (c["salt"][begin] > 0)
            listed[0] |= written
            done = len(begin) if final else len(begin) - 1
            skip = written
            long = np.repeat(listed, length)
            if skip:
                long[0] = False
            keep_from = size
            if not final:
                keep_from = int(begin[-1])
                written = bool(listed[-1])
                if written:
                    # What is here of the long list goes now; its last row stays to tell copies.
                    keep_from = size - 1
                else:
                    long[keep_from:] = False
                held = {k: v[keep_from:] for k, v in c.items()}
            rows = np.flatnonzero(long)
            if len(rows):
                yield _listed(np.ones(len(rows), np.int32), c["token"][rows], c["gid"][rows], c["n"][rows], c["i"][rows])
            short = np.flatnonzero(~listed[:done] & (length[:done] > 1))
            found = []
            for size_of in np.unique(length[short]).tolist():
                first = begin[short[length[short] == size_of]]
                x, y = np.triu_indices(size_of, 1)
                x, y = (first[:, None] + x).ravel(), (first[:, None] + y).ravel()
                n, m, i, j = c["n"][x], c["n"][y], c["i"][x], c["i"][y]
                fits = (np.minimum(n, m) * 100 >= np.maximum(n, m) * percent) & (np.minimum(n - i, m - j) * (100 + percent) >= (n + m) * percent)
                found.append(np.stack((c["gid"][x[fits]], c["gid"][y[fits]])))
            if found:
                a, b = np.sort(np.concatenate(found, axis=1), axis=0)
                order = np.lexsort((b, a))
                a, b = a[order], b[order]
                once = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, bool)
                if once.any():
                    zero = np.zeros(int(once.sum()), np.int32)
                    yield _listed(zero, a[once], b[once], zero, zero)

        for batch in batches:
            now = {k: np.concatenate((held[k], batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64))) for k in names}
            yield from emit(now, False)
        if len(held["token"]):
            yield from emit(held, True)

    return run


def _listed(kind, a, b, n, i) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(kind, pa.int32()), pa.array(a), pa.array(b), pa.array(n.astype(np.int32)), pa.array(i.astype(np.int32))], names=["kind", "a", "b", "n", "i"]
    )


# -- candidates --------------------------------------------------------------


def _may_link(n: Column, i: Column, m: Column, j: Column, percent: int) -> Column:
    """Whether sets of sizes n and m can link when a common shingle stands at i and j of their prefixes.

    For the first common shingle the bound is exact; a pair that links passes there at least.
    """
    overlap = 1 + F.least(n - i, m - j) - 1
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (overlap * (100 + percent) >= (n + m) * percent)


def _star_candidates(entries: DataFrame, seed: int, percent: int) -> DataFrame:
    """gid, pivot: the pivots that each group shares most prefix shingles with."""
    scrambled = F.col("gid").bitwiseXOR(F.col("token")).bitwiseXOR(F.lit(seed))
    picked = entries.groupBy("token").agg(F.min(scrambled).alias("r")).select(
        "token", F.col("r").bitwiseXOR(F.col("token")).bitwiseXOR(F.lit(seed)).alias("gid")
    )
    pivots = entries.join(picked, ["token", "gid"]).select("token", F.col("gid").alias("pivot"), F.col("n").alias("m"), F.col("i").alias("j"))
    pairs = entries.join(pivots, "token").filter(
        (F.col("gid") != F.col("pivot")) & _may_link(F.col("n"), F.col("i"), F.col("m"), F.col("j"), percent)
    )
    counted = pairs.groupBy("gid", "pivot").agg(F.count(F.lit(1)).alias("c"))
    best = F.row_number().over(Window.partitionBy("gid").orderBy(F.desc("c"), "pivot"))
    return counted.withColumn("r", best).filter(F.col("r") <= PIVOTS).select("gid", "pivot")


def _unsettled(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """Entries of shingles whose groups are not all of one component, with it (null: several) and their groups' sketches."""
    labelled = entries.join(groups.select("gid", F.when(F.col("cmin") == F.col("cmax"), F.col("cmin")).alias("comp"), "odd"), "gid")
    mixed = (
        labelled.groupBy("token")
        .agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.when(F.col("comp").isNull(), 1)).alias("several"))
        .filter((F.col("lo") != F.col("hi")) | (F.col("several") > 0))
        .select("token")
    )
    return labelled.join(mixed, "token")


def _pair_bound(unsettled: DataFrame) -> int:
    """How many pairs of groups of different components share a shingle, at most."""
    per = unsettled.groupBy("token", "comp").agg(F.count(F.lit(1)).cast("double").alias("c"))
    own = F.when(F.col("comp").isNull(), 0.0).otherwise(F.col("c") * F.col("c"))
    by = per.groupBy("token").agg(F.sum("c").alias("s"), F.sum(own).alias("q"))
    return int(by.agg(F.sum((F.col("s") * F.col("s") - F.col("q")) / 2)).first()[0] or 0)


def _remaining_candidates(unsettled: DataFrame, percent: int) -> DataFrame:
    """gid, pivot: pairs of groups of different components that share a shingle and may link."""
    other = unsettled.select(
        F.col("token").alias("their"), F.col("gid").alias("pivot"), F.col("n").alias("m"), F.col("i").alias("j"), F.col("comp").alias("other"), F.col("odd").alias("their_odd")
    )
    apart = F.col("comp").isNull() | F.col("other").isNull() | (F.col("comp") != F.col("other"))
    return unsettled.join(
        other,
        (F.col("token") == F.col("their"))
        & (F.col("gid") < F.col("pivot"))
        & apart
        & _may_link(F.col("n"), F.col("i"), F.col("m"), F.col("j"), percent)
        & _near_enough(F.col("odd"), F.col("their_odd"), F.col("n"), F.col("m"), percent),
    ).select("gid", "pivot").distinct()


# -- verification ------------------------------------------------------------


def _wanted(wanted):
    """Texts whose hash may be wanted, once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = wanted.value, set()
        for batch in batches:
            for b in blocks(batch.column(0)):
                rows = []
                for i in range(b.hi - b.lo):
                    text = b.text(i)
                    tid = _text_hash(text)
                    at = int.from_bytes(tid[:3], "big")
                    if bits[at >> 3] >> (at & 7) & 1 and tid not in seen:
                        seen.add(tid)
                        rows.append((tid, text))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*rows)], names=["tid", "text"])

    return run


def _verifier(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column("tb")):
                other = batch.column("ta").slice(b.lo, b.hi - b.lo)
                theirs = shingle_sets(words(b, SPACED), size)
                mine = [s for c in blocks(other) for s in shingle_sets(words(c, SPACED), size)]
                kept = []
                for k, (x, y) in enumerate(zip(mine, theirs)):
                    both = np.sort(np.concatenate((x, y)))
                    common = int((both[1:] == both[:-1]).sum())
                    if 100 * common >= percent * (len(x) + len(y) - common):
                        kept.append(b.lo + k)
                if kept:
                    yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(kept)) for c in ("a", "b")], names=["a", "b"])

    return run


def _verify(spark, source: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """a, b: the pairs of sets that link, by their whole texts.  ``pairs`` is from :func:`_sets_of`."""
    pairs = stored(pairs, "pairs")
    if pairs.isEmpty():
        return pairs.select("a", "b")
    tids = pairs.select(F.col("tid_a").alias("tid")).unionByName(pairs.select(F.col("tid_b").alias("tid")))
    place = F.conv(F.hex(F.substring("tid", 1, 3)), 16, 10).cast("int")
    octets = tids.select(place.alias("p")).select(F.expr("p div 8").cast("int").alias("octet"), F.expr("shiftleft(1, p % 8)").alias("bit"))
    bits = np.zeros(1 << (WANTED_BITS - 3), np.uint8)
    found = octets.groupBy("octet").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits[found.column("octet").to_numpy()] = found.column("bits").to_numpy()
    wanted = spark.sparkContext.broadcast(bits)
    texts = source.select("text").mapInArrow(_wanted(wanted), "tid binary, text binary")
    texts = texts.join(tids.distinct(), "tid", "left_semi").groupBy("tid").agg(F.first("text").alias("text"))
    texts = stored(texts, "texts")
    joined = pairs.join(texts.select(F.col("tid").alias("tid_a"), F.col("text").alias("ta")), "tid_a").join(
        texts.select(F.col("tid").alias("tid_b"), F.col("text").alias("tb")), "tid_b"
    )
    links = stored(joined.select("a", "b", "ta", "tb").mapInArrow(_verifier(size, percent), "a binary, b binary"), "links")
    discard(pairs, texts)
    wanted.destroy()
    return links


_PAIR = ["a", "b", "tid_a", "tid_b"]


def _needed(sets: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sets of groups that stand in a pair, and the pairs, stored.

    While the groups' numbers measure at most ``BROADCAST_BYTES``, the sets are cut down to them before they move.
    """
    pairs, _ = stored_and_measured(pairs, "group_pairs", F.lit(16))
    named = pairs.select("gid").unionByName(pairs.select(F.col("pivot").alias("gid"))).distinct()
    gids, size = stored_and_measured(named, "groups", F.lit(8))
    return sets.join(F.broadcast(gids) if size.fits(BROADCAST_BYTES) else gids, "gid", "left_semi"), pairs


def _sets_of(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Group pairs as pairs of distinct sets: all of one group with the other's first."""
    sets, pairs = _needed(sets, pairs)
    first = sets.groupBy("gid").agg(F.min(F.struct("sid", "tid", "odd", "n")).alias("s")).select("gid", "s.*")
    expanded = pairs.join(_side(sets, "gid", "a"), "gid").join(_side(first, "pivot", "b"), "pivot")
    return expanded.filter((F.col("a") != F.col("b")) & _sides_near(percent)).select(*_PAIR)


def _sets_apart(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Group pairs as all pairs of sets of different components (``comp``) that can link; within a group each once."""
    sets, pairs = _needed(sets, pairs)
    a, b = _side(sets, "gid", "a", "comp"), _side(sets, "their", "b", "comp")
    own = (F.col("gid") != F.col("pivot")) | (F.col("a") < F.col("b"))
    apart = (F.col("pivot") == F.col("their")) & (F.col("comp_a") != F.col("comp_b")) & own & _sides_near(percent)
    return pairs.join(a, "gid").join(b, apart).select(*_PAIR)


def _side(sets: DataFrame, group: str, name: str, *more: str) -> DataFrame:
    return sets.select(F.col("gid").alias(group), F.col("sid").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in ("tid", "odd", "n", *more)])


def _sides_near(percent: int) -> Column:
    return _near_enough(F.col("odd_a"), F.col("odd_b"), F.col("n_a"), F.col("n_b"), percent)


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def _labels(sets: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sets with their components, and of each group the least and largest."""
    roots = components(links)
    labelled = stored(
        sets.join(roots, sets["sid"] == roots["node"], "left").select("sid", "gid", "odd", F.coalesce("root", "sid").alias("comp")), "labelled"
    )
    # Sets of one group differ; a sketch stands for a group of one set only.
    odd = F.when(F.count(F.lit(1)) == 1, F.first("odd")).alias("odd")
    return labelled, labelled.groupBy("gid").agg(F.min("comp").alias("cmin"), F.max("comp").alias("cmax"), odd)


def _first_row() -> Column:
    """The least (doc_id, tid) of an aggregation; rows without an id come last."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tid")).alias("first")


def _grouped(docs: DataFrame, size: int, percent: int, sketch_bits: int, id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The rows' members, and of each set the first row of its component: sid, first."""
    spark = docs.sparkSession
    source = docs.select(F.col(id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    counts = sketch(source, size, sketch_bits)
    order = levels(counts)
    hot = counts[counts >= HOT_ROWS]
    hot_level = int(order[counts >= HOT_ROWS].min()) if len(hot) else 99
    shared = spark.sparkContext.broadcast(order)
    members = stored(source.mapInArrow(_members(shared, size, sketch_bits, percent), _MEMBERS), "members")
    sets = members.filter("n > 0").groupBy("sid", "gid").agg(F.min("tid").alias("tid"), F.first("n").alias("n"), F.first("odd").alias("odd"), _first_row())
    sets = stored(sets, "sets")
    entries = source.select("text").mapInArrow(_entries(shared, size, sketch_bits, percent, hot_level), _ENTRIES)
    key = ["token", "salt"]
    lists = stored(entries.repartition(*key).sortWithinPartitions(*key, "gid").mapInArrow(_lists(percent), _LISTS), "lists")
    shared.destroy()
    near = lists.filter("kind = 0").select(F.col("a").alias("gid"), F.col("b").alias("pivot")).distinct()
    long = lists.filter("kind = 1").select(F.col("a").alias("token"), F.col("b").alias("gid"), "n", "i")

    # Members of one group against its first, and groups on long lists against pivots.
    many = sets.groupBy("gid").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    own = many.select("gid", F.col("gid").alias("pivot"))
    links, nodes, bound = [], sets.count(), float("inf")
    open_lists = labelled = long
    for turn in range(ROUNDS):
        seed = int.from_bytes(_digest(bytes([turn]), 8), "little", signed=True)
        tried = _star_candidates(open_lists.select("token", "gid", "n", "i"), seed, percent)
        pairs = _sets_of(sets, tried.unionByName(own) if turn == 0 else tried, percent)
        found = _verify(spark, source, pairs, size, percent)
        links.append(found)
        done = (open_lists, labelled)
        labelled, groups = _labels(sets, _union(links))
        open_lists = stored(_unsettled(long, groups), "open_lists")
        discard(*done)
        before, bound = bound, _pair_bound(open_lists)
        # One more round costs as much as so many pairs, and is of use only where groups still merge.
        if bound <= PIVOTS * nodes or 2 * bound > before:
            break
    split = groups.filter("cmin != cmax").select("gid", F.col("gid").alias("pivot"))
    comp = labelled.select("sid", "comp")
    remaining = near.unionByName(_remaining_candidates(open_lists, percent)).distinct().unionByName(split)
    apart = stored(_sets_apart(sets.join(comp, "sid"), remaining, percent), "apart")
    # Of many sets alike each is tried against the least first; what that leaves in different components comes after.
    either = apart.unionByName(apart.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("tid_b").alias("tid_a"), F.col("tid_a").alias("tid_b")))
    hubs = either.filter("b < a").groupBy("a").agg(F.min(F.struct("b", "tid_a", "tid_b")).alias("h")).select("a", "h.*")
    links.append(_verify(spark, source, hubs, size, percent))
    roots = components(_union(links))
    named = [roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}")) for side in ("a", "b")]
    still = apart.join(named[0], "a", "left").join(named[1], "b", "left")
    still = still.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).join(hubs.select("a", "b"), ["a", "b"], "left_anti").select(*_PAIR)
    links.append(_verify(spark, source, still, size, percent))
    discard(apart)
    discard(lists, open_lists, labelled)
    roots = components(_union(links))
    final = sets.join(roots, sets["sid"] == roots["node"], "left").select("sid", "first", F.coalesce("root", "sid").alias("root"))
    named = final.groupBy("root").agg(F.min("first").alias("first"))
    named = stored(final.select("sid", "root").join(named, "root").select("sid", "first"), "named")
    discard(sets, *links)
    return members, named


def jaccard_components(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, sketch_bits: int = SKETCH_BITS, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the least id reachable by links), per row of ``docs``."""
    members, named = _grouped(docs, size, percent, sketch_bits, id, text)
    return members.join(named, "sid", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"),
    )


def representatives(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, sketch_bits: int = SKETCH_BITS, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, tid: the row that stands for each component, by its id and the hash of its text.

    It is the one of the least id, then hash; one without an id only where none of the component has
    one.  A row without words stands for itself.
    """
    members, named = _grouped(docs, size, percent, sketch_bits, id, text)
    alone = members.filter("n = 0").select("doc_id", "tid")
    return named.select("first.doc_id", "first.tid").unionByName(alone).distinct()


def keep_representatives(docs: DataFrame) -> DataFrame:
    """One row of each component of ``docs``: that of the least id, then hash of the text; of equal (id, text) rows the least."""
    own, kept_id, kept_text, row = (unused(c, docs.columns) for c in ("_own", "_id", "_tid", "_row"))
    kept = representatives(docs).select(F.col("doc_id").alias(kept_id), F.col("tid").alias(kept_text))
    keyed = docs.withColumn(own, text_hash(F.col("text")))
    held = keyed.join(kept, F.col("doc_id").eqNullSafe(F.col(kept_id)) & (F.col(own) == F.col(kept_text)), "left_semi")
    # Null ids meet in one group per text only.
    return held.groupBy("doc_id", own).agg(F.min(F.struct(*docs.columns)).alias(row)).select(f"{row}.*")
