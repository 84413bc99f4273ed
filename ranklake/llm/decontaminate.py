"""Benchmark decontamination: every training passage queries a BM25 index of the test items.

The items (question and answer) are the index, in shards of at most ``SHARD_BYTES`` of text, each sent
to all tasks; their term statistics cover all items.  A text is cut into passages of ``2 * stride``
words, one every ``stride`` words, where the stride is the longest item of the shard, so each item that
a text holds lies in one passage whole.  Weights are divided by an item's score against itself, so one
threshold fits items of all lengths.

Per passage all items at or above the threshold are retrieved by block-max WAND.  Most passages end
before: like items are neighbours in the index, and for up to ``GROUPS`` ranges of items the sum of the
largest weights of a passage's terms, a bound of every score there, is taken for many passages at once.
WAND then runs over the ranges whose bound reaches the threshold.  What is retrieved is verified: enough of the question's and of the answer's
``SHINGLE`` word sequences must stand in the passage.

Nothing but the statistics of the items is shuffled.

Both sides are lower-cased.

Defined cases: a null or empty text has no passages; a null or empty item is in the index but never
found; an item of fewer words than a shingle is one sequence; equal items are found each; without items
or documents there are no rows; rows with the same doc_id give one row per item, the best.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranklake.llm.names import unused
from ranklake.llm.blocks import ALNUM, Words, blocks, chain, words

K1, B = 1.2, 0.75
THRESHOLD = 0.5
SHINGLE = 3
QUESTION_OVERLAP, ANSWER_OVERLAP = 0.6, 0.5
BLOCK = 16
#: Ranges of items for which a passage's best possible score is computed at once.
GROUPS = 64
#: Passages whose bounds are computed at once.
SLICE = 1024
SHARD_BYTES = 8 * 1024 * 1024
MIN_STRIDE = 32
#: Share of an item's words that are the question, where it comes as one text.
QUESTION_SHARE = 0.75

FOUND = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long"
_FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64()), ("first_word", pa.int64())])


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, term, tf, words of the item) of item texts."""
    for batch in batches:
        ids = batch.column("item").to_numpy(zero_copy_only=False)
        for b in blocks(batch.column("text")):
            found = words(b, ALNUM)
            for i in range(b.hi - b.lo):
                own = found.hash[found.first[i] : found.first[i + 1]]
                term, tf = np.unique(own, return_counts=True)
                n = len(term)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, ids[b.lo + i])), pa.array(term.astype(np.int64)), pa.array(tf.astype(np.int64)), pa.array(np.full(n, len(own), np.int64))],
                    names=["item", "term", "tf", "n"],
                )


@dataclass
class Postings:
    items: list[int]
    weights: list[float]
    #: Last item and largest weight of each block of postings.
    last: list[int]
    most: list[float]


class BlockMaxIndex:
    """Postings with block maxima; weights are shares of an item's score against itself."""

    def __init__(self, item: np.ndarray, term: np.ndarray, weight: np.ndarray, n_items: int, block: int = BLOCK):
        total = np.bincount(item, weights=weight, minlength=n_items)
        weight = weight / total[item]
        # Like items are neighbours, so that maxima over ranges of items are close to their weights:
        # first by an item's most common term, then by its score against itself.
        _, number, df = np.unique(term, return_inverse=True, return_counts=True)
        common = np.zeros(n_items, np.int64)
        np.maximum.at(common, item, df[number] * (len(df) + 1) + number)
        self.item_of = np.lexsort((total, common))
        rank = np.empty(n_items, np.int64)
        rank[self.item_of] = np.arange(n_items)
        item = rank[item]
        order = np.lexsort((item, term))
        item, term, weight = item[order], term[order], weight[order]
        self.terms, begin = np.unique(term, return_index=True)
        self.largest = np.maximum.reduceat(weight, begin) if len(begin) else np.zeros(0)
        self.block = block
        # The largest weight of each term in each of at most GROUPS ranges of items,
        self.ranges = np.unique(np.linspace(0, n_items, min(GROUPS, n_items) + 1).astype(np.int64))
        # in steps of the largest weight over 255, rounded up.
        self.step = float(weight.max()) / 255 if len(weight) else 1.0
        self.by_range = np.zeros((len(self.terms), max(1, len(self.ranges) - 1)), np.uint8)
        spans = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(term))))
        steps = np.minimum(255, np.ceil(weight / self.step)).astype(np.uint8)
        np.maximum.at(self.by_range, (spans, np.searchsorted(self.ranges, item, "right") - 1), steps)
        self.postings = []
        for lo, hi in zip(begin, np.append(begin[1:], len(term))):
            cuts = range(lo, hi, block)
            self.postings.append(
                Postings(
                    item[lo:hi].tolist(), weight[lo:hi].tolist(),
                    [int(item[min(c + block, hi) - 1]) for c in cuts], [float(weight[c : min(c + block, hi)].max()) for c in cuts],
                )
            )

    def search(self, term_numbers: list[int], threshold: float, lo: int = 0, hi: int | None = None) -> list[tuple[int, float]]:
        """(item, score) of all items at or above the threshold, for distinct terms: block-max WAND.

        ``lo`` and ``hi`` limit it to a range of the index's own order.
        """
        slack = threshold - 1e-9
        end = len(self.item_of) if hi is None else hi
        cursors, out = [], []
        for t in term_numbers:
            items = self.postings[t].items
            at = bisect_left(items, lo)
            if at < len(items) and items[at] < end:
                cursors.append([items[at], at, t])
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, (_, _, t) in enumerate(cursors):
                bound += self.largest[t]
                if bound >= slack:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            # Bound by the blocks that would hold this item.
            tight, until = 0.0, None
            for _, _, t in cursors[: pivot + 1]:
                p = self.postings[t]
                b = bisect_left(p.last, item)
                if b < len(p.last):
                    tight += p.most[b]
                    until = p.last[b] if until is None else min(until, p.last[b])
            if tight < slack:
                # No item up to the first end of these blocks, or before the next cursor, can do.
                target = (until if until is not None else item) + 1
                if pivot + 1 < len(cursors):
                    target = min(target, cursors[pivot + 1][0])
                target = max(target, item + 1)
                move = range(pivot + 1)
            elif cursors[0][0] == item:
                score = 0.0
                for _, at, t in cursors[: pivot + 1]:
                    score += self.postings[t].weights[at]
                if score >= slack:
                    out.append((int(self.item_of[item]), score))
                target, move = item + 1, range(pivot + 1)
            else:
                target, move = item, [k for k in range(pivot + 1) if cursors[k][0] < item]
            for k in move:
                _, at, t = cursors[k]
                p = self.postings[t]
                at = bisect_left(p.items, target, at)
                cursors[k] = [p.items[at], at, t] if at < len(p.items) and p.items[at] < end else None
            cursors = [c for c in cursors if c is not None]
        return out


@dataclass
class Shard:
    ids: list[int]
    index: BlockMaxIndex
    question: list[np.ndarray]
    answer: list[np.ndarray]
    stride: int


def _sequences(h: np.ndarray) -> np.ndarray:
    """Distinct shingles of words; of fewer words, the one sequence."""
    size = min(SHINGLE, len(h))
    return np.unique(chain(h, size)) if size else np.zeros(0, np.uint64)


def _hashes(texts: list[str]) -> list[np.ndarray]:
    out = []
    for b in blocks(pa.array([(t or "").encode() for t in texts], pa.binary())):
        found = words(b, ALNUM)
        out += [found.hash[lo:hi] for lo, hi in zip(found.first[:-1], found.first[1:])]
    return out


def _shards(items: DataFrame, question: str | None, answer: str | None, id: str, text: str) -> Iterator[Shard]:
    """The index, one bounded shard at a time."""
    spark = items.sparkSession
    if question:
        whole = F.concat_ws("\n", F.coalesce(question, F.lit("")), F.coalesce(answer, F.lit("")))
        items = items.select(
            F.col(id).cast("long").alias("item"), F.lower(whole).alias("text"),
            F.lower(F.coalesce(question, F.lit(""))).alias("q"), F.lower(F.coalesce(answer, F.lit(""))).alias("a"),
        )
    else:
        items = items.select(
            F.col(id).cast("long").alias("item"), F.lower(F.coalesce(text, F.lit(""))).alias("text"),
            F.lit(None).cast("string").alias("q"), F.lit(None).cast("string").alias("a"),
        )
    # Equal ids are told apart by their text.
    items = items.withColumn("key", F.xxhash64("item", "text"))
    totals = items.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    if not totals["n"]:
        return
    terms = items.select(F.col("key").alias("item"), F.col("text").cast("binary").alias("text")).mapInArrow(_terms, "item long, term long, tf long, n long").distinct()
    lengths = terms.groupBy("item").agg(F.first("n").alias("n")).agg(F.sum("n").alias("n")).first()["n"] or 0
    average = max(1.0, lengths / totals["n"])
    df = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (totals["n"] - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n") / average))
    weighted = terms.join(df, "term").select(F.col("item").alias("key"), "term", (idf * tf).alias("weight"))
    n_shards = 1 + totals["bytes"] // SHARD_BYTES
    for shard in range(n_shards):
        own = F.pmod(F.xxhash64("key"), F.lit(n_shards)) == shard
        rows = items.filter(own).orderBy("item", "key").toArrow()
        if not rows.num_rows:
            continue
        keys = rows.column("key").to_numpy()
        listed = weighted.filter(own).toArrow()
        order = np.argsort(keys, kind="stable")
        place = order[np.searchsorted(keys, listed.column("key").to_numpy(), sorter=order)]
        index = BlockMaxIndex(place, listed.column("term").to_numpy().astype(np.uint64), listed.column("weight").to_numpy(), len(keys))
        every = _hashes(rows.column("text").to_pylist())
        if question:
            q, a = _hashes(rows.column("q").to_pylist()), _hashes(rows.column("a").to_pylist())
        else:
            cut = [-(-int(len(h) * QUESTION_SHARE * 100) // 100) for h in every]
            q, a = [h[:c] for h, c in zip(every, cut)], [h[c:] for h, c in zip(every, cut)]
        yield Shard(
            rows.column("item").to_pylist(), index, [_sequences(h) for h in q], [_sequences(h) for h in a],
            max(MIN_STRIDE, max(map(len, every))),
        )


def _share(of: np.ndarray, there: np.ndarray) -> float:
    return 1.0 if not len(of) else float(np.isin(of, there).mean())


def search_block(shard: Shard, found: Words, threshold: float = THRESHOLD) -> list[tuple[int, int, float, float, float, int]]:
    """(text, item, score, question and answer overlap, first word) of verified finds, the best each."""
    index, stride, h = shard.index, shard.stride, found.hash
    if not len(index.terms) or not len(h):
        return []
    at = np.minimum(np.searchsorted(index.terms, h), len(index.terms) - 1)
    known = np.flatnonzero(index.terms[at] == h)
    counts = np.diff(found.first)
    # Passages begin every stride words; the last one reaches a text's end.
    n_passages = np.where(counts > 0, np.maximum(1, -(-counts // stride) - 1), 0)
    text = np.repeat(np.arange(len(counts)), n_passages)
    begin = found.first[text] + (np.arange(len(text)) - np.repeat(np.cumsum(n_passages) - n_passages, n_passages)) * stride
    end = np.minimum(begin + 2 * stride, found.first[text + 1])
    # Distinct (passage, term): a word lies in the last passage that begins before it and in that one's
    # predecessor, where they reach it.
    last = np.searchsorted(begin, known, "right") - 1
    pairs = []
    for passage in (last, last - 1):
        inside = (passage >= 0) & (begin[passage] <= known) & (known < end[passage])
        pairs.append(passage[inside] * len(index.terms) + at[known[inside]])
    distinct = np.sort(np.concatenate(pairs))
    distinct = distinct[np.concatenate(([True], distinct[1:] != distinct[:-1]))] if len(distinct) else distinct
    owner, term = distinct // len(index.terms), distinct % len(index.terms)
    starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(owner) else owner
    best: dict[tuple[int, int], tuple] = {}
    if not len(owner):
        return []
    ends = np.append(starts[1:], len(term))
    # Of each passage and range of items, the largest score there could be.
    bound = np.zeros((len(starts), index.by_range.shape[1]), bool)
    for lo in range(0, len(starts), SLICE):
        hi = min(lo + SLICE, len(starts))
        rows = index.by_range[term[starts[lo] : ends[hi - 1]]]
        sums = np.add.reduceat(rows, starts[lo:hi] - starts[lo], axis=0, dtype=np.uint32)
        bound[lo:hi] = sums >= (threshold - 1e-9) / index.step
    for k in np.flatnonzero(bound.any(1)).tolist():
        i = int(owner[starts[k]])
        lo, hi = int(begin[i]), int(end[i])
        terms = term[starts[k] : ends[k]].tolist()
        hits = [x for r in np.flatnonzero(bound[k]).tolist() for x in index.search(terms, threshold, int(index.ranges[r]), int(index.ranges[r + 1]))]
        there = None
        for item, score in hits:
            if there is None:
                there = np.concatenate([chain(h[lo:hi], k) for k in range(1, SHINGLE + 1)])
            q, a = _share(shard.question[item], there), _share(shard.answer[item], there)
            if q >= QUESTION_OVERLAP and a >= ANSWER_OVERLAP:
                row = (score, q, a, int(lo - found.first[text[i]]))
                key = (int(text[i]), item)
                if key not in best or row[0] > best[key][0]:
                    best[key] = row
    return [(*k, *v) for k, v in best.items()]


def _searcher(shared, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = shared.value
        for batch in batches:
            ids, rows = batch.column("doc_id").to_pylist(), []
            for b in blocks(batch.column("text")):
                for text, item, *rest in search_block(shard, words(b, ALNUM), threshold):
                    rows.append((ids[b.lo + text], shard.ids[item], *rest))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _FOUND.types)], schema=_FOUND)

    return run


def contaminated(
    docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, question: str | None = None, answer: str | None = None,
    id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap, first_word: what documents hold of items.

    ``items`` has ``question`` and ``answer`` columns where these are named, else one text of which the
    last quarter is the answer.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id).cast("long").alias("doc_id"), F.lower(text).cast("binary").alias("text"))
    parts = []
    for shard in _shards(items, question, answer, item_id, item_text):
        shared = spark.sparkContext.broadcast(shard)
        parts.append(source.mapInArrow(_searcher(shared, threshold), FOUND))
    if not parts:
        return spark.createDataFrame([], FOUND)
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    row = F.struct("score", "question_overlap", "answer_overlap", (-F.col("first_word")).alias("f"))
    best = found.groupBy("doc_id", "item_id").agg(F.max(row).alias("b"))
    return best.select("doc_id", "item_id", "b.score", "b.question_overlap", "b.answer_overlap", (-F.col("b.f")).alias("first_word"))


def _cleaner(shared, threshold: float, lower: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = shared.value
        for batch in batches:
            own = batch.drop_columns([lower])
            for b in blocks(batch.column(lower)):
                held = {text for text, *_ in search_block(shard, words(b, ALNUM), threshold)}
                kept = [i for i in range(b.lo, b.hi) if i - b.lo not in held]
                if kept:
                    yield own.take(pa.array(kept))

    return run


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the documents of which :func:`contaminated` reports anything; nothing is shuffled."""
    spark, schema, lower = docs.sparkSession, docs.schema, unused("_lower", docs.columns)
    for shard in _shards(items, None, None, item_id, item_text):
        shared = spark.sparkContext.broadcast(shard)
        docs = docs.withColumn(lower, F.lower(text).cast("binary")).mapInArrow(_cleaner(shared, threshold, lower), schema)
    return docs
