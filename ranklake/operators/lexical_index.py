"""The lexical index as tables: segments of postings in blocks, each with the most a document can gain by it.

Documents are dealt to shards by their id, and within a shard to ranges of about ``RANGE_DOCS``.  A row is a
block: one term in one range, with its documents, their largest term frequency and smallest length.  From these two a
search bounds what the term adds to any document of the range, whatever the corpus figures are by
then.  A row without a term lists the documents of the range, those without any token included.

A delivery adds a segment and never rewrites one.  Of documents that it replaces or deletes it keeps the ids, and it takes
their terms out of the document frequencies; searches leave their older versions out.  So statistics are
those of a rebuild at any time.  Segments of like size are merged into one, without the texts.  A manifest, replaced by
one rename, names the segments that count.
"""

from __future__ import annotations

import functools
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ranklake.functions.text import tokenize
from ranklake.operators.sizing import stored_and_measured
from ranklake.sources.snapshots import CommitConflict, Manifest, SnapshotStore
from ranklake.sources.storage import stored

# Fixed value: the share of the mean idf that stands in for a negative one.
EPSILON = 0.25

RANGE_DOCS = 128
#: Texts of a shard, in bytes on average: one task sorts and writes its postings.
SHARD_BYTES = 8 * 1024 * 1024
#: So many segments of like size are merged into one.
FAN = 4

_RANGE = ("seg", "shard", "part")


@dataclass(frozen=True)
class LexicalIndex:
    """An index as it was when opened.

    ``blocks(seg, shard, part, term, n, max_tf, min_len, docs)``, ``terms(term, df)``, and ``gone(doc_id, until)``:
    segments before ``until`` hold a replaced or deleted version.  ``idf_floor`` stands in for
    negative idf values.
    """

    blocks: DataFrame
    gone: DataFrame | None
    terms: DataFrame
    n_docs: int
    avg_len: float
    idf_floor: float

    def idf(self) -> Column:
        """Inverse document frequency of a row of ``terms``."""
        raw = raw_idf(F.col("df"), F.lit(self.n_docs))
        return F.when(raw < 0, F.lit(self.idf_floor)).otherwise(raw)

    def live(self, rows: DataFrame) -> DataFrame:
        """Rows with ``seg`` and ``doc_id`` but for older versions of documents."""
        if self.gone is None:
            return rows
        latest = self.gone.groupBy(F.col("doc_id").alias("_gone")).agg(F.max("until").alias("_until"))
        return rows.join(latest, (F.col("doc_id") == F.col("_gone")) & (F.col("seg") < F.col("_until")), "left_anti")

    def _listed(self, blocks: DataFrame) -> DataFrame:
        return self.live(blocks.select(*_RANGE, "term", F.explode("docs").alias("d")).select(*_RANGE, "term", "d.*"))

    @property
    def postings(self) -> DataFrame:
        """``doc_id, term, tf, doc_len``."""
        return self._listed(self.blocks.filter(F.col("term").isNotNull())).select("doc_id", "term", "tf", "doc_len")

    @property
    def documents(self) -> DataFrame:
        """``seg, shard, part, doc_id, copies, doc_len`` of every document."""
        return self._listed(self.blocks.filter(F.col("term").isNull())).drop("term").withColumnRenamed("tf", "copies")


def raw_idf(df: Column, n_docs: Column) -> Column:
    return F.ln(n_docs - df + 0.5) - F.ln(df + 0.5)


def default_shards(spark: SparkSession, n_docs: int, n_bytes: int) -> int:
    """About ``SHARD_BYTES`` of text a shard, and small corpora still use all cores."""
    cores = spark.sparkContext.defaultParallelism
    return max(1, -(-n_bytes // SHARD_BYTES), min(4 * cores, n_docs // 250))


# -- blocks ------------------------------------------------------------------


def counted(passages: DataFrame, tokenizer=tokenize, *more: str) -> DataFrame:
    """``doc_id, doc_len, term, tf``; a null term once for each passage.

    The length is taken before the explode, which then carries two numbers per
    token instead of the whole array.
    """
    every = F.concat(F.array(F.lit(None).cast("string")), F.col("tokens"))
    return (
        passages.select(*more, "doc_id", tokenizer(F.col("content")).alias("tokens"))
        .select(*more, "doc_id", F.size("tokens").cast("long").alias("doc_len"), every.alias("tokens"))
        # Not a plain explode: Spark would tokenize once more, in a filter on the array's size.
        .select(*more, "doc_id", "doc_len", F.explode_outer("tokens").alias("term"))
        .groupBy(*more, "doc_id", "doc_len", "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def _dealt(rows: DataFrame, n_docs: int, shards: int) -> DataFrame:
    """Rows by shard, one a task, with shard and range.  All that follows within a document needs no further shuffle."""
    ranges = max(1, round(n_docs / shards / RANGE_DOCS))
    place = F.xxhash64("doc_id")
    return rows.withColumns(
        {"shard": F.pmod(place, F.lit(shards)).cast("int"), "part": F.pmod(F.shiftright(place, 24), F.lit(ranges)).cast("int")}
    ).repartitionById(shards, "shard")


def _block_schema(id_type: str) -> str:
    docs = f"array<struct<doc_id:{id_type},tf:long,doc_len:long>>"
    return f"part int, term string, n long, max_tf long, min_len long, docs {docs}, shard int"


def _blocks_of_postings(postings: DataFrame) -> DataFrame:
    """Blocks of ``shard, part, doc_id, doc_len, term, tf``."""
    return postings.groupBy("shard", "part", "term").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("tf").alias("max_tf"),
        F.min("doc_len").alias("min_len"),
        F.sort_array(F.collect_list(F.struct("doc_id", "tf", "doc_len"))).alias("docs"),
    )


def _blocks_of_texts(rows: DataFrame, tokenizer) -> DataFrame:
    """Blocks of ``shard, part, doc_id, content``, of which a shard lies in one task.

    The task counts the terms of the texts it reads, keeps four numbers a posting, and sorts these into blocks at the end.
    """
    tokens = F.coalesce(tokenizer(F.col("content")), F.array().cast("array<string>"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("shard", "part", "doc_id", tokens.alias("tokens")).mapInArrow(_in_blocks, _block_schema(id_type))


def _in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs, rows, terms, counts, n_rows = [], [], [], [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        tokens = batch.column("tokens")
        lengths = tokens.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        words = tokens.flatten().dictionary_encode()
        codes = pc.fill_null(words.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        width = len(words.dictionary) + 1
        every = np.arange(batch.num_rows)
        # Code 0 is the null term, once for each text.
        key, tf = np.unique(np.concatenate([every * width, np.repeat(every, lengths) * width + codes]), return_counts=True)
        code = (key % width - 1).astype(np.int32)
        terms.append(pa.DictionaryArray.from_arrays(pa.array(code, mask=code < 0), words.dictionary))
        rows.append((key // width + n_rows).astype(np.int32))
        counts.append(tf.astype(np.int32))
        docs.append(pa.table([batch.column(c) for c in ("shard", "part", "doc_id")] + [pa.array(lengths)], ["shard", "part", "doc_id", "doc_len"]))
        n_rows += batch.num_rows
    if not docs:
        return
    # Documents by shard, range, id and length; what agrees in all of these is counted together.
    table = pa.concat_tables(docs).combine_chunks()
    ids = pc.rank(table.column("doc_id"), null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
    shard, part, doc_len = (table.column(c).to_numpy() for c in ("shard", "part", "doc_len"))
    order = np.lexsort((doc_len, ids, part, shard))
    new = np.ones(n_rows, bool)
    new[1:] = np.any([np.diff(c[order]) != 0 for c in (doc_len, ids, part, shard)], axis=0)
    doc_of = np.empty(n_rows, np.int64)
    doc_of[order] = np.cumsum(new) - 1
    table = table.take(pa.array(order[new]))
    shard, part, doc_len = (table.column(c).to_numpy().astype(np.int64) for c in ("shard", "part", "doc_len"))
    # Postings by shard, term and document, so by range too.
    words = pa.chunked_array(terms).unify_dictionaries().combine_chunks()
    names = words.dictionary
    place = np.concatenate([[0], pc.rank(names, tiebreaker="dense").to_numpy().astype(np.int64)])
    term, doc = place[pc.fill_null(words.indices, -1).to_numpy().astype(np.int64) + 1], doc_of[np.concatenate(rows)]
    key = ((shard[doc] - shard[0]) * len(place) + term) * len(doc_len) + doc
    order = np.argsort(key)
    key, tf = key[order], np.concatenate(counts)[order].astype(np.int64)
    first = np.flatnonzero(np.diff(key, prepend=-1))
    tf, (term, doc) = np.add.reduceat(tf, first), np.divmod(key[first], len(doc_len))
    begin = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(part[doc], prepend=-1) != 0))
    name = term[begin] % len(place) - 1
    listed = pa.StructArray.from_arrays([table.column("doc_id").combine_chunks().take(pa.array(doc)), pa.array(tf), pa.array(doc_len[doc])], ["doc_id", "tf", "doc_len"])
    blocks = pa.table(
        {
            "part": pa.array(part[doc[begin]].astype(np.int32)),
            "term": names.take(pc.sort_indices(names)).take(pa.array(name, mask=name < 0)),
            "n": pa.array(np.diff(np.append(begin, len(doc)))),
            "max_tf": pa.array(np.maximum.reduceat(tf, begin)),
            "min_len": pa.array(np.minimum.reduceat(doc_len[doc], begin)),
            "docs": pa.ListArray.from_arrays(pa.array(np.append(begin, len(doc)).astype(np.int32)), listed),
            "shard": pa.array(shard[doc[begin]].astype(np.int32)),
        }
    )
    yield from blocks.to_batches(max_chunksize=10_000)


def _write_blocks(blocks: DataFrame, folder: str) -> DataFrame:
    """Blocks written by shard and sorted by term."""
    blocks.sortWithinPartitions("shard", "term", "part").write.partitionBy("shard").parquet(f"{folder}/blocks")
    return _read_blocks(blocks.sparkSession, folder, blocks.schema["docs"].dataType.elementType["doc_id"].dataType.simpleString())


def _read_blocks(spark: SparkSession, folder: str, id_type: str) -> DataFrame:
    return spark.read.schema(_block_schema(id_type)).parquet(f"{folder}/blocks")


# -- segments ----------------------------------------------------------------


def build_index(passages: DataFrame, path: str, *, shards: int | None = None, tokenizer=tokenize) -> LexicalIndex:
    """Write the index of ``passages(doc_id, content)`` under ``path`` and open it; what was there no longer counts."""
    spark = passages.sparkSession
    return _add(spark, path, passages, None, shards, tokenizer, None, anew=True)


def update_index(
    spark: SparkSession,
    path: str,
    passages: DataFrame | None = None,
    deleted: DataFrame | None = None,
    *,
    shards: int | None = None,
    tokenizer=tokenize,
    batch: tuple[str, int] | None = None,
) -> LexicalIndex:
    """Take in new and changed ``passages`` and the ``doc_id`` of ``deleted`` ones as one more segment.

    A ``batch`` (stream, number) that was taken before changes nothing.  Segments are merged where
    enough of like size have come together.
    """
    _add(spark, path, passages, deleted, shards, tokenizer, batch)
    return merge_segments(spark, path)


def load_index(spark: SparkSession, path: str) -> LexicalIndex:
    """Open an index as it is now."""
    return _open(spark, path, SnapshotStore(path).manifest(spark))


def _segments(path: str, manifest: Manifest) -> dict[int, str]:
    return {int(number): f"{path}/{folder}" for number, folder in manifest.folders.get("segments", {}).items()}


def _open(spark: SparkSession, path: str, manifest: Manifest) -> LexicalIndex:
    segments = _segments(path, manifest)
    if not segments:
        raise LookupError(f"no index in {path}")
    stats = _stats(spark, segments).collect()  # a row a segment
    n_docs, n_tokens = sum(s["n_docs"] for s in stats), sum(s["n_tokens"] for s in stats)
    newest = max(stats, key=lambda s: s["seg"])
    blocks = [_read_blocks(spark, folder, newest["id_type"]).select(F.lit(number).alias("seg"), "*") for number, folder in segments.items()]
    gone = [f"{segments[s['seg']]}/gone" for s in stats if s["n_gone"]]
    return LexicalIndex(
        blocks=functools.reduce(DataFrame.unionByName, blocks),
        gone=spark.read.parquet(*gone) if gone else None,
        terms=_frequencies(spark, segments),
        n_docs=n_docs,
        avg_len=n_tokens / n_docs if n_docs else 0.0,
        idf_floor=EPSILON * newest["mean_idf"],
    )


def _stats(spark: SparkSession, segments: dict[int, str]) -> DataFrame:
    rows = [spark.read.parquet(f"{folder}/stats").withColumn("seg", F.lit(number)) for number, folder in segments.items()]
    return functools.reduce(DataFrame.unionByName, rows)


def _frequencies(spark: SparkSession, segments: dict[int, str]) -> DataFrame:
    """``term, df`` over some segments; a term that no document is left with goes."""
    terms = spark.read.parquet(*[f"{folder}/terms" for folder in segments.values()])
    if len(segments) == 1:
        return terms
    return terms.groupBy("term").agg(F.sum("df").alias("df")).filter("df <> 0")


def _add(spark, path, passages, deleted, shards, tokenizer, batch, anew=False) -> LexicalIndex:
    store = SnapshotStore(path)
    while True:
        base = store.manifest(spark)
        if batch and base.batches.get(batch[0], -1) >= batch[1]:
            return _open(spark, path, base)
        known = {} if anew else _segments(path, base)
        number, tag = max(known, default=-1) + 1, f"segments/{uuid.uuid4().hex}"
        _write_segment(spark, f"{path}/{tag}", number, known, path, base, passages, deleted, shards, tokenizer)
        folders = {str(n): f.removeprefix(f"{path}/") for n, f in known.items()} | {str(number): tag}
        try:
            return _open(spark, path, store.commit(spark, Manifest(base.number, {"segments": folders}, {}, base.batches), batch))
        except CommitConflict:
            continue


def _write_segment(spark, folder, number, known, path, base, passages, deleted, shards, tokenizer) -> None:
    id_type = next(df for df in (passages, deleted) if df is not None).schema["doc_id"].dataType.simpleString()
    none = spark.createDataFrame([], f"shard int, part int, doc_id {id_type}, content string")
    n_new, n_bytes = _extent(passages, F.octet_length("content")) if passages is not None else (0, 0)
    shards = shards or default_shards(spark, n_new, n_bytes)
    rows = _dealt(passages.select("doc_id", "content"), n_new, shards) if passages is not None else none
    blocks = _write_blocks(_blocks_of_texts(rows, tokenizer), folder)
    listed = blocks.filter(F.col("term").isNull()).select(F.explode("docs").alias("d")).select("d.*")
    own = blocks.filter(F.col("term").isNotNull()).groupBy("term").agg(F.sum("n").alias("df"))
    figures = listed.agg(F.sum("tf").alias("docs"), F.sum(F.col("tf") * F.col("doc_len")).alias("tokens"))
    n_docs, n_tokens, n_gone = (*map(int, (x or 0 for x in figures.first())), 0)
    if known:
        index = _open(spark, path, base)
        changed = listed.select("doc_id")
        if deleted is not None:
            changed = changed.unionByName(deleted.select("doc_id"))
        lost = stored(index.documents.join(changed.distinct(), "doc_id", "left_semi"), "lost")
        lost.select("doc_id", F.lit(number).alias("until")).distinct().write.parquet(f"{folder}/gone")
        row = lost.agg(F.count(F.lit(1)), F.sum("copies"), F.sum(F.col("copies") * F.col("doc_len"))).first()
        n_gone, n_docs, n_tokens = row[0], n_docs - (row[1] or 0), n_tokens - (row[2] or 0)
        older = _lost_by_term(index, lost)
        own = own.unionByName(older.groupBy("term").agg((-F.sum("n")).alias("df"))).groupBy("term").agg(F.sum("df").alias("df")).filter("df <> 0")
    own.write.parquet(f"{folder}/terms")
    total = n_docs + (_stats(spark, known).agg(F.sum("n_docs")).first()[0] if known else 0)
    idf = _frequencies(spark, known | {number: folder}).agg(F.avg(raw_idf(F.col("df"), F.lit(total)))).first()[0] or 0.0
    _write_stats(spark, folder, n_new, n_docs, n_tokens, n_gone, idf, id_type)


def _lost_by_term(index: LexicalIndex, lost: DataFrame) -> DataFrame:
    """``term, n`` of blocks that hold some of the ``lost`` documents: how many of them.

    Only ranges with such a document are opened.  Where all documents of a range are lost, its blocks count whole, and their
    lists are not read; else the lists meet the lost ids of the range.
    """
    listed = index.blocks.filter(F.col("term").isNull()).select(*_RANGE, F.col("n").alias("listed"))
    by_range = lost.groupBy(*_RANGE).agg(F.count(F.lit(1)).alias("n_lost"), F.collect_set("doc_id").alias("lost")).join(listed, list(_RANGE))
    whole = F.col("n_lost") == F.col("listed")
    payload = F.aggregate("lost", F.lit(0).cast("long"), lambda n, d: n + F.octet_length(d.cast("string")) + 8)
    ids, size = stored_and_measured(by_range.withColumn("lost", F.when(~whole, F.col("lost"))).select(*_RANGE, "lost"), "lost_ids", F.coalesce(payload, F.lit(0)))
    blocks = index.blocks.filter(F.col("term").isNotNull())
    all_of, some_of = ids.filter(F.col("lost").isNull()).select(*_RANGE), ids.filter(F.col("lost").isNotNull())
    if size.fits():
        all_of, some_of = F.broadcast(all_of), F.broadcast(some_of)
    counted_whole = blocks.select(*_RANGE, "term", "n").join(all_of, list(_RANGE), "left_semi").select("term", "n")
    met = F.size(F.filter("docs", lambda d: F.array_contains("lost", d["doc_id"]))).cast("long").alias("n")
    return counted_whole.unionByName(blocks.join(some_of, list(_RANGE)).select("term", met).filter("n > 0"))


def _extent(rows: DataFrame, payload: Column) -> tuple[int, int]:
    """Rows and bytes, where ``payload`` gives the bytes of a row."""
    n, n_bytes = rows.agg(F.count(F.lit(1)), F.sum(payload.cast("long"))).first()
    return n, n_bytes or 0


def _write_stats(spark, folder, size, n_docs, n_tokens, n_gone, mean_idf, id_type) -> None:
    row = (size, n_docs, n_tokens, n_gone, float(mean_idf), id_type)
    spark.createDataFrame([row], "size long, n_docs long, n_tokens long, n_gone long, mean_idf double, id_type string").coalesce(1).write.parquet(f"{folder}/stats")


def merge_segments(spark: SparkSession, path: str, fan: int = FAN) -> LexicalIndex:
    """Merge segments until fewer than ``fan`` of any size class are left."""
    store = SnapshotStore(path)
    while True:
        base = store.manifest(spark)
        segments = _segments(path, base)
        stats = {s["seg"]: s for s in _stats(spark, segments).collect()}
        classes: dict[int, list[int]] = {}
        for number, s in stats.items():
            classes.setdefault(int(math.log(s["size"] + 1, fan)), []).append(number)
        ripe = next((sorted(numbers) for _, numbers in sorted(classes.items()) if len(numbers) >= fan), None)
        if ripe is None:
            return _open(spark, path, base)
        tag = f"segments/{uuid.uuid4().hex}"
        _write_merged(spark, path, f"{path}/{tag}", base, ripe, stats)
        folders = {n: f for n, f in base.folders["segments"].items() if int(n) not in ripe} | {str(ripe[-1]): tag}
        try:
            store.commit(spark, Manifest(base.number, {"segments": folders}, {}, base.batches))
        except CommitConflict:
            continue


def _write_merged(spark, path, folder, base, ripe, stats) -> None:
    """One segment of several, under the number of the last: what they hold that still counts."""
    index, segments = _open(spark, path, base), _segments(path, base)
    own = {n: segments[n] for n in ripe}
    rows = index._listed(index.blocks.filter(F.col("seg").isin(ripe))).select("doc_id", "doc_len", "term", "tf")
    size = rows.filter(F.col("term").isNull()).count()
    n_bytes = _extent(rows, (F.octet_length("term") + 1) * F.col("tf"))[1]
    _write_blocks(_blocks_of_postings(_dealt(rows, size, default_shards(spark, size, n_bytes))), folder)
    _frequencies(spark, own).write.parquet(f"{folder}/terms")
    n_gone, gone = 0, [f"{own[n]}/gone" for n in ripe if stats[n]["n_gone"]]
    if gone:
        # Only segments that are left, before the one that said so, can hold older versions.
        oldest = min([n for n in segments if n not in ripe] + [ripe[-1]])
        needed = spark.read.parquet(*gone).filter(F.col("until") > oldest)
        needed.write.parquet(f"{folder}/gone")
        n_gone = needed.count()
    figures = [sum(stats[n][c] for n in ripe) for c in ("n_docs", "n_tokens")]
    _write_stats(spark, folder, size, *figures, n_gone, stats[ripe[-1]]["mean_idf"], stats[ripe[-1]]["id_type"])
