"""Batch retrieval: single channels, hybrid, several variants per query, re-ranking."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranklake.functions.models import EmbedFactory, ScoreFactory, embedding
from ranklake.functions.text import search_mode
from ranklake.operators import dense, lexical
from ranklake.operators.expansion import (
    DEFAULT_NUM_VARIANTS,
    EMPTY_QUERY,
    clean_queries,
    expand,
    numbered,
)
from ranklake.operators.fusion import as_list, rrf_fuse
from ranklake.operators.passages import enrich
from ranklake.operators.rerank import DEFAULT_RERANK_POOL, rerank
from ranklake.sources.storage import stored

MODES = ("semantic", "bm25", "hybrid")

# Fixed value: warning text.
NO_LEXICAL = "BM25 index not found — falling back to semantic retrieval only."
NO_VECTORS = "Vector index missing."

_KEYS = ["query_id", "variant_no"]


@dataclass(frozen=True)
class Corpus:
    """What a search reads.

    ``passages`` has ``doc_id, content`` and metadata, ``vectors`` has ``doc_id,
    embedding``.  ``embed`` turns query texts into vectors; it is not needed for
    queries that bring an ``embedding`` column.  A missing index is ``None``.  With ``pad_words`` the
    lexical channel always returns as many documents as asked for, the last ones without any query term.
    """

    passages: DataFrame
    lexical: lexical.LexicalIndex | None = None
    vectors: DataFrame | None = None
    embed: EmbedFactory | None = None
    pad_words: bool = False


@dataclass(frozen=True)
class Retrieval:
    """Result tables, all keyed by ``query_id``."""

    variants: DataFrame
    hits: DataFrame
    warnings: DataFrame


def embed_passages(
    passages: DataFrame,
    factory: EmbedFactory,
    batch_size: int = 256,
    partitions: int | None = None,
) -> DataFrame:
    """``passages`` with the vector of their content as ``embedding``.

    Partitions stay as they are read, or are dealt out evenly to ``partitions``
    where the input has too few for the model to keep all cores busy.
    """
    if partitions:
        passages = passages.repartition(partitions)
    return passages.withColumn("embedding", embedding(F.col("content"), factory, batch_size))


def default_pool(top_k: int) -> int:
    """Depth of one channel before fusion."""
    return max(2 * top_k, 8)


def search(
    corpus: Corpus, queries: DataFrame, mode: str, top_k: int, *, pool: int | None = None
) -> Retrieval:
    """Best ``top_k`` hits per query, with the passages' columns.

    ``queries`` has ``query_id, query``, and ``variant_no`` if a query comes in
    several wordings; blank ones are dropped.  One wording in a single channel
    keeps the channel's own score.  Otherwise channels are fused per wording (the
    dense list first), then the complete fused lists across wordings.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    pool = default_pool(top_k) if pool is None else pool
    queries = _prepared(queries)
    notes = []
    if mode in ("semantic", "hybrid") and corpus.vectors is None:
        notes, mode = [NO_VECTORS], None
    elif mode in ("bm25", "hybrid") and corpus.lexical is None:
        notes, mode = [NO_LEXICAL], "semantic" if mode == "hybrid" else None
    hits = _ranked(corpus, queries, mode, top_k, pool)
    columns = [c for c in corpus.passages.columns if c != "doc_id"]
    hits = enrich(hits, corpus.passages, columns)
    return Retrieval(queries.select("query_id", "variant_no", "query"), hits, _warn(queries, notes))


def _prepared(queries: DataFrame) -> DataFrame:
    """Clean queries with a ``variant_no``."""
    if "variant_no" not in queries.columns:
        queries = queries.withColumn("variant_no", F.lit(0))
    return clean_queries(queries)


def _warn(queries: DataFrame, notes: list[str]) -> DataFrame:
    return queries.select("query_id").distinct().select(
        "query_id", F.explode(F.array(*[F.lit(n) for n in notes]).cast("array<string>")).alias("warning")
    )


def _ranked(corpus: Corpus, queries: DataFrame, mode: str | None, top_k: int, pool: int) -> DataFrame:
    """``query_id, doc_id, rank, score`` before enrichment."""
    if mode is None:
        ids = corpus.passages.schema["doc_id"].dataType.simpleString()
        return queries.select(
            "query_id",
            F.lit(None).cast(ids).alias("doc_id"),
            F.lit(0).alias("rank"),
            F.lit(0.0).alias("score"),
        ).filter(F.lit(False))
    if mode == "hybrid":
        channels = as_list(_dense(corpus, queries, pool), 0).unionByName(
            as_list(_lexical(corpus, queries, pool), 1)
        )
        return _across_variants(_with_variant_count(rrf_fuse(channels, _KEYS), queries), top_k)
    channel = _dense if mode == "semantic" else _lexical
    hits = _with_variant_count(channel(corpus, queries, max(pool, top_k)), queries)
    # A single wording is cut at top_k itself; several are fused from their pools.
    depth = F.when(F.col("n_variants") == 1, F.lit(top_k)).otherwise(F.lit(pool))
    hits = hits.filter(F.col("rank") <= depth)
    if mode == "bm25":
        # Positional score for the depth that was asked for.
        hits = hits.withColumn("score", (depth + 1 - F.col("rank")).cast("double"))
    return _across_variants(hits, top_k)


def _with_variant_count(lists: DataFrame, queries: DataFrame) -> DataFrame:
    """Add how many wordings a query has.  The lists are cut to their pools already."""
    counts = queries.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_variants"))
    return lists.join(counts, "query_id")


def _across_variants(lists: DataFrame, top_k: int) -> DataFrame:
    """Fuse the lists of a query's variants; the list of an only variant stays as it is."""
    fused = rrf_fuse(
        lists.withColumn("list_no", F.col("variant_no")).withColumn("own_score", F.col("score")),
        ["query_id", "n_variants"],
    )
    score = F.when(F.col("n_variants") == 1, F.col("own_score")).otherwise(F.col("score"))
    return fused.filter(F.col("rank") <= top_k).select(
        "query_id", "doc_id", "rank", score.alias("score")
    )


def _dense(corpus: Corpus, queries: DataFrame, k: int) -> DataFrame:
    if "embedding" not in queries.columns:
        if corpus.embed is None:
            raise ValueError("queries need an embedding column, or the corpus an embed function")
        # Written, so that each query goes through the model once.
        queries = stored(
            queries.select(*_KEYS, embedding(F.col("query"), corpus.embed).alias("embedding")),
            "query_vectors",
        )
    return dense.search(corpus.vectors, queries, k, keys=_KEYS)


def _lexical(corpus: Corpus, queries: DataFrame, k: int) -> DataFrame:
    hits = lexical.search(corpus.lexical, queries, k, keys=_KEYS)
    if corpus.pad_words:
        hits = lexical.pad_hits(stored(hits, "word_hits"), queries, corpus.passages, k, _KEYS)
    return hits.drop("bm25_score")


def search_requests(
    corpus: Corpus, requests: DataFrame, top_k: int, *, pool: int | None = None
) -> Retrieval:
    """Search with a mode per request: ``query_id, query, mode``.

    ``mode`` is a label in any case; a label that is none of the three modes
    means hybrid.
    """
    labelled = requests.withColumn("mode", F.coalesce(search_mode(F.col("mode")), F.lit("hybrid")))
    results = [
        search(corpus, labelled.filter(F.col("mode") == m).drop("mode"), m, top_k, pool=pool)
        for m in MODES
    ]
    return Retrieval(
        _union(r.variants for r in results),
        _union(r.hits.withColumn("mode", F.lit(m)) for m, r in zip(MODES, results)),
        _union(r.warnings for r in results),
    )


def _union(frames) -> DataFrame:
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame)
    return first


def retrieve(
    corpus: Corpus,
    queries: DataFrame,
    *,
    mode: str = "hybrid",
    responses: DataFrame | None = None,
    num_variants: int = DEFAULT_NUM_VARIANTS,
    top_k: int = 10,
    scorer: ScoreFactory | None = None,
    rerank_pool: int = DEFAULT_RERANK_POOL,
) -> Retrieval:
    """Expand, search, and re-rank a table of queries.

    ``responses`` (``query_id, raw_response``) are the answers to the expansion
    requests; without them only the original wording is searched.  With a
    ``scorer``, ``rerank_pool`` hits are retrieved and cut to ``top_k`` after
    scoring against the original query.
    """
    if responses is not None:
        variants, warnings = expand(queries, responses, num_variants)
    else:
        variants = numbered(queries.withColumn("variants", F.lit(None).cast("array<string>")))
        blank = queries.join(variants.select("query_id"), "query_id", "left_anti")
        warnings = blank.select("query_id", F.lit(EMPTY_QUERY).alias("warning"))
    # Every channel reads the variants, so they are parsed and numbered once.
    variants = stored(variants, "variants")
    depth = rerank_pool if scorer else top_k
    found = search(corpus, variants, mode, depth)
    hits = found.hits
    if scorer:
        originals = clean_queries(queries)
        hits = rerank(hits, originals, top_k, scorer)
    return Retrieval(variants, hits, warnings.unionByName(found.warnings))
