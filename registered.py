"""The registered queries: one function of (spark, sf_dir) per key."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranklake.functions.models import hashing_embedder, token_overlap_scorer
from ranklake.functions.text import tokenize
from ranklake.operators import dense, dense_lists, expansion, lexical, passages, present, profile, sketches
from ranklake.operators.evaluate import compare_modes, judged_wins, mode_overlap
from ranklake.operators.fusion import as_list, rrf_fuse
from ranklake.operators.products import clean_meta, join_all_reviews, merge_reviews, with_texts
from ranklake.operators.rerank import rerank
from ranklake.operators.reviews import aggregate_reviews, rank_reviews
from ranklake.plans.product_table import product_table, run_etl
from ranklake.plans.search import Corpus, embed_passages, retrieve, search, search_requests
from ranklake.operators.embedding_cache import EmbeddingCache
from ranklake.sources import drift, feedback, roles, tables
from ranklake.sources.schemas import FEEDBACK, PRODUCT_META, REVIEWS
from ranklake.sources.storage import fresh_path, stored
from ranklake.streaming.feedback import ingest_feedback
from ranklake.streaming.refresh import ProductStore

DIMS = 64
TOP_K = 10
QUERIES: dict = {}

# Tables that have columns to count, in the order of the report.
ALL_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def register(function):
    QUERIES[function.__name__] = function
    return function


def _long(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


# -- product table -----------------------------------------------------------


@register
def etl_review_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(rank_reviews(roles.reviews(spark, sf_dir)), "rn")


@register
def etl_review_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate_reviews(roles.reviews(spark, sf_dir))


@register
def etl_meta_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_meta(roles.product_meta(spark, sf_dir))


@register
def etl_merge_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = merge_reviews(
        clean_meta(roles.product_meta(spark, sf_dir)),
        aggregate_reviews(roles.sparse_reviews(spark, sf_dir)),
    )
    return merged.select("parent_asin", "product_title", "review_texts", "avg_review_rating")


@register
def etl_text_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = merge_reviews(
        clean_meta(roles.product_meta(spark, sf_dir)),
        aggregate_reviews(roles.reviews(spark, sf_dir)),
    )
    return with_texts(merged).select("parent_asin", "text_bm25", "text_faiss")


def _products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return product_table(roles.reviews(spark, sf_dir), roles.product_meta(spark, sf_dir))


@register
def etl_product_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _products(spark, sf_dir)


@register
def etl_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines in, product table out, read back from Parquet; details are objects in the files."""
    path = fresh_path(spark, "etl")
    roles.reviews(spark, sf_dir).write.json(f"{path}/reviews.jsonl")
    meta = roles.product_meta(spark, sf_dir)
    meta.withColumn("details", F.from_json("details", "size long")).write.json(f"{path}/meta.jsonl")
    run_etl(spark, f"{path}/reviews.jsonl", f"{path}/meta.jsonl", f"{path}/processed/products")
    return tables.read_products(spark, f"{path}/processed/products")


def _deliveries(spark: SparkSession, sf_dir: str) -> tuple[ProductStore, int]:
    """All products and reviews, delivered in four parts, and the version after the first two.

    Some products come with the second metadata only, some change by it, and no review comes with either.
    """
    path = fresh_path(spark, "refresh")
    store = ProductStore(f"{path}/store", buckets=8)
    meta, reviews = roles.product_meta(spark, sf_dir), roles.reviews(spark, sf_dir)
    changes = F.col("average_rating") > 2.5
    early = meta.filter("store IS NOT NULL").withColumn("title", F.when(changes, F.concat(F.lit("old "), "title")).otherwise(F.col("title")))

    def deliver(rows: DataFrame, kind: str, schema, refresh) -> None:
        rows.write.mode("append").json(f"{path}/{kind}")
        refresh(spark.readStream.schema(schema).json(f"{path}/{kind}"), f"{path}/checkpoint-{kind}").awaitTermination()

    deliver(early, "meta", PRODUCT_META, store.refresh_metadata)
    deliver(reviews.filter("rating <= 3"), "reviews", REVIEWS, store.refresh_reviews)
    version = store.version(spark)
    deliver(meta.filter(F.col("store").isNull() | changes), "meta", PRODUCT_META, store.refresh_metadata)
    deliver(reviews.filter("rating > 3"), "reviews", REVIEWS, store.refresh_reviews)
    return store, version


@register
def scan_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata files that disagree on the type of price and rating: the rows by the merged schema."""
    return drift.read_merged(spark, _drifting(spark, sf_dir)).select("parent_asin", "price", "rating_number", "store")


@register
def scan_drift_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which keys those files disagree on."""
    return drift.conflicts(drift.key_types(spark, _drifting(spark, sf_dir)))


def _drifting(spark: SparkSession, sf_dir: str) -> str:
    """Prices as numbers, as text, or as objects, ratings as whole numbers or with a fraction, by file."""
    path, meta = fresh_path(spark, "drift"), roles.product_meta(spark, sf_dir).select("parent_asin", "price", "rating_number", "store")
    number = F.col("price").try_cast("double")
    size = F.col("rating_number")
    for name, part, price, rating in (
        ("numbers", size <= 15, number, size),
        ("texts", (size > 15) & (size <= 30), F.col("price"), size + 0.5),
        ("objects", size > 30, F.struct(F.coalesce(number, F.lit(0.0)).alias("amount")), size),
    ):
        meta.filter(part).withColumns({"price": price, "rating_number": rating}).write.json(f"{path}/{name}")
    return f"{path}/*"


@register
def product_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The product table after all deliveries: that of a full build."""
    return _deliveries(spark, sf_dir)[0].products(spark)


@register
def product_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version after the first deliveries, read when two more were published."""
    store, version = _deliveries(spark, sf_dir)
    return store.products(spark, version)


@register
def etl_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.row_counts(
        reviews=roles.reviews(spark, sf_dir),
        meta=roles.product_meta(spark, sf_dir),
        products=_products(spark, sf_dir),
    )


@register
def passages_dual(spark: SparkSession, sf_dir: str) -> DataFrame:
    products = stored(_products(spark, sf_dir), "products")
    for_words, for_vectors = passages.build_dual_corpora(products)
    return for_words.withColumn("corpus", F.lit("bm25")).unionByName(
        for_vectors.withColumn("corpus", F.lit("faiss"))
    ).select("corpus", "content", *passages.META_COLUMNS)


@register
def review_fanout_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All products and their reviews, with or without a text; suppliers are products that nobody reviewed."""
    parts = roles.product_meta(spark, sf_dir).select("parent_asin", "title")
    suppliers = roles.table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("supplier "), F.col("s_suppkey").cast("string")).alias("parent_asin"), F.col("s_name").alias("title")
    )
    reviews = roles.sparse_reviews(spark, sf_dir).withColumn("reviewed", F.lit(True))
    return (
        join_all_reviews(parts.unionByName(suppliers), reviews)
        .groupBy("parent_asin", "title")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count("reviewed").alias("n_reviews"),
            F.count("text").alias("n_texts"),
            F.sum("rating").alias("rating_sum"),
        )
    )


# -- profiling ---------------------------------------------------------------


@register
def scan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.row_counts(**{t: roles.table(spark, sf_dir, t) for t in ALL_TABLES})


@register
def profile_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
    out = profile.describe(roles.table(spark, sf_dir, "lineitem"), columns)
    figures = ["mean", "stddev", "min", "max", "q25", "q50", "q75"]
    return out.select("column_name", "n", *[F.round(c, 6).alias(c) for c in figures])


@register
def profile_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = roles.reviews(spark, sf_dir).select(
        "helpful_vote", (F.trim("text") != "").alias("has_text")
    )
    return profile.column_means(rows, rows.columns).withColumn("mean", F.round("mean", 9))


@register
def profile_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.null_shares(roles.product_meta(spark, sf_dir)).withColumn(
        "null_share", F.round("null_share", 9)
    )


@register
def profile_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.info(roles.product_meta(spark, sf_dir))


@register
def profile_value_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.value_shares(roles.reviews(spark, sf_dir), "helpful_vote").withColumn(
        "percent", F.round("percent", 9)
    )


@register
def profile_top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.top_values(roles.reviews(spark, sf_dir), "parent_asin", 10)


@register
def profile_nunique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.distinct_count(roles.reviews(spark, sf_dir), "parent_asin")


@register
def profile_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of two deliveries combined, against the exact figures of all rows: whether they are within the stated errors."""
    reviews, columns, path = roles.reviews(spark, sf_dir), ["parent_asin", "helpful_vote", "text"], fresh_path(spark, "sketches")
    for name, part in (("low", "rating <= 3"), ("high", "rating > 3"), ("low", "rating <= 3")):
        sketches.append(reviews.filter(part), columns, path, name)
    kept = stored(sketches.combined(spark, path), "kept")
    out = []
    for c in columns:
        own = kept.filter(F.col("column_name") == c)
        top = sketches.top_values(own, 10).join(profile.top_values(reviews, c, 10**6).select(F.col("value").cast("string"), F.col("n").alias("exact")), "value", "left")
        right = top.agg(F.coalesce(F.max(F.abs(F.col("n") - F.col("exact")) - F.col("error")), F.lit(0.0)) <= 0)
        exact = profile.distinct_count(reviews, c).select("n_distinct").scalar()
        near = sketches.distinct_counts(own).select(F.abs(F.col("n_distinct") - exact) <= F.greatest(F.col("error"), F.lit(1)))
        out.append(own.select("column_name", "n", right.scalar().alias("counts_right"), near.scalar().alias("distinct_right")))
    return out[0].unionByName(out[1]).unionByName(out[2])


@register
def profile_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = roles.reviews(spark, sf_dir).select(
        profile.from_epoch_millis(F.col("timestamp")).alias("ts")
    )
    return profile.time_profile(rows, "ts", "2000-01-01 00:00:00").select(
        F.date_format("latest", "yyyy-MM-dd HH:mm:ss").alias("latest"),
        F.date_format("latest_day", "yyyy-MM-dd").alias("latest_day"),
        "n_after",
    )


@register
def profile_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shape of the merged table without the columns that exploration drops."""
    merged = join_all_reviews(
        roles.product_meta(spark, sf_dir).drop("main_category", "subtitle", "images"),
        roles.reviews(spark, sf_dir).drop("helpful_vote", "images"),
    )
    return tables.row_counts(merged=merged)


@register
def sample_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.sample_rows(roles.passages(spark, sf_dir), "doc_id", "seed-1", 2)


@register
def row_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rows from behind three quarters of the table."""
    index = profile.position_index(roles.passages(spark, sf_dir), ["doc_id"])
    return index.at(3 * index.total // 4, 2)


@register
def row_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All usable reviews of the best reviewed product."""
    reviews = roles.reviews(spark, sf_dir)
    best = profile.top_values(reviews, "parent_asin", 1).select("value")
    return reviews.filter(F.col("parent_asin") == best.scalar()).select("parent_asin", "text", "rating")


# -- lexical and vector indexes ----------------------------------------------


@register
def tokenize_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = roles.passages(spark, sf_dir).select("doc_id", tokenize(F.col("content")).alias("t"))
    return tokens.select(
        "doc_id",
        F.size("t").cast("long").alias("n_tokens"),
        F.md5(F.array_join("t", "\n")).alias("tokens_md5"),
    )


@register
def bm25_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.term_counts(roles.passages(spark, sf_dir)).select("doc_id", "term", "tf")


@register
def bm25_doc_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.doc_lengths(roles.passages(spark, sf_dir))


def _index(spark: SparkSession, sf_dir: str) -> lexical.LexicalIndex:
    return lexical.build_index(roles.passages(spark, sf_dir), fresh_path(spark, "lexical"))


@register
def bm25_term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.term_stats(_index(spark, sf_dir)).withColumn("idf", F.round("idf", 9))


@register
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = lexical.search(_index(spark, sf_dir), roles.queries(spark, sf_dir), TOP_K)
    return _long(hits, "rank")


@register
def bm25_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, by thresholds and bounds whatever the number of postings, from an index of several deliveries."""
    docs, path = roles.passages(spark, sf_dir), fresh_path(spark, "lexical")
    parts = [F.col("lang") == "en", F.col("lang").isin("de", "fr"), ~F.coalesce(F.col("lang").isin("en", "de", "fr"), F.lit(False))]
    first, *later = [docs.filter(F.coalesce(p, F.lit(False))) for p in parts]
    # English texts come in a wrong version first; the last delivery brings the right one and deletes what is no document.
    stray = docs.select((-F.col("doc_id") - 1).alias("doc_id"), "content")
    lexical.build_index(first.withColumn("content", F.reverse("content")).select("doc_id", "content").unionByName(stray), path)
    for delivery in later:
        lexical.update_index(spark, path, delivery)
    index = lexical.update_index(spark, path, first, stray.select("doc_id"))
    return _long(lexical.search(index, roles.queries(spark, sf_dir), TOP_K, open_postings=0), "rank")


@register
def bm25_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Term statistics after deliveries of every source, one by one merged, and a second one of all texts in another version."""
    docs, path = roles.passages(spark, sf_dir), fresh_path(spark, "lexical")
    lexical.build_index(docs.withColumn("content", F.concat(F.lit("old "), "content")), path)
    for late in (False, True):
        rows = docs.filter(F.coalesce(F.length("content") > 2000, F.lit(False)) == late)
        index = lexical.update_index(spark, path, rows)
    return lexical.term_stats(index).withColumn("idf", F.round("idf", 9))


@register
def bm25_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product names as queries against the documents: most find fewer than ten."""
    docs, queries = roles.passages(spark, sf_dir), roles.product_queries(spark, sf_dir)
    hits = lexical.search(_index(spark, sf_dir), queries, TOP_K)
    return _long(lexical.pad_hits(hits, queries, docs, TOP_K), "rank")


@register
def dense_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as a query against all vectors."""
    vectors = roles.vectors(spark, sf_dir)
    hits = dense.search(vectors, vectors.withColumnRenamed("doc_id", "query_id"), TOP_K)
    return _long(hits, "rank")


def _listed(spark: SparkSession, sf_dir: str, probes: int | None) -> DataFrame:
    """Every fiftieth vector as a query against all vectors, by inverted lists."""
    vectors = roles.vectors(spark, sf_dir)
    index = dense_lists.build_lists(vectors, fresh_path(spark, "lists"))
    queries = vectors.filter(F.col("doc_id") % 50 == 0).withColumnRenamed("doc_id", "query_id")
    return _long(dense_lists.search(index, queries, TOP_K, probes=probes), "rank")


@register
def dense_lists_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lists probed: the exact answer."""
    return _listed(spark, sf_dir, dense_lists.MAX_LISTS)


@register
def dense_lists_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether nine of ten of the exact hits are found in the lists that are probed by default."""
    exact = _listed(spark, sf_dir, dense_lists.MAX_LISTS)
    measured = dense_lists.recall(_listed(spark, sf_dir, None), exact)
    return measured.select("n_exact", (F.col("recall") >= 0.9).cast("long").alias("enough"))


@register
def embed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    embedded = embed_passages(roles.passages(spark, sf_dir), hashing_embedder(DIMS))
    return embedded.select("doc_id", F.posexplode("embedding").alias("dim", "value")).select(
        "doc_id", F.col("dim").cast("long").alias("dim"), F.round(F.col("value").cast("double"), 7).alias("value")
    )


@register
def embed_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings after the texts changed: the cache of the first build serves the texts that did not."""
    docs, cache = roles.passages(spark, sf_dir), EmbeddingCache(fresh_path(spark, "cache"), "hashing-64")
    cache.embed(docs.withColumn("content", F.when(F.col("lang") == "en", F.concat(F.lit("old "), "content")).otherwise(F.col("content"))), hashing_embedder(DIMS))
    embedded, _ = cache.embed(docs, hashing_embedder(DIMS))
    return embedded.select("doc_id", F.posexplode("embedding").alias("dim", "value")).select(
        "doc_id", F.col("dim").cast("long").alias("dim"), F.round(F.col("value").cast("double"), 7).alias("value")
    )


@register
def embed_cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that the model saw: in a first build, in a second of the same table, and after a change."""
    docs, cache = roles.passages(spark, sf_dir), EmbeddingCache(fresh_path(spark, "cache"), "hashing-64")
    changed = docs.withColumn("content", F.when(F.col("lang") == "en", F.concat(F.lit("new "), "content")).otherwise(F.col("content")))
    seen = [(name, cache.embed(rows, hashing_embedder(DIMS))[1]) for name, rows in (("first", docs), ("again", docs), ("changed", changed))]
    return spark.createDataFrame(seen, "build string, n_embedded long")


@register
def index_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both indexes written, opened again, and counted."""
    path = fresh_path(spark, "indexes")
    docs = roles.passages(spark, sf_dir)
    lexical.build_index(docs, f"{path}/lexical")
    index = lexical.load_index(spark, f"{path}/lexical")
    tables.write_vectors(roles.vectors(spark, sf_dir), f"{path}/vectors")
    return tables.row_counts(
        postings=index.postings, terms=index.terms, vectors=tables.read_vectors(spark, f"{path}/vectors")
    ).drop("n_columns")


# -- search ------------------------------------------------------------------


def _corpus(spark: SparkSession, sf_dir: str, words: bool = True, vectors: bool = True) -> Corpus:
    docs = roles.passages(spark, sf_dir)
    vector_table = None
    if vectors:
        path = fresh_path(spark, "vectors")
        tables.write_vectors(
            embed_passages(docs, hashing_embedder(DIMS)).select("doc_id", "embedding"), path
        )
        vector_table = tables.read_vectors(spark, path)
    return Corpus(
        passages=docs,
        lexical=_index(spark, sf_dir) if words else None,
        vectors=vector_table,
        embed=hashing_embedder(DIMS),
    )


def _hits(hits: DataFrame, *more: str) -> DataFrame:
    return _long(hits, "rank").select("query_id", "doc_id", "rank", "score", *more)


@register
def rrf_fuse_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector list and the BM25 list of every query, fused."""
    corpus = _corpus(spark, sf_dir)
    queries = roles.queries(spark, sf_dir)
    by_words = lexical.search(corpus.lexical, queries, TOP_K).drop("bm25_score")
    by_vector = dense.search(
        corpus.vectors, embed_passages(queries.withColumnRenamed("query", "content"), corpus.embed), TOP_K
    )
    return _hits(rrf_fuse(as_list(by_vector, 0).unionByName(as_list(by_words, 1))))


@register
def search_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = _corpus(spark, sf_dir, words=False)
    return _hits(search(corpus, roles.queries(spark, sf_dir), "semantic", TOP_K).hits)


@register
def search_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = _corpus(spark, sf_dir, vectors=False)
    return _hits(search(corpus, roles.queries(spark, sf_dir), "bm25", TOP_K).hits)


@register
def search_bm25_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first word of each query: ten documents for each, whether they hold it or not."""
    corpus = replace(_corpus(spark, sf_dir, vectors=False), pad_words=True)
    words = roles.queries(spark, sf_dir).withColumn("query", F.regexp_extract("query", "[^ ]+", 0))
    return _hits(search(corpus, words, "bm25", TOP_K, pool=TOP_K).hits)


@register
def search_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = _corpus(spark, sf_dir)
    hits = search(corpus, roles.queries(spark, sf_dir), "hybrid", TOP_K).hits
    return _hits(hits, "content", "lang", "source")


def _variants(spark: SparkSession, sf_dir: str, num_variants: int = 3) -> DataFrame:
    return expansion.expand(*roles.conversation_queries(spark, sf_dir), num_variants)[0]


@register
def search_semantic_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = _corpus(spark, sf_dir, words=False)
    return _hits(search(corpus, _variants(spark, sf_dir), "semantic", TOP_K).hits)


@register
def search_bm25_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = _corpus(spark, sf_dir, vectors=False)
    return _hits(search(corpus, _variants(spark, sf_dir), "bm25", TOP_K).hits)


@register
def search_hybrid_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, responses = roles.conversation_queries(spark, sf_dir)
    return _hits(
        retrieve(_corpus(spark, sf_dir), queries, responses=responses, top_k=TOP_K).hits
    )


@register
def search_by_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = _corpus(spark, sf_dir)
    hits = search_requests(corpus, roles.mode_requests(spark, sf_dir), TOP_K).hits
    return _hits(hits, "mode")


@register
def search_without_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No lexical index: hybrid falls back to vectors, BM25 finds nothing."""
    corpus = _corpus(spark, sf_dir, words=False)
    requests = roles.mode_requests(spark, sf_dir)
    found = search_requests(corpus, requests, TOP_K)
    counts = found.hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_hits"))
    return (
        requests.select("query_id")
        .join(counts, "query_id", "left")
        .join(found.warnings, "query_id", "left")
        .select("query_id", F.coalesce("n_hits", F.lit(0)).alias("n_hits"), "warning")
    )


@register
def retrieve_reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expansion, hybrid search 15 deep, re-scoring against the original query, best 3."""
    queries, responses = roles.conversation_queries(spark, sf_dir)
    found = retrieve(
        _corpus(spark, sf_dir), queries, responses=responses, top_k=3, scorer=token_overlap_scorer()
    )
    return _hits(found.hits, "retrieval_score")


# -- queries -----------------------------------------------------------------


@register
def clean_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the query texts as queries: some are blank."""
    padded = roles.queries(spark, sf_dir).select(
        "query_id", F.posexplode(F.split("query", r"[.]")).alias("part_no", "query")
    )
    return _long(expansion.clean_queries(padded), "part_no")


@register
def expand_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expansion.expansion_requests(roles.queries(spark, sf_dir))


@register
def parse_variants_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, responses = roles.conversation_queries(spark, sf_dir)
    parsed = expansion.parse_json_array(F.col("raw_response"))
    return responses.select("query_id", F.posexplode_outer(parsed).alias("pos", "variant")).select(
        "query_id", F.col("pos").cast("long").alias("pos"), "variant"
    )


@register
def expand_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(_variants(spark, sf_dir, 2), "variant_no")


@register
def expand_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expansion.expand(*roles.conversation_queries(spark, sf_dir))[1]


@register
def expand_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings by cause: by length of the query its response is none, has no array, or a malformed one."""
    queries = roles.queries(spark, sf_dir)
    n = F.length("query")
    raw = F.when(n >= 300, F.concat(F.lit("["), "query", F.lit("]"))).when(n >= 220, F.col("query")).when(n >= 150, F.lit("[]"))
    return expansion.expand(queries, queries.select("query_id", raw.alias("raw_response")))[1]


# -- after retrieval ---------------------------------------------------------


@register
def enrich_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label rows as hits: their passages' text, where there is one."""
    hits = roles.table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("query_id"), "doc_id", F.lit("none").alias("content")
    )
    # A hit whose id is no passage keeps its content.
    unknown = hits.withColumn("doc_id", -F.col("doc_id") - 1)
    return passages.enrich(hits.unionByName(unknown), roles.passages(spark, sf_dir), ["content"])


@register
def rerank_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = roles.queries(spark, sf_dir)
    hits = search(_corpus(spark, sf_dir, vectors=False), queries, "bm25", 15).hits
    return _hits(rerank(hits, queries, 5, token_overlap_scorer()), "retrieval_score")


def _product_hits(spark: SparkSession, sf_dir: str):
    """Product queries, and their three best products by BM25."""
    path = fresh_path(spark, "products")
    tables.write_products(_products(spark, sf_dir), f"{path}/table")
    products = tables.read_products(spark, f"{path}/table")
    words = passages.to_passages(products.select("text_bm25", "doc_id"), "text_bm25")
    corpus = Corpus(
        passages=passages.to_passages(
            products.select("text_faiss", *passages.META_COLUMNS), "text_faiss"
        ),
        lexical=lexical.build_index(words, f"{path}/lexical"),
    )
    queries = roles.product_queries(spark, sf_dir)
    return queries, search(corpus, queries, "bm25", 3).hits


@register
def build_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present.build_context(*_product_hits(spark, sf_dir))


@register
def result_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(present.result_cards(_product_hits(spark, sf_dir)[1]), "rank")


@register
def mode_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus, queries = _corpus(spark, sf_dir), roles.queries(spark, sf_dir)
    return mode_overlap(
        search(corpus, queries, "bm25", TOP_K).hits,
        search(corpus, queries, "semantic", TOP_K).hits,
        TOP_K,
    )


def _judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A difficulty and a winner for each query, by its length."""
    n = F.length("query")
    return roles.queries(spark, sf_dir).select(
        "query_id",
        F.when(n < 220, "easy").when(n < 300, "medium").otherwise("hard").alias("difficulty"),
        F.when(n % 2 == 0, "bm25").otherwise("semantic").alias("winner"),
    )


@register
def modes_by_difficulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much the two modes agree, per difficulty of the query and judged winner."""
    compared = compare_modes(mode_overlaps(spark, sf_dir), _judgements(spark, sf_dir))
    return compared.groupBy("difficulty", "winner").agg(
        F.count(F.lit(1)).alias("n_queries"), F.sum("n_both").alias("n_both"), F.sum("n_left").alias("n_left")
    )


@register
def modes_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged_wins(_judgements(spark, sf_dir))


# -- feedback ----------------------------------------------------------------


@register
def feedback_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends to a CSV log: up votes, then down votes."""
    path = fresh_path(spark, "feedback")
    rows = feedback.feedback_rows(roles.votes(spark, sf_dir), F.col("at"))
    for vote in feedback.VOTES:
        feedback.append_feedback(rows.filter(F.col("feedback") == vote), path)
    return feedback.read_feedback(spark, path)


@register
def feedback_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as a stream; all events are delivered twice, and the last run finds nothing new."""
    path = fresh_path(spark, "feedback")
    events = roles.table(spark, sf_dir, "events")
    for delivered in (True, True, False):
        if delivered:
            events.write.mode("append").parquet(f"{path}/events")
        source = roles.as_votes(spark.readStream.schema(events.schema).parquet(f"{path}/events"))
        rows = source.withColumnRenamed("title", "event_id").withColumn("title", F.col("event_id"))
        ingest_feedback(rows, f"{path}/log", f"{path}/checkpoint", event_id="event_id").awaitTermination()
    return spark.read.schema(FEEDBACK).parquet(f"{path}/log")
