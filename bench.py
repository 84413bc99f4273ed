"""Headline timings: prints one JSON line.

    BENCH_SF_DIR   folder of the test tables   (default /root/testdata/sf0.1)
    BENCH_CPUS     cores of the local session  (default 8)

Each entry is run once to warm up and then ``RUNS`` times; the median is
reported.  Index builds and searches on built indexes are timed apart.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F

from ranklake.functions.models import hashing_embedder, token_overlap_scorer
from ranklake.operators import dense, lexical, present, profile
from ranklake.operators.rerank import rerank
from ranklake.plans.product_table import product_table
from ranklake.plans.search import Corpus, embed_passages, retrieve, search
from ranklake.session import spark_session
from ranklake.sources import roles, tables
from ranklake.sources.storage import fresh_path, stored

RUNS = 3
DIMS = 64


def run(df) -> None:
    """Compute every row and column without keeping them."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = spark_session(
        f"local[{cpus}]",
        "bench",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")

    docs = roles.passages(spark, sf_dir)
    queries = roles.queries(spark, sf_dir)
    vectors = roles.vectors(spark, sf_dir)
    conversations, responses = roles.conversation_queries(spark, sf_dir)
    reviews, meta = roles.reviews(spark, sf_dir), roles.product_meta(spark, sf_dir)
    embed = hashing_embedder(DIMS)

    doc_vectors = stored(embed_passages(docs, embed).select("doc_id", "embedding"), "vectors")
    index = lexical.build_index(docs, fresh_path(spark, "lexical"))
    corpus = Corpus(docs, index, doc_vectors, embed)
    pool = stored(search(corpus, queries, "hybrid", 15).hits, "pool")

    entries = {
        "etl_product_table": lambda: run(product_table(reviews, meta)),
        "profile_describe": lambda: run(
            profile.describe(
                roles.table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"]
            )
        ),
        "bm25_index_build": lambda: lexical.build_index(docs, fresh_path(spark, "lexical")),
        "embed_documents": lambda: run(
            embed_passages(docs, embed, partitions=int(cpus)).select("doc_id", "embedding")
        ),
        "bm25_search": lambda: run(lexical.search(index, queries, 10)),
        "dense_search": lambda: run(
            dense.search(vectors, vectors.withColumnRenamed("doc_id", "query_id"), 10)
        ),
        "search_hybrid": lambda: run(search(corpus, queries, "hybrid", 10).hits),
        "search_hybrid_multi": lambda: run(
            retrieve(corpus, conversations, responses=responses).hits
        ),
        "rerank_pool_15": lambda: run(rerank(pool, queries, 3, token_overlap_scorer())),
        "build_context": lambda: run(
            present.build_context(
                queries,
                pool.filter(F.col("rank") <= 3).select(
                    "query_id", "rank", "content",
                    F.col("source").alias("product_title"),
                    F.lit(4.5).alias("average_rating"),
                    F.lit("").alias("review_texts"),
                ),
            )
        ),
    }
    only = sys.argv[1:] or list(entries)
    seconds = {}
    for name in only:
        entries[name]()
        times = []
        for _ in range(RUNS):
            start = time.perf_counter()
            entries[name]()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 3)
        print(name, seconds[name], file=sys.stderr)
    print(
        json.dumps(
            {
                "metric": "total of median seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir).removeprefix("sf"),
                "cpus": int(cpus),
                "runs": RUNS,
            }
        )
    )


if __name__ == "__main__":
    main()
