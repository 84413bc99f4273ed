"""DataFrame operators: reviews, products, indexes, search, fusion, re-ranking, profiling."""
