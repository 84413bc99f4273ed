"""ranklake: product search as Spark data processing.

Raw reviews and product metadata become one row per product, lexical and
vector indexes are written as tables, and whole tables of queries are answered
in batch.  Every operator takes and returns DataFrames.
"""
