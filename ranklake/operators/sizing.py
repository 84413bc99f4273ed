"""Measured sizes, and the split of hot keys.

A side is broadcast only after its size was measured; the callers have another
exact way for larger sides.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ranklake.sources.storage import stored

# Largest side that is broadcast, in bytes of payload.
BROADCAST_BYTES = 64 * 1024 * 1024

# A key with more rows than this is salted.
HOT_ROWS = 2_000_000

# Hash values by which rows are counted before keys are.
HASHES = 4096


@dataclass(frozen=True)
class Size:
    rows: int
    bytes: int

    def fits(self, limit: int = BROADCAST_BYTES) -> bool:
        return self.bytes <= limit

    def parts(self, limit: int = BROADCAST_BYTES) -> int:
        """Number of parts of at most ``limit`` bytes each, on average."""
        return max(1, -(-self.bytes // limit))


def measure(df: DataFrame, payload: Column, row_overhead: int = 32) -> Size:
    """Row count and bytes of ``df``, where ``payload`` gives the bytes of a row."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(payload.cast("long")).alias("b")).first()
    return Size(row["n"], (row["b"] or 0) + row_overhead * row["n"])


def stored_and_measured(df: DataFrame, name: str, payload: Column, row_overhead: int = 32) -> tuple[DataFrame, Size]:
    """``df`` written to shared storage and read back, with its size as the write itself counted it."""
    seen = Observation(name)
    table = stored(df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(payload.cast("long")).alias("b")), name)
    n, b = (seen.get.get(x) or 0 for x in ("n", "b"))
    return table, Size(n, b + row_overhead * n)


def hot_keys(df: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than ``hot_rows`` rows, and into how many ``salts`` to split each.

    Rows are counted by a hash of the key first.  Only keys of a hash with more than ``hot_rows`` rows are counted
    themselves; where there is none, adaptive execution drops that count.  Both read the key column only and are combined
    before their shuffle.  At most ``rows / hot_rows`` keys can qualify, which bounds the broadcast.
    """
    hashed = F.pmod(F.xxhash64(key), F.lit(HASHES))
    large = df.groupBy(hashed.alias("_hash")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows)
    return (
        df.select(key, hashed.alias("_hash"))
        .join(F.broadcast(large.select("_hash")), "_hash", "left_semi")
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > hot_rows)
        .select(key, F.ceil(F.col("n") / F.lit(hot_rows)).cast("int").alias("salts"))
    )


def split_hot(
    df: DataFrame, key: str, hot: DataFrame, spread: list[str]
) -> tuple[DataFrame, DataFrame]:
    """Rows of ordinary keys, and rows of the :func:`hot_keys` with a ``salt`` column.

    ``spread`` names the columns whose hash picks the salt.  Where no key is hot,
    adaptive execution sees the empty broadcast and drops the hot branch.
    """
    hot = F.broadcast(hot)
    salt = F.pmod(F.xxhash64(*spread), F.col("salts")).cast("int")
    salted = df.join(hot, key).withColumn("salt", salt).drop("salts")
    return df.join(hot, key, "left_anti"), salted


def replicate_hot(df: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """Rows of hot keys, once per salt: the other side of a join with salted rows."""
    every = F.explode(F.sequence(F.lit(0), F.col("salts") - 1))
    return df.join(F.broadcast(hot), key).withColumn("salt", every).drop("salts")
