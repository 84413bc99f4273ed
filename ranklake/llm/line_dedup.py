"""Line dedup: three-line windows that occur before are removed, wherever they occur again.

The non-blank lines of a text (trimmed for comparison) form overlapping windows of ``size``
consecutive lines.  Equal windows are found over all documents by a 128-bit hash.  The first
occurrence, by document key and position, stays; the lines that later occurrences cover are merged
per document and go, together with the blank lines right after them.

Shuffles: window hashes (fixed width), then whole texts once, to meet their covered positions.  The
count of a window is combined before its shuffle; joins on a hot window are split by adaptive
execution.

Defined cases: a null text counts as empty and comes back as null; a text with fewer than ``size``
non-blank lines has one window of all its lines, which equals only windows of the same lines (with
``short=False`` it has none and stays as it is); repeats of fewer than ``size`` lines between differing neighbours
stay; rows with the same key (id and text) are one
document, and each gets the same result; a null id is a key like others and comes last.  Other
columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ranklake.llm.names import unused
from ranklake.sources.storage import discard, stored

SIZE = 3
BLANK = " \t\r\f\x0b"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _filled(lines: Column) -> Column:
    """(position, trimmed line) of the non-blank lines."""
    trimmed = F.transform(lines, lambda x, i: F.struct(i.alias("pos"), F.btrim(x, F.lit(BLANK)).alias("t")))
    return F.filter(trimmed, lambda x: x["t"] != "")


def windows(docs: DataFrame, size: int = SIZE, id: str = "doc_id", text: str = "text", short: bool = True) -> DataFrame:
    """One row per window: id, dk (hash of the text), at (index of its first non-blank line), h1, h2."""
    filled = docs.select(
        F.col(id).alias("id"), F.xxhash64(text).alias("dk"), _filled(_lines(F.col(text))).alias("f")
    ).filter(F.size("f") >= (1 if short else size))

    def hashes(i: Column) -> Column:
        # Lines beyond the end are null, which hashes pass over.
        ts = [F.get(F.col("f"), i + k)["t"] for k in range(size)]
        return F.struct(i.alias("at"), F.xxhash64(*ts).alias("h1"), F.xxhash64(F.lit(7), *ts[::-1]).alias("h2"))

    spans = F.transform(F.sequence(F.lit(0), F.greatest(F.size("f") - size, F.lit(0))), hashes)
    return filled.select("id", "dk", F.explode(spans).alias("w")).select("id", "dk", "w.at", "w.h1", "w.h2")


def later_windows(docs: DataFrame, size: int = SIZE, id: str = "doc_id", text: str = "text", short: bool = True) -> DataFrame:
    """The windows that occurred before in another place: id, dk, at."""
    every = stored(windows(docs, size, id, text, short), "line_windows")
    # Null ids come last; the least (id, dk, at) of a window is where it stays.
    place = F.struct(F.col("id").isNull().alias("n"), "id", "dk", "at")
    repeated = (
        every.groupBy("h1", "h2")
        .agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("c"))
        .filter(F.col("c") > 1)
        .select("h1", "h2", "first")
    )
    later = every.join(repeated, ["h1", "h2"]).filter(~place.eqNullSafe(F.col("first"))).select("id", "dk", "at")
    # What stays in shared storage is the repeated windows only.
    later = stored(later, "later_windows")
    discard(every)
    return later


def dedup_lines(docs: DataFrame, size: int = SIZE, id: str = "doc_id", text: str = "text", short: bool = True) -> DataFrame:
    """``docs`` with the repeated lines removed from ``text``, plus ``n_lines`` and ``n_removed``."""
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    # Names of its own, beside those of any columns that pass through.
    key, gone_id, gone_key, at, split, found, gone, keep = (
        unused(c, docs.columns) for c in ("_key", "_id", "_dk", "_at", "_lines", "_filled", "_gone", "_keep")
    )
    later = (
        later_windows(docs, size, id, text, short)
        .groupBy("id", "dk")
        .agg(F.collect_set("at").alias(at))
        .select(F.col("id").alias(gone_id), F.col("dk").alias(gone_key), at)
    )
    marked = docs.select(*own, F.xxhash64(text).alias(key)).join(
        later, F.col(id).eqNullSafe(F.col(gone_id)) & (F.col(key) == F.col(gone_key)), "left"
    )
    covered = F.array_distinct(
        F.flatten(F.transform(at, lambda a: F.sequence(a, F.least(a + size, F.size(found)) - 1)))
    )
    # A removed line takes the blank lines up to the next non-blank line with it.
    filled, n = F.col(found), F.size(split)
    spans = F.transform(
        covered,
        lambda k: F.sequence(
            F.get(filled, k)["pos"], F.coalesce(F.get(filled, k + 1)["pos"], n) - 1
        ),
    )
    lines = (
        marked.withColumn(split, _lines(F.col(text)))
        .withColumn(found, F.when(F.col(at).isNotNull(), _filled(F.col(split))))
        .withColumn(gone, F.flatten(spans))
        .withColumn(keep, F.array_except(F.sequence(F.lit(0), n - 1), F.col(gone)))
    )
    kept = F.array_join(F.transform(keep, lambda i: F.get(F.col(split), i)), "\n")
    return lines.select(
        *[c for c in own if c != text],
        F.when(F.col(at).isNull(), F.col(text)).otherwise(kept).alias(text),
        F.size(split).cast("long").alias("n_lines"),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed"),
    ).select(*own, "n_lines", "n_removed")


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` without repeated lines, ``n_chars`` made to fit; a document that loses all its text goes."""
    plain = docs.select(*[F.col(f"`{c}`").alias(unused(c, ["n_lines", "n_removed"])) for c in docs.columns])
    found = dedup_lines(plain).filter((F.col("n_removed") == 0) | (F.btrim("text", F.lit(" \t\n\r\f\x0b")) != ""))
    changed = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", changed).select(*[F.col(f"`{a}`").alias(b) for a, b in zip(plain.columns, docs.columns)])
