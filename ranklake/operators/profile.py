"""Profiling of a table: statistics, missing values, frequencies, samples."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ranklake.functions.text import known
from ranklake.sources.storage import fresh_path

# Exact quantiles: a bracket with at most so many distinct values is ranked; a sketch brackets a quantile within
# this share of the values on either side.
_RANKED_VALUES = 100_000
_MARGIN = 0.02


def _unpivot(df: DataFrame, values: dict[str, Column], value_name: str) -> DataFrame:
    """A one-row frame of ``values`` as rows ``column_name, value_name``."""
    pairs = F.array(
        *[F.struct(F.lit(n).alias("column_name"), v.alias(value_name)) for n, v in values.items()]
    )
    return df.agg(pairs.alias("p")).select(F.inline("p"))


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum of numeric columns."""
    basics = {}
    for name in columns:
        x = known(F.col(name)).cast("double")
        basics[name] = F.struct(
            F.count(x).alias("n"),
            F.avg(x).alias("mean"),
            F.stddev_samp(x).alias("stddev"),
            F.min(x).alias("min"),
            F.max(x).alias("max"),
        )
    quartiles = exact_quantiles(df, columns, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return _unpivot(df, basics, "s").select("column_name", "s.*").join(
        quartiles, "column_name", "left"
    )


@dataclass
class _Bracket:
    """Where a quantile of a column lies: between two values, with so many values below the first and in between."""

    column: str
    low: int
    high: int
    share: float
    begin: float
    end: float
    sketch: bytes
    distinct: int
    below: int
    inside: int
    margin: float = _MARGIN

    def cuts(self) -> list[float]:
        """Shares of the values in between that should hold the quantile between them."""
        first, last = ((rank - self.below) / max(1, self.inside - 1) for rank in (self.low, self.high))
        return [max(0.0, first - self.margin), min(1.0, last + self.margin)]


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: dict[str, float], ranked_values: int = _RANKED_VALUES
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per column.

    A quantile sketch of a column gives two values that should lie below and above a quantile.  Counting what is
    below and between them tells whether they do, and the next sketch is of the values in between only,
    until few distinct ones are left; these are counted and ranked.  Each pass reads the
    columns once for all quantiles and shrinks the brackets to a few hundredths.  The driver holds a sketch and
    some numbers for each quantile.
    """
    values = df.select(*[known(F.col(c)).cast("double").alias(f"v{i}") for i, c in enumerate(columns)])
    numbers = {c: F.when(~F.isnan(f"v{i}"), F.col(f"v{i}")) for i, c in enumerate(columns)}
    brackets = _first_brackets(values, numbers, probabilities)
    while open_ := [b for b in brackets if b.distinct > ranked_values and b.begin < b.end]:
        _narrow(values, numbers, open_)
    return _ranked(values, numbers, columns, probabilities, brackets)


def _figures(x: Column) -> Column:
    return F.struct(
        F.count(x).alias("n"), F.approx_count_distinct(x).alias("distinct"), F.min(x).alias("begin"), F.max(x).alias("end"),
        F.kll_sketch_agg_double(x).alias("sketch"),
    )


def _first_brackets(values: DataFrame, numbers: dict[str, Column], probabilities: dict[str, float]) -> list[_Bracket]:
    row = values.agg(*[_figures(x).alias(f"f{i}") for i, x in enumerate(numbers.values())]).first()
    brackets = []
    for column, found in zip(numbers, row):
        for p in probabilities.values() if found["n"] else ():
            place = (found["n"] - 1) * p
            low, high = math.floor(place), math.ceil(place)
            brackets.append(_Bracket(column, low, high, place - low, found["begin"], found["end"], bytes(found["sketch"]), found["distinct"], 0, found["n"]))
    return brackets


def _narrow(values: DataFrame, numbers: dict[str, Column], brackets: list[_Bracket]) -> None:
    """One pass: each bracket takes the values its sketch proposes, if they hold the quantile, else proposes wider ones."""
    spark = values.sparkSession
    held = spark.createDataFrame([tuple(bytearray(b.sketch) for b in brackets)], ", ".join(f"s{i} binary" for i in range(len(brackets))))
    proposed = held.select(*[F.kll_sketch_get_quantile_double(f"s{i}", F.array(*map(F.lit, b.cuts()))) for i, b in enumerate(brackets)]).first()
    aggregates = []
    for i, (b, (begin, end)) in enumerate(zip(brackets, proposed)):
        # The ends of a sketch need not be those of the values.
        begin, end = (b.begin if b.cuts()[0] == 0.0 else begin), (b.end if b.cuts()[1] == 1.0 else end)
        x = numbers[b.column]
        aggregates += [F.count_if(x < begin).alias(f"b{i}"), _figures(F.when(x.between(begin, end), x)).alias(f"f{i}")]
    row = values.agg(*aggregates).first()
    for i, b in enumerate(brackets):
        below, found = row[f"b{i}"], row[f"f{i}"]
        if below <= b.low and b.high < below + found["n"] and (found["n"] < b.inside or found["distinct"] < b.distinct):
            b.begin, b.end, b.sketch, b.distinct = found["begin"], found["end"], bytes(found["sketch"]), found["distinct"]
            b.below, b.inside, b.margin = below, found["n"], _MARGIN
        elif b.margin < 1:
            b.margin *= 2
        else:
            b.distinct = 0  # nothing left to narrow: rank what there is


def _ranked(values, numbers, columns, probabilities, brackets: list[_Bracket]) -> DataFrame:
    """The quantiles, from the values in their brackets, counted before they are ranked."""
    spark = values.sparkSession
    rows = [(i, b.column, b.low - b.below, b.high - b.below, b.share) for i, b in enumerate(brackets)]
    wanted = spark.createDataFrame(rows, "bracket int, column_name string, low long, high long, share double")
    inside = [F.struct(F.lit(i).alias("bracket"), numbers[b.column].alias("value")) for i, b in enumerate(brackets)]
    keep = [F.when(numbers[b.column].between(b.begin, b.end), s) for b, s in zip(brackets, inside)]
    listed = F.array(*keep) if keep else F.array().cast("array<struct<bracket:int,value:double>>")
    counted = values.select(F.inline(F.filter(listed, lambda s: s.isNotNull()))).groupBy("bracket", "value").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("bracket").orderBy("value"))
    ranked = counted.withColumn("upto", upto).join(F.broadcast(wanted), "bracket")
    low, high = (F.min(F.when(F.col("upto") > F.col(rank), F.col("value"))) for rank in ("low", "high"))
    found = ranked.groupBy("bracket").agg((low + (high - low) * F.first("share")).alias("x"))
    # A row for every column, also for one without values.
    every = [(c, n, i * len(probabilities) + k) for i, c in enumerate(dict.fromkeys(b.column for b in brackets)) for k, n in enumerate(probabilities)]
    named = spark.createDataFrame(every, "column_name string, name string, bracket int").join(found, "bracket")
    out = spark.createDataFrame([(c,) for c in columns], "column_name string").join(named, "column_name", "left")
    return out.groupBy("column_name").agg(*[F.max(F.when(F.col("name") == n, F.col("x"))).alias(n) for n in probabilities])


def column_means(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean per column; booleans count as 0 and 1."""
    return _unpivot(df, {c: F.avg(known(F.col(c)).cast("double")) for c in columns}, "mean")


def null_shares(df: DataFrame) -> DataFrame:
    """Share of NULLs per column, in one pass; NaN counts as missing."""
    number = {c for c, kind in df.dtypes if kind in ("float", "double")}
    missing = {c: (known(F.col(c)) if c in number else F.col(c)).isNull() for c in df.columns}
    return _unpivot(df, {c: F.avg(m.cast("double")) for c, m in missing.items()}, "null_share")


def info(df: DataFrame) -> DataFrame:
    """Type and number of non-NULL values per column."""
    return _unpivot(
        df,
        {
            f.name: F.struct(
                F.lit(f.dataType.simpleString()).alias("data_type"),
                F.count(F.col(f.name)).alias("non_null"),
            )
            for f in df.schema.fields
        },
        "s",
    ).select("column_name", "s.*")


def value_shares(df: DataFrame, column: str) -> DataFrame:
    """``value, percent`` of the non-NULL values, most frequent first."""
    present = df.filter(F.col(column).isNotNull())
    total = present.agg(F.count(F.lit(1)).alias("total"))
    return (
        present.groupBy(F.col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("value", (F.lit(100.0) * F.col("n") / total.scalar()).alias("percent"))
        .orderBy(F.col("percent").desc(), "value")
    )


def top_values(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """``value, n`` of the most frequent values; equal counts in value order."""
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), "value")
        .limit(n)
    )


def distinct_count(df: DataFrame, column: str) -> DataFrame:
    """``column_name, n_distinct``, exact."""
    return df.agg(F.count_distinct(column).alias("n_distinct")).select(
        F.lit(column).alias("column_name"), "n_distinct"
    )


def time_profile(df: DataFrame, column: str, after: str) -> DataFrame:
    """Latest instant, its day, and the number of rows later than ``after``."""
    ts = F.col(column).cast("timestamp")
    return df.agg(
        F.max(ts).alias("latest"),
        F.max(F.to_date(ts)).alias("latest_day"),
        F.count_if(ts > F.lit(after).cast("timestamp")).alias("n_after"),
    )


def from_epoch_millis(column: Column) -> Column:
    return F.timestamp_millis(column)


@dataclass(frozen=True)
class PositionIndex:
    """A table in a given order, in folders of neighbouring rows, and how many rows each has.

    The order is made total by a hash of the row.
    """

    rows: DataFrame
    order: tuple[str, ...]
    #: Folder and rows before it, in order.
    offsets: list[tuple[int, int]]
    total: int

    def at(self, position: int, n: int = 1) -> DataFrame:
        """``n`` rows from a position; only the folders that hold them are read."""
        begin, end = max(0, position), min(self.total, max(0, position) + n)
        after = [offset for _, offset in self.offsets[1:]] + [self.total]
        parts = [(part, offset) for (part, offset), stop in zip(self.offsets, after) if offset < end and stop > begin]
        by = Window.partitionBy("_part").orderBy(*self.order, "_tie")
        place = F.create_map(*[F.lit(x) for pair in parts or [(0, 0)] for x in pair])[F.col("_part")] + F.row_number().over(by) - 1
        wanted = self.rows.filter(F.col("_part").isin([part for part, _ in parts])).withColumn("_at", place)
        return wanted.filter(F.col("_at").between(begin, end - 1)).drop("_part", "_tie", "_at")


def position_index(df: DataFrame, order: Sequence[str], path: str | None = None, ranges: int | None = None) -> PositionIndex:
    """Sort ``df`` by range once; then any position is found by the counts of the ranges (as many as Spark sees fit)."""
    spark = df.sparkSession
    path = path or fresh_path(spark, "positions")
    tied = df.withColumn("_tie", F.xxhash64(*df.columns))
    dealt = tied.repartitionByRange(ranges, *order, "_tie") if ranges else tied.repartitionByRange(*order, "_tie")
    ranged = dealt.withColumn("_part", F.spark_partition_id())
    ranged.sortWithinPartitions("_part", *order, "_tie").write.mode("overwrite").partitionBy("_part").parquet(path)
    rows = spark.read.schema(ranged.schema).parquet(path)
    # One row a range, with the number of its rows from the files' footers.
    counts = sorted(map(tuple, rows.groupBy("_part").agg(F.count(F.lit(1))).collect()))
    offsets, total = [], 0
    for part, n in counts:
        offsets.append((part, total))
        total += n
    return PositionIndex(rows, tuple(order), offsets, total)


def row_at(df: DataFrame, order: Sequence[str], position: int, n: int = 1) -> DataFrame:
    """``n`` rows from a position in a given order; no task holds more than a range of rows."""
    return position_index(df, order).at(position, n)


def sample_rows(df: DataFrame, key: str, seed: str, n: int = 1) -> DataFrame:
    """``n`` rows chosen by a seeded hash of the key: the same rows on every run."""
    draw = F.md5(F.concat(F.col(key).cast("string"), F.lit(seed)))
    return df.orderBy(draw, key).limit(n)
