"""Order-dependent helpers: runs, ranges, duplicates, balance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranges(df: DataFrame, value: str, order: str, by: list[str] | None = None) -> DataFrame:
    """(by..., value, start, stop): 1-based places of each run of equal values in order."""
    by = by or []
    own = Window.partitionBy(*by).orderBy(order)
    rows = df.withColumn("place", F.row_number().over(own)).withColumn("before", F.lag(value).over(own))
    rows = rows.withColumn("run", F.sum(F.when(F.col("before").eqNullSafe(F.col(value)) & (F.col("place") > 1), 0).otherwise(1)).over(own))
    return rows.groupBy(*by, "run", value).agg(F.min("place").alias("start"), F.max("place").alias("stop")).drop("run")


def ranges_of_lengths(df: DataFrame, length: str, order: str, by: list[str] | None = None) -> DataFrame:
    """``df`` with start and stop: lengths laid end to end from 1."""
    own = Window.partitionBy(*(by or [])).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(length).over(own)
    return df.withColumn("stop", stop).withColumn("start", F.col("stop") - F.col(length) + 1)


def places_of_ranges(df: DataFrame, start: str = "start", stop: str = "stop") -> DataFrame:
    """Ranges spelled out again: a row (..., place) for each place."""
    return df.withColumn("place", F.explode(F.sequence(F.col(start), F.col(stop)))).drop(start, stop)


def duplicated(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``df`` with is_duplicate: whether a row of the same keys comes before."""
    return df.withColumn("is_duplicate", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) > 1)


def balance(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """(by..., balance): the value for which the rows up to it and from it on differ least in number; the smaller of two."""
    by = by or []
    counts = df.groupBy(*by, value).agg(F.count("*").alias("n"))
    own = Window.partitionBy(*by).orderBy(value)
    below = F.sum("n").over(own.rowsBetween(Window.unboundedPreceding, 0))
    above = F.sum("n").over(own.rowsBetween(0, Window.unboundedFollowing))
    scored = counts.withColumn("uneven", F.abs(below - above))
    best = F.min(F.struct("uneven", F.col(value).alias("v")))
    grouped = scored.groupBy(*by).agg(best.alias("best")) if by else scored.agg(best.alias("best"))
    return grouped.select(*by, F.col("best.v").alias("balance"))


def group_nearby(df: DataFrame, by: str, start: str, stop: str, reach: int) -> DataFrame:
    """``df`` with group_no: neighbours in order of start whose ranges, each widened by ``reach``, touch are chained."""
    own = Window.partitionBy(by).orderBy(start, stop)
    before = F.lag(stop).over(own)
    new = F.when(before.isNull() | (F.col(start) - reach > before + reach), 1).otherwise(0)
    return df.withColumn("_new", new).withColumn("group_no", F.sum("_new").over(own.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def overlapping(a: DataFrame, b: DataFrame, by: str, bin_size: int = 1024) -> DataFrame:
    """(by, a_start, a_stop, b_start, b_stop): pairs of overlapping closed ranges (by, start, stop): an equi-join on bins."""
    def binned(df: DataFrame, tag: str) -> DataFrame:
        bins = F.sequence(F.floor(F.col("start") / bin_size), F.floor(F.col("stop") / bin_size))
        return df.select(by, F.col("start").alias(f"{tag}_start"), F.col("stop").alias(f"{tag}_stop"), F.explode(bins).alias("bin"))

    met = binned(a, "a").join(binned(b, "b"), [by, "bin"])
    # each pair is counted in the first bin both are in
    first = F.floor(F.greatest("a_start", "b_start") / bin_size) == F.col("bin")
    return met.where((F.col("a_start") <= F.col("b_stop")) & (F.col("b_start") <= F.col("a_stop")) & first).drop("bin")
