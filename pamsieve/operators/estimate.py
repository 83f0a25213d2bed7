"""Counts of hits by distance without alignment, from tables of how often each site occurs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.neighbours import with_neighbours
from ..motif import Motif
from .search import check_guides, oriented
from .sites import distinct_sites


def site_counts(sites: DataFrame, max_count: int | None = None) -> DataFrame:
    """(site, n) of concrete sites; n is capped at ``max_count`` if given."""
    counts = distinct_sites(sites, certain_only=True)
    return counts if max_count is None else counts.withColumn("n", F.least("n", F.lit(max_count)))


def count_bins(counts: DataFrame, max_count: int) -> DataFrame:
    """(bin, sites): how many sites occur once, twice, ... ``max_count`` times or more."""
    return counts.groupBy(F.least("n", F.lit(max_count)).alias("bin")).agg(F.count("*").alias("sites"))


def estimate(counts: DataFrame, guides: DataFrame, motif: Motif, distance: int, max_count: int | None = None) -> DataFrame:
    """(guide, D0, ..., D<distance>): each guide's neighbourhood looked up among site counts; absent sites count 0.

    Every key counts at its least distance.  Guides must be concrete.  Exact for concrete sites if nothing is capped.
    """
    check_guides(guides, motif, distance, concrete=True)
    keys = with_neighbours(oriented(guides, motif), distance, motif.length_no_pam + distance)
    table = counts if max_count is None else counts.withColumn("n", F.least("n", F.lit(max_count)))
    # sites are longer by what the motif's distance exceeds this one
    table = table.groupBy(F.substring("site", 1, motif.length_no_pam + distance).alias("key")).agg(F.sum("n").alias("n"))
    found = keys.join(table, "key", "left")
    columns = [F.coalesce(F.sum(F.when(F.col("least") == d, F.col("n"))), F.lit(0)).cast("long").alias(f"D{d}") for d in range(distance + 1)]
    return found.groupBy("guide").agg(*columns)


def sketch_counts(sites: DataFrame, eps: float = 1e-4, confidence: float = 0.99, seed: int = 42) -> DataFrame:
    """(sketch, total): a count-min sketch of concrete sites, a bounded binary, made with partial aggregates."""
    return sites.where("not is_ambig").agg(F.count_min_sketch("site", F.lit(eps), F.lit(confidence), F.lit(seed)).alias("sketch"), F.count("*").alias("total"))


def right_or_left(counts: DataFrame, guides: DataFrame, motif: Motif, max_count: int = 10, distance: int = 1, right: bool = True) -> DataFrame:
    """Estimates from capped counts: with ``right`` a cap counts as itself, else as the mean of what it stands for."""
    if right:
        return estimate(counts, guides, motif, distance, max_count)
    over = counts.where(F.col("n") >= max_count).agg(F.avg("n")).first()[0] or max_count
    capped = counts.withColumn("n", F.when(F.col("n") >= max_count, F.lit(round(over))).otherwise(F.col("n")))
    return estimate(capped, guides, motif, distance)
