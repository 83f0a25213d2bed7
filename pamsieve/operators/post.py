"""What follows a search: overlaps, counts by distance."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_KEYS = ("guide", "chromosome", "strand")


def filter_overlapping(hits: DataFrame, window: int) -> DataFrame:
    """Of hits of one guide, chromosome and strand, by distance and start, those whose start isn't within ``window`` of a kept one.

    Hits are first parted where their starts lie more than ``window`` apart: parts can't influence each other, so
    a very long list of hits becomes many short ones, and the greedy pass holds one part at a time.
    """
    own = Window.partitionBy(*_KEYS).orderBy("start")
    gap = F.col("start") - F.lag("start").over(own)
    parted = hits.withColumn("_new", F.when(gap.isNull() | (gap > window), 1).otherwise(0)).withColumn("_part", F.sum("_new").over(own))
    rest = [c for c in hits.columns if c not in (*_KEYS, "distance", "start")]
    item = F.struct("distance", "start", *rest)
    kind = f"array<struct<{','.join(f'`{c}`:{t}' for c, t in [(c, dict(hits.dtypes)[c]) for c in ('distance', 'start', *rest)])}>>"
    kept = F.aggregate(
        F.array_sort(F.collect_list(item)),
        F.array().cast(kind),
        lambda acc, x: F.when(F.exists(acc, lambda y: F.abs(y["start"] - x["start"]) <= window), acc).otherwise(F.concat(acc, F.array(x))),
    )
    grouped = parted.groupBy(*_KEYS, "_part").agg(kept.alias("kept"))
    return grouped.select(*_KEYS, F.inline("kept")).select(*hits.columns)


def filter_overlapping_pandas(hits: DataFrame, window: int) -> DataFrame:
    """The same, one group at a time in pandas: a check on the expression above."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[int] = []
        rows = []
        for i, start in pdf.sort_values(["distance", "start"], kind="stable")["start"].items():
            if all(abs(start - s) > window for s in kept):
                kept.append(start)
                rows.append(i)
        return pdf.loc[rows]

    return hits.groupBy(*_KEYS).applyInPandas(run, hits.schema)


def counts_by_distance(distance: str, most: int) -> list:
    """Aggregates D0..D<most>: how often each distance occurs."""
    return [F.count_if(F.col(distance) == d).alias(f"D{d}") for d in range(most + 1)]


def summarize(hits: DataFrame, distance: int) -> DataFrame:
    """(guide, D0, ..., D<distance>) of guides with hits, sorted by the counts and then the guide; farther hits don't count."""
    columns = [f"D{d}" for d in range(distance + 1)]
    return hits.where(F.col("distance") <= distance).groupBy("guide").agg(*counts_by_distance("distance", distance)).orderBy(*columns, "guide")


def tidy(summary: DataFrame) -> DataFrame:
    """Guide first, then D0.. in order; sorted by the counts, then the guide."""
    columns = sorted((c for c in summary.columns if c != "guide"), key=lambda c: int(c[1:]))
    return summary.select("guide", *columns).orderBy(*columns, "guide")
