"""Guides as a stream: each micro-batch of guides is searched among stored sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.dna import free_end_distance
from ..motif import Motif
from ..operators.post import counts_by_distance
from ..operators.search import _chunk_keys, pieces


def guide_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(guide): lines of text files as they arrive in a folder."""
    return spark.readStream.text(folder).select(F.upper(F.trim("value")).alias("guide")).where("guide != ''")


def search_stream(guides: DataFrame, sites: DataFrame, motif: Motif, k: int) -> DataFrame:
    """(guide, distance, chromosome, start, strand): hits among concrete sites of each guide as it comes.

    A stateless stream-static join on whole pieces of the guide.  A pair that meets by several pieces is kept only for
    the first that fits, told from the pair alone, so nothing has to be remembered.
    """
    length, width = motif.length_no_pam, motif.length_no_pam + motif.distance
    cuts = pieces(length, k)
    q = F.reverse("guide") if motif.extends5 else F.col("guide")
    keyed = guides.where((F.char_length("guide") == length) & F.col("guide").rlike("^[ACGT]+$")).select("guide", q.alias("q"))
    left, right = _chunk_keys(keyed, sites.where("not is_ambig").select("site").distinct(), cuts, k, width)
    met = left.join(right, ["piece", "word"])

    def stands(i: int) -> Column:
        a, n = cuts[i]
        ends = [a + s for s in range(-k, k + 1) if 0 <= a + s and a + s + n <= width]
        return F.coalesce(*(F.when(F.substring("site", e + 1, n) == F.substring("q", a + 1, n), True) for e in ends), F.lit(False))

    first = F.coalesce(*(F.when(stands(i), F.lit(i)) for i in range(len(cuts))))
    near = met.where(F.col("piece") == first).withColumn("distance", free_end_distance("q", "site", length, k)).where(F.col("distance") <= k)
    loci = sites.where("not is_ambig").select("site", F.col("chrom").alias("chromosome"), "start", "strand")
    return near.select("guide", "site", "distance").join(loci, "site").select("guide", "distance", "chromosome", "start", "strand")


def summary_stream(hits: DataFrame, k: int) -> DataFrame:
    """Running counts by guide and distance; for outputMode("complete")."""
    return hits.groupBy("guide").agg(*counts_by_distance("distance", k))


def run_once(df: DataFrame, name: str, mode: str, checkpoint: str) -> StreamingQuery:
    """Process what is there, into a table in memory, and stop."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
