"""Guides, variants and stored hits."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dna import letter_of, mask

HITS = "guide string, alignment_guide string, alignment_reference string, distance int, chromosome string, start long, strand string"


def read_guides(spark: SparkSession, path: str) -> DataFrame:
    """(guide): the lines of a text file, upper-cased; empty lines are left out."""
    return spark.read.text(path).select(F.upper(F.trim("value")).alias("guide")).where("guide != ''")


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HITS).csv(path, header=True)


def compress_alleles(alts: Column) -> Column:
    """Alleles of one length become one, with the IUPAC letters of all of them; shorter ones first."""
    lengths = F.array_sort(F.array_distinct(F.transform(alts, lambda a: F.char_length(a))))

    def merged(n: Column) -> Column:
        same = F.filter(alts, lambda a: F.char_length(a) == n)

        def at(i: Column) -> Column:
            return letter_of(F.aggregate(same, F.lit(0), lambda acc, a: acc.bitwiseOR(mask(F.substring(a, i, F.lit(1))))))

        return F.when(n == 0, F.lit("")).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), at), ""))

    return F.transform(lengths, merged)


def variants_of(records: DataFrame, missing_alt: str = "delete") -> DataFrame:
    """(rec_no, id, chrom, pos, stop, ref, alts) of records (rec_no, id, chrom, pos, ref, alt).

    ``alt`` is a list joined by commas; '.' or nothing is one empty allele, i.e. the reference letters are deleted, or,
    with ``missing_alt="skip"``, no variant.  A record without an id is named by its number.
    """
    alts = F.transform(F.split(F.upper("alt"), ","), lambda a: F.when((a == ".") | (a == "*"), F.lit("")).otherwise(a))
    named = F.when(F.col("id").isNull() | (F.col("id") == ".") | (F.col("id") == ""), F.col("rec_no").cast("string")).otherwise(F.col("id"))
    rows = records.withColumn("ref", F.upper("ref"))
    if missing_alt == "skip":
        rows = rows.where("alt is not null and alt not in ('.', '', '*')")
    return rows.select(
        "rec_no", named.alias("id"), "chrom", F.col("pos").cast("long").alias("pos"), (F.col("pos") + F.char_length("ref") - 1).cast("long").alias("stop"), "ref",
        compress_alleles(F.coalesce(alts, F.array(F.lit("")))).alias("alts"),
    )


def read_vcf(spark: SparkSession, path: str, missing_alt: str = "delete") -> DataFrame:
    """The variants of a VCF file (plain or gzip); only the first five fields are read, so odd further ones don't matter."""
    if not re.search(r"\.vcf(\.gz)?$", path):
        raise ValueError(f"not a VCF file: {path}")
    lines = spark.read.text(path).withColumn("line", F.monotonically_increasing_id()).where("not startswith(value, '#') and value != ''")
    field = lambda k: F.element_at(F.split("value", "\t"), k)
    # the number of a record within the file: a window over (line) alone, with nothing but numbers in it
    numbered = lines.select("line").withColumn("rec_no", F.row_number().over(Window.orderBy("line")).cast("long"))
    records = lines.join(numbered, "line").select("rec_no", field(3).alias("id"), field(1).alias("chrom"), field(2).cast("long").alias("pos"), field(4).alias("ref"), field(5).alias("alt"))
    return variants_of(records, missing_alt)
