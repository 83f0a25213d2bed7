"""Row filters by key that leave most rows where they are, DataFrame functions only.

Rows of users come as (``KEY``, ``ROW``): a long and all their columns as one struct, so no name can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._io import bloom_position

KEY, ROW, MAYBE = "key", "row", "maybe"


def quoted(name: str) -> str:
    """A column's name, whatever letters it has, as a reference to it."""
    return "`" + name.replace("`", "``") + "`"


def packed(columns: list[str]) -> Column:
    """Columns as one struct, which has a field even if there are none."""
    return F.struct(*(F.col(quoted(c)) for c in columns)) if columns else F.struct(F.lit(0).alias("none"))


def unpacked(row: str, columns: list[str]) -> list[Column]:
    return [F.col(f"{row}.{quoted(c)}").alias(c) for c in columns]


def keyed(docs: DataFrame, key: Column) -> DataFrame:
    return docs.select(key.alias(KEY), packed(docs.columns).alias(ROW))


def may_be_in(df: DataFrame, keys: DataFrame, key: str, bits: int) -> DataFrame:
    """``df`` with a column ``MAYBE`` that is false only for rows whose ``key`` is surely not in ``keys``.

    A one-hash bitmap of the keys is broadcast: ``bits`` / 8 bytes at most, a multiple of 4096.
    """
    at = bloom_position(F.col(key), bits)
    maps = keys.select(at.alias("at_")).groupBy(F.bitmap_bucket_number("at_").alias("bucket_")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at_")).alias("bits_"))
    placed = df.withColumn("at_", at).withColumn("bit_", F.bitmap_bit_position("at_")).withColumn("bucket_", F.bitmap_bucket_number("at_"))
    byte = F.conv(F.hex(F.expr("substring(bits_, cast(bit_ div 8 as int) + 1, 1)")), 16, 10).cast("int")
    joined = placed.join(F.broadcast(maps), "bucket_", "left").withColumn("byte_", byte)
    hit = F.coalesce(F.expr("shiftright(byte_, cast(bit_ % 8 as int)) & 1") == 1, F.lit(False))
    return joined.withColumn(MAYBE, hit).drop("bucket_", "bits_", "at_", "bit_", "byte_")


def without(df: DataFrame, keys: DataFrame, key: str, bits: int) -> DataFrame:
    """Rows of ``df`` whose ``key`` isn't in ``keys`` (null keys stay); only rows that may be are shuffled."""
    told = may_be_in(df, keys, key, bits)
    open_rows = told.where(MAYBE).drop(MAYBE).join(keys.select(key).distinct(), key, "left_anti")
    return told.where(f"not {MAYBE}").drop(MAYBE).unionByName(open_rows)


def once(df: DataFrame, keys: DataFrame, key: str, bits: int) -> DataFrame:
    """Rows of ``df``, of those whose ``key`` is in ``keys`` one of each; only rows that may be are shuffled.

    Keys with many rows leave one a task before the shuffle.
    """
    told = may_be_in(df, keys, key, bits)
    return told.where(f"not {MAYBE}").drop(MAYBE).unionByName(told.where(MAYBE).drop(MAYBE).dropDuplicates([key]))
