"""The stages of the corpus pipeline; each takes (spark, docs, sf_dir) and returns a DataFrame.

Stages decide on keys and narrow tables; texts are shuffled only where a row may be dropped or changed.  Rows are told
apart by a hash of id and text, so repeated ids, or rows without one, don't share a verdict.  Columns besides those that
a stage reads travel as one struct, so they may have any name.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._filter import KEY, ROW, keyed, once, packed, quoted, unpacked, without
from ._io import cut, input_bytes, power_of_two
from .jaccard_join import ngram_jaccard_join, row_key
from .packing import pack
from .quality_rules import quality_rules
from .secret_scan import scan_secrets
from .substring_dedup import substring_dedup

MAX_BITS = 1 << 26
REST = "rest of the row"


def _bits(docs: DataFrame) -> int:
    return power_of_two(input_bytes(docs) / 64, 1 << 15, MAX_BITS)


def _row_key() -> Column:
    return row_key(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))


def _texts_changed(docs: DataFrame, change) -> DataFrame:
    """``docs`` with the text that ``change``, of (doc_id, text, REST), returns as a column named last; n_chars told anew."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    out, text = change(docs.select("doc_id", "text", packed(rest).alias(REST)))
    columns = {"doc_id": F.col("doc_id"), "text": F.col(text).alias("text"), "n_chars": F.char_length(text).cast("long").alias("n_chars")}
    columns |= dict(zip(rest, unpacked(quoted(REST), rest), strict=True))
    return out.select(*(columns[c] for c in docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go.

    Defined cases: a null or empty text fails; a null source is a host of its own; equal rows share a verdict, other
    rows of one id don't; an empty table stays one; further columns are passed on.
    """
    told = quality_rules(docs.select(_row_key().alias(KEY), "text", "source"), id_col=KEY)
    rejected = cut(told.where("not kept").select(KEY).distinct(), "rejected")
    return without(keyed(docs, _row_key()), rejected, KEY, _bits(docs)).select(*unpacked(ROW, docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, 0.8) one row stays, that of the smallest id.

    Defined cases: rows of one id and one text are copies, of which any one stays; rows of one id and different texts
    are judged each by its own; a row without an id, text or words has no copies and stays; an empty table stays one;
    further columns are passed on.
    """
    told = ngram_jaccard_join(docs.select("doc_id", "text"), shingle=5, percent=80, row_keys=True)
    groups = cut(told.where("n_shingles > 0 and doc_id is not null").select("row_key", "component_row"), "groups")
    copies = groups.where("component_row != row_key").select(F.col("row_key").alias(KEY)).distinct()
    again = groups.where("component_row = row_key").groupBy(F.col("row_key").alias(KEY)).agg(F.count("*").alias("n")).where("n > 1").select(KEY)
    bits = _bits(docs)
    return once(without(keyed(docs, _row_key()), copies, KEY, bits), again, KEY, bits).select(*unpacked(ROW, docs.columns))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a smaller document has too are cut; a text that loses nothing keeps its white space.

    Defined cases: a null text comes back empty; a row without an id loses nothing; rows of one id don't cut each other;
    an empty table stays one; further columns are passed on.
    """
    return _texts_changed(docs, lambda df: (substring_dedup(df, whole=True, keep=[REST]), "kept_text"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark.

    Defined cases: a null text stays null; a null source is an empty path; rows are changed each for itself; an empty
    table stays one; further columns are passed on.
    """
    return _texts_changed(docs, lambda df: (scan_secrets(df.withColumn("path", F.col(f"{quoted(REST)}.source")), path_col="path", keep=[REST]), "redacted"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their token ids, packed into sequences of 2048 tokens.

    Defined cases: a null or empty text is its end mark alone; rows are packed each for itself, null or repeated ids
    passed on; an empty table gives an empty result; further columns are left out.
    """
    return pack(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=1, ids=True)
