"""Operator 5, token counts: a two-tier lookup on the map side.

Tier one is a broadcast table of the most frequent pre-tokens' lengths in tokens, at most ``table_size`` entries.  It
is found over all documents without dealing out any pre-token: each task counts its own with bounded space (the
rarest go when there are too many), hands over one summary of at most ``table_size`` entries, and summaries are
merged in a tree.  Tier two: pre-tokens that aren't in it are encoded by the library in batches and kept in the
worker's bounded cache.  The table only saves work; counts never depend on it.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import task
from ._tokens import Cache, tokenizer

BLOCK_ROWS = 256
FAN_IN = 16


def _heavy(counts: Counter, size: int) -> Counter:
    return counts if len(counts) <= size else Counter(dict(counts.most_common(size)))


def _summaries(size: int, slots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column("text"):
                counts.update((text.as_py() or "").encode().split())
                if len(counts) > 8 * size:
                    counts = _heavy(counts, 2 * size)
        blob = pickle.dumps(dict(_heavy(counts, size)))
        slot = pa.array([TaskContext.get().partitionId() % slots], pa.int32())
        yield pa.RecordBatch.from_arrays([slot, pa.array([blob], pa.binary())], ["slot", "summary"])

    return task(run)


def _merged(size: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        total: Counter = Counter()
        for blob in pdf["summary"]:
            total.update(pickle.loads(blob))
            if len(total) > 8 * size:
                total = _heavy(total, 2 * size)
        return pd.DataFrame({"slot": [pdf["slot"].iloc[0]], "summary": [pickle.dumps(dict(_heavy(total, size)))]})

    return run


def frequent_pretokens(texts: DataFrame, size: int) -> list[bytes]:
    """At most ``size`` pre-tokens (white-space separated) of a ``text`` column, the most frequent as far as summaries tell."""
    schema = "slot int, summary binary"
    most = 8 * texts.sparkSession.sparkContext.defaultParallelism
    found = texts.select("text").coalesce(max(most, FAN_IN)).mapInArrow(_summaries(size, FAN_IN), schema)
    total: Counter = Counter()
    for row in found.groupBy("slot").applyInPandas(_merged(size), schema).collect():
        total.update(pickle.loads(row["summary"]))
    return [w for w, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:size]]


def _lengths(path: str, chunks: list[bytes]) -> dict[bytes, int]:
    found = tokenizer(path).encode_batch_fast([c.decode() for c in chunks], add_special_tokens=False)
    return {c: len(e) for c, e in zip(chunks, found, strict=True)}


def _counts(path: str, table, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Cache(limit, table.value)
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(i, BLOCK_ROWS)
                out = []
                for text in part.column("text"):
                    chunks = (text.as_py() or "").encode().split()
                    if unknown := cache.missing(chunks):
                        cache.learn(_lengths(path, unknown))
                    try:
                        out.append(sum(map(cache.now.__getitem__, chunks)))
                    except KeyError:  # more distinct pre-tokens in a text than the cache holds
                        some = _lengths(path, list(set(chunks)))
                        out.append(sum(map(some.__getitem__, chunks)))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("n_bytes"), pa.array(np.array(out, np.int64))], ["id", "n_bytes", "n_tokens"])

    return task(run)


def token_counts(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, table_size: int = 1 << 15, cache_size: int = 400_000
) -> DataFrame:
    """(``id_col``, n_bytes, n_tokens, over_limit) of each row, as the tokenizer at ``path`` counts without added tokens.

    The vocabulary must drop white space before it splits, as the one with word ends does: then a text's tokens are
    those of its white-space separated pre-tokens.

    Defined cases: a null or empty text has 0 bytes and 0 tokens; ids are passed on, null or repeated; an empty table
    gives an empty result; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    table = _lengths(path, frequent_pretokens(rows, table_size))
    held = docs.sparkSession.sparkContext.broadcast(table)
    out = rows.withColumn("n_bytes", F.octet_length("text").cast("long")).mapInArrow(_counts(path, held, cache_size), "id long, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
