"""Operator 8, quality rules: rule failures by host, shrunk with an empirical beta prior, joined back to documents.

One scan measures each text (vectorised, nothing leaves its row) and writes a narrow table.  Failures are then summed
by host (partial aggregates, so a host with a third of all rows costs a row a task).  The prior is fitted to the
hosts' rates by moments: mean m = failures / documents, and strength m (1 - m) / variance - 1.  A host's rate is
(failures + m * strength) / (documents + strength).

Verdict: a document goes if it fails a base rule; if its host is blocked, i.e. the shrunk rate of documents that fail
any rule is ``block_rate`` or more; or if it fails a host-judged rule (symbols, repeated lines) whose shrunk rate at
its host is ``suspect_rate`` or more.  So a rare failure at an otherwise clean host is forgiven.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._io import cut, small_batches
from ._text import Words, blocks, task

_BLANK = " \t\n\x0b\x0c\r"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
RULES = ("short", "repeats", "symbols", "dup_lines")
MAX_STRENGTH = 1e6


def _per_text(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[edges[1:]] - total[edges[:-1]]


def _repeat_words(words: Words, k: int) -> np.ndarray:
    """For each text, its words in k-word windows found twice or more in it."""
    valid = words.valid(k)
    at = np.flatnonzero(valid)
    edge = np.zeros(len(words.doc) + 1, np.int64)
    if len(at):
        key = words.windows(k, words.hashes(0), 0)[at] + words.doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        hit = np.zeros(len(at), bool)
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        edge[at[hit]] += 1
        edge[at[hit] + k] -= 1
    return _per_text(np.cumsum(edge)[:-1] > 0, words.first_word)


def _lines(text: str) -> tuple[int, int]:
    """Lines with a word, and how many of them equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(_BLANK)]
    return len(lines), len(lines) - len(set(lines))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column("text")
        for i, j, words in blocks(text):
            lines = np.array([_lines(x or "") for x in text[i:j].to_pylist()], np.int64).reshape(-1, 2)
            lead = words.inside & ((words.data & 0xC0) != 0x80)
            columns = [words.counts, _per_text(lead, words.offsets), _per_text(_SYMBOL[words.data], words.offsets), lines[:, 0], lines[:, 1], _repeat_words(words, 8)]
            part = batch.slice(i, j - i)
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("host"), *(pa.array(np.asarray(c, np.int64)) for c in columns)], ["id", "host", *MEASURES])


def measure(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """(id, host, measures) of each row; a null text has no words."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(task(_measure), "id long, host string, " + ", ".join(f"{m} long" for m in MEASURES))


def rules() -> dict[str, Column]:
    """Each rule's failure, of the measures."""
    n = F.col("n_words")
    return {
        "short": n < 20,
        "repeats": 100 * F.col("n_repeat_words") > 30 * n,
        "symbols": 10 * F.col("n_symbols") > F.col("word_chars"),
        "dup_lines": 100 * F.col("n_dup_lines") > 30 * F.col("n_lines"),
    }


def host_rates(measured: DataFrame) -> DataFrame:
    """(host, n_docs, rate_any, rate_<rule>): failure rates of each host, shrunk with a beta prior fitted to all hosts."""
    failed = rules()
    either = failed["short"] | failed["repeats"] | failed["symbols"] | failed["dup_lines"]
    kinds = {"any": either, "symbols": failed["symbols"], "dup_lines": failed["dup_lines"]}
    hosts = cut(measured.groupBy("host").agg(F.count("*").alias("n_docs"), *(F.count_if(c).alias(k) for k, c in kinds.items())), "hosts")
    sums = hosts.agg(F.sum("n_docs").alias("n"), *(F.sum(k).alias(k) for k in kinds)).first()
    n = sums["n"] or 1
    mean = {k: (sums[k] or 0) / n for k in kinds}
    spread = hosts.agg(*(F.sum(F.col("n_docs") * (F.col(k) / F.col("n_docs") - mean[k]) ** 2).alias(k) for k in kinds)).first()
    rates = []
    for k, m in mean.items():
        v = (spread[k] or 0.0) / n
        strength = MAX_STRENGTH if v <= 0 else min(MAX_STRENGTH, max(1.0, m * (1 - m) / v - 1))
        rates.append(((F.col(k) + m * strength) / (F.col("n_docs") + strength)).alias(f"rate_{k}"))
    return hosts.select("host", "n_docs", *rates)


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", block_rate: float = 0.5, suspect_rate: float = 0.02
) -> DataFrame:
    """A row for each input row: ``id_col``, the measures, base_failed, the host's shrunk rates, reason, and kept.

    Defined cases: a null or empty text has no words and fails the base rule; rows without a host form one host of
    their own; rows are judged one by one, so equal rows and repeated ids get equal verdicts; an empty table gives an
    empty result; other columns are ignored.
    """
    measured = cut(measure(docs, id_col, text_col, host_col), "measures")
    verdicts = host_rates(measured).withColumnRenamed("host", "its_host")
    joined = measured.join(verdicts, F.col("host").eqNullSafe(F.col("its_host")), "left")
    failed = rules()
    base = failed["short"] | failed["repeats"]
    reason = (
        F.when(failed["short"], "short")
        .when(failed["repeats"], "repeats")
        .when(F.col("rate_any") >= block_rate, "host blocked")
        .when(failed["symbols"] & (F.col("rate_symbols") >= suspect_rate), "symbols")
        .when(failed["dup_lines"] & (F.col("rate_dup_lines") >= suspect_rate), "dup_lines")
    )
    out = joined.withColumn("reason", reason).withColumn("base_failed", base)
    return out.select(F.col("id").alias(id_col), *MEASURES, "base_failed", "rate_any", "rate_symbols", "rate_dup_lines", "reason", F.col("reason").isNull().alias("kept"))
