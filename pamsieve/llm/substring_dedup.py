"""Operator 1, substring dedup: count-min prefilter, then exact grouping of the windows it cannot rule out.

Pass 1 scans the texts and sketches.  Each window of ``window`` words is represented by its anchor, the smallest
hash among its 7-word shingles; two equal windows have equal anchors, so an anchor's count is never below its
windows' counts, and there are about four times fewer anchors than windows.  Every task keeps a two-row count-min
sketch (counters saturate at two) and emits its touched counters in chunks of 65 536; chunks are merged by summing.
The merged sketch, one bit a counter for "at least two", is broadcast: at most ``max_counters`` bits a row.  When the
corpus outgrows it, it rules out less and the second pass shuffles more, but nothing is lost.

Pass 2 scans again and keeps (96 hash bits, doc, position) of those windows only whose estimate is two or more.  A task
compares its own first: a window that a smaller doc of the same LOCAL windows has too is marked at once, so a passage
that a third of all docs share costs a few rows a task, not one a doc.  One shuffle brings the rest of equal windows
together; all but those of the smallest doc are marked.  (96 bits: at 10^13 windows, all of 100 TB of text, chance makes
about one pair of different windows equal in a thousand such corpora.)  Marks are gathered per doc.  A bitmap of the docs
with marks parts the input: texts that have none are finished where they are read, only the others are shuffled.

A text is never cut; a task holds about 35 bytes for each byte of its longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._filter import MAYBE, may_be_in, packed, unpacked
from ._io import cut, input_bytes, power_of_two, small_batches
from ._text import Words, blocks, mix, signed, task

SHINGLE = 7
CHUNK = 1 << 16
FLUSH = 1 << 20
LOCAL = 1 << 19
KEY_MASK = 0x7FFFFFFF
_CHUNKS = "chunk int, once binary, twice binary"
_WINDOWS = "h1 long, h2 int, id long, at long"


def _anchors(words: Words, window: int, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of each run's first window, its anchor); consecutive windows of a text with one anchor are a run."""
    s = words.windows(shingle, words.hashes(0), 0)
    valid = words.valid(window)
    n, span = len(valid), window - shingle + 1
    low, have = s, 1
    while have < span:
        step = min(have, span - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    low = low[:n]
    new = np.ones(n, bool)
    new[1:] = (low[1:] != low[:-1]) | (words.doc[1:n] != words.doc[: n - 1]) if n else True
    runs = np.flatnonzero(new & valid)
    return runs, low[runs]


def _positions(anchors: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Each anchor's counters in the two rows."""
    mask = np.uint64(width - 1)
    return (anchors & mask).astype(np.int64), ((anchors >> np.uint64(32)) & mask).astype(np.int64) + width


def _chunks(found: list[np.ndarray]) -> pa.RecordBatch:
    """A partial sketch as chunks: which counters were raised once, which twice or more (as uint16 lists)."""
    at = np.sort(np.concatenate(found))
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1]
    which = np.flatnonzero(new)
    many = np.diff(np.append(which, len(at))) > 1
    once, twice = at[which[~many]], at[which[many]]
    chunk = np.unique(at >> 16)

    def lists(x: np.ndarray) -> pa.Array:
        edges = (np.append(np.searchsorted(x, chunk << 16), len(x)) * 2).astype(np.int32)
        body = (x & (CHUNK - 1)).astype("<u2")
        return pa.Array.from_buffers(pa.binary(), len(chunk), [None, pa.py_buffer(edges.tobytes()), pa.py_buffer(body.tobytes())])

    return pa.RecordBatch.from_arrays([pa.array(chunk, pa.int32()), lists(once), lists(twice)], ["chunk", "once", "twice"])


def _sketch(width: int, window: int, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = [], 0
        for batch in batches:
            for _, _, words in blocks(batch.column("text")):
                at = _positions(_anchors(words, window, shingle)[1], width)
                found += at
                n += len(at[0]) * 2
                if n >= FLUSH:
                    yield _chunks(found)
                    found, n = [], 0
        if n:
            yield _chunks(found)

    return task(run)


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    seen, again = np.zeros(CHUNK, bool), np.zeros(CHUNK, bool)
    for once, twice in zip(pdf["once"], pdf["twice"], strict=True):
        a, b = np.frombuffer(once, "<u2"), np.frombuffer(twice, "<u2")
        again[a[seen[a]]] = True
        again[b] = True
        seen[a] = True
        seen[b] = True
    return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "again": [np.packbits(again, bitorder="little").tobytes()]})


def count_min_sketch(texts: DataFrame, width: int, window: int = 13, shingle: int = SHINGLE) -> np.ndarray:
    """The merged sketch of a ``text`` column: bit p of the result says that counter p was raised at least twice."""
    chunks = texts.select("text").mapInArrow(_sketch(width, window, shingle), _CHUNKS)
    out = np.zeros(max(CHUNK, 2 * width) // 8, np.uint8)
    for chunk, again in chunks.groupBy("chunk").applyInPandas(_merge, "chunk int, again binary").collect():
        out[chunk * CHUNK // 8 : (chunk + 1) * CHUNK // 8] = np.frombuffer(again, np.uint8)
    return out


def _compared(h1: np.ndarray, h2: np.ndarray, ids: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Windows as rows; those that a smaller id has among them too have no ``h2`` and anything as ``h1``."""
    order = np.argsort(h1)
    sorted_, sorted_h2, sorted_ids = h1[order], h2[order], ids[order]
    new = np.ones(len(h1), bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    first = np.flatnonzero(new)
    many = np.diff(first, append=len(h1))
    one_key = np.minimum.reduceat(sorted_h2, first) == np.maximum.reduceat(sorted_h2, first)
    sure = np.empty(len(h1), bool)  # rows stay in the order of the texts, which is good for compression
    sure[order] = (sorted_ids > np.repeat(np.minimum.reduceat(sorted_ids, first), many)) & np.repeat(one_key, many)
    spread = np.where(sure, mix(at.view(np.uint64) ^ mix(ids.view(np.uint64))), h1)
    return pa.RecordBatch.from_arrays([pa.array(signed(spread)), pa.array(h2, mask=sure), pa.array(ids), pa.array(at)], ["h1", "h2", "id", "at"])


def _repeated(width: int, window: int, shingle: int, sketch):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sketch.value
        found, held = [], 0

        def twice(at: np.ndarray) -> np.ndarray:
            return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            keys = batch.column("key").to_numpy(zero_copy_only=False) & KEY_MASK
            for i, _, words in blocks(batch.column("text")):
                runs, anchors = _anchors(words, window, shingle)
                a, b = _positions(anchors, width)
                hit = twice(a)
                hit[hit] = twice(b[hit])
                valid = words.valid(window)
                # a run goes on to the next run's start; what lies between texts isn't valid
                ends = np.append(runs[1:], len(valid))[hit] if len(runs) else runs
                edge = np.zeros(len(valid) + 1, np.int32)
                np.add.at(edge, runs[hit], 1)
                np.add.at(edge, ends, -1)
                at = (np.cumsum(edge)[:-1] > 0) & valid
                where = np.flatnonzero(at)
                if not len(where):
                    continue
                h1 = words.windows(window, words.hashes(0), 0)[where]
                h2 = (words.windows(window, words.hashes(1), 1)[where] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                doc = words.doc[where]
                found.append((h1, h2, ids[i + doc], (keys[i + doc] << 32) | (where - words.first_word[doc])))
                held += len(where)
                if held >= LOCAL:
                    yield _compared(*(np.concatenate(x) for x in zip(*found, strict=True)))
                    found, held = [], 0
        if held:
            yield _compared(*(np.concatenate(x) for x in zip(*found, strict=True)))

    return task(run)


def _finish(window: int, whole: bool):
    """Texts without the words that their marks, if there are any, cover."""

    def marked(words: Words, i: int, key: int, marks: np.ndarray) -> np.ndarray:
        n = int(words.counts[i])
        edge = np.zeros(n + 1, np.int32)
        m = np.asarray(marks, np.int64)
        at = np.unique(m[(m >> 32) == (key & KEY_MASK)] & 0xFFFFFFFF)
        np.add.at(edge, at, 1)
        np.add.at(edge, np.minimum(at + window, n), -1)
        return np.cumsum(edge)[:n] > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            marks = batch.column("marks") if "marks" in batch.schema.names else None
            key = batch.column("key").to_pylist() if marks is not None else None
            for i, j, words in blocks(text):
                n_removed, kept = [], []
                for r in range(i, j):
                    gone = None
                    if marks is not None and marks[r].is_valid:
                        gone = marked(words, r - i, key[r], marks[r].values.to_numpy(zero_copy_only=False))
                    lost = 0 if gone is None else int(gone.sum())
                    n_removed.append(lost)
                    kept.append(text[r].as_py() if whole and not lost else words.joined(r - i, ~gone if lost else None).decode())
                part = batch.slice(i, j - i)
                columns = [part.column("id"), pa.array(words.counts, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), part.column("rest")]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "n_removed", "kept", "rest"])

    return task(run)


def repeated_windows(docs: DataFrame, window: int = 13, shingle: int = SHINGLE, max_counters: int = 1 << 27) -> DataFrame:
    """(id, at): windows of ``docs`` (id, key, text) that a smaller id has too; ``at`` is 31 bits of key, 32 of the first word."""
    spark = docs.sparkSession.sparkContext
    shingle = min(shingle, window)
    width = power_of_two(input_bytes(docs) / 4, 1 << 16, max_counters)
    sketch = spark.broadcast(count_min_sketch(docs, width, window, shingle))
    found = docs.where("id is not null").select("id", "key", "text").mapInArrow(_repeated(width, window, shingle, sketch), _WINDOWS)
    same = Window.partitionBy("h1", "h2")
    return found.withColumn("first", F.min("id").over(same)).where("h2 is null or id > first").select("id", "at")


def substring_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 13,
    max_counters: int = 1 << 27,
    filter_bits: int = 1 << 26,
    whole: bool = False,
    keep: list[str] | None = None,
) -> DataFrame:
    """Remove each word covered by a ``window``-word passage that also starts in a document with a smaller id.

    Returns a row for each input row: ``id_col``, n_words, n_removed (long), kept_text (the words that stay, joined by
    one space; with ``whole`` a text that loses nothing stays as it is) and the columns in ``keep``.  Words are runs of
    anything but space and 0x09-0x0D; passages are judged on the input.

    Defined cases: a null or empty text has no words; a text of fewer words than ``window`` stays; a row without an id
    stays whole and is nobody's source; rows with one id are judged each by its own text and do not remove each
    other's passages; equal rows get equal results; an empty table gives an empty result; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    keep = keep or []
    if clash := {"n_words", "n_removed", "kept_text", id_col} & set(keep):
        raise ValueError(f"columns to keep have names of the result: {sorted(clash)}")
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), packed(keep).alias("rest")
    ).withColumn("key", F.xxhash64("id", "text"))
    marks = cut(repeated_windows(rows, window, max_counters=max_counters).groupBy("id").agg(F.collect_list("at").alias("marks")), "marks")
    told = may_be_in(rows, marks, "id", power_of_two(input_bytes(docs) / 64, 1 << 15, filter_bits))
    schema = StructType().add("id", "long").add("n_words", "long").add("n_removed", "long").add("kept", "string").add(rows.schema["rest"])
    finish = _finish(window, whole)
    unmarked = told.where(f"id is null or not {MAYBE}").select("id", "text", "rest").mapInArrow(finish, schema)
    marked = told.where(f"id is not null and {MAYBE}").select("id", "key", "text", "rest").join(marks, "id", "left").mapInArrow(finish, schema)
    out = unmarked.unionByName(marked)
    return out.select(F.col("id").alias(id_col), "n_words", "n_removed", F.col("kept").alias("kept_text"), *unpacked("rest", keep))
