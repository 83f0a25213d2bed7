"""Exact substring search and symbol statistics over long strings."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sites import tiles

#: Where a substring is spelled out by walking its tile, tiles are short.
TILE = 512
LONG_TILE = 1 << 15
FEW_PATTERNS = 100_000


def _tiled(texts: DataFrame, context: int) -> DataFrame:
    return tiles(texts, context, max(TILE, context))


def substrings(texts: DataFrame, k: int) -> DataFrame:
    """(chrom, pos, word): every substring of ``k`` letters with its 1-based place."""
    n = F.col("size") + F.greatest(F.lit(0), F.least(F.lit(k - 1), F.char_length("tile") - F.col("lead") - F.col("size"))) - (k - 1)
    rows = _tiled(texts, max(1, k - 1)).where(n > 0)
    at = F.sequence(F.lit(1), n)
    words = rows.select("chrom", "at", "lead", "tile", F.explode(at).alias("i"))
    return words.select("chrom", (F.col("at") + F.col("i")).cast("long").alias("pos"), F.substring("tile", F.col("lead") + F.col("i"), F.lit(k)).alias("word"))


class _Matcher:
    """Patterns by length, found in a tile by hashes of its windows; what a hash finds is compared letter by letter."""

    def __init__(self, patterns: list[str]):
        self.groups = []  # (length, sorted hashes, patterns' numbers, their letters); no hash twice in a group
        by_length: dict[int, list[int]] = {}
        for i, p in enumerate(patterns):
            by_length.setdefault(len(p), []).append(i)
        for k, numbers in sorted(by_length.items()):
            letters = np.stack([_letters(patterns[i]) for i in numbers])
            hashes, numbers = np.array([_window_hashes(x, k)[0] for x in letters]), np.array(numbers)
            left = np.argsort(hashes, kind="stable")
            while len(left):
                _, one = np.unique(hashes[left], return_index=True)
                own = left[one]
                self.groups.append((k, hashes[own], numbers[own], letters[own]))
                left = np.delete(left, one)

    def find(self, tile: str, begin: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, pattern) of occurrences that start at ``begin`` or one of the ``size`` - 1 letters behind it."""
        data = _letters(tile)
        places, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, hashes, numbers, letters in self.groups:
            part = data[begin : begin + size + k - 1]
            if len(part) < k:
                continue
            own = _window_hashes(part, k)
            at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
            place = np.flatnonzero(hashes[at] == own)
            which = at[place]
            equal = np.ones(len(place), bool)
            for j in range(k):
                equal &= part[place + j] == letters[which, j]
            places.append(place[equal] + begin)
            found.append(numbers[which[equal]])
        return np.concatenate(places), np.concatenate(found)


def _letters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _window_hashes(letters: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros(len(letters) - k + 1, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + letters[j : j + len(out)]
    return out


def _matched(texts: DataFrame, patterns: list[str], counted: bool) -> DataFrame:
    """Occurrences (pattern, chrom, pos), or with ``counted`` each task's counts (pattern, n), of a few patterns in one scan."""
    held = texts.sparkSession.sparkContext.broadcast((patterns, _Matcher(patterns)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matcher = held.value
        names, counts = pa.array(names, pa.string()), np.zeros(len(names), np.int64)
        for batch in batches:
            for chrom, at, lead, size, tile in zip(*(batch.column(c).to_pylist() for c in ("chrom", "at", "lead", "size")), batch.column("tile"), strict=True):
                place, which = matcher.find(tile.as_py(), lead, size)
                if counted:
                    counts += np.bincount(which, minlength=len(counts))
                elif len(place):
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(which)), pa.array([chrom] * len(place), pa.string()), pa.array(place - lead + at + 1)], ["pattern", "chrom", "pos"])
        if counted:
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(some)), pa.array(counts[some])], ["pattern", "n"])

    context = max(1, max(map(len, patterns)) - 1)
    tiled = tiles(texts, context, max(LONG_TILE, context)).select("chrom", "at", "lead", "size", "tile")
    return tiled.mapInArrow(run, "pattern string, n long" if counted else "pattern string, chrom string, pos long")


def _few(patterns: DataFrame) -> list[str] | None:
    """The different patterns that have letters, if they are at most FEW_PATTERNS."""
    rows = patterns.select("pattern").where("char_length(pattern) > 0").distinct().limit(FEW_PATTERNS + 1).collect()
    return sorted(r[0] for r in rows) if len(rows) <= FEW_PATTERNS else None


def _joined(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """Occurrences of many patterns: an equi-join of all substrings for each length of patterns."""
    lengths = [r[0] for r in patterns.select(F.char_length("pattern")).distinct().collect() if r[0]]
    found = None
    for k in sorted(lengths):
        own = patterns.where(F.char_length("pattern") == k).select("pattern").distinct()
        part = substrings(texts, k).join(own, F.col("word") == F.col("pattern")).select("pattern", "chrom", "pos")
        found = part if found is None else found.unionByName(part)
    return found


def locate(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, chrom, pos): all occurrences, overlapping ones too; a pattern without letters occurs nowhere.

    Up to FEW_PATTERNS different patterns are broadcast and searched in one scan; beyond that they are joined.
    """
    few = _few(patterns)
    if few is None:
        return _joined(texts, patterns)
    if not few:
        return patterns.sparkSession.createDataFrame([], "pattern string, chrom string, pos long")
    return _matched(texts, few, counted=False)


def count(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, n): numbers of occurrences, 0 included; of few patterns only a count a task is shuffled."""
    few = _few(patterns)
    if few is None:
        found = _joined(texts, patterns).groupBy("pattern").agg(F.count("*").alias("n"))
    elif few:
        found = _matched(texts, few, counted=True).groupBy("pattern").agg(F.sum("n").alias("n"))
    else:
        found = patterns.sparkSession.createDataFrame([], "pattern string, n long")
    return patterns.select("pattern").distinct().join(found, "pattern", "left").select("pattern", F.coalesce("n", F.lit(0)).alias("n"))


def word_counts(texts: DataFrame, k: int) -> DataFrame:
    """(word, n): the index of all words of ``k`` letters."""
    return substrings(texts, k).groupBy("word").agg(F.count("*").alias("n"))


def kmer_counts(texts: DataFrame, k: int, most: int = 1 << 18) -> DataFrame:
    """(kmer, n): all words of ``k`` ASCII letters, 1 to 8; a task holds at most about ``most`` words and a tile before it hands counts out."""
    if not 1 <= k <= 8:
        raise ValueError("k-mers of 1 to 8 letters are counted")
    ends = 8 * np.arange(k - 1, -1, -1, dtype=np.uint64)

    def spelled(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([int(c).to_bytes(k, "big").decode() for c in counts]), pa.array(list(counts.values()), pa.int64())], ["kmer", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for tile in batch.column("tile"):
                data = np.frombuffer(tile.as_buffer(), np.uint8).astype(np.uint64)
                n = len(data) - k + 1
                if n < 1:
                    continue
                code = np.zeros(n, np.uint64)
                for i in range(k):
                    code |= data[i : i + n] << ends[i]
                for c, m in zip(*(x.tolist() for x in np.unique(code, return_counts=True)), strict=True):
                    counts[c] += m
                if len(counts) >= most:
                    yield spelled(counts)
                    counts = Counter()
        if counts:
            yield spelled(counts)

    # a word belongs to the tile that it begins in
    tiled = tiles(texts, max(1, k - 1))
    own = tiled.select(F.substring("tile", F.col("lead") + 1, F.col("size") + (k - 1)).alias("tile"))
    return own.mapInArrow(run, "kmer string, n long").groupBy("kmer").agg(F.sum("n").alias("n"))


def symbol_counts(texts: DataFrame) -> DataFrame:
    """(chrom, symbol, n): histogram of letters."""
    letters = F.explode(F.split("seq", "")).alias("symbol")
    return texts.select("chrom", letters).groupBy("chrom", "symbol").agg(F.count("*").alias("n"))


def rank(texts: DataFrame, symbol: str, place: int) -> DataFrame:
    """(chrom, n): how often the symbol occurs in the first ``place`` letters."""
    head = F.left("seq", F.lit(max(0, place)))
    return texts.select("chrom", (F.char_length(head) - F.char_length(F.replace(head, F.lit(symbol), F.lit("")))).cast("long").alias("n"))


def frequency(texts: DataFrame, symbol: str, start: int, stop: int) -> DataFrame:
    """(chrom, n): how often the symbol occurs at places start to stop."""
    part = F.substring("seq", start, max(0, stop - start + 1))
    return texts.select("chrom", (F.char_length(part) - F.char_length(F.replace(part, F.lit(symbol), F.lit("")))).cast("long").alias("n"))


def select(texts: DataFrame, symbol: str, j: int) -> DataFrame:
    """(chrom, pos): the place of the symbol's j-th occurrence, 0 if there are fewer."""
    before = F.substring_index("seq", symbol, j)
    there = F.char_length("seq") - F.char_length(F.replace("seq", F.lit(symbol), F.lit(""))) >= j
    return texts.select("chrom", F.when(there, F.char_length(before) + 1).otherwise(0).cast("long").alias("pos"))


def symbol_positions(texts: DataFrame, symbol: str) -> DataFrame:
    """(chrom, j, pos): places of a symbol, numbered: what rank and select answer singly."""
    rows = _tiled(texts, 1)
    inner = F.substring("tile", F.col("lead") + 1, F.col("size"))
    hits = F.filter(F.sequence(F.lit(1), F.col("size")), lambda i: F.substring(inner, i, F.lit(1)) == symbol)
    found = rows.select("chrom", "at", F.explode(hits).alias("i")).select("chrom", (F.col("at") + F.col("i")).cast("long").alias("pos"))
    return found.withColumn("j", F.row_number().over(Window.partitionBy("chrom").orderBy("pos")).cast("long")).select("chrom", "j", "pos")


def suffix_array(texts: DataFrame) -> DataFrame:
    """(chrom, i, pos): 0-based places of suffixes in order; for short texts, as every suffix is spelled out."""
    rows = texts.select("chrom", "seq", F.explode(F.sequence(F.lit(0), F.char_length("seq") - 1)).alias("pos"))
    order = Window.partitionBy("chrom").orderBy(F.expr("substring(seq, pos + 1)"))
    return rows.select("chrom", (F.row_number().over(order) - 1).cast("long").alias("i"), F.col("pos").cast("long").alias("pos"))


def bwt(texts: DataFrame) -> DataFrame:
    """(chrom, i, symbol): the letter before each suffix in order; '' before the whole text."""
    placed = suffix_array(texts).join(texts.select("chrom", "seq"), "chrom")
    return placed.select("chrom", "i", F.when(F.col("pos") == 0, "").otherwise(F.expr("substring(seq, int(pos), 1)")).alias("symbol"))


def restore(tiled: DataFrame) -> DataFrame:
    """(chrom, seq): texts put together from their tiles."""
    part = F.struct("at", F.substring("tile", F.col("lead") + 1, F.col("size")).alias("s"))
    ordered = F.array_sort(F.collect_list(part))
    return tiled.groupBy("chrom").agg(F.array_join(F.transform(ordered, lambda p: p["s"]), "").alias("seq"))
