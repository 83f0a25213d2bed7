"""Operator 2, n-gram Jaccard join: adaptive multi-match prefixes, then exact verification.

Texts become sets of word shingles (64-bit hashes); equal sets are one class.  Shingles are ordered by document
frequency, rarest first, ties by hash.  The frequency comes from a count-min sketch over all documents whose partition
sketches are summed; any order would be right, as long as all documents share it.

For threshold t, two sets that link share at least ``need = ceil(t n)`` shingles of either, n being its size.  So the
first n - need + l shingles of both hold l common ones.  Each set picks its l: it estimates from the frequencies how
many index entries a prefix would touch and how many candidates could still reach l matches (touched / l), and takes
the l with the least cost of touching plus verifying.  A pair is a candidate when its prefixes share min(l, l') shingles.

Large groups of near copies would give all their pairs.  So a few star rounds come first: each bucket draws a hub, each
set is compared with the likest of its hubs (as signatures tell) that isn't in its component yet, and verified links
give new components.  A round is linear in the index, and rounds end when they find few links.  Then all pairs of a bucket that lie in different components
still are joined, under the length, position and parity-signature bounds, all lossless and part of the join condition.  Pairs inside a component can't change it.  Sets of shingles are read
again from the texts, for those classes only that have a candidate, and compared exactly.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._io import bloom, bloom_position, cut, discard, input_bytes, power_of_two, small_batches
from ._text import Words, blocks, mix, signed, task
from .components import components

CHUNK = 1 << 16
SIG = [f"s{i}" for i in range(8)]
MAX_MATCHES = 8
SEEN = 200_000
STAR_ROUNDS = 3
SMALL = 4
PARTNERS = 0.1  # classes that share a token the sketch can't tell from a unique one, on average
FAR = 208  # signature bits; unrelated sets of any size differ in about 256 of 512, with a deviation of 11
_LOG = 8  # steps a doubling of the frequency in the broadcast sketch


def _sets(words: Words, shingle: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text of a block."""
    one = words.hashes(0)
    all_of = words.windows(shingle, one, 0)
    for a, b in zip(words.first_word[:-1], words.first_word[1:], strict=True):
        if b - a >= shingle:
            yield np.unique(all_of[a : b - shingle + 1])
        elif b > a:
            yield words.windows(b - a, one[a:b], 0)
        else:
            yield np.zeros(0, np.uint64)


def _class(found: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None


def _signature(found: np.ndarray) -> np.ndarray:
    """Parities of the shingles that fall on each of 512 bits: two sets' signatures differ in at most |x - y| + |y - x| bits."""
    odd = np.bincount((mix(found) >> np.uint64(55)).astype(np.int64), minlength=512) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)


def _counters(found: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(width - 1)
    return (found & mask).astype(np.int64), ((found >> np.uint64(32)) & mask).astype(np.int64) + width


_ROW = "id long, row long, n long, c binary, " + ", ".join(f"{s} long" for s in SIG) + ", chunk int, counts binary"
_ROW_SCHEMA = pa.schema(
    [("id", pa.int64()), ("row", pa.int64()), ("n", pa.int64()), ("c", pa.binary()), *((s, pa.int64()) for s in SIG), ("chunk", pa.int32()), ("counts", pa.binary())]
)


def _describe(shingle: int, width: int):
    """Rows of two kinds: each text's class and signature, and the partition's sketch in chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(2 * width, np.uint32)
        for batch in batches:
            for i, j, words in blocks(batch.column("text"), lower=True):
                sizes, classes, signatures, all_sets = [], [], [], []
                for found in _sets(words, shingle):
                    sizes.append(len(found))
                    classes.append(_class(found))
                    signatures.append(_signature(found))
                    all_sets.append(found)
                for at in _counters(np.concatenate(all_sets), width):
                    np.add.at(sketch, at, 1)
                part, n = batch.slice(i, j - i), j - i
                sig = np.stack(signatures)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("row"), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary())]
                    + [pa.array(np.ascontiguousarray(sig[:, k])) for k in range(8)]
                    + [pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())],
                    schema=_ROW_SCHEMA,
                )
        step = min(CHUNK, 2 * width)
        parts = [(k // step, sketch[k : k + step]) for k in range(0, 2 * width, step) if sketch[k : k + step].any()]
        if parts:
            n = len(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(n, f.type) for f in _ROW_SCHEMA][:12]
                + [pa.array([k for k, _ in parts], pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for _, x in parts], pa.binary())],
                schema=_ROW_SCHEMA,
            )

    return task(run)


def _sum_chunks(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(zlib.decompress(x), np.uint32).astype(np.uint64) for x in pdf["counts"])
    level = np.minimum(255, np.floor(_LOG * np.log2(np.maximum(total, 1)))).astype(np.uint8)
    return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "levels": [level.tobytes()]})


def _frequencies(described: DataFrame, width: int) -> np.ndarray:
    """The summed sketch, one byte a counter: _LOG * log2 of the count."""
    step = min(CHUNK, 2 * width)
    out = np.zeros(2 * width, np.uint8)
    chunks = described.where("chunk is not null").select("chunk", "counts")
    for chunk, levels in chunks.groupBy("chunk").applyInPandas(_sum_chunks, "chunk int, levels binary").collect():
        out[chunk * step : (chunk + 1) * step] = np.frombuffer(levels, np.uint8)
    return out


def _prefix(found: np.ndarray, levels: np.ndarray, width: int, percent: int, floor: float) -> tuple[np.ndarray, int]:
    """The shingles of the prefix in order, and how many of them a partner has to share."""
    a, b = _counters(found, width)
    level = np.minimum(levels[a], levels[b])
    order = np.argsort(level, kind="stable")
    n = len(found)
    need = -(-percent * n // 100)
    most = min(MAX_MATCHES, need)
    length = n - need + np.arange(1, most + 1)
    touched = np.cumsum(np.maximum(2.0 ** (level[order[: length[-1]]] / _LOG) - floor, PARTNERS))[length - 1]
    matches = np.arange(1, most + 1)
    cost = touched * (1 + (1 + n / 64) / matches) + matches
    best = int(np.argmin(cost))
    return found[order[: length[best]]], best + 1


def _index(shingle: int, width: int, percent: int, floor: float, sketch):
    """Index entries of each class that is new to the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, seen = sketch.value, set()
        for batch in batches:
            for _, _, words in blocks(batch.column("text"), lower=True):
                tokens, classes, counts, places, sizes, matches = [], [], [], [], [], []
                for found in _sets(words, shingle):
                    c = _class(found)
                    if c is None or c in seen:
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(c)
                    prefix, least = _prefix(found, levels, width, percent, floor)
                    tokens.append(prefix)
                    classes.append(c)
                    counts.append(len(prefix))
                    places.append(np.arange(len(prefix)))
                    sizes.append(len(found))
                    matches.append(least)
                if not tokens:
                    continue
                at = np.repeat(np.arange(len(counts)), counts)
                info = (np.array(sizes, np.int64) << 28 | np.array(matches, np.int64) << 24)[at] | np.minimum(np.concatenate(places), (1 << 24) - 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(np.concatenate(tokens))), pa.array(classes, pa.binary()).take(pa.array(at)), pa.array(info)], ["token", "c", "info"]
                )

    return task(run)


def _extract(shingle: int, wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        for batch in batches:
            at = batch.column("bit").to_numpy(zero_copy_only=False) - 1
            hit = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            for _, _, words in blocks(batch.column("text").filter(pa.array(hit)), lower=True):
                found = [x for x in _sets(words, shingle) if len(x)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_class(x) for x in found], pa.binary()), pa.array([x.tobytes() for x in found], pa.binary())], ["c", "shingles"]
                )

    return task(run)


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    return task(run)


def _differ(a: str, b: str) -> Column:
    """Signature bits in which two entries ``a`` and ``b`` (prefixes of their columns) differ."""
    bits = [F.bit_count(F.col(f"{a}{s}").bitwiseXOR(F.col(f"{b}{s}"))) for s in SIG]
    return sum(bits[1:], bits[0])


def _close(a: str, b: str, percent: int) -> Column:
    """Length and signature bounds of two entries."""
    n, m = F.col(f"{a}n"), F.col(f"{b}n")
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (_differ(a, b) * (100 + percent) <= (n + m) * (100 - percent))


def _with_partners(entries: DataFrame, percent: int) -> DataFrame:
    """Entries without those of small buckets that no other entry of the bucket could link with, by all bounds.

    Most buckets hold two or three classes that share a common phrase; larger ones are left as they are.
    """
    order = Window.partitionBy("token").orderBy("n", "c")
    out = entries.withColumn("held", F.count("*").over(Window.partitionBy("token")))
    met = F.lit(False)
    for step in range(1, SMALL):
        for tag, shift in ((f"b{step}", F.lag), (f"a{step}", F.lead)):
            out = out.withColumn(tag, shift(F.struct("n", *SIG), step).over(order))
            met = met | F.coalesce(_close("", f"{tag}.", percent), F.lit(False))
    return out.where((F.col("held") > SMALL) | met).select(*entries.columns)


def _open(entries: DataFrame, bucket) -> DataFrame:
    """Entries of those buckets that hold more than one component."""
    return entries.withColumn("lo", F.min("label").over(bucket)).withColumn("hi", F.max("label").over(bucket)).where("lo != hi").drop("lo", "hi")


def _closest_hubs(entries: DataFrame, bucket, percent: int, turn: int) -> DataFrame:
    """Pairs (x, y) of each class and the likest hub of its buckets that lies in another component.

    A bucket's hub is one of its classes, drawn by hash anew in each turn and bucket.
    """
    hub = F.min(F.struct(F.xxhash64("c", "token", F.lit(turn)).alias("draw"), "c", "n", "label", *SIG)).over(bucket)
    met = entries.withColumn("hub", hub).where("label != hub.label")
    met = met.select("c", "n", *SIG, F.col("hub.c").alias("_c"), F.col("hub.n").alias("_n"), *(F.col(f"hub.{s}").alias(f"_{s}") for s in SIG))
    # what looks unrelated is left to the exact join, which asks for shared tokens first
    met = met.where(_close("", "_", percent) & (_differ("", "_") <= FAR)).withColumn("far", _differ("", "_") / (F.col("n") + F.col("_n")))
    best = met.groupBy("c").agg(F.min(F.struct("far", "_c")).alias("best")).select("c", F.col("best._c").alias("_c"))
    return best.select(F.least("c", "_c").alias("x"), F.greatest("c", "_c").alias("y")).distinct()


class _Verifier:
    """Exact links among candidate pairs (x, y) of classes."""

    def __init__(self, rows: DataFrame, classes: DataFrame, shingle: int, percent: int, bits: int):
        self.rows, self.classes, self.shingle, self.percent, self.bits = rows, classes, shingle, percent, bits

    def __call__(self, pairs: DataFrame) -> DataFrame:
        sc = pairs.sparkSession.sparkContext
        ends = pairs.select(F.col("x").alias("c")).unionByName(pairs.select(F.col("y").alias("c"))).distinct()
        rows = ends.join(self.classes.select("c", "row"), "c")
        held = sc.broadcast(np.frombuffer(bytes(bloom(rows, F.col("row"), self.bits)), np.uint8))
        texts = self.rows.where("id is not null").withColumn("bit", bloom_position(F.col("row"), self.bits)).select("text", "bit")
        sets = cut(texts.mapInArrow(_extract(self.shingle, held), "c binary, shingles binary"), "sets")
        held.unpersist()
        left = pairs.join(sets.select(F.col("c").alias("x"), F.col("shingles").alias("a")), "x")
        both = left.join(sets.select(F.col("c").alias("y"), F.col("shingles").alias("b")), "y").select("x", "y", "a", "b")
        links = cut(both.mapInArrow(_verify(self.percent), "x binary, y binary").distinct(), "links")
        discard(sets)
        return links


def row_key(id_col: str | Column, text_col: str | Column) -> Column:
    """A hash of a row's id (long) and text (null as empty)."""
    return F.xxhash64(id_col, text_col)


def ngram_jaccard_join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, max_counters: int = 1 << 20, filter_bits: int = 1 << 26, row_keys: bool = False
) -> DataFrame:
    """(``id_col``, n_shingles, component_id) of each row; rows link when their sets' Jaccard similarity is percent/100 or more.

    ``row_keys`` adds row_key, a hash of id and text by which rows that share an id are told apart, and component_row,
    that of the component's first row: smallest id, then key.

    Words are lower-cased (A-Z) runs of anything but space and 0x09-0x0D; a text of fewer words than ``shingle`` has
    its whole sequence as its one shingle.  component_id is the smallest id reachable by links.

    Defined cases: a null or empty text has an empty set, links with nothing and is its own component; a row without
    an id takes no part and has a null component; rows that share an id are compared each by its own text; equal rows
    get equal results; an empty table gives an empty result; other columns are ignored.
    """
    sc = docs.sparkSession.sparkContext
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("row", row_key("id", "text"))
    size = input_bytes(docs)
    width = power_of_two(size / 128, 1 << 12, max_counters)
    bits = power_of_two(size / 64, 1 << 15, filter_bits)

    described = cut(rows.mapInArrow(_describe(shingle, width), _ROW), "described")
    texts = described.where("chunk is null")
    levels = _frequencies(described, width)
    floor = float(2.0 ** (np.median(levels) / _LOG)) if len(levels) else 1.0
    sketch = sc.broadcast(levels)
    linkable = texts.where("c is not null and id is not null")
    classes = cut(linkable.groupBy("c").agg(F.min(F.struct("id", "row")).alias("first"), F.min("row").alias("row"), F.min("n").alias("n"), *(F.min(s).alias(s) for s in SIG)), "classes")

    index = rows.where("id is not null").select("text").mapInArrow(_index(shingle, width, percent, floor, sketch), "token long, c binary, info long")
    bucket = Window.partitionBy("token")
    # in a bucket sorted by size, an entry has a partner of fitting size only if a neighbour fits
    by_size = bucket.orderBy("info", "c")
    size_of = lambda c: F.shiftright(c, 28)
    fits = F.coalesce(100 * size_of(F.lag("info").over(by_size)) >= percent * size_of("info"), F.lit(False)) | F.coalesce(
        100 * size_of("info") >= percent * size_of(F.lead("info").over(by_size)), F.lit(False)
    )
    shared = index.withColumn("fits", fits).withColumn("lo", F.min("c").over(bucket)).withColumn("hi", F.max("c").over(bucket)).where("fits and lo != hi").drop("fits", "lo", "hi")
    shared = shared.dropDuplicates(["token", "c"]).select(
        "token", "c", F.shiftright("info", 28).alias("n"), F.shiftright("info", 24).bitwiseAND(15).alias("least"), F.col("info").bitwiseAND((1 << 24) - 1).alias("place")
    )
    entries = cut(_with_partners(shared.join(classes.select("c", *SIG), "c").withColumn("label", F.col("c")), percent), "entries")
    sketch.unpersist()

    verify = _Verifier(rows, classes, shingle, percent, bits)
    links = known = None
    open_ = entries
    for turn in range(STAR_ROUNDS):
        tried = cut(_closest_hubs(open_, bucket, percent, turn), "tried")
        if known is not None:
            tried = cut(tried.join(known, ["x", "y"], "left_anti"), "tried")
        if tried.isEmpty():
            break
        known = tried if known is None else known.unionByName(tried)
        found = verify(tried)
        gained = found.count()
        links = found if links is None else links.unionByName(found)
        labels = components(links)
        old = open_
        open_ = cut(_open(open_.drop("label").join(labels.withColumnRenamed("v", "c"), "c", "left").withColumn("label", F.coalesce("label", "c")), bucket), "open")
        discard(old)
        if turn == 0:
            first = gained
        elif gained * 10 < first:  # what is left is left to the exact join
            break
    x = open_.select(*(F.col(c).alias(f"x_{c}") for c in open_.columns))
    y = open_.select(*(F.col(c).alias(f"y_{c}") for c in open_.columns))
    n, m, p, q = (F.col(c) for c in ("x_n", "y_n", "x_place", "y_place"))
    bound = F.least(p, q) + 1 + F.least(n - p - 1, m - q - 1)
    far = (F.col("x_token") == F.col("y_token")) & (F.col("x_c") < F.col("y_c")) & (F.col("x_label") != F.col("y_label"))
    pairs = x.join(y, far & _close("x_", "y_", percent) & (bound * (100 + percent) >= percent * (n + m)))
    pairs = pairs.groupBy(F.col("x_c").alias("x"), F.col("y_c").alias("y")).agg(F.count("*").alias("both"), F.min(F.least("x_least", "y_least")).alias("least"))
    pairs = pairs.where("both >= least").select("x", "y")
    if known is not None:
        pairs = pairs.join(known, ["x", "y"], "left_anti")
    rest = cut(pairs, "rest")
    discard(open_)
    if not rest.isEmpty():
        found = verify(rest)
        links = found if links is None else links.unionByName(found)
    labels = components(links if links is not None else rest)

    named = classes.select("c", "first").join(labels.withColumnRenamed("v", "c"), "c", "left").withColumn("label", F.coalesce("label", "c"))
    smallest = named.groupBy("label").agg(F.min("first").alias("top"))
    result = cut(named.join(smallest, "label").select("c", "top"), "components")
    discard(classes)
    out = texts.select("id", "row", "n", "c").join(result, "c", "left")
    of_some = F.col("id").isNotNull()
    keys = [F.col("row").alias("row_key"), F.when(of_some, F.coalesce("top.row", "row")).alias("component_row")]
    component = F.when(of_some, F.coalesce("top.id", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), *(keys if row_keys else []))
