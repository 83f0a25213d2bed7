"""Sites: every place where a motif's PAM fits, as oriented strings.

Contigs are cut into tiles with enough context on both sides.  A genome of few long contigs is dealt out by tile
(``deal``), so that one contig is scanned by many tasks; many short contigs are scanned where they are read, without a
shuffle.  Tiles are scanned in Arrow batches with array operations; a window is kept if every letter is compatible with the
motif and at most ``ambig_max`` letters of it are ambiguous.  All sites read from the letter next to the PAM outwards,
guide part first and ``distance`` letters of extension last, padded with '-' at a contig's ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dna import is_ambiguous
from ..motif import COMPLEMENT_FROM, COMPLEMENT_TO, MASKS, Motif

TILE = 1 << 15
_MASK = np.zeros(256, np.uint8)
for _letter, _bases in MASKS.items():
    _MASK[ord(_letter)] = _bases
_CERTAIN = np.isin(np.arange(256), list(b"ACGT"))
_COMPLEMENT = np.arange(256, dtype=np.uint8)
_COMPLEMENT[list(COMPLEMENT_FROM.encode())] = list(COMPLEMENT_TO.encode())


def tiles(contigs: DataFrame, context: int, size: int = TILE, deal: int | None = None) -> DataFrame:
    """(chrom, n, lo, hi, at, lead, tile): slices of ``size`` letters from ``at`` (0-based) and ``context`` letters on both sides.

    ``lead`` letters of the tile stand before ``at``; lo and hi are the 1-based first and last letters that aren't N.
    With ``deal`` tiles are dealt to so many tasks, else they stay with their contig.
    """
    chunks = F.regexp_extract_all("seq", F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    cut = contigs.withColumn("lo", F.char_length("seq") - F.char_length(F.ltrim("seq", F.lit("N"))) + 1).withColumn("hi", F.char_length(F.rtrim("seq", F.lit("N"))))
    cut = cut.withColumn("chunks", chunks).select("chrom", "n", "lo", "hi", "chunks", F.posexplode("chunks").alias("k", "chunk"))
    near = lambda step: F.coalesce(F.get("chunks", F.col("k") + step), F.lit(""))
    if context > size:
        raise ValueError("tiles must be longer than their context")
    lead, tail = F.right(near(-1), F.lit(context)), F.left(near(1), F.lit(context))
    out = cut.select("chrom", "n", "lo", "hi", (F.col("k") * F.lit(size)).cast("long").alias("at"), F.char_length(lead).alias("lead"), F.concat(lead, "chunk", tail).alias("tile"), F.char_length("chunk").alias("size"))
    return out.repartition(deal, "chrom", "at") if deal else out


def _fit(data: np.ndarray, pattern: str, ambig_max: int) -> np.ndarray:
    """0-based starts of windows that fit the pattern."""
    m = len(pattern)
    n = len(data) - m + 1
    if n <= 0 or not m:
        return np.zeros(0, np.int64)
    bases = _MASK[data]
    ok = np.ones(n, bool)
    for i, letter in enumerate(pattern):
        if letter != "N":
            ok &= (bases[i : i + n] & _MASK[ord(letter)]) != 0
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~_CERTAIN[data], out=total[1:])
    ok &= total[m:] - total[:-m] <= ambig_max
    if ambig_max:  # a gap fits nothing, N neither
        gaps = np.zeros(len(data) + 1, np.int64)
        np.cumsum(bases == 0, out=gaps[1:])
        ok &= gaps[m:] == gaps[:-m]
    return np.flatnonzero(ok)


def _scan_tile(data: np.ndarray, row: dict, motif: Motif, minus: bool, whole: bool) -> tuple[np.ndarray, np.ndarray] | None:
    """(1-based starts in the contig, letters of the sites) of one strand of a tile."""
    pattern = motif.rve if minus else motif.fwd
    p, guide, d = len(motif.pam), motif.length_no_pam, motif.distance
    at, lead, m = row["at"], row["lead"], len(pattern)
    found = _fit(data, pattern, motif.ambig_max)
    left = found - lead + at  # 0-based in the contig
    widen_left = minus != motif.extends5
    lo = max(1, row["lo"] - d) if widen_left else row["lo"]
    hi = row["hi"] if widen_left else min(row["n"], row["hi"] + d)
    keep = (found >= lead) & (found < lead + row["size"]) & (left + 1 >= lo) & (left + m <= hi)
    found, left = found[keep], left[keep]
    if not len(found):
        return None
    outwards_left = minus != motif.extends5  # the guide part lies left of the PAM
    if whole:
        steps = np.arange(m) if not minus else np.arange(m)[::-1]
        place = found[:, None] + steps
    else:
        length = guide + d
        place = found[:, None] + guide - 1 - np.arange(length) if outwards_left else found[:, None] + p + np.arange(length)
    inside = (place >= 0) & (place < len(data)) & (place + (at - lead) >= 0) & (place + (at - lead) < row["n"])
    letters = np.where(inside, data[np.clip(place, 0, len(data) - 1)], ord("-")).astype(np.uint8)
    if minus:
        letters = _COMPLEMENT[letters]
    return (left + m if outwards_left else left + 1), letters


def _fixed(letters: np.ndarray) -> pa.Array:
    """Equally long strings from a matrix of letters."""
    n, width = letters.shape
    return pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int64).tobytes()), pa.py_buffer(letters.tobytes())]).cast(pa.string())


def scan(tiled: DataFrame, motif: Motif, whole: bool = False) -> DataFrame:
    """(chrom, start, strand, site) of tiles; with ``whole``, the window with its PAM in 5' to 3' order instead."""
    strands = [s for s, on in ((False, motif.forward), (True, motif.reverse)) if on]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.drop_columns(["tile"]).to_pylist()
            for row, tile in zip(rows, batch.column("tile"), strict=True):
                data = np.frombuffer(tile.as_buffer(), np.uint8)
                for minus in strands:
                    found = _scan_tile(data, row, motif, minus, whole)
                    if found is not None:
                        start, letters = found
                        n = len(start)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([row["chrom"]]).take(pa.array(np.zeros(n, np.int64))), pa.array(start), pa.array(["-" if minus else "+"]).take(pa.array(np.zeros(n, np.int64))), _fixed(letters)],
                            ["chrom", "start", "strand", "site"],
                        )

    return tiled.mapInArrow(run, "chrom string, start long, strand string, site string")


def sites(contigs: DataFrame, motif: Motif, tile: int = TILE, deal: int | None = None) -> DataFrame:
    """(chrom, start, strand, site, is_ambig): all sites of both strands; ``deal`` as for ``tiles``.

    ``start`` is the 1-based outer edge of the PAM.  is_ambig tells of letters or padding other than ACGT.
    """
    context = len(motif) + motif.distance
    found = scan(tiles(contigs, context, max(tile, context), deal), motif)
    return found.withColumn("is_ambig", is_ambiguous("site"))


def guide_windows(contigs: DataFrame, motif: Motif) -> DataFrame:
    """(chrom, start, strand, window): whole windows with their PAM, 5' to 3' on their strand."""
    context = len(motif) + motif.distance
    return scan(tiles(contigs, context, max(TILE, context)), motif, whole=True).withColumnRenamed("site", "window")


def distinct_sites(found: DataFrame, length: int | None = None, certain_only: bool = False) -> DataFrame:
    """(site, n): distinct sites, cut to ``length`` letters if given, and how often each occurs."""
    rows = found.where("not is_ambig") if certain_only else found
    key = F.col("site") if length is None else F.substring("site", 1, length)
    return rows.groupBy(key.alias("site")).agg(F.count("*").alias("n"))


def pam_positions(contigs: DataFrame, motif: Motif) -> DataFrame:
    """(chrom, pos, strand): the PAM's edge next to the guide, wherever the PAM fits without ambiguous letters."""
    p = len(motif.pam)
    # a motif of the PAM alone, read outwards, with no guide part to keep in bounds
    alone = Motif(motif.alias, "X" * p, motif.pam, motif.forward, motif.reverse, 0, True, 0)
    found = scan(tiles(contigs, p, TILE), alone, whole=True)
    # on + the window's start is its right edge, on - its left edge; the guide lies left of a 3' PAM
    shift = 0 if not motif.extends5 else p - 1
    inner = F.when(F.col("strand") == "+", F.col("start") - shift).otherwise(F.col("start") + shift)
    return found.select("chrom", inner.alias("pos"), "strand")


def all_sites(contigs: DataFrame, motif: Motif, remove_pam: bool = True, normalize: bool = True, length: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(certain, ambiguous) sites; without ``normalize`` they read 5' to 3', and with the PAM if it isn't removed."""
    if normalize and remove_pam:
        found = sites(contigs, motif)
    else:
        found = guide_windows(contigs, motif).withColumnRenamed("window", "site")
        if remove_pam:
            n = motif.length_no_pam
            found = found.withColumn("site", F.left("site", F.lit(n)) if motif.extends5 else F.right("site", F.lit(n)))
        elif normalize and motif.extends5:
            found = found.withColumn("site", F.reverse("site"))
        found = found.withColumn("is_ambig", is_ambiguous("site"))
    if length is not None:
        found = found.withColumn("site", F.substring("site", 1, length)).withColumn("is_ambig", is_ambiguous("site"))
    return found.where("not is_ambig"), found.where("is_ambig")
