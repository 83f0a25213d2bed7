"""Search: guides joined with sites whose free-end edit distance is at most k.

All strategies give the same rows.  They differ in how candidates are found:

* ``nested_loop``: every guide with every distinct site; guides are broadcast when their number is checked to be small.
* ``seed``: k + 1 disjoint pieces of the guide; one of them must stand whole in the site, at most k letters off.
* ``qgram``: adjacent chunks of the guide; all but k of them must stand in the site, at most k letters off.
* ``neighbourhood``: all beginnings of a site within k edits are listed and looked up.
* ``auto``: nested_loop for few guides, else seed, or nested_loop where a guide has too few letters for pieces.

Distances are counted once for each pair of guide and distinct site; loci are joined on afterwards.  Sites with
letters other than ACGT are few; they are compared under IUPAC matching in Arrow batches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.align import align, masked_distance
from ..functions.dna import free_end_distance, hamming
from ..functions.neighbours import with_neighbours
from ..motif import Motif

FEW_GUIDES = 200
STRATEGIES = ("auto", "nested_loop", "seed", "qgram", "neighbourhood")
HIT_COLUMNS = ("guide", "alignment_guide", "alignment_reference", "distance", "chromosome", "start", "strand")


def oriented(guides: DataFrame, motif: Motif) -> DataFrame:
    """(guide, q): distinct guides and how they read along sites."""
    q = F.reverse("guide") if motif.extends5 else F.col("guide")
    return guides.select(F.upper("guide").alias("guide")).where("guide is not null").distinct().select("guide", q.alias("q"))


def check_guides(guides: DataFrame, motif: Motif, k: int, concrete: bool = False) -> int:
    """The number of guides, after looking for ones that can't be searched; only a bad one comes to the driver."""
    motif.check_guides([], k)
    letters = "^[ACGT]*$" if concrete else "^[ACGTRYSWKMBDHVN]*$"
    bad = guides.where((F.char_length("guide") != motif.length_no_pam) | ~F.upper("guide").rlike(letters)).select(F.upper("guide")).first()
    if bad is not None:
        motif.check_guides([bad[0]], k, concrete)
    return guides.count()


def _small(df: DataFrame, n: int) -> DataFrame:
    """Broadcast what is known to be small; leave the choice to the optimizer otherwise."""
    return F.broadcast(df) if n <= FEW_GUIDES else df


def pieces(length: int, k: int) -> list[tuple[int, int]]:
    """(0-based start, length) of k + 1 disjoint pieces of a guide."""
    size, rest = divmod(length, k + 1)
    out, at = [], 0
    for i in range(k + 1):
        n = size + (i < rest)
        out.append((at, n))
        at += n
    return out


def _placed(site: Column, start: int, n: int, k: int, width: int) -> Column:
    """array<struct<word>>: the site's words that a guide's piece may have moved to."""
    at = [start + s for s in range(-k, k + 1) if 0 <= start + s and start + s + n <= width]
    return F.array_distinct(F.array(*(F.substring(site, a + 1, n) for a in at)))


def _chunk_keys(guides: DataFrame, sites: DataFrame, chunks: list[tuple[int, int]], k: int, width: int) -> tuple[DataFrame, DataFrame]:
    q = F.array(*(F.struct(F.lit(i).alias("piece"), F.substring("q", a + 1, n).alias("word")) for i, (a, n) in enumerate(chunks)))
    left = guides.select("guide", "q", F.inline(q))

    def words(piece: int, start: int, n: int) -> Column:
        return F.transform(_placed(F.col("site"), start, n, k, width), lambda w: F.struct(F.lit(piece).alias("piece"), w.alias("word")))

    right = sites.select("site", F.inline(F.concat(*(words(i, a, n) for i, (a, n) in enumerate(chunks)))))
    return left, right


def candidates(guides: DataFrame, sites: DataFrame, motif: Motif, k: int, strategy: str, n_guides: int, hash_length: int | None = None) -> DataFrame:
    """(guide, q, site): pairs that may be within k edits; none within k is missing."""
    length, width = motif.length_no_pam, motif.length_no_pam + motif.distance
    if strategy == "nested_loop":
        return _small(guides, n_guides).join(sites.select("site"), F.lit(True))
    if strategy == "seed":
        left, right = _chunk_keys(guides, sites, pieces(length, k), k, width)
        return right.join(_small(left, n_guides), ["piece", "word"]).select("guide", "q", "site").distinct()
    if strategy == "qgram":
        size = max(1, length // (k + 3))
        chunks = [(a, size) for a in range(0, length - size + 1, size)]
        left, right = _chunk_keys(guides, sites, chunks, k, width)
        met = right.join(_small(left, n_guides), ["piece", "word"]).groupBy("guide", "q", "site").agg(F.count_distinct("piece").alias("met"))
        return met.where(F.col("met") >= len(chunks) - k).select("guide", "q", "site")
    if strategy == "neighbourhood":
        h = min(hash_length or min(length - k, 16), width)
        keys = with_neighbours(guides, k, h)
        keyed = sites.select("site", F.substring("site", 1, h).alias("key"))
        return keyed.join(keys, "key").select("guide", "q", "site")
    raise ValueError(f"unknown strategy {strategy}; known: {', '.join(STRATEGIES)}")


def search(
    sites: DataFrame,
    guides: DataFrame,
    motif: Motif,
    distance: int | None = None,
    strategy: str = "auto",
    alignments: bool = True,
    strip: bool = True,
    hash_length: int | None = None,
    extra: tuple[str, ...] = (),
    mismatch_only: bool = False,
) -> DataFrame:
    """Hits of guides among ``sites``: HIT_COLUMNS and any ``extra`` columns of sites.

    ``alignments``: fill in the aligned strings (Arrow, over hits only), else null.  ``strip`` chooses between the two
    styles of alignment; see ``functions.align``.  ``mismatch_only``: letters may differ, but none may be added or left out.
    Guides with ambiguous letters are compared under IUPAC matching with every site.
    """
    k = motif.distance if distance is None else distance
    n = check_guides(guides, motif, k)
    q = oriented(guides, motif)
    certain, odd = q.where(q["q"].rlike("^[ACGT]*$")), q.where(~q["q"].rlike("^[ACGT]*$"))
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}; known: {', '.join(STRATEGIES)}")
    if strategy == "auto":
        strategy = "nested_loop" if n <= FEW_GUIDES or motif.length_no_pam < 2 * (k + 1) else "seed"
    different = sites.groupBy("site", "is_ambig").agg(F.lit(1).alias("one")).drop("one")
    plain, unclear = different.where("not is_ambig"), different.where("is_ambig")
    length = motif.length_no_pam
    near = hamming("q", F.substring("site", 1, length)) if mismatch_only else free_end_distance("q", "site", length, k)
    pairs = candidates(certain, plain, motif, k, strategy, n, hash_length).withColumn("distance", near.cast("int")).where(F.col("distance") <= k)
    masked = hamming("q", F.substring("site", 1, length)) if mismatch_only else masked_distance(F.col("q"), F.col("site"), k)
    loose = _small(q, n).join(unclear.select("site"), F.lit(True)).unionByName(_small(odd, n).join(plain.select("site"), F.lit(True)))
    pairs = pairs.select("guide", "q", "site", "distance").unionByName(loose.withColumn("distance", masked.cast("int")).where(F.col("distance") <= k).select("guide", "q", "site", "distance"))
    if alignments:
        told = pairs.withColumn("aln", align(F.col("q"), F.col("site"), k, strip=strip))
        flip = F.reverse if motif.extends5 else (lambda c: c)
        pairs = told.select("guide", "site", "distance", flip(F.col("aln.aln_guide")).alias("alignment_guide"), flip(F.col("aln.aln_ref")).alias("alignment_reference"))
    else:
        none = F.lit(None).cast("string")
        pairs = pairs.select("guide", "site", "distance", none.alias("alignment_guide"), none.alias("alignment_reference"))
    hits = sites.select("site", F.col("chrom").alias("chromosome"), "start", "strand", *extra).join(pairs, "site")
    return hits.select(*HIT_COLUMNS, *extra)


def exact_search(windows: DataFrame, guides: DataFrame, motif: Motif) -> DataFrame:
    """Hits without any edit among whole windows with their PAM: an equi-join on the guide's letters."""
    letters = F.left("window", F.lit(motif.length_no_pam)) if motif.extends5 else F.right("window", F.lit(motif.length_no_pam))
    return windows.withColumn("guide", letters).join(oriented(guides, motif), "guide").select("guide", F.lit(0).alias("distance"), F.col("chrom").alias("chromosome"), "start", "strand")


def early_stop(hits: DataFrame, limits: list[int]) -> DataFrame:
    """Hits up to and with the one by which a guide reaches its limit at some distance; a limit of 0 counts as 1.

    Traversal is by distance, chromosome, start and strand.  ``limits`` has a number for each distance from 0.
    """
    if not limits:
        raise ValueError("there must be a limit for each distance")
    order = [F.col(c) for c in ("distance", "chromosome", "start", "strand")]
    limit = F.element_at(F.array(*(F.lit(max(1, x)) for x in limits)), F.col("distance") + 1)
    walk = Window.partitionBy("guide").orderBy(*order)
    numbered = hits.where(F.col("distance") < len(limits)).withColumn("step", F.row_number().over(walk))
    numbered = numbered.withColumn("seen", F.row_number().over(Window.partitionBy("guide", "distance").orderBy("step")))
    stop = F.min(F.when(F.col("seen") >= limit, F.col("step"))).over(Window.partitionBy("guide"))
    return numbered.withColumn("stop", stop).where("stop is null or step <= stop").drop("step", "seen", "stop")


def cap_per_distance(hits: DataFrame, limits: list[int]) -> DataFrame:
    """At most ``limits[d]`` hits of a guide at distance d, in the order of ``early_stop``."""
    limit = F.element_at(F.array(*(F.lit(x) for x in limits)), F.col("distance") + 1)
    own = Window.partitionBy("guide", "distance").orderBy("chromosome", "start", "strand")
    return hits.where(F.col("distance") < len(limits)).withColumn("seen", F.row_number().over(own)).where(F.col("seen") <= limit).drop("seen")


def suppress_shifted(hits: DataFrame) -> DataFrame:
    """Drop a hit if one of a smaller distance is no farther from it than their distances differ (same guide, strand, contig)."""
    item = F.struct("distance", "start")
    kept = F.aggregate(
        F.array_sort(F.collect_list(item)),
        F.array().cast("array<struct<distance:int,start:bigint>>"),
        lambda acc, x: F.when(F.exists(acc, lambda y: F.abs(y["start"] - x["start"]) <= x["distance"] - y["distance"]), acc).otherwise(F.concat(acc, F.array(x))),
    )
    return hits.groupBy("guide", "chromosome", "strand").agg(kept.alias("kept")).select("guide", "chromosome", "strand", F.inline("kept"))


def near_positions(left: DataFrame, right: DataFrame, reach: int) -> DataFrame:
    """(chrom, pos, near): positions of ``right`` within ``reach`` of one of ``left`` (both chrom, pos): an equi-join on bins."""
    width = max(1, 2 * reach + 1)
    a = left.select("chrom", "pos", F.explode(F.array_distinct(F.array(*(F.floor((F.col("pos") + s) / width) for s in (-reach, reach))))).alias("bin"))
    b = right.select("chrom", F.col("pos").alias("near"), F.floor(F.col("pos") / width).alias("bin"))
    return a.join(b, ["chrom", "bin"]).where(F.abs(F.col("near") - F.col("pos")) <= reach).select("chrom", "pos", "near")


def nearest_position(left: DataFrame, right: DataFrame) -> DataFrame:
    """(chrom, pos, near): the last position of ``right`` at or before each of ``left``, null if there is none (as-of join)."""
    rows = left.select("chrom", "pos", F.lit(1).alias("own")).unionByName(right.select("chrom", "pos", F.lit(0).alias("own")))
    before = Window.partitionBy("chrom").orderBy("pos", "own").rowsBetween(Window.unboundedPreceding, 0)
    near = F.last(F.when(F.col("own") == 0, F.col("pos")), ignorenulls=True).over(before)
    return rows.withColumn("near", near).where("own = 1").select("chrom", "pos", "near")
