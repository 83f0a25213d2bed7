"""The engine's queries over the driver's tables, by name, and their DuckDB SQL.

The genome is derived from ``documents``: a contig for each text, letters turned into bases.  Guides are sites
themselves, the smallest of each of twelve classes of contigs, so that every search has hits.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import persistence
from ..functions import dna
from ..motif import CATALOG, COMPLEMENT_FROM, COMPLEMENT_TO, Motif, motif
from ..operators import estimate as est
from ..operators import post
from ..operators import ranges as rg
from ..operators import search as se
from ..operators import sites as si
from ..operators import text_index as ti
from ..operators import variants as va
from ..sources import contigs as co
from ..sources import tables as tb

GUIDE_CLASSES = 12
_built: dict[tuple, str] = {}
CAS9, CAS12A = motif("Cas9", 2), motif("Cas12a", 1)
LOOSE = motif("Cas9", 1, 2)
PATTERNS = ("GATTACA", "AAAA", "ACGT", "TTTT", "CCGGA")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _contigs(spark: SparkSession, sf_dir: str, digits: str | None = None) -> DataFrame:
    return co.derived_contigs(_documents(spark, sf_dir), digits=digits)


def _sites(spark: SparkSession, sf_dir: str, m: Motif = CAS9) -> DataFrame:
    return si.sites(_contigs(spark, sf_dir), m)


def _indexed(spark: SparkSession, sf_dir: str, m: Motif = CAS9) -> DataFrame:
    """The sites as a stored table: the index of searches, built by the session's first search of a genome."""
    key = spark.sparkContext.applicationId, sf_dir, m.alias, m.distance, m.ambig_max
    if key not in _built:
        path = f"{persistence.shared_dir(spark)}/sites-{uuid.uuid4().hex}"
        persistence.save(_sites(spark, sf_dir, m), path, m)
        _built[key] = path
    return persistence.load(spark, _built[key])[0]


def _chosen(spark: SparkSession, sites: DataFrame, m: Motif) -> DataFrame:
    """(guide): the smallest concrete site of each class of contigs, 5' to 3'; at most GUIDE_CLASSES of them."""
    site = F.substring("site", 1, m.length_no_pam)
    least = sites.where("not is_ambig").groupBy((F.col("chrom").cast("long") % GUIDE_CLASSES).alias("class")).agg(F.min(site).alias("q"))
    rows = least.select((F.reverse("q") if m.extends5 else F.col("q")).alias("guide")).distinct().collect()
    return spark.createDataFrame(rows, "guide string")


def _guides(spark: SparkSession, sf_dir: str, m: Motif = CAS9) -> DataFrame:
    return _chosen(spark, _indexed(spark, sf_dir, m), m)


def _plain(hits: DataFrame) -> DataFrame:
    return hits.select("guide", F.col("distance").cast("int").alias("distance"), "chromosome", "start", "strand")


def _hits(spark: SparkSession, sf_dir: str, strategy: str = "auto", k: int = 2, m: Motif = CAS9, **more) -> DataFrame:
    return _plain(se.search(_indexed(spark, sf_dir, m), _guides(spark, sf_dir, m), m, k, strategy, alignments=False, **more))


def _variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A substitution, an insertion and a deletion for each contig, placed by its length alone."""
    contigs = _contigs(spark, sf_dir)
    letter = lambda at: F.expr(f"substring(seq, int({at}), 1)")
    kinds = {
        0: ("n div 3 + 1", lambda p: letter(p), lambda p: F.translate(letter(p), "ACGT", "CGTA")),
        1: ("n div 3 + 4", lambda p: letter(p), lambda p: F.concat(letter(p), F.lit("GG"))),
        2: ("n div 2 + 1", lambda p: F.expr(f"substring(seq, int({p}), 2)"), lambda p: letter(p)),
    }
    parts = []
    for kind, (at, ref, alt) in kinds.items():
        rows = contigs.where("n >= 40")
        parts.append(rows.select((F.col("chrom_id").cast("long") * 3 + kind).alias("rec_no"), F.lit(".").alias("id"), "chrom", F.expr(at).alias("pos"), ref(at).alias("ref"), alt(at).alias("alt")))
    return tb.variants_of(parts[0].unionByName(parts[1]).unionByName(parts[2]))


def contig_lengths(spark, sf_dir):
    return _contigs(spark, sf_dir).select("chrom", "n")


def telomere_bounds(spark, sf_dir):
    return _contigs(spark, sf_dir, "N").select("chrom", dna.first_certain("seq").cast("long").alias("lo"), dna.last_certain("seq").cast("long").alias("hi"))


def pam_positions_cas9(spark, sf_dir):
    return si.pam_positions(_contigs(spark, sf_dir), CAS9)


def pam_positions_cas12a(spark, sf_dir):
    return si.pam_positions(_contigs(spark, sf_dir), CAS12A)


def sites_cas9_d2(spark, sf_dir):
    return _sites(spark, sf_dir)


def sites_cas12a_d1(spark, sf_dir):
    return _sites(spark, sf_dir, CAS12A)


def sites_ambig(spark, sf_dir):
    return si.sites(_contigs(spark, sf_dir, "N"), LOOSE)


def sites_prefix_suffix(spark, sf_dir):
    sites = _sites(spark, sf_dir).where("not is_ambig")
    return sites.groupBy(F.substring("site", 1, 7).alias("prefix")).agg(F.count("*").alias("n_sites"), F.count_distinct(F.expr("substring(site, 8)")).alias("n_suffixes"))


def site_counts(spark, sf_dir):
    return est.site_counts(_sites(spark, sf_dir))


def site_counts_capped(spark, sf_dir):
    return est.count_bins(est.site_counts(_sites(spark, sf_dir)), 10)


def search_nested_loop_d2(spark, sf_dir):
    return _hits(spark, sf_dir, "nested_loop")


def search_seed_d2(spark, sf_dir):
    return _hits(spark, sf_dir, "seed")


def search_qgram_d2(spark, sf_dir):
    return _hits(spark, sf_dir, "qgram")


def search_neighbourhood_d1(spark, sf_dir):
    return _hits(spark, sf_dir, "neighbourhood", 1)


def search_cas12a_d1(spark, sf_dir):
    return _hits(spark, sf_dir, "seed", 1, CAS12A)


def hamming_search(spark, sf_dir):
    return _hits(spark, sf_dir, "seed", 2, mismatch_only=True)


def exact_search(spark, sf_dir):
    return _plain(se.exact_search(si.guide_windows(_contigs(spark, sf_dir), CAS9), _guides(spark, sf_dir), CAS9))


def search_alignments(spark, sf_dir):
    return se.search(_indexed(spark, sf_dir), _guides(spark, sf_dir), CAS9, 2, "seed")


def alignment_letters(spark, sf_dir):
    """What alignments must keep: the guide's letters, letters that begin the site, and as many differing columns as edits."""
    sites = _indexed(spark, sf_dir)
    hits = se.search(sites, _guides(spark, sf_dir), CAS9, 2, "seed", extra=("site",))
    a, b = F.col("alignment_guide"), F.col("alignment_reference")
    differ = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y), lambda d: d))
    bare = lambda c: F.replace(c, F.lit("-"), F.lit(""))
    begins = F.startswith("site", F.reverse(bare(b))) if CAS9.extends5 else F.startswith("site", bare(b))
    return hits.select("guide", "distance", "chromosome", "start", "strand", bare(a).alias("letters"), differ.cast("int").alias("differing"), begins.alias("begins_site"))


def filter_overlapping_w23(spark, sf_dir):
    return post.filter_overlapping(_hits(spark, sf_dir), 23)


def summarize(spark, sf_dir):
    return post.summarize(_hits(spark, sf_dir), 2)


def search_pipeline(spark, sf_dir):
    """Flagship: sites, seeded search, overlap filter, summary."""
    return post.summarize(post.filter_overlapping(_hits(spark, sf_dir, "seed"), 23), 2)


def early_stop(spark, sf_dir):
    return se.early_stop(_hits(spark, sf_dir), [1, 2, 7])


def cap_per_distance(spark, sf_dir):
    return se.cap_per_distance(_hits(spark, sf_dir), [1, 5, 10])


def suppress_shifted(spark, sf_dir):
    return se.suppress_shifted(_hits(spark, sf_dir))


def dict_estimate_d1(spark, sf_dir):
    m = CAS9.with_distance(1)
    return est.estimate(est.site_counts(_indexed(spark, sf_dir, m)), _guides(spark, sf_dir, m), m, 1)


def hash_estimate_d1(spark, sf_dir):
    m = CAS9.with_distance(1)
    return est.right_or_left(est.site_counts(_indexed(spark, sf_dir, m)), _guides(spark, sf_dir, m), m, 2, 1)


def count_sketch(spark, sf_dir):
    return est.sketch_counts(_sites(spark, sf_dir)).select(F.length("sketch").cast("long").alias("sketch_bytes"), "total")


def anti_join_strategies(spark, sf_dir):
    """Hits of one strategy within two edits that another doesn't find within one: those of two edits."""
    keys = ["guide", "distance", "chromosome", "start", "strand"]
    return _hits(spark, sf_dir, "nested_loop", 2).join(_hits(spark, sf_dir, "seed", 1), keys, "left_anti")


def set_union_prefixes(spark, sf_dir):
    return _sites(spark, sf_dir).select(F.substring("site", 1, 7).alias("prefix")).distinct()


def kmers(spark, sf_dir):
    return ti.kmer_counts(_contigs(spark, sf_dir), 6)


def skipkmers(spark, sf_dir):
    return _contigs(spark, sf_dir).select(F.explode(dna.skipkmers("seq", 6)).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("n"))


def pack_2bit(spark, sf_dir):
    sites = _sites(spark, sf_dir).where("not is_ambig").select("site").distinct()
    packed = sites.select("site", dna.pack2("site").alias("packed"))
    return packed.select("site", "packed", dna.unpack2("packed", CAS9.length_no_pam + CAS9.distance).alias("again"))


def expand_ambiguous(spark, sf_dir):
    rows = si.sites(_contigs(spark, sf_dir, "R"), LOOSE).where("is_ambig and not contains(site, '-')").select("site").distinct()
    return rows.select("site", F.explode(dna.expand_ambiguous("site")).alias("spelling"))


def revcomp(spark, sf_dir):
    return _contigs(spark, sf_dir).select("chrom", F.md5(dna.reverse_complement("seq")).alias("digest"))


def text_count(spark, sf_dir):
    patterns = spark.createDataFrame([(p,) for p in PATTERNS], "pattern string")
    return ti.count(_contigs(spark, sf_dir), patterns)


def text_locate(spark, sf_dir):
    patterns = spark.createDataFrame([(p,) for p in PATTERNS], "pattern string")
    return ti.locate(_contigs(spark, sf_dir), patterns)


def rank_freq(spark, sf_dir):
    c = _contigs(spark, sf_dir)
    return ti.rank(c, "A", 100).withColumnRenamed("n", "rank_100").join(ti.frequency(c, "G", 50, 150).withColumnRenamed("n", "freq_50_150"), "chrom")


def select_jth(spark, sf_dir):
    return ti.select(_contigs(spark, sf_dir), "T", 25)


def symbol_counts(spark, sf_dir):
    return ti.symbol_counts(_contigs(spark, sf_dir))


def suffix_arrays(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").cast("string").alias("chrom"), "text")
    texts = items.select("chrom", co.dna_of(F.coalesce("text", F.lit(""))).alias("seq")).where("seq != ''")
    return ti.suffix_array(texts)


def variant_alleles(spark, sf_dir):
    return _variants(spark, sf_dir).select("rec_no", "id", "chrom", "pos", "stop", "ref", F.array_join("alts", ",").alias("alts"))


def variant_groups(spark, sf_dir):
    return va.variant_groups(_variants(spark, sf_dir), CAS9).select("rec_no", "chrom", "group_no")


def variant_haplotypes(spark, sf_dir):
    return va.haplotypes(_variants(spark, sf_dir), _contigs(spark, sf_dir), CAS9).select("chrom", "first", "seq", "variants")


def variant_sites(spark, sf_dir):
    return va.variant_sites(_variants(spark, sf_dir), _contigs(spark, sf_dir), CAS9)


def variant_search_d2(spark, sf_dir):
    found = va.variant_sites(_variants(spark, sf_dir), _contigs(spark, sf_dir), CAS9)
    path = f"{persistence.shared_dir(spark)}/variant-sites-{uuid.uuid4().hex}"
    persistence.save(found, path, CAS9)
    found = persistence.load(spark, path)[0]
    hits = se.search(found, _chosen(spark, found, CAS9), CAS9, 2, "seed", alignments=False, extra=("variants",))
    return hits.select("guide", F.col("distance").cast("int").alias("distance"), "chromosome", "start", "strand", "variants")


def run_ranges(spark, sf_dir):
    rows = _documents(spark, sf_dir).select("source", "doc_id", "lang")
    return rg.ranges(rows, "lang", "doc_id", ["source"]).select("source", "lang", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"))


def duplicate_sites(spark, sf_dir):
    ordered = _sites(spark, sf_dir).withColumn("at", F.struct(F.col("chrom").cast("long"), "start", "strand"))
    marked = rg.duplicated(ordered, ["site"], "at")
    return marked.groupBy("is_duplicate").agg(F.count("*").alias("n"))


def balance_lengths(spark, sf_dir):
    rows = _contigs(spark, sf_dir).select((F.col("chrom_id") % 7).cast("long").alias("part"), (F.floor(F.col("n") / 100)).cast("long").alias("size"))
    return rg.balance(rows, "size", ["part"])


def pam_within_reach(spark, sf_dir):
    pams = si.pam_positions(_contigs(spark, sf_dir), CAS12A)
    plus, minus = (pams.where(F.col("strand") == s).select("chrom", "pos") for s in "+-")
    return se.near_positions(plus, minus, 10)


def pam_before(spark, sf_dir):
    pams = si.pam_positions(_contigs(spark, sf_dir), CAS12A)
    plus, minus = (pams.where(F.col("strand") == s).select("chrom", "pos") for s in "+-")
    return se.nearest_position(plus, minus).withColumn("near", F.coalesce("near", F.lit(-1)))


def variant_overlaps(spark, sf_dir):
    sites = _sites(spark, sf_dir, CAS12A).select("chrom", "start", (F.col("start") + 24).alias("stop")).where("strand = '+'")
    ranges = _variants(spark, sf_dir).select("chrom", F.col("pos").alias("start"), "stop")
    return rg.overlapping(sites, ranges, "chrom")


def motif_list(spark, sf_dir):
    rows = [(m.alias, m.fwd, m.rve, m.pam, m.distance, m.extends5) for m in CATALOG.values()]
    return spark.createDataFrame(rows, "alias string, fwd string, rve string, pam string, distance int, extends5 boolean")


# DuckDB

_ALPHABET, _BASES = co._ALPHABET, co._BASES


def _sql_dna(digits: str | None = None) -> str:
    if digits:
        return f"translate(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]', '', 'g'), '{_ALPHABET}0123456789', '{_BASES}{digits * 10}')"
    return f"translate(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g'), '{_ALPHABET}', '{_BASES}')"


def _sql_contigs(digits: str | None = None) -> str:
    return f"c AS (SELECT *, length(seq) AS n FROM (SELECT CAST(doc_id AS VARCHAR) AS chrom, doc_id, {_sql_dna(digits)} AS seq FROM documents) WHERE seq <> '')"


def _sql_class(letter: str) -> str:
    bases = {"N": "ACGT", "V": "ACG", "B": "CGT"}.get(letter, letter)
    ambiguous = {"N": "RYSWKMBDHVN", "V": "RSMVNWKYBDH", "B": "SYKBNRWMDHV"}.get(letter, "".join(x for x in "RYSWKMBDHVN" if letter in {"R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}[x]))
    return f"[{bases}{ambiguous}]"


def _sql_strand(m: Motif, minus: bool, contigs: str) -> str:
    pattern, w, g, p, d = (m.rve if minus else m.fwd), len(m), m.length_no_pam, len(m.pam), m.distance
    left = minus != m.extends5
    letters = "".join(_sql_class(x) for x in pattern)
    pam = "".join(_sql_class(x) for x in (pattern[-p:] if left else pattern[:p]))
    part = lambda at, n: f"substr(tile, i - base + 1 + {at}, {n})"
    guide = part(0, g) if left else part(p, g)
    before = f"right(repeat('-', {d}) || substr(tile, greatest(1, i - base + 1 - {d}), least({d}, i - base)), {d})"
    after = f"left({part(w, d)} || repeat('-', {d}), {d})"
    site = f"reverse({before} || {guide})" if left else f"{guide} || {after}"
    if minus:
        site = f"translate({site}, '{COMPLEMENT_FROM}', '{COMPLEMENT_TO}')"
    lo, hi = (f"greatest(1, lo - {d})", "hi") if left else ("lo", f"least(n, hi + {d})")
    return (
        f"SELECT chrom, CAST({f'i + {w - 1}' if left else 'i'} AS BIGINT) AS start, '{'-' if minus else '+'}' AS strand, {site} AS site FROM {contigs} "
        f"WHERE i >= {lo} AND i + {w - 1} <= {hi} AND regexp_full_match({part(w - p if left else 0, p)}, '{pam}') AND regexp_full_match({part(0, w)}, '{letters}') AND length(regexp_replace({part(0, w)}, '[ACGT]', '', 'g')) <= {m.ambig_max}"
    )


def _sql_tiles(name: str, digits: str | None = None) -> str:
    """CTEs: contigs c, and ``name`` with a row for each place i and the short piece of the contig around it, from ``base``."""
    ends = "length(seq) - length(ltrim(seq, 'N')) + 1 AS lo, length(rtrim(seq, 'N')) AS hi"
    cut = f"SELECT chrom, n, {ends}, o, greatest(1, o - 31) AS base, substr(seq, greatest(1, o - 31), 272) AS tile FROM (SELECT *, unnest(range(0, n, 200)) AS o FROM c)"
    return f"{_sql_contigs(digits)}, {name} AS (SELECT * FROM (SELECT *, o + unnest(range(1, 201)) AS i FROM ({cut})) WHERE i <= n)"


def _sql_sites(m: Motif, digits: str | None = None, name: str = "sites") -> str:
    """CTEs: contigs c, places and sites."""
    strands = " UNION ALL ".join(_sql_strand(m, s, f"{name}_at") for s in (False, True))
    return f"{_sql_tiles(f'{name}_at', digits)}, {name} AS MATERIALIZED (SELECT *, regexp_matches(site, '[^ACGT]') AS is_ambig FROM ({strands}))"


def _sql_guides(m: Motif) -> str:
    q = f"min(substr(site, 1, {m.length_no_pam}))"
    return f"guides AS MATERIALIZED (SELECT DISTINCT {'reverse(q)' if m.extends5 else 'q'} AS guide, q FROM (SELECT {q} AS q FROM sites WHERE NOT is_ambig GROUP BY CAST(chrom AS BIGINT) % {GUIDE_CLASSES}))"


def _sql_hits(m: Motif = CAS9, k: int = 2, distance: str | None = None) -> str:
    length = m.length_no_pam
    free = "least(" + ", ".join(f"levenshtein(q, substr(site, 1, {j}))" for j in range(length - k, length + k + 1)) + ")"
    pairs = f"pairs AS MATERIALIZED (SELECT guide, site, CAST({distance or free} AS INTEGER) AS distance FROM guides, (SELECT DISTINCT site FROM sites))"
    return f"{_sql_sites(m)}, {_sql_guides(m)}, {pairs}, hits AS MATERIALIZED (SELECT guide, distance, chrom AS chromosome, start, strand FROM pairs JOIN sites USING (site) WHERE distance <= {k})"


def _sql_counts(k: int) -> str:
    return ", ".join(f"CAST(count_if(distance = {d}) AS BIGINT) AS D{d}" for d in range(k + 1))


_PLAIN = "SELECT guide, distance, chromosome, start, strand FROM hits"
_GREEDY = """
kept AS (
  SELECT guide, chromosome, strand, unnest(list_reduce(list(struct_pack(d := distance, s := start) ORDER BY distance, start),
         lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: {near})) > 0 THEN acc ELSE list_append(acc, x) END, []::STRUCT(d INTEGER, s BIGINT)[])) AS x
  FROM hits GROUP BY guide, chromosome, strand
),
clear AS MATERIALIZED (SELECT guide, x.d AS distance, chromosome, x.s AS start, strand FROM kept)
"""


def _sql_pams(m: Motif) -> str:
    p, n = len(m.pam), f"substr(tile, i - base + 1, {len(m.pam)})"
    plus = "".join(f"[{ {'N': 'ACGT', 'V': 'ACG', 'B': 'CGT'}.get(x, x) }]" for x in m.pam)
    minus = "".join(f"[{ {'N': 'ACGT', 'V': 'ACG', 'B': 'CGT'}.get(x, x) }]" for x in motif(m.alias).rve[(0 if m.extends5 else m.length_no_pam) :][:p])
    right, left = ("i", f"i + {p - 1}") if m.extends5 else (f"i + {p - 1}", "i")
    return (
        f"{_sql_tiles('spot')}, pams AS MATERIALIZED (SELECT chrom, CAST({right} AS BIGINT) AS pos, '+' AS strand FROM spot WHERE i + {p - 1} <= n AND regexp_full_match({n}, '{plus}') "
        f"UNION ALL SELECT chrom, CAST({left} AS BIGINT), '-' FROM spot WHERE i + {p - 1} <= n AND regexp_full_match({n}, '{minus}'))"
    )


_VARIANTS = """
v AS (
  SELECT doc_id * 3 + k AS rec_no, CAST(doc_id * 3 + k AS VARCHAR) AS id, chrom, CAST(p AS BIGINT) AS pos, CAST(p + length(r) - 1 AS BIGINT) AS stop, r AS ref, a AS alts
  FROM (
    SELECT doc_id, chrom, 0 AS k, n // 3 + 1 AS p, substr(seq, n // 3 + 1, 1) AS r, translate(substr(seq, n // 3 + 1, 1), 'ACGT', 'CGTA') AS a FROM c WHERE n >= 40
    UNION ALL SELECT doc_id, chrom, 1, n // 3 + 4, substr(seq, n // 3 + 4, 1), substr(seq, n // 3 + 4, 1) || 'GG' FROM c WHERE n >= 40
    UNION ALL SELECT doc_id, chrom, 2, n // 2 + 1, substr(seq, n // 2 + 1, 2), substr(seq, n // 2 + 1, 1) FROM c WHERE n >= 40
  )
),
grouped AS (
  SELECT *, sum(new) OVER (PARTITION BY chrom ORDER BY pos, stop ROWS UNBOUNDED PRECEDING) AS g
  FROM (SELECT *, CASE WHEN lag(stop) OVER w IS NULL OR pos - 22 > lag(stop) OVER w + 22 THEN 1 ELSE 0 END AS new FROM v WINDOW w AS (PARTITION BY chrom ORDER BY pos, stop))
)
"""
#: With the rule for places, a group's variants follow each other without overlap unless a contig is very short.
_HAPLOTYPES = """
parts AS (
  SELECT *, lag(stop) OVER (PARTITION BY chrom, g ORDER BY pos, stop) AS before FROM grouped
),
haps AS (
  SELECT chrom, g, min(pos) AS a, max(stop) AS z, string_agg(CASE WHEN before IS NULL THEN '' ELSE substr(seq, before + 1, pos - before - 1) END || alts, '' ORDER BY pos) AS mid,
         string_agg(id || ':' || ref || '/' || alts, '-' ORDER BY pos) AS variants
  FROM parts JOIN c USING (chrom) GROUP BY chrom, g
)
SELECT chrom, CAST(greatest(1, a - 25) AS BIGINT) AS first, substr(seq, greatest(1, a - 25), a - greatest(1, a - 25)) || mid || substr(seq, z + 1, least(n, z + 25) - z) AS seq, variants
FROM haps JOIN c USING (chrom)
"""
_KMERS = "SELECT kmer, count(*) AS n FROM (SELECT substr(seq, i, 6) AS kmer FROM (SELECT seq, unnest(range(1, {stop}, {step})) AS i FROM c WHERE n >= 6)) GROUP BY kmer"
_COUNTED = "occ AS (SELECT pattern, chrom, CAST(i AS BIGINT) AS pos FROM spot, (SELECT unnest([{patterns}]) AS pattern) WHERE substr(tile, i - base + 1, length(pattern)) = pattern)"
_SPELL = " ".join(f"WHEN '{x}' THEN {list(b)}" for x, b in {"R": "AG", "Y": "CT", "A": "A", "C": "C", "G": "G", "T": "T"}.items())


def _with(ctes: str, query: str) -> str:
    """A query after common table expressions; it may begin with further ones, after a comma."""
    return f"WITH {ctes} {query}"


ORACLE_SQL = {
    "contig_lengths": _with(_sql_contigs(), "SELECT chrom, n FROM c"),
    "telomere_bounds": _with(_sql_contigs("N"), "SELECT chrom, CAST(n - length(ltrim(seq, 'N')) + 1 AS BIGINT) AS lo, CAST(length(rtrim(seq, 'N')) AS BIGINT) AS hi FROM c"),
    "pam_positions_cas9": _with(_sql_pams(CAS9), "SELECT * FROM pams"),
    "pam_positions_cas12a": _with(_sql_pams(CAS12A), "SELECT * FROM pams"),
    "sites_cas9_d2": _with(_sql_sites(CAS9), "SELECT * FROM sites"),
    "sites_cas12a_d1": _with(_sql_sites(CAS12A), "SELECT * FROM sites"),
    "sites_ambig": _with(_sql_sites(LOOSE, "N"), "SELECT * FROM sites"),
    "sites_prefix_suffix": _with(_sql_sites(CAS9), "SELECT substr(site, 1, 7) AS prefix, count(*) AS n_sites, count(DISTINCT substr(site, 8)) AS n_suffixes FROM sites WHERE NOT is_ambig GROUP BY 1"),
    "site_counts": _with(_sql_sites(CAS9), "SELECT site, count(*) AS n FROM sites WHERE NOT is_ambig GROUP BY site"),
    "site_counts_capped": _with(_sql_sites(CAS9), "SELECT least(n, 10) AS bin, count(*) AS sites FROM (SELECT count(*) AS n FROM sites WHERE NOT is_ambig GROUP BY site) GROUP BY 1"),
    "search_nested_loop_d2": _with(_sql_hits(), _PLAIN),
    "search_seed_d2": _with(_sql_hits(), _PLAIN),
    "search_qgram_d2": _with(_sql_hits(), _PLAIN),
    "search_neighbourhood_d1": _with(_sql_hits(k=1), _PLAIN),
    "search_cas12a_d1": _with(_sql_hits(CAS12A, 1), _PLAIN),
    "hamming_search": _with(_sql_hits(distance="hamming(q, substr(site, 1, 20))"), _PLAIN),
    "exact_search": _with(_sql_hits(k=1), _PLAIN + " WHERE distance = 0"),
    "alignment_letters": _with(_sql_hits(), "SELECT *, guide AS letters, distance AS differing, true AS begins_site FROM hits"),
    "filter_overlapping_w23": _with(f"{_sql_hits()}, {_GREEDY.format(near='abs(y.s - x.s) <= 23')}", "SELECT * FROM clear"),
    "suppress_shifted": _with(f"{_sql_hits()}, {_GREEDY.format(near='abs(y.s - x.s) <= x.d - y.d')}", "SELECT * FROM clear"),
    "summarize": _with(_sql_hits(), f"SELECT guide, {_sql_counts(2)} FROM hits GROUP BY guide"),
    "search_pipeline": _with(f"{_sql_hits()}, {_GREEDY.format(near='abs(y.s - x.s) <= 23')}", f"SELECT guide, {_sql_counts(2)} FROM clear GROUP BY guide"),
    "early_stop": _with(
        _sql_hits(),
        """, walk AS (SELECT *, row_number() OVER (PARTITION BY guide ORDER BY distance, chromosome, start, strand) AS step FROM hits),
        seen AS (SELECT *, row_number() OVER (PARTITION BY guide, distance ORDER BY step) AS rn FROM walk),
        halt AS (SELECT guide, min(step) AS stop FROM seen WHERE rn >= CASE distance WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 7 END GROUP BY guide)
        SELECT guide, distance, chromosome, start, strand FROM seen LEFT JOIN halt USING (guide) WHERE stop IS NULL OR step <= stop""",
    ),
    "cap_per_distance": _with(
        _sql_hits(),
        """SELECT guide, distance, chromosome, start, strand FROM hits
        QUALIFY row_number() OVER (PARTITION BY guide, distance ORDER BY chromosome, start, strand) <= CASE distance WHEN 0 THEN 1 WHEN 1 THEN 5 ELSE 10 END""",
    ),
    "dict_estimate_d1": _with(
        _sql_hits(CAS9.with_distance(1), 1),
        ", est AS (SELECT guide, distance FROM pairs JOIN sites USING (site) WHERE NOT is_ambig AND distance <= 1) " + f"SELECT guide, {_sql_counts(1)} FROM est GROUP BY guide",
    ),
    "hash_estimate_d1": _with(
        _sql_hits(CAS9.with_distance(1), 1),
        """, est AS (SELECT guide, distance, n FROM pairs JOIN (SELECT site, least(count(*), 2) AS n FROM sites WHERE NOT is_ambig GROUP BY site) USING (site) WHERE distance <= 1)
        SELECT guide, CAST(coalesce(sum(n) FILTER (distance = 0), 0) AS BIGINT) AS D0, CAST(coalesce(sum(n) FILTER (distance = 1), 0) AS BIGINT) AS D1 FROM est GROUP BY guide""",
    ),
    "anti_join_strategies": _with(_sql_hits(), _PLAIN + " WHERE distance = 2"),
    "set_union_prefixes": _with(_sql_sites(CAS9), "SELECT DISTINCT substr(site, 1, 7) AS prefix FROM sites"),
    "kmers": _with(_sql_contigs(), _KMERS.format(stop="n - 4", step=1)),
    "skipkmers": _with(_sql_contigs(), _KMERS.format(stop="n - 4", step=6)),
    "pack_2bit": _with(
        _sql_sites(CAS9),
        """SELECT site, CAST(list_sum([CAST(strpos('CGT', substr(site, i, 1)) AS BIGINT) * CAST(pow(4, 22 - i) AS BIGINT) for i in range(1, 23)]) AS BIGINT) AS packed, site AS again
        FROM (SELECT DISTINCT site FROM sites WHERE NOT is_ambig)""",
    ),
    "expand_ambiguous": _with(
        _sql_sites(LOOSE, "R"),
        f""", s AS (SELECT DISTINCT site FROM sites WHERE is_ambig AND NOT contains(site, '-'))
        SELECT site, unnest(list_reduce([CASE substr(site, i, 1) {_SPELL} END for i in range(1, 22)], lambda acc, x: flatten([[a || b for a in acc] for b in x]))) AS spelling FROM s""",
    ),
    "revcomp": _with(_sql_contigs(), f"SELECT chrom, md5(reverse(translate(seq, '{COMPLEMENT_FROM}', '{COMPLEMENT_TO}'))) AS digest FROM c"),
    "text_count": _with(
        f"{_sql_tiles('spot')}, {_COUNTED.format(patterns=', '.join(repr(p) for p in PATTERNS))}",
        f"SELECT pattern, count(chrom) AS n FROM (SELECT unnest([{', '.join(repr(p) for p in PATTERNS)}]) AS pattern) LEFT JOIN occ USING (pattern) GROUP BY pattern",
    ),
    "text_locate": _with(f"{_sql_tiles('spot')}, {_COUNTED.format(patterns=', '.join(repr(p) for p in PATTERNS))}", "SELECT * FROM occ"),
    "rank_freq": _with(
        _sql_contigs(),
        """SELECT chrom, CAST(length(regexp_replace(left(seq, 100), '[^A]', '', 'g')) AS BIGINT) AS rank_100,
        CAST(length(regexp_replace(substr(seq, 50, 101), '[^G]', '', 'g')) AS BIGINT) AS freq_50_150 FROM c""",
    ),
    "select_jth": _with(
        _sql_contigs(),
        """, t AS (SELECT chrom, i FROM (SELECT chrom, seq, unnest(range(1, n + 1)) AS i FROM c) WHERE substr(seq, i, 1) = 'T' QUALIFY row_number() OVER (PARTITION BY chrom ORDER BY i) = 25)
        SELECT chrom, coalesce(i, 0) AS pos FROM c LEFT JOIN t USING (chrom)""",
    ),
    "symbol_counts": _with(_sql_contigs(), "SELECT chrom, symbol, count(*) AS n FROM (SELECT chrom, unnest(string_split(seq, '')) AS symbol FROM c) GROUP BY ALL"),
    "suffix_arrays": f"""
        WITH c AS (SELECT * FROM (SELECT CAST(item_id AS VARCHAR) AS chrom, {_sql_dna()} AS seq FROM benchmark) WHERE seq <> ''),
        s AS (SELECT chrom, seq, unnest(range(0, length(seq))) AS pos FROM c)
        SELECT chrom, row_number() OVER (PARTITION BY chrom ORDER BY substr(seq, pos + 1)) - 1 AS i, pos FROM s""",
    "variant_alleles": _with(f"{_sql_contigs()}, {_VARIANTS}", "SELECT rec_no, id, chrom, pos, stop, ref, alts FROM v"),
    "variant_groups": _with(f"{_sql_contigs()}, {_VARIANTS}", "SELECT rec_no, chrom, CAST(g AS BIGINT) AS group_no FROM grouped"),
    "variant_haplotypes": _with(f"{_sql_contigs()}, {_VARIANTS}, {_HAPLOTYPES}", ""),
    "run_ranges": """
        WITH r AS (SELECT source, doc_id, lang, row_number() OVER w AS place, lag(lang) OVER w AS before FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)),
        g AS (SELECT *, sum(CASE WHEN before = lang THEN 0 ELSE 1 END) OVER (PARTITION BY source ORDER BY place ROWS UNBOUNDED PRECEDING) AS run FROM r)
        SELECT source, lang, min(place) AS start, max(place) AS stop FROM g GROUP BY source, run, lang""",
    "duplicate_sites": _with(_sql_sites(CAS9), "SELECT rn > 1 AS is_duplicate, count(*) AS n FROM (SELECT row_number() OVER (PARTITION BY site ORDER BY CAST(chrom AS BIGINT), start, strand) AS rn FROM sites) GROUP BY 1"),
    "balance_lengths": _with(
        _sql_contigs(),
        """, k AS (SELECT doc_id % 7 AS part, n // 100 AS size, count(*) AS m FROM c GROUP BY ALL),
        b AS (SELECT part, size, abs(sum(m) OVER (PARTITION BY part ORDER BY size) - sum(m) OVER (PARTITION BY part ORDER BY size DESC)) AS uneven FROM k)
        SELECT part, CAST(arg_min(size, (uneven, size)) AS BIGINT) AS balance FROM b GROUP BY part""",
    ),
    "pam_within_reach": _with(_sql_pams(CAS12A), 
        """, a AS (SELECT chrom, pos, unnest(list_distinct([(pos - 10) // 21, (pos + 10) // 21])) AS bin FROM pams WHERE strand = '+'),
        b AS (SELECT chrom, pos AS near, pos // 21 AS bin FROM pams WHERE strand = '-')
        SELECT chrom, pos, near FROM a JOIN b USING (chrom, bin) WHERE near BETWEEN pos - 10 AND pos + 10""",
    ),
    "pam_before": _with(
        _sql_pams(CAS12A),
        ", p AS (SELECT chrom, pos FROM pams WHERE strand = '+'), m AS (SELECT chrom, pos FROM pams WHERE strand = '-') SELECT p.chrom, p.pos, coalesce(m.pos, -1) AS near FROM p ASOF LEFT JOIN m ON p.chrom = m.chrom AND p.pos >= m.pos",
    ),
    "variant_overlaps": _with(
        f"{_sql_sites(CAS12A)}, {_VARIANTS}",
        """SELECT s.chrom, s.start AS a_start, s.start + 24 AS a_stop, v.pos AS b_start, v.stop AS b_stop FROM sites s JOIN v ON s.chrom = v.chrom AND s.strand = '+' AND s.start <= v.stop AND v.pos <= s.start + 24""",
    ),
    "motif_list": "SELECT * FROM (VALUES " + ", ".join(f"('{m.alias}', '{m.fwd}', '{m.rve}', '{m.pam}', {m.distance}, {str(m.extends5).lower()})" for m in CATALOG.values()) + ") AS t(alias, fwd, rve, pam, distance, extends5)",
}

QUERIES = {
    f.__name__: f
    for f in (
        contig_lengths, telomere_bounds, pam_positions_cas9, pam_positions_cas12a, sites_cas9_d2, sites_cas12a_d1, sites_ambig, sites_prefix_suffix, site_counts,
        site_counts_capped, search_nested_loop_d2, search_seed_d2, search_qgram_d2, search_neighbourhood_d1, search_cas12a_d1, hamming_search, exact_search,
        search_alignments, alignment_letters, filter_overlapping_w23, suppress_shifted, summarize, search_pipeline, early_stop, cap_per_distance, dict_estimate_d1, hash_estimate_d1,
        count_sketch, anti_join_strategies, set_union_prefixes, kmers, skipkmers, pack_2bit, expand_ambiguous, revcomp, text_count, text_locate, rank_freq, select_jth,
        symbol_counts, suffix_arrays, variant_alleles, variant_groups, variant_haplotypes, variant_sites, variant_search_d2, run_ranges, duplicate_sites,
        balance_lengths, pam_within_reach, pam_before, variant_overlaps, motif_list,
    )
}
