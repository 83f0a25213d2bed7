"""Command line: build, search, estimate, filter, summarize, list."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from . import persistence
from .functions.dna import min_kmer_size
from .functions.neighbours import with_neighbours
from .motif import CATALOG, Motif, motif
from .operators import estimate as est
from .operators import post
from .operators import search as se
from .operators import sites as si
from .operators import text_index, variants
from .sources.contigs import genome_info, read_genome
from .sources.tables import read_guides, read_hits, read_vcf

#: Kinds of stored index, and the strategy by which each is searched.
INDEXES = {
    "linearDB": "nested_loop", "treeDB": "nested_loop", "motifDB": "qgram", "prefixHashDB": "neighbourhood", "vcfDB": "seed",
    "fmi": "seed", "fmi_seed": "seed", "bffDB": "neighbourhood",
}
BUILDS = ["linearDB", "treeDB", "motifDB", "prefixHashDB", "vcfDB", "fmi", "bffDB", "hashDB", "dictDB", "pamDB", "template"]
DEFAULT_LIMIT = 1_000_000


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="pamsieve", description="Approximate guide search on Spark.")
    commands = top.add_subparsers(dest="command", required=True)

    build = commands.add_parser("build", help="make an index of a genome")
    build.add_argument("kind", choices=BUILDS)
    build.add_argument("--name", default="")
    build.add_argument("--genome", help=".fa, .fasta, .fna or .2bit")
    build.add_argument("--output", required=True)
    build.add_argument("--motif", help="a preset; see list")
    build.add_argument("--fwd_motif", help="guide pattern, X where the PAM stands")
    build.add_argument("--fwd_pam", help="PAM pattern, X where the guide stands")
    build.add_argument("--not_forward", action="store_true")
    build.add_argument("--not_reverse", action="store_true")
    build.add_argument("--extend3", action="store_true")
    build.add_argument("--distance", type=int, default=3)
    build.add_argument("--ambig_max", type=int, default=0)
    build.add_argument("--prefix_length", type=int, default=7)
    build.add_argument("--hash_length", type=int)
    build.add_argument("--max_count", type=int, default=10)
    build.add_argument("--vcf")
    build.add_argument("--no_variant_overlaps", action="store_true")
    build.add_argument("--mismatch_only", action="store_true")
    build.add_argument("--word_length", type=int, help="fmi: letters of the indexed words")

    search = commands.add_parser("search", help="search guides in an index")
    search.add_argument("kind", choices=list(INDEXES))
    search.add_argument("--database", required=True)
    search.add_argument("--guides", required=True)
    search.add_argument("--output", required=True)
    search.add_argument("--distance", type=int, default=3)
    search.add_argument("--early_stopping", type=int, nargs="*")
    search.add_argument("--no_alignment", action="store_true")

    estimate = commands.add_parser("estimate", help="count hits by distance from a hashDB or dictDB")
    estimate.add_argument("--database", required=True)
    estimate.add_argument("--guides", required=True)
    estimate.add_argument("--output", required=True)
    estimate.add_argument("--right", action="store_true")

    for name, text in (("filter", "drop hits near better ones"), ("summarize", "count hits by distance")):
        one = commands.add_parser(name, help=text)
        one.add_argument("--detail_file", required=True)
        one.add_argument("--output", required=True)
        one.add_argument("--distance", type=int, default=23 if name == "filter" else 3)

    commands.add_parser("list", help="print known motifs")
    return top


def chosen_motif(args: argparse.Namespace) -> Motif:
    if args.motif:
        return motif(args.motif, args.distance, args.ambig_max)
    if not (args.fwd_motif and args.fwd_pam):
        raise ValueError("give a preset motif, or both patterns")
    return Motif(args.name or "own", args.fwd_motif, args.fwd_pam, not args.not_forward, not args.not_reverse, args.distance, not args.extend3, args.ambig_max)


def build(spark: SparkSession, args: argparse.Namespace) -> None:
    m = chosen_motif(args)
    if args.kind == "template":  # the neighbourhood of a guide of Ns depends on the motif only: keep its parameters
        guides = spark.createDataFrame([("ACGT" * m.length_no_pam,)], "guide string").selectExpr(f"left(guide, {m.length_no_pam}) as guide", f"left(guide, {m.length_no_pam}) as q")
        keys = with_neighbours(guides, m.distance, args.hash_length or min(m.length_no_pam - m.distance, 16), args.mismatch_only)
        persistence.save(keys.groupBy("least").count(), args.output, m, args.name, kind=args.kind, hash_length=args.hash_length)
        return
    if not args.genome:
        raise ValueError("a genome is needed")
    contigs, info = read_genome(spark, args.genome), genome_info(spark, args.genome)
    about = {"kind": args.kind, "genome": info.path, "checksum": info.checksum, "contigs": list(info.contigs)}
    if args.kind == "pamDB":
        persistence.save(si.pam_positions(contigs, m).orderBy("chrom", "pos"), args.output, m, args.name, **about)
        return
    if args.kind == "vcfDB":
        if not args.vcf:
            raise ValueError("a VCF file is needed")
        found = variants.variant_sites(read_vcf(spark, args.vcf), contigs, m, not args.no_variant_overlaps)
        persistence.save_sites(found, args.output, m, args.prefix_length, name=args.name, **about)
        return
    found = si.sites(contigs, m, deal=4 * spark.sparkContext.defaultParallelism)
    if args.kind in ("hashDB", "dictDB"):
        counts = est.site_counts(found, args.max_count if args.kind == "hashDB" else None)
        persistence.save(counts, args.output, m, args.name, max_count=args.max_count, **about)
        return
    if args.kind == "fmi":
        k = args.word_length or max(1, min_kmer_size(m.length_no_pam, m.distance))
        persistence.save(text_index.word_counts(contigs, k), f"{args.output}/words", m, args.name, word_length=k, **about)
    persistence.save_sites(found, args.output, m, args.prefix_length, name=args.name, hash_length=args.hash_length, **about)


def search(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    table, m, about = persistence.load(spark, args.database)
    extra = ("variants",) if "variants" in table.columns else ()
    hits = se.search(table, read_guides(spark, args.guides), m, args.distance, INDEXES[args.kind], not args.no_alignment, args.kind not in ("linearDB", "motifDB"), about.get("hash_length"), extra)
    limits = args.early_stopping
    if limits is None and args.kind in ("prefixHashDB", "vcfDB"):
        limits = [DEFAULT_LIMIT] * (args.distance + 1)
    if limits:
        if len(limits) != args.distance + 1:
            raise ValueError("early stopping needs a limit for each distance")
        if args.kind == "linearDB":
            if limits != sorted(limits):
                raise ValueError("limits must not fall")
            hits = se.cap_per_distance(post.filter_overlapping(hits, 2 * args.distance + 1), limits)
        else:
            hits = se.early_stop(hits, limits)
    return hits


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Run a command; 1 if it fails."""
    args = parser().parse_args(argv)
    try:
        if args.command == "list":
            print("\n".join(CATALOG[a].describe() for a in sorted(CATALOG)))
            return 0
        spark = spark or SparkSession.builder.appName("pamsieve").getOrCreate()
        if args.command == "build":
            build(spark, args)
        elif args.command == "search":
            persistence.write_csv(search(spark, args), args.output)
        elif args.command == "estimate":
            table, m, about = persistence.load(spark, args.database)
            guides = read_guides(spark, args.guides)
            distance = min(1, m.distance) if about["kind"] == "hashDB" else m.distance
            out = est.right_or_left(table, guides, m, about["max_count"], distance, args.right) if about["kind"] == "hashDB" else est.estimate(table, guides, m, distance)
            persistence.write_csv(post.tidy(out), args.output, single=True)
        elif args.command == "filter":
            persistence.write_csv(post.filter_overlapping(read_hits(spark, args.detail_file), args.distance), args.output)
        else:
            persistence.write_csv(post.summarize(read_hits(spark, args.detail_file), args.distance), args.output, single=True)
    except Exception as e:
        print(f"pamsieve: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
