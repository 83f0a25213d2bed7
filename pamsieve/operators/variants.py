"""Search on haplotypes: sites that a variant makes or changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dna import is_ambiguous
from ..motif import Motif
from .ranges import group_nearby
from .sites import scan, tiles


def variant_groups(variants: DataFrame, motif: Motif, overlaps: bool = True) -> DataFrame:
    """``variants`` with group_no: those close enough to fall into one site are grouped; else each stands alone."""
    if not overlaps:
        return variants.withColumn("group_no", F.col("rec_no"))
    return group_nearby(variants, "chrom", "pos", "stop", motif.length_no_pam + motif.distance)


def annotation(name: Column, ref: Column, alt: Column) -> Column:
    """id:REF/ALT, with long alleles shortened to their first letters and length."""
    short = lambda a: F.when(F.char_length(a) > 10, F.concat(F.left(a, F.lit(4)), F.lit("..."), F.char_length(a).cast("string"), F.lit("bp"))).otherwise(a)
    return F.concat(name, F.lit(":"), short(ref), F.lit("/"), short(alt))


def mismatched_references(variants: DataFrame, contigs: DataFrame) -> DataFrame:
    """Variants whose REF isn't what the contig has there."""
    joined = variants.join(contigs.select("chrom", "seq"), "chrom")
    return joined.where(F.expr("substring(seq, int(pos), length(ref)) != ref")).drop("seq")


def haplotypes(variants: DataFrame, contigs: DataFrame, motif: Motif, overlaps: bool = True, include_ref: bool = False) -> DataFrame:
    """(hap_id, chrom, first, seq, edits, variants): alternative sequences around each group of variants.

    All combinations of the group's alternative alleles (with ``include_ref`` of reference alleles too) are spelled out,
    with enough letters on both sides for any site that touches one.  ``first`` is the contig's place of the first
    letter, ``edits`` lists (pos, stop, at, len, shift, note): each allele's reference range, its place in ``seq`` and its name.
    """
    flank = len(motif) + motif.distance
    grouped = variant_groups(variants, motif, overlaps)
    alleles = F.concat("alts", F.array("ref")) if include_ref else F.col("alts")
    item = F.struct("pos", "stop", "rec_no", "id", "ref", alleles.alias("alleles"))
    lists = grouped.groupBy("chrom", "group_no").agg(F.array_sort(F.collect_list(item)).alias("vs"))
    span = lists.join(contigs.select("chrom", "n", "seq"), "chrom")
    first = F.greatest(F.lit(1), F.element_at("vs", 1)["pos"] - flank).cast("long")
    last = F.least(F.col("n"), F.array_max(F.transform("vs", lambda v: v["stop"])) + flank)
    cut = span.select("chrom", "group_no", "vs", first.alias("first"), F.expr(f"substring(seq, int(greatest(1, vs[0].pos - {flank})), int(least(n, array_max(transform(vs, v -> v.stop)) + {flank}) - greatest(1, vs[0].pos - {flank}) + 1))").alias("local"), last.alias("last"))
    edit = "struct<pos:bigint,stop:bigint,at:bigint,len:bigint,shift:bigint,note:string>"
    begin = F.array(F.struct(F.lit("").alias("seq"), F.col("first").alias("next"), F.lit("").alias("note"), F.array().cast(f"array<{edit}>").alias("edits")))

    def grow(acc: Column, v: Column) -> Column:
        def one(h: Column, a: Column) -> Column:
            # letters between the last variant and this one; overlapping variants can't be combined
            between = F.substring("local", (h["next"] - F.col("first") + 1).cast("int"), F.greatest(F.lit(0), v["pos"] - h["next"]).cast("int"))
            seq = F.concat(h["seq"], between)
            note = annotation(v["id"], v["ref"], a)
            place = F.struct(
                v["pos"].alias("pos"), v["stop"].alias("stop"), F.char_length(seq).cast("long").alias("at"), F.char_length(a).cast("long").alias("len"),
                (F.char_length(a) - F.char_length(v["ref"])).cast("long").alias("shift"), note.alias("note"),
            )
            return F.struct(
                F.concat(seq, a).alias("seq"), (v["stop"] + 1).alias("next"), F.when(h["note"] == "", note).otherwise(F.concat(h["note"], F.lit("-"), note)).alias("note"), F.concat(h["edits"], F.array(place)).alias("edits")
            )

        able = lambda h: h["next"] <= v["pos"]
        taken = F.flatten(F.transform(F.filter(acc, able), lambda h: F.transform(v["alleles"], lambda a: one(h, a))))
        return F.concat(taken, F.filter(acc, lambda h: ~able(h)))

    built = cut.withColumn("h", F.explode(F.aggregate("vs", begin, grow)))
    tail = F.substring("local", (F.col("h.next") - F.col("first") + 1).cast("int"), F.greatest(F.lit(0), F.col("last") - F.col("h.next") + 1).cast("int"))
    out = built.select("chrom", "first", F.concat("h.seq", tail).alias("seq"), F.col("h.edits").alias("edits"), F.col("h.note").alias("variants"))
    return out.where("size(edits) > 0").withColumn("hap_id", F.concat_ws("|", "chrom", F.col("first").cast("string"), "variants"))


def variant_sites(variants: DataFrame, contigs: DataFrame, motif: Motif, overlaps: bool = True, include_ref: bool = False) -> DataFrame:
    """(chrom, start, strand, site, is_ambig, variants): sites on haplotypes that touch an altered place, each once.

    ``variants`` names the alleles that the site touches.  ``start`` is the PAM's outer edge in the contig: places behind an insertion or deletion are shifted back; one inside
    an inserted allele is told as the allele's first reference place.  Contigs that the genome lacks are left out.
    """
    haps = haplotypes(variants, contigs, motif, overlaps, include_ref)
    pseudo = haps.select(F.col("hap_id").alias("chrom"), F.char_length("seq").cast("long").alias("n"), "seq")
    context = len(motif) + motif.distance
    found = scan(tiles(pseudo, context), motif).withColumnRenamed("chrom", "hap_id").withColumnRenamed("start", "local")
    joined = found.join(haps.select("hap_id", "chrom", "first", "edits"), "hap_id")
    width = len(motif)
    right = (F.col("strand") == "+") == F.lit(motif.extends5)
    lo = F.when(right, F.col("local") - width + 1).otherwise(F.col("local"))
    hi = F.when(right, F.col("local")).otherwise(F.col("local") + width - 1)

    def touches(e: Column) -> Column:
        """An allele without letters stands between two: the window must hold both."""
        return F.when(e["len"] > 0, (lo <= e["at"] + e["len"]) & (hi >= e["at"] + 1)).otherwise((lo <= e["at"]) & (hi >= e["at"] + 1))

    met = F.filter("edits", touches)
    kept = joined.withColumn("variants", F.array_join(F.transform(met, lambda e: e["note"]), "-")).where(F.size(met) > 0)
    back = F.aggregate(
        "edits",
        F.struct(F.lit(0).cast("long").alias("shift"), F.lit(None).cast("long").alias("inside")),
        lambda acc, e: F.struct(
            F.when(F.col("local") > e["at"] + e["len"], acc["shift"] + e["shift"]).otherwise(acc["shift"]).alias("shift"),
            F.when((F.col("local") > e["at"]) & (F.col("local") <= e["at"] + e["len"]) & (e["shift"] != 0), F.least(e["pos"] + F.col("local") - e["at"] - 1, e["stop"])).otherwise(acc["inside"]).alias("inside"),
        ),
        lambda acc: F.coalesce(acc["inside"], F.col("first") + F.col("local") - 1 - acc["shift"]),
    )
    return kept.select("chrom", back.alias("start"), "strand", "site", is_ambiguous("site").alias("is_ambig"), "variants").distinct()
