"""Column functions over DNA strings; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..motif import COMPLEMENT_FROM, COMPLEMENT_TO, LETTERS, MASKS

#: Fixed order of the bases in which ambiguous letters are spelled out.
BASE_ORDER = "ACTG"


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def complement(s) -> Column:
    return F.translate(_col(s), COMPLEMENT_FROM, COMPLEMENT_TO)


def reverse_complement(s) -> Column:
    return F.reverse(complement(s))


def is_ambiguous(s) -> Column:
    """Whether any letter, or gap, isn't one of ACGT."""
    return _col(s).rlike("[^ACGT]")


def ambiguous_letters(s) -> Column:
    return F.char_length(F.regexp_replace(_col(s), "[ACGT]", ""))


def first_certain(s) -> Column:
    """1-based place of the first letter that isn't N."""
    return F.char_length(_col(s)) - F.char_length(F.ltrim(_col(s), F.lit("N"))) + 1


def last_certain(s) -> Column:
    return F.char_length(F.rtrim(_col(s), F.lit("N")))


def pack2(s) -> Column:
    """Up to 31 letters of ACGT as a long, two bits a letter, first letter highest."""
    return F.conv(F.translate(_col(s), "ACGT", "0123"), 4, 10).cast("long")


def unpack2(x, length: int) -> Column:
    return F.translate(F.lpad(F.conv(_col(x).cast("string"), 10, 4), length, "0"), "0123", "ACGT")


def equal_shifted(x, y, shift: int) -> Column:
    """Whether the packed ``x`` without its lowest ``shift`` bits equals the packed ``y``."""
    return F.bit_count(F.shiftright(_col(x), shift).bitwiseXOR(_col(y))) == 0


def kmers(s, k: int) -> Column:
    """All overlapping k-mers, in order."""
    n = F.char_length(_col(s)) - k + 1
    return F.when(n < 1, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(_col(s), i, F.lit(k))))


def skipkmers(s, k: int) -> Column:
    """Adjacent k-mers without overlap; a shorter rest is left out."""
    n = F.floor(F.char_length(_col(s)) / k).cast("int")
    return F.when(n < 1, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.substring(_col(s), i * k + 1, F.lit(k)))
    )


def shares_kmers(a, b, least: int) -> Column:
    """Whether two arrays of k-mers have at least ``least`` different ones in common."""
    return F.size(F.array_intersect(_col(a), _col(b))) >= least


def min_kmer_size(length: int, distance: int) -> int:
    """The longest piece that must stay whole when ``length`` letters take ``distance`` edits."""
    return length // (distance + 1)


def all_kmers(spark: SparkSession, k: int, alphabet: str = "ACGT") -> DataFrame:
    """(kmer): every word of ``k`` letters, sorted."""
    letters, n = "".join(sorted(alphabet)), len(alphabet)
    digits = [F.expr(f"substring('{letters}', int(id div {n ** (k - 1 - i)} % {n}) + 1, 1)") for i in range(k)]
    return spark.range(n**k).select(F.concat(*digits).alias("kmer"))


def _mapping(pairs: dict[str, object]) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))


def spellings(letter) -> Column:
    """The bases an IUPAC letter stands for, in BASE_ORDER; a gap stands for A."""
    bases = {x: "".join(b for b in BASE_ORDER if m & MASKS[b]) or "A" for x, m in MASKS.items()}
    return F.split(F.element_at(_mapping(bases), letter), "")


def expand_ambiguous(s) -> Column:
    """All concrete spellings of a string; its first letter changes fastest."""
    letters = F.split(_col(s), "")
    grow = lambda acc, x: F.flatten(F.transform(spellings(x), lambda b: F.transform(acc, lambda a: F.concat(a, b))))
    return F.aggregate(letters, F.array(F.lit("")), grow)


def mask(letter) -> Column:
    return F.element_at(_mapping(MASKS), letter)


def letter_of(bases) -> Column:
    return F.element_at(_mapping({m: x for m, x in LETTERS.items()}), bases)


def compatible(x, y) -> Column:
    """Whether two letters share a base."""
    return mask(x).bitwiseAND(mask(y)) != 0


def inclusive(x, y) -> Column:
    """Whether one letter's bases include the other's; a gap is never included."""
    both = mask(x).bitwiseAND(mask(y))
    return (both != 0) & ((both == mask(x)) | (both == mask(y)))


def hamming(a, b, match=None) -> Column:
    """Places that don't match over the shorter of two strings; ``match`` defaults to ``compatible``."""
    match = match or compatible
    n = F.least(F.char_length(_col(a)), F.char_length(_col(b)))
    x, y = F.split(F.substring(_col(a), F.lit(1), n), ""), F.split(F.substring(_col(b), F.lit(1), n), "")
    return F.when(n == 0, 0).otherwise(F.aggregate(F.zip_with(x, y, lambda p, q: F.when(match(p, q), 0).otherwise(1)), F.lit(0), lambda acc, v: acc + v))


def common_prefix(a, b) -> Column:
    """Length of the prefix over which two concrete strings agree."""
    n = F.least(F.char_length(_col(a)), F.char_length(_col(b)))
    same = lambda i: F.substring(_col(a), F.lit(1), i) == F.substring(_col(b), F.lit(1), i)
    return F.when(n == 0, 0).otherwise(F.size(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), same)))


def free_end_distance(q, site, length: int, k: int) -> Column:
    """Edit distance of a concrete guide to the best prefix of a concrete site, k + 1 if over k.

    ``q`` has ``length`` letters; prefixes of length - k to length + k letters are all that can be within k.
    """
    ends = [F.levenshtein(_col(q), F.substring(_col(site), 1, j), k) for j in range(max(0, length - k), length + k + 1)]
    found = [F.when(d < 0, F.lit(k + 1)).otherwise(d) for d in ends]
    return F.least(*found) if len(found) > 1 else found[0]


def ungap(s) -> Column:
    return F.regexp_replace(_col(s), "-", "")


def random_dna(seed_col, length: int) -> Column:
    """``length`` letters that depend on the column's value only."""
    digests = F.concat(*(F.md5(F.concat(_col(seed_col).cast("string"), F.lit(f":{i}"))) for i in range(-(-length // 32))))
    return F.substring(F.translate(digests, "0123456789abcdef", "ACGTACGTACGTACGT"), 1, length)
