import random

import pytest
from pyspark.sql import functions as F

from pamsieve.functions import align as al
from pamsieve.functions import dna
from pamsieve.functions.neighbours import neighbourhood
from pamsieve.motif import CATALOG, MASKS, Motif, combine, motif, reverse_complement


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def plain_distance(g, s, ok):
    """Full table: cheapest alignment of the whole guide with a beginning of the site."""
    row = list(range(len(g) + 1))
    best = row[-1]
    for j, b in enumerate(s, 1):
        new = [j]
        for i, a in enumerate(g, 1):
            new.append(min(row[i - 1] + (not ok(a, b)), row[i] + 1, new[i - 1] + 1))
        row = new
        best = min(best, row[-1])
    return best


def compatible(a, b):
    return bool(MASKS[a] & MASKS[b])


def test_motifs():
    cas9, cas12 = motif("Cas9"), motif("Cas12a")
    assert (len(cas9), cas9.length_no_pam, cas9.pam, cas9.fwd[-3:], cas9.rve[:3]) == (23, 20, "NGG", "NGG", "CCN")
    assert (len(cas12), cas12.length_no_pam, cas12.fwd[:4], cas12.rve[-4:], cas12.extends5) == (25, 21, "TTTV", "BAAA", False)
    assert len(CATALOG) == 11 and cas9.with_distance(2) != cas9 and motif("Cas9", 2).distance == 2
    assert cas9.append_pam("A" * 20) == "A" * 20 + "NGG" and cas12.append_pam("C" * 21)[:4] == "TTTV"
    assert cas9.same(Motif("mine", cas9.guide_pattern, cas9.pam_pattern)) and "PAM NGG" in cas9.describe()
    assert motif("test").orient("ACG") == "GCA" and motif("Cas9", ambig_max=3).ambig_max == 3
    one_strand = Motif("f", "NNNX", "XXXG", reverse=False)
    assert one_strand.rve == "" and one_strand.fwd == "NNNG"


@pytest.mark.parametrize("bad", [("NNNX", "XXG"), ("NNXX", "XXXG"), ("NXNX", "XGXG"), ("NNNX", "XXXJ")])
def test_bad_motifs(bad):
    with pytest.raises(ValueError):
        Motif("bad", *bad)
    with pytest.raises(ValueError):
        motif("no such")


def test_combining_patterns():
    assert combine("NNX", "XXG") == "NNG" and reverse_complement("ACGTN-RY") == "RY-NACGT"


def test_guide_checks():
    m = motif("Cas9", 3)
    m.check_guides(["A" * 20, "N" * 20], 3)
    for guides, distance, concrete in ((["A" * 19], 1, False), ([], 4, False), (["N" * 20], 1, True), (["A" * 19 + "-"], 1, False)):
        with pytest.raises(ValueError):
            m.check_guides(guides, distance, concrete)


def test_letters(spark):
    lit = F.lit
    assert one(spark, dna.reverse_complement(lit("ACGTNR-"))) == "-YNACGT"
    assert [one(spark, dna.is_ambiguous(lit(s))) for s in ("ACGT", "ACN", "A-")] == [False, True, True]
    assert [(one(spark, dna.first_certain(lit(s))), one(spark, dna.last_certain(lit(s)))) for s in ("NACTGN", "ANGN")] == [(2, 5), (1, 3)]
    assert one(spark, dna.expand_ambiguous(lit("WR"))) == ["AA", "TA", "AG", "TG"]
    assert one(spark, dna.expand_ambiguous(lit("N"))) == ["A", "C", "T", "G"] and one(spark, dna.expand_ambiguous(lit("A-"))) == ["AA"]
    assert one(spark, dna.kmers(lit("ACTGA"), 4)) == ["ACTG", "CTGA"] and one(spark, dna.kmers(lit("AC"), 4)) == []
    assert one(spark, dna.skipkmers(lit("ACTGACT"), 3)) == ["ACT", "GAC"] and one(spark, dna.skipkmers(lit("A"), 3)) == []
    assert [dna.min_kmer_size(*x) for x in ((20, 4), (10, 10), (5, 1))] == [4, 0, 2]
    assert [r.kmer for r in dna.all_kmers(spark, 2).orderBy("kmer").collect()] == [a + b for a in "ACGT" for b in "ACGT"]
    for s in ("ACGT", "TTTTTTTTTTTTTTTTTTTTTTTTTTTTTTT", "A" * 24, "G"):
        packed = one(spark, dna.pack2(lit(s)))
        assert one(spark, dna.unpack2(lit(packed), len(s))) == s and packed == sum("ACGT".index(c) * 4**i for i, c in enumerate(reversed(s)))
    assert one(spark, dna.equal_shifted(dna.pack2(lit("ACGTAC")), dna.pack2(lit("ACGT")), 4))
    assert (one(spark, dna.hamming(lit("RGTGACGG"), lit("WCTGACTG"))), one(spark, dna.hamming(lit("RGTGACGG"), lit("WCTGACTG"), dna.inclusive))) == (2, 3)
    assert [one(spark, dna.inclusive(lit(a), lit(b))) for a, b in ("WR", "NW", "N-", "--")] == [False, True, False, False]
    assert one(spark, dna.common_prefix(lit("ACGT"), lit("ACT"))) == 2 and one(spark, dna.ungap(lit("A-C-"))) == "AC"
    assert len(one(spark, dna.random_dna(lit(7), 50))) == 50
    assert one(spark, dna.shares_kmers(dna.kmers(lit("ACGTA"), 2), dna.kmers(lit("CGTT"), 2), 2))


CASES = [("ATGA", "AGACCT", 4, 1), ("ATGATCG", "AGAAATCGATG", 4, 3), ("TGAGAA", "CATCAAAAA", 2, 3), ("TA", "CCTACCC", 10, 2), ("A", "", 3, 1), ("ACGT", "ACGT", 0, 0)]


@pytest.mark.parametrize(("g", "s", "k", "d"), CASES)
def test_known_distances(spark, g, s, k, d):
    assert al.align_batch([g], [s], k)[0][2] == min(d, k + 1) and al.distance_batch([g], [s], k)[0][0] == min(d, k + 1)
    assert one(spark, dna.free_end_distance(F.lit(g), F.lit(s), len(g), min(k, len(g)))) == min(d, min(k, len(g)) + 1)


def test_known_alignment():
    assert al.align_batch(["ATGATCG"], ["AGAAATCGATG"], 4)[0] == ("ATG--ATCG", "A-GAAATCG", 3)
    assert al.align_batch(["AACGT"], ["AAACGT"], 4)[0][:2] == ("AA-CGT", "AAACGT") and al.align_batch(["AACGT"], ["AAACGT"], 4, strip=False)[0][:2] == ("-AACGT", "AAACGT")


def test_alignments_have_their_distance():
    rng = random.Random(1)
    guides = ["".join(rng.choices("ACGT", k=8)) for _ in range(600)]
    sites = ["".join(c if rng.random() < 0.8 else rng.choice("ACGTRN-") for c in g) + "".join(rng.choices("ACGT", k=3)) for g in guides]
    for strip in (True, False):
        for (a, b, d), g, s in zip(al.align_batch(guides, sites, 3, strip=strip), guides, sites, strict=True):
            want = plain_distance(g, s, compatible)
            assert d == min(want, 4)
            if d <= 3:
                assert a.replace("-", "") == g and len(a) == len(b)
                assert sum(x == "-" or y == "-" or not compatible(x, y) for x, y in zip(a, b, strict=True)) == d
    for match, ok in (("inclusive", lambda a, b: MASKS[a] & MASKS[b] in (MASKS[a], MASKS[b]) and MASKS[a] * MASKS[b] > 0), ("equal", lambda a, b: a == b and a != "-")):
        assert [d for d, _ in al.distance_batch(guides, sites, 3, match)] == [min(4, plain_distance(g, s, ok)) for g, s in zip(guides, sites, strict=True)]
    with pytest.raises(ValueError):
        al.distance_batch(["A"], ["A"], 1, "odd")


def test_column_forms_agree(spark):
    rng = random.Random(2)
    rows = [("".join(rng.choices("ACGT", k=7)), "".join(rng.choices("ACGTN", k=9))) for _ in range(300)] + [(None, "ACGTACGTA"), ("ACGTACG", None)]
    df = spark.createDataFrame(rows, "g string, s string")
    got = df.select("g", "s", al.align(F.col("g"), F.col("s"), 2).alias("a")).collect()
    for r in got:
        if r.g is None or r.s is None:
            assert r.a is None or r.a.distance is None
        else:
            assert r.a.distance == min(3, plain_distance(r.g, r.s, compatible))
    both = df.where("g is not null and s is not null")
    for r in both.select("g", "s", al.masked_distance(F.col("g"), F.col("s"), 2).alias("d"), dna.free_end_distance("g", "s", 7, 2).alias("e")).collect():
        assert r.d == min(3, plain_distance(r.g, r.s, compatible))
        assert r.e == min(3, plain_distance(r.g, r.s, lambda a, b: a == b))


@pytest.mark.parametrize(("q", "k", "length"), [("ACG", 1, 4), ("ACGT", 2, 5), ("AAC", 2, 5), ("ACGTA", 1, 3), ("ACG", 0, 2)])
def test_neighbourhoods_are_complete(q, k, length):
    from itertools import product

    found = neighbourhood(q, k, length)
    for word in map("".join, product("ACGT", repeat=length)):
        whole = length >= len(q) + k
        want = plain_distance(q, word, lambda a, b: a == b)
        if not whole:  # the site may go on after the word, so the guide needn't be spent
            want = min(want, *(edits(q[:i], word) for i in range(len(q) + 1)))
        assert found.get(word, k + 1) == min(want, k + 1)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
        row = new
    return row[-1]


def test_mismatch_neighbourhood():
    found = neighbourhood("ACG", 1, 3, mismatch_only=True)
    assert len(found) == 10 and found["ACG"] == 0 and found["ACT"] == 1
