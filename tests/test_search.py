import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pamsieve.motif import MASKS, Motif, motif, reverse_complement
from pamsieve.operators import estimate as est
from pamsieve.operators import post
from pamsieve.operators import search as se
from pamsieve.operators import sites as si
from pamsieve.operators import text_index as ti
from pamsieve.sources.contigs import derived_contigs

from .test_functions import compatible, plain_distance

CONTIGS = "chrom_id int, chrom string, n long, seq string"


def genome(seed, sizes=(400, 150, 30, 5), letters="ACGT" * 12 + "N"):
    rng = random.Random(seed)
    return {f"c{i}": "N" * (i % 2 * 7) + "".join(rng.choices(letters, k=n)) + "N" * (i % 3 * 5) for i, n in enumerate(sizes)}


def frame(spark, seqs):
    return spark.createDataFrame([(i, c, len(s), s) for i, (c, s) in enumerate(seqs.items())], CONTIGS)


def brute_sites(seqs, m: Motif):
    out = set()
    p, g, d, w = len(m.pam), m.length_no_pam, m.distance, len(m)
    for chrom, s in seqs.items():
        certain = [i for i, c in enumerate(s) if c != "N"]
        if not certain:
            continue
        lo, hi = certain[0] + 1, certain[-1] + 1
        for minus, pattern in ((False, m.fwd), (True, m.rve)):
            left = minus != m.extends5  # guide and extension lie left of the PAM
            a, b = (max(1, lo - d), hi) if left else (lo, min(len(s), hi + d))
            for i in range(a, b - w + 2 if pattern else a):
                window = s[i - 1 : i - 1 + w]
                if not all(compatible(x, y) for x, y in zip(window, pattern, strict=True)) or sum(c not in "ACGT" for c in window) > m.ambig_max:
                    continue
                if left:
                    text = ("-" * d + s[: i - 1])[-d:] + window[:g] if d else window[:g]
                    site, start = text[::-1], i + w - 1
                else:
                    site, start = window[p:] + (s[i - 1 + w :] + "-" * d)[:d], i
                if minus:
                    site = reverse_complement(site)[::-1]
                out.add((chrom, start, "-" if minus else "+", site, any(c not in "ACGT" for c in site)))
    return out


SHORT = Motif("short", "NNNNNNXX", "XXXXXXGG", distance=2)
FIRST = Motif("first", "XXXNNNNNN", "TTVXXXXXX", distance=1, extends5=False)
MOTIFS = [SHORT, FIRST, motif("test"), SHORT.with_ambig(2), FIRST.with_ambig(9), Motif("plus", "NNNNNXX", "XXXXXNG", reverse=False, distance=3), Motif("minus", "XXNNNN", "TCXXXX", forward=False, extends5=False, distance=0)]


@pytest.mark.parametrize("m", MOTIFS, ids=lambda m: f"{m.alias}{m.ambig_max}")
def test_sites_against_brute_force(spark, m):
    seqs = genome(1)
    for tile in (si.TILE, 16):
        got = [tuple(r) for r in si.sites(frame(spark, seqs), m, tile).collect()]
        assert len(got) == len(set(got)) and set(got) == brute_sites(seqs, m)


def test_pam_positions(spark):
    seqs = {"c": "AAGGTTCCGG"}
    got = sorted(tuple(r) for r in si.pam_positions(frame(spark, seqs), SHORT).collect())
    assert got == sorted([("c", 3, "+"), ("c", 9, "+"), ("c", 8, "-")])
    first = sorted(tuple(r) for r in si.pam_positions(frame(spark, {"c": "CTTACCBAAA".replace("B", "G")}), FIRST).collect())
    assert first == sorted([("c", 4, "+"), ("c", 7, "-")])


def test_all_sites(spark):
    seqs = genome(3)
    certain, odd = si.all_sites(frame(spark, seqs), SHORT)
    assert certain.count() + odd.count() == len(brute_sites(seqs, SHORT)) and odd.where("not is_ambig").count() == 0
    whole = si.all_sites(frame(spark, seqs), SHORT, remove_pam=False, normalize=False)[0].collect()
    assert whole and all(r.site.endswith("GG") and len(r.site) == 8 for r in whole)
    bare = si.all_sites(frame(spark, seqs), SHORT, normalize=False, length=4)[0].collect()
    assert bare and all(len(r.site) == 4 for r in bare)
    flipped = si.all_sites(frame(spark, seqs), SHORT, remove_pam=False)[0].collect()
    assert all(r.site.startswith("GG") for r in flipped)


def guides_of(spark, seqs, m, n=6, seed=5):
    rng = random.Random(seed)
    found = sorted({s[: m.length_no_pam] for _, _, _, s, odd in brute_sites(seqs, m) if not odd})
    picked = ["".join(rng.choice("ACGT") if rng.random() < 0.1 else c for c in q) for q in rng.sample(found, n)]
    return [q[::-1] if m.extends5 else q for q in picked]


def brute_hits(seqs, m, guides, k):
    sites = brute_sites(seqs, m)
    return sorted((g, d, c, a, s) for g in set(guides) for c, a, s, site, _ in sites if (d := plain_distance(m.orient(g), site, compatible)) <= k)


@pytest.mark.parametrize("m", [SHORT, FIRST, SHORT.with_ambig(2)], ids=lambda m: f"{m.alias}{m.ambig_max}")
@pytest.mark.parametrize("strategy", ["nested_loop", "seed", "qgram", "neighbourhood", "auto"])
def test_strategies_agree(spark, m, strategy):
    seqs = genome(2)
    guides = guides_of(spark, seqs, m)
    table = spark.createDataFrame([(g,) for g in [*guides, guides[0]]], "guide string")
    sites = si.sites(frame(spark, seqs), m)
    hits = se.search(sites, table, m, 1, strategy).collect()
    assert sorted((h.guide, h.distance, h.chromosome, h.start, h.strand) for h in hits) == brute_hits(seqs, m, guides, 1)
    for h in hits:
        pairs = list(zip(h.alignment_guide, h.alignment_reference, strict=True))
        assert h.alignment_guide.replace("-", "") == h.guide and sum("-" in p or not compatible(*p) for p in pairs) == h.distance


def test_other_searches(spark):
    seqs = genome(4, letters="ACGT")
    guides = guides_of(spark, seqs, SHORT)
    table = spark.createDataFrame([(g,) for g in guides], "guide string")
    sites = si.sites(frame(spark, seqs), SHORT)
    exact = se.exact_search(si.guide_windows(frame(spark, seqs), SHORT), table, SHORT).collect()
    assert sorted((h.guide, h.distance, h.chromosome, h.start, h.strand) for h in exact) == [h for h in brute_hits(seqs, SHORT, guides, 0)]
    same = se.search(sites, table, SHORT, 1, "nested_loop", alignments=False, mismatch_only=True).collect()
    want = [(g, c, a) for g in set(guides) for c, a, s, site, _ in brute_sites(seqs, SHORT) if sum(x != y for x, y in zip(g[::-1], site, strict=False)) <= 1]
    assert sorted((h.guide, h.chromosome, h.start) for h in same) == sorted(want)
    any_guide = spark.createDataFrame([("N" * 6,)], "guide string")
    assert se.search(sites, any_guide, SHORT, 0, alignments=False).count() == sites.count()
    with pytest.raises(ValueError):
        se.search(sites, spark.createDataFrame([("ACG",)], "guide string"), SHORT)
    with pytest.raises(ValueError):
        se.search(sites, table, SHORT, 1, "magic")


def test_estimates_are_counts(spark):
    seqs = genome(6, letters="ACGT")
    m = SHORT.with_distance(2)
    guides = guides_of(spark, seqs, m)
    table = spark.createDataFrame([(g,) for g in guides], "guide string")
    counts = est.site_counts(si.sites(frame(spark, seqs), m))
    got = {r.guide: tuple(r)[1:] for r in est.estimate(counts, table, m, 2).collect()}
    concrete = [s for _, _, _, s, odd in brute_sites(seqs, m) if not odd]
    for g in set(guides):
        d = [plain_distance(g[::-1], s, compatible) for s in concrete]
        assert got[g] == tuple(d.count(i) for i in range(3))
    capped = est.estimate(counts, table, m, 1, max_count=1).collect()
    assert all(r.D0 <= 1 for r in capped) and est.right_or_left(counts, table, m, 1).count() == len(set(guides)) == est.right_or_left(counts, table, m, 1, right=False).count()
    bins = {r.bin: r.sites for r in est.count_bins(counts, 3).collect()}
    assert sum(bins.values()) == len(set(concrete))
    sketch = est.sketch_counts(si.sites(frame(spark, seqs), m)).first()
    assert sketch.total == len(concrete) and len(sketch.sketch) > 0


def random_hits(spark, n=300):
    rng = random.Random(9)
    rows = [(rng.choice("gh"), None, None, rng.randint(0, 3), rng.choice(["c1", "c2"]), rng.randint(1, 400), rng.choice("+-")) for _ in range(n)]
    return spark.createDataFrame(rows, "guide string, alignment_guide string, alignment_reference string, distance int, chromosome string, start long, strand string")


def test_overlaps_are_removed(spark):
    hits = random_hits(spark).dropDuplicates(["guide", "chromosome", "strand", "start"])
    for window in (0, 3, 23):
        a = sorted(map(tuple, post.filter_overlapping(hits, window).collect()), key=repr)
        b = sorted(map(tuple, post.filter_overlapping_pandas(hits, window).collect()), key=repr)
        assert a == b
    assert post.filter_overlapping(hits.limit(0), 3).collect() == []


def test_summaries(spark):
    hits = random_hits(spark)
    pdf = hits.toPandas()
    got = post.summarize(hits, 2).toPandas()
    want = pd.crosstab(pdf.guide, pdf.distance)
    for r in got.itertuples():
        assert [r.D0, r.D1, r.D2] == want.loc[r.guide, [0, 1, 2]].tolist()
    assert post.tidy(got.pipe(lambda p: spark.createDataFrame(p[["D1", "D0", "guide", "D2"]]))).columns == ["guide", "D0", "D1", "D2"]


def test_early_stops(spark):
    hits = random_hits(spark)
    rows = sorted((r.guide, r.distance, r.chromosome, r.start, r.strand) for r in hits.collect())
    for limits in ([0, 0, 0, 0], [3, 50, 2, 1], [1000] * 4, [1000, 2]):
        want = []
        for g in "gh":
            seen = [0] * len(limits)
            for r in (r for r in rows if r[0] == g and r[1] < len(limits)):
                want.append(r)
                seen[r[1]] += 1
                if seen[r[1]] >= max(1, limits[r[1]]):
                    break
        got = sorted((r.guide, r.distance, r.chromosome, r.start, r.strand) for r in se.early_stop(hits, limits).collect())
        assert got == want
    capped = se.cap_per_distance(hits, [1, 2, 3, 4]).groupBy("guide", "distance").count().collect()
    assert all(r["count"] <= r.distance + 1 for r in capped)
    with pytest.raises(ValueError):
        se.early_stop(hits, [])


def test_shifted_hits_are_suppressed(spark):
    hits = random_hits(spark)
    kept = {}
    for r in sorted(hits.collect(), key=lambda r: (r.distance, r.start)):
        group = kept.setdefault((r.guide, r.chromosome, r.strand), [])
        if not any(abs(s - r.start) <= r.distance - d for d, s in group):
            group.append((r.distance, r.start))
    got = {}
    for r in se.suppress_shifted(hits).collect():
        got.setdefault((r.guide, r.chromosome, r.strand), []).append((r.distance, r.start))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in kept.items()}


def test_positions(spark):
    rng = random.Random(3)
    a = [(rng.choice("xy"), rng.randint(1, 300)) for _ in range(60)]
    b = [(rng.choice("xy"), rng.randint(1, 300)) for _ in range(60)]
    left, right = spark.createDataFrame(a, "chrom string, pos long"), spark.createDataFrame(b, "chrom string, pos long")
    got = sorted(tuple(r) for r in se.near_positions(left, right, 4).collect())
    assert got == sorted((c, p, q) for c, p in a for d, q in b if c == d and abs(p - q) <= 4)
    near = sorted(map(tuple, se.nearest_position(left, right).collect()), key=repr)
    assert near == sorted([(c, p, max((q for d, q in b if d == c and q <= p), default=None)) for c, p in a], key=repr)


def test_derived_genome(spark):
    df = spark.createDataFrame([(1, "Abc d-E1"), (2, "12"), (3, None)], "doc_id long, text string")
    assert [(r.chrom, r.seq, r.n) for r in derived_contigs(df).collect()] == [("1", "ACGTA", 5)]
    assert derived_contigs(df, digits="N").count() == 2 and set(derived_contigs(df, digits="N").first().seq) <= set(MASKS)
    assert derived_contigs(df).select(F.col("n") == F.char_length("seq")).first()[0]


def occurrences(texts, patterns):
    return sorted((p, c, i + 1) for c, t in texts for p in set(patterns) if p for i in range(len(t)) if t.startswith(p, i))


def test_substrings_are_located_in_one_scan(spark, monkeypatch):
    rng = random.Random(12)
    texts = [(f"c{i}", "".join(rng.choices("ACGT", k=rng.choice([1, 5, 300, 70_000])))) for i in range(12)]
    texts += [("odd", "é日\U0001f600é日\U0001f600A" * 30), ("runs", "A" * 40_000 + "C" + "A" * 40_000), ("empty", "")]
    patterns = ["A", "AAAA", "ACGT", "GATTACA", "\U0001f600é", "日", texts[3][1][:200], "A" * 300, "C" + "A" * 999, "absent", "", None, "ACGT"]
    df = frame(spark, dict(texts))
    wanted = spark.createDataFrame([(p,) for p in patterns], "pattern string")
    want = occurrences(texts, [p for p in patterns if p])
    assert sorted(map(tuple, ti.locate(df, wanted).collect())) == want
    assert {r.pattern: r.n for r in ti.count(df, wanted).collect()} == {p: sum(w[0] == p for w in want) for p in patterns}
    few = [p for p in patterns if p and len(p) < 8]
    wanted, df = spark.createDataFrame([(p,) for p in few], "pattern string"), frame(spark, {c: t for c, t in texts if len(t) < 1000})
    once = sorted(map(tuple, ti.locate(df, wanted).collect()))
    counts = sorted(map(tuple, ti.count(df, wanted).collect()))
    monkeypatch.setattr(ti, "FEW_PATTERNS", 2)  # now by joins
    assert sorted(map(tuple, ti.locate(df, wanted).collect())) == once and sorted(map(tuple, ti.count(df, wanted).collect())) == counts
    assert ti.locate(df, wanted.limit(0)).collect() == [] == ti.count(df, wanted.limit(0)).collect()


def test_dealt_tiles_give_the_same_sites(spark):
    rng = random.Random(13)
    df = frame(spark, {"long": "".join(rng.choices("ACGTN", weights=[9, 9, 9, 9, 1], k=5000))}).coalesce(1)
    here, dealt = si.sites(df, SHORT, tile=300), si.sites(df, SHORT, tile=300, deal=8)
    assert sorted(map(tuple, here.collect())) == sorted(map(tuple, dealt.collect()))
    assert dealt.select(F.spark_partition_id()).distinct().count() > 1
