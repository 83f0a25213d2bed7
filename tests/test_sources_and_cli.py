import csv
import glob
import gzip
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pamsieve import cli, persistence
from pamsieve.motif import motif
from pamsieve.operators import ranges as rg
from pamsieve.operators import text_index as ti
from pamsieve.operators import variants as va
from pamsieve.operators.search import search
from pamsieve.operators.sites import sites, tiles
from pamsieve.plans import queries
from pamsieve.sources import contigs as co
from pamsieve.sources import tables as tb
from pamsieve.streaming import guides as st

from .test_search import brute_hits, brute_sites, frame, genome, guides_of

HEADER = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\n"


def fasta(path, seqs, width=37):
    path.write_text("".join(f">{c} some text\n" + "".join(s[i : i + width] + "\n" for i in range(0, len(s), width)) for c, s in seqs.items()))
    return str(path)


def test_fasta_and_2bit(spark, tmp_path):
    seqs = genome(11)
    a = fasta(tmp_path / "g.fa", {**seqs, "empty": ""})
    (tmp_path / "g.2bit").write_bytes(co.encode_2bit(list(seqs.items())))
    for path in (a, str(tmp_path / "g.2bit")):
        rows = co.read_genome(spark, path).orderBy("chrom_id").collect()
        assert [(r.chrom, r.n, r.seq) for r in rows] == [(c, len(s), s) for c, s in sorted(seqs.items())]
    one, two = co.genome_info(spark, a), co.genome_info(spark, str(tmp_path / "g.2bit"))
    assert one.fasta and not two.fasta and one.contigs == two.contigs and one.same(one) and not one.same(two) and one.longest == max(map(len, seqs.values()))
    with pytest.raises(ValueError):
        co.is_fasta("x.txt")
    with pytest.raises(ValueError):
        co.is_fasta("none")
    with pytest.raises(ValueError):
        co.decode_2bit(b"\0" * 32)


def test_vcf(spark, tmp_path):
    text = HEADER + "c1\t148\t.\ta\tA,G,T\t.\textra\tmore\nc1\t149\trs1\tA\tA,AG,AGG\nc2\t180\t.\tC\t.\nc2\t5\t.\tTCAG\tT\n"
    (tmp_path / "v.vcf").write_text(text)
    with gzip.open(tmp_path / "v.vcf.gz", "wt") as f:
        f.write(text)
    for name in ("v.vcf", "v.vcf.gz"):
        got = [tuple(r) for r in tb.read_vcf(spark, str(tmp_path / name)).orderBy("rec_no").collect()]
        assert got == [(1, "1", "c1", 148, 148, "A", ["D"]), (2, "rs1", "c1", 149, 149, "A", ["A", "AG", "AGG"]), (3, "3", "c2", 180, 180, "C", [""]), (4, "4", "c2", 5, 8, "TCAG", ["T"])]
    assert tb.read_vcf(spark, str(tmp_path / "v.vcf"), missing_alt="skip").count() == 3
    with pytest.raises(ValueError):
        tb.read_vcf(spark, "x.txt")


def test_haplotypes(spark):
    seq = "ACGTACGTACGTACGTACGTACGGACGTAACGTTGGCATCGA" * 3
    m = motif("test", 1)
    contigs = frame(spark, {"c": seq})
    make = lambda rows: tb.variants_of(spark.createDataFrame(rows, "rec_no long, id string, chrom string, pos long, ref string, alt string"))
    one = make([(1, ".", "c", 30, seq[29:30], "G"), (2, "far", "c", 100, seq[99:102], seq[99:100])])
    haps = {r.variants: r for r in va.haplotypes(one, contigs, m).collect()}
    assert set(haps) == {f"1:{seq[29]}/G", f"far:{seq[99:102]}/{seq[99]}"}
    for r in haps.values():
        e = r.edits[0]
        changed = seq[: e.pos - 1] + r.seq[e.at : e.at + e.len] + seq[e.stop :]
        assert r.seq in changed
    found = va.variant_sites(one, contigs, m).collect()
    for r in found:  # each is a site of the changed contig, and touches the change
        v = haps[r.variants].edits[0]
        whole = seq[: v.pos - 1] + haps[r.variants].seq[v.at : v.at + v.len] + seq[v.stop :]
        assert r.site in {s for _, _, _, s, _ in brute_sites({"c": whole}, m)}
    same = {(a, s, site) for _, a, s, site, _ in brute_sites({"c": seq[:29] + "G" + seq[30:]}, m)}
    want = {x for x in same if x[0] - (len(m) - 1 if x[1] == "+" else 0) <= 30 <= x[0] + (0 if x[1] == "+" else len(m) - 1)}
    assert {(r.start, r.strand, r.site) for r in found if r.variants.startswith("1:")} == want
    near = make([(1, ".", "c", 30, seq[29:30], "A,AC"), (2, ".", "c", 33, seq[32:33], "C,GG"), (3, ".", "zz", 1, "A", "C")])
    assert va.haplotypes(near, contigs, m).count() == 4 and va.haplotypes(near, contigs, m, overlaps=False).count() == 4
    assert {r.group_no for r in va.variant_groups(near, m).where("chrom = 'c'").collect()} == {1}
    assert va.haplotypes(near, contigs, m, include_ref=True).count() == 9
    assert va.mismatched_references(make([(1, ".", "c", 1, "T", "G"), (2, ".", "c", 1, "A", "G")]), contigs).count() == 1
    assert va.variant_sites(near.limit(0), contigs, m).collect() == []


def test_text_index(spark):
    texts = spark.createDataFrame([("t", 11, "abracadabra"), ("u", 40_000, "ab" * 20_000)], "chrom string, n long, seq string")
    pats = spark.createDataFrame([(p,) for p in ("a", "abra", "d", "aaa", "bab", "")], "pattern string")
    got = {r.pattern: r.n for r in ti.count(texts.where("chrom = 't'"), pats).collect()}
    assert got == {"a": 5, "abra": 2, "d": 1, "aaa": 0, "bab": 0, "": 0}
    assert sorted(r.pos for r in ti.locate(texts, pats.where("pattern = 'abra'")).collect()) == [1, 8]
    assert ti.locate(texts, pats.where("pattern = 'bab'")).count() == 19_999
    t = texts.where("chrom = 't'")
    assert ti.rank(t, "a", 4).first().n == 2 and ti.frequency(t, "a", 2, 8).first().n == 3
    assert [ti.select(t, "a", j).first().pos for j in (1, 5, 6)] == [1, 11, 0]
    assert [(r.j, r.pos) for r in ti.symbol_positions(t, "b").orderBy("j").collect()] == [(1, 2), (2, 9)]
    assert {r.symbol: r.n for r in ti.symbol_counts(t).collect()} == {"a": 5, "b": 2, "r": 2, "c": 1, "d": 1}
    s = "abracadabra"
    order = sorted(range(len(s)), key=lambda i: s[i:])
    assert [r.pos for r in ti.suffix_array(t).orderBy("i").collect()] == order
    assert [r.symbol for r in ti.bwt(t).orderBy("i").collect()] == [s[i - 1] if i else "" for i in order]
    assert {r.chrom: r.seq for r in ti.restore(tiles(texts, 10, 64)).collect()} == {"t": s, "u": "ab" * 20_000}
    assert {r.word: r.n for r in ti.word_counts(t, 4).collect()}["abra"] == 2


def test_kmers_of_whole_texts(spark, tmp_path):
    rng = random.Random(4)
    docs = ["".join(rng.choices("acgt TG,é7", k=k)) for k in (0, 5, 6, 499, 700, 90_000)] + ["tile" * 20_000, None]
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    seqs = [r.seq for r in queries._contigs(spark, str(tmp_path)).collect()]
    assert max(map(len, seqs)) > 1 << 16
    want = Counter(s[i : i + 6] for s in seqs for i in range(len(s) - 5))
    assert {r.kmer: r.n for r in queries.kmers(spark, str(tmp_path)).collect()} == want
    few = ti.kmer_counts(spark.createDataFrame([("t", 11, "abracadabra"), ("u", 1, "a")], "chrom string, n long, seq string"), 4, most=1)
    assert {r.kmer: r.n for r in few.collect()} == {"abra": 2} | dict.fromkeys(("brac", "raca", "acad", "cada", "adab", "dabr"), 1)


def test_ranges(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate("aabbbca")], "i int, v string")
    got = sorted((r.start, r.stop, r.v) for r in rg.ranges(df, "v", "i").collect())
    assert got == [(1, 2, "a"), (3, 5, "b"), (6, 6, "c"), (7, 7, "a")]
    spelled = rg.places_of_ranges(rg.ranges(df, "v", "i")).orderBy("place").collect()
    assert "".join(r.v for r in spelled) == "aabbbca"
    lengths = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "i int, n int")
    assert [(r.start, r.stop) for r in rg.ranges_of_lengths(lengths, "n", "i").orderBy("i").collect()] == [(1, 2), (3, 5), (6, 6)]
    assert [r.is_duplicate for r in rg.duplicated(df, ["v"], "i").orderBy("i").collect()] == [False, True, False, True, True, False, True]
    for values, want in ((range(1, 11), 5), (range(1, 12), 6), ([1] * 4 + [2] + [5] * 4, 2)):
        assert rg.balance(spark.createDataFrame([(v,) for v in values], "v int"), "v").first().balance == want
    a = spark.createDataFrame([("c", 1, 5000), ("c", 10, 20), ("d", 1, 9)], "chrom string, start long, stop long")
    b = spark.createDataFrame([("c", 18, 3000), ("d", 10, 12), ("c", 5001, 5002)], "chrom string, start long, stop long")
    assert rg.overlapping(a, b, "chrom").count() == 2


def test_stored_sites_and_streams(spark, tmp_path):
    seqs = genome(12, letters="ACGT")
    m = motif("test", 1)
    found = sites(frame(spark, seqs), m)
    persistence.save_sites(found, str(tmp_path / "db"), m, 2, files=3, name="x", genome="g")
    table, again, about = persistence.load(spark, str(tmp_path / "db"))
    assert again == m and about["name"] == "x" and table.count() == found.count() and "prefix" in table.columns
    with pytest.raises(ValueError):
        persistence.save_sites(found, str(tmp_path / "no"), m, 9)
    guides = guides_of(spark, seqs, m, 4)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(guides[:2]) + "\n")
    (tmp_path / "in" / "b.txt").write_text("\n".join(guides[2:]) + "\nBAD\n")
    hits = st.search_stream(st.guide_stream(spark, str(tmp_path / "in")), table, m, 1)
    st.run_once(hits, "hits", "append", str(tmp_path / "c1"))
    got = sorted((r.guide, r.distance, r.chromosome, r.start, r.strand) for r in spark.table("hits").distinct().collect())
    concrete = {(c, a, s) for c, a, s, _, odd in brute_sites(seqs, m) if not odd}
    assert got == [h for h in brute_hits(seqs, m, guides, 1) if h[2:] in concrete]
    st.run_once(st.summary_stream(hits, 1), "sums", "complete", str(tmp_path / "c2"))
    assert spark.table("sums").count() == len(set(guides))


def rows_of(path):
    return [r for f in sorted(glob.glob(f"{path}/*.csv")) for r in csv.DictReader(open(f))]


def test_command_line(spark, tmp_path, capsys):
    seqs = genome(13, letters="ACGT")
    m = motif("test", 1)
    g, p = fasta(tmp_path / "g.fa", seqs), str(tmp_path)
    guides = guides_of(spark, seqs, m, 3)
    (tmp_path / "guides.txt").write_text("\n".join(guides) + "\n")
    (tmp_path / "v.vcf").write_text(HEADER + f"c0\t50\t.\t{seqs['c0'][49]}\t{'A' if seqs['c0'][49] != 'A' else 'C'}\n")
    run = lambda *a: cli.main(list(a), spark)
    assert run("list") == 0 and "Cas12a" in capsys.readouterr().out
    common = ["--genome", g, "--motif", "test", "--distance", "1", "--prefix_length", "2"]
    want = len(brute_hits(seqs, m, guides, 1))
    for kind in ("linearDB", "prefixHashDB"):
        assert run("build", kind, "--output", f"{p}/{kind}", *common) == 0
        assert run("search", kind, "--database", f"{p}/{kind}", "--guides", f"{p}/guides.txt", "--output", f"{p}/out-{kind}", "--distance", "1") == 0
        assert len(rows_of(f"{p}/out-{kind}")) == want
    stop = ["--distance", "1", "--early_stopping", "0", "0"]
    assert run("search", "prefixHashDB", "--database", f"{p}/prefixHashDB", "--guides", f"{p}/guides.txt", "--output", f"{p}/few", *stop) == 0
    assert len(rows_of(f"{p}/few")) == len(set(guides))
    assert run("filter", "--detail_file", f"{p}/out-linearDB", "--output", f"{p}/filtered", "--distance", "5") == 0
    assert 0 < len(rows_of(f"{p}/filtered")) <= want
    assert run("summarize", "--detail_file", f"{p}/out-linearDB", "--output", f"{p}/summary", "--distance", "1") == 0
    assert sum(int(r["D0"]) + int(r["D1"]) for r in rows_of(f"{p}/summary")) == want
    for kind in ("dictDB", "hashDB"):
        assert run("build", kind, "--output", f"{p}/{kind}", *common) == 0
        assert run("estimate", "--database", f"{p}/{kind}", "--guides", f"{p}/guides.txt", "--output", f"{p}/est-{kind}", "--right") == 0
        assert set(rows_of(f"{p}/est-{kind}")[0]) == {"guide", "D0", "D1"}
    for kind in ("pamDB", "template", "fmi"):
        assert run("build", kind, "--output", f"{p}/{kind}", *common) == 0
    assert run("build", "vcfDB", "--output", f"{p}/vcfDB", "--vcf", f"{p}/v.vcf", *common) == 0
    assert run("search", "vcfDB", "--database", f"{p}/vcfDB", "--guides", f"{p}/guides.txt", "--output", f"{p}/out-vcf", "--distance", "1") == 0
    assert all(r["variants"].startswith("1:") for r in rows_of(f"{p}/out-vcf"))
    assert run("build", "linearDB", "--output", f"{p}/bad", "--genome", g) == 1
    assert run("build", "vcfDB", "--output", f"{p}/bad", *common) == 1
    assert run("search", "treeDB", "--database", f"{p}/nowhere", "--guides", f"{p}/guides.txt", "--output", f"{p}/bad") == 1
    own = ["--fwd_motif", "NNNX", "--fwd_pam", "XXXG", "--distance", "1", "--not_reverse", "--prefix_length", "2"]
    assert run("build", "treeDB", "--output", f"{p}/own", "--genome", g, *own) == 0
    assert persistence.load(spark, f"{p}/own")[0].where(F.col("strand") == "-").count() == 0
    assert search(persistence.load(spark, f"{p}/own")[0], tb.read_guides(spark, f"{p}/guides.txt"), m, 0, alignments=False).count() > 0
