import hashlib
import re
import unicodedata

from pyspark.sql import functions as F

from pamsieve.llm import fingerprints as fp

SPACE = re.compile(r"[\s\x0b\x1c-\x1f\x85]+")
TEXTS = [
    (1, "Hello  World"), (2, "hello world\n"), (3, "HELLO WORLD"), (4, "Straße café"), (5, "STRASSE café"), (6, None), (7, ""),
    (8, "ﬁne ΣΣ"), (9, "FINE σς"), (10, "other"), (11, "other"), (12, "x" * 50_000), (13, "  a\tb "), (20, "a b"), (-5, "tail text here"),
]


def canonical(text):
    nfkc = lambda s: unicodedata.normalize("NFKC", s)
    return SPACE.sub(" ", nfkc(nfkc(text or "").casefold())).strip(" ")


def table(spark, rows):
    return spark.createDataFrame([(i, t, "z", 5) for i, t in rows], "doc_id long, text string, canon string, size int").repartition(3)


def test_canonical_forms_and_fingerprints(spark):
    df = table(spark, TEXTS)
    got = {r.doc_id: r.c for r in df.select("doc_id", fp.canonical(F.coalesce("text", F.lit(""))).alias("c")).collect()}
    assert got == {i: canonical(t) for i, t in TEXTS}
    marks = {r.doc_id: r.fingerprint for r in fp.fingerprints(df).collect()}
    for i, s in TEXTS:
        for j, t in TEXTS:
            assert (marks[i] == marks[j]) == (canonical(s) == canonical(t))
    assert all(re.fullmatch("[0-9a-f]{64}", m) for m in marks.values())


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    out = []
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t) // 3
        edited = t[: len(t) - n] + after[:n]
        same = [j for j, u in rows if canonical(u) == canonical(t)]
        least = min((j for j in same if j is not None), default=None)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), float(canonical(edited) == canonical(t)), float(canonical(after) == canonical(t)), least, len(same)))
    return sorted(out, key=repr)


def run(spark, rows):
    got = fp.edited_fingerprints(table(spark, rows)).collect()
    return sorted([(r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next, r.group_id, r.group_size) for r in got], key=repr)


def test_edited_fingerprints_against_brute_force(spark):
    assert run(spark, TEXTS) == brute(TEXTS)
    rows = [(i * i - 300, ("word%d " % (i % 7)) * (i % 11)) for i in range(150)] + [(1 << 60, "far é"), (-(1 << 60), "away")]
    assert run(spark, rows) == brute(rows)


def test_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(fp, "BUCKET_BYTES", 8)
    rows = [(i * i - 300, f"t{i} " * (i % 5)) for i in range(300)]
    assert run(spark, rows) == brute(rows)


def test_repeated_and_null_ids(spark):
    rows = [(1, "b c d"), (1, "a a a"), (1, "a a a"), (None, "n n n n"), (None, None)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, [(None, "x y z")]) == brute([(None, "x y z")])
    assert run(spark, [(4, "lone text")]) == brute([(4, "lone text")])
    assert run(spark, []) == []


def test_bytes_are_compared_inside_equal_buckets(spark, monkeypatch):
    monkeypatch.setattr(fp, "digest", lambda text, lanes=4: F.lpad(F.pmod(F.xxhash64(text), F.lit(3)).cast("string"), 64, "0"))
    got = sorted([(r.doc_id, r.group_id, r.group_size) for r in fp.edited_fingerprints(table(spark, TEXTS)).collect()])
    assert got == sorted([(r[0], r[5], r[6]) for r in brute(TEXTS)])
