import hashlib
import random
import re

from pamsieve.llm.substring_dedup import substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    firsts = {}
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, ws in words:
        if i is not None:
            for a in range(len(ws) - window + 1):
                key = tuple(ws[a : a + window])
                firsts[key] = min(i, firsts.get(key, i))
    out = []
    for i, ws in words:
        gone = set()
        if i is not None:
            for a in range(len(ws) - window + 1):
                if firsts[tuple(ws[a : a + window])] < i:
                    gone |= set(range(a, a + window))
        out.append((i, len(ws), len(gone), " ".join(w for k, w in enumerate(ws) if k not in gone)))
    return sorted(out, key=repr)


def run(spark, rows, window=13, **more):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, h1 string, at int")
    return sorted(map(tuple, substring_dedup(df, window=window, **more).collect()), key=repr)


def test_random_texts_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = ["a", "b", "é", "ß x", "w" * 100, "token", "\x1c"]
    passages = [" ".join(rng.choices(vocabulary, k=rng.randint(10, 40))) for _ in range(6)]
    rows = []
    for i in range(80):
        parts = [rng.choice(passages) if rng.random() < 0.4 else " ".join(rng.choices(vocabulary, k=rng.randint(0, 30))) for _ in range(rng.randint(1, 5))]
        rows.append((rng.randint(0, 60), rng.choice(["\n", " ", "\t \x0b"]).join(parts)))
    for more in ({}, {"max_counters": 1 << 16}):
        assert run(spark, rows, 13, **more) == brute(rows, 13)


def test_a_tiny_sketch_loses_nothing(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices("abcdefgh", k=60))) for i in range(40)]
    rows += [(100 + i, t) for i, t in rows[:5]]
    assert run(spark, rows, 8, max_counters=1 << 16, filter_bits=1 << 15) == brute(rows, 8)


def test_defined_cases(spark):
    long = " ".join(f"w{i}" for i in range(300_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, "a b c " * 10), (5, "a b c " * 10), (5, "a b c " * 10), (6, "a b c " * 10), (7, long), (8, long + " end"), (None, None)]
    assert run(spark, rows) == brute(rows, 13)
    assert run(spark, []) == []


def test_digest_of_kept_words(spark):
    rows = [(1, "x  y\nz")]
    assert hashlib.sha256(run(spark, rows)[0][3].encode()).hexdigest() == hashlib.sha256(b"x y z").hexdigest()


def test_passages_that_most_texts_share(spark):
    """Tasks mark what they see twice themselves; nothing changes for what they see once."""
    rng = random.Random(9)
    passage = " ".join(rng.choices("abcdefghij", k=30))
    rows = [(rng.randint(0, 300), passage + " " + " ".join(rng.choices("klmnop", k=20))) for _ in range(200)] + [(400, passage * 3)]
    assert run(spark, rows, 13) == brute(rows, 13)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    assert sorted(map(tuple, substring_dedup(df, window=13).collect()), key=repr) == brute(rows, 13)
