import random
import re

import numpy as np
import pytest

from pamsieve.llm.components import components
from pamsieve.llm.jaccard_join import _prefix, _signature, ngram_jaccard_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    ws = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))} if ws else set()


def brute(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t in rows]
    parent = list(range(len(sets)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if i is not None and j is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[root(a)] = root(b)
    least = {}
    for a, (i, x) in enumerate(sets):
        if i is not None:
            least[root(a)] = min(i, least.get(root(a), i))
    return sorted([(i, len(x), None if i is None else least[root(a)]) for a, (i, x) in enumerate(sets)], key=repr)


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(200)] + ["Éa", "THE", "the"]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.65:
            ws = WORD.findall(rng.choice(rows)[1])
            for _ in range(rng.randint(0, 4)):
                if ws:
                    ws[rng.randrange(len(ws))] = rng.choice(vocabulary)
        else:
            ws = rng.choices(vocabulary, k=rng.choice([0, 1, 2, 3, 5, 30, 60, 120]))
        rows.append((i, rng.choice([" ", "\n"]).join(ws)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("k", "percent", "seed"), [(3, 90, 1), (5, 80, 2), (2, 60, 3)])
def test_against_brute_force(spark, k, percent, seed):
    rows = corpus(seed) + [(900, None), (901, ""), (902, " "), (None, "w1 w2 w3"), (903, "w1 w2 w3"), (903, "w1 w2 w3"), (904, "W1\tw2 W3")]
    df = spark.createDataFrame([(i, t, b"x", 0) for i, t in rows], "doc_id long, text string, c binary, label int").repartition(3)
    got = sorted(map(tuple, ngram_jaccard_join(df, shingle=k, percent=percent, max_counters=1 << 12).collect()), key=repr)
    assert got == brute(rows, k, percent)


def test_an_empty_table(spark):
    assert ngram_jaccard_join(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_signatures_bound_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(50):
        x = np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64))
        y = np.unique(np.append(x[rng.random(len(x)) < 0.9], rng.integers(0, 1 << 63, 9, dtype=np.uint64)))
        bits = sum(int(v).bit_count() for v in (_signature(x) ^ _signature(y)).view(np.uint64))
        assert bits <= len(np.setxor1d(x, y))


def test_prefixes_of_linked_sets_share_enough():
    rng = np.random.default_rng(2)
    levels = rng.integers(0, 60, 2 << 12).astype(np.uint8)
    linked = 0
    for _ in range(300):
        x = np.unique(rng.integers(0, 1 << 63, int(rng.integers(1, 200)), dtype=np.uint64))
        y = np.unique(np.append(x[rng.random(len(x)) < 0.95], rng.integers(0, 1 << 63, int(rng.integers(0, 6)), dtype=np.uint64)))
        both = len(np.intersect1d(x, y))
        if len(y) and 100 * both >= 80 * (len(x) + len(y) - both):
            linked += 1
            (p, a), (q, b) = (_prefix(s, levels, 1 << 12, 80, 4.0) for s in (x, y))
            assert len(np.intersect1d(p, q)) >= min(a, b)
    assert linked > 100


def test_components_of_a_chain(spark):
    edges = [(f"{a:04d}", f"{a + 1:04d}") for a in range(200)] + [("x", "y"), ("y", "x")]
    got = {r.v: r.label for r in components(spark.createDataFrame(edges, "x string, y string")).collect()}
    assert got == {f"{a:04d}": "0000" for a in range(201)} | {"x": "x", "y": "x"}
