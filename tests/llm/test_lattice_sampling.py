import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from pamsieve.llm import lattice_sampling
from pamsieve.llm.lattice_sampling import SPACE, Decoder, Lattice, Sampler, Vocabulary, decode, piece_ids, sample_encodings, vocabulary

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["hello world", "", " ", "  two  spaces\n\ttab", "日本語 \U0001f9ff\x00", "é ﬁ▁x", "a" * 300, "x", None]


def segmentations(vocab, text):
    """Every segmentation's weight, from the pieces alone."""
    weight = {}
    for state in np.flatnonzero(vocab.end >= 0):
        weight[vocab.pieces[vocab.end[state]]] = vocab.value[state]
    marked = SPACE + text.replace(" ", SPACE)

    def from_(i):
        if i == len(marked):
            return [((), 0.0)]
        out = []
        for j in range(i + 1, len(marked) + 1):
            w = weight.get(marked[i:j])
            if w is None and j == i + 1:
                w = len(marked[i].encode()) * vocab.byte_weight
            if w is not None:
                out += [((marked[i:j], *rest), w + v) for rest, v in from_(j)]
        return out

    found = dict(from_(0))
    top = max(found.values())
    total = top + math.log(sum(math.exp(v - top) for v in found.values()))
    return {s: v - total for s, v in found.items()}


def ways(vocab, texts, keys, k):
    """For each text [(pieces, log-probability, perturbed)], the largest perturbed first."""
    sampler = Sampler(Lattice(vocab), texts, keys)
    found, out = sampler.sample(k), [[] for _ in texts]
    for row in found.ordered().tolist():
        ids, _ = piece_ids(sampler.lattice, found.edges(row), found.size[row : row + 1])
        out[found.doc[row]].append((tuple(vocab.pieces[i] for i in ids), found.total[row], found.bound[row]))
    return out


def test_samples_are_segmentations_with_their_probability():
    vocab = vocabulary(PATH, 1.0)
    for text in ("hello", "ab cd", "the end", "tion"):
        exact = segmentations(vocab, text)
        for found in ways(vocab, [text] * 50, np.arange(50).astype(np.uint64) * np.uint64(7919), 6):
            names = [s for s, _, _ in found]
            assert len(set(names)) == len(names) == min(6, len(exact))
            assert all(abs(exact[s] - lp) < 1e-6 for s, lp, _ in found)
            assert all(a[2] >= b[2] for a, b in zip(found, found[1:], strict=False))


def test_few_segmentations_are_all_found():
    vocab = vocabulary(PATH, 1.0)
    exact = segmentations(vocab, "ab")
    for found in ways(vocab, ["ab"] * 20, np.arange(20).astype(np.uint64), 50):
        assert len(found) == len(exact)
    assert [len(x) for x in ways(vocab, [""], np.zeros(1, np.uint64), 3)] == [1]


def test_segmentations_of_tiny_probability_are_found():
    for alpha in (6.0, 60.0):  # all but one have probabilities far under 1e-13, or under the smallest double
        vocab = Vocabulary(PATH, alpha)
        exact = segmentations(vocab, "the")
        for found in ways(vocab, ["the"] * 5, np.arange(5).astype(np.uint64), 50):
            assert len({s for s, _, _ in found}) == len(found) == len(exact)
            assert all(abs(exact[s] - lp) < 1e-6 * max(1.0, -lp) for s, lp, _ in found)


def test_lattices_do_not_depend_on_what_else_is_held():
    vocab, texts = vocabulary(PATH, 1.0), ["some words here", "and there", "wörds 日本 here", "x" * 50]
    keys = np.arange(4).astype(np.uint64)
    want = ways(vocab, texts, keys, 3)
    small, found = Lattice(vocab, limit=20), []
    for i in range(4):
        sampler = Sampler(small, texts[i : i + 1], keys[i : i + 1])
        got = sampler.sample(3)
        assert [tuple(piece_ids(small, got.edges(r), got.size[r : r + 1])[0]) for r in got.ordered()] != [] and small.nodes <= max(20, len(texts[i]) + 1)
        found.append([(got.total[r], got.bound[r]) for r in got.ordered()])
    assert found == [[(lp, g) for _, lp, g in w] for w in want]


def test_frequencies_are_those_of_sampling_without_replacement():
    vocab, text, n = vocabulary(PATH, 0.5), "ab c", 6000
    p = {s: math.exp(v) for s, v in segmentations(vocab, text).items()}
    rng = np.random.default_rng(4)
    first, second, third = Counter(), Counter(), Counter()
    for found in ways(vocab, [text] * n, rng.integers(0, 1 << 63, n, dtype=np.uint64), 3):
        for count, (names, _, _) in zip((first, second, third), found, strict=True):
            count[names] += 1
    two = {b: sum(p[a] * p[b] / (1 - p[a]) for a in p if a != b) for b in p}
    three = {c: sum(p[a] * p[b] / (1 - p[a]) * p[c] / (1 - p[a] - p[b]) for a in p for b in p if len({a, b, c}) == 3) for c in p}
    for got, want in ((first, p), (second, two), (third, three)):
        for s, q in want.items():
            assert abs(got[s] / n - q) < 5 * math.sqrt(q * (1 - q) / n) + 1e-3


def test_inclusion_weights_are_unbiased(spark):
    vocab, text, n = vocabulary(PATH, 0.5), "ab c", 3000
    exact = segmentations(vocab, text)
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"))
    rows = sample_encodings(df, PATH, k=3, alpha=0.5).collect()
    # sums over samples weighted by p / inclusion estimate expectations: of 1, and of the number of pieces
    ones = sum(math.exp(r.log_prob) / r.inclusion for r in rows) / n
    size = sum(math.exp(r.log_prob) / r.inclusion * len(r.ids) / 4 for r in rows) / n
    want = sum(math.exp(v) * len(s) for s, v in exact.items())
    assert abs(ones - 1) < 0.03 and abs(size - want) < 0.15 and all(0 < r.inclusion <= 1 for r in rows)


def test_round_trip_and_seeds(spark):
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choices("abc éß日\U0001f600 \n", k=rng.randint(1, 80))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, sample int, key string")
    a = sample_encodings(df.repartition(1), PATH, k=3, decoded=True).withColumn("again", decode(F.col("ids"), PATH)).collect()
    for r in a:
        assert r.again == r.decoded == (texts[r.doc_id] or "").replace(SPACE, " ")
    by = Counter(r.doc_id for r in a)
    assert set(by) == set(range(len(texts))) and by[1] == by[8] == 1 and max(by.values()) == 3
    b = sample_encodings(df.repartition(7), PATH, k=3).collect()
    assert sorted((r.doc_id, r.sample, bytes(r.ids)) for r in a) == sorted((r.doc_id, r.sample, bytes(r.ids)) for r in b)
    c = sample_encodings(df, PATH, k=3, seed=1).collect()
    assert sorted((r.doc_id, r.sample, bytes(r.ids)) for r in c) != sorted((r.doc_id, r.sample, bytes(r.ids)) for r in b)


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "some words"), (4, "some words"), (4, "some words"), (None, None)], "doc_id long, text string")
    got = sample_encodings(df, PATH, k=2).collect()
    assert len(got) == 7
    same = [bytes(r.ids) for r in got if r.doc_id == 4]
    assert Counter(Counter(same).values()) == Counter({2: 2})
    assert sample_encodings(df.limit(0), PATH).collect() == []
    assert spark.createDataFrame([(None,)], "x binary").select(decode(F.col("x"), PATH)).first()[0] is None


def test_very_long_texts(spark):
    texts = ["long words and short ones \n\t" * 20_000, "a" * 100_000, "\n" * 50_000, " " * 50_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sample_encodings(df, PATH, k=2).withColumn("again", decode(F.col("ids"), PATH)).collect()
    assert {(r.doc_id, r.sample): r.again for r in rows} == {(i, s): texts[i] for i in range(4) for s in range(2) if (i, s) != (2, 1)}


def test_stretches_between_breaks_share_lattices():
    # the same words before other marks and behind line ends, which are in no piece: nothing new to put in
    lattice, keys = Lattice(vocabulary(PATH, 1.0)), np.arange(1).astype(np.uint64)
    Sampler(lattice, ["some words here (are)\nthere\u2603 ."], keys)
    held = lattice.nodes
    Sampler(lattice, ["some\n words\u2603 here\u2603 some\nthere\n\n words ."], keys)
    assert lattice.nodes == held


def test_the_threshold_needs_no_further_way(monkeypatch):
    walks, walk = [], Sampler._walk
    monkeypatch.setattr(Sampler, "_walk", lambda self, *rest: walks.append(1) or walk(self, *rest))
    texts, keys = ["some words here", "x", "", "日本\n"], np.arange(4).astype(np.uint64)
    for k in (1, 2, 3):
        more = Sampler(Lattice(vocabulary(PATH, 1.0)), texts, keys).sample(k + 1)
        want = np.full(4, -np.inf)
        want[more.doc[more.number == k]] = more.bound[more.number == k]
        del walks[:]
        found = Sampler(Lattice(vocabulary(PATH, 1.0)), texts, keys).sample(k)
        assert found.beyond.tolist() == want.tolist() and len(walks) <= k


def test_sets_far_behind_are_drawn_where_they_matter(monkeypatch):
    texts = ["some words here, and there", "ab", "", "x" * 40, "日本\n the end of a longer text than the others"]
    keys, calls, opened = np.arange(5).astype(np.uint64), [], lattice_sampling._OpenSets._open
    monkeypatch.setattr(lattice_sampling._OpenSets, "_open", lambda self, *x: calls.append((x[4] - x[3]).sum()) or opened(self, *x))
    for alpha in (1.0, 6.0):
        monkeypatch.setattr(lattice_sampling, "NEAR", 1e9)
        want = ways(vocabulary(PATH, alpha), texts, keys, 8)
        for near in (45.0, 2.0, 0.0):
            monkeypatch.setattr(lattice_sampling, "NEAR", near)
            del calls[:]
            assert ways(vocabulary(PATH, alpha), texts, keys, 8) == want
        assert len(calls) > 8  # once a way, and those that had waited
    monkeypatch.setattr(lattice_sampling, "NEAR", 45.0)
    del calls[:]
    found = Sampler(Lattice(vocabulary(PATH, 1.0)), ["some words here and there " * 100], keys[:1]).sample(2)
    assert sum(calls) < found.size[0] / 2


def test_words_that_share_a_hash_are_told_apart(monkeypatch):
    vocab, texts, keys = vocabulary(PATH, 1.0), ["some words here", "words, and there", "日本 some"], np.arange(3).astype(np.uint64)
    want = ways(vocab, texts, keys, 3)
    hashes = lattice_sampling.word_hashes
    monkeypatch.setattr(lattice_sampling, "word_hashes", lambda *a: hashes(*a) % 2)
    assert ways(vocab, texts, keys, 3) == want
    lattice = Lattice(vocab, limit=30)
    for i in (0, 1, 2, 0, 1, 2):
        sampler = Sampler(lattice, texts[i : i + 1], keys[i : i + 1])
        found = sampler.sample(3)
        assert [(found.total[r], found.bound[r]) for r in found.ordered()] == [(lp, g) for _, lp, g in want[i]]


def test_columns_of_texts_are_those_of_rows():
    vocab = vocabulary(PATH, 1.0)
    decoder, rng = Decoder(vocab), np.random.default_rng(5)
    ids = [rng.integers(0, len(vocab.pieces), n).astype("<u4") for n in (0, 1, 5, 0, 40_000, 1, 1)]
    ids[-1][0] = vocab.byte_id[ord(" ")]
    bad = [vocab.byte_id[[0xE6, 0x97]].astype("<u4"), vocab.byte_id[[0x20, 0x80, 0x41]].astype("<u4")]
    good = [i[(vocab.byte_id[0x80] > i) | (vocab.byte_id[0xFF] < i)] for i in ids]
    for rows in (good, ids + bad, []):
        got = decoder.column(np.concatenate([*rows, np.zeros(0, "<u4")]), np.array([len(r) for r in rows], np.int64))
        assert got.to_pylist() == [decoder(r.tobytes()) for r in rows]
        for text, r in zip(got.to_pylist(), rows, strict=True):
            plain = b"".join(bytes([vocab.byte_of[i]]) if i in vocab.byte_of else vocab.pieces[i].replace(SPACE, " ").encode() for i in r.tolist())
            assert text == plain.decode("utf-8", "replace").removeprefix(" ")
