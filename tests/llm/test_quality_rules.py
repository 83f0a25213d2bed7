import random
import re

from pyspark.sql import functions as F

from pamsieve.llm.quality_rules import quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    ws = WORD.findall(t)
    wins = [tuple(ws[i : i + 8]) for i in range(len(ws) - 7)]
    rep = {j for i, w in enumerate(wins) if wins.count(w) > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), len(lines), len(lines) - len(set(lines)), len(rep)


def test_measures_against_brute_force(spark):
    rng = random.Random(4)
    words = ["a", "é#", "b", "ñ", "<x>", "日本"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", "\n", "\t ", " \n\n"]) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    texts += [None, "", "\n \n", "x\x0by", "same\nsame\nsame\n", "the " * 5000]
    df = spark.createDataFrame([(i, t, "h") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in quality_rules(df).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        want = brute(t) if i < len(texts) - 1 else (5000, 15000, 0, 1, 0, 5000)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words) == want, t
        assert r.base_failed == (want[0] < 20 or 100 * want[5] > 30 * want[0])
        assert not (r.base_failed and r.kept)


def clean(seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(60))


def test_hosts_are_judged_with_a_prior(spark):
    rows = [(i, clean(i), "good") for i in range(300)] + [(1000, clean(1000).replace(" ", "## "), "good")]
    rows += [(2000 + i, "junk", "bad") for i in range(60)] + [(2999, clean(2999), "bad")]
    rows += [(3000, clean(3000), None), (3001, None, None), (4000, clean(4000), "tiny")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("host", F.lit("x"))
    got = {r.doc_id: r for r in quality_rules(df).collect()}
    assert len(got) == len(rows)
    assert all(got[i].kept for i in range(300))
    assert got[1000].kept  # a rare failure at a clean host
    assert got[2999].reason == "host blocked" and not got[2000].kept
    assert got[3000].kept and not got[3001].kept and got[4000].kept
    assert quality_rules(df.limit(0)).collect() == []
