import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pamsieve.llm import forest, secret_scan
from pamsieve.llm.secret_scan import FEATURES, SYMBOLS, features, labelled_findings, scan_secrets, train

RUN = re.compile(r"[A-Za-z0-9_+/=\-]{16,}")


def test_held_out_accuracy(spark):
    found = labelled_findings(spark, 3000, seed=11)
    model = train(found)
    held = labelled_findings(spark, 1500, seed=99)
    told = features(F.col("value"), F.col("before"), F.col("path"), F.col("after"), model.table)
    rows = np.array(held.select(*(told[k].cast("double") for k in FEATURES), F.col("label").cast("double")).collect(), float)
    guess = forest.predict(model.trees, rows[:, :-1]) >= 0.5
    truth = rows[:, -1] == 1
    assert (guess == truth).mean() > 0.95
    assert guess[truth].mean() > 0.95 and (~guess[~truth]).mean() > 0.93


def test_the_expression_is_the_forest(spark):
    rng = np.random.default_rng(3)
    x = rng.random((300, 3))
    trees = forest.fit(x, (x[:, 0] + x[:, 1] > 1).astype(float))
    df = spark.createDataFrame(x.tolist(), "a double, b double, c double")
    got = [r[0] for r in df.selectExpr(forest.to_sql(trees, ["a", "b", "c"])).collect()]
    assert np.allclose(got, forest.predict(trees, x))
    assert ((np.array(got) >= 0.5) == (x[:, 0] + x[:, 1] > 1)).mean() > 0.93


def test_findings_and_redaction(spark):
    rng = random.Random(5)
    secret = "".join(rng.choices("0123456789abcdef", k=40))
    rows = [
        (1, f'The storti token = "{secret}" and\nmore {secret}', "src1"), (2, "pay with 5307980776276280 or call +1 (017) 555-7713", "src2"), (3, None, None), (4, "", "x"),
        (5, f'TOKEN = "{secret.upper()}"!! END', "src0"), (5, "enschverbegebe nothing here 12", "src0"), (None, "no digits " * 5000, "y"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("findings", F.lit(1)).withColumn("found", F.lit(2))
    got = scan_secrets(df).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.redacted): r for r in got}
    assert by[1, 'The storti token = "[SECRET]" and\nmore [SECRET]'].n_secrets >= 1
    assert by[2, rows[1][1]].n_secrets == 0 and by[2, rows[1][1]].n_candidates == 1
    assert by[3, None].n_candidates == by[4, ""].n_candidates == 0
    assert by[5, 'TOKEN = "[SECRET]"!! END'].n_secrets == 1
    assert scan_secrets(df.limit(0)).collect() == []
    with pytest.raises(ValueError, match="no labelled"):
        train(labelled_findings(spark, 10).limit(0))


def test_candidates_against_brute_force(spark):
    rng = random.Random(6)
    letters = "abcXYZ0123_-/=+\"'.é"
    texts = [" ".join("".join(rng.choices(letters, k=rng.randint(1, 60))) for _ in range(rng.randint(0, 12))) for _ in range(150)]
    df = spark.createDataFrame([(i, t, "p") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    for r in scan_secrets(df).collect():
        want = [(k, v) for k, w in enumerate(re.split(r"[\x20\x09-\x0D]+", texts[r.doc_id])) for v in RUN.findall(w)]
        assert [(f.word_no, f.value) for f in r.findings] == want


def described(value, before, after, path, table):
    """The features of a candidate, straight from their definitions."""
    n, near, low = len(value), before.lower(), value.lower()

    def share(pattern, v=value):
        return sum(len(m[0]) for m in re.finditer(pattern, v)) / n

    kind = lambda c: "A" if "A" <= c <= "Z" else "0" if "0" <= c <= "9" else "-" if c in "_+/=-" else c if "a" <= c <= "z" else "."
    at = [SYMBOLS.index(kind(c)) for c in value]
    turns = sum(
        (a in "0123456789" and b.isascii() and b.isalpha()) or (a.isascii() and a.isalpha() and b in "0123456789") or ("a" <= a <= "z" and "A" <= b <= "Z") or ("A" <= a <= "Z" and "a" <= b <= "z")
        for a, b in zip(value, value[1:], strict=False)
    )
    told = {
        "length": n, "transitions": turns / n, "digits": share("[0-9]+"), "variety": len(set(value)) / n**0.5, "coverage": share("|".join(secret_scan._WORDS), low), "upper": share("[A-Z]+"),
        "separators": share(r"[_+/=\-]+"), "hex": bool(re.search("^[0-9a-f]+$", low)), "hint": bool(re.search(secret_scan._HINT, f"{near} {low}")), "harmless": bool(re.search(secret_scan._HARMLESS, near)),
        "assigned": bool(re.search(r"[=:]\s*\S*$", before)), "test_path": bool(re.search(secret_scan._TEST_PATH, path.lower())), "symbols": share(r"[^A-Za-z0-9_+/=\-]+"), "vowels": share("[aeiou]+", low),
        "known": bool(re.search(secret_scan._KNOWN, value)),
        "assigned_length": n if re.search(rf"{secret_scan._HINT}[\w\-]*[\"'`\])]*(\s*[=:]+>?|(?<=bearer))[\s\"'`]*$", near) else 0,
        "markov": sum(table[a, b] for a, b in zip(at, at[1:], strict=False)) / max(1, n - 1),
        "after_harmless": bool(re.search(secret_scan._HARMLESS, after.lower())), "after_hint": bool(re.search(secret_scan._HINT, after.lower())),
    }
    return [float(told[k]) for k in FEATURES]


def test_verdicts_against_brute_force(spark):
    rng = random.Random(21)
    model = train(labelled_findings(spark))
    values = ["".join(rng.choices("abcdefXYZ0123456789_-/", k=rng.randint(16, 50))) for _ in range(150)] + ["AKIA" + "Q" * 16, "/usr/share/access/index/data", "0" * 20]
    rows = []
    for i, v in enumerate(values):
        before, after = rng.choice(["the commit", "api_key =", "order no", "a", "x token:", ""]), rng.choice(["end", "checksum ok", "", "token"])
        rows.append((i, f"{before} {v} {after}", rng.choice(["src1", "tests/data", None]), v, before, after))
    got = scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string, v string, b string, a string")).collect()
    for r in got:
        _, text, path, value, before, after = rows[r.doc_id]
        words = re.split(r"[\x20\x09-\x0D]+", text)
        (finding,) = [f for f in r.findings if f.value == value]
        k = finding.word_no
        near = " ".join([*(words[k + d] if k + d >= 0 else "" for d in (-2, -1)), ""])
        score = forest.predict(model.trees, np.array([described(value, near, words[k + 1] if k + 1 < len(words) else "", path or "", model.table)]))[0]
        assert abs(finding.score - score) < 1e-6 and finding.is_secret == (finding.score >= 0.5)


def test_recall_on_whole_texts(spark):
    rng = random.Random(12)
    upper, mixed = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    pick = lambda letters, k: "".join(rng.choices(letters, k=k))
    secrets = [(form, "AKIA" + pick(upper, 16)) for form in ("the id {} here", "key: {}") for _ in range(20)]
    secrets += [("token = '{}'", pick(mixed, rng.randint(20, 32))) for _ in range(20)]
    secrets += [("password = {}", "-".join(pick("aeiounrstlhdcmpbg", 6) for _ in range(4))) for _ in range(20)]
    for form in ("password = {}", "password={}", '"password": "{}",', "my pwd: {}\nend"):
        secrets += [(form, v) for v in ("hunter2x", "P@ssw0rd!2024-x", "tG7!kq9z", "sunrise4471")]
    rows = [(i, f"some words before {form.format(v)} and words after", "src1") for i, (form, v) in enumerate(secrets)]
    plain = ["internationalisation of administration", "author: unknown and key: none", "see /usr/local/share/index", "-" * 40, "a token is a word, a password too"]
    rows += [(1000 + i, t, "src1") for i, t in enumerate(plain)]
    got = {r.doc_id: r for r in scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    missed = [rows[i][1] for i, (_, v) in enumerate(secrets) if v in got[i].redacted]
    assert len(missed) <= 0.05 * len(secrets), missed
    assert not [r.redacted for i, r in got.items() if i >= 1000 and r.n_secrets]


def test_short_values_are_masked_as_words(spark):
    df = spark.createDataFrame([(1, "password = hunter2x then hunter2x, xhunter2xy", "src1")], "doc_id long, text string, source string")
    assert scan_secrets(df).first().redacted == "password = [SECRET] then [SECRET], xhunter2xy"
