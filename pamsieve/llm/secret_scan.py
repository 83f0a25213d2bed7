"""Operator 7, secret scans: a random forest removes false positives; DataFrame and SQL functions only.

Candidates are maximal runs of 16 or more letters, digits and ``_+/=-``, and words of any length that a hint assigns
(``password = x``, ``"token": "x"``, ``Bearer x``).  Each is described by its length, character transitions, digits,
variety, dictionary coverage, vowels, known forms, the path (the document's source) and the words before and after it.
Character transitions are a Markov chain's: the mean log-ratio of each step from one character to the next among secrets
and among harmless values.  That table and a random forest are trained from labelled findings; the forest's trees are
compiled to CASE expressions, so scanning is one pass over the texts without a shuffle, and texts without a run or a hint
are told by one test.
A secret of several words (a passphrase with blanks) is found by its first word only.

Labelled findings are rows (value, before, path, label, and if known after); at most ``max_labelled`` of them are used, those of the
smallest hash.  The corpus has none, so by default a generator makes them: keys, tokens and passwords of common kinds
against card numbers, phone numbers, identifiers, commit hashes, dates, paths, long words and words with digits.
"""

from __future__ import annotations

import random
import string

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import forest
from ._filter import packed, unpacked

_RUN = r"[A-Za-z0-9_+/=\-]{16,}"
_WORD = r"[\x20\x09-\x0D]+"
_HINT = r"(key|token|secret|passw|pwd|auth|credential|bearer|private|signature)"
_ASSIGNED = rf"(?i)(?:{_HINT[1:-1]})[\w\-]*[\"'`\])]*(?:\s*[=:]+>?|(?<=bearer))\s*(?<![a-z])(\S+)$"
_KNOWN = r"^(AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{30,}|sk_live_[A-Za-z0-9]{16,}|xox[abprs]-.{10,})$"
_HARMLESS = r"(sha|commit|hash|checksum|digest|uuid|guid|order|card|phone|isbn|version|revision|build|ticket|invoice|etag|date|call|pay)"
_TEST_PATH = r"(test|example|sample|fixture|mock|doc|readme|demo)"
#: The default dictionary: endings, words of technical texts, and common English words of four letters and more.
_WORDS = (
    "and for ing the tion access article build data date document error file image index item list name number order page report section test user value version year "
    "about after again because been before being between both came could does down each even every first found from good great hand have head here high home house into just keep "
    "know large last late leave left life line little live long look made make many might more most much must need never next night only open other over part people place point "
    "right same said should show side small some still such take tell than that their them then there these they thing think this those thought through time turn under until very "
    "want water well went were what when where which while white will with without work world would write young your back call case change child city come company country different "
    "early example family follow form general give group grow help important increase interest level local member mean money month move nation offer order own plan play power present "
    "problem process program public question real result room school second seem service social state student study system today"
).split()
FEATURES = ["length", "transitions", "digits", "variety", "coverage", "upper", "separators", "hex", "hint", "harmless", "assigned", "test_path", "symbols", "vowels", "known", "assigned_length", "markov", "after_harmless", "after_hint"]
SYMBOLS = "abcdefghijklmnopqrstuvwxyzA0-."  # upper case, digits, separators and all else are one symbol each
_UPPER, _DIGITS, _SEPARATORS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "_+/=-"
MASK = "[SECRET]"


def _share(value: Column, pattern: str) -> Column:
    """The share of a value's characters that the pattern's matches cover."""
    n = F.char_length(value)
    return (n - F.char_length(F.regexp_replace(value, pattern, ""))) / n


def transitions(values: list[str], labels: list[int]) -> np.ndarray:
    """log P(next | symbol, secret) - log P(next | symbol, harmless) for each step, smoothed, to four places."""
    k = len(SYMBOLS)
    place = {c: i for i, c in enumerate(SYMBOLS)} | {c: k - 4 for c in _UPPER} | {c: k - 3 for c in _DIGITS} | {c: k - 2 for c in _SEPARATORS}
    counts = np.full((2, k, k), 0.5)
    for value, label in zip(values, labels, strict=True):
        at = [place.get(c, k - 1) for c in value]
        np.add.at(counts[int(label > 0)], (at[:-1], at[1:]), 1)
    p = np.log(counts / counts.sum(axis=2, keepdims=True))
    return np.round(p[1] - p[0], 4)


def _markov(value: Column, table: np.ndarray) -> Column:
    """The mean of the table's entries over a value's steps, 0 without any."""
    told = F.translate(value, _UPPER + _DIGITS + _SEPARATORS, "A" * 26 + "0" * 10 + "-" * 5)
    told = F.regexp_replace(told, r"[^a-zA0\-]", ".")
    held = F.split(F.lit(",".join(map(repr, table.ravel().tolist()))), ",").cast("array<double>")
    n, k = F.char_length(value), len(SYMBOLS)
    # one walk: what a lambda closes over would be worked out anew at each step
    begin = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))

    def step(acc: Column, c: Column) -> Column:
        symbol = F.instr(F.lit(SYMBOLS), c) - 1
        entry = F.when(acc["last"] < 0, F.lit(0.0)).otherwise(F.get(held, acc["last"] * k + symbol))
        return F.struct(symbol.alias("last"), (acc["sum"] + entry).alias("sum"))

    return F.aggregate(F.split(told, ""), begin, step, lambda acc: acc["sum"]) / F.greatest(n - 1, F.lit(1))


def features(value: Column, before: Column, path: Column, after: Column, table: np.ndarray) -> dict[str, Column]:
    """The forest's features of a candidate, of the two words before it and the one after, and of its document's path."""
    turn = r"(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"
    n = F.char_length(value)
    near = F.lower(before)
    flag = lambda c: c.cast("double")
    return {
        "length": n.cast("double"),
        "transitions": (F.char_length(F.regexp_replace(value, turn, " ")) - n) / n,
        "digits": _share(value, "[0-9]+"),
        "variety": F.size(F.array_distinct(F.split(value, ""))) / F.sqrt(n.cast("double")),
        "coverage": _share(F.lower(value), "|".join(_WORDS)),
        "upper": _share(value, "[A-Z]+"),
        "separators": _share(value, r"[_+/=\-]+"),
        "hex": flag(F.lower(value).rlike("^[0-9a-f]+$")),
        "hint": flag(F.concat(near, F.lit(" "), F.lower(value)).rlike(_HINT)),
        "harmless": flag(near.rlike(_HARMLESS)),
        "assigned": flag(before.rlike("[=:]\\s*\\S*$")),
        "test_path": flag(F.lower(path).rlike(_TEST_PATH)),
        "symbols": _share(value, r"[^A-Za-z0-9_+/=\-]+"),
        "vowels": _share(F.lower(value), "[aeiou]+"),
        "known": flag(value.rlike(_KNOWN)),
        "assigned_length": F.when(near.rlike(rf"{_HINT}[\w\-]*[\"'`\])]*(\s*[=:]+>?|(?<=bearer))[\s\"'`]*$"), n).otherwise(0).cast("double"),
        "markov": _markov(value, table),
        "after_harmless": flag(F.lower(after).rlike(_HARMLESS)),
        "after_hint": flag(F.lower(after).rlike(_HINT)),
    }


def labelled_findings(spark: SparkSession, n: int = 3000, seed: int = 11) -> DataFrame:
    """Generated findings (value, before, path, label, after), the same for the same arguments."""
    rng = random.Random(seed)
    behind = random.Random(seed + 1)
    alnum, hexes, digits = string.ascii_letters + string.digits, "0123456789abcdef", string.digits

    def text(letters: str, k: int) -> str:
        return "".join(rng.choices(letters, k=k))

    def word() -> str:
        return rng.choice(_WORDS) if rng.random() < 0.7 else text("aeiounrstlhd", rng.randint(2, 9))

    hints = ["token =", "api_key =", "secret:", "password =", "Authorization: Bearer", "key:", "TOKEN =", "client_secret=", "private_key =", "auth_token:"]
    marks = ["commit", "sha256:", "order", "card", "call", "uuid =", "checksum =", "build", "version", "invoice no", "etag:", "digest ="]
    secrets = [
        lambda: text(hexes, rng.choice([32, 40, 40, 64])), lambda: text(hexes, 40).upper(), lambda: "AKIA" + text(string.ascii_uppercase + digits, 16), lambda: "ghp_" + text(alnum, 36),
        lambda: "sk_live_" + text(alnum, 24), lambda: text(alnum + "+/", 40), lambda: text(alnum + "-_", rng.randint(20, 60)), lambda: "xoxb-" + text(digits, 11) + "-" + text(alnum, 24),
    ]
    harmless = [
        lambda: text(digits, 16), lambda: text(digits, rng.randint(16, 20)), lambda: "-".join([word(), word(), text(digits, 4), word()]) + "-item", lambda: "_".join([word(), word(), word(), "v" + text(digits, 2)]) + "_final",
        lambda: "/".join(["", word(), word(), text(digits, 4), text(digits, 2), word() + "index"]), lambda: word() + word() + word() + text(digits, 2) + "number", lambda: f"20{text(digits, 2)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}T10-00-00",
        lambda: "0" * rng.randint(16, 30), lambda: "-".join(text(hexes, k) for k in (8, 4, 4, 4, 12)), lambda: "=" * 8 + text(digits, 1) + "=" * 12,
    ]
    passphrase = lambda: rng.choice("-_").join(text("aeiounrstlhdcmpbg", rng.randint(3, 8)) for _ in range(rng.randint(4, 6)))
    free = [lambda: "AKIA" + text(string.ascii_uppercase, 16), lambda: text(string.ascii_letters, rng.randint(16, 40)), lambda: text(string.ascii_letters + "-_", rng.randint(20, 40)), passphrase, passphrase, passphrase, passphrase, passphrase]  # without a digit
    short = [lambda: word() + text(digits, rng.randint(2, 4)), lambda: text("aeiounrstlhd", rng.randint(4, 8)) + text(digits, rng.randint(1, 4)) + text(alnum, rng.randint(0, 2)), lambda: text(alnum, rng.randint(5, 11)) + text(digits, rng.randint(1, 3)), lambda: text(alnum, rng.randint(4, 8)) + text("!@#$%&*?", rng.randint(1, 2)) + text(alnum, rng.randint(3, 7))]
    long_words = [lambda: text("aeiounrstlhdaeion", rng.randint(16, 26)), lambda: "-".join([word(), word(), word(), word(), "section"]), lambda: "/".join(["", word(), word(), word(), word(), "index"]), lambda: rng.choice("-=_+") * rng.randint(16, 60), lambda: "_".join([word(), word(), "document", word()])]
    plain = [word, word, lambda: word().capitalize(), lambda: rng.choice(["none", "null", "true", "false", "required", "missing", "invalid"]), lambda: text(digits, rng.randint(1, 3)), lambda: "/".join(["", word(), word()])]
    rows = []
    for _ in range(n):
        if rng.random() < 0.35:
            hinted, path = f"{word()} {rng.choice(hints)}", rng.choice(["src1", "src7", "config/app", "lib/client", "web"])
            kind = rng.random()
            if kind < 0.3:
                rows.append((rng.choice(free)(), hinted, path, 1))
            elif kind < 0.35:
                rows.append((free[0](), f"{word()} {word()}", path, 1))
            elif kind < 0.6:
                rows.append((rng.choice(short)(), hinted, path, 1))
            elif kind < 0.8:
                rows.append((rng.choice(long_words)(), f"{word()} {word()}", path, 0))
            else:
                rows.append((rng.choice(plain)(), hinted, path, 0))
            continue
        kind = rng.random()
        near = f"{word()} {word()}"
        path = rng.choice(["src1", "src7", "config/app", "lib/client", "web"])
        if kind < 0.4:
            rows.append((rng.choice(secrets)(), f"{word()} {rng.choice(hints)}", path, 1))
        elif kind < 0.45:  # keys of known form without a hint
            rows.append((rng.choice(secrets[2:5])(), near, path, 1))
        elif kind < 0.75:
            rows.append((rng.choice(harmless)(), near if rng.random() < 0.6 else f"{word()} {rng.choice(marks)}", path, 0))
        elif kind < 0.85:  # digests named as such
            rows.append((text(hexes, rng.choice([40, 64])), f"{word()} {rng.choice(marks)}", path, 0))
        elif kind < 0.92:  # placeholders
            rows.append((rng.choice(["your", "example", "xxxx", "test"]) + rng.choice(["_", "-"]) + word() + "_0000" + "0" * 8, f"{word()} {rng.choice(hints)}", path, 0))
        else:  # anything in fixtures
            rows.append((rng.choice(harmless)(), f"{word()} {rng.choice(hints)}", rng.choice(["tests/data", "docs/example", "fixtures"]), 0))
    def after(label: int) -> str:
        """The next word: mostly any, behind harmless values more often one that names them."""
        named = behind.random() < (0.02 if label else 0.15)
        return behind.choice(["checksum", "commit", "build", "order", "digest", "version"]) if named else behind.choice(_WORDS)

    return spark.createDataFrame([(*r, after(r[3])) for r in rows], "value string, before string, path string, label int, after string")


class Model:
    """The forest's trees and the table of transitions."""

    def __init__(self, trees: list, table: np.ndarray):
        self.trees, self.table = trees, table


def train(labelled: DataFrame, max_labelled: int = 20_000, trees: int = 25, depth: int = 6) -> Model:
    """Transitions and a forest from at most ``max_labelled`` labelled findings, chosen by hash."""
    given = labelled.where("value is not null and value != '' and label is not null")
    after = F.coalesce("after", F.lit("")) if "after" in labelled.columns else F.lit("")
    given = given.select("value", F.coalesce("before", F.lit("")).alias("before"), F.coalesce("path", F.lit("")).alias("path"), after.alias("after"), F.col("label").cast("double").alias("label"))
    rows = given.orderBy(F.xxhash64("value", "before", "path"), "value").limit(max_labelled).collect()
    if not rows:
        raise ValueError("no labelled findings to train from")
    table = transitions([r["value"] for r in rows], [r["label"] for r in rows])
    sample = labelled.sparkSession.createDataFrame(rows, given.schema)
    told = features(F.col("value"), F.col("before"), F.col("path"), F.col("after"), table)
    found = np.array(sample.select(*(told[k].cast("double") for k in FEATURES), "label").collect(), float)
    return Model(forest.fit(found[:, :-1], found[:, -1], trees, depth), table)


def _candidates(words: Column, hinted: Column) -> Column:
    """array<struct<value, before, after, word_no>> of a text's words; ``hinted``: whether the text has any hint.

    ``words`` must be a column of the row and ``hinted`` stand outside of lambdas: what a lambda closes over is worked
    out anew for each word.
    """
    told = F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i")))

    def at(s: Column, k: int) -> Column:
        return F.coalesce(F.get(words, s["i"] + k), F.lit(""))

    def assigned(s: Column) -> Column:
        """What a hint assigns, without quotes around it or punctuation behind; empty if none does."""
        raw = F.regexp_extract(F.concat_ws(" ", at(s, -2), at(s, -1), s["w"]), _ASSIGNED, 1)
        bare = F.when(raw.rlike("^[\"'`]"), F.regexp_extract(raw, "^[\"'`]+([^\"'`]+)", 1)).otherwise(F.regexp_replace(raw, "[,;.)>\\]}\"'`]+$", ""))
        return F.when(bare.rlike("[A-Za-z0-9]") & s["w"].contains(bare), bare).otherwise("")

    def each(s: Column) -> Column:
        near = [at(s, -2), at(s, -1)]
        runs = F.regexp_extract_all(s["w"], F.lit(_RUN), F.lit(0))

        def one(v: Column, head: Column) -> Column:
            return F.struct(v.alias("value"), F.concat_ws(" ", *near, head).alias("before"), at(s, 1).alias("after"), s["i"].alias("word_no"))

        more = F.filter(F.array(s["v"]), lambda v: (v != "") & ~F.array_contains(runs, v))
        return F.concat(F.transform(runs, lambda v: one(v, F.split(s["w"], _RUN)[0])), F.transform(more, lambda v: one(v, F.split_part(s["w"], v, F.lit(1)))))

    def with_value(value) -> Column:
        return F.transform(told, lambda s: F.struct(s["w"].alias("w"), s["i"].alias("i"), value(s).alias("v")))

    told = F.when(hinted, with_value(assigned)).otherwise(with_value(lambda s: F.lit("")))
    return F.flatten(F.transform(F.filter(told, lambda s: (s["v"] != "") | (F.char_length(s["w"]) >= 16)), each))


def _mask(text: Column, value: Column) -> Column:
    quoted = F.concat(F.lit("(?<![A-Za-z0-9])\\Q"), F.replace(value, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E(?![A-Za-z0-9])"))
    return F.when(F.char_length(value) < 16, F.regexp_replace(text, quoted, F.lit(MASK))).otherwise(F.replace(text, value, F.lit(MASK)))


def scan_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", labelled: DataFrame | None = None, threshold: float = 0.5, max_labelled: int = 20_000, keep: list[str] | None = None
) -> DataFrame:
    """A row for each input row: ``id_col``, findings, n_candidates, n_secrets, redacted, and the columns in ``keep``.

    ``findings`` lists every candidate: word_no (its word's place in the text), value, score and is_secret (score of
    ``threshold`` or more).  ``redacted`` is the text with each secret's value replaced by [SECRET] wherever it occurs; one of
    fewer than 16 characters, wherever no letter or digit stands beside it.

    Defined cases: a null or empty text has no candidates and is passed on; a null path is empty; ids are passed on,
    null or repeated; an empty table gives an empty result; other columns are ignored.
    """
    model = train(labelled if labelled is not None else labelled_findings(docs.sparkSession), max_labelled)
    text, path = F.col(text_col).cast("string"), F.coalesce(F.col(path_col).cast("string"), F.lit(""))
    keep = keep or []
    if clash := {"findings", "n_candidates", "n_secrets", "redacted", id_col} & set(keep):
        raise ValueError(f"columns to keep have names of the result: {sorted(clash)}")
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), path.alias("path"), packed(keep).alias("kept"))
    some = F.col("text").rlike(f"{_RUN}|(?i){_HINT}")
    rows = rows.withColumn("words", F.when(some, F.split("text", _WORD)).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("found", _candidates(F.col("words"), F.col("text").rlike(f"(?i){_HINT}")))
    described = F.transform(
        "found", lambda c: F.struct(c["word_no"].alias("word_no"), c["value"].alias("value"), *(v.alias(k) for k, v in features(c["value"], c["before"], F.col("path"), c["after"], model.table).items()))
    )
    rows = rows.select("id", "text", "kept", described.alias("found"))
    score = forest.to_sql(model.trees, [f"c.{k}" for k in FEATURES])
    scored = F.expr(f"transform(found, c -> struct(c.word_no as word_no, c.value as value, {score} as score))")
    rows = rows.select("id", "text", "kept", scored.alias("found"))
    findings = F.transform("found", lambda c: F.struct(c["word_no"], c["value"], F.round(c["score"], 6).alias("score"), (c["score"] >= threshold).alias("is_secret")))
    rows = rows.select("id", "text", "kept", findings.alias("findings"))
    secrets = F.transform(F.filter("findings", lambda c: c["is_secret"]), lambda c: c["value"])
    # longer values first: one may be part of another
    ordered = F.array_sort(F.array_distinct(secrets), lambda a, b: F.char_length(b) - F.char_length(a))
    redacted = F.aggregate(ordered, F.col("text"), _mask)
    return rows.select(
        F.col("id").alias(id_col),
        "findings",
        F.size("findings").cast("long").alias("n_candidates"),
        F.size(secrets).cast("long").alias("n_secrets"),
        F.when(F.size(secrets) > 0, redacted).otherwise(F.col("text")).alias("redacted"),
        *unpacked("kept", keep),
    )
