import random
import re
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from pamsieve.llm import pipeline_stages as stages
from pamsieve.llm._filter import without
from pamsieve.llm._io import shared_dir
from pamsieve.llm.quality_rules import quality_rules
from pamsieve.llm.secret_scan import scan_secrets

from .test_jaccard_join import brute as jaccard_brute
from .test_substring_dedup import brute as substring_brute
from .test_tokens_and_packing import BYTE, check_packing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghilmnorst", k=rng.randint(2, 9))) for _ in range(800)]
    passage = " ".join(rng.choices(words, k=40))
    rows = []
    for i in range(120):
        kind = rng.random()
        text = " ".join(rng.choices(words, k=rng.randint(25, 150)))
        if kind < 0.1:
            text = "too short"
        elif kind < 0.3 and rows:
            text = (rng.choice(rows)[1] or "") + " " + rng.choice(words)
        elif kind < 0.5:
            text = f"{text}\n{passage} {rng.choice(words)}"
        elif kind < 0.6:
            text += ' token = "' + "".join(rng.choices("0123456789abcdef", k=40)) + '"'
        elif kind < 0.65:
            text = " ".join(f"{w}###" for w in text.split())
        rows.append((i, text, "en", f"src{i % 3}", len(text)))
    return rows + [(200, None, None, None, None), (None, " ".join(rng.choices(words, k=50)), None, None, 0), rows[20], rows[20]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_filters_move_only_what_they_must(spark):
    df = spark.range(100).withColumn("text", F.lit("a")).unionByName(spark.createDataFrame([(None, "a")], "id long, text string"))
    keys = spark.createDataFrame([(i,) for i in range(0, 100, 7)], "id long")
    for bits in (1 << 15, 32):
        got = {r.id for r in without(df, keys, "id", bits).collect()}
        assert got == {i for i in range(100) if i % 7} | {None}
    assert without(df, keys.limit(0), "id", 1 << 15).count() == 101


def test_stages_in_turn_against_brute_force(spark, docs):
    first = stages.quality(spark, docs, "")
    kept = {(r.doc_id, r.n_words) for r in quality_rules(docs).where("kept").collect()}
    want = [r for r in corpus() if (r[0], len((r[1] or "").split())) in kept]
    assert rows_of(first) == sorted(want, key=repr) and 0 < len(want) < len(corpus())

    first = spark.createDataFrame(want, SCHEMA)
    second = rows_of(stages.near_duplicates(spark, first, ""))
    groups = {i: c for i, _, c in jaccard_brute([(r[0], r[1]) for r in want], 5, 80)}
    stay = [r for r in want if r[0] is None or groups[r[0]] == r[0]]
    assert second == sorted(set(stay), key=repr) and len(second) < len(stay) < len(want)  # of equal rows one stays

    third = rows_of(stages.substrings(spark, spark.createDataFrame(second, SCHEMA), ""))
    cut = defaultdict(list)
    for i, _, gone, text in substring_brute([(r[0], r[1]) for r in second], 13):
        cut[i].append((gone, text))
    want = []
    for r in second:
        ws = " ".join(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
        gone, text = next(x for x in cut[r[0]] if x[0] or x[1] == ws)
        text = text if gone else r[1]
        text = text or ""  # a null text is an empty one from here on
        want.append((r[0], text, r[2], r[3], len(text)))
    assert third == sorted(want, key=repr) and any(a[1] != b[1] for a, b in zip(third, second, strict=True))

    fourth = rows_of(stages.secrets(spark, spark.createDataFrame(third, SCHEMA), ""))
    want = {(r.doc_id, r.redacted) for r in scan_secrets(spark.createDataFrame(third, SCHEMA)).collect()}
    assert {(r[0], r[1]) for r in fourth} == want and len(fourth) == len(third)
    assert sum("[SECRET]" in (r[1] or "") for r in fourth) > 0 and not any(re.search("[0-9a-f]{40}", r[1] or "") for r in fourth)

    unique = {r[0]: r[1] for r in fourth if r[0] is not None}
    frame = spark.createDataFrame([(i, t) for i, t in unique.items()], "doc_id long, text string")
    check_packing(stages.packing(spark, frame, "").collect(), unique, 2048, 1)


def test_run_is_the_stages_in_order(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "substring dedup", "secret scans", "packing"]
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    fill = defaultdict(int)
    for r in out:
        fill[r.sequence_id] += r.length
    assert 100 < len({r.doc_id for r in out}) < 200 and max(fill.values()) <= 2048


def test_run_returns_the_ids_of_stored_texts(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    folder = Path(shared_dir(spark).removeprefix("file://"))
    before = set(folder.iterdir())
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    made = {p.name.rsplit("-", 1)[0]: p for p in set(folder.iterdir()) - before}
    assert {name.replace(" ", "-") for name, _ in corpus_pipeline.STAGES} <= set(made)
    texts = spark.read.parquet(str(made["secret-scans"])).where("doc_id is not null").collect()
    unique = {r.doc_id: r.text for r in texts if sum(x.doc_id == r.doc_id for x in texts) == 1}
    assert len(unique) > 40
    tok = Tokenizer.from_file(BYTE)
    for i, text in unique.items():
        pieces = sorted((r for r in out if r.doc_id == i), key=lambda r: r.start)
        ids = np.frombuffer(b"".join(r.ids for r in pieces), "<u4").tolist()
        assert ids == tok.encode(text or "", add_special_tokens=False).ids + [1]


def test_an_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").collect() == []


CLASHES = ["_", "_row", "_bit", "_may_be_in", "_at", "bits_", "maybe", "key", "row", "id", "rest", "kept", "n_words", "n_removed", "kept_text", "findings", "redacted", "n_secrets", "path", "a.b", "with space", "back`tick", "component_id", "row_key"]


def test_extra_columns_of_any_name(spark):
    rng = random.Random(2)
    text = " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(60))
    rows = [(1, text, "en", "s", 0, *CLASHES), (2, text + " end", "en", "s", 0, *CLASHES), (3, "short", "en", "s", 0, *CLASHES), (4, "other " + text[:200] + ' and token = "0123456789abcdef0123456789abcdef01234567" ' + "more of it " * 3 + text[220:300], "en", "s", 0, *CLASHES)]
    df = spark.createDataFrame(rows, [*("doc_id", "text", "lang", "source", "n_chars"), *CLASHES])
    for stage in (stages.quality, stages.near_duplicates, stages.substrings, stages.secrets):
        df = stage(spark, df, "")
        assert df.columns == [*("doc_id", "text", "lang", "source", "n_chars"), *CLASHES]
        got = df.collect()
        assert all(tuple(r)[5:] == tuple(CLASHES) for r in got)
    assert [r.doc_id for r in sorted(got)] == [1, 4] and "[SECRET]" in sorted(got)[1].text
    assert stages.packing(spark, df, "").count() == 2


def test_repeated_ids_have_verdicts_of_their_own(spark):
    rng = random.Random(6)
    x, y, z = (" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(40)) for _ in range(3))
    rows = [(1, x), (5, x), (5, y), (5, y), (7, x + " more"), (1, z), (1, z), (None, x), (None, x), (9, None), (9, ""), (9, "")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    got = sorted(((r.doc_id, r.text) for r in stages.near_duplicates(spark, df, "").collect()), key=repr)
    assert got == sorted([(1, x), (5, y), (1, z), (None, x), (None, x), (9, None), (9, ""), (9, "")], key=repr)
