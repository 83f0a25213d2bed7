import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from pamsieve.llm._tokens import Cache, Ids
from pamsieve.llm.packing import pack
from pamsieve.llm.token_counts import frequent_pretokens, token_counts

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "\n\n", "  two  spaces ", "it's  We'LL don't", "a b  c  d", "x \x1cy\x1d \x1e", "tab\t\tx\r\n y", "Ünï cödé ß İ Σς",
    "<|endoftext|> in <|endoftext|>text", "a<|startoftext|>b <|endoftext|>", "123 4567 ８９", "é ́x", "日本 語 テスト", " x   y", "  \n x", "end  ", "\x00 \x7f",
]


def texts():
    rng = random.Random(1)
    return ODD + ["".join(rng.choices(ODD + ["word ", "the ", "\n"], k=rng.randint(1, 30))) for _ in range(200)]


def test_token_counts_are_the_librarys(spark):
    tok = Tokenizer.from_file(WORD)
    rows = [(i, t, "n") for i, t in enumerate(texts())] + [(-1, None, None), (None, "two words", "x"), (0, "the the", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(3)
    got = sorted(map(tuple, token_counts(df, WORD, limit=20, table_size=16, cache_size=8).collect()), key=repr)
    want = []
    for i, t, _ in rows:
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 20))
    assert got == sorted(want, key=repr)
    assert token_counts(df.limit(0), WORD).collect() == []


def test_frequent_pretokens(spark):
    df = spark.createDataFrame([("a a a b b c",), ("a b d",), (None,)], "text string")
    assert frequent_pretokens(df.fillna(""), 2) == [b"a", b"b"]


def test_cache_is_bounded():
    cache = Cache(10, {"first": 1})
    for i in range(100):
        for c in cache.missing([str(i), str(i - 1)]):
            cache.learn({c: i})
        assert len(cache.now) <= 13 and cache.now["first"] == 1


def test_ids_are_the_librarys():
    tok, ids = Tokenizer.from_file(BYTE), Ids(BYTE)
    assert ids.ranked is not None and Ids(WORD).ranked is None
    points = [f"a{chr(c)}b {chr(c)} 1{chr(c)}2" for c in range(1, 0x10000, 7) if not 0xD800 <= c < 0xE000]
    for t in texts() + points + ["\U0001f600 x", "a" * 50_000, " " * 50_000, "\n" * 5000 + "x"]:
        assert np.frombuffer(ids(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_ids_of_runs_that_the_faster_library_cannot_split():
    tok, ids = Tokenizer.from_file(BYTE), Ids(BYTE)
    for t in (" " * 2_000_000, "a" + "\n" * 1_000_000 + "b", "\t " * 600_000):
        assert np.frombuffer(ids(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


def check_packing(pieces, docs, capacity, end_id):
    tok = Tokenizer.from_file(BYTE)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in pieces:
        assert r.length > 0
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, t in docs.items():
        want = tok.encode(t or "", add_special_tokens=False).ids + [end_id]
        at = 0
        for r in sorted(by_doc.pop(i), key=lambda r: r.start):
            part = np.array(want[r.start : r.start + r.length], "<u4").tobytes()
            assert r.start == at and r.doc_tokens == len(want)
            assert r.ids == part if "ids" in r else r.ids_crc32 == zlib.crc32(part)
            at += r.length
        assert at == len(want)
    assert not by_doc
    padding = 0
    for rs in by_sequence.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        padding += capacity - at
    return padding / (capacity * max(1, len(by_sequence)))


def test_packing_is_lossless(spark):
    rng = random.Random(2)
    docs = {i: " ".join(rng.choices(["alpha", "beta", "Gamma'll", "ñandú"], k=rng.randint(0, 150))) for i in range(400)}
    docs |= {1000: None, 1001: "", 1002: "word " * 5000}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").withColumns({}).repartition(5)
    for kind in (True, False):
        pieces = pack(df, BYTE, capacity=128, open_windows=8, ids=kind).collect()
        assert check_packing(pieces, docs, 128, 1) < 0.15
    assert pack(df.limit(0), BYTE).collect() == []


def test_packing_of_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (1, "x")], "doc_id long, text string")
    got = pack(df, BYTE, end_id=None).collect()
    assert sorted((r.doc_id is None, r.doc_tokens) for r in got) == [(False, 1), (False, 2), (False, 2), (True, 1)]
    assert len({r.sequence_id for r in got}) == 1
