"""Tokenizers in Python workers, and bounded caches of what they give for pieces of text."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_BEYOND = re.compile("[\U00010000-\U0010ffff]")
_loaded: dict = {}


def tokenizer(path: str):
    if path not in _loaded:
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(path)
        found.no_truncation()
        found.no_padding()
        _loaded[path] = found
    return _loaded[path]


class Cache:
    """Chunk -> value in two generations (``now`` is the newer): what wasn't used in the last ``limit`` additions goes."""

    def __init__(self, limit: int, first: dict | None = None):
        self.first = first or {}
        self.now, self.old, self.limit = dict(self.first), {}, limit + len(self.first)

    def learn(self, values: dict) -> None:
        if len(self.now) + len(values) > self.limit:
            self.old, self.now = self.now, dict(self.first)
        self.now.update(values)

    def missing(self, chunks: Iterable) -> list:
        unknown = set(chunks).difference(self.now)  # a plain dict: it is probed, not walked
        if self.old and unknown:
            back = {c: self.old[c] for c in unknown if c in self.old}
            self.now.update(back)
            unknown.difference_update(back)
        return list(unknown)


def _ranked(path: str):
    """The vocabulary of a byte-level BPE file for the faster of the two libraries, or None if it isn't one.

    Its ids must follow the order of merges, and its splitting be the usual one; then both libraries give the same ids
    for every text of code points below U+10000 (tests compare them).
    """
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    if (model["type"], split.get("type"), split.get("use_regex"), split.get("add_prefix_space"), spec["normalizer"]) != ("BPE", "ByteLevel", True, False, None):
        return None
    if any(model.get(k) for k in ("continuing_subword_prefix", "end_of_word_suffix", "dropout")):
        return None
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    vocabulary = {t: i for t, i in model["vocab"].items() if t not in special}
    merged = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if merged != sorted(merged) or len(merged) + 256 != len(vocabulary):
        return None
    ranks = {bytes(byte[c] for c in t): i for t, i in vocabulary.items()}
    return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


class Ids:
    """The ids of whole texts as little-endian unsigned 32-bit bytes, without added special tokens."""

    def __init__(self, path: str):
        self.path = path
        if ("ranked", path) not in _loaded:
            _loaded["ranked", path] = _ranked(path)
        self.ranked = _loaded["ranked", path]

    def __call__(self, text: str) -> bytes:
        if self.ranked is not None and not _BEYOND.search(text):
            try:
                return self.ranked.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()
            except ValueError:  # its splitting gives up on runs of about a million white-space characters
                pass
        return np.array(tokenizer(self.path).encode(text, add_special_tokens=False).ids, "<u4").tobytes()
