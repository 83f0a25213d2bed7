"""Neighbourhoods: every string that a guide's site can be within k edits, as distinct keys with their least distance."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

BASES = "ACGT"


def neighbourhood(q: str, k: int, length: int, mismatch_only: bool = False) -> dict[str, int]:
    """Strings of ``length`` letters that begin a site within ``k`` edits of ``q``, and the least edits each needs.

    The guide is read letter by letter while an automaton's set of states (letters read, edits) is followed; what is
    beyond the guide's end is free.  A string that stops before the guide does counts the edits so far.
    """
    layers: dict[str, dict[int, int]] = {"": {i: i for i in range(min(k, len(q)) + 1)} if not mismatch_only else {0: 0}}
    for _ in range(length):
        grown: dict[str, dict[int, int]] = {}
        for word, states in layers.items():
            for base in BASES:
                out: dict[int, int] = {}
                for i, d in states.items():
                    if i == len(q):  # the guide is spent: any letter is free
                        out[i] = min(d, out.get(i, k + 1))
                        continue
                    step = d + (q[i] != base)
                    if step <= k:
                        out[i + 1] = min(step, out.get(i + 1, k + 1))
                    if not mismatch_only and d < k:
                        out[i] = min(d + 1, out.get(i, k + 1))
                if not mismatch_only:
                    for i in sorted(out):  # letters of the guide without a partner
                        for skip in range(1, k - out[i] + 1):
                            if i + skip <= len(q):
                                out[i + skip] = min(out[i] + skip, out.get(i + skip, k + 1))
                if out:
                    grown[word + base] = out
        layers = grown
    whole = length >= len(q) + (0 if mismatch_only else k)
    result = {}
    for word, states in layers.items():
        ends = [d for i, d in states.items() if i == len(q)] if whole else list(states.values())
        if ends:
            result[word] = min(ends)
    return result


def with_neighbours(guides: DataFrame, k: int, length: int, mismatch_only: bool = False) -> DataFrame:
    """(guide, q, key, least): a row for each key of each guide's neighbourhood; guides are spread over tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for guide, q in zip(batch.column("guide").to_pylist(), batch.column("q").to_pylist(), strict=True):
                found = neighbourhood(q, k, length, mismatch_only)
                keys, least = list(found), list(found.values())
                for i in range(0, len(keys), 50_000):
                    n = len(keys[i : i + 50_000])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([guide] * n), pa.array([q] * n), pa.array(keys[i : i + n]), pa.array(least[i : i + n], pa.int32())], ["guide", "q", "key", "least"]
                    )

    return guides.select("guide", "q").distinct().repartition("guide").mapInArrow(run, "guide string, q string, key string, least int")
