"""Distances and alignments under IUPAC matching, for whole Arrow batches at a time.

The dynamic programme runs over the letters of guide and site, and in numpy over all pairs of a batch.  Alignments are
of the whole guide with a prefix of the site: letters left over at the site's end cost nothing.  Where several
alignments are best: a match is always taken; else a gap in the site if it's as good as any, else a gap in the guide
if it's as good as a mismatch, else the mismatch.  Of several best ends the first counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..motif import MASKS

GAP = ord("-")
_MASK = np.zeros(256, np.uint8)
for _letter, _bases in MASKS.items():
    _MASK[ord(_letter)] = _bases
_DIAGONAL, _LEFT, _TOP = 0, 1, 2


def _matrix(strings: list[str], fill: str = "-") -> np.ndarray:
    """Letters as rows of equal length."""
    width = max(map(len, strings), default=0)
    return np.frombuffer("".join(s.ljust(width, fill) for s in strings).encode(), np.uint8).reshape(len(strings), width)


def _matches(guide: np.ndarray, site: np.ndarray, match: str) -> np.ndarray:
    """(pairs, guide letters, site letters): what matches."""
    g, s = _MASK[guide][:, :, None], _MASK[site][:, None, :]
    if match == "equal":
        return (guide[:, :, None] == site[:, None, :]) & (s != 0)
    both = g & s
    if match == "inclusive":
        return (both != 0) & ((both == g) | (both == s))
    if match == "compatible":
        return both != 0
    raise ValueError(f"unknown match {match}")


def _table(ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Costs and moves, [pair, guide letters used, site letters used]."""
    n, glen, slen = ok.shape
    cost = np.zeros((n, glen + 1, slen + 1), np.int16)
    move = np.zeros((n, glen + 1, slen + 1), np.uint8)
    cost[:, 0, :] = np.arange(slen + 1)
    cost[:, :, 0] = np.arange(glen + 1)
    move[:, 0, :], move[:, :, 0] = _TOP, _LEFT
    for i in range(1, glen + 1):
        for j in range(1, slen + 1):
            diagonal, left, top = cost[:, i - 1, j - 1], cost[:, i - 1, j], cost[:, i, j - 1]
            hit = ok[:, i - 1, j - 1]
            gap_in_site = left <= np.minimum(diagonal, top)
            gap_in_guide = top <= diagonal
            cost[:, i, j] = np.where(hit, diagonal, np.minimum(np.minimum(diagonal, left), top) + 1)
            move[:, i, j] = np.where(hit, _DIAGONAL, np.where(gap_in_site, _LEFT, np.where(gap_in_guide, _TOP, _DIAGONAL)))
    return cost, move


def _prefix(ok: np.ndarray) -> np.ndarray:
    """How many first letters match, for each pair."""
    n = min(ok.shape[1:])
    run = np.cumprod(ok[:, np.arange(n), np.arange(n)], axis=1) if n else np.zeros((len(ok), 0), int)
    return run.sum(axis=1)


def align_batch(guides: list[str], sites: list[str], k: int, match: str = "compatible", strip: bool = True) -> list[tuple[str, str, int]]:
    """(guide with gaps, site with gaps, distance) of each pair; ("", "", k + 1) where the distance is over k.

    ``strip``: the common prefix is set apart before aligning; the distance is the same, the gaps may lie elsewhere.
    """
    if not guides:
        return []
    sizes = {(len(g), len(s)) for g, s in zip(guides, sites, strict=True)}
    if len(sizes) > 1:  # pairs of one size at a time
        out: list = [None] * len(guides)
        for size in sizes:
            at = [i for i, (g, s) in enumerate(zip(guides, sites, strict=True)) if (len(g), len(s)) == size]
            for i, r in zip(at, align_batch([guides[i] for i in at], [sites[i] for i in at], k, match, strip), strict=True):
                out[i] = r
        return out
    g, s = _matrix(guides), _matrix(sites)
    ok = _matches(g, s, match)
    if strip and ok.size:
        lead = _prefix(ok)
        if lead.any():
            rest = align_batch([x[p:] for x, p in zip(guides, lead, strict=True)], [x[p:] for x, p in zip(sites, lead, strict=True)], k, match, False)
            return [(gs[:p] + a, ss[:p] + b, d) if d <= k else ("", "", k + 1) for gs, ss, p, (a, b, d) in zip(guides, sites, lead, rest, strict=True)]
    cost, move = _table(ok)
    last = cost[:, -1, :]
    ends, best = last.argmin(axis=1), last.min(axis=1)
    out = []
    for r, (end, d) in enumerate(zip(ends, best, strict=True)):
        if d > k:
            out.append(("", "", k + 1))
            continue
        i, j, a, b = g.shape[1], int(end), [], []
        while i or j:
            step = move[r, i, j]
            a.append("-" if step == _TOP else guides[r][i - 1])
            b.append("-" if step == _LEFT else sites[r][j - 1])
            i, j = i - (step != _TOP), j - (step != _LEFT)
        out.append(("".join(reversed(a)), "".join(reversed(b)), int(d)))
    return out


def distance_batch(guides: list[str], sites: list[str], k: int, match: str = "compatible") -> list[tuple[int, int]]:
    """(distance or k + 1, site letters left over) of each pair; of several best ends the last counts."""
    out: list = [None] * len(guides)
    by_size: dict = {}
    for i, (g, s) in enumerate(zip(guides, sites, strict=True)):
        by_size.setdefault((len(g), len(s)), []).append(i)
    for at in by_size.values():
        ok = _matches(_matrix([guides[i] for i in at]), _matrix([sites[i] for i in at]), match)
        last = _table(ok)[0][:, -1, :]
        best = last.min(axis=1)
        left = last[:, ::-1].argmin(axis=1)
        for i, d, r in zip(at, best, left, strict=True):
            out[i] = (int(d), int(r)) if d <= k else (k + 1, 0)
    return out


def align(guide: Column, site: Column, k: int, match: str = "compatible", strip: bool = True) -> Column:
    """struct<aln_guide, aln_ref, distance>; null where an argument is."""

    @F.pandas_udf("aln_guide string, aln_ref string, distance int")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for g, s in batches:
            given = (g.notna() & s.notna()).to_numpy()
            found = iter(align_batch(g[given].tolist(), s[given].tolist(), k, match, strip))
            rows = [next(found) if there else (None, None, None) for there in given]
            out = pd.DataFrame(rows, columns=["aln_guide", "aln_ref", "distance"])
            yield out.astype({"distance": "Int32"})

    return run(guide, site)


def masked_distance(guide: Column, site: Column, k: int, match: str = "compatible") -> Column:
    """Free-end distance under IUPAC matching, k + 1 if over k."""

    @F.pandas_udf("int")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for g, s in batches:
            yield pd.Series([d for d, _ in distance_batch(g.tolist(), s.tolist(), k, match)], dtype="int32")

    return run(guide, site)
