"""Operator 6, language ID: Bayesian fusion of text, declared markup language, address suffix and host priors.

Text: naive Bayes over hashed byte trigrams, fitted on a bounded sample of labelled documents.  Trigrams of a text
depend on each other, so a text speaks for at most ``effective`` of them: its log-likelihood is scaled by
min(1, effective / n).  A scan reduces each page to its log-likelihoods, declared language, host, domain and suffix;
all else works on that narrow table with grouped aggregates over all pages.

Text-only posteriors are soft counts.  Summed by declared language, and by address suffix, they give
P(declared | language) and P(suffix | language), smoothed.  Summed by host and domain they give the host's prior,
shrunk to its domain's, which is shrunk to the whole corpus; a page's own count is taken out of its host's and
domain's first, so that it isn't used twice.  Sums have a row a key and task before the shuffle.  They are joined back
by broadcast while they are small; beyond that adaptive execution splits a host that holds a third of all pages, as only
the narrow evidence is on its side.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._io import cut
from ._text import task

BINS = 1 << 15
UNDETERMINED = "und"
_NAME = re.compile(rb"(/?)([a-z][a-z0-9]*)")
_UNSEEN = {b"script", b"style", b"noscript", b"template"}
_LANG = re.compile(rb"\blang\s*=\s*(?:[\"']\s*)?([a-z]{2,3})\b")
_EQUIV = re.compile(rb"http-equiv\s*=\s*[\"']?content-language\b")
_CONTENT = re.compile(rb"\bcontent\s*=\s*(?:[\"']\s*)?([a-z]{2,3})\b")
_HOST = re.compile(r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", re.IGNORECASE)
_SECOND = {"ac", "co", "com", "edu", "gov", "net", "org"}  # registries under a country's suffix


def parse(page: str | None) -> tuple[str, str]:
    """(text without markup, scripts and styles; declared language or empty) of a page, in one pass.

    What is searched in vain isn't searched again, so the time is in proportion to the page's length, whatever it holds.
    """
    data = (page or "").encode("utf-8", "surrogatepass")
    low, parts, at = data.lower(), [], 0
    of_html, of_meta, missing = None, None, set()

    def find(what: bytes, start: int) -> int:
        found = -1 if what in missing else low.find(what, start)
        if found < 0:
            missing.add(what)
        return found

    while (tag := find(b"<", at)) >= 0:
        parts.append(data[at:tag])
        if low.startswith(b"<!--", tag) and (end := find(b"-->", tag + 4)) >= 0:
            at = end + 3
        elif (end := find(b">", tag)) >= 0:
            at, name = end + 1, _NAME.match(low, tag + 1)
            name = name[2] if name and not name[1] else b""
            if name == b"html":
                of_html = of_html or _LANG.search(low, tag, end)
            elif name == b"meta" and _EQUIV.search(low, tag, end):
                of_meta = of_meta or _CONTENT.search(low, tag, end)
            elif name in _UNSEEN and (close := find(b"</" + name, at)) >= 0:
                at = find(b">", close) + 1 or len(data)
        else:
            at = tag
            break
        parts.append(b" ")
    parts.append(data[at:])
    found = of_html or of_meta
    return html.unescape(b"".join(parts).decode("utf-8", "surrogatepass")), found[1].decode() if found else ""


def visible(page: str | None) -> str:
    """The text of a page without markup, scripts and styles."""
    return parse(page)[0]


def trigrams(text: str) -> np.ndarray:
    """Hashed byte trigrams of the lower-cased letters, words set apart by one space."""
    letters = re.sub(r"[\W\d_]+", " ", text.lower()).strip()
    b = np.frombuffer(f" {letters} ".encode(), np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64)
    code = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)
    return (code >> np.uint32(17)).astype(np.int64)


class TextModel:
    """log P(trigram | language), BINS rows, a column for each of ``languages``."""

    def __init__(self, languages: list[str], table: np.ndarray, effective: float):
        self.languages, self.table, self.effective = languages, table, effective

    def log_likelihood(self, text: str) -> np.ndarray:
        at = trigrams(text)
        if not len(at):
            return np.zeros(len(self.languages))
        return self.table[at].sum(axis=0, dtype=np.float64) * min(1.0, self.effective / len(at))


def _bin_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            at, n = np.unique(trigrams(text.as_py()), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int64))], ["lang", "bin", "n"])


def _column(pdf: pd.DataFrame) -> pd.DataFrame:
    counts = np.zeros(BINS, np.int64)
    counts[pdf["bin"]] = pdf["n"]
    return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "counts": [counts.tobytes()]})


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", max_a_language: int = 500, max_languages: int = 256, effective: float = 48.0) -> TextModel:
    """Fit on whole texts: at most ``max_a_language`` different labelled rows of each language, those of the smallest hash.

    So a rare language is drawn as fully as a common one.  At most ``max_languages`` are told apart, those with the most
    rows.  Texts are counted where they lie; the driver gets BINS counts a language.

    Defined cases: rows without a text or language are left out; without any labelled row the model knows one language,
    "und"; a language whose texts have no letters is known by its prior alone.
    """
    given = labelled.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    sizes = given.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).collect()
    languages = sorted(r["lang"] for r in sizes)
    counts = {}
    if languages:
        # rows under a bound on the hash that lets somewhat more than wanted through; the rest by rank, among those few
        share = [(r["lang"], min(1.0, (1.2 * max_a_language + 50) / r["count"])) for r in sizes]
        bounds = labelled.sparkSession.createDataFrame(share, "lang string, share double")
        drawn = given.join(F.broadcast(bounds), "lang").withColumn("draw", F.xxhash64("text", "lang"))
        drawn = drawn.where(F.shiftrightunsigned("draw", 11) * F.lit(2.0**-53) < F.col("share")).dropDuplicates(["lang", "draw"])
        rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
        drawn = drawn.withColumn("rank", rank).where(F.col("rank") <= max_a_language)
        found = drawn.select("lang", "text").mapInArrow(task(_bin_counts), "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
        counts = {r["lang"]: np.frombuffer(r["counts"], np.int64) for r in found.groupBy("lang").applyInPandas(_column, "lang string, counts binary").collect()}
    languages = languages or [UNDETERMINED]
    table = np.stack([counts.get(x, np.zeros(BINS, np.int64)) for x in languages], axis=1) + 0.1
    return TextModel(languages, np.log(table / table.sum(axis=0)).astype(np.float32), effective)


def address(url: str | None) -> tuple[str, str, str]:
    """(host, domain, suffix) of an address; empty where it has none.  The domain is what a registry gives: a.com, a.co.uk."""
    m = _HOST.match(url or "")
    host = m[1].lower().rstrip(".") if m else ""
    parts = host.split(".")
    labels = 3 if len(parts) > 2 and len(parts[-1]) == 2 and parts[-2] in _SECOND else 2
    return host, ".".join(parts[-labels:]), parts[-1] if m else ""


def _evidence(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = model.value
        for batch in batches:
            likelihoods, rest = [], []
            for url, page in zip(batch.column("url").to_pylist(), batch.column("html"), strict=True):
                text, declared = parse(page.as_py())
                likelihoods.append(held.log_likelihood(text))
                rest.append((*address(url), declared))
            table = np.array(likelihoods).reshape(-1, len(held.languages))
            columns = list(zip(*rest, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *(pa.array(c, pa.string()) for c in columns), *(pa.array(np.ascontiguousarray(table[:, k])) for k in range(table.shape[1]))],
                ["id", "host", "domain", "suffix", "declared", *(f"l{k}" for k in range(table.shape[1]))],
            )

    return task(run)


def _softmax(scores: list[Column]) -> list[Column]:
    top = F.greatest(*scores) if len(scores) > 1 else scores[0]
    parts = [F.exp(s - top) for s in scores]
    total = sum(parts[1:], parts[0])
    return [p / total for p in parts]


def identify_languages(
    pages: DataFrame,
    model: TextModel,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    host_strength: float = 8.0,
    domain_strength: float = 16.0,
    smoothing: float = 1.0,
) -> DataFrame:
    """A row for each input row: ``id_col``, lang, confidence, and p_<language> for each of the model's languages.

    Defined cases: a page without text or html is judged by what else is known; a missing declared language, suffix or
    host is a value of its own; null and repeated ids are passed on, and equal rows get equal results; ties go to the
    first language by name; an empty table gives an empty result; other columns are ignored.
    """
    spark, langs = pages.sparkSession, model.languages
    k = range(len(langs))
    held = spark.sparkContext.broadcast(model)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    kind = dict(rows.dtypes)["id"]
    schema = f"id {kind}, host string, domain string, suffix string, declared string, " + ", ".join(f"l{i} double" for i in k)
    seen = cut(rows.mapInArrow(_evidence(held), schema), "evidence")
    seen = seen.withColumns({f"t{i}": c for i, c in enumerate(_softmax([F.col(f"l{i}") for i in k]))})

    def sums(key: str, tag: str) -> DataFrame:
        return cut(seen.groupBy(key).agg(*(F.sum(f"t{i}").alias(f"{tag}{i}") for i in k), F.count("*").alias(f"{tag}n")), f"by-{key}")

    total = seen.agg(*(F.sum(f"t{i}") for i in k), F.count("*")).first()
    whole = [(total[i] or 0.0) + smoothing for i in k]
    joined = seen
    for key, tag in (("host", "h"), ("domain", "d"), ("suffix", "s"), ("declared", "m")):
        joined = joined.join(sums(key, tag), key, "left")
    prior = [w / sum(whole) for w in whole]
    less = lambda tag, i: F.greatest(F.col(f"{tag}{i}") - F.col(f"t{i}"), F.lit(0.0))
    domain = [(less("d", i) + domain_strength * prior[i]) / (F.col("dn") - 1 + domain_strength) for i in k]
    host = [(less("h", i) + host_strength * domain[i]) / (F.col("hn") - 1 + host_strength) for i in k]

    def likelihood(tag: str, i: int) -> Column:
        """P(value | language), the page's own count taken out."""
        return (less(tag, i) + smoothing * prior[i]) / (whole[i] + smoothing)

    scores = [F.col(f"l{i}") + F.log(host[i]) + F.log(likelihood("m", i)) + F.log(likelihood("s", i)) for i in k]
    joined = joined.withColumns({f"q{i}": s for i, s in enumerate(scores)})
    joined = joined.withColumns({f"p_{lang}": c for lang, c in zip(langs, _softmax([F.col(f"q{i}") for i in k]), strict=True)})
    best = F.greatest(*(F.col(f"p_{x}") for x in langs)) if len(langs) > 1 else F.col(f"p_{langs[0]}")
    lang = F.coalesce(*(F.when(F.col(f"p_{x}") == best, F.lit(x)) for x in langs))
    return joined.select(F.col("id").alias(id_col), lang.alias("lang"), best.alias("confidence"), *(F.col(f"p_{x}") for x in langs))
