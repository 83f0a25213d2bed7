"""The queries of this subpackage, by name, and DuckDB SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id
from .chat_format import rotate_perspectives
from .fingerprints import edited_fingerprints
from .jaccard_join import ngram_jaccard_join
from .lattice_sampling import sample_encodings
from .packing import pack
from .quality_rules import quality_rules
from .secret_scan import scan_secrets
from .substring_dedup import substring_dedup
from .token_counts import token_counts


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(_docs(spark, sf_dir), window=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(_docs(spark, sf_dir), shingle=3, percent=90)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(_docs(spark, sf_dir))


def op4_lattice_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sample_encodings(_docs(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), k=2, decoded=True)
    return out.select(
        "doc_id", "sample", (F.octet_length("ids") / 4).cast("long").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"),
        F.round("log_prob", 6).alias("log_prob"), F.round("inclusion", 9).alias("inclusion"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_docs(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language_id.train(_docs(spark, sf_dir), max_a_language=500)
    out = language_id.identify_languages(spark.read.parquet(f"{sf_dir}/pages.parquet"), model)
    return out.select("page_id", "lang", F.round("confidence", 9).alias("confidence"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_secrets(_docs(spark, sf_dir))
    spans = F.transform("findings", lambda f: F.concat_ws(":", f["word_no"].cast("string"), F.sha2(f["value"], 256), f["is_secret"].cast("string")))
    return out.select("doc_id", "n_candidates", "n_secrets", F.array_join(spans, " ").alias("findings"), F.sha2(F.coalesce("redacted", F.lit("")), 256).alias("redacted_sha256"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_docs(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=1, ids=True)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rotate_perspectives(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    mask = F.array_join(F.transform("mask", lambda m: F.concat_ws("-", m["start"].cast("string"), m["end"].cast("string"))), ",")
    return out.select("conv_id", "perspective", "block", "n_turns", "rendered", mask.alias("mask"))


WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1_SQL = rf"""
WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(ws[i:i+12], ' ') AS k
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)
),
firsts AS (SELECT k, min(doc_id) AS f FROM win GROUP BY k HAVING min(doc_id) < max(doc_id)),
gone AS (
  SELECT DISTINCT win.doc_id, j
  FROM win JOIN firsts ON win.k = firsts.k AND win.doc_id > firsts.f, unnest(range(i, i + 13)) AS u(j)
),
word AS (SELECT doc_id, generate_subscripts(ws, 1) AS j, unnest(ws) AS x FROM w),
kept AS (
  SELECT word.doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY j) AS t
  FROM word ANTI JOIN gone USING (doc_id, j) GROUP BY word.doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

OP2_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i+2], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 1))) AS i FROM w WHERE len(ws) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
b AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM b JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)),
r(x, y) AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
m AS (SELECT x, min(y) AS y FROM r GROUP BY x)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(m.y, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.x = w.doc_id
"""

OP8_SQL = rf"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS t, {WORDS} AS ws FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(ws[i:i+7], ' ') AS k
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)
),
twice AS (SELECT doc_id, k FROM win GROUP BY ALL HAVING count(*) > 1),
rep AS (
  SELECT doc_id, count(DISTINCT j) AS n
  FROM win JOIN twice USING (doc_id, k), unnest(range(i, i + 8)) AS u(j) GROUP BY doc_id
),
lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM w) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id
),
m AS (
  SELECT w.doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)
),
f AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         10 * n_symbols > word_chars AS symbols, 100 * n_dup_lines > 30 * n_lines AS dups FROM m
),
h AS (
  SELECT source, count(*) AS n, count_if(base_failed OR symbols OR dups) AS a, count_if(symbols) AS s, count_if(dups) AS d
  FROM f GROUP BY source
),
p AS (SELECT sum(n) AS tn, sum(a) / sum(n) AS ma, sum(s) / sum(n) AS ms, sum(d) / sum(n) AS md FROM h),
v AS (
  SELECT sum(n * pow(a / n - ma, 2)) / any_value(tn) AS va, sum(n * pow(s / n - ms, 2)) / any_value(tn) AS vs,
         sum(n * pow(d / n - md, 2)) / any_value(tn) AS vd FROM h, p
),
g AS (
  SELECT ma, ms, md,
         CASE WHEN va <= 0 THEN 1e6 ELSE least(1e6, greatest(1.0, ma * (1 - ma) / va - 1)) END AS ka,
         CASE WHEN vs <= 0 THEN 1e6 ELSE least(1e6, greatest(1.0, ms * (1 - ms) / vs - 1)) END AS ks,
         CASE WHEN vd <= 0 THEN 1e6 ELSE least(1e6, greatest(1.0, md * (1 - md) / vd - 1)) END AS kd FROM p, v
),
r AS (SELECT source, (a + ma * ka) / (n + ka) AS ra, (s + ms * ks) / (n + ks) AS rs, (d + md * kd) / (n + kd) AS rd FROM h, g)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR ra >= 0.5 OR (symbols AND rs >= 0.02) OR (dups AND rd >= 0.02)) AS kept
FROM f JOIN r ON f.source IS NOT DISTINCT FROM r.source
"""

ESCAPED = r"regexp_replace({}, '<(\\*)\|', '<\1\\|', 'g')"
OP10_SQL = f"""
WITH t AS (
  SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS own, turn, coalesce(role, 'unknown') AS who, coalesce(text, '') AS said
  FROM conversations
),
p AS (SELECT DISTINCT conv_id, own, who AS perspective FROM t WHERE who <> 'system'),
s AS (
  SELECT t.conv_id, t.own, perspective, turn, who, said,
         '<|im_start|>' || CASE WHEN who = 'system' THEN 'system' WHEN who = perspective THEN 'assistant'
           ELSE 'user name=' || {ESCAPED.format("translate(who, chr(10) || chr(13), '  ')")} END || chr(10) AS head,
         {ESCAPED.format("said")} || '<|im_end|>' AS body
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id AND t.own IS NOT DISTINCT FROM p.own
),
o AS (
  SELECT *, sum(length(head) + length(body) + 1) OVER w - 1 AS e, row_number() OVER w AS k
  FROM s WINDOW w AS (PARTITION BY conv_id, own, perspective ORDER BY turn NULLS FIRST, who, said ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, perspective, CAST(0 AS BIGINT) AS block, count(*) AS n_turns, string_agg(head || body || chr(10), '' ORDER BY k) AS rendered,
       coalesce(string_agg(CASE WHEN who = perspective THEN concat(CAST(e - length(body) AS BIGINT), '-', CAST(e AS BIGINT)) END, ',' ORDER BY k), '') AS mask
FROM o GROUP BY conv_id, own, perspective
"""

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_fingerprints": op3_fingerprints,
    "op4_lattice_sampling": op4_lattice_sampling,
    "op5_token_counts": op5_token_counts,
    "op6_language_id": op6_language_id,
    "op7_secret_scan": op7_secret_scan,
    "op8_quality_rules": op8_quality_rules,
    "op9_packing": op9_packing,
    "op10_chat_format": op10_chat_format,
}
ORACLE_SQL = {"op1_substring_dedup": OP1_SQL, "op2_jaccard_join": OP2_SQL, "op8_quality_rules": OP8_SQL, "op10_chat_format": OP10_SQL}
