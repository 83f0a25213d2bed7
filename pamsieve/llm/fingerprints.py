"""Operator 3, document fingerprints: canonical exact digests, DataFrame and SQL functions only.

A text's canonical form is its NFKC form, case-folded (full Unicode folding), NFKC again, with each run of white
space one space and none at the ends.  Spark has no function for NFKC or folding, but its ``reflect`` calls those of
the Unicode library it ships with; texts of ASCII only take ``lower``, which gives the same.  The fingerprint is four
xxhash64 lanes with different seeds, 256 bits in hex.

Groups: fingerprints that occur more than once are found on (fingerprint) alone; a bitmap of them, of a fixed size
at most, keeps all other texts out of the shuffle.  What is left is aggregated by fingerprint and canonical bytes, so
equal buckets are compared byte by byte, and a group with a third of all rows costs a row a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._filter import MAYBE, may_be_in
from ._io import cut, input_bytes, power_of_two

LANES = 4
_SPACE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]+"
POINTS = 64
BUCKET_BYTES = 4 << 20


def canonical(text: Column) -> Column:
    """The canonical form of a text that isn't null."""
    compose = lambda x: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(True))
    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), compose(text), F.lit(True))
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.trim(F.regexp_replace(F.when(ascii_only, F.lower(text)).otherwise(compose(folded)), _SPACE, " "))


def digest(text: Column, lanes: int = LANES) -> Column:
    """``lanes`` xxhash64 values with different seeds as hex."""
    return F.concat(*(F.lpad(F.lower(F.hex(F.xxhash64(F.lit(k), text))), 16, "0") for k in range(lanes)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, fingerprint) of each row; equal texts, and texts equal in canonical form, have equal fingerprints.

    Defined cases: a null text counts as empty; null and repeated ids are passed on; an empty table gives an empty
    result; other columns are ignored.
    """
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("canon", canonical(F.col("text"))).select(id_col, digest(F.col("canon")).alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    """Exact digests are alike or not."""
    return (a == b).cast("double")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lanes: int = LANES, filter_bits: int = 1 << 26) -> DataFrame:
    """(fingerprint, canonical or null, group_id, size) of each group of two or more rows with equal canonical bytes.

    ``canonical`` is given only where one fingerprint stands for several canonical texts, to tell its groups apart.
    group_id is the group's smallest id; nulls count as larger than all others, and as null if there are no others.
    """
    bits = power_of_two(input_bytes(docs) / 64, 1 << 15, filter_bits)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    canon = rows.select("id", canonical(F.col("text")).alias("canon"))
    marked = canon.select("id", "canon", digest(F.col("canon"), lanes).alias("fingerprint"))
    twice = cut(marked.groupBy("fingerprint").agg(F.count("*").alias("size")).where("size > 1").select("fingerprint"), "twice")
    some = may_be_in(marked, twice, "fingerprint", bits).where(MAYBE)
    groups = some.groupBy("fingerprint", "canon").agg(F.min("id").alias("group_id"), F.count("*").alias("size"))
    forms = Window.partitionBy("fingerprint")
    told = groups.withColumn("forms", F.count("*").over(forms)).where("size > 1 or forms > 1")
    return cut(told.select("fingerprint", F.when(F.col("forms") > 1, F.col("canon")).alias("canonical"), "group_id", "size"), "groups")


def _bucket(docs: DataFrame, n: int) -> Column:
    """About ``n`` ranges of ids, as even as percentiles at POINTS points and straight lines between them make them."""
    shares = [k / POINTS for k in range(POINTS + 1)]
    points = docs.select(F.percentile_approx("id", shares, 10_000).alias("p")).first()["p"]
    points = sorted(set(points or [0]))
    steps = max(1, -(-n // POINTS))

    def place(lo: int, hi: int) -> Column:
        if hi - lo <= 1:
            width = (points[hi] if hi < len(points) else points[lo] + 1) - points[lo]
            inner = F.floor((F.col("id") - points[lo]) / F.lit(float(width)) * steps)
            return F.lit(lo * steps) + F.least(F.greatest(inner, F.lit(0)), F.lit(steps - 1))
        mid = (lo + hi) // 2
        return F.when(F.col("id") < points[mid], place(lo, mid)).otherwise(place(mid, hi))

    return F.coalesce(place(0, max(1, len(points) - 1)), F.lit(-1)).cast("long")


def with_next(docs: DataFrame, enrich, columns: list[str], size: int) -> DataFrame:
    """Each row of ``enrich(docs)`` and ``next_<column>`` of the row after it by descending id; ``docs`` is (id, text).

    The last row's next is the first.  Nulls come last; rows of one id are ordered by text.  Rows are dealt out by
    ranges of ids, of about BUCKET_BYTES each: the only shuffle of texts.  A range's last row takes the first of the
    next range; those few firsts are found by id alone and read again.
    """
    bucket = _bucket(docs, max(1, size // BUCKET_BYTES))
    order = [F.col("id").desc_nulls_last(), F.col("text").desc()]
    own = Window.partitionBy("bucket").orderBy(*order)
    packed = F.struct(*(F.col(c) for c in columns))
    rows = enrich(docs).withColumn("bucket", bucket).withColumn("next", F.lead(packed).over(own))
    heads = cut(docs.select("id", bucket.alias("bucket")).groupBy("bucket").agg(F.max("id").alias("id")), "heads")
    some = may_be_in(docs.withColumn("known", F.coalesce("id", F.lit(-1))), heads.select(F.coalesce("id", F.lit(-1)).alias("known")), "known", 1 << 20)
    some = some.where(MAYBE).drop(MAYBE, "known")
    firsts = some.join(heads, some["id"].eqNullSafe(heads["id"])).select("bucket", "text").groupBy("bucket").agg(F.max("text").alias("text"))
    down = Window.orderBy(F.col("bucket").desc())  # over the ranges, not the rows
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ring = heads.select("bucket").withColumn("after", F.lead("bucket").over(down)).withColumn("top", F.max("bucket").over(whole))
    ring = ring.select(F.col("bucket").alias("from"), F.coalesce("after", "top").alias("bucket"))
    edges = cut(ring.join(enrich(firsts), "bucket").select(F.col("from").alias("bucket"), packed.alias("head")), "edges")
    joined = rows.join(edges, "bucket", "left")
    return joined.select("id", "text", *(c for c in columns if c != "text"), *(F.coalesce(F.col(f"next.{c}"), F.col(f"head.{c}")).alias(f"next_{c}") for c in columns))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text, of it with its last third replaced by the next document's beginning, and their likeness.

    The last floor(n_chars / 3) code points are replaced by the first as many (or all) of the next document by
    descending id; see ``with_next``.  Also group_id and group_size, the row's group of canonically equal texts.
    """
    size = input_bytes(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def marked(df: DataFrame) -> DataFrame:
        return df.withColumn("canon", canonical(F.col("text"))).withColumn("fingerprint", digest(F.col("canon"))).drop("canon")

    groups = exact_groups(docs, id_col, text_col)
    n, cutoff = F.char_length("text"), F.floor(F.char_length("text") / 3).cast("int")
    pairs = with_next(rows, marked, ["text", "fingerprint"], size)
    edited = pairs.select("id", "text", n.cast("long").alias("n_chars"), "fingerprint", F.col("next_fingerprint").alias("following"), F.concat(F.substring("text", F.lit(1), n - cutoff), F.substring("next_text", F.lit(1), cutoff)).alias("edited"))
    edited = edited.withColumn("canon", canonical(F.col("edited")))
    clashing = groups.where("canonical is not null").select("fingerprint").distinct()
    out = edited.select(
        "id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", digest(F.col("canon")).alias("edited_fingerprint"), "following"
    ).withColumns({"near_edited": likeness(F.col("fingerprint"), F.col("edited_fingerprint")), "near_next": likeness(F.col("fingerprint"), F.col("following"))})
    plain = groups.where("canonical is null").select("fingerprint", "group_id", "size")
    joined = out.drop("following").join(plain, "fingerprint", "left").select(F.col("id").alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", F.coalesce("group_id", "id").alias("group_id"), F.coalesce("size", F.lit(1)).alias("group_size"))
    return joined if clashing.isEmpty() else _apart(joined, docs, groups, id_col, text_col)


def _apart(joined: DataFrame, docs: DataFrame, groups: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Group ids where different canonical texts share a fingerprint: by their bytes."""
    told = groups.where("canonical is not null").select("fingerprint", F.col("canonical").alias("canon"), F.col("group_id").alias("g"), F.col("size").alias("s"))
    rows = docs.select(F.col(id_col).alias("id"), canonical(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("canon"))
    by_id = rows.select("id", "canon", digest(F.col("canon")).alias("fingerprint")).join(told, ["fingerprint", "canon"]).select("fingerprint", F.col("id").alias(id_col), "g", "s").distinct()
    return joined.join(by_id, ["fingerprint", id_col], "left").withColumns({"group_id": F.coalesce("g", "group_id"), "group_size": F.coalesce("s", "group_size")}).drop("g", "s")
