"""Genome sources: FASTA, 2bit, and contigs derived from a table of texts; all give (chrom_id, chrom, n, seq)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CONTIGS = "chrom_id int, chrom string, n long, seq string"
FASTA_SUFFIXES = (".fa", ".fasta", ".fna")


def suffix(path: str) -> str:
    found = re.search(r"\.[A-Za-z0-9]+$", path)
    if not found:
        raise ValueError(f"no file suffix in {path}")
    return found[0]


def is_fasta(path: str) -> bool:
    """Whether a path names FASTA; 2bit is the only other kind."""
    kind = suffix(path)
    if kind in FASTA_SUFFIXES:
        return True
    if kind == ".2bit":
        return False
    raise ValueError(f"neither FASTA nor 2bit: {path}")


def _numbered(named: DataFrame) -> DataFrame:
    """Contigs without empty ones, numbered by name; the window is over names, not sequences' letters."""
    kept = named.where("chrom != '' and n > 0")
    ids = kept.select("chrom").distinct().withColumn("chrom_id", F.row_number().over(Window.orderBy("chrom")) - 1)
    return kept.join(ids, "chrom").select(F.col("chrom_id").cast("int"), "chrom", F.col("n").cast("long"), "seq")


def read_fasta(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Records of FASTA files; a record is split off at '>', so a file is read in as many tasks as it has splits.

    A name is what stands before the first white space.  Letters are upper-cased and anything but letters and '-' goes.
    """
    text = spark.read.text(paths, lineSep=">").where("trim(value) != ''")
    head = F.regexp_extract("value", r"^[^\r\n]*", 0)
    body = F.upper(F.regexp_replace(F.expr("substring(value, length(regexp_extract(value, '^[^\\\\r\\\\n]*', 0)) + 1)"), r"[^A-Za-z\-]+", ""))
    named = text.select(F.element_at(F.split(head, r"\s"), 1).alias("chrom"), body.alias("seq"))
    return _numbered(named.withColumn("n", F.char_length("seq")))


def decode_2bit(content: bytes) -> list[tuple[str, str]]:
    """(name, sequence) of the records of a 2bit file; blocks of N are N, masked letters are upper-cased."""
    order = "<" if int.from_bytes(content[:4], "little") == 0x1A412743 else ">"
    word = lambda at, n=1: np.frombuffer(content, f"{order}u4", n, at)
    magic, version, count, _ = word(0, 4)
    if magic != 0x1A412743 or version != 0:
        raise ValueError("not a 2bit file")
    letters = np.frombuffer(b"TCAG", np.uint8)
    at, out = 16, []
    for _ in range(count):
        size = content[at]
        name, offset = content[at + 1 : at + 1 + size].decode(), int(word(at + 1 + size)[0])
        at += 1 + size + 4
        n, blocks = (int(x) for x in word(offset, 2))
        starts, sizes = word(offset + 8, blocks), word(offset + 8 + 4 * blocks, blocks)
        p = offset + 8 + 8 * blocks
        masked = int(word(p)[0])
        p += 4 + 8 * masked + 4
        packed = np.frombuffer(content, np.uint8, -(-n // 4), p)
        seq = letters[(packed[:, None] >> np.array([6, 4, 2, 0], np.uint8)) & 3].reshape(-1)[:n].copy()
        for s, k in zip(starts, sizes, strict=True):
            seq[s : s + k] = ord("N")
        out.append((name, seq.tobytes().decode()))
    return out


def encode_2bit(records: list[tuple[str, str]]) -> bytes:
    """A 2bit file of records; letters other than ACGT become N."""
    index, bodies = b"", []
    offset = 16 + sum(1 + len(n.encode()) + 4 for n, _ in records)
    code = np.full(256, 0, np.uint8)
    code[list(b"TCAG")] = range(4)
    for name, seq in records:
        letters = np.frombuffer(seq.upper().encode(), np.uint8)
        other = np.concatenate([[False], ~np.isin(letters, list(b"ACGT")), [False]])
        starts, ends = np.flatnonzero(~other[:-1] & other[1:]), np.flatnonzero(other[:-1] & ~other[1:])
        quads = np.zeros(-(-len(letters) // 4) * 4, np.uint8)
        quads[: len(letters)] = code[letters]
        packed = (quads.reshape(-1, 4) << np.array([6, 4, 2, 0], np.uint8)).sum(axis=1).astype(np.uint8)
        parts = [[len(letters), len(starts)], starts, ends - starts, [0, 0]]
        body = np.concatenate(parts).astype("<u4").tobytes() + packed.tobytes()
        index += bytes([len(name.encode())]) + name.encode() + int(offset).to_bytes(4, "little")
        offset += len(body)
        bodies.append(body)
    return np.array([0x1A412743, 0, len(records), 0], "<u4").tobytes() + index + b"".join(bodies)


def read_2bit(spark: SparkSession, path: str | list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                for name, seq in decode_2bit(content.as_py()):
                    yield pa.RecordBatch.from_pydict({"chrom": [name], "n": [len(seq)], "seq": [seq]})

    files = spark.read.format("binaryFile").load(path).select("content")
    return _numbered(files.mapInArrow(run, "chrom string, n long, seq string"))


def read_genome(spark: SparkSession, path: str) -> DataFrame:
    return read_fasta(spark, path) if is_fasta(path) else read_2bit(spark, path)


#: Fixed rule of the derived genome: the alphabet's letters become bases in turn, everything else goes.
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_BASES = ("ACGT" * 7)[:26] * 2


def dna_of(text: Column, keep_digits_as: str | None = None) -> Column:
    """A DNA string of any text; with ``keep_digits_as`` digits become that letter instead of going."""
    source, target = (_ALPHABET, _BASES) if keep_digits_as is None else (_ALPHABET + "0123456789", _BASES + keep_digits_as * 10)
    # letters that aren't translated have to go before they could be taken for bases
    only = F.regexp_replace(text, "[^A-Za-z0-9]" if keep_digits_as else "[^A-Za-z]", "")
    return F.translate(only, source, target)


def derived_contigs(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", digits: str | None = None) -> DataFrame:
    """A contig for each row of a table of texts, named by its id; rows without a base have none."""
    seq = dna_of(F.coalesce(F.col(text_col), F.lit("")), digits)
    rows = documents.select(F.col(id_col).cast("int").alias("chrom_id"), F.col(id_col).cast("string").alias("chrom"), seq.alias("seq"))
    return rows.select("chrom_id", "chrom", F.char_length("seq").cast("long").alias("n"), "seq").where("n > 0")


@dataclass(frozen=True)
class GenomeInfo:
    """What identifies a genome: a checksum of its file and its contigs' names."""

    path: str
    checksum: int
    contigs: tuple[str, ...]
    longest: int
    fasta: bool

    def same(self, other: GenomeInfo) -> bool:
        return self.checksum == other.checksum and set(self.contigs) == set(other.contigs)


def genome_info(spark: SparkSession, path: str) -> GenomeInfo:
    """Checksum (CRC-32 of each file's bytes, summed), contig names and the longest contig's length."""
    kind = is_fasta(path)
    checksum = spark.read.format("binaryFile").load(path).agg(F.sum(F.crc32("content"))).first()[0]
    contigs = read_genome(spark, path)
    rows = contigs.select("chrom_id", "chrom", "n").orderBy("chrom_id").collect()  # names and lengths only
    if not rows:
        raise ValueError(f"no contigs in {path}")
    return GenomeInfo(path, int(checksum), tuple(r["chrom"] for r in rows), max(r["n"] for r in rows), kind)
