"""Where operators cut lineage, and how they size what they broadcast."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where it is unset in local mode (tests), one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="pamsieve-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        found = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_made: list[str] = []


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later plans start there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
    if path in _made:
        _made.remove(path)


def discard(*cuts: DataFrame) -> None:
    """Delete cut tables that no later plan reads."""
    for df in cuts:
        _delete(df.sparkSession, df.cut_path)


def tables() -> list[str]:
    """The cut tables that are still there, oldest first; results of operators may read them."""
    return list(_made)


def clean(spark: SparkSession, keep: list[str] = ()) -> None:
    """Delete all cut tables but those in ``keep``: for callers that have written the results they wanted."""
    for path in tables():
        if path not in keep:
            _delete(spark, path)


BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Have the session hand texts to Python at most BATCH_ROWS at a time: a task holds a batch several times over.

    Spark bounds these batches by rows only, and by 10 000 of them unless told otherwise.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def input_bytes(df: DataFrame) -> int:
    """The optimizer's size of ``df`` in bytes, without running anything."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def power_of_two(x: float, least: int, most: int) -> int:
    return min(most, max(least, 1 << max(0, math.ceil(math.log2(max(1.0, x))))))


def bloom(df: DataFrame, key, bits: int) -> bytearray:
    """A one-hash Bloom filter of ``key`` (a long column expression) with ``bits`` bits, built by bitmap aggregates.

    At most bits / 8 bytes come to the driver.  Members are always found; see ``bloom_position``.
    """
    at = bloom_position(key, bits)
    rows = (
        df.select(at.alias("at"))
        .groupBy(F.bitmap_bucket_number("at").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
        .collect()
    )
    out = bytearray(max(bits // 8, 4096))
    for bucket, part in rows:
        at0 = (bucket - 1) * 4096
        out[at0 : at0 + len(part)] = part
    return out


def bloom_position(key, bits: int):
    """The 1-based bit of a key; in Python bit p is byte (p-1) // 8, value 1 << (p-1) % 8."""
    return F.pmod(F.xxhash64(key), F.lit(bits)) + 1
