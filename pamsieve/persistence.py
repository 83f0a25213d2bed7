"""Stored tables: sites partitioned and sorted by prefix, counts, hits, and what describes them."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
from dataclasses import asdict
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .motif import Motif


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where it is unset in local mode (tests), one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="pamsieve-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        found = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def save(df: DataFrame, path: str, motif: Motif | None = None, name: str = "", **details) -> None:
    """Write a table and, beside it, one row of JSON on how it was made; both by Spark, so any file system will do."""
    df.write.mode("overwrite").parquet(f"{path}/table")
    about = {"name": name, "date": datetime.now(timezone.utc).isoformat(), "motif": asdict(motif) if motif else None, **details}
    df.sparkSession.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def save_sites(sites: DataFrame, path: str, motif: Motif, prefix_length: int = 7, files: int | None = None, name: str = "", **details) -> None:
    """Write sites sorted by their prefix within files that hold ranges of prefixes, so that searches by prefix skip most."""
    if not 0 < prefix_length <= motif.length_no_pam + motif.distance:
        raise ValueError("the prefix must be part of the site")
    keyed = sites.withColumn("prefix", F.substring("site", 1, prefix_length))
    parted = keyed.repartitionByRange(files, "prefix") if files else keyed.repartitionByRange("prefix")
    save(parted.sortWithinPartitions("prefix", "site"), path, motif, name, prefix_length=prefix_length, **details)


def load(spark: SparkSession, path: str) -> tuple[DataFrame, Motif | None, dict]:
    """(table, motif, what else is known) of a stored table."""
    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    found = Motif(**about["motif"]) if about.get("motif") else None
    return spark.read.parquet(f"{path}/table"), found, about


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """Write rows as CSV with a header; ``single``: one file, for small results."""
    (df.coalesce(1) if single else df).write.mode("overwrite").csv(path, header=True)
