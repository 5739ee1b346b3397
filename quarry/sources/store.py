"""Derived tables kept beside the session: built once for a state of their sources, then read.

A derived table is Parquet, partitioned, in a folder named by a fingerprint of the source files. The
next query that asks for it reads the columns and the partitions that it needs."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Sequence
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_known: dict[tuple[str, str, tuple[str, ...]], tuple[str, str]] = {}


def folder(spark: SparkSession) -> str:
    """Where derived tables go: the folder that driver and executors share (spark.checkpoint.dir), a
    temporary one in a session of one process, the warehouse else."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        found = f"file://{tempfile.mkdtemp(prefix='quarry-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return (found or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def state(spark: SparkSession, paths: Sequence[str]) -> str:
    """A fingerprint of files by path, size and time of change; their content is not read."""
    rows = []
    for p in paths:
        files = spark.read.format("binaryFile").load(p)
        told = files.agg(F.count(F.lit(1)), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")))
        rows.append((p, *map(str, told.first())))
    return sha256(repr(sorted(rows)).encode()).hexdigest()[:24]


def stored(spark: SparkSession, name: str, paths: Sequence[str], build: Callable[[], DataFrame], by: str | None = None) -> DataFrame:
    """build()'s rows, from a stored table if the files at paths are as they were when it was made. by: a
    column to partition by. The table is written under a name that only a finished write gets read by."""
    key = (spark.sparkContext.applicationId, name, tuple(paths))
    now = state(spark, paths)
    have = _known.get(key)
    if have is None or have[0] != now:
        path = f"{folder(spark)}/quarry-{spark.sparkContext.applicationId}/{name}-{now}"
        df = build()
        writer = df.repartition(by).write if by else df.write
        (writer.partitionBy(by) if by else writer).mode("overwrite").parquet(path)
        have = _known[key] = (now, path)
    return spark.read.parquet(have[1])
