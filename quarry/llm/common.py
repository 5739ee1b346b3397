"""Plumbing shared by the training-data operators: scratch tables and gapless ranks."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a session
    that runs in one process gets a temporary folder; on a cluster that would lose rows, and is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: scratch tables need a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='quarry-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors, and
    makes sure that the work above is done once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quarry-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """What runs within sends at most `rows` rows at once to Python workers: rows here hold whole texts, and
    a batch is held several times over, outside the heap too."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, str(rows if int(was) <= 0 else min(rows, int(was))))
    try:
        yield
    finally:
        spark.conf.set(key, was)


def _remove(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is None:
        return
    hadoop = sc._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(sc._jsc.hadoopConfiguration()).delete(hadoop, True)


def release() -> None:
    """Delete the scratch tables written so far; runs by itself at exit. Results that still read
    them must have been written before."""
    while _written:
        try:
            _remove(*_written.pop())
        except Exception:  # the JVM may be gone at exit
            return


atexit.register(release)


def spare(df: DataFrame, name: str) -> str:
    """name, or name with underscores before it, such that df has no such column."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


def without(df: DataFrame, *names: str) -> DataFrame:
    """Rename columns of df that clash with names the operator is about to add."""
    clash = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`").alias(f"input_{c}" if c.lower() in clash else c) for c in df.columns])


def few(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A stored table of a few numbers a row for the small side of a join: sent to every executor up to
    `most` rows, some 20 MB; beyond, both sides are shuffled."""
    return F.broadcast(df) if df.count() <= most else df.hint("merge")


def by_rows(df: DataFrame, rows: int, most: int = 200_000) -> DataFrame:
    """A side of a join that has about `rows` rows. A stored table's size as a file does not tell its size as a
    broadcast, ten times that, held by the driver: up to `most` rows the session decides, beyond them the
    join sorts."""
    return df if rows <= most else df.hint("merge")


def gapless_rank(df: DataFrame, keys: list[str], order: list[Column], name: str, rows: int | dict[int, int], per_bucket: int = 100_000) -> DataFrame:
    """Add a rank from 0 without gaps within each key, however many rows a key holds.

    rows: how many there are, or, of a single key with few values, how many each value has; then only
    the values above per_bucket are spread. A key's rows are spread over hash buckets of the order columns; ranks run within a bucket, and
    the buckets' counts, summed, are the offset. So no task sorts more than about per_bucket rows.
    Rows that are equal in all order columns may take each other's rank."""
    bucket, within, start = (spare(df, n) for n in ("_bucket", "_within", "_before"))
    own = {k: spare(df, f"_o_{k}") for k in (*keys, bucket)}
    if isinstance(rows, dict):
        many = {k: -(-n // per_bucket) for k, n in rows.items() if n > per_bucket}
        parts = F.create_map(*[F.lit(x) for kv in many.items() for x in kv]) if many else None
        buckets = F.coalesce(F.try_element_at(parts, F.col(keys[0]).cast("int")), F.lit(1)) if many else F.lit(1)
    else:
        buckets = F.lit(max(1, -(-rows // per_bucket)))
    spread = df.withColumn(bucket, F.pmod(F.xxhash64(*order), buckets).cast("int"))
    counts = spread.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*[F.col(k).alias(own[k]) for k in own], F.coalesce(before, F.lit(0)).alias(start))
    ranked = spread.withColumn(within, F.row_number().over(Window.partitionBy(*keys, bucket).orderBy(*order)))
    on = [F.col(k).eqNullSafe(F.col(own[k])) for k in keys] + [F.col(bucket) == F.col(own[bucket])]
    joined = ranked.join(offsets, on, "inner")
    return joined.withColumn(name, (F.col(within) - 1 + F.col(start)).cast("long")).drop(*own.values(), start, within, bucket)


def text_column(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and text alone; null texts become empty ones."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def empty(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
