"""Sinks: JSON-safe rows, chunked files, content-addressed sources, fingerprints, reports."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.parse import finite


def json_safe(df: DataFrame) -> DataFrame:
    """Dates as yyyy-MM-dd, NaN and infinities as null."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        kind = f.dataType.typeName()
        out.append((F.date_format(c, "yyyy-MM-dd") if kind in ("date", "timestamp") else finite(c) if kind in ("double", "float") else c).alias(f.name))
    return df.select(*out)


def write_chunks(df: DataFrame, path: str, rows: int = 7500, order: list[str] | None = None, most: int = 20 << 20) -> None:
    """JSON lines in files of at most `rows` rows, sorted within each. A file of `most` bytes or more is an
    error; what has been written is removed then."""
    safe = json_safe(df)
    if order:
        safe = safe.repartitionByRange(*order).sortWithinPartitions(*order)
    safe.write.option("maxRecordsPerFile", rows).mode("overwrite").json(path)
    spark = df.sparkSession
    large = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path).where(F.col("length") >= most).select("path", "length").orderBy("path").limit(5).collect()
    if large:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        raise ValueError(f"files of {most} bytes or more: {[(r['path'], r['length']) for r in large]}")


def content_name(content: Column, date: Column, extension: str, prefix: str = "source") -> Column:
    """The name of a raw file by its content: prefix_date_<12 digits of SHA-256>extension."""
    return F.concat(F.lit(f"{prefix}_"), date, F.lit("_"), F.substring(F.sha2(content, 256), 1, 12), F.lit(extension))


def write_sources(files: DataFrame, path: str, extension: str, prefix: str = "source") -> DataFrame:
    """Keep raw files (content binary, date string) under names made of their content, as rows name, sha256,
    content of a Parquet table by date. What is there already is not written again. The manifest of
    what was new comes back."""
    spark = files.sparkSession
    new = files.select(content_name(F.col("content"), F.col("date"), extension, prefix).alias("name"), F.sha2("content", 256).alias("sha256"), "date", "content").dropDuplicates(["name"])
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        new = new.join(spark.read.parquet(path).select("name"), "name", "left_anti")
    manifest = new.select("name", "sha256", "date").collect()  # one row a file fetched
    new.write.partitionBy("date").mode("append").parquet(path)
    return spark.createDataFrame([tuple(r) for r in manifest], "name string, sha256 string, date string")


def write_reports(title: str, sections: dict[str, list[dict[str, Any]]], folder: str) -> dict[str, str]:
    """A report of small tables as JSON, JSON lines, Markdown and one CSV a section; paths by kind."""
    from pathlib import Path

    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    files = {"json": ("report.json", json.dumps({"title": title, **sections}, indent=2, ensure_ascii=False, default=str)), "markdown": ("report.md", markdown(title, sections))}
    files["jsonl"] = ("report.jsonl", "".join(canonical({"section": k, **r}) + "\n" for k, rows in sections.items() for r in rows))
    for k, rows in sections.items():
        names = list(rows[0]) if rows else []
        cell = lambda v: "" if v is None else '"' + str(v).replace('"', '""') + '"' if any(c in str(v) for c in ',"\n') else str(v)
        files[f"csv:{k}"] = (f"{k}.csv", "".join(",".join(cell(r.get(n)) for n in names) + "\n" for r in [dict(zip(names, names, strict=True)), *rows]) if rows else "")
    for name, content in files.values():
        (out / name).write_text(content, encoding="utf-8")
    return {k: str(out / name) for k, (name, _) in files.items()}


def write_panel(df: DataFrame, path: str, date: str) -> None:
    """A panel by year, so that windows prune partitions."""
    df.withColumn("year", F.year(date)).repartition("year").write.partitionBy("year").mode("overwrite").parquet(path)


def source_fingerprint(spark: SparkSession, path: str) -> dict[str, str]:
    """SHA-256 of each file of a glob; the files are hashed where they are read, only hashes come back."""
    rows = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha")).collect()
    return {r["path"]: r["sha"] for r in rows}


def changed_sources(before: dict[str, str], after: dict[str, str]) -> dict[str, list[str]]:
    return {"added": sorted(after.keys() - before.keys()), "removed": sorted(before.keys() - after.keys()), "changed": sorted(k for k in before.keys() & after.keys() if before[k] != after[k])}


def canonical(value: Any) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str)


def fingerprint(value: Any) -> str:
    """SHA-256 of a value's canonical JSON."""
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def data_fingerprint(df: DataFrame) -> str:
    """The same for equal rows in any order: counts and sums of row hashes, aggregated before the shuffle."""
    columns = sorted(df.columns)
    r = df.select(F.xxhash64(*[F.col(f"`{c}`") for c in columns]).alias("h")).agg(F.count(F.lit(1)), F.sum(F.col("h").cast("decimal(38,0)")), F.bit_xor("h")).first()
    return fingerprint([columns, *map(str, r)])


def markdown(title: str, sections: dict[str, list[dict[str, Any]]]) -> str:
    """A report of small tables."""
    out = [f"# {title}"]
    for name, rows in sections.items():
        out += ["", f"## {name}", ""]
        if not rows:
            out.append("No rows.")
            continue
        names = list(rows[0])
        out += ["| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
        out += ["| " + " | ".join("" if r.get(n) is None else f"{r[n]:.6g}" if isinstance(r[n], float) else str(r[n]) for n in names) + " |" for r in rows]
    return "\n".join(out) + "\n"
