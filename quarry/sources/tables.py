"""Scans: JSON lines with explicit schemas, newest file per key, maps, and spreadsheets' header rows."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from datetime import date, datetime, time, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.parse import finite, positive
from quarry.operators.features import keep_last, require_columns

PRICE = T.StructType([T.StructField(n, T.StringType()) for n in ("date", "isin", "lei", "issuer", "ticker", "yahoo_symbol", "mapping_source")] + [T.StructField("close", T.DoubleType())])


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All files of a glob, each row with its file, so that later files can win."""
    return spark.read.schema(schema).json(path).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))


def load_prices(spark: SparkSession, path: str) -> DataFrame:
    """One finite price above zero for each symbol and day; later files win, later rows in a file too."""
    rows = json_lines(spark, path, PRICE).withColumn("date", F.to_date("date")).withColumn("_row", F.monotonically_increasing_id())
    rows = rows.where(positive(F.col("close")) & F.col("date").isNotNull() & F.col("yahoo_symbol").isNotNull())
    return keep_last(rows, ["yahoo_symbol", "date"], [F.col("_file"), F.col("_block"), F.col("_row")]).drop("_file", "_block", "_row")


def load_market(df: DataFrame) -> DataFrame:
    require_columns(df, {"market_date", "market_close"}, "market")
    rows = df.select(F.to_date("market_date").alias("market_date"), finite(F.col("market_close")).alias("market_close")).where("market_date is not null and market_close > 0")
    return keep_last(rows, ["market_date"], [F.col("market_close")])


def newest_file(spark: SparkSession, path: str, schema: T.StructType, key: str) -> DataFrame:
    """Rows of the file last written for each value of the key."""
    rows = spark.read.schema(schema).json(path).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_modification_time").alias("_time"))
    best = rows.groupBy(key).agg(F.max_by("_file", F.struct("_time", "_file")).alias("_best"))
    return rows.join(best, key).where("_file = _best").drop("_file", "_time", "_best")


def explode_map(df: DataFrame, json_col: str, field: str, key: str, value_schema: str) -> DataFrame:
    """Rows of a JSON object of objects: key and the value's fields."""
    parsed = df.select(F.from_json(json_col, f"{field} map<string, struct<{re.sub(r'(\w+) (\w+)', r'\1: \2', value_schema)}>>").alias("_j"))
    return parsed.select(F.explode(f"_j.{field}").alias(key, "_v")).select(key, "_v.*")


def header_row(rows: Sequence[Sequence[object]], groups: Iterable[Iterable[str]], within: int = 100) -> int:
    """The first of `within` rows in which every group of terms has one that occurs in a cell."""
    wanted = [[t.casefold() for t in g] for g in groups]
    for i, row in enumerate(rows[:within]):
        cells = [str(c).strip().casefold() for c in row if c is not None]
        if all(any(t in c for t in g for c in cells) for g in wanted):
            return i
    raise ValueError("no header row")


def find_column(columns: Sequence[str], names: Sequence[str]) -> str | None:
    """A column by exact name, else by a part of its name."""
    low = {c.strip().casefold(): c for c in reversed(list(columns))}
    for n in names:
        if n.casefold() in low:
            return low[n.casefold()]
    return next((c for n in names for c in columns if n.casefold() in c.casefold()), None)


def spreadsheet(spark: SparkSession, path: str, groups: Iterable[Iterable[str]], sheet: int | str = 0) -> DataFrame:
    """A sheet of an ODS or XLSX file, from its header row on, as strings. Such files are a few MB and
    are opened on the driver."""
    import pandas as pd

    raw = pd.read_excel(path, sheet_name=sheet, header=None, dtype=str)
    at = header_row(raw.values.tolist(), groups)
    body = raw.iloc[at + 1 :].dropna(how="all")
    body.columns = [str(c).strip() for c in raw.iloc[at]]
    return spark.createDataFrame(body.where(body.notna(), None))


def last_usable_day(now: datetime, zone: str = "Europe/Stockholm", closed: time = time(18)) -> date:
    """The last calendar day whose closing prices may be used: today from `closed` on, else yesterday.
    now must know its zone."""
    local = now.astimezone(ZoneInfo(zone))
    return local.date() if local.time() >= closed else local.date() - timedelta(days=1)


def html_tables(spark: SparkSession, pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """Cells of the tables in HTML pages: key, table, row and cells, numbered from 0. Markup is parsed where
    the pages are; broken markup gives what can be read."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self) -> None:
            super().__init__(convert_charrefs=True)
            self.found: list[tuple[int, int, list[str]]] = []
            self.table, self.row, self.cells, self.text, self.open = -1, -1, [], [], False

        def handle_starttag(self, tag: str, attrs: list) -> None:
            if tag == "table":
                self.end_row()
                self.table, self.row = self.table + 1, -1
            elif tag == "tr":
                self.end_row()
                self.row += 1
            elif tag in ("td", "th"):
                self.end_cell()
                self.open = True

        def handle_endtag(self, tag: str) -> None:
            if tag in ("td", "th"):
                self.end_cell()
            elif tag in ("tr", "table"):
                self.end_row()

        def handle_data(self, data: str) -> None:
            if self.open:
                self.text.append(data)

        def end_cell(self) -> None:
            if self.open:
                self.cells.append(" ".join("".join(self.text).split()))
            self.text, self.open = [], False

        def end_row(self) -> None:
            self.end_cell()
            if self.cells and self.table >= 0:
                self.found.append((self.table, max(self.row, 0), self.cells))
            self.cells = []

    def run(batches):  # noqa: ANN001, ANN202
        import pandas as pd

        for pdf in batches:
            rows = []
            for k, page in zip(pdf["k"], pdf["h"], strict=True):
                reader = Reader()
                reader.feed(page or "")
                reader.close()
                reader.end_row()
                rows += [(k, *f) for f in reader.found]
            yield pd.DataFrame(rows, columns=[key, "table", "row", "cells"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(F.col(key).alias("k"), F.col(html).alias("h")).mapInPandas(run, f"{key} {kind}, table int, row int, cells array<string>")


def download_intervals(have: DataFrame, wanted: DataFrame, key: str, date: str) -> DataFrame:
    """What is missing per key: wanted has key, start and end; the parts before and after what is there.
    A key without rows lacks all. Downloading itself is left to the caller."""
    spans = have.groupBy(key).agg(F.min(date).alias("_a"), F.max(date).alias("_b"))
    j = wanted.join(spans, key, "left")
    part = lambda a, b, name: F.struct(a.alias("start"), b.alias("end"), F.lit(name).alias("part"))
    parts = F.when(F.col("_a").isNull(), F.array(part(F.col("start"), F.col("end"), "all"))).otherwise(F.array(part(F.col("start"), F.date_sub("_a", 1), "backfill"), part(F.date_add("_b", 1), F.col("end"), "update")))
    return j.select(key, F.explode(parts).alias("_p")).select(key, "_p.*").where("start <= end")
