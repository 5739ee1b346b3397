"""Joins in time: forward as-of, fallback between keys, validity intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def forward(left: DataFrame, right: DataFrame, key: str, left_date: str, right_date: str, values: list[str]) -> DataFrame:
    """For each left row the first right row of its key on or after its date; unmatched rows keep
    nulls. Adds right_date and values.

    Both sides are laid end to end, sorted once by (key, date) from the latest on, and the last right
    row seen is carried along: one shuffle, no row multiplied, one step a row. (A frame that looks ahead
    to the end would be computed anew for each row.) Left keys and dates
    may repeat; of right rows with equal dates the least by value counts. Null keys or dates do not
    match. A key is one sort run, so its rows meet in one task, as in any sort by series."""
    payload = F.struct(F.col(right_date).alias("_date"), *[F.col(v).alias(v) for v in values])
    kind = right.select(payload.alias("p")).schema["p"].dataType
    rest = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(left.columns)])
    rest_kind = left.select(rest.alias("r")).schema["r"].dataType
    a = left.select(F.col(key).alias("_k"), F.col(left_date).alias("_d"), F.lit(0).alias("_side"), rest.alias("_row"), F.lit(None).cast(kind).alias("_p"))
    b = right.where(F.col(key).isNotNull() & F.col(right_date).isNotNull()).select(F.col(key).alias("_k"), F.col(right_date).alias("_d"), F.lit(1).alias("_side"), F.lit(None).cast(rest_kind).alias("_row"), payload.alias("_p"))
    back = Window.partitionBy("_k").orderBy(F.col("_d").desc(), F.col("_side").desc(), F.col("_p").desc()).rowsBetween(Window.unboundedPreceding, 0)
    met = a.unionByName(b).withColumn("_m", F.when(F.col("_k").isNotNull() & F.col("_d").isNotNull(), F.last("_p", ignorenulls=True).over(back))).where("_side = 0")
    own = [F.col(f"_row.c{i}").alias(c) for i, c in enumerate(left.columns)]
    return met.select(*own, F.col("_m._date").alias(right_date), *[F.col(f"_m.{v}").alias(v) for v in values])


def forward_with_fallback(left: DataFrame, right: DataFrame, keys: list[str], labels: list[str], left_date: str, right_date: str, values: list[str]) -> DataFrame:
    """As-of by the first of several keys under which the right side has a series at all; a series
    that merely ends too early is no reason to try the next. right has a column key per series.
    Adds match (the label, or unmatched)."""
    series = right.select("key").distinct()
    out, chosen = left, F.lit(None).cast("string")
    for i, k in enumerate(keys):
        have = series.select(F.col("key").alias(k), F.lit(True).alias(f"_has{i}"))
        out = out.join(have, k, "left")
    for i, k in reversed(list(enumerate(keys))):
        chosen = F.when(F.col(f"_has{i}"), F.col(k)).otherwise(chosen)
    label = F.lit(None).cast("string")
    for i, name in reversed(list(enumerate(labels))):
        label = F.when(F.col(f"_has{i}"), F.lit(name)).otherwise(label)
    out = out.withColumn("key", chosen).withColumn("_label", label).drop(*[f"_has{i}" for i in range(len(keys))])
    out = forward(out, right, "key", left_date, right_date, values)
    return out.withColumn("match", F.when(F.col(right_date).isNotNull(), F.col("_label")).otherwise("unmatched")).drop("_label", "key")


def valid_on(date: Column, start: Column, end: Column) -> Column:
    """Whether a date lies in an interval; open ends are null, both ends count."""
    return (start.isNull() | (start <= date)) & (end.isNull() | (date <= end))


def temporal(left: DataFrame, dim: DataFrame, key: str, date: str, start: str = "valid_from", end: str = "valid_to", how: str = "inner") -> DataFrame:
    """Equi-join on the key with the dimension row that was valid on the date."""
    d = dim.withColumnRenamed(key, "_key")
    on = (F.col(key) == F.col("_key")) & valid_on(F.col(date), F.col(start), F.col(end))
    return left.join(d, on, how).drop("_key")
