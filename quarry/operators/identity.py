"""Resolving instruments to entities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.asof import valid_on

#: Codes in the order in which they are trusted.
KEYS = ("isin", "lei", "yahoo_symbol", "ticker", "issuer")


def resolve(rows: DataFrame, aliases: DataFrame, row_id: str, date: str, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Add entity_id and identity_resolution: the code that decided, ambiguous_<code> or unresolved.

    Candidates on every code are found by equi-joins; of each row only those on its best code count,
    and they decide if they name one entity. Alias rows count while valid on the row's date."""
    found = []
    for priority, k in enumerate(keys):
        if k in rows.columns and k in aliases.columns:
            side = aliases.where(F.col(k).isNotNull()).select(F.col(k).alias("_k"), "entity_id", "valid_from", "valid_to")
            hit = rows.where(F.col(k).isNotNull()).select(row_id, F.col(date).alias("_d"), F.col(k).alias("_k")).join(side, "_k").where(valid_on(F.col("_d"), F.col("valid_from"), F.col("valid_to")))
            found.append(hit.select(row_id, F.lit(priority).alias("priority"), "entity_id"))
    every = reduce(DataFrame.unionByName, found).groupBy(row_id, "priority").agg(F.count_distinct("entity_id").alias("n"), F.min("entity_id").alias("entity_id"))
    best = every.groupBy(row_id).agg(F.min_by(F.struct("priority", "n", "entity_id"), "priority").alias("b"))
    name = F.element_at(F.array(*[F.lit(k) for k in keys]), F.col("b.priority") + 1)
    label = F.when(F.col("b").isNull(), "unresolved").when(F.col("b.n") > 1, F.concat(F.lit("ambiguous_"), name)).otherwise(name)
    return rows.join(best, row_id, "left").withColumn("entity_id", F.when(F.col("b.n") == 1, F.col("b.entity_id"))).withColumn("identity_resolution", label).drop("b")


def only_if_unique(df: DataFrame, by: str, value: str) -> DataFrame:
    """The value of each key that has exactly one."""
    return df.where(F.col(by).isNotNull() & F.col(value).isNotNull()).groupBy(by).agg(F.count_distinct(value).alias("_n"), F.max(value).alias(value)).where("_n = 1").drop("_n")


def contract_violations(aliases: DataFrame, codes: tuple[str, ...] = ("isin", "lei")) -> DataFrame:
    """Codes that name more than one entity: code, value, entities."""
    parts = [aliases.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("value")).agg(F.count_distinct("entity_id").alias("entities")).where("entities > 1").select(F.lit(c).alias("code"), "value", "entities") for c in codes]
    return reduce(DataFrame.unionByName, parts)


def evidence(rows: DataFrame, index: DataFrame, row_id: str, codes: tuple[str, ...]) -> DataFrame:
    """Intersect what each code's evidence says about a row: unique, ambiguous, conflict, unresolved.

    A code may name any number of instruments: they stay rows, counted per row and instrument."""
    parts = []
    for c in codes:
        said = index.where(F.col(c).isNotNull() & F.col("isin").isNotNull()).select(F.col(c).alias("_k"), "isin").distinct()
        parts.append(rows.select(row_id, F.col(c).alias("_k")).where("_k is not null").join(said, "_k").select(row_id, F.lit(c).alias("_code"), "isin"))
    every = reduce(DataFrame.unionByName, parts)
    shared = every.groupBy(row_id, "isin").agg(F.count_distinct("_code").alias("_c"))
    votes = every.groupBy(row_id).agg(F.count_distinct("_code").alias("_n")).withColumnRenamed(row_id, "_r")
    agreed = shared.join(votes, F.col(row_id) == F.col("_r")).where("_c = _n").groupBy(row_id).agg(F.count(F.lit(1)).alias("_a"), F.min("isin").alias("resolved_isin")).withColumnRenamed(row_id, "_q")
    out = rows.join(votes, F.col(row_id) == F.col("_r"), "left").join(agreed, F.col(row_id) == F.col("_q"), "left")
    status = F.when(F.col("_n").isNull(), "unresolved").when(F.col("_a").isNull(), "conflict").when(F.col("_a") > 1, "ambiguous").otherwise("unique")
    return out.withColumn("status", status).withColumn("resolved_isin", F.when(F.col("_a") == 1, F.col("resolved_isin"))).drop("_n", "_a", "_r", "_q")


def next_ids(df: DataFrame, order: list[str], start: int, name: str = "entity_id") -> DataFrame:
    """Give new rows the identifiers after `start`, in order. For batches of new entities: they are
    few, and ids must not have gaps, so one task numbers them."""
    return df.withColumn(name, F.format_string("ENT-%06d", F.row_number().over(Window.orderBy(*order)) + start))
