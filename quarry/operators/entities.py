"""Growing the registry of entities: observations meet known codes, the rest become new entities."""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.identity import next_ids, only_if_unique


class ContractError(ValueError):
    """Codes of one observation belong to different entities."""


def discover(observations: DataFrame, aliases: DataFrame, last_id: int) -> DataFrame:
    """Alias rows to append, so that every observation has an entity.

    observations and aliases have isin, lei, issuer; aliases have entity_id too. An observation takes the
    entity of its isin, else of its lei, else of its issuer where only one entity has that name and the
    observation has no code of its own. Isin and lei of different entities are an error, and nothing is
    returned. Unmatched observations that share a code are one new entity. Rows that the aliases hold
    already are left out, so the same batch twice adds nothing."""
    codes = ["isin", "lei", "issuer"]
    rows = observations.select(*codes).distinct()
    for c in codes:
        known = only_if_unique(aliases, c, "entity_id").select(F.col(c).alias(f"_{c}"), F.col("entity_id").alias(f"by_{c}"))
        rows = rows.join(known, F.col(c) == F.col(f"_{c}"), "left").drop(f"_{c}")
    if not rows.where("by_isin <> by_lei").isEmpty():
        raise ContractError("isin and lei of an observation belong to different entities")
    nameless = F.col("isin").isNull() & F.col("lei").isNull()
    rows = rows.withColumn("entity_id", F.coalesce("by_isin", "by_lei", F.when(nameless, F.col("by_issuer")))).select(*codes, "entity_id")
    # a code seen with an entity in this batch gives it to the others with that code
    for _ in range(2):
        for c in ("isin", "lei"):
            w = Window.partitionBy(c)
            rows = rows.withColumn("entity_id", F.coalesce("entity_id", F.when(F.col(c).isNotNull(), F.min("entity_id").over(w))))
    open_ = rows.where("entity_id is null")
    label = F.coalesce("isin", "lei", "issuer")
    open_ = open_.withColumn("label", label)
    for _ in range(2):
        for c in ("isin", "lei"):
            open_ = open_.withColumn("label", F.when(F.col(c).isNotNull(), F.min("label").over(Window.partitionBy(c))).otherwise(F.col("label")))
    fresh = next_ids(open_.select("label").distinct(), ["label"], last_id)
    new = open_.drop("entity_id").join(fresh, "label").select(*codes, "entity_id")
    out = rows.where("entity_id is not null").unionByName(new)
    return out.join(aliases.select(*[F.col(c).alias(f"_{c}") for c in [*codes, "entity_id"]]), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*codes, "entity_id"]], "left_anti")


def lookup(rows: DataFrame, instruments: DataFrame, row_id: str, value: str, keys: tuple[str, ...] = ("isin", "lei", "issuer")) -> DataFrame:
    """The value of the first key that is known: exact, ambiguous_<key> if its instruments disagree. Several
    instruments with one value between them agree."""
    out, found, label = rows, F.lit(None).cast("string"), F.lit("unresolved")
    for k in keys:
        one = instruments.where(F.col(k).isNotNull()).groupBy(F.col(k).alias(f"_{k}")).agg(F.count_distinct(value).alias(f"n_{k}"), F.min(value).alias(f"v_{k}"))
        out = out.join(one, F.col(k) == F.col(f"_{k}"), "left")
    for k in reversed(keys):
        hit = F.col(f"n_{k}") >= 1
        found = F.when(hit, F.when(F.col(f"n_{k}") == 1, F.col(f"v_{k}").cast("string"))).otherwise(found)
        label = F.when(F.col(f"n_{k}") == 1, F.lit(k)).when(hit, F.lit(f"ambiguous_{k}")).otherwise(label)
    return out.select(row_id, found.alias(value), label.alias("instrument_resolution"))


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of two names that matches in blocks, 0 if either is empty: 2 * matched / total."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a.fillna(""), b.fillna(""), strict=True)], dtype=float)


def best_match(names: DataFrame, candidates: DataFrame, name: str, block: Callable[[Column], Column], least: float = 0.8) -> DataFrame:
    """Of each name the candidate most alike within its block, such as the first letters: blocks keep the
    comparisons few. names: name; candidates: symbol, candidate."""
    left = names.select(name).distinct().withColumn("_b", block(F.col(name)))
    met = left.join(candidates.withColumn("_b", block(F.col("candidate"))), "_b").withColumn("similarity", similarity(F.col(name), F.col("candidate"))).where(F.col("similarity") >= least)
    w = Window.partitionBy(name).orderBy(F.col("similarity").desc(), "symbol")
    return met.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(name, "symbol", "candidate", "similarity")


def cascade(rows: DataFrame, maps: list[tuple[DataFrame, str, str]], value: str) -> DataFrame:
    """The value from the first of several maps (table, key, label) that knows the row's key."""
    out, found, label = rows, F.lit(None).cast("string"), F.lit("unmapped")
    for i, (m, k, _) in enumerate(maps):
        out = out.join(only_if_unique(m, k, value).select(F.col(k).alias(f"_k{i}"), F.col(value).alias(f"_v{i}")), F.col(k) == F.col(f"_k{i}"), "left")
    for i, (_, _, name) in reversed(list(enumerate(maps))):
        found = F.coalesce(F.col(f"_v{i}").cast("string"), found)
        label = F.when(F.col(f"_v{i}").isNotNull(), F.lit(name)).otherwise(label)
    return out.withColumn(value, found).withColumn("mapping_source", label).drop(*[f"_{x}{i}" for i in range(len(maps)) for x in "kv"])
