"""Grids of candidates: building, pooling over windows, scoring."""

from __future__ import annotations

from itertools import product
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def grid(spark: SparkSession, values: dict[str, list[Any]]) -> DataFrame:
    """Every combination of parameter values; they are parameters, so the product is made here."""
    return spark.createDataFrame(list(product(*values.values())), list(values))


def pool(rows: DataFrame, by: list[str], least_rows: int = 0) -> DataFrame:
    """Means of metrics over windows with enough rows, their number, and summed counts."""
    ok = rows.where(F.col("n") >= least_rows)
    return ok.groupBy(*by).agg(F.count(F.lit(1)).alias("windows"), F.sum("n").alias("n"), F.avg("lift").alias("mean_lift"), F.avg("return_difference").alias("mean_return_difference"))


def scored(pooled: DataFrame, top: int, key: list[str]) -> DataFrame:
    """(lift - 1) plus what the mean return falls short; the best `top`, ties by key."""
    s = (F.col("mean_lift") - 1) + F.greatest(F.lit(0.0), -F.col("mean_return_difference"))
    return pooled.withColumn("score", s).orderBy(F.col("score").desc_nulls_last(), *key).limit(top)


def stability(rows: DataFrame, by: list[str], metric: str, baseline: float) -> DataFrame:
    """Number, mean, extremes, share above a baseline and agreement in sign of a metric over windows."""
    m = F.col(metric)
    up, down = F.count_if(m > baseline), F.count_if(m < baseline)
    return rows.groupBy(*by).agg(F.count(m).alias("windows"), F.avg(m).alias("mean"), F.min(m).alias("least"), F.max(m).alias("most"), (up / F.count(m)).alias("above_baseline"), (F.greatest(up, down) / F.count(m)).alias("sign_consistency"))


def best_per(rows: DataFrame, by: list[str], order: list[Any]) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")
