"""Rates, intervals and scores as aggregate or row expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z = 1.959963984540054  # the normal quantile at 0.975


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is null or zero."""
    return F.when(b != 0, a.cast("double") / b)


def mean(x: Column) -> Column:
    """The average by an exact sum that is rounded once, so the same in whatever order rows come.

    Numbers are summed in three parts as integers, down to 2^-52; where one is 2^40 or more, or no
    number, it is the plain average."""
    x = x.cast("double")
    fits = F.when(F.abs(x) < 2.0**40, x)
    whole = F.floor(fits)
    rest = (fits - whole) * 2.0**26
    low = F.sum(F.floor((rest - F.floor(rest)) * 2.0**26))
    high = F.sum(F.floor(rest)) + F.shiftright(low, 26)
    total = (F.sum(whole) + F.shiftright(high, 26)).cast("double")
    part = (high.bitwiseAND(F.lit(2**26 - 1)) * F.lit(2**26) + low.bitwiseAND(F.lit(2**26 - 1))) / F.lit(2.0**52)
    return F.when(F.count(fits) == F.count(x), (total + part) / F.count(x)).otherwise(F.avg(x))


def lift(a: Column, b: Column) -> Column:
    """a / b only if b is above zero."""
    return F.when(b > 0, a / b)


def events(y: Column, where: Column | None = None) -> Column:
    hit = (y > 0) if where is None else (y > 0) & where
    return F.count_if(F.coalesce(hit, F.lit(False)))


def rate(y: Column, where: Column | None = None, mode: str = "finite") -> tuple[Column, Column, Column]:
    """Count, events and their quotient. mode `finite` leaves null targets out, `all` counts them."""
    inside = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    n = F.count_if(inside & y.isNotNull()) if mode == "finite" else F.count_if(inside)
    e = events(y, inside)
    return n, e, ratio(e, n)


def wilson(k: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """The Wilson interval of a proportion, within 0 and 1; null without observations."""
    p = k.cast("double") / n
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z / (1 + z * z / n) * F.sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))
    return F.when(n > 0, F.greatest(F.lit(0.0), mid - half)), F.when(n > 0, F.least(F.lit(1.0), mid + half))


def wald(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    p = k.cast("double") / n
    half = z * F.sqrt(p * (1 - p) / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), p - half)), F.when(n > 0, F.least(F.lit(1.0), p + half))


def wald_difference(k1: Column, n1: Column, k0: Column, n0: Column, z: float = 1.96) -> tuple[Column, Column, Column]:
    p1, p0 = k1.cast("double") / n1, k0.cast("double") / n0
    half = z * F.sqrt(p1 * (1 - p1) / n1 + p0 * (1 - p0) / n0)
    ok = (n1 > 0) & (n0 > 0)
    return F.when(ok, p1 - p0), F.when(ok, p1 - p0 - half), F.when(ok, p1 - p0 + half)


def average_rank(x: str, by: list[str]) -> Column:
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, x))
    return F.rank().over(Window.partitionBy(*by).orderBy(x)) + (ties - 1) / 2


def auc(df: DataFrame, label: str, score: str, by: list[str]) -> DataFrame:
    """Area under the ROC curve by group, from counts of labels at each distinct score; null where
    a group has one class. Rows with a null label or score are left out.

    Rows are summed up to distinct scores before anything is ordered."""
    at = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(*by, score).agg(events(F.col(label)).alias("_p"), F.count_if(F.col(label) <= 0).alias("_q"))
    below = F.coalesce(F.sum("_q").over(Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = at.withColumn("_u", F.col("_p") * (below + F.col("_q") / 2))
    out = parts.groupBy(*by).agg(F.sum("_u").alias("_u"), F.sum("_p").alias("positives"), F.sum("_q").alias("negatives"))
    return out.withColumn("auc", ratio(F.col("_u"), F.col("positives") * F.col("negatives"))).drop("_u")


def spearman(df: DataFrame, x: str, y: str, by: list[str], average: bool = True) -> DataFrame:
    """Rank correlation by group: ties share their average rank, or keep the order of the rows'
    other columns if average is False."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    if average:
        ranked = rows.select(*by, average_rank(x, by).alias("_x"), average_rank(y, by).alias("_y"))
    else:
        tie = [c for c in df.columns if c not in (x, y, *by)]
        number = lambda c: F.row_number().over(Window.partitionBy(*by).orderBy(c, *tie)).cast("double")
        ranked = rows.select(*by, number(x).alias("_x"), number(y).alias("_y"))
    return ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.corr("_x", "_y").alias("spearman"))


def log_loss(y: Column, p: Column, clip: float = 1e-8) -> Column:
    q = F.greatest(F.lit(clip), F.least(F.lit(1 - clip), p))
    return F.avg(F.when(y.isNotNull() & p.isNotNull(), -(F.when(y > 0, F.ln(q)).otherwise(F.ln(1 - q)))))


def brier(y: Column, p: Column) -> Column:
    return F.avg((p - y) * (p - y))
