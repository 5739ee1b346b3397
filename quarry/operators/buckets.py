"""Buckets, frozen thresholds and the summaries made over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import ranks, stats
from quarry.functions.parse import finite
from quarry.operators import order


def quantile_tail(df: DataFrame, x: str, q: float, side: str, by: list[str], name: str) -> DataFrame:
    """At or beyond the quantile of the row's cross-section."""
    edge = df.groupBy(*by).agg(F.percentile(x, q if side == "lower" else 1 - q).alias("_q"))
    inside = F.col(x) <= F.col("_q") if side == "lower" else F.col(x) >= F.col("_q")
    return df.join(edge, by).withColumn(name, F.coalesce(inside, F.lit(False))).drop("_q")


def learned_edges(pretest: DataFrame, x: str, quantiles: list[float]) -> list[float]:
    """Quantiles of a column over rows before the test: a few numbers, for literals."""
    return order.quantiles(pretest, x, quantiles)


def frozen_tail(pretest: DataFrame, test: DataFrame, x: str, fraction: float, name: str) -> DataFrame:
    """Rows of the test at or above the quantile 1 - fraction of what came before."""
    edges = learned_edges(pretest, x, [1 - fraction])
    inside = F.col(x) >= edges[0] if edges else F.lit(False)
    return test.withColumn(name, F.coalesce(inside, F.lit(False)))


def trajectory(long: Column, short: Column) -> Column:
    null = long.isNull() | short.isNull()
    return F.when(null, "insufficient_history").when((long < 0) & (short >= 0), "recovery").when((long >= 0) & (short >= 0), "uptrend").when((long < 0) & (short < 0), "downtrend").otherwise("other")


def four_groups(regime: Column, high: Column) -> Column:
    m, h = F.coalesce(regime, F.lit(False)), F.coalesce(high, F.lit(False))
    return F.when(m & h, "A").when(m, "B").when(h, "C").otherwise("D")


def change_bucket(c: Column) -> Column:
    """Half-open buckets of a change in points: a zero change is in the second."""
    return F.when(c < 0, "<0").when(c < 0.25, "0-0.25").when(c < 0.5, "0.25-0.5").when(c < 1, "0.5-1").when(c >= 1, ">1")


def outcome(r: Column, edge: float = 0.05) -> Column:
    return F.when(r.isNull(), "insufficient_forward_data").when(r <= -edge, "down").when(r >= edge, "up").otherwise("middle")


def signed_change(c: Column, by: list[str], tie: list[str]) -> Column:
    """negative, zero, and four bands of the first rank among the positive changes of a date."""
    r, n = ranks.first_rank(F.when(c > 0, c), by, tie)
    p = r / n
    return F.when(c < 0, "negative").when(c == 0, "zero").when(p <= 0.5, "positive_0_50").when(p <= 0.8, "positive_50_80").when(p <= 0.95, "positive_80_95").when(p.isNotNull(), "positive_95_100")


def split_dynamics(rows: DataFrame, keys: list[str], x: str = "short_interest_pct", date: str = "snapshot_date") -> DataFrame:
    """Change and relative change within a split: the first row of each has none."""
    before = F.lag(x).over(Window.partitionBy(*keys).orderBy(date))
    return rows.withColumn("change", F.col(x) - before).withColumn("relative_change", stats.ratio(F.col(x) - before, F.abs(before)))


def surface(rows: DataFrame, a: str, b: str, y: str) -> DataFrame:
    """Rates of cells and their distance from the rate of their row of the surface."""
    cells = rows.groupBy(a, b).agg(F.count(y).alias("n"), stats.events(F.col(y)).alias("events"))
    w = Window.partitionBy(a)
    rate = stats.ratio(F.col("events"), F.col("n"))
    return cells.withColumn("rate", rate).withColumn("effect", rate - stats.ratio(F.sum("events").over(w), F.sum("n").over(w)))


def drift(rows: DataFrame, x: str, before: Column) -> DataFrame:
    """Means before and after, and their distance in standard deviations of the former."""
    v, a, b = F.col(x), before, ~before
    out = rows.agg(F.count_if(a & v.isNotNull()).alias("n_before"), F.count_if(b & v.isNotNull()).alias("n_after"), F.avg(F.when(a, v)).alias("mean_before"), F.avg(F.when(b, v)).alias("mean_after"), F.stddev_samp(F.when(a, v)).alias("_s"))
    return out.withColumn("standardised_delta", stats.ratio(F.col("mean_after") - F.col("mean_before"), F.col("_s"))).drop("_s")


def missing(rows: DataFrame, names: list[str]) -> DataFrame:
    return rows.agg(*[(F.count_if(finite(F.col(c)).isNull()) / F.count(F.lit(1))).alias(c) for c in names])


def classification(rows: DataFrame, y: str, p: str) -> DataFrame:
    hit, true = F.col(p) >= 0.5, F.col(y) > 0
    both = F.count_if(hit & true)
    return rows.agg(F.count(F.lit(1)).alias("n"), stats.log_loss(F.col(y), F.col(p)).alias("log_loss"), stats.brier(F.col(y), F.col(p)).alias("brier"), F.avg((hit == true).cast("double")).alias("accuracy"), stats.ratio(both, F.count_if(hit)).alias("precision"), stats.ratio(both, F.count_if(true)).alias("recall"))


def regression(rows: DataFrame, y: str, p: str) -> DataFrame:
    e = F.col(p) - F.col(y)
    return rows.where(e.isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))


def change_class(c: Column, extreme: Column | float) -> Column:
    """negative, zero, positive_normal, and positive_extreme from a threshold on."""
    return F.when(c < 0, "negative").when(c == 0, "zero").when(c >= extreme, "positive_extreme").when(c > 0, "positive_normal")


#: Bands of changes in points, closed above: label and upper end. Fixed values.
GRADIENT = (("le_0", 0.0), ("0_0.25", 0.25), ("0.25_0.5", 0.5), ("0.5_1", 1.0), ("1_2", 2.0), ("gt_2", None))


def gradient(c: Column) -> Column:
    """The band of a change."""
    out = F.when(c.isNull(), None)
    for label, end in GRADIENT:
        out = out.otherwise(label) if end is None else out.when(c <= end, label)
    return out
