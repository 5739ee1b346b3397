"""Turning points, gaps and calendars of series."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def extrema(df: DataFrame, key: str = "symbol", day: str = "date", value: str = "close", days: int = 180, prominence: float = 0.25) -> DataFrame:
    """Peaks and troughs: above (below) the value before and not below (above) the next, and by
    `prominence` above the minimum (below the maximum) of the days before."""
    w = Window.partitionBy(key).orderBy(day)
    back = Window.partitionBy(key).orderBy(F.unix_date(day)).rangeBetween(-days, 0)
    x, before, after = F.col(value), F.lag(value).over(w), F.lead(value).over(w)
    low, high = F.min(value).over(back), F.max(value).over(back)
    rows = df.withColumns({"_peak": (x > before) & (x >= after) & (x / low - 1 >= prominence), "_trough": (x < before) & (x <= after) & (1 - x / high >= prominence)})
    return rows.withColumn("kind", F.when(F.col("_peak"), "peak").when(F.col("_trough"), "trough")).where("kind is not null").drop("_peak", "_trough")


def spaced(df: DataFrame, keys: list[str], day: str = "date", least: int = 30) -> DataFrame:
    """Greedy choice: a row is taken if it lies `least` days after the last one taken.

    The choice is sequential within a key, so it folds over the key's own sorted days; what is
    collected per key are the days of its turning points, not its rows."""
    days = df.groupBy(*keys).agg(F.sort_array(F.collect_set(F.unix_date(day))).alias("_days"))
    start = F.array().cast("array<int>")
    taken = F.aggregate("_days", start, lambda acc, d: F.when((F.size(acc) == 0) | (d - F.element_at(acc, -1) >= least), F.concat(acc, F.array(d))).otherwise(acc))
    kept = days.select(*keys, F.explode(taken).alias("_day"))
    return df.withColumn("_day", F.unix_date(day)).join(kept, [*keys, "_day"], "left_semi").drop("_day")


def gaps(df: DataFrame, key: str, day: str, least: int = 7) -> DataFrame:
    """Stretches of more than `least` days between neighbouring observations."""
    w = Window.partitionBy(key).orderBy(day)
    return df.select(key, F.lag(day).over(w).alias("gap_start"), F.col(day).alias("gap_end")).withColumn("gap_days", F.datediff("gap_end", "gap_start")).where(F.col("gap_days") > least)


def coverage(df: DataFrame, key: str, day: str, start: str, end: str, least: int = 7) -> DataFrame:
    """Per key first and last day, weekdays expected and present, largest gap, and a label."""
    w = Window.partitionBy(key).orderBy(day)
    rows = df.select(key, F.col(day).alias("_d"), F.datediff(day, F.lag(day).over(w)).alias("_g"))
    out = rows.groupBy(key).agg(F.min("_d").alias("first_date"), F.max("_d").alias("last_date"), F.count_if(F.weekday("_d") < 5).alias("weekdays_present"), F.coalesce(F.max("_g"), F.lit(0)).alias("largest_gap"), F.count_if(F.col("_g") > least).alias("internal_gaps"))
    span = F.datediff("last_date", "first_date") + 1
    first = F.weekday("first_date")
    # whole weeks have five weekdays; of the rest those before Saturday count
    rest = F.pmod(span, F.lit(7))
    extra = sum((F.when((F.pmod(first + i, F.lit(7)) < 5) & (rest > i), 1).otherwise(0) for i in range(6)), F.lit(0))
    out = out.withColumn("weekdays_expected", (F.floor(span / 7) * 5 + extra).cast("long"))
    label = F.when(F.col("internal_gaps") > 0, "internal_gaps").when(F.col("first_date") > F.lit(start).cast("date"), "starts_late").when(F.col("last_date") < F.lit(end).cast("date"), "ends_early").otherwise("complete")
    return out.withColumn("coverage", label)


def easter(year: int) -> date:
    """Easter Sunday in the Gregorian calendar."""
    a, (b, c) = year % 19, divmod(year, 100)
    h = (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30
    k = (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7
    m = (a + 11 * h + 22 * k) // 451
    month, day = divmod(h + k - 7 * m + 114, 31)
    return date(year, month, day + 1)


def swedish_holidays(year: int) -> set[date]:
    """The general holidays of Sweden. Those that always fall on a weekend are among them."""
    saturday = lambda d: d + timedelta((5 - d.weekday()) % 7)
    e = easter(year)
    fixed = [(1, 1), (1, 6), (5, 1), (6, 6), (12, 25), (12, 26)]
    moving = [e + timedelta(n) for n in (-2, -1, 0, 1, 39)] + [saturday(date(year, 6, 20)), saturday(date(year, 10, 31))]
    return {date(year, m, d) for m, d in fixed} | set(moving)


def business_days(spark: SparkSession, start: date, end: date) -> DataFrame:
    """Weekdays from start to end without the holidays; a few hundred literals a year at most."""
    rest = sorted(d for y in range(start.year, end.year + 1) for d in swedish_holidays(y))
    days = spark.sql(f"SELECT explode(sequence(date'{start}', date'{end}')) AS day").where(F.weekday("day") < 5)
    return days.where(~F.col("day").isin(rest)) if rest else days


def missing_days(calendar: DataFrame, have: DataFrame, day: str) -> DataFrame:
    return calendar.join(have.select(F.col(day).alias("day")).distinct(), "day", "left_anti")
