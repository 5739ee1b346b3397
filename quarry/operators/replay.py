"""Replaying a log of position changes into a panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.features import keep_last


#: Dates that are sent to every executor at most.
DAYS = 100_000


def load_log(df: DataFrame, order: list[str]) -> DataFrame:
    """issuer_key (the code, else the name) and one row per holder, issuer_key and date, the last."""
    keyed = df.withColumn("issuer_key", F.coalesce(F.nullif(F.trim("isin"), F.lit("")), F.col("issuer")))
    return keep_last(keyed, ["holder", "issuer_key", "position_date"], [F.col(c) for c in order])


def replay(log: DataFrame, start: str | None = None) -> DataFrame:
    """State on every date on which anything changed: per issuer and code the sum, count, maximum and
    the largest share of the positions above zero.

    A position holds from its date to the holder's next change, so each row is an interval. Its
    number is turned into the dates in it by position in the sorted list of dates, which is small (one
    row a calendar date) and is joined on a block of dates, not by comparing every pair."""
    w = Window.partitionBy("holder", "issuer_key").orderBy("position_date")
    spans = log.withColumn("_until", F.lead("position_date").over(w)).where("position > 0")
    dates = log.where(F.col("position_date") >= F.lit(start).cast("date")) if start else log
    dates = dates.select(F.col("position_date").alias("snapshot_date")).distinct()
    span = 32
    block = lambda c: F.floor(F.unix_date(c) / span).cast("long")
    bounds = dates.agg(F.min("snapshot_date").alias("_from"), F.max("snapshot_date").alias("_to"))
    spans = spans.crossJoin(F.broadcast(bounds))  # one row: the first and last date
    a = F.greatest("position_date", "_from")
    b = F.coalesce(F.date_sub("_until", 1), "_to")
    spans = spans.where(a <= b).withColumn("_block", F.explode(F.sequence(block(a), block(b))))
    days = dates.withColumn("_block", block("snapshot_date"))
    # a row a calendar date: centuries of them are small, and then spans stay where they are
    days = F.broadcast(days) if days.count() <= DAYS else days
    met = spans.join(days, "_block").where((F.col("snapshot_date") >= F.col("position_date")) & (F.col("_until").isNull() | (F.col("snapshot_date") < F.col("_until"))))
    out = met.groupBy("snapshot_date", "issuer", "isin").agg(
        F.round(F.sum("position"), 6).alias("short_interest_pct"), F.count(F.lit(1)).cast("int").alias("active_holders"), F.round(F.max("position"), 6).alias("max_individual_position_pct"), F.round(F.max("position") / F.sum("position") * 100, 6).alias("max_position_share_pct")
    )
    return out


def integrity(panel: DataFrame) -> DataFrame:
    """Counts of what should not be: one row."""
    si, top = F.col("short_interest_pct"), F.col("max_individual_position_pct")
    return panel.agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.min(si), 6).alias("si_min"), F.round(F.max(si), 6).alias("si_max"), F.round(F.median(si), 6).alias("si_median"), F.round(F.avg(si), 6).alias("si_mean"),
        F.count_if(si <= 0).alias("not_positive"), F.count_if(si > 100).alias("above_100"), F.count_if(F.col("active_holders") < 1).alias("no_holder"), F.count_if(top > si + 1e-6).alias("max_above_sum"), F.count_if(F.col("max_position_share_pct") > 100.000001).alias("share_above_100"),
    )


def jumps(panel: DataFrame, keys: list[str], date: str = "snapshot_date") -> DataFrame:
    """How often a series moves by more than 1, 2, 3 and 5 points, by half, or in holders by five."""
    w = Window.partitionBy(*keys).orderBy(date)
    d = F.col("short_interest_pct") - F.lag("short_interest_pct").over(w)
    rows = panel.select(*keys, d.alias("d"), (d / F.lag("short_interest_pct").over(w)).alias("r"), (F.col("active_holders") - F.lag("active_holders").over(w)).alias("h"))
    return rows.agg(*[F.count_if(F.abs("d") >= t).alias(f"jumps_{t}pp") for t in (1, 2, 3, 5)], F.count_if(F.abs("r") >= 0.5).alias("relative_jumps"), F.count_if(F.abs("h") >= 5).alias("holder_jumps"))


def concentration_jumps(panel: DataFrame, keys: list[str], least: float = 20.0, date: str = "snapshot_date") -> DataFrame:
    """Rows whose largest share moves by `least` points or more from the row before."""
    w = Window.partitionBy(*keys).orderBy(date)
    share = F.col("max_position_share_pct")
    return panel.select(*keys, date, (share - F.lag(share).over(w)).alias("change")).where(F.abs("change") >= least)


def market_days(panel: DataFrame, keys: list[str], move: float = 0.5, share: float = 0.2, date: str = "snapshot_date") -> DataFrame:
    """Days on which at least `share` of the securities move by `move` points or more at once."""
    w = Window.partitionBy(*keys).orderBy(date)
    d = F.abs(F.col("short_interest_pct") - F.lag("short_interest_pct").over(w))
    by_day = panel.select(date, d.alias("_d")).groupBy(date).agg(F.count("_d").alias("compared"), F.count_if(F.col("_d") >= move).alias("moved"))
    return by_day.where((F.col("compared") > 0) & (F.col("moved") >= share * F.col("compared"))).withColumn("share", F.col("moved") / F.col("compared"))
