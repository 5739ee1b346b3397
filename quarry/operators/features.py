"""Features of observations and of price series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.parse import finite, positive

MOMENTUM, FORWARD, THRESHOLDS, HIGHS = (5, 20, 60), (1, 3, 5, 10, 20, 60), (1, 2, 3, 5), (20, 60)


def keep_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key in an order."""
    w = Window.partitionBy(*keys).orderBy(*[c.desc_nulls_last() for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def union_by_priority(parts: list[tuple[DataFrame, int]], keys: list[str]) -> DataFrame:
    """Rows of several sources; of rows with one key that of the highest priority stays."""
    rows = None
    for df, priority in parts:
        df = df.withColumn("_priority", F.lit(priority))
        rows = df if rows is None else rows.unionByName(df)
    return keep_last(rows, keys, [F.col("_priority")]).drop("_priority")


def observation_features(df: DataFrame, key: str = "security_key", date: str = "snapshot_date") -> DataFrame:
    """Lags, gaps, deltas, relative change, acceleration and threshold flags of a register panel with
    short_interest_pct, active_holders, max_individual_position_pct and max_position_share_pct."""
    w = Window.partitionBy(key).orderBy(date)
    values = ("short_interest_pct", "active_holders", "max_individual_position_pct", "max_position_share_pct")
    df = df.withColumn("previous_snapshot_date", F.lag(date).over(w))
    df = df.withColumns({f"previous_{v}": F.lag(v).over(w) for v in values if v in df.columns})
    names = {"short_interest_pct": "short_interest_delta_pp", "active_holders": "holder_delta", "max_individual_position_pct": "max_position_delta_pp", "max_position_share_pct": "concentration_delta_pp"}
    df = df.withColumns({n: F.col(v) - F.col(f"previous_{v}") for v, n in names.items() if v in df.columns})
    now, before = F.col("short_interest_pct"), F.col("previous_short_interest_pct")
    flags = {}
    for t in THRESHOLDS:
        above = F.coalesce(now >= t, F.lit(False))
        flags |= {
            f"above_{t}_0pct": above,
            f"entered_above_{t}_0pct": F.coalesce(above & (before < t), F.lit(False)),
            f"exited_below_{t}_0pct": F.coalesce((now < t) & (before >= t), F.lit(False)),
        }
    return df.withColumns(
        {
            "fi_observation_gap_days": F.datediff(date, "previous_snapshot_date"),
            "short_interest_relative_change": F.when(before >= 0.5, F.col("short_interest_delta_pp") / before),
            "short_interest_acceleration_pp": F.col("short_interest_delta_pp") - F.lag("short_interest_delta_pp").over(w),
            "new_visible_observation": F.col("previous_snapshot_date").isNull(),
            **flags,
        }
    )


def price_features(df: DataFrame, key: str = "symbol", date: str = "date", close: str = "close") -> DataFrame:
    """Momentum, volatility and distance from highs, by observations; one sort a series serves all."""
    df = df.where(positive(F.col(close)))
    w = Window.partitionBy(key).orderBy(date)
    c = F.col(close)
    df = df.withColumn("_ret", c / F.lag(close).over(w) - 1)
    out = {f"price_return_{n}d": c / F.lag(close, n).over(w) - 1 for n in MOMENTUM}
    out["price_volatility_20d"] = F.stddev_samp("_ret").over(w.rowsBetween(-19, 0))
    sixty = w.rowsBetween(-59, 0)
    out["price_volatility_60d"] = F.when(F.count("_ret").over(sixty) == 60, F.stddev_samp("_ret").over(sixty))
    out |= {f"price_distance_from_{n}d_high": c / F.max(close).over(w.rowsBetween(-n, 0)) - 1 for n in HIGHS}
    return df.withColumns(out).drop("_ret")


def forward_returns(df: DataFrame, key: str = "symbol", date: str = "date", close: str = "close", horizons: tuple[int, ...] = FORWARD) -> DataFrame:
    """close N observations later / close - 1; entry and target must be finite and above zero."""
    w = Window.partitionBy(key).orderBy(date)
    good = F.when(positive(F.col(close)), F.col(close))
    return df.withColumns({f"forward_return_{n}d": F.lead(good, n).over(w) / good - 1 for n in horizons})


def severity(df: DataFrame, key: str = "symbol", date: str = "date", close: str = "close", ahead: int = 5) -> DataFrame:
    """Least and greatest return of the next `ahead` observations and their dates; null unless all
    exist and are finite; ties go to the earliest."""
    w = Window.partitionBy(key).orderBy(date).rowsBetween(1, ahead)
    c = finite(F.col(close))
    whole = F.count(c).over(w) == ahead
    early = F.struct(c.alias("c"), F.col(date).alias("d"))
    late = F.struct(c.alias("c"), (-F.unix_date(date)).alias("d"))
    return df.withColumns(
        {
            f"min_return_{ahead}d": F.when(whole, F.min(c).over(w) / F.col(close) - 1),
            f"max_return_{ahead}d": F.when(whole, F.max(c).over(w) / F.col(close) - 1),
            f"min_return_{ahead}d_date": F.when(whole, F.min_by(date, early).over(w)),
            f"max_return_{ahead}d_date": F.when(whole, F.max_by(date, late).over(w)),
        }
    )


def horizon_returns(df: DataFrame, keys: list[str], date: str, value: str, horizons: tuple[int, ...], prefix: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(date) if keys else Window.orderBy(date)
    return df.withColumns({f"{prefix}_return_{n}d": F.col(value) / F.lag(value, n).over(w) - 1 for n in horizons})


def sector_returns(df: DataFrame, sector: str, date: str, horizons: tuple[int, ...] = MOMENTUM) -> DataFrame:
    """The median constituent's return of each sector and date."""
    return df.where(F.col(sector).isNotNull()).groupBy(sector, date).agg(*[F.median(f"price_return_{n}d").alias(f"sector_return_{n}d") for n in horizons])


def require_unique(df: DataFrame, keys: list[str], what: str) -> DataFrame:
    """df, if no key repeats."""
    if not df.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError(f"{what}: {keys} repeat")
    return df


def one_to_one(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of two tables in neither of which a key repeats."""
    return require_unique(a, keys, "left side").join(require_unique(b, keys, "right side"), keys)


def reattached(rows: DataFrame, keys: list[str], reference: Column, value: str, name: str) -> DataFrame:
    """rows with their value's distance from that of the reference row with the same keys; null without
    one. Two references of one key are an error."""
    base = require_unique(rows.where(reference), keys, "reference rows").select(*keys, F.col(value).alias("_base"))
    return rows.join(base, keys, "left").withColumn(name, F.col(value) - F.col("_base")).drop("_base")


def require_columns(df: DataFrame, names: set[str], what: str) -> DataFrame:
    missing = sorted(names - set(df.columns))
    if missing:
        raise ValueError(f"{what} lacks {missing}")
    return df


def relative_returns(df: DataFrame, market: DataFrame, sectors: DataFrame, date: str, sector: str, horizons: tuple[int, ...] = MOMENTUM) -> DataFrame:
    """Left joins, many to one; own return less the market's and the sector's."""
    out = df.join(require_unique(market, [date], "market"), date, "left").join(require_unique(sectors, [date, sector], "sectors"), [date, sector], "left")
    return out.withColumns({f"price_return_{n}d_relative_{k}": F.col(f"price_return_{n}d") - F.col(f"{k}_return_{n}d") for k in ("market", "sector") for n in horizons})


def leave_one_out(x: str, by: list[str]) -> Column:
    """The mean of the others in the group; null for a single one."""
    w = Window.partitionBy(*by)
    n = F.count(x).over(w)
    return F.when(n > 1, (F.sum(x).over(w) - F.col(x)) / (n - 1))


# --- incremental -----------------------------------------------------------------------------


def new_rows(fresh: DataFrame, have: DataFrame, keys: list[str]) -> DataFrame:
    return fresh.join(have.select(*keys), keys, "left_anti")


def context_rows(have: DataFrame, fresh: DataFrame, key: str, date: str) -> DataFrame:
    """Of each key in fresh, the last earlier row of have."""
    first = fresh.groupBy(key).agg(F.min(date).alias("_first"))
    earlier = have.join(first, key).where(F.col(date) < F.col("_first")).drop("_first")
    return keep_last(earlier, [key], [F.col(date)])


def refresh_incomplete(have: DataFrame, recomputed: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Fill the targets that are still null from a new computation."""
    new = recomputed.select(*keys, *[F.col(v).alias(f"_{v}") for v in values])
    return have.join(new, keys, "left").withColumns({v: F.coalesce(v, f"_{v}") for v in values}).drop(*[f"_{v}" for v in values])
