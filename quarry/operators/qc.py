"""Quality checks: each gives one row check, violations, status; the worst status is the dataset's."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.parse import finite, positive

SEVERITY = {"PASS": 0, "WARN": 1, "FAIL": 2}


def check(df: DataFrame, name: str, violations: Column, severity: str = "FAIL") -> DataFrame:
    """A check by one aggregate."""
    n = F.coalesce(violations, F.lit(0)).cast("bigint")
    return df.agg(n.alias("violations")).select(F.lit(name).alias("check"), "violations", F.when(F.col("violations") > 0, severity).otherwise("PASS").alias("status"))


def worst(checks: list[DataFrame]) -> DataFrame:
    """All checks, and a last row `overall` with the worst status."""
    rows = reduce(DataFrame.unionByName, checks)
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv]), F.col("status"))
    total = rows.agg(F.sum("violations").alias("violations"), F.max_by("status", rank).alias("status")).select(F.lit("overall").alias("check"), "violations", "status")
    return rows.unionByName(total)


def duplicates(df: DataFrame, keys: list[str], name: str = "duplicates") -> DataFrame:
    return check(df.groupBy(*keys).count(), name, F.count_if(F.col("count") > 1))


#: Columns that a panel must have, and numbers in it that must be finite. Fixed values.
REQUIRED = ("snapshot_date", "security_key", "yahoo_symbol", "price_mapping_source", "price_date", "close_on_signal_date", "days_from_fi_to_price", "price_match_available", "short_interest_pct", "active_holders", "max_individual_position_pct", "max_position_share_pct", *(f"forward_return_{n}d" for n in (1, 3, 5, 10, 20, 60)))
NUMBERS = ("short_interest_pct", "active_holders", "max_individual_position_pct", "max_position_share_pct", "short_interest_delta_pp", "short_interest_relative_change", "short_interest_acceleration_pp", "holder_delta", "max_position_delta_pp", "concentration_delta_pp", "fi_observation_gap_days")
LOOKS_AHEAD = ("future_", "next_", "forward_price")


def panel_checks(panel: DataFrame, prices: DataFrame, mapping: DataFrame, symbol: str = "symbol", thresholds: tuple[int, ...] = (1, 2, 3, 5)) -> DataFrame:
    """The fifteen checks of a feature panel and their worst status. prices: symbol, date, close;
    mapping: symbol.

    What rows say of themselves is one aggregate; two checks group by a key, three join with prices or
    the mapping, and two look at the schema alone."""
    spark = panel.sparkSession
    missing = sorted(set(REQUIRED) - set(panel.columns))
    ahead = sorted(c for c in panel.columns if any(p in c.lower() for p in LOOKS_AHEAD) and not c.startswith("forward_return_"))
    told = spark.createDataFrame([("required_columns", len(missing), "FAIL"), ("price_leakage", len(ahead), "FAIL")], "name string, violations bigint, severity string")
    if missing:
        return worst([_statuses(told)])
    matched = F.coalesce("price_match_available", F.lit(False))
    bad = lambda c: F.col(c).isNotNull() & finite(F.col(c).cast("double")).isNull()
    any_of = lambda conditions: reduce(lambda a, b: a | b, conditions)
    now, before = F.col("short_interest_pct"), F.col("previous_short_interest_pct")
    both = now.isNotNull() & before.isNotNull()
    wrong = [
        both & ((F.col(f"above_{t}_0pct") != (now >= t)) | (F.col(f"entered_above_{t}_0pct") != ((now >= t) & (before < t))) | (F.col(f"exited_below_{t}_0pct") != ((now < t) & (before >= t))))
        for t in thresholds
    ]
    returns = [f"forward_return_{n}d" for n in (1, 3, 5, 10, 20, 60)]
    of_rows = {
        "date_integrity": (F.count_if(F.col("snapshot_date").isNull() | matched & (F.col("price_date").isNull() | (F.col("price_date") < F.col("snapshot_date")) | (F.col("days_from_fi_to_price") < 0))), "FAIL"),
        "match_distances": (F.when(F.count_if(matched) == 0, 1).otherwise(0), "WARN"),
        "mapping_sources": (F.count_if(F.coalesce("price_mapping_source", F.lit("unmatched")).isin("isin", "issuer", "entity", "unmatched") == F.lit(False)), "FAIL"),
        "price_values": (F.count_if(matched & (bad("close_on_signal_date") | ~F.coalesce(F.col("close_on_signal_date") > 0, F.lit(False)))), "FAIL"),
        "forward_returns": (F.count_if(any_of([bad(c) | F.coalesce(F.col(c) <= -1, F.lit(False)) for c in returns])), "FAIL"),
        "unmatched_rows": (F.count_if(F.col("price_date").isNull()), "WARN"),
        "numeric_values": (F.count_if(any_of([bad(c) for c in NUMBERS if c in panel.columns])), "FAIL"),
        "threshold_logic": (F.count_if(any_of(wrong)), "FAIL"),
    }
    cells = F.array(*[F.struct(F.lit(k).alias("name"), n.cast("bigint").alias("violations"), F.lit(s).alias("severity")) for k, (n, s) in of_rows.items()])
    own = panel.agg(cells.alias("_c")).select(F.explode("_c").alias("_c")).select("_c.*")
    known = panel.where(F.col("yahoo_symbol").isNotNull())
    count = lambda df, name, severity: df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("name"), "violations", F.lit(severity).alias("severity"))
    first = prices.groupBy(F.col(symbol).alias("yahoo_symbol")).agg(F.min("date").alias("_first"))
    early = known.join(first, "yahoo_symbol", "left").where(F.col("_first").isNull() | (F.col("snapshot_date") < F.col("_first")))
    names = mapping.select(F.col(symbol).alias("yahoo_symbol")).distinct()
    # numbered by the prices, apart from how the panel was made
    w = Window.partitionBy(symbol).orderBy("date")
    numbered = prices.where(positive(F.col("close"))).select(F.col(symbol).alias("yahoo_symbol"), F.col("date").alias("price_date"), "close", F.row_number().over(w).alias("_i"))
    later = numbered.select("yahoo_symbol", (F.col("_i") - 5).alias("_i"), F.col("close").alias("_later"))
    again = numbered.join(later, ["yahoo_symbol", "_i"], "left").select("yahoo_symbol", "price_date", (F.col("_later") / F.col("close") - 1).alias("_again"))
    apart = recomputed(known.where("price_date is not null"), "forward_return_5d", again, ["yahoo_symbol", "price_date"], "_again")
    parts = [
        told, own,
        count(panel.groupBy("security_key", "snapshot_date").count().where("count > 1"), "duplicate_features", "FAIL"),
        count(known.groupBy("security_key").agg(F.count_distinct("yahoo_symbol").alias("_n")).where("_n > 1"), "identity_consistency", "WARN"),
        count(early, "first_price_problem", "WARN"),
        count(known.select("yahoo_symbol").distinct().join(names, "yahoo_symbol", "left_anti"), "mapping_integrity", "FAIL"),
        count(apart, "forward_return_alignment", "FAIL"),
    ]
    return worst([_statuses(reduce(DataFrame.unionByName, parts))])


def _statuses(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("name").alias("check"), F.col("violations").cast("bigint").alias("violations"), F.when(F.col("violations") > 0, F.col("severity")).otherwise("PASS").alias("status"))


def large_moves(df: DataFrame, key: str, date: str, close: str, least: float = 0.5) -> DataFrame:
    """Observations that move by `least` or more from the one before."""
    w = Window.partitionBy(key).orderBy(date)
    return df.withColumn("move", F.col(close) / F.lag(close).over(w) - 1).where(F.abs("move") >= least)


def recomputed(df: DataFrame, have: str, fresh: DataFrame, keys: list[str], again: str, tolerance: float = 1e-9) -> DataFrame:
    """Rows whose stored value differs from an independent one, by 1e-9 in absolute and relative terms,
    or exists on one side only."""
    both = df.select(*keys, F.col(have).alias("stored")).join(fresh.select(*keys, F.col(again).alias("fresh")), keys, "left")
    near = F.abs(F.col("stored") - F.col("fresh")) <= F.greatest(F.lit(tolerance), tolerance * F.greatest(F.abs("stored"), F.abs("fresh")))
    return both.where(~(near | (F.col("stored").isNull() & F.col("fresh").isNull())) | (F.col("stored").isNull() != F.col("fresh").isNull()))


def flag_errors(df: DataFrame, key: str, date: str, value: str, threshold: float) -> Column:
    """How many rows have an above flag that contradicts the value."""
    flag = F.col(f"above_{threshold:g}_0pct")
    return F.count_if(flag != F.coalesce(F.col(value) >= threshold, F.lit(False)))


def mapping_coverage(prices: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """Symbols on both sides or on one: key, where."""
    a, b = prices.select(key).distinct().withColumn("_a", F.lit(1)), mapping.select(key).distinct().withColumn("_b", F.lit(1))
    return a.join(b, key, "full").select(key, F.when(F.col("_a").isNull(), "mapping_only").when(F.col("_b").isNull(), "prices_only").otherwise("both").alias("found_in"))


def clean_prices(df: DataFrame, keys: list[str], close: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """One row a key, the first, and the keys with more than one price. Any such conflict empties the
    output: conflicting archives must be settled, not guessed at."""
    by_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(close).alias("prices"))
    conflicts = by_key.where("prices > 1")
    gate = conflicts.limit(1).agg(F.count(F.lit(1)).alias("_conflicts"))
    w = Window.partitionBy(*keys).orderBy(*order)
    first = df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return first.crossJoin(F.broadcast(gate)).where("_conflicts = 0").drop("_conflicts"), conflicts  # gate: one row


#: Parts of names that no input may carry. Fixed values.
FUTURE = ("forward_", "future_", "min_return_", "max_return_", "target_")


def leaking(columns: list[str], forbidden: tuple[str, ...] = ()) -> list[str]:
    """Columns that know the future."""
    return [c for c in columns if c in forbidden or any(p in c for p in FUTURE)]


def feature_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    """Numeric and boolean columns that may be inputs."""
    kinds = ("double", "float", "int", "bigint", "smallint", "tinyint", "boolean")
    bad = set(leaking(df.columns)) | set(exclude)
    return [c for c, k in df.dtypes if (k in kinds or k.startswith("decimal")) and c not in bad]


def without_all_null(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns with any value, by one aggregate."""
    row = df.agg(*[F.count(F.col(c)).alias(c) for c in columns]).first()
    return [c for c in columns if row[c]]
