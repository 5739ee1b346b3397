"""What the tables stand for: prices, market, sectors, a monthly register panel, a position log.

Every mapping exists twice, as DataFrames and as SQL common table expressions of the same names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import stats
from quarry.operators import asof, features
from quarry.plans.spec import Window
from quarry.sources.store import stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, ctes: str = "") -> Callable[[Query], Query]:
    """Register a query and, with it, its SQL."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = f"WITH {ctes}\n{sql}" if ctes else sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def to_4(c: Column) -> Column:
    """Four digits by the same arithmetic in every engine: halves are common among prices."""
    return F.floor(c * 10000 + 0.5).cast("double") / 10000


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a fixed number of digits, -0.0 as 0.0, so that engines agree whatever their order of sums."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


WINDOWS = [Window("window_1", "1997-12-31", "1998-12-31", "1999-12-31"), Window("window_2", "1998-12-31", "1999-12-31", "2000-12-31")]


# --- prices ----------------------------------------------------------------------------------


def prices(spark: SparkSession, sf: str) -> DataFrame:
    """Averages do not depend on the order in which lines come: whoever asks again gets the same prices."""
    l = table(spark, sf, "lineitem")  # noqa: E741
    return l.groupBy(F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("date")).agg(to_4(stats.mean(F.col("l_extendedprice") / F.col("l_quantity"))).alias("close"))


def market(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem")  # noqa: E741
    return l.groupBy(F.to_date("l_shipdate").alias("market_date")).agg(to_4(F.avg(F.col("l_extendedprice") / F.col("l_quantity"))).alias("market_close"))


def sectors(spark: SparkSession, sf: str) -> DataFrame:
    s, n, r = (table(spark, sf, t) for t in ("supplier", "nation", "region"))
    return s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(F.col("s_suppkey").alias("symbol"), F.col("r_name").alias("sector"))


def history(spark: SparkSession, sf: str) -> DataFrame:
    return features.severity(features.forward_returns(features.price_features(prices(spark, sf))))


_W = "(PARTITION BY symbol ORDER BY date)"
PRICES = "prices AS (SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS date, floor(avg(l_extendedprice / l_quantity) * 10000 + 0.5) / 10000 AS close FROM lineitem GROUP BY 1, 2)"
MARKET = "market AS (SELECT CAST(l_shipdate AS DATE) AS market_date, floor(avg(l_extendedprice / l_quantity) * 10000 + 0.5) / 10000 AS market_close FROM lineitem GROUP BY 1)"
SECTORS = "sectors AS (SELECT s_suppkey AS symbol, r_name AS sector FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
HISTORY = (
    PRICES
    + ", returns AS (SELECT *, close / lag(close) OVER "
    + _W
    + " - 1 AS ret FROM prices), history AS (SELECT symbol, date, close, "
    + ", ".join(f"close / lag(close, {n}) OVER {_W} - 1 AS price_return_{n}d" for n in features.MOMENTUM)
    + ", stddev_samp(ret) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS price_volatility_20d"
    + ", CASE WHEN count(ret) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) = 60 THEN stddev_samp(ret) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) END AS price_volatility_60d, "
    + ", ".join(f"close / max(close) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN {n} PRECEDING AND CURRENT ROW) - 1 AS price_distance_from_{n}d_high" for n in features.HIGHS)
    + ", "
    + ", ".join(f"lead(close, {n}) OVER {_W} / close - 1 AS forward_return_{n}d" for n in features.FORWARD)
    + ", CASE WHEN count(close) OVER ahead = 5 THEN min(close) OVER ahead / close - 1 END AS min_return_5d, CASE WHEN count(close) OVER ahead = 5 THEN max(close) OVER ahead / close - 1 END AS max_return_5d"
    + " FROM returns WINDOW ahead AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING))"
)


# --- the register panel ----------------------------------------------------------------------


def register(spark: SparkSession, sf: str) -> DataFrame:
    """Per supplier and month a level, a number of holders and a largest share."""
    l = table(spark, sf, "lineitem")  # noqa: E741
    out = l.groupBy(F.col("l_suppkey").alias("security_key"), F.to_date(F.trunc("l_shipdate", "month")).alias("snapshot_date")).agg(
        F.round(100 * F.avg("l_tax"), 6).alias("short_interest_pct"), F.count_distinct("l_partkey").alias("active_holders"), F.round(100 * F.max("l_tax"), 6).alias("max_individual_position_pct"), F.round(100 * F.max("l_discount"), 6).alias("max_position_share_pct")
    )
    return out


SOURCES = ("lineitem", "supplier", "nation", "region")


def panel(spark: SparkSession, sf: str) -> DataFrame:
    """Register rows with their features, priced as of the first day on or after the month's start, with
    returns relative to the market's and to the sector's. Built once and stored by year."""
    paths = [f"{sf}/{t}.parquet" for t in SOURCES]
    return stored(spark, "panel", paths, lambda: _panel(spark, sf).withColumn("snapshot_year", F.year("snapshot_date")), "snapshot_year").drop("snapshot_year")


def _panel(spark: SparkSession, sf: str) -> DataFrame:
    rows = features.observation_features(register(spark, sf))
    h = history(spark, sf)
    # what no query of the panel asks for is not carried along, and so never computed
    unused = {"symbol", "date", "price_volatility_60d", "min_return_5d_date", "max_return_5d_date"}
    values = [c for c in h.columns if c not in unused]
    rows = asof.forward(rows.withColumn("_s", F.col("security_key")), h.withColumnRenamed("symbol", "_s").withColumnRenamed("date", "price_date"), "_s", "snapshot_date", "price_date", values).drop("_s")
    rows = rows.join(sectors(spark, sf).withColumnRenamed("symbol", "security_key"), "security_key", "left")
    of_sector = features.sector_returns(h.join(sectors(spark, sf), "symbol"), "sector", "date").withColumnRenamed("date", "price_date")
    of_market = features.horizon_returns(market(spark, sf), [], "market_date", "market_close", features.MOMENTUM, "market").drop("market_close").withColumnRenamed("market_date", "price_date")
    rows = features.relative_returns(rows, of_market, of_sector, "price_date", "sector")
    matched = F.col("price_date").isNotNull()
    return rows.withColumns({
        "price_match_available": matched, "days_from_fi_to_price": F.datediff("price_date", "snapshot_date"), "close_on_signal_date": F.col("close"),
        "yahoo_symbol": F.when(matched, F.col("security_key")), "price_mapping_source": F.when(matched, "isin"),
    })


REGISTER = "register AS (SELECT l_suppkey AS security_key, CAST(date_trunc('month', l_shipdate) AS DATE) AS snapshot_date, round(100 * avg(l_tax), 6) AS short_interest_pct, count(DISTINCT l_partkey) AS active_holders, round(100 * max(l_tax), 6) AS max_individual_position_pct, round(100 * max(l_discount), 6) AS max_position_share_pct FROM lineitem GROUP BY 1, 2)"
_R = "(PARTITION BY security_key ORDER BY snapshot_date)"
OBSERVED = (
    REGISTER
    + f", lagged AS (SELECT *, lag(snapshot_date) OVER {_R} AS previous_snapshot_date, lag(short_interest_pct) OVER {_R} AS previous_short_interest_pct, lag(active_holders) OVER {_R} AS previous_active_holders, lag(max_individual_position_pct) OVER {_R} AS previous_max_individual_position_pct, lag(max_position_share_pct) OVER {_R} AS previous_max_position_share_pct FROM register)"
    + ", deltas AS (SELECT *, short_interest_pct - previous_short_interest_pct AS short_interest_delta_pp, active_holders - previous_active_holders AS holder_delta, max_individual_position_pct - previous_max_individual_position_pct AS max_position_delta_pp, max_position_share_pct - previous_max_position_share_pct AS concentration_delta_pp FROM lagged)"
    + f", observed AS (SELECT *, snapshot_date - previous_snapshot_date AS fi_observation_gap_days, CASE WHEN previous_short_interest_pct >= 0.5 THEN short_interest_delta_pp / previous_short_interest_pct END AS short_interest_relative_change, short_interest_delta_pp - lag(short_interest_delta_pp) OVER {_R} AS short_interest_acceleration_pp FROM deltas)"
)
PANEL = HISTORY + ", " + OBSERVED + ", " + SECTORS + ", matched AS (SELECT o.*, h.date AS price_date, h.* EXCLUDE (symbol, date) FROM observed o ASOF LEFT JOIN history h ON o.security_key = h.symbol AND o.snapshot_date <= h.date), panel AS (SELECT m.*, s.sector FROM matched m LEFT JOIN sectors s ON m.security_key = s.symbol)"

_MARKET_RETURNS = "market_returns AS (SELECT market_date, " + ", ".join(f"market_close / lag(market_close, {n}) OVER (ORDER BY market_date) - 1 AS market_return_{n}d" for n in features.MOMENTUM) + " FROM market)"
_SECTOR_RETURNS = "sector_returns AS (SELECT sector, date, " + ", ".join(f"median(price_return_{n}d) AS sector_return_{n}d" for n in features.MOMENTUM) + " FROM history JOIN sectors USING (symbol) GROUP BY 1, 2)"
#: The panel with relative returns.
RELATIVE = (
    PANEL
    + f", {MARKET}, {_MARKET_RETURNS}, {_SECTOR_RETURNS}, relative AS (SELECT p.*, "
    + ", ".join(f"price_return_{n}d - {k}_return_{n}d AS price_return_{n}d_relative_{k}" for k in ("market", "sector") for n in features.MOMENTUM)
    + " FROM panel p LEFT JOIN market_returns m ON p.price_date = m.market_date LEFT JOIN sector_returns s ON p.sector = s.sector AND p.price_date = s.date)"
)


def rank_sql(x: str, by: str = "snapshot_date") -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {by}, {x} IS NULL ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY {by}) END"


#: The panel repeated per window, with the splits' names.
SPLITS = "windows(w, a, b, c) AS (VALUES ('window_1', DATE '1997-12-31', DATE '1998-12-31', DATE '1999-12-31'), ('window_2', DATE '1998-12-31', DATE '1999-12-31', DATE '2000-12-31'))"
SPLIT = "CASE WHEN snapshot_date <= a THEN 'train' WHEN snapshot_date <= b THEN 'validation' WHEN snapshot_date <= c THEN 'test' END"


# --- the position log ------------------------------------------------------------------------


def position_log(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    rows = e.select(F.col("event_type").alias("holder"), F.col("user_id").cast("string").alias("issuer"), F.col("user_id").cast("string").alias("isin"), F.to_date("ts").alias("position_date"), F.when(F.col("value") < 20, 0.0).otherwise(F.round(F.col("value") / 100, 4)).alias("position"), "ts", "event_id")
    from quarry.operators.replay import load_log

    return load_log(rows, ["ts", "event_id"]).drop("ts", "event_id")


LOG = "raw AS (SELECT event_type AS holder, CAST(user_id AS VARCHAR) AS issuer, CAST(user_id AS VARCHAR) AS isin, CAST(ts AS DATE) AS position_date, CASE WHEN value < 20 THEN 0.0 ELSE round(value / 100, 4) END AS position, ts, event_id FROM events), log AS (SELECT * EXCLUDE (ts, event_id, n) FROM (SELECT *, row_number() OVER (PARTITION BY holder, isin, position_date ORDER BY ts DESC, event_id DESC) AS n FROM raw) WHERE n = 1)"
