"""Queries of scans, parsing, features and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import parse, text
from quarry.operators import asof, features, identity, order, replay, series
from quarry.queries.base import _W, HISTORY, LOG, MARKET, OBSERVED, PANEL, PRICES, REGISTER, SECTORS, history, market, panel, position_log, prices, query, register, rounded, sectors, table, to_4
from quarry.sources.store import stored

_H = ("price_return_5d", "price_return_20d", "price_return_60d")


def _r(*names: str) -> str:
    """SQL: columns rounded under their own names, -0.0 as 0.0."""
    return ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in names)


# --- 2.A scans and sinks ---------------------------------------------------------------------


@query("scan_price_dedupe", "SELECT symbol, date, close FROM (SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS date, floor(l_extendedprice / l_quantity * 10000 + 0.5) / 10000 AS close, row_number() OVER (PARTITION BY l_suppkey, CAST(l_shipdate AS DATE) ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC) AS n FROM lineitem WHERE l_quantity > 0) WHERE n = 1 AND close > 0")
def scan_price_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem").where("l_quantity > 0")  # noqa: E741
    rows = l.select(F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("date"), to_4(F.col("l_extendedprice") / F.col("l_quantity")).alias("close"), "l_orderkey", "l_linenumber", "l_partkey")
    return features.keep_last(rows, ["symbol", "date"], [F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")]).where(parse.positive(F.col("close"))).select("symbol", "date", "close")


@query("scan_union_priority", "SELECT * FROM (SELECT o_custkey AS key, 'open' AS source, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1 UNION ALL SELECT o_custkey, 'all', count(*) FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') GROUP BY 1)")
def scan_union_priority(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    part = lambda df, s: df.groupBy(F.col("o_custkey").alias("key")).agg(F.count(F.lit(1)).alias("n")).select("key", F.lit(s).alias("source"), "n")
    return features.union_by_priority([(part(o.where("o_orderstatus = 'O'"), "open"), 1), (part(o, "all"), 0)], ["key"])


@query("scan_unique_issuer_key", "SELECT p_name || p_size AS issuer, max(p_brand) AS brand FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) = 1")
def scan_unique_issuer_key(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.concat("p_name", "p_size").alias("issuer"), F.col("p_brand").alias("brand"))
    return identity.only_if_unique(p, "issuer", "brand")


@query("scan_market", "SELECT * FROM market WHERE market_close > 0", MARKET)
def scan_market(spark: SparkSession, sf: str) -> DataFrame:
    return market(spark, sf).where(parse.positive(F.col("market_close")))


@query("scan_sector_map", "SELECT symbol, sector FROM sectors", SECTORS)
def scan_sector_map(spark: SparkSession, sf: str) -> DataFrame:
    from quarry.sources.tables import explode_map

    s = sectors(spark, sf)
    nested = s.groupBy((F.col("symbol") % 8).alias("file")).agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct(F.col("symbol").cast("string"), F.struct("sector")))).alias("instruments"))).alias("json"))
    return explode_map(nested, "json", "instruments", "symbol", "sector string").select(F.col("symbol").cast("bigint").alias("symbol"), "sector")


@query("sink_json_safe", f"SELECT symbol, strftime(date, '%Y-%m-%d') AS date, {_r('price_return_5d')} FROM history", HISTORY)
def sink_json_safe(spark: SparkSession, sf: str) -> DataFrame:
    from quarry.sources.sinks import json_safe

    rows = history(spark, sf).select("symbol", "date", F.when(F.col("price_return_5d").isNull(), F.lit(float("nan"))).otherwise(F.col("price_return_5d")).alias("price_return_5d"))
    return rounded(json_safe(rows))


# --- 2.B parsing -----------------------------------------------------------------------------


@query("parse_position", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 0.0 WHEN c_custkey % 4 = 1 THEN c_acctbal WHEN c_custkey % 4 = 2 THEN 0.0 ELSE c_acctbal END AS position FROM customer")
def parse_position(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    k = F.col("c_custkey") % 4
    shown = F.format_string("%.2f", F.col("c_acctbal"))
    written = F.when(k == 0, F.lit("<0,5")).when(k == 1, F.concat(F.regexp_replace(shown, r"\.", ","), F.lit(" %"))).when(k == 2, F.lit("n/a")).otherwise(shown)
    return c.select("c_custkey", parse.position(written).alias("position"))


@query("parse_number", "SELECT o_orderkey, round(o_totalprice, 2) AS value FROM orders")
def parse_number(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    us = F.format_number("o_totalprice", 2)
    eu = F.translate(us, ".,", ",.")
    return o.select("o_orderkey", parse.number(F.when(F.col("o_orderkey") % 2 == 0, us).otherwise(eu)).alias("value"))


@query("parse_date", "SELECT o_orderkey, CASE WHEN CAST(o_orderdate AS DATE) <= DATE '1999-12-31' THEN CAST(o_orderdate AS DATE) END AS day FROM orders")
def parse_date(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey") % 5
    written = F.date_format("o_orderdate", "dd.MM.yyyy")
    for i, f in enumerate(parse.DATE_FORMATS):
        written = F.when(k == i, F.date_format("o_orderdate", f)).otherwise(written)
    return o.select("o_orderkey", parse.date(written, F.lit("1999-12-31").cast("date")).alias("day"))


@query("text_security_key", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'ISIN:' || upper(replace(p_brand, '#', ' ')) ELSE 'ISSUER:' || upper(p_name) END AS key FROM part")
def text_security_key(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    isin = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" "), F.lower("p_brand"))).otherwise(F.lit(" - "))
    return p.select("p_partkey", text.security_key(isin, F.regexp_replace("p_name", " ", " . ")).alias("key"))


# --- 2.B replay ------------------------------------------------------------------------------

_REPLAY = LOG + ", spans AS (SELECT *, lead(position_date) OVER (PARTITION BY holder, isin ORDER BY position_date) AS until FROM log), days AS (SELECT DISTINCT position_date AS snapshot_date FROM log WHERE position_date >= DATE '2024-01-05'), replayed AS (SELECT snapshot_date, issuer, isin, round(sum(position), 6) AS short_interest_pct, CAST(count(*) AS INT) AS active_holders, round(max(position), 6) AS max_individual_position_pct, round(max(position) / sum(position) * 100, 6) AS max_position_share_pct FROM spans JOIN days ON snapshot_date >= position_date AND (until IS NULL OR snapshot_date < until) WHERE position > 0 GROUP BY 1, 2, 3)"


def _replayed(spark: SparkSession, sf: str) -> DataFrame:
    return replay.replay(position_log(spark, sf).withColumn("issuer_key", F.col("isin")), "2024-01-05")


@query("replay_load_log", "SELECT holder, issuer, isin, position_date, position FROM log", LOG)
def replay_load_log(spark: SparkSession, sf: str) -> DataFrame:
    return position_log(spark, sf).select("holder", "issuer", "isin", "position_date", "position")


@query("replay_state", "SELECT * FROM replayed", _REPLAY)
def replay_state(spark: SparkSession, sf: str) -> DataFrame:
    return _replayed(spark, sf)


@query("replay_validation", "SELECT count(*) AS rows, round(min(short_interest_pct), 6) AS si_min, round(max(short_interest_pct), 6) AS si_max, round(median(short_interest_pct), 6) AS si_median, round(avg(short_interest_pct), 6) AS si_mean, count(*) FILTER (short_interest_pct <= 0) AS not_positive, count(*) FILTER (short_interest_pct > 100) AS above_100, count(*) FILTER (active_holders < 1) AS no_holder, count(*) FILTER (max_individual_position_pct > short_interest_pct + 1e-6) AS max_above_sum, count(*) FILTER (max_position_share_pct > 100.000001) AS share_above_100 FROM replayed", _REPLAY)
def replay_validation(spark: SparkSession, sf: str) -> DataFrame:
    return replay.integrity(_replayed(spark, sf))


@query("replay_top20", "SELECT snapshot_date, issuer, short_interest_pct FROM replayed ORDER BY short_interest_pct DESC, snapshot_date, issuer LIMIT 20", _REPLAY)
def replay_top20(spark: SparkSession, sf: str) -> DataFrame:
    return _replayed(spark, sf).select("snapshot_date", "issuer", "short_interest_pct").orderBy(F.col("short_interest_pct").desc(), "snapshot_date", "issuer").limit(20)


@query("replay_qc_jumps", ", ".join(["SELECT count(*) FILTER (abs(d) >= 1) AS jumps_1pp", "count(*) FILTER (abs(d) >= 2) AS jumps_2pp", "count(*) FILTER (abs(d) >= 3) AS jumps_3pp", "count(*) FILTER (abs(d) >= 5) AS jumps_5pp", "count(*) FILTER (abs(r) >= 0.5) AS relative_jumps", "count(*) FILTER (abs(h) >= 5) AS holder_jumps FROM (SELECT short_interest_pct - lag(short_interest_pct) OVER w AS d, (short_interest_pct - lag(short_interest_pct) OVER w) / lag(short_interest_pct) OVER w AS r, active_holders - lag(active_holders) OVER w AS h FROM replayed WINDOW w AS (PARTITION BY issuer, isin ORDER BY snapshot_date))"]), _REPLAY)
def replay_qc_jumps(spark: SparkSession, sf: str) -> DataFrame:
    return replay.jumps(_replayed(spark, sf), ["issuer", "isin"])


_MOVED = ", stepped AS (SELECT *, max_position_share_pct - lag(max_position_share_pct) OVER w AS change, abs(short_interest_pct - lag(short_interest_pct) OVER w) AS d FROM replayed WINDOW w AS (PARTITION BY issuer, isin ORDER BY snapshot_date))"


@query("replay_qc_concentration", "SELECT issuer, isin, snapshot_date, round(change, 6) + 0.0 AS change FROM stepped WHERE abs(change) >= 20", _REPLAY + _MOVED)
def replay_qc_concentration(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(replay.concentration_jumps(_replayed(spark, sf), ["issuer", "isin"]).select("issuer", "isin", "snapshot_date", "change"))


@query("replay_qc_market_days", "SELECT snapshot_date, count(d) AS compared, count(*) FILTER (d >= 0.5) AS moved, round(count(*) FILTER (d >= 0.5) / count(d), 6) AS share FROM stepped GROUP BY 1 HAVING count(d) > 0 AND count(*) FILTER (d >= 0.5) >= 0.2 * count(d)", _REPLAY + _MOVED)
def replay_qc_market_days(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(replay.market_days(_replayed(spark, sf), ["issuer", "isin"]))


@query("join_reattach", "SELECT b.p_size, b.p_type, b.n, b.n - a.n AS difference FROM (SELECT p_size, p_type, count(*) AS n FROM part GROUP BY 1, 2) b LEFT JOIN (SELECT p_size, count(*) AS n FROM part WHERE p_type = 'ECONOMY' GROUP BY 1) a ON a.p_size = b.p_size")
def join_reattach(spark: SparkSession, sf: str) -> DataFrame:
    """Every row of a long result with its distance from its group's reference row."""
    rows = table(spark, sf, "part").groupBy("p_size", "p_type").agg(F.count(F.lit(1)).alias("n"))
    return features.reattached(rows, ["p_size"], F.col("p_type") == "ECONOMY", "n", "difference")


@query("sink_content_names", "SELECT page_id, 'page_2024-01-01_' || substr(sha256(coalesce(html, '')), 1, 12) || '.html' AS name FROM pages")
def sink_content_names(spark: SparkSession, sf: str) -> DataFrame:
    from quarry.sources.sinks import content_name

    return table(spark, sf, "pages").select("page_id", content_name(F.coalesce("html", F.lit("")).cast("binary"), F.lit("2024-01-01"), ".html", "page").alias("name"))


# --- 2.B features ----------------------------------------------------------------------------

_OBS = ("short_interest_delta_pp", "max_position_delta_pp", "concentration_delta_pp", "short_interest_relative_change", "short_interest_acceleration_pp")


@query("feat_observation", f"SELECT security_key, snapshot_date, previous_snapshot_date, CAST(fi_observation_gap_days AS INT) AS gap, holder_delta, {_r(*_OBS)}, previous_snapshot_date IS NULL AS first FROM observed", OBSERVED)
def feat_observation(spark: SparkSession, sf: str) -> DataFrame:
    d = features.observation_features(register(spark, sf))
    return rounded(d.select("security_key", "snapshot_date", "previous_snapshot_date", F.col("fi_observation_gap_days").alias("gap"), "holder_delta", *_OBS, F.col("new_visible_observation").alias("first")))


@query(
    "feat_threshold_flags",
    "SELECT security_key, snapshot_date, " + ", ".join(f"coalesce(short_interest_pct >= {t}, false) AS above_{t}_0pct, coalesce(short_interest_pct >= {t} AND previous_short_interest_pct < {t}, false) AS entered_above_{t}_0pct, coalesce(short_interest_pct < {t} AND previous_short_interest_pct >= {t}, false) AS exited_below_{t}_0pct" for t in features.THRESHOLDS) + " FROM observed",
    OBSERVED,
)
def feat_threshold_flags(spark: SparkSession, sf: str) -> DataFrame:
    d = features.observation_features(register(spark, sf))
    return d.select("security_key", "snapshot_date", *[c for c in d.columns if c.endswith("_0pct")])


_PRICE = (*_H, "price_volatility_20d", "price_volatility_60d", "price_distance_from_20d_high", "price_distance_from_60d_high")


@query("feat_price_history", f"SELECT symbol, date, {_r(*_PRICE)} FROM history", HISTORY)
def feat_price_history(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(features.price_features(prices(spark, sf)).select("symbol", "date", *_PRICE))


_FWD = tuple(f"forward_return_{n}d" for n in features.FORWARD)


@query("feat_forward_returns", f"SELECT symbol, date, {_r(*_FWD)} FROM history", HISTORY)
def feat_forward_returns(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(features.forward_returns(prices(spark, sf)).select("symbol", "date", *_FWD))


@query(
    "feat_severity",
    "SELECT symbol, date, round(min_return_5d, 6) + 0.0 AS min_return_5d, round(max_return_5d, 6) + 0.0 AS max_return_5d, list_filter(near, lambda x: x.c = list_min(list_transform(near, lambda y: y.c)))[1].d AS min_return_5d_date, list_filter(near, lambda x: x.c = list_max(list_transform(near, lambda y: y.c)))[1].d AS max_return_5d_date FROM (SELECT *, CASE WHEN min_return_5d IS NOT NULL THEN list({'c': close, 'd': date}) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) END AS near FROM history)",
    HISTORY,
)
def feat_severity(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(features.severity(prices(spark, sf)).drop("close"))


@query("feat_forward_summary", "SELECT count(forward_return_5d) AS rows, count(*) FILTER (forward_return_5d > 0) AS positive, round(min(forward_return_5d), 6) AS least, round(median(forward_return_5d), 6) AS middle, round(max(forward_return_5d), 6) AS most FROM history", HISTORY)
def feat_forward_summary(spark: SparkSession, sf: str) -> DataFrame:
    """The column is made once and stored; its middle is found in pieces."""
    r = F.col("forward_return_5d")
    rows = stored(spark, "forward_return_5d", [f"{sf}/lineitem.parquet"], lambda: history(spark, sf).select(r))
    middle = order.quantiles(rows, "forward_return_5d", [0.5])
    return rounded(rows.agg(F.count(r).alias("rows"), F.count_if(r > 0).alias("positive"), F.min(r).alias("least"), F.lit(middle[0] if middle else None).cast("double").alias("middle"), F.max(r).alias("most")))


_SECTOR = HISTORY + ", " + SECTORS + ", " + MARKET + ", sector_returns AS (SELECT sector, date, " + ", ".join(f"median(price_return_{n}d) AS sector_return_{n}d" for n in features.MOMENTUM) + " FROM history JOIN sectors USING (symbol) GROUP BY 1, 2), market_returns AS (SELECT market_date AS date, " + ", ".join(f"market_close / lag(market_close, {n}) OVER (ORDER BY market_date) - 1 AS market_return_{n}d" for n in features.MOMENTUM) + " FROM market)"


def _sector_returns(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = features.price_features(prices(spark, sf)).join(sectors(spark, sf), "symbol")
    return rows, features.sector_returns(rows, "sector", "date")


@query("feat_sector_returns", f"SELECT sector, date, {_r(*(f'sector_return_{n}d' for n in features.MOMENTUM))} FROM sector_returns", _SECTOR)
def feat_sector_returns(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_sector_returns(spark, sf)[1])


@query("feat_relative_returns", "SELECT symbol, date, " + ", ".join(f"round(price_return_{n}d - {k}_return_{n}d, 6) + 0.0 AS price_return_{n}d_relative_{k}" for k in ("market", "sector") for n in features.MOMENTUM) + " FROM history JOIN sectors USING (symbol) LEFT JOIN sector_returns USING (sector, date) LEFT JOIN market_returns USING (date)", _SECTOR)
def feat_relative_returns(spark: SparkSession, sf: str) -> DataFrame:
    rows, by_sector = _sector_returns(spark, sf)
    m = features.horizon_returns(market(spark, sf).withColumnRenamed("market_date", "date"), [], "date", "market_close", features.MOMENTUM, "market").drop("market_close")
    out = features.relative_returns(rows, m, by_sector, "date", "sector")
    return rounded(out.select("symbol", "date", *[c for c in out.columns if "_relative_" in c]))


@query("feat_incremental_new_rows", "SELECT security_key, snapshot_date FROM register WHERE snapshot_date >= DATE '2000-01-01'", REGISTER)
def feat_incremental_new_rows(spark: SparkSession, sf: str) -> DataFrame:
    r = register(spark, sf).select("security_key", "snapshot_date")
    return features.new_rows(r, r.where("snapshot_date < date'2000-01-01'"), ["security_key", "snapshot_date"])


@query("feat_incremental_context", "SELECT security_key, max(snapshot_date) AS snapshot_date FROM register WHERE snapshot_date < DATE '2000-01-01' AND security_key IN (SELECT security_key FROM register WHERE snapshot_date >= DATE '2000-01-01') AND security_key IS NOT NULL GROUP BY 1", REGISTER)
def feat_incremental_context(spark: SparkSession, sf: str) -> DataFrame:
    r = register(spark, sf).select("security_key", "snapshot_date")
    return features.context_rows(r.where("snapshot_date < date'2000-01-01'"), r.where("snapshot_date >= date'2000-01-01'"), "security_key", "snapshot_date")


@query("feat_incremental_refresh", f"SELECT symbol, date, {_r('forward_return_20d')} FROM history", HISTORY)
def feat_incremental_refresh(spark: SparkSession, sf: str) -> DataFrame:
    p = prices(spark, sf)
    whole = features.forward_returns(p, horizons=(20,))
    then = features.forward_returns(p.where("date <= date'2000-06-30'"), horizons=(20,))
    have = then.unionByName(features.new_rows(whole, then, ["symbol", "date"]))
    return rounded(features.refresh_incomplete(have, whole, ["symbol", "date"], ["forward_return_20d"]).select("symbol", "date", "forward_return_20d"))


@query("feat_events", "SELECT security_key, snapshot_date AS event_date, short_interest_pct, previous_short_interest_pct, round(short_interest_delta_pp, 6) + 0.0 AS change_pp FROM observed WHERE previous_short_interest_pct IS NOT NULL AND short_interest_delta_pp <> 0", OBSERVED)
def feat_events(spark: SparkSession, sf: str) -> DataFrame:
    d = features.observation_features(register(spark, sf)).where("previous_short_interest_pct is not null and short_interest_delta_pp <> 0")
    return rounded(d.select("security_key", F.col("snapshot_date").alias("event_date"), "short_interest_pct", "previous_short_interest_pct", F.col("short_interest_delta_pp").alias("change_pp")))


@query("feat_abnormal_returns", "SELECT h.symbol, h.date, round(h.forward_return_5d - m.f, 6) + 0.0 AS abnormal_return_5d FROM history h ASOF LEFT JOIN (SELECT market_date, lead(market_close, 5) OVER (ORDER BY market_date) / market_close - 1 AS f FROM market ) m ON h.date <= m.market_date", HISTORY + ", " + MARKET)
def feat_abnormal_returns(spark: SparkSession, sf: str) -> DataFrame:
    m = market(spark, sf).withColumn("index", F.lit(1))
    m = features.forward_returns(m, "index", "market_date", "market_close", (5,)).withColumnRenamed("forward_return_5d", "f").select("index", "market_date", "f")
    rows = features.forward_returns(prices(spark, sf), horizons=(5,)).withColumn("index", F.lit(1))
    # one index for all rows: the series is joined by the day it applies to, not laid end to end
    w = Window.orderBy("market_date")
    days = m.withColumn("_after", F.lag("market_date").over(w)).withColumn("date", F.explode(F.sequence(F.coalesce(F.date_add("_after", 1), F.date_sub("market_date", 366)), "market_date"))).select("date", "f")
    return rounded(rows.join(days, "date", "left").select("symbol", "date", (F.col("forward_return_5d") - F.col("f")).alias("abnormal_return_5d")))


_EXTREMA = PRICES + ", around AS (SELECT *, lag(close) OVER w AS b, lead(close) OVER w AS a, min(close) OVER v AS lo, max(close) OVER v AS hi FROM prices WINDOW w AS (PARTITION BY symbol ORDER BY date), v AS (PARTITION BY symbol ORDER BY date RANGE BETWEEN INTERVAL 180 DAY PRECEDING AND CURRENT ROW)), extrema AS (SELECT symbol, date, close, CASE WHEN close > b AND close >= a AND close / lo - 1 >= 0.25 THEN 'peak' WHEN close < b AND close <= a AND 1 - close / hi >= 0.25 THEN 'trough' END AS kind FROM around)"


@query("feat_extrema", "SELECT symbol, date, close, kind FROM extrema WHERE kind IS NOT NULL", _EXTREMA)
def feat_extrema(spark: SparkSession, sf: str) -> DataFrame:
    return series.extrema(prices(spark, sf))


@query("feat_cycles", "SELECT symbol, kind, date FROM chosen ORDER BY 1, 2, 3", "RECURSIVE " + _EXTREMA + ", numbered AS (SELECT symbol, kind, date FROM extrema WHERE kind IS NOT NULL), chosen(symbol, kind, date) AS (SELECT symbol, kind, min(date) FROM numbered GROUP BY 1, 2 UNION ALL SELECT * FROM (SELECT c.symbol, c.kind, (SELECT min(n.date) FROM numbered n WHERE n.symbol = c.symbol AND n.kind = c.kind AND n.date >= c.date + 30) AS date FROM chosen c) WHERE date IS NOT NULL)")
def feat_cycles(spark: SparkSession, sf: str) -> DataFrame:
    return series.spaced(series.extrema(prices(spark, sf)), ["symbol", "kind"]).select("symbol", "kind", "date")


# --- 2.C joins -------------------------------------------------------------------------------


@query("join_asof_forward", "SELECT security_key, snapshot_date, price_date, close, CAST(price_date - snapshot_date AS INT) AS days FROM matched", PANEL)
def join_asof_forward(spark: SparkSession, sf: str) -> DataFrame:
    r = register(spark, sf).select("security_key", "snapshot_date").withColumn("symbol", F.col("security_key"))
    out = asof.forward(r, prices(spark, sf).withColumnRenamed("date", "price_date"), "symbol", "snapshot_date", "price_date", ["close"])
    return out.select("security_key", "snapshot_date", "price_date", "close", F.datediff("price_date", "snapshot_date").alias("days"))


@query(
    "join_asof_fallback",
    "SELECT r.security_key, r.snapshot_date, p.date AS price_date, CASE WHEN p.date IS NULL THEN 'unmatched' WHEN r.k >= 0 THEN 'exact' ELSE 'market' END AS match FROM (SELECT g.security_key, snapshot_date, CASE WHEN s.symbol IS NULL THEN -1 ELSE g.security_key END AS k FROM register g LEFT JOIN (SELECT DISTINCT symbol FROM listed) s ON g.security_key = s.symbol) r ASOF LEFT JOIN (SELECT symbol, date FROM listed UNION ALL SELECT -1, market_date FROM market) p ON r.k = p.symbol AND r.snapshot_date <= p.date",
    REGISTER + ", " + PRICES + ", " + MARKET + ", listed AS (SELECT p.* FROM prices p JOIN supplier ON symbol = s_suppkey WHERE s_acctbal >= 5000)",
)
def join_asof_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers with a low balance have no series of their own and are priced by the market's."""
    r = register(spark, sf).select("security_key", "snapshot_date").withColumns({"exact": F.col("security_key"), "other": F.lit(-1).cast("bigint")})
    listed = prices(spark, sf).join(table(spark, sf, "supplier").where("s_acctbal >= 5000"), F.col("symbol") == F.col("s_suppkey"), "left_semi")
    p = listed.select(F.col("symbol").alias("key"), F.col("date").alias("price_date"), "close").unionByName(market(spark, sf).select(F.lit(-1).cast("bigint").alias("key"), F.col("market_date").alias("price_date"), F.col("market_close").alias("close")))
    out = asof.forward_with_fallback(r, p, ["exact", "other"], ["exact", "market"], "snapshot_date", "price_date", ["close"])
    return out.select("security_key", "snapshot_date", "price_date", "match")


_ALIAS = "aliases AS (SELECT s_suppkey AS code, 'ENT-' || lpad(CAST(s_suppkey // 2 AS VARCHAR), 6, '0') AS entity_id, CASE WHEN s_suppkey % 2 = 1 THEN DATE '1998-01-01' END AS valid_from, CASE WHEN s_suppkey % 2 = 0 THEN DATE '1999-12-31' END AS valid_to FROM supplier)"


def _aliases(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        k.alias("code"), F.format_string("ENT-%06d", F.floor(k / 2)).alias("entity_id"), F.when(k % 2 == 1, F.lit("1998-01-01").cast("date")).alias("valid_from"), F.when(k % 2 == 0, F.lit("1999-12-31").cast("date")).alias("valid_to")
    )


@query("join_temporal", "SELECT security_key, snapshot_date, entity_id FROM register JOIN aliases ON security_key = code AND (valid_from IS NULL OR valid_from <= snapshot_date) AND (valid_to IS NULL OR snapshot_date <= valid_to)", REGISTER + ", " + _ALIAS)
def join_temporal(spark: SparkSession, sf: str) -> DataFrame:
    r = register(spark, sf).select(F.col("security_key").alias("code"), "snapshot_date")
    return asof.temporal(r, _aliases(spark, sf), "code", "snapshot_date").select(F.col("code").alias("security_key"), "snapshot_date", "entity_id")


@query(
    "join_identity_resolve",
    "SELECT o_orderkey, CASE WHEN isin_n = 1 THEN isin_e WHEN isin_n IS NULL AND issuer_n = 1 THEN issuer_e END AS entity_id, CASE WHEN isin_n = 1 THEN 'isin' WHEN isin_n > 1 THEN 'ambiguous_isin' WHEN issuer_n = 1 THEN 'issuer' WHEN issuer_n > 1 THEN 'ambiguous_issuer' ELSE 'unresolved' END AS identity_resolution FROM orders LEFT JOIN (SELECT p_partkey % 500 AS isin, count(DISTINCT p_brand) AS isin_n, min(p_brand) AS isin_e FROM part GROUP BY 1) i ON o_custkey = isin LEFT JOIN (SELECT p_type || (p_partkey // 3) AS issuer, count(DISTINCT p_brand) AS issuer_n, min(p_brand) AS issuer_e FROM part GROUP BY 1) s ON 'ECONOMY' || (o_custkey % 400) = issuer",
)
def join_identity_resolve(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("isin"), F.concat(F.lit("ECONOMY"), F.col("o_custkey") % 400).alias("issuer"), F.to_date("o_orderdate").alias("d"))
    none = F.lit(None).cast("date")
    a = table(spark, sf, "part").select((F.col("p_partkey") % 500).alias("isin"), F.concat("p_type", F.floor(F.col("p_partkey") / 3)).alias("issuer"), F.col("p_brand").alias("entity_id"), none.alias("valid_from"), none.alias("valid_to"))
    return identity.resolve(rows, a, "o_orderkey", "d").select("o_orderkey", "entity_id", "identity_resolution")


@query("join_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)")
def join_anti(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey").join(table(spark, sf, "orders").where("o_totalprice > 250000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("join_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def join_semi(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey").join(table(spark, sf, "orders").where("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi")


@query("join_one_to_one", "SELECT a.symbol, a.date, round(a.r - b.r, 6) + 0.0 AS spread FROM a JOIN b ON a.symbol = b.symbol AND a.date = b.date", PRICES + f", a AS MATERIALIZED (SELECT * FROM (SELECT symbol, date, close / lag(close, 5) OVER {_W} - 1 AS r FROM prices) WHERE r IS NOT NULL), b AS MATERIALIZED (SELECT * FROM (SELECT symbol, date, close / lag(close, 20) OVER {_W} - 1 AS r FROM prices) WHERE r IS NOT NULL)")
def join_one_to_one(spark: SparkSession, sf: str) -> DataFrame:
    h = features.price_features(prices(spark, sf))
    a, b = h.select("symbol", "date", "price_return_5d").dropna(), h.select("symbol", "date", "price_return_20d").dropna()
    return rounded(features.one_to_one(a, b, ["symbol", "date"]).select("symbol", "date", (F.col("price_return_5d") - F.col("price_return_20d")).alias("spread")))


@query("join_full_outer", "SELECT coalesce(a.nation, b.nation) AS nation, a.customers, b.suppliers FROM (SELECT c_nationkey AS nation, count(*) AS customers FROM customer WHERE c_acctbal > 9000 GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS nation, count(*) AS suppliers FROM supplier WHERE s_acctbal > 0 GROUP BY 1) b ON a.nation = b.nation")
def join_full_outer(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("customers"))
    b = table(spark, sf, "supplier").where("s_acctbal > 0").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("suppliers"))
    return a.join(b, "nation", "full")


@query("join_leave_one_out", "SELECT symbol, date, round(CASE WHEN n > 1 THEN (s - price_return_5d) / (n - 1) END, 6) + 0.0 AS peers FROM (SELECT *, count(price_return_5d) OVER (PARTITION BY sector, date) AS n, sum(price_return_5d) OVER (PARTITION BY sector, date) AS s FROM history JOIN sectors USING (symbol))", HISTORY + ", " + SECTORS)
def join_leave_one_out(spark: SparkSession, sf: str) -> DataFrame:
    rows = features.price_features(prices(spark, sf)).join(sectors(spark, sf), "symbol")
    return rounded(rows.select("symbol", "date", features.leave_one_out("price_return_5d", ["sector", "date"]).alias("peers")))


@query("join_events_enriched", "SELECT e.security_key, e.snapshot_date, round(e.short_interest_delta_pp, 6) + 0.0 AS change_pp, round(p.forward_return_5d, 6) + 0.0 AS forward_return_5d FROM observed e LEFT JOIN panel p USING (security_key, snapshot_date) WHERE e.short_interest_delta_pp <> 0", PANEL)
def join_events_enriched(spark: SparkSession, sf: str) -> DataFrame:
    e = features.observation_features(register(spark, sf)).where("short_interest_delta_pp <> 0").select("security_key", "snapshot_date", F.col("short_interest_delta_pp").alias("change_pp"))
    return rounded(e.join(panel(spark, sf).select("security_key", "snapshot_date", "forward_return_5d"), ["security_key", "snapshot_date"], "left"))


@query("join_parameter_grid", "SELECT s.v AS signal, b.v AS bin, t.v AS target FROM (VALUES ('a'), ('b'), ('c')) s(v), (VALUES (0.05), (0.1), (0.2)) b(v), (VALUES ('x'), ('y')) t(v)")
def join_parameter_grid(spark: SparkSession, sf: str) -> DataFrame:
    from quarry.plans.discovery import grid

    return grid(spark, {"signal": ["a", "b", "c"], "bin": [0.05, 0.1, 0.2], "target": ["x", "y"]})
