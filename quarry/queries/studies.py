"""Queries of back-tests, quality checks, identity, diagnostics and models."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import ranks, stats, text
from quarry.operators import buckets, diagnostics, features, identity, portfolio, qc, series
from quarry.plans.spec import TARGETS
from quarry.queries.base import HISTORY, OBSERVED, PANEL, PRICES, SECTORS, SPLIT, SPLITS, WINDOWS, panel, prices, query, register, rounded, sectors, table
from quarry.queries.research import _CELLS, _Y, _deciled

# --- 2.J portfolio ---------------------------------------------------------------------------

_PRED = "pred AS (SELECT snapshot_date AS date, security_key AS security, price_volatility_20d AS score, forward_return_5d AS target_return FROM panel WHERE price_volatility_20d IS NOT NULL AND forward_return_5d IS NOT NULL), days AS (SELECT date, CAST((r - 1) // 5 AS INT) AS period FROM (SELECT date, row_number() OVER (ORDER BY date) AS r FROM (SELECT DISTINCT date FROM pred)) WHERE (r - 1) % 5 = 0), rows_ AS (SELECT * FROM pred JOIN days USING (date)), held AS (SELECT *, least(1.0 / count(*) OVER (PARTITION BY period), 0.05) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY period ORDER BY score DESC, security) AS r, count(*) OVER (PARTITION BY period) AS n FROM rows_) WHERE r <= greatest(1, ceil(n * 0.2)))"
_TURN = "moved AS (SELECT coalesce(a.period, b.period + 1) AS period, sum(abs(coalesce(a.weight, 0) - coalesce(b.weight, 0))) AS m, coalesce(sum(a.weight), 0) AS i, coalesce(sum(b.weight), 0) AS o FROM held a FULL JOIN held b ON a.period = b.period + 1 AND a.security = b.security GROUP BY 1), turn AS (SELECT period, 0.5 * (m + abs(i - o)) AS turnover FROM moved WHERE period <= (SELECT max(period) FROM held))"
_PF = PANEL + ", " + _PRED
_STRAT = "strat AS (SELECT period, date, benchmark, gross, invested, names, turnover, turnover * 10 / 1e4 AS cost, gross - turnover * 10 / 1e4 AS net FROM (SELECT period, date, avg(target_return) AS benchmark FROM rows_ GROUP BY 1, 2) JOIN (SELECT period, sum(weight * target_return) AS gross, sum(weight) AS invested, count(*) AS names FROM held GROUP BY 1) USING (period) JOIN turn USING (period))"


def _predictions(spark: SparkSession, sf: str) -> DataFrame:
    return portfolio.clean(panel(spark, sf).select(F.col("snapshot_date").alias("date"), F.col("security_key").alias("security"), F.col("price_volatility_20d").alias("score"), F.col("forward_return_5d").alias("target_return")))


def _held(spark: SparkSession, sf: str) -> DataFrame:
    p = _predictions(spark, sf)
    rows = p.join(portfolio.rebalance_dates(p, 5), "date")
    return portfolio.weights(portfolio.select_top(rows, 0.2, ["period"]), ["period"])


@query("pf_selection_weights", "SELECT period, date, security, round(weight, 6) AS weight FROM held", _PF)
def pf_selection_weights(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_held(spark, sf).select("period", "date", "security", "weight"))


@query("pf_turnover", "SELECT period, round(turnover, 6) AS turnover FROM turn", _PF + ", " + _TURN)
def pf_turnover(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(portfolio.turnover(_held(spark, sf)))


@query("pf_strategy", "SELECT period, date, names, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in ("benchmark", "gross", "invested", "turnover", "cost", "net")) + " FROM strat", _PF + ", " + _TURN + ", " + _STRAT)
def pf_strategy(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(portfolio.strategy(_predictions(spark, sf)))


@query("pf_compound_drawdown", "SELECT round(exp(sum(ln(1 + net / 20))) - 1, 6) AS compound, round(least(0, min(d)), 6) + 0.0 AS max_drawdown FROM (SELECT *, w / greatest(1, max(w) OVER (ORDER BY period ROWS UNBOUNDED PRECEDING)) - 1 AS d FROM (SELECT *, exp(sum(ln(1 + net / 20)) OVER (ORDER BY period ROWS UNBOUNDED PRECEDING)) AS w FROM strat))", _PF + ", " + _TURN + ", " + _STRAT)
def pf_compound_drawdown(spark: SparkSession, sf: str) -> DataFrame:
    rows = portfolio.strategy(_predictions(spark, sf)).withColumn("r", F.col("net") / 20).select("period", "r")
    return rounded(portfolio.drawdown(rows, "r"))


@query("pf_cost_sensitivity", "SELECT bps, round(avg(gross - turnover * bps / 1e4), 6) + 0.0 AS mean_net FROM strat, (VALUES (5), (10), (20)) t(bps) GROUP BY 1", _PF + ", " + _TURN + ", " + _STRAT)
def pf_cost_sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    rows = portfolio.strategy(_predictions(spark, sf)).withColumn("bps", F.explode(F.array(F.lit(5), F.lit(10), F.lit(20))))
    return rounded(rows.groupBy("bps").agg(F.avg(F.col("gross") - F.col("turnover") * F.col("bps") / 1e4).alias("mean_net")))


@query("pf_concentration", "SELECT (SELECT count(DISTINCT security) FROM held) AS unique_securities, round(sum(n) FILTER (r <= 1) / (SELECT count(*) FROM held), 6) AS top_1_share, round(sum(n) FILTER (r <= 5) / (SELECT count(*) FROM held), 6) AS top_5_share, round(sum(n) FILTER (r <= 10) / (SELECT count(*) FROM held), 6) AS top_10_share FROM (SELECT security, n, row_number() OVER (ORDER BY n DESC, security) AS r FROM (SELECT security, count(*) AS n FROM held GROUP BY 1))", _PF)
def pf_concentration(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(portfolio.concentration(portfolio.selection_counts(_held(spark, sf))))


@query("pf_exclusions", "SELECT excluded, round(avg(target_return), 6) + 0.0 AS mean FROM (SELECT 'drop_' || k AS excluded, target_return FROM pred, top WHERE security <> k UNION ALL SELECT 'drop_all', target_return FROM pred WHERE security NOT IN (SELECT k FROM top)) GROUP BY 1", _PF + ", top AS (SELECT security AS k FROM held GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10)")
def pf_exclusions(spark: SparkSession, sf: str) -> DataFrame:
    """The universe without each of the ten securities selected most often, and without all of them."""
    p = _predictions(spark, sf)
    top = portfolio.selection_counts(_held(spark, sf)).orderBy(F.col("selections").desc(), "security").limit(10)
    sets = top.select(F.explode(F.array(F.concat(F.lit("drop_"), F.col("security").cast("string")), F.lit("drop_all"))).alias("excluded"), "security")
    return rounded(portfolio.excluding(p, sets).groupBy("excluded").agg(F.avg("target_return").alias("mean")))


@query("pf_random_removal", "SELECT share, seed, count(*) AS n, round(avg(target_return), 6) + 0.0 AS mean FROM pred, (VALUES (0.1), (0.2), (0.3)) s(share), (VALUES (0), (1), (2), (3), (4)) t(seed) WHERE ((security * 7919 + seed * 104729 + 12345) * 31337) % 10007 >= share * 10007 GROUP BY 1, 2", _PF)
def pf_random_removal(spark: SparkSession, sf: str) -> DataFrame:
    """The universe without a tenth to three tenths of its securities, five draws each."""
    return rounded(portfolio.thinned(_predictions(spark, sf)).groupBy("share", "seed").agg(F.count(F.lit(1)).alias("n"), F.avg("target_return").alias("mean")))


def _rebalanced_sql(every: int) -> str:
    """The strategy's tables for another distance between rebalancings, ending in its mean."""
    parts = (_PRED + ", " + _TURN + ", " + _STRAT).replace("// 5", f"// {every}").replace("% 5 = 0", f"% {every} = 0")
    for name in ("days", "rows_", "held", "moved", "turn", "strat"):
        parts = re.sub(rf"\b{name}\b", f"{name}{every}", parts)
    return parts.split(" AS (", 1)[1].split("), ", 1)[1] if every != 3 else parts


@query("pf_rebalance_sensitivity", " UNION ALL ".join(f"SELECT {k} AS every, count(*) AS periods, round(avg(net), 6) + 0.0 AS mean_net, round(avg(turnover), 6) AS mean_turnover FROM strat{k}" for k in (3, 5, 10)), PANEL + ", " + ", ".join(_rebalanced_sql(k) for k in (3, 5, 10)))
def pf_rebalance_sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    p = _predictions(spark, sf)
    rows = [portfolio.strategy(p, every=k).withColumn("every", F.lit(k)) for k in (3, 5, 10)]
    return rounded(reduce(DataFrame.unionByName, rows).groupBy("every").agg(F.count(F.lit(1)).alias("periods"), F.avg("net").alias("mean_net"), F.avg("turnover").alias("mean_turnover")))


_SIDES = "sides AS (SELECT 'volatility' AS experiment, snapshot_date AS date, security_key AS security, price_volatility_20d AS score, forward_return_5d AS target_return FROM panel UNION ALL SELECT 'momentum', snapshot_date, security_key, price_return_20d, forward_return_5d FROM panel), usable AS (SELECT * FROM sides WHERE score IS NOT NULL AND target_return IS NOT NULL), days2 AS (SELECT date, CAST((r - 1) // 5 AS INT) AS period FROM (SELECT date, row_number() OVER (ORDER BY date) AS r FROM (SELECT DISTINCT date FROM usable)) WHERE (r - 1) % 5 = 0), chosen AS (SELECT *, least(1.0 / count(*) OVER (PARTITION BY experiment, period), 0.05) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY experiment, period ORDER BY score DESC, security) AS r, count(*) OVER (PARTITION BY experiment, period) AS n FROM usable JOIN days2 USING (date)) WHERE r <= greatest(1, ceil(n * 0.2)))"


@query("pf_experiments", "SELECT experiment, count(*) AS periods, round(avg(gross), 6) + 0.0 AS mean_gross FROM (SELECT experiment, period, sum(weight * target_return) AS gross FROM chosen GROUP BY 1, 2) GROUP BY 1", PANEL + ", " + _SIDES)
def pf_experiments(spark: SparkSession, sf: str) -> DataFrame:
    """Two experiments side by side in one job."""
    p = panel(spark, sf)
    one = lambda name, c: p.select(F.lit(name).alias("experiment"), F.col("snapshot_date").alias("date"), F.col("security_key").alias("security"), F.col(c).alias("score"), F.col("forward_return_5d").alias("target_return"))
    rows = portfolio.strategy(one("volatility", "price_volatility_20d").unionByName(one("momentum", "price_return_20d")), by=["experiment"])
    return rounded(rows.groupBy("experiment").agg(F.count(F.lit(1)).alias("periods"), F.avg("gross").alias("mean_gross")))


@query("pf_yearly", "SELECT year(date) AS year, count(*) AS periods, round(avg(net), 6) + 0.0 AS mean_net, round(avg(gross - benchmark), 6) + 0.0 AS mean_excess FROM strat GROUP BY 1", _PF + ", " + _TURN + ", " + _STRAT)
def pf_yearly(spark: SparkSession, sf: str) -> DataFrame:
    rows = portfolio.strategy(_predictions(spark, sf)).groupBy(F.year("date").alias("year"))
    return rounded(rows.agg(F.count(F.lit(1)).alias("periods"), F.avg("net").alias("mean_net"), F.avg(F.col("gross") - F.col("benchmark")).alias("mean_excess")))


@query("pf_probability_buckets", "SELECT CASE WHEN score / 3 < 0.5 THEN '<0.5' WHEN score / 3 < 0.55 THEN '0.5-0.55' WHEN score / 3 < 0.6 THEN '0.55-0.6' WHEN score / 3 < 0.7 THEN '0.6-0.7' ELSE '0.7+' END AS bucket, count(*) AS n, round(avg(target_return), 6) + 0.0 AS mean FROM pred GROUP BY 1", _PF)
def pf_probability_buckets(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("score") / 3
    b = F.when(p < 0.5, "<0.5").when(p < 0.55, "0.5-0.55").when(p < 0.6, "0.55-0.6").when(p < 0.7, "0.6-0.7").otherwise("0.7+")
    return rounded(_predictions(spark, sf).groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg("target_return").alias("mean")))


# --- 2.K quality -----------------------------------------------------------------------------


_FIRST = "firsts AS (SELECT symbol, min(date) AS first FROM prices GROUP BY 1)"
_CHECKS = [
    *[(f"'{c}'", "0", "PASS") for c in ("required_columns", "price_leakage", "date_integrity", "match_distances", "mapping_sources", "price_values", "forward_returns", "numeric_values", "threshold_logic", "identity_consistency", "mapping_integrity", "forward_return_alignment")],
    ("'unmatched_rows'", "(SELECT count(*) FROM panel WHERE price_date IS NULL)", "WARN"),
    ("'duplicate_features'", "(SELECT count(*) FROM (SELECT 1 FROM panel GROUP BY security_key, snapshot_date HAVING count(*) > 1))", "FAIL"),
    ("'first_price_problem'", "(SELECT count(*) FROM panel LEFT JOIN firsts ON security_key = symbol WHERE price_date IS NOT NULL AND (first IS NULL OR snapshot_date < first))", "WARN"),
]


@query(
    "qc_panel",
    "SELECT * FROM checks UNION ALL SELECT 'overall', CAST(sum(violations) AS BIGINT), max_by(status, CASE status WHEN 'PASS' THEN 0 WHEN 'WARN' THEN 1 ELSE 2 END) FROM checks",
    PANEL + ", " + _FIRST + ", checks AS (SELECT \"check\", violations, CASE WHEN violations > 0 THEN severity ELSE 'PASS' END AS status FROM (" + " UNION ALL ".join(f"SELECT {n} AS \"check\", CAST({v} AS BIGINT) AS violations, '{s}' AS severity" for n, v, s in _CHECKS) + "))",
)
def qc_panel(spark: SparkSession, sf: str) -> DataFrame:
    return qc.panel_checks(panel(spark, sf), prices(spark, sf), sectors(spark, sf).select("symbol"))


@query("qc_match_distance", "SELECT CAST(price_date - snapshot_date AS INT) AS days, count(*) AS n FROM panel GROUP BY 1", PANEL)
def qc_match_distance(spark: SparkSession, sf: str) -> DataFrame:
    return panel(spark, sf).groupBy(F.datediff("price_date", "snapshot_date").alias("days")).agg(F.count(F.lit(1)).alias("n"))


@query("qc_forward_returns", "SELECT CAST(count(*) FILTER ((a.forward_return_5d IS NULL) <> (b.close IS NULL) OR abs(a.forward_return_5d - (b.close / a.close - 1)) > greatest(1e-9, 1e-9 * abs(a.forward_return_5d))) AS INT) AS mismatches FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM history) a LEFT JOIN (SELECT symbol, close, row_number() OVER (PARTITION BY symbol ORDER BY date) - 5 AS i FROM history) b ON a.symbol = b.symbol AND a.i = b.i", HISTORY)
def qc_forward_returns(spark: SparkSession, sf: str) -> DataFrame:
    p = prices(spark, sf)
    w = Window.partitionBy("symbol").orderBy("date")
    numbered = p.withColumn("i", F.row_number().over(w))
    later = numbered.select("symbol", (F.col("i") - 5).alias("i"), F.col("close").alias("later"))
    again = numbered.join(later, ["symbol", "i"], "left").withColumn("again", F.col("later") / F.col("close") - 1)
    return qc.recomputed(features.forward_returns(p, horizons=(5,)), "forward_return_5d", again, ["symbol", "date"], "again").agg(F.count(F.lit(1)).cast("int").alias("mismatches"))


@query("qc_large_moves", "SELECT symbol, date, round(move, 6) + 0.0 AS move FROM (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS move FROM prices) WHERE abs(move) >= 0.5", PRICES)
def qc_large_moves(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(qc.large_moves(prices(spark, sf), "symbol", "date", "close").select("symbol", "date", "move"))


@query("qc_gaps", "SELECT * FROM (SELECT symbol, lag(date) OVER w AS gap_start, date AS gap_end, CAST(date - lag(date) OVER w AS INT) AS gap_days FROM prices WINDOW w AS (PARTITION BY symbol ORDER BY date)) WHERE gap_days > 7", PRICES)
def qc_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return series.gaps(prices(spark, sf), "symbol", "date")


@query("qc_coverage", "SELECT symbol, min(date) AS first_date, max(date) AS last_date, count(*) FILTER (isodow(date) <= 5) AS weekdays_present, CAST(coalesce(max(g), 0) AS INT) AS largest_gap, count(*) FILTER (g > 7) AS internal_gaps, (SELECT count(*) FROM range(min(date)::TIMESTAMP, max(date)::TIMESTAMP + INTERVAL 1 DAY, INTERVAL 1 DAY) t(d) WHERE isodow(d) <= 5) AS weekdays_expected, CASE WHEN count(*) FILTER (g > 7) > 0 THEN 'internal_gaps' WHEN min(date) > DATE '1995-02-01' THEN 'starts_late' WHEN max(date) < DATE '2001-10-01' THEN 'ends_early' ELSE 'complete' END AS coverage FROM (SELECT *, date - lag(date) OVER (PARTITION BY symbol ORDER BY date) AS g FROM prices) GROUP BY 1", PRICES)
def qc_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return series.coverage(prices(spark, sf), "symbol", "date", "1995-02-01", "2001-10-01")


@query("qc_mapping_coverage", "SELECT coalesce(a.symbol, b.symbol) AS symbol, CASE WHEN a.symbol IS NULL THEN 'mapping_only' WHEN b.symbol IS NULL THEN 'prices_only' ELSE 'both' END AS found_in FROM (SELECT DISTINCT symbol FROM prices) a FULL JOIN (SELECT p_partkey AS symbol FROM part) b ON a.symbol = b.symbol", PRICES)
def qc_mapping_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return qc.mapping_coverage(prices(spark, sf), table(spark, sf, "part").select(F.col("p_partkey").alias("symbol")), "symbol")


@query("qc_price_conflicts", "SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS date, count(*) AS rows, count(DISTINCT l_extendedprice) AS prices FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_extendedprice) > 1")
def qc_price_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("date"), F.col("l_extendedprice").alias("close"), "l_orderkey")
    return qc.clean_prices(rows, ["symbol", "date"], "close", ["l_orderkey"])[1]


@query("qc_evidence", "SELECT o_orderkey, CASE WHEN a IS NULL AND b IS NULL THEN 'unresolved' WHEN a IS NULL THEN CASE WHEN len(b) > 1 THEN 'ambiguous' ELSE 'unique' END WHEN b IS NULL THEN CASE WHEN len(a) > 1 THEN 'ambiguous' ELSE 'unique' END WHEN len(list_intersect(a, b)) = 0 THEN 'conflict' WHEN len(list_intersect(a, b)) > 1 THEN 'ambiguous' ELSE 'unique' END AS status FROM orders LEFT JOIN (SELECT p_size AS k, list(DISTINCT p_brand) AS a FROM part GROUP BY 1) x ON o_custkey % 60 = x.k LEFT JOIN (SELECT p_type || p_partkey AS k, list(DISTINCT p_brand) AS b FROM part GROUP BY 1) y ON CASE WHEN o_custkey % 2 = 0 THEN 'ECONOMY' || (o_custkey % 900) END = y.k")
def qc_evidence(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 60).alias("size"), F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("ECONOMY"), F.col("o_custkey") % 900)).alias("type"))
    index = table(spark, sf, "part").select(F.col("p_size").cast("bigint").alias("size"), F.concat("p_type", "p_partkey").alias("type"), F.col("p_brand").alias("isin"))
    return identity.evidence(rows, index, "o_orderkey", ("size", "type")).select("o_orderkey", "status")


# --- 2.L identity and lifecycle --------------------------------------------------------------


@query("id_contract", "SELECT 'isin' AS code, CAST(p_size AS VARCHAR) AS value, count(DISTINCT p_brand) AS entities FROM part GROUP BY 2 HAVING count(DISTINCT p_brand) > 1 UNION ALL SELECT 'lei', CAST(p_partkey AS VARCHAR), count(DISTINCT p_brand) FROM part GROUP BY 2 HAVING count(DISTINCT p_brand) > 1")
def id_contract(spark: SparkSession, sf: str) -> DataFrame:
    return identity.contract_violations(table(spark, sf, "part").select(F.col("p_size").alias("isin"), F.col("p_partkey").alias("lei"), F.col("p_brand").alias("entity_id")))


@query("id_new_entities", "SELECT p_name || p_size AS issuer, 'ENT-' || lpad(CAST(row_number() OVER (ORDER BY p_name || p_size) + 500 AS VARCHAR), 6, '0') AS entity_id FROM (SELECT DISTINCT p_name, p_size FROM part)")
def id_new_entities(spark: SparkSession, sf: str) -> DataFrame:
    new = table(spark, sf, "part").select(F.concat("p_name", "p_size").alias("issuer")).distinct()
    return identity.next_ids(new, ["issuer"], 500)


@query("id_company_names", "SELECT s_suppkey, 'supplier ' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS name FROM supplier")
def id_company_names(spark: SparkSession, sf: str) -> DataFrame:
    written = F.concat(F.lit("Süpplier  Holdings, "), F.regexp_extract("s_name", r"(\d+)", 1), F.lit(" Aktiebolag (publ) Limited"))
    return table(spark, sf, "supplier").select("s_suppkey", text.company(written).alias("name"))


@query("id_latest_instrument", "SELECT l_suppkey AS security, max_by(l_partkey, struct_pack(d := l_shipdate, o := l_orderkey, n := l_linenumber, p := l_partkey)) AS instrument FROM lineitem GROUP BY 1")
def id_latest_instrument(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("security")).agg(F.max_by("l_partkey", F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")).alias("instrument"))


@query("web_top_changes", "SELECT security_key, snapshot_date, round(short_interest_delta_pp, 6) + 0.0 AS change_pp FROM observed WHERE short_interest_delta_pp IS NOT NULL ORDER BY short_interest_delta_pp DESC, security_key, snapshot_date LIMIT 10", OBSERVED)
def web_top_changes(spark: SparkSession, sf: str) -> DataFrame:
    d = features.observation_features(register(spark, sf)).where("short_interest_delta_pp is not null")
    return rounded(d.orderBy(F.col("short_interest_delta_pp").desc(), "security_key", "snapshot_date").limit(10).select("security_key", "snapshot_date", F.col("short_interest_delta_pp").alias("change_pp")))


@query("web_latest_events", "SELECT security_key, snapshot_date, round(short_interest_delta_pp, 6) + 0.0 AS change_pp FROM observed WHERE short_interest_delta_pp <> 0 ORDER BY snapshot_date DESC, abs(short_interest_delta_pp) DESC, security_key LIMIT 100", OBSERVED)
def web_latest_events(spark: SparkSession, sf: str) -> DataFrame:
    d = features.observation_features(register(spark, sf)).where("short_interest_delta_pp <> 0")
    return rounded(d.orderBy(F.col("snapshot_date").desc(), F.abs("short_interest_delta_pp").desc(), "security_key").limit(100).select("security_key", "snapshot_date", F.col("short_interest_delta_pp").alias("change_pp")))


@query("inventory_gaps", "SELECT snapshot_date, n, CAST(snapshot_date - lag(snapshot_date) OVER (ORDER BY snapshot_date) AS INT) AS gap FROM (SELECT CAST(l_shipdate AS DATE) AS snapshot_date, count(*) AS n FROM lineitem GROUP BY 1)")
def inventory_gaps(spark: SparkSession, sf: str) -> DataFrame:
    days = table(spark, sf, "lineitem").groupBy(F.to_date("l_shipdate").alias("snapshot_date")).agg(F.count(F.lit(1)).alias("n"))
    return days.withColumn("gap", F.datediff("snapshot_date", F.lag("snapshot_date").over(Window.orderBy("snapshot_date"))))


# --- 2.N diagnostics -------------------------------------------------------------------------

_D = PANEL + ", " + _CELLS


@query("diag_standardised", "SELECT count(*) AS cells, CAST(sum(n) AS BIGINT) AS rows, round(sum(n * he / hn) / sum(n), 6) AS high_rate, round(sum(n * le / ln) / sum(n), 6) AS low_rate, round(100 * (sum(n * he / hn) / sum(n) - sum(n * le / ln) / sum(n)), 6) + 0.0 AS difference_pp FROM (SELECT d1, count(*) AS n, count(*) FILTER (d2 >= 8) AS hn, count(*) FILTER (d2 >= 8 AND y > 0) AS he, count(*) FILTER (d2 < 8) AS ln, count(*) FILTER (d2 < 8 AND y > 0) AS le FROM deciled WHERE d1 >= 0 AND y IS NOT NULL GROUP BY 1) WHERE hn >= 10 AND ln >= 10", _D)
def diag_standardised(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(diagnostics.standardised(_deciled(spark, sf).where("d1 >= 0"), ["d1"], F.col("d2") >= 8, F.col("y")))


@query("diag_high_low", "SELECT coalesce(a.d1, b.d1) AS d1, high_n, high_events, low_n, low_events, round(100 * (high_events / nullif(high_n, 0) - low_events / nullif(low_n, 0)), 6) + 0.0 AS difference_pp FROM (SELECT d1, count(y) AS high_n, count(*) FILTER (y > 0) AS high_events FROM deciled WHERE d2 >= 8 GROUP BY 1) a FULL JOIN (SELECT d1, count(y) AS low_n, count(*) FILTER (y > 0) AS low_events FROM deciled WHERE d2 < 8 GROUP BY 1) b ON a.d1 = b.d1", _D)
def diag_high_low(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(diagnostics.high_low(_deciled(spark, sf), ["d1"], F.col("d2") >= 8, "y"))


_HALF = "halved AS (SELECT *, CASE WHEN snapshot_date <= (SELECT min(snapshot_date) + CAST((max(snapshot_date) - min(snapshot_date)) // 2 AS INT) FROM panel) THEN 'first' ELSE 'second' END AS half FROM deciled WHERE d1 >= 0 AND d2 >= 0)"


@query("diag_halves", "SELECT half, count(y) AS n, count(*) FILTER (y > 0) AS events FROM halved GROUP BY 1", _D + ", " + _HALF)
def diag_halves(spark: SparkSession, sf: str) -> DataFrame:
    return diagnostics.halves(_deciled(spark, sf)).where("d1 >= 0 and d2 >= 0").groupBy("half").agg(F.count("y").alias("n"), stats.events(F.col("y")).alias("events"))


@query("diag_replication", "SELECT a.half, a.rank, a.d1, a.d2, a.n, a.events, round(a.effect, 6) + 0.0 AS effect, round(b.effect, 6) + 0.0 AS effect_elsewhere, b.n AS n_elsewhere, sign(a.effect) = sign(b.effect) AS same_sign FROM (SELECT *, CAST(row_number() OVER (PARTITION BY half ORDER BY abs(effect) DESC, d1, d2) AS INT) AS rank FROM per WHERE n >= 20) a LEFT JOIN per b ON a.half <> b.half AND a.d1 = b.d1 AND a.d2 = b.d2 WHERE rank <= 5", _D + ", " + _HALF + ", per AS (SELECT *, events / n - sum(events) OVER (PARTITION BY half, d1) / sum(n) OVER (PARTITION BY half, d1) AS effect FROM (SELECT half, d1, d2, count(y) AS n, count(*) FILTER (y > 0) AS events FROM halved GROUP BY 1, 2, 3))")
def diag_replication(spark: SparkSession, sf: str) -> DataFrame:
    rows = diagnostics.halves(_deciled(spark, sf)).where("d1 >= 0 and d2 >= 0")
    return rounded(diagnostics.replicate(rows, ["d1", "d2"], "y", "d1", least=20))


@query("diag_prior_groups", "SELECT CASE WHEN price_return_20d <= 0 THEN 'le_0' WHEN price_return_20d <= q[1] THEN '0_p50' WHEN price_return_20d <= q[2] THEN 'p50_p80' WHEN price_return_20d IS NOT NULL THEN 'gt_p80' END AS grp, count(*) AS n, round(avg(forward_return_5d), 6) + 0.0 AS mean FROM panel, (SELECT quantile_cont(price_return_20d, [0.5, 0.8]) AS q FROM panel WHERE snapshot_date <= DATE '1998-12-31' AND price_return_20d > 0) GROUP BY 1", PANEL)
def diag_prior_groups(spark: SparkSession, sf: str) -> DataFrame:
    p = panel(spark, sf)
    edges = buckets.learned_edges(p.where("snapshot_date <= date'1998-12-31' and price_return_20d > 0"), "price_return_20d", [0.5, 0.8])
    return rounded(p.groupBy(diagnostics.prior_groups(F.col("price_return_20d"), edges).alias("grp")).agg(F.count(F.lit(1)).alias("n"), F.avg("forward_return_5d").alias("mean")))


@query("diag_interaction", "SELECT sector, count(*) AS n, round(avg(y) FILTER (a AND b) - avg(y) FILTER (a AND NOT b) - avg(y) FILTER (NOT a AND b) + avg(y) FILTER (NOT a AND NOT b), 6) + 0.0 AS interaction FROM (SELECT sector, price_return_20d < 0 AS a, short_interest_delta_pp > 0 AS b, forward_return_5d AS y FROM panel) WHERE a IS NOT NULL AND b IS NOT NULL AND y IS NOT NULL GROUP BY 1", PANEL)
def diag_interaction(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(diagnostics.four_cell_interaction(panel(spark, sf), F.col("price_return_20d") < 0, F.col("short_interest_delta_pp") > 0, F.col("forward_return_5d"), ["sector"]))


@query("diag_lagged_timing", "SELECT k AS lag, count(y) AS n, count(*) FILTER (y > 0) AS events FROM (SELECT k, CASE k WHEN 0 THEN short_interest_delta_pp WHEN 1 THEN l1 ELSE l2 END AS c, y FROM (SELECT *, " + _Y + " AS y, lag(short_interest_delta_pp, 1) OVER w AS l1, lag(short_interest_delta_pp, 2) OVER w AS l2 FROM panel WINDOW w AS (PARTITION BY security_key ORDER BY snapshot_date)), (VALUES (0), (1), (2)) t(k)) WHERE c > 1 GROUP BY 1", PANEL)
def diag_lagged_timing(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("security_key").orderBy("snapshot_date")
    c = F.col("short_interest_delta_pp")
    lags = F.array(*[F.struct(F.lit(k).alias("lag"), (F.lag(c, k).over(w) if k else c).alias("c")) for k in range(3)])
    rows = panel(spark, sf).withColumns({"y": TARGETS["down_5pct_5d"].build(), "_l": lags}).withColumn("_l", F.explode("_l"))
    return rows.where("_l.c > 1").groupBy(F.col("_l.lag").alias("lag")).agg(F.count("y").alias("n"), stats.events(F.col("y")).alias("events"))


@query("diag_persistence", "SELECT high, count(*) AS n, round(avg(d), 6) + 0.0 AS mean_next_change FROM (SELECT short_interest_delta_pp > 1 AS high, lead(short_interest_pct) OVER (PARTITION BY security_key ORDER BY snapshot_date) - short_interest_pct AS d, short_interest_delta_pp AS c FROM observed) WHERE c > 0 AND d IS NOT NULL GROUP BY 1", OBSERVED)
def diag_persistence(spark: SparkSession, sf: str) -> DataFrame:
    d = features.observation_features(register(spark, sf))
    w = Window.partitionBy("security_key").orderBy("snapshot_date")
    rows = d.select((F.col("short_interest_delta_pp") > 1).alias("high"), (F.lead("short_interest_pct").over(w) - F.col("short_interest_pct")).alias("d"), F.col("short_interest_delta_pp").alias("c"))
    return rounded(rows.where("c > 0 and d is not null").groupBy("high").agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean_next_change")))


_GRID_SQL = (
    "SELECT horizon, event_threshold, si_cut, risk_cut, count(*) FILTER (v AND h) AS n, count(*) FILTER (v AND h AND x <= e) AS events, count(*) AS base_n, count(*) FILTER (x <= e) AS base_events FROM (SELECT h.k AS horizon, a.e AS event_threshold, b.s AS si_cut, d.q AS risk_cut, e, x, coalesce(risk >= q, false) AS v, coalesce(c >= s, false) AS h FROM (SELECT 1 AS k, forward_return_1d AS x, price_volatility_20d AS risk, short_interest_delta_pp AS c FROM panel"
    + "".join(f" UNION ALL SELECT {k}, forward_return_{k}d, price_volatility_20d, short_interest_delta_pp FROM panel" for k in (3, 5, 10, 20))
    + ") h, (VALUES (-0.03), (-0.05), (-0.07), (-0.1)) a(e), (VALUES (0.0), (0.5), (1.0), (2.0)) b(s), (VALUES (0.5), (1.0), (1.5), (2.0), (2.5)) d(q) WHERE x IS NOT NULL) GROUP BY ALL"
)


@query("diag_event_grid", _GRID_SQL, PANEL)
def diag_event_grid(spark: SparkSession, sf: str) -> DataFrame:
    rows = panel(spark, sf)
    return diagnostics.event_grid(rows, "price_volatility_20d", "short_interest_delta_pp", {k: f"forward_return_{k}d" for k in (1, 3, 5, 10, 20)}, [-0.03, -0.05, -0.07, -0.1], [0.0, 0.5, 1.0, 2.0], [0.5, 1.0, 1.5, 2.0, 2.5])


@query("diag_overlaps", "SELECT a.name AS \"left\", b.name AS \"right\" FROM (VALUES ('w1', DATE '1998-01-01', DATE '1999-12-31'), ('w2', DATE '1999-01-01', DATE '2000-12-31'), ('w3', DATE '2001-01-01', DATE '2001-12-31')) a(name, s, e), (VALUES ('w1', DATE '1998-01-01', DATE '1999-12-31'), ('w2', DATE '1999-01-01', DATE '2000-12-31'), ('w3', DATE '2001-01-01', DATE '2001-12-31')) b(name, s, e) WHERE a.name < b.name AND a.s <= b.e AND b.s <= a.e")
def diag_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    periods = spark.sql("SELECT * FROM VALUES ('w1', date'1998-01-01', date'1999-12-31'), ('w2', date'1999-01-01', date'2000-12-31'), ('w3', date'2001-01-01', date'2001-12-31') AS t(name, start, end)")
    return diagnostics.overlaps(periods)


# --- 2.I models ------------------------------------------------------------------------------


@query("ml_walk_forward")
def ml_walk_forward(spark: SparkSession, sf: str) -> DataFrame:
    from quarry.plans import models

    rows = panel(spark, sf).withColumn("y", TARGETS["down_5pct_5d"].build()).select("snapshot_date", "y", "price_volatility_20d", "price_return_5d", "short_interest_pct")
    got = models.walk_forward(rows, ["price_volatility_20d", "price_return_5d", "short_interest_pct"], WINDOWS, [m for m in models.MODELS.values() if m.task == "classification"])
    return spark.createDataFrame([(g["window"], g["status"], g.get("model"), g.get("n"), g.get("auc")) for g in got], "window string, status string, model string, n bigint, auc double")


@query("ml_incremental")
def ml_incremental(spark: SparkSession, sf: str) -> DataFrame:
    from quarry.plans import models

    rows = panel(spark, sf).withColumn("y", TARGETS["down_5pct_5d"].build()).select("snapshot_date", "y", "price_volatility_20d", "short_interest_pct")
    got = models.incremental(rows, ["price_volatility_20d"], ["short_interest_pct"], WINDOWS)
    return spark.createDataFrame([(g["window"], g["family"], g["n"], g["auc"], g["delta_auc"], g["delta_log_loss"]) for g in got], "window string, family string, n bigint, auc double, delta_auc double, delta_log_loss double")
