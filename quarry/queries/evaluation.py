"""Queries of evaluation operators and registries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import ranks, text
from quarry.operators import entities, evaluation
from quarry.plans import research
from quarry.plans.spec import TARGETS
from quarry.queries.base import PANEL, SPLIT, SPLITS, WINDOWS, panel, query, rank_sql, rounded, table
from quarry.queries.research import _first_sql, _Y

_V = "price_volatility_20d"


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    p = panel(spark, sf).withColumns({"y": TARGETS["down_5pct_5d"].build(), "sel": ranks.tail(ranks.pct_rank(F.col(_V), ["snapshot_date"]), 0.2, "upper")})
    return research.in_windows(p, WINDOWS, ("validation", "test"))


_EX = f"ex AS (SELECT w AS \"window\", {SPLIT} AS split, * FROM (SELECT *, {_Y} AS y, coalesce({rank_sql(_V)} >= 0.8, false) AS sel FROM panel), windows), exr AS (SELECT * FROM ex WHERE split IN ('validation', 'test'))"


@query(
    "ev_experiments",
    f"SELECT m.\"window\", m.split, n, events, round(events / n, 6) AS rate, base_n, base_events, round(base_events / base_n, 6) AS base_rate, round((events / n) / (base_events / base_n), 6) AS lift, round(mean_return, 6) + 0.0 AS mean_return, round(median_return, 6) + 0.0 AS median_return, round(base_mean_return, 6) + 0.0 AS base_mean_return, round(mean_return - base_mean_return, 6) + 0.0 AS return_difference, round(auc, 6) AS auc FROM (SELECT \"window\", split, count(y) FILTER (sel) AS n, count(*) FILTER (sel AND y > 0) AS events, count(y) AS base_n, count(*) FILTER (y > 0) AS base_events, avg(forward_return_5d) FILTER (sel) AS mean_return, median(forward_return_5d) FILTER (sel) AS median_return, avg(forward_return_5d) AS base_mean_return FROM exr GROUP BY 1, 2) m JOIN (SELECT \"window\", split, (sum(r) FILTER (y > 0) - count(*) FILTER (y > 0) * (count(*) FILTER (y > 0) + 1) / 2.0) / (count(*) FILTER (y > 0) * count(*) FILTER (y <= 0)) AS auc FROM (SELECT \"window\", split, y, rank() OVER (PARTITION BY \"window\", split ORDER BY {_V}) + (count(*) OVER (PARTITION BY \"window\", split, {_V}) - 1) / 2.0 AS r FROM exr WHERE y IS NOT NULL AND {_V} IS NOT NULL) GROUP BY 1, 2) a ON a.\"window\" = m.\"window\" AND a.split = m.split",
    PANEL + ", " + SPLITS + ", " + _EX,
)
def ev_experiments(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(evaluation.experiments(_rows(spark, sf), ["window", "split"], "sel", _V, "y", "forward_return_5d"))


@query("ev_calibration", f"SELECT sector, bin, count(*) AS n, round(avg({_V}), 6) AS mean_score, round(avg(CAST(y > 0 AS DOUBLE)), 6) AS rate FROM (SELECT *, CAST(greatest(0, ceil((r - 1) * 10.0 / greatest(n - 1, 1) - 1e-12) - 1) AS INT) AS bin FROM (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY {_V}, security_key, snapshot_date) AS r, count(*) OVER (PARTITION BY sector) AS n FROM (SELECT *, {_Y} AS y FROM panel) WHERE {_V} IS NOT NULL AND y IS NOT NULL)) GROUP BY 1, 2", PANEL)
def ev_calibration(spark: SparkSession, sf: str) -> DataFrame:
    rows = panel(spark, sf).withColumn("y", TARGETS["down_5pct_5d"].build()).where(F.col("y").isNotNull() & F.col(_V).isNotNull())
    return rounded(evaluation.calibration(rows, ["sector"], _V, "y", ["security_key", "snapshot_date"]))


@query("ev_selection_summary", "SELECT sector, count(forward_return_5d) AS n, " + ", ".join(f"round({e}, 6) + 0.0 AS {n}" for n, e in (("least", "min(forward_return_5d)"), ("most", "max(forward_return_5d)"), ("mean", "avg(forward_return_5d)"), ("median", "median(forward_return_5d)"), *((f"p{q}", f"quantile_cont(forward_return_5d, {q / 100})") for q in (10, 25, 75, 90)))) + " FROM panel GROUP BY 1", PANEL)
def ev_selection_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(evaluation.selection_summary(panel(spark, sf), ["sector"], "forward_return_5d"))


_GATE_ROWS = f"g AS (SELECT sector, y, s, x, rank() OVER (PARTITION BY s, sector ORDER BY x) + (count(*) OVER (PARTITION BY s, sector, x) - 1) / 2.0 AS r FROM (SELECT sector, {_Y} AS y, s, CASE s WHEN 1 THEN {_V} ELSE short_interest_pct END AS x FROM panel, (VALUES (1), (2)) t(s) WHERE snapshot_date <= DATE '1998-12-31') WHERE y IS NOT NULL AND x IS NOT NULL), gated AS (SELECT sector, s, (sum(r) FILTER (y > 0) - count(*) FILTER (y > 0) * (count(*) FILTER (y > 0) + 1) / 2.0) / nullif(count(*) FILTER (y > 0) * count(*) FILTER (y <= 0), 0) AS auc FROM g GROUP BY 1, 2)"


@query("ev_regime_gate", f"SELECT a.sector, round(a.auc, 6) AS auc_{_V}, round(b.auc, 6) AS auc_short_interest_pct, CASE WHEN b.auc > a.auc THEN 'short_interest_pct' ELSE '{_V}' END AS chosen FROM gated a JOIN gated b ON a.sector = b.sector AND a.s = 1 AND b.s = 2", PANEL + ", " + _GATE_ROWS)
def ev_regime_gate(spark: SparkSession, sf: str) -> DataFrame:
    rows = panel(spark, sf).withColumn("y", TARGETS["down_5pct_5d"].build()).where("snapshot_date <= date'1998-12-31'")
    return rounded(evaluation.gate(rows, "sector", "y", _V, "short_interest_pct"))


@query("ev_companies", f"SELECT security_key, n, round(acc, 6) AS accuracy, round(auc, 6) AS auc FROM (SELECT security_key, count(*) AS n, avg(CAST(({_V} >= 0.5) = (y > 0) AS DOUBLE)) AS acc, (sum(r) FILTER (y > 0) - count(*) FILTER (y > 0) * (count(*) FILTER (y > 0) + 1) / 2.0) / nullif(count(*) FILTER (y > 0) * count(*) FILTER (y <= 0), 0) AS auc FROM (SELECT *, rank() OVER (PARTITION BY security_key ORDER BY {_V}) + (count(*) OVER (PARTITION BY security_key, {_V}) - 1) / 2.0 AS r FROM (SELECT *, {_Y} AS y FROM panel) WHERE y IS NOT NULL AND {_V} IS NOT NULL) GROUP BY 1 HAVING count(*) >= 25) ORDER BY n DESC, security_key LIMIT 25", PANEL)
def ev_companies(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(evaluation.companies(panel(spark, sf).withColumn("y", TARGETS["down_5pct_5d"].build()), "security_key", "y", _V))


@query("ev_score_tails", f"SELECT CASE WHEN {_V} <= q[1] THEN 'low' WHEN {_V} >= q[2] THEN 'high' ELSE 'middle' END AS tail, count(y) AS n, count(*) FILTER (y > 0) AS events, round(count(*) FILTER (y > 0) / count(y), 6) AS rate FROM (SELECT *, {_Y} AS y FROM panel WHERE snapshot_date > DATE '1998-12-31' AND {_V} IS NOT NULL), (SELECT quantile_cont({_V}, [0.2, 0.8]) AS q FROM panel WHERE snapshot_date <= DATE '1998-12-31') GROUP BY 1", PANEL)
def ev_score_tails(spark: SparkSession, sf: str) -> DataFrame:
    p = panel(spark, sf).withColumn("y", TARGETS["down_5pct_5d"].build())
    return rounded(evaluation.score_tails(p.where("snapshot_date <= date'1998-12-31'"), p.where("snapshot_date > date'1998-12-31'"), _V, "y"))


@query("ev_quartile_labels", f"SELECT security_key, snapshot_date, CASE WHEN {_V} IS NULL THEN NULL WHEN n < 4 THEN 'insufficient_data' ELSE 'Q' || CAST(ceil(r * 4.0 / n) AS INT) END AS quartile FROM (SELECT *, {_first_sql(_V)} AS r, count({_V}) OVER (PARTITION BY snapshot_date) AS n FROM panel)", PANEL)
def ev_quartile_labels(spark: SparkSession, sf: str) -> DataFrame:
    return panel(spark, sf).select("security_key", "snapshot_date", evaluation.quartile_labels(F.col(_V), ["snapshot_date"], ["security_key"]).alias("quartile"))


_DIFF = ", ".join(f"round(avg(forward_return_{h}d) FILTER (p AND c) - avg(forward_return_{h}d) FILTER (p AND NOT c), 6) + 0.0 AS difference_forward_return_{h}d" for h in (1, 5, 20))


@query("ev_conditional_change", f"SELECT sector, count(y) FILTER (p AND c) AS with_n, count(*) FILTER (p AND c AND y > 0) AS with_events, round(count(*) FILTER (p AND c AND y > 0) / nullif(count(y) FILTER (p AND c), 0), 6) AS with_rate, count(y) FILTER (p AND NOT c) AS without_n, count(*) FILTER (p AND NOT c AND y > 0) AS without_events, round(count(*) FILTER (p AND NOT c AND y > 0) / nullif(count(y) FILTER (p AND NOT c), 0), 6) AS without_rate, {_DIFF} FROM (SELECT *, {_Y} AS y, coalesce({rank_sql('price_return_5d')} <= 0.3, false) AS p, coalesce(short_interest_delta_pp > 0.5, false) AS c FROM panel) GROUP BY 1", PANEL)
def ev_conditional_change(spark: SparkSession, sf: str) -> DataFrame:
    prior = ranks.tail(ranks.pct_rank(F.col("price_return_5d"), ["snapshot_date"]), 0.3, "lower")
    rows = panel(spark, sf).withColumns({"y": TARGETS["down_5pct_5d"].build(), "p": prior})
    return rounded(evaluation.conditional_change(rows, ["sector"], F.col("p"), F.col("short_interest_delta_pp") > 0.5, "y", [f"forward_return_{h}d" for h in (1, 5, 20)]))


@query("ev_most_frequent", "SELECT l_partkey AS value, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, value LIMIT 50")
def ev_most_frequent(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.most_frequent(table(spark, sf, "lineitem").select(F.col("l_partkey").alias("value")), "value")


@query("id_lookup", "SELECT o_orderkey, CASE WHEN a.n = 1 THEN a.v WHEN a.n IS NULL AND b.n = 1 THEN b.v END AS symbol, CASE WHEN a.n = 1 THEN 'isin' WHEN a.n > 1 THEN 'ambiguous_isin' WHEN b.n = 1 THEN 'lei' WHEN b.n > 1 THEN 'ambiguous_lei' ELSE 'unresolved' END AS instrument_resolution FROM orders LEFT JOIN (SELECT p_partkey // 2 AS k, count(DISTINCT p_type) AS n, min(p_type) AS v FROM part WHERE p_size > 10 GROUP BY 1) a ON o_custkey = a.k LEFT JOIN (SELECT p_size AS k, count(DISTINCT p_type) AS n, min(p_type) AS v FROM part WHERE p_brand = 'Brand#2' AND p_size > 10 GROUP BY 1) b ON o_custkey % 70 = b.k")
def id_lookup(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("isin"), (F.col("o_custkey") % 70).alias("lei"))
    p = table(spark, sf, "part").where("p_size > 10")
    instruments = p.select(F.floor(F.col("p_partkey") / 2).alias("isin"), F.when(F.col("p_brand") == "Brand#2", F.col("p_size").cast("bigint")).alias("lei"), F.col("p_type").alias("symbol"))
    return entities.lookup(rows, instruments, "o_orderkey", "symbol", ("isin", "lei"))


@query("id_cascade", "SELECT c_custkey, coalesce(CAST(CASE WHEN c_mktsegment = 'BUILDING' THEN c_custkey END AS VARCHAR), CASE WHEN c_nationkey < 10 THEN 'N' || c_nationkey END) AS symbol, CASE WHEN c_mktsegment = 'BUILDING' THEN 'manual' WHEN c_nationkey < 10 THEN 'nation' ELSE 'unmapped' END AS mapping_source FROM customer")
def id_cascade(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    manual = c.where("c_mktsegment = 'BUILDING'").select("c_custkey", F.col("c_custkey").cast("string").alias("symbol"))
    nation = table(spark, sf, "nation").where("n_nationkey < 10").select(F.col("n_nationkey").alias("c_nationkey"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("symbol"))
    return entities.cascade(c, [(manual, "c_custkey", "manual"), (nation, "c_nationkey", "nation")], "symbol").select("c_custkey", "symbol", "mapping_source")


@query("id_name_similarity")
def id_name_similarity(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier")
    names = s.select(text.company(F.concat(F.lit("Suplier "), F.regexp_extract("s_name", r"(\d+)", 1))).alias("name"))
    candidates = s.select(F.col("s_suppkey").alias("symbol"), text.company(F.regexp_replace("s_name", "#", " ")).alias("candidate"))
    return entities.best_match(names, candidates, "name", lambda c: F.right(c, F.lit(3)))


@query("id_discover", "SELECT 'B' || p_partkey AS isin, CAST(NULL AS VARCHAR) AS lei, upper(p_name) AS issuer, CASE WHEN p_size <= 10 THEN 'ENT-' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') ELSE 'ENT-' || lpad(CAST(500000 + row_number() OVER (PARTITION BY p_size <= 10 ORDER BY 'B' || p_partkey) AS VARCHAR), 6, '0') END AS entity_id FROM part WHERE p_size > 5")
def id_discover(spark: SparkSession, sf: str) -> DataFrame:
    """Parts up to size 5 are known as they are, up to size 10 by another name; the others are new."""
    none = F.lit(None).cast("string")
    seen = table(spark, sf, "part").select(F.concat(F.lit("B"), F.col("p_partkey").cast("string")).alias("isin"), none.alias("lei"), F.upper("p_name").alias("issuer"), "p_size", F.format_string("ENT-%06d", F.col("p_partkey")).alias("entity_id"))
    known = seen.where("p_size <= 10").withColumn("issuer", F.when(F.col("p_size") <= 5, F.col("issuer")).otherwise("OLD NAME"))
    return entities.discover(seen.select("isin", "lei", "issuer"), known.drop("p_size"), 500_000)
