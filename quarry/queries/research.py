"""Queries of signals, masks, ranks, aggregates and research analyses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import ranks, stats
from quarry.operators import buckets, inference, order
from quarry.plans import discovery, research
from quarry.plans.spec import TARGETS, Signal, Spec, load
from quarry.queries.base import PANEL, RELATIVE, SPLIT, SPLITS, WINDOWS, panel, query, rank_sql, rounded

KEY = ("security_key", "snapshot_date")
_Y = "CASE WHEN forward_return_5d IS NOT NULL THEN CAST(forward_return_5d <= -0.05 AS DOUBLE) END"


def _ids(df: DataFrame, *more: str | Column) -> DataFrame:
    return rounded(df.select(*KEY, *more))


# --- 2.D masks and buckets -------------------------------------------------------------------

_M, _V, _S = "price_return_5d", "price_volatility_20d", "short_interest_delta_pp"


@query("mask_targets", "SELECT security_key, snapshot_date, " + ", ".join(f"CASE WHEN {t.column} IS NOT NULL THEN CAST({t.column} {'>' if t.side == 'above' else '<='} {t.threshold} AS DOUBLE) END AS {n}" if t.side != "number" else f"round({t.column}, 6) + 0.0 AS {n}" for n, t in TARGETS.items()) + " FROM panel", PANEL)
def mask_targets(spark: SparkSession, sf: str) -> DataFrame:
    return _ids(panel(spark, sf), *[t.build().alias(n) for n, t in TARGETS.items()])


@query("mask_tail", f"SELECT security_key, snapshot_date, coalesce({rank_sql(_M)} <= 0.2, false) AS low, coalesce({rank_sql(_V)} >= 0.8, false) AS high FROM panel", PANEL)
def mask_tail(spark: SparkSession, sf: str) -> DataFrame:
    r = lambda c: ranks.pct_rank(F.col(c), ["snapshot_date"])
    return _ids(panel(spark, sf), ranks.tail(r(_M), 0.2, "lower").alias("low"), ranks.tail(r(_V), 0.2, "upper").alias("high"))


@query("mask_quantile_tail", f"SELECT security_key, snapshot_date, coalesce({_M} <= q, false) AS low FROM panel JOIN (SELECT snapshot_date, quantile_cont({_M}, 0.2) AS q FROM panel GROUP BY 1) USING (snapshot_date)", PANEL)
def mask_quantile_tail(spark: SparkSession, sf: str) -> DataFrame:
    return _ids(buckets.quantile_tail(panel(spark, sf), _M, 0.2, "lower", ["snapshot_date"], "low"), "low")


@query("mask_frozen_tail", f"SELECT security_key, snapshot_date, coalesce({_V} >= (SELECT quantile_cont({_V}, 0.8) FROM panel WHERE snapshot_date <= DATE '1998-12-31'), false) AS high FROM panel WHERE snapshot_date > DATE '1998-12-31'", PANEL)
def mask_frozen_tail(spark: SparkSession, sf: str) -> DataFrame:
    p = panel(spark, sf)
    return _ids(buckets.frozen_tail(p.where("snapshot_date <= date'1998-12-31'"), p.where("snapshot_date > date'1998-12-31'"), _V, 0.2, "high"), "high")


@query("mask_top_positive_change", f"SELECT security_key, snapshot_date, coalesce({rank_sql('pos')} > 0.8, false) AS top FROM (SELECT *, CASE WHEN {_S} > 0 THEN {_S} END AS pos FROM panel)", PANEL)
def mask_top_positive_change(spark: SparkSession, sf: str) -> DataFrame:
    pos = F.when(F.col(_S) > 0, F.col(_S))
    return _ids(panel(spark, sf).withColumn("pos", pos), F.coalesce(ranks.pct_rank(F.col("pos"), ["snapshot_date"]) > 0.8, F.lit(False)).alias("top"))


@query("mask_bands", f"SELECT security_key, snapshot_date, CASE WHEN r <= 0.1 THEN 'lower_0_0.1' WHEN r <= 0.25 THEN 'lower_0.1_0.25' WHEN r <= 0.5 THEN 'lower_0.25_0.5' END AS band FROM (SELECT *, {rank_sql(_M)} AS r FROM panel)", PANEL)
def mask_bands(spark: SparkSession, sf: str) -> DataFrame:
    p = panel(spark, sf).withColumn("r", ranks.pct_rank(F.col(_M), ["snapshot_date"]))
    return _ids(p, ranks.bands(F.col("r"), [0.1, 0.25, 0.5], "lower").alias("band"))


@query("mask_windows", f"SELECT w AS window, {SPLIT} AS split, count(*) AS n FROM panel, windows WHERE {SPLIT} IS NOT NULL GROUP BY 1, 2", PANEL + ", " + SPLITS)
def mask_windows(spark: SparkSession, sf: str) -> DataFrame:
    return research.in_windows(panel(spark, sf), WINDOWS, ("train", "validation", "test")).groupBy("window", "split").agg(F.count(F.lit(1)).alias("n"))


@query("mask_evaluation", "SELECT count(*) AS n FROM panel WHERE snapshot_date BETWEEN DATE '1998-03-01' AND DATE '1999-02-28'", PANEL)
def mask_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    return panel(spark, sf).where(F.col("snapshot_date").between(F.lit("1998-03-01").cast("date"), F.lit("1999-02-28").cast("date"))).agg(F.count(F.lit(1)).alias("n"))


@query("mask_trajectory", "SELECT security_key, snapshot_date, CASE WHEN price_return_60d IS NULL OR price_return_20d IS NULL THEN 'insufficient_history' WHEN price_return_60d < 0 AND price_return_20d >= 0 THEN 'recovery' WHEN price_return_60d >= 0 AND price_return_20d >= 0 THEN 'uptrend' WHEN price_return_60d < 0 AND price_return_20d < 0 THEN 'downtrend' ELSE 'other' END AS trajectory FROM panel", PANEL)
def mask_trajectory(spark: SparkSession, sf: str) -> DataFrame:
    return _ids(panel(spark, sf), buckets.trajectory(F.col("price_return_60d"), F.col("price_return_20d")).alias("trajectory"))


@query("mask_four_groups", f"SELECT security_key, snapshot_date, CASE WHEN m AND h THEN 'A' WHEN m THEN 'B' WHEN h THEN 'C' ELSE 'D' END AS grp FROM (SELECT *, coalesce({rank_sql(_M)} <= 0.2, false) AS m, coalesce({_S} > 1, false) AS h FROM panel)", PANEL)
def mask_four_groups(spark: SparkSession, sf: str) -> DataFrame:
    m = ranks.tail(ranks.pct_rank(F.col(_M), ["snapshot_date"]), 0.2, "lower")
    return _ids(panel(spark, sf).withColumn("m", m), buckets.four_groups(F.col("m"), F.col(_S) > 1).alias("grp"))


@query("mask_change_buckets", f"SELECT security_key, snapshot_date, CASE WHEN {_S} < 0 THEN '<0' WHEN {_S} < 0.25 THEN '0-0.25' WHEN {_S} < 0.5 THEN '0.25-0.5' WHEN {_S} < 1 THEN '0.5-1' WHEN {_S} >= 1 THEN '>1' END AS bucket FROM panel", PANEL)
def mask_change_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return _ids(panel(spark, sf), buckets.change_bucket(F.col(_S)).alias("bucket"))


@query("mask_outcome_buckets", "SELECT security_key, snapshot_date, CASE WHEN forward_return_5d IS NULL THEN 'insufficient_forward_data' WHEN forward_return_5d <= -0.05 THEN 'down' WHEN forward_return_5d >= 0.05 THEN 'up' ELSE 'middle' END AS outcome FROM panel", PANEL)
def mask_outcome_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return _ids(panel(spark, sf), buckets.outcome(F.col("forward_return_5d")).alias("outcome"))


@query("mask_signed_change", f"SELECT security_key, snapshot_date, CASE WHEN {_S} < 0 THEN 'negative' WHEN {_S} = 0 THEN 'zero' WHEN r <= 0.5 THEN 'positive_0_50' WHEN r <= 0.8 THEN 'positive_50_80' WHEN r <= 0.95 THEN 'positive_80_95' WHEN r IS NOT NULL THEN 'positive_95_100' END AS bucket FROM (SELECT *, CASE WHEN {_S} > 0 THEN CAST(row_number() OVER (PARTITION BY snapshot_date, {_S} > 0 ORDER BY {_S}, security_key) AS DOUBLE) / count(CASE WHEN {_S} > 0 THEN 1 END) OVER (PARTITION BY snapshot_date) END AS r FROM panel)", PANEL)
def mask_signed_change(spark: SparkSession, sf: str) -> DataFrame:
    return _ids(panel(spark, sf), buckets.signed_change(F.col(_S), ["snapshot_date"], ["security_key"]).alias("bucket"))


# --- 2.E ranks -------------------------------------------------------------------------------


def _first_sql(x: str, by: str = "snapshot_date") -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN row_number() OVER (PARTITION BY {by}, {x} IS NULL ORDER BY {x}, security_key) END"


@query("rank_deciles", f"SELECT security_key, snapshot_date, CASE WHEN r IS NULL THEN -1 ELSE greatest(0, least(9, CAST(ceil(r * 10.0 / n) AS INT) - 1)) END AS decile FROM (SELECT *, {_first_sql(_M)} AS r, count({_M}) OVER (PARTITION BY snapshot_date) AS n FROM panel)", PANEL)
def rank_deciles(spark: SparkSession, sf: str) -> DataFrame:
    return _ids(panel(spark, sf), ranks.deciles(F.col(_M), ["snapshot_date"], ["security_key"]).alias("decile"))


_FLOOR = f"SELECT *, CASE WHEN r IS NULL OR n < 3 THEN -1 ELSE least(2, CAST(floor(r * 3.0 / n) AS INT)) END AS tercile FROM (SELECT *, {_first_sql(_V)} AS r, count({_V}) OVER (PARTITION BY snapshot_date) AS n FROM panel)"


@query("rank_groups_floor", f"SELECT security_key, snapshot_date, tercile FROM ({_FLOOR})", PANEL)
def rank_groups_floor(spark: SparkSession, sf: str) -> DataFrame:
    return _ids(panel(spark, sf), ranks.groups_floor(F.col(_V), ["snapshot_date"], ["security_key"], 3).alias("tercile"))


@query("rank_nested_deciles", f"SELECT security_key, snapshot_date, CASE WHEN r2 IS NULL THEN -1 ELSE greatest(0, least(9, CAST(ceil(r2 * 10.0 / n2) AS INT) - 1)) END AS decile FROM (SELECT security_key, snapshot_date, {_first_sql('short_interest_pct', 'snapshot_date, tercile')} AS r2, count(short_interest_pct) OVER (PARTITION BY snapshot_date, tercile) AS n2 FROM ({_FLOOR}))", PANEL)
def rank_nested_deciles(spark: SparkSession, sf: str) -> DataFrame:
    p = panel(spark, sf).withColumn("tercile", ranks.groups_floor(F.col(_V), ["snapshot_date"], ["security_key"], 3))
    return _ids(p, ranks.deciles(F.col("short_interest_pct"), ["snapshot_date", "tercile"], ["security_key"]).alias("decile"))


@query("rank_yearly_quintiles", f"SELECT security_key, snapshot_date, CAST(greatest(0, ceil((r - 1) * 5.0 / greatest(n - 1, 1) - 1e-12) - 1) AS INT) AS quintile FROM (SELECT *, row_number() OVER (PARTITION BY year(snapshot_date) ORDER BY {_V}, security_key, snapshot_date) AS r, count(*) OVER (PARTITION BY year(snapshot_date)) AS n FROM panel WHERE {_V} IS NOT NULL)", PANEL)
def rank_yearly_quintiles(spark: SparkSession, sf: str) -> DataFrame:
    p = panel(spark, sf).where(F.col(_V).isNotNull())
    r, n = ranks.first_rank(F.col(_V), [F.year("snapshot_date")], ["security_key", "snapshot_date"])
    return _ids(p, ranks.quantile_cut(r, n, 5).alias("quintile"))


@query("rank_pretest_terciles", f"SELECT security_key, snapshot_date, CASE WHEN {_V} IS NULL THEN 'UNKNOWN' WHEN {_V} <= q[1] THEN 'LOW' WHEN {_V} <= q[2] THEN 'MID' ELSE 'HIGH' END AS regime FROM panel, (SELECT quantile_cont({_V}, [1.0 / 3, 2.0 / 3]) AS q FROM panel WHERE snapshot_date <= DATE '1997-12-31')", PANEL)
def rank_pretest_terciles(spark: SparkSession, sf: str) -> DataFrame:
    p = panel(spark, sf)
    edges = buckets.learned_edges(p.where("snapshot_date <= date'1997-12-31'"), _V, [1 / 3, 2 / 3])
    return _ids(p, ranks.by_thresholds(F.col(_V), edges, ["LOW", "MID", "HIGH"]).alias("regime"))


@query("rank_split_local_change", f"SELECT w AS window, split, security_key, snapshot_date, round(short_interest_pct - lag(short_interest_pct) OVER (PARTITION BY w, split, security_key ORDER BY snapshot_date), 6) + 0.0 AS change FROM (SELECT *, {SPLIT} AS split FROM panel, windows) WHERE split IS NOT NULL", PANEL + ", " + SPLITS)
def rank_split_local_change(spark: SparkSession, sf: str) -> DataFrame:
    rows = research.in_windows(panel(spark, sf), WINDOWS, ("train", "validation", "test"))
    return rounded(buckets.split_dynamics(rows, ["window", "split", "security_key"]).select("window", "split", *KEY, "change"))


# --- 2.F aggregates --------------------------------------------------------------------------


@query("agg_rates", f"SELECT sector, count(y) AS n, count(*) FILTER (y > 0) AS events, round(count(*) FILTER (y > 0) / count(y), 6) AS rate, count(*) AS n_all, round(count(*) FILTER (y > 0) / count(*), 6) AS rate_all FROM (SELECT *, {_Y} AS y FROM panel) GROUP BY 1", PANEL)
def agg_rates(spark: SparkSession, sf: str) -> DataFrame:
    y = F.col("y")
    n, e, r = stats.rate(y)
    n_all, _, r_all = stats.rate(y, mode="all")
    return rounded(panel(spark, sf).withColumn("y", TARGETS["down_5pct_5d"].build()).groupBy("sector").agg(n.alias("n"), e.alias("events"), r.alias("rate"), n_all.alias("n_all"), r_all.alias("rate_all")))


@query("agg_binary_metrics", f"SELECT n, events, round(events / n, 6) AS rate, round(be / bn, 6) AS base_rate, round((events / n) / (be / bn), 6) AS lift FROM (SELECT count(y) FILTER (t) AS n, count(*) FILTER (t AND y > 0) AS events, count(y) AS bn, count(*) FILTER (y > 0) AS be FROM (SELECT *, {_Y} AS y, coalesce({rank_sql(_M)} <= 0.2, false) AS t FROM panel))", PANEL)
def agg_binary_metrics(spark: SparkSession, sf: str) -> DataFrame:
    t = ranks.tail(ranks.pct_rank(F.col(_M), ["snapshot_date"]), 0.2, "lower")
    rows = panel(spark, sf).select(t.alias("t"), TARGETS["down_5pct_5d"].build().alias("y"))
    n, e, r = stats.rate(F.col("y"), F.col("t"))
    _, _, b = stats.rate(F.col("y"))
    return rounded(rows.agg(n.alias("n"), e.alias("events"), r.alias("rate"), b.alias("base_rate")).withColumn("lift", stats.lift(F.col("rate"), F.col("base_rate"))))


_PCT = ("p01", 0.01), ("p05", 0.05), ("p10", 0.1), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99)


@query("agg_return_summary", "SELECT sector, count(forward_return_5d) AS n, round(avg(forward_return_5d), 6) + 0.0 AS mean, round(median(forward_return_5d), 6) + 0.0 AS median, " + ", ".join(f"round(quantile_cont(forward_return_5d, {v}), 6) + 0.0 AS {k}" for k, v in _PCT) + " FROM panel GROUP BY 1", PANEL)
def agg_return_summary(spark: SparkSession, sf: str) -> DataFrame:
    r = F.col("forward_return_5d")
    return rounded(panel(spark, sf).groupBy("sector").agg(F.count(r).alias("n"), F.avg(r).alias("mean"), F.median(r).alias("median"), *[F.percentile(r, v).alias(k) for k, v in _PCT]))


@query("agg_event_buckets", f"SELECT bucket, count(*) AS n, round(median(forward_return_20d), 6) + 0.0 AS median, round(avg(forward_return_20d), 6) + 0.0 AS mean, round(count(*) FILTER (forward_return_20d > 0) / count(forward_return_20d), 6) AS positive FROM (SELECT *, CASE WHEN {_S} < 0 THEN '<0' WHEN {_S} < 0.25 THEN '0-0.25' WHEN {_S} < 0.5 THEN '0.25-0.5' WHEN {_S} < 1 THEN '0.5-1' WHEN {_S} >= 1 THEN '>1' END AS bucket FROM panel) GROUP BY 1", PANEL)
def agg_event_buckets(spark: SparkSession, sf: str) -> DataFrame:
    r = F.col("forward_return_20d")
    rows = panel(spark, sf).withColumn("bucket", buckets.change_bucket(F.col(_S)))
    return rounded(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.median(r).alias("median"), F.avg(r).alias("mean"), stats.ratio(F.count_if(r > 0), F.count(r)).alias("positive")))


@query("agg_volatility_regimes", f"SELECT year(snapshot_date) AS year, {_V} >= v AS high_vol, short_interest_pct >= s AS high_si, count(*) AS n, round(avg(forward_return_5d), 6) + 0.0 AS mean FROM panel, (SELECT median({_V}) AS v, median(short_interest_pct) AS s FROM panel) WHERE {_V} IS NOT NULL GROUP BY 1, 2, 3", PANEL)
def agg_volatility_regimes(spark: SparkSession, sf: str) -> DataFrame:
    p = panel(spark, sf)
    v, s = order.quantiles(p, _V, [0.5])[0], order.quantiles(p, "short_interest_pct", [0.5])[0]
    rows = p.where(F.col(_V).isNotNull()).groupBy(F.year("snapshot_date").alias("year"), (F.col(_V) >= v).alias("high_vol"), (F.col("short_interest_pct") >= s).alias("high_si"))
    return rounded(rows.agg(F.count(F.lit(1)).alias("n"), F.avg("forward_return_5d").alias("mean")))


_CELLS = f"deciled AS (SELECT *, {_Y} AS y, CASE WHEN r1 IS NULL THEN -1 ELSE greatest(0, least(9, CAST(ceil(r1 * 10.0 / n1) AS INT) - 1)) END AS d1, CASE WHEN r2 IS NULL THEN -1 ELSE greatest(0, least(9, CAST(ceil(r2 * 10.0 / n2) AS INT) - 1)) END AS d2 FROM (SELECT *, {_first_sql(_M)} AS r1, count({_M}) OVER (PARTITION BY snapshot_date) AS n1, {_first_sql('short_interest_pct')} AS r2, count(short_interest_pct) OVER (PARTITION BY snapshot_date) AS n2 FROM panel))"


def _deciled(spark: SparkSession, sf: str) -> DataFrame:
    d = lambda c: ranks.deciles(F.col(c), ["snapshot_date"], ["security_key"])
    return panel(spark, sf).withColumns({"d1": d(_M), "d2": d("short_interest_pct"), "y": TARGETS["down_5pct_5d"].build()})


@query("agg_surface", "SELECT d1, d2, n, events, round(events / n, 6) AS rate, round(events / n - sum(events) OVER (PARTITION BY d1) / sum(n) OVER (PARTITION BY d1), 6) + 0.0 AS effect FROM (SELECT d1, d2, count(y) AS n, count(*) FILTER (y > 0) AS events FROM deciled WHERE d1 >= 0 AND d2 >= 0 GROUP BY 1, 2) WHERE n > 0", PANEL + ", " + _CELLS)
def agg_surface(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(buckets.surface(_deciled(spark, sf).where("d1 >= 0 and d2 >= 0"), "d1", "d2", "y").where("n > 0"))


@query("agg_stratification_2d", "SELECT d1 // 5 AS a, d2 // 5 AS b, count(y) AS n, count(*) FILTER (y > 0) AS events, round(avg(forward_return_5d), 6) + 0.0 AS mean, round(median(forward_return_5d), 6) + 0.0 AS median FROM deciled WHERE d1 >= 0 AND d2 >= 0 GROUP BY 1, 2", PANEL + ", " + _CELLS)
def agg_stratification_2d(spark: SparkSession, sf: str) -> DataFrame:
    rows = _deciled(spark, sf).where("d1 >= 0 and d2 >= 0").groupBy(F.floor(F.col("d1") / 5).alias("a"), F.floor(F.col("d2") / 5).alias("b"))
    return rounded(rows.agg(F.count("y").alias("n"), stats.events(F.col("y")).alias("events"), F.avg("forward_return_5d").alias("mean"), F.median("forward_return_5d").alias("median")))


@query("agg_top_fraction", f"SELECT round(f, 2) AS fraction, count(*) AS n, round(avg(forward_return_5d), 6) + 0.0 AS mean FROM (SELECT forward_return_5d, row_number() OVER (ORDER BY {_V} DESC, security_key, snapshot_date) AS r, count(*) OVER () AS total FROM panel WHERE {_V} IS NOT NULL AND forward_return_5d IS NOT NULL), (VALUES (0.01), (0.05), (0.1), (0.25)) t(f) WHERE r <= greatest(1, ceil(total * f)) GROUP BY 1", PANEL)
def agg_top_fraction(spark: SparkSession, sf: str) -> DataFrame:
    rows = panel(spark, sf).where(F.col(_V).isNotNull() & F.col("forward_return_5d").isNotNull())
    return rounded(order.top_fractions(rows, _V, ["security_key", "snapshot_date"], [0.01, 0.05, 0.1, 0.25], "forward_return_5d"))


@query("agg_yearly_monthly", "SELECT year(snapshot_date) AS year, month(snapshot_date) AS month, count(*) AS n, round(avg(forward_return_5d), 6) + 0.0 AS mean FROM panel GROUP BY 1, 2", PANEL)
def agg_yearly_monthly(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(panel(spark, sf).groupBy(F.year("snapshot_date").alias("year"), F.month("snapshot_date").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.avg("forward_return_5d").alias("mean")))


@query("agg_drift", f"SELECT a.n AS n_before, b.n AS n_after, round(a.m, 6) AS mean_before, round(b.m, 6) AS mean_after, round((b.m - a.m) / a.s, 6) + 0.0 AS standardised_delta FROM (SELECT count({_V}) AS n, avg({_V}) AS m, stddev_samp({_V}) AS s FROM panel WHERE snapshot_date <= DATE '1998-12-31') a, (SELECT count({_V}) AS n, avg({_V}) AS m FROM panel WHERE snapshot_date > DATE '1998-12-31') b", PANEL)
def agg_drift(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(buckets.drift(panel(spark, sf), _V, F.col("snapshot_date") <= F.lit("1998-12-31").cast("date")))


@query("agg_missingness", "SELECT round(count(*) FILTER (price_return_60d IS NULL) / count(*), 6) AS price_return_60d, round(count(*) FILTER (forward_return_60d IS NULL) / count(*), 6) AS forward_return_60d FROM panel", PANEL)
def agg_missingness(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(buckets.missing(panel(spark, sf), ["price_return_60d", "forward_return_60d"]))


@query("agg_dataset_summary", "SELECT count(*) AS rows, count(DISTINCT security_key) AS securities, count(DISTINCT snapshot_date) AS dates, min(snapshot_date) AS first, max(snapshot_date) AS last FROM panel", PANEL)
def agg_dataset_summary(spark: SparkSession, sf: str) -> DataFrame:
    return panel(spark, sf).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("security_key").alias("securities"), F.count_distinct("snapshot_date").alias("dates"), F.min("snapshot_date").alias("first"), F.max("snapshot_date").alias("last"))


_POOL = f"pooled_rows AS (SELECT sector, w AS window, count(y) AS n, count(*) FILTER (y > 0) / count(y) AS lift, avg(forward_return_5d) AS return_difference FROM (SELECT *, {_Y} AS y, {SPLIT} AS split FROM panel, windows) WHERE split IN ('validation', 'test') GROUP BY 1, 2)"


def _pool_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = research.in_windows(panel(spark, sf).withColumn("y", TARGETS["down_5pct_5d"].build()), WINDOWS, ("validation", "test"))
    return rows.groupBy("sector", "window").agg(F.count("y").alias("n"), stats.ratio(stats.events(F.col("y")), F.count("y")).alias("lift"), F.avg("forward_return_5d").alias("return_difference"))


@query("agg_pool_and_score", "SELECT sector, count(*) AS windows, CAST(sum(n) AS BIGINT) AS n, round(avg(lift), 6) AS mean_lift, round(avg(return_difference), 6) + 0.0 AS mean_return_difference, round(avg(lift) - 1 + greatest(0, -avg(return_difference)), 6) + 0.0 AS score FROM pooled_rows WHERE n >= 20 GROUP BY 1 ORDER BY score DESC, sector LIMIT 3", PANEL + ", " + SPLITS + ", " + _POOL)
def agg_pool_and_score(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(discovery.scored(discovery.pool(_pool_rows(spark, sf), ["sector"], 20), 3, ["sector"]))


@query("agg_stability", "SELECT sector, count(lift) AS windows, round(avg(lift), 6) AS mean, round(min(lift), 6) AS least, round(max(lift), 6) AS most, round(count(*) FILTER (lift > 0.5) / count(lift), 6) AS above_baseline, round(greatest(count(*) FILTER (lift > 0.5), count(*) FILTER (lift < 0.5)) / count(lift), 6) AS sign_consistency FROM pooled_rows GROUP BY 1", PANEL + ", " + SPLITS + ", " + _POOL)
def agg_stability(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(discovery.stability(_pool_rows(spark, sf), ["sector"], "lift", 0.5))


# --- 2.G analyses ----------------------------------------------------------------------------

_READY = f"ready AS (SELECT snapshot_date, {_Y} AS y5, CASE WHEN forward_return_5d IS NOT NULL THEN CAST(forward_return_5d <= -0.1 AS DOUBLE) END AS y10, {rank_sql('price_return_5d')} AS rm, {rank_sql('price_return_60d')} AS rl, {rank_sql(_V)} AS rv FROM panel), masked AS (SELECT w AS \"window\", {SPLIT} AS split, *, coalesce(rm <= 0.2, false) AS m, coalesce(rl <= 0.2, false) AS l, coalesce(rv >= 0.8, false) AS v FROM ready, windows), cut AS (SELECT * FROM masked WHERE split IN ('validation', 'test')), long AS (SELECT *, 'down_5pct_5d' AS target, y5 AS y FROM cut UNION ALL SELECT *, 'down_10pct_5d', y10 FROM cut)"
_CTX = PANEL + ", " + SPLITS + ", " + _READY
_MOM, _LONG, _VOL = Signal("price_momentum_5d", "lower", (0.2,)), Signal("price_momentum_60d", "lower", (0.2,)), Signal("price_volatility_20d", "upper", (0.2,))
_TWO = ("down_5pct_5d", "down_10pct_5d")


def _run(spark: SparkSession, sf: str, analysis: str, *signals: Signal) -> DataFrame:
    return rounded(research.run(panel(spark, sf), Spec(analysis, signals, _TWO, analysis), WINDOWS))


def _compare_sql(a: str, b: str, names: tuple[str, str], extra: str = "", group: str = "", source: str = "long") -> str:
    x, y = names
    return (
        f"SELECT \"window\", split, target, {extra} {x}_n, {x}_events, {y}_n, {y}_events, round({x}_events / nullif({x}_n, 0), 6) AS {x}_rate, round({y}_events / nullif({y}_n, 0), 6) AS {y}_rate, round({x}_events / nullif({x}_n, 0) - {y}_events / nullif({y}_n, 0), 6) + 0.0 AS absolute_difference, round(CASE WHEN {y}_events > 0 THEN ({x}_events / nullif({x}_n, 0)) / ({y}_events / {y}_n) END, 6) AS lift "
        f"FROM (SELECT \"window\", split, target, {group} count(y) FILTER ({a}) AS {x}_n, count(*) FILTER ({a} AND y > 0) AS {x}_events, count(y) FILTER ({b}) AS {y}_n, count(*) FILTER ({b} AND y > 0) AS {y}_events FROM {source} GROUP BY ALL)"
    )


@query("rq_tail", _compare_sql("m", "true", ("tail", "base"), "'price_momentum_5d' AS signal, 'lower' AS direction, 0.2::DOUBLE AS bin,") + " UNION ALL " + _compare_sql("v", "true", ("tail", "base"), "'price_volatility_20d' AS signal, 'upper' AS direction, 0.2::DOUBLE AS bin,"), _CTX)
def rq_tail(spark: SparkSession, sf: str) -> DataFrame:
    return _run(spark, sf, "tail", _MOM, _VOL)


@query(
    "rq_interaction",
    "SELECT \"window\", split, target, p11_n, p11_events, p10_n, p10_events, p01_n, p01_events, p00_n, p00_events, round(p11_events / nullif(p11_n, 0), 6) AS p11_rate, round(p10_events / nullif(p10_n, 0), 6) AS p10_rate, round(p01_events / nullif(p01_n, 0), 6) AS p01_rate, round(p00_events / nullif(p00_n, 0), 6) AS p00_rate, round(p11_events / nullif(p11_n, 0) - p10_events / nullif(p10_n, 0) - p01_events / nullif(p01_n, 0) + p00_events / nullif(p00_n, 0), 6) + 0.0 AS additive_interaction FROM (SELECT \"window\", split, target, "
    + ", ".join(f"count(*) FILTER ({c}) AS {n}_n, count(*) FILTER ({c} AND y > 0) AS {n}_events" for n, c in (("p11", "m AND v"), ("p10", "m AND NOT v"), ("p01", "NOT m AND v"), ("p00", "NOT m AND NOT v")))
    + " FROM long GROUP BY ALL)",
    _CTX,
)
def rq_interaction(spark: SparkSession, sf: str) -> DataFrame:
    return _run(spark, sf, "interaction", _MOM, _VOL)


@query("rq_regime_comparison", _compare_sql("m AND v", "m", ("incremental", "baseline")), _CTX)
def rq_regime_comparison(spark: SparkSession, sf: str) -> DataFrame:
    return _run(spark, sf, "regime_comparison", _MOM, _VOL)


@query("rq_multi_regime", _compare_sql("m AND l AND v", "m", ("incremental", "baseline")), _CTX)
def rq_multi_regime(spark: SparkSession, sf: str) -> DataFrame:
    return _run(spark, sf, "multi_regime_comparison", _MOM, _LONG, _VOL)


@query("rq_nested_regime", _compare_sql("m AND l AND v", "m AND l AND NOT v", ("incremental", "baseline")), _CTX)
def rq_nested_regime(spark: SparkSession, sf: str) -> DataFrame:
    return _run(spark, sf, "nested_regime_comparison", _MOM, _LONG, _VOL)


def _conditional_sql() -> str:
    parts = []
    for a in ("0.1", "0.2"):
        for b in ("0.2", "0.3"):
            parts.append(_compare_sql(f"coalesce(rm <= {a}, false) AND coalesce(rv >= 1 - {b}, false)", f"coalesce(rm <= {a}, false) AND NOT coalesce(rv >= 1 - {b}, false)", ("incremental", "baseline"), f"'{a}/{b}' AS bins,"))
    return " UNION ALL ".join(parts)


@query("rq_conditional_regime", _conditional_sql(), _CTX)
def rq_conditional_regime(spark: SparkSession, sf: str) -> DataFrame:
    return _run(spark, sf, "conditional_regime_comparison", Signal("price_momentum_5d", "lower", (0.1, 0.2)), Signal("price_volatility_20d", "upper", (0.2, 0.3)))


def _band_sql(r: str) -> str:
    return f"CASE WHEN {r} <= 0.2 THEN 'lower_0_0.2' WHEN {r} <= 0.5 THEN 'lower_0.2_0.5' WHEN {r} <= 1 THEN 'lower_0.5_1' END"


_BANDED = f"banded AS (SELECT * FROM (SELECT *, {_band_sql('rm')} AS first_band, {_band_sql('rl')} AS second_band FROM long) WHERE first_band IS NOT NULL AND second_band IS NOT NULL)"
_B1, _B2 = Signal("price_momentum_5d", "lower", (0.2, 0.5, 1.0)), Signal("price_momentum_60d", "lower", (0.2, 0.5, 1.0))


@query("rq_stratified_regime", _compare_sql("v", "NOT v", ("high", "normal"), "first_band, second_band,", "first_band, second_band,", "banded"), _CTX + ", " + _BANDED)
def rq_stratified_regime(spark: SparkSession, sf: str) -> DataFrame:
    return _run(spark, sf, "stratified_regime_comparison", _B1, _B2, _VOL)


def _contrast_sql() -> str:
    bands = ["lower_0_0.2", "lower_0.2_0.5", "lower_0.5_1"]
    pairs = [("first_weak_vs_strong", bands[0], b, bands[2], b) for b in bands] + [("second_weak_vs_strong", a, bands[0], a, bands[2]) for a in bands] + [("joint_weak_vs_strong", bands[0], bands[0], bands[2], bands[2])]
    rows = ", ".join(f"('{k}', '{a}__{b}', '{c}__{d}')" for k, a, b, c, d in pairs)
    return f"WITH cell AS (SELECT \"window\", split, target, first_band || '__' || second_band AS cell, count(*) FILTER (v AND y > 0) / nullif(count(*) FILTER (v), 0) - count(*) FILTER (NOT v AND y > 0) / nullif(count(*) FILTER (NOT v), 0) AS effect FROM banded GROUP BY ALL), keys AS (SELECT DISTINCT \"window\", split, target FROM cell) SELECT k.\"window\", k.split, k.target, contrast, reference, comparison, round(a.effect, 6) + 0.0 AS reference_effect, round(b.effect, 6) + 0.0 AS comparison_effect, round(b.effect - a.effect, 6) + 0.0 AS difference_in_differences FROM keys k CROSS JOIN (VALUES {rows}) p(contrast, reference, comparison) LEFT JOIN cell a ON a.\"window\" = k.\"window\" AND a.split = k.split AND a.target = k.target AND a.cell = reference LEFT JOIN cell b ON b.\"window\" = k.\"window\" AND b.split = k.split AND b.target = k.target AND b.cell = comparison"


@query("rq_stratified_interaction", "SELECT * FROM (" + _contrast_sql() + ")", _CTX + ", " + _BANDED)
def rq_stratified_interaction(spark: SparkSession, sf: str) -> DataFrame:
    return _run(spark, sf, "stratified_interaction", _B1, _B2, _VOL)


SEVERITY_SPEC = """
id: severity_of_falls
question: Do falls of 5 per cent reach 10 per cent more often at high volatility?
mode: deep
signals:
  - {name: price_momentum_5d, direction: lower, bins: [0.2]}
  - {name: price_volatility_20d, direction: upper, bins: [0.2]}
targets: [down_5pct_5d, down_10pct_5d]
analysis: {type: regime_comparison}
splits: [validation, test]
metadata:
  derived_metrics:
    severity: {formula: down_10pct_5d_events / down_5pct_5d_events}
    severity_difference: {formula: severity_incremental - severity_baseline}
    severity_lift: {formula: severity_incremental / severity_baseline}
"""


@query("rq_derived_metrics", "SELECT \"window\", split, round(ib, 6) AS severity_baseline, round(ii, 6) AS severity_incremental, round(ii - ib, 6) + 0.0 AS severity_difference, round(CASE WHEN ib <> 0 THEN ii / ib END, 6) AS severity_lift FROM (SELECT \"window\", split, count(*) FILTER (m AND y10 > 0) / nullif(count(*) FILTER (m AND y5 > 0), 0) AS ib, count(*) FILTER (m AND v AND y10 > 0) / nullif(count(*) FILTER (m AND v AND y5 > 0), 0) AS ii FROM cut GROUP BY 1, 2)", _CTX)
def rq_derived_metrics(spark: SparkSession, sf: str) -> DataFrame:
    spec = load(SEVERITY_SPEC)
    rows = research.run(panel(spark, sf), spec, WINDOWS)
    return rounded(research.derive(rows, {k: v["formula"] for k, v in spec.metadata["derived_metrics"].items()}, spec.targets))


# --- relative signals, and intervals from counts ---

RELATIVE_SPECS = {
    k: f"""
id: relative_{k}
question: Does momentum against the {k} weaken at high volatility?
mode: deep
signals:
  - {{name: price_return_5d_relative_{k}, direction: lower, bins: [0.2, 0.5, 1.0]}}
  - {{name: price_return_60d_relative_{k}, direction: lower, bins: [0.2, 0.5, 1.0]}}
  - {{name: price_volatility_20d, direction: upper, bins: [0.2]}}
targets: [down_5pct_5d, down_10pct_5d]
analysis: {{type: stratified_interaction}}
"""
    for k in ("market", "sector")
}


def _relative_ctes(k: str) -> str:
    ready = _READY
    for n, old in ((5, "price_return_5d"), (60, "price_return_60d")):
        ready = ready.replace(rank_sql(old), rank_sql(f"price_return_{n}d_relative_{k}"))
    return RELATIVE + ", " + SPLITS + ", " + ready.replace("FROM panel)", "FROM relative)", 1) + ", " + _BANDED


def _relative(k: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return rounded(research.run(panel(spark, sf), load(RELATIVE_SPECS[k]), WINDOWS))

    query(f"rq_relative_{k}", "SELECT * FROM (" + _contrast_sql() + ")", _relative_ctes(k))(run)


for _k in RELATIVE_SPECS:
    _relative(_k)


@query("mask_relative_signals", "SELECT security_key, snapshot_date, " + ", ".join(f"round(price_return_{n}d_relative_{k}, 6) + 0.0 AS price_return_{n}d_relative_{k}" for k in ("market", "sector") for n in (5, 20, 60)) + " FROM relative", RELATIVE)
def mask_relative_signals(spark: SparkSession, sf: str) -> DataFrame:
    return _ids(panel(spark, sf), *[f"price_return_{n}d_relative_{k}" for k in ("market", "sector") for n in (5, 20, 60)])


@query("mask_change_class", f"SELECT security_key, snapshot_date, CASE WHEN {_S} < 0 THEN 'negative' WHEN {_S} = 0 THEN 'zero' WHEN {_S} >= q THEN 'positive_extreme' WHEN {_S} > 0 THEN 'positive_normal' END AS class FROM panel, (SELECT quantile_cont({_S}, 0.8) AS q FROM panel WHERE {_S} > 0 AND snapshot_date <= DATE '1998-12-31')", PANEL)
def mask_change_class(spark: SparkSession, sf: str) -> DataFrame:
    """Extreme is what is beyond the quantile of the positive changes before the test."""
    p = panel(spark, sf)
    edge = buckets.learned_edges(p.where((F.col(_S) > 0) & (F.col("snapshot_date") <= F.lit("1998-12-31").cast("date"))), _S, [0.8])
    return _ids(p, buckets.change_class(F.col(_S), edge[0] if edge else float("inf")).alias("class"))


@query("mask_gradient", f"SELECT security_key, snapshot_date, CASE WHEN {_S} <= 0 THEN 'le_0' WHEN {_S} <= 0.25 THEN '0_0.25' WHEN {_S} <= 0.5 THEN '0.25_0.5' WHEN {_S} <= 1 THEN '0.5_1' WHEN {_S} <= 2 THEN '1_2' WHEN {_S} IS NOT NULL THEN 'gt_2' END AS band FROM panel", PANEL)
def mask_gradient(spark: SparkSession, sf: str) -> DataFrame:
    return _ids(panel(spark, sf), buckets.gradient(F.col(_S)).alias("band"))


@query("rank_frozen_buckets", f"SELECT security_key, snapshot_date, CASE WHEN {_S} IS NULL THEN 'UNKNOWN' WHEN {_S} <= q[1] THEN 'q0_20' WHEN {_S} <= q[2] THEN 'q20_40' WHEN {_S} <= q[3] THEN 'q40_60' WHEN {_S} <= q[4] THEN 'q60_80' WHEN {_S} <= q[5] THEN 'q80_95' ELSE 'q95_100' END AS bucket FROM panel, (SELECT quantile_cont({_S}, [0.2, 0.4, 0.6, 0.8, 0.95]) AS q FROM panel WHERE snapshot_date <= DATE '1998-12-31') WHERE snapshot_date > DATE '1998-12-31'", PANEL)
def rank_frozen_buckets(spark: SparkSession, sf: str) -> DataFrame:
    p = panel(spark, sf)
    edges = buckets.learned_edges(p.where("snapshot_date <= date'1998-12-31'"), _S, [0.2, 0.4, 0.6, 0.8, 0.95])
    return _ids(p.where("snapshot_date > date'1998-12-31'"), ranks.by_thresholds(F.col(_S), edges, ["q0_20", "q20_40", "q40_60", "q60_80", "q80_95", "q95_100"]).alias("bucket"))


def _with_intervals(spark: SparkSession, sf: str, analysis: str, *signals: Signal) -> DataFrame:
    return rounded(research.run(panel(spark, sf), Spec(analysis, signals, _TWO, analysis, bootstrap=True), WINDOWS))


@query("stat_bootstrap_nested")
def stat_bootstrap_nested(spark: SparkSession, sf: str) -> DataFrame:
    return _with_intervals(spark, sf, "regime_comparison", _MOM, _VOL)


@query("stat_bootstrap_between")
def stat_bootstrap_between(spark: SparkSession, sf: str) -> DataFrame:
    return _with_intervals(spark, sf, "nested_regime_comparison", _MOM, _LONG, _VOL)


@query("stat_bootstrap_interaction")
def stat_bootstrap_interaction(spark: SparkSession, sf: str) -> DataFrame:
    return _with_intervals(spark, sf, "interaction", _MOM, _VOL)


@query("stat_bootstrap_contrasts")
def stat_bootstrap_contrasts(spark: SparkSession, sf: str) -> DataFrame:
    return _with_intervals(spark, sf, "stratified_interaction", _B1, _B2, _VOL)


# --- 2.H statistics --------------------------------------------------------------------------


@query("stat_wilson", f"SELECT sector, k, n, round(greatest(0, mid - half), 6) AS low, round(least(1, mid + half), 6) AS high FROM (SELECT *, (k / n + {stats.Z**2} / (2 * n)) / (1 + {stats.Z**2} / n) AS mid, {stats.Z} / (1 + {stats.Z**2} / n) * sqrt(k / n * (1 - k / n) / n + {stats.Z**2} / (4.0 * n * n)) AS half FROM (SELECT sector, count(*) FILTER (y > 0) AS k, count(y) AS n FROM (SELECT sector, {_Y} AS y FROM panel) GROUP BY 1))", PANEL)
def stat_wilson(spark: SparkSession, sf: str) -> DataFrame:
    rows = panel(spark, sf).withColumn("y", TARGETS["down_5pct_5d"].build()).groupBy("sector").agg(stats.events(F.col("y")).alias("k"), F.count("y").alias("n"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return rounded(rows.select("sector", "k", "n", low.alias("low"), high.alias("high")))


@query("stat_wald_difference", f"SELECT sector, round(p1 - p0, 6) + 0.0 AS difference, round(p1 - p0 - h, 6) + 0.0 AS low, round(p1 - p0 + h, 6) + 0.0 AS high FROM (SELECT sector, k1 / n1 AS p1, k0 / n0 AS p0, 1.96 * sqrt(k1 / n1 * (1 - k1 / n1) / n1 + k0 / n0 * (1 - k0 / n0) / n0) AS h FROM (SELECT sector, count(*) FILTER (y > 0 AND h) AS k1, count(y) FILTER (h) AS n1, count(*) FILTER (y > 0 AND NOT h) AS k0, count(y) FILTER (NOT h) AS n0 FROM (SELECT sector, {_Y} AS y, short_interest_pct >= 4 AS h FROM panel) GROUP BY 1))", PANEL)
def stat_wald_difference(spark: SparkSession, sf: str) -> DataFrame:
    y, h = F.col("y"), F.col("short_interest_pct") >= 4
    n1, k1, _ = stats.rate(y, h)
    n0, k0, _ = stats.rate(y, ~h)
    rows = panel(spark, sf).withColumn("y", TARGETS["down_5pct_5d"].build()).groupBy("sector").agg(k1.alias("k1"), n1.alias("n1"), k0.alias("k0"), n0.alias("n0"))
    d, low, high = stats.wald_difference(*(F.col(c) for c in ("k1", "n1", "k0", "n0")))
    return rounded(rows.select("sector", d.alias("difference"), low.alias("low"), high.alias("high")))


@query("stat_auc", f"SELECT sector, count(*) FILTER (y > 0) AS positives, count(*) FILTER (y <= 0) AS negatives, round((sum(r) FILTER (y > 0) - count(*) FILTER (y > 0) * (count(*) FILTER (y > 0) + 1) / 2.0) / (count(*) FILTER (y > 0) * count(*) FILTER (y <= 0)), 6) AS auc FROM (SELECT sector, y, rank() OVER (PARTITION BY sector ORDER BY {_V}) + (count(*) OVER (PARTITION BY sector, {_V}) - 1) / 2.0 AS r FROM (SELECT *, {_Y} AS y FROM panel) WHERE y IS NOT NULL AND {_V} IS NOT NULL) GROUP BY 1", PANEL)
def stat_auc(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.auc(panel(spark, sf).withColumn("y", TARGETS["down_5pct_5d"].build()), "y", _V, ["sector"]))


@query("stat_spearman", f"SELECT sector, count(*) AS n, round(corr(rx, ry), 6) + 0.0 AS spearman FROM (SELECT sector, rank() OVER (PARTITION BY sector ORDER BY {_V}) + (count(*) OVER (PARTITION BY sector, {_V}) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY sector ORDER BY forward_return_5d) + (count(*) OVER (PARTITION BY sector, forward_return_5d) - 1) / 2.0 AS ry FROM panel WHERE {_V} IS NOT NULL AND forward_return_5d IS NOT NULL) GROUP BY 1", PANEL)
def stat_spearman(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.spearman(panel(spark, sf), _V, "forward_return_5d", ["sector"]))


_P = f"least(greatest({_V} / 3, 0), 1)"


@query("stat_classification", f"SELECT count(*) AS n, round(avg(CASE WHEN y > 0 THEN -ln(least(greatest(p, 1e-8), 1 - 1e-8)) ELSE -ln(1 - least(greatest(p, 1e-8), 1 - 1e-8)) END), 6) AS log_loss, round(avg((p - y) * (p - y)), 6) AS brier, round(avg(CAST((p >= 0.5) = (y > 0) AS DOUBLE)), 6) AS accuracy, round(count(*) FILTER (p >= 0.5 AND y > 0) / count(*) FILTER (p >= 0.5), 6) AS precision, round(count(*) FILTER (p >= 0.5 AND y > 0) / count(*) FILTER (y > 0), 6) AS recall FROM (SELECT {_P} AS p, {_Y} AS y FROM panel WHERE {_V} IS NOT NULL) WHERE y IS NOT NULL", PANEL)
def stat_classification(spark: SparkSession, sf: str) -> DataFrame:
    rows = panel(spark, sf).select(F.least(F.greatest(F.col(_V) / 3, F.lit(0.0)), F.lit(1.0)).alias("p"), TARGETS["down_5pct_5d"].build().alias("y")).where(F.col(_V).isNotNull() & F.col("y").isNotNull())
    return rounded(buckets.classification(rows, "y", "p"))


@query("stat_regression", "SELECT count(*) AS n, round(avg(abs(p - y)), 6) AS mae, round(sqrt(avg((p - y) * (p - y))), 6) AS rmse FROM (SELECT price_return_5d AS p, forward_return_5d AS y FROM panel) WHERE p IS NOT NULL AND y IS NOT NULL", PANEL)
def stat_regression(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(buckets.regression(panel(spark, sf), "forward_return_5d", "price_return_5d"))


@query("stat_average_precision", f"SELECT round(sum(tp / n * p) / (SELECT count(*) FROM (SELECT {_Y} AS y FROM panel WHERE {_V} IS NOT NULL) WHERE y > 0), 6) AS average_precision FROM (SELECT sum(p) OVER (ORDER BY s DESC) AS tp, sum(q) OVER (ORDER BY s DESC) AS n, p FROM (SELECT {_V} AS s, count(*) FILTER (y > 0) AS p, count(*) AS q FROM (SELECT *, {_Y} AS y FROM panel) WHERE y IS NOT NULL AND {_V} IS NOT NULL GROUP BY 1))", PANEL)
def stat_average_precision(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(order.average_precision(panel(spark, sf).withColumn("y", TARGETS["down_5pct_5d"].build()), "y", _V))


@query("stat_bootstrap_mean")
def stat_bootstrap_mean(spark: SparkSession, sf: str) -> DataFrame:
    return inference.grouped_bootstrap(panel(spark, sf).where(F.col("forward_return_5d").isNotNull()), ["sector"], "forward_return_5d", ["security_key", "snapshot_date"])


@query("stat_permutation")
def stat_permutation(spark: SparkSession, sf: str) -> DataFrame:
    import numpy as np

    pdf = _deciled(spark, sf).where("d2 >= 0 and y is not null").groupBy("d2", "y").count().toPandas()  # 20 counts
    k = pdf[pdf.y > 0].groupby("d2")["count"].sum().reindex(range(10), fill_value=0).to_numpy()
    n = pdf.groupby("d2")["count"].sum().reindex(range(10), fill_value=0).to_numpy()
    observed = float((k / np.maximum(n, 1)).max())
    draws = inference.permutations(spark, 1000, lambda rng: float((rng.multivariate_hypergeometric(n, int(k.sum())) / np.maximum(n, 1)).max()))
    return draws.agg(F.count(F.lit(1)).alias("permutations"), inference.empirical_p(observed).alias("p_value"))


@query("stat_permute_within_dates", "SELECT snapshot_date, count(*) AS n, CAST(sum(d2) AS BIGINT) AS total, CAST(sum(d2 * d2) AS BIGINT) AS squares, CASE WHEN count(*) >= 30 THEN true END AS moved FROM deciled GROUP BY 1", PANEL + ", " + _CELLS)
def stat_permute_within_dates(spark: SparkSession, sf: str) -> DataFrame:
    """A shuffle keeps each date's values, and moves them: of thirty or more of ten kinds some surely do."""
    rows = inference.permute_within(_deciled(spark, sf).select(*KEY, "d2", F.col("d2").alias("was")), ["snapshot_date"], "d2", ["security_key"], 7)
    n = F.count(F.lit(1))
    return rows.groupBy("snapshot_date").agg(n.alias("n"), F.sum("d2").alias("total"), F.sum(F.col("d2") * F.col("d2")).alias("squares"), F.when(n >= 30, F.count_if(F.col("d2") != F.col("was")) > 0).alias("moved"))
