"""Queries of frozen evaluations, anatomies, gates between scores, and models beside portfolios."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import ranks
from quarry.operators import buckets, diagnostics, evaluation, features, portfolio
from quarry.plans import lifecycle, registry
from quarry.plans.spec import TARGETS, Signal, Spec
from quarry.queries.base import PANEL, RELATIVE, WINDOWS, panel, prices, query, rank_sql, rounded
from quarry.queries.research import _Y

_V, _S, _M = "price_volatility_20d", "short_interest_delta_pp", "price_return_5d"
_BEFORE = "snapshot_date <= DATE '1998-12-31'"
_EDGE = f"edge AS (SELECT quantile_cont({_V}, 0.8) AS v, quantile_cont({_S}, 0.8) FILTER ({_S} > 0) AS s FROM panel WHERE {_BEFORE})"


def _with_target(spark: SparkSession, sf: str) -> DataFrame:
    return panel(spark, sf).withColumn("y", TARGETS["down_5pct_5d"].build())


def _frozen(rows: DataFrame) -> tuple[DataFrame, float, float]:
    """The rows of the test, and cuts of volatility and of positive changes from before it."""
    before = rows.where("snapshot_date <= date'1998-12-31'")
    v, s = buckets.learned_edges(before, _V, [0.8])[0], buckets.learned_edges(before.where(F.col(_S) > 0), _S, [0.8])[0]
    return rows.where("snapshot_date > date'1998-12-31'"), v, s


_FOUR = "count(y) FILTER (r AND h) AS rh_n, count(*) FILTER (r AND h AND y > 0) AS rh_events, count(y) FILTER (r AND NOT h) AS rl_n, count(*) FILTER (r AND NOT h AND y > 0) AS rl_events, count(y) FILTER (NOT r AND h) AS oh_n, count(*) FILTER (NOT r AND h AND y > 0) AS oh_events, count(y) FILTER (NOT r AND NOT h) AS ol_n, count(*) FILTER (NOT r AND NOT h AND y > 0) AS ol_events"
_GAP = "round(rh_events / nullif(rh_n, 0) - rl_events / nullif(rl_n, 0) - oh_events / nullif(oh_n, 0) + ol_events / nullif(ol_n, 0), 6) + 0.0 AS interaction"


@query("diag_event_interaction", f"SELECT *, {_GAP} FROM (SELECT sector, {_FOUR} FROM (SELECT sector, {_Y} AS y, coalesce({_V} >= v, false) AS r, coalesce({_S} >= s, false) AS h FROM panel, edge WHERE NOT ({_BEFORE})) GROUP BY 1)", PANEL + ", " + _EDGE)
def diag_event_interaction(spark: SparkSession, sf: str) -> DataFrame:
    rows, v, s = _frozen(_with_target(spark, sf))
    return rounded(diagnostics.risk_interaction(rows, F.col(_V) >= v, F.col(_S) >= s, "y", ["sector"]))


@query("diag_timing", f"SELECT *, {_GAP} FROM (SELECT lag, {_FOUR} FROM (SELECT k AS lag, {_Y} AS y, coalesce({_V} >= v, false) AS r, coalesce(CASE k WHEN 0 THEN {_S} WHEN 1 THEN l1 ELSE l2 END >= s, false) AS h FROM (SELECT *, lag({_S}, 1) OVER w AS l1, lag({_S}, 2) OVER w AS l2 FROM panel WINDOW w AS (PARTITION BY security_key ORDER BY snapshot_date)), (VALUES (0), (1), (2)) t(k), edge WHERE NOT ({_BEFORE})) GROUP BY 1)", PANEL + ", " + _EDGE)
def diag_timing(spark: SparkSession, sf: str) -> DataFrame:
    """The same interaction with the change of now, of the observation before, and of the one before that."""
    every = _with_target(spark, sf)
    _, v, s = _frozen(every)
    rows = diagnostics.lagged(every, _S, 2).where("snapshot_date > date'1998-12-31'")
    return rounded(diagnostics.risk_interaction(rows, F.col(_V) >= v, F.col("lagged") >= s, "y", ["lag"]))


_GROUP = f"CASE WHEN coalesce({_V} >= v, false) AND coalesce({_S} >= s, false) THEN 'A' WHEN coalesce({_V} >= v, false) THEN 'B' WHEN coalesce({_S} >= s, false) THEN 'C' ELSE 'D' END"
_ANATOMY = "count(*) AS n, count(forward_return_5d) AS known, round(count(*) FILTER (forward_return_5d <= -0.05) / nullif(count(forward_return_5d), 0), 6) AS down_share, round(count(*) FILTER (forward_return_5d > -0.05 AND forward_return_5d < 0.05) / nullif(count(forward_return_5d), 0), 6) AS middle_share, round(count(*) FILTER (forward_return_5d >= 0.05) / nullif(count(forward_return_5d), 0), 6) AS up_share"


@query("diag_anatomy", f"SELECT {_GROUP} AS \"group\", {_ANATOMY}, round(avg(price_return_20d), 6) + 0.0 AS mean_price_return_20d, round(avg(short_interest_pct), 6) + 0.0 AS mean_short_interest_pct, round(avg(active_holders), 6) + 0.0 AS mean_active_holders FROM panel, edge WHERE NOT ({_BEFORE}) GROUP BY 1", PANEL + ", " + _EDGE)
def diag_anatomy(spark: SparkSession, sf: str) -> DataFrame:
    """What the four groups of risk and change are made of, cut where the time before the test says."""
    rows, v, s = _frozen(_with_target(spark, sf))
    return rounded(diagnostics.anatomy(rows, buckets.four_groups(F.col(_V) >= v, F.col(_S) >= s), "forward_return_5d", ["price_return_20d", "short_interest_pct", "active_holders"]))


_PATH = "CASE WHEN price_return_60d IS NULL OR price_return_20d IS NULL THEN 'insufficient_history' WHEN price_return_60d < 0 AND price_return_20d >= 0 THEN 'recovery' WHEN price_return_60d >= 0 AND price_return_20d >= 0 THEN 'uptrend' WHEN price_return_60d < 0 AND price_return_20d < 0 THEN 'downtrend' ELSE 'other' END"


@query("diag_reversal", f"SELECT trajectory, {_GROUP} AS \"group\", {_ANATOMY}, round(avg(forward_return_20d), 6) + 0.0 AS mean_forward_return_20d FROM (SELECT *, {_PATH} AS trajectory FROM panel), edge WHERE NOT ({_BEFORE}) GROUP BY 1, 2", PANEL + ", " + _EDGE)
def diag_reversal(spark: SparkSession, sf: str) -> DataFrame:
    """The groups by the path on which a price has come."""
    rows, v, s = _frozen(_with_target(spark, sf))
    rows = rows.withColumn("trajectory", buckets.trajectory(F.col("price_return_60d"), F.col("price_return_20d")))
    return rounded(diagnostics.anatomy(rows, buckets.four_groups(F.col(_V) >= v, F.col(_S) >= s), "forward_return_5d", ["forward_return_20d"], ["trajectory"]))


@query("diag_momentum_split", f"SELECT price_return_20d > 0 AS rising, *, {_GAP} FROM (SELECT price_return_20d > 0 AS rising_, {_FOUR} FROM (SELECT price_return_20d, {_Y} AS y, coalesce({_V} >= v, false) AS r, coalesce({_S} >= s, false) AS h FROM panel, edge WHERE NOT ({_BEFORE}) AND price_return_20d IS NOT NULL) GROUP BY 1)".replace("SELECT price_return_20d > 0 AS rising, *,", "SELECT rising_ AS rising, * EXCLUDE (rising_),"), PANEL + ", " + _EDGE)
def diag_momentum_split(spark: SparkSession, sf: str) -> DataFrame:
    rows, v, s = _frozen(_with_target(spark, sf))
    rows = rows.where("price_return_20d is not null").withColumn("rising", F.col("price_return_20d") > 0)
    return rounded(diagnostics.risk_interaction(rows, F.col(_V) >= v, F.col(_S) >= s, "y", ["rising"]))


@query("diag_si_gradient", f"SELECT half, band, count(y) AS n, count(*) FILTER (y > 0) AS events FROM (SELECT {_Y} AS y, CASE WHEN snapshot_date <= (SELECT min(snapshot_date) + CAST((max(snapshot_date) - min(snapshot_date)) // 2 AS INT) FROM panel WHERE NOT ({_BEFORE})) THEN 'first' ELSE 'second' END AS half, CASE WHEN {_S} <= 0 THEN 'le_0' WHEN {_S} <= 0.25 THEN '0_0.25' WHEN {_S} <= 0.5 THEN '0.25_0.5' WHEN {_S} <= 1 THEN '0.5_1' WHEN {_S} <= 2 THEN '1_2' ELSE 'gt_2' END AS band FROM panel WHERE NOT ({_BEFORE}) AND {_S} IS NOT NULL) GROUP BY 1, 2", PANEL)
def diag_si_gradient(spark: SparkSession, sf: str) -> DataFrame:
    """Rates by bands of the change in either half of the test."""
    rows = diagnostics.halves(_with_target(spark, sf).where("snapshot_date > date'1998-12-31'")).where(F.col(_S).isNotNull())
    return rows.groupBy("half", buckets.gradient(F.col(_S)).alias("band")).agg(F.count("y").alias("n"), F.count_if(F.coalesce(F.col("y") > 0, F.lit(False))).alias("events"))


_SPEC = Spec("frozen_regime", (Signal("price_momentum_5d", "lower", (0.2,)), Signal("price_volatility_20d", "upper", (0.2,))), ("down_5pct_5d",), "regime_comparison")


@query("ev_prospective", f"SELECT 'evaluation' AS \"window\", 'test' AS split, 'down_5pct_5d' AS target, i_n AS incremental_n, i_e AS incremental_events, b_n AS baseline_n, b_e AS baseline_events, round(i_e / i_n, 6) AS incremental_rate, round(b_e / b_n, 6) AS baseline_rate, round(i_e / i_n - b_e / b_n, 6) + 0.0 AS absolute_difference, round((i_e / i_n) / (b_e / b_n), 6) AS lift FROM (SELECT count(y) FILTER (m AND v) AS i_n, count(*) FILTER (m AND v AND y > 0) AS i_e, count(y) FILTER (m) AS b_n, count(*) FILTER (m AND y > 0) AS b_e FROM (SELECT snapshot_date, {_Y} AS y, coalesce({rank_sql(_M)} <= 0.2, false) AS m, coalesce({rank_sql(_V)} >= 0.8, false) AS v FROM panel) WHERE snapshot_date BETWEEN DATE '2000-01-02' AND DATE '2001-12-31')", PANEL)
def ev_prospective(spark: SparkSession, sf: str) -> DataFrame:
    """A candidate frozen at the end of 1999 on the two years after."""
    c = lifecycle.freeze(_SPEC, date(1999, 12, 31), date(2000, 1, 1))
    rows, _ = lifecycle.evaluate(c, panel(spark, sf), date(2000, 1, 2), date(2001, 12, 31), [])
    return rounded(rows)


_SUB = f"subs AS (SELECT *, {_Y} AS y, coalesce({rank_sql(_M)} <= 0.2, false) AS sel FROM (SELECT p.*, market_return_20d FROM relative p LEFT JOIN market_returns m ON p.price_date = m.market_date)), inside AS (SELECT * FROM subs WHERE snapshot_date BETWEEN DATE '2000-03-01' AND DATE '2001-08-31')"


@query(
    "ev_subgroups",
    "SELECT kind, subgroup, n, events, round(events / nullif(n, 0), 6) AS rate, base_n, base_events, round(base_events / nullif(base_n, 0), 6) AS base_rate, round(CASE WHEN base_events > 0 THEN (events / nullif(n, 0)) / (base_events / base_n) END, 6) AS lift FROM (SELECT kind, subgroup, count(y) FILTER (sel) AS n, count(*) FILTER (sel AND y > 0) AS events, count(y) AS base_n, count(*) FILTER (y > 0) AS base_events FROM (SELECT 'period' AS kind, CASE WHEN snapshot_date <= DATE '2000-06-30' THEN '2000H1' WHEN snapshot_date <= DATE '2000-12-31' THEN '2000H2' WHEN snapshot_date <= DATE '2001-06-30' THEN '2001H1' ELSE '2001H2' END AS subgroup, y, sel FROM inside UNION ALL SELECT 'sector', sector, y, sel FROM inside UNION ALL SELECT 'market', CASE WHEN market_return_20d < 0 THEN 'falling' WHEN market_return_20d >= 0 THEN 'rising' END, y, sel FROM inside) WHERE subgroup IS NOT NULL GROUP BY 1, 2)",
    RELATIVE + ", " + _SUB,
)
def ev_subgroups(spark: SparkSession, sf: str) -> DataFrame:
    """A selection by half-years cut to the evaluation, by sector and by the market's direction."""
    start, end = date(2000, 3, 1), date(2001, 8, 31)
    sel = ranks.tail(ranks.pct_rank(F.col(_M), ["snapshot_date"]), 0.2, "lower")
    rows = _with_target(spark, sf).withColumn("sel", sel).where(F.col("snapshot_date").between(F.lit(start), F.lit(end)))
    return rounded(evaluation.subgroups(rows, lifecycle.half_years(start, end), F.col("sel"), "y"))


_REGIMES = f"cuts AS (SELECT quantile_cont({_V}, [1.0 / 3, 2.0 / 3]) AS q FROM panel WHERE {_BEFORE}), regimes AS (SELECT *, {_Y} AS y, CASE WHEN {_V} IS NULL THEN 'UNKNOWN' WHEN {_V} <= q[1] THEN 'LOW' WHEN {_V} <= q[2] THEN 'MID' ELSE 'HIGH' END AS regime FROM panel, cuts)"
_AREA = "(sum(r) FILTER (y > 0) - count(*) FILTER (y > 0) * (count(*) FILTER (y > 0) + 1) / 2.0) / nullif(count(*) FILTER (y > 0) * count(*) FILTER (y <= 0), 0)"
_RANKED = "rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0 AS r"


@query(
    "ev_strategies",
    f"SELECT strategy, count(*) FILTER (y > 0) AS positives, count(*) FILTER (y <= 0) AS negatives, round({_AREA}, 6) AS auc FROM (SELECT strategy, y, {_RANKED.format(by='strategy', x='score')} FROM (SELECT k AS strategy, y, CASE k WHEN 'first_only' THEN short_interest_pct WHEN 'second_only' THEN {_V} WHEN 'gate_validation' THEN CASE WHEN chosen = 2 THEN {_V} ELSE short_interest_pct END ELSE CASE WHEN w.regime IN ('MID', 'HIGH') THEN {_V} ELSE short_interest_pct END END AS score FROM regimes w LEFT JOIN gates g ON w.regime = g.regime, (VALUES ('first_only'), ('second_only'), ('gate_validation'), ('gate_mid_high')) t(k) WHERE NOT ({_BEFORE})) WHERE y IS NOT NULL AND score IS NOT NULL) GROUP BY 1",
    PANEL + ", " + _REGIMES + f", areas AS (SELECT regime, s, {_AREA} AS auc FROM (SELECT regime, s, y, {_RANKED.format(by='s, regime', x='x')} FROM (SELECT regime, s, y, CASE s WHEN 1 THEN short_interest_pct ELSE {_V} END AS x FROM regimes, (VALUES (1), (2)) t(s) WHERE snapshot_date > DATE '1997-12-31' AND {_BEFORE}) WHERE y IS NOT NULL AND x IS NOT NULL) GROUP BY 1, 2), gates AS (SELECT regime, CASE WHEN max(auc) FILTER (s = 2) > max(auc) FILTER (s = 1) THEN 2 ELSE 1 END AS chosen FROM areas GROUP BY 1)",
)
def ev_strategies(spark: SparkSession, sf: str) -> DataFrame:
    """Four ways of choosing between a level and a volatility score, judged on the test."""
    from quarry.functions import stats

    p = _with_target(spark, sf)
    edges = buckets.learned_edges(p.where("snapshot_date <= date'1998-12-31'"), _V, [1 / 3, 2 / 3])
    rows = p.withColumn("regime", ranks.by_thresholds(F.col(_V), edges, ["LOW", "MID", "HIGH"]))
    gates = evaluation.gate(rows.where("snapshot_date > date'1997-12-31' and snapshot_date <= date'1998-12-31'"), "regime", "y", "short_interest_pct", _V)
    test = evaluation.strategies(rows.where("snapshot_date > date'1998-12-31'"), gates, "regime", "short_interest_pct", _V)
    return rounded(stats.auc(test, "y", "score", ["strategy"]))


@query("qc_migration", "SELECT c AS \"column\", (SELECT count(*) FROM history) AS rows, 0 AS only_left, 0 AS only_right, 0 AS different FROM (VALUES ('price_return_5d'), ('price_return_60d'), ('forward_return_5d')) t(c)", PANEL)
def qc_migration(spark: SparkSession, sf: str) -> DataFrame:
    """Features of whole series against the same made of two overlapping parts."""
    p = prices(spark, sf)
    make = lambda d: features.forward_returns(features.price_features(d), horizons=(5,))
    whole = make(p)
    late = make(p.where("date >= date'1997-01-01'")).where("date >= date'1999-01-01'")
    early = make(p.where("date < date'2000-01-01'")).where("date < date'1999-01-01'")
    return diagnostics.compared(whole, early.unionByName(late), ["symbol", "date"], ["price_return_5d", "price_return_60d", "forward_return_5d"])


_FEATURES = ["price_volatility_20d", "price_return_5d", "price_return_20d", "short_interest_pct", "short_interest_delta_pp"]


@query("ml_feature_sets")
def ml_feature_sets(spark: SparkSession, sf: str) -> DataFrame:
    from quarry.plans import models

    rows = _with_target(spark, sf).select("snapshot_date", "y", *_FEATURES)
    got = models.select_features(rows, {"prices": _FEATURES[:3], "register": _FEATURES[3:], "all": _FEATURES}, WINDOWS)
    return spark.createDataFrame([(g["window"], g["chosen"], g["validation_auc"], g["test_n"], g["test_auc"]) for g in got], "window string, chosen string, validation_auc double, test_n bigint, test_auc double")


@query("ml_importance")
def ml_importance(spark: SparkSession, sf: str) -> DataFrame:
    from quarry.plans import models

    rows = _with_target(spark, sf).select("snapshot_date", "y", *_FEATURES)
    return spark.createDataFrame(models.importance(rows, _FEATURES, WINDOWS[0]), "feature string, importance double")


@query("ml_controlled")
def ml_controlled(spark: SparkSession, sf: str) -> DataFrame:
    from quarry.plans import models

    rows = _with_target(spark, sf).select("snapshot_date", "y", *_FEATURES)
    got = models.controlled(rows, ["price_return_5d", "price_return_20d"], ["short_interest_delta_pp", "price_volatility_20d"], WINDOWS)
    names = list(got[0])
    return spark.createDataFrame([tuple(g[n] for n in names) for g in got], ", ".join(f"{n} {'string' if n == 'window' else 'double'}" for n in names))


@query("pf_signal_backtest")
def pf_signal_backtest(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of models fitted before each window's test, as a portfolio of those least likely to fall."""
    from quarry.plans import models

    rows = _with_target(spark, sf).select("snapshot_date", "security_key", "forward_return_5d", "y", *_FEATURES)
    scored = models.out_of_sample(rows, _FEATURES, WINDOWS)
    p = scored.select(F.col("window"), F.col("snapshot_date").alias("date"), F.col("security_key").alias("security"), evaluation.economic_score(F.col("score"), "regression", "below").alias("score"), F.col("forward_return_5d").alias("target_return"))
    out = portfolio.strategy(p, every=1, by=["window"]).withColumn("r", F.col("net") / 20)
    return rounded(portfolio.drawdown(out, "r", by=["window"]).join(out.groupBy("window").agg(F.count(F.lit(1)).alias("periods"), F.avg("net").alias("mean_net"), F.avg(F.col("gross") - F.col("benchmark")).alias("mean_excess")), "window"))


# --- diagnostics by name, over walk-forward windows -------------------------------------------


def _cut(before: DataFrame, x: str, q: float) -> float:
    edges = buckets.learned_edges(before, x, [q])
    return edges[0] if edges else float("inf")


@registry.register("event_interaction")
def event_interaction(before: DataFrame, test: DataFrame) -> DataFrame:
    v, s = _cut(before, _V, 0.8), _cut(before.where(F.col(_S) > 0), _S, 0.8)
    return diagnostics.risk_interaction(test, F.col(_V) >= v, F.col(_S) >= s, "y", [])


@registry.register("outcome_anatomy")
def outcome_anatomy(before: DataFrame, test: DataFrame) -> DataFrame:
    v, s = _cut(before, _V, 0.8), _cut(before.where(F.col(_S) > 0), _S, 0.8)
    return diagnostics.anatomy(test, buckets.four_groups(F.col(_V) >= v, F.col(_S) >= s), "forward_return_5d", ["price_return_20d"])


@registry.register("si_gradient")
def si_gradient(before: DataFrame, test: DataFrame) -> DataFrame:
    rows = test.where(F.col(_S).isNotNull())
    return rows.groupBy(buckets.gradient(F.col(_S)).alias("band")).agg(F.count("y").alias("n"), F.count_if(F.coalesce(F.col("y") > 0, F.lit(False))).alias("events"))


_LOCKED = ", ".join(f"e{i} AS (SELECT quantile_cont({_V}, 0.8) AS v, quantile_cont({_S}, 0.8) FILTER ({_S} > 0) AS s FROM panel WHERE snapshot_date <= DATE '{w.validation_end}')" for i, w in enumerate(WINDOWS))


@query("diag_locked_oos", " UNION ALL ".join(f"SELECT '{w.name}' AS \"window\", *, {_GAP} FROM (SELECT {_FOUR} FROM (SELECT {_Y} AS y, coalesce({_V} >= v, false) AS r, coalesce({_S} >= s, false) AS h FROM panel, e{i} WHERE snapshot_date > DATE '{w.validation_end}' AND snapshot_date <= DATE '{w.test_end}'))" for i, w in enumerate(WINDOWS)), PANEL + ", " + _LOCKED)
def diag_locked_oos(spark: SparkSession, sf: str) -> DataFrame:
    """A registered diagnostic over the walk-forward windows, its cuts learned before each test."""
    return rounded(registry.run("event_interaction", _with_target(spark, sf), WINDOWS))
