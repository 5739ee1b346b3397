"""Small fixtures worked out by hand."""

import math
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry.functions import parse, ranks, stats, text
from quarry.operators import asof, buckets, diagnostics, features, identity, inference, portfolio, qc, replay, series
from quarry.plans import lifecycle, research
from quarry.plans.spec import Signal, Spec, SpecError, Window, expression, from_dict, load, load_all

D = date(2024, 1, 1)


def day(n):
    return D + timedelta(n)


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


# --- parsing and text ------------------------------------------------------------------------


@pytest.mark.parametrize(("s", "want"), [("1,5 %", 1.5), ("0.7", 0.7), ("<0,5", 0.0), ("", 0.0), (None, 0.0), ("x", 0.0), ("NaN", 0.0)])
def test_position(spark, s, want):
    assert one(spark, parse.position(F.lit(s).cast("string"))) == want


@pytest.mark.parametrize(("s", "want"), [("1.234,56", 1234.56), ("1,234.56", 1234.56), ("12,5", 12.5), ("1 234", 1234.0), ("-3.5%", -3.5), ("a", None), ("", None), (None, None)])
def test_number(spark, s, want):
    assert one(spark, parse.number(F.lit(s).cast("string"))) == want


@pytest.mark.parametrize(("s", "want"), [("2024-02-29", date(2024, 2, 29)), ("29.02.2024", date(2024, 2, 29)), ("20240229", date(2024, 2, 29)), ("2024-02-30", None), ("2025-01-01", None), ("x", None)])
def test_date(spark, s, want):
    assert one(spark, parse.date(F.lit(s), F.lit("2024-12-31").cast("date"))) == want


def test_text_keys(spark):
    assert one(spark, text.security_key(F.lit(" se-01 "), F.lit("x"))) == "ISIN:SE 01"
    assert one(spark, text.security_key(F.lit(" "), F.lit("Åb & Co."))) == "ISSUER:ÅB CO"
    assert one(spark, text.squeezed(F.lit("  a.b   c "))) == "A.B C"
    assert one(spark, text.code(F.lit(" se 00 1"))) == "SE001"
    assert one(spark, text.company(F.lit("Éxample Publ AB"))) == "example"


# --- ranks -----------------------------------------------------------------------------------


def _frame(spark, values):
    return spark.createDataFrame([(D, i, v) for i, v in enumerate(values)], "d date, k long, x double")


def test_pct_rank_matches_average_ties(spark):
    df = _frame(spark, [1.0, 2.0, 2.0, 5.0, None, math.nan, math.inf])
    got = [r["r"] for r in df.select("k", ranks.pct_rank(F.col("x"), ["d"]).alias("r")).orderBy("k").collect()]
    assert got == [0.25, 0.625, 0.625, 1.0, None, None, None]


def test_tails_are_asymmetric(spark):
    df = _frame(spark, [float(i) for i in range(10)]).withColumn("r", ranks.pct_rank(F.col("x"), ["d"]))
    n = df.agg(F.count_if(ranks.tail(F.col("r"), 0.2, "upper")), F.count_if(ranks.tail(F.col("r"), 0.2, "lower"))).first()
    assert tuple(n) == (3, 2)
    with pytest.raises(ValueError):
        ranks.tail(F.col("r"), 0.0, "upper")


def test_decile_formulas_differ(spark):
    df = _frame(spark, [float(i) for i in range(7)] + [None])
    rows = df.select("k", ranks.deciles(F.col("x"), ["d"], ["k"]).alias("c"), ranks.groups_floor(F.col("x"), ["d"], ["k"], 7).alias("f"), ranks.groups_floor(F.col("x"), ["d"], ["k"], 10).alias("few")).orderBy("k").collect()
    assert [r["c"] for r in rows] == [1, 2, 4, 5, 7, 8, 9, -1]
    assert [r["f"] for r in rows] == [1, 2, 3, 4, 5, 6, 6, -1]
    assert {r["few"] for r in rows} == {-1}


def test_bands_partition(spark):
    df = _frame(spark, [float(i) for i in range(40)]).withColumn("r", ranks.pct_rank(F.col("x"), ["d"]))
    got = {r["b"]: r["count"] for r in df.groupBy(ranks.bands(F.col("r"), [0.5, 0.1, 1.0], "lower").alias("b")).count().collect()}
    assert got == {"lower_0_0.1": 4, "lower_0.1_0.5": 16, "lower_0.5_1": 20}


def test_ranks_equal_pandas(spark):
    r = np.random.default_rng(0)
    pdf = pd.DataFrame({"d": r.integers(0, 4, 300), "k": range(300), "x": r.integers(0, 30, 300).astype(float)})
    pdf.loc[r.integers(0, 300, 20), "x"] = None
    got = spark.createDataFrame(pdf).select("k", F.round(ranks.pct_rank(F.col("x"), ["d"]), 12).alias("r")).toPandas().set_index("k").sort_index()["r"]
    want = pdf.groupby("d")["x"].rank(pct=True)
    assert np.allclose(got, want, equal_nan=True)


# --- as-of and intervals ---------------------------------------------------------------------


def test_forward_asof(spark):
    left = spark.createDataFrame([("a", day(0)), ("a", day(2)), ("a", day(3)), ("a", day(9)), ("b", day(0)), (None, day(0)), ("a", None), ("a", day(2))], "k string, s date")
    right = spark.createDataFrame([("a", day(2), 1.0), ("a", day(5), 2.0), ("a", day(5), 3.0), (None, day(3), 9.0)], "k string, p date, v double")
    got = asof.forward(left, right, "k", "s", "p", ["v"]).collect()
    assert sorted((r["k"] or "", str(r["s"]), r["v"]) for r in got if r["v"]) == [("a", str(day(0)), 1.0), ("a", str(day(2)), 1.0), ("a", str(day(2)), 1.0), ("a", str(day(3)), 2.0)]
    assert len(got) == 8 and sum(r["v"] is None for r in got) == 4


def test_fallback_only_without_series(spark):
    left = spark.createDataFrame([("x", "e", day(0)), ("y", "e", day(0)), ("x", "e", day(8)), ("n", "m", day(0))], "a string, b string, s date")
    right = spark.createDataFrame([("x", day(1), 1.0), ("e", day(9), 2.0)], "key string, p date, v double")
    got = {(r["a"], r["s"]): (r["match"], r["v"]) for r in asof.forward_with_fallback(left, right, ["a", "b"], ["exact", "entity"], "s", "p", ["v"]).collect()}
    assert got == {("x", day(0)): ("exact", 1.0), ("y", day(0)): ("entity", 2.0), ("x", day(8)): ("unmatched", None), ("n", day(0)): ("unmatched", None)}


def test_temporal_ends_are_inclusive(spark):
    left = spark.createDataFrame([("a", day(i)) for i in range(5)], "k string, d date")
    dim = spark.createDataFrame([("a", day(1), day(3), 1), ("a", day(4), None, 2)], "k string, valid_from date, valid_to date, e int")
    assert sorted((r["d"], r["e"]) for r in asof.temporal(left, dim, "k", "d").collect()) == [(day(1), 1), (day(2), 1), (day(3), 1), (day(4), 2)]


# --- features --------------------------------------------------------------------------------


def test_severity_short_tail_and_ties(spark):
    p = spark.createDataFrame([("s", day(i), v) for i, v in enumerate([10.0, 8.0, 12.0, 8.0, 12.0, 9.0, 9.0])], "symbol string, date date, close double")
    rows = features.severity(p).orderBy("date").collect()
    assert (round(rows[0]["min_return_5d"], 6), rows[0]["min_return_5d_date"], round(rows[0]["max_return_5d"], 6), rows[0]["max_return_5d_date"]) == (-0.2, day(1), 0.2, day(2))
    assert rows[1]["min_return_5d"] is not None and rows[2]["min_return_5d"] is None
    holes = p.withColumn("close", F.when(F.col("date") == day(2), None).otherwise(F.col("close")))
    assert features.severity(holes).orderBy("date").first()["min_return_5d"] is None


def test_threshold_flags(spark):
    df = spark.createDataFrame([("k", day(i), v) for i, v in enumerate([None, 2.0, 3.0, 2.9, None, 5.0])], "security_key string, snapshot_date date, short_interest_pct double")
    rows = features.observation_features(df).orderBy("snapshot_date").collect()
    assert [r["above_3_0pct"] for r in rows] == [False, False, True, False, False, True]
    assert [r["entered_above_3_0pct"] for r in rows] == [False, False, True, False, False, False]
    assert [r["exited_below_3_0pct"] for r in rows] == [False, False, False, True, False, False]


def test_volatility_and_momentum_equal_pandas(spark):
    r = np.random.default_rng(1)
    close = 100 * np.exp(np.cumsum(r.normal(size=90) * 0.02))
    df = spark.createDataFrame([("s", day(i), float(c)) for i, c in enumerate(close)], "symbol string, date date, close double")
    got = features.price_features(df).orderBy("date").toPandas()
    s = pd.Series(close)
    assert np.allclose(got["price_volatility_20d"].astype(float), s.pct_change().rolling(20, min_periods=2).std(), equal_nan=True)
    assert np.allclose(got["price_return_20d"].astype(float), s / s.shift(20) - 1, equal_nan=True)
    assert np.allclose(got["price_distance_from_20d_high"].astype(float), s / s.rolling(21, min_periods=1).max() - 1)
    assert got["price_volatility_60d"].notna().sum() == 30


def test_incremental(spark):
    have = spark.createDataFrame([("a", day(0), 1.0), ("a", day(1), None), ("b", day(0), 2.0)], "k string, d date, v double")
    fresh = spark.createDataFrame([("a", day(1)), ("a", day(2)), ("c", day(0))], "k string, d date")
    assert sorted((r["k"], r["d"]) for r in features.new_rows(fresh, have, ["k", "d"]).collect()) == [("a", day(2)), ("c", day(0))]
    assert [(r["k"], r["d"]) for r in features.context_rows(have, fresh, "k", "d").collect()] == [("a", day(0))]
    again = spark.createDataFrame([("a", day(1), 7.0), ("b", day(0), 9.0)], "k string, d date, v double")
    assert {(r["k"], r["d"]): r["v"] for r in features.refresh_incomplete(have, again, ["k", "d"], ["v"]).collect()} == {("a", day(0)): 1.0, ("a", day(1)): 7.0, ("b", day(0)): 2.0}


def test_guards(spark):
    df = spark.createDataFrame([(1, 2), (1, 3)], "a int, b int")
    with pytest.raises(ValueError):
        features.require_unique(df, ["a"], "x")
    with pytest.raises(ValueError):
        features.require_columns(df, {"a", "c"}, "x")
    assert qc.leaking(["a", "forward_return_5d", "x"], ("x",)) == ["forward_return_5d", "x"]


# --- replay ----------------------------------------------------------------------------------


def test_replay(spark):
    rows = [("h1", "A", "I1", day(0), 1.0, 0), ("h2", "A", "I1", day(0), 3.0, 1), ("h1", "A", "I1", day(2), 0.0, 2), ("h1", "A", "I1", day(2), 0.5, 3), ("h2", "A new", "I1", day(3), 2.0, 4), ("h3", "B", " ", day(1), 0.7, 5), ("h2", "A new", "I1", day(5), 0.0, 6)]
    log = replay.load_log(spark.createDataFrame(rows, "holder string, issuer string, isin string, position_date date, position double, n int"), ["n"]).drop("n")
    got = {(r["snapshot_date"], r["issuer"]): (r["short_interest_pct"], r["active_holders"]) for r in replay.replay(log, str(day(1))).collect()}
    assert got == {
        (day(1), "A"): (4.0, 2), (day(1), "B"): (0.7, 1), (day(2), "A"): (3.5, 2), (day(2), "B"): (0.7, 1), (day(3), "A"): (0.5, 1), (day(3), "A new"): (2.0, 1), (day(3), "B"): (0.7, 1), (day(5), "A"): (0.5, 1), (day(5), "B"): (0.7, 1),
    }
    assert replay.replay(log.limit(0)).count() == 0


def test_streaming_replay_equals_batch(spark, tmp_path):
    from quarry.streaming.replay import totals

    rows = [("h1", "A", "A", "A", day(0), 1.0), ("h2", "A", "A", "A", day(1), 3.0), ("h1", "A", "A", "A", day(2), 0.0), ("h3", "B", "B", "B", day(1), 0.7)]
    log = spark.createDataFrame(rows, "holder string, issuer string, isin string, issuer_key string, position_date date, position double")
    for i in range(3):
        log.where(F.col("position_date") == day(i)).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    q = totals(stream).writeStream.format("memory").queryName("replayed").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["issuer_key"], r["snapshot_date"]): (r["short_interest_pct"], r["active_holders"]) for r in spark.table("replayed").collect()}
    assert got == {("A", day(0)): (1.0, 1), ("A", day(1)): (4.0, 2), ("A", day(2)): (3.0, 1), ("B", day(1)): (0.7, 1)}


# --- series ----------------------------------------------------------------------------------


def test_greedy_spacing(spark):
    df = spark.createDataFrame([("s", day(i)) for i in (0, 29, 31, 45, 60, 61)], "symbol string, date date")
    assert sorted(r["date"] for r in series.spaced(df, ["symbol"]).collect()) == [day(0), day(31), day(61)]


def test_holidays(spark):
    assert series.easter(2024) == date(2024, 3, 31) and series.easter(2000) == date(2000, 4, 23)
    assert {date(2024, 3, 29), date(2024, 4, 1), date(2024, 5, 9), date(2024, 6, 22), date(2024, 11, 2)} <= series.swedish_holidays(2024)
    days = [r["day"] for r in series.business_days(spark, date(2023, 12, 22), date(2024, 1, 3)).orderBy("day").collect()]
    assert days == [date(2023, 12, d) for d in (22, 27, 28, 29)] + [date(2024, 1, 2), date(2024, 1, 3)]


# --- identity --------------------------------------------------------------------------------


def test_resolve_prefers_trusted_codes(spark):
    none = None
    aliases = spark.createDataFrame([("E1", "I1", "N", none, none), ("E2", "I2", "N", none, none), ("E3", "I3", "M", day(0), day(1)), ("E4", "I3", "K", none, none)], "entity_id string, isin string, issuer string, valid_from date, valid_to date")
    rows = spark.createDataFrame([(1, "I1", "M", day(0)), (2, None, "N", day(0)), (3, None, "M", day(1)), (4, None, "M", day(2)), (5, "I3", "M", day(1)), (6, "I9", "K", day(0))], "id long, isin string, issuer string, d date")
    got = {r["id"]: (r["entity_id"], r["identity_resolution"]) for r in identity.resolve(rows, aliases, "id", "d").collect()}
    assert got == {1: ("E1", "isin"), 2: (None, "ambiguous_issuer"), 3: ("E3", "issuer"), 4: (None, "unresolved"), 5: (None, "ambiguous_isin"), 6: ("E4", "issuer")}


# --- statistics ------------------------------------------------------------------------------


def test_event_rates_keep_or_drop_nulls(spark):
    df = spark.createDataFrame([(1.0,), (0.0,), (None,), (None,)], "y double")
    for mode, want in (("finite", (2, 1, 0.5)), ("all", (4, 1, 0.25))):
        assert tuple(df.agg(*stats.rate(F.col("y"), mode=mode)).first()) == want


def test_auc(spark):
    r = np.random.default_rng(2)
    y, s = r.integers(0, 2, 200), r.integers(0, 20, 200) / 10
    want = np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]])
    df = spark.createDataFrame([("g", float(a), float(b)) for a, b in zip(y, s, strict=True)] + [("h", 1.0, 1.0)], "g string, y double, s double")
    got = {r["g"]: r["auc"] for r in stats.auc(df, "y", "s", ["g"]).collect()}
    assert abs(got["g"] - want) < 1e-12 and got["h"] is None


def test_seed_and_bootstrap():
    assert inference.stable_seed("a", 1) == inference.stable_seed("a", 1) != inference.stable_seed("a", 2)
    x = np.random.default_rng(0).normal(size=400)
    low, high = inference.bootstrap_mean(x, 1)
    assert low < x.mean() < high and (low, high) == inference.bootstrap_mean(x[::-1], 1)
    assert inference.bootstrap_mean(x[:19], 1) == (None, None)
    low, high = inference.rates_from_counts([(50, 100), (20, 100)], [1, -1], 3)
    assert low < 0.3 < high and high - low < 0.4
    assert inference.rates_from_counts([(0, 0), (1, 2)], [1, -1], 3) == (None, None)
    draws = inference.joint_cells({(1, 1): (30, 60), (1, 0): (10, 50), (0, 1): (20, 50), (0, 0): (5, 40)}, 4)
    assert abs(draws.mean() - (0.5 - 0.2 - 0.4 + 0.125)) < 0.02


def test_wilson(spark):
    low, high = spark.range(1).select(*stats.wilson(F.lit(5), F.lit(10))).first()
    assert abs(low - 0.236593) < 1e-6 and abs(high - 0.763407) < 1e-6
    assert tuple(spark.range(1).select(*stats.wilson(F.lit(0), F.lit(0))).first()) == (None, None)


# --- specifications --------------------------------------------------------------------------

W = [Window("w", "2024-01-10", "2024-01-20", "2024-01-30")]


def test_specs_are_checked():
    good = {"id": "a", "signals": [{"name": "price_momentum_5d"}], "targets": ["down_5pct_5d"], "analysis": {"type": "tail"}}
    assert from_dict(good).signals[0].bins == (0.1,)
    for change in ({"id": ""}, {"analysis": {"type": "x"}}, {"analysis": {"type": "interaction"}}, {"targets": ["x"]}, {"targets": []}, {"mode": "fast"}, {"signals": [{"name": "a", "direction": "up"}]}, {"signals": [{"name": "a", "bins": [0]}]}, {"splits": ["later"]}):
        with pytest.raises(SpecError):
            from_dict({**good, **change})
    with pytest.raises(SpecError):
        load_all(["{id: a, signals: [{name: x}], targets: [down_5pct_5d], analysis: {type: tail}}"] * 2)
    with pytest.raises(SpecError):
        load("[1]")


def test_derived_expressions(spark):
    df = spark.createDataFrame([(25.0, 100.0, 40.0, 0.0)], "a double, b double, c double, z double")
    names = {k: F.col(k) for k in "abcz"}
    val = lambda t: df.select(expression(t, names).alias("v")).first()["v"]
    assert (val("a / b"), val("c / b"), round(val("c / b - a / b"), 9), round(val("(c / b) / (a / b)"), 9)) == (0.25, 0.4, 0.15, 1.6)
    assert val("a / z") is None and val("-a + +b * 2") == 175.0
    for bad in ("f(a)", "a.b", "a ** b", "'x'", "True", "q", "a if b else c", "a +"):
        with pytest.raises(SpecError):
            expression(bad, names)


def _panel(spark, n=600):
    r = np.random.default_rng(5)
    rows = [(day(i % 30), *(float(v) for v in r.normal(size=3)), float(r.normal() * 0.1) if i % 17 else None) for i in range(n)]
    return spark.createDataFrame(rows, "snapshot_date date, price_return_5d double, price_return_60d double, price_volatility_20d double, forward_return_5d double")


def test_interaction_cells_add_up(spark):
    spec = Spec("x", (Signal("price_momentum_5d", "lower", (0.3,)), Signal("price_volatility_20d", "upper", (0.3,))), ("down_5pct_5d",), "interaction", splits=("validation", "test"))
    p = _panel(spark)
    rows = research.run(p, spec, W).collect()
    n = {r["s"]: r["n"] for r in research.in_windows(p, W, ("validation", "test")).groupBy(F.col("split").alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert {r["split"]: sum(r[f"{c}_n"] for c in ("p11", "p10", "p01", "p00")) for r in rows} == n


def test_every_analysis_runs(spark):
    two = (Signal("price_momentum_5d", "lower", (0.2, 0.5, 1.0)), Signal("price_momentum_60d", "lower", (0.2, 0.5, 1.0)))
    three = (*two, Signal("price_volatility_20d", "upper", (0.2,)))
    specs = [Spec(a, s, ("down_5pct_5d", "down_10pct_5d"), a) for a, s in (("tail", three), ("interaction", two), ("regime_comparison", two), ("multi_regime_comparison", three), ("nested_regime_comparison", three), ("conditional_regime_comparison", two), ("stratified_regime_comparison", three), ("stratified_interaction", three))]
    counts = {k: v.count() for k, v in research.run_all(_panel(spark), specs, W).items()}
    assert counts == {"tail": 28, "interaction": 4, "regime_comparison": 4, "multi_regime_comparison": 4, "nested_regime_comparison": 4, "conditional_regime_comparison": 36, "stratified_regime_comparison": 36, "stratified_interaction": 28}
    assert research.tails_needed(specs[:2]) == {("price_momentum_5d", "lower", b) for b in (0.2, 0.5, 1.0)} | {("price_momentum_60d", "lower", b) for b in (0.2, 0.5, 1.0)} | {("price_volatility_20d", "upper", 0.2)}


# --- portfolio -------------------------------------------------------------------------------


@pytest.mark.parametrize(("n", "want"), [(1, 0.05), (10, 0.05), (20, 0.05), (25, 0.04)])
def test_capped_weights(spark, n, want):
    df = spark.createDataFrame([(0, str(i)) for i in range(n)], "period int, security string")
    assert {round(r["weight"], 9) for r in portfolio.weights(df, ["period"]).collect()} == {want}


def test_turnover_and_losses(spark):
    held = spark.createDataFrame([(0, "a", 0.5), (0, "b", 0.5), (1, "a", 0.5), (1, "c", 0.5), (2, "d", 0.2)], "period int, security string, weight double")
    got = {r["period"]: round(r["turnover"], 9) for r in portfolio.turnover(held).collect()}
    assert got == {0: 1.0, 1: 0.5, 2: 1.0}
    r = spark.createDataFrame([(0, 0.1), (1, -0.5), (2, 0.2)], "period int, r double")
    assert abs(r.agg(portfolio.compounded("r")).first()[0] - (1.1 * 0.5 * 1.2 - 1)) < 1e-12
    assert abs(portfolio.drawdown(r, "r").first()["max_drawdown"] + 0.5) < 1e-12
    lost = r.unionAll(spark.createDataFrame([(3, -1.0)], r.schema))
    assert lost.agg(portfolio.compounded("r")).first()[0] == -1.0 and portfolio.drawdown(lost, "r").first()["max_drawdown"] == -1.0


# --- quality ---------------------------------------------------------------------------------


def test_conflicting_prices_empty_the_output(spark):
    df = spark.createDataFrame([("a", 1.0, 0), ("a", 1.0, 1), ("b", 2.0, 2)], "k string, close double, n int")
    clean, conflicts = qc.clean_prices(df, ["k"], "close", ["n"])
    assert clean.count() == 2 and conflicts.count() == 0
    clean, conflicts = qc.clean_prices(df.unionAll(spark.createDataFrame([("b", 3.0, 3)], df.schema)), ["k"], "close", ["n"])
    assert clean.count() == 0 and conflicts.count() == 1


def test_worst_status(spark):
    df = spark.range(3)
    rows = {r["check"]: (r["violations"], r["status"]) for r in qc.worst([qc.check(df, "a", F.count_if(F.col("id") > 5)), qc.check(df, "b", F.count_if(F.col("id") > 1), "WARN")]).collect()}
    assert rows == {"a": (0, "PASS"), "b": (1, "WARN"), "overall": (1, "WARN")}


def test_change_buckets(spark):
    df = spark.createDataFrame([(-0.1,), (0.0,), (0.25,), (0.5,), (1.0,), (None,)], "c double")
    assert [r[0] for r in df.select(buckets.change_bucket(F.col("c"))).collect()] == ["<0", "0-0.25", "0.25-0.5", "0.5-1", ">1", None]


def test_halves(spark):
    df = spark.createDataFrame([(day(0),), (day(2),), (day(3),), (day(4),)], "snapshot_date date")
    assert [r["half"] for r in diagnostics.halves(df).orderBy("snapshot_date").collect()] == ["first", "first", "second", "second"]


# --- lifecycle -------------------------------------------------------------------------------


def test_candidates(spark):
    spec = Spec("c", (Signal("price_momentum_5d"),), ("down_5pct_5d",), "tail")
    c = lifecycle.freeze(spec, date(2024, 1, 1), date(2024, 1, 2))
    assert lifecycle.intact(c)
    lifecycle.separated(c, date(2024, 1, 3), date(2024, 2, 1))
    for bad in ((date(2024, 1, 1), date(2024, 2, 1)), (date(2024, 3, 1), date(2024, 2, 1))):
        with pytest.raises(SpecError):
            lifecycle.separated(c, *bad)
    with pytest.raises(SpecError):
        lifecycle.freeze(spec, date(2024, 1, 1), date(2024, 1, 1))
    assert lifecycle.half_years(date(2024, 3, 1), date(2025, 2, 1)) == [("2024H1", date(2024, 3, 1), date(2024, 6, 30)), ("2024H2", date(2024, 7, 1), date(2024, 12, 31)), ("2025H1", date(2025, 1, 1), date(2025, 2, 1))]
    assert lifecycle.next_candidate([{"a": 1}, {"a": 2}], [{"a": 1}]) == {"a": 2}
    rows = [{"split": "validation", "n": 200, "absolute_difference": v} for v in (0.1, 0.2)]
    assert lifecycle.outcome(rows) == "supported" and lifecycle.outcome(rows[:1]) == "insufficient"
    lifecycle.ordered(W)


# --- sources ---------------------------------------------------------------------------------


def test_sources_and_sinks(spark, tmp_path):
    from quarry.sources import sinks, tables

    for n, lines in enumerate((['{"date": "2024-01-01", "yahoo_symbol": "A", "close": 1.0}', '{"date": "2024-01-01", "yahoo_symbol": "B", "close": -1}'], ['{"date": "2024-01-01", "yahoo_symbol": "A", "close": 2.0}', '{"date": "2024-01-02", "yahoo_symbol": "A", "close": 3.0}'])):
        (tmp_path / f"p{n}.jsonl").write_text("\n".join(lines))
    got = sorted((r["yahoo_symbol"], str(r["date"]), r["close"]) for r in tables.load_prices(spark, str(tmp_path / "p*.jsonl")).collect())
    assert got == [("A", "2024-01-01", 2.0), ("A", "2024-01-02", 3.0)]
    before = sinks.source_fingerprint(spark, str(tmp_path / "p*.jsonl"))
    (tmp_path / "p1.jsonl").write_text("{}")
    after = sinks.source_fingerprint(spark, str(tmp_path / "p*.jsonl"))
    assert [len(v) for v in sinks.changed_sources(before, after).values()] == [0, 0, 1]
    df = spark.createDataFrame([(day(i), float("nan") if i % 2 else 1.0) for i in range(5)], "d date, x double")
    sinks.write_chunks(df, str(tmp_path / "out"), rows=2, order=["d"])
    rows = spark.read.json(str(tmp_path / "out"))
    assert rows.count() == 5 and rows.where("x is null").count() == (3 if "x" not in rows.columns else 2)
    assert sinks.data_fingerprint(df) == sinks.data_fingerprint(df.orderBy(F.desc("d"))) != sinks.data_fingerprint(df.limit(4))
    assert "| a |" in sinks.markdown("t", {"s": [{"a": 1.5}], "n": []})
    assert tables.header_row([["x"], ["Issuer name", "Position %"], ["a", 1]], [["issuer"], ["position"]]) == 1
    assert tables.find_column(["Name of issuer", "ISIN"], ["isin"]) == "ISIN" and tables.find_column(["Name of issuer"], ["issuer"]) == "Name of issuer"
    with pytest.raises(ValueError):
        tables.header_row([["x"]], [["y"]])
    have = spark.createDataFrame([("a", day(3)), ("a", day(5))], "k string, d date")
    want = spark.createDataFrame([("a", day(0), day(9)), ("b", day(0), day(1))], "k string, start date, end date")
    assert sorted((r["k"], r["part"], r["start"], r["end"]) for r in tables.download_intervals(have, want, "k", "d").collect()) == [("a", "backfill", day(0), day(2)), ("a", "update", day(6), day(9)), ("b", "all", day(0), day(1))]
