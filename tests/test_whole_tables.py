"""Order statistics in pieces, intervals from counts, panel checks, stored panels and sinks."""

import functools
import math
import operator
import random
from datetime import date, datetime, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions import stats
from quarry.operators import buckets, diagnostics, features, inference, order, portfolio, qc, replay
from quarry.plans import research
from quarry.plans.spec import SIGNALS, Signal, Spec, SpecError, load
from quarry.queries import build
from quarry.queries.base import WINDOWS, prices
from quarry.queries.research import RELATIVE_SPECS
from quarry.sources import sinks, store, tables


@pytest.fixture(params=[50_000, 7])
def piece(request, monkeypatch):
    monkeypatch.setattr(order, "PIECE", request.param)
    return request.param


def _numbers(spark, n=300, seed=1):
    r = random.Random(seed)
    rows = [(i, round(r.gauss(0, 1), 1), float(r.randrange(3) == 0), r.random()) for i in range(n)] + [(n, None, 1.0, 0.5), (n + 1, float("nan"), 0.0, 0.5)]
    return spark.createDataFrame(rows, "id long, x double, y double, v double"), [t for t in rows if t[1] is not None and t[1] == t[1]]


def test_quantiles_in_pieces(spark, piece):
    df, rows = _numbers(spark)
    wanted = [0.0, 1 / 3, 0.5, 0.95, 1.0]
    got = order.quantiles(df, "x", wanted)
    assert np.allclose(got, np.quantile([t[1] for t in rows], wanted))
    assert order.quantiles(df.where("id < 0"), "x", wanted) == []


def test_only_pieces_that_matter_are_cut(spark, monkeypatch):
    monkeypatch.setattr(order, "PIECE", 10)
    df = spark.range(3000).select((F.col("id") * 7 % 3000 / 2.0).alias("x"))
    cut = order.edges(df, "x", 3000, [1500])
    assert 2 <= len(cut) <= 4 and cut[0] < 749.5 < cut[-1] and len(order.edges(df, "x", 3000)) == 255
    for q in (0.0, 0.001, 0.25, 0.5, 0.7777, 1.0):
        assert order.quantiles(df, "x", [q])[0] == pytest.approx(np.quantile(np.arange(3000) / 2, q), abs=1e-9)
    tied = df.select(F.when(F.col("x") < 1000, 1.0).otherwise(F.col("x")).alias("x"))
    assert order.quantiles(tied, "x", [0.1, 0.5, 0.9]) == pytest.approx([1.0, 1.0, 0.9 * 2999 / 2])


def test_forward_summary_in_pieces(spark, monkeypatch):
    """The middle of all returns is not left to one task."""
    whole = build.feat_forward_summary(spark, "/root/testdata/sf0.001").collect()
    monkeypatch.setattr(order, "PIECE", 50)
    found = build.feat_forward_summary(spark, "/root/testdata/sf0.001")
    assert found.collect() == whole and "median" not in found._jdf.queryExecution().toString()


def test_mean_is_exact(spark):
    r = random.Random(3)
    rows = [(g, r.choice([1, -1]) * r.uniform(0, 10 ** r.randrange(1, 9))) for g in range(60) for _ in range(g % 9 + 1)]
    rows += [(60, None), (61, 1.5), (61, float("nan")), (62, 2.0**50), (62, 2.0**51), (63, None), (63, 2.5)]
    got = {x["g"]: x["m"] for x in spark.createDataFrame(rows, "g long, x double").groupBy("g").agg(stats.mean(F.col("x")).alias("m")).collect()}
    for g in range(60):
        values = [x for k, x in rows if k == g]
        assert got[g] == math.fsum(values) / len(values)
    assert got[60] is None and math.isnan(got[61]) and got[62] == 1.5 * 2.0**50 and got[63] == 2.5


def test_prices_do_not_depend_on_the_order_of_lines(spark, tmp_path):
    """Averages at a half of the fourth digit, which plain sums of another order put on either side."""
    r = random.Random(5)
    four = lambda values: math.floor(functools.reduce(operator.add, values) / len(values) * 10000 + 0.5)
    days = []
    while len(days) < 5:
        lines = [(round(r.uniform(900, 100_000), 2), float(r.choice([2, 4, 5, 8, 16, 20, 25, 40, 50]))) for _ in range(4)] * 2
        values = [p / q for p, q in lines]
        if four(values) != four(values[::-1]) or four(values) != four(sorted(values)):
            days.append(sorted(lines, key=lambda t: t[0] / t[1]) if four(values) != four(sorted(values)) else lines)
    found = []
    for k, way in enumerate((lambda x: x, lambda x: x[::-1], lambda x: x[::2] + x[1::2])):
        rows = [(d, p, q, datetime(1999, 1, 1)) for d, lines in enumerate(days) for p, q in way(lines)]
        spark.createDataFrame(rows, "l_suppkey long, l_extendedprice double, l_quantity double, l_shipdate timestamp").coalesce(1).write.parquet(str(tmp_path / str(k) / "lineitem.parquet"))
        found.append(sorted(map(tuple, prices(spark, str(tmp_path / str(k))).collect())))
    assert found[0] == found[1] == found[2]


def test_top_fractions_in_pieces(spark, piece):
    df, rows = _numbers(spark)
    got = {r["fraction"]: (r["n"], r["mean"]) for r in order.top_fractions(df.where("x is not null and not isnan(x)"), "x", ["id"], [0.001, 0.1, 0.5], "v").collect()}
    best = sorted(rows, key=lambda t: (-t[1], t[0]))
    for f in (0.001, 0.1, 0.5):
        k = max(1, int(np.ceil(len(rows) * f)))
        assert got[f][0] == k and abs(got[f][1] - np.mean([t[3] for t in best[:k]])) < 1e-9
    assert order.top_fractions(df.where("id < 0"), "x", ["id"], [0.1], "v").count() == 0


def test_auc_and_precision_in_pieces(spark, piece):
    df, rows = _numbers(spark)
    df = df.where("x is not null and not isnan(x)")
    y, s = np.array([t[2] for t in rows]), np.array([t[1] for t in rows])
    assert abs(order.auc(df, "y", "x").first()["auc"] - inference.auc_of(y, s)) < 1e-12
    total, hits, seen, at = 0.0, 0, 0, y.sum()
    for v in sorted(set(s), reverse=True):
        here = s == v
        hits, seen = hits + y[here].sum(), seen + here.sum()
        total += y[here].sum() * hits / seen
    assert abs(order.average_precision(df, "y", "x").first()[0] - total / at) < 1e-12
    assert order.auc(df.where("y > 0"), "y", "x").first()["auc"] is None


def test_intervals_from_counts_equal_resampling(spark):
    r = np.random.default_rng(0)
    inside = r.random(400) < 0.3
    y = np.where(inside, r.random(400) < 0.5, r.random(400) < 0.3)
    draws = []
    for _ in range(4000):
        at = r.integers(0, 400, 400)
        draws.append(y[at][inside[at]].mean() - y[at].mean())
    got = inference.nested_from_counts((int(y[inside].sum()), int(inside.sum())), (int(y.sum()), 400), 1, 4000)
    assert np.allclose(got, np.percentile(draws, [2.5, 97.5]), atol=0.012)
    assert inference.nested_from_counts((0, 0), (3, 9), 1) == (None, None)
    spread = inference.interval_of({"a": (30, 100), "b": (10, 100), "c": (20, 100), "d": (20, 100)}, False, 3, 4000)
    assert spread[0] < 0.2 < spread[1] and abs((spread[1] - spread[0]) / 2 - 1.96 * np.sqrt((0.21 + 0.09 + 2 * 0.16) / 100)) < 0.02


def test_specifications_with_intervals(spark):
    r = random.Random(3)
    rows = [(f"s{k}", date(1998, 1 + m, 1), r.gauss(0, 1), r.gauss(0, 1), r.gauss(0, 0.1)) for k in range(60) for m in range(12)]
    df = spark.createDataFrame(rows, "security_key string, snapshot_date date, price_return_5d double, price_volatility_20d double, forward_return_5d double")
    signals = (Signal("price_momentum_5d", "lower", (0.3,)), Signal("price_volatility_20d", "upper", (0.3,)))
    for analysis, of in (("tail", signals), ("interaction", signals), ("regime_comparison", signals)):
        spec = Spec(analysis, of, ("down_5pct_5d",), analysis, bootstrap=True, bootstrap_iterations=500)
        got = research.run(df, spec, WINDOWS).collect()
        again = research.run(df, spec, WINDOWS).collect()
        assert got and sorted(map(str, got)) == sorted(map(str, again))
        for x in got:
            effect = x["additive_interaction"] if analysis == "interaction" else x["absolute_difference"]
            assert x["ci_low"] <= effect <= x["ci_high"]


def test_grouped_bootstrap_matches_a_plain_one(spark):
    r = np.random.default_rng(4)
    x = r.normal(1.0, 2.0, 500)
    rows = [("a" if i < 490 else "b", i, float(v)) for i, v in enumerate(x)] + [("a", 900, None), ("a", 901, float("inf"))]
    df = spark.createDataFrame(rows, "g string, id long, x double")
    got = {t["g"]: t for t in inference.grouped_bootstrap(df, ["g"], "x", ["id"]).collect()}
    low, high = inference.bootstrap_mean(x[:490], 1)
    assert got["a"]["n"] == 490 and abs(got["a"]["mean"] - x[:490].mean()) < 1e-9
    assert abs(got["a"]["ci_low"] - low) < 0.05 and abs(got["a"]["ci_high"] - high) < 0.05
    assert got["b"]["n"] == 10 and got["b"]["ci_low"] is None
    same = {t["g"]: t for t in inference.grouped_bootstrap(df.repartition(7, "id"), ["g"], "x", ["id"]).collect()}
    assert abs(same["a"]["ci_low"] - got["a"]["ci_low"]) < 1e-9
    share = np.bincount(inference.appearances(np.arange(2000, dtype=np.int64), 200).ravel(), minlength=4)[:4] / 400_000
    assert np.allclose(share, np.exp(-1) / np.array([1, 1, 2, 6]), atol=0.005)


def test_fifteen_checks(spark):
    from quarry.queries.base import panel, prices, sectors

    sf = "/root/testdata/sf0.001"
    p, q, m = panel(spark, sf), prices(spark, sf), sectors(spark, sf).select("symbol")
    status = lambda df: {r["check"]: (r["violations"], r["status"]) for r in qc.panel_checks(df, q, m).collect()}
    good = status(p)
    assert len(good) == 16 and good["overall"][1] in ("PASS", "WARN") and good["forward_return_alignment"] == (0, "PASS")
    bad = p.withColumns({
        "price_date": F.when(F.col("price_date").isNotNull(), F.date_sub("snapshot_date", 1)), "forward_return_5d": F.col("forward_return_5d") + 1, "forward_return_1d": F.lit(-2.0), "close_on_signal_date": F.lit(-1.0),
        "short_interest_delta_pp": F.lit(float("inf")), "above_3_0pct": ~F.col("above_3_0pct"), "price_mapping_source": F.lit("guess"), "yahoo_symbol": F.unix_date("snapshot_date").cast("long") + 10**6,
    })
    got = status(bad.union(bad).withColumn("future_close", F.lit(1)))
    for name in ("date_integrity", "forward_returns", "price_values", "numeric_values", "threshold_logic", "mapping_sources", "duplicate_features", "identity_consistency", "mapping_integrity", "price_leakage", "first_price_problem"):
        assert got[name][0] > 0, name
    assert got["overall"][1] == "FAIL" and status(p.drop("active_holders"))["required_columns"] == (1, "FAIL")


def test_event_grid_equals_counting(spark):
    r = random.Random(8)
    rows = [(r.choice([None, *(k / 4 for k in range(12))]), r.choice([None, -1.0, 0.0, 0.5, 3.0]), r.choice([None, *(k / 50 - 0.12 for k in range(10))]), r.uniform(-0.2, 0.2)) for _ in range(400)]
    df = spark.createDataFrame(rows, "risk double, c double, r1 double, r5 double")
    events, changes, risks = [-0.03, -0.1], [0.0, 0.5], [0.5, 2.0]
    got = {(x["horizon"], x["event_threshold"], x["si_cut"], x["risk_cut"]): (x["n"], x["events"], x["base_n"], x["base_events"]) for x in diagnostics.event_grid(df, "risk", "c", {1: "r1", 5: "r5"}, events, changes, risks).collect()}
    for (h, e, s, q), value in got.items():
        ok = [(a, b, t[h]) for a, b, *t in ((x[0], x[1], *{1: x[2], 5: x[3]}.items()) for x in rows) for t in [dict(t)] if t[h] is not None]
        inside = [t for a, b, t in ok if a is not None and a >= q and b is not None and b >= s]
        assert value == (len(inside), sum(t <= e for t in inside), len(ok), sum(t <= e for _, _, t in ok))
    assert len(got) == 16


def test_relative_specifications_load():
    for text in RELATIVE_SPECS.values():
        assert all(s.name in SIGNALS for s in load(text).signals)
    assert len(SIGNALS) == 15 and "active_holders" not in SIGNALS


def test_one_to_one_and_reattached(spark):
    a = spark.createDataFrame([(1, "r", 2.0), (1, "s", 5.0), (2, "s", 1.0)], "k int, kind string, v double")
    got = {(r["k"], r["kind"]): r["d"] for r in features.reattached(a, ["k"], F.col("kind") == "r", "v", "d").collect()}
    assert got == {(1, "r"): 0.0, (1, "s"): 3.0, (2, "s"): None}
    with pytest.raises(ValueError):
        features.one_to_one(a, a, ["k"])
    assert features.one_to_one(a.select("k", "kind", "v"), a.select("k", "kind"), ["k", "kind"]).count() == 3


def test_replay_quality(spark):
    rows = [("a", date(2024, 1, d), s, p) for d, s, p in ((1, 1.0, 50.0), (2, 2.0, 90.0), (3, 2.1, 91.0))] + [("b", date(2024, 1, d), s, 10.0) for d, s in ((1, 1.0), (2, 1.1), (3, 1.2))]
    df = spark.createDataFrame(rows, "issuer string, snapshot_date date, short_interest_pct double, max_position_share_pct double")
    assert [(r["issuer"], r["change"]) for r in replay.concentration_jumps(df, ["issuer"]).collect()] == [("a", 40.0)]
    assert [(r["snapshot_date"].day, r["moved"], r["share"]) for r in replay.market_days(df, ["issuer"]).collect()] == [(2, 1, 0.5)]


def test_changes_in_classes(spark):
    df = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 0.2, 0.25, 3.0, None)], "c double")
    assert [r[0] for r in df.select(buckets.change_class(F.col("c"), 2.0)).collect()] == ["negative", "zero", "positive_normal", "positive_normal", "positive_extreme", None]
    assert [r[0] for r in df.select(buckets.gradient(F.col("c"))).collect()] == ["le_0", "le_0", "0_0.25", "0_0.25", "gt_2", None]


def test_thinned(spark):
    df = spark.range(3000).select(F.col("id").alias("security"))
    got = {(r["share"], r["seed"]): r["count"] for r in portfolio.thinned(df).groupBy("share", "seed").count().collect()}
    assert len(got) == 15 and all(abs(n / 3000 - (1 - s)) < 0.05 for (s, _), n in got.items())


def test_stored_tables_follow_their_sources(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t"))
    made = []

    def build():
        made.append(1)
        return spark.read.parquet(str(tmp_path / "t")).withColumn("k", F.col("id") % 2)

    get = lambda: store.stored(spark, "some", [str(tmp_path / "t")], build, "k")
    assert get().count() == 3 and get().count() == 3 and len(made) == 1
    spark.range(2).write.mode("append").parquet(str(tmp_path / "t"))
    assert get().count() == 5 and len(made) == 2


def test_sinks_of_sources_and_reports(spark, tmp_path):
    files = spark.createDataFrame([(bytearray(b"one"), "2024-01-01"), (bytearray(b"two"), "2024-01-02"), (bytearray(b"one"), "2024-01-01")], "content binary, date string")
    first = sinks.write_sources(files, str(tmp_path / "raw"), ".ods")
    assert sorted(r["name"] for r in first.collect()) == ["source_2024-01-01_7692c3ad3540.ods", "source_2024-01-02_3fc4ccfe7458.ods"]
    assert sinks.write_sources(files, str(tmp_path / "raw"), ".ods").count() == 0 and spark.read.parquet(str(tmp_path / "raw")).count() == 2
    with pytest.raises(ValueError):
        sinks.write_chunks(spark.range(100).withColumn("t", F.lit("x" * 100)), str(tmp_path / "big"), most=2000)
    assert not (tmp_path / "big").exists()
    sinks.write_chunks(spark.range(100), str(tmp_path / "small"), rows=30)
    paths = sinks.write_reports("R", {"a": [{"x": 1, "y": 'q,"z'}], "b": []}, str(tmp_path / "report"))
    assert (tmp_path / "report" / "a.csv").read_text() == 'x,y\n1,"q,""z"\n' and set(paths) == {"json", "jsonl", "markdown", "csv:a", "csv:b"}


def test_html_tables_and_last_usable_day(spark):
    page = "<p>x</p><table><tr><th>A<th>B</tr><tr><td> 1 &amp; <b>2</b></td><td></td></tr></table><table><tr><td>z"
    got = tables.html_tables(spark, spark.createDataFrame([(7, page), (8, None)], "page_id long, html string")).orderBy("table", "row").collect()
    assert [tuple(r) for r in got] == [(7, 0, 0, ["A", "B"]), (7, 0, 1, ["1 & 2", ""]), (7, 1, 0, ["z"])]
    assert tables.last_usable_day(datetime(2024, 1, 10, 16, 59, tzinfo=timezone.utc)) == date(2024, 1, 9)
    assert tables.last_usable_day(datetime(2024, 1, 10, 17, 0, tzinfo=timezone.utc)) == date(2024, 1, 10)


def test_unknown_signals_are_refused(spark):
    with pytest.raises(SpecError):
        research.prepare(spark.createDataFrame([(date(2024, 1, 1), 1.0)], "snapshot_date date, x double"), [Spec("a", (Signal("holder_change"),), ("down_5pct_5d",), "tail")])


def test_prospective_runs_are_guarded(spark):
    from quarry.plans import lifecycle

    r = random.Random(5)
    rows = [(f"s{k}", date(y, m, 1), r.gauss(0, 1), r.gauss(0, 1), r.gauss(0, 0.1)) for k in range(30) for y in (1999, 2000) for m in range(1, 13)]
    df = spark.createDataFrame(rows, "security_key string, snapshot_date date, price_return_5d double, price_volatility_20d double, forward_return_5d double")
    spec = Spec("c", (Signal("price_momentum_5d", "lower", (0.3,)), Signal("price_volatility_20d", "upper", (0.3,))), ("down_5pct_5d",), "regime_comparison")
    c = lifecycle.freeze(spec, date(1999, 12, 31), date(2000, 1, 1))
    got, run = lifecycle.evaluate(c, df, date(2000, 1, 1), date(2000, 12, 31), [])
    assert got.count() == 1 and run["status"] == "done"
    again, second = lifecycle.evaluate(c, df, date(2000, 1, 1), date(2000, 12, 31), [run])
    assert again is None and second["status"] == "duplicate"
    with pytest.raises(SpecError):
        lifecycle.evaluate(c, df, date(1999, 12, 1), date(2000, 12, 31), [])


def test_models_of_sets_and_controls(spark):
    from quarry.plans import models
    from quarry.plans.spec import Window

    r = random.Random(6)
    rows = []
    for i in range(900):
        a, b = r.gauss(0, 1), r.gauss(0, 1)
        rows.append((date(2020 + i % 3, 6, 1), a, b, float(a + r.gauss(0, 0.5) > 0)))
    df = spark.createDataFrame(rows, "snapshot_date date, a double, b double, y double")
    w = [Window("w", "2020-12-31", "2021-12-31", "2022-12-31")]
    got = models.select_features(df, {"noise": ["b"], "signal": ["a"]}, w)[0]
    assert got["chosen"] == "signal" and got["test_auc"] > 0.9
    both = models.controlled(df, ["a"], ["b"], w)[0]
    assert both["weight_event_score"] > abs(both["weight_b"]) and both["auc"] > 0.9
    assert models.importance(df, ["a", "b"], w[0])[0][0] == "a"
    assert models.out_of_sample(df, ["a"], w).count() == 300
