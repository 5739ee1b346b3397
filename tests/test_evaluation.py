"""Entities, evaluation and resampling."""

from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import entities, evaluation, inference
from quarry.plans import discovery, registry
from quarry.plans.spec import SpecError, Window

ROW = "isin string, lei string, issuer string"


def _aliases(spark, rows):
    return spark.createDataFrame(rows, ROW + ", entity_id string")


def _found(df):
    return sorted((r["isin"] or "", r["lei"] or "", r["issuer"] or "", r["entity_id"]) for r in df.collect())


def test_new_name_of_a_known_code_keeps_its_entity(spark):
    a = _aliases(spark, [("S1", "L1", "OLD", "ENT-000001")])
    new = entities.discover(spark.createDataFrame([("S1", "L1", "NEW")], ROW), a, 1)
    assert _found(new) == [("S1", "L1", "NEW", "ENT-000001")]


def test_new_lei_and_bridge(spark):
    a = _aliases(spark, [("S1", "L1", "A", "ENT-000001")])
    new = entities.discover(spark.createDataFrame([("S1", "L2", "A"), ("S9", "L1", "B")], ROW), a, 1)
    assert _found(new) == [("S1", "L2", "A", "ENT-000001"), ("S9", "L1", "B", "ENT-000001")]


def test_same_batch_twice_adds_nothing(spark):
    a = _aliases(spark, [("S1", "L1", "A", "ENT-000001")])
    batch = spark.createDataFrame([("S1", "L1", "A"), ("S2", None, "B"), ("S2", "L2", "B2"), (None, "L2", "C")], ROW)
    new = entities.discover(batch, a, 1)
    assert {r["entity_id"] for r in new.collect()} == {"ENT-000002"} and new.count() == 3
    assert entities.discover(batch, a.unionByName(new), 2).count() == 0


def test_conflicting_codes_are_an_error(spark):
    a = _aliases(spark, [("S1", "L1", "A", "ENT-000001"), ("S2", "L2", "B", "ENT-000002")])
    with pytest.raises(entities.ContractError):
        entities.discover(spark.createDataFrame([("S1", "L2", "A")], ROW), a, 2)


def test_names_alone_decide_only_if_unique(spark):
    a = _aliases(spark, [("S1", None, "A", "ENT-000001"), ("S2", None, "B", "ENT-000002"), ("S3", None, "B", "ENT-000003")])
    got = _found(entities.discover(spark.createDataFrame([(None, None, "A"), (None, None, "B")], ROW), a, 3))
    assert got == [("", "", "A", "ENT-000001"), ("", "", "B", "ENT-000004")]


def test_lookup_agreeing_instruments(spark):
    i = spark.createDataFrame([("S1", None, "N", "X"), ("S1", None, "M", "X"), ("S2", "L", "N", "Y")], ROW + ", symbol string")
    rows = spark.createDataFrame([(1, "S1", None, "N"), (2, None, "L", "M"), (3, None, None, "N"), (4, "S9", None, "M"), (5, None, None, None)], "id long, " + ROW)
    got = {r["id"]: (r["symbol"], r["instrument_resolution"]) for r in entities.lookup(rows, i, "id", "symbol").collect()}
    assert got == {1: ("X", "isin"), 2: ("Y", "lei"), 3: (None, "ambiguous_issuer"), 4: ("X", "issuer"), 5: (None, "unresolved")}


def test_similarity(spark):
    df = spark.createDataFrame([("ABCD", "BCDE"), ("A", None), ("", "")], "a string, b string")
    assert [r[0] for r in df.select(entities.similarity("a", "b")).collect()] == [0.75, 0.0, 0.0]


def test_economic_score(spark):
    row = spark.range(1).select(evaluation.economic_score(F.lit(0.3), "regression", "below"), evaluation.economic_score(F.lit(0.3), "classification", "below")).first()
    assert tuple(row) == (-0.3, 0.3)


def test_gate_ties_go_to_the_first(spark):
    df = spark.createDataFrame([("a", 1.0, 0.9, 0.9), ("a", 0.0, 0.1, 0.1), ("b", 1.0, 0.1, 0.9), ("b", 0.0, 0.9, 0.1), ("c", 1.0, 0.5, 0.5)], "r string, y double, p double, q double")
    gates = evaluation.gate(df, "r", "y", "p", "q")
    assert {r["r"]: r["chosen"] for r in gates.collect()} == {"a": "p", "b": "q", "c": "p"}
    assert evaluation.gated(df, gates, "r", "p", "q").where("r = 'b' and y = 1").first()["gated_score"] == 0.9


def test_ablation_and_status(spark):
    df = spark.createDataFrame([("a", 0.6, 1.0, "ok"), ("a", 0.56, 2.0, "weak"), ("b", 0.5, 1.0, "weak"), ("b", 0.58, 1.0, "weak"), ("c", 0.5, 1.0, "none")], "k string, auc double, lift double, status string")
    assert {r["k"]: r["status"] for r in evaluation.ablation(df, ["k"]).collect()} == {"a": "stable", "b": "unstable", "c": "no_signal"}
    assert {r["k"]: r["status"] for r in evaluation.status(df, ["k"], {"ok": 0, "weak": 1, "none": 2}).collect()} == {"a": "ok", "b": "weak", "c": "none"}


def test_walk_keeps_last_known(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, None), ("a", 3, 3.0), ("b", 1, None)], "k string, t int, x double")
    assert [r["v"] for r in df.select("k", "t", evaluation.walk(df, "k", ["t"], "x").alias("v")).orderBy("k", "t").collect()] == [1.0, 1.0, 3.0, None]


def test_delta_auc_and_interaction():
    r = np.random.default_rng(0)
    y = r.integers(0, 2, 400).astype(float)
    a, b = r.normal(size=400), y + r.normal(size=400) * 0.5
    d, low, high = inference.paired_delta_auc(y, a, b, 1, 200)
    assert low < d < high and low > 0.2
    assert inference.auc_of(np.array([1.0, 0.0]), np.array([1.0, 1.0])) == 0.5 and inference.auc_of(np.ones(3), np.ones(3)) is None
    got = inference.interaction_interval({"risk_high": (60, 100), "risk_low": (20, 100), "other_high": (10, 100), "other_low": (10, 100)}, 3)
    assert abs(got["estimate"] - 0.4) < 1e-12 and got["p_positive"] == 1.0 and got["ci_low"] < 0.4 < got["ci_high"]
    assert inference.interaction_interval({k: (0, 0) for k in ("risk_high", "risk_low", "other_high", "other_low")}, 3)["estimate"] is None


def test_permutation_tests(spark):
    r = np.random.default_rng(0)
    ret = r.normal(size=500)
    ret[::50] = np.nan
    masks = np.stack([np.nan_to_num(ret, nan=0.0) < -1.5, r.random(500) < 0.1])
    targets = {"down": ("r", lambda v: v <= -1.0)}
    scores = inference.max_statistic(spark, {"r": ret}, targets, masks, 60)
    again = inference.max_statistic(spark, {"r": ret}, targets, masks, 60)
    assert sorted(map(tuple, scores.collect())) == sorted(map(tuple, again.collect()))
    best = scores.agg(F.max("score")).first()[0]
    y = (ret <= -1.0).astype(float)
    observed = y[masks[0]].mean() / np.nanmean(np.where(np.isfinite(ret), y, np.nan)) - 1
    assert observed > best
    got = inference.null_test(spark, np.where(np.isfinite(ret), y, np.nan), masks[0], 99)
    assert got["p_value"] == 0.01 and got["exceedances"] == 0


def test_grids_and_registry(spark):
    assert discovery.grid(spark, {"a": [1, 2], "b": ["x"]}).count() == 2

    @registry.register("share_above_learned_median")
    def share(before, test):
        (m,) = before.agg(F.median("x")).first()
        return test.agg(F.avg((F.col("x") > m).cast("double")).alias("share"))

    with pytest.raises(SpecError):
        registry.register("share_above_learned_median")(share)
    with pytest.raises(SpecError):
        registry.run("none", None, [])
    df = spark.createDataFrame([(date(2024, 1, i), float(i)) for i in range(1, 31)], "snapshot_date date, x double")
    rows = registry.run("share_above_learned_median", df, [Window("w", "2024-01-05", "2024-01-10", "2024-01-20")]).collect()
    assert [(r["window"], r["share"]) for r in rows] == [("w", 1.0)]
    assert "share_above_learned_median" in registry.names()


def test_models_learn(spark):
    from quarry.plans import models

    r = np.random.default_rng(1)
    rows = []
    for i in range(900):
        x = r.normal()
        rows.append((date(2024, 1 + i % 3, 1 + i % 28), float(x), float(r.normal()), None, float(r.random() < 1 / (1 + np.exp(-2 * x)))))
    df = spark.createDataFrame(rows, "snapshot_date date, a double, b double, empty double, y double")
    w = [Window("w", "2024-01-31", "2024-02-29", "2024-03-31"), Window("thin", "2024-03-28", "2024-03-29", "2024-03-30")]
    got = models.walk_forward(df, ["a", "b", "empty"], w, [models.MODELS["logistic"], models.MODELS["random_forest"]])
    assert got[0]["status"] == "ok" and got[0]["features"] == 2 and got[0]["auc"] > 0.75 and got[1]["status"] == "skipped"
    assert models.in_parallel([lambda: 1, lambda: 2]) == [1, 2]
