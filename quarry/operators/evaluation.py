"""Evaluating experiments, calibrations, model gates and feature sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import ranks, stats


def experiments(rows: DataFrame, by: list[str], selected: str, score: str, y: str, ret: str) -> DataFrame:
    """Per group: AUC of the score, rate inside the selection and overall, lift, and the returns of the
    selected and of all. rows are research rows repeated per window, split and experiment."""
    sel = F.coalesce(F.col(selected), F.lit(False))
    n, e, r = stats.rate(F.col(y), sel)
    bn, be, br = stats.rate(F.col(y))
    inside = F.when(sel, F.col(ret))
    out = rows.groupBy(*by).agg(
        n.alias("n"), e.alias("events"), r.alias("rate"), bn.alias("base_n"), be.alias("base_events"), br.alias("base_rate"),
        F.avg(inside).alias("mean_return"), F.median(inside).alias("median_return"), F.avg(ret).alias("base_mean_return"),
    )
    out = out.withColumns({"lift": stats.lift(F.col("rate"), F.col("base_rate")), "return_difference": F.col("mean_return") - F.col("base_mean_return")})
    auc = stats.auc(rows, y, score, by).select(*[F.col(c).alias(f"_{c}") for c in by], "auc")
    return out.join(auc, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by], "left").drop(*[f"_{c}" for c in by])


def status(rows: DataFrame, by: list[str], order: dict[str, int]) -> DataFrame:
    """The status of a pool of results: the one that comes first in an order."""
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.col("status"))
    return rows.groupBy(*by).agg(F.min_by("status", rank).alias("status"), F.count(F.lit(1)).alias("results"))


def calibration(rows: DataFrame, by: list[str], p: str, y: str, tie: list[str], bins: int = 10) -> DataFrame:
    """Mean score and rate in up to `bins` equal bins of the ordered scores of each group."""
    r, n = ranks.first_rank(F.col(p), by, tie)
    binned = rows.where(F.col(p).isNotNull() & F.col(y).isNotNull()).withColumn("bin", ranks.quantile_cut(r, n, bins))
    return binned.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_score"), F.avg((F.col(y) > 0).cast("double")).alias("rate"))


def selection_summary(rows: DataFrame, by: list[str], x: str) -> DataFrame:
    q = F.percentile(x, F.array(*[F.lit(v) for v in (0.1, 0.25, 0.75, 0.9)]))
    out = rows.groupBy(*by).agg(F.count(x).alias("n"), F.min(x).alias("least"), F.max(x).alias("most"), F.avg(x).alias("mean"), F.median(x).alias("median"), q.alias("_q"))
    return out.withColumns({k: F.element_at("_q", i + 1) for i, k in enumerate(("p10", "p25", "p75", "p90"))}).drop("_q")


def economic_score(score: Column, task: str, direction: str) -> Column:
    """Higher is better for the portfolio: a probability as it is, a predicted return turned around
    where falls are sought."""
    return -score if task == "regression" and direction == "below" else score


def gate(validation: DataFrame, regime: str, y: str, first: str, second: str) -> DataFrame:
    """Per regime the score with the higher validation AUC; ties and missing values go to the first."""
    a = stats.auc(validation, y, first, [regime]).select(F.col(regime).alias("_r"), F.col("auc").alias("_a"))
    b = stats.auc(validation, y, second, [regime]).select(F.col(regime).alias("_q"), F.col("auc").alias("_b"))
    met = validation.select(regime).where(F.col(regime).isNotNull()).distinct().join(a, F.col(regime) == F.col("_r"), "left").join(b, F.col(regime) == F.col("_q"), "left")
    return met.select(regime, F.col("_a").alias(f"auc_{first}"), F.col("_b").alias(f"auc_{second}"), F.when(F.col("_b") > F.col("_a"), second).otherwise(first).alias("chosen"))


def gated(rows: DataFrame, gates: DataFrame, regime: str, first: str, second: str) -> DataFrame:
    """Rows with the score that their regime's gate has chosen."""
    return rows.join(gates.select(F.col(regime).alias("_r"), "chosen"), F.col(regime) == F.col("_r"), "left").withColumn("gated_score", F.when(F.col("chosen") == second, F.col(second)).otherwise(F.col(first))).drop("_r", "chosen")


def ablation(results: DataFrame, by: list[str]) -> DataFrame:
    """How feature sets do over windows: how often AUC reaches 0.55 and 0.60, lifts, and a verdict."""
    a = F.col("auc")
    out = results.groupBy(*by).agg(F.count(a).alias("windows"), F.avg(a).alias("mean_auc"), F.min(a).alias("least_auc"), F.count_if(a >= 0.55).alias("at_055"), F.count_if(a >= 0.60).alias("at_060"), F.avg("lift").alias("mean_lift"), F.median("lift").alias("median_lift"))
    verdict = F.when(F.col("windows") == 0, "no_result").when(F.col("at_055") == F.col("windows"), "stable").when(F.col("at_055") > 0, "unstable").otherwise("no_signal")
    return out.withColumn("status", verdict)


def companies(rows: DataFrame, key: str, y: str, score: str, least: int = 25, top: int = 25) -> DataFrame:
    """The `top` keys by rows with their AUC and accuracy at a half."""
    ok = rows.where(F.col(y).isNotNull() & F.col(score).isNotNull())
    n = ok.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg(((F.col(score) >= 0.5) == (F.col(y) > 0)).cast("double")).alias("accuracy")).where(F.col("n") >= least)
    auc = stats.auc(ok, y, score, [key]).select(F.col(key).alias("_k"), "auc")
    return n.orderBy(F.col("n").desc(), key).limit(top).join(auc, F.col(key) == F.col("_k"), "left").drop("_k")


def score_tails(pretest: DataFrame, test: DataFrame, score: str, y: str, low: float = 0.2, high: float = 0.8) -> DataFrame:
    """Rates in the tails of a model's score, cut where the scores before the test say."""
    from quarry.operators.buckets import learned_edges

    a, b = learned_edges(pretest, score, [low, high])
    side = F.when(F.col(score) <= a, "low").when(F.col(score) >= b, "high").when(F.col(score).isNotNull(), "middle")
    n, e, r = stats.rate(F.col(y))
    return test.withColumn("tail", side).where("tail is not null").groupBy("tail").agg(n.alias("n"), e.alias("events"), r.alias("rate"))


def quartile_labels(x: Column, by: list[str], tie: list[str]) -> Column:
    """Q1 to Q4 by the first rank, right-closed; groups of fewer than four are too small to cut."""
    r, n = ranks.first_rank(x, by, tie)
    return F.when(x.isNull(), None).when(n < 4, "insufficient_data").otherwise(F.concat(F.lit("Q"), F.ceil(r * 4.0 / n).cast("int").cast("string")))


def conditional_change(rows: DataFrame, by: list[str], prior: Column, change: Column, y: str, returns: list[str]) -> DataFrame:
    """Inside a prior tail, rows with and without a second one: rates, and differences of mean returns."""
    p, c = F.coalesce(prior, F.lit(False)), F.coalesce(change, F.lit(False))
    n1, e1, r1 = stats.rate(F.col(y), p & c)
    n0, e0, r0 = stats.rate(F.col(y), p & ~c)
    gap = [(F.avg(F.when(p & c, F.col(x))) - F.avg(F.when(p & ~c, F.col(x)))).alias(f"difference_{x}") for x in returns]
    return rows.groupBy(*by).agg(n1.alias("with_n"), e1.alias("with_events"), r1.alias("with_rate"), n0.alias("without_n"), e0.alias("without_events"), r0.alias("without_rate"), *gap)


def most_frequent(rows: DataFrame, value: str, top: int = 50) -> DataFrame:
    return rows.groupBy(value).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), value).limit(top)


def walk(rows: DataFrame, key: str, order: list[str], x: str) -> Column:
    """The last known value of a key's rows."""
    return F.last(x, ignorenulls=True).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def strategies(rows: DataFrame, gates: DataFrame, regime: str, first: str, second: str) -> DataFrame:
    """One copy of a row for each way of choosing between two scores: the first alone, the second alone, the
    one that its regime's gate chose, and the second where the regime is MID or HIGH."""
    g = gated(rows, gates, regime, first, second)
    ways = {"first_only": F.col(first), "second_only": F.col(second), "gate_validation": F.col("gated_score"), "gate_mid_high": F.when(F.col(regime).isin("MID", "HIGH"), F.col(second)).otherwise(F.col(first))}
    every = F.explode(F.array(*[F.struct(F.lit(k).alias("strategy"), c.cast("double").alias("score")) for k, c in ways.items()]))
    return g.withColumn("_s", every).select("*", "_s.*").drop("_s", "gated_score")


def subgroups(rows: DataFrame, periods: list[tuple[str, object, object]], selected: Column, y: str, date: str = "snapshot_date", sector: str = "sector", market: str = "market_return_20d") -> DataFrame:
    """kind, subgroup: how a selection does within fixed periods, sectors and the market's direction over
    twenty days (below zero, or at and above it), against all rows of the subgroup. One aggregate."""
    day = F.lit(None).cast("string")
    for name, a, b in periods:
        day = F.when(F.col(date).between(F.lit(a).cast("date"), F.lit(b).cast("date")), F.lit(name)).otherwise(day)
    way = F.when(F.col(market) < 0, "falling").when(F.col(market) >= 0, "rising")
    every = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("subgroup")) for k, c in (("period", day), ("sector", F.col(sector)), ("market", way))]))
    n, e, r = stats.rate(F.col(y), selected)
    bn, be, br = stats.rate(F.col(y))
    out = rows.withColumn("_g", every).where("_g.subgroup is not null").groupBy(F.col("_g.kind").alias("kind"), F.col("_g.subgroup").alias("subgroup"))
    out = out.agg(n.alias("n"), e.alias("events"), r.alias("rate"), bn.alias("base_n"), be.alias("base_events"), br.alias("base_rate"))
    return out.withColumn("lift", stats.lift(F.col("rate"), F.col("base_rate")))
