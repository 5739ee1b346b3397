"""Portfolio back-tests from scored predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.parse import finite


def clean(df: DataFrame, score: str = "score", ret: str = "target_return", date: str = "date", key: str = "security") -> DataFrame:
    """Rows that have a date, a key, and a finite score and return."""
    ok = F.col(date).isNotNull() & F.col(key).isNotNull() & finite(F.col(score)).isNotNull() & finite(F.col(ret)).isNotNull()
    return df.where(ok)


def rebalance_dates(df: DataFrame, every: int, date: str = "date") -> DataFrame:
    """Every k-th distinct date with its number. The list of dates is one row a calendar date, so
    numbering it in one task is bounded by time, not by data."""
    days = df.select(date).distinct()
    return days.withColumn("_r", F.row_number().over(Window.orderBy(date))).where((F.col("_r") - 1) % every == 0).select(date, ((F.col("_r") - 1) / every).cast("int").alias("period"))


def select_top(df: DataFrame, fraction: float, by: list[str], score: str = "score", key: str = "security") -> DataFrame:
    """The best ceil(n * fraction), at least one, of each group; ties by key."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    r = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(score).desc(), key))
    return df.withColumn("_n", n).withColumn("_r", r).where(F.col("_r") <= F.greatest(F.lit(1), F.ceil(F.col("_n") * fraction))).drop("_n", "_r")


def weights(df: DataFrame, by: list[str], cap: float = 0.05) -> DataFrame:
    """Equal weights up to a cap; what is left is cash."""
    return df.withColumn("weight", F.least(F.lit(1.0) / F.count(F.lit(1)).over(Window.partitionBy(*by)), F.lit(cap)))


def _moves(held: DataFrame, period: str, key: str, by: list[str], more: list[str]) -> DataFrame:
    """Each holding in its period and, as what was there before, in the next: one row a key and period."""
    now = F.struct(F.col(period).alias("_p"), F.col("weight").alias("_w"), F.lit(0.0).alias("_was"), *[F.col(c).alias(c) for c in more])
    then = F.struct((F.col(period) + 1).alias("_p"), F.lit(0.0).alias("_w"), F.col("weight").alias("_was"), *[F.lit(None).cast(held.schema[c].dataType).alias(c) for c in more])
    rows = held.select(*by, key, F.explode(F.array(now, then)).alias("_m")).select(*by, key, "_m.*")
    return rows.groupBy(*by, F.col("_p").alias(period), key).agg(F.sum("_w").alias("_w"), F.sum("_was").alias("_was"), *[F.max(c).alias(c) for c in more])


def _turned() -> Column:
    return 0.5 * (F.sum(F.abs(F.col("_w") - F.col("_was"))) + F.abs(F.sum("_w") - F.sum("_was")))


def turnover(held: DataFrame, period: str = "period", key: str = "security", by: list[str] | None = None) -> DataFrame:
    """Half the sum of changes in weights and cash, by period; all of it is bought in the first. The
    holdings are read once: no join of a period with the one before."""
    by = by or []
    moved = _moves(held, period, key, by, [])
    return moved.groupBy(*by, period).agg(_turned().alias("turnover"), F.sum("_w").alias("_in")).where("_in > 0").drop("_in")


def strategy(df: DataFrame, every: int = 5, fraction: float = 0.2, cap: float = 0.05, bps: float = 10.0, side: int = 1, by: list[str] | None = None) -> DataFrame:
    """Per period gross, cost, net and benchmark return. df: date, security, score, target_return and
    the columns of by, along which separate experiments run in one job.

    Universe, selection and weights are windows over one partition a period; turnover and returns are
    one aggregate over the holdings."""
    by = by or []
    df = clean(df)
    rows = df.join(F.broadcast(rebalance_dates(df, every)), "date")
    w = Window.partitionBy(*by, "period")
    take = F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)).over(w) * fraction))
    rows = rows.withColumns({"benchmark": F.avg("target_return").over(w), "_k": take, "_r": F.row_number().over(w.orderBy(F.col("score").desc(), "security"))})
    held = rows.where(F.col("_r") <= F.col("_k")).withColumn("weight", F.least(F.lit(1.0) / F.col("_k"), F.lit(cap)))
    moved = _moves(held, "period", "security", by, ["date", "benchmark", "target_return"])
    out = moved.groupBy(*by, "period").agg(
        F.max("date").alias("date"), F.max("benchmark").alias("benchmark"), (F.sum(F.col("_w") * F.col("target_return")) * side).alias("gross"), F.sum("_w").alias("invested"), F.count_if(F.col("_w") > 0).alias("names"), _turned().alias("turnover")
    )
    cost = F.col("turnover") * bps / 1e4
    return out.where("names > 0").withColumns({"cost": cost, "net": F.col("gross") - cost})


def compounded(r: str) -> Column:
    """Product of 1 + r less 1; -1 if any period loses everything."""
    return F.when(F.coalesce(F.min(r), F.lit(0.0)) <= -1, F.lit(-1.0)).otherwise(F.exp(F.sum(F.log1p(F.when(F.col(r) > -1, F.col(r))))) - 1)


def drawdown(df: DataFrame, r: str, period: str = "period", by: list[str] | None = None) -> DataFrame:
    """compound, and max_drawdown: the largest loss from a running maximum of wealth, which starts at 1."""
    by = by or []
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(period)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    safe = F.when(F.col(r) > -1, F.col(r))
    wealth = F.exp(F.sum(F.log1p(safe)).over(run))
    rows = df.withColumn("_w", F.when(F.min(r).over(run) <= -1, F.lit(0.0)).otherwise(wealth))
    rows = rows.withColumn("_d", F.col("_w") / F.greatest(F.lit(1.0), F.max("_w").over(run)) - 1)
    return rows.groupBy(*by).agg(compounded(r).alias("compound"), F.least(F.lit(0.0), F.min("_d")).alias("max_drawdown"))


def selection_counts(held: DataFrame, key: str = "security") -> DataFrame:
    return held.groupBy(key).agg(F.count(F.lit(1)).alias("selections"))


def concentration(counts: DataFrame, n: str = "selections", key: str = "security") -> DataFrame:
    """Share of the largest, the five and the ten largest, and how many there are."""
    w = Window.orderBy(F.col(n).desc(), key)
    top = counts.orderBy(F.col(n).desc(), key).limit(10).withColumn("_r", F.row_number().over(w))
    total = counts.agg(F.sum(n).alias("_all"), F.count(F.lit(1)).alias("unique_securities"))
    share = lambda k: (F.sum(F.when(F.col("_r") <= k, F.col(n))) / F.first("_all")).alias(f"top_{k}_share")
    return top.crossJoin(F.broadcast(total)).agg(F.first("unique_securities").alias("unique_securities"), share(1), share(5), share(10))


def excluding(df: DataFrame, sets: DataFrame, key: str = "security", name: str = "excluded") -> DataFrame:
    """One copy of df for each named set of excluded keys, without them. sets: name, key; the names
    are a parameter list, so few."""
    names = [r[0] for r in sets.select(name).distinct().collect()]
    copies = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in sorted(names)])))
    return copies.join(sets.where(F.col(key).isNotNull()), [name, key], "left_anti")


def random_exclusions(securities: list[str], shares: tuple[float, ...] = (0.1, 0.2, 0.3), seeds: int = 5) -> list[tuple[str, str]]:
    """Named sets of securities to leave out, drawn without replacement."""
    import numpy as np

    out = []
    for share in shares:
        for seed in range(seeds):
            rng = np.random.default_rng(seed)
            drop = rng.choice(sorted(securities), size=int(len(securities) * share), replace=False)
            out += [(f"random_{share:g}_{seed}", s) for s in drop]
    return out


def thinned(df: DataFrame, shares: tuple[float, ...] = (0.1, 0.2, 0.3), seeds: int = 5, key: str = "security") -> DataFrame:
    """One copy of df for each share and seed, without that share of the securities. Which ones go is a
    hash of a number key and the seed, so no list of securities is needed anywhere."""
    draws = F.explode(F.array(*[F.struct(F.lit(float(s)).alias("share"), F.lit(k).alias("seed")) for s in shares for k in range(seeds)]))
    rows = df.withColumn("_d", draws).select("*", "_d.*").drop("_d")
    spot = ((F.col(key).cast("bigint") * 7919 + F.col("seed") * 104729 + 12345) * 31337) % 10007
    return rows.where(spot >= F.col("share") * 10007)
