"""Controlled comparisons of two arms and their replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import stats


def standardised(rows: DataFrame, cell: list[str], high: Column, y: Column, by: list[str] | None = None, least: int = 10) -> DataFrame:
    """Rates of two arms weighted by the same cell sizes, over cells with enough rows in both."""
    by = by or []
    h, l = F.coalesce(high, F.lit(False)), ~F.coalesce(high, F.lit(True))  # noqa: E741
    cells = rows.where(y.isNotNull()).groupBy(*by, *cell).agg(F.count(F.lit(1)).alias("n"), F.count_if(h).alias("hn"), F.count_if(h & (y > 0)).alias("he"), F.count_if(l).alias("ln"), F.count_if(l & (y > 0)).alias("le"))
    ok = cells.where((F.col("hn") >= least) & (F.col("ln") >= least))
    weighted = lambda e, n: F.sum(F.col("n") * F.col(e) / F.col(n)) / F.sum("n")
    out = ok.groupBy(*by).agg(F.count(F.lit(1)).alias("cells"), F.sum("n").alias("rows"), weighted("he", "hn").alias("high_rate"), weighted("le", "ln").alias("low_rate"))
    return out.withColumn("difference_pp", 100 * (F.col("high_rate") - F.col("low_rate")))


def high_low(rows: DataFrame, by: list[str], high: Column, y: str) -> DataFrame:
    """Rates of the arms per cell, from either side, and their difference in points."""
    side = lambda cond, p: rows.where(cond).groupBy(*by).agg(F.count(y).alias(f"{p}_n"), stats.events(F.col(y)).alias(f"{p}_events"))
    h = F.coalesce(high, F.lit(False))
    out = side(h, "high").join(side(~h, "low"), by, "full")
    return out.withColumn("difference_pp", 100 * (stats.ratio(F.col("high_events"), F.col("high_n")) - stats.ratio(F.col("low_events"), F.col("low_n"))))


def halves(rows: DataFrame, date: str = "snapshot_date") -> DataFrame:
    """first or second by the middle of the time span; the middle belongs to the first."""
    a, b = rows.agg(F.min(date), F.max(date)).first()
    if a is None:
        return rows.withColumn("half", F.lit(None).cast("string"))
    middle = a + (b - a) / 2
    return rows.withColumn("half", F.when(F.col(date) <= F.lit(middle), "first").otherwise("second"))


def replicate(rows: DataFrame, cells: list[str], y: str, row_of: str, top: int = 5, least: int = 50, half: str = "half") -> DataFrame:
    """The top cells by absolute effect in each half, with their effect in the other."""
    per = rows.groupBy(half, *cells).agg(F.count(y).alias("n"), stats.events(F.col(y)).alias("events"))
    w = Window.partitionBy(half, row_of)
    effect = stats.ratio(F.col("events"), F.col("n")) - stats.ratio(F.sum("events").over(w), F.sum("n").over(w))
    per = per.withColumn("effect", effect)
    order = Window.partitionBy(half).orderBy(F.abs("effect").desc(), *cells)
    chosen = per.where(F.col("n") >= least).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    other = per.select(F.when(F.col(half) == "first", "second").otherwise("first").alias(half), *cells, F.col("effect").alias("effect_elsewhere"), F.col("n").alias("n_elsewhere"))
    return chosen.join(other, [half, *cells], "left").withColumn("same_sign", F.signum("effect") == F.signum("effect_elsewhere"))


def prior_groups(x: Column, edges: list[float]) -> Column:
    """At or below zero, and three bands of the positive side by learned quantiles."""
    return F.when(x <= 0, "le_0").when(x <= edges[0], "0_p50").when(x <= edges[1], "p50_p80").when(x.isNotNull(), "gt_p80")


def four_cell_interaction(rows: DataFrame, a: Column, b: Column, y: Column, by: list[str]) -> DataFrame:
    """(A - B) - (C - D) over a and b, a and not b, not a and b, neither; rows without inputs are out."""
    ok = rows.where(a.isNotNull() & b.isNotNull() & y.isNotNull())
    mean = lambda m: stats.ratio(F.sum(F.when(m, y)), F.count_if(m))
    return ok.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), (mean(a & b) - mean(a & ~b) - mean(~a & b) + mean(~a & ~b)).alias("interaction"))


def overlaps(periods: DataFrame, name: str = "name", start: str = "start", end: str = "end") -> DataFrame:
    """Pairs of named periods that share a day. Periods are a registry of evaluations, a few rows."""
    a = periods.select(F.col(name).alias("left"), F.col(start).alias("_a"), F.col(end).alias("_b"))
    b = periods.select(F.col(name).alias("right"), F.col(start).alias("_c"), F.col(end).alias("_d"))
    return a.join(b, (F.col("left") < F.col("right")) & (F.col("_a") <= F.col("_d")) & (F.col("_c") <= F.col("_b"))).select("left", "right")


def event_grid(rows: DataFrame, risk: str, change: str, returns: dict[int, str], events: list[float], changes: list[float], risks: list[float]) -> DataFrame:
    """horizon, event_threshold, si_cut, risk_cut: rows at or above both cuts (n) and how many of them fall
    by the threshold or more (events), with the same of all rows that have the return (base_*).

    Every threshold that a value passes is known from one number, how many it passes, so rows are summed
    up by these numbers first; the cells of the grid are made from the sums."""
    passes = lambda c, cuts: sum((F.coalesce(c, F.lit(False)).cast("int") for c in (F.col(c) >= v for v in sorted(cuts))), F.lit(0))
    falls = sum((F.coalesce(F.col("_x") <= e, F.lit(False)).cast("int") for e in sorted(events, reverse=True)), F.lit(0))
    every = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(c).alias("x")) for h, c in returns.items()]))
    long = rows.select(passes(risk, risks).alias("_r"), passes(change, changes).alias("_c"), every.alias("_h")).select("_r", "_c", F.col("_h.horizon").alias("horizon"), F.col("_h.x").alias("_x"))
    sums = long.where("_x is not null").groupBy("horizon", "_r", "_c", falls.alias("_f")).agg(F.count(F.lit(1)).alias("_n"))
    grid = F.array(*[F.struct(F.lit(e).alias("event_threshold"), F.lit(i + 1).alias("f"), F.lit(s).alias("si_cut"), F.lit(j + 1).alias("c"), F.lit(q).alias("risk_cut"), F.lit(k + 1).alias("r")) for i, e in enumerate(sorted(events, reverse=True)) for j, s in enumerate(sorted(changes)) for k, q in enumerate(sorted(risks))])
    cells = sums.withColumn("_g", F.explode(grid)).select("*", "_g.*")
    inside, hit = (F.col("_r") >= F.col("r")) & (F.col("_c") >= F.col("c")), F.col("_f") >= F.col("f")
    total = lambda m: F.coalesce(F.sum(F.when(m, F.col("_n"))), F.lit(0))
    return cells.groupBy("horizon", "event_threshold", "si_cut", "risk_cut").agg(total(inside).alias("n"), total(inside & hit).alias("events"), F.sum("_n").alias("base_n"), total(hit).alias("base_events"))


def risk_interaction(rows: DataFrame, risk: Column, high: Column, y: str, by: list[str]) -> DataFrame:
    """Rates of four groups, at risk and not, with a high change and not, and rh - rl - oh + ol: how much more
    a high change tells of those at risk. Groups without rows make it null."""
    r, h = F.coalesce(risk, F.lit(False)), F.coalesce(high, F.lit(False))
    groups = {"rh": r & h, "rl": r & ~h, "oh": ~r & h, "ol": ~r & ~h}
    cells = [c.alias(f"{name}_{part}") for name, m in groups.items() for part, c in zip(("n", "events"), stats.rate(F.col(y), m)[:2], strict=True)]
    out = rows.groupBy(*by).agg(*cells)
    rate = lambda g: stats.ratio(F.col(f"{g}_events"), F.col(f"{g}_n"))
    return out.withColumn("interaction", rate("rh") - rate("rl") - rate("oh") + rate("ol"))


def lagged(rows: DataFrame, x: str, lags: int, key: str = "security_key", date: str = "snapshot_date") -> DataFrame:
    """One copy of a row for each lag from 0 to lags, with the value of x so many observations before."""
    w = Window.partitionBy(key).orderBy(date)
    values = F.array(*[F.struct(F.lit(k).alias("lag"), (F.lag(x, k).over(w) if k else F.col(x)).alias("lagged")) for k in range(lags + 1)])
    return rows.withColumn("_l", values).withColumn("_l", F.explode("_l")).select("*", "_l.lag", "_l.lagged").drop("_l")


def anatomy(rows: DataFrame, group: Column, returns: str, values: list[str], by: list[str] | None = None) -> DataFrame:
    """What a group is made of: rows, their share of all, shares of falls, rises and what lies between, and
    the means of columns."""
    from quarry.operators.buckets import outcome

    by = by or []
    o = outcome(F.col(returns))
    known = F.col(returns).isNotNull()
    shares = [stats.ratio(F.count_if(o == k), F.count_if(known)).alias(f"{k}_share") for k in ("down", "middle", "up")]
    return rows.groupBy(*by, group.alias("group")).agg(F.count(F.lit(1)).alias("n"), F.count_if(known).alias("known"), *shares, *[F.avg(v).alias(f"mean_{v}") for v in values])


def compared(a: DataFrame, b: DataFrame, keys: list[str], values: list[str], tolerance: float = 1e-9) -> DataFrame:
    """column, rows, only_left, only_right, different: two tables side by side, each number within a
    tolerance in absolute or relative terms. Null equals null."""
    left = a.select(*keys, F.lit(1).alias("_l"), *[F.col(v).cast("double").alias(f"_a_{v}") for v in values])
    right = b.select(*keys, F.lit(1).alias("_r"), *[F.col(v).cast("double").alias(f"_b_{v}") for v in values])
    both = left.join(right, keys, "full")

    def apart(v: str) -> Column:
        x, y = F.col(f"_a_{v}"), F.col(f"_b_{v}")
        near = F.abs(x - y) <= F.greatest(F.lit(tolerance), tolerance * F.greatest(F.abs(x), F.abs(y)))
        return F.when(F.col("_l").isNull() | F.col("_r").isNull(), False).otherwise(~F.coalesce(near, x.isNull() & y.isNull()))

    cells = [F.struct(F.lit(v).alias("column"), F.count(F.lit(1)).alias("rows"), F.count_if(F.col("_r").isNull()).alias("only_left"), F.count_if(F.col("_l").isNull()).alias("only_right"), F.count_if(apart(v)).alias("different")) for v in values]
    return both.agg(F.array(*cells).alias("_c")).select(F.explode("_c").alias("_c")).select("_c.*")
