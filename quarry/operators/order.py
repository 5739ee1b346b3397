"""Order statistics and running sums over a whole table, a piece at a time.

A column is cut at approximate quantiles into pieces of about PIECE rows; counts and sums of pieces say
which piece holds what is sought, and only there are rows put in order. Results are exact."""

from __future__ import annotations

from math import ceil, floor

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from quarry.functions import stats
from quarry.functions.parse import finite

PIECE, PIECES = 50_000, 256


def edges(rows: DataFrame, x: str, n: int, wanted: list[int] | None = None) -> list[float]:
    """Where to cut a column of n numbers. wanted: ranks (from 1) of which alone the pieces matter; what
    lies between others is not cut."""
    parts = min(PIECES, n // PIECE)
    at = range(1, parts)
    if wanted is not None:  # an edge is off by much less than a piece
        own = [(k - 1) * parts // n for k in wanted]
        at = sorted({i for j in own for i in range(j - 1, j + 3)} & set(at))
    if not at:
        return []
    found = rows.agg(F.percentile_approx(x, F.array(*[F.lit(i / parts) for i in at]), F.lit(10_000))).first()[0]
    return sorted(set(found or []))


def piece(x: str, cut: list[float]) -> Column:
    """The number of edges below a value."""
    if 0 < len(cut) <= 16:
        return sum((F.coalesce(F.col(x) > float(e), F.lit(False)).cast("int") for e in cut[1:]), F.coalesce(F.col(x) > float(cut[0]), F.lit(False)).cast("int"))
    return F.size(F.filter(F.array(*[F.lit(float(e)) for e in cut]), lambda e: e < F.col(x))) if cut else F.lit(0)


def at_ranks(rows: DataFrame, x: str, ties: list[str], wanted: list[int]) -> dict[int, Row]:
    """Of rows whose x is a number, those at the wanted ranks (from 1) in the order of x and ties."""
    n = rows.count()
    cut = edges(rows, x, n, [k for k in wanted if k <= n])
    placed = rows.select(x, *ties, piece(x, cut).alias("_p"))
    sizes = {r["_p"]: r["count"] for r in placed.groupBy("_p").count().collect()}  # PIECES rows at most
    where, before = {}, 0
    for p in sorted(sizes):
        where |= {(p, k - before): k for k in wanted if before < k <= before + sizes[p]}
        before += sizes[p]
    if not where:
        return {}
    sought = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(r).alias("r")) for p, r in where])
    ranked = placed.where(F.col("_p").isin(sorted({p for p, _ in where}))).withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(x, *ties)))
    got = ranked.where(F.array_contains(sought, F.struct(F.col("_p").alias("p"), F.col("_r").alias("r")))).collect()  # as many as are wanted
    return {where[r["_p"], r["_r"]]: r for r in got}


def quantiles(rows: DataFrame, x: str, wanted: list[float]) -> list[float]:
    """Exact quantiles with linear interpolation; none of an empty column."""
    rows = rows.select(finite(F.col(x)).alias("_x")).where("_x is not null")
    n = rows.count()
    if n <= PIECE:  # one task's work
        return list(rows.agg(F.percentile("_x", F.array(*[F.lit(q) for q in wanted]))).first()[0] or [])
    spots = [q * (n - 1) for q in wanted]
    got = at_ranks(rows, "_x", [], sorted({f(s) + 1 for s in spots for f in (floor, ceil)}))
    value = lambda k: got[k + 1]["_x"]
    return [value(floor(s)) + (s - floor(s)) * (value(ceil(s)) - value(floor(s))) for s in spots]


def top_fractions(rows: DataFrame, score: str, ties: list[str], fractions: list[float], value: str) -> DataFrame:
    """fraction, n and mean of value among the best ceil(n * f), at least one, for each f.

    The rows at the ends of the tops are found, then one aggregate takes everything up to them."""
    rows = rows.withColumn("_x", -F.col(score))
    n = rows.count()
    take = {f: max(1, -(-n * round(f * 10**6) // 10**6)) for f in fractions}
    last = at_ranks(rows, "_x", ties, sorted(set(take.values())))
    cells = []
    for f, k in take.items():
        if k in last:
            end = F.struct(*[F.lit(last[k][c]).cast(rows.schema[c].dataType).alias(c) for c in ("_x", *ties)])
            inside = F.struct("_x", *ties) <= end
            cells.append(F.struct(F.lit(float(f)).alias("fraction"), F.count_if(inside).alias("n"), F.avg(F.when(inside, F.col(value))).alias("mean")))
    if not cells:
        return rows.sparkSession.createDataFrame([], "fraction double, n bigint, mean double")
    return rows.agg(F.array(*cells).alias("_c")).select(F.explode("_c").alias("_c")).select("_c.*")


def running(rows: DataFrame, x: str, values: list[str]) -> DataFrame:
    """rows, one for each number x, with the sums run_<value> of all rows up to and including their own."""
    cut = edges(rows, x, rows.count())
    placed = rows.withColumn("_piece", piece(x, cut))
    sums = placed.groupBy("_piece").agg(*[F.sum(v).alias(f"_{v}") for v in values])  # PIECES rows at most
    past = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("_piece", *[F.coalesce(F.sum(f"_{v}").over(past), F.lit(0)).alias(f"_{v}") for v in values])
    here = Window.partitionBy("_piece").orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.join(F.broadcast(before), "_piece").withColumns({f"run_{v}": F.sum(v).over(here) + F.col(f"_{v}") for v in values})
    return out.drop("_piece", *[f"_{v}" for v in values])


def _by_score(rows: DataFrame, y: str, score: str) -> DataFrame:
    """Positives _p and others _q at each distinct score, the best first by _x."""
    at = rows.where(F.col(y).isNotNull() & F.col(score).isNotNull()).groupBy((-F.col(score).cast("double")).alias("_x"))
    return at.agg(stats.events(F.col(y)).alias("_p"), F.count_if(F.col(y) <= 0).alias("_q"))


def average_precision(rows: DataFrame, y: str, score: str) -> DataFrame:
    """Mean precision at each positive, from counts at distinct scores."""
    run = running(_by_score(rows, y, score), "_x", ["_p", "_q"])
    at = run.withColumn("_y", F.col("run__p") / (F.col("run__p") + F.col("run__q")) * F.col("_p"))
    return at.agg(stats.ratio(F.sum("_y"), F.sum("_p")).alias("average_precision"))


def auc(rows: DataFrame, y: str, score: str) -> DataFrame:
    """positives, negatives and the area under the ROC curve of the whole table; null for one class."""
    run = running(_by_score(rows, y, score), "_x", ["_p"])
    # each negative is beaten by the positives with better scores, and half by those with its own
    at = run.withColumn("_u", F.col("_q") * (F.col("run__p") - F.col("_p") / 2))
    out = at.agg(F.sum("_u").alias("_u"), F.sum("_p").alias("positives"), F.sum("_q").alias("negatives"))
    return out.withColumn("auc", stats.ratio(F.col("_u"), F.col("positives") * F.col("negatives"))).drop("_u")
