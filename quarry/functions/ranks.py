"""Ranks, tails, bands and groups within cross-sections.

All take the columns that make a cross-section; nulls and non-finite values take no part and get
false, null or -1, as each says. Every window is over one cross-section, so cross-sections spread
over the cluster; none of them is ever sorted as a whole."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from quarry.functions.parse import finite


def pct_rank(x: Column, by: list[str | Column]) -> Column:
    """Rank divided by the number of values, ties sharing their average rank.

    Rank, ties and count are windows over the same partitions, rank and ties in the same order: one
    shuffle by cross-section and one sort a column."""
    v = finite(x)
    w = Window.partitionBy(*by).orderBy(v.asc_nulls_last())
    ties = F.count(F.lit(1)).over(w.rangeBetween(Window.currentRow, Window.currentRow))
    n = F.count(v).over(Window.partitionBy(*by))
    return F.when(v.isNotNull(), (F.rank().over(w) + (ties - 1) / 2) / n)


def first_rank(x: Column, by: list[str | Column], tie: list[str | Column]) -> tuple[Column, Column]:
    """Rank from 1 with ties in the order of `tie`, and the number of values."""
    v = finite(x)
    r = F.row_number().over(Window.partitionBy(*by).orderBy(v.asc_nulls_last(), *tie))
    return F.when(v.isNotNull(), r), F.count(v).over(Window.partitionBy(*by))


def tail(rank: Column, fraction: float, direction: str) -> Column:
    """Whether a percentile rank lies in the tail; both ends inclusive, null is no."""
    if not 0 < fraction <= 1:
        raise ValueError(f"a fraction above 0, up to 1: {fraction}")
    if direction not in ("upper", "lower"):
        raise ValueError(f"upper or lower: {direction}")
    return F.coalesce(rank >= 1 - fraction if direction == "upper" else rank <= fraction, F.lit(False))


def bands(rank: Column, fractions: list[float], direction: str) -> Column:
    """The label `direction_low_high` of the innermost band of nested tails; null outside all."""
    out, low = F.lit(None).cast("string"), None
    edges = sorted(fractions)
    for f in reversed(edges):
        low = edges[edges.index(f) - 1] if edges.index(f) else 0.0
        out = F.when(tail(rank, f, direction), F.lit(f"{direction}_{low:g}_{f:g}")).otherwise(out)
    return out


def deciles(x: Column, by: list[str | Column], tie: list[str | Column], groups: int = 10) -> Column:
    """ceil(pct * groups) - 1 of the first rank, from 0; -1 for nulls."""
    r, n = first_rank(x, by, tie)
    g = F.ceil(r * F.lit(groups) / n).cast("int") - 1
    # least and greatest skip nulls, so nulls are told apart first
    return F.when(r.isNull(), F.lit(-1)).otherwise(F.greatest(F.lit(0), F.least(F.lit(groups - 1), g)))


def groups_floor(x: Column, by: list[str | Column], tie: list[str | Column], groups: int) -> Column:
    """floor(pct * groups), at most groups - 1, in cross-sections of at least `groups` values; a value
    on an edge goes up. -1 for nulls and small cross-sections."""
    r, n = first_rank(x, by, tie)
    g = F.floor(r * F.lit(groups) / n).cast("int")
    return F.when(r.isNull() | (n < groups), F.lit(-1)).otherwise(F.least(F.lit(groups - 1), g))


def quantile_cut(rank: Column, n: Column, groups: int) -> Column:
    """Group from 0 of a first rank cut at linear quantiles of 1..n, right-closed."""
    return F.when(rank.isNotNull(), F.greatest(F.lit(0), F.ceil((rank - 1) * F.lit(float(groups)) / F.greatest(n - 1, F.lit(1)) - 1e-12).cast("int") - 1))


def by_thresholds(x: Column, edges: list[float], labels: list[str], unknown: str = "UNKNOWN") -> Column:
    """The label of the first edge that x does not exceed, else the last label."""
    v = finite(x)
    out = F.lit(labels[-1])
    for e, name in reversed(list(zip(edges, labels, strict=False))):
        out = F.when(v <= e, F.lit(name)).otherwise(out)
    return F.when(v.isNull(), F.lit(unknown)).otherwise(out)
