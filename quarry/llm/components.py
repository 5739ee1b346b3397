"""Connected components of a graph given by links, by alternating star contractions.

Each round a node's larger neighbours are hung on its smallest one (large star), then its smaller
ones (small star); the graph turns into stars in a number of rounds that grows with the logarithm of
the longest path. Minima are summed up before the shuffle, joins are plain equi-joins that adaptive
execution splits where a node has very many links, and each round is written to the shared folder. No round sends
many links out whole: the driver would hold them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import by_rows, materialize


def _least(df: DataFrame) -> DataFrame:
    return df.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(links: DataFrame, rows: int) -> DataFrame:
    """links: u > v, `rows` of them. Every neighbour above u, and u, hangs on the least of u and its neighbours."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
    above = links.select(F.col("v").alias("n"), F.col("u").alias("o"))  # o is above n
    hung = by_rows(above, rows).join(by_rows(least, rows), "n").select(F.col("o").alias("u"), F.col("m").alias("v"))
    own = least.where("n > m").select(F.col("n").alias("u"), F.col("m").alias("v"))
    return hung.union(own).distinct()


def _small_star(links: DataFrame, rows: int) -> DataFrame:
    """links: u > v, about `rows` of them. All neighbours below u, and u, hang on the least of them."""
    least = _least(links)
    hung = by_rows(links, rows).join(by_rows(least, rows), "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return hung.union(own).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """node, component: the smallest node reachable, for every node that has a link.

    Links may repeat, run either way, join a node with itself (ignored) or be null (ignored). An
    empty table gives an empty result."""
    kind = links.schema[a].dataType
    u, v = F.col(a), F.col(b)
    ordered = links.where(u != v).select(F.greatest(u, v).cast(kind).alias("u"), F.least(u, v).cast(kind).alias("v")).distinct()
    now = materialize(ordered, "links")
    before, rows = None, now.count()
    for _ in range(rounds):
        now = materialize(_small_star(_large_star(now, rows), rows), "stars")
        # equal tables of links have equal counts and sums of hashes
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before, rows = tuple(state), state[0]
    raise RuntimeError(f"no end after {rounds} rounds")


class Forest:
    """Which of a run of links between numbered places connect anything new."""

    def __init__(self, n: int = 0):
        self.label = np.arange(n)

    def grow(self, n: int) -> None:
        self.label = np.concatenate([self.label, np.arange(len(self.label), len(self.label) + n)])

    def _top(self, i: np.ndarray) -> np.ndarray:
        top = self.label[i]
        while not np.array_equal(up := self.label[top], top):
            top = up
        self.label[i] = top
        return top

    def add(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Places in i, j of the links that were needed."""
        at, taken = np.arange(len(i)), []
        while len(at):
            x, y = self._top(i[at]), self._top(j[at])
            apart = x != y
            at, x, y = at[apart], x[apart], y[apart]
            high, first = np.unique(np.maximum(x, y), return_index=True)  # each tree hangs on a lower one by one link
            taken.append(at[first])
            self.label[high] = np.minimum(x, y)[first]
        return np.concatenate(taken) if taken else at
