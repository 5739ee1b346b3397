"""Exact top-k search by tiled matrix products.

Queries go to the executors in rounds of bounded size; within a round every task holds its share of
the candidates against them, tile by tile: one matrix product, a partial selection of the k best per
query, merged into the task's list. Tasks' lists are merged per query. Candidates stay where they
are, and no approximation and no index is used.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import materialize
from quarry.llm.vectors import matrix, valid

#: Vectors in a block of candidates and of queries: a tile of scores is at most 64 MB.
SHARD, QUERIES = 8192, 1024
#: Bytes of queries that are sent to every executor at once.
ROUND = 32 << 20
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products without rounding. Products of doubles are exact while every partial
    sum stays below 2**53; beyond, Python's integers are used, and scores past 64 bits become the
    ends of that range."""
    bound = float(np.abs(q).max(initial=0.0)) * float(np.abs(c).max(initial=0.0)) * q.shape[1]
    if bound < 2.0**53:
        return (q @ c.T).astype(np.int64)
    exact = np.array([[int(x) for x in row] for row in q], dtype=object) @ np.array([[int(x) for x in row] for row in c], dtype=object).T
    return np.minimum(np.maximum(exact, LEAST + 1), MOST).astype(np.int64)


def tile_top(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per query the k best candidates of a tile, itself excluded; ties go to smaller ids."""
    order = np.argsort(c_ids, kind="stable")
    c_ids, c = c_ids[order], c[order]
    scores = _scores(q, c)
    n = len(c_ids)
    own = q_ids[:, None] == c_ids[None, :]
    if float(np.abs(scores.astype(np.float64)).max(initial=0)) * n < 2.0**62:
        # score and place in one number without ties: the smaller id is the larger number
        mixed = scores * n + (n - 1 - np.arange(n))
        mixed[own] = LEAST
        take = min(k, n)
        best = np.argpartition(mixed, n - take, axis=1)[:, n - take :]
    else:
        best = np.argsort(np.where(own, MOST, ~scores), axis=1, kind="stable")[:, :k]
    rows, cols = np.repeat(np.arange(len(q_ids)), best.shape[1]), best.ravel()
    fits = ~own[rows, cols]
    rows, cols = rows[fits], cols[fits]
    return q_ids[rows], c_ids[cols], scores[rows, cols]


def shortest(lists: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of lists of query, candidate and score the k best of each query."""
    query, found, score = (np.concatenate(x) for x in zip(*lists, strict=True))
    order = np.lexsort((found, ~score, query))
    query, found, score = query[order], found[order], score[order]
    place = np.arange(len(query)) - np.searchsorted(query, query, side="left")
    return query[place < k], found[place < k], score[place < k]


def search(queries: DataFrame, candidates: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "vector", scale: float | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k best candidates by inner product.

    Candidates with the query's own id are left out; ties go to the smaller vec_id; where fewer than
    k candidates exist all are returned. With scale, components are floor(scale * x) and scores are
    integers; without, components must be integers already. Scores beyond 64 bits are the ends of that
    range. Vectors that are null, empty or hold null or non-finite components, and rows without an id,
    take no part; vectors of unequal length don't meet. A query whose row repeats is one query; if a
    candidate's id repeats, each of its rows is a candidate of its own. Empty tables give an empty
    result."""

    def ready(df: DataFrame) -> DataFrame:
        v = F.col(f"`{vector_col}`")
        df = df.where(valid(v) & F.col(f"`{id_col}`").isNotNull())
        if scale is not None:
            scaled = lambda x: F.lit(float(scale)) * x.cast("double")
            # floor() gives a long; doubles of 2**53 and more are whole
            v = F.transform(v, lambda x: F.when(F.abs(scaled(x)) < 2.0**53, F.floor(scaled(x)).cast("double")).otherwise(scaled(x)))
        return df.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.cast("array<double>").alias("vec"))

    asked = ready(queries).distinct()
    size = asked.agg(F.coalesce(F.sum(F.size("vec")), F.lit(0))).first()[0]
    rounds = max(1, -(-8 * int(size) // ROUND))
    if rounds > 1:
        asked = materialize(asked, "queries")
    taken = ready(candidates)
    sc = taken.sparkSession.sparkContext
    found = []
    for r in range(rounds):
        # at most about ROUND bytes
        table = (asked.where(F.pmod(F.xxhash64("id"), F.lit(rounds)) == r) if rounds > 1 else asked).toArrow().combine_chunks()
        lengths = table.column(1).combine_chunks().value_lengths().to_numpy(zero_copy_only=False) if table.num_rows else np.empty(0)
        by_length = {int(d): (table.column(0).to_numpy()[lengths == d], matrix(table.column(1).combine_chunks().filter(pa.array(lengths == d)))) for d in np.unique(lengths)}
        shared = sc.broadcast(by_length)
        lists = taken.mapInArrow(_lister(shared, k), "query_id bigint, vec_id bigint, score bigint")
        if rounds > 1:
            lists = materialize(lists, "lists")
            shared.unpersist()
        found.append(lists)
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    ranked = reduce(DataFrame.union, found).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _lister(shared, k: int):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        lists: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, vectors = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
            for d, (q_ids, q) in asked.items():
                at = np.flatnonzero(lengths == d)
                c = matrix(vectors.take(pa.array(at))) if len(at) else None
                for s in range(0, len(at), SHARD):
                    for t in range(0, len(q_ids), QUERIES):
                        lists.append(tile_top(q_ids[t : t + QUERIES], q[t : t + QUERIES], ids[at[s : s + SHARD]], c[s : s + SHARD], k))
            if len(lists) > 64:
                lists = [shortest(lists, k)]
        if lists:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in shortest(lists, k)], ["query_id", "vec_id", "score"])

    return run
