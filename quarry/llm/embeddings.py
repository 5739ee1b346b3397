"""Near-duplicates among embeddings: all pairs by cosine, in tiles of an int8 quantised product.

Unit vectors are quantised to int8 twice, the second time what the first lost, and the norms of both
errors are kept. |u.v - x.y| <= |e_u| + |e_v| + 3 |e_u| |e_v| for quantised x, y, so the first product
with this bound decides most pairs, the second nearly all others; only pairs that both leave open are
computed in doubles, from the vectors. int8 products are summed exactly, so the bounds hold at any
dimension. Equal vectors are one class with a multiplicity, so copies are never paired.

Vectors are dealt into `side` groups by a hash, and a task compares two groups: codes of two bytes a
component are sent to `side` tasks each. A task tells a vector's links as one number, and which vectors
its links connect as a spanning forest, however dense a cluster is.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialize
from quarry.llm.components import Forest, components
from quarry.llm.vectors import matrix, valid

#: Vectors on a side of one product, and bytes of codes that a task holds.
BLOCK, HELD = 2048, 64 << 20
#: Above the rounding of what is left in single precision once the int8 product is exact.
SLACK = 2e-6
#: Components whose int8 products single precision sums exactly: 127 * 127 * 1024 < 2**24.
EXACT = 1024


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length one; scaled by their largest component first, so that no square overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def quantise(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales, and the norm of each row's error, rounded up. Zero rows stay zero."""
    scale = np.abs(u).max(axis=1) / 127.0
    scale[scale == 0] = 1.0
    q = np.rint(u / scale[:, None]).astype(np.int8)
    error = u - q * scale[:, None]
    return q, scale, np.sqrt(np.einsum("ij,ij->i", error, error)) * (1 + 1e-9) + 1e-15


class Codes:
    """Vectors as two int8 numbers a component: nodes, copies, codes, scales and error norms."""

    def __init__(self, node: np.ndarray, copies: np.ndarray, first: np.ndarray, second: np.ndarray, numbers: np.ndarray):
        self.node, self.copies, self.first, self.second, self.numbers = node, copies, first, second, numbers

    @classmethod
    def of(cls, node: np.ndarray, copies: np.ndarray, vectors: np.ndarray) -> Codes:
        u = unit(vectors)
        q, s, e = quantise(u)
        q2, s2, e2 = quantise(u - q * s[:, None])
        return cls(node, copies, q, q2, np.stack([s, e, s2, e2], axis=1))

    @classmethod
    def joined(cls, parts: list[Codes]) -> Codes:
        return cls(*(np.concatenate([getattr(p, k) for p in parts]) for k in ("node", "copies", "first", "second", "numbers")))

    def __len__(self) -> int:
        return len(self.node)

    def __getitem__(self, at) -> Codes:  # noqa: ANN001
        return Codes(self.node[at], self.copies[at], self.first[at], self.second[at], self.numbers[at])

    def fine(self, at: np.ndarray) -> np.ndarray:
        """Both codes together, in doubles."""
        return self.first[at] * self.numbers[at, 0, None] + self.second[at] * self.numbers[at, 2, None]


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of int8 rows, exact integers."""
    if a.shape[1] <= EXACT:
        return a.astype(np.float32) @ b.astype(np.float32).T
    pieces = range(0, a.shape[1], EXACT)
    return sum((a[:, k : k + EXACT].astype(np.float32) @ b[:, k : k + EXACT].astype(np.float32).T).astype(np.float64) for k in pieces)


def close(a: Codes, b: Codes, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs of rows of a and b at cosine >= threshold, and pairs that the codes leave open; of one
    block with itself, i < j."""
    value = (product(a.first, b.first) * a.numbers[:, 0, None].astype(np.float32)).astype(np.float32) * b.numbers[:, 0].astype(np.float32)
    bound = lambda e: e + 1.5 * e**2
    width = bound(a.numbers[:, 1, None]).astype(np.float32) + bound(b.numbers[:, 1]).astype(np.float32)
    i, j = np.divmod(np.flatnonzero(value + width >= np.float32(threshold - SLACK)), len(b))
    if same:
        i, j = i[i < j], j[i < j]
    sure = value[i, j] - width[i, j] >= np.float32(threshold + SLACK)
    undecided = np.flatnonzero(~sure)
    left_open = np.zeros(len(i), bool)
    for s in range(0, len(undecided), 100_000):
        at = undecided[s : s + 100_000]
        x = np.einsum("ij,ij->i", a.fine(i[at]), b.fine(j[at]))
        w = bound(a.numbers[i[at], 3]) + bound(b.numbers[j[at], 3]) + 1e-12
        sure[at] = x - w >= threshold
        left_open[at] = (x + w >= threshold) & ~sure[at]
    return i[sure], j[sure], i[left_open], j[left_open]


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of matching rows, in doubles."""
    x, y = x / np.abs(x).max(axis=1, keepdims=True), y / np.abs(y).max(axis=1, keepdims=True)
    dot = lambda p, q: np.einsum("ij,ij->i", p, q)
    return dot(x, y) / (np.sqrt(dot(x, x)) * np.sqrt(dot(y, y)))


class _Tile:
    """Compares the vectors of one group with each other, or with those of another as they come."""

    def __init__(self, threshold: float, same: bool):
        self.threshold, self.same = threshold, same
        self.held: list[Codes] = []
        self.links: list[np.ndarray] = []
        self.start: list[int] = []
        self.forest = Forest()

    def _hold(self, block: Codes) -> None:
        self.start.append(len(self.forest.label))
        self.forest.grow(len(block))
        self.held.append(block)
        self.links.append(np.zeros(len(block), np.int64))

    def hold(self, codes: Codes) -> None:
        for s in range(0, len(codes), BLOCK):
            self._hold(codes[s : s + BLOCK])

    def meet(self, codes: Codes) -> Iterator[pa.RecordBatch]:
        for s in range(0, len(codes), BLOCK):
            block = codes[s : s + BLOCK]
            if self.same:
                self._hold(block)
                own, at = self.links[-1], self.start[-1]
            else:
                own, at = np.zeros(len(block), np.int64), len(self.forest.label)
                self.forest.grow(len(block))
            for other, links, start in zip(self.held, self.links, self.start, strict=True):
                same = self.same and start == at
                i, j, oi, oj = close(other, block, self.threshold, same)
                if len(i):
                    links += np.bincount(i, block.copies[j], len(other)).astype(np.int64)
                    own += np.bincount(j, other.copies[i], len(block)).astype(np.int64)
                    new = self.forest.add(start + i, at + j)
                    yield told(other.node[i[new]], block.node[j[new]], None)
                if len(oi):
                    yield told(other.node[oi], block.node[oj], 0)
            if not self.same:
                yield told(block.node, None, own)

    def counts(self) -> Iterator[pa.RecordBatch]:
        for block, links in zip(self.held, self.links, strict=True):
            yield told(block.node, None, links)


def told(a: np.ndarray, b: np.ndarray | None, links: np.ndarray | int | None) -> pa.RecordBatch:
    """A link (a, b), a number of links of a, or an open pair (a, b, 0)."""
    if b is None:
        a, links = a[links > 0], links[links > 0]
    n = len(a)
    third = pa.nulls(n, pa.int64()) if links is None else pa.array(np.zeros(n, np.int64) if isinstance(links, int) else links)
    return pa.RecordBatch.from_arrays([pa.array(a), pa.nulls(n, pa.int64()) if b is None else pa.array(b), third], ["a", "b", "links"])


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """grp, rep, copies, vec into blocks of codes by group."""
    for batch in batches:
        if not batch.num_rows:
            continue
        group, node, copies = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        vectors = matrix(batch.column(3))
        for g in np.unique(group).tolist():
            at = np.flatnonzero(group == g)
            for s in range(0, len(at), BLOCK):
                c = Codes.of(node[at[s : s + BLOCK]], copies[at[s : s + BLOCK]], vectors[at[s : s + BLOCK]])
                yield pa.RecordBatch.from_arrays([pa.array([g], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (c.node, c.copies, c.first, c.second, c.numbers))], ["grp", "node", "copies", "first", "second", "numbers"])


def _tiles(threshold: float):  # noqa: ANN202
    def decoded(batch: pa.RecordBatch, r: int) -> Codes:
        raw = [batch.column(k)[r].as_py() for k in range(3, 8)]
        node, copies = np.frombuffer(raw[0], np.int64), np.frombuffer(raw[1], np.int64)
        first, second = (np.frombuffer(x, np.int8).reshape(len(node), -1) for x in raw[2:4])
        return Codes(node, copies, first, second, np.frombuffer(raw[4], np.float64).reshape(-1, 4))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tile, waiting, grp = None, None, [], None

        def flush() -> Iterator[pa.RecordBatch]:
            if waiting:
                codes = Codes.joined(waiting)
                waiting.clear()
                if now[0] == now[1] or grp == now[1]:
                    yield from tile.meet(codes)
                else:
                    tile.hold(codes)

        for batch in batches:
            for r in range(batch.num_rows):
                key, g = (batch.column(0)[r].as_py(), batch.column(1)[r].as_py()), batch.column(2)[r].as_py()
                if key != now or g != grp or sum(map(len, waiting)) >= 4 * BLOCK:
                    yield from flush()
                if key != now:
                    if tile:
                        yield from tile.counts()
                    now, tile = key, _Tile(threshold, key[0] == key[1])
                grp = g
                waiting.append(decoded(batch, r))
        if tile:
            yield from flush()
            yield from tile.counts()

    return run


def _links(distinct: DataFrame, n: int, dimension: int, threshold: float) -> DataFrame:
    """a, b, links as told() has them, for stored vectors rep, copies, vec of one length."""
    spark = distinct.sparkSession
    side = max(1, ceil(n * dimension * 2 / HELD), min(ceil(sqrt(2 * spark.sparkContext.defaultParallelism)), ceil(n / BLOCK)))
    dealt = distinct.select(F.pmod(F.xxhash64("rep", F.lit("group")), F.lit(side)).cast("long").alias("grp"), "rep", "copies", "vec")
    coded = materialize(dealt.mapInArrow(_encode, "grp bigint, node binary, copies binary, first binary, second binary, numbers binary"), "codes")
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(side - 1).cast("long"))).alias("k")
    sent = coded.select("*", k).select(F.least("grp", "k").alias("i"), F.greatest("grp", "k").alias("j"), "grp", "node", "copies", "first", "second", "numbers")
    tiles = sent.repartition(side * (side + 1) // 2, "i", "j").sortWithinPartitions("i", "j", "grp")
    return tiles.mapInArrow(_tiles(threshold), "a bigint, b bigint, links bigint")


def _settled(pairs: DataFrame, distinct: DataFrame, threshold: float) -> DataFrame:
    """The open pairs a, b that are links, with the copies of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.select([0, 1, 2, 3]).filter(pa.array(cosine(matrix(batch.column(4)), matrix(batch.column(5))) >= threshold))

    side = lambda c: distinct.select(F.col("rep").alias(c), F.col("copies").alias(f"{c}n"), F.col("vec").alias(f"{c}v"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "an", "bn", "av", "bv").mapInArrow(run, "a bigint, b bigint, an bigint, bn bigint")


def near_duplicates(df: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row a vector: vec_id, n_links (other vectors at cosine >= threshold), component_id (the
    smallest vec_id reachable by links, itself included) and kept (it is that smallest).

    Null and empty vectors, zero vectors, vectors with null or non-finite components and rows without
    a vec_id link with nothing; the latter have no component_id and are not kept. Vectors of unequal
    length link with nothing of another length. Equal vectors are linked with each other; if an id
    repeats, its rows are vectors of their own with a shared id. Other columns are ignored. An empty
    table gives an empty result. The threshold must be above 0."""
    vec = F.col(f"`{vector_col}`")
    id_ = F.col(f"`{id_col}`").cast("long")
    usable = id_.isNotNull() & valid(vec) & F.exists(vec, lambda x: x != 0)
    base = df.select(id_.alias("vec_id"), F.when(usable, F.transform(vec, lambda x: x.cast("double"))).alias("vec"))
    # equal vectors are known by 128 bits of hash, so that only one of them travels
    hashed = base.where("vec is not null").select("vec_id", "vec", F.xxhash64("vec").alias("h"), F.xxhash64("vec", F.lit("second")).alias("g"))
    distinct = materialize(hashed.groupBy("h", "g").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("vec").alias("vec")), "vectors")
    lengths = [tuple(r) for r in distinct.groupBy(F.size("vec")).count().collect()]
    if not lengths:
        return base.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    found = materialize(reduce(DataFrame.union, [_links(distinct.where(F.size("vec") == d), n, d, threshold) for d, n in lengths]), "near")
    counts = found.where("b is null").select(F.col("a").alias("node"), "links")
    edges = found.where("b is not null and links is null").select("a", "b")
    undecided = found.where("links = 0").select("a", "b")
    if not undecided.isEmpty():
        more = materialize(_settled(undecided, distinct, threshold), "settled")
        counts = counts.union(more.select("a", "bn")).union(more.select("b", "an"))
        edges = edges.union(more.select("a", "b"))
    linked = counts.groupBy("node").agg(F.sum("links").alias("far_links"))
    groups = components(edges).withColumnRenamed("node", "member")
    by_class = (
        distinct.select("h", "g", "rep", "copies")
        .join(linked, F.col("rep") == F.col("node"), "left")
        .join(groups, F.col("rep") == F.col("member"), "left")
        .select("h", "g", (F.col("copies") - 1 + F.coalesce("far_links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    # stored, so that the join shuffles both sides itself and a hot vector can be split
    back = hashed.select("vec_id", "h", "g").join(materialize(by_class, "classes"), ["h", "g"]).select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    alone = base.where("vec is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return back.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
