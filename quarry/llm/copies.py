"""Near copies among texts, exactly: shingle sets alike by a Jaccard similarity.

SimHash fingerprints of the sets meet in pigeonhole blocks first, and each set is held against the
nearest it meets; that connects the dense groups. Sixty-four bits can't hold all pairs alike by 0.8
(sets at that similarity lie ten bits apart on average), so the rest come from prefixes: all sets are
ordered in one way, rare hashes first, and sets that are alike share a hash near the beginning of
both. Either way a pair becomes a link only by the exact similarity of the two whole sets; pairs that
can't be alike, by how many hashes either set has in each of BUCKETS parts, are told before.

No set is stored. What is shuffled are the prefixes, a fifth of each set, and the texts of documents
that may be like another, once or twice each.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import by_rows, few, materialize, spare
from quarry.llm.components import components

SEED = 42
#: Members of a prefix hash that are compared in one piece.
TILE = 4096
#: One set in SAMPLED goes into the sample that orders the prefixes.
SAMPLED = 32
#: Common hashes that are sent to every executor at most, 16 bytes each.
COMMON = 500_000
#: Hashes of words that a task remembers at most.
REMEMBERED = 60_000
#: Parts of the range of hashes by which sets are sketched.
BUCKETS = 256
#: The same, where sketches are held against each other for every pair that meets; what a set has that
#: doesn't fit.
COARSE = 64
ANY = bytes([255]) * COARSE


# --- shingle sets ----------------------------------------------------------------------------


class _Words(dict):
    """Hashes of words, made once each."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        h = self[word] = xxh64_intdigest(word, SEED)
        return h


def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (fixed values: David Stafford's 13th)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class ShingleSets:
    """Makes sets of 64-bit hashes of runs of `words` words, lower-cased in A-Z alone; one hash of
    the whole sequence if it is shorter, none without a word."""

    def __init__(self, words: int):
        self.words, self.known = words, _Words()

    def __call__(self, text: str) -> np.ndarray:
        w = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: exactly \x20 and \x09-\x0D part words
        if not w:
            return np.empty(0, np.uint64)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        h = np.fromiter(map(self.known.__getitem__, w), np.uint64, len(w))
        run = min(self.words, len(w))
        out = np.full(len(w) - run + 1, run, np.uint64)
        for k in range(run):
            out = _mixed(out ^ h[k : k + len(out)])
        return np.unique(out)


def name_of(hashes: np.ndarray) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(hashes.tobytes(), SEED)


def simhash(hashes: np.ndarray) -> np.uint64:
    """Bit k is set if over half of the hashes have it."""
    ones = np.zeros(64, np.int64)
    for s in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[s : s + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0]


def alike(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether the intersection is `similarity` or more of the union; two empty sets are alike."""
    if len(x) > len(y):
        x, y = y, x
    if len(x) < similarity * len(y) - 1e-9:
        return False
    if not len(y):
        return True
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return both + 1e-9 >= similarity * (len(x) + len(y) - both)


def sketch(hashes: np.ndarray) -> bytes | None:
    """How many hashes are in each part of their range; none if a count doesn't fit a byte."""
    counts = np.bincount((hashes >> np.uint64(56)).astype(np.int64), minlength=BUCKETS)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else None


def names(texts: DataFrame, words: int) -> DataFrame:
    """doc_id, set (a name of the text's shingle set), n (its size), fp (its SimHash), its sketch, and, for
    one set in SAMPLED, its hashes, once in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, told = ShingleSets(words), set()
        for batch in batches:
            own, sizes, fps, samples, sketches = [], [], [], [], []
            for text in batch.column(1):
                h = make(text.as_py())
                name = name_of(h)
                own.append(name)
                sizes.append(len(h))
                fps.append(simhash(h))
                sketches.append(sketch(h))
                wanted = name % SAMPLED == 0 and name not in told
                samples.append(h.tobytes() if wanted else None)
                if wanted:
                    told.add(name)
            long = lambda v: pa.array(np.array(v, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), long(own), pa.array(sizes, pa.int64()), long(fps), pa.array(sketches, pa.binary()), pa.array(samples, pa.binary())], ["doc_id", "set", "n", "fp", "sketch", "hashes"])

    return texts.mapInArrow(run, "doc_id bigint, set bigint, n bigint, fp bigint, sketch binary, hashes binary")


# --- pairs -----------------------------------------------------------------------------------


def common(named: DataFrame, least: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Hashes found in `least` sampled sets or more, sorted, at most COMMON of the commonest, and in how
    many. They order the prefixes and say how many pieces a hash is dealt into; pairs are the same
    with any list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int64))], ["h"])

    sample = named.where("hashes is not null").dropDuplicates(["set"]).select("hashes").mapInArrow(run, "h bigint")
    found = sample.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= least).orderBy(F.col("c").desc(), "h").limit(COMMON).toArrow()
    h, c = found.column("h").to_numpy().view(np.uint64), found.column("c").to_numpy()
    order = np.argsort(h)
    return h[order], c[order]


def prefixes(texts: DataFrame, words: int, similarity: float, order: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """h, tile, set, sized, component: the first hashes of each set, of which two sets alike by
    `similarity` share one. texts: doc_id, text, and set and component where they are known.

    Sets alike by s share at least s of the hashes of either, so those cannot all lie behind the
    first n - ceil(s n) + 1 of both. sized holds n and the place; a null component is the set. A hash
    in many sets is dealt into pieces, and each pair of pieces is a tile: its members are repeated
    once a piece. A task tells each set once."""
    shared = texts.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, told = ShingleSets(words), set()
        known, count = shared.value
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            for text, set_, component in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                h = make(text.as_py())
                n, name = len(h), name_of(h)
                name = name - (1 << 64) if name >> 63 else name
                if not n or name in told:
                    continue
                told.add(name)
                pieces = np.ones(n, np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    rank = np.where(known[at] == h, count[at], 0)
                    sort = np.lexsort((h, rank))
                    h, pieces = h[sort], np.maximum(1, -(-rank[sort] * SAMPLED // TILE))
                first = n - ceil(similarity * n - 1e-9) + 1
                h, pieces, place = h[:first], pieces[:first], np.arange(first)
                tile = np.zeros(first, np.int64)
                if pieces.max() > 1:
                    own = name % pieces
                    at = np.repeat(np.arange(first), pieces)
                    other = np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                    tile = (np.minimum(own[at], other) << 31) | np.maximum(own[at], other)
                    h, place = h[at], place[at]
                for column, x in zip(out, (h.view(np.int64), tile, np.full(len(h), name), n << 32 | place, np.full(len(h), component if set_ == name and component is not None else name)), strict=True):
                    column.append(x)
            if out[0]:
                columns = [np.concatenate(x) for x in out]
                columns[4] = pa.array(columns[4], mask=columns[4] == columns[2])  # most are the set itself
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns[:4]), columns[4]], ["h", "tile", "set", "sized", "component"])

    return texts.mapInArrow(run, ENTRY)


ENTRY = "h bigint, tile bigint, set bigint, sized bigint, component bigint"


def _by_run(entries: DataFrame, each, schema: str) -> DataFrame:  # noqa: ANN001
    """Apply each(entries, run numbers, coarse sketches or nothing) to whole runs of one hash and tile, in
    order of size."""
    sketched = "coarse" in entries.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, coarse = np.empty((0, 5), np.int64), np.empty((0, COARSE), np.uint8)
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
            columns.append(batch.column(4).fill_null(0).to_numpy(zero_copy_only=False))
            columns[4] = np.where(batch.column(4).is_null().to_numpy(zero_copy_only=False), columns[2], columns[4])
            held = np.concatenate([held, np.stack(columns, axis=1)])
            if sketched:
                coarse = np.concatenate([coarse, np.frombuffer(b"".join(v if v is not None else ANY for v in batch.column(5).to_pylist()), np.uint8).reshape(-1, COARSE)])
            # the last run may go on in the next batch
            other = np.flatnonzero(np.any(held[:, :2] != held[-1, :2], axis=1))
            done = int(other[-1]) + 1 if len(other) else 0
            if done:
                yield from each(held[:done], _runs(held[:done]), coarse[:done] if sketched else None)
                held, coarse = held[done:], coarse[done:]
        if len(held):
            yield from each(held, _runs(held), coarse if sketched else None)

    return entries.repartition("h", "tile").sortWithinPartitions("h", "tile", "sized", "set").mapInArrow(run, schema)


def _runs(rows: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.any(rows[1:, :2] != rows[:-1, :2], axis=1))])


def meeting(entries: DataFrame) -> DataFrame:
    """The entries of hashes under which sets of different components meet."""

    def each(rows: np.ndarray, run_of: np.ndarray, _: None) -> Iterator[pa.RecordBatch]:
        component = rows[:, 4]
        starts = np.flatnonzero(np.concatenate([[True], run_of[1:] != run_of[:-1]]))
        apart = np.minimum.reduceat(component, starts) != np.maximum.reduceat(component, starts)
        kept = rows[apart[run_of]]
        if len(kept):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in kept.T], ["h", "tile", "set", "sized", "component"])

    return _by_run(entries, each, ENTRY)


def pairs(entries: DataFrame, similarity: float, steps: int | None = None) -> DataFrame:
    """a, b: sets of different components that share a hash of their prefixes and may be alike, by
    sizes and places. steps: only the next so many in order of size, and with them the set in which
    the hash comes first of all: copies that were edited apart have rarer hashes before it than what
    they were made from, so that one is likely to be like all of them. Where entries carry coarse
    sketches, pairs that these tell apart are left out."""

    def each(rows: np.ndarray, run_of: np.ndarray, coarse: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        ends = np.searchsorted(run_of, run_of, side="right")
        name, component = rows[:, 2], rows[:, 4]
        n, place = rows[:, 3] >> 32, rows[:, 3] & 0xFFFFFFFF

        def near(at: np.ndarray, to: np.ndarray) -> np.ndarray:
            most = np.minimum(place[at], place[to]) + np.minimum(n[at] - place[at], n[to] - place[to])
            keep = (component[at] != component[to]) & (most * (1 + similarity) + 1e-6 >= similarity * (n[at] + n[to]))
            at, to = at[keep], to[keep]
            if coarse is not None and len(at):
                keep = np.empty(len(at), bool)
                for s in range(0, len(at), 100_000):
                    x, y = at[s : s + 100_000], to[s : s + 100_000]
                    # ANY bounds nothing: its partner's own size is what is left
                    most = np.minimum(coarse[x], coarse[y]).sum(1, dtype=np.int64)
                    keep[s : s + 100_000] = (most == 255 * COARSE) | (most * (1 + similarity) + 1e-6 >= similarity * (n[x] + n[y]))
                at, to = at[keep], to[keep]
            a, b = name[at], name[to]
            return np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)

        at, step = np.arange(len(rows)), 1
        found: list[np.ndarray] = []
        if steps is not None:
            first = np.lexsort((at, place, run_of))
            starts = np.flatnonzero(np.concatenate([[True], run_of[1:] != run_of[:-1]]))
            found.append(near(at, first[starts][run_of]))
        while steps is None or step <= steps:
            at = at[at + step < ends[at]]
            at = at[n[at] + 1e-9 >= similarity * n[at + step]]  # in order of n: what fails now fails later
            if not len(at):
                break
            found.append(near(at, at + step))
            step += 1
            if sum(map(len, found)) > 1_000_000:
                yield told(found)
                found = []
        if found:
            yield told(found)

    def told(found: list[np.ndarray]) -> pa.RecordBatch:
        # most pairs meet under many hashes
        once = np.unique(np.concatenate(found), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(once[:, 0]), pa.array(once[:, 1])], ["a", "b"])

    return _by_run(entries, each, "a bigint, b bigint").distinct()


def verified(met: DataFrame, owners: DataFrame, texts: DataFrame, words: int, similarity: float, repeated: bool) -> DataFrame:
    """Of the pairs a, b the links: those whose sets are alike. owners: set, doc_id, n and sketch; repeated:
    whether a doc_id may have more rows than one."""
    ends = lambda p: materialize(p.select(F.explode(F.array("a", "b")).alias("set")).distinct(), "ends")
    met = materialize(met, "pairs")
    met = materialize(_likely(met, materialize(owners.join(few(ends(met)), "set"), "sketches"), similarity), "likely")
    sought = materialize(owners.select("set", "doc_id").join(few(ends(met)), "set"), "sought")
    own = texts.join(few(sought), "doc_id").select("set", "text")
    if repeated:
        own = _own(own, words).dropDuplicates(["set"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, last, x = ShingleSets(words), None, np.empty(0, np.uint64)
        for batch in batches:
            keep = []
            for a, ta, tb in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if a != last:
                    last, x = a, make(ta.as_py())
                keep.append(alike(x, make(tb.as_py()), similarity))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda c, t: own.select(F.col("set").alias(c), F.col("text").alias(t))
    return by_rows(met, met.count()).join(side("b", "tb"), "b").join(side("a", "ta"), "a").select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint")


def with_coarse(entries: DataFrame, distinct: DataFrame) -> DataFrame:
    """The entries with their sets' sketches in COARSE parts. distinct: set, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column(1).to_pylist():
                c = np.frombuffer(v, np.uint8).reshape(COARSE, -1).sum(1, dtype=np.int64) if v is not None else None
                out.append(c.astype(np.uint8).tobytes() if c is not None and c.max() < 255 else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["set", "coarse"])

    sets = entries.select("set").distinct()
    own = distinct.select("set", "sketch").join(sets, "set", "left_semi").mapInArrow(run, "set bigint, coarse binary")
    return entries.join(own, "set", "left").select("h", "tile", "set", "sized", "component", "coarse")


def _likely(met: DataFrame, ends: DataFrame, similarity: float) -> DataFrame:
    """The pairs a, b that may be alike by sizes and sketches: two sets share no more hashes in a part of
    their range than the smaller has there. ends: set, n, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            none = column.is_null().to_numpy(zero_copy_only=False)
            return none, np.frombuffer(b"".join(v if v is not None else bytes(BUCKETS) for v in column.to_pylist()), np.uint8).reshape(-1, BUCKETS)

        for batch in batches:
            if batch.num_rows:
                size = sum(batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
                (no_a, a), (no_b, b) = counts(batch.column(4)), counts(batch.column(5))
                most = np.minimum(a, b).sum(1, dtype=np.int64)
                keep = no_a | no_b | (most * (1 + similarity) + 1e-6 >= similarity * size)
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    side = lambda c: ends.select(F.col("set").alias(c), F.col("n").alias(f"{c}n"), F.col("sketch").alias(f"{c}s"))
    return by_rows(met, met.count()).join(by_rows(side("b"), ends.count()), "b").join(by_rows(side("a"), ends.count()), "a").select("a", "b", "an", "bn", "as", "bs").mapInArrow(run, "a bigint, b bigint")


def _own(rows: DataFrame, words: int) -> DataFrame:
    """The rows set, text whose text has that set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = ShingleSets(words)
        for batch in batches:
            names_ = np.array([name_of(make(t.as_py())) for t in batch.column(1)], np.uint64).view(np.int64)
            yield batch.filter(pa.array(names_ == batch.column(0).to_numpy(zero_copy_only=False)))

    return rows.mapInArrow(run, "set bigint, text string")


# --- groups ----------------------------------------------------------------------------------


def nearest(distinct: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs a, b of sets to begin with. distinct: set, fp; links: a, b, fingerprints that are close.

    Sets that share a fingerprint hang on the least of them, and the least set of a fingerprint is
    held against that of the nearest fingerprint among those above it and among those below."""
    of = distinct.groupBy("fp").agg(F.min("set").alias("low"))
    same = distinct.join(of, "fp").where("set <> low").select(F.col("low").alias("a"), F.col("set").alias("b"))
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    bits = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    best = both.groupBy(F.col("a").alias("own"), (F.col("a") < F.col("b")).alias("_up")).agg(F.min_by("b", F.struct(bits, F.col("b"))).alias("other"))
    named = lambda c: of.select(F.col("fp").alias(c), F.col("low").alias(f"{c}_set"))
    other = best.join(named("own"), "own").join(named("other"), "other").select(F.least("own_set", "other_set").alias("a"), F.greatest("own_set", "other_set").alias("b"))
    return same.union(other).distinct()


def groups(docs: DataFrame, texts: DataFrame, words: int, similarity: float, close) -> DataFrame:  # noqa: ANN001
    """doc_id and component_id (the smallest doc_id of the group) of stored rows of names().
    close: links between distinct fingerprints fp, as a, b."""
    by_id = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("m"))
    repeated = not by_id.where("m > 1").isEmpty()
    distinct = materialize(docs.groupBy("set").agg(F.min("doc_id").alias("rep"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "distinct")
    named = distinct.where("rep is not null")
    owners = named.select("set", F.col("rep").alias("doc_id"), "n", "sketch")
    texts = texts.where("doc_id is not null")
    check = lambda met: materialize(verified(met, owners, texts, words, similarity, repeated), "links")
    links = check(nearest(named.where("n > 0"), materialize(close(named.where("n > 0").select("fp").distinct()), "close")))
    if repeated:  # rows that share a smallest doc_id are one document
        of_one = named.groupBy("rep").agg(F.min("set").alias("a")).join(named, "rep").where("set <> a").select("a", F.col("set").alias("b"))
        links = links.union(of_one)
    stars = _stars(components(links))
    known = materialize(owners.select("set", "doc_id").join(stars.select(F.col("b").alias("set"), F.col("a").alias("component")), "set").select("doc_id", "set", "component"), "known")
    met = materialize(meeting(prefixes(texts.join(few(known), "doc_id", "left").select("doc_id", "text", "set", "component"), words, similarity, common(docs))), "meeting")
    # few pairs of each first, in two rounds, which connect what the fingerprints have missed of dense groups:
    # sets that have one component by then are not held against each other
    now = met
    for steps in (1, 8):
        more = check(pairs(now, similarity, steps))
        if not more.isEmpty():
            stars = _stars(components(stars.union(more)))
            now = materialize(meeting(met.drop("component").join(stars.select(F.col("b").alias("set"), F.col("a").alias("component")), "set", "left").select("h", "tile", "set", "sized", "component")), "meeting")
    found = components(stars.union(check(pairs(with_coarse(now, distinct), similarity)))).withColumnRenamed("node", "set")
    ids = found.join(distinct, "set").groupBy("component").agg(F.min("rep").alias("component_id"))
    linked = found.join(ids, "component").select("set", "component_id")
    of = distinct.join(linked, "set", "left").select("set", F.coalesce("component_id", "rep").alias("component_id"))
    # stored, so that the last join shuffles both sides itself and a hot set can be split
    return docs.select("doc_id", "set").join(materialize(of, "classes"), "set").select("doc_id", "component_id")


def _stars(found: DataFrame) -> DataFrame:
    """Nodes and their components as links a, b: each component holds itself as well."""
    return materialize(found.select(F.col("component").alias("a"), F.col("node").alias("b")), "stars")


def keep_first(df: DataFrame, grouped: DataFrame, id_col: str) -> DataFrame:
    """The rows of df whose id is the smallest of its group, once each; rows without an id stay.
    grouped: doc_id, component_id, stored."""
    by_id = grouped.groupBy("doc_id").agg(F.max("component_id").alias("m"), F.count(F.lit(1)).alias("n"))
    own = spare(df, "_dropped")
    id_: Column = F.col(f"`{id_col}`")
    dropped = few(materialize(by_id.where("m <> doc_id").select(F.col("doc_id").alias(own)), "dropped"))
    out = df.join(dropped, id_.cast("long") == F.col(own), "left_anti")
    if not by_id.where("m = doc_id and n > 1").isEmpty():
        out = out.where(id_.isNotNull()).dropDuplicates([id_col]).unionByName(out.where(id_.isNull()))
    return out.select(*[F.col(f"`{c}`") for c in df.columns])
