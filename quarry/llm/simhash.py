"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked at a small Hamming distance.

Pairs come from pigeonhole blocks. Of `blocks` blocks at least blocks - max_bits agree for any pair
within max_bits, so each fingerprint is filed once under every choice of that many blocks, and only
fingerprints in one bucket are compared, bit by bit. With 7 blocks and 4 bits the keys are 27 bits
of the fingerprint, so chance meetings stay rare at billions of documents.

Work is done on distinct fingerprints. A bucket above BUCKET members is dealt into chunks whose
pairs are compared in tasks of their own. A task emits a spanning forest of the links that it
finds, not the links, so the output grows with the members, however dense a group is.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import copies
from quarry.llm.common import materialize, text_column
from quarry.llm.components import Forest, components

#: Members of a bucket that are compared in one piece.
BUCKET = 512
SEED = 42


def shingles(text: str, words: int) -> list[bytes]:
    """Runs of `words` words, lower-cased in A-Z alone and joined by a space, repeats included; the
    whole sequence if it is shorter; nothing if there is no word."""
    w = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: exactly \x20 and \x09-\x0D part words
    if len(w) <= words:
        return [b" ".join(w)] if w else []
    return [b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)]


def fingerprint(text: str, words: int) -> int:
    """Bit k is set if it is set in over half of the shingles' XXH64; zero without a word."""
    from xxhash import xxh64_intdigest

    parts = shingles(text, words)
    if not parts:
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for s in range(0, len(parts), 1 << 16):
        h = np.array([xxh64_intdigest(x, SEED) for x in parts[s : s + (1 << 16)]], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(parts), bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of each row; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), words) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return text_column(df, id_col, text_col).mapInArrow(run, "doc_id bigint, fp bigint")


def masks(max_bits: int, blocks: int) -> list[int]:
    """A mask, as a signed long, of each choice of blocks that a close pair may agree on."""
    edge = [64 * i // blocks for i in range(blocks + 1)]
    part = [(1 << edge[i + 1]) - (1 << edge[i]) for i in range(blocks)]
    found = [sum(c) for c in combinations(part, blocks - max_bits)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def _forest(max_bits: int):  # noqa: ANN202
    """Over rows sorted by tile: links within each run of a tile, as edges of a spanning forest."""

    def close(run_of: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends = np.searchsorted(run_of, run_of, side="right")
        at = np.arange(len(fp))
        left, right = [], []
        step = 1
        while len(at := at[at + step < ends[at]]):
            near = at[np.bitwise_count(fp[at] ^ fp[at + step]) <= max_bits]
            left.append(near)
            right.append(near + step)
            step += 1
        return (np.concatenate(left), np.concatenate(right)) if left else (at, at)

    def edges(tile: np.ndarray, fp: np.ndarray) -> pa.RecordBatch | None:
        run_of = np.concatenate([[0], np.cumsum(np.any(tile[1:] != tile[:-1], axis=1))])
        i, j = close(run_of, fp)
        if not len(i):
            return None
        own, place = np.unique(fp.view(np.int64), return_inverse=True)
        i, j = place[i], place[j]
        kept = Forest(len(own)).add(i, j)
        return pa.RecordBatch.from_arrays([pa.array(own[i[kept]]), pa.array(own[j[kept]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, fp = np.empty((0, 4), np.int64), np.empty(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(5)]
            tile = np.concatenate([tile, np.stack(columns[:4], axis=1)])
            fp = np.concatenate([fp, columns[4]])
            # the last tile may go on in the next batch
            other = np.flatnonzero(np.any(tile != tile[-1], axis=1))
            done = int(other[-1]) + 1 if len(other) else 0
            if done and (found := edges(tile[:done], fp[:done].view(np.uint64))) is not None:
                yield found
            tile, fp = tile[done:], fp[done:]
        if len(fp) and (found := edges(tile, fp.view(np.uint64))) is not None:
            yield found

    return run


def links(distinct: DataFrame, max_bits: int = 4, blocks: int = 7) -> DataFrame:
    """a, b: links between distinct fingerprints fp that connect whatever is within max_bits of one
    another. Every row is two fingerprints as close as that."""
    filed = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks(max_bits, blocks)])).alias("choice", "part"))
    shared = filed.groupBy("choice", "part").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # a row of distinct is filed many times over, which its estimated size does not tell: neither side is ever sent out whole
    met = filed.hint("merge").join(shared, ["choice", "part"]).withColumn("chunks", F.ceil(F.col("n") / BUCKET).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    tiles = met.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    tiles = tiles.select("choice", "part", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    by = ["choice", "part", "i", "j"]
    return tiles.repartition(*by).sortWithinPartitions(*by).mapInArrow(_forest(max_bits), "a bigint, b bigint")


def _grouped(docs: DataFrame, max_bits: int, blocks: int) -> DataFrame:
    """Stored rows doc_id and fp, with component_id."""
    distinct = materialize(docs.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    found = components(links(distinct, max_bits, blocks)).withColumnRenamed("node", "fp")
    least = found.join(distinct, "fp").groupBy("component").agg(F.min("rep").alias("component_id"))
    linked = found.join(least, "component").select("fp", "component_id")
    of = distinct.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id"))
    # stored, so that the last join shuffles both sides itself and a hot fingerprint can be split
    return docs.join(materialize(of, "classes"), "fp")


def near_duplicates(df: DataFrame, words: int = 4, max_bits: int = 4, blocks: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of each row.

    Rows with equal fingerprints, and fingerprints at max_bits or fewer differing bits, are linked;
    component_id is the smallest doc_id reachable. Null, empty and wordless texts share the
    fingerprint zero and link like any other. Repeated rows are rows of their own; rows with a null
    doc_id take part, and their component_id is null only if no linked row has an id. Other columns
    are ignored. An empty table gives an empty result."""
    docs = materialize(fingerprints(df, words, id_col, text_col), "fingerprints")
    back = _grouped(docs, max_bits, blocks)
    return back.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, words: int = 5, similarity: float = 0.8, max_bits: int = 4, blocks: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df without near copies: of each group the row with the smallest doc_id.

    Texts are linked if the sets of their runs of `words` words are alike (Jaccard) by `similarity` or
    more, counted on 64-bit hashes of all runs; groups are what links connect. Candidates are the
    nearest fingerprints that meet in pigeonhole blocks, and, as 64 bits can't hold every such pair,
    sets that share a hash of their prefixes; none is missed, and each is verified on the whole sets.
    Null and wordless texts are copies of each other. Rows that share a doc_id are one document, of
    which one row stays; rows without a doc_id stay. An empty table gives an empty result."""
    texts = text_column(df, id_col, text_col)
    docs = materialize(copies.names(texts, words), "names")
    grouped = copies.groups(docs, texts, words, similarity, lambda fps: links(fps, max_bits, blocks))
    return copies.keep_first(df, materialize(grouped, "groups"), id_col)
