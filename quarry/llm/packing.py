"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Only a document longer than the capacity is cut: its first piece takes the remainder, the others
are full. Placing works on the histogram of piece lengths, which has at most `capacity` rows
whatever the corpus, so the plan is made on the driver in bounded memory; the pieces themselves
never leave the executors. A piece finds its place by its rank among the pieces of its length.

The plan has two parts. Pieces above a third of the capacity can share a sequence with at most one
other such piece: these are matched greedily, each with the largest that still fits. All smaller
pieces then go, longest first, into the smallest gap that takes them.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import gapless_rank, materialize, spare, text_column, without

# --- token ids -------------------------------------------------------------------------------

#: Characters on whose class all releases of Unicode in use agree; other texts go to the library.
_USUAL = re.compile("[^\x00-ͷЀ-ҁ‐-‧‰-⁞₠-€]").search


class Ids:
    """Ids of texts as the tokenizers library gives them for a byte-level BPE file with the usual
    split pattern. Texts of common characters are encoded by tiktoken from the same vocabulary,
    which takes a third of the time; all others, and texts with control characters that the two
    class differently, by the library itself."""

    def __init__(self, spec: str, split: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        from quarry.llm.bpe import byte_symbols

        doc = json.loads(spec)
        of = {s: b for b, s in enumerate(byte_symbols())}
        ranks = {bytes(of[c] for c in t): i for t, i in doc["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in doc.get("added_tokens", ())}
        ranks = {b: i for b, i in ranks.items() if i not in self.special.values()}
        self._library = Tokenizer.from_str(spec)
        self._library.no_padding()
        self._library.no_truncation()
        self._fast = tiktoken.Encoding("own", pat_str=split, mergeable_ranks=ranks, special_tokens=self.special)

    def __call__(self, text: str) -> np.ndarray:
        if not text.isascii() and _USUAL(text):
            return np.array(self._library.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return self._fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)


_made: dict[str, Ids] = {}


def ids_of(spec: str, split: str) -> Ids:
    key = hashlib.sha256((spec + split).encode()).hexdigest()
    if key not in _made:
        _made[key] = Ids(spec, split)
    return _made[key]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of a document of n tokens."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


_OUT = {"ids": ("binary", pa.binary()), "ids_crc32": ("bigint", pa.int64())}


def pieces(df: DataFrame, tokenizer: str, split: str, end_id: int = 0, capacity: int = 2048, outputs: tuple[str, ...] = ("ids",), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise whole texts and cut them: doc_id, piece (from 0), start, length and, of outputs, ids
    (little-endian unsigned 32-bit) and ids_crc32 of each piece.

    Every document ends with end_id, so null and empty texts are one piece of one token. Repeated
    rows give repeated pieces; other columns of df are ignored."""
    spec = df.sparkSession.sparkContext.broadcast(Path(tokenizer).read_text(encoding="utf-8"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = ids_of(spec.value, split)
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            out: dict[str, list] = {o: [] for o in outputs}
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.concatenate([encode(text.as_py()), end])
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    for column, v in zip(rows, (doc, k, start, length), strict=True):
                        column.append(v)
                    for o, v in out.items():
                        own = ids[start : start + length].tobytes()
                        v.append(own if o == "ids" else zlib.crc32(own))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
            arrays = [pa.array(v, t) for v, t in zip(rows, kinds, strict=True)] + [pa.array(v, _OUT[o][1]) for o, v in out.items()]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", *out])

    schema = "doc_id bigint, piece int, start bigint, length bigint" + "".join(f", {o} {_OUT[o][0]}" for o in outputs)
    return text_column(df, id_col, text_col).mapInArrow(run, schema)


# --- the plan --------------------------------------------------------------------------------


@dataclass
class Group:
    """Some sequences with the same contents: for each place, the length put there and the rank of
    the first sequence's piece among the pieces of that length; sequence i holds rank + i * step."""

    count: int
    gap: int
    places: list[tuple[int, int, int]] = field(default_factory=list)  # length, first rank, step

    def split(self, n: int) -> Group:
        """Take the first n sequences off."""
        first = Group(n, self.gap, list(self.places))
        self.count -= n
        self.places = [(length, rank + n * step, step) for length, rank, step in self.places]
        return first


class Plan:
    """Where the piece of a given length and rank goes."""

    def __init__(self, groups: list[Group], capacity: int):
        rows = []
        sequence = 0
        for g in groups:
            offset = 0
            for length, rank, step in g.places:
                rows.append((length, rank, rank + g.count * step, step, sequence, offset))
                offset += step * length
            sequence += g.count
        self.sequences = sequence
        self.capacity = capacity
        table = np.array(rows, dtype=np.int64).reshape(-1, 6)
        # places of one group that share a length interleave: rank - first is the place within the
        # step, so each run of ranks is listed once, with its offsets a fixed length apart
        self.runs = table[np.lexsort((table[:, 1], table[:, 0]))]

    def locate(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of each piece."""
        runs = self.runs
        wide = np.int64(1) << np.int64(44)
        k = np.searchsorted(runs[:, 0] * wide + runs[:, 1], length * wide + rank, side="right") - 1
        r = runs[k]
        within = rank - r[:, 1]
        return r[:, 4] + within // r[:, 3], r[:, 5] + within % r[:, 3] * length


def _fill(groups: dict[int, list[Group]], gaps: list[int], length: int, n: int, rank: int, capacity: int) -> None:
    """Put n pieces of a length, from a rank on, into the smallest gaps that take them, opening
    sequences when there are none; a sequence takes as many as fit before the next is touched."""

    def put_back(g: Group) -> None:
        if g.gap not in groups:
            groups[g.gap] = []
            insort(gaps, g.gap)
        groups[g.gap].append(g)

    while n:
        at = bisect_left(gaps, length)
        if at == len(gaps):
            most = capacity // length
            put_back(Group(-(-n // most), capacity))
            continue
        gap = gaps[at]
        g = groups[gap].pop()
        if not groups[gap]:
            del groups[gap]
            gaps.pop(at)
        most = gap // length
        full = min(g.count, n // most)
        if full:
            taken = g.split(full)
            taken.places.append((length, rank, most))
            taken.gap -= most * length
            rank += full * most
            n -= full * most
            put_back(taken)
        if g.count and n and n < most:
            taken = g.split(1)
            taken.places.append((length, rank, n))
            taken.gap -= n * length
            n = 0
            put_back(taken)
        if g.count:
            put_back(g)


def plan(histogram: dict[int, int], capacity: int) -> Plan:
    """Pack histogram[length] pieces of each length into as few sequences as the method can."""
    left = {k: v for k, v in sorted(histogram.items()) if v and 3 * k > capacity}
    used = dict.fromkeys(left, 0)
    sizes = sorted(left)
    groups: dict[int, list[Group]] = {}

    def add(g: Group) -> None:
        groups.setdefault(g.gap, []).append(g)

    for length in sorted(left, reverse=True):
        while left[length]:
            # the largest partner that fits; for the same length two are needed
            k = bisect_left(sizes, capacity - length + 1) - 1
            while k >= 0 and (left[sizes[k]] == 0 or sizes[k] == length and left[length] < 2 or sizes[k] > length):
                k -= 1
            if k < 0:
                n = left[length]
                add(Group(n, capacity - length, [(length, used[length], 1)]))
                used[length] += n
                left[length] = 0
                break
            other = sizes[k]
            n = left[length] // 2 if other == length else min(left[length], left[other])
            if other == length:
                add(Group(n, capacity - 2 * length, [(length, used[length], 2)]))
                used[length] += 2 * n
                left[length] -= 2 * n
                continue
            add(Group(n, capacity - length - other, [(length, used[length], 1), (other, used[other], 1)]))
            for x in (length, other):
                used[x] += n
                left[x] -= n
    gaps = sorted(groups)
    for length in sorted((k for k, v in histogram.items() if v and 3 * k <= capacity), reverse=True):
        _fill(groups, gaps, length, histogram[length], 0, capacity)
    return Plan([g for gap in sorted(groups) for g in groups[gap] if g.count], capacity)


def pack(cut_up: DataFrame, capacity: int = 2048, length_col: str = "length", order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Add sequence_id and offset to rows that have a length of 1 to capacity.

    Every row gets a place; a sequence's rows lie without gaps from offset 0. Which of several rows
    of one length gets which place depends on the order columns alone. An empty input gives an
    empty result. Columns of the input named sequence_id or offset are renamed. The input is read
    twice: give a stored table."""
    cut_up = without(cut_up, "sequence_id", "offset")
    rank = spare(cut_up, "_rank")
    histogram = {int(r[0]): int(r[1]) for r in cut_up.groupBy(length_col).count().collect()}  # at most capacity rows
    if histogram and not 1 <= min(histogram) <= max(histogram) <= capacity:
        raise ValueError(f"lengths must be 1 to {capacity}: {min(histogram)} to {max(histogram)}")
    placed = plan(histogram, capacity)
    ranked = gapless_rank(cut_up, [length_col], [F.col(c) for c in order], rank, histogram, per_bucket=1000)
    shared = cut_up.sparkSession.sparkContext.broadcast(placed)
    names = cut_up.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut_up.schema) + ", sequence_id bigint, offset bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = shared.value
        for batch in batches:
            sequence, offset = where.locate(*(batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (length_col, rank)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return ranked.select(*[F.col(f"`{c}`") for c in names], rank).mapInArrow(run, schema)


def pack_documents(df: DataFrame, tokenizer: str, split: str, end_id: int = 0, capacity: int = 2048, outputs: tuple[str, ...] = ("ids",), **columns: str) -> DataFrame:
    """Tokenise, cut and pack: one row a piece, see pieces() and pack()."""
    return pack(materialize(pieces(df, tokenizer, split, end_id, capacity, outputs, **columns), "pieces"), capacity)
