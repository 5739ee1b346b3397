"""Scoring texts with a log-bilinear language model, trained in numpy by noise-contrastive estimation.

A context is the two tokens before. The nearer one has a vector of its own for every frequent word, the
farther one a vector of its group (the commonest words, else a class of the word's shape); the
context's vector is their sum. Targets are the frequent words, the end of a text, and for all other
words the class of their shape; within a class a word has its smoothed share. A token's score is the
product of context and target vectors and a bias, less the logarithm of the context's sum over all
targets, which batched products give for every pair of a farther group and a nearer word. So scores are
true log-probabilities over all words seen and, in each class, one slot for the unseen.

How many words have vectors grows with the root of the corpus. A core is trained first, in one table of
groups and core targets whose size is fixed. With its vectors given, the contrast of every other
target, and then of every nearer word, with noise is a problem of its own, over its counts in the
whole corpus: executors solve them side by side. The contrast with noise is taken in expectation over
counts, so nothing is drawn. The counts of words grow with the corpus; frequent ones, up to HEAD, go to
the executors, rare ones are joined.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialize, text_column

#: Words with a target in the core, words with a context group of their own, and words whose counts
#: are sent to every executor (a few MB).
TARGETS, GROUPS, HEAD = 800, 24, 100_000
#: A word has a target of its own from root(tokens) / ROOT[0] occurrences on, and a vector as the nearer
#: word from root(tokens) / ROOT[1] on, but from LEAST on at least; both of the HEAD words alone.
ROOT, LEAST = (4, 16), 100
DIMENSIONS, NOISE, STEPS = 16, 8, 120
END = ""  # the end of a text, among words

# --- shapes ----------------------------------------------------------------------------------

_TAILS = {".": 1, "!": 1, "?": 1, ",": 2, ";": 2, ":": 2}
COARSE = 18  # scripts x endings
SHAPES = COARSE * 4


def _script(word: str) -> int:
    """0 plain letters, 1 to 3 by accents, 4 other alphabets and signs, 5 with a digit."""
    if word.isascii():
        return 5 if any(c.isdigit() for c in word) else 0 if any(c.isalpha() for c in word) else 4
    if any(c.isdigit() for c in word):
        return 5
    marks = {unicodedata.normalize("NFD", c)[1:2] for c in word if ord(c) > 127}
    return 1 if "̈" in marks or "ß" in word else 2 if "̃" in marks else 3 if marks & {"̀", "́", "̂", "̧"} else 4


def shape(word: str) -> int:
    """Script, ending and length of a word as one number below SHAPES."""
    n = len(word)
    return (_script(word) * 3 + _TAILS.get(word[-1:], 0)) * 4 + (0 if n <= 3 else 1 if n <= 6 else 2 if n <= 10 else 3)


_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search


def tokens(text: str) -> list[str]:
    """Words, lower-cased in A-Z alone and parted at \\x20 and \\x09-\\x0D."""
    low = text.encode().lower()
    if _OTHER_SPACE(text):  # at which split() of a string would part words too
        return [w.decode() for w in low.split()]
    return low.decode().split()


# --- the model -------------------------------------------------------------------------------


@dataclass
class Vocabulary:
    """What a worker needs to number tokens. head: word -> count."""

    head: dict[str, int]
    targets: list[str]  # words with targets of their own; the core comes first
    core: int  # how many of them are in the core
    groups: list[str]  # words with context groups of their own, a beginning of targets
    near: list[str]  # words with vectors of their own as the nearer word

    @property
    def size(self) -> int:
        return len(self.targets) + SHAPES + 1

    @property
    def core_size(self) -> int:
        return self.core + SHAPES + 1

    @property
    def contexts(self) -> int:
        return len(self.groups) + COARSE + 1  # and the time before a text's start

    def group_of(self) -> np.ndarray:
        """The context group of each target."""
        g = np.array([min(i, len(self.groups)) for i in range(self.size)])
        for i, w in enumerate(self.targets):
            if i >= len(self.groups):
                g[i] = len(self.groups) + shape(w) // 4
        g[len(self.targets) : len(self.targets) + SHAPES] = len(self.groups) + np.arange(SHAPES) // 4
        return g

    def core_of(self) -> np.ndarray:
        """The core's target of each target: words outside it are in their shape's class."""
        at = np.arange(self.size)
        at[: len(self.targets)] = [i if i < self.core else self.core + shape(w) for i, w in enumerate(self.targets)]
        at[len(self.targets) :] -= len(self.targets) - self.core
        return at


class _Numbers:
    """Numbers of words in a worker: one look-up a token; all else is by arrays over the numbers."""

    def __init__(self, vocabulary: Vocabulary):
        own = {w: i for i, w in enumerate(vocabulary.targets)} | {END: vocabulary.size - 1}
        self.words = sorted({*vocabulary.head, END})
        self.index = {w: i for i, w in enumerate(self.words)}
        self.first = len(vocabulary.targets)
        self.target = np.array([own[w] if w in own else self.first + shape(w) for w in self.words], dtype=np.int64)
        self.group, self.nears = vocabulary.group_of(), len(vocabulary.near)
        place = {w: i for i, w in enumerate(vocabulary.near)}
        self.near = np.array([place.get(w, -1) for w in self.words], dtype=np.int64)
        self._shapes: dict[str, int] = {}

    def shapes(self, words: list[str]) -> np.ndarray:
        """Shapes of words; those of many are remembered."""
        known = self._shapes
        if len(known) > 400_000:
            known.clear()
        out = []
        for w in words:
            n = known.get(w)
            if n is None:
                n = known[w] = shape(w)
            out.append(n)
        return np.array(out, dtype=np.int64)

    def lay(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray]:
        """Texts end to end: each token's number (-1 for a word without one), its target, and where each
        text begins; then the places, words and shapes of the words without a number."""
        every: list[str] = []
        sizes = []
        for t in texts:
            w = tokens(t)
            every += w
            every.append(END)
            sizes.append(len(w) + 1)
        index = np.fromiter(map(self.index.get, every, repeat(-1)), np.int64, len(every))
        rare = np.flatnonzero(index < 0)
        words = [every[i] for i in rare.tolist()]
        shapes = self.shapes(words)
        target = self.target[index]
        target[rare] = self.first + shapes
        size = np.array(sizes, dtype=np.int64)
        return index, target, np.cumsum(size) - size, rare, words, shapes


def shifted(values: np.ndarray, starts: np.ndarray, first: int) -> np.ndarray:
    """The value of the token before, `first` at the texts' starts."""
    out = np.empty_like(values)
    out[1:] = values[:-1]
    out[starts] = first
    return out


def contexts_of(number: _Numbers, index: np.ndarray, target: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token of texts laid end to end the group of the farther word, the group of the nearer one,
    and the nearer word's own number, or that of its group behind all of them."""
    group = number.group[target]
    before = int(number.group.max()) + 1  # the time before the start
    one = shifted(group, starts, before)
    own = np.where(index >= 0, number.near[index], -1)
    near = shifted(np.where(own >= 0, own, number.nears + group), starts, number.nears + before)
    return shifted(one, starts, before), one, near


def train(counts: np.ndarray, steps: int = STEPS, dimensions: int = DIMENSIONS, noise: int = NOISE, seed: int = 5) -> dict[str, np.ndarray]:
    """Vectors of the farther and the nearer groups and of the targets with their biases, from counts
    (groups**2, targets).

    Noise comes from the targets' shares. For each context its expected number is `noise` times the
    context's tokens, so the objective and its gradient are those of noise-contrastive estimation
    with the draw of noise averaged out."""
    pairs, size = counts.shape
    side = int(round(pairs**0.5))
    r = np.random.default_rng(seed)
    share = counts.sum(0) + 0.5
    share = (share / share.sum()).astype(np.float32)
    n = counts.sum(1)
    used = np.flatnonzero(n)
    w = {
        "far": (r.normal(size=(side, dimensions)) * 0.1).astype(np.float32), "near": (r.normal(size=(side, dimensions)) * 0.1).astype(np.float32),
        "target": (r.normal(size=(size, dimensions)) * 0.1).astype(np.float32), "bias": np.log(share),
    }
    if len(used):
        data = (counts[used] / n.sum()).astype(np.float32)
        false = (noise * n[used, None] / n.sum()).astype(np.float32) * share
        level = np.log(noise * share)
        far, near = used // side, used % side
        # counts are very uneven: rows weigh by the root of their share, so that rare contexts learn too
        weight = (1 / np.sqrt(n[used] / n.sum()))[:, None].astype(np.float32)
        weight /= float((weight[:, 0] * n[used]).sum() / n.sum())
        m = {k: np.zeros_like(v) for k, v in w.items()}
        s = {k: np.zeros_like(v) for k, v in w.items()}
        for step in range(1, steps + 1):
            context = w["far"][far] + w["near"][near]
            true = 1 / (1 + np.exp(np.clip(level - (context @ w["target"].T + w["bias"]), -30, 30)))
            g = ((data * (1 - true)) - false * true) * weight
            back = g @ w["target"]
            grads = {"far": np.zeros_like(w["far"]), "near": np.zeros_like(w["near"]), "target": g.T @ context, "bias": g.sum(0)}
            np.add.at(grads["far"], far, back)
            np.add.at(grads["near"], near, back)
            for k, v in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * v
                s[k] = 0.98 * s[k] + 0.02 * v * v
                w[k] = w[k] + 0.08 * (1 - 0.8 * step / steps) * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.98**step)) + 1e-7)
    return w


def _adam(grad, x: np.ndarray, steps: int, rate: float) -> np.ndarray:  # noqa: ANN001
    m, v = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, steps + 1):
        g = grad(x)
        m, v = 0.9 * m + 0.1 * g, 0.98 * v + 0.02 * g * g
        x = x + rate * (1 - 0.8 * step / steps) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.98**step)) + 1e-7)
    return x


def fit_targets(counts: np.ndarray, seen: np.ndarray, w: dict[str, np.ndarray], start: np.ndarray, noise: int = NOISE, steps: int = 60) -> np.ndarray:
    """Vectors with a bias behind of more targets, the vectors of contexts given. counts: targets x contexts;
    seen: how often each context was; start: the classes' vectors and biases to begin with."""
    used = np.flatnonzero(seen)
    side = len(w["far"])
    context = np.hstack([w["far"][used // side] + w["near"][used % side], np.ones((len(used), 1))]).astype(np.float32)
    data, total = counts[:, used].astype(np.float32), float(seen.sum())
    share = (counts.sum(1) + 0.5) / total
    false = (noise * share[:, None] * seen[used]).astype(np.float32)
    level = np.log(noise * share)[:, None].astype(np.float32)
    size = (counts.sum(1)[:, None] + 1).astype(np.float32)

    def grad(x: np.ndarray) -> np.ndarray:
        true = 1 / (1 + np.exp(np.clip(level - x @ context.T, -30, 30)))
        return ((data * (1 - true) - false * true) @ context - 2.0 * (x - begin)) / size

    begin = start.copy().astype(np.float32)
    begin[:, -1] = np.log(share)
    return _adam(grad, begin.copy(), steps, 0.05)


def fit_near(counts: np.ndarray, share: np.ndarray, target: np.ndarray, bias: np.ndarray, far: np.ndarray, start: np.ndarray, noise: int = NOISE, steps: int = 60, faith: float = 20.0) -> np.ndarray:
    """Vectors of nearer words, those of targets given. counts: words x targets; far: the mean vector of
    what stands before each; start: their groups' vectors, which count as `faith` occurrences do."""
    n = counts.sum(1, keepdims=True).astype(np.float32)
    data = counts.astype(np.float32)
    level = np.log(noise * share).astype(np.float32)

    def grad(x: np.ndarray) -> np.ndarray:
        true = 1 / (1 + np.exp(np.clip(level - ((x + far) @ target.T + bias), -30, 30)))
        return ((data * (1 - true) - noise * n * share * true) @ target - faith * (x - start)) / (n + faith)

    return _adam(grad, start.astype(np.float32).copy(), steps, 0.05)


def sums(near: np.ndarray, far: np.ndarray, target: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Natural logarithms of the sums over all targets: nearer words x farther groups."""
    out = np.empty((len(near), len(far)), np.float64)
    step = max(1, (1 << 21) // (len(far) * len(target)))  # some 8 MB at once
    for s in range(0, len(near), step):
        every = (near[s : s + step, None, :] + far[None, :, :]).reshape(-1, near.shape[1]).astype(np.float32) @ target.T + bias
        top = every.max(1)
        every -= top[:, None]
        out[s : s + step] = (np.log(np.exp(every, out=every).sum(1, dtype=np.float64)) + top).reshape(-1, len(far))
    return out


def parameters_to_table(w: dict[str, np.ndarray]) -> np.ndarray:
    side = len(w["far"])
    context = (w["far"][:, None, :] + w["near"][None, :, :]).reshape(side * side, -1)
    out = context.astype(np.float64) @ w["target"].T.astype(np.float64) + w["bias"]
    out -= out.max(1, keepdims=True)
    out -= np.log(np.exp(out).sum(1, keepdims=True))
    return out / np.log(10)


# --- gathering from the corpus ---------------------------------------------------------------


def _slices(batch: pa.RecordBatch, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about `most` bytes of text; a longer text is a run of its own. Words as
    Python objects take many times the bytes of their text."""
    sizes = np.asarray(pc.binary_length(batch.column(1)), dtype=np.int64)
    part = (np.cumsum(sizes) - sizes) // most
    edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def word_counts(docs: DataFrame, at_once: int = 500_000) -> DataFrame:
    """word (the end of a text is the empty one), its shape (-1 for the end) and count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            words = list(seen)
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([shape(w) if w else -1 for w in words], pa.int32()), pa.array(seen.values(), pa.int64())], ["word", "shape", "n"])

        for batch in batches:
            for text in batch.column(1):
                seen.update(tokens(text.as_py()))
                seen[END] += 1
                if len(seen) > at_once:
                    yield out()
                    seen.clear()
        yield out()

    parts = docs.mapInArrow(run, "word string, shape int, n bigint")
    return parts.groupBy("word", "shape").agg(F.sum("n").alias("c"))


def head_of(counts: DataFrame, most: int) -> tuple[dict[str, int], int]:
    """Words at or above the least count that at most `most` words reach, and that count."""
    # counts fall into bins of a logarithm, a few thousand at most
    bins = counts.groupBy(F.floor(F.log2("c") * 64).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("words"), F.min("c").alias("least")).collect()
    total, least = 0, None
    for r in sorted(bins, key=lambda r: -r["b"]):
        if total + r["words"] > most:
            break
        total += r["words"]
        least = r["least"]
    if least is None:
        return {}, 1 << 62
    return {r["word"]: r["c"] for r in counts.where(F.col("c") >= least).select("word", "c").collect()}, least


CORE, NEAR, MORE = 0, 1, 2  # tables of counts: core contexts and targets, nearer words and targets, contexts and targets outside the core


def context_counts(docs: DataFrame, vocabulary: Vocabulary, at_once: int = 1_000_000) -> DataFrame:
    """kind, row, target, n: counts over all rows, summed up within tasks."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        number, core_of = _Numbers(v), v.core_of()
        held: list[list[tuple[np.ndarray, np.ndarray]]] = [[], [], []]

        def merged(kind: int) -> tuple[np.ndarray, np.ndarray]:
            keys = np.concatenate([k for k, _ in held[kind]])
            at, place = np.unique(keys, return_inverse=True)
            return at, np.bincount(place, np.concatenate([n for _, n in held[kind]])).astype(np.int64)

        def told(kind: int) -> pa.RecordBatch:
            at, n = merged(kind)
            held[kind] = []
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int8)), pa.array((at // v.size).astype(np.int32)), pa.array((at % v.size).astype(np.int32)), pa.array(n)], ["kind", "row", "target", "n"])

        for batch in (part for whole in batches for part in _slices(whole)):
            if batch.num_rows:
                index, target, starts, *_ = number.lay(batch.column(1).to_pylist())
                far, one, near = contexts_of(number, index, target, starts)
                context = far * v.contexts + one
                own, rest = near < number.nears, (target >= v.core) & (target < v.size - 1)
                for kind, keys in ((CORE, context * v.size + core_of[target]), (NEAR, (near * v.size + target)[own]), (MORE, (context * v.size + target)[rest])):
                    at, n = np.unique(keys, return_counts=True)
                    held[kind].append((at, n))
                    if sum(len(k) for k, _ in held[kind]) > at_once:
                        held[kind] = [merged(kind)]
                        if len(held[kind][0][0]) > at_once // 2:
                            yield told(kind)
        for kind in (CORE, NEAR, MORE):
            if held[kind]:
                yield told(kind)

    return docs.mapInArrow(run, "kind byte, row int, target int, n bigint")


def _by_key(counts: DataFrame, key: str, other: str, width: int, solve, size: int) -> tuple[np.ndarray, np.ndarray]:  # noqa: ANN001
    """Dense rows of counts of each key go to solve(keys, rows), in executors, and what it gives for each is
    brought together: keys and `size` numbers each, as many as the vocabulary has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 3

        def solved(part: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            keys, at = np.unique(part[0], return_inverse=True)
            for s in range(0, len(keys), 256):
                mine = (at >= s) & (at < s + 256)
                rows = np.zeros((min(256, len(keys) - s), width), np.float32)
                np.add.at(rows, (at[mine] - s, part[1][mine]), part[2][mine])
                got = solve(keys[s : s + 256], rows).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array(keys[s : s + 256]), pa.FixedSizeListArray.from_arrays(pa.array(got.ravel()), size).cast(pa.list_(pa.float32()))], ["k", "v"])

        waiting, keys = [], 0
        for batch in batches:
            if batch.num_rows:
                part = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
                waiting.append(part)
                keys += 1 + int(np.count_nonzero(part[0][1:] != part[0][:-1]))
                if keys > 512:
                    held = [np.concatenate(x) for x in zip(held, *waiting, strict=True)]
                    # the last key may go on in the next batch
                    done = int(np.searchsorted(held[0], held[0][-1]))
                    if done:
                        yield from solved([h[:done] for h in held])
                    held, waiting, keys = [h[done:] for h in held], [], 1
        held = [np.concatenate(x) for x in zip(held, *waiting, strict=True)]
        if len(held[0]):
            yield from solved(held)

    got = counts.select(key, other, "n").repartition(key).sortWithinPartitions(key).mapInArrow(run, "k bigint, v array<float>").orderBy("k").toArrow()
    flat = got.column("v").combine_chunks().flatten().to_numpy() if got.num_rows else np.empty(0, np.float32)
    return got.column("k").to_numpy(), flat.reshape(-1, size)


@dataclass
class Model:
    """Vectors, and the logarithm of the sum over all targets for each nearer word and farther group."""

    far: np.ndarray
    near: np.ndarray
    target: np.ndarray
    bias: np.ndarray
    sums: np.ndarray

    def score(self, far: np.ndarray, near: np.ndarray, target: np.ndarray) -> np.ndarray:
        """log10 of the probabilities of targets, 200,000 at a time."""
        out = np.empty(len(target))
        for s in range(0, len(target), 200_000):
            f, n, t = (x[s : s + 200_000] for x in (far, near, target))
            out[s : s + 200_000] = np.einsum("ij,ij->i", self.far[f] + self.near[n], self.target[t]) + self.bias[t] - self.sums[n, f]
        return out / np.log(10)


def fit(counts: DataFrame, v: Vocabulary) -> Model:
    """Train on stored counts of context_counts()."""
    side, pairs = v.contexts, v.contexts**2
    got = counts.where(F.col("kind") == CORE).groupBy("row", "target").agg(F.sum("n").alias("n")).toArrow()  # pairs x core targets at most
    table = np.zeros((pairs, v.core_size))
    table[got.column("row").to_numpy(), got.column("target").to_numpy()] = got.column("n").to_numpy()
    w = train(table)
    seen = table.sum(1)
    sc = counts.sparkSession.sparkContext
    # targets outside the core and, as they no longer hold those, the classes
    core_of = v.core_of()
    start = np.hstack([w["target"], w["bias"][:, None]])[core_of]
    shared = sc.broadcast((w, seen, start))

    def targets(keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
        w, seen, start = shared.value
        return fit_targets(rows, seen, w, start[keys])

    wide = start.astype(np.float32)
    wide[v.core : len(v.targets) + SHAPES, -1] -= 20  # classes and words that nothing is left of
    wide[len(v.targets) : len(v.targets) + SHAPES, -1] = np.log(0.5 / (seen.sum() + 1))
    keys, got = _by_key(counts.where(F.col("kind") == MORE), "target", "row", pairs, targets, wide.shape[1])
    wide[keys] = got
    target, bias = wide[:, :-1].copy(), wide[:, -1].copy()
    # nearer words: before each stands, on average, what stands before its group
    by_near = table.sum(1).reshape(side, side)
    mean = (by_near.T / np.maximum(by_near.sum(0), 1)[:, None]) @ w["far"]
    place = {x: i for i, x in enumerate(v.groups)}
    group = np.array([place.get(x, len(v.groups) + shape(x) // 4) for x in v.near], dtype=np.int64)
    share = np.zeros(v.size)
    totals = counts.where(F.col("kind") == CORE).groupBy("target").agg(F.sum("n").alias("n")).collect()  # core targets at most
    inner = np.zeros(v.core_size)
    for r in totals:
        inner[r["target"]] = r["n"]
    more = np.zeros(v.size)
    for r in counts.where(F.col("kind") == MORE).groupBy("target").agg(F.sum("n").alias("n")).collect():  # targets at most
        more[r["target"]] = r["n"]
    share[: v.core], share[-1] = inner[: v.core], inner[-1]
    share[v.core : -1] = more[v.core : -1]
    share = ((share + 0.5) / (share + 0.5).sum()).astype(np.float32)
    known = sc.broadcast((w, target, bias, share, mean.astype(np.float32), group))
    width = target.shape[1]

    def nears(keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
        w, target, bias, share, mean, group = known.value
        g = group[keys]
        x = fit_near(rows, share, target, bias, mean[g], w["near"][g])
        return np.hstack([x, sums(x, w["far"], target, bias)])

    near = np.vstack([w["near"][group], w["near"]]).astype(np.float32) if len(group) else w["near"].astype(np.float32)
    keys, got = _by_key(counts.where(F.col("kind") == NEAR), "row", "target", v.size, nears, width + side)
    z = np.vstack([sums(near[s : s + 256], w["far"], target, bias) for s in range(len(v.near), len(near), 256)])
    every = np.zeros((len(near), side), np.float32)
    every[len(v.near) :] = z
    lost = np.setdiff1d(np.arange(len(v.near)), keys)  # nothing but texts' ends follows them
    if len(lost):
        every[lost] = sums(near[lost], w["far"], target, bias)
    near[keys], every[keys] = got[:, :width], got[:, width:]
    return Model(w["far"].astype(np.float32), near, target, bias, every)


# --- the operator ----------------------------------------------------------------------------


def held_out(folds: int = 5, fold: int = 1) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold


def score(df: DataFrame, held: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (smoothed unigrams) and score (the
    model), both log10 of the text's probability with its end.

    Learns from the rows that aren't held out (by default by a hash of doc_id) and scores all rows.
    Null and empty texts are one token, the end. Repeated rows are scored each. If nothing is left to
    learn from, counts are zero and both scores follow from the smoothing. Other columns are ignored.
    An empty table gives an empty result."""
    held = held_out() if held is None else held
    docs = text_column(df, id_col, text_col)
    learned = docs.where(~held)
    counts = materialize(word_counts(learned), "words")
    stats = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)), F.sum(F.when(F.col("word") == END, F.col("c")))).first()
    n, v = int(stats[0]), int(stats[1])
    floor = n + 0.5 * (v + 1)
    head, least = head_of(counts, HEAD)
    if stats[2]:  # the end is never looked up among the rare words
        head[END] = int(stats[2])
    frequent = sorted((w for w in head if w != END), key=lambda w: (-head[w], w))
    root = n**0.5
    core = min(TARGETS, len(frequent))
    own = max(core, sum(head[w] >= max(LEAST, root / ROOT[0]) for w in frequent))
    near = max(min(GROUPS, len(frequent)), sum(head[w] >= max(LEAST, root / ROOT[1]) for w in frequent))
    vocabulary = Vocabulary(head, frequent[:own], core, frequent[:GROUPS], frequent[:near])
    model = fit(materialize(context_counts(learned, vocabulary), "contexts"), vocabulary)
    by_shape = {r["shape"]: r["z"] for r in counts.where("shape >= 0").groupBy("shape").agg((F.sum("c") + 0.5 * F.count(F.lit(1))).alias("z")).collect()}  # SHAPES rows at most
    mass = np.full(SHAPES, 0.5)
    for s, z in by_shape.items():
        mass[s] += z
    for w in vocabulary.targets:
        mass[shape(w)] -= head[w] + 0.5
    shared = df.sparkSession.sparkContext.broadcast((vocabulary, model, mass, floor))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        v, model, mass, floor = shared.value
        number = _Numbers(v)
        count = np.array([v.head.get(w, 0) for w in number.words], dtype=np.float64)
        base_of = np.log10((count + 0.5) / floor)
        seen_of = (count > 0).astype(np.int64)
        # words without a target of their own have their share of their shape's mass
        inside_of = np.zeros(len(count))
        other = (number.target >= number.first) & (number.target < v.size - 1)
        inside_of[other] = np.log10((count[other] + 0.5) / mass[number.target[other] - number.first])
        row = TaskContext.get().partitionId() << 40
        none = pa.nulls
        names = ["row", "doc_id", "word", "shape", "n_tokens", "n_known", "base", "score"]
        for batch in (part for whole in batches for part in _slices(whole)):
            index, target, starts, rare, words, shapes = number.lay(batch.column(1).to_pylist())
            far, _, near = contexts_of(number, index, target, starts)
            told = model.score(far, near, target) + inside_of[index]
            base, seen = base_of[index], seen_of[index]
            base[rare] = seen[rare] = 0
            told[rare] -= inside_of[-1]  # what number -1 has read
            m, q = len(starts), len(rare)
            first = np.arange(row, row + m)
            row += m
            sizes = np.diff(np.append(starts, len(index)))
            totals = [sizes, np.add.reduceat(seen, starts), np.add.reduceat(base, starts), np.add.reduceat(told, starts)]
            yield pa.RecordBatch.from_arrays([pa.array(first), batch.column(0), none(m, pa.string()), none(m, pa.int32()), *map(pa.array, totals)], names)
            if q:
                of = first[np.searchsorted(starts, rare, side="right") - 1]
                yield pa.RecordBatch.from_arrays([pa.array(of), none(q, pa.int64()), pa.array(words, pa.string()), pa.array(shapes.astype(np.int32)), none(q, pa.int64()), none(q, pa.int64()), none(q, pa.float64()), none(q, pa.float64())], names)

    schema = "row bigint, doc_id bigint, word string, shape int, n_tokens bigint, n_known bigint, base double, score double"
    scored = materialize(docs.mapInArrow(run, schema), "scored")
    rare = scored.where("word is not null").select("row", "word", "shape")
    found = counts.where((F.col("c") < least) & (F.col("shape") >= 0)).select("word", "c")
    masses = F.element_at(F.array(*[F.lit(float(x)) for x in mass]), F.col("shape") + 1)
    c = F.coalesce("c", F.lit(0))
    tail = rare.join(found, "word", "left").select(
        "row", F.when(c > 0, 1).otherwise(0).alias("k"), F.log10((c + 0.5) / F.lit(floor)).alias("b"), F.log10((c + 0.5) / masses).alias("s")
    )
    tail = tail.groupBy("row").agg(F.sum("k").alias("k"), F.sum("b").alias("b"), F.sum("s").alias("s"))
    whole = scored.where("word is null").select("row", "doc_id", "n_tokens", "n_known", "base", "score").join(tail, "row", "left")
    zero = F.lit(0.0)
    return whole.select(
        "doc_id", held.alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", zero)).alias("base_score"), (F.col("score") + F.coalesce("s", zero)).alias("score"),
    )
