"""Toxicity by a weighted finite-state pattern grammar.

Five small transducers run in a cascade over a text's words. Negation marks insults and threats that
it denies, reported speech those that are quoted, target those that stand shortly after someone who is
addressed. What they have marked goes to the insult and the threat transducer. Either opens a clause at
its word, takes further words of its kind into it, waits a few words for a target that follows, and
emits the clause with its kind when a target comes, the sentence ends, or nothing follows: a threat
needs a target, an insult without one is a clause of a lesser kind. They are composed into one
machine over tuples of their states, made as texts reach them. A score is made of emitted clauses.

The lexicon of insults is an acceptor over words and word beginnings with weights learned from
labelled rows; the other lexicons are closed classes of function words. What a clause of each kind
counts is learned as well, from given values on; two weights and a bias turn a document's clauses into
a probability, fitted by logistic regression.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import exp, log, log1p
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialize, text_column

OTHER, TARGET, DENY, REPORT, INSULT, THREAT, BREAK, STOP = range(8)

# Closed classes of words. Fixed values of the grammar.
TARGETS = "you your yours youre u ur he she they them him her his their this that these those we it all everyone people man woman du dich dir ihr euch sie er tu te toi vous ton ta ils elle il tú usted ustedes vosotros ellos ellas ti".split()
DENIALS = "not never no nobody without isn't aren't wasn't don't doesn't didn't cannot can't won't nicht kein keine nie niemals pas jamais aucun aucune sans nunca jamás ningún ninguna sin".split()
REPORTS = "said says say saying told tells called calls claimed claims wrote writes quoted quotes reported according heard alleged sagte sagt schrieb behauptet dit disait écrit selon appelé dijo dice escribió según llamó".split()
THREATS = "kill murder hurt beat stab shoot burn destroy smash strangle töten umbringen schlagen tuer frapper matar golpear".split()
# How much a clause of each kind counts before anything is learned. Fixed values of the grammar.
ADDRESSED, DENIED, QUOTED = 1.25, 0.5, 0.6
#: Rows of a kind at which what is learned of it counts as much as what is given.
FAITH = 30

_WORDS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[.!?\n]|[,;:()\"“”]").findall
SKETCHES = 4  # minimal hashes by which copies among labelled rows are told
LENGTHS = range(4, 9)  # of word beginnings that may enter the lexicon


def words(text: str) -> list[str]:
    """Words in lower case, and the marks that end a sentence or part a clause."""
    return _WORDS(text.lower().replace("’", "'"))


# --- transducers -----------------------------------------------------------------------------

# What a word's mark says beside its symbol.
IS_DENIED, IS_QUOTED, IS_ADDRESSED = 1, 2, 4


@dataclass(frozen=True)
class Memory:
    """A transducer that remembers a symbol for the next `reach` words, or up to one of `ends`, and
    marks the insults and threats that it meets meanwhile. Its state is the words that are left."""

    symbol: int
    reach: int
    ends: tuple[int, ...]
    mark: int

    def step(self, state: int, symbol: int, marks: int) -> tuple[int, int]:
        """The next state, and the marks as they go on."""
        if symbol in (INSULT, THREAT) and state:
            marks |= self.mark
        if symbol == self.symbol:
            return self.reach, marks
        if symbol in self.ends:
            return 0, marks
        return (state if symbol in (BREAK, STOP) else max(0, state - 1)), marks


@dataclass(frozen=True)
class Clause:
    """A transducer that gathers words of one symbol into clauses. Its state is None, or the mark of
    the open clause (the least denied and quoted one of its words) and the words it still waits."""

    symbol: int
    wait: int
    needs_target: bool

    def step(self, state: tuple[int, int] | None, symbol: int, marks: int) -> tuple[tuple[int, int] | None, int | None, bool]:
        """The next state, the mark of the clause that ends here, if one does, and whether it has a target."""
        if symbol == self.symbol:
            own = marks & ~IS_ADDRESSED
            own = own if state is None else own & state[0]
            return (None, own, True) if marks & IS_ADDRESSED else ((own, self.wait), None, False)
        if state is None:
            return None, None, False
        if symbol == TARGET:
            return None, state[0], True
        left = state[1] if symbol == BREAK else state[1] - 1
        if symbol == STOP or left <= 0:
            return None, None if self.needs_target else state[0], False
        return (state[0], left), None, False


MARKERS = (Memory(DENY, 2, (BREAK, STOP), IS_DENIED), Memory(REPORT, 6, (STOP,), IS_QUOTED), Memory(TARGET, 4, (STOP,), IS_ADDRESSED))
CLAUSES = (Clause(INSULT, 6, False), Clause(THREAT, 6, True))
#: Kinds of clauses: insults by their marks, then threats, all of which are addressed.
KINDS = 16


def kind_of(threat: bool, marks: int, addressed: bool) -> int:
    return 8 * threat + (marks & (IS_DENIED | IS_QUOTED)) + IS_ADDRESSED * addressed


def given(kind: int) -> float:
    """What a clause of a kind counts before anything is learned."""
    return (ADDRESSED if kind & IS_ADDRESSED else 1.0) * (DENIED if kind & IS_DENIED else 1.0) * (QUOTED if kind & IS_QUOTED else 1.0)


class Machine:
    """The composition. States are numbers of tuples of the parts' states; a state's move by a symbol is
    made when a text first takes it."""

    def __init__(self) -> None:
        start = (0,) * len(MARKERS) + (None,) * len(CLAUSES)
        self.tuples, self.number = [start], {start: 0}
        self.moves: dict[int, tuple[int, tuple[tuple[bool, int], ...]]] = {}

    def move(self, at: int, symbol: int) -> tuple[int, tuple[tuple[bool, int], ...]]:
        """The next state, and the clauses that end: whether of a threat, and their kind."""
        got = self.moves.get(at * 8 + symbol)
        if got is None:
            now, after, marks, ended = self.tuples[at], [], 0, []
            for part, state in zip(MARKERS, now, strict=False):
                state, marks = part.step(state, symbol, marks)
                after.append(state)
            for threat, (part, state) in enumerate(zip(CLAUSES, now[len(MARKERS) :], strict=True)):
                state, mark, addressed = part.step(state, symbol, marks)
                after.append(state)
                if mark is not None:
                    ended.append((bool(threat), kind_of(bool(threat), mark, addressed)))
            to = tuple(after)
            if to not in self.number:
                self.number[to] = len(self.tuples)
                self.tuples.append(to)
            got = self.moves[at * 8 + symbol] = (self.number[to], tuple(ended))
        return got


class Grammar:
    """Lexicons and weights; everything that scoring needs. counts: what a clause of each kind counts."""

    def __init__(self, lexicon: dict[str, float], weights: tuple[float, float, float] = (-4.0, 1.0, 1.0), counts: tuple[float, ...] | None = None):
        self.lexicon = lexicon
        self.weights = weights
        self.counts = counts or tuple(map(given, range(KINDS)))
        self.machine = Machine()
        closed = [(TARGET, TARGETS), (DENY, DENIALS), (REPORT, REPORTS), (THREAT, THREATS)]
        self._fixed = {w: (c, 1.0 if c == THREAT else 0.0) for c, ws in closed for w in ws}
        self._fixed |= {m: (STOP, 0.0) for m in ".!?\n"} | {m: (BREAK, 0.0) for m in ',;:()"“”'}
        self._known: dict[str, tuple[int, float]] = {}

    def symbol(self, word: str) -> tuple[int, float]:
        """Class and weight of a word; the longest known beginning counts."""
        known = self._known.get(word)
        if known is None:
            if len(self._known) > 100_000:
                self._known.clear()
            known = self._fixed.get(word) or (OTHER, 0.0)
            if word + "$" in self.lexicon:
                known = (INSULT, self.lexicon[word + "$"])
            else:
                for n in reversed(LENGTHS):
                    if len(word) >= n and word[:n] in self.lexicon:
                        known = (INSULT, self.lexicon[word[:n]])
                        break
            self._known[word] = known
        return known

    def clauses(self, text: str) -> list[tuple[int, float]]:
        """Kind and weight of each clause, by the weightiest of its words."""
        symbols = [*map(self.symbol, words(text))]
        if not any(s[1] for s in symbols):
            return []
        at, found, open_ = 0, [], [0.0, 0.0]  # the weights of the open insult and the open threat
        for c, w in [*symbols, (STOP, 0.0)]:
            if w:
                threat = c == THREAT
                open_[threat] = max(open_[threat], w)
            elif not at and c == OTHER:
                continue
            at, ended = self.machine.move(at, c)
            for threat, kind in ended:
                found.append((kind, open_[threat]))
                open_[threat] = 0.0
            if c == STOP:
                open_ = [0.0, 0.0]
        return found

    def parts(self, text: str) -> tuple[list[float], list[float]]:
        """By kind the weightiest clause and the sum of all."""
        top, total = [0.0] * KINDS, [0.0] * KINDS
        for kind, w in self.clauses(text):
            top[kind] = max(top[kind], w)
            total[kind] += w
        return top, total

    def features(self, text: str) -> tuple[float, float]:
        found = [w * self.counts[kind] for kind, w in self.clauses(text)]
        return (max(found), log1p(sum(found))) if found else (0.0, 0.0)

    def score(self, text: str) -> float:
        """The probability that a text is toxic."""
        b, m, s = self.weights
        top, total = self.features(text)
        return 1 / (1 + exp(-max(-30.0, min(30.0, b + m * top + s * total))))


# --- learning --------------------------------------------------------------------------------


def entries(text: str) -> set[str]:
    """What may enter the lexicon: whole words, marked by $, and beginnings of words."""
    out = set()
    for w in set(words(text)):
        if w[0].isalpha():
            out.add(w + "$")
            out.update(w[:n] for n in LENGTHS if n <= len(w))
    return out


def sketch(text: str) -> list[int]:
    """Minimal hashes of the runs of three words."""
    w = words(text)
    runs = {" ".join(w[i : i + 3]).encode() for i in range(max(1, len(w) - 2))}
    return [min(crc32(r, k) for r in runs) for k in range(1, SKETCHES + 1)]


def choose(counts: Iterable[tuple[str, int, int]], toxic: int, clean: int, least: int, odds: float, evidence: float = 0.0) -> dict[str, float]:
    """Entries seen in at least `least` toxic documents whose odds of being toxic, smoothed, exceed
    those of all documents by `odds` in logarithm, and whose rows, drawn by chance from all, would be
    as toxic with a logarithm of likelihood of -`evidence` at most; an entry that a shorter one covers
    as well is left out. The weight is the logarithm of the odds, from 0 to 1 at 8."""
    good, rate = {}, toxic / max(1, toxic + clean)
    for e, t, c in counts:
        if t >= least:
            o = log((t + 0.1) / (toxic + 0.2)) - log((c + 0.1) / (clean + 0.2))
            gain = t * log(t / (t + c) / rate) + (c * log(c / (t + c) / (1 - rate)) if c else 0.0)
            if o >= odds and gain >= evidence:
                good[e] = (o, t)
    out = {}
    for e, (o, _) in good.items():
        stem = e.rstrip("$")
        if not any(stem[:n] in good and stem[:n] != e for n in LENGTHS if n < len(stem) or (n == len(stem) and e.endswith("$"))):
            out[e] = min(1.0, o / 8)
    return out


def counted(total: np.ndarray, y: np.ndarray, faith: float = FAITH) -> tuple[float, ...]:
    """What a clause of each kind counts: how far rows with such clauses are from the others in the
    logarithm of odds, over the same of plain insults (kind 0), drawn towards what is given."""
    sizes = np.array([max(1, int((y == k).sum())) for k in (0, 1)])

    def odds(k: int) -> tuple[float, int]:
        has = total[:, k] > 0
        t, c = int((has & (y == 1)).sum()), int((has & (y == 0)).sum())
        return log((t + 0.5) / (sizes[1] + 1)) - log((c + 0.5) / (sizes[0] + 1)), t + c

    plain, _ = odds(0)
    if plain < 0.5:
        return tuple(map(given, range(KINDS)))
    out = []
    for k in range(KINDS):
        o, n = odds(k)
        out.append(1.0 if k == 0 else (n * min(2.0, max(0.0, o / plain)) + faith * given(k)) / (n + faith))
    return tuple(out)


def fit(x: np.ndarray, y: np.ndarray, steps: int = 50, ridge: float = 1e-2) -> tuple[float, float, float]:
    """Logistic regression by Newton's method; features may only speak for toxicity."""
    a = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(a.shape[1])
    keep = np.diag([1e-6, *[ridge] * x.shape[1]]) * max(1, len(x)) / 1000
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (y - p) - keep @ w
        h = (a * (p * (1 - p))[:, None]).T @ a + keep + 1e-9 * np.eye(len(w))
        d = np.linalg.solve(h, g)
        w = np.clip(w + d, [-12, 0, 0], [12, 20, 20])
        if np.abs(d).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def learn(docs: DataFrame, labels: DataFrame, sample: int = 20_000, least: int = 5, evidence: float = 10.0, odds: float = 3.0, label_col: str = "toxic") -> Grammar:
    """Fit the grammar on labelled rows: docs (doc_id, text) and labels (doc_id, label 0/1).

    At most about `sample` rows are used, taken by a hash of doc_id; all if there are no more. Word
    counts and features are made by the executors; the driver gets the entries that qualify and three
    numbers a sampled row. Of rows that
    share a minimal shingle hash, as copies and near copies do, one is kept: what the copies of one
    text have in common is no insult. An entry needs `least` toxic rows and
    `evidence` that they are no chance, which is the same for a sample of any size. Rows without a label, a doc_id or a document are left out; without rows of
    both classes the grammar knows no insult and scores everything below a half."""
    have = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label_col).cast("int").alias("toxic"))
    n = have.count()
    share = min(1_000_000, -(-sample * 1_000_000 // max(1, n)))
    # so few rows, of two numbers each, can be sent to every executor
    taken = have.where(F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1_000_000)) < share)

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sketch(t.as_py()) for t in batch.column(1)]
            hashes = [pa.array([f[k] for f in found], pa.int64()) for k in range(SKETCHES)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *hashes], ["doc_id", "text", "toxic", *(f"h{k}" for k in range(SKETCHES))])

    rows = text_column(docs).join(F.broadcast(taken), "doc_id").select("doc_id", "text", "toxic")
    rows = materialize(rows.mapInArrow(signed, "doc_id bigint, text string, toxic int, " + ", ".join(f"h{k} bigint" for k in range(SKETCHES))), "labelled")
    one = rows.select("doc_id", *[f"h{k}" for k in range(SKETCHES)])
    for k in range(SKETCHES):  # of rows with an equal hash the first stays
        others = [f"h{j}" for j in range(SKETCHES) if j != k]
        one = one.groupBy(f"h{k}").agg(F.min(F.struct("doc_id", *others)).alias("one")).select("one.*", f"h{k}")
    different = F.broadcast(one.select("doc_id").distinct())  # no more than the sample
    rows = rows.join(different, "doc_id").select("doc_id", "text", "toxic")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                seen[toxic].update(entries(text.as_py()))
                seen[toxic][""] += 1
        # an entry that no toxic document here has still counts against others' partitions
        keys = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([seen[1][k] for k in keys], pa.int64()), pa.array([seen[0][k] for k in keys], pa.int64())], ["entry", "t", "c"])

    counts = rows.mapInArrow(count, "entry string, t bigint, c bigint").groupBy("entry").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    counts = materialize(counts, "entries")
    whole = counts.where("entry = ''").select("t", "c").first()
    toxic, clean = tuple(whole) if whole else (0, 0)
    if not toxic or not clean:
        return Grammar({})
    # what choose() asks for, with a little room for rounding
    enough = (F.col("t") + 0.1) * (clean + 0.2) >= (F.col("c") + 0.1) * (exp(odds) * (toxic + 0.2) * (1 - 1e-9))
    found = [tuple(r) for r in counts.where((F.col("entry") != "") & (F.col("t") >= least) & enough).collect()]
    grammar = Grammar(choose(found, toxic, clean, least, odds, evidence))
    shared = docs.sparkSession.sparkContext.broadcast(grammar.lexicon)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Grammar(shared.value)
        for batch in batches:
            x = [own.parts(t.as_py()) for t in batch.column(1)]
            lists = [pa.array([v[k] for v in x], pa.list_(pa.float64())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*lists, batch.column(2)], ["top", "total", "toxic"])

    # no more rows than the sample; those without a clause, most of them, are one row a class
    alike = rows.mapInArrow(featured, "top array<double>, total array<double>, toxic int").groupBy("top", "total", "toxic").count()
    got = alike.orderBy("top", "total", "toxic").collect()
    times = [r["count"] for r in got]
    top, total = (np.repeat(np.array([r[k] for r in got], dtype=np.float64).reshape(-1, KINDS), times, axis=0) for k in (0, 1))
    y = np.repeat(np.array([r[2] for r in got], dtype=np.float64), times)
    counts = counted(total, y)
    x = np.stack([(top * counts).max(1), np.log1p((total * counts).sum(1))], axis=1)
    return Grammar(grammar.lexicon, fit(x, y), counts)


def score(docs: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 from a half on) of each row, whole texts, in a narrow
    map. Null and empty texts have no clause and get the score of clean text; repeated rows stay."""
    shared = docs.sparkSession.sparkContext.broadcast((grammar.lexicon, grammar.weights, grammar.counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Grammar(*shared.value)
        for batch in batches:
            scores = np.array([own.score(t.as_py()) for t in batch.column(1)], dtype=np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return text_column(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, score double, predicted int")


def reject(docs: DataFrame, grammar: Grammar, text_col: str = "text") -> DataFrame:
    """The rows of docs that score below a half, as they are. Null texts count as empty and stay."""
    shared = docs.sparkSession.sparkContext.broadcast((grammar.lexicon, grammar.weights, grammar.counts))
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Grammar(*shared.value)
        for batch in batches:
            stay = [own.score(t.as_py() or "") < 0.5 for t in batch.column(place)]
            yield batch.filter(pa.array(stay, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(folds: int = 5, fold: int = 0):  # noqa: ANN201
    """Whether a row's doc_id falls into the fold that learning never sees."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold


def judge(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> DataFrame:
    """Learn from the labels outside the held-out fold and score every document: doc_id, held_out,
    score and predicted. Null and empty texts score as clean ones, repeated rows stay, other columns
    are ignored; an empty table of documents gives an empty result, one of labels scores below a half."""
    grammar = learn(docs, labels.where(~held_out()), sample)
    return score(docs, grammar).select("doc_id", held_out().alias("held_out"), "score", "predicted")
