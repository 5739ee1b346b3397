"""Personal data in texts: fixed patterns, and what a trained character model adds to them.

The patterns' spans always stay. A bidirectional LSTM with CRF transitions, trained here from the
patterns' own spans in a bounded sample and from written-out forms that the patterns miss, reads
every place that can hold personal data. Such a place has a digit, an at-sign or a spelled-out one:
no span without one is ever allowed, so text away from them needs no reading and loses nothing.
Windows of fixed length overlap; where they do, a character's scores come from the window in whose
middle it lies most, and one decoding runs over the whole place.

Beside other writings of the patterns' kinds the model finds a kind that has no pattern: secrets, the
values of tokens, keys and passwords.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import text_column
from quarry.llm.tagger import PAD, Tagger, codes

KINDS = ("email", "ip", "card", "phone")
#: What the model knows.
LEARNED = (*KINDS, "secret")
Span = tuple[int, int]

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a start within a run of digits can only fail where the run's own start has failed
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(number: str) -> bool:
    odd = number[-1::-2]
    even = [2 * int(c) for c in number[-2::-2]]
    return (sum(map(int, odd)) + sum(v - 9 if v > 9 else v for v in even)) % 10 == 0


def _emails(text: str) -> list[Span]:
    """Leftmost matches of the address pattern, found from the at-signs: a run of address
    characters without one is never tried from each of its places."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and _LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, m.end()))
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", free)
    return found


def base(text: str) -> dict[str, list[Span]]:
    """The patterns' spans of each kind, code points, ends exclusive."""
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = _emails(text)
    if re.search("[0-9]", text):
        out["ip"] = [m.span() for m in _IP.finditer(text) if all(len(v := p.lstrip("0") or "0") <= 3 and int(v) <= 255 for p in m.group().split("."))]
        out["card"] = [m.span() for m in _CARD.finditer(text) if 13 <= len(d := digits(m.group())) <= 19 and luhn(d)]
        out["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= len(digits(m.group())) <= 15]
    return out


# --- the model's places ----------------------------------------------------------------------

WINDOW, STRIDE, AROUND = 96, 48, 40
#: What every span holds at least one of.
_TRIGGER = re.compile(r"[0-9@]|[\[({<]\s?(?:at|AT|At)\s?[\])}>]")


def places(text: str) -> list[Span]:
    """Stretches around triggers, merged where they touch."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _allowed() -> np.ndarray:
    """Inside a kind only after its beginning or inside: tag 0 is outside, 1 + 2k begins, 2 + 2k goes on."""
    n = 1 + 2 * len(LEARNED)
    ok = np.ones((n, n), bool)
    for k in range(len(LEARNED)):
        ok[:, 2 + 2 * k] = False
        ok[1 + 2 * k, 2 + 2 * k] = ok[2 + 2 * k, 2 + 2 * k] = True
    return ok


ALLOWED = _allowed()


def windows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping windows over a place, and the start of each."""
    starts = np.arange(0, max(1, len(x) - WINDOW + STRIDE), STRIDE)
    padded = np.full(int(starts[-1]) + WINDOW, PAD, np.int16)
    padded[: len(x)] = x
    return padded[starts[:, None] + np.arange(WINDOW)], starts


def stitch(e: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """One row of scores a character, from the window in whose middle it lies most."""
    at = np.arange(n)
    k = np.clip(np.rint((at - WINDOW / 2 + 0.5) / STRIDE).astype(int), 0, len(starts) - 1)
    return e[k, at - starts[k]]


_SPELLED = re.compile(r"\s?[\[({<]\s?(?:at|AT|At)\s?[\])}>]\s?")
_SPELLED_DOT = re.compile(r"\s?[\[({<]\s?(?:dot|DOT|Dot)\s?[\])}>]\s?")


def plausible(kind: str, s: str) -> bool:
    """Whether what the model marked can be of the kind at all."""
    d = digits(s)
    if kind == "email":
        plain = _SPELLED_DOT.sub(".", _SPELLED.sub("@", s)).replace(" @", "@").replace("@ ", "@")
        return bool(re.fullmatch(r"[^\s@]{1,64}@[^\s@.]+(\.[^\s@.]+)+", plain))
    if kind == "ip":
        p = re.fullmatch(r"([0-9]{1,3})\W{1,3}([0-9]{1,3})\W{1,3}([0-9]{1,3})\W{1,3}([0-9]{1,3})", s)
        return bool(p) and all(int(v) <= 255 for v in p.groups())
    if kind == "card":
        return bool(re.fullmatch(r"[0-9](?:[\s./_–-]{0,2}[0-9])+", s)) and 13 <= len(d) <= 19 and luhn(d)
    if kind == "secret":
        return bool(re.fullmatch(r"[^\s\"'<>]{12,}", s)) and bool(d) and bool(re.search("[A-Za-z]", s))
    return 9 <= len(d) <= 15 and bool(re.fullmatch(r"(?:\+|\(|[0-9])[\s()./0-9–-]*[0-9]", s)) and bool(re.search(r"[^0-9]", s)) and len(re.findall(r"[0-9]+", s)) <= 6


class Finder:
    """The patterns and the trained model."""

    def __init__(self, tagger: Tagger):
        self.tagger = tagger

    def added(self, texts: list[str], bases: list[dict[str, list[Span]]], at_once: int = 4096) -> list[dict[str, list[Span]]]:
        """What the model finds beside the patterns' spans, batched over texts."""
        out = [{k: [] for k in LEARNED} for _ in texts]
        queue: list[tuple[int, int, int, np.ndarray, np.ndarray]] = []
        held = 0

        def flush() -> None:
            every = np.concatenate([q[3] for q in queue])
            e = np.concatenate([self.tagger.emissions(every[i : i + at_once]) for i in range(0, len(every), at_once)])
            done = 0
            for doc, start, n, w, starts in queue:
                scores = stitch(e[done : done + len(w)], starts, n)
                done += len(w)
                self._spans(texts[doc], start, self.tagger.decode(scores, ALLOWED), bases[doc], out[doc])

        for doc, text in enumerate(texts):
            for a, b in places(text):
                w, starts = windows(codes(text[a:b]))
                queue.append((doc, a, b - a, w, starts))
                held += len(w)
                if held >= at_once:
                    flush()
                    queue, held = [], 0
        if queue:
            flush()
        return out

    def _spans(self, text: str, start: int, tags: np.ndarray, known: dict[str, list[Span]], out: dict[str, list[Span]]) -> None:
        begins = np.flatnonzero(tags % 2 == 1)
        for b in begins.tolist():
            end = b + 1
            while end < len(tags) and tags[end] == tags[b] + 1:
                end += 1
            s, t = start + b, start + end
            kind = LEARNED[(int(tags[b]) - 1) // 2]
            while s < t and text[s].isspace():
                s += 1
            while t > s and text[t - 1].isspace():
                t -= 1
            if kind == "secret":  # quotes are not the value's
                while s < t and text[s] in "\"'`":
                    s += 1
                while t > s and text[t - 1] in "\"'`.,;":
                    t -= 1
            whole = (s == 0 or not text[s - 1].isalnum()) and (t == len(text) or not text[t].isalnum())
            clash = any(x < t and s < y for spans in known.values() for x, y in spans)
            if s < t and whole and not clash and plausible(kind, text[s:t]):
                out[kind].append((s, t))


# --- training --------------------------------------------------------------------------------


def _secret(r: np.random.Generator) -> tuple[str, int, int]:
    """A named value, and where the value lies in it."""
    name = str(r.choice(["token", "password", "passwd", "pwd", "secret", "key", "api_key", "apikey", "access_token", "auth", "bearer", "client_secret", "Token", "PASSWORD", "API_KEY"]))
    gap = str(r.choice([" = ", "=", ": ", ":", " : ", " "])) if name != "bearer" else " "
    signs = list(str(r.choice(["0123456789abcdef", "0123456789abcdef", "0123456789ABCDEF", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ-_+/"])))
    value = "".join(r.choice(signs, int(r.integers(14, 49)))) + str(r.integers(0, 10)) + "".join(r.choice(list("abcdef"), 1))
    quote = str(r.choice(['"', '"', "'", ""]))
    made = f"{name}{gap}{quote}{value}{quote}"
    start = len(name) + len(gap) + len(quote)
    return made, start, start + len(value)


def _variants(r: np.random.Generator) -> tuple[str, str, int, int]:
    """A written-out form of some kind, the kind, and where it lies in what is written; an empty kind
    for look-alikes that are none."""
    num = lambda n: "".join(map(str, r.integers(0, 10, n)))
    word = lambda: "".join(r.choice(list("abcdefghijklmnoprstuvw"), int(r.integers(3, 9))))
    kind = int(r.integers(0, 16))
    whole = lambda made, k: (made, k, 0, len(made))
    if kind < 2:
        at = str(r.choice(["@", " (at) ", "[at]", " [at] ", "(at)", "@"]))
        dot = "." if "@" in at else str(r.choice([".", " (dot) ", "[dot]", " [dot] ", "(dot)"]))
        name = r.choice(["", f".{word()}", f"_{word()}", f".{num(2)}", num(int(r.integers(1, 3)))])
        return whole(f"{word()}{name}{at}{word()}{dot}{r.choice(['', word() + dot])}{r.choice(['com', 'org', 'net', 'de'])}", "email")
    if kind < 4:
        dot = str(r.choice([".", "[.]", " . ", "(.)"]))
        return whole(dot.join(str(v) for v in r.integers(0, 256, 4)), "ip")
    if kind < 6:
        d = num(15)
        d += next(str(c) for c in range(10) if luhn(d + str(c)))
        gap = str(r.choice(["", " ", "-", ".", " - "]))
        return whole(gap.join(d[i : i + 4] for i in range(0, 16, 4)) if gap else d, "card")
    if kind < 10:
        a, b, c = num(3), num(3), num(4)
        return whole(str(r.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{num(1)} ({a}) {b}-{c}", f"+{num(2)} {a} {b}{c}", f"{a} {b} {c}", f"+{num(2)}-{a}-{b}-{c}", f"{a}.{b}.{c}"])), "phone")
    if kind < 13:
        made, start, end = _secret(r)
        return made, "secret", start, end
    if kind < 15:
        return whole(str(r.choice([f"{r.integers(1, 29)}.{r.integers(1, 13)}.{r.integers(1900, 2030)}", f"{num(2)},{num(3)}.{num(2)}", f"v{num(1)}.{num(1)}.{num(2)}", f"Version {num(1)}.{num(1)}.", num(int(r.integers(1, 13))), f"{num(4)}-{num(2)}-{num(2)}", f"§ {num(3)}", f"{word()}{num(2)}", f"{word()}{num(3)}{word()}", f"token {word()}", f"key {num(2)}"])), "")
    return whole(f"{word()} {word()}", "")


def examples(found: list[tuple[str, list[tuple[int, int, int]]]], count: int, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Training windows and tags: the sampled stretches as they are, and stretches into which a
    form is written at some place between words."""
    r = np.random.default_rng(seed)
    plain = [t for t, spans in found if not spans] or ["The data and the words of a line are here, as in any other line of such a text.", "La ligne est un texte comme les autres, avec des mots et rien de plus."]
    xs, ys = [], []

    def add(text: str, spans: list[tuple[int, int, int]]) -> None:
        x = np.full(WINDOW, PAD, np.int16)
        x[: min(WINDOW, len(text))] = codes(text)[:WINDOW]
        y = np.zeros(WINDOW, np.int64)
        for k, a, b in spans:
            y[a:b] = 2 + 2 * k
            if a < WINDOW:
                y[a] = 1 + 2 * k
        xs.append(x)
        ys.append(y)

    for text, spans in found[: count // 2]:
        # what holds a secret without a label would teach the contrary
        if not any(_NAMED(text)):
            add(text, spans)
    while len(xs) < count:
        text = str(plain[int(r.integers(0, len(plain)))])
        gaps = [i for i, c in enumerate(text[:60]) if c == " "] or [0]
        cut = int(gaps[int(r.integers(0, len(gaps)))])
        made, kind, a, b = _variants(r)
        if r.random() < 0.15:  # at the start of a text, or as all of it
            text, cut = "  " + (text if r.random() < 0.8 else ""), 0
        line = f"{text[:cut]} {made}{r.choice([' ', ' ', ', ', '. ', '### ', ' | '])}{text[cut + 1 :]}"
        at = cut + 1
        if cut == 0:
            line, at = line[1:], 0
        if any(_NAMED(line[: at]) + _NAMED(line[at + len(made) :])) or (kind and at + b > WINDOW):
            continue
        add(line, [(LEARNED.index(kind), at + a, at + b)] if kind else [])
    return np.stack(xs), np.stack(ys)


#: Values that a name introduces: left out of the training lines that have no label for them.
_NAMED = re.compile(r"(?i)(?:token|password|passwd|pwd|secret|key|auth|bearer)\s?[:=]?\s?[\"']?[^\s\"']{12}").findall


def sample(docs: DataFrame, rows: int = 20_000, stretches: int = 600) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """At most `stretches` stretches of one window each, with the patterns' spans in them, from at
    most about `rows` documents taken by a hash of their ids. This is all that training sees."""
    n = docs.count()
    share = min(1_000_000, -(-rows * 1_000_000 // max(1, n)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, marks = [], []
            for text in batch.column(1):
                text = text.as_py()
                spans = [(KINDS.index(k), a, b) for k, v in base(text).items() for a, b in v]
                for a, b in [*spans_around(text, spans), *([(0, min(WINDOW, len(text)))] if text else [])]:
                    inside = [(k, x - a, y - a) for k, x, y in spans if a <= x and y <= b]
                    if not any(x < b and a < y and not (a <= x and y <= b) for _, x, y in spans):
                        lines.append(text[a:b])
                        marks.append(",".join(f"{k}:{x}:{y}" for k, x, y in inside))
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string()), pa.array(marks, pa.string())], ["line", "marks"])

    taken = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("pii")), F.lit(1_000_000)) < share)
    found = taken.mapInArrow(run, "line string, marks string")
    kept = []
    for marked in (True, False):
        got = found.where(F.col("marks") != "" if marked else F.col("marks") == "").distinct().orderBy(F.xxhash64("line"), "line", "marks").limit(stretches // 2).collect()
        kept += [(r["line"], [tuple(map(int, m.split(":"))) for m in r["marks"].split(",") if m]) for r in got]
    return kept


def spans_around(text: str, spans: list[tuple[int, int, int]]) -> list[Span]:
    """A window's length of text around each span, the span at a place that varies."""
    return [(a, min(len(text), a + WINDOW)) for _, s, e in spans if e - s < WINDOW - 16 for a in (max(0, s - (s * 7 + e) % (WINDOW - (e - s) - 8)),)]


def train(docs: DataFrame, steps: int = 320, count: int = 2000) -> Finder:
    """Train the model for a table of documents (doc_id, text) on the driver, in seconds, whatever the
    table's size; the same table gives the same model."""
    x, y = examples(sample(docs), count)
    tagger = Tagger(1 + 2 * len(LEARNED))
    tagger.train(x, y, steps)
    return Finder(tagger)


# --- the operator ----------------------------------------------------------------------------


def listed(spans: dict[str, list[Span]]) -> str:
    """kind:start:end by kind as listed, then start, joined by commas."""
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in sorted(spans[k]))


def find(docs: DataFrame, finder: Finder | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row doc_id, the number of pattern spans of each kind (n_email, n_ip, n_card, n_phone),
    base_sha256 of their list, spans (that list with what the model adds to these kinds), secrets (the
    list of a kind that only the model knows), n_added (spans the model adds, secrets included) and
    n_spans (all spans).

    Null texts count as empty: no spans. Repeated rows stay; other columns are ignored. An empty table
    gives an empty result, and a model that knows the written-out forms alone. A narrow map over whole
    texts once the model is trained."""
    slim = text_column(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast((finder or train(slim)).tagger)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Finder(shared.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            bases = [base(t) for t in texts]
            added = own.added(texts, bases)
            every = [{k: b[k] + a[k] for k in KINDS} for b, a in zip(bases, added, strict=True)]
            counts = [pa.array([len(b[k]) for b in bases], pa.int64()) for k in KINDS]
            hashes = [hashlib.sha256(listed(b).encode()).hexdigest() for b in bases]
            secrets = [",".join(f"secret:{x}:{y}" for x, y in sorted(a["secret"])) for a in added]
            more = [sum(map(len, a.values())) for a in added]
            total = [n + sum(map(len, b.values())) for n, b in zip(more, bases, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array(hashes, pa.string()), pa.array([listed(v) for v in every], pa.string()), pa.array(secrets, pa.string()), pa.array(more, pa.int64()), pa.array(total, pa.int64())],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "secrets", "n_added", "n_spans"],
            )

    counts = ", ".join(f"n_{k} bigint" for k in KINDS)
    return slim.mapInArrow(run, f"doc_id bigint, {counts}, base_sha256 string, spans string, secrets string, n_added bigint, n_spans bigint")


def redact(docs: DataFrame, finder: Finder | None = None, text_col: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in brackets; all other columns as they are. Null
    texts stay null. Spans of two kinds that overlap are replaced as one, by the kind that starts first.
    Repeated rows stay; an empty table gives an empty result."""
    shared = docs.sparkSession.sparkContext.broadcast((finder or train(text_column(docs))).tagger)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Finder(shared.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(place).to_pylist()]
            bases = [base(t) for t in texts]
            new = []
            for text, b, a in zip(texts, bases, own.added(texts, bases), strict=True):
                done, end = [], 0
                for s, t, k in sorted((s, t, k) for k in LEARNED for s, t in b.get(k, []) + a[k]):
                    if s >= end:
                        done += [text[end:s], f"[{k.upper()}]"]
                    end = max(end, t)
                new.append("".join([*done, text[end:]]))
            nulls = batch.column(place).is_null().to_pylist()
            columns = list(batch.columns)
            columns[place] = pa.array([None if n else t for n, t in zip(nulls, new, strict=True)], batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
