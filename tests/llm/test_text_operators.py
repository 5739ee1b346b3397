import hashlib
import random
import zlib
from collections import Counter
from math import log10

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm import bpe, lm, packing, pii, sharding, toxicity
from quarry.llm.tagger import Tagger

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = ["abcdefghijklmnopqrstuvwxyz", "the in on er re", "éüñßçÉÜÑ ", "0123456789", " \t\n\r\x0b\x0c\x1c\x85\xa0\u2028", "!?.,'\"-_()", "ΣσςİıǅК中가あ", "😀👍🏽\u200d\ufe0f\u0301", ["<|endoftext|>", "'s 't "]]


def _texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(r.choice(ALPHABET)) for _ in range(r.randint(0, 40))) for _ in range(n)]


# --- 2 BPE -----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(open(WORD, encoding="utf-8").read())


def test_bpe_equals_library(codec):
    library = Tokenizer.from_file(WORD)
    for t in _texts(4000, 1) + ["", "a" * 5000, "😀" * 300, "aaa bbb" * 900]:
        ids = library.encode(t, add_special_tokens=False).ids
        assert codec.encode(t) == ids
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_transcode(spark, docs):
    library = Tokenizer.from_file(WORD)
    rows = bpe.transcode(docs, WORD, ("ids", "decoded", "n_tokens", "ids_sha256", "decoded_sha256")).collect()
    assert len(rows) == docs.count()
    texts = Counter((r["doc_id"], r["text"] or "") for r in docs.collect())
    for r in rows:
        matches = [t for (i, t) in texts if i == r["doc_id"]]
        ids = library.encode(matches[0], add_special_tokens=False).ids
        assert (r["ids"], r["n_tokens"]) == (ids, len(ids))
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()
    assert bpe.transcode(docs.limit(0), WORD).count() == 0


# --- 5 packing -------------------------------------------------------------------------------


def test_fast_ids_equal_library():
    ids = packing.ids_of(open(BYTE, encoding="utf-8").read(), public_tokenizers.PATTERN)
    library = Tokenizer.from_file(BYTE)
    for t in _texts(4000, 2):
        assert list(ids(t)) == library.encode(t, add_special_tokens=False).ids


def test_cut():
    assert packing.cut(1, 4) == [(0, 1)]
    assert packing.cut(4, 4) == [(0, 4)]
    assert packing.cut(9, 4) == [(0, 1), (1, 4), (5, 4)]
    assert packing.cut(8, 4) == [(0, 4), (4, 4)]


@pytest.mark.parametrize("seed", range(25))
def test_plan_places_every_piece(seed):
    r = random.Random(seed)
    capacity = r.choice([7, 10, 30, 64, 2048])
    h: dict[int, int] = {}
    for _ in range(r.randint(0, 200)):
        n = r.randint(1, capacity if r.random() < 0.5 else max(1, capacity // 4))
        h[n] = h.get(n, 0) + r.choice([1, 1, 2, 5, 50])
    p = packing.plan(h, capacity)
    pieces = [(n, k) for n, c in h.items() for k in range(c)]
    if not pieces:
        assert p.sequences == 0
        return
    seq, off = p.locate(np.array([x[0] for x in pieces]), np.array([x[1] for x in pieces]))
    bins: dict[int, list] = {}
    for (n, _), s, o in zip(pieces, seq, off, strict=True):
        bins.setdefault(int(s), []).append((int(o), n))
    assert set(bins) == set(range(p.sequences))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= capacity
        assert sum(3 * n > capacity for _, n in b) <= 2
    total = sum(n * c for n, c in h.items())
    assert p.sequences <= 1.3 * -(-total // capacity) + sum(c for n, c in h.items() if 2 * n > capacity)


def test_pack_documents(spark, docs):
    out = packing.pack_documents(docs, BYTE, public_tokenizers.PATTERN, capacity=16, outputs=("ids", "ids_crc32")).collect()
    library = Tokenizer.from_file(BYTE)
    want = Counter()
    for r in docs.collect():
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        want.update((r["doc_id"], k, s, n, np.array(ids[s : s + n], "<u4").tobytes()) for k, (s, n) in enumerate(packing.cut(len(ids), 16)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], bytes(r["ids"])) for r in out) == want
    assert all(r["ids_crc32"] == zlib.crc32(bytes(r["ids"])) for r in out)
    by: dict[int, list] = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in by.values():
        ends = [0] + [o + n for o, n in sorted(b)]
        assert [o for o, _ in sorted(b)] == ends[:-1] and ends[-1] <= 16
    assert packing.pack_documents(docs.limit(0), BYTE, public_tokenizers.PATTERN).count() == 0
    with pytest.raises(ValueError):
        packing.pack(spark.sql("SELECT 1L AS doc_id, 0 AS piece, 17 AS length"), 16)


# --- 9 sharding ------------------------------------------------------------------------------


def _jump(key, n):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * sharding.MULTIPLIER + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_equals_published_loop(spark):
    k = F.xxhash64("id")
    for n in (1, 2, 24, 300):
        rows = spark.range(200).select(k.alias("k"), sharding.jump(k, n).alias("s"), sharding.jump(k, n + 1).alias("t")).collect()
        assert all(r["s"] == _jump(r["k"], n) for r in rows)
        assert all(r["t"] in (r["s"], n) for r in rows)


def test_shard_documents(spark, docs):
    rows = sharding.shard_documents(docs, 3).collect()
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    by: dict[int, list] = {}
    for r in rows:
        assert r["law"] == "key" and r["grown_shard"] in (r["shard"], 3)
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sharding.shard_documents(docs.limit(0)).count() == 0


def test_gapless_rank_over_many_buckets(spark):
    from quarry.llm.common import gapless_rank

    df = spark.range(500).select((F.col("id") % 3).alias("k"), "id")
    for given in (500, {0: 167, 1: 167, 2: 166}, {0: 167, 1: 3}):
        rows = gapless_rank(df, ["k"], [F.col("id")], "r", given, per_bucket=20).collect()
        for k in range(3):
            assert sorted(r["r"] for r in rows if r["k"] == k) == list(range(sum(i % 3 == k for i in range(500))))


def test_pack_with_clashing_columns(spark):
    rows = [(i, 0, 1 + i * 37 % 50, 7, 8, 9, 10, 11) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, piece int, length int, _rank int, _bucket int, _within int, _before int, offset int")
    got = packing.pack(df, 64).collect()
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert (r["_rank"], r["_bucket"], r["_within"], r["_before"], r["input_offset"]) == (7, 8, 9, 10, 11)
    assert len(got) == 60 and all(sum(n for _, n in v) <= 64 and sorted(o for o, _ in v)[0] == 0 for v in by.values())


# --- 7 language model ------------------------------------------------------------------------


def test_lm_base_and_normalisation(spark, docs, monkeypatch):
    for head, targets in ((100_000, 800), (4, 2)):
        monkeypatch.setattr(lm, "HEAD", head)
        monkeypatch.setattr(lm, "TARGETS", targets)
        rows = lm.score(docs).collect()
        texts = [(r["doc_id"], (r["text"] or "").encode().lower().split()) for r in docs.collect()]
        held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in texts}
        c = Counter()
        for i, w in texts:
            if not held[i]:
                c.update([*w, None])
        n, v = sum(c.values()), len(c)
        want = Counter()
        for i, w in texts:
            base = sum(log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in [*w, None])
            want[i, held[i], len(w) + 1, sum(c[x] > 0 for x in [*w, None]), n, round(base, 6)] += 1
        assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows) == want
        assert all(r["score"] < 0 and np.isfinite(r["score"]) for r in rows)
    assert lm.score(docs.limit(0)).count() == 0


def test_lm_learns_contexts():
    r = np.random.default_rng(0)
    counts = np.zeros((9, 6))
    truth = r.dirichlet(np.full(6, 0.3), size=3)
    for c in range(9):
        counts[c] = r.multinomial(5000, truth[c % 3])
    w = lm.train(counts, steps=300, dimensions=4)
    table = lm.parameters_to_table(w)
    assert np.allclose((10**table).sum(1), 1)
    share = counts.sum(0) / counts.sum()
    assert (counts * table).sum() > (counts * np.log10(share)).sum()
    assert np.abs(10**table - counts / counts.sum(1, keepdims=True)).max() < 0.1
    # a target or a nearer word fitted alone, all else given, is where it was
    again = lm.fit_targets(counts.T[2:4], counts.sum(1), w, np.hstack([w["target"], w["bias"][:, None]])[2:4], steps=300)
    ten = np.log(10) * table + lm.sums(w["near"], w["far"], w["target"], w["bias"]).T.ravel()[:, None]
    own = (w["far"][:, None, :] + w["near"][None, :, :]).reshape(9, -1) @ again[:, :-1].T + again[:, -1]
    z = lm.sums(w["near"], w["far"], w["target"], w["bias"]).T.ravel()[:, None]
    assert np.abs(np.exp(own - z) - 10 ** table[:, 2:4]).max() < 0.03
    assert np.allclose(np.exp(ten - lm.sums(w["near"], w["far"], w["target"], w["bias"]).T.ravel()[:, None]).sum(1), 1)


def test_lm_nearer_words_learn_alone():
    r = np.random.default_rng(3)
    target, bias = r.normal(size=(30, 6)).astype(np.float32), np.zeros(30, np.float32)
    truth = r.normal(size=(4, 6)).astype(np.float32)
    p = np.exp(truth @ target.T)
    p /= p.sum(1, keepdims=True)
    counts = np.stack([r.multinomial(20_000, q) for q in p]).astype(np.float32)
    share = (counts.sum(0) / counts.sum()).astype(np.float32)
    start = np.zeros((4, 6), np.float32)
    got = lm.fit_near(counts, share, target, np.log(share), start, start, steps=200)
    out = got @ target.T + np.log(share)
    out -= np.log(np.exp(out).sum(1, keepdims=True))
    loss = lambda q: -(counts * q).sum() / counts.sum()
    assert loss(out) < loss(np.log(share)) - 0.3 and loss(out) < loss(np.log(p)) + 0.3


def test_lm_tokens():
    assert lm.tokens("Ab\x0bÉ\x1cC \t d\xa0e") == ["ab", "É\x1cc", "d\xa0e"]


def test_lm_contexts():
    v = lm.Vocabulary({"a": 5, "b": 4, "c": 3, "": 2}, ["a", "b", "c"], 2, ["a"], ["a", "b"])
    n = lm._Numbers(v)
    index, target, starts, rare, words, _ = n.lay(["a b zz", "", "a c"])
    assert starts.tolist() == [0, 4, 5] and words == ["zz"] and rare.tolist() == [2]
    far, one, near = lm.contexts_of(n, index, target, starts)
    before, zz, c = v.contexts - 1, 1 + lm.shape("zz") // 4, 1 + lm.shape("c") // 4
    assert far.tolist() == [before, before, 0, 1 + lm.shape("b") // 4, before, before, before, 0]
    assert one.tolist() == [before, 0, 1 + lm.shape("b") // 4, zz, before, before, 0, c]
    assert near.tolist() == [2 + before, 0, 1, 2 + zz, 2 + before, 2 + before, 0, 2 + c]
    assert v.core_of()[:3].tolist() == [0, 1, 2 + lm.shape("c")] and v.core_of()[-1] == v.core_size - 1


def test_lm_is_a_distribution(spark):
    """Over all targets, every class split among its words and one unseen, probabilities add up to one in
    every context."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").na.fill("", ["text"])
    v = lm.Vocabulary({"the": 500, "of": 400, "and": 300, "la": 200, "": 200}, ["the", "of", "and", "la"], 2, ["the"], ["the", "of", "la", "never"])
    m = lm.fit(lm.context_counts(docs, v), v)
    for near in range(len(m.near)):
        for far in (0, v.contexts - 1):
            got = m.score(np.full(v.size, far), np.full(v.size, near), np.arange(v.size))
            assert abs((10**got).sum() - 1) < 1e-3


def test_lm_beats_its_base_on_held_out_rows(spark):
    got = lm.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").selectExpr("sum(score) / sum(n_tokens) AS s", "sum(base_score) / sum(n_tokens) AS b", "avg(CAST(score > base_score AS double)) AS w").first()
    assert got["s"] > got["b"] + 0.1 and got["w"] > 0.9


def test_lm_end_is_counted_outside_the_head(spark, monkeypatch):
    """Few long documents: the end is rarer than every word of the head."""
    df = spark.createDataFrame([(i, "aa bb cc dd " * 50) for i in range(12)], "doc_id bigint, text string")
    row = lambda: sorted((x["doc_id"], x["n_known"], round(x["base_score"], 9)) for x in lm.score(df).collect())
    want = row()
    monkeypatch.setattr(lm, "HEAD", 4)
    assert row() == want and want[0][1] == 201


# --- 8 toxicity ------------------------------------------------------------------------------


def test_grammar_scores_clauses():
    g = toxicity.Grammar({"idio": 1.0, "scum$": 0.8}, (-6.0, 8.0, 2.0))
    weight = lambda text: [w * g.counts[k] for k, w in g.clauses(text)]
    plain, addressed = weight("some idiotic noise"), weight("you are an idiot")
    denied, quoted = weight("not an idiot"), weight("he said idiot")
    assert plain == [1.0] and addressed[0] > plain[0] > denied[0] and quoted[0] < addressed[0]
    assert weight("scum scummy") == [0.8] and weight("kill the lights.") == [] and weight("kill") == []
    assert weight("idiot, you") == addressed and weight("idiot. you") == plain and weight("idiot scum idiot") == plain
    for text in ("I will kill you", "kill you", "we will kill you", "kill or hurt, one day, you"):
        assert weight(text) == [toxicity.ADDRESSED], text
    assert weight("never kill you") == [toxicity.ADDRESSED * toxicity.DENIED] and not weight("") and not weight("kill a b c d e f you")
    assert g.score("") < 0.5 < g.score("you idiot") and g.score("he said not idiot") < g.score("idiot")


def _plain_clauses(g, text):
    """The clauses by direct search over the words, without a machine."""
    symbols = [g.symbol(w) for w in toxicity.words(text)] + [(toxicity.STOP, 0.0)]
    marks_ends = (toxicity.BREAK, toxicity.STOP)

    def marked(i, symbol, reach, ends):
        left = reach
        for c, _ in reversed(symbols[:i]):
            if c == symbol:
                return True
            left -= c not in marks_ends
            if c in ends or left <= 0:
                return False
        return False

    found = []
    for kind, threat in ((toxicity.INSULT, False), (toxicity.THREAT, True)):
        i = 0
        while i < len(symbols):
            if symbols[i][0] != kind:
                i += 1
                continue
            marks, weight, left, end, target = 3, 0.0, 6, False, False
            while not end:
                c, w = symbols[i]
                if c == kind:
                    marks &= marked(i, toxicity.DENY, 2, marks_ends) + 2 * marked(i, toxicity.REPORT, 6, (toxicity.STOP,))
                    weight, left = max(weight, w), 6
                    end = target = marked(i, toxicity.TARGET, 4, (toxicity.STOP,))
                elif c == toxicity.TARGET:
                    end = target = True
                else:
                    left -= c != toxicity.BREAK
                    end = c == toxicity.STOP or left <= 0
                i += 1
            if target or not threat:
                found.append((8 * threat + marks + 4 * target, weight))
    return sorted(found)


def test_machine_equals_direct_search():
    r = random.Random(0)
    g = toxicity.Grammar({"idio": 1.0, "scum$": 0.8})
    for n in range(3000):
        text = " ".join(r.choice(["the", "a", "b", "you", "not", "said", "idiot", "scum", "kill", ",", ".", "one", "two"]) for _ in range(r.randrange(1, 25)))
        assert sorted(g.clauses(text)) == _plain_clauses(g, text), text


def test_scores_equal_direct_search(spark):
    """Whole documents: learned grammar, score from clauses found without the machine."""
    from math import exp, log1p

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    g = toxicity.Grammar({"worthl": 1.0, "of$": 0.2, "idio": 0.9}, (-4.0, 3.0, 2.0), tuple(1 + k / 20 for k in range(toxicity.KINDS)))
    for r in toxicity.score(docs, g).join(docs, "doc_id").collect():
        found = [w * g.counts[k] for k, w in _plain_clauses(g, r["text"] or "")]
        b, m, s = g.weights
        want = b + (m * max(found) + s * log1p(sum(found)) if found else 0.0)
        assert abs(r["score"] - 1 / (1 + exp(-max(-30, min(30, want))))) < 1e-9 and r["predicted"] == (r["score"] >= 0.5)


def test_counts_of_kinds_are_learned():
    y = np.array([1] * 400 + [0] * 4000, dtype=float)
    total = np.zeros((4400, toxicity.KINDS))
    total[:300, 0] = 1
    total[400:420, 0] = 1
    total[300:380, 1] = 1
    total[420:1220, 1] = 1  # denied insults are as frequent among clean rows
    counts = toxicity.counted(total, y)
    assert counts[0] == 1 and counts[1] < 0.3 and counts[2] == toxicity.given(2)


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.judge(docs, labels).join(labels, "doc_id").where("held_out").groupBy("toxic", "predicted").count().collect()
    n = {(r["toxic"], r["predicted"]): r["count"] for r in rows}
    assert n.get((1, 1), 0) >= 0.85 * (n.get((1, 1), 0) + n.get((1, 0), 0))
    assert n.get((0, 1), 0) <= 0.01 * n[0, 0]


@pytest.mark.parametrize(("toxic", "clean", "t", "c"), [(100, 4900, 25, 37), (1000, 3000, 10, 0)])
def test_toxicity_learns_rare_insults(spark, toxic, clean, t, c):
    """A word of few toxic rows, or of more clean rows than toxic ones where toxic rows are rare."""
    r = random.Random(3)
    filler = lambda: " ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(6))
    rows = [(i, filler() + (" zzyzx" if i < t or toxic <= i < toxic + c else ""), int(i < toxic)) for i in range(toxic + clean)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    assert "zzyz" in {w[:4] for w in toxicity.learn(df.select("doc_id", "text"), df.select("doc_id", "toxic")).lexicon}


def test_toxicity_edges(spark, docs):
    empty = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    labels = spark.createDataFrame([(1, 1, None), (None, 0, 1), (3, 1, 0), (3, 1, 0)], "doc_id bigint, quality int, toxic int")
    for given in (empty, labels):
        rows = toxicity.judge(docs, given).collect()
        assert len(rows) == docs.count() and all(0 <= r["score"] < 0.5 and r["predicted"] == 0 for r in rows)
    assert toxicity.judge(docs.limit(0), labels).count() == 0
    kept = toxicity.reject(docs, toxicity.Grammar({"quick$": 1.0}, (-4.0, 8.0, 2.0)))
    assert kept.columns == docs.columns and kept.count() == docs.count() - 2


# --- 10 personal data ------------------------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _plain(text):
    import re

    def ok(kind, s):
        d = re.sub("[^0-9]", "", s)
        if kind == "ip":
            return all(int(p) <= 255 for p in s.split("."))
        if kind == "card":
            total = sum((2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) if i % 2 else int(c) for i, c in enumerate(reversed(d)))
            return 13 <= len(d) <= 19 and total % 10 == 0
        return kind == "email" or 9 <= len(d) <= 15

    return {k: [m.span() for m in re.finditer(p, text) if ok(k, m.group())] for k, p in PATTERNS.items()}


def test_base_equals_patterns():
    r = random.Random(0)
    for _ in range(20_000):
        t = "".join(r.choice("aB9.%+-@ 0123()\n-..@@é") for _ in range(r.randint(0, 60)))
        assert pii.base(t) == _plain(t)
    for t in ("1" * 3000 + ".2.3.4", "a" * 200_000, "@" * 2000, "+1" * 2000):
        pii.base(t)
    t = "1." + "0" * 5000 + ".2.3 0." + "0" * 5000 + "7.0.0"
    assert pii.base(t)["ip"] == [(0, 5006), (5007, len(t))] and pii.base("1." + "9" * 5000 + ".2.3")["ip"] == []


def test_decoding_equals_brute_force():
    from itertools import product

    r = np.random.default_rng(2)
    t = Tagger(3, width=2, hidden=2)
    allowed = np.array([[1, 1, 0], [1, 1, 1], [1, 1, 1]], bool)
    for _ in range(20):
        t.p["move"], t.p["start"] = r.normal(size=(3, 3)), r.normal(size=3)
        e = r.normal(size=(6, 3))
        value = lambda y: e[0, y[0]] + t.p["start"][y[0]] + sum(e[i, y[i]] + t.p["move"][y[i - 1], y[i]] for i in range(1, 6)) if all(allowed[a, b] for a, b in zip(y, y[1:], strict=False)) else -np.inf  # noqa: E731, B023
        assert tuple(t.decode(e, allowed)) == max(product(range(3), repeat=6), key=value)


def test_tagger_gradient():
    t = Tagger(3, width=3, hidden=4, seed=1)
    x = np.array([[65, 66, 67, 48], [49, 64, 65, 131]], dtype=np.int16)
    y = np.array([[0, 1, 2, 0], [1, 2, 0, 0]])

    def loss():
        e = t.emissions(x).astype(float)
        out = 0.0
        for n in range(len(x)):
            a, gold = e[n, 0] + t.p["start"], e[n, 0, y[n, 0]] + t.p["start"][y[n, 0]]
            for s in range(1, x.shape[1]):
                m = a[:, None] + t.p["move"]
                a = e[n, s] + np.log(np.exp(m - m.max(0)).sum(0)) + m.max(0)
                gold += e[n, s, y[n, s]] + t.p["move"][y[n, s - 1], y[n, s]]
            out += np.log(np.exp(a - a.max()).sum()) + a.max() - gold
        return out / len(x)

    g = t._gradient(x, y)
    r = np.random.default_rng(0)
    for k in t.p:
        for _ in range(4):
            i = tuple(r.integers(0, s) for s in t.p[k].shape) if k != "embed" else (int(x[0, r.integers(0, 4)]), int(r.integers(0, 3)))
            old = t.p[k][i]
            t.p[k] = t.p[k].astype(np.float64)
            t.p[k][i] = old + 1e-3
            up = loss()
            t.p[k][i] = old - 1e-3
            down = loss()
            t.p[k][i] = old
            assert abs((up - down) / 2e-3 - g[k][i]) < 2e-3, k


def test_windows_cover_and_stitch():
    for n in (1, 47, 96, 97, 500):
        x = np.arange(n, dtype=np.int16) % 100
        w, starts = pii.windows(x)
        e = np.repeat(w[..., None], 2, axis=2).astype(float)
        assert pii.stitch(e, starts, n)[:, 0].tolist() == x.tolist()


def test_find_and_redact(spark, docs):
    finder = pii.train(docs.select("doc_id", "text").na.fill("", ["text"]), steps=120, count=600)
    rows = pii.find(docs, finder).collect()
    by = Counter()
    for r in docs.collect():
        b = _plain(r["text"] or "")
        listed = ",".join(f"{k}:{a}:{e}" for k in pii.KINDS for a, e in b[k])
        by[r["doc_id"], *(len(b[k]) for k in pii.KINDS), hashlib.sha256(listed.encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in rows) == by
    assert next(r for r in rows if r["doc_id"] == 6)["spans"].startswith("ip:26:40")
    out = {r["doc_id"]: r["text"] for r in pii.redact(docs, finder).collect()}
    assert out[2] is None and out[3] == "" and "@" not in out[1] and "[EMAIL]" in out[1] and "[PHONE]" in out[6] and "[IP]" in out[6]
    assert pii.redact(docs, finder).columns == docs.columns
    assert pii.find(docs.limit(0), finder).count() == 0


def test_model_adds_written_out_forms():
    x, y = pii.examples([], 2000)
    tagger = Tagger(1 + 2 * len(pii.LEARNED))
    tagger.train(x, y, 320)
    finder = pii.Finder(tagger)
    texts = ["please call (274) 555-9629 for it", "john.lee [at] mail.com is the name", "this line has 12 words and nothing else in 2024", 'words token = "254a3ed195c502ef96b5857aa82e5fbcfb6b6856" words', "Apache License, Version 2.0. and 2852466340876421 there"]
    found = finder.added(texts, [pii.base(t) for t in texts])
    assert texts[0][slice(*found[0]["phone"][0])] == "(274) 555-9629"
    assert texts[1][slice(*found[1]["email"][0])] == "john.lee [at] mail.com"
    assert texts[3][slice(*found[3]["secret"][0])] == "254a3ed195c502ef96b5857aa82e5fbcfb6b6856"
    assert not any(found[2].values()) and not any(found[4].values())
    hx, hy = pii.examples([], 200, seed=99)
    got = np.stack([tagger.decode(e, pii.ALLOWED) for e in tagger.emissions(hx)])
    assert (got == hy).mean() > 0.95


def test_secrets_of_documents(spark):
    """The documents hold secrets, which no pattern knows; their writing is known here alone."""
    import re

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want, got = set(), set()
    for r in pii.find(docs).join(docs, "doc_id").collect():
        want |= {(r["doc_id"], *m.span(1)) for m in re.finditer(r'token = "([0-9a-f]{40})"', r["text"] or "")}
        got |= {(r["doc_id"], *map(int, s.split(":")[1:])) for s in r["secrets"].split(",") if s}
        assert r["n_spans"] == r["n_added"] + r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"]
    assert len(want) > 5 and len(want & got) >= 0.9 * len(want) and len(want & got) >= 0.9 * len(got)
