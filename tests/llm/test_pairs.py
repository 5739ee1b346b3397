import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import components, copies, embeddings, simhash, topk, urls


def _reach(n, pairs):
    label = list(range(n))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        label[b] = a
    return [top(i) for i in range(n)]


# --- components ------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    pairs = [(r.randrange(80), r.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 230)]
    df = spark.createDataFrame([*pairs, (5, 5), (None, 3)], "a long, b long")
    got = {x["node"]: x["component"] for x in components.components(df).collect()}
    want = _reach(230, pairs)
    linked = {x for p in pairs if p[0] != p[1] for x in p}
    assert got == {i: want[i] for i in linked}
    assert components.components(df.limit(0)).count() == 0


def test_forest():
    r = random.Random(3)
    for _ in range(50):
        pairs = [(r.randrange(40), r.randrange(40)) for _ in range(r.randrange(90))]
        forest, kept = components.Forest(30), []
        forest.grow(10)
        for part in (pairs[:20], pairs[20:]):
            i, j = (np.array([p[k] for p in part], dtype=np.int64) for k in (0, 1))
            kept += [part[k] for k in forest.add(i, j).tolist()]
        assert _reach(40, kept) == _reach(40, pairs)
        assert len(kept) == 40 - len(set(_reach(40, pairs)))


# --- 1 SimHash -------------------------------------------------------------------------------


def test_fingerprint_by_hand():
    import xxhash

    for text in ("", " \n", "One two", "a b c d e A b", "x " * 50, "É é\xa0z q"):
        w = text.encode().lower().split()
        parts = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
        want = sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))
        assert simhash.fingerprint(text, 4) & (2**64 - 1) == want


@pytest.mark.parametrize(("bits", "blocks"), [(4, 7), (6, 9), (4, 5)])
def test_masks_are_pigeonholes(bits, blocks):
    r = random.Random(0)
    ms = simhash.masks(bits, blocks)
    for _ in range(300):
        a = r.getrandbits(64)
        b = a
        for k in r.sample(range(64), bits):
            b ^= 1 << k
        assert any(a & m == b & m for m in (x & (2**64 - 1) for x in ms))


@pytest.mark.parametrize("bucket", [512, 3])
def test_links_connect_exactly(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    r = random.Random(4)
    base = [r.getrandbits(64) for _ in range(30)]
    fps = set(base)
    for b in base[:8]:
        for _ in range(30):
            x = b
            for k in r.sample(range(64), r.randrange(1, 6)):
                x ^= 1 << k
            fps.add(x)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    got = simhash.links(df).collect()
    at = {s: i for i, s in enumerate(signed)}
    near = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    assert _reach(len(fps), [(at[x["a"]], at[x["b"]]) for x in got]) == _reach(len(fps), near)


def test_filed_fingerprints_are_not_broadcast(spark, tmp_path):
    """A stored table is small as a file, and each row of it is filed 35 times."""
    spark.range(3000).select(F.xxhash64("id").alias("fp")).write.parquet(str(tmp_path / "fps"))
    found = simhash.links(spark.read.parquet(str(tmp_path / "fps")))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_many_links_are_not_broadcast(spark, tmp_path):
    """Stored links are a tenth as large as a file as they are in the driver."""
    spark.range(1, 300_000).select(F.col("id").alias("u"), (F.col("id") % 100).alias("v")).where("u > v").write.parquet(str(tmp_path / "links"))
    links = spark.read.parquet(str(tmp_path / "links"))
    rows = links.count()
    for found in (components._large_star(links, rows), components._small_star(links, rows)):
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_simhash_documents(spark, docs):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    by = {}
    for x in rows:
        by.setdefault(x["doc_id"], []).append((x["fingerprint"], x["component_id"]))
    assert by[2] == by[3] == by[4] == [("0" * 16, 2)] and len(by[1]) == 2 and by[1][0] == by[1][1]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_keep_one(spark, docs):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
    r = random.Random(2)
    text = [r.choice(words) + str(r.randrange(50)) for _ in range(400)]
    near = list(text)
    near[200] = "changed"
    other = [r.choice(words) + str(r.randrange(50, 99)) for _ in range(400)]
    rows = [(10, " ".join(text)), (11, " ".join(near)), (12, " ".join(text)), (13, " ".join(other)), (13, " ".join(other)), (None, "x y z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = simhash.keep_one(df)
    assert sorted((x["doc_id"] or 0) for x in out.collect()) == [0, 10, 13]
    assert out.columns == df.columns
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((x["doc_id"] or 0) for x in kept.collect()) == [0, 1, 2, 5, 6, 7]
    assert simhash.keep_one(docs.limit(0)).count() == 0


@pytest.mark.parametrize("bucket", [512, 3])
def test_keep_one_equals_brute_force(spark, monkeypatch, bucket):
    """Texts with single words or one passage replaced, alike by 0.5 to 1, about half of them below 0.8."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    monkeypatch.setattr(copies, "TILE", bucket * 8)
    monkeypatch.setattr(copies, "SAMPLED", 3)
    if bucket == 3:  # no sketch fits
        monkeypatch.setattr(copies, "sketch", lambda hashes: None)
    r = random.Random(7)
    texts = []
    for _ in range(40):
        base = [f"w{r.randrange(3000)}" for _ in range(r.randrange(20, 150))]
        texts.append(base)
        for kind in range(6):
            t, share = list(base), r.uniform(0.005, 0.06)
            if kind % 2:
                size = max(1, int(4 * share * len(t)))
                at = r.randrange(len(t) - size)
                t[at : at + size] = [f"v{r.randrange(3000)}" for _ in range(size)]
            else:
                for at in r.sample(range(len(t)), max(1, int(share * len(t)))):
                    t[at] = f"v{r.randrange(3000)}"
            texts.append(t)
    notice = [f"n{i}" for i in range(30)]  # a passage that many different texts share
    texts += [[f"u{r.randrange(3000)}" for _ in range(25)] + notice for _ in range(30)]
    sets = [{tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} for t in texts]
    alike = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in range(len(texts)) for j in range(i)}
    assert sum(0.8 <= x < 0.9 for x in alike.values()) > 20 and sum(0.6 <= x < 0.8 for x in alike.values()) > 20
    want = _reach(len(texts), [p for p, x in alike.items() if x >= 0.8])
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(x["doc_id"] for x in simhash.keep_one(df).collect()) == sorted(set(want))


def test_sketches_bound_what_sets_share():
    r = np.random.default_rng(5)
    for n in (3, 40, 900):
        pool = r.integers(0, 2**63, 2 * n).astype(np.uint64)
        for _ in range(20):
            a, b = (np.unique(r.choice(pool, n)) for _ in range(2))
            x, y = (np.frombuffer(copies.sketch(v), np.uint8).astype(int) for v in (a, b))
            assert len(np.intersect1d(a, b)) <= np.minimum(x, y).sum()
    assert copies.sketch(np.arange(300, dtype=np.uint64)) is None


# --- 3 embeddings ----------------------------------------------------------------------------


def _vectors(seed=0):
    r = np.random.default_rng(seed)
    base = r.normal(size=(40, 12))
    return np.vstack([base, *[base[:15] + r.normal(size=(15, 12)) * s for s in (0.1, 0.3, 0.4)], np.repeat(base[:1], 12, 0), base[3:4] * 7])


@pytest.mark.parametrize(("block", "held"), [(4096, 1 << 26), (9, 1000)])
def test_embeddings(spark, monkeypatch, block, held):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    monkeypatch.setattr(embeddings, "HELD", held)
    v = _vectors()
    bad = [(900, None), (901, [0.0] * 12), (902, [float("nan")] * 12), (903, [1.0] * 11 + [float("inf")]), (904, [None] * 12), (905, [])]
    far = 2**60
    rows = [(far + i, [float(x) for x in row]) for i, row in enumerate(v)] + bad + [(None, [float(x) for x in v[0]]), (None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS rep", "2 AS links", "3 AS copies")
    every = embeddings.near_duplicates(df, 0.9).collect()
    got = {x["vec_id"]: x for x in every}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    want = _reach(len(v), list(zip(*np.nonzero(link), strict=True)))
    assert link.sum() > 100 and len(every) == len(rows)
    for i in range(len(v)):
        x = got[far + i]
        assert (x["n_links"], x["component_id"], x["kept"]) == (link[i].sum(), far + want[i], want[i] == i)
    for i, _ in bad:
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert [(x["n_links"], x["component_id"], x["kept"]) for x in every if x["vec_id"] is None] == [(0, None, False)] * 2
    assert embeddings.near_duplicates(df.limit(0)).count() == 0
    assert embeddings.near_duplicates(df.where("vec_id = 900")).collect()[0]["component_id"] == 900


def test_embeddings_at_the_threshold(spark):
    """Pairs at a cosine of 0.9 or a rounding below, which no code can tell, and vectors of other lengths."""
    at = [(0, [1.0, 0.0]), (1, [0.9, float(np.sqrt(1 - 0.81))]), (2, [0.9 - 1e-9, float(np.sqrt(1 - (0.9 - 1e-9) ** 2))]), (3, [0.9 + 1e-9, -float(np.sqrt(1 - (0.9 + 1e-9) ** 2))]), (4, [1.0, 0.0, 0.0])]
    got = {x["vec_id"]: x for x in embeddings.near_duplicates(spark.createDataFrame(at, "vec_id long, embedding array<double>"), 0.9).collect()}
    near = {(i, j) for i in range(4) for j in range(4) if i != j and embeddings.cosine(np.array([at[i][1]]), np.array([at[j][1]]))[0] >= 0.9}
    assert (0, 3) in near and (0, 2) not in near
    assert [got[i]["n_links"] for i in range(5)] == [sum(a == i for a, _ in near) for i in range(4)] + [0]


def test_quantisation_bounds_hold():
    r = np.random.default_rng(3)
    for d in (64, 2500):
        u, v = embeddings.unit(r.normal(size=(100, d))), embeddings.unit(r.normal(size=(100, d)) * 1e30)
        a, b = (embeddings.Codes.of(np.arange(100), np.ones(100, np.int64), x) for x in (u, v))
        whole = a.first.astype(np.int64) @ b.first.astype(np.int64).T
        assert (embeddings.product(a.first, b.first) == whole).all()
        for product, e in ((whole * a.numbers[:, 0, None] * b.numbers[:, 0], 1), (a.fine(np.arange(100)) @ b.fine(np.arange(100)).T, 3)):
            bound = lambda x: x + 1.5 * x**2
            assert (np.abs(u @ v.T - product) <= bound(a.numbers[:, e, None]) + bound(b.numbers[:, e]) + 1e-12).all()
        assert a.numbers[:, 3].max() < a.numbers[:, 1].max() / 50


# --- 6 top-k ---------------------------------------------------------------------------------


@pytest.mark.parametrize("round_", [1 << 20, 200])
def test_topk(spark, monkeypatch, round_):
    monkeypatch.setattr(topk, "SHARD", 7)
    monkeypatch.setattr(topk, "QUERIES", 3)
    monkeypatch.setattr(topk, "ROUND", round_)
    r = np.random.default_rng(1)
    v = np.vstack([r.normal(size=(30, 6)), np.repeat(r.normal(size=(1, 6)), 25, 0)])
    far = 2**60
    rows = [(far + i, [float(x) for x in row]) for i, row in enumerate(v)] + [(500, None), (600, [float("nan")] * 6), (None, [1.0] * 6), (700, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS tile", "2 AS salt")
    asked = df.where(f"(vec_id - {far}) % 5 = 0 or vec_id is null")
    got = topk.search(asked.union(asked), df, 10, "vec_id", "embedding", 1024.0).collect()
    q = np.floor(1024 * v).astype(int)
    want = []
    for i in range(0, len(v), 5):
        best = sorted(((-int(q[i] @ q[j]), j) for j in range(len(v)) if j != i))[:10]
        want += [(far + i, k + 1, far + j, -s) for k, (s, j) in enumerate(best)]
    assert sorted((x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in got) == want
    few = df.where(f"vec_id between {far} and {far + 3}")
    assert topk.search(few.where(f"vec_id = {far}"), few, 10, "vec_id", "embedding", 1024.0).count() == 3
    assert topk.search(df.limit(0), df, 10, "vec_id", "embedding", 1024.0).count() == 0
    assert topk.search(few.where(f"vec_id = {far}"), df.limit(0), 10, "vec_id", "embedding", 1024.0).count() == 0


def test_topk_huge_components(spark):
    q, c = np.array([[2.0**40, 1.0]]), np.array([[2.0**20, 5.0], [2.0**20, 3.0]])
    assert topk._scores(q, c).tolist() == [[2**60 + 5, 2**60 + 3]]
    ids = topk.tile_top(np.array([9]), q, np.array([2, 1]), c, 1)
    assert (ids[1].tolist(), ids[2].tolist()) == ([2], [2**60 + 5])
    df = spark.createDataFrame([(0, [1e300, 1.0]), (1, [1e300, 2.0]), (2, [-1e300, 1.0]), (3, [0.0, 5.0])], "vec_id long, embedding array<double>")
    got = topk.search(df.where("vec_id = 0"), df, 10, "vec_id", "embedding", 1024.0).orderBy("rank").collect()
    assert [(x["vec_id"], x["score"]) for x in got] == [(1, 2**63 - 1), (3, 1024 * 5120), (2, 1 - 2**63)]


# --- 4 urls ----------------------------------------------------------------------------------

RULES = [urls.Rule("net/", "block"), urls.Rule("example.net/en/", "allow"), urls.Rule("example.com/de/", "block"), urls.Rule("org/fr/", "allow")]


def _parts(u):
    import re

    if u is None or "://" not in u:
        return "", ""
    rest = u.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def test_urls(spark):
    r = random.Random(0)
    given = [None, "", "no scheme", "http://", "http://NET", "https://net/x", "https://a.NET/x", "http://xnet/x", "ftp://Example.net/en/1?q=/de/", "http://b.example.net/en", "http://u@example.com:80/de/1", "http://example.com/de/", "x://y://z.org/fr/1#a", "http://É.ORG/fr/ü", "http://a.org/fr\n/x", "http://a.org/fr/\nx"]
    given += [f"http://{r.choice(['a', 'b.a', 'c'])}.example.{r.choice(['com', 'net', 'org'])}/{r.choice(['en', 'fr', 'de'])}/{r.randrange(10**6)}" for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(given)), "page_id long, url string").selectExpr("*", "1 AS node", "'x' AS rule")
    got = {x["page_id"]: x for x in urls.judge(df, RULES).collect()}
    assert len(got) == len(given)
    for i, u in enumerate(given):
        host, path = _parts(u)
        fits = [q for q in RULES if (host == q.host or host.endswith("." + q.host)) and path.startswith(q.path)]
        rule = max(fits, key=lambda q: len(q.text)) if fits else None
        x = got[i]
        assert (x["host"], x["path"], x["rule"]) == (host, path, rule.text if rule else None), u
        assert x["verdict"] == rule.verdict if rule else x["verdict"] in ("allow", "block")
    assert urls.judge(df.limit(0), RULES).count() == 0
    assert urls.keep_allowed(df, RULES).count() == sum(x["verdict"] == "allow" for x in got.values())


def test_url_templates_reject_by_purity(spark):
    """A host whose labelled pages under one branch are all blocked: the rest of the branch goes too."""
    rules = [urls.Rule("shop.example/win/a", "block"), urls.Rule("shop.example/news/", "allow")]
    rows = [f"http://shop.example/win/a{i}" for i in range(60)] + [f"http://shop.example/win/b{i}" for i in range(3)] + [f"http://shop.example/news/{i}" for i in range(60)] + [f"http://other.example/win/{i}" for i in range(30)]
    df = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = {x["page_id"]: x["verdict"] for x in urls.judge(df, rules).collect()}
    for i, u in enumerate(rows):
        assert got[i] == ("block" if u.startswith("http://shop.example/win/") else "allow")


def test_url_templates_without_labels_stay(spark):
    """Nine tenths of the ruled pages are blocked; pages of hosts without a label stay all the same."""
    rules = [urls.Rule("bad.example/", "block"), urls.Rule("good.example/", "allow")]
    rows = [f"http://bad.example/x/{i}" for i in range(90)] + [f"http://good.example/x/{i}" for i in range(10)] + [f"http://other.example/x/{i}" for i in range(30)]
    df = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = {x["page_id"]: x["verdict"] for x in urls.judge(df, rules).collect()}
    assert all(got[i] == ("block" if "bad." in u else "allow") for i, u in enumerate(rows))


def test_url_templates_of_deep_and_rare_segments(spark):
    """A sixth segment tells bad pages from good ones, and so does a first one with 1 % of its host's."""
    rules = [urls.Rule("a.example/1/2/3/4/5/win/x", "block"), urls.Rule("a.example/1/2/3/4/5/news/", "allow"), urls.Rule("b.example/win/x", "block"), urls.Rule("b.example/news/", "allow")]
    rows = [f"http://a.example/1/2/3/4/5/{k}{i}" for k, n in (("win/x", 40), ("win/y", 4), ("news/", 60)) for i in range(n)]
    rows += [f"http://b.example/{k}{i}" for k, n in (("win/x", 20), ("win/y", 2), ("news/", 2000)) for i in range(n)]
    rows += [f"http://c.example/{'s/' * 300}{i}" for i in range(3)]
    df = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = {x["page_id"]: x["verdict"] for x in urls.judge(df, rules).collect()}
    assert len(got) == len(rows) and all(got[i] == ("block" if "/win/" in u else "allow") for i, u in enumerate(rows))


def test_url_branches_alike_are_merged(spark):
    """Sections of one shape share their labels, those whose labels or shapes differ don't."""
    rules = [urls.Rule("a.example/de/", "block"), urls.Rule("b.example/de/", "block"), urls.Rule("b.example/fr/", "allow"), urls.Rule("c.example/de/", "block")]
    rows = [f"http://{h}.example/{s}/{i}" for h in "abc" for s in ("de", "fr", "en") for i in range(40)]
    rows += [f"http://c.example/about{i // 20}" for i in range(200)]
    df = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = {u: x for x in urls.judge(df, rules).collect() for u in [rows[x["page_id"]]]}
    assert {got[f"http://a.example/{s}/{i}"]["verdict"] for s in ("fr", "en") for i in range(40)} == {"block"}
    assert {got[f"http://b.example/en/{i}"]["verdict"] for i in range(40)} == {"allow"}
    assert {got[f"http://c.example/en/{i}"]["verdict"] for i in range(40)} == {"block"}
    assert {got[f"http://c.example/about{i}"]["verdict"] for i in range(10)} == {"allow"}
