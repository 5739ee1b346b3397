"""The pipeline's stages against plain versions, and on tables with odd rows."""

import random
import re

import pytest

import corpus_pipeline
from quarry.llm import pii, toxicity

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def _stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def _write(spark, folder, rows, labels, extra=False):
    df = spark.createDataFrame(rows, COLUMNS)
    if extra:
        df = df.selectExpr("*", "1 AS component_id", "2 AS `set`", "'x' AS _dropped", "3 AS piece", "4 AS _rank", "5 AS score", "6 AS hashes")
    df.write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    return df


def _packed(rows):
    """Sequences are filled from 0 without gaps, up to 2048 tokens; pieces of a document follow each other."""
    by, documents = {}, {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        documents.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"]))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    return documents


def test_stages_are_as_dealt():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "personal_data", "packing"]


def test_near_duplicates_equal_brute_force(spark):
    """All documents of a small table, with edited copies, by the sets of their five-word runs."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    r = random.Random(1)
    rows = [(x["doc_id"], x["text"]) for x in docs.select("doc_id", "text").collect()]
    more = []
    for k, (_, text) in enumerate(rows[:60]):
        words = (text or "").split()
        if len(words) > 30:
            for at in r.sample(range(len(words)), max(1, len(words) // r.choice([20, 40, 60, 200]))):
                words[at] = f"new{at}"
            more.append((10_000 + k, " ".join(words)))
    every = rows + more
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set() for i, t in every for w in [(t or "").encode().lower().split()]}
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    close = 0
    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = sets[a], sets[b]
            both = len(x & y)
            if (not x and not y) or (x and y and both >= 0.8 * (len(x) + len(y) - both)):
                close += x != y
                lo, hi = sorted((find(a), find(b)))
                top[hi] = lo
    assert close > 10
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in every], COLUMNS)
    kept = _stage("near_duplicates")(spark, df, "")
    assert kept.columns == df.columns
    assert sorted(x["doc_id"] for x in kept.collect()) == [i for i in ids if find(i) == i]


def test_toxicity_stage_drops_what_the_grammar_rejects(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = _stage("toxicity")(spark, docs, sf)
    grammar = toxicity.learn(docs, spark.read.parquet(f"{sf}/labels.parquet").where(~toxicity.held_out()))
    assert kept.columns == docs.columns
    assert sorted(x["doc_id"] for x in kept.select("doc_id").collect()) == sorted(x["doc_id"] for x in docs.collect() if grammar.score(x["text"] or "") < 0.5)


def test_personal_data_stage_masks_every_pattern(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    out = _stage("personal_data")(spark, docs, "")
    assert out.columns == docs.columns
    for r in out.collect():
        text = before[r["doc_id"]] or ""
        spans = [text[a:b] for v in pii.base(text).values() for a, b in v]
        assert not any(s in (r["text"] or "") for s in spans if len(s) > 8)
        assert (r["text"] == text) or re.search(r"\[(EMAIL|IP|CARD|PHONE|SECRET)\]", r["text"])
        assert r["n_chars"] == len(r["text"] or "")


@pytest.mark.parametrize("extra", [False, True])
def test_pipeline_with_odd_rows(spark, tmp_path, extra):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
    r = random.Random(4)
    text = " ".join(r.choice(words) + str(r.randrange(99)) for _ in range(200))
    rows = [
        (1, text, "en", "a", 1), (1, text, "en", "a", 1), (2, text + " end", None, None, None), (3, None, None, None, None), (4, "", "en", "a", 0), (None, "no id but a text", "en", "a", 9),
        (5, "one two three " * 4000, "en", "a", 9), (6, "call +1 (274) 555-9629 now or write to ann@mail.example.com please", "en", "b", 9), (7, "1." + "0" * 5000 + ".2.3", "en", "b", 9),
    ]
    _write(spark, tmp_path, rows, [(1, 1, 0), (6, 1, 1), (None, 0, 1), (9, None, None)], extra)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    documents = _packed(got)
    assert set(documents) == {1, 3, 5, 6, 7, None}
    assert len(documents[5]) > 1 and sorted(p for p, *_ in documents[5]) == list(range(len(documents[5])))


def test_pipeline_of_nothing(spark, tmp_path):
    _write(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], COLUMNS), str(tmp_path)).count() == 0
