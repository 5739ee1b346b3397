"""The registered queries of this package: thin views over its operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.tables import table, tokenizer_path


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), words=4, max_bits=4)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.bpe import transcode

    docs = table(spark, sf_dir, "documents")
    return transcode(docs, tokenizer_path("word_bpe_49k.json"), ("n_tokens", "ids_sha256", "decoded_sha256"))


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.urls import Rule, judge

    rules = [Rule("net/", "block"), Rule("example.net/en/", "allow"), Rule("example.com/de/", "block"), Rule("org/fr/", "allow")]
    return judge(table(spark, sf_dir, "pages"), rules).withColumn("purity", F.round("purity", 9))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quarry.llm.packing import pack_documents

    docs = table(spark, sf_dir, "documents")
    return pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), public_tokenizers.PATTERN, outputs=("ids_crc32",))


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.lm import score

    return score(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.toxicity import judge

    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"), 24)


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.embeddings import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"), 0.9)


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.topk import search

    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors.where("vec_id % 100 = 0"), vectors, 10, "vec_id", "embedding", scale=1024.0)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.pii import find

    return find(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_bpe": op2_bpe,
    "op3_embeddings": op3_embeddings,
    "op4_urls": op4_urls,
    "op5_packing": op5_packing,
    "op6_topk": op6_topk,
    "op7_lm": op7_lm,
    "op8_toxicity": op8_toxicity,
    "op9_sharding": op9_sharding,
    "op10_pii": op10_pii,
}


def _urls_sql(depth: int = 6) -> str:
    """The tree of op4 as SQL, for paths of up to `depth` segments: one block of table expressions a level."""

    def against(hits: str, misses: str) -> str:
        a, b = f"c.{hits}::DOUBLE", f"c.{misses}::DOUBLE"
        c, d = f"(t.{hits} - {a})", f"(t.{misses} - {b})"
        cross, margins = f"({a} * {d} - {b} * {c})", f"(({a} + {b}) * ({c} + {d}) * ({a} + {c}) * ({b} + {d}))"
        return f"CASE WHEN {margins} > 0 AND {cross} * {cross} * ({a} + {b} + {c} + {d}) >= 6.63 * {margins} THEN CASE WHEN {cross} > 0 THEN '+' ELSE '-' END ELSE '=' END"

    rule = "CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/' WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/' WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/' WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END"
    found = "'(?s)^.*?://([^/?#]*)([^?#]*)'"
    parts = [
        f"u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), {found}, 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), {found}, 2) AS path FROM pages)",
        f"r AS (SELECT *, {rule} AS rule FROM u)",
        "d AS (SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS decided FROM r)",
        "n0 AS (SELECT page_id, host, path, rule, decided, CASE WHEN decided = 'block' THEN 1 ELSE 0 END AS bad, CASE WHEN decided = 'allow' THEN 1 ELSE 0 END AS good, string_split(regexp_replace(path, '^/', ''), '/') AS segments, '' AS node FROM d)",
    ]
    for k in range(depth):
        parts += [
            f"s{k} AS (SELECT *, segments[{k + 1}] AS seg FROM n{k})",
            f"c{k} AS (SELECT host, node, seg, sum(bad) AS bad, sum(good) AS good, sum(CASE WHEN len(segments) = {k + 1} THEN 1 ELSE 0 END) AS ends, sum(CASE WHEN len(segments) > {k + 1} THEN 1 ELSE 0 END) AS goes_on FROM s{k} WHERE seg IS NOT NULL GROUP BY ALL HAVING count(*) >= 8)",
            f"t{k} AS (SELECT host, node, sum(bad) AS bad, sum(good) AS good, sum(ends) AS ends, sum(goes_on) AS goes_on FROM c{k} GROUP BY ALL)",
            f"k{k} AS (SELECT c.host, c.node, c.seg, '~' || {against('bad', 'good')} || {against('ends', 'goes_on')} AS branch FROM c{k} c JOIN t{k} t ON c.host = t.host AND c.node = t.node)",
            f"n{k + 1} AS (SELECT s.* EXCLUDE (node, seg), s.node || CASE WHEN s.seg IS NULL THEN '' ELSE '/' || coalesce(branch, '*') END AS node FROM s{k} s LEFT JOIN k{k} b ON s.host = b.host AND s.node = b.node AND s.seg = b.seg)",
        ]
    smoothed = lambda towards: f"(sum(bad) + 5.0 * {towards}) / (sum(bad) + sum(good) + 5.0)"
    parts.append(f"leaf AS (SELECT host, node, CASE WHEN sum(bad) + sum(good) > 0 AND {smoothed('prior')} >= 0.8 AND {smoothed('least(prior, 0.5)')} >= 0.8 THEN {smoothed('prior')} END AS purity FROM n{depth}, (SELECT coalesce(sum(bad) / nullif(sum(bad) + sum(good), 0), 0.0) AS prior FROM n0) GROUP BY host, node, prior)")
    return "WITH " + ", ".join(parts) + f" SELECT page_id, n.host, path, rule, coalesce(decided, CASE WHEN purity IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, n.node AS template, round(purity, 9) AS purity FROM n{depth} n JOIN leaf l ON n.host = l.host AND n.node = l.node"


ORACLE_SQL = {
    "op4_urls": _urls_sql(),
    "op3_embeddings": """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), ok AS (
  SELECT vec_id, e FROM v
  WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), reach(vec_id, other) AS (
  SELECT a, b FROM link UNION SELECT r.vec_id, l.b FROM reach r JOIN link l ON r.other = l.a
), least AS (SELECT vec_id, min(other) AS m FROM reach GROUP BY 1),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM link GROUP BY 1)
SELECT v.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links,
  least(v.vec_id, coalesce(m, v.vec_id)) AS component_id, v.vec_id = least(v.vec_id, coalesce(m, v.vec_id)) AS kept
FROM v LEFT JOIN n USING (vec_id) LEFT JOIN least USING (vec_id)""",
    "op6_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
}
