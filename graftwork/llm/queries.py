"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import clusters, language, licenses, mixing, nearjoin, negatives, packing, quality, substring, tokens, topk, toxicity, warc

TOKENIZER = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Of a sequence: fewer than short documents would come to, so that the limit binds.
MOST_SEGMENTS = 8


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), max_segments=MOST_SEGMENTS, with_ids=False).drop("ids")


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


#: Documents whose ids these numbers divide are named like license files; the second kind lies a folder higher.
NAMED, HIGHER = 4, 12


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents lie in a tree of folders: source, then thousands of ids."""
    docs = table(spark, sf_dir, "documents")
    folder = F.when(F.col("doc_id") % HIGHER != 0, F.floor(F.col("doc_id") / 1000).cast("string"))
    name = F.concat(F.when(F.col("doc_id") % NAMED == 0, F.lit("LICENSE-")).otherwise(F.lit("")), F.col("doc_id").cast("string"), F.lit(".txt"))
    return licenses.scan(docs, F.concat_ws("/", F.coalesce("source", F.lit("-")), folder, name))


#: The audit's second replica is made here: records of these remainders by 97 are damaged or lost in it.
DAMAGED, LOST = 5, 6


def op6_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records, against a replica in which some are damaged or lost."""
    pages = table(spark, sf_dir, "pages")
    body = F.when(F.col("page_id") % 97 == DAMAGED, F.concat(F.lit("?"), F.coalesce("html", F.lit("")))).otherwise(F.col("html"))
    first = warc.leaves(pages, F.col("page_id"), warc.record(F.col("url"), F.col("html")))
    second = warc.leaves(pages.where(F.coalesce(F.col("page_id") % 97 != LOST, F.lit(True))), F.col("page_id"), warc.record(F.col("url"), body))
    return warc.audit(first, second).withColumnRenamed("number", "page_id")


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op8_count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearjoin.near_classes(table(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = language.train(docs.where(~held_out).select("text", "lang"))
    return language.predict(docs, model, keep=(held_out.alias("held_out"),))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(vectors, F.col("vec_id") % 100 == 0, label)


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = lambda c: F.coalesce(F.crc32(F.col(c).cast("string")) % 3 == 1, F.lit(False))
    model = toxicity.fit(docs, labels.where(~held_out("doc_id")))
    scored = toxicity.score(docs, model, keep=(held_out("doc_id").alias("held_out"),))
    return scored.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_pack, op2_mix, op3_topk, op4_quality, op5_licenses, op6_warc_audit, op7_substring, op8_count_tokens, op9_near_duplicates, op10_language, op11_hard_negatives, op12_toxicity, op13_clusters)}

_WORDS = r"w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents)"



def _kmeans_sql(k: int = 16, rounds: int = 3) -> str:
    """Each round in two table expressions: the nearest centroid of each vector, and the centroids after it."""
    sql = f"""
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS x FROM embeddings
           WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS j, x FROM v QUALIFY j < {k})"""
    apart = "list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))::BIGINT"
    for r in range(rounds + 1):
        sql += f""",
a{r} AS MATERIALIZED (SELECT v.vec_id, v.x, min({{'d': {apart}, 'j': c.j}}) AS best FROM v, c{r} c GROUP BY ALL)"""
        if r < rounds:
            sql += f""",
m{r} AS (SELECT j, list(m ORDER BY i) AS x FROM (SELECT best.j AS j, i, floor(sum(x[i])::DOUBLE / count(*))::BIGINT AS m FROM a{r}, range(1, 65) t(i) GROUP BY 1, 2) GROUP BY j),
c{r + 1} AS MATERIALIZED (SELECT c.j, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m USING (j))"""
    return sql + f"""
SELECT a.vec_id, a.best.j::INTEGER AS cluster, a.best.d AS distance, (sum(a.best.d) OVER (PARTITION BY a.best.j))::BIGINT AS cluster_inertia, (sum(a.best.d) OVER ())::BIGINT AS inertia,
 sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON c.j = a.best.j
"""


ORACLE_SQL: dict[str, str] = {
    "op11_hard_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_dot_product(a.x, c.x)::BIGINT AS score FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id AND len(c.x) = len(a.x)),
pos AS (SELECT * FROM p WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, pos.vec_id AS positive_id, (row_number() OVER (PARTITION BY anchor_id, pos.vec_id ORDER BY n.score DESC, n.vec_id))::INTEGER AS rank, n.vec_id AS negative_id, pos.score AS positive_score, n.score AS negative_score
FROM pos JOIN p n USING (anchor_id) WHERE NOT n.same AND 30 * pos.score <= 100 * n.score AND 100 * n.score <= 90 * pos.score QUALIFY rank <= 10
""",
    "op13_clusters": _kmeans_sql(),
    "op3_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS x FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(c.x) = len(q.x)),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
""",
    "op7_substring": f"""
WITH {_WORDS},
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM w, unnest(range(1, len(ws) - 48)) AS t(i) WHERE len(ws) >= 50),
hit AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) AS least FROM win) WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS j FROM hit, unnest(range(50)) AS t(k)),
kept AS (SELECT w.doc_id, t.j, ws[t.j] AS word FROM w, unnest(range(1, len(ws) + 1)) AS t(j) LEFT JOIN gone ON gone.doc_id = w.doc_id AND gone.j = t.j WHERE gone.j IS NULL),
own AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS text FROM kept GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(own.n, 0))::BIGINT AS n_removed, sha256(coalesce(own.text, '')) AS kept_sha256 FROM w LEFT JOIN own USING (doc_id)
""",
    "op9_near_duplicates": f"""
WITH RECURSIVE {_WORDS},
g AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 4], ' ')) AS g FROM w, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS t(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 5 * k >= 4 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT DISTINCT a AS v, a AS u FROM e UNION SELECT v, e.b FROM reach JOIN e ON e.a = reach.u)
SELECT w.doc_id, coalesce((SELECT min(u) FROM reach WHERE v = w.doc_id), w.doc_id) AS class_id, (SELECT count(*) FROM e WHERE e.a = w.doc_id)::BIGINT AS n_links FROM w
""",
    "op6_warc_audit": """
WITH r AS (
  SELECT page_id, page_id // 1024 AS file,
         strlen(concat('WARC/1.0', chr(13), chr(10), 'WARC-Type: response', chr(13), chr(10), 'WARC-Target-URI: ', url, chr(13), chr(10), 'Content-Length: ', strlen(coalesce(html, ''))::VARCHAR))
         + 4 + strlen(coalesce(html, '')) + 4 AS length
  FROM pages),
o AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM r)
SELECT page_id, CASE page_id % 97 WHEN 5 THEN 'changed' ELSE 'missing' END AS kind, file, "offset", length::BIGINT AS length
FROM o WHERE page_id % 97 IN (5, 6)
""",
}
