"""The queries of the corpus operators: name -> function of (spark, sf_dir), and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, jaccard_join, language_id, license_scan, mixing, quality_classifier, quality_rules, sharding, token_counts, token_files
from .common import documents, new_path


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    model = language_id.fit(docs.where(~held_out).where("doc_id IS NOT NULL"))
    return language_id.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(decontamination.scan(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(*mixing.mix(documents(spark, sf_dir))).select(F.col("k").alias("doc_id"), "size", "source_size", "target", "taken")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rows = sharding.sharded(spark.read.parquet(f"{sf_dir}/documents.parquet"), new_path(spark, "shards"))
    return sharding.shard_digest(rows)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir))


def trusted_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents labelled good and not toxic."""
    return spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1 AND toxic = 0").select("doc_id")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_classifier.classified(documents(spark, sf_dir).select("doc_id", "lang", "text"), trusted_keys(spark, sf_dir))
    return rows.select("doc_id", "lang", F.col("__perplexity").alias("perplexity"), F.col("__threshold").alias("threshold"), F.col("__kept").alias("kept"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar(documents(spark, sf_dir))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(documents(spark, sf_dir)).drop("failed_rules")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.licenses(documents(spark, sf_dir)).select("doc_id", F.array_join(F.col("licenses.license"), ",").alias("licenses"), "license", F.round("dice", 6).alias("dice"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = new_path(spark, "tokens")
    token_files.write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), at)
    return token_files.digests(token_files.read_tokens(spark, at))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_decontamination, op3_mixing, op4_sharding, op5_token_counts, op6_quality_classifier, op7_jaccard_join, op8_quality_rules, op9_license_scan, op10_token_files)}

ORACLES = {
    "op2_decontamination": r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(8, len(w)) AS n, array_to_string(w[i : i + least(8, len(w)) - 1], ' ') AS g FROM b, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS t(i) WHERE len(w) > 0),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g FROM d, ns, unnest(range(1, len(w) - n + 2)) AS t(i) WHERE len(w) >= n),
m AS (SELECT doc_id, dw.n AS n, i, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ks FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM m) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ks, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)
""",
    "op7_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS g FROM w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN n n1 ON n1.doc_id = a JOIN n n2 ON n2.doc_id = b WHERE 100 * c >= 90 * (n1.n + n2.n - c)),
r(doc_id, x) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.x)
SELECT doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(x) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY 1
""",
}
