"""The training-data queries, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import decontam, licenses, packing, pieces, pii, products, sharding, simhash, toxicity, urls
from quarry.llm.common import read, table_path

TOKENIZER = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"


def tokenizer_file(name: str) -> str:
    """Where the public tokenizers package, installed on all machines, keeps a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read(spark, sf_dir, "documents"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read(spark, sf_dir, "documents"))


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"))


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.segment(read(spark, sf_dir, "documents"), tokenizer_file(PIECES))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = table_path(spark, "packed_ids")
    packing.write_store(read(spark, sf_dir, "documents"), path, tokenizer_file(TOKENIZER))
    return packing.read_store(spark, path)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op8_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products.top_products(read(spark, sf_dir, "embeddings"), "vec_id % 100 = 0")


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(read(spark, sf_dir, "pages"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of op1: the numbers of base spans."""
    return op1_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of op2: the base phrases."""
    return op2_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of op9: host, path and rule."""
    return op9_urls(spark, sf_dir).select("page_id", "host", "path", "rule")


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
PII_SQL = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
c AS (SELECT doc_id, regexp_replace(m, '[^0-9]', '', 'g') AS x FROM (SELECT doc_id, unnest(regexp_extract_all(t, '[0-9](?:[ -]?[0-9])+')) AS m FROM d)),
k AS (SELECT doc_id, list_sum(list_transform(range(1, length(x) + 1), lambda i: CASE WHEN (length(x) - i) % 2 = 0 THEN x[i]::INT WHEN x[i]::INT > 4 THEN 2 * x[i]::INT - 9 ELSE 2 * x[i]::INT END)) AS s FROM c WHERE length(x) BETWEEN 14 AND 19),
n AS (SELECT doc_id, count(*) AS n FROM k WHERE s % 10 = 0 GROUP BY 1)
SELECT doc_id, len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'))::BIGINT AS n_email,
len(list_filter(regexp_extract_all(t, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+'), lambda m: len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR (length(ltrim(p, '0')) = 3 AND ltrim(p, '0') > '255'))) = 0))::BIGINT AS n_ip,
coalesce(n, 0)::BIGINT AS n_card, len(list_filter(regexp_extract_all(t, '\+[0-9][ ().0-9-]+[0-9]'), lambda m: length(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 10 AND 15))::BIGINT AS n_phone FROM d LEFT JOIN n USING (doc_id)"""
LICENSE_SQL = rf"""WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
p AS (SELECT doc_id, i - 1 AS i, CASE WHEN w[i] = 'mit' AND w[i + 1] = 'license' THEN 'mit' WHEN w[i] = 'apache' AND w[i + 1] = 'license' THEN 'apache' WHEN w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license' THEN 'gpl' END AS l FROM i),
g AS (SELECT doc_id, count(*) AS n, min(i) AS a, max(i) AS z, string_agg(DISTINCT l, ',' ORDER BY l) AS s FROM p WHERE l IS NOT NULL GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, a::BIGINT AS first_word, z::BIGINT AS last_word, coalesce(s, '') AS base_labels FROM d LEFT JOIN g USING (doc_id)"""
URL_SQL = r"""WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (SELECT unnest(['com', 'example.com', 'www.example.com', 'net', 'net']) AS h, unnest(['/', '/en/', '/en/', '/es/', '/fr/']) AS p),
f AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY 1)
SELECT page_id, host, path, rule FROM u LEFT JOIN f USING (page_id)"""

QUERIES = {f.__name__: f for f in (op1_pii, op2_licenses, op3_shards, op4_pieces, op5_packing, op6_decontamination, op7_simhash, op8_products, op9_urls, op10_toxicity, pii_counts, license_base, url_rules)}
ORACLES = {"op6_decontamination": decontam.ORACLE_SQL, "op8_products": products.ORACLE_SQL, "pii_counts": PII_SQL, "license_base": LICENSE_SQL, "url_rules": URL_SQL}
