"""The registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from histomill.llm import decontam, html_text, licenses, packing, quality, secrets, sentence_dedup, simhash, spotsigs, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Fixed values of the first query's contract: host, path, verdict.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
#: Blocked ``host + path`` strings for urls that no rule fits: these hosts, languages and 1,000 numbers.
BLOCKED_HOSTS, BLOCKED_LANGUAGES = ("tionsh", "tiontion", "tionble"), ("en", "de", "fr", "es")
RANKS, TOKENS = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url against the rules and the blocked urls."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    hosts, languages = (F.explode(F.array(*map(F.lit, x))) for x in (BLOCKED_HOSTS, BLOCKED_LANGUAGES))
    blocked = spark.range(1000).select("id", hosts.alias("h")).select("id", "h", languages.alias("l"))
    return url_filter.judge(table(spark, sf_dir, "pages"), rules, blocked.select(F.concat("h", F.lit(".example.net/"), "l", F.lit("/"), "id").alias("url")))


OP1_SQL = r"""
WITH u AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(rule_host, rule_path, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                                      ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
f AS (
  SELECT page_id, rule_host || rule_path AS rule, v,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC, v DESC) AS n
  FROM u JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)),
b AS (
  SELECT h || '.example.net/' || l || '/' || n AS listed
  FROM (VALUES ('tionsh'), ('tiontion'), ('tionble')) AS x(h), (VALUES ('en'), ('de'), ('fr'), ('es')) AS y(l), range(1000) AS z(n))
SELECT u.page_id, u.host, u.path, f.rule,
       coalesce(f.v, CASE WHEN u.host || u.path IN (SELECT listed FROM b) THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN f ON f.page_id = u.page_id AND f.n = 1
"""


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.path(TOKENS))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components of all documents."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    return secrets.find_secrets(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans", "n_entropy"
    )


def op5_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document, of its edited text, and their likeness."""
    return spotsigs.fingerprint(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        spotsigs.digest(F.col("sigs")).alias("fingerprint"),
        spotsigs.digest(F.col("edited_sigs")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of every document."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak label, score and decision for every document."""
    return quality.classify(table(spark, sf_dir, "documents"))


def op9_sentence_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that an earlier one has."""
    return sentence_dedup.deduplicate(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every ten-word window of the benchmark."""
    found = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        F.col("n_hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


OP10_SQL = r"""
WITH b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (
  SELECT item_id, w[i + 1 : i + 10] AS terms, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(0, len(w))) AS i FROM d),
m AS (
  SELECT p.doc_id, p.i, g.n, g.item_id
  FROM p JOIN g ON g.terms = p.w[p.i + 1 : p.i + 10] AND g.n = 10
  UNION ALL
  SELECT p.doc_id, p.i, g.n, g.item_id
  FROM p JOIN g ON g.n < 10 AND p.w[p.i + 1] = g.terms[1] AND p.w[p.i + 1 : p.i + g.n] = g.terms),
h AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS spot FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit,
       coalesce(t.n_items, 0) AS n_items, sha256(coalesce(t.items, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

def op10_near_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the benchmark's items that it holds exactly and in proximity."""
    found = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slop=decontam.NEAR_SLOP)
    return found.select("doc_id", "n_words", F.col("n_hit").cast("long").alias("n_hit"), "items", "near_items", "contaminated")


#: Queries by name; those without SQL are tested against brute force.
QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filter,
        op2_pack,
        op3_simhash,
        op4_secrets,
        op5_spotsigs,
        op6_html_text,
        op7_licenses,
        op8_quality,
        op9_sentence_dedup,
        op10_decontaminate,
        op10_near_matches,
    )
}
ORACLES = {"op1_url_filter": OP1_SQL, "op10_decontaminate": OP10_SQL}
