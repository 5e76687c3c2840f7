"""The operators' registered queries, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .exact import exact_groups
from .lines import line_deduplicate
from .media import media_digests
from .mixing import schedule
from .packing import pack
from .pii import pseudonyms
from .quality import add_score, held_out, train
from .simhash import near_groups
from .urls import rule_table, url_verdicts
from .wavelet import read_documents, token_files

#: The rules of op5's contract.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Target weights of op4: the source that is largest in the tables has two parts, each other one has one.
WEIGHTS = {"src0": 2}
#: The setting that holds the pseudonyms' key, and the key of tests and checks, which is no secret.
KEY_SETTING, TEST_KEY = "spark.situ.pseudonyms.key", "situ pseudonyms"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return near_groups(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all documents keep of their lines."""
    done = line_deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents stored as AVI files and read back."""
    return media_digests(table(spark, sf_dir, "documents"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' places in the mixture."""
    return schedule(table(spark, sf_dir, "documents"), WEIGHTS)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages."""
    return url_verdicts(table(spark, sf_dir, "pages"), rule_table(spark, RULES))


def op6_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with pseudonyms for personal data."""
    return pseudonyms(table(spark, sf_dir, "documents").select("doc_id", "text"), spark.conf.get(KEY_SETTING, TEST_KEY).encode())


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts of all documents, which become the first batch of a digest index."""
    return exact_groups(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = train(docs, table(spark, sf_dir, "labels"))
    scored = add_score(docs, weights)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' pieces in sequences of 1024 ids."""
    pieces = pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids, written to token files and read back."""
    return read_documents(token_files(table(spark, sf_dir, "documents")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All registered queries of this subpackage."""
    found = (
        op1_simhash_near_dedup,
        op2_line_dedup,
        op3_media_columns,
        op4_mix_sources,
        op5_url_filter,
        op6_pii_pseudonyms,
        op7_exact_dedup,
        op8_quality_classifier,
        op9_packing,
        op10_token_files,
        pipeline,
    )
    return {f.__name__: f for f in found}


_OP2 = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), shared AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT k.*, s.key IS NOT NULL AND k.doc_id <> s.first AS gone FROM keyed k LEFT JOIN shared s ON k.key = s.key
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_OP5 = r"""
WITH rules(rule, rhost, rpath, action) AS (VALUES
  ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
  ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')
), p AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages
)
SELECT page_id, host, path, max(rule) FILTER (place = 1) AS rule, coalesce(max(action) FILTER (place = 1), 'allow') AS verdict
FROM (
  SELECT p.*, r.rule, r.action, row_number() OVER (PARTITION BY page_id ORDER BY length(r.rule) DESC NULLS LAST) AS place
  FROM p LEFT JOIN rules r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath)
) GROUP BY page_id, host, path
"""

_OP7 = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that it can express: the others are tested against brute force in tests/llm."""
    return {"op2_line_dedup": _OP2, "op5_url_filter": _OP5, "op7_exact_dedup": _OP7}
