"""Registered queries of the operators, and DuckDB SQL where it can tell their rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from reco.llm import (bpe, exact_dedup, html_text, langid, line_dedup, mixing, multiset_hash, role_repair, simhash,
                      spelling, token_file, url_filter, warc)
from reco.llm.common import shared_path

RULES = [url_filter.Rule("allow", "org", "/"), url_filter.Rule("block", "example.org", "/es/"),
         url_filter.Rule("block", "example.org", "/en/1"), url_filter.Rule("allow", "com", "/fr/"),
         url_filter.Rule("block", "com", "/de/")]
RANKS = "byte_bpe_multi_50k.tiktoken"
TOKENIZER, END_ID = "byte_bpe_50k.json", 2


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def op1_warc(spark: SparkSession, sf: str) -> DataFrame:
    manifest = warc.write_archives(_read(spark, sf, "pages"), shared_path(spark, "warc"))
    return warc.read_archives(manifest).drop("uri")


def op2_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = _read(spark, sf, "documents")
    model = langid.train(docs)
    d = docs.select("doc_id", "text", (langid.bucket5("doc_id") == 0).alias("held_out"))
    return langid.identify(d, model)


def op3_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    pages = _read(spark, sf, "pages").select("page_id", "url")
    return url_filter.judge(pages, url_filter.rule_table(spark, RULES)).drop("url")


def op4_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.digest_documents(_read(spark, sf, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op5_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.decisions(_read(spark, sf, "documents"))


def op6_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    docs = _read(spark, sf, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    m = mixing.mix(docs, F.col("size"))
    return m.select("doc_id", "size", "source_size", "target", (F.col("takes") * F.col("size")).alias("taken"))


def op7_html_text(spark: SparkSession, sf: str) -> DataFrame:
    t = html_text.extract(_read(spark, sf, "pages").select("page_id", "url", "html"))
    return t.withColumn("n_chars", F.length("text").cast("long"))


def op8_multiset_hash(spark: SparkSession, sf: str) -> DataFrame:
    return multiset_hash.fingerprints(_read(spark, sf, "documents"))


def op9_simhash(spark: SparkSession, sf: str) -> DataFrame:
    d = simhash.decisions(_read(spark, sf, "documents"))
    return d.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_token_file(spark: SparkSession, sf: str) -> DataFrame:
    manifest = token_file.write_tokens(_read(spark, sf, "documents"), shared_path(spark, "tokens"),
                                       public_tokenizers.path(TOKENIZER), END_ID)
    return token_file.read_tokens(manifest)


def op11_line_runs(spark: SparkSession, sf: str) -> DataFrame:
    d = line_dedup.deduplicate(_read(spark, sf, "documents").select("doc_id", "text"))
    return d.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op12_spelling(spark: SparkSession, sf: str) -> DataFrame:
    found = spelling.words(_read(spark, sf, "documents"), min_chars=spelling.MIN_CHARS)    # a dropped letter only shortens a word
    return spelling.variants(spelling.with_slips(found))


def op13_role_repair(spark: SparkSession, sf: str) -> DataFrame:
    return role_repair.repair(role_repair.damaged(_read(spark, sf, "conversations")), copies=F.col("copies"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_warc, op2_language_id, op3_url_filter, op4_byte_bpe, op5_exact_dedup,
                            op6_mix_sources, op7_html_text, op8_multiset_hash, op9_simhash, op10_token_file,
                            op11_line_runs, op12_spelling, op13_role_repair)}

_RULE_ROWS = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in RULES)

ORACLE_SQL: dict[str, str] = {
    "op1_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
        FROM f""",
    "op3_url_filter": f"""
        WITH r(verdict, host, path) AS (VALUES {_RULE_ROWS}),
        u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages),
        m AS (SELECT u.host, u.path, r.host || r.path AS rule, r.verdict,
                     row_number() OVER (PARTITION BY u.host, u.path ORDER BY length(r.host || r.path) DESC, length(r.host) DESC, r.verdict DESC) AS rn
              FROM (SELECT DISTINCT host, path FROM u) u JOIN r
              ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path))
        SELECT u.page_id, u.host, u.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
        FROM u LEFT JOIN (SELECT * FROM m WHERE rn = 1) m ON u.host = m.host AND u.path = m.path""",
    "op5_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op11_line_runs": """
        WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
        l AS (SELECT doc_id, unnest(a) AS line, unnest(range(len(a))) AS pos FROM s),
        k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        r AS (SELECT key, max(doc_id) AS owner FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
        SELECT k.doc_id, count(*) AS n_lines, count(r.key) FILTER (k.doc_id <> r.owner) AS n_dropped,
               sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (r.key IS NULL OR k.doc_id = r.owner), '')) AS kept_sha256
        FROM k LEFT JOIN r ON k.key = r.key GROUP BY k.doc_id""",
}
