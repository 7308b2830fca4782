"""The thin queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import decontaminate, fingerprint, langid, packing, pii, quality, simhash, token_output, urlfilter, warc
from quillon.llm.common import scratch

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    token_output.write_tokens(_table(spark, sf_dir, "documents"), path, WORD_BPE, end_id=2)
    return token_output.token_digests(token_output.read_tokens(spark, path))


def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = packing.pieces(_table(spark, sf_dir, "documents"), WORD_BPE, 2048, end_id=0)
    items = items.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(items, 2048)


def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = simhash.fingerprints(_table(spark, sf_dir, "documents"), shingle=4, seed=42)
    return simhash.near_groups(marks, radius=4).select("doc_id", simhash.as_hex("fp").alias("fingerprint"), "component_id")


def quality_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.filter(langid.fold("doc_id", 5) != 0))
    scored = quality.score(docs.select("doc_id", "text"), model)
    p = F.col("__q_score")
    return scored.select("doc_id", F.coalesce(langid.fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), p.alias("score"), (p >= 0.3).cast("int").alias("predicted"))


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    net = langid.train(docs.filter(langid.fold("doc_id", 4) != 2))
    out = langid.identify(docs, net)
    return out.select("doc_id", F.coalesce(langid.fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare(_table(spark, sf_dir, "documents"))


#: A deployment passes its own key.
PII_KEY = "replace-this-key"


def pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.replace(_table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)
    return out.select("doc_id", "text", F.size("__q_kinds").alias("n_entities"), F.array_join("__q_kinds", ",").alias("kinds"))


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


#: The rules of the URL filter's query.
RULES = [urlfilter.Rule.of("org/", "allow"), urlfilter.Rule.of("example.org/es/", "block"), urlfilter.Rule.of("example.org/en/1", "allow"), urlfilter.Rule.of("com/fr/", "allow"), urlfilter.Rule.of("com/de/", "block")]


def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(_table(spark, sf_dir, "pages"), RULES)


def page_captures(pages: DataFrame) -> DataFrame:
    """A capture log of ``pages``: of each page a full response, and a revisit at another time
    that carries the page's own validators. Some have no ETag, or a weak one."""
    i = F.col("page_id")
    tag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))
    common = [F.lit("last-modified"), F.concat(F.lit("day "), F.floor(i / 7).cast("string"))]
    tagged = lambda *more: F.when(i % 3 == 0, F.create_map(*common, *more)).otherwise(F.create_map(*common, F.lit("etag"), tag, *more))
    weak = lambda *more: F.when(i % 3 == 0, F.create_map(*common, *more)).otherwise(F.create_map(*common, F.lit("etag"), F.when(i % 3 == 1, F.concat(F.lit("W/"), tag)).otherwise(tag), *more))
    digest = F.concat(F.lit("sha1:"), F.sha1(F.coalesce("html", F.lit(""))))
    full = pages.select(F.concat(F.lit("response-"), i).alias("record_id"), "url", i.alias("ts"), F.lit("response").alias("kind"), tagged(F.lit("content-type"), F.lit("text/html"), F.lit("date"), F.concat(F.lit("at "), i.cast("string"))).alias("headers"), digest.alias("digest"))
    again = (i * 7919 + 13) % (i * 2 + 10)
    seen = pages.select(F.concat(F.lit("revisit-"), i).alias("record_id"), "url", again.alias("ts"), F.lit("revisit").alias("kind"), weak(F.lit("date"), F.concat(F.lit("at "), again.cast("string")), F.lit("content-type"), F.lit("ignored")).alias("headers"), digest.alias("digest"))
    return full.unionByName(seen)


def warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.resolve_revisits(page_captures(_table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    return out.withColumn("headers", warc.header_text("headers"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_ids": token_ids,
    "op2_best_fit_packing": best_fit_packing,
    "op3_document_fingerprints": document_fingerprints,
    "op4_decontamination": decontamination,
    "op5_warc_revisits": warc_revisits,
    "op6_quality_neighbours": quality_neighbours,
    "op7_pii_surrogates": pii_surrogates,
    "op8_language_id": language_id,
    "op9_url_filter": url_filter,
    "op10_simhash_near_dedup": simhash_near_dedup,
}

#: DuckDB SQL of the queries that SQL can express.
ORACLES: dict[str, str] = {
    "op5_warc_revisits": r"""
WITH p AS (
  SELECT page_id AS i, url, md5(coalesce(html, '')) AS m, sha1(coalesce(html, '')) AS s,
         regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM pages),
c AS (
  SELECT i, m, s,
         regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*', 0)), '^www[.]', ''), ':(80|443)$', '')
         || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS stem,
         list_sort(list_filter(string_split(regexp_extract(bare, '[?](.*)$', 1), '&'),
                   lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref)(=|$)'))) AS q FROM p WHERE url IS NOT NULL),
u AS (SELECT i, m, s, stem || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical_url,
      CASE WHEN i % 3 <> 0 THEN '"' || m || '"' END AS tag, 'day ' || CAST(i // 7 AS VARCHAR) AS lm,
      (i * 7919 + 13) % (i * 2 + 10) AS again FROM c),
r AS (SELECT v.i, v.canonical_url, v.again, v.tag, v.lm, v.s,
      (SELECT max({'ts': f.i, 'id': 'response-' || f.i, 'tag': f.tag, 'lm': f.lm, 's': f.s}) FROM u f
       WHERE f.canonical_url = v.canonical_url AND f.i < v.again) AS h FROM u v),
o AS (SELECT *, CASE WHEN h IS NULL THEN 'missing'
      WHEN coalesce(tag = h.tag, lm = h.lm, s = h.s) THEN 'resolved' ELSE 'mismatch' END AS outcome,
      CASE WHEN i % 3 = 1 THEN 'W/' || tag ELSE tag END AS sent FROM r)
SELECT 'revisit-' || i AS record_id, canonical_url, again AS ts, h.id AS resolved_id, h.ts AS resolved_ts, outcome,
  CASE WHEN outcome = 'resolved'
    THEN 'content-type: text/html' || chr(10) || 'date: at ' || again
         || CASE WHEN coalesce(sent, h.tag) IS NULL THEN '' ELSE chr(10) || 'etag: ' || coalesce(sent, h.tag) END
         || chr(10) || 'last-modified: ' || h.lm
    ELSE 'content-type: ignored' || chr(10) || 'date: at ' || again
         || CASE WHEN sent IS NULL THEN '' ELSE chr(10) || 'etag: ' || sent END || chr(10) || 'last-modified: ' || lm
  END AS headers
FROM o""",
}
