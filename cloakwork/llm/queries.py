"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.llm import decontaminate, jaccard_join, licenses, lm_scoring, packing, quality, substring_dedup, token_rollup, toxicity, warc
from cloakwork.llm.shared import shared_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are inserted; toxic ones are then deleted and poor ones revised (digits scrubbed), twice under one batch id.

    Texts are only counted, never shuffled: counts meet the labels, not the documents.
    """
    docs = _table(spark, sf_dir, "documents")
    labels = _table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    ledger = token_rollup.TokenLedger(spark, f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}")
    ledger.commit("load", token_rollup.count_tokens(docs).withColumn("op", F.lit("insert")))
    versions = F.explode(F.array(*map(F.lit, token_rollup.TOKENIZERS)))
    gone = labels.filter("toxic = 1").select("doc_id", F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("lang"), versions.alias("tokenizer"), F.lit(0).cast("long").alias("n_tokens"), F.lit("delete").alias("op"))
    scrubbed = docs.withColumn("text", F.regexp_replace("text", "[0-9]", " "))
    poor = token_rollup.count_tokens(scrubbed).join(labels.filter("toxic = 0 AND quality = 0").select("doc_id"), "doc_id")
    changes = gone.unionByName(poor.withColumn("op", F.lit("revise")))
    ledger.commit("review", changes)
    ledger.commit("review", changes)
    return ledger.totals()


OP1_SQL = r"""
WITH l AS (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY doc_id),
d AS (
  SELECT d.doc_id, d.source, d.lang,
         CASE WHEN l.toxic = 0 AND l.quality = 0 THEN regexp_replace(coalesce(d.text, ''), '[0-9]', ' ', 'g') ELSE coalesce(d.text, '') END AS text
  FROM documents d LEFT JOIN l ON l.doc_id = d.doc_id
  WHERE l.toxic IS NULL OR l.toxic <> 1),
c AS (
  SELECT source, lang, 'space-1' AS tokenizer, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n FROM d
  UNION ALL
  SELECT source, lang, 'alnum-1', len(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) FROM d)
SELECT source, lang, tokenizer, CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens
FROM c GROUP BY source, lang, tokenizer
"""


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP3_SQL = r"""
WITH iw AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
pat AS (
  SELECT DISTINCT item, least(13, len(w)) AS m, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM iw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT m FROM pat),
dw AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
win AS (SELECT rid, m, i, array_to_string(w[i : i + m - 1], ' ') AS g FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw, lens)),
occ AS (SELECT win.rid, win.i, win.m, pat.item FROM win JOIN pat ON pat.m = win.m AND pat.g = win.g),
hit AS (SELECT rid, count(DISTINCT i + k) AS n_hit FROM (SELECT rid, i, unnest(range(0, m)) AS k FROM occ) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT rid, item FROM occ) GROUP BY rid)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit ON hit.rid = dw.rid LEFT JOIN its ON its.rid = dw.rid
"""


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(_table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
g AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i : i + least(5, len(w)) - 1], ' ')) AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM g x JOIN g y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS (
  SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 80 * (na.n + nb.n - i)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.b)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = d.doc_id
"""


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_report(_table(spark, sf_dir, "pages"))


OP5_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT p.page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN n >= 100 AND p.page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND p.page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p LEFT JOIN f ON f.d = p.d AND p.n >= 100
"""


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_table(spark, sf_dir, "documents")).drop("kept", "text", "rest")


OP6_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (
  SELECT rid, i, md5(array_to_string(w[i : i + 34], ' ')) AS h
  FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
rep AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT rid, i + k AS at FROM (SELECT rid, i, unnest(range(0, 35)) AS k FROM win WHERE h IN (SELECT h FROM rep))),
word AS (SELECT rid, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS at FROM d),
kept AS (
  SELECT word.rid, string_agg(x, ' ' ORDER BY word.at) AS s, count(*) AS n
  FROM word LEFT JOIN gone ON gone.rid = word.rid AND gone.at = word.at WHERE gone.rid IS NULL GROUP BY word.rid)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.rid = d.rid
"""


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents")).drop("found")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_rollup": op1_token_rollup,
    "op2_quality_rules": op2_quality_rules,
    "op3_decontamination": op3_decontamination,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_warc": op5_warc,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_packing": op8_packing,
    "op9_license_scan": op9_license_scan,
    "op10_lm_scoring": op10_lm_scoring,
}
SQL: dict[str, str] = {"op1_token_rollup": OP1_SQL, "op3_decontamination": OP3_SQL, "op4_jaccard_join": OP4_SQL, "op5_warc": OP5_SQL, "op6_substring_dedup": OP6_SQL}
