"""Registered queries of the masking, profiling and entity operators, with SQL where SQL can express them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork.functions import patterns as P
from cloakwork.functions import spans as S
from cloakwork.functions.normalize import norm_key
from cloakwork.operators import library, masking, profile
from cloakwork.plans import files, models, tabular, texts  # noqa: F401  these register their queries
from cloakwork.plans.registry import QUERIES, SQL, label_sql, offsets_sql, query, t  # noqa: F401  the first two are what callers want
from cloakwork.streaming import anonymize as A

CUSTOMERS = {"customer": {"c_mktsegment": "text", "c_name": "text", "c_acctbal": "numeric"}, "supplier": {"s_name": "text"}}
ORDER = {"customer": "c_custkey", "supplier": "s_suppkey"}
_SEGMENTS = f"seg AS (SELECT k, CASE WHEN k IS NOT NULL THEN 'C_mktsegment ' || {label_sql('n')} END AS p FROM (SELECT upper(trim(c_mktsegment)) AS k, row_number() OVER (ORDER BY min(c_custkey)) AS n FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1))"


def _segments(spark: SparkSession, d: str) -> DataFrame:
    return masking.text_mapping(masking.values_of({"customer": t(spark, d, "customer")}, {"customer": {"c_mktsegment": "text"}}, ORDER))


@query(f"WITH {_SEGMENTS} SELECT c_custkey, p AS c_mktsegment FROM customer LEFT JOIN seg ON k = upper(trim(c_mktsegment))")
def mask_text_segment(spark, d):
    return masking.mask_text(t(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", _segments(spark, d))


@query("""
WITH v AS (SELECT upper(trim(c_name)) AS k, 0 AS s, c_custkey AS r, 'C_name' AS p FROM customer WHERE c_name IS NOT NULL
           UNION ALL SELECT upper(trim(s_name)), 1, s_suppkey, 'S_name' FROM supplier WHERE s_name IS NOT NULL),
f AS (SELECT k, min((s, r, p)) AS f FROM v GROUP BY k)
SELECT k AS norm_key, f[3] AS prefix, CAST(row_number() OVER (PARTITION BY f[3] ORDER BY f[1], f[2]) AS INTEGER) AS ordinal FROM f
""")
def text_mapping_table(spark, d):
    sheets = {n: t(spark, d, n) for n in ("customer", "supplier")}
    config = {"customer": {"c_name": "text"}, "supplier": {"s_name": "text"}}
    return masking.text_mapping(masking.values_of(sheets, config, ORDER)).select("norm_key", "prefix", "ordinal")


@query("SELECT c_custkey, round_even(c_acctbal * 1.25 * 100, 0) / 100 AS c_acctbal FROM customer")
def mask_numeric_float(spark, d):
    return t(spark, d, "customer").select("c_custkey", masking.scale(F.col("c_acctbal"), 1.25, False).alias("c_acctbal"))


@query("SELECT p_partkey, CAST(round_even(p_size * 0.7::DOUBLE, 0) AS BIGINT) AS p_size FROM part")
def mask_numeric_int(spark, d):
    return t(spark, d, "part").select("p_partkey", masking.scale(F.col("p_size"), 0.7, True).alias("p_size"))


@query("SELECT l_orderkey, l_linenumber, round_even(l_extendedprice * 0.8 * 100, 0) / 100 AS l_extendedprice, CAST(round_even(l_partkey * 1.5::DOUBLE, 0) AS BIGINT) AS l_partkey FROM lineitem")
def mask_lineitem(spark, d):
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", masking.scale(F.col("l_extendedprice"), 0.8, False).alias("l_extendedprice"), masking.scale(F.col("l_partkey"), 1.5, True).alias("l_partkey"))


@query("SELECT c_custkey, upper(trim(c_mktsegment)) AS c_mktsegment FROM customer")
def mask_roundtrip(spark, d):
    mapping = _segments(spark, d)
    masked = masking.mask_text(t(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", mapping)
    back = masking.unmask_text(masked, "c_mktsegment", mapping)
    return back.withColumn("c_mktsegment", norm_key(F.col("c_mktsegment")))


@query("SELECT c_custkey, round_even((round_even(c_acctbal * 1.25 * 100, 0) / 100) / 1.25 * 100, 0) / 100 AS c_acctbal FROM customer")
def unmask_numeric(spark, d):
    masked = masking.scale(F.col("c_acctbal"), 1.25, False)
    return t(spark, d, "customer").select("c_custkey", masking.unscale(masked, 1.25, False).alias("c_acctbal"))


@query("""
SELECT CAST((SELECT count(c_mktsegment) + count(c_name) + count(c_acctbal) FROM customer) + (SELECT count(s_name) FROM supplier) AS BIGINT) AS masked_values,
       CAST((SELECT count(*) FROM (SELECT upper(trim(c_mktsegment)) FROM customer WHERE c_mktsegment IS NOT NULL UNION SELECT upper(trim(c_name)) FROM customer WHERE c_name IS NOT NULL UNION SELECT upper(trim(s_name)) FROM supplier WHERE s_name IS NOT NULL)) AS BIGINT) AS unique_entities
""")
def mask_stats(spark, d):
    sheets = {n: t(spark, d, n) for n in CUSTOMERS}
    return masking.mask_stats(sheets, CUSTOMERS, masking.text_mapping(masking.values_of(sheets, CUSTOMERS, ORDER)))


def _found(spark, d, label: str) -> DataFrame:
    docs = t(spark, d, "documents")
    column = F.concat(*[S.find(F.col("text"), p, name, i) for i, (name, p, _) in enumerate(P.DETECTORS + P.IDENTITY) if name == label])
    return S.rows(docs, ["doc_id"], column).select("doc_id", "start", "end", "value")


_EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"


_IP = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"


@query(offsets_sql("documents", "doc_id", _EMAIL))
def entities_email(spark, d):
    return _found(spark, d, "EMAIL")


@query(offsets_sql("documents", "doc_id", _IP))
def entities_ip(spark, d):
    return _found(spark, d, "IP")


_SPANS = f"""
e AS ({offsets_sql("documents", "doc_id", _EMAIL)}), p AS ({offsets_sql("documents", "doc_id", _IP)}),
every AS (SELECT *, 'EMAIL' AS label, 0 AS prio FROM e UNION ALL SELECT *, 'IP', 2 FROM p),
spans AS (SELECT * FROM every x WHERE NOT EXISTS (SELECT 1 FROM every y WHERE y.doc_id = x.doc_id AND (y.start, y.start - y."end", y.prio) < (x.start, x.start - x."end", x.prio) AND y."end" > x.start))"""


@query(f"""
WITH {_SPANS},
firsts AS (SELECT doc_id, value, arg_min(label, start) AS label, min(start) AS first FROM spans GROUP BY doc_id, value),
holders AS (SELECT doc_id, value, '[' || label || '_' || row_number() OVER (PARTITION BY doc_id, label ORDER BY first) || ']' AS holder FROM firsts),
parts AS (SELECT s.doc_id, s.start, s."end", holder, coalesce(lag(s."end") OVER (PARTITION BY s.doc_id ORDER BY s.start), 0) AS before FROM spans s JOIN holders h ON h.doc_id = s.doc_id AND h.value = s.value),
texts AS (SELECT doc_id, string_agg(substr(text, before + 1, start - before) || holder, '' ORDER BY start) AS body, max("end") AS last, CAST(count(*) AS INTEGER) AS n FROM parts JOIN documents USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN n IS NULL THEN text ELSE body || substr(text, last + 1) END AS anonymised, coalesce(n, 0) AS n_spans FROM documents d LEFT JOIN texts USING (doc_id)
""")
def anonymize_text(spark, d):
    out = A.anonymize(t(spark, d, "documents"))
    return out.select("doc_id", "anonymised", F.size("spans").alias("n_spans"))


@query("SELECT doc_id, text AS restored FROM documents")
def restore_text(spark, d):
    return A.restore(A.anonymize(t(spark, d, "documents"))).select("doc_id", "restored")


@query(f"""
WITH {_SPANS},
v AS (SELECT label, value, count(*) AS n, min((doc_id, start)) AS spot FROM spans GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY spot) AS i FROM v)
SELECT label, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_values, string_agg(value, ', ' ORDER BY spot) FILTER (WHERE i <= 5) AS first FROM k GROUP BY label
""")
def label_counts(spark, d):
    return A.label_sizes(S.rows(A.detect_entities(t(spark, d, "documents").select("doc_id", "text")), ["doc_id"], "spans"))


@query("SELECT conv_id, turn, CAST(length(text) AS INTEGER) AS chars, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS INTEGER) AS lines, CAST(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS INTEGER) AS words FROM conversations")
def document_metrics(spark, d):
    return t(spark, d, "conversations").select("conv_id", "turn", F.length("text").alias("chars"), F.size(F.split("text", "\n")).alias("lines"), F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("words"))


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 20")
def preview(spark, d):
    return t(spark, d, "customer").select("c_custkey", "c_name").orderBy("c_custkey").limit(20)


@query("""
SELECT table_name AS sheet, column_name AS col,
       CASE WHEN data_type IN ('BIGINT', 'INTEGER', 'DOUBLE') AND NOT contains(lower(column_name), 'id') THEN 'numeric' ELSE 'text' END AS kind, false AS sensitive
FROM (VALUES ('customer'), ('orders'), ('part')) s(n) JOIN information_schema.columns ON table_name = n
""")
def column_types(spark, d):
    return profile.column_types({n: t(spark, d, n) for n in ("customer", "orders", "part")})


_CONTACTS = """SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'u' || c_custkey || '@mail.example' ELSE c_name END AS mail,
  CASE WHEN c_custkey % 2 = 0 THEN '+7 (495) 12' || c_custkey % 10 || '-45-6' || c_custkey % 7 ELSE 'нет' END AS phone,
  '10.0.' || c_custkey % 250 || '.1' AS host, 'ООО Ромашка ' || c_custkey AS firm, c_mktsegment AS segment FROM customer"""
_CLASSES = {"mail": "email", "phone": "phone", "host": "ip", "firm": "company", "segment": None}


def contacts(spark, d):
    """Customers with columns of each value class."""
    k = F.col("c_custkey")
    return t(spark, d, "customer").select(
        k.alias("id"),
        F.when(k % 3 == 0, F.concat(F.lit("u"), k.cast("string"), F.lit("@mail.example"))).otherwise(F.col("c_name")).alias("mail"),
        F.when(k % 2 == 0, F.concat(F.lit("+7 (495) 12"), (k % 10).cast("string"), F.lit("-45-6"), (k % 7).cast("string"))).otherwise("нет").alias("phone"),
        F.concat(F.lit("10.0."), (k % 250).cast("string"), F.lit(".1")).alias("host"),
        F.concat(F.lit("ООО Ромашка "), k.cast("string")).alias("firm"),
        F.col("c_mktsegment").alias("segment"),
    )


def _votes(column: str) -> str:
    rules = {"email": r"^[^@\s]+@[^@\s]+\.[^@\s]+$", "phone": r"^[+7(8][\d\s\-()]{8,}$", "ip": r"^\d{1,3}(\.\d{1,3}){3}$", "company": r"^(ООО|АО|ПАО|ЗАО|ИП|ОАО|НКО|ФГУП|МУП|ГУП)\s"}
    kind = "CASE " + " ".join(f"WHEN regexp_matches(v, '{r}') THEN '{c}'" for c, r in rules.items()) + " END"
    first = f"SELECT {column} AS v FROM c WHERE {column} IS NOT NULL GROUP BY 1 ORDER BY min(id), 1 LIMIT 20"
    return f"SELECT '{column}' AS col, (SELECT k FROM (SELECT {kind} AS k, count(*) AS n FROM ({first}) GROUP BY 1) WHERE k IS NOT NULL AND n >= 0.3 * (SELECT count(*) FROM ({first})) ORDER BY n DESC LIMIT 1) AS category"


@query(f"WITH c AS ({_CONTACTS}) " + " UNION ALL ".join(map(_votes, _CLASSES)))
def category_vote(spark, d):
    df = contacts(spark, d)
    votes = [profile.category_vote(df, c, order="id") for c in _CLASSES]
    return reduce(DataFrame.unionByName, votes)


def _hits(column: str) -> str:
    rule = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}|\b(?:\d{1,3}\.){3}\d{1,3}\b|(?:^|\D)(?:\+7|8)[\s\-]?\(?\d{3}\)?[\s\-]?\d{3}[\s\-]?\d{2}[\s\-]?\d{2}(?:\D|$)"
    return f"SELECT '{column}' AS col, (SELECT bool_or(regexp_matches(v, '{rule}')) FROM (SELECT {column} AS v FROM c WHERE {column} IS NOT NULL GROUP BY 1 ORDER BY min(id), 1 LIMIT 20)) AS hit"


@query(f"WITH c AS ({_CONTACTS}) " + " UNION ALL ".join(map(_hits, _CLASSES)))
def scanner_columns(spark, d):
    df = contacts(spark, d)
    return reduce(DataFrame.unionByName, [profile.scanner_hit(df, c, order="id") for c in _CLASSES])


@query("SELECT n_name AS norm_key, 'x' AS pseudonym FROM nation WHERE n_regionkey <> 1")
def library_upsert(spark, d):
    rows = t(spark, d, "nation").select(F.col("n_name").alias("norm_key"), F.lit("x").alias("pseudonym"), "n_regionkey")
    return library.upsert(rows.filter("n_regionkey = 1").drop("n_regionkey"), rows.drop("n_regionkey"), "norm_key")


@query("SELECT n_name AS col, CASE WHEN n_regionkey = 0 THEN 'required' WHEN n_regionkey < 3 THEN 'recommended' ELSE 'safe' END AS verdict FROM nation")
def verdict_merge(spark, d):
    n = t(spark, d, "nation").withColumnRenamed("n_name", "col")
    return profile.settle_verdicts(n.select("col"), n.filter("n_regionkey = 0").select("col", F.lit("required").alias("verdict")), n.filter("n_regionkey < 3").select("col", F.lit("recommended").alias("verdict")))


@query("SELECT n_name || 'X' AS value, n_name AS best, round(200.0 * length(n_name) / (2 * length(n_name) + 1), 6)::DOUBLE AS score FROM nation")
def fuzzy_top(spark, d):
    names = t(spark, d, "nation").select(F.col("n_name").alias("norm_key"))
    return library.fuzzy_candidates(names.select(F.concat("norm_key", F.lit("X")).alias("value")), names, 85)


@query(f"""
WITH e AS ({offsets_sql("documents", "doc_id", _EMAIL)}), p AS ({offsets_sql("documents", "doc_id", _IP)})
SELECT doc_id, start, "end", 'EMAIL' AS label FROM e
UNION ALL SELECT doc_id, start, "end", 'IP' FROM p WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.doc_id = p.doc_id AND e.start < p."end" AND p.start < e."end")
""")
def merge_without_overlap(spark, d):
    docs = t(spark, d, "documents")
    base, more = S.find(F.col("text"), P.DETECTORS[0][1], "EMAIL", 0), S.find(F.col("text"), P.DETECTORS[2][1], "IP", 2)
    return S.rows(docs, ["doc_id"], S.add_without_overlap(base, more)).select("doc_id", "start", "end", "label")
