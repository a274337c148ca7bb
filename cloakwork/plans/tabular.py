"""Registered queries of masking, profiling, verdicts and the library."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork.functions import fakes
from cloakwork.functions import patterns as P
from cloakwork.functions.normalize import composed, derive_prefix, index_label, library_key, norm_key, norm_original
from cloakwork.operators import library, masking, profile
from cloakwork.plans.registry import label_sql, query, t
from cloakwork.sources.shared import shared_folder

SEED = "a secret of the test"
#: Headers and what they are, for queries over column names.
HEADERS = ["Имя предприятия", "Автор изменения", "Контрагент", "Сумма", "Цена за единицу", "Дата", "Статус", "Документ закупки", "АВТОР Изменения", "Город", "Телефон", "E-mail", "Адрес доставки", "Название линия", "Номер", "Код артикула"]


def _values(rows: list[tuple], names: str) -> str:
    cell = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return f"(VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) v({names})"


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def headers(spark) -> DataFrame:
    return spark.createDataFrame([(h,) for h in HEADERS], "col string")


@query(f"""
SELECT col, len(list_filter({_list(P.SENSITIVE_HEADERS)}, lambda k: contains(lower(col), k))) > 0 AS sensitive,
       CASE WHEN len(list_filter({_list(P.IDENTIFIER_HEADERS)}, lambda k: contains(lower(col), k))) > 0 THEN 'text' ELSE 'numeric' END AS kind_of_number,
       CASE {" ".join(f"WHEN len(list_filter({_list(keys)}, lambda k: contains(lower(col), k))) > 0 THEN '{c}'" for c, keys in P.CATEGORY_HEADERS.items())} END AS category
FROM {_values([(h,) for h in HEADERS], "col")}
""")
def header_rules(spark, d):
    from pyspark.sql.types import LongType

    rows = [(h, profile.header_sensitive(h), profile.column_kind(h, LongType()), profile.header_category(h)) for h in HEADERS]
    return spark.createDataFrame(rows, "col string, sensitive boolean, kind_of_number string, category string")


@query(f"""
SELECT col, CASE WHEN ends_with(w, 'ия') THEN upper(w[1]) || w[2:len(w) - 2] || 'ие' ELSE upper(w[1]) || w[2:] END AS prefix
FROM (SELECT col, lower(coalesce(list_filter(ws, lambda x: NOT list_contains({_list(["имя", "наименование", "название", "номер", "внеш", "внешний", "рабочего"])}, lower(x)))[1], ws[1])) AS w
      FROM (SELECT col, string_split(col, ' ') AS ws FROM {_values([(h,) for h in HEADERS], "col")}))
""")
def header_prefixes(spark, d):
    return spark.createDataFrame([(h, derive_prefix(h)) for h in HEADERS], "col string, prefix string")


@query(f"SELECT p_partkey, {label_sql('(p_partkey + 1)')} AS label FROM part")
def index_labels(spark, d):
    return t(spark, d, "part").select("p_partkey", index_label(F.col("p_partkey") + 1).alias("label"))


_DECORATED = "CASE c_custkey % 5 WHEN 0 THEN '  «' || c_name || '»' WHEN 1 THEN c_name || chr(9) || '  x ' WHEN 2 THEN 'cafe' || chr(769) || ' ' || c_custkey WHEN 3 THEN 'café ' || c_custkey ELSE '\" ' || c_name || ' \"' END"


def decorated(spark, d) -> DataFrame:
    """Customers' names with quotes, blanks and composed or decomposed accents around them."""
    k = F.col("c_custkey")
    value = F.when(k % 5 == 0, F.concat(F.lit("  «"), "c_name", F.lit("»"))).when(k % 5 == 1, F.concat("c_name", F.lit("\t  x "))).when(k % 5 == 2, F.concat(F.lit("café "), k.cast("string")))
    value = value.when(k % 5 == 3, F.concat(F.lit("café "), k.cast("string"))).otherwise(F.concat(F.lit('" '), "c_name", F.lit(' "')))
    return t(spark, d, "customer").select("c_custkey", value.alias("value"))


_STRIP = r"regexp_replace({}, '^[\s]+|[\s]+$', '', 'g')"
_PLAIN = r"regexp_replace(translate({}, '\"“”«»‘’''', ''), '\s+', ' ', 'g')".replace('\\"', '"')


@query(f"""
SELECT c_custkey, nfc_normalize({_PLAIN.format("upper(" + _STRIP.format("v") + ")")}) AS norm_key, nfc_normalize({_PLAIN.format(_STRIP.format("v"))}) AS original, {_STRIP.format(_PLAIN.format("upper(v)"))} AS library_key
FROM (SELECT c_custkey, {_DECORATED} AS v FROM customer)
""")
def norm_keys(spark, d):
    rows = decorated(spark, d).select("c_custkey", norm_key(F.col("value")).alias("k"), norm_original(F.col("value")).alias("o"), library_key(F.col("value")).alias("library_key"))
    return composed(composed(rows, "k", "norm_key"), "o", "original").select("c_custkey", "norm_key", "original", "library_key")


@query(f"""
WITH v AS (SELECT c_custkey, {_PLAIN.format("upper(" + _STRIP.format("v") + ")")} AS k, {_PLAIN.format(_STRIP.format("v"))} AS o FROM (SELECT c_custkey, {_DECORATED.replace("c_custkey", "(c_custkey % 40)").replace("c_name", "('n' || c_custkey % 7)")} AS v FROM customer)),
f AS (SELECT k, arg_min(o, (c_custkey, o)) AS original, min(c_custkey) AS r FROM v GROUP BY k),
e AS (SELECT nfc_normalize(k) AS e, row_number() OVER (ORDER BY min(r)) AS n FROM f GROUP BY 1)
SELECT k AS norm_key, original, 'Клиент ' || {label_sql("n")} AS pseudonym FROM f JOIN e ON e.e = nfc_normalize(k)
""")
def composed_mapping(spark, d):
    """Composed and decomposed spellings share a pseudonym; the first spelling of a key is its original."""
    small = t(spark, d, "customer").select("c_custkey", F.concat(F.lit("n"), (F.col("c_custkey") % 7).cast("string")).alias("c_name"))
    k = F.col("c_custkey") % 40
    value = F.when(k % 5 == 0, F.concat(F.lit("  «"), "c_name", F.lit("»"))).when(k % 5 == 1, F.concat("c_name", F.lit("\t  x "))).when(k % 5 == 2, F.concat(F.lit("café "), k.cast("string")))
    value = value.when(k % 5 == 3, F.concat(F.lit("café "), k.cast("string"))).otherwise(F.concat(F.lit('" '), "c_name", F.lit(' "')))
    pos = F.struct(F.lit(0).alias("sheet"), F.lit(0).alias("col"), F.col("c_custkey").alias("row"))
    return masking.text_mapping(small.select(value.alias("value"), F.lit("Клиент").alias("prefix"), pos.alias("pos"))).select("norm_key", "original", "pseudonym")


SURNAMES = ["Иванов", "Петров", "Сидорова", "Орлов", "Ким"]


def people(spark, d) -> DataFrame:
    """Names of different lengths under five surnames, one value without a surname among them."""
    n = F.col("n_nationkey")
    surname = F.element_at(F.array(*map(F.lit, SURNAMES)), (n % 5 + 1).cast("int"))
    value = F.when(n == 24, "ромашка белая").otherwise(F.concat(surname, F.lit(" "), F.initcap("n_name")))
    return t(spark, d, "nation").select(value.alias("value"), n.alias("pos"), "n_nationkey")


_PEOPLE = f"SELECT n_nationkey AS pos, CASE WHEN n_nationkey = 24 THEN 'ромашка белая' ELSE {_list(SURNAMES)}[n_nationkey % 5 + 1] || ' ' || array_to_string(list_transform(string_split(n_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') END AS value FROM nation"


@query(f"""
WITH p AS ({_PEOPLE}), s AS (SELECT pos, value, lower(string_split(value, ' ')[1]) AS s FROM p WHERE pos <> 24)
SELECT value, c AS canonical FROM s JOIN (SELECT s, arg_max(value, (length(value), -pos)) AS c FROM s GROUP BY s) USING (s) WHERE value <> c
""")
def entity_groups(spark, d):
    return masking.surname_groups(people(spark, d).select("value", "pos"))


@query(f"""
WITH p AS ({_PEOPLE}), s AS (SELECT pos, value, CASE WHEN pos = 24 THEN value ELSE lower(string_split(value, ' ')[1]) END AS s FROM p),
g AS (SELECT s, row_number() OVER (ORDER BY min(pos)) AS n FROM s GROUP BY s)
SELECT value AS original, 'Автор ' || {label_sql("n")} AS pseudonym FROM s JOIN g USING (s)
""")
def grouped_mapping(spark, d):
    """All spellings under one surname get the pseudonym of their longest."""
    rows = people(spark, d)
    pos = F.struct(F.lit(0).alias("sheet"), F.lit(0).alias("col"), F.col("pos").cast("long").alias("row"))
    return masking.text_mapping(rows.select("value", F.lit("Автор").alias("prefix"), pos.alias("pos")), groups=masking.surname_groups(rows.select("value", "pos"))).select("original", "pseudonym")


@query(f"""
SELECT p_partkey, {_list(fakes.SURNAMES)}[(p_partkey) % 20 + 1] || ' ' || {_list(fakes.NAMES)}[((p_partkey) // 20) % 20 + 1] || ' ' || {_list(fakes.FATHERS)}[((p_partkey) // 400) % 10 + 1] AS person,
       'ООО «' || {_list(fakes.FIRMS)}[(p_partkey) % 20 + 1] || CASE WHEN p_partkey >= 20 THEN ' ' || {label_sql("((p_partkey) // 20)")} ELSE '' END || '»' AS company,
       '+7 (000) ' || lpad(CAST((p_partkey) // 10000 AS VARCHAR), 3, '0') || '-' || lpad(CAST((p_partkey) // 100 % 100 AS VARCHAR), 2, '0') || '-' || lpad(CAST((p_partkey) % 100 AS VARCHAR), 2, '0') AS phone,
       'user' || (p_partkey + 1) || '@example.org' AS email, '10.0.' || (p_partkey) // 256 || '.' || (p_partkey) % 256 AS ip,
       'г. ' || {_list(fakes.TOWNS)}[(p_partkey) % 10 + 1] || ', ул. ' || {_list(fakes.STREETS)}[((p_partkey) // 10) % 10 + 1] || ', д. ' || ((p_partkey) // 100 + 1) AS address,
       {_list(fakes.TOWNS)}[(p_partkey) % 10 + 1] || CASE WHEN p_partkey >= 10 THEN ' ' || {label_sql("((p_partkey) // 10)")} ELSE '' END AS city
FROM part
""")
def category_fakes(spark, d):
    return t(spark, d, "part").select("p_partkey", *[fakes.fake(c, F.col("p_partkey") + 1).alias(c) for c in ("person", "company", "phone", "email", "ip", "address", "city")])


WORKBOOK = {"customer": {"c_name": "text", "c_acctbal": "numeric", "missing": "text"}, "supplier": {"s_name": "text", "s_acctbal": "numeric"}}
_K = "(0.5 + CAST(('0x' || substr(sha256('{}:{}'), 1, 16)) AS UBIGINT)::DOUBLE / 18446744073709551616.0)"


def workbook(spark, d) -> tuple[dict, dict]:
    return {"customer": t(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), "supplier": t(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")}, {"customer": "c_custkey", "supplier": "s_suppkey"}


def _both(sheets: dict, config=WORKBOOK) -> DataFrame:
    a, b = sheets["customer"], sheets["supplier"]
    return a.toDF("id", "name", "balance").withColumn("sheet", F.lit("customer")).unionByName(b.toDF("id", "name", "balance").withColumn("sheet", F.lit("supplier")))


@query(f"""
SELECT 'customer' AS sheet, c_custkey AS id, 'C_name ' || {label_sql("n")} AS name, round_even(c_acctbal * {_K.format(SEED, "c_acctbal")} * 100, 0) / 100 AS balance
FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) AS n FROM customer)
UNION ALL SELECT 'supplier', s_suppkey, 'S_name ' || {label_sql("n")}, round_even(s_acctbal * {_K.format(SEED, "s_acctbal")} * 100, 0) / 100
FROM (SELECT *, row_number() OVER (ORDER BY s_suppkey) AS n FROM supplier)
""")
def mask_workbook(spark, d):
    sheets, order = workbook(spark, d)
    return _both(masking.mask_workbook(sheets, WORKBOOK, order, SEED)[0])


@query("SELECT 'customer' AS sheet, c_custkey AS id, upper(c_name) AS name, abs(c_acctbal) < 1e9 AS near FROM customer UNION ALL SELECT 'supplier', s_suppkey, upper(s_name), abs(s_acctbal) < 1e9 FROM supplier")
def unmask_workbook(spark, d):
    """Masked and unmasked: names as they were, numbers within what rounding to cents loses."""
    sheets, order = workbook(spark, d)
    masked, mapping, numeric = masking.mask_workbook(sheets, WORKBOOK, order, SEED)
    back = _both(masking.unmask_workbook(masked, mapping, numeric))
    plain = _both(sheets).select("sheet", "id", F.col("balance").alias("was"))
    return back.join(plain, ["sheet", "id"]).select("sheet", "id", F.upper("name").alias("name"), (F.abs(F.col("balance") - F.col("was")) <= 0.011).alias("near"))


@query("""
WITH f AS (SELECT c_mktsegment AS s, row_number() OVER (ORDER BY min(c_custkey)) AS n FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY 1)
SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'Старое имя' ELSE 'C_mktsegment ' || chr(CAST(64 + n AS INTEGER)) END AS c_mktsegment FROM customer LEFT JOIN f ON s = c_mktsegment
""")
def mask_with_library(spark, d):
    """A value that the library knows keeps its pseudonym and takes up no ordinal; new ones are stored, and stay in a second run."""
    lib = library.Library(spark, f"{shared_folder(spark)}/library-{uuid.uuid4().hex}")
    lib.save_text(spark.createDataFrame([("BUILDING", "Старое имя")], "norm_key string, pseudonym string"), ["c_mktsegment"])
    sheets, config = {"customer": t(spark, d, "customer").select("c_custkey", "c_mktsegment")}, {"customer": {"c_mktsegment": "text"}}
    masking.mask_workbook(sheets, config, {"customer": "c_custkey"}, SEED, library=lib)
    back = {"customer": sheets["customer"].withColumn("c_custkey", -F.col("c_custkey"))}  # another order: only the library keeps the names
    again = masking.mask_workbook(back, config, {"customer": "c_custkey"}, "another secret", library=lib)[0]["customer"]
    return again.withColumn("c_custkey", -F.col("c_custkey"))


@query("SELECT n_name AS value, 'N' || n_nationkey AS pseudonym FROM nation WHERE n_nationkey % 2 = 0")
def library_lookup(spark, d):
    """What the library stores for keys of changed spelling: exact by key, or by similarity."""
    n = t(spark, d, "nation")
    stored = n.select(F.col("n_name").alias("norm_key"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("pseudonym"))
    asked = n.filter("n_nationkey % 2 = 0").select(F.when(F.col("n_nationkey") % 4 == 0, F.concat(F.lit(' "'), F.lower("n_name"), F.lit('"'))).otherwise(F.concat("n_name", F.lit("Z"))).alias("value"), "n_name")
    found = masking.resolve_library(asked.select("value"), stored, fuzzy=85)
    return asked.join(found, norm_key(F.col("value")) == F.col("norm_key")).select(F.col("n_name").alias("value"), "pseudonym")


@query("SELECT r_name AS col, 'first' AS kept, r_regionkey < 2 AS logged FROM region")
def library_tables(spark, d):
    """First writes win in every table; text saves log their columns."""
    lib = library.Library(spark, f"{shared_folder(spark)}/library-{uuid.uuid4().hex}")
    r = t(spark, d, "region").select(F.col("r_name").alias("col"), "r_regionkey")
    for verdict in ("first", "second"):
        lib.save("verdicts", r.filter("r_regionkey < 3" if verdict == "first" else "true").select("col", F.lit("first" if verdict == "first" else None).cast("string").alias("verdict")).withColumn("verdict", F.coalesce("verdict", F.when(F.col("col").isNull(), "never").otherwise("first"))))
    names = [x[0] for x in r.filter("r_regionkey < 2").select("col").collect()]
    lib.save_text(r.select(F.col("col").alias("norm_key"), F.lit("p").alias("pseudonym")), names)
    return lib.read("verdicts").join(lib.read("columns").withColumn("logged", F.lit(True)), "col", "left").select("col", F.col("verdict").alias("kept"), F.coalesce("logged", F.lit(False)).alias("logged"))


def sheets_of(spark, d) -> dict[str, DataFrame]:
    """Two tables with Russian headers over customers and suppliers."""
    c, s = t(spark, d, "customer"), t(spark, d, "supplier")
    name = F.when(F.col("c_custkey") % 2 == 0, "Иванов Иван").otherwise(F.concat(F.lit("Петров Пётр"), F.lit("")))
    first = c.select("c_custkey", F.col("c_name").alias("Контрагент"), name.alias("Ведущий"), F.col("c_acctbal").alias("Сумма"), F.concat(F.col("c_custkey").cast("string"), F.lit("@mail.ru")).alias("Связь"), F.col("c_mktsegment").alias("Статус"))
    return {"Клиенты": first, "Склад": s.select("s_suppkey", F.col("s_name").alias("Место"), F.col("s_acctbal").alias("Цена"))}


ORDER = {"Клиенты": "c_custkey", "Склад": "s_suppkey"}
_DETECTED = _values([("Клиенты", "Контрагент", 1, "header", False), ("Клиенты", "Ведущий", 2, "person", True), ("Клиенты", "Сумма", 3, "header", False), ("Клиенты", "Связь", 4, "scanner", True), ("Склад", "Место", 1, "known", False), ("Склад", "Цена", 2, "header", False)], "sheet, col, pos, source, required")


@query(f"SELECT sheet, col, CAST(pos AS INTEGER) AS pos, source, required FROM {_DETECTED}")
def detected_columns(spark, d):
    known = spark.createDataFrame([("Место",), ("Нигде",)], "col string")
    return profile.detect_columns(sheets_of(spark, d), known, order=ORDER)


@query("SELECT 'Клиенты' AS sheet, 'Ведущий,Связь' AS cols")
def required_columns(spark, d):
    found = profile.required_columns(profile.detect_columns(sheets_of(spark, d), order=ORDER))
    return found.select("sheet", F.array_join("cols", ",").alias("cols"))


@query("SELECT 'Клиенты' AS sheet, 'c_custkey' AS col UNION ALL SELECT 'Клиенты', 'Связь' UNION ALL SELECT 'Клиенты', 'Статус' UNION ALL SELECT 'Склад', 's_suppkey' UNION ALL SELECT 'Склад', 'Место'")
def columns_not_selected(spark, d):
    """The tables' columns without those of a configuration, and without those that a verdict is stored for."""
    every = profile.columns_of(sheets_of(spark, d))
    chosen = spark.createDataFrame([("Клиенты", "Контрагент"), ("Клиенты", "Ведущий"), ("Склад", "Цена")], "sheet string, col string")
    stored = spark.createDataFrame([("Сумма", "safe")], "col string, verdict string")
    return profile.unknown_columns(every.select("sheet", "col").exceptAll(chosen), stored).select("sheet", "col")


@query("SELECT c_nationkey % 5 = 9 AS hit, 'name' AS col FROM customer LIMIT 1")
def person_vote_latin(spark, d):
    """No name in Latin letters is taken for a person."""
    return profile.person_vote(t(spark, d, "customer").select(F.col("c_name").alias("name"), "c_custkey"), "name", order="c_custkey")


@query("SELECT 'mode' AS col, 'text' AS as_identifier, 'numeric' AS as_coefficient UNION ALL SELECT 'код', 'text', 'text'")
def masking_kinds(spark, d):
    from pyspark.sql.types import LongType

    rows = [(c, profile.masking_kind(c, LongType()), profile.masking_kind(c, LongType(), "coefficient")) for c in ("mode", "код")]
    return spark.createDataFrame(rows, "col string, as_identifier string, as_coefficient string")


_VERDICT = "CASE n_regionkey WHEN 0 THEN 'required' WHEN 1 THEN 'recommended' WHEN 2 THEN 'unsure' ELSE 'safe' END"


def verdicts(spark, d) -> DataFrame:
    r = F.col("n_regionkey")
    return t(spark, d, "nation").select(F.col("n_name").alias("col"), F.when(r == 0, "required").when(r == 1, "recommended").when(r == 2, "unsure").otherwise("safe").alias("verdict"), (F.col("n_nationkey") % 2 == 0).alias("chosen"), "n_nationkey")


@query(f"SELECT n_name AS col, CASE WHEN n_nationkey % 7 = 0 THEN 'required' ELSE {_VERDICT} END AS verdict, n_nationkey % 7 = 0 OR n_regionkey < 2 AS selected FROM nation")
def applied_verdicts(spark, d):
    rows = verdicts(spark, d)
    return profile.apply_verdicts(rows.select("col", "verdict"), rows.filter("n_nationkey % 7 = 0").select("col"))


@query(f"SELECT n_name AS col, n_nationkey % 2 = 0 OR n_regionkey = 0 AS selected FROM (SELECT *, {_VERDICT} FROM nation)")
def locked_columns(spark, d):
    return profile.lock_required(verdicts(spark, d)).select("col", "selected")


@query(f"SELECT n_name AS col, CASE WHEN n_nationkey % 2 = 1 THEN 'safe' WHEN {_VERDICT} IN ('required', 'recommended') AND n_nationkey % 3 > 0 THEN {_VERDICT} ELSE 'required' END AS verdict FROM nation")
def stored_verdicts(spark, d):
    rows = verdicts(spark, d)
    return profile.verdicts_to_store(rows.select("col"), rows.filter("chosen").select("col"), rows.filter("n_nationkey % 3 > 0").select("col", "verdict"))


@query(f"SELECT verdict, count(n_name) AS n FROM (VALUES ('required'), ('recommended'), ('safe')) v(verdict) LEFT JOIN nation ON CASE WHEN n_regionkey < 2 THEN {_VERDICT} ELSE 'safe' END = verdict GROUP BY verdict")
def verdict_counts(spark, d):
    return profile.verdict_counts(verdicts(spark, d))


@query("SELECT CAST((SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS BIGINT) AS rows")
def total_rows(spark, d):
    return masking.total_rows(workbook(spark, d)[0])


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name FROM customer ORDER BY customer.c_custkey LIMIT 5")
def first_rows(spark, d):
    return profile.first_rows(t(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey")


@query("""
SELECT 'c_mktsegment' AS col, (SELECT string_agg(v, ', ' ORDER BY r) FROM (SELECT c_mktsegment AS v, min(c_custkey) AS r FROM customer GROUP BY 1 ORDER BY 2 LIMIT 3)) AS sample
UNION ALL SELECT 'c_nationkey', (SELECT string_agg(v, ', ' ORDER BY r) FROM (SELECT CAST(c_nationkey AS VARCHAR) AS v, min(c_custkey) AS r FROM customer GROUP BY 1 ORDER BY 2 LIMIT 3))
UNION ALL SELECT 'empty', '—'
""")
def column_samples(spark, d):
    c = t(spark, d, "customer").withColumn("empty", F.lit(None).cast("string"))
    return reduce(DataFrame.unionByName, [profile.column_samples(c, x, order="c_custkey") for x in ("c_mktsegment", "c_nationkey", "empty")])


@query(f"""
SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'email' WHEN 1 THEN 'phone' WHEN 2 THEN 'ip' WHEN 3 THEN 'company' WHEN 4 THEN 'person' END AS class FROM part
""")
def value_classes(spark, d):
    k = F.col("p_partkey")
    n = k.cast("string")
    value = F.when(k % 7 == 0, F.concat(F.lit("почта"), n, F.lit("@пример.рф"))).when(k % 7 == 1, F.concat(F.lit("+7 (495) 100-"), F.lpad(n, 5, "0")))
    value = value.when(k % 7 == 2, F.concat(F.lit("300.1.2."), (k % 255).cast("string"))).when(k % 7 == 3, F.concat(F.lit("ооо Ромашка "), n)).when(k % 7 == 4, "Орлов А.Б.").when(k % 7 == 5, F.concat(F.lit("ООО"), n)).otherwise(F.concat(F.lit("орлов "), n))
    return t(spark, d, "part").select("p_partkey", profile.value_class(value, profile.looks_like_person(value)).alias("class"))
