"""Registered queries of detectors, span algebra, rewriting and restoring."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.functions import patterns as P
from cloakwork.functions import spans as S
from cloakwork.operators import pages
from cloakwork.plans.registry import query, t
from cloakwork.streaming import anonymize as A

#: Texts of our own with the spans that each detector finds in them: (text, [(label, value), ..]) in order of place.
FIXTURE: list[tuple[str, list[tuple[str, str]]]] = [
    ("Пишите на anna.k+1@почта.example.org сегодня", []),
    ("Пишите на anna.k+1@post.example.org сегодня", [("EMAIL", "anna.k+1@post.example.org")]),
    ("Узлы 10.20.30.40, 999.1.1.1 и 1.2.3", [("IP", "10.20.30.40"), ("IP", "999.1.1.1")]),
    ("Тел. 8 (812) 555-01-23; +79015550124, 118125550123", [("ТЕЛЕФОН", "8 (812) 555-01-23"), ("ТЕЛЕФОН", "+79015550124")]),
    ("Договор № 77-15/А, счёт №5", [("ДОГОВОР", "№ 77-15/"), ("ДОГОВОР", "№5")]),
    ("от 31.12.2023 до 2024-01-15, не 1.2.2024", [("ДАТА", "31.12.2023"), ("ДАТА", "2024-01-15")]),
    ("«7» мая 2021 г. и 12 Декабря 1999", [("ДАТА", "«7» мая 2021 г."), ("ДАТА", "12 Декабря 1999")]),
    ("согласовал Кузьмин П.Р. и С.Т. Лаврова", [("ФИО", "Кузьмин П.Р."), ("ФИО", "С.Т. Лаврова")]),
    ("Королёва Мария Павловна\nздесь Королёва Мария Павловна", [("ФИО", "Королёва Мария Павловна")]),
    ("Нижний Новгород Область", []),
    ("заключил ПАО «Северный ветер» вчера", [("ОРГ", "ПАО «Северный ветер»")]),
    ("г. Тверь, ул. Садовая, д. 5, кв. 12", [("АДРЕС", "г. Тверь, ул. Садовая, д. 5, кв. 12")]),
    ("", []),
    ("\U0001f600 x@y.example", [("EMAIL", "x@y.example")]),
]


def _literal(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _expected(fixture) -> str:
    """SQL of (doc_id, start, end, label, value): each value is sought from where the one before begins."""
    rows = []
    for i, (text, spans) in enumerate(fixture):
        at, before = 0, None
        for label, value in spans:
            at = text.index(value, at + (value == before))
            rows.append(f"({i}, {at}, {at + len(value)}, {_literal(label)}, {_literal(value)})")
            before = value
    return f'SELECT CAST(a AS BIGINT) AS doc_id, b AS start, c AS "end", label, value FROM (VALUES {", ".join(rows)}) v(a, b, c, label, value)'


def fixture(spark, rows=None) -> DataFrame:
    return spark.createDataFrame([(i, x) for i, (x, *_) in enumerate(rows or FIXTURE)], "doc_id long, text string")


@query(_expected(FIXTURE))
def entities_fixture(spark, d):
    return S.rows(A.detect_entities(fixture(spark), expand=False), ["doc_id"], "spans").select("doc_id", "start", "end", "label", "value")


IDENTITY = [
    ("серия 38 02 № 118822 и 5203 774411", [("ПАСПОРТ", "серия 38 02 № 118822"), ("ПАСПОРТ", "5203 774411")]),
    ("СНИЛС 112-233-445 95, 11223344595", [("СНИЛС", "112-233-445 95"), ("ПАСПОРТ", "1122334459"), ("СНИЛС", "11223344595")]),
    ("ИНН: 5001007322", [("ИНН", "ИНН: 5001007322"), ("ПАСПОРТ", "5001007322")]),
    ("500100732259", [("ПАСПОРТ", "5001007322"), ("ИНН", "500100732259")]),
    ("КПП 500101001 и 500101001", [("КПП", "КПП 500101001")]),
    ("123456789 1234", []),
]


@query(_expected([(x, sorted(s, key=lambda p: x.index(p[1]))) for x, s in IDENTITY]))
def entities_identity(spark, d):
    """Identity numbers of all kinds, sorted by place; overlaps stay."""
    found = S.sorted_by_start(F.concat(*[S.find(F.col("text"), p, n, i) for i, (n, p, _) in enumerate(P.IDENTITY)]))
    return S.rows(fixture(spark, IDENTITY), ["doc_id"], found).select("doc_id", "start", "end", "label", "value")


def notes(spark, d) -> DataFrame:
    """A note on every customer, with a phone, a date and a contract in known places."""
    k = F.col("c_custkey")
    phone = F.concat(F.lit("+7 (9"), F.lpad((k % 100).cast("string"), 2, "0"), F.lit(") 555-"), F.lpad((k % 97).cast("string"), 2, "0"), F.lit("-"), F.lpad((k % 89).cast("string"), 2, "0"))
    date = F.concat(F.lpad((k % 28 + 1).cast("string"), 2, "0"), F.lit("."), F.lpad((k % 12 + 1).cast("string"), 2, "0"), F.lit(".2021"))
    return t(spark, d, "customer").select(k.alias("doc_id"), F.concat(F.lit("Клиент "), "c_name", F.lit(" тел. "), phone, F.lit(", с "), date, F.lit(" по договору № "), k.cast("string"), F.lit("/1")).alias("text"))


_PHONE = "'+7 (9' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') || ') 555-' || lpad(CAST(c_custkey % 97 AS VARCHAR), 2, '0') || '-' || lpad(CAST(c_custkey % 89 AS VARCHAR), 2, '0')"
_DATE = "lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0') || '.' || lpad(CAST(c_custkey % 12 + 1 AS VARCHAR), 2, '0') || '.2021'"
_AT = "length('Клиент ' || c_name || ' тел. ')"


@query(f"SELECT c_custkey AS doc_id, CAST({_AT} AS INTEGER) AS start, CAST({_AT} + 18 AS INTEGER) AS \"end\", {_PHONE} AS value FROM customer")
def entities_phone(spark, d):
    return S.rows(notes(spark, d), ["doc_id"], S.find(F.col("text"), P.DETECTORS[1][1], "ТЕЛЕФОН", 1)).select("doc_id", "start", "end", "value")


@query(f"SELECT c_custkey AS doc_id, CAST({_AT} + 22 AS INTEGER) AS start, CAST({_AT} + 32 AS INTEGER) AS \"end\", {_DATE} AS value FROM customer")
def entities_date(spark, d):
    return S.rows(notes(spark, d), ["doc_id"], S.find(F.col("text"), P.DETECTORS[10][1], "ДАТА", 10)).select("doc_id", "start", "end", "value")


_NOTE = "'Клиент ' || c_name || ' тел. [ТЕЛЕФОН_1], с [ДАТА_1] по договору [ДОГОВОР_1]'"


@query(f"SELECT c_custkey AS doc_id, {_NOTE} AS anonymised, 3 AS n_spans, 'Клиент ' || c_name || ' тел. ' || {_PHONE} || ', с ' || {_DATE} || ' по договору № ' || c_custkey || '/1' AS restored FROM customer")
def anonymize_notes(spark, d):
    out = A.restore(A.anonymize(notes(spark, d)))
    return out.select("doc_id", "anonymised", F.size("spans").alias("n_spans"), "restored")


@query(f"""
SELECT c_custkey AS doc_id, u.ord, u.label, u.placeholder, u.value FROM customer,
LATERAL (VALUES (0, 'ТЕЛЕФОН', '[ТЕЛЕФОН_1]', {_PHONE}), (1, 'ДАТА', '[ДАТА_1]', {_DATE}), (2, 'ДОГОВОР', '[ДОГОВОР_1]', '№ ' || c_custkey || '/1')) u(ord, label, placeholder, value)
""")
def mapping_rows(spark, d):
    return A.mapping_rows(A.anonymize(notes(spark, d)), "doc_id")


def spans_of(rows: list[tuple[int, int, str, str]]) -> Column:
    one = [F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(c).alias("label"), F.lit(v).alias("value"), F.lit(i).alias("prio")) for i, (a, b, c, v) in enumerate(rows)]
    return F.array(*one).cast(f"array<{S.SPAN}>")


_SWEEP = [(0, 5, "A", "aaaaa"), (3, 9, "B", "bbbbbb"), (0, 3, "C", "ccc"), (9, 11, "D", "dd"), (9, 11, "E", "dd")]


@query("""SELECT kind, list_value AS labels FROM (VALUES ('merged', 'A,D'), ('after', 'D'), ('before', 'B,D'), ('sorted', 'A,C,B,D,E')) v(kind, list_value)""")
def label_filter_orders(spark, d):
    """The sweep, and what is left of it where labels are filtered after and before it."""
    every, chosen = spans_of(_SWEEP), ["B", "D"]
    names = lambda s: F.array_join(F.transform(s, lambda x: x["label"]), ",")
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), names(s).alias("labels")) for k, s in (("merged", S.merge(every)), ("after", S.keep_labels(S.merge(every), chosen)), ("before", S.merge(S.keep_labels(every, chosen))), ("sorted", S.sorted_by_start(every)))])
    return spark.range(1).select(F.inline(rows))


@query("SELECT * FROM (VALUES ('[ФИО_1] и [ФИО_1], [ОРГ_1]', 'ФИО:Иван;ОРГ:Маяк')) v(anonymised, mapping)")
def first_label_wins(spark, d):
    """A value keeps the label under which it came first."""
    docs = spark.createDataFrame([("Иван и Иван, Маяк",)], "text string")
    out = A.anonymize(docs, spans=spans_of([(0, 4, "ФИО", "Иван"), (7, 11, "ОРГ", "Иван"), (13, 17, "ОРГ", "Маяк")]))
    return out.select("anonymised", F.array_join(F.transform("holders", lambda h: F.concat(h["label"], F.lit(":"), h["value"])), ";").alias("mapping"))


@query("SELECT * FROM (VALUES ('none', 'A,B'), ('0', 'B'), ('1', 'A,D'), ('0,1', 'C'), ('0,1,9', 'C')) v(dropped, labels)")
def false_positives(spark, d):
    """Base spans go by index (an index beyond the list does nothing); new ones come in where nothing taken so far overlaps."""
    base, more = spans_of([(0, 4, "A", "a"), (6, 9, "B", "b")]), spans_of([(2, 7, "C", "c"), (6, 8, "D", "d")])
    rows = []
    for drop in ([], [0], [1], [0, 1], [0, 1, 9]):
        left = S.add_without_overlap(base, more, F.array(*map(F.lit, drop)).cast("array<int>"))
        rows.append(F.struct(F.lit(",".join(map(str, drop)) or "none").alias("dropped"), F.array_join(F.transform(left, lambda s: s["label"]), ",").alias("labels")))
    return spark.range(1).select(F.inline(F.array(*rows)))


WORDS = ["Генеральный директор", "Орлов директор", "Отдел", "заказчик", "Москва", ""]


@query("""
SELECT * FROM (VALUES ('Генеральный директор', false, true), ('Орлов директор', true, true), ('Отдел', false, false), ('заказчик', false, false), ('Москва', false, true), ('', true, true)) v(value, as_person, as_organisation)
""")
def postfilter(spark, d):
    """Whether a span of this value is kept as a person and as an organisation."""
    df = spark.createDataFrame([(w,) for w in WORDS], "value string")
    kept = lambda label: F.size(S.postfilter(F.array(F.struct(F.lit(0).alias("start"), F.lit(1).alias("end"), F.lit(label).alias("label"), F.col("value").alias("value"), F.lit(0).alias("prio"))))) > 0
    return df.select("value", kept("ФИО").alias("as_person"), kept("ОРГ").alias("as_organisation"))


@query("""
SELECT * FROM (VALUES ('Анна Ким', true, true, false), ('анна Ким', false, true, false), ('Anna Kim', true, false, false), ('Казань', true, true, true), ('район', false, false, true)) v(value, capitalised, person_like, geo)
""")
def word_predicates(spark, d):
    v = F.col("value")
    return spark.createDataFrame([("Анна Ким",), ("анна Ким",), ("Anna Kim",), ("Казань",), ("район",)], "value string").select(v, S.capitalised(v).alias("capitalised"), S.person_like(v).alias("person_like"), S.is_geo(v).alias("geo"))


LINES = "один\n  два  \nтри четыре\n"


@query("SELECT * FROM (VALUES ('один', true), ('два', true), ('три', false), ('четыре', false), ('два  \nтри четыре', true)) v(value, whole)")
def whole_lines(spark, d):
    values = ["один", "два", "три", "четыре", "два  \nтри четыре"]
    rows = [F.struct(F.lit(v).alias("value"), S.whole_line(F.lit(LINES), F.struct(F.lit(LINES.index(v)).alias("start"), F.lit(LINES.index(v) + len(v)).alias("end"))).alias("whole")) for v in values]
    return spark.range(1).select(F.inline(F.array(*rows)))


CORES = [("ПАО «Северный ветер»", "Северный ветер", "северный"), ("ооо Маяковой", "Маяковой", "маяк"), ("ФГУП Берёзами", "Берёзами", "берёз"), ("АО Дым", "Дым", "дым"), ("ИП Лавров Л.", None, None), ("ОАО", None, None), ("ЗАО маяк", None, None), ("Садовской", "Садовской", "садовск")]


@query("SELECT value, core, stem FROM (VALUES " + ", ".join(f"({_literal(a)}, {'NULL' if b is None else _literal(b)}, {'NULL' if c is None else _literal(c)})" for a, b, c in CORES) + ") v(value, core, stem)")
def org_stems(spark, d):
    v = F.col("value")
    return spark.createDataFrame([(a,) for a, *_ in CORES], "value string").select(v, S.org_core(v).alias("core"), S.org_stem(S.org_core(v)).alias("stem"))


MENTIONS = ("Завод ООО «Гранит» у реки. Гранита много, у гранитом; гранд.", [("ОРГ", "ООО «Гранит»"), ("ОРГ", "Гранит"), ("ОРГ", "Гранита"), ("ОРГ", "гранитом")])


@query(_expected([MENTIONS]))
def org_expansion(spark, d):
    """Every further mention of an organisation, by its stem."""
    text = F.col("text")
    found = S.sorted_by_start(S.expand_orgs(text, S.find(text, P.DETECTORS[3][1], "ОРГ", 3)))
    return S.rows(fixture(spark, [MENTIONS]), ["doc_id"], found).select("doc_id", "start", "end", "label", "value")


SCANS = ("a@b.example и 10.0.0.256, 10.0.9.25, 8-495-555-01-02", [("EMAIL", "a@b.example"), ("IP", "10.0.9.25"), ("ТЕЛЕФОН", "8-495-555-01-02")])


@query(_expected([SCANS]))
def scanner_spans(spark, d):
    return S.rows(fixture(spark, [SCANS]), ["doc_id"], S.scan(F.col("text"))).select("doc_id", "start", "end", "label", "value")


@query(r"SELECT doc_id, regexp_replace(regexp_replace(text, 'lake', '[СКРЫТО_1]', 'gi'), 'the', '[СКРЫТО_2]', 'gi') AS hidden FROM documents")
def hidden_terms(spark, d):
    return t(spark, d, "documents").select("doc_id", S.hide_terms(F.col("text"), ["Lake", "THE", "lake", ""]).alias("hidden"))


@query(r"SELECT * FROM (VALUES ('a\E.b', '[СКРЫТО_1]x'), ('ФИО', '[ФИО_1] [СКРЫТО_1]')) v(term, hidden)")
def hidden_awkward_terms(spark, d):
    """Terms of any characters are taken literally; placeholders are not touched."""
    rows = [("a\\E.b", "a\\E.bx"), ("ФИО", "[ФИО_1] фио")]
    return reduce(DataFrame.unionByName, [spark.createDataFrame([(term, text)], "term string, text string").select("term", S.hide_terms(F.col("text"), [term]).alias("hidden")) for term, text in rows])


@query("SELECT doc_id, substr(text, 1, 1000) AS head, length(regexp_replace(text, '\\s', '', 'g')) < 50 AS scanned FROM documents")
def text_heads(spark, d):
    text = F.col("text")
    return t(spark, d, "documents").select("doc_id", F.substring(text, 1, 1000).alias("head"), pages.looks_scanned(text).alias("scanned"))


@query("""
SELECT conv_id, string_agg('--- Страница ' || turn || E' ---\\n' || coalesce(text, ''), E'\\n\\n' ORDER BY turn, text) AS txt,
       string_agg('## Страница ' || turn || E'\\n\\n' || coalesce(text, ''), E'\\n\\n---\\n\\n' ORDER BY turn, text) AS md,
       count(*) AS n_pages FROM conversations WHERE turn IS NOT NULL GROUP BY conv_id
""")
def bound_pages(spark, d):
    """Turns of conversations as pages of documents; the JSON's page count stands for its parts."""
    rows = t(spark, d, "conversations").select("conv_id", F.col("turn").cast("int").alias("page"), "text")
    out = pages.bind_pages(rows, "conv_id")
    return out.select("conv_id", "txt", "md", F.size(F.from_json("json", "struct<pages:array<struct<page:int,text:string>>>")["pages"]).cast("long").alias("n_pages"))
