"""Registered queries of the recognisers and of what models answer, with stand-ins for the models."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork.functions import spans as S
from cloakwork.operators import profile
from cloakwork.operators import recognise as R
from cloakwork.plans.registry import offsets_sql, query, t
from cloakwork.plans.texts import spans_of
from cloakwork.streaming import anonymize as A

_PAIR = "[A-Z][a-z]+ [A-Z][a-z]+"


def scored_words():
    """A scored stand-in: five-letter words of a-z as people, by a confidence that grows with the place in the text."""
    word = re.compile(r"\b[a-z]{5}\b", re.ASCII)
    return lambda text: [(m.start(), m.end(), "person", 0.9 if m.start() % 2 else 0.3) for m in word.finditer(text)]


def chat_of_numbers():
    """A chat stand-in: the first run of digits of a question as an entity, in a fence; breaks off on texts with 'x', is away on those with 'q'."""

    def answer(text: str) -> str:
        m = re.search("[0-9]+", text)
        if "q" in text:
            raise R.ModelUnavailable("away")
        if "x" in text:
            return 'Sure: [{"start": ]'
        items = [{"text": "", "label": "number", "start": m.start(), "end": m.end(), "confidence": "high"}, {"label": "broken", "start": "?"}] if m else []
        return f"Here:\n```json\n{json.dumps(items)}\n```"

    return answer


@query(offsets_sql("documents", "doc_id", _PAIR))
def model_entities(spark, d):
    """People that a model finds in whole texts (the stand-in takes two capitalised words for one)."""
    found = R.in_whole_text(R.capitalised_pairs)(F.col("text"))
    return S.rows(t(spark, d, "documents"), ["doc_id"], found).select("doc_id", "start", "end", "value")


NAMES = "Протокол\n  Орлов Иван  \nНижний Новгород\nорлов иван\nКим Анна Ли и другие\nЛавров Лев\n"


@query("""SELECT CAST(a AS INTEGER) AS start, CAST(b AS INTEGER) AS "end", value, 'ФИО' AS label FROM (VALUES (11, 21, 'Орлов Иван'), (72, 82, 'Лавров Лев')) v(a, b, value)""")
def line_entities(spark, d):
    """Lines that are a name, whatever a model makes of them in a sentence; place names are skipped."""
    docs = spark.createDataFrame([(NAMES,)], "text string")
    return S.rows(docs, [], R.by_line(lambda: lambda x: [(9, len(x), "PER")])(F.col("text"))).select("start", "end", "value", "label")


@query(r"""
WITH m AS (SELECT conv_id, turn, regexp_extract_all(text, '\b[a-z]{5}\b') AS m, string_split_regex(text, '\b[a-z]{5}\b') AS g FROM conversations WHERE trim(text) <> ''),
x AS (SELECT conv_id, turn, m[i] AS w, CAST(list_sum(list_transform(g[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda z: length(z))), 0) AS INTEGER) AS start FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM m))
SELECT conv_id, turn, start, w AS text, 0.9::DOUBLE AS confidence FROM x WHERE start % 2 = 1
""")
def local_model(spark, d):
    """A scored model's people; those below the least confidence are dropped."""
    docs = R.Recogniser("local", scored_words).extract(t(spark, d, "conversations").select("conv_id", "turn", F.col("text")))
    return S.rows(docs, ["conv_id", "turn"], "entities").select("conv_id", "turn", "start", "text", "confidence")


@query(r"""
WITH p AS (SELECT p_partkey, 'part ' || p_partkey || CASE p_partkey % 5 WHEN 0 THEN ' x' WHEN 1 THEN ' q' ELSE '' END AS text FROM part)
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'AnswerInvalid' WHEN 1 THEN 'ModelUnavailable' END AS error,
       CASE WHEN p_partkey % 5 > 1 THEN CAST(p_partkey AS VARCHAR) END AS number, sha256('chat:' || text) AS cache_key FROM p
""")
def chat_entities(spark, d):
    """A chat model's entities, offsets without texts filled in, broken items skipped, failures told by kind."""
    k = F.col("p_partkey")
    docs = t(spark, d, "part").select(k, F.concat(F.lit("part "), k.cast("string"), F.when(k % 5 == 0, " x").when(k % 5 == 1, " q").otherwise("")).alias("text"))
    out = R.Recogniser("chat", chat_of_numbers).extract(docs)
    return out.select("p_partkey", "error", F.get("entities", F.lit(0))["text"].alias("number"), "cache_key")


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'kept' END AS text FROM part")
def cached_entities(spark, d):
    """Texts whose result is cached are not asked about again (the model here finds nothing)."""
    docs = t(spark, d, "part").select("p_partkey", F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("text"))
    kept = F.array(F.struct(F.lit("kept").alias("text"), F.lit("l").alias("label"), F.lit(0).alias("start"), F.lit(1).alias("end"), F.lit(1.0).alias("confidence"), F.lit("cache").alias("source")))
    cached = docs.filter("p_partkey % 2 = 0").select(R.cache_key(F.col("text"), "local").alias("cache_key"), kept.alias("entities"))
    out = R.Recogniser("local", lambda: lambda text: [], cached).extract(docs)
    return out.select("p_partkey", F.get("entities", F.lit(0))["text"].alias("text"))


@query("SELECT * FROM (VALUES ('off', false, 0), ('other', false, 0), ('chat', true, 1)) v(mode, enabled, n)")
def recogniser_modes(spark, d):
    docs = spark.createDataFrame([("7",), ("",), (None,)], "text string")
    rows = []
    for mode in ("off", "other", "chat"):
        r = R.Recogniser(mode, chat_of_numbers)
        rows.append((mode, r.enabled(), int(r.extract(docs).agg(F.sum(F.size("entities"))).first()[0])))
    return spark.createDataFrame(rows, "mode string, enabled boolean, n int")


ANSWERS = [
    ("Так:\n```json\n{\"a\": 1}\n```\nи ещё {\"b\": 2}", '{"a": 1}', "[]", '{"a": 1}\n\nи ещё {"b": 2}'),
    ("ответ {\"a\": {\"b\": [1, 2]}} конец }", '{"a": {"b": [1, 2]}}', "[1, 2]", '{"a": {"b": [1, 2]}} конец }'),
    ("[{\"x\": 1}, {\"y\": 2}] готово", '{"x": 1}', '[{"x": 1}, {"y": 2}]', '{"x": 1}, {"y": 2}'),
    ("нет ничего", "", "[]", "{}"),
    ("открыто { и всё", "", "[]", "{}"),
]


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, {_q(b)}, {_q(a)}, {_q(o)})" for i, (_, b, a, o) in enumerate(ANSWERS)) + ") v(id, block, array_part, object_part)")
def answer_json(spark, d):
    """What is JSON in a model's answer: its fenced or balanced block, from first to last bracket, from first to last brace."""
    x = F.col("answer")
    return spark.createDataFrame([(i, a) for i, (a, *_) in enumerate(ANSWERS)], "id int, answer string").select("id", R.json_block(x).alias("block"), R.json_array(x).alias("array_part"), R.json_object(x).alias("object_part"))


@query("SELECT n_name, CASE n_regionkey WHEN 0 THEN 0.9 WHEN 1 THEN 0.6 ELSE 0.3 END::DOUBLE AS confidence, sha256('chat:' || n_name) AS key FROM nation")
def confidences(spark, d):
    r = F.col("n_regionkey")
    word = F.when(r == 0, "high").when(r == 1, "medium").when(r == 2, "low").otherwise("sure")
    return t(spark, d, "nation").select("n_name", R.confidence(word).alias("confidence"), R.cache_key(F.col("n_name"), "chat").alias("key"))


@query("SELECT n_name, '  idx=0  label=ОРГ  value=''' || n_name || '''  pos=0-' || length(n_name) AS question FROM nation UNION ALL SELECT '-', '  (пусто)'")
def described_spans(spark, d):
    one = F.array(F.struct(F.lit(0).alias("start"), F.length("n_name").alias("end"), F.lit("ОРГ").alias("label"), F.col("n_name").alias("value"), F.lit(0).alias("prio")))
    rows = t(spark, d, "nation").select("n_name", R.describe(one).alias("question"))
    return rows.unionByName(spark.range(1).select(F.lit("-").alias("n_name"), R.describe(F.array().cast(f"array<{S.SPAN}>")).alias("question")))


@query("SELECT * FROM (VALUES (1, 'B,new', '1', 1, 1, NULL), (2, 'A,B', '', 0, 0, 'AnswerInvalid'), (3, 'A,B', '9', 0, 0, NULL)) v(id, labels, wrong, added, removed, error)")
def reviewed_spans(spark, d):
    """A model's review of known spans: false ones go, new ones come in, by how many the list changed."""
    said = {1: '{"false_positives": [0, "?"], "new": [{"start": 0, "end": 3, "label": "new"}, {"start": 7, "end": 9, "label": "over"}], "confirmed": [1]}', 2: "{nothing}", 3: '```json\n{"false_positives": [9], "new": []}\n```'}
    docs = spark.createDataFrame([(i, f"abcdefghij{i}") for i in said], "id int, text string").withColumn("spans", spans_of([(1, 4, "A", "bcd"), (6, 9, "B", "ghi")]))
    out = R.Recogniser("chat", lambda: lambda q: said[int(q[-1])]).review(docs)
    merged = S.add_without_overlap(F.col("spans"), R.as_spans(F.col("new")), F.col("false_positives"))
    effect = R.review_effect(F.col("spans"), merged, F.col("false_positives"))
    names = F.array_join(F.transform(merged, lambda s: s["label"]), ",")
    wrong = F.array_join(F.transform("false_positives", lambda i: F.when(i < 2, i + 1).otherwise(i).cast("string")), ",")
    return out.select("id", names.alias("labels"), wrong.alias("wrong"), effect["added"].alias("added"), effect["removed"].alias("removed"), "error")


@query("SELECT n_name AS col, CASE WHEN n_regionkey = 0 THEN 'safe' WHEN n_nationkey % 2 = 0 THEN 'required' ELSE 'safe' END AS verdict FROM nation")
def classified_columns(spark, d):
    """Stored verdicts first, then a model's (its first answer here has no JSON); columns that it leaves out are safe."""
    n = t(spark, d, "nation")
    said = {r[0]: "required" for r in n.filter("n_nationkey % 2 = 0").select("n_name").collect()}
    answers = iter(["I cannot say {", "```json\n" + json.dumps({"Лист": said}) + "\n```"])
    return R.classify_columns(n.select(F.col("n_name").alias("col")), n.filter("n_regionkey = 0").select(F.col("n_name").alias("col"), F.lit("safe").alias("verdict")), lambda q: next(answers))


@query("SELECT * FROM (VALUES ('a', 'Клиент'), ('b', NULL), ('c', NULL)) v(col, prefix)")
def suggested_prefixes(spark, d):
    def away(q):
        raise R.ModelTimeout

    rows = [("a", R.suggested_prefix("a", ["x"], lambda q: " «клиент». ")), ("b", R.suggested_prefix("b", ["x"], lambda q: "два слова")), ("c", R.suggested_prefix("c", ["x"], away))]
    return spark.createDataFrame(rows, "col string, prefix string")


@query("SELECT 'Лист: nation' || chr(10) || '  - n_nationkey: 0, 1, 2' || chr(10) || '  - n_name: ' || (SELECT string_agg(n_name, ', ' ORDER BY n_nationkey) FROM nation WHERE n_nationkey < 3) AS prompt")
def column_prompt(spark, d):
    text = profile.column_prompt({"nation": t(spark, d, "nation").select("n_nationkey", "n_name")}, order={"nation": "n_nationkey"})
    return spark.createDataFrame([(text,)], "prompt string")


@query("SELECT * FROM (VALUES ('[ФИО_1] из [ОРГ_1], [ОРГ_2]; [EMAIL_1]')) v(anonymised)")
def whole_detection(spark, d):
    """Detectors, a model, the scanner and further mentions in one go."""
    docs: DataFrame = spark.createDataFrame([("Anna Kim из ООО «Гранит», гранитом; a@b.example",)], "text string")
    return A.anonymize(docs, recognised=R.in_whole_text(R.capitalised_pairs)(F.col("text")), scanner=True).select("anonymised")
