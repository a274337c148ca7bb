"""Model-backed recognisers: pluggable models over whole texts or name-like lines, their answers, and the cache of results.

A model is a factory (picklable, without arguments) of a function text -> [(start, end, kind)], or for scored models
[(start, end, label, score)]; a worker makes it once for all its batches.  A language model is a function text -> answer.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.functions import patterns as P
from cloakwork.functions.spans import SPAN

ENTITY = "struct<text:string,label:string,start:int,end:int,confidence:double,source:string>"
MODES = ("off", "local", "chat")


class ModelUnavailable(RuntimeError):
    """The model cannot be reached."""


class ModelTimeout(RuntimeError):
    """The model did not answer in time."""


class AnswerInvalid(ValueError):
    """The model's answer is not what was asked for."""


def capitalised_pairs() -> Callable[[str], list[tuple[int, int, str]]]:
    """A stand-in for a model: two neighbouring words that begin with an ASCII capital are a person."""
    pair = re.compile(r"[A-Z][a-z]+ [A-Z][a-z]+")
    return lambda text: [(m.start(), m.end(), "PER") for m in pair.finditer(text)]


def in_whole_text(model: Callable[[], Callable], prio: int = 50) -> Callable[[Column], Column]:
    """A column function: the model's people (all words capitalised) and organisations in a text as spans; a model that fails finds none."""

    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = model()
        for texts in batches:
            yield texts.map(lambda t: _spans(run, t, prio))

    return F.pandas_udf(found, f"array<{SPAN}>")


def _spans(run: Callable, text: str | None, prio: int) -> list[dict]:
    if not text:
        return []
    try:
        hits = run(text)
    except Exception:  # noqa: BLE001  a model that breaks on a text finds nothing in it
        return []
    out = []
    for start, end, kind in hits:
        value = text[start:end]
        if kind in P.MODEL_LABELS and (kind != "PER" or all(w[0].isupper() for w in value.split())):
            out.append({"start": start, "end": end, "label": P.MODEL_LABELS[kind], "value": value, "prio": prio})
    return out


def by_line(model: Callable[[], Callable], prio: int = 60) -> Callable[[Column], Column]:
    """A column function: as in_whole_text, for lines of two to four capitalised words alone.

    The model sees such a line behind a word that makes a name of it; offsets are shifted back.  A line with a place word is skipped.
    """
    line_rule, shift = re.compile(P.NAME_LINE), len(P.NAME_PREFIX)
    places = set(P.GEO_WORDS)

    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = model()

        def one(text: str | None) -> list[dict]:
            out, at = [], 0
            for line in (text or "").split("\n"):
                bare = line.strip()
                if line_rule.match(bare) and not places.intersection(bare.lower().split()):
                    first = at + len(line) - len(line.lstrip())
                    for s in _spans(run, P.NAME_PREFIX + bare, prio):
                        if s["start"] >= shift:
                            out.append(s | {"start": first + s["start"] - shift, "end": first + s["end"] - shift})
                at += len(line) + 1
            return out

        for texts in batches:
            yield texts.map(one)

    return F.pandas_udf(found, f"array<{SPAN}>")


def local_entities(model: Callable[[], Callable], least_person: float = P.LEAST_PERSON) -> Callable[[Column], Column]:
    """A column function: a scored model's entities; people below the confidence are dropped."""

    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = model()
        for texts in batches:
            yield texts.map(lambda t: [{"text": t[a:b], "label": label, "start": a, "end": b, "confidence": float(score), "source": "local"} for a, b, label, score in (run(t) if t and t.strip() else [])])

    every = F.pandas_udf(found, f"array<{ENTITY}>")
    return lambda text: confident(every(text), least_person)


def confident(entities: Column, least_person: float = P.LEAST_PERSON) -> Column:
    """Entities but for people below the confidence."""
    return F.filter(entities, lambda e: (e["label"] != "person") | (e["confidence"] >= least_person))


def fenced(answer: Column) -> Column:
    """What stands in an answer's code block; null without one."""
    return F.nullif(F.regexp_extract(answer, r"```(?:json)?\s*([\s\S]*?)```", 1), F.lit(""))


def json_block(answer: Column) -> Column:
    """The first code block of an answer, else its first balanced {..}, else nothing."""
    rest = F.substring(answer, F.instr(answer, "{"), F.length(answer))
    chars = F.when(F.instr(answer, "{") > 0, F.split(rest, "")).otherwise(F.array().cast("array<string>"))
    zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(acc: Column, c: Column) -> Column:
        depth = acc["depth"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)
        at = acc["at"] + F.length(c)
        return F.struct(depth.alias("depth"), at.alias("at"), F.when((acc["end"] == 0) & (c == "}") & (depth == 0), at).otherwise(acc["end"]).alias("end"))

    end = F.aggregate(chars, zero, step, lambda acc: acc["end"])
    return F.coalesce(F.regexp_replace(fenced(answer), r"^\s+|\s+$", ""), F.when(end > 0, F.substring(rest, F.lit(1), end)).otherwise(""))


def _outer(answer: Column, first: str, last: str, none: str) -> Column:
    plain = F.regexp_replace(answer, r"```(?:json)?", "")
    return F.coalesce(F.nullif(F.regexp_extract(plain, rf"(?s)\{first}.*\{last}", 0), F.lit("")), F.lit(none))


def json_array(answer: Column) -> Column:
    """From the first [ to the last ], fences aside; [] without."""
    return _outer(answer, "[", "]", "[]")


def json_object(answer: Column) -> Column:
    """From the first { to the last }, fences aside; {} without."""
    return _outer(answer, "{", "}", "{}")


def confidence(word: Column) -> Column:
    """A number for high, medium and low; an unknown word counts as low."""
    out = F.lit(P.CONFIDENCE["low"])
    for name, value in P.CONFIDENCE.items():
        out = F.when(word == name, value).otherwise(out)
    return out


def cache_key(text: Column, mode: str) -> Column:
    return F.sha2(F.concat(F.lit(f"{mode}:"), text), 256)


def describe(spans: Column) -> Column:
    """Spans as the lines of a question."""
    line = lambda s, i: F.concat(F.lit("  idx="), i.cast("string"), F.lit("  label="), s["label"], F.lit("  value='"), s["value"], F.lit("'  pos="), s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))
    return F.when(F.size(spans) > 0, F.array_join(F.transform(spans, line), "\n")).otherwise("  (пусто)")


_ITEM = "struct<text:string,label:string,start:string,end:string,confidence:string>"


def _entities(items: Column, text: Column) -> Column:
    """Items of an answer with both offsets as entities; others are skipped."""
    good = F.filter(items, lambda x: x["start"].try_cast("int").isNotNull() & x["end"].try_cast("int").isNotNull())

    def entity(x: Column) -> Column:
        start, end = x["start"].try_cast("int"), x["end"].try_cast("int")
        value = F.coalesce(F.nullif(x["text"], F.lit("")), F.substring(text, start + 1, end - start))
        return F.struct(value.alias("text"), F.coalesce(x["label"], F.lit("")).alias("label"), start.alias("start"), end.alias("end"), confidence(F.coalesce(x["confidence"], F.lit("low"))).alias("confidence"), F.lit("chat").alias("source"))

    return F.transform(good, entity)


def entities_of_answer(answer: Column, text: Column) -> Column:
    """An answer's array of entities; null where it holds no valid array."""
    part = json_array(answer)
    return F.when(F.get_json_object(part, "$").isNotNull(), _entities(F.from_json(part, f"array<{_ITEM}>"), text))


def review_of_answer(answer: Column, text: Column) -> Column:
    """struct(new, false_positives) of an answer about known spans; null where it holds no valid object."""
    part = json_object(answer)
    parsed = F.when(F.get_json_object(part, "$").isNotNull(), F.from_json(part, f"struct<new:array<{_ITEM}>,false_positives:array<string>>"))
    wrong = F.filter(F.transform(F.coalesce(parsed["false_positives"], F.array().cast("array<string>")), lambda x: x.try_cast("int")), lambda x: x.isNotNull())
    new = F.coalesce(_entities(parsed["new"], text), F.array().cast(f"array<{ENTITY}>"))
    return F.when(parsed.isNotNull(), F.struct(new.alias("new"), F.array_distinct(wrong).alias("false_positives")))


def ask(chat: Callable[[], Callable[[str], str]]) -> Callable[[Column], Column]:
    """A column function: struct(answer, error) of a language model; its errors become the name of their kind."""

    def answers(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        run = chat()
        for questions in batches:
            rows = []
            for q in questions:
                try:
                    rows.append((run(q), None))
                except (ModelUnavailable, ModelTimeout) as problem:
                    rows.append((None, type(problem).__name__))
            yield pd.DataFrame(rows, columns=["answer", "error"])

    return F.pandas_udf(answers, "answer string, error string")


class Recogniser:
    """Entities of documents by mode: off, local (a scored model) or chat (a language model).  An unknown mode is off."""

    def __init__(self, mode: str = "off", model: Callable | None = None, cached: DataFrame | None = None):
        self.mode = mode if mode in MODES else "off"
        self.model, self.cached = model, cached

    def enabled(self) -> bool:
        return self.mode != "off"

    def extract(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """Adds cache_key, entities and error; a blank text has none.  Texts in ``cached`` (cache_key, entities) are not asked about again."""
        text = F.col(text_col)
        out = docs.withColumn("cache_key", cache_key(F.coalesce(text, F.lit("")), self.mode))
        none = F.array().cast(f"array<{ENTITY}>")
        if not self.enabled():
            return out.withColumn("entities", none).withColumn("error", F.lit(None).cast("string"))
        blank = F.coalesce(F.trim(text), F.lit("")) == ""
        known = None
        if self.cached is not None:
            known = out.join(self.cached.select("cache_key", "entities"), "cache_key").withColumn("error", F.lit(None).cast("string")).select(*docs.columns, "cache_key", "entities", "error")
            out = out.join(self.cached.select("cache_key"), "cache_key", "left_anti").select(*docs.columns, "cache_key")
        if self.mode == "local":
            new = out.withColumn("entities", F.when(blank, none).otherwise(local_entities(self.model)(text))).withColumn("error", F.lit(None).cast("string"))
        else:
            new = out.withColumn("said", ask(self.model)(F.coalesce(text, F.lit(""))))
            found = entities_of_answer(F.col("said.answer"), text)
            broken = F.coalesce(F.col("said.error"), F.when(found.isNull(), AnswerInvalid.__name__))
            new = new.withColumn("entities", F.when(blank, none).otherwise(F.coalesce(found, none))).withColumn("error", F.when(~blank, broken)).drop("said")
        return new if known is None else known.unionByName(new)

    def review(self, docs: DataFrame, spans_col: str = "spans", text_col: str = "text") -> DataFrame:
        """Adds new (entities), false_positives (indices into the spans) and error; nothing unless in chat mode."""
        none = F.struct(F.array().cast(f"array<{ENTITY}>").alias("new"), F.array().cast("array<int>").alias("false_positives"))
        if self.mode != "chat":
            out = docs.withColumn("said", none).withColumn("error", F.lit(None).cast("string"))
        else:
            question = F.concat(describe(F.col(spans_col)), F.lit("\n\n"), F.coalesce(F.col(text_col), F.lit("")))
            out = docs.withColumn("answer", ask(self.model)(question))
            found = review_of_answer(F.col("answer.answer"), F.col(text_col))
            out = out.withColumn("error", F.coalesce(F.col("answer.error"), F.when(found.isNull(), AnswerInvalid.__name__))).withColumn("said", F.coalesce(found, none)).drop("answer")
        return out.withColumn("new", F.col("said.new")).withColumn("false_positives", F.col("said.false_positives")).drop("said")


def as_spans(entities: Column, prio: int = 300) -> Column:
    return F.transform(entities, lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["label"].alias("label"), e["text"].alias("value"), F.lit(prio).alias("prio")))


def review_effect(base: Column, merged: Column, false_positives: Column) -> Column:
    """struct(added, removed): by how many spans a review changed the list; indices beyond it count for nothing."""
    removed = F.size(F.filter(F.array_distinct(false_positives), lambda i: (i >= 0) & (i < F.size(base))))
    return F.struct((F.size(merged) - (F.size(base) - removed)).alias("added"), removed.alias("removed"))


def classify_columns(columns: DataFrame, cached: DataFrame, chat: Callable[[str], str] | None, prompt: str = "", attempts: int = 3) -> DataFrame:
    """(col, verdict): stored verdicts first; the rest are asked for in one question, again after an answer without valid JSON.

    ``columns``: (col), names from schemas, which the driver knows anyway; a column that the answer leaves out, and every
    column without a model, is safe.  An unreachable model is an error at once.
    """
    import json

    from cloakwork.operators.profile import no_verdicts, settle_verdicts, unknown_columns

    spark = columns.sparkSession
    open_ = [r[0] for r in unknown_columns(columns, cached).select("col").distinct().orderBy("col").collect()]
    if not open_ or chat is None:
        return settle_verdicts(columns, cached, no_verdicts(spark))
    for _ in range(attempts):
        answer = chat(prompt + "\n" + "\n".join(open_))
        block = spark.range(1).select(json_block(F.lit(answer)).alias("j")).first()[0]
        try:
            said = json.loads(block)
        except ValueError:
            continue
        if isinstance(said, dict):
            flat = {}
            for k, v in said.items():
                flat.update(v if isinstance(v, dict) else {k: v})
            model = [(c, str(flat[c])) for c in open_ if c in flat]
            return settle_verdicts(columns, cached, spark.createDataFrame(model, "col string, verdict string") if model else no_verdicts(spark))
    raise AnswerInvalid("no answer held valid JSON")


def suggested_prefix(column: str, sample: list[str], chat: Callable[[str], str] | None) -> str | None:
    """One noun for a column's pseudonyms by a model; None without an answer of one word."""
    if chat is None:
        return None
    try:
        words = (chat(f"{column}: {', '.join(sample)}") or "").strip().strip(".\"'«»").split()
    except (ModelUnavailable, ModelTimeout):
        return None
    return words[0].capitalize() if len(words) == 1 else None
