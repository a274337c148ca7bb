"""Entity spans as arrays of structs: finding, filtering, merging, rewriting and restoring, all in the JVM.

A span is struct(start, end, label, value, prio): half-open, 0-based, in code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.functions import patterns as P

SPAN = "struct<start:int,end:int,label:string,value:string,prio:int>"


def _empty() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def find(text: Column, pattern: str, label: str, prio: int, flags: str = P.FLAGS) -> Column:
    """All matches with their offsets: lengths of the pieces between matches, summed up.

    Texts without the characters that any match of this label holds are not searched; of the rest, those without a match once.
    """
    full = flags + pattern
    hits = F.regexp_extract_all(text, F.lit(full), F.lit(0))
    return F.when(may_hold(text, label) & text.rlike(full), placed(hits, F.split(text, full, -1), label, prio)).otherwise(_empty())


def rows(docs: DataFrame, keys: list[str], spans: Column | str) -> DataFrame:
    """(keys, start, end, label, value, prio): one row for each span.

    By an outer generator: from another one Spark would infer a filter on the spans and push it down, where they would be found a second time.
    """
    return docs.select(*keys, F.inline_outer(spans)).filter("start IS NOT NULL")


def may_hold(text: Column, label: str) -> Column:
    """Whether a text has the characters that an entity of this label cannot be without."""
    if label in P.MARKS:
        return F.contains(text, F.lit(P.MARKS[label]))
    return text.rlike(P.NEEDS[label]) if label in P.NEEDS else F.lit(True)


def placed(hits: Column, gaps: Column, label: str, prio: int) -> Column:
    """Spans of the matches, from what lies between them."""
    zero = F.struct(F.lit(0).alias("at"), _empty().alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["gap"])
        end = start + F.length(pair["hit"])
        span = F.struct(start.alias("start"), end.alias("end"), F.lit(label).alias("label"), pair["hit"].alias("value"), F.lit(prio).alias("prio"))
        return F.struct(end.alias("at"), F.array_append(acc["out"], span).cast(f"array<{SPAN}>").alias("out"))

    pairs = F.zip_with(hits, F.slice(gaps, F.lit(1), F.size(hits)), lambda h, g: F.struct(h.alias("hit"), g.alias("gap")))
    return F.when(F.size(hits) > 0, F.aggregate(pairs, zero, step, lambda acc: acc["out"])).otherwise(_empty())


def scan(text: Column) -> Column:
    """The scanner's spans: e-mails, addresses of machines (numbers up to 255) and phones, after all detectors in order."""
    kinds = [(label, p) for label, p, _ in P.DETECTORS if label in ("EMAIL", "IP", "ТЕЛЕФОН")]
    found = F.concat(*[find(text, p, label, 100 + i) for i, (label, p) in enumerate(kinds)])
    return F.filter(found, lambda s: (s["label"] != "IP") | F.forall(F.split(s["value"], r"\."), lambda n: n.cast("int") <= 255))


def sorted_by_start(spans: Column) -> Column:
    """By start, then detector; overlaps stay."""
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), s["prio"].alias("b"), s["end"].alias("c"), s.alias("s"))))
    return F.transform(keyed, lambda k: k["s"])


def org_core(value: Column) -> Column:
    """An organisation's name without legal form and quotes; null if too short, not capitalised, or a surname with initials."""
    forms = "|".join(sorted(P.ORG_FORMS, key=len, reverse=True))
    core = F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.trim(value), f"(?iu)^(?:{forms})", "")), "[«»\"]", ""))
    person = core.rlike(r"^[А-ЯЁ][а-яё]+(?:\s+[А-ЯЁ]\.){1,2}\s*$")
    return F.when(core.rlike("^[А-ЯЁA-Z]") & (F.length(core) >= 3) & ~person, core)


def org_stem(name: Column) -> Column:
    """The first word in lower case, less the first ending of the list that leaves four letters."""
    word = F.lower(F.split(name, r"\s+")[0])
    out = word
    for ending in reversed(P.STEM_ENDINGS):
        out = F.when(word.endswith(ending) & (F.length(word) - len(ending) >= 4), F.substring(word, F.lit(1), F.length(word) - len(ending))).otherwise(out)
    return out


def expand_orgs(text: Column, spans: Column) -> Column:
    """``spans`` and every further word that begins with the stem of an organisation among them."""
    orgs = F.filter(spans, lambda s: s["label"] == "ОРГ")
    stems = F.array_distinct(F.filter(F.transform(orgs, lambda s: org_stem(org_core(s["value"]))), lambda s: s.isNotNull() & (F.length(s) >= 4)))
    letters = "[А-Яа-яёЁA-Za-z]"
    edge = r"[\wА-Яа-яёЁA-Za-z]"

    def one(stem: Column) -> Column:
        pattern = F.concat(F.lit(f"(?iuU)(?<!{edge})"), quoted(stem), F.lit(f"{letters}*(?!{edge})"))
        return placed(F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1), "ОРГ", 200)

    more = F.flatten(F.transform(stems, one))
    fresh = F.aggregate(more, spans.cast(f"array<{SPAN}>"), lambda acc, s: F.when(F.exists(acc, lambda x: x["start"] == s["start"]), acc).otherwise(F.array_append(acc, s)))
    return F.when(F.size(stems) > 0, fresh).otherwise(spans.cast(f"array<{SPAN}>"))


def quoted(term: Column) -> Column:
    """A regular expression that matches the term and nothing else, whatever the term holds."""
    return F.concat(F.lit("\\Q"), F.replace(term, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def words(value: Column) -> Column:
    return F.filter(F.split(value, r"(?U)\s+"), lambda w: w != "")


def is_geo(word: Column) -> Column:
    return F.array_contains(F.array(*map(F.lit, P.GEO_WORDS)), F.lower(word))


def whole_line(text: Column, span: Column) -> Column:
    """Nothing but white space stands beside the span on its lines."""
    before = F.substring_index(F.substring(text, F.lit(1), span["start"]), "\n", -1)
    after = F.substring_index(F.substring(text, span["end"] + 1, F.length(text)), "\n", 1)
    return (F.trim(before) == "") & (F.trim(after) == "")


def capitalised(value: Column) -> Column:
    return F.forall(words(value), lambda w: w.rlike(r"^\p{Lu}"))


def person_like(value: Column) -> Column:
    return F.exists(words(value), lambda w: w.rlike("^[А-ЯЁ]"))


def detect(text: Column, identity: bool = False) -> Column:
    """Spans of all detectors, in detector order."""
    out = []
    for prio, (label, pattern, line) in enumerate(P.DETECTORS + (P.IDENTITY if identity else [])):
        found = find(text, pattern, label, prio)
        if line:
            found = F.filter(found, lambda s: whole_line(text, s) & ~F.exists(words(s["value"]), is_geo))
        out.append(found)
    return F.concat(*out)


def drop_common(spans: Column, labels: tuple[str, ...], common: list[str]) -> Column:
    """Drops spans of these labels all of whose words are common; one without words stays."""
    known = F.array(*map(F.lit, common))
    return F.filter(spans, lambda s: ~(s["label"].isin(*labels) & (F.size(words(s["value"])) > 0) & F.forall(words(s["value"]), lambda w: F.array_contains(known, F.lower(w)))))


def postfilter(spans: Column) -> Column:
    people = drop_common(spans, P.PERSON_LABELS, P.COMMON + P.GEO_WORDS)
    return drop_common(people, P.ORG_LABELS, P.ORG_COMMON)


def merge(spans: Column) -> Column:
    """By start, longer first, earlier detector first; a span is kept if it starts at or after the last one's end."""
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("a"), (s["start"] - s["end"]).alias("b"), s["prio"].alias("c"), s.alias("s")))
    zero = F.struct(F.lit(0).alias("end"), _empty().alias("out"))
    step = lambda acc, k: F.when(k["a"] >= acc["end"], F.struct(k["s"]["end"].alias("end"), F.array_append(acc["out"], k["s"]).cast(f"array<{SPAN}>").alias("out"))).otherwise(acc)
    return F.aggregate(F.array_sort(keyed), zero, step, lambda acc: acc["out"])


def keep_labels(spans: Column, labels: list[str] | None) -> Column:
    return spans if labels is None else F.filter(spans, lambda s: s["label"].isin(*labels))


def add_without_overlap(base: Column, more: Column, drop: Column | None = None) -> Column:
    """``base`` less the indices in ``drop``, then those of ``more`` that overlap nothing taken so far."""
    kept = base if drop is None else F.filter(base, lambda _, i: ~F.array_contains(drop, i))
    overlaps = lambda xs, s: F.exists(xs, lambda x: (x["start"] < s["end"]) & (s["start"] < x["end"]))
    return F.aggregate(more, kept, lambda acc, s: F.when(overlaps(acc, s), acc).otherwise(F.array_append(acc, s)))


def placeholders(spans: Column) -> Column:
    """(placeholder, label, value, ordinal) in order; a value keeps the label and number it got first."""
    firsts = F.filter(spans, lambda x, i: F.array_position(F.transform(spans, lambda y: y["value"]), x["value"]) == i + 1)
    ordinal = lambda f: F.size(F.filter(firsts, lambda g: (g["label"] == f["label"]) & (g["start"] <= f["start"])))
    return F.transform(firsts, lambda f: F.struct(F.concat(F.lit("["), f["label"], F.lit("_"), ordinal(f).cast("string"), F.lit("]")).alias("placeholder"), f["label"].alias("label"), f["value"].alias("value"), ordinal(f).alias("ordinal")))


def rewrite(text: Column, spans: Column, holders: Column) -> Column:
    """The text with merged spans replaced; put together once from what lies between them."""
    name = lambda s: F.filter(holders, lambda h: h["value"] == s["value"])[0]["placeholder"]
    before = lambda i: F.coalesce(F.get(spans, i - 1)["end"], F.lit(0))
    parts = F.transform(spans, lambda s, i: F.concat(F.substring(text, before(i) + 1, s["start"] - before(i)), name(s)))
    last = F.coalesce(F.get(spans, F.size(spans) - 1)["end"], F.lit(0))
    return F.when(F.size(spans) > 0, F.concat(F.array_join(parts, ""), F.substring(text, last + 1, F.length(text)))).otherwise(text)


def hide_terms(text: Column, terms: list[str], first: int = 1) -> Column:
    """Extra terms in any case become [СКРЫТО_n], from ``first`` on, outside placeholders; a repeated term keeps its number."""
    for n, term in enumerate(dict.fromkeys(t for t in terms if t), first):
        pattern = F.concat(F.lit("(?iu)"), quoted(F.lit(term)), F.lit(r"(?![^\[\]]*_\d+\])"))
        text = F.regexp_replace(text, pattern, F.lit(f"[{P.HIDDEN}_{n}]"))
    return text


def restore(text: Column, holders: Column) -> Column:
    """Placeholders back to values, in mapping order."""
    return F.aggregate(holders, text, lambda t, h: F.replace(t, h["placeholder"], h["value"]))
