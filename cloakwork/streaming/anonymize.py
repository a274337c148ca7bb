"""Anonymising documents, in batches or as a stream (each document stands alone, so both are the same plan)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.functions import spans as S


def detect_entities(docs: DataFrame, name: str = "spans", labels: list[str] | None = None, identity: bool = False, text_col: str = "text", *, scanner: bool = False, recognised: Column | None = None, expand: bool = True) -> DataFrame:
    """Adds the merged spans of a text: detectors, a model's (``recognised``), the scanner's, further mentions of
    organisations; less common words; merged; then those of ``labels``.  What is found is a column between the steps, so
    that no step searches again."""
    text = F.col(text_col)
    found = S.detect(text, identity)
    if recognised is not None:
        found = F.concat(found, F.coalesce(recognised, F.array().cast(f"array<{S.SPAN}>")))
    if scanner:
        found = F.concat(found, S.scan(text))
    out = docs.withColumn(name, found)
    if expand:
        out = out.withColumn(name, S.expand_orgs(text, F.col(name)))
    return out.withColumn(name, S.keep_labels(S.merge(S.postfilter(F.col(name))), labels))


def anonymize(docs: DataFrame, labels: list[str] | None = None, identity: bool = False, text_col: str = "text", *, spans: Column | None = None, names: tuple[str, str, str] = ("spans", "holders", "anonymised"), **options) -> DataFrame:
    """Adds three columns: the spans, the mapping's entries in order, and the rewritten text; a null text stays null.

    ``spans`` are spans found before (not merged); labels then part them before they are merged.  ``names`` are the new
    columns' names; a table that uses one of them is refused.  ``options`` as detect_entities.
    """
    used = [n for n in names if n.lower() in (c.lower() for c in docs.columns)]
    if used:
        raise ValueError(f"the table has columns of these names: {used}")
    found, holders, rewritten = names
    none = F.array().cast(f"array<{S.SPAN}>")
    if spans is None:
        out = detect_entities(docs, found, labels, identity, text_col, **options).withColumn(found, F.coalesce(found, none))
    else:
        out = docs.withColumn(found, F.coalesce(S.merge(S.keep_labels(spans, labels)), none))
    out = out.withColumn(holders, S.placeholders(F.col(found)))
    return out.withColumn(rewritten, S.rewrite(F.col(text_col), F.col(found), F.col(holders)))


def restore(docs: DataFrame, text_col: str = "anonymised", holders_col: str = "holders") -> DataFrame:
    return docs.withColumn("restored", S.restore(F.col(text_col), F.col(holders_col)))


def mapping_rows(docs: DataFrame, key: str, holders_col: str = "holders") -> DataFrame:
    """(key, ord, label, placeholder, value): the mapping as a table."""
    every = docs.select(key, F.posexplode_outer(holders_col).alias("ord", "h")).filter("ord IS NOT NULL")  # outer: see spans.rows
    return every.select(key, "ord", "h.label", "h.placeholder", "h.value")


def label_sizes(spans: DataFrame, shown: int = 5) -> DataFrame:
    """(label, n, n_values, first): spans by label, their different values, and the first values by document and place.

    ``spans``: (doc_id, start, label, value).
    """
    firsts = spans.groupBy("label", "value").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "start")).alias("at"))
    top = F.slice(F.array_sort(F.collect_list(F.struct("at", "value"))), 1, shown)
    out = firsts.groupBy("label").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_values"))
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("label").orderBy("at"))
    least = firsts.withColumn("rank", rank).filter(F.col("rank") <= shown).groupBy("label").agg(top.alias("first"))
    return out.join(least, "label").select("label", "n", "n_values", F.array_join(F.transform("first", lambda x: x["value"]), ", ").alias("first"))
