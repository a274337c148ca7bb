"""Recognised pages of documents as one text, Markdown or JSON per document, and the test for scanned documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Page headings and separators of the two text forms.
TXT_HEAD, TXT_BETWEEN = ("--- Страница ", " ---\n"), "\n\n"
MD_HEAD, MD_BETWEEN = ("## Страница ", "\n\n"), "\n\n---\n\n"
#: Fixed value: a document with fewer characters besides white space counts as scanned.
LEAST_CHARS = 50


def _joined(pages: Column, head: tuple[str, str], between: str) -> Column:
    return F.array_join(F.transform(pages, lambda p: F.concat(F.lit(head[0]), p["page"].cast("string"), F.lit(head[1]), p["text"])), between)


def bind_pages(pages: DataFrame, key: str = "path") -> DataFrame:
    """(key, txt, md, json) per document, pages in order of ``page``; a null text is empty.  The JSON has no line breaks."""
    rows = pages.filter("page IS NOT NULL").select(key, F.struct(F.col("page").cast("int").alias("page"), F.coalesce("text", F.lit("")).alias("text")).alias("p"))
    bound = rows.groupBy(key).agg(F.array_sort(F.collect_list("p")).alias("pages"))
    whole = F.to_json(F.struct(F.size("pages").alias("total_pages"), F.col("pages")))
    return bound.select(key, _joined(F.col("pages"), TXT_HEAD, TXT_BETWEEN).alias("txt"), _joined(F.col("pages"), MD_HEAD, MD_BETWEEN).alias("md"), whole.alias("json"))


def looks_scanned(text: Column) -> Column:
    """Whether a converted document has hardly any text; a null has none."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s", "")) < LEAST_CHARS
