"""Pseudonyms for text columns and coefficients for numeric ones, over a workbook of tables, and the way back."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakwork.functions.fakes import fake
from cloakwork.functions.normalize import composed, derive_prefix, index_label, library_key, norm_key, norm_original
from cloakwork.functions.spans import person_like
from cloakwork.sources.shared import written

#: Positions of one table that are numbered by one task.
RANGE_BITS = 20


def scale(value: Column, k: Column | float, integer: bool) -> Column:
    """Times the coefficient; half to even, to whole numbers or two decimals."""
    k = F.lit(k) if isinstance(k, int | float) else k
    return F.rint(value * k).cast("long") if integer else F.rint(value * k * 100) / 100


def unscale(value: Column, k: Column | float, integer: bool) -> Column:
    k = F.lit(k) if isinstance(k, int | float) else k
    return F.rint(value / k).cast("long") if integer else F.rint(value / k * 100) / 100


def coefficient(column: str, seed: str) -> float:
    """A number in [0.5, 1.5) for a column name, the same in every run with this seed (a secret: who knows it can undo the masking)."""
    return 0.5 + int.from_bytes(hashlib.sha256(f"{seed}:{column}".encode()).digest()[:8], "big") / 2**64


def numeric_mapping(config: dict[str, dict[str, str]], seed: str, known: dict[str, float] | None = None) -> dict[tuple[str, str], float]:
    """A coefficient for each (table, numeric column): one for each column name, the library's first."""
    return {(s, c): (known or {}).get(c, coefficient(c, seed)) for s, columns in config.items() for c, kind in columns.items() if kind == "numeric"}


def values_of(sheets: dict[str, DataFrame], config: dict[str, dict[str, str]], order: dict[str, str]) -> DataFrame:
    """(value, prefix, pos) of the text cells that the configuration names; unknown tables and columns are skipped."""
    parts = []
    for i, (sheet, columns) in enumerate(config.items()):
        for j, (column, kind) in enumerate(columns.items()):
            if kind == "text" and sheet in sheets and column in sheets[sheet].columns:
                pos = F.struct(F.lit(i).alias("sheet"), F.lit(j).alias("col"), F.col(order[sheet]).cast("long").alias("row"))
                parts.append(sheets[sheet].select(F.col(column).cast("string").alias("value"), F.lit(derive_prefix(column)).alias("prefix"), pos.alias("pos")).filter("value IS NOT NULL"))
    return reduce(DataFrame.unionByName, parts)


def numbered(firsts: DataFrame) -> DataFrame:
    """Adds ``ordinal``: 1, 2 .. by ``pos`` within each prefix.

    Positions are numbered in ranges of 2**RANGE_BITS rows of a column, each by its own task; what lies before a
    range is added from a table with one row for each range.
    """
    part = ["prefix", "sheet", "col", "range"]
    rows = firsts.withColumns({"sheet": F.col("pos.sheet"), "col": F.col("pos.col"), "range": F.shiftright("pos.row", RANGE_BITS)})
    sizes = rows.groupBy(*part).agg(F.count(F.lit(1)).alias("size"))
    before = Window.partitionBy("prefix").orderBy("sheet", "col", "range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0))).drop("size")
    same = reduce(lambda a, b: a & b, [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in part])
    met = rows.alias("r").join(starts.alias("s"), same).select("r.*", "s.start")
    own = F.row_number().over(Window.partitionBy(*part).orderBy("pos.row"))
    return met.withColumn("ordinal", (F.col("start") + own).cast("int")).drop("sheet", "col", "range", "start")


def text_mapping(values: DataFrame, known: DataFrame | None = None, groups: DataFrame | None = None, categories: dict[str, str] | None = None) -> DataFrame:
    """(norm_key, original, pseudonym, prefix, ordinal): one row for each distinct key, numbered by first appearance.

    Distinct values are found by partial aggregation; only they are composed (NFC), resolved and numbered.  Keys that
    agree once composed share a pseudonym, as does a value with its canonical form in ``groups`` (value, canonical).
    ``known`` (norm_key, pseudonym), the library, takes precedence and uses up no ordinal.  ``categories`` names for a
    prefix the category whose fakes stand in for "Prefix A".
    """
    keyed = values.select(norm_key(F.col("value")).alias("norm_key"), "value", "prefix", "pos")
    firsts = keyed.groupBy("norm_key").agg(F.min(F.struct("pos", "value", "prefix")).alias("f")).select("norm_key", norm_original(F.col("f.value")).alias("original"), "f.prefix", "f.pos")
    firsts = composed(firsts, "norm_key", "entity")
    if groups is not None:
        to = composed(groups.select(norm_key(F.col("value")).alias("k"), norm_key(F.col("canonical")).alias("c")), "c", "canonical").select("k", "canonical").distinct()
        firsts = firsts.join(to, firsts["norm_key"] == to["k"], "left").withColumn("entity", F.coalesce("canonical", "entity")).drop("k", "canonical")
    if known is not None:
        old = known.select(F.col("norm_key").alias("known_key"), F.col("pseudonym").alias("known_name"))
        firsts = firsts.join(old, F.col("entity") == F.col("known_key"), "left").drop("known_key")
        firsts = firsts.withColumn("known_name", F.coalesce("known_name", F.lit(None).cast("string")))
    else:
        firsts = firsts.withColumn("known_name", F.lit(None).cast("string"))
    entities = firsts.filter("known_name IS NULL").groupBy("entity").agg(F.min(F.struct("pos", "prefix")).alias("f")).select("entity", "f.prefix", "f.pos")
    names = numbered(entities)
    label = F.concat_ws(" ", "prefix", index_label(F.col("ordinal")))
    for prefix, category in (categories or {}).items():
        label = F.when(F.col("prefix") == prefix, fake(category, F.col("ordinal"))).otherwise(label)
    names = names.select("entity", F.col("prefix").alias("entity_prefix"), "ordinal", label.alias("name"))
    out = firsts.join(names, "entity", "left")
    return out.select("norm_key", "original", F.coalesce("known_name", "name").alias("pseudonym"), F.coalesce("entity_prefix", "prefix").alias("prefix"), "ordinal")


def mask_text(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """Looks a column up; unmapped values and nulls stay.  Spark chooses the join by the mapping's size."""
    small = mapping.select(F.col("norm_key").alias("__key"), F.col("pseudonym").alias("__to"))
    out = df.join(small, norm_key(F.col(column).cast("string")) == F.col("__key"), "left")
    return out.withColumn(column, F.coalesce("__to", F.col(column).cast("string"))).drop("__key", "__to")


def unmask_text(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """Pseudonyms back to originals; of originals that share one, the last counts."""
    back = mapping.groupBy(F.col("pseudonym").alias("__from")).agg(F.max_by("original", F.struct(F.coalesce("ordinal", F.lit(0)), "original")).alias("__to"))
    out = df.join(back, F.col(column).cast("string") == F.col("__from"), "left")
    return out.withColumn(column, F.coalesce("__to", F.col(column).cast("string"))).drop("__from", "__to")


def _integer(df: DataFrame, column: str) -> bool:
    return "int" in df.schema[column].dataType.simpleString()


def mask_workbook(sheets: dict[str, DataFrame], config: dict[str, dict[str, str]], order: dict[str, str], seed: str, *, library=None, group_people: bool = True, categories: dict[str, str] | None = None, fuzzy: int | None = None) -> tuple[dict[str, DataFrame], DataFrame, dict[tuple[str, str], float]]:
    """(masked tables, text mapping, numeric mapping): one mapping for all tables, written once; column order is kept.

    ``library`` (see operators.library) gives what earlier runs stored and stores what is new; ``fuzzy`` lets its keys
    match from that similarity on; ``group_people`` resolves spellings that share a surname; ``categories`` as text_mapping.
    """
    values = values_of(sheets, config, order)
    groups = surname_groups(values.select("value", F.struct("pos.sheet", "pos.col", "pos.row").alias("pos"))) if group_people else None
    known = None if library is None else resolve_library(values, library.read("text"), fuzzy)
    mapping = written(text_mapping(values, known, groups, categories), "mapping")
    stored = {} if library is None else {r[0]: r[1] for r in library.read("numeric").collect()}  # one row a column name
    numeric = numeric_mapping(config, seed, stored)
    if library is not None:
        spark = mapping.sparkSession
        columns = sorted({c for cs in config.values() for c, kind in cs.items() if kind == "text"})
        library.save_text(mapping.select(library_key(F.col("original")).alias("norm_key"), "pseudonym"), columns)
        if numeric:
            library.save("numeric", spark.createDataFrame(sorted({(c, k) for (_, c), k in numeric.items()}), "col string, coefficient double"))
    out = {}
    for sheet, df in sheets.items():
        names = df.columns
        for column, kind in config.get(sheet, {}).items():
            if column not in names:
                continue
            if kind == "text":
                df = mask_text(df, column, mapping)
            else:
                df = df.withColumn(column, scale(F.col(column), numeric[sheet, column], _integer(df, column)))
        out[sheet] = df.select(names)
    return out, mapping, numeric


def resolve_library(values: DataFrame, stored: DataFrame, fuzzy: int | None = None) -> DataFrame:
    """(norm_key, pseudonym) of the values that the library knows, by its own key or, from ``fuzzy`` on, by similarity."""
    from cloakwork.operators.library import fuzzy_candidates

    keys = values.select(norm_key(F.col("value")).alias("k"), library_key(F.col("value")).alias("value")).distinct()
    found = keys.join(stored, F.col("value") == F.col("norm_key")).select(F.col("k").alias("norm_key"), "pseudonym")
    if fuzzy is not None:
        rest = keys.join(found.select(F.col("norm_key").alias("k")), "k", "left_anti")
        near = fuzzy_candidates(rest.select("value").distinct(), stored, fuzzy)
        more = rest.join(near, "value").join(stored, F.col("best") == F.col("norm_key")).select(F.col("k").alias("norm_key"), "pseudonym")
        found = found.unionByName(more)
    return composed(found, "norm_key", "entity").groupBy(F.col("entity").alias("norm_key")).agg(F.min("pseudonym").alias("pseudonym"))


def unmask_workbook(sheets: dict[str, DataFrame], mapping: DataFrame, numeric: dict[tuple[str, str], float]) -> dict[str, DataFrame]:
    """Tables back: numeric columns by (table, column); a table that no key names is taken by column name; text columns by pseudonym."""
    named = {s for s, _ in numeric}
    by_name = {c: k for (_, c), k in numeric.items()}
    out = {}
    for sheet, df in sheets.items():
        names = df.columns
        for column in names:
            k = numeric.get((sheet, column), None if sheet in named else by_name.get(column))
            if k is not None:
                df = df.withColumn(column, unscale(F.col(column), k, _integer(df, column)))
            elif df.schema[column].dataType.simpleString() == "string":  # masked cells are text
                df = unmask_text(df, column, mapping)
        out[sheet] = df.select(names)
    return out


def total_rows(sheets: dict[str, DataFrame]) -> DataFrame:
    """(rows): over all tables."""
    return reduce(DataFrame.unionAll, [df.agg(F.count(F.lit(1)).alias("rows")) for df in sheets.values()]).agg(F.sum("rows").alias("rows"))


def mask_stats(sheets: dict[str, DataFrame], config: dict[str, dict[str, str]], mapping: DataFrame) -> DataFrame:
    """One row: masked cells (not null, configured and present) and distinct originals."""
    cells = [sheets[s].agg(*[F.count(c).alias(c) for c in cols if c in sheets[s].columns]).select(sum((F.col(c) for c in cols if c in sheets[s].columns), F.lit(0)).cast("long").alias("n"), F.lit(0).cast("long").alias("e")) for s, cols in config.items() if s in sheets]
    both = reduce(DataFrame.unionAll, [*cells, mapping.agg(F.lit(0).cast("long").alias("n"), F.count(F.lit(1)).alias("e"))])
    return both.agg(F.sum("n").alias("masked_values"), F.sum("e").alias("unique_entities"))


def last_name(value: Column) -> Column:
    """The first of two or more words if it begins with a Cyrillic capital, in lower case; else null."""
    return F.when((F.size(F.split(F.trim(value), r"\s+")) >= 2) & person_like(value), F.nullif(F.lower(F.regexp_extract(value, r"^\s*([А-ЯЁ][А-Яа-яЁё\-]*)\s", 1)), F.lit("")))


def longest_of_groups(values: DataFrame, key: str) -> DataFrame:
    """(value, canonical) of different values that share ``key``; canonical: the longest, the first (by ``pos``) on a tie."""
    named = values.filter(F.col(key).isNotNull()).groupBy(key, "value").agg(F.min("pos").alias("pos"))
    most = named.groupBy(key).agg(F.max(F.length("value")).alias("most"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    best = named.join(most, key).filter(F.length("value") == F.col("most")).groupBy(key).agg(F.min_by("value", "pos").alias("canonical"))
    return named.join(best, key).filter("value != canonical").select("value", "canonical")


def surname_groups(values: DataFrame) -> DataFrame:
    """(value, canonical) of values (value, pos) that share a surname."""
    return longest_of_groups(values.withColumn("surname", last_name(F.col("value"))), "surname")
