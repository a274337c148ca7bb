"""Which columns are sensitive, whether they are text or numbers, and what has been decided about them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, NumericType

from cloakwork.functions import patterns as P
from cloakwork.functions.spans import person_like

#: Verdicts in order of weight.
VERDICTS = ("required", "recommended", "safe")


def header_sensitive(name: str) -> bool:
    return any(k in name.lower() for k in P.SENSITIVE_HEADERS)


def column_kind(name: str, data_type: DataType) -> str:
    """numeric for numbers whose header names no identifier; else text (booleans too)."""
    number = isinstance(data_type, NumericType) and not isinstance(data_type, BooleanType)
    return "numeric" if number and not any(k in name.lower() for k in P.IDENTIFIER_HEADERS) else "text"


def masking_kind(name: str, data_type: DataType, numeric_mode: str = "identifier") -> str:
    """What the configuration takes a column as: a number is an identifier (text) unless it is to be scaled (mode coefficient)."""
    if numeric_mode not in ("identifier", "coefficient"):
        raise ValueError(f"no such mode: {numeric_mode}")
    return column_kind(name, data_type) if numeric_mode == "coefficient" else "text"


def header_category(name: str) -> str | None:
    return next((c for c, keys in P.CATEGORY_HEADERS.items() if any(k in name.lower() for k in keys)), None)


def columns_of(tables: dict[str, DataFrame]) -> DataFrame:
    """(sheet, col, pos): every column, from the schemas."""
    rows = [(s, c, i) for s, df in tables.items() for i, c in enumerate(df.columns)]
    return next(iter(tables.values())).sparkSession.createDataFrame(rows, "sheet string, col string, pos int")


def column_types(tables: dict[str, DataFrame]) -> DataFrame:
    """(sheet, col, kind, sensitive) of every column; reads schemas only."""
    rows = [(s, f.name, column_kind(f.name, f.dataType), header_sensitive(f.name)) for s, df in tables.items() for f in df.schema]
    return next(iter(tables.values())).sparkSession.createDataFrame(rows, "sheet string, col string, kind string, sensitive boolean")


def samples(df: DataFrame, column: str, n: int, order: str | None = None) -> DataFrame:
    """(value): n distinct non-null values as text, the first seen by the column ``order``, else the least (both the same in every run)."""
    if order is None:
        return df.select(F.col(column).cast("string").alias("value")).filter("value IS NOT NULL").distinct().orderBy("value").limit(n)
    seen = df.select(F.col(column).cast("string").alias("value"), F.col(order).alias("pos")).filter("value IS NOT NULL")
    return seen.groupBy("value").agg(F.min("pos").alias("pos")).orderBy("pos", "value").limit(n).select("value")


def value_class(value: Column, is_person: Column | None = None) -> Column:
    """The first class that a value matches, person (by a predicate) last; else null."""
    found = F.lit(None).cast("string") if is_person is None else F.when(is_person, "person")
    return reduce(lambda rest, c: F.when(value.rlike(P.VALUE_CLASSES[c]), c).otherwise(rest), reversed(list(P.VALUE_CLASSES)), found)


def category_vote(df: DataFrame, column: str, n: int = 20, least: float = 0.3, order: str | None = None, is_person=None) -> DataFrame:
    """(col, category): the class that most sampled values match, first matching class each; null below the share."""
    classes = [*P.VALUE_CLASSES, "person"]
    votes = samples(df, column, n, order).select(value_class(F.col("value"), None if is_person is None else is_person(F.col("value"))).alias("kind"))
    hits = F.array(*[F.struct(F.count_if(F.col("kind") == c).alias("n"), F.lit(-i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(classes)])
    best = votes.agg(F.array_max(hits).alias("best"), F.count(F.lit(1)).alias("total"))
    return best.select(F.lit(column).alias("col"), F.when((F.col("best.n") > 0) & (F.col("best.n") >= F.col("total") * least), F.col("best.c")).alias("category"))


def detect_category(df: DataFrame, column: str, **options) -> DataFrame:
    """(col, category): by the values, else by the header, else null."""
    return category_vote(df, column, **options).withColumn("category", F.coalesce("category", F.lit(header_category(column))))


def scanner_hit(df: DataFrame, column: str, n: int = 20, order: str | None = None) -> DataFrame:
    """(col, hit): whether any sampled value holds an e-mail, phone or IP."""
    some = [P.FLAGS + p for label, p, _ in P.DETECTORS if label in ("EMAIL", "ТЕЛЕФОН", "IP")]
    hit = reduce(lambda a, b: a | b, [F.col("value").rlike(p) for p in some])
    return samples(df, column, n, order).agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("hit")).select(F.lit(column).alias("col"), "hit")


def looks_like_person(value: Column) -> Column:
    """A stand-in for a person model: two or three words, each with a Cyrillic capital, or a surname with initials."""
    return person_like(value) & value.rlike(r"^\s*[А-ЯЁ][а-яё\-]+(\s+[А-ЯЁ][а-яё\-]+){1,2}\s*$|^\s*[А-ЯЁ][а-яё\-]+\s+[А-ЯЁ]\.\s*([А-ЯЁ]\.)?\s*$")


def person_vote(df: DataFrame, column: str, is_person=looks_like_person, n: int = 10, order: str | None = None) -> DataFrame:
    """(col, hit): whether some and at least half of the sampled values are people, by a predicate on a column (or a model's UDF)."""
    return samples(df, column, n, order).agg(F.avg(is_person(F.col("value")).cast("int")).alias("share")).select(F.lit(column).alias("col"), (F.coalesce("share", F.lit(0.0)) >= 0.5).alias("hit"))


def column_samples(df: DataFrame, column: str, n: int = 3, order: str | None = None) -> DataFrame:
    """(col, sample): the sampled values in order, comma-joined; a dash without any."""
    rows = samples(df, column, n, order)
    numbered = rows.select("value", F.monotonically_increasing_id().alias("i"))  # a limited result is one partition, in order
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "value"))), lambda x: x["value"]), ", ")
    return numbered.agg(F.when(F.count(F.lit(1)) > 0, joined).otherwise("—").alias("sample")).select(F.lit(column).alias("col"), "sample")


def detect_columns(tables: dict[str, DataFrame], known: DataFrame | None = None, is_person=looks_like_person, order: dict[str, str] | None = None) -> DataFrame:
    """(sheet, col, pos, source, required): the sensitive columns.

    A column counts by its header, because earlier runs logged it (``known``: col), because people make up half of its
    sample, or because the scanner finds something in its sample; the last two make it required.  ``source`` is the first
    of these that holds.
    """
    spark = next(iter(tables.values())).sparkSession
    every = columns_of(tables)
    headers = spark.createDataFrame([(s, c) for s, df in tables.items() for c in df.columns if header_sensitive(c)], "sheet string, col string").withColumn("source", F.lit("header"))
    parts = [headers.select("sheet", "col", "source", F.lit(0).alias("rank"))]
    if known is not None:
        parts.append(every.join(known.select("col").distinct(), "col", "left_semi").select("sheet", "col", F.lit("known").alias("source"), F.lit(1).alias("rank")))
    for s, df in tables.items():
        at = (order or {}).get(s)
        for f in df.schema:
            if column_kind(f.name, f.dataType) == "numeric":
                continue
            for name, rank, vote in (("person", 2, person_vote(df, f.name, is_person, order=at)), ("scanner", 3, scanner_hit(df, f.name, order=at))):
                parts.append(vote.filter("hit").select(F.lit(s).alias("sheet"), "col", F.lit(name).alias("source"), F.lit(rank).alias("rank")))
    found = reduce(DataFrame.unionByName, parts).groupBy("sheet", "col").agg(F.min_by("source", "rank").alias("source"), F.max(F.col("rank") >= 2).alias("required"))
    return every.join(found, ["sheet", "col"]).select("sheet", "col", "pos", "source", "required")


def required_columns(detected: DataFrame) -> DataFrame:
    """(sheet, cols): each table's required columns in their order."""
    return detected.filter("required").groupBy("sheet").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "col"))), lambda x: x["col"]).alias("cols"))


def settle_verdicts(columns: DataFrame, cached: DataFrame, model: DataFrame) -> DataFrame:
    """(col, verdict): what is cached, else what the model says, else safe."""
    return columns.join(cached.select("col", F.col("verdict").alias("c")), "col", "left").join(model.select("col", F.col("verdict").alias("m")), "col", "left").select("col", F.coalesce("c", "m", F.lit("safe")).alias("verdict"))


def unknown_columns(columns: DataFrame, cached: DataFrame) -> DataFrame:
    """The columns (sheet, col) that no verdict is stored for: those to ask the model about."""
    return columns.join(cached.select("col").distinct(), "col", "left_anti")


def apply_verdicts(verdicts: DataFrame, scanner: DataFrame | None = None) -> DataFrame:
    """(.., verdict, selected): what the scanner (col) hits is required; required and recommended columns are selected."""
    if scanner is not None:
        hit = scanner.select(F.col("col"), F.lit(True).alias("hit")).distinct()
        verdicts = verdicts.join(hit, "col", "left").withColumn("verdict", F.when(F.col("hit"), "required").otherwise(F.col("verdict"))).drop("hit")
    return verdicts.withColumn("selected", F.col("verdict").isin("required", "recommended"))


def lock_required(choice: DataFrame) -> DataFrame:
    """(.., selected): a required column stays selected whatever the user chose (``chosen``)."""
    return choice.withColumn("selected", F.col("chosen") | (F.col("verdict") == "required"))


def verdicts_to_store(columns: DataFrame, selected: DataFrame, model: DataFrame) -> DataFrame:
    """(col, verdict): a selected column keeps the model's verdict if that asks for masking, else it is required; any other is safe."""
    chosen = selected.select("col", F.lit(True).alias("chosen")).distinct()
    said = model.select("col", F.col("verdict").alias("said"))
    kept = F.when(F.col("said").isin("required", "recommended"), F.col("said")).otherwise("required")
    return columns.select("col").distinct().join(chosen, "col", "left").join(said, "col", "left").select("col", F.when(F.col("chosen"), kept).otherwise("safe").alias("verdict"))


def verdict_counts(verdicts: DataFrame) -> DataFrame:
    """(verdict, n): columns by verdict; an unknown one counts as safe, a missing one as 0."""
    kind = F.when(F.col("verdict").isin("required", "recommended"), F.col("verdict")).otherwise("safe")
    every = verdicts.sparkSession.createDataFrame([(v,) for v in VERDICTS], "verdict string")
    counts = verdicts.groupBy(kind.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))
    return every.join(counts, "verdict", "left").select("verdict", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def column_prompt(tables: dict[str, DataFrame], n: int = 3, order: dict[str, str] | None = None) -> str:
    """The columns and some values of each, as a model is asked about them (a few values a column reach the driver)."""
    parts = []
    for sheet, df in tables.items():
        lines = [f"Лист: {sheet}"]
        for c in df.columns:
            lines.append(f"  - {c}: {column_samples(df, c, n, (order or {}).get(sheet)).first()['sample']}")
        parts.append("\n".join(lines))
    return "\n\n".join(parts)


def no_verdicts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "col string, verdict string")


def first_rows(df: DataFrame, order: str, n: int = 5) -> DataFrame:
    """The first n rows by a key, every column as text."""
    return df.orderBy(order).limit(n).select(*[F.col(c).cast("string").alias(c) for c in df.columns])

