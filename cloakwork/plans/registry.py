"""The table of registered queries and of their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Q = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Q] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Q) -> Q:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def label_sql(n: str) -> str:
    """Bijective base 26 of a positive number below 18279, in SQL."""
    return f"(CASE WHEN {n} > 702 THEN chr(CAST(65 + (({n} - 703) // 676) % 26 AS INTEGER)) ELSE '' END || CASE WHEN {n} > 26 THEN chr(CAST(65 + (({n} - 27) // 26) % 26 AS INTEGER)) ELSE '' END || chr(CAST(65 + ({n} - 1) % 26 AS INTEGER)))"


def offsets_sql(source: str, key: str, pattern: str) -> str:
    """SQL of all matches of a pattern without groups: key, start, end, value."""
    return rf"""
SELECT {key}, CAST(list_sum(list_transform(g[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda z: length(z))), 0) AS INTEGER) AS start,
       CAST(list_sum(list_transform(g[1:i], lambda z: length(z))) + list_sum(list_transform(m[1:i], lambda z: length(z))) AS INTEGER) AS "end", m[i] AS value
FROM (SELECT {key}, m, g, unnest(range(1, len(m) + 1)) AS i
      FROM (SELECT {key}, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS g FROM {source}) WHERE len(m) > 0)
"""
