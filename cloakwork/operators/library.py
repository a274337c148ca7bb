"""The persistent library: the first pseudonym, coefficient or verdict that is stored for a key stays."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {"text": "norm_key string, pseudonym string", "numeric": "col string, coefficient double", "columns": "col string", "verdicts": "col string, verdict string"}


class Library:
    """Tables in ``path``.  Each save carries its time and a random number; of two that store a key at once the earlier counts, for every reader."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def read(self, table: str) -> DataFrame:
        """A table; empty where nothing has been stored."""
        schema = SCHEMAS[table]
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(f"{schema}, saved string").parquet(f"{self.path}/{table}")
        key, *others = [c for c in rows.columns if c != "saved"]
        return rows.groupBy(key).agg(*[F.min_by(c, F.struct("saved", c)).alias(c) for c in others]) if others else rows.select(key).distinct()

    def save(self, table: str, rows: DataFrame) -> None:
        """Store the keys that are new."""
        saved = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
        upsert(self.read(table), rows, SCHEMAS[table].split()[0]).withColumn("saved", F.lit(saved)).write.mode("append").parquet(f"{self.path}/{table}")

    def save_text(self, rows: DataFrame, columns: list[str]) -> None:
        """Store pseudonyms, and log the columns that they come from."""
        self.save("text", rows.filter("norm_key IS NOT NULL AND pseudonym IS NOT NULL"))
        if columns:
            self.save("columns", self.spark.createDataFrame([(c,) for c in columns], SCHEMAS["columns"]))

    def lookup(self, table: str, keys: DataFrame) -> DataFrame:
        """The stored rows of ``keys`` (a table whose first column is the key)."""
        key = SCHEMAS[table].split()[0]
        return self.read(table).join(keys.select(F.col(keys.columns[0]).alias(key)).distinct(), key, "left_semi")


def upsert(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows to append: new keys only, the least row of each."""
    others = [c for c in new.columns if c != key]
    first = new.groupBy(key).agg(F.min(F.struct(*others)).alias("r")).select(key, "r.*") if others else new.distinct()
    return first.join(existing.select(key), key, "left_anti").select(new.columns)


def fuzzy_candidates(values: DataFrame, known: DataFrame, threshold: int = 85) -> DataFrame:
    """(value, best, score): the most similar stored key of each value, by Indel ratio of sorted words, at least ``threshold``.

    The ratio is 100 * 2 * LCS / (both lengths).  Every pair whose lengths allow the threshold (a ratio r
    needs lengths within (2 - r) / r) is screened by edit distance, which never exceeds the Indel
    distance, so no match is lost; what remains is scored by its longest common subsequence.
    """
    sort = lambda c: F.array_join(F.array_sort(F.split(c, " ")), " ")
    a = values.select("value", sort(F.col("value")).alias("x")).withColumn("n", F.length("x"))
    b = known.select(F.col("norm_key").alias("best"), sort(F.col("norm_key")).alias("y")).withColumn("m", F.length("y"))
    total = F.col("n") + F.col("m")
    room = F.floor(total * (100 - threshold) / 100).cast("int")
    longest = F.floor(F.col("n") * (200 - threshold) / max(threshold, 1)).cast("int")
    shortest = F.ceil(F.col("n") * threshold / (200 - threshold)).cast("int")
    a = a.withColumn("m", F.explode(F.sequence(F.least(shortest, longest), longest)))  # lengths that can match: an equi-join
    near = a.join(b, "m").filter(F.abs(F.col("n") - F.col("m")) <= room).filter(F.levenshtein("x", "y") <= room)
    near = near.withColumn("score", F.when(total == 0, 100.0).otherwise(F.round(200 * common_length(F.col("x"), F.col("y")) / total, 6)))
    return near.filter(F.col("score") >= threshold).groupBy("value").agg(F.max_by("best", F.struct("score", "best")).alias("best"), F.max("score").alias("score"))


def common_length(x: Column, y: Column) -> Column:
    """Length of the longest common subsequence of two texts, row by row of the usual table."""
    chars = lambda c: F.filter(F.split(c, ""), lambda ch: ch != "")
    xs, ys = chars(x), chars(y)
    zeros = F.transform(F.sequence(F.lit(0), F.size(ys)), lambda i: F.lit(0))

    def line(above: Column, ch: Column) -> Column:
        cell = lambda row, i: F.concat(row, F.array(F.when(F.get(ys, i) == ch, F.get(above, i) + 1).otherwise(F.greatest(F.get(above, i + 1), F.get(row, i)))))
        steps = F.filter(F.sequence(F.lit(0), F.size(ys)), lambda i: i < F.size(ys))
        return F.aggregate(steps, F.array(F.lit(0)), cell)

    return F.element_at(F.aggregate(xs, zeros, line), -1)
