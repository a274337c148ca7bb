"""Corpus pipeline: toxicity, near duplicates, repeated passages, benchmark passages, packing.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which
is written as Parquet and read again as the next stage's ``docs``.  All but the last return the columns
of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.llm import decontaminate, jaccard_join, packing, substring_dedup, toxicity
from cloakwork.llm.shared import shared_folder

#: The toxicity stage is a trained model, which SQL cannot express.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model rejects go; it learns from labelled documents outside the held-out fold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    machine = toxicity.train(toxicity.training_rows(docs, labels, toxic_rows=1500, clean_rows=3000))
    return toxicity.drop_toxic(docs, machine)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays."""
    return jaccard_join.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go from the texts; a text without any stays as it is."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    found = substring_dedup.remove_repeats(docs, carry=rest)
    text = F.when(F.col("n_removed") > 0, F.col("kept").cast("string")).otherwise(F.col("text").cast("string"))
    new = {"text": text, "n_chars": F.when(F.col("n_removed") > 0, F.length(text).cast("long")).otherwise(F.col("rest.n_chars"))}
    return found.select(*[(F.col("doc_id") if c == "doc_id" else new.get(c, F.col(f"rest.{c}"))).alias(c) for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too much of a test item go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
