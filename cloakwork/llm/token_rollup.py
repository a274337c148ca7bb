"""Delta-maintained token counts by source, language and tokenizer version.

A ledger folder holds, for every committed batch, its signed per-document entries and the signed
rollup that they add up to::

    entries/batch=<id>   doc_id, source, lang, tokenizer, n_tokens, n_docs   (signed)
    deltas/batch=<id>    source, lang, tokenizer, n_tokens, n_docs           (signed sums)
    changes/batch=<id>   the batch itself, one row for each document and tokenizer version
    commits/<id>         an empty file, made last and in one step: a batch without it does not count

An insert adds the document's counts, a delete subtracts what the ledger holds for it, a revision does
both.  Totals are sums of the committed deltas, so a batch costs its own rows and the entries in the
``buckets`` that its documents fall into (entries are stored by a hash of the document), never a recount.
``compact`` replaces all entries and deltas so far by what they add up to, so that the ledger grows with its
documents, not with its history.  Committing a batch id again changes nothing; a batch whose
commit was lost halfway is written over.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.llm.quality import words_of

ENTRY = "doc_id long, source string, lang string, tokenizer string, n_tokens long, n_docs long"
DELTA = "source string, lang string, tokenizer string, n_tokens long, n_docs long"
KEYS = ["source", "lang", "tokenizer"]
#: How the names of compactions begin.
COMPACT = "_all-"

#: Rule-based tokenizers by version: whitespace words, and runs of digits, Latin letters and characters beyond ASCII.
TOKENIZERS = {
    "space-1": lambda text: F.size(words_of(text)),
    "alnum-1": lambda text: F.regexp_count(text, F.lit(r"[\p{Alnum}\x{80}-\x{10FFFF}]+")),
}


def count_tokens(docs: DataFrame, tokenizers: dict | None = None) -> DataFrame:
    """One row for each row and tokenizer version: doc_id, source, lang, tokenizer, n_tokens (0 for a null text)."""
    text: Column = F.coalesce(F.col("text").cast("string"), F.lit(""))
    counts = [F.struct(F.lit(v).alias("tokenizer"), f(text).cast("long").alias("n_tokens")) for v, f in (tokenizers or TOKENIZERS).items()]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.inline(F.array(*counts)))


def count_bpe_tokens(docs: DataFrame, ranks: str, version: str) -> DataFrame:
    """As count_tokens, by a byte-level BPE vocabulary file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from cloakwork.llm.packing import encoder

        encode, _ = encoder(ranks)
        for b in batches:
            n = [len(encode(t)) if t else 0 for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([version] * b.num_rows), pa.array(n, pa.int64())], ["doc_id", "source", "lang", "tokenizer", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, source string, lang string, tokenizer string, n_tokens long")


class TokenLedger:
    """Token totals in ``path``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 32):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _store(self, path: str):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def batches(self) -> list[str]:
        """Names of the committed batches that count (one a batch), those that a compaction holds left out."""
        store, path = self._store(f"{self.path}/commits")
        names = sorted(x.getPath().getName() for x in store.listStatus(path)) if store.exists(path) else []
        held = [n for n in names if n.startswith(COMPACT)]
        return [n for n in names if not n.startswith(COMPACT) and not any(n in self._held(h) for h in held)] + held[-1:]

    def _held(self, name: str) -> set[str]:
        return {r[0] for r in self.spark.read.schema("batch string").parquet(f"{self.path}/held/batch={name}").collect()}

    def committed(self, batch: str) -> bool:
        store, path = self._store(f"{self.path}/commits/{batch}")
        return store.exists(path)

    def _mark(self, batch: str) -> None:
        store, path = self._store(f"{self.path}/commits/{batch}")
        store.create(path, True).close()

    def _read(self, kind: str, schema: str, known: list[str]) -> DataFrame:
        """Rows of these batches."""
        if not known:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{kind}").parquet(*[f"{self.path}/{kind}/batch={b}" for b in known])

    def entries(self) -> DataFrame:
        return self._read("entries", ENTRY, self.batches()).drop("bucket")

    def current(self, entries: DataFrame | None = None) -> DataFrame:
        """What the ledger holds for each document and tokenizer version."""
        sums = (entries or self.entries()).groupBy("doc_id", *KEYS).agg(F.sum("n_tokens").alias("n_tokens"), F.sum("n_docs").alias("n_docs"))
        return sums.filter("n_docs != 0 OR n_tokens != 0")

    def totals(self) -> DataFrame:
        sums = self._read("deltas", DELTA, self.batches()).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.filter("n_docs != 0 OR n_tokens != 0")

    def _write(self, batch: str, rows: DataFrame) -> None:
        bucket = F.pmod(F.xxhash64("doc_id"), F.lit(self.buckets)).cast("int")
        rows.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/entries/batch={batch}")
        back = self._read("entries", ENTRY, [batch])
        back.groupBy(*KEYS).agg(F.sum("n_tokens").alias("n_tokens"), F.sum("n_docs").alias("n_docs")).write.mode("overwrite").parquet(f"{self.path}/deltas/batch={batch}")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply a batch: rows (op, doc_id, source, lang, tokenizer, n_tokens), op insert, delete or revise.

        Of several rows for one document and tokenizer the largest (op, source, lang, n_tokens) counts.
        An insert or revision replaces what the ledger holds; a delete of an unknown document changes
        nothing (its other columns are not read).  Rows without doc_id or tokenizer are ignored; a
        null source or language is a group of its own; other columns are ignored; an empty batch commits
        and changes nothing.  Texts reach the ledger as counts only, however long.  One writer at a time.
        Returns False where the batch was known.
        """
        if batch.startswith(COMPACT) or "/" in batch or not batch:
            raise ValueError(f"no name for a batch: {batch}")
        if self.committed(batch):
            return False
        rank = F.struct("op", "source", "lang", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"))
        known = changes.filter("doc_id IS NOT NULL AND tokenizer IS NOT NULL AND op IN ('insert', 'delete', 'revise')")
        last = known.groupBy(F.col("doc_id").cast("long").alias("doc_id"), "tokenizer").agg(F.max(rank).alias("new")).select("doc_id", "tokenizer", "new.*")
        place = f"{self.path}/changes/batch={batch}"
        last.write.mode("overwrite").parquet(place)  # read twice below: what the batch counted isn't counted again
        last = self.spark.read.schema(last.schema).parquet(place)
        added = last.filter("op != 'delete'").select("doc_id", *KEYS, "n_tokens", F.lit(1).cast("long").alias("n_docs"))
        signed = added
        before = self.batches()
        if before:
            bucket = F.pmod(F.xxhash64("doc_id"), F.lit(self.buckets)).cast("int")
            touched = [r[0] for r in last.select(bucket.alias("bucket")).distinct().collect()]  # ``buckets`` numbers at most
            old = self._read("entries", f"{ENTRY}, bucket int", before).filter(F.col("bucket").isin(touched)).drop("bucket")
            old = self.current(old).join(last.select("doc_id", "tokenizer"), ["doc_id", "tokenizer"], "left_semi")
            signed = added.unionByName(old.select("doc_id", *KEYS, (-F.col("n_tokens")).alias("n_tokens"), (-F.col("n_docs")).alias("n_docs")))
        self._write(batch, signed)
        self._mark(batch)
        return True

    def compact(self) -> None:
        """Put what all committed batches add up to in their place (their names stay known)."""
        before = self.batches()
        name = f"{COMPACT}{len(before):08d}-{uuid.uuid4().hex}" if not (old := [b for b in before if b.startswith(COMPACT)]) else f"{COMPACT}{int(old[-1][len(COMPACT):].split('-')[0]) + 1:08d}-{uuid.uuid4().hex}"
        held = set(before).union(*[self._held(o) for o in old]) if old else set(before)
        self.spark.createDataFrame([(b,) for b in sorted(held)], "batch string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/held/batch={name}")
        self._write(name, self.current().select("doc_id", *KEYS, "n_tokens", "n_docs"))
        self._mark(name)
