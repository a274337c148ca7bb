"""Quality rules: fixed base rules and a hashed n-gram log-likelihood ratio, in DataFrame functions only.

Words and word pairs are hashed into ``buckets``.  Two multinomials over the buckets are counted, one
over a trusted target (documents labelled as good) and one over the whole raw corpus, and smoothed.
A document's score is the mean over its n-grams of log(target share / raw share); it is kept where
its score reaches ``threshold`` and no base rule rejects it.  Every document gets a score and the
same text always gets the same verdict.

One pass over the text counts, one scores.  The counts are grouped by bucket (partial sums of at most
``buckets`` rows leave a task); the table of ratios reaches the scorer as one constant array of
``buckets`` doubles.  The target covers every trusted document: rows meet the distinct trusted ids by
a merge join at every size, which shuffles the texts once and broadcasts nothing that grows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = "\t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8


def words_of(text: Column) -> Column:
    """Runs of other characters than the six ASCII white-space characters."""
    for c in SPACES:  # replace() works on bytes and split() by one plain character needs no regular expression
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def ngram_buckets(words: Column, buckets: int) -> Column:
    """Bucket of each word and of each pair of neighbours."""
    mask = F.lit(buckets - 1).cast("long")
    one = F.transform(words, lambda w: F.xxhash64(w).bitwiseAND(mask).cast("int"))
    after = F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1)))
    two = F.filter(F.zip_with(words, after, lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b).bitwiseAND(mask).cast("int"))), lambda h: h.isNotNull())
    return F.concat(one, two)


def repeated_words(docs: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words inside 8-word windows that the text holds twice or more.

    Windows are hashed; where no hash occurs twice nothing more is done.  Otherwise (hash, position)
    pairs are sorted, those with an equal neighbour are repeats, and the union of their ranges is
    summed from the sorted positions.
    """
    last = F.size("words") - WINDOW
    hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get("word_hashes", i + k) for k in range(WINDOW)]))
    docs = docs.withColumn("word_hashes", F.transform("words", lambda w: F.xxhash64(w)))
    docs = docs.withColumn("window_hashes", F.when(last >= 1, hashes))
    unique = F.size(F.array_distinct("window_hashes")) == F.size("window_hashes")
    pairs = F.array_sort(F.transform("window_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    docs = docs.withColumn("window_pairs", F.when(F.col("window_hashes").isNotNull() & ~unique, pairs))
    same = lambda i, j: F.get("window_pairs", i)["h"] == F.get("window_pairs", j)["h"]
    at = F.array_sort(F.transform(F.filter("window_pairs", lambda p, k: F.coalesce((k > 0) & same(k - 1, k), F.lit(False)) | F.coalesce(same(k, k + 1), F.lit(False))), lambda p: p["i"]))
    docs = docs.withColumn("repeat_at", at)
    gaps = F.zip_with("repeat_at", F.slice("repeat_at", F.lit(2), F.greatest(F.size("repeat_at"), F.lit(1))), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    total = F.aggregate(gaps, F.lit(0), lambda s, g: s + g)
    return docs.withColumn("n_repeat_words", F.coalesce(total, F.lit(0)).cast("long")).drop("word_hashes", "window_hashes", "window_pairs", "repeat_at")


def base_rules(docs: DataFrame) -> DataFrame:
    """doc_id, text, words and the base figures of every row (a null text has no words)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("words", words_of(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^ \t\x0B\f\r]"))
    plain = F.col("text")
    for c in SYMBOLS:
        plain = F.replace(plain, F.lit(c), F.lit(""))
    out = out.withColumn("n_words", F.size("words").cast("long"))
    out = out.withColumn("word_chars", F.length(F.array_join("words", "")).cast("long"))
    out = out.withColumn("n_symbols", (F.length("text") - F.length(plain)).cast("long"))
    out = out.withColumn("lines", lines).withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).drop("lines", "text")
    out = repeated_words(out)
    return out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of all documents labelled as good."""
    return labels.filter("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()


def ratios(docs: DataFrame, labels: DataFrame, *, buckets: int, smoothing: float) -> DataFrame:
    """One row: ``ratio``, an array of log(target share / raw share) by bucket."""
    trusted = trusted_ids(labels).withColumn("trusted", F.lit(1)).hint("merge")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(trusted, "doc_id", "left")
    rows = rows.select("trusted", words_of(F.col("text")).alias("words"))  # after the join: texts are smaller than their words
    grams = rows.select(F.coalesce("trusted", F.lit(0)).alias("trusted"), F.explode(ngram_buckets(F.col("words"), buckets)).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("trusted").alias("target"))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left")
    whole = every.agg(F.sort_array(F.collect_list(F.struct("bucket", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target")))).alias("by"), F.sum("raw").alias("raws"), F.sum("target").alias("targets"))
    share = lambda n, total: (n + smoothing) / (F.coalesce(total, F.lit(0)) + smoothing * buckets)
    return whole.select(F.transform("by", lambda c: F.log(share(c["target"], F.col("targets"))) - F.log(share(c["raw"], F.col("raws")))).alias("ratio"))


def quality_verdicts(docs: DataFrame, labels: DataFrame, *, buckets: int = 1 << 14, smoothing: float = 1.0, threshold: float = -0.05) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept for every row.

    A null or empty text has no words: its counts are 0, its score is 0 and the base rules reject it.
    Repeated rows are judged one by one, texts of any length whole; equal texts get equal scores, and one at the threshold is kept.  Without trusted documents all
    ratios are those of an even target.  Other columns are ignored.
    """
    found = ratios(docs, labels, buckets=buckets, smoothing=smoothing).select(F.to_json("ratio")).first()[0]
    ratio = F.from_json(F.lit(found), "array<double>")  # folded to one constant array
    out = base_rules(docs).withColumn("grams", ngram_buckets(F.col("words"), buckets))
    total = F.aggregate("grams", F.lit(0.0), lambda s, g: s + F.get(ratio, g))
    out = out.withColumn("score", F.when(F.size("grams") > 0, total / F.size("grams")).otherwise(F.lit(0.0)))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", (~F.col("base_failed") & (F.col("score") >= threshold)).alias("kept"))
