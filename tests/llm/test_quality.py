import math
import random
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from cloakwork.llm import quality, toxicity


def test_target_covers_all_trusted(spark):
    """With every document trusted the target is the corpus: all ratios are 0, however many documents there are."""
    docs = spark.range(20_500).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("w"), F.col("id").cast("string")).alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    assert quality.quality_verdicts(docs, labels).filter(F.abs("score") > 1e-9).count() == 0


def test_scores_equal_brute_force(spark):
    """Scores and verdicts against log ratios counted in plain Python; nulls, repeated rows, ties, clashing names, a long text, an empty table."""
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(40)] + ["é", "#x"]
    rows = [(i, " ".join(rng.choice(vocabulary[: 20 + 22 * (i % 2)]) for _ in range(rng.choice([3, 25, 60])))) for i in range(50)]
    rows += [(50, None), (51, ""), (None, "w1 w2 " * 15), (3, rows[3][1]), (52, " ".join(rng.choice(vocabulary) for _ in range(60_000)))]
    labels = [(i, int(i % 2 == 0)) for i in range(40)] + [(2, 1), (None, 1), (5, None), (999, 1)]
    docs = spark.createDataFrame([(i, x, 1, "k") for i, x in rows], "doc_id long, text string, kept int, words string")
    buckets, smoothing, threshold = 64, 1.0, -0.05

    def grams(text):
        w = [x.encode() for x in re.findall(r"[^ \t\n\x0b\f\r]+", text or "")]
        one = [xxhash.xxh64_intdigest(x, 42) for x in w]
        return [h % buckets for h in one] + [xxhash.xxh64_intdigest(b, a) % buckets for a, b in zip(one, w[1:], strict=False)]

    trusted = {i for i, q in labels if q == 1 and i is not None}
    raw, target = Counter(), Counter()
    for i, x in rows:
        raw.update(grams(x))
        if i in trusted:
            target.update(grams(x))
    share = lambda c, b: (c[b] + smoothing) / (sum(c.values()) + smoothing * buckets)
    ratio = [math.log(share(target, b)) - math.log(share(raw, b)) for b in range(buckets)]
    want = {}
    for i, x in rows:
        g = grams(x)
        want[i, x] = sum(ratio[b] for b in g) / len(g) if g else 0.0
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    got = quality.quality_verdicts(docs, table, buckets=buckets, smoothing=smoothing, threshold=threshold).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    for (i, _), score in want.items():
        for r in by[i]:
            assert r["score"] == pytest.approx(score, abs=1e-9) and r["kept"] == (not r["base_failed"] and r["score"] >= threshold)
    assert any(r["kept"] for r in got) and any(not r["kept"] and not r["base_failed"] for r in got)
    assert quality.quality_verdicts(docs.limit(0), table.limit(0)).count() == 0


def test_toxicity_middle_is_set_on_rows_apart():
    """Clean rows after the first ``clean_rows`` change no margin, only the middle, and the middle then leaves them alone."""
    toxic = [(f"you are a {w} person {i}", 1) for i, w in enumerate(["blarghk", "bl-arghk", "blaarghk", "blarrghk"] * 10)]
    clean = [(f"a plain sentence of words number {i}", 0) for i in range(40)]
    spare = [(f"there was a blargo in the park {i}", 0) for i in range(10)]
    alone, met = (toxicity.train(toxic + clean + more, clean_rows=40) for more in ([], spare))
    assert (alone.table == met.table).all() and alone.bias == met.bias
    assert toxicity.Scorer(met)([t for t, _ in spare]).max() < 0.5
    assert toxicity.Scorer(met)([t for t, _ in toxic]).min() >= 0.5
