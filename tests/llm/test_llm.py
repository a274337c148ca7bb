import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloakwork.llm import decontaminate, jaccard_join, packing, quality, substring_dedup, token_rollup, toxicity, warc

DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)] + ["The", "of,", "é!", "ж"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 120))) for _ in range(60)]
    texts += [texts[3], texts[4] + " tail", texts[5].upper(), "a a a a " * 40, "", None, "one two", "One\ttwo", texts[7] + "\n" + texts[8]]
    return list(enumerate(texts))


def runs_of_words():
    """Windows that end or begin with a word that is a run in one copy only."""
    parts = [[f"u{k}_{j}" for j in range(12)] for k in range(60)]
    texts = [" ".join(t) for k, p in enumerate(parts) for t in ((f"x{k}", *p, f"y{k}"), (p[0], *p, p[-1], p[-1]))]
    return list(enumerate(texts))


@pytest.mark.parametrize("few", [False, True])
def test_substring_dedup(spark, corpus, few):
    corpus = runs_of_words() if few else corpus
    width = 12
    split = {i: (x or "").encode().split() for i, x in corpus}
    seen = {}
    for i, w in split.items():
        for k in range(len(w) - width + 1):
            seen.setdefault(tuple(w[k : k + width]), []).append((i, k))
    gone = {(i, k + j) for at in seen.values() if len(at) > 1 for i, k in at for j in range(width)}
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeats(spark.createDataFrame(corpus, DOCS), width=width, rounds=3).collect()}
    assert len(got) == len(corpus)
    for i, w in split.items():
        kept = b" ".join(x for j, x in enumerate(w) if (i, j) not in gone)
        assert (got[i]["n_words"], got[i]["kept_sha256"]) == (len(w), hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("bitmap", [1 << 23, 0])
def test_jaccard(spark, corpus, bitmap, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BITMAP_CLASSES", bitmap)
    sets = {}
    for i, x in corpus:
        w = (x or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and root[b] < root[a]:
                    root[a], changed = root[b], True
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(spark.createDataFrame(corpus, DOCS)).collect()}
    assert got == {i: (len(s), root[i]) for i, s in sets.items()}


def test_prefix_tree():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 30, 20)) for _ in range(40)]
    for probe in sets[:5]:
        want = [i for i, s in enumerate(sets) if 100 * len(np.intersect1d(s, probe)) >= 60 * len(np.union1d(s, probe))]
        assert sorted(jaccard_join.PrefixTree(sets).linked(probe, 60, step=3)) == want


def test_packing(spark, corpus):
    from tokenizers import Tokenizer
    import public_tokenizers

    known = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack(spark.createDataFrame(corpus, DOCS).coalesce(1), context=64, with_ids=True).collect()
    docs, sequences = {}, {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        assert r["start"] == len(docs.setdefault(r["doc_id"], []))
        docs[r["doc_id"]] += r["ids"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert docs == {i: known.encode(x or "", add_special_tokens=False).ids + [1] for i, x in corpus}
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64


def test_decontamination(spark, corpus):
    bench = spark.createDataFrame([(1, corpus[2][1]), (2, "one, TWO"), (3, None), (2, "one two"), (4, corpus[9][1])], "item_id long, text string")
    docs = spark.createDataFrame(corpus, DOCS)
    one, many = (sorted(map(tuple, decontaminate.find_contamination(docs, bench, shard_words=n).drop("spans", "items").collect())) for n in (10**6, 1))
    assert one == many
    by = {r[0]: r for r in one}
    assert by[2][5] and by[66][2:4] == (2, 1) and by[64][1:4] == (0, 0, 0)


def test_warc(spark, tmp_path):
    rows = [(1, "u1", "x" * 200), (2, "u2", "x" * 200), (3, "u3", None), (4, "u4", "é\r\n\r\nkurz"), (5, None, "é\r\n\r\nkurz")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in warc.page_report(pages).collect()}
    assert [got[i]["record_type"] for i in range(1, 6)] == ["response", "revisit", "response", "response", "response"]
    assert got[2]["refers_to"] == 1 and got[2]["payload_bytes"] == 200 and got[3]["payload_bytes"] == 0
    assert got[4]["payload_digest"] == hashlib.sha256("é\r\n\r\nkurz".encode()).hexdigest()
    path = warc.archive(pages, f"file://{tmp_path}/w")
    assert warc.read_archive(spark, path).filter("record_type = 'revisit'").count() == 1


def test_quality_base(spark):
    text = "a b c d e f g h i j k l m n o p q r s t u\nx #1\nx #1\n" + "a b c d e f g h"
    row = quality.base_rules(spark.createDataFrame([(1, text), (2, None)], DOCS)).orderBy("doc_id").collect()
    assert (row[0]["n_words"], row[0]["n_symbols"], row[0]["n_dup_lines"], row[0]["n_repeat_words"]) == (33, 2, 1, 16)
    assert row[1]["n_words"] == 0 and row[1]["base_failed"]


def test_ledger(spark, tmp_path):
    ledger = token_rollup.TokenLedger(spark, f"file://{tmp_path}/l")
    row = lambda op, i, n: (op, i, "s", "en", "v1", n)
    make = lambda *rows: spark.createDataFrame(rows, "op string, doc_id long, source string, lang string, tokenizer string, n_tokens long")
    assert ledger.commit("a", make(row("insert", 1, 5), row("insert", 2, 7)))
    assert not ledger.commit("a", make(row("insert", 3, 9)))
    assert ledger.commit("b", make(row("delete", 1, 0), row("revise", 2, 4), row("delete", 9, 0)))
    assert [tuple(r) for r in ledger.totals().collect()] == [("s", "en", "v1", 1, 4)]


def test_toxicity():
    rng = random.Random(2)
    plain = ["".join(rng.choice(["ta", "ro", "mi", "ne", "sul"]) for _ in range(3)) for _ in range(300)]
    rows = [(" ".join(rng.choices(plain, k=30)) + (f" {rng.choice(['blockhead', 'dipstick'])}" if k % 4 == 0 else ""), int(k % 4 == 0)) for k in range(160)]
    machine = toxicity.train(rows, clean_words=200, landmarks=40, rounds=2)
    score = toxicity.Scorer(machine)
    got = score([x for x, _ in rows] + ["taro b.l.o.c.k.h.e.a.d", "", None])
    assert ((got[:-3] >= 0.5) == np.asarray([y for _, y in rows])).mean() > 0.97
    assert got[-3] >= 0.5 > got[-2] == got[-1]


def test_prefix_tree_skips_subtrees():
    """Sets that share a beginning with which no probe can reach the overlap are stepped over at once."""
    sets = [np.r_[np.arange(1000, 1040), 2000 + 10 * i + np.arange(10)] for i in range(60)] + [np.arange(50)]
    tree = jaccard_join.PrefixTree(sets)
    assert tree.linked(np.arange(50), 80) == [60] and tree.visited < 5
    probe = np.r_[np.arange(1000, 1040), np.arange(3000, 3010)]
    want = [i for i, s in enumerate(sets) if 100 * len(np.intersect1d(s, probe)) >= 60 * len(np.union1d(s, probe))]
    assert sorted(tree.linked(probe, 60, step=7)) == want


def test_groups_across_batches():
    import pyarrow as pa

    rng = random.Random(3)
    keys = sorted(rng.choices(range(9), k=200))
    seen = []
    work = lambda t: iter([seen.append(t.column(0).to_pylist()) or pa.record_batch([pa.array([0])], ["x"])])
    batches = [pa.record_batch([pa.array(keys[i : i + 7])], ["key"]) for i in range(0, 200, 7)]
    list(jaccard_join._groups(work)([batches[0].slice(0, 0), *batches]))
    assert sorted(k for part in seen for k in part) == keys and sum(len(set(p)) for p in seen) == len(set(keys))


def test_one_of_each(spark):
    """One row of each group stays, with all columns; nulls, repeated ids and rows, clashing names, an empty table."""
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a, "x"), (2, a + " tail", "x"), (3, b, "y"), (3, a, "z"), (None, a, "n"), (4, "", "e"), (5, None, "e"), (6, "short", "s"), (6, "short", "s"), (7, "short", "t"), (None, "lone text", "u"), (None, "lone text", "u"), (8, " ".join(f"c{i}" for i in range(300_000)), "long")]
    docs = spark.createDataFrame([(i, x, c, 1, "m") for i, x, c in rows], "doc_id long, text string, class string, rank int, mark string")
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    got = sorted((r["doc_id"] or 0, r["class"]) for r in kept.collect())
    assert got == [(0, "u"), (1, "x"), (3, "y"), (4, "e"), (5, "e"), (6, "s"), (8, "long")]
    assert jaccard_join.one_of_each(docs.limit(0)).count() == 0
    assert jaccard_join.near_duplicates(docs.limit(0)).count() == 0


def test_substring_edges(spark):
    """Rows without an id whose 32-bit hashes agree, one id with several texts, repeated rows, clashing names, a long text, an empty table."""
    passage = " ".join(f"p{i}" for i in range(20))
    # a birthday search for two texts of different lengths with the same 32-bit hash
    found = spark.range(400_000).select(F.concat(F.lit("x "), F.col("id").cast("string"), F.repeat(F.lit(" y"), (F.col("id") % 40).cast("int"))).alias("t")).select("t", F.hash(F.col("t").cast("binary")).alias("h"))
    twins = [r["t"] for r in found.groupBy("h").agg(F.collect_set("t").alias("ts")).filter("size(ts) > 1").select(F.inline(F.transform("ts", lambda t: F.struct(t.alias("t"))))).collect()]
    assert len(twins) >= 2
    rows = [(None, t) for t in twins] + [(None, None), (None, ""), (5, passage + " a"), (5, "b " + passage), (5, "b " + passage), (6, "lone words"), (7, " ".join(f"q{i}" for i in range(200_000)))]
    docs = spark.createDataFrame([(i, t, 1, "n") for i, t in rows], "doc_id long, text string, rest int, name string")
    width = 12
    split = [(t or "").split() for _, t in rows]
    seen = {}
    for i, w in enumerate(split):
        for k in range(len(w) - width + 1):
            seen.setdefault(tuple(w[k : k + width]), []).append((i, k))
    gone = {(i, k + j) for at in seen.values() if len(at) > 1 for i, k in at for j in range(width)}
    want = sorted((i or 0, len(w), sum((r, k) in gone for k in range(len(w)))) for r, ((i, _), w) in enumerate(zip(rows, split, strict=True)))
    out = substring_dedup.remove_repeats(docs, width=width, rounds=3, carry=["rest", "name"])
    got = out.collect()
    assert sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in got) == want
    assert all(tuple(r["rest"]) == (1, "n") for r in got) and sum(r["doc_id"] is None for r in got) == len(twins) + 2
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_decontamination_names(spark):
    """Columns named like the operator's own stay as they are; null ids and texts, repeated rows and an empty table have results."""
    item = " ".join(f"w{i}" for i in range(13))
    rows = [(None, item, 1), (1, None, 2), (2, "", 3), (3, "clean text", 4), (3, "clean text", 4), (4, item.upper() + " x" * 400, 5)]
    docs = spark.createDataFrame([(i, t, "s", "t", n) for i, t, n in rows], "doc_id long, text string, search_text string, search_spans string, spans int")
    bench = spark.createDataFrame([(1, item), (1, item), (None, "clean text")], "item_id long, text string")
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r["spans"] for r in kept.collect()) == [2, 3, 4, 4, 5]
    assert decontaminate.find_contamination(docs.limit(0), bench).count() == 0
    assert decontaminate.find_contamination(docs, bench.limit(0)).filter("contaminated").count() == 0


def test_packing_optimum():
    """The cheapest cuts against all ways to cut short streams, every power of two free of padding."""
    rng = np.random.default_rng(4)
    for _ in range(30):
        context = 16
        at = np.r_[0, np.sort(rng.choice(np.arange(1, 60), 14, replace=False))]
        at = at[np.r_[True, np.diff(at) <= context]] if (np.diff(at) > context).any() else at
        if (np.diff(at) > context).any():
            continue
        price = rng.choice([0.0, 3.0, 9.0], len(at)).astype(np.float32)
        best = {0: 0.0}
        for j in range(1, len(at)):
            ways = []
            for i in range(j):
                n = int(at[j] - at[i])
                if n <= context:
                    ways.append(best[i] + (0 if n & (n - 1) == 0 else context - n))
            best[j] = min(ways) + float(price[j]) + 1.5
        split = packing.cuts(at, price, context, 1.5)
        where = {int(p): k for k, p in enumerate(at)}
        cost = sum((0 if (n := b - a) & (n - 1) == 0 else context - n) + float(price[where[b]]) + 1.5 for a, b in zip(split, split[1:], strict=False))
        assert split[0] == 0 and split[-1] == at[-1] and abs(cost - best[len(at) - 1]) < 1e-6


def test_packing_padding_and_edges(spark, corpus):
    """Little padding; special tokens, null ids, repeated rows, clashing names, a long text, an empty table."""
    from tokenizers import Tokenizer
    import public_tokenizers

    known = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [x for _, x in corpus] * 12 + ["<|endoftext|> a", "word " * 6000, "é中\U0001f600 \x00", None]
    docs = spark.createDataFrame([(None if i % 50 == 0 else i, x, i, "o") for i, x in enumerate(texts)], "doc_id long, text string, start int, offset string").coalesce(1)
    rows = packing.pack(docs, with_ids=True).collect()
    sizes = {}
    for r in rows:
        sizes[r["sequence_id"]] = sizes.get(r["sequence_id"], 0) + r["length"]
    want = sorted(tuple(known.encode(x or "", add_special_tokens=False).ids + [1]) for x in texts)
    assert sum(sizes.values()) == sum(map(len, want)) and max(sizes.values()) <= 2048
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in sizes.values())
    assert padding <= 0.05 * sum(sizes.values())
    whole = [r for r in rows if r["doc_id"] == 1]
    assert [i for r in sorted(whole, key=lambda r: r["start"]) for i in r["ids"]] == known.encode(texts[1], add_special_tokens=False).ids + [1]
    assert packing.pack(docs.limit(0)).count() == 0


def test_kernel_equals_direct_sum():
    """Kernel values against a direct sum over the gapped subsequences that two words share."""
    from itertools import combinations

    def vector(word):
        s, out = f"\x02{word}\x03", {}
        for i, j, k in combinations(range(len(s)), 3):
            if k - i < toxicity.SPAN:
                key = s[i] + s[j] + s[k]
                out[key] = out.get(key, 0) + toxicity.DECAY ** (k - i - 1)
        norm = sum(v * v for v in out.values()) ** 0.5
        return {k: v / norm for k, v in out.items()}

    words = ["dipstick", "dip-stick", "diipstick", "banana", "a", "aaaa", "блок"]
    marks = ["dipstick", "blockhead", "nab", "aaab"]
    want = [[sum(v * b.get(k, 0) for k, v in a.items()) for b in map(vector, marks)] for a in map(vector, words)]
    assert np.allclose(toxicity.Landmarks(marks).kernel(words), want, atol=1e-5)


def test_toxicity_edges(spark):
    """Null ids are not held out; long spelled-out units are seen joined; empty tables have results."""
    unit = ".".join("abcdefghijklmnopqrstuvwxyzblockhead")
    assert any("blockhead" in p for p in toxicity.pieces(unit))
    docs = spark.createDataFrame([(None, "x y", "l"), (1, None, "l"), (2, "", "l"), (2, "", "l"), (3, "word " * 100_000, "l")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 0, None)], "doc_id long, toxic int, quality int")
    got = toxicity.score_documents(docs, labels).collect()
    assert len(got) == 5 and [r["held_out"] for r in got if r["doc_id"] is None] == [False] and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score_documents(docs.limit(0), labels.limit(0)).count() == 0


PAGES = "page_id long, url string, html string"


def test_warc_appends_and_overwrite(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    page = lambda i: warc.page_records(spark.createDataFrame([(i, "u", "x" * 10 * i)], PAGES))
    warc.register(spark)
    for i in (1, 2):
        page(i).write.format("warc").mode("append").save(path)
    assert sorted(r["page_id"] for r in warc.read_archive(spark, path).collect()) == [1, 2]
    page(3).write.format("warc").mode("overwrite").save(path)
    assert [(r["page_id"], len(r["payload"])) for r in warc.read_archive(spark, path).collect()] == [(3, 30)]


@pytest.mark.parametrize("kind", ["members", "one", "plain", "own"])
def test_warc_foreign_archives(spark, tmp_path, kind):
    """Archives of other writers: plain gzip members, one member for all, no gzip; split into small ranges; broken header bytes."""
    import gzip

    rng = random.Random(1)
    want, whole = [], []
    for i in range(60):
        body = bytes(rng.randrange(256) for _ in range(rng.randint(0, 3000)))
        if i % 3 == 2:
            head, block = b"WARC-Type: metadata\r\nContent-Type: text/plain\r\n", body
        else:
            head, block = b"WARC-Type: response\r\ncontent-type: application/http; msgtype=response\r\n", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n" + body
        head += b"WARC-Target-URI: http://x/\xff%d\r\n" % i
        whole.append(b"WARC/1.0\r\n" + head + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n")
        want.append(("metadata" if i % 3 == 2 else "response", f"http://x/�{i}", body))
    if kind == "own":
        want = [("response", f"u{i}", bytes(str(rng.random()) * 20, "ascii")) for i in range(60)]
        warc.archive(spark.createDataFrame([(i, u, b.decode()) for i, (_, u, b) in enumerate(want)], PAGES).coalesce(1), f"file://{tmp_path}")
    elif kind == "plain":
        (tmp_path / "a.warc").write_bytes(b"".join(whole))
    else:
        (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, whole)) if kind == "members" else gzip.compress(b"".join(whole)))
    key = lambda r: r[1]
    for size in (1000, 1 << 27):
        df = warc.read_archive(spark, f"file://{tmp_path}", partition_bytes=size)
        assert sorted(((r["record_type"], r["target_uri"], bytes(r["payload"])) for r in df.collect()), key=key) == sorted(want, key=key)
        assert df.filter("record_type = 'response'").select("target_uri").count() == sum(x[0] == "response" for x in want)
    assert warc.read_archive(spark, f"file://{tmp_path}", payload="false").filter("payload IS NULL").count() == 60


def test_warc_edges(spark, tmp_path):
    """Null ids and texts, repeated ids, clashing names, ties among equal payloads, an empty table."""
    long = "y" * 3_000_000
    rows = [(None, None, None, 1), (None, "u", "x" * 150, 2), (2, "u", "x" * 150, 3), (2, "u", "x" * 150, 3), (5, "u", "x" * 150, 4), (6, "u", long, 5)]
    pages = spark.createDataFrame([(a, b, c, str(d)) for a, b, c, d in rows], PAGES + ", record_type string")
    got = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"] or 0, r["payload_bytes"]) for r in warc.page_report(pages).collect())
    assert got == [(0, "response", 0, 0), (0, "revisit", 2, 150), (2, "response", 0, 150), (2, "response", 0, 150), (5, "revisit", 2, 150), (6, "response", 0, 3_000_000)]
    assert warc.page_report(pages.limit(0)).count() == 0


def test_ledger_lost_commit_and_compaction(spark, tmp_path):
    """A batch whose commit was lost counts once when it is retried; a compaction changes no total."""
    ledger = token_rollup.TokenLedger(spark, f"file://{tmp_path}/l", buckets=3)
    row = lambda op, i, n, s="s": (op, i, s, "en", "v1", n)
    make = lambda *rows: spark.createDataFrame([(*r, "x") for r in rows], "op string, doc_id long, source string, lang string, tokenizer string, n_tokens long, bucket string")
    state = lambda: sorted(map(tuple, ledger.totals().collect()), key=str)
    first = make(row("insert", 1, 5), row("insert", 2, 7), row("insert", 3, 10, None), row("insert", None, 99))
    ledger.commit("a", first)
    (tmp_path / "l" / "commits" / "a").unlink()
    assert state() == []
    assert ledger.commit("a", first) and not ledger.commit("a", first)
    assert state() == [("s", "en", "v1", 2, 12), (None, "en", "v1", 1, 10)]
    ledger.commit("b", make(row("revise", 2, 4), row("delete", 3, 0)))
    before = state()
    assert before == [("s", "en", "v1", 2, 9)]
    ledger.compact()
    assert state() == before and len(ledger.batches()) == 1 and not ledger.commit("b", make(row("insert", 8, 1)))
    ledger.commit("c", make(row("delete", 1, 0)))
    ledger.commit("empty", make().limit(0) if False else first.limit(0))
    ledger.compact()
    assert state() == [("s", "en", "v1", 1, 4)] and len(ledger.batches()) == 1
    assert [tuple(r) for r in ledger.current().select("doc_id", "n_tokens").collect()] == [(2, 4)]
