import random

import pytest

pytest.importorskip("corpus_pipeline")
import corpus_pipeline  # noqa: E402

WIDTH = 35


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs, items):
    """(doc_id, kept text) after near duplicates, repeated passages and benchmark passages, from the definitions."""
    sets = {k: shingles(x) for k, (_, x) in enumerate(docs)}
    root = {k: k for k in sets}
    linked = lambda a, b: sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    for _ in docs:
        for a in sets:
            for b in sets:
                if linked(a, b):
                    root[a] = root[b] = min(root[a], root[b])
    first = {}
    for k in sorted(sets, key=lambda k: (docs[k][0] is None, docs[k][0] or 0)):
        first.setdefault(root[k], k)
    docs = [d for k, d in enumerate(docs) if not sets[k] or first[root[k]] == k]
    words = [(x or "").split() for _, x in docs]
    seen = {}
    for r, w in enumerate(words):
        for k in range(len(w) - WIDTH + 1):
            seen.setdefault(tuple(w[k : k + WIDTH]), []).append((r, k))
    gone = {(r, k + j) for at in seen.values() if len(at) > 1 for r, k in at for j in range(WIDTH)}
    out = []
    for r, ((i, x), w) in enumerate(zip(docs, words, strict=True)):
        kept = [t for k, t in enumerate(w) if (r, k) not in gone]
        text = x if len(kept) == len(w) else " ".join(kept)
        t = (text or "").lower().split()
        hit = {k + j for item in items for k in range(len(t)) for j in range(len(item)) if t[k : k + len(item)] == item}
        if not hit or 20 * len(hit) < len(t):
            out.append((i, text))
    return out


def test_pipeline(spark, tmp_path):
    """The stages against brute force on a small table: nulls, empty texts, repeated rows and an extra column included."""
    from cloakwork.llm import packing

    rng = random.Random(6)
    words = ["".join(rng.choice(["ta", "ro", "mi", "ne", "sul"]) for _ in range(3)) for _ in range(400)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    passage, item = text(60), text(13)
    docs = [(i, text(rng.randint(5, 120))) for i in range(120)]
    docs += [(200 + i, f"{text(20)} {passage} {text(20)}") for i in range(6)]  # a passage that repeats
    docs += [(300, docs[3][1]), (301, docs[4][1] + " tail"), (302, docs[5][1].upper()), (5, docs[5][1])]  # copies
    docs += [(400, f"{text(10)} {item} {text(10)}"), (401, f"{text(400)} {item}"), (402, None), (403, ""), (None, text(30))]
    toxic = [(500 + i, f"{text(30)} blockhead {text(5)}") for i in range(60)]
    rows = [(i, x, "en", "web", len(x or ""), "extra") for i, x in docs + toxic]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, rest string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 500)) for i, _ in docs + toxic if i is not None and i < 120 or i is not None and i >= 500], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = brute(docs, [item.split()])
    encode, _ = packing.encoder(packing.default_ranks())
    sizes = sorted((i or -1, len(encode(x or "")) + 1) for i, x in want)
    total = {}
    for r in got:
        total.setdefault((r["doc_id"] or -1, r["doc_tokens"]), []).append(r["length"])
    assert sorted(total) == sizes and all(sum(n) == k[1] for k, n in total.items())


def test_pipeline_of_empty_tables(spark, tmp_path):
    for name, ddl in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], ddl).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
