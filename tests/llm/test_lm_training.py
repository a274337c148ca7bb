import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cloakwork.llm import lm_scoring as lm


def test_learns_from_all_rows(spark):
    """Word beginnings and spellings outside the starting sample get evidence and trained embeddings."""
    rng = random.Random(3)
    texts = [" ".join(f"{rng.choice('abcdefgh')}{rng.choice('xyz')}{rng.choice('klmnop')}{rng.randint(0, 9)}" for _ in range(50)) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")
    training = docs.select("doc", F.col("text").cast("binary").alias("text"), F.hash("text").alias("crc"))
    model, counts = lm.learned(training, 3, 5)
    words = lm.Words(pa.array([x.encode() for x in texts], pa.binary()))
    seen = np.unique(words.first)
    fresh = lm.train([], model.value.table, steps=5)
    moved = np.abs(model.value.attention.p["first"][seen] - fresh.p["first"][seen]).max(1)
    assert len(seen) > 100 and (moved > 1e-5).all()
    distinct = pa.array(sorted({w.encode() for x in texts for w in x.split()}), pa.binary())
    assert np.allclose(model.value.spelling, lm.spelling_table(lm.byte_pairs(distinct)))
    assert counts.count() == len(distinct) and counts.agg(F.sum("count")).first()[0] == 120 * 50
    same = np.flatnonzero(words.row[1:] == words.row[:-1])
    near = np.bincount(words.first[same] * lm.IDS + words.first[same + 1], minlength=lm.IDS**2).reshape(lm.IDS, lm.IDS)
    assert (model.value.table == lm.class_table(near)).all()


def brute(model, statistics, counts, text):
    """(score in nats, unknown words' spelling) of a text, token by token, from the definitions."""
    p, words = model.attention.p, lm.Words(pa.array([text.encode()], pa.binary()), model.spelling, model.table)
    ids = [(lm.IDS, lm.IDS), *zip(words.first.tolist(), words.last.tolist(), strict=True)]
    targets = [*words.classes.tolist(), lm.CLASSES]
    total = spelled = 0.0
    for t, target in enumerate(targets):
        start = t // lm.STRIDE * lm.STRIDE - (lm.WINDOW - lm.STRIDE)
        x = [p["first"][ids[u][0]] + p["last"][ids[u][1]] + p["place"][u - start] for u in range(max(0, start), t + 1)]
        q, k, v = np.split(np.asarray(x, np.float64) @ p["qkv"], 3, axis=1)
        a = np.exp(k @ q[-1] / np.sqrt(lm.WIDTH))
        y = (a / a.sum()) @ v @ p["mix"] + x[-1]
        z = y @ p["out"] + p["bias"]
        total += z[target] - np.log(np.exp(z).sum())
    for i, w in enumerate(text.lower().split()):
        n, kinds = statistics.by_class[words.classes[i]]
        if w in counts:
            total += np.log(counts[w] / (n + kinds))
        else:
            total += np.log(kinds / (n + kinds)) if n else 0.0
            spelled += words.spell[i]
    return total, spelled


def test_scores_equal_brute_force(spark):
    """Scores, base scores and counts against plain Python, with null, empty, repeated, upper-case and unknown words, and an all-empty partition."""
    rng = random.Random(5)
    vocabulary = [f"{a}{b}{c}" for a in "abcd" for b in "aeiou" for c in ("n", "rt", "l")]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 5, 30, 90]))) for _ in range(60)]
    texts += [None, "", "  \n", "BAN ban zzz", texts[0]] + [f"only{i}" for i in range(20)]
    rows = list(enumerate(texts)) + [(None, "ban bart"), (7, texts[7])]
    docs = spark.createDataFrame([(i, x, "c", 1) for i, x in rows], "doc_id long, text string, row string, rare int").repartition(3)
    empty = spark.createDataFrame([(900 + i, "", "c", 1) for i in range(4)], docs.schema).coalesce(1)
    kept = {}
    learned, commonest = lm.learned, lm.commonest
    try:
        lm.learned = lambda *a: kept.setdefault("learned", learned(*a))
        got = lm.score_documents(docs.unionByName(empty), frequent=20, steps=5).collect()
    finally:
        lm.learned = learned
    model, table = kept["learned"]
    zlib = __import__("zlib")
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    rows += [(900 + i, "") for i in range(4)]
    counts, ends = {}, 0
    for i, x in rows:
        if not held(i):
            ends += 1
            for w in (x or "").lower().split():
                counts[w] = counts.get(w, 0) + 1
    tokens, kinds = sum(counts.values()) + ends, len(counts) + 1
    by_class = np.zeros((lm.CLASSES, 2))
    names = lm.Words(pa.array([w.encode() for w in counts], pa.binary()), table=model.value.table)
    np.add.at(by_class, names.classes, np.c_[list(counts.values()), np.ones(len(counts))])
    statistics = lm.Statistics(tokens, kinds, by_class, np.zeros(0, np.int64), np.zeros(0, np.int64))
    assert len(got) == len(rows) and commonest(table, 20).count() <= 20
    want = {}
    for i, x in rows:
        w = (x or "").lower().split()
        base = sum(np.log10((counts.get(t, 0) + 1) / (tokens + kinds + 1)) for t in w) + np.log10((ends + 1) / (tokens + kinds + 1))
        score, spelled = brute(model.value, statistics, counts, x or "")
        want[i] = (held(i), len(w) + 1, sum(t in counts for t in w) + 1, tokens, base, score / np.log(10), (score + spelled) / np.log(10))
    for r in got:
        assert tuple(r)[1:5] == want[r[0]][:4] and np.allclose(tuple(r)[5:], want[r[0]][4:], atol=1e-3)
    assert lm.score_documents(docs.limit(0), steps=2).count() == 0


def test_gradients():
    """Gradients against finite differences."""
    rng = np.random.default_rng(1)
    a = lm.Attention()
    a.p = {n: x.astype(np.float64) for n, x in a.p.items()}
    windows = [x[:6] for x in lm.windows_of(lm.Words(pa.array([b"one two three four " * 20, b"five six"], pa.binary())))[:5]]
    _, g = a.gradients(*windows)
    for name in a.p:
        at = tuple(rng.integers(0, n) for n in a.p[name].shape) if name not in ("first", "last") else (int(windows[0][1, 20]) if name == "first" else int(windows[1][1, 20]), 3)
        values = []
        for step in (1e-4, -1e-4):
            a.p[name][at] += step
            values.append(a.gradients(*windows)[0])
            a.p[name][at] -= step
        assert abs((values[0] - values[1]) / 2e-4 - g[name][at]) < 1e-4


def test_only_places_to_score_are_worked_out():
    """Context is seen, but nothing is predicted there; the places left are all that windows score."""
    first, last, hidden, target, good, _ = lm.windows_of(lm.Words(pa.array([b"one two three four " * 20, b"five six", b""], pa.binary())))
    z, e, total, _ = lm.Attention().forward(first, last, hidden)
    assert z.shape == e.shape == (len(first), lm.STRIDE, lm.CLASSES + 1) and total.shape == (len(first), lm.STRIDE)
    assert np.allclose((e / total[:, :, None]).sum(2), 1, atol=1e-5) and not good[:, : -lm.STRIDE].any()
    assert good.sum() == 81 + 3 + 1


def test_known_counts():
    """Counts of listed words in any order, 0 for others, and for all where none is listed."""
    names = np.array([9, -3, 1 << 62], np.int64)
    some = lm.Statistics(10, 3, np.ones((lm.CLASSES, 2)), names, np.array([4, 5, 6]))
    assert some.known(np.array([1 << 62, 0, 9, -3, 9], np.int64)).tolist() == [6, 0, 4, 5, 4]
    none = lm.Statistics(10, 3, np.ones((lm.CLASSES, 2)), np.zeros(0, np.int64), np.zeros(0, np.int64))
    assert none.known(names).tolist() == [0, 0, 0] and none.known(names[:0]).tolist() == []


def test_word_ids_and_spellings():
    """Beginnings, endings and spelling scores of words of all lengths against plain Python, for all words and for some."""
    texts = [b"a bc DEF ghij", b"", b"klmno \xd0\xb6\xd1\x83\xd0\xba x", b"a"]
    table = lm.spelling_table(np.arange(1 << 16) % 11)
    words = lm.Words(pa.array(texts, pa.binary()), table)
    plain = [w.lower() for x in texts for w in x.split()]
    bits = lambda part, salt: int(lm.mix(np.array([int.from_bytes(part, "little") + salt], np.uint64))[0]) % lm.IDS
    assert words.first.tolist() == [bits(w[:3], 1) for w in plain] and words.last.tolist() == [bits(w[::-1][:3], 5) for w in plain]
    want = [sum(table[a, b] for a, b in zip(b"\0" + w, w + b"\0", strict=True)) for w in plain]
    assert np.allclose(words.spell, want) and np.allclose(words.spelled(np.array([6, 1, 1])), [want[6], want[1], want[1]])
    assert len(lm.Words(pa.array([b"", None], pa.binary()), table).spell) == len(words.spelled(np.zeros(0, np.int64))) == 0
