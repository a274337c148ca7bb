import random

from cloakwork.operators import library


def ratio(x, y):
    x, y = (" ".join(sorted(t.split(" "))) for t in (x, y))
    row = [0] * (len(y) + 1)
    for a in x:
        new = [0]
        for j, b in enumerate(y):
            new.append(row[j] + 1 if a == b else max(row[j + 1], new[j]))
        row = new
    return round(200 * row[-1] / (len(x) + len(y)), 6)


def test_fuzzy_equals_brute_force(spark):
    rng = random.Random(6)
    keys = sorted({"".join(rng.choice("ABCD ") for _ in range(rng.randint(6, 14))).strip() for _ in range(40)} | {"ABCDEFGHIJ"})
    values = {"XBCDEFGHIJ", "BCDEFGHIJ", "ABCXEFGYIJ", "ZABCDEFGHIJ"}
    for k in keys:
        at = rng.randrange(len(k))
        values |= {k, (k[:at] + rng.choice("ABCDX") + k[at + 1 :]).strip(), (k[:at] + k[at + 1 :]).strip()}
    known = spark.createDataFrame([(k, "p") for k in keys], "norm_key string, pseudonym string")
    got = {r["value"]: (r["score"], r["best"]) for r in library.fuzzy_candidates(spark.createDataFrame([(v,) for v in sorted(values)], "value string"), known).collect()}
    want = {v: max((ratio(v, k), k) for k in keys) for v in values}
    assert got == {v: x for v, x in want.items() if x[0] >= 85}
    assert got["XBCDEFGHIJ"] == (90.0, "ABCDEFGHIJ") and "ABCXEFGYIJ" not in got
