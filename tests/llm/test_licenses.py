import textwrap

import pytest
from pyspark.sql import functions as F

from cloakwork.llm import licenses


def test_wrapped_notices(spark):
    """Notices wrapped over lines are confirmed, also inside comments; a one-line notice counts once."""
    long = {f: max(licenses.TEMPLATES[f], key=len) for f in ("mit", "bsd", "gpl", "lgpl")}
    wrap = lambda x, mark="": "\n".join(mark + line for line in textwrap.wrap(x, 76))
    prose = "Qumar velor tisk pelm.\nZint orun bastide alpha."
    rows = [(i, f"{prose}\n\n{wrap(x)}\n \n{prose}") for i, x in enumerate(long.values())]
    rows += [(10 + i, f"{wrap(x, '# ')}\n\n{prose}") for i, x in enumerate(long.values())]
    rows += [(20, f"{prose}\nReleased under the MIT License.\n{prose}"), (21, prose), (22, None)]
    got = {r["doc_id"]: (r["families"], r["n_confirmed"]) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {k + i: (f, 1) for k in (0, 10) for i, f in enumerate(long)}
    assert got == want | {20: ("mit", 1), 21: ("", 0), 22: ("", 0)}


ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
PROSE = "the man of the house went to the {} market and bought bread for his family"


def test_unknown_and_affero(spark):
    """A licence without a family counts as unknown, wrapped too; the Affero licence is no GPL; ordinary sentences are nothing."""
    rows = [(i, PROSE.format(i)) for i in range(40)]
    rows += [(100, "Licensed under the GNU Affero General Public License, version 3"), (101, ISC), (102, "\n".join(textwrap.wrap(ISC, 60))), (103, "She said that the software works and that any copy of it is fine.")]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[100]["families"], got[100]["n_confirmed"]) == ("agpl", 1)
    assert got[101]["n_unknown"] == 1 and got[102]["n_unknown"] >= 1 and not got[102]["families"]
    assert all(got[i]["n_unknown"] + got[i]["n_confirmed"] == 0 for i in [*range(40), 103])


def test_scores_equal_softmax(spark):
    """Every line that reaches the least probability is found with it, and no other: the bounds lose nothing."""
    lines = [x for _, x in licenses.notices()] + [x for _, x in licenses.CALIBRATION] + licenses.ORDINARY + [PROSE.format(i) for i in range(10)] + [ISC, "", "MIT", "license"]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    buckets = 1 << 12
    model = licenses.train(docs, buckets=buckets, background_docs=50, background_lines=100)
    shape = licenses._booleans(model.known), licenses._integers(model.firsts), buckets
    own = {r[0]: list(r[1]) for r in docs.select("doc_id", licenses.features(licenses.word_places(licenses.cleaned(F.col("text")), buckets), *shape)).collect()}
    want = {}
    for i, f in own.items():
        p = licenses.softmax((model.weights[f].sum(0) + model.bias)[None] / model.temperature)[0]
        if 1 - p[-1] >= model.least:
            want[i] = 1 - p[-1]
    got = {r["doc_id"]: r["probability"] for r in licenses.scan_licenses(docs, buckets=buckets, model=model).collect() if r["probability"] is not None}
    assert got == pytest.approx(want, abs=1e-6) and len(want) > 20


def test_edges(spark):
    """Null ids and texts, repeated rows, clashing columns, a very long text, an empty table."""
    long = "\n".join(["qumar velor zint " * 4] * 4000) + "\nReleased under the MIT License."
    rows = [(None, None, 1, "a"), (1, "", 2, "b"), (2, "Released under the MIT License.", 3, "c"), (2, "Released under the MIT License.", 3, "c"), (3, long, 4, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, found int, lines string")
    got = sorted((r["doc_id"] or 0, r["n_paragraphs"], r["families"]) for r in licenses.scan_licenses(docs).collect())
    assert got == [(0, 0, ""), (1, 0, ""), (2, 1, "mit"), (2, 1, "mit"), (3, 4001, "mit")]
    assert licenses.scan_licenses(docs.limit(0)).count() == 0
