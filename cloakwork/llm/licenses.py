"""License scans: a trained paragraph classifier over word n-grams, confirmed against templates.

Paragraphs are the lines of a text and, for notices wrapped over lines, its blocks between blank lines
with their line ends folded to spaces (long blocks in overlapping pieces).  Features are the distinct
lower-case words and word pairs of the notices below, hashed: a word that no notice holds has no
feature, and a pair has one where both of its words have.  A multinomial logistic regression (one class
for each family, one for licences of any other kind, one for everything else) is fitted on the notices,
on deterministic variations of them, and on lines and blocks of a bounded number of documents as
background.  Its probabilities are calibrated by a temperature, and the least probability that counts as
a licence is set, on held-out rows; those of the licence classes include notices that no variation was
made from.  What passes is compared with the family's templates; a licence-like paragraph that
no template confirms, or that the classifier gives to the unknown class, is reported as ``unknown``.

Scoring uses DataFrame functions only and never shuffles.  Each word is hashed once; a line's (a block's,
a document's) sum of what its words and the pairs that they can begin add at most bounds its score from above.
Features and scores are computed just for what can reach the least probability; everything else provably fails.
"""

from __future__ import annotations

import math
import random
from collections import Counter
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.llm.quality import SPACES

#: Short notices by family (fixed values; the usual wording of each notice).
TEMPLATES: dict[str, list[str]] = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "This project is released under the Apache 2.0 license.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "Released under the GNU GPL v3.",
    ],
    "agpl": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
        "Released under the GNU AGPL v3.",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "You can redistribute this library under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "This project is licensed under the MIT License.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Released under the 3-Clause BSD License.",
        "This software is licensed under the BSD license.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright. All rights reserved. No part of this text may be reproduced without written permission.",
    ],
}
#: Notices of licences without a family here (fixed values; the usual wording): what the unknown class learns from.
OTHERS: list[str] = [
    "This software is provided 'as-is', without any express or implied warranty. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely.",
    "Distributed under the Boost Software License, Version 1.0.",
    "Permission to use, copy, modify, distribute, and sell this software and its documentation for any purpose is hereby granted without fee, provided that the above copyright notice appear in all copies.",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0.",
    "The contents of this file are subject to the terms of the Common Development and Distribution License.",
    "This package is free software; you may redistribute it under the terms of the Artistic License.",
    "This is free and unencumbered software released into the public domain.",
    "This font software is licensed under the SIL Open Font License, Version 1.1.",
    "You may use, distribute and modify this code under the terms of the licence that accompanies it.",
    "Use of this source code is governed by a license that can be found in the LICENSE file.",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "The software is provided without warranty of any kind, express or implied, including but not limited to the warranties of merchantability and fitness for a particular purpose.",
]
#: Notices that no variation is made from, to calibrate on (fixed values).
CALIBRATION: list[tuple[str, str]] = [
    ("apache", "You may obtain a copy of the Apache License, Version 2.0, with this project."),
    ("gpl", "This software is distributed under the terms of the GNU General Public License, version 3 or later."),
    ("agpl", "Distributed under the terms of the GNU Affero General Public License."),
    ("lgpl", "Licensed under the GNU Lesser General Public License."),
    ("mit", "This software is distributed under the terms of the MIT License."),
    ("bsd", "Licensed under the 3-Clause BSD license."),
    ("mpl", "This file is licensed under the Mozilla Public License."),
    ("cc-by", "The text is available under a Creative Commons Attribution International License."),
    ("proprietary", "No part of this work may be reproduced without permission. All rights reserved."),
    ("unknown", "Licensed under the European Union Public Licence, version 1.2."),
    ("unknown", "Permission is granted to copy, distribute and modify this document under the terms of the Free Documentation License."),
]
#: Ordinary sentences in words that licences use, too, for the background class besides the corpus's own lines (fixed values).
ORDINARY: list[str] = [
    "The committee will provide a copy of the report to any person who asks for it.",
    "You can use this tool to change pictures and share them with your friends.",
    "The software was installed on every computer in the office without any trouble.",
    "He was granted permission to leave early, provided that the work was done.",
    "She found her driving license and a notice from the city in the mail.",
    "The terms of the contract include a fee for each person who joins.",
    "All students reserved their seats for the concert under the open sky.",
    "The government released a new version of its public health program.",
    "The source of the river is far from the above villages and the documentation is poor.",
    "Any change in the law may be made by the general assembly, subject to the following conditions.",
    "The library is free for all, and the code for the door is written on the file.",
    "A limited number of copies of the work were distributed to the public by the author.",
    "He told us that the new software runs on any computer and that it is a joy to use.",
    "They made a copy of the letter and sent it to the office for further use.",
    "Any of the files may be opened with the program that came with the machine.",
    "It is not certain that the above is true, but the purpose of the study was clear.",
    "Without any warning the software stopped and the documentation was of no help.",
    "The people of the city may use the park free of charge in the summer.",
    "The following is a list of the works that the museum has on public display.",
    "This is the version of the story that we were told, and this is the place where it ended.",
    "The general of the army was asked to distribute food to the people in the villages.",
    "You will find the code for the lock in the file, or you may ask the person at the desk.",
    "No part of the road is open, and all of the shops along it are closed in winter.",
    "We agree with these terms, and the work on the bridge can start with this notice.",
]
#: Characters that part words besides white space.
MARKS = ",.;:()\"'/"
#: What a confirmed paragraph must hold of one of its family's templates.
LEAST_SHARE = 0.7
#: What parts the blocks of a text: blank lines.
BLANK = r"\n(?:[ \t\x0B\f\r]*\n)+"
#: Words of a block judged at once, and how far the next piece begins: any template lies within one piece, and
#: a piece fills few of the buckets, so a long block does not hold a template by chance.
PIECE, PIECE_STEP = 120, 80
UNKNOWN, NONE = "unknown", "none"


def cleaned(text: Column) -> Column:
    """Lower case, marks and white space other than line ends as blanks."""
    text = F.lower(text)
    for c in MARKS + SPACES.replace("\n", ""):
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def word_places(line: Column, buckets: int) -> Column:
    """Bucket of each word of a cleaned line."""
    mask = F.lit(buckets - 1).cast("long")
    return F.transform(F.array_remove(F.split(line, " "), ""), lambda w: F.xxhash64(w).bitwiseAND(mask).cast("int"))


def features(places: Column, known: Column, firsts: Column, buckets: int) -> Column:
    """Distinct features: buckets of known words, and beyond ``buckets`` those of pairs of neighbours that a notice holds.

    ``firsts`` names for each pair bucket the word that begins the notices' pair there (-1: none), so that other pairs,
    which may share the bucket, do not count.
    """
    after = F.slice(places, F.lit(2), F.greatest(F.size(places), F.lit(1)))
    one = lambda a, b: F.pmod(F.hash(a, b), F.lit(buckets))
    pairs = F.zip_with(places, after, lambda a, b: F.when(b.isNotNull() & F.get(known, a), F.when(F.get(firsts, one(a, b)) == a, one(a, b) + buckets)))
    return F.array_distinct(F.concat(F.filter(places, lambda p: F.get(known, p)), F.filter(pairs, lambda p: p.isNotNull())))


def notices() -> list[tuple[str, str]]:
    return [(f, x) for f, xs in TEMPLATES.items() for x in xs] + [(UNKNOWN, x) for x in OTHERS]


def variations(seed: int, per_notice: int) -> list[tuple[str, str, int]]:
    """(family, line, fold): notices whole, with words lost, and inside other words; the calibration notices in the held-out fold."""
    rng = random.Random(seed)
    rare = ["alpha", "qumar", "zint", "velor", "bastide", "orun", "tisk", "pelm"]
    out = [(f, x, 3) for f, x in CALIBRATION] + [(NONE, x, k % 4) for k, x in enumerate(ORDINARY)]
    for family, line in notices():
        out.append((family, line, 0))
        words = line.split()
        for k in range(per_notice):
            lost = 0.3 if family == UNKNOWN else 0.08  # other licences share some of these words, not whole sentences
            kept = [w for w in words if len(words) < 6 or rng.random() > lost]
            more = [rng.choice(rare) for _ in range(rng.randint(0, 6))]
            cut = rng.randint(0, len(more))
            out.append((family, " ".join([*more[:cut], *kept, *more[cut:]]), k % 4))
    return out


class Classifier:
    """Weights by feature and class (the background class is last), the calibrated temperature and the least probability.

    ``known`` are the buckets of the notices' words, ``templates`` each family's templates as sets of features,
    and ``firsts`` the first word of the notices' pair in each pair bucket, or -1.
    """

    def __init__(self, families: list[str], weights: np.ndarray, bias: np.ndarray, temperature: float, least: float):
        self.families, self.weights, self.bias, self.temperature, self.least = families, weights, bias, temperature, least
        self.known = np.zeros(0, bool)
        self.templates: dict[str, list[set[int]]] = {}
        self.firsts = np.zeros(0, int)

    def margins(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights and bias of each family against the background class (which is last)."""
        return (self.weights[:, :-1] - self.weights[:, -1:]) / self.temperature, (self.bias[:-1] - self.bias[-1]) / self.temperature

    def reach(self) -> np.ndarray:
        """What a word of each bucket adds to any family's score at most, by itself and by a pair that it begins."""
        most = np.maximum(self.margins()[0].max(1), 0)
        n = len(self.known)
        pair = np.zeros(n)
        held = np.flatnonzero(self.firsts >= 0)
        np.maximum.at(pair, self.firsts[held], most[n + held])
        return np.where(self.known, most[:n] + pair, 0.0)


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def fit(rows: list[tuple[str, list[int], int]], buckets: int, *, steps: int = 400, rate: float = 0.5, decay: float = 1e-3) -> Classifier:
    """rows: (family or none, features, fold); fold 3 is held out for the temperature and the least probability."""
    families = [*TEMPLATES, UNKNOWN, NONE]
    held = sorted({b for family, own, _ in rows if family != NONE for b in own})
    column = {b: i for i, b in enumerate(held)}
    seen = Counter((family, tuple(sorted(column[b] for b in own if b in column)), fold == 3) for family, own, fold in rows)
    x = np.zeros((len(seen), len(held)), np.float32)
    for r, (_, own, _) in enumerate(seen):
        x[r, list(own)] = 1
    y = np.asarray([families.index(f) for f, _, _ in seen])
    out = np.asarray([fold for _, _, fold in seen])
    times = np.asarray(list(seen.values()), np.float32)
    counts = np.bincount(y[~out], times[~out], minlength=len(families))
    weight = (times / np.maximum(counts, 1)[y])[~out]
    weight[y[~out] == len(families) - 1] *= len(families) * 4
    weight = (weight / weight.sum())[:, None].astype(np.float32)
    w, b = np.zeros((len(held), len(families)), np.float32), np.zeros(len(families), np.float32)
    mw, mb = np.zeros_like(w), np.zeros_like(b)
    goal, inside = np.eye(len(families), dtype=np.float32)[y[~out]], x[~out]
    for _ in range(steps):  # gradient descent with momentum
        g = (softmax(inside @ w + b) - goal) * weight
        mw = np.float32(0.9) * mw - np.float32(rate) * (inside.T @ g + np.float32(decay) * w)
        mb = np.float32(0.9) * mb - np.float32(rate) * g.sum(0)
        w, b = w + mw, b + mb
    z, t = x[out] @ w + b, y[out]
    loss = {c: -np.average(np.log(softmax(z / c)[np.arange(len(t)), t] + 1e-12), weights=times[out]) for c in (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0)}
    temperature = min(loss, key=loss.get)
    p = 1 - softmax(z / temperature)[:, -1]
    background = p[t == len(families) - 1]
    least = min(0.9, max(0.5, float(np.max(background, initial=0.0)) + 0.01))
    dense = np.zeros((buckets, len(families)))
    dense[held] = w
    return Classifier(families[:-1], dense, b, temperature, least)


def _lines(spark: SparkSession, rows: list[tuple[str, str, int]]) -> DataFrame:
    one = [F.struct(F.lit(f).alias("family"), F.lit(x).alias("line"), F.lit(k).alias("fold")) for f, x, k in rows]
    return spark.range(1).select(F.inline(F.array(*one)))


def background(docs: DataFrame, background_docs: int, background_lines: int) -> DataFrame:
    """(family, line, fold): lines, and beginnings of blocks, of ``background_docs`` documents by hash order (documented bounds)."""
    hashed = docs.select(F.col("text").cast("string").alias("text"), F.xxhash64(F.col("doc_id").cast("long")).alias("h")).filter("text IS NOT NULL")
    last = hashed.select("h").distinct().orderBy("h").limit(background_docs).agg(F.max("h")).first()[0]
    some = hashed.filter(F.col("h") <= F.lit(last))
    cut = lambda x: F.substring(F.replace(x, F.lit("\n"), F.lit(" ")), 1, 8 * PIECE)
    parts = F.array_distinct(F.concat(F.split("text", "\n"), F.transform(F.split("text", BLANK), cut)))
    lines = some.select("h", F.posexplode(parts).alias("at", "line")).filter("trim(line) != ''")
    return lines.orderBy(F.xxhash64("h", "at"), "line").limit(background_lines).select(F.lit(NONE).alias("family"), "line", F.pmod(F.xxhash64("line"), F.lit(4)).cast("int").alias("fold"))


def train(docs: DataFrame, *, buckets: int, background_docs: int, background_lines: int, seed: int = 7) -> Classifier:
    """Fit on the notices and on background lines.

    Background lines that hold most of a notice, or that lie mostly within one (as lines of a wrapped
    notice do), are left out: they may well be licences.
    """
    spark = docs.sparkSession
    own = word_places(cleaned(F.col("line")), buckets)
    seen = _lines(spark, [(f, x, 0) for f, x in [*notices(), *CALIBRATION]]).agg(F.array_distinct(F.flatten(F.collect_list(own)))).first()[0]
    known = np.zeros(buckets, bool)
    known[seen] = True
    after = F.slice("places", F.lit(2), F.greatest(F.size("places"), F.lit(1)))
    pairs = F.zip_with("places", after, lambda a, b: F.when(b.isNotNull(), F.struct(a.alias("a"), F.pmod(F.hash(a, b), F.lit(buckets)).alias("at"))))
    firsts = np.full(buckets, -1)
    for a, at in _lines(spark, [(f, x, 0) for f, x in notices()]).select(own.alias("places")).select(F.inline(F.filter(pairs, lambda p: p.isNotNull()))).distinct().orderBy("at", F.desc("a")).collect():
        firsts[at] = a  # of two pairs in one bucket that with the smaller first word counts
    shape = _booleans(known), _integers(firsts), buckets
    said = [(r[0], set(r[1])) for r in _lines(spark, [(f, x, 0) for f, x in notices()]).select("family", features(own, *shape)).collect()]
    rows = background(docs, background_docs, background_lines).unionByName(_lines(spark, variations(seed, 24)))
    found = [(r[0], list(r[1]), r[2]) for r in rows.select("family", features(own, *shape), "fold").collect()]
    near = lambda x: any(len(t & x) >= 0.6 * min(len(t), max(len(x), 6)) for _, t in said)
    out = fit([r for r in found if r[0] != NONE or not near(set(r[1]))], 2 * buckets)
    out.known, out.firsts = known, firsts
    out.templates = {f: [t for g, t in said if g == f] for f in out.families}
    return out


def _booleans(values) -> Column:
    return F.from_json(F.lit("[" + ",".join("true" if v else "false" for v in values) + "]"), "array<boolean>")


def _integers(values) -> Column:
    return F.from_json(F.lit("[" + ",".join(str(int(v)) for v in values) + "]"), "array<int>")


def _constant(values) -> Column:
    return F.from_json(F.lit("[" + ",".join(repr(float(v)) for v in values) + "]"), "array<double>")


def scan_licenses(docs: DataFrame, *, buckets: int = 1 << 13, background_docs: int = 2000, background_lines: int = 4000, model: Classifier | None = None) -> DataFrame:
    """Per row: doc_id, n_paragraphs, families, n_confirmed, n_unknown, probability, similarity, found.

    ``families`` are the confirmed families, sorted and comma-joined; ``n_unknown`` counts paragraphs
    that look like a licence but agree with no template of a family; ``probability`` and ``similarity``
    are the highest among licence-like paragraphs (null without one); ``found`` holds them all.  Of
    several families or templates that fit a paragraph equally the first in order counts.  A null or
    empty text has no paragraphs.  ``n_paragraphs`` counts lines; blank lines are none.  A block of
    several lines is judged in overlapping pieces (and the unconfirmed lines of a confirmed one do not count), so a text may be of any length; it counts once for each
    family that a template confirms and that none of its own lines was confirmed for, and once as unknown
    where nothing in it was confirmed and none of its lines was found.  Rows are judged one by one,
    repeated ones and ties too; other columns are ignored, whatever their names; an empty table gives no rows.
    """
    model = model or train(docs, buckets=buckets, background_docs=background_docs, background_lines=background_lines)
    weights, bias = model.margins()
    # sum_k exp(margin_k) must reach least / (1 - least); with K families the largest margin must reach its K-th part
    need = math.log(model.least / (1 - model.least)) - math.log(len(model.families)) - float(bias.max())
    reach, upper = _constant(model.reach()), _constant(weights.max(1))
    shape = _booleans(model.known), _integers(model.firsts), buckets
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.split(text, "\n").alias("lines"), F.transform(F.split(cleaned(text), "\n"), lambda x: word_places(x, buckets)).alias("places"))
    most = F.transform("places", lambda ps: F.aggregate(ps, F.lit(0.0), lambda s, b: s + F.get(reach, b)))
    full = F.transform("lines", lambda x: x.rlike(r"[^ \t\x0B\f\r]"))
    out = out.withColumn("most", most).withColumn("full", full)
    # blocks of two or more lines whose words can reach the least score together
    rows = F.concat(F.transform("lines", lambda x, i: F.struct(i.alias("i"), F.get("full", i).alias("full"), F.get("most", i).alias("most"))), F.array(F.struct(F.size("lines").alias("i"), F.lit(False).alias("full"), F.lit(0.0).alias("most"))))
    none = F.array().cast("array<struct<a:int,b:int>>")

    def step(acc: Column, row: Column) -> Column:
        able = ~row["full"] & (row["i"] - acc["a"] > 1) & (acc["most"] >= need)
        more = F.when(able, F.array(F.struct(acc["a"].alias("a"), row["i"].alias("b")))).otherwise(none)
        return F.struct(F.when(row["full"], acc["a"]).otherwise(row["i"] + 1).alias("a"), F.when(row["full"], acc["most"] + row["most"]).otherwise(0.0).alias("most"), F.concat(acc["out"], more).alias("out"))

    out = out.withColumn("blocks", F.aggregate(rows, F.struct(F.lit(0).alias("a"), F.lit(0.0).alias("most"), none.alias("out")), step, lambda acc: acc["out"]))
    single = F.transform(F.filter(F.transform("most", lambda m, i: F.struct(m.alias("most"), i.alias("i"))), lambda c: c["most"] >= need), lambda c: F.struct(c["i"].alias("a"), (c["i"] + 1).alias("b"), F.get("places", c["i"]).alias("places")))
    starts = lambda w: F.sequence(F.lit(1), F.greatest(F.size(w) - (PIECE - PIECE_STEP), F.lit(1)), F.lit(PIECE_STEP))
    whole = F.transform("blocks", lambda c: F.struct(c["a"].alias("a"), c["b"].alias("b"), F.flatten(F.slice("places", c["a"] + 1, c["b"] - c["a"])).alias("places")))
    pieces = F.flatten(F.transform(whole, lambda c: F.transform(starts(c["places"]), lambda k: F.struct(c["a"].alias("a"), c["b"].alias("b"), F.slice(c["places"], k, F.lit(PIECE)).alias("places")))))
    some = F.transform(F.concat(single, pieces), lambda c: F.struct(c["a"].alias("a"), c["b"].alias("b"), features(c["places"], *shape).alias("own")))
    out = out.select("doc_id", "lines", F.size(F.filter("full", lambda x: x)).cast("long").alias("n_paragraphs"), F.filter(some, lambda c: F.aggregate(c["own"], F.lit(0.0), lambda s, b: s + F.get(upper, b)) >= need).alias("some"))
    tables = [_constant(weights[:, k]) for k in range(len(model.families))]
    score = lambda c, t, start: F.aggregate(c["own"], F.lit(float(start)), lambda s, b: s + F.get(t, b))
    scores = lambda c: [score(c, t, bias[k]) for k, t in enumerate(tables)]
    out = out.withColumn("some", F.transform("some", lambda c: F.struct(c["a"].alias("a"), c["b"].alias("b"), c["own"].alias("own"), F.array(*scores(c)).alias("z"))))
    odds = lambda c: F.aggregate(c["z"], F.lit(0.0), lambda s, z: s + F.exp(z))
    out = out.withColumn("some", F.transform("some", lambda c: F.struct(c["a"].alias("a"), c["b"].alias("b"), c["own"].alias("own"), (odds(c) / (1 + odds(c))).alias("probability"), F.element_at(F.array(*map(F.lit, model.families)), F.array_position(c["z"], F.array_max(c["z"])).cast("int")).alias("family"))))
    out = out.withColumn("some", F.filter("some", lambda c: c["probability"] >= model.least))
    share = lambda c, t: F.size(F.array_intersect(c["own"], F.from_json(F.lit(str(sorted(t))), "array<int>"))) / len(t)
    match = lambda c: reduce(lambda rest, f: F.when(c["family"] == f, F.greatest(*[share(c, t) for t in model.templates[f]], F.lit(0.0))).otherwise(rest), TEMPLATES, F.lit(0.0))
    out = out.withColumn("found", F.transform("some", lambda c: F.struct(F.array_join(F.slice("lines", c["a"] + 1, c["b"] - c["a"]), " ").alias("line"), c["a"].alias("a"), c["b"].alias("b"), c["family"].alias("family"), c["probability"].alias("probability"), match(c).alias("similarity")))).drop("some")
    alone = lambda c: c["b"] == c["a"] + 1
    single = F.filter("found", alone)
    sure = F.filter("found", lambda c: ~alone(c) & (c["similarity"] >= LEAST_SHARE))
    doubt = F.filter("found", lambda c: ~alone(c) & (c["similarity"] < LEAST_SHARE))
    out = out.withColumn("single", single).withColumn("sure", sure).withColumn("doubt", doubt)
    inside = lambda c, x: (x["a"] >= c["a"]) & (x["a"] < c["b"])
    known_line = lambda c: F.exists("single", lambda x: (x["similarity"] >= LEAST_SHARE) & (x["family"] == c["family"]) & inside(c, x))
    before = lambda c, i: F.exists(F.slice("sure", F.lit(1), i), lambda x: (x["family"] == c["family"]) & (x["a"] == c["a"]))
    told = lambda c, i: F.exists("sure", lambda x: x["a"] == c["a"]) | F.exists("single", lambda x: inside(c, x)) | F.exists(F.slice("doubt", F.lit(1), i), lambda x: x["a"] == c["a"])
    lines = F.filter("single", lambda x: (x["similarity"] >= LEAST_SHARE) | ~F.exists("sure", lambda c: inside(c, x)))
    out = out.withColumn("found", F.concat(lines, F.filter("sure", lambda c, i: ~known_line(c) & ~before(c, i)), F.filter("doubt", lambda c, i: ~told(c, i))))
    sure = F.filter("found", lambda c: c["similarity"] >= LEAST_SHARE)
    return out.select(
        "doc_id",
        "n_paragraphs",
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda c: c["family"]))), ",").alias("families"),
        F.size(sure).cast("long").alias("n_confirmed"),
        (F.size("found") - F.size(sure)).cast("long").alias("n_unknown"),
        F.array_max(F.transform("found", lambda c: c["probability"])).alias("probability"),
        F.array_max(F.transform("found", lambda c: c["similarity"])).alias("similarity"),
        "found",
    )
