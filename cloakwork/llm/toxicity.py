"""Toxicity: a support vector machine over a gap-weighted subsequence string kernel, with Nystroem landmarks.

The kernel of two words sums, over the three-character subsequences that they share, ``DECAY`` to the
power of the characters that the subsequences span in both (``SPAN`` at most; word ends count as
characters), normalised.  An insult with a gap or an inserted character so keeps most of its weight.
Kernel values against the landmark words, whitened by the landmarks' own kernel matrix, are a word's
features; a linear SVM separates them.  As both steps are linear in the landmarks' subsequences, a
word's SVM output is one sparse product of its subsequences with a table.

Labels belong to documents, insults are words, so training is multiple-instance: every word of a
clean document is clean, and a toxic document holds at least one toxic word.  The first witnesses are
the words whose subsequences are most over-represented in toxic documents; then the machine is fitted
on the witnesses and on clean words, picks new witnesses, and meets the clean words that it found most
toxic, a few times over.

A document's units are its lower-case words with their outer punctuation stripped, and runs of
single characters joined (spelled-out insults).  Its score is the highest unit score, passed through a
logistic function whose middle is set on the training documents and on clean ones that the machine was not
fitted on, since clean words that it has met get lower margins than others.  Scoring is one pass without a
shuffle; each task keeps the scores of words it has seen in a bounded cache.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork.llm.shared import mix, slices

DECAY, SPAN = 0.7, 6
#: Longest unit that the kernel sees whole; longer ones are cut into overlapping pieces of this many characters.
PIECE = 24
#: Word scores kept by a task at most; beyond it the cache starts anew.
CACHE = 400_000
#: Entries of the table of subsequence weights.
TABLE = 1 << 20
OUTER = ".,;:!?\"'()[]{}<>*#$%&|-_=+/\\`~"
SPELLED = re.compile(r"(?<!\S)\S(?:\s\S){2,}(?!\S)")
#: The margin of a document without units.
EMPTY = -3.0


def units(text: str | None) -> set[str]:
    """The distinct units of a text; a null or empty text has none."""
    if not text:
        return set()
    text = text.lower()
    return set(text.split()).union("".join(run.split()) for run in SPELLED.findall(text))


def pieces(unit: str) -> list[str]:
    """A unit without outer punctuation, and without inner punctuation where it has some; long ones in overlapping pieces, so that nothing goes unseen."""
    unit = unit.strip(OUTER) or unit
    half = PIECE // 2
    cut = lambda x: [x] if len(x) <= PIECE else [x[i : i + PIECE] for i in range(0, len(x) - half, half)]
    out = cut(unit)
    if not unit.isalnum() and len(plain := "".join(filter(str.isalnum, unit))) > 2:
        out += cut(plain)
    return out


@lru_cache(maxsize=64)
def places(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions of all subsequences of three within ``SPAN`` characters, and their weights."""
    found = [(i, j, k) for i in range(n) for j in range(i + 1, n) for k in range(j + 1, min(n, i + SPAN))]
    i, j, k = np.asarray(found).T
    return i, j, k, (DECAY ** (k - i - 1.0)).astype(np.float32)


def subsequences(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(indices of words, keys, weights divided by the words' norms) for words of one length at a time."""
    by: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by.setdefault(len(w), []).append(i)
    for n, own in by.items():
        i, j, k, weight = places(n + 2)
        for at in range(0, len(own), 4096):
            part = own[at : at + 4096]
            codes = np.frombuffer("".join(f"\x02{words[x]}\x03" for x in part).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(part), n + 2).astype(np.uint64)
            keys = mix((codes[:, i] << np.uint64(42)) | (codes[:, j] << np.uint64(21)) | codes[:, k])
            order = np.argsort(keys, axis=1, kind="stable")
            flat = np.take_along_axis(keys, order, 1)
            first = np.ones(flat.shape, bool)
            first[:, 1:] = flat[:, 1:] != flat[:, :-1]
            starts = np.flatnonzero(first.ravel())
            sums = np.add.reduceat(weight[order].ravel(), starts)
            norm = np.sqrt(np.add.reduceat(sums * sums, np.searchsorted(starts, np.arange(len(part)) * flat.shape[1])))
            yield np.asarray(part), keys, weight[None, :] / norm[:, None]


class Landmarks:
    """Kernel values against fixed words."""

    def __init__(self, words: list[str]):
        self.words = words
        keys, weights, owner = [], [], []
        for own, key, weight in subsequences(words):
            keys.append(key.ravel())
            weights.append(weight.ravel())
            owner.append(np.repeat(own, key.shape[1]))
        self.keys, column = np.unique(np.concatenate(keys), return_inverse=True)
        self.matrix = np.zeros((len(self.keys) + 1, len(words)), np.float32)  # the last row is for keys that no landmark has
        np.add.at(self.matrix, (column, np.concatenate(owner)), np.concatenate(weights))

    def kernel(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.words)), np.float32)
        for own, key, weight in subsequences(words):
            row = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            row[self.keys[row] != key] = len(self.keys)
            total = np.zeros((len(own), len(self.words)), np.float32)
            for s in range(key.shape[1]):
                total += weight[:, s, None] * self.matrix[row[:, s]]
            out[own] = total
        return out


class StringMachine:
    """A fitted machine: a table of subsequence weights, a bias, and the logistic function's middle and slope."""

    def __init__(self, table: np.ndarray, bias: float, shift: float = 0.0, slope: float = 4.0):
        self.table, self.bias, self.shift, self.slope = table, bias, shift, slope

    def margins(self, words: list[str]) -> np.ndarray:
        """SVM output for each unit; a long unit's is its highest piece's."""
        if not words:
            return np.zeros(0)
        parts = [pieces(w) for w in words]
        flat = [p for ps in parts for p in ps]
        out = np.zeros(len(flat), np.float32)
        for own, key, weight in subsequences(flat):
            out[own] = (self.table[(key & np.uint64(TABLE - 1)).astype(np.int64)] * weight).sum(1)
        out += np.float32(self.bias)
        return out if len(flat) == len(words) else np.maximum.reduceat(out, np.cumsum([0, *(len(p) for p in parts)])[:-1])

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (margin + self.shift), -60, 60)))


def separate(positive: np.ndarray, negative: np.ndarray, *, cost: float = 3000.0, steps: int = 1500) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss by accelerated gradient steps; both classes weigh the same."""
    x = np.ones((len(positive) + len(negative), positive.shape[1] + 1))  # filled in place: the training data are held once
    x[: len(positive), :-1], x[len(positive) :, :-1] = positive, negative
    y = np.r_[np.ones(len(positive)), -np.ones(len(negative))]
    c = np.where(y > 0, cost / len(positive), cost / len(negative))
    step = 1.0 / (1.0 + 2 * np.linalg.eigvalsh((x * c[:, None]).T @ x)[-1])
    w = np.zeros(x.shape[1])
    v, t = w.copy(), 1.0
    for _ in range(steps):
        g = np.r_[v[:-1], 0] - 2 * x.T @ (c * y * np.maximum(0, 1 - y * (x @ v)))
        new, t2 = v - step * g, (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w[:-1], float(w[-1])


def excess(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Signed root of the log-likelihood ratio that a thing's document counts differ between the classes."""
    share = n_toxic / (n_toxic + n_clean)
    both = np.maximum(toxic + clean, 1e-9)
    g = toxic * np.log(np.maximum(toxic, 1e-9) / (both * share)) + clean * np.log(np.maximum(clean, 1e-9) / (both * (1 - share)))
    return np.where(toxic > both * share, 1, -1) * np.sqrt(2 * np.maximum(g, 0))


def first_witnesses(words: list[str], bags: list[tuple[list[int], int]]) -> np.ndarray:
    """How over-represented each word, and the subsequences that it holds, are in toxic documents (words by index)."""
    n = [sum(label == k for _, label in bags) for k in (0, 1)]
    counts = np.zeros((2, TABLE), np.float32)
    direct = np.zeros((2, len(words)))
    slots: list[np.ndarray] = [np.zeros(0, np.int32)] * len(words)
    for own, key, _ in subsequences(words):
        slot = (key & np.uint64(TABLE - 1)).astype(np.int32)
        for i, x in enumerate(own.tolist()):
            slots[x] = slot[i]
    for own, label in bags:
        if own:
            counts[label][np.unique(np.concatenate([slots[x] for x in own]))] += 1
            direct[label][own] += 1
    del slots
    part = np.clip(excess(counts[1], counts[0], n[1], n[0]), -4, 8)
    part[counts.sum(0) < 4] = 0
    whole = np.clip(excess(direct[1], direct[0], n[1], n[0]), -4, 12)
    whole[direct.sum(0) < 3] = 0
    for own, key, weight in subsequences(words):
        whole[own] += (part[(key & np.uint64(TABLE - 1)).astype(np.int64)] * weight).sum(1) / weight.sum(1)
    return whole


def train(rows: Iterable[tuple[str | None, int]], *, clean_rows: int = 3000, landmarks: int = 256, clean_words: int = 8000, rounds: int = 4, seed: int = 11) -> StringMachine:
    """rows: (text, label 0 or 1) of training documents; clean ones after the first ``clean_rows`` only help to set the middle."""
    rng = np.random.default_rng(seed)
    texts, spare, clean = [], [], 0
    for text, label in rows:
        clean += label == 0
        if label == 0 and clean > clean_rows:
            spare.append(text)
        else:
            texts.append((sorted({p for u in units(text) for p in pieces(u)}), label))
    in_clean = Counter(w for own, label in texts if label == 0 for w in own)
    words = sorted({w for own, label in texts for w in own})
    number = {w: i for i, w in enumerate(words)}
    bags = [([number[w] for w in own], label) for own, label in texts]
    del texts, number
    candidate = np.asarray([w not in in_clean for w in words], bool)
    toxic_bags = [[x for x in own if candidate[x]] for own, label in bags if label == 1]
    toxic_bags = [own for own in toxic_bags if own]
    if not toxic_bags or not in_clean:
        return StringMachine(np.zeros(TABLE, np.float32), 1.0 if toxic_bags else EMPTY)
    score = first_witnesses(words, bags)
    negatives = np.flatnonzero(~candidate)
    base = negatives[rng.permutation(len(negatives))[:clean_words]]
    few = max(0.0, 1 - 3 / len(negatives))  # a witness beats all clean words but the two or three most suspicious
    bar = float(np.quantile(score[negatives], few))
    hard = negatives[np.argsort(-score[negatives], kind="stable")[: clean_words // 4]]
    often = Counter(x for own in toxic_bags for x in own)
    seeds: set[int] = set()
    machine = None
    for r in range(rounds):
        chosen = set(seeds)
        for own in toxic_bags:
            s = score[own]
            chosen.update(x for x, v in zip(own, s, strict=True) if v >= bar)
        if not chosen:
            chosen = {own[int(np.argmax(score[own]))] for own in toxic_bags}
        if r == 0:
            seeds = set(chosen)  # found by their counts alone: they stay
        witness = np.asarray(sorted(chosen, key=lambda x: (-often[x], x)))
        marks: list[int] = []
        for group, share in ((witness, landmarks // 2), (hard, landmarks // 4)):  # unlike each other
            pool = group[np.sort(rng.permutation(len(group))[:1500])] if len(group) > 1500 else group
            names = [words[x] for x in pool]
            gram = np.hstack([Landmarks(names[i : i + 256]).kernel(names) for i in range(0, len(names), 256)])  # few columns at a time
            picked: list[int] = []
            for i in range(len(pool)):
                if not picked or gram[i, picked].max() < 0.75:
                    picked.append(i)
                if len(picked) == share:
                    break
            marks += [int(pool[i]) for i in picked]
        marks += [int(x) for x in base[rng.permutation(len(base))[: landmarks - len(marks)]]]
        names = sorted({words[x] for x in marks})
        space = Landmarks(names)
        value, vector = np.linalg.eigh(space.kernel(names).astype(np.float64))
        white = vector[:, value > 1e-3] / np.sqrt(value[value > 1e-3])
        near = lambda own: space.kernel([words[x] for x in own]) @ white  # noqa: E731, B023
        weights, bias = separate(near(witness), near(np.unique(np.r_[base, hard])))
        table = np.zeros(TABLE, np.float32)
        np.add.at(table, (space.keys & np.uint64(TABLE - 1)).astype(np.int64), (space.matrix[:-1] @ (white @ weights)).astype(np.float32))
        machine = StringMachine(table, bias)
        score = machine.margins(words).astype(np.float64)
        top = np.argsort(-score[negatives], kind="stable")
        hard = negatives[top[: clean_words // 4]]
        bar = max(0.5, float(np.quantile(score[negatives], few)))
    tops = [(float(score[own].max()) if own else EMPTY, label) for own, label in bags]
    meet = Scorer(machine)
    calibrate(machine, tops + [(float(x), 0) for i in range(0, len(spare), 200) for x in meet.margins(spare[i : i + 200])])
    return machine


def calibrate(machine: StringMachine, tops: list[tuple[float, int]]) -> None:
    """Put a score of one half at the middle of the margins that part the training documents best."""
    values = sorted(tops)
    margins = np.asarray([m for m, _ in values])
    labels = np.asarray([y for _, y in values])
    errors = np.r_[0, np.cumsum(labels)] + np.r_[np.cumsum((1 - labels)[::-1])[::-1], 0]
    at = np.flatnonzero(errors == errors.min())
    i = int(at[len(at) // 2])
    low = margins[i - 1] if i else margins[0] - 1
    high = margins[i] if i < len(margins) else margins[-1] + 1
    machine.shift = -float(low + high) / 2


def training_rows(docs: DataFrame, labels: DataFrame, *, toxic_rows: int, clean_rows: int, spare_rows: int = 3000, fold: int | None = 5, longest: int = 1 << 16) -> list[tuple[str | None, int]]:
    """At most ``toxic_rows`` toxic and ``clean_rows`` and ``spare_rows`` clean labelled documents by hash order, without those of more than ``longest`` bytes
    (documented bounds of what the driver holds), never of the held-out fold.  Null labels and ids label nothing."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    if fold:
        known = known.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold != 0)
    some = [known.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in ((1, toxic_rows), (0, clean_rows + spare_rows))]
    chosen = F.broadcast(some[0].unionByName(some[1]))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= longest).join(chosen, "doc_id")
    return [(r[1], r[2]) for r in rows.groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()]


class Scorer:
    """Scores texts within a task, with a bounded cache of unit scores."""

    def __init__(self, model: StringMachine):
        self.model, self.cache = model, {}

    def margins(self, texts: list[str | None]) -> np.ndarray:
        """The highest unit score of each text."""
        split = [units(t) for t in texts]
        if len(self.cache) > CACHE:
            self.cache.clear()
        new = sorted(set().union(*split).difference(self.cache))
        self.cache.update(zip(new, self.model.margins(new).tolist(), strict=True))
        return np.asarray([max(map(self.cache.__getitem__, us), default=EMPTY) for us in split])

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        return self.model.probability(self.margins(texts)).astype(np.float64)


def score_texts(docs: DataFrame, machine: StringMachine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, score, predicted.  A text without units scores as a clean one.

    Rows are scored one by one, repeated ones too; null ids are kept; other columns are ignored; an
    empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in slices(batches, limit=2_000_000):
            score = scorer(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")


def drop_toxic(docs: DataFrame, machine: StringMachine, text_col: str = "text") -> DataFrame:
    """The rows that the machine does not reject, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in slices(batches, text=at, limit=2_000_000):
            yield batch.filter(pa.array(scorer(batch.column(at).to_pylist()) < 0.5))

    return docs.mapInArrow(run, docs.schema)


def score_documents(docs: DataFrame, labels: DataFrame, *, toxic_rows: int = 1500, clean_rows: int = 3000, **options) -> DataFrame:
    """Train on the labelled rows outside the held-out fold, then score every row.

    The fold of a document is crc32(doc_id as text) mod 5; fold 0 is held out (a row without an id is not).  Labels,
    language, source and id are never features.  The machine is fitted on ``toxic_rows`` and ``clean_rows`` rows at most and its
    middle set on 3,000 further clean ones at most, all of 64 KB at most.  Every text is scored whole, however long.  Without toxic or clean
    labelled rows, or with an empty labels table, no unit is told from another: with clean rows only all are clean.
    """
    machine = train(training_rows(docs, labels, toxic_rows=toxic_rows, clean_rows=clean_rows), clean_rows=clean_rows, **options)
    out = score_texts(docs, machine)
    return out.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False)).alias("held_out"), "score", "predicted")
