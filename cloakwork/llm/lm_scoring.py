"""LM scoring: a causal self-attention model over subword ids, with word probabilities counted on the whole corpus.

A word enters the model as two subword ids, hashes of its first three and of its last three bytes.  From
the ids before it (and a start id), one head of causal attention predicts the word's class (or the end of
the text).  Classes are groups of first subword ids that keep like company in the sample.  The word itself is then
drawn within its class: a known word by its count, an unknown one by the class's escape probability
(Witten-Bell).  ``score`` treats an unknown word as one event, as the base does, so the two compare;
``spelled_score`` also pays for its spelling, under a byte-pair table.

Texts of any length are scored in windows of ``WINDOW`` ids that overlap by ``WINDOW - STRIDE``: the
overlap is context only, so each token is scored once; windows of many texts are one batch, and a mask
hides later ids and those of other texts.

The class and spelling tables come from counts over all training rows (fixed-size tables).  The weights
start from a fit on ``sample_rows`` training rows; then every input split goes once through all windows of
its training rows, and the weights that the splits reach are averaged by their windows, so windows and steps
grow with the corpus and a lost task is redone alone.  Word counts cover all training rows.  Counts of the commonest
words (``frequent`` at most, a fixed bound) are broadcast; the others meet the counts in one join by word, of one
row for each text and distinct rare word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork.llm.shared import mix, signed, slices, word_parts, written

CLASSES = 64
IDS = 1024
WINDOW, STRIDE = 32, 24
#: Places of a window that are context only.
AHEAD = WINDOW - STRIDE
WIDTH = 16
STEP = 2_000_000
LN10 = float(np.log(10))
FOLDS, HELD = 7, 2
#: Rows of the starting fit hold so many bytes at most; longer ones are met in the pass over all rows.
SAMPLE_BYTES = 1 << 15


class Words:
    """Names, counts, subword ids, classes and spelling scores of a binary column's lower-cased words."""

    def __init__(self, column: pa.Array, spelling: np.ndarray | None = None, table: np.ndarray | None = None):
        self.names, self.counts, raw, starts, ends = word_parts(column, lower=True)
        self.row = np.repeat(np.arange(len(column)), self.counts)
        if not len(self.names):
            self.first = self.last = self.classes = np.zeros(0, np.int64)
            return
        three = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF], np.uint64)[np.minimum(ends - starts, 3)]  # what a word has of three bytes
        wide = np.r_[np.zeros(3, np.uint8), raw, np.zeros(3, np.uint8)]
        places = lambda i: wide[i].astype(np.uint64) | wide[i + 1].astype(np.uint64) << np.uint64(8) | wide[i + 2].astype(np.uint64) << np.uint64(16)
        head = places(starts + 3) & three
        wide = wide[::-1]
        tail = places(len(raw) + 3 - ends) & three
        self.first = (mix(head + np.uint64(1)) & np.uint64(IDS - 1)).astype(np.int64)
        self.last = (mix(tail + np.uint64(5)) & np.uint64(IDS - 1)).astype(np.int64)
        self.classes = self.first % CLASSES if table is None else table[self.first]
        self.starts, self.ends, self.raw, self.spelling = starts, ends, raw, spelling

    @property
    def spell(self) -> np.ndarray:
        return self.spelled(np.arange(len(self.names)))

    def spelled(self, chosen: np.ndarray) -> np.ndarray:
        """Spelling scores of some words."""
        if not len(chosen):
            return np.zeros(0)
        place, ends = self.bytes_of(chosen)
        begin = np.r_[0, ends[:-1]]
        now = self.raw[place]
        before = np.r_[np.uint8(0), now[:-1]]
        before[begin] = 0
        return np.add.reduceat(self.spelling[before, now], begin) + self.spelling[now[ends - 1], 0]

    def bytes_of(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in ``raw`` of the bytes of some words, in a row; where among them each word ends)."""
        size = (self.ends - self.starts)[chosen]
        ends = np.cumsum(size)
        return np.repeat(self.starts[chosen] - ends + size, size) + np.arange(ends[-1]), ends


def byte_pairs(words: pa.Array) -> np.ndarray:
    """Counts of (byte, byte before it) of some words, as 256 * before + byte; byte 0 stands for a word's start and end."""
    out = np.zeros(1 << 16, np.int64)
    w = Words(words)
    if len(w.names):
        size = w.ends - w.starts
        place = np.repeat(w.starts - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        before = np.r_[np.uint8(0), w.raw[:-1]]
        before[w.starts] = 0
        out += np.bincount(before[place].astype(np.int64) * 256 + w.raw[place], minlength=1 << 16)
        out += np.bincount(w.raw[w.ends - 1].astype(np.int64) * 256, minlength=1 << 16)
    return out


def spelling_table(pairs: np.ndarray) -> np.ndarray:
    """log P(byte | byte before it) from the counts of byte_pairs."""
    count = pairs.reshape(256, 256) + 0.05
    return np.log(count / count.sum(1, keepdims=True))


def exponentials(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(z, exp(z)) after a shift that keeps the exponentials in range: of all at once where they lie close enough, else row by row."""
    top = z.max()
    z -= top if top - z.min() < 60 else z.max(-1, keepdims=True)
    return z, np.exp(z)


def times(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The places of all windows times a matrix, as one product instead of one a window."""
    return (x.reshape(-1, x.shape[-1]) @ weights).reshape(*x.shape[:-1], -1)


class Attention:
    """Weights of the model and its forward and backward passes on batches of windows."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        d = WIDTH
        new = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {
            "first": new(IDS + 1, d, scale=0.3),
            "last": new(IDS + 1, d, scale=0.3),
            "place": new(WINDOW, d, scale=0.1),
            "qkv": new(d, 3 * d, scale=0.25),
            "mix": new(d, d, scale=0.25),
            "out": new(d, CLASSES + 1, scale=0.2),
            "bias": np.zeros(CLASSES + 1, np.float32),
        }
        self.open = np.tril(np.ones((WINDOW, WINDOW), np.float32))  # no place sees later ones

    def forward(self, first: np.ndarray, last: np.ndarray, hidden: np.ndarray):
        """(z, e, total, parts): P(class) at each of a window's last ``STRIDE`` places is e / total, its logarithm z - log(total).

        Only these places are ever scored; those before them are what they see.
        ``hidden``: how many of a window's first places hold nothing.
        """
        p, d = self.p, WIDTH
        x = p["first"].take(first, axis=0)
        x += p["last"].take(last, axis=0)
        x += p["place"]
        q = times(x[:, AHEAD:], p["qkv"][:, :d])
        kv = times(x, p["qkv"][:, d:])
        k, v = kv[:, :, :d], kv[:, :, d:]
        a = exponentials(q @ k.transpose(0, 2, 1) * np.float32(d**-0.5))[1]
        a *= self.open[AHEAD:]
        if hidden.any():
            some = np.flatnonzero(hidden)
            a[some] *= np.arange(WINDOW)[None, None, :] >= hidden[some][:, None, None]
        a /= times(a, np.ones((WINDOW, 1), np.float32)) + np.float32(1e-30)  # a hidden place sees nothing
        h = a @ v
        y = times(h, p["mix"])
        y += x[:, AHEAD:]
        z = times(y, p["out"])
        z += p["bias"]
        z, e = exponentials(z)
        return z, e, times(e, np.ones((CLASSES + 1, 1), np.float32))[:, :, 0], (x, q, k, v, a, h, y)

    def gradients(self, first, last, hidden, target, good):
        z, e, total, (x, q, k, v, a, h, y) = self.forward(first, last, hidden)
        p, d = self.p, WIDTH
        target, good = target[:, AHEAD:], good[:, AHEAD:]
        b, w = target.shape
        flat = lambda t: t.reshape(-1, t.shape[-1])
        own = np.arange(b * w), target.ravel()
        weight = (good / np.float32(max(1, good.sum()))).astype(np.float32)
        loss = -((flat(z)[own].reshape(b, w) - np.log(total)) * good).sum() / max(1, good.sum())
        g = flat(e)
        g *= (weight / total).reshape(-1, 1)
        g[own] -= weight.ravel()
        out = {"out": flat(y).T @ g, "bias": np.ones(len(g), g.dtype) @ g}
        dy = (g @ p["out"].T).reshape(b, w, d)
        out["mix"] = flat(h).T @ flat(dy)
        dh = times(dy, p["mix"].T)
        ds = dh @ v.transpose(0, 2, 1)
        ds -= np.einsum("bij,bij->bi", ds, a)[:, :, None]
        ds *= a
        ds *= np.float32(d**-0.5)
        dq = ds @ k
        dkv = np.concatenate([ds.transpose(0, 2, 1) @ q, a.transpose(0, 2, 1) @ dh], axis=2)
        out["qkv"] = np.concatenate([flat(x[:, AHEAD:]).T @ flat(dq), flat(x).T @ flat(dkv)], axis=1)
        dx = times(dkv, p["qkv"][:, d:].T)
        dx[:, AHEAD:] += times(dq, p["qkv"][:, :d].T)
        dx[:, AHEAD:] += dy
        out["place"] = dx.sum(0)
        for name, ids in (("first", first), ("last", last)):  # sums by id: rows sorted by id, added up in runs
            ids = ids.ravel().astype(np.int16)  # sorted by their digits, which is faster
            order = np.argsort(ids, kind="stable")
            run = ids[order]
            begin = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
            out[name] = np.zeros_like(p[name])
            out[name][run[begin]] = np.add.reduceat(flat(dx).take(order, axis=0), begin)
        return loss, out

    def fit(self, windows, *, steps: int = 500, batch: int = 192, rate: float = 0.01, seed: int = 9) -> float:
        """Adam on random batches; windows: (first, last, hidden, target, good)."""
        rng = np.random.default_rng(seed)
        state = self.state()
        loss = 0.0
        for t in range(1, steps + 1):
            i = rng.integers(0, len(windows[0]), batch)
            loss = self.step(state, [w[i] for w in windows], rate * (1 - t / (steps + 1)))
        return float(loss)

    def state(self) -> dict:
        return {"t": 0, "m": {n: np.zeros_like(x) for n, x in self.p.items()}, "v": {n: np.zeros_like(x) for n, x in self.p.items()}}

    def step(self, state: dict, windows, rate: float) -> float:
        """One step of Adam; returns the loss before it."""
        loss, g = self.gradients(*windows)
        state["t"] += 1
        t, m, v = state["t"], state["m"], state["v"]
        for n in self.p:
            m[n] = 0.9 * m[n] + 0.1 * g[n]
            v[n] = 0.98 * v[n] + 0.02 * g[n] * g[n]
            self.p[n] -= (rate * (m[n] / (1 - 0.9**t)) / (np.sqrt(v[n] / (1 - 0.98**t)) + 1e-8)).astype(np.float32)
        return float(loss)


def windows_of(words: Words):
    """(first, last, hidden, target, good, row): all windows of all rows; ``good`` are the places to score.

    A row's ids are the start id and its words; the target at a place is the class of the next word, or the end.
    """
    n = words.counts + 1
    starts = np.r_[0, np.cumsum(n)]
    first = np.full(starts[-1], IDS, np.int64)
    last = np.full(starts[-1], IDS, np.int64)
    target = np.full(starts[-1], CLASSES, np.int64)
    place = np.arange(len(words.row)) + words.row
    first[place + 1] = words.first
    last[place + 1] = words.last
    target[place] = words.classes
    begin = starts[:-1]
    first[begin], last[begin] = IDS, IDS
    many = -(-n // STRIDE)
    row = np.repeat(np.arange(len(n)), many)
    number = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    at = (number * STRIDE - (WINDOW - STRIDE))[:, None] + np.arange(WINDOW)[None, :]  # place within the row
    inside = (at >= 0) & (at < n[row][:, None])
    flat = np.where(inside, begin[row][:, None] + at, 0)
    good = inside & (np.arange(WINDOW)[None, :] >= WINDOW - STRIDE)
    hidden = np.maximum(0, (WINDOW - STRIDE) - number * STRIDE)
    return np.where(inside, first[flat], IDS), np.where(inside, last[flat], IDS), hidden, np.where(inside, target[flat], 0), good, row


def class_table(neighbours: np.ndarray, groups: int = 12) -> np.ndarray:
    """Class of each first subword id: ids that follow and precede like ids share a group, large groups have several classes.

    Groups are found among the leading singular vectors of the normalised counts of neighbours
    (``neighbours``: how often an id follows another).
    """
    out = np.arange(IDS) % CLASSES
    if neighbours.sum() < 1000:
        return out
    count = neighbours.astype(np.float32)
    count = count + count.T
    total = count.sum(1) + 1e-3
    vectors, values, _ = np.linalg.svd(count / np.sqrt(total[:, None] * total[None, :]), hermitian=True)
    x = vectors[:, 1:8] * values[1:8] / np.sqrt(total / total.sum())[:, None]
    x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-9
    centres = [int(np.argmax(total))]
    for _ in range(groups - 1):  # farthest first, among ids with some weight
        far = np.min([((x - x[c]) ** 2).sum(1) for c in centres], axis=0) * np.sqrt(total)
        centres.append(int(np.argmax(far)))
    middle = x[centres]
    for _ in range(20):
        own = np.argmin(((x[:, None, :] - middle[None]) ** 2).sum(2), axis=1)
        for g in range(groups):
            if (own == g).any():
                middle[g] = np.average(x[own == g], axis=0, weights=total[own == g])
    share = np.bincount(own, total, minlength=groups) / total.sum()
    parts = np.maximum(1, np.floor(share * (CLASSES - groups)).astype(int))
    start = np.r_[0, np.cumsum(parts)]
    for g in range(groups):
        ids = np.flatnonzero(own == g)
        ids = ids[np.argsort(-total[ids], kind="stable")]
        out[ids] = start[g] + np.arange(len(ids)) % parts[g]
    return out


class Model:
    def __init__(self, attention: Attention, spelling: np.ndarray, table: np.ndarray):
        self.attention, self.spelling, self.table = attention, spelling, table

    def class_scores(self, words: Words) -> np.ndarray:
        """Sum of log P(class) over each row's tokens, the end included."""
        first, last, hidden, target, good, row = windows_of(words)
        out = np.zeros(len(words.counts))
        for a in range(0, len(row), 256):
            b = slice(a, a + 256)
            z, _, total, _ = self.attention.forward(first[b], last[b], hidden[b])
            own = np.take_along_axis(z, target[b][:, AHEAD:, None], 2)[:, :, 0] - np.log(total)
            np.add.at(out, row[b], np.where(good[b][:, AHEAD:], own, 0).sum(1, dtype=np.float64))
        return out


def train(texts: list[bytes], table: np.ndarray, *, steps: int = 500, seed: int = 5) -> Attention:
    """Weights to start from, fitted on sample texts."""
    attention = Attention(seed)
    first, last, hidden, target, good, _ = windows_of(Words(pa.array(texts or [b""], pa.binary()), table=table))
    attention.fit((first, last, hidden, target, good), steps=steps)
    return attention


def _passes(model, batch: int = 192, rate: float = 0.002):
    """(windows, weights): the weights after one pass of Adam over all windows of a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attention = Attention()
        attention.p = {n: x.copy() for n, x in model.value.attention.p.items()}
        state = attention.state()
        rng, seen, held = np.random.default_rng(9), 0, None
        for rows in slices(batches, limit=STEP // 4):
            new = windows_of(Words(rows.column(1), table=model.value.table))[:5]
            held = new if held is None else tuple(np.concatenate(x) for x in zip(held, new, strict=True))
            order = rng.permutation(len(held[0]))
            full = len(order) // batch * batch
            for a in range(0, full, batch):
                attention.step(state, [w[order[a : a + batch]] for w in held], rate)
            seen += full
            held = tuple(w[order[full:]] for w in held)
        if held is not None and len(held[0]):
            attention.step(state, held, rate * len(held[0]) / batch)
            seen += len(held[0])
        if seen:
            flat = np.concatenate([x.ravel() for x in attention.p.values()]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([flat.tobytes()], pa.binary())], ["windows", "weights"])

    return run


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(windows, weights): the sum of several tasks' weights, each times its windows."""
    total, flat = 0, None
    for batch in batches:
        for n, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = np.frombuffer(raw.as_buffer(), np.float32).astype(np.float64) * n
            total, flat = total + n, own if flat is None else flat + own
    if total:
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64()), pa.array([flat.tobytes()], pa.binary())], ["windows", "weights"])


def refined(model, training: DataFrame) -> Attention:
    """One pass over all training rows: each input split goes on from the given weights by itself, and what the splits reach
    is averaged by their windows, on the executors first (at most eight sums reach the driver)."""
    passed = training.mapInArrow(_passes(model), "windows long, weights binary").repartition(8)
    found = passed.mapInArrow(_sums, "windows long, weights binary").collect()
    out = Attention()
    out.p = {n: x.copy() for n, x in model.value.attention.p.items()}
    if found:
        total = sum(r[0] for r in found)
        flat = sum(np.frombuffer(r[1], np.float64) / total for r in found)
        at = 0
        for n, x in out.p.items():
            out.p[n] = flat[at : at + x.size].reshape(x.shape).astype(np.float32)
            at += x.size
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, first, word, count) of words, and with first -1 (IDS * id + next id, -1, null, count) of neighbours."""
    near = np.zeros(IDS * IDS, np.int64)
    names = ["name", "first", "word", "count"]
    for batch in slices(batches, limit=2 * STEP):
        w = Words(batch.column(1))
        if not len(w.names):
            continue
        same = np.flatnonzero(w.row[1:] == w.row[:-1])
        near += np.bincount(w.first[same] * IDS + w.first[same + 1], minlength=IDS * IDS)
        found = pa.array(signed(w.names)).dictionary_encode()
        code, name = found.indices.to_numpy(), found.dictionary
        count = np.bincount(code)
        one = np.empty(len(name), np.int64)
        one[code] = np.arange(len(code))  # a place of each word
        place, ends = w.bytes_of(one)
        word = pa.Array.from_buffers(pa.binary(), len(one), [None, pa.py_buffer(np.r_[0, ends].astype(np.int32)), pa.py_buffer(w.raw[place])])
        yield pa.RecordBatch.from_arrays([name, pa.array(w.first[one].astype(np.int32)), word, pa.array(count)], names)
    found = np.flatnonzero(near)
    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.full(len(found), -1, np.int32)), pa.nulls(len(found), pa.binary()), pa.array(near[found])], names)


def _spellings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = np.zeros(1 << 16, np.int64)
    for batch in slices(batches, text=0, limit=STEP):
        out += byte_pairs(batch.column(0))
    found = np.flatnonzero(out)
    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(out[found])], ["pair", "count"])


def _dense(rows: DataFrame, size: int) -> np.ndarray:
    """A table of ``size`` counts from rows (place, count)."""
    found = rows.toArrow()
    out = np.zeros(size, np.int64)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return out


class Statistics:
    """What scoring needs of the corpus: totals, by class, and the commonest words."""

    def __init__(self, tokens: int, distinct: int, by_class: np.ndarray, names: np.ndarray, counts: np.ndarray):
        self.tokens, self.distinct, self.by_class = tokens, distinct, by_class  # by_class: tokens, distinct words
        self.names, self.counts = names, counts

    def known(self, names: np.ndarray) -> np.ndarray:
        """Counts of the commonest words, 0 for others."""
        at = pa.compute.index_in(pa.array(names), value_set=pa.array(self.names)).fill_null(len(self.names)).to_numpy()
        return np.r_[self.counts, 0][at]

    def base(self, count):
        return np.log((count + 1) / (self.tokens + self.distinct + 1))

    def escape(self, classes: np.ndarray) -> np.ndarray:
        """log probability of an unknown word within a class (a class without words: certain)."""
        n, v = self.by_class[:, 0], self.by_class[:, 1]
        return np.log(np.where(n > 0, v / np.maximum(n + v, 1), 1.0))[classes]

    def within(self, count: np.ndarray, classes: np.ndarray) -> np.ndarray:
        return np.log(count / (self.by_class[classes, 0] + self.by_class[classes, 1]))


SCORED = "row long, doc long, n_tokens long, known long, base double, model double, rare array<struct<name:long,times:int,class:int,spell:float>>"


def _scored(model, statistics):
    """Per row: a row number, tokens, known ones, base and model sums, as far as the commonest words and classes go, and
    the distinct other words with their times, class and spelling score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, s = model.value, statistics.value
        number = TaskContext.get().partitionId() << 33
        for batch in slices(batches, limit=STEP):
            w = Words(batch.column(1), m.spelling, m.table)
            count = s.known(signed(w.names))
            often = count > 0
            n = batch.num_rows
            sums = lambda x: np.bincount(w.row[often], x, minlength=n).astype(np.float64)  # noqa: E731, B023
            rare = np.flatnonzero(~often)
            order = rare[np.lexsort((w.names[rare], w.row[rare]))]
            new = np.ones(len(order), bool)
            new[1:] = (w.names[order][1:] != w.names[order][:-1]) | (w.row[order][1:] != w.row[order][:-1])
            one = order[new]
            times = np.diff(np.r_[np.flatnonzero(new), len(order)])
            ends = np.searchsorted(w.row[one], np.arange(n + 1)).astype(np.int32)
            parts = [pa.array(signed(w.names[one])), pa.array(times.astype(np.int32)), pa.array(w.classes[one].astype(np.int32)), pa.array(w.spelled(one).astype(np.float32))]
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(parts, ["name", "times", "class", "spell"]))
            columns = [number + np.arange(n), w.counts + 1, sums(np.ones(often.sum())).astype(np.int64), sums(s.base(count[often])), sums(s.within(count[often], w.classes[often])) + m.class_scores(w)]
            first, *rest = map(pa.array, columns)
            number += n
            yield pa.RecordBatch.from_arrays([first, batch.column(0), *rest, lists], ["row", "doc", "n_tokens", "known", "base", "model", "rare"])

    return run


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD, F.lit(False))


def learned(training: DataFrame, sample_rows: int, steps: int):
    """(broadcast model, counts of words by name with their class) of training rows (doc, text)."""
    context = training.sparkSession.sparkContext
    found = training.mapInArrow(_counts, "name long, first int, word binary, count long").groupBy("name", "first", "word").agg(F.sum("count").alias("count"))
    found = written(found, "counts")
    words = found.filter("first >= 0")
    table = class_table(_dense(found.filter("first < 0").select("name", "count"), IDS * IDS).reshape(IDS, IDS))
    pairs = words.select("word").mapInArrow(_spellings, "pair long, count long").groupBy("pair").agg(F.sum("count").alias("count"))
    spelling = spelling_table(_dense(pairs, 1 << 16))
    short = training.filter(F.octet_length("text") <= SAMPLE_BYTES)
    last = short.select(F.xxhash64("doc").alias("h")).orderBy("h").limit(sample_rows).agg(F.max("h")).first()[0]
    sample = short.filter(F.xxhash64("doc") <= F.lit(last if last is not None else 0)).orderBy("doc", "text").limit(sample_rows).select("text").collect()
    start = context.broadcast(Model(train([bytes(r[0]) for r in sample], table, steps=steps), spelling, table))
    model = context.broadcast(Model(refined(start, training), spelling, table))
    classes = F.from_json(F.lit(str(table.tolist())), "array<int>")
    return model, words.select("name", F.get(classes, F.col("first")).alias("class"), "count")


def commonest(counts: DataFrame, most: int) -> DataFrame:
    """Words (name, count) from the least count on that leaves ``most`` of them at most, found from a histogram of counts."""
    step = F.floor(F.log2("count") * 16).cast("int")  # few steps, whatever the counts
    found = sorted(((r[0], r[1]) for r in counts.groupBy(step.alias("step")).count().collect()), reverse=True)
    total, least = 0, None
    for at, n in found:
        total += n
        if total > most:
            break
        least = at
    return counts.filter(step >= F.lit(least if least is not None else 1 << 30)).select("name", "count")


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, sample_rows: int = 800, frequent: int = 1 << 16, steps: int = 500) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, spelled_score.

    ``score`` is the log10 probability of the text where an unknown word, as in ``base_score``, is one event: it
    compares with the base on the same events.  ``spelled_score`` is that of the text with every unknown word's
    bytes paid for, too.  Learns from rows whose crc32(doc_id as text) mod 7 is not 2 (a null id learns, too).
    A null or empty text is one end token.  Texts of any length are scored whole.  Repeated rows count each and
    are scored each, ties alike; other columns are ignored, whatever their names; an empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), text.alias("text"))
    training = rows.filter(~held_out(F.col("doc")))
    model, counts = learned(training, sample_rows, steps)
    ends = training.count()
    by_class = np.zeros((CLASSES, 2))
    for r in counts.groupBy("class").agg(F.sum("count"), F.count(F.lit(1))).collect():
        by_class[r[0]] = r[1], r[2]
    top = commonest(counts, frequent).toArrow()
    tokens, distinct = int(by_class[:, 0].sum()) + ends, int(by_class[:, 1].sum()) + (ends > 0)
    statistics = spark.sparkContext.broadcast(Statistics(tokens, distinct, by_class, top.column(0).to_numpy().astype(np.int64), top.column(1).to_numpy().astype(np.int64)))

    scored = written(rows.mapInArrow(_scored(model, statistics), SCORED), "scored")  # once, so a row's number is its own
    rare = scored.select("row", F.inline("rare"))
    escapes = F.from_json(F.lit("[" + ",".join(repr(float(x)) for x in statistics.value.escape(np.arange(CLASSES))) + "]"), "array<double>")
    sizes = F.from_json(F.lit("[" + ",".join(repr(float(n + v)) for n, v in by_class) + "]"), "array<double>")
    word = F.when(F.col("count").isNotNull(), F.log(F.col("count") / F.get(sizes, F.col("class")))).otherwise(F.get(escapes, F.col("class")))
    spell = F.when(F.col("count").isNull(), F.col("spell").cast("double")).otherwise(0.0)
    base = F.log((F.coalesce("count", F.lit(0)) + 1) / F.lit(float(tokens + distinct + 1)))
    met = rare.join(counts.select("name", "count"), "name", "left").select("row", F.when(F.col("count").isNotNull(), F.col("times")).otherwise(0).alias("known"), (F.col("times") * base).alias("base"), (F.col("times") * word).alias("word"), (F.col("times") * spell).alias("spell"))
    more = met.groupBy("row").agg(F.sum("known").alias("more_known"), F.sum("base").alias("more_base"), F.sum("word").alias("more_word"), F.sum("spell").alias("more_spell"))
    end = float(np.log((ends + 1) / (tokens + distinct + 1)))
    plus = lambda c: F.coalesce(c, F.lit(0.0))
    return scored.drop("rare").join(more, "row", "left").select(
        F.col("doc").alias("doc_id"),
        held_out(F.col("doc")).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0)) + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        ((F.col("base") + plus(F.col("more_base")) + end) / LN10).alias("base_score"),
        ((F.col("model") + plus(F.col("more_word"))) / LN10).alias("score"),
        ((F.col("model") + plus(F.col("more_word") + F.col("more_spell"))) / LN10).alias("spelled_score"),
    )
