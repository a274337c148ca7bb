"""Substring deduplication by recompression.

Words become 64-bit names.  A round replaces maximal runs of one name, then pairs of neighbours whose
names fall, by a hash bit, into the left and the right half of the alphabet; what a run or pair is
called depends on its parts alone, so every task of every round gives equal parts the same name without
a central dictionary.  Beside its name a symbol carries the range of words that decided it (its own,
and neighbours that it was kept apart from): wherever those words occur, the symbol occurs.  So a
window that holds a symbol's range holds that symbol in each of its copies.

1. ``rounds`` rounds leave about a sixth as many symbols as words.  Each window stands by one symbol that
   it holds, that of the least name; so its copies stand by the same one.  Names by which windows stand
   twice anywhere in the corpus are found by one shuffle of these names.
2. A window that stands by a shared name may be repeated; any other is provably unique.  (A window
   that holds no symbol's range is taken as a candidate.)  Only candidates are spelled out, as
   fingerprints that travel in runs under their symbol's name, and those that occur twice
   (same symbol, same place in the window, same fingerprint) are repeats.
3. Words under a repeated window are removed.

What a task sees twice itself needs no shuffle: of each name or window a task's chunk sends one row, with
a mark if it held more, so a passage that a third of all documents share reaches a reducer as one row a
chunk.  Shuffled rows are fixed in width; texts are shuffled by document, never by content.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cloakwork.llm.shared import chunks, mix, rolling, signed, slices, word_names

WIDTH = 35
ROUNDS = 6
FAR = 1 << 40
#: Bytes of text that a task works on at a time.
STEP = 3_000_000
#: Marks of a row: its chunk holds the name more than once; known to be shared without looking further.
MANY, KNOWN = 2, 1


def recompress(tokens: np.ndarray, doc: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(names, lo, hi, doc) of the symbols of several documents' joined tokens; [lo, hi) decided the symbol."""
    name, d = mix(tokens), doc
    lo = np.arange(len(tokens), dtype=np.int64)
    hi = lo + 1
    begin, end = lo, hi  # the words that a symbol stands for, which [lo, hi) holds
    for r in range(rounds):
        if not len(name):
            break
        # runs, of one symbol too: that the neighbours differ is part of what decided it.  A neighbour that would
        # lengthen the run has its boundary word, so one other word there settles it; else the neighbour's range does.
        new = np.r_[True, (name[1:] != name[:-1]) | (d[1:] != d[:-1])]
        first = np.flatnonzero(new)
        last = np.r_[first[1:], len(name)] - 1
        count = last - first + 1
        n2, lo2, hi2, d2, begin, end = name[first], lo[first], hi[last], d[first], begin[first], end[last]
        before = np.r_[FAR, d2[1:] - d2[:-1]] == 0
        after = np.r_[before[1:], False]
        other = tokens[np.maximum(begin - 1, 0)] != tokens[end - 1]
        lo2 = np.where(before, np.minimum(lo2, np.where(other, begin - 1, np.r_[0, lo[last[:-1]]])), -FAR)
        other = tokens[np.minimum(end, len(tokens) - 1)] != tokens[begin]
        hi2 = np.where(after, np.maximum(hi2, np.where(other, end + 1, np.r_[hi[first[1:]], 0])), FAR)
        run = np.flatnonzero(count > 1)
        n2[run] = mix(n2[run] * np.uint64(31) + count[run].astype(np.uint64))
        name, lo, hi, d = n2, lo2, hi2, d2
        # pairs: left-half names take a right-half name that follows
        left = (mix(name + np.uint64(7919 * (r + 1))) >> np.uint64(40)) & np.uint64(1) == 0
        pair = np.zeros(len(name), bool)
        pair[:-1] = left[:-1] & ~left[1:] & after[:-1]
        second = np.r_[False, pair[:-1]]
        i = np.flatnonzero(pair)
        lo2, hi2, n2 = lo.copy(), hi.copy(), name.copy()
        lo2[i], hi2[i] = np.minimum(lo[i], lo[i + 1]), np.maximum(hi[i], hi[i + 1])
        n2[i] = mix(name[i] * np.uint64(0x9E3779B97F4A7C15) + mix(name[i + 1] + np.uint64(12345)))
        alone = ~pair & ~second
        # a lone symbol depends on the neighbour that it might have paired with
        k = np.flatnonzero(alone & left & after)
        lo2[k], hi2[k] = np.minimum(lo[k], lo[k + 1]), np.maximum(hi[k], hi[k + 1])
        hi2[alone & left & ~after] = FAR
        k = np.flatnonzero(alone & ~left & before)
        lo2[k], hi2[k] = np.minimum(lo[k], lo[k - 1]), np.maximum(hi[k], hi[k - 1])
        lo2[alone & ~left & ~before] = -FAR
        keep = ~second
        end = end.copy()
        end[i] = end[i + 1]
        name, lo, hi, d, begin, end = n2[keep], lo2[keep], hi2[keep], d[keep], begin[keep], end[keep]
    return name, lo, hi, d


class Parsed:
    """The symbols of a chunk of texts, and which windows hold which."""

    def __init__(self, texts: pa.Array, width: int, rounds: int):
        self.tokens, self.lengths = word_names(texts)
        self.starts = np.r_[0, np.cumsum(self.lengths)]
        owner = np.repeat(np.arange(len(texts)), self.lengths)
        self.width = width
        self.name, self.lo, self.hi, self.doc = recompress(self.tokens, owner, rounds)
        self.usable = np.flatnonzero(self.hi - self.lo <= width)
        first = np.searchsorted(self.doc, np.arange(len(texts)))
        self.index = np.arange(len(self.name)) - first[self.doc] if len(self.name) else np.zeros(0, np.int64)
        room = np.maximum(self.lengths - width + 1, 0)
        #: windows, as the position of their first word in the joined tokens
        self.windows = np.repeat(self.starts[:-1] - np.r_[0, np.cumsum(room)[:-1]], room) + np.arange(room.sum())
        self.owner = owner

    def least_symbols(self) -> np.ndarray:
        """Of the symbols whose range each window (by its first word) holds, the first with the least name; len(self.name) without one.

        It depends on the window's words alone, so a window's copies agree on it.
        """
        out = np.full(len(self.tokens) + 1, len(self.name), np.int64)
        symbols = self.usable[np.argsort(self.name[self.usable], kind="stable")[::-1]]
        begin = np.maximum(self.hi[symbols] - self.width, self.starts[self.doc[symbols]])
        size = self.lo[symbols] + 1 - begin
        place = np.repeat(begin - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        out[place] = np.repeat(symbols, size)  # of several values for a place the last one stays
        return out


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place of each distinct key, whether it occurs again) for places sorted by key."""
    _, first, inverse, count = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    many = count > 1
    return first, many[inverse]


def _symbols(width: int, rounds: int):
    """Step 1: rows (name, doc, crc, at); ``at`` is a symbol's place in its text and, in its two lowest bits, MANY and KNOWN."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=STEP):
            texts = batch.column(1)
            p = Parsed(texts, width, rounds)
            least = p.least_symbols()[p.windows]
            u = np.unique(least[least < len(p.name)])
            first, many = repeated(p.name[u])
            bare = p.windows[least == len(p.name)]  # windows without a symbol
            bare_docs = np.unique(p.owner[bare]) if len(bare) else np.zeros(0, np.int64)
            known = np.flatnonzero(many)
            doc = np.r_[p.doc[u[first]], p.doc[u[known]], bare_docs]
            rest = len(known) + len(bare_docs)
            name = np.r_[signed(p.name[u[first]]), signed(mix(np.r_[p.doc[u[known]], bare_docs].astype(np.uint64) * np.uint64(97) + np.arange(rest, dtype=np.uint64)))]
            at = np.r_[p.index[u[first]], p.index[u[known]], np.full(len(bare_docs), -1)].astype(np.int64)
            flags = np.r_[many[first] * MANY, np.full(rest, MANY | KNOWN)]
            own = pa.array(doc)
            yield pa.RecordBatch.from_arrays([pa.array(name), batch.column(0).take(own), batch.column(2).take(own), pa.array(at * 4 + flags)], ["name", "doc", "crc", "at"])

    return run


def _windows(width: int, rounds: int):
    """Step 2: rows (name, doc, crc, at, off, spelled) of runs of candidate windows; ``at`` holds marks as in step 1.

    The windows at..at+len(spelled)-1 stand by one symbol, called ``name``, whose range begins
    ``off`` words after the first of them; ``spelled`` are the windows' fingerprints.  (A window
    without a symbol is a run of its own under a second fingerprint.)  A known run has ``off``
    windows and no fingerprints.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=STEP):
            p = Parsed(batch.column(1), width, rounds)
            shared = np.zeros(len(p.name) + 1, bool)
            first_symbol = np.searchsorted(p.doc, np.arange(batch.num_rows))
            lists = batch.column(3)
            owner = np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
            at = np.asarray(lists.flatten(), np.int64)
            shared[first_symbol[owner[at >= 0]] + at[at >= 0]] = True
            shared[-1] = True
            anchor = p.least_symbols()[p.windows]
            w, anchor = p.windows[shared[anchor]], anchor[shared[anchor]]
            if not len(w):
                continue
            bare = anchor == len(p.name)
            one, two = rolling(p.tokens, width, 1)[w], rolling(p.tokens, width, 2)[w]
            name = np.where(bare, two, np.r_[p.name, np.uint64(0)][anchor])
            off = np.where(bare, 0, np.r_[p.lo, 0][anchor] - w)
            first, many = repeated(one ^ mix(two))
            head = np.zeros(len(w), bool)
            head[first] = True
            # runs of windows in a row with one anchor, all first of their kind here and all with or without copies here
            h = np.flatnonzero(head)
            cut = np.r_[True, (w[h][1:] != w[h][:-1] + 1) | (anchor[h][1:] != anchor[h][:-1]) | bare[h][1:] | (many[h][1:] != many[h][:-1])]
            begin = h[cut]
            sizes = np.diff(np.r_[np.flatnonzero(cut), len(h)])
            k = np.flatnonzero(many)
            gap = (w[k][1:] != w[k][:-1] + 1) | (p.owner[w[k]][1:] != p.owner[w[k]][:-1])
            known = k[np.r_[True, gap]] if len(k) else k
            length = w[k[np.r_[gap, True]]] + 1 - w[known] if len(k) else k
            row = np.r_[w[begin], w[known]]
            doc = p.owner[row]
            own = pa.array(doc)
            pad = signed(mix(w[known].astype(np.uint64) + np.uint64(17) * doc[len(begin) :].astype(np.uint64)))
            ends = np.r_[0, np.cumsum(sizes), np.full(len(known), len(h))].astype(np.int32)
            columns = [
                pa.array(np.r_[signed(name[begin]), pad]),
                batch.column(0).take(own),
                batch.column(2).take(own),
                pa.array((row - p.starts[doc]) * 4 + np.r_[many[begin] * MANY, np.full(len(known), MANY | KNOWN)]),
                pa.array(np.r_[off[begin], length].astype(np.int32)),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(signed(one[h]))),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["name", "doc", "crc", "at", "off", "spelled"])

    return run


def _removal(width: int):
    """Step 3: what is left of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, limit=STEP):
            n_words, n_removed, kept = [], [], []
            for text, begin, end in zip(texts, batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                words = text.split() if text else []
                n_words.append(len(words))
                if begin:
                    change = np.zeros(len(words) + 1, np.int64)
                    np.add.at(change, np.asarray(begin), 1)
                    np.add.at(change, np.asarray(end) + width - 1, -1)
                    under = np.cumsum(change)[:-1] > 0
                    words = [w for w, gone in zip(words, under.tolist(), strict=True) if not gone]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
            digest = [hashlib.sha256(k).hexdigest() for k in kept]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest), pa.array(kept, pa.binary()), batch.column(1), batch.column(5)], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept", "text", "rest"])

    return run


def _parse(ddl: str) -> list:
    return list(StructType.fromDDL(ddl))


def _shared(rows: DataFrame, *names: str) -> DataFrame:
    """Rows whose name occurs in another row, or more than once in a chunk; rows known beforehand pass.  ``at`` loses its marks."""
    mark = lambda bit: F.col("at").bitwiseAND(F.lit(bit).cast("long")) != 0
    rows = rows.withColumn("known", mark(KNOWN)).withColumn("many", mark(MANY))
    w = Window.partitionBy("known", *names)
    rows = rows.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("some", F.max("many").over(w))
    return rows.filter("known OR (NOT many AND (n > 1 OR some))").withColumn("at", F.shiftright("at", 2).cast("int"))


def repeats(docs: DataFrame, width: int, rounds: int) -> DataFrame:
    """(doc, crc, ranges[]): ranges of first words of repeated windows, each as begin * 2**32 + end.

    Rows that agree in doc and crc are equal texts, so each place is listed once however many they are.
    """
    found = _shared(docs.select("doc", "text", "crc").mapInArrow(_symbols(width, rounds), "name long, doc long, crc long, at long"), "name")
    lists = found.groupBy("doc", "crc").agg(F.collect_set("at").alias("at"))
    texts = docs.join(lists, ["doc", "crc"]).select("doc", "text", "crc", "at", "rest")  # rest only so that this join's shuffle is the last one's, too
    runs = texts.mapInArrow(_windows(width, rounds), "name long, doc long, crc long, at long, off int, spelled array<long>").repartition("name")
    windows = runs.select("name", "doc", "crc", "at", "off", F.posexplode_outer("spelled").alias("k", "more"))
    k = F.coalesce("k", F.lit(0))
    known = F.col("at").bitwiseAND(F.lit(KNOWN).cast("long")) != 0
    first = F.shiftright("at", 2).cast("int")
    windows = windows.select("name", "more", "doc", "crc", (F.col("at") + 4 * k).alias("at"), F.when(known, first + F.col("off")).otherwise(first + k + 1).alias("to"), F.when(~known, F.col("off") - k).alias("off"))
    found = _shared(windows, "name", "off", "more")
    return found.groupBy("doc", "crc").agg(F.collect_set(F.shiftleft(F.col("at").cast("long"), 32) + F.col("to")).alias("ranges"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = WIDTH, rounds: int = ROUNDS, carry: list[str] | None = None) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256, kept (the words left, joined by one space) and the text itself, as binary.

    ``carry`` names columns to pass on in the struct ``rest``.

    A word goes if a window of ``width`` words that covers it also starts anywhere else, in the same
    text or another.  A null or empty text has no words.  Repeated rows are copies of each other (and lose
    their windows); rows are told apart by id and a 64-bit hash of the text, those without an id by two such
    hashes.  Shorter texts have no windows, very long ones are worked on alone.  Other columns are ignored,
    whatever their names; an empty table gives no rows.
    """
    text = F.col(text_col).cast("string").cast("binary")
    plain = F.coalesce(text, F.lit(b""))
    name = F.col(id_col).cast("long")
    # both joins shuffle the very same rows, so Spark does so once
    rest = F.struct(name.alias("id"), F.struct(*([F.col(c) for c in carry] if carry else [F.lit(0).alias("none")])).alias("carried"))
    rows = docs.select(F.coalesce(name, F.xxhash64(F.lit("no id"), plain)).alias("doc"), text.alias("text"), F.xxhash64(plain).alias("crc"), rest.alias("rest"))
    ranges = repeats(rows, width, rounds)
    out = rows.join(ranges, ["doc", "crc"], "left").select("doc", "text", "crc", F.transform("ranges", lambda r: F.shiftright(r, 32).cast("int")).alias("begin"), F.transform("ranges", lambda r: r.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")).alias("end"), "rest")
    out = out.mapInArrow(_removal(width), StructType([*_parse("doc_id long, n_words long, n_removed long, kept_sha256 string, kept binary, text binary"), rows.schema["rest"]]))
    return out.select(F.col("rest.id").alias("doc_id"), "n_words", "n_removed", "kept_sha256", "kept", "text", F.col("rest.carried").alias("rest"))
