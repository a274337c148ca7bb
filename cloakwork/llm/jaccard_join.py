"""N-gram Jaccard join: exact, with prefix trees over globally ordered shingle sets.

A document's set holds the fingerprints of its distinct word shingles.  All sets share one order:
frequent shingles come last, the rest by fingerprint.  Documents with equal sets form a class, named
by the set's signature; everything below works on classes.

* If two sets of sizes n <= m reach Jaccard t, their first n - ceil(t n) + 1 and m - ceil(t m) + 1
  shingles (the prefixes) share one, n >= t m, and the overlap is at least o = ceil(t (n + m) / (1 + t)).
* Prefix shingles that one class alone has are dropped after one shuffle; what is left is written.
* Links inside a large group of near copies are found as stars first: each prefix shingle proposes
  up to three leaders, every class is compared with those it shares most with.
* Then all other candidates are found exactly: pairs that share a prefix shingle, are alike in size
  and are not already connected by those links.  A pair that shares c light (not frequent) prefix shingles can
  overlap in c + (frequent ones in either prefix) + (what follows the larger prefix) at most; for a
  frequent shingle, as if it were the first they share, in 1 + (what follows it in either set).
  Only pairs whose bound reaches o are kept.
* Candidates are verified on their whole sets: the sets to be compared with one class are stored in a
  prefix tree (as the sorted sequences, whose common beginnings are its inner nodes); a traversal keeps the
  overlap of the path so far, shares it among all sets below, and leaves a subtree as soon as the
  overlap plus the remaining length cannot reach o.  A class with many candidates is split.
* Components of the verified links by least-label propagation with pointer jumping.

Texts are never shuffled.  The table of frequent shingles is bounded (``frequent``) and only sets the order,
so results do not depend on it; the bitmap that preselects sets is bounded too and has no false negatives.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloakwork.llm.shared import mix, rolling, slices, word_names, written

SHINGLE = 5
LIGHT_BITS = 62
#: Bytes of text that a task works on at a time.
STEP = 3_000_000
#: Classes to compare up to which their names travel as a bitmap of 16 bits each (16 MB at most); beyond, rows meet them in a join.
BITMAP_CLASSES = 1 << 23
#: Sets that are compared with one class by one task.
BLOCK = 256


class Sets:
    """The ordered shingle sets of a column of texts: ``flat`` (order values), ``starts``, ``sizes`` and ``names``."""

    def __init__(self, texts: pa.Array, heavy: np.ndarray, shingle: int):
        words, counts = word_names(texts, lower=True)
        begin = np.r_[0, np.cumsum(counts)]
        room = np.where(counts >= shingle, counts - shingle + 1, np.minimum(counts, 1))
        starts = np.r_[0, np.cumsum(room)]
        values = np.empty(starts[-1], np.uint64)
        long = np.repeat(counts >= shingle, room)
        place = np.repeat(begin[:-1] - starts[:-1], room) + np.arange(starts[-1])
        if long.any():
            values[long] = rolling(words, shingle, 5)[place[long]]
        for i in np.flatnonzero((counts > 0) & (counts < shingle)):
            values[starts[i]] = reduce(lambda h, w: mix(h * np.uint64(31) + w), words[begin[i] : begin[i + 1], None], mix(np.full(1, counts[i], np.uint64)))[0]
        del words, long, place
        flat = (values >> np.uint64(64 - LIGHT_BITS)).view(np.int64)
        if len(heavy):  # frequent shingles: by their place in the table, after all others
            at = np.minimum(np.searchsorted(heavy["value"], flat), len(heavy) - 1)
            flat = np.where(heavy["value"][at] == flat, (1 << LIGHT_BITS) + heavy["rank"][at], flat)
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            if b - a > 1:
                flat[a:b].sort()
        owner = np.repeat(np.arange(len(counts)), room)
        first = np.ones(len(flat), bool)
        first[1:] = (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])
        self.flat, owner = flat[first], owner[first]
        self.sizes = np.bincount(owner, minlength=len(counts)).astype(np.int64)
        self.starts = np.r_[0, np.cumsum(self.sizes)]
        # a class's name is a sum over its shingles' fingerprints, so the order plays no part
        plain = self.flat
        if len(heavy):
            plain = plain.copy()
            frequent = np.flatnonzero(plain >= 1 << LIGHT_BITS)
            by_rank = np.empty(len(heavy), np.int64)
            by_rank[heavy["rank"]] = heavy["value"]
            plain[frequent] = by_rank[plain[frequent] - (1 << LIGHT_BITS)]
        total = np.r_[np.uint64(0), np.cumsum(mix(plain.astype(np.uint64) + np.uint64(77)))]
        self.names = mix((total[self.starts[1:]] - total[self.starts[:-1]]) + self.sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)

    def distinct(self) -> np.ndarray:
        """One row of each class that has shingles."""
        _, first = np.unique(self.names, return_index=True)
        return first[self.sizes[first] > 0]

    def members(self, rows: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in flat, row index) of the first ``length`` shingles of each row."""
        owner = np.repeat(np.arange(len(rows)), length)
        return np.repeat(self.starts[rows] - np.r_[0, np.cumsum(length)[:-1]], length) + np.arange(length.sum()), owner


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return n - -(-n * percent // 100) + 1


def least_overlap(n, m, percent: int):
    """Least common shingles of two sets of these sizes: 100 i >= percent (n + m - i)."""
    return -(-(n + m) * percent // (100 + percent))


NONE = np.zeros(0, [("value", np.int64), ("rank", np.int64)])


def _overview(shingle: int):
    """(doc_id, mark, class, n, value[], count[]) of every row; a chunk's first row has the shingles that several of its classes hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=STEP):
            s = Sets(batch.column(1), NONE, shingle)
            rows = s.distinct()
            at, _ = s.members(rows, s.sizes[rows])
            value = np.sort(s.flat[at])
            edges = np.flatnonzero(np.r_[True, value[1:] != value[:-1], True]) if len(value) else np.zeros(1, np.int64)
            count = np.diff(edges)
            many = count > 2
            offsets = pa.array(np.r_[0, np.full(batch.num_rows, many.sum())].astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (value[edges[:-1]][many], count[many])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(s.names), pa.array(s.sizes), *lists], ["doc_id", "mark", "class", "n", "value", "count"])

    return run


def _prefixes(heavy, shingle: int, percent: int):
    """(key, class, n, at, heavies): the prefix shingles of each class of a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=STEP):
            s = Sets(batch.column(1), heavy.value, shingle)
            rows = s.distinct()
            n = s.sizes[rows]
            length = prefix_length(n, percent)
            at, owner = s.members(rows, length)
            key = s.flat[at]
            heavies = np.bincount(owner[key >= 1 << LIGHT_BITS], minlength=len(rows))
            place = at - s.starts[rows][owner]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(s.names[rows][owner]), pa.array(n[owner].astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(heavies[owner].astype(np.int32))], ["key", "class", "n", "at", "heavies"])

    return run


def _chosen(heavy, bitmap, size: int, shingle: int):
    """(class, tokens) of classes that the bitmap may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=STEP):
            s = Sets(batch.column(1), heavy.value, shingle)
            rows = s.distinct()
            yield spelled(s, rows[in_bitmap(bitmap.value, s.names[rows], size)])

    return run


def _named(shingle: int):
    """(class, text): one row of each class of a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=STEP):
            s = Sets(batch.column(1), NONE, shingle)
            rows = s.distinct()
            yield pa.RecordBatch.from_arrays([pa.array(s.names[rows]), batch.column(1).take(pa.array(rows))], ["class", "text"])

    return run


def _spelled(heavy, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=STEP):
            s = Sets(batch.column(1), heavy.value, shingle)
            yield spelled(s, s.distinct())

    return run


def spelled(s: Sets, rows: np.ndarray) -> pa.RecordBatch:
    """(class, tokens) of some rows."""
    at, _ = s.members(rows, s.sizes[rows])
    ends = np.r_[0, np.cumsum(s.sizes[rows])].astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(s.names[rows]), pa.ListArray.from_arrays(pa.array(ends), pa.array(s.flat[at]))], ["class", "tokens"])


def bit_places(names: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix(names.astype(np.int64).view(np.uint64))
    return (h & np.uint64(size - 1)).astype(np.int64), ((h >> np.uint64(32)) & np.uint64(size - 1)).astype(np.int64)


def in_bitmap(words: np.ndarray, names: np.ndarray, size: int) -> np.ndarray:
    """Whether a bitmap of 64-bit words holds the names; it may hold others, too."""
    a, b = bit_places(names, size)
    held = lambda x: (words[x >> 6] >> (x & 63).astype(np.uint64)) & np.uint64(1)
    return (held(a) & held(b)).astype(bool)


def _places(size: int):
    """(word, bits): the words of a bitmap that classes set, and which bits of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(np.concatenate(bit_places(np.asarray(batch.column(0)), size)))
            word, first = np.unique(at >> 6, return_index=True)
            bits = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first) if len(at) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bits.view(np.int64))], ["word", "bits"])

    return run


def bitmap_of(classes: DataFrame, size: int) -> np.ndarray:
    """A bitmap of ``size`` bits of the classes, put together by word; it reaches the driver once."""
    found = classes.select("class").mapInArrow(_places(size), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(max(1, size >> 6), np.uint64)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy().astype(np.int64).view(np.uint64)
    return out


def _groups(work):
    """Apply ``work`` to the rows of one key after the other (batches are sorted by key; a key may span batches)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []  # batches of the last key so far, joined once it ends
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.asarray(batch.column(0))
            if rest and rest[0].column(0)[-1].as_py() != key[-1]:
                last = int(np.searchsorted(key, key[-1]))
                yield from work(pa.Table.from_batches([*rest, batch.slice(0, last)]))
                rest = [batch.slice(last)]
            elif rest or key[0] == key[-1]:
                rest.append(batch)
            else:
                last = int(np.searchsorted(key, key[-1]))
                yield from work(pa.Table.from_batches([batch.slice(0, last)]))
                rest = [batch.slice(last)]
        if rest:
            yield from work(pa.Table.from_batches(rest))

    return run


def _stars(percent: int):
    """(class, leader, kind): each class with leaders of its key that are alike in size.

    Leaders are the class most of whose prefix shingles others have too (kind 0: the likely centre
    of a group of near copies), the smallest set (1), and one by hash (2); what is not alike in size
    elects leaders of its own.
    """

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key, name, n, live = (table.column(i).to_numpy() for i in range(4))
        part = -live / prefix_length(n.astype(np.int64), percent)
        by = (part, n, mix(name.view(np.uint64)))
        edges = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
        pairs: list[np.ndarray] = []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            for kind, value in enumerate(by):
                rest = np.arange(a, b)
                while len(rest) > 1:
                    lead = rest[np.lexsort((name[rest], value[rest]))[0]]
                    alike = (np.minimum(n[rest], n[lead]) * 100 >= np.maximum(n[rest], n[lead]) * percent) & (rest != lead)
                    if alike.any():
                        pairs.append(np.c_[name[rest[alike]], np.full((alike.sum(), 2), (name[lead], kind))])
                    rest = rest[~alike & (rest != lead)]
                if b - a == 2:  # the other kinds would elect the same pair
                    break
        found = np.concatenate(pairs) if pairs else np.zeros((0, 3), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(found[:, i].copy()) for i in range(3)], ["class", "leader", "kind"])

    return _groups(work)


def _candidates(percent: int):
    """(a, b, strong, count, n, m, heavies): pairs of one key that are alike in size and not of one star."""

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key, name, n, at, heavies, star = (table.column(i).to_numpy() for i in range(6))
        edges = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
        out: list[tuple[np.ndarray, ...]] = []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            own = a + np.argsort(n[a:b], kind="stable")
            if star[own].min() == star[own].max():
                continue
            to = np.searchsorted(n[own] * percent, n[own] * 100, side="right")  # sizes up to n * 100 / percent
            for first in range(0, len(own), 256):  # blocks against the window of alike sizes
                i = np.arange(first, min(first + 256, len(own)))
                j = np.arange(first, int(to[i].max()))
                x, y = own[i][:, None], own[j][None, :]
                good = (j[None, :] > i[:, None]) & (j[None, :] < to[i][:, None]) & (star[x] != star[y])
                if key[a] >= 1 << LIGHT_BITS:
                    good &= 1 + np.minimum(n[x] - at[x], n[y] - at[y]) - 1 >= least_overlap(n[x].astype(np.int64), n[y], percent)
                p, q = np.nonzero(good)
                if len(p):
                    x, y = own[i[p]], own[j[q]]
                    swap = name[x] > name[y]
                    x, y = np.where(swap, y, x), np.where(swap, x, y)
                    out.append((name[x], name[y], np.full(len(x), key[a] >= 1 << LIGHT_BITS), n[x], n[y], np.minimum(heavies[x], heavies[y])))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["a", "b", "strong", "n", "m", "heavies"])

    return _groups(work)


class PrefixTree:
    """Ordered sets as sorted sequences; their common beginnings are the inner nodes of the tree."""

    def __init__(self, sets: list[np.ndarray]):
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">i8").tobytes())
        self.sets = [sets[i] for i in self.order]
        #: how much of each sequence the one before it shares
        self.shared = [0]
        for a, b in zip(self.sets, self.sets[1:], strict=False):
            k = min(len(a), len(b))
            other = np.flatnonzero(a[:k] != b[:k])
            self.shared.append(int(other[0]) if len(other) else k)

    def linked(self, probe: np.ndarray, percent: int, step: int = 64) -> list[int]:
        """Indices of the sets that reach the similarity with ``probe``.

        Where a path is left because not even the longest set below it can reach the overlap, all sets below
        are stepped over at once; of ``visited`` sets some part was looked at.
        """
        out = []
        path = np.zeros(1, np.int64)  # overlap of each beginning of the current path, as far as it was followed
        sizes, shared = np.asarray([len(s) for s in self.sets]), np.asarray(self.shared)
        self.visited = 0
        i = 0
        while i < len(self.sets):
            own = self.sets[i]
            n = len(own)
            self.visited += 1
            need = int(least_overlap(len(probe), n, percent))
            depth = min(int(shared[i]), len(path) - 1)
            path = path[: depth + 1]
            pieces = [path]
            overlap = int(path[-1])
            while depth < n and overlap < need <= overlap + n - depth:
                part = own[depth : depth + step]
                place = np.minimum(np.searchsorted(probe, part), len(probe) - 1)
                along = overlap + np.cumsum(probe[place] == part)
                pieces.append(along)
                overlap = int(along[-1])
                depth += len(part)
            if len(pieces) > 1:
                path = np.concatenate(pieces)
            if overlap >= need:
                out.append(self.order[i])
                i += 1
                continue
            # left at this depth: the sets that share the path so far
            below = shared[i + 1 :] < depth
            to = i + 1 + (int(np.argmax(below)) if below.any() else len(below)) if depth else i + 1
            longest = int(sizes[i:to].max())
            i = to if overlap + longest - depth < int(least_overlap(len(probe), longest, percent)) else i + 1
        return out


def _verify(percent: int):
    """Rows (lead, part, probe, class, tokens) sorted so that a block's probe comes first -> (a, b) that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray]] = []
        now, probe = None, None

        def links() -> pa.RecordBatch:
            found = PrefixTree([t for _, t in held]).linked(probe, percent) if held and probe is not None else []
            return pa.RecordBatch.from_arrays([pa.array([now[0]] * len(found), pa.int64()), pa.array([held[i][0] for i in found], pa.int64())], ["a", "b"])

        for batch in batches:
            lists = batch.column(4)
            offsets = np.asarray(lists.offsets)
            tokens = np.asarray(lists.values)
            lead, part, is_probe, name = (batch.column(i).to_pylist() for i in range(4))
            for r in range(batch.num_rows):
                if (lead[r], part[r]) != now:
                    if held:
                        yield links()
                    now, probe = (lead[r], part[r]), None
                    held = []
                own = tokens[offsets[r] : offsets[r + 1]].copy()
                if is_probe[r]:
                    probe = own
                else:
                    held.append((name[r], own))
        if held:
            yield links()

    return run


def verified(pairs: DataFrame, rows: DataFrame, heavy, shingle: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose whole sets link; written.  The partners of one class are dealt out in blocks of about ``BLOCK``."""
    spark = rows.sparkSession
    large = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts")).filter("parts > 1")
    blocks = pairs.join(large, "a", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("b"), F.col("parts")), F.lit(0)).cast("int").alias("part"))
    members = blocks.select(F.col("a").alias("lead"), "part", F.lit(False).alias("probe"), F.col("b").alias("class"))
    probes = blocks.select(F.col("a").alias("lead"), "part", F.lit(True).alias("probe"), F.col("a").alias("class")).distinct()
    needed = written(members.unionByName(probes), "needed")
    wanted = needed.select("class").distinct()
    n = wanted.count()
    if n <= BITMAP_CLASSES:
        size = 1 << max(10, (16 * n - 1).bit_length())
        sets = rows.mapInArrow(_chosen(heavy, spark.sparkContext.broadcast(bitmap_of(wanted, size)), size, shingle), "class long, tokens array<long>")
    else:
        sets = rows.select("doc_id", "text").mapInArrow(_named(shingle), "class long, text binary").join(wanted, "class", "left_semi").mapInArrow(_spelled(heavy, shingle), "class long, tokens array<long>")
    sets = sets.groupBy("class").agg(F.first("tokens").alias("tokens"))
    met = needed.join(sets, "class").select("lead", "part", "probe", "class", "tokens")
    met = met.repartition("lead", "part").sortWithinPartitions("lead", "part", F.desc("probe"))
    return written(met.mapInArrow(_verify(percent), "a long, b long"), "links")


def components(links: DataFrame) -> DataFrame:
    """(class, root) of every class that has a link: the least class that it reaches."""
    both = written(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).select(F.col("a").alias("class"), "root"), "labels")
    while True:
        near = both.join(labels.select(F.col("class").alias("b"), F.col("root").alias("r")), "b").groupBy(F.col("a").alias("class")).agg(F.min("r").alias("r"))
        step = labels.join(near, "class").select("class", F.col("root").alias("old"), F.least("root", "r").alias("root"))
        jump = step.join(labels.select(F.col("class").alias("root"), F.col("root").alias("up")), "root").select("class", "old", F.least("root", "up").alias("root"))
        new = written(jump, "labels")
        labels = new.select("class", "root")
        if new.filter("old != root").isEmpty():
            return labels


def grouped(docs: DataFrame, id_col: str, text_col: str, *, shingle: int = SHINGLE, percent: int = 80, frequent: int = 1 << 17, frequent_from: int = 24) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): doc_id, mark (a hash of the text), class and n (set size) of every row, and class, n, first (the
    least row: ids first, then marks) and root of every class that has shingles."""
    spark = docs.sparkSession
    text = F.col(text_col).cast("string").cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("mark"))
    overview = written(rows.mapInArrow(_overview(shingle), "doc_id long, mark long, class long, n long, value array<long>, count array<long>"), "classes")
    base = overview.select("doc_id", "mark", "class", "n")
    often = overview.select(F.inline(F.arrays_zip("value", "count"))).groupBy("value").agg(F.sum("count").alias("count")).filter(F.col("count") >= frequent_from)
    top = [(r[0], r[1]) for r in often.orderBy(F.desc("count"), "value").limit(frequent).collect()]
    table = np.asarray([(v, i) for i, (v, _) in enumerate(reversed(top))], NONE.dtype)
    heavy = spark.sparkContext.broadcast(np.sort(table, order="value"))

    entries = rows.mapInArrow(_prefixes(heavy, shingle, percent), "key long, class long, n int, at int, heavies int").repartition("key")
    entries = entries.groupBy("key", "class").agg(*[F.first(c).alias(c) for c in ("n", "at", "heavies")])
    entries = entries.withColumn("own", F.count(F.lit(1)).over(Window.partitionBy("key"))).filter("own > 1").drop("own")
    entries = entries.withColumn("live", F.count(F.lit(1)).over(Window.partitionBy("class")))
    entries = written(entries.select("key", "class", "n", "at", "heavies", "live"), "prefixes")
    by_key = lambda df: df.repartition("key").sortWithinPartitions("key")

    stars = by_key(entries.select("key", "class", "n", "live")).mapInArrow(_stars(percent), "class long, leader long, kind long")
    stars = written(stars.groupBy("class", "leader", "kind").count(), "stars")  # read twice below
    best = stars.groupBy("class", "kind").agg(F.max_by("leader", F.struct("count", "leader")).alias("leader"))
    likely = best.select(F.col("leader").alias("a"), F.col("class").alias("b")).distinct()
    enough = stars.groupBy(F.col("leader").alias("a"), F.col("class").alias("b")).agg(F.max("count").alias("count")).join(entries.select(F.col("class").alias("b"), "n").distinct(), "b")
    likely = likely.join(enough.filter(F.col("count") * 12 >= F.col("n") * (100 - percent) / 100).select("a", "b"), ["a", "b"])
    linked = verified(likely, rows, heavy, shingle, percent)

    star = components(linked).withColumnRenamed("root", "star")
    marked = entries.join(star, "class", "left").select("key", "class", "n", "at", "heavies", F.coalesce("star", "class").alias("star"))
    found = by_key(marked).mapInArrow(_candidates(percent), "a long, b long, strong boolean, n int, m int, heavies int")
    counted = found.groupBy("a", "b").agg(F.max("strong").alias("strong"), F.sum((~F.col("strong")).cast("int")).alias("light"), F.first("n").alias("n"), F.first("m").alias("m"), F.first("heavies").alias("heavies"))
    larger = F.greatest("n", "m")
    after = F.floor(larger * percent / 100 + F.lit(0.999999)) - 1  # n - prefix_length(n)
    need = F.ceil((F.col("n") + F.col("m")) * percent / (100 + percent) - F.lit(1e-9))
    likely = counted.filter(F.col("strong") | (F.col("light") + F.col("heavies") + after >= need)).select("a", "b")
    links = linked.unionByName(verified(likely, rows, heavy, shingle, percent))

    firsts = base.filter("n > 0").groupBy("class", "n").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("first"))
    return base, firsts.join(components(links), "class", "left").withColumn("root", F.coalesce("root", "class"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id.

    Words are runs of other characters than ASCII white space, A-Z folded.  A text with fewer words
    than a shingle is one shingle; one without words, or null, has none and links with nothing.  The
    component's id is the smallest doc_id that links lead to.  Repeated rows and equal texts share a
    component; rows without an id take part, but give no component its id (a component of such
    rows only has a null id).  Texts may be of any length; a tie between leaders changes no link.  Other
    columns are ignored, whatever their names; an empty table gives no rows.  Equal sets are told by a 64-bit
    name and their size: among n different sets about n * n / 2 ** 65 pairs are expected to be taken for equal.
    """
    base, classes = grouped(docs, id_col, text_col, **options)
    named = classes.groupBy("root").agg(F.min("first.doc_id").alias("component_id"))
    ids = classes.join(named, "root").select("class", "n", "component_id")
    some = base.filter("n > 0").join(ids, ["class", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return some.unionByName(base.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """All columns of one row of each component: that with the least id (rows without one come last).

    Rows without words stay.  Of rows that repeat both id and text one stays.  What goes is told by id and a
    hash of the text, so of several texts under one id only those go that are linked with what stays; the rows
    to drop meet the documents in a merge join at every size.
    """
    base, classes = grouped(docs, id_col, text_col, **options)
    base = written(base, "rows")
    best = classes.groupBy("root").agg(F.min("first").alias("best"))
    fate = classes.join(best, "root").select("class", "n", F.when(F.col("first") == F.col("best"), F.col("first")).alias("stays"))
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    gone = base.filter("n > 0").join(fate, ["class", "n"]).filter(~row.eqNullSafe(F.col("stays"))).select("doc_id", "mark").distinct()
    text = F.xxhash64(F.col(text_col).cast("string").cast("binary"))
    own, mark, rank = (fresh(docs, name) for name in ("id", "mark", "rank"))
    same = F.col(id_col).cast("long").eqNullSafe(F.col(own)) & (text == F.col(mark))
    kept = docs.join(gone.select(F.col("doc_id").alias(own), F.col("mark").alias(mark)).hint("merge"), same, "left_anti")
    repeats = base.filter("n > 0").groupBy("doc_id", "mark").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    if repeats.isEmpty():
        return kept
    again = repeats.select(F.col("doc_id").alias(own), F.col("mark").alias(mark), F.lit(True).alias(rank))
    others = [F.col(c) for c in docs.columns if c not in (id_col, text_col)] or [F.lit(0)]
    number = F.row_number().over(Window.partitionBy(F.col(id_col), text).orderBy(F.xxhash64(*others)))
    kept = kept.join(again.hint("merge"), same, "left").drop(own, mark)
    return kept.withColumn(rank, F.when(F.col(rank), number).otherwise(1)).filter(F.col(rank) == 1).drop(rank)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not use."""
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    return name
