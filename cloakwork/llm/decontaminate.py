"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

Every window of ``width`` consecutive words of a test item is a pattern (an item that is shorter is
one pattern).  The patterns of one length share a search table: a block is ``BLOCK`` consecutive
words; ``shift`` tells for the block at the end of the search window how far the window may move
without missing a pattern (a block that no pattern holds allows the longest move); where the move is
0, the block selects a bucket of patterns that end with it, whose first words are compared before
the whole pattern is.

Documents are read once and not shuffled.  The test set is broadcast in shards of at most
``shard_words`` words each; with more than one shard, the documents pass through one search step for
each, which carries the spans found so far.  A worker builds a shard's tables once, for all its tasks.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork.llm.shared import slices

BLOCK = 3
#: A-Z to a-z; digits, a-z and every byte of a character beyond ASCII stay; the rest parts words.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(TABLE).split() if text else []


class WuManber:
    """Search for many word sequences of one length."""

    def __init__(self, patterns: dict[tuple[bytes, ...], set[str]], length: int):
        self.length, self.block = length, min(BLOCK, length)
        self.longest = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.bucket: dict[tuple[bytes, ...], list[tuple[bytes, list[bytes], set[str]]]] = defaultdict(list)
        for pattern, items in patterns.items():
            for end in range(self.block, length + 1):
                key = pattern[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, self.longest), length - end)
            self.bucket[pattern[length - self.block :]].append((pattern[0], list(pattern), items))

    def find(self, text: list[bytes]) -> Iterator[tuple[int, set[str]]]:
        """(first word, items) of each occurrence, in order."""
        m, b, n, longest, shift = self.length, self.block, len(text), self.longest, self.shift.get
        end = m
        while end <= n:
            key = tuple(text[end - b : end])
            move = shift(key, longest)
            if move:
                end += move
                continue
            start = end - m
            for first, pattern, items in self.bucket[key]:
                if first == text[start] and pattern == text[start:end]:
                    yield start, items
            end += 1


def tables(items: list[tuple[str, bytes | None]], width: int) -> list[WuManber]:
    by: dict[int, dict[tuple[bytes, ...], set[str]]] = defaultdict(lambda: defaultdict(set))
    for item, text in items:
        w = words(text)
        m = min(width, len(w))
        for i in range(len(w) - m + 1) if m else ():
            by[m][tuple(w[i : i + m])].add(item)
    return [WuManber(dict(p), m) for m, p in sorted(by.items())]


def scan(searches: list[WuManber], text: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
    """Merged spans of hit words (half-open) and the items found."""
    spans: list[tuple[int, int]] = []
    found: set[str] = set()
    for search in searches:
        for start, items in search.find(text):
            spans.append((start, start + search.length))
            found |= items
    return merged(spans), found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def shards(benchmark: DataFrame, item_col: str, text_col: str, shard_words: int) -> Iterator[list[tuple[str, bytes | None]]]:
    """The test set in pieces of bounded size; an item longer than that is a piece of its own."""
    held: list[tuple[str, bytes | None]] = []
    size = 0
    for row in benchmark.select(F.col(item_col).cast("string"), F.col(text_col).cast("binary")).toLocalIterator():
        if row[0] is None or not row[1]:
            continue
        text = bytes(row[1])
        n = len(words(text))
        if held and size + n > shard_words:
            yield held
            held, size = [], 0
        held.append((row[0], text))
        size += n
    yield held


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", *, width: int = 13, share: int = 20, shard_words: int = 200_000) -> DataFrame:
    """Per row: words, words inside an occurrence, items found and the verdict n_hit > 0 and share * n_hit >= n_words.

    A null or empty text has no words and is clean.  Items without words or id are ignored; repeated
    items count once, windows that several items share hit for each.  Repeated rows and ties are judged one by one,
    texts of any length whole; other columns are ignored, whatever their names; an empty test
    set leaves every document clean, an empty table gives no rows.  ``spans`` holds the hit words' half-open ranges.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out, spans, items = search(rows, benchmark, "text", item_col, item_text_col, width=width, shard_words=shard_words)
    return out.select(
        "doc_id",
        F.element_at(spans, 1).cast("long").alias("n_words"),
        F.element_at(spans, 2).cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(items), ","), 256).alias("items_sha256"),
        verdict(spans, share).alias("contaminated"),
        F.slice(spans, 3, F.greatest(F.size(spans) - 2, F.lit(0))).alias("spans"),
        F.array_sort(items).alias("items"),
    )


#: Tables that this worker has built, by shard; the oldest goes where there are more than four.
_BUILT: dict[tuple[str, int], list[WuManber]] = {}


def built(name: str, items: list[tuple[str, bytes | None]], width: int) -> list[WuManber]:
    if (name, width) not in _BUILT:
        if len(_BUILT) >= 4:
            _BUILT.pop(next(iter(_BUILT)))
        _BUILT[name, width] = tables(items, width)
    return _BUILT[name, width]


def verdict(spans: str, share: int):
    hit, total = F.element_at(spans, 2), F.element_at(spans, 1)
    return (hit > 0) & (share * hit.cast("long") >= total)


def search(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text_col: str, *, width: int, shard_words: int) -> tuple[DataFrame, str, str]:
    """All rows and columns of ``docs`` with two more, whose names are returned: the spans (words, hit words, bounds) and the items."""
    names = []
    for name in ("search_text", "search_spans", "search_items"):
        while name in [c.lower() for c in docs.columns]:
            name += "_"
        names.append(name)
    text, spans, items = names
    out = docs.withColumns({text: F.col(text_col).cast("string").cast("binary"), spans: F.lit(None).cast("array<int>"), items: F.lit(None).cast("array<string>")})
    pieces = shards(benchmark, item_col, item_text_col, shard_words)
    shard = next(pieces)
    while shard is not None:
        after = next(pieces, None)
        out = out.mapInArrow(_step(docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, shard)), width, last=after is None), out.schema)
        shard = after
    return out.drop(text), spans, items


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", *, width: int = 13, share: int = 20, shard_words: int = 200_000) -> DataFrame:
    """The rows that are not contaminated, with all their columns."""
    out, spans, _ = search(docs, benchmark, text_col, item_col, item_text_col, width=width, shard_words=shard_words)
    return out.filter(~verdict(spans, share)).select(docs.columns)


def _step(shard, width: int, last: bool):
    """One search step.  spans: words, hit words, then the ranges' bounds one after the other.  The last step drops the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = built(*shard.value, width)
        for batch in batches:
            at = batch.num_columns - 3  # text, spans, items
            for part in slices([batch], text=at):
                spans, items = [], []
                for text, before, had in zip(*(part.column(at + k).to_pylist() for k in range(3)), strict=True):
                    w = words(text)
                    now, found = scan(searches, w)
                    if before:
                        now = merged([*now, *zip(before[2::2], before[3::2], strict=True)])
                    spans.append([len(w), sum(b - a for a, b in now), *(x for ab in now for x in ab)])
                    items.append(sorted(found.union(had or ())))
                own = [*part.columns[:at], pa.nulls(part.num_rows, pa.binary()) if last else part.column(at), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(own, names=part.schema.names)

    return run
