"""Sequence packing: order-preserving dynamic programming over document and sentence boundaries.

The documents of an input partition, in their order, form one token stream that is cut into
sequences of at most ``context`` tokens.  ``best[j]`` is the least cost of a packing that ends at
boundary ``j``:

    best[j] = cut(j) + min( min_{i: pos[j]-pos[i] <= context} best[i] + context - (pos[j] - pos[i]),
                            min_{p = 1, 2, 4 ..} best[i: pos[i] = pos[j] - p] ) + sequence_penalty

The first minimum is over a sliding window of ``best[i] + pos[i]``, which a monotone queue gives in
amortised constant time; the second is for sequences whose length is any power of two and that need
no padding (the penalty of a sequence keeps them from being chosen for their own sake).  ``cut`` is 0 at a document's end, ``sentence_penalty`` at a sentence's end inside a
document and ``hard_penalty`` elsewhere (only offered where two boundaries lie further apart than a
sequence is long).

Nothing is shuffled: each task packs the rows of its own input split, in streams of about
``stream_tokens`` tokens, so memory is bounded and a lost task is redone alone.  Sequence ids are the
partition's number * 2**32 + a running number.
"""

from __future__ import annotations

import base64
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork.llm.shared import chunks

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
SPECIAL = "<|endoftext|>"


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def encoder(path: str):
    """(encode, ends): text -> uint32 ids, and for each id whether a sentence may end with it."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    special = max(ranks.values()) + 1
    coder = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: special})
    ends = np.zeros(special + 1, bool)
    for piece, i in ranks.items():
        ends[i] = b"\n" in piece or piece.rstrip(b"\"')").endswith((b".", b"!", b"?"))

    def encode(text: str) -> np.ndarray:
        if SPECIAL in text:
            return np.asarray(coder.encode(text, allowed_special={SPECIAL}), np.uint32)
        return np.asarray(coder.encode_to_numpy(text, allowed_special=set(), disallowed_special=()), np.uint32) if hasattr(coder, "encode_to_numpy") else np.asarray(coder.encode_ordinary(text), np.uint32)

    return encode, ends


def boundaries(ends: np.ndarray, sentence: np.ndarray, context: int, sentence_penalty: float, hard_penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Where a stream may be cut, and at which price.  ends: each document's end; sentence: sentence ends."""
    total = int(ends[-1])
    price = np.full(total + 1, np.inf, np.float32)
    price[sentence] = sentence_penalty
    price[ends] = 0
    price[0] = 0
    at = np.flatnonzero(np.isfinite(price))
    wide = np.flatnonzero(np.diff(at) > context)
    for k in wide:
        price[np.arange(at[k] + context // 8, at[k + 1], context // 8)] = hard_penalty
    if len(wide):
        at = np.flatnonzero(np.isfinite(price))
    return at, price[at]


def cuts(at: np.ndarray, price: np.ndarray, context: int, sequence_penalty: float) -> list[int]:
    """Positions of the cheapest cuts (the first is 0, the last the stream's end).  Of ties the longer sequence counts."""
    pos, fee = at.tolist(), (price + sequence_penalty).tolist()
    ends, begins = [], []  # pairs of boundaries that lie a power of two apart
    p = context // 2
    while p >= 1:
        i = np.minimum(np.searchsorted(at, at - p), len(at) - 1)
        j = np.flatnonzero((at >= p) & (at[i] == at - p))
        ends.append(j)
        begins.append(i[j])
        p //= 2
    order = np.argsort(np.concatenate([*ends, [0]])[:-1], kind="stable")
    short = np.concatenate([*begins, [0]])[:-1][order].astype(np.int64).tolist()
    of = np.searchsorted(np.concatenate([*ends, [0]])[:-1][order], np.arange(len(at) + 1)).tolist()
    best, back, key = [0.0] * len(pos), [0] * len(pos), [0.0] * len(pos)
    queue: deque[int] = deque([0])
    for j in range(1, len(pos)):
        here = pos[j]
        while pos[queue[0]] < here - context:
            queue.popleft()
        i = queue[0]
        cost = key[i] + context - here
        for k in short[of[j] : of[j + 1]]:
            if best[k] < cost:
                cost, i = best[k], k
        best[j], back[j] = cost + fee[j], i
        value = key[j] = best[j] + here
        while queue and key[queue[-1]] > value:
            queue.pop()
        queue.append(j)
    out, j = [pos[-1]], len(pos) - 1
    while j:
        j = back[j]
        out.append(pos[j])
    return out[::-1]


def pack_stream(ids: list[np.ndarray], ends_sentence: np.ndarray, context: int, sentence_penalty: float, hard_penalty: float, sequence_penalty: float):
    """(document index, start, length, sequence, offset) arrays and the joined ids of one stream."""
    lengths = np.asarray([len(x) for x in ids], np.int64)
    joined = np.concatenate(ids)
    ends = np.cumsum(lengths)
    sentence = np.flatnonzero(ends_sentence[joined]) + 1
    split = np.asarray(cuts(*boundaries(ends, sentence, context, sentence_penalty, hard_penalty), context, sequence_penalty), np.int64)
    edges = np.union1d(split, ends)
    edges = np.r_[0, edges[edges > 0]]
    first, last = edges[:-1], edges[1:]
    doc = np.searchsorted(ends, first, side="right")
    sequence = np.searchsorted(split, first, side="right") - 1
    return doc, first - (ends - lengths)[doc], last - first, sequence, first - split[sequence], joined, first


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, ranks: str | None = None, context: int = 2048, end_id: int = 1, sentence_penalty: float = 24.0, hard_penalty: float = 96.0, sequence_penalty: float = 64.0, stream_tokens: int = 1_000_000, with_ids: bool = False) -> DataFrame:
    """Pack every row's tokens into sequences; one row per piece.

    A document is the byte-level BPE ids of its text (a null or empty text has none), then ``end_id``.
    Each id lies in exactly one piece.  The ids are those that the vocabulary's JSON file gives in ``tokenizers``; they are
    made from its rank file by another library, faster.  Repeated rows are packed once each; a null id is kept; a long
    text is a stream of its own, cut where the optimum says; other columns are ignored, whatever their names; an
    empty table gives no rows.  ``with_ids`` adds the pieces' ids.
    """
    path = ranks or default_ranks()
    schema = SCHEMA + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, ends_sentence = encoder(path)
        ends_sentence = np.r_[ends_sentence, np.zeros(max(0, end_id + 1 - len(ends_sentence)), bool)]
        stop = np.asarray([end_id], np.uint32)
        number = TaskContext.get().partitionId() << 32
        held: list[np.ndarray] = []
        names: list = []
        size = 0

        def flush():
            nonlocal number, size
            doc, start, length, sequence, offset, joined, first = pack_stream(held, ends_sentence, context, sentence_penalty, hard_penalty, sequence_penalty)
            raw = memoryview(np.ascontiguousarray(joined, "<u4")).cast("B")
            crc = np.fromiter((zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(first.tolist(), length.tolist(), strict=True)), np.int64, len(first))
            total = np.asarray([len(x) for x in held], np.int64)[doc]
            columns = [pa.array(names, pa.int64()).take(pa.array(doc)), *map(pa.array, (start, length, crc, total, number + sequence, offset))]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.r_[first, first[-1] + length[-1]].astype(np.int32)), pa.array(joined.astype(np.int32))))
            number += int(sequence[-1]) + 1
            held.clear()
            names.clear()
            size = 0
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids])

        for batch, texts in chunks(batches):
            for name, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                ids = np.concatenate([encode(text.decode()), stop]) if text else stop
                names.append(name)
                held.append(ids)
                size += len(ids)
                if size >= stream_tokens:
                    yield flush()
        if held:
            yield flush()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, schema)
