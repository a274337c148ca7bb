"""Helpers shared by the corpus operators: shared-folder tables, word cutting, chunked Arrow loops."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one step of a chunked loop holds as Python words at most (a longer text is a chunk of its own).
CHUNK_BYTES = 6_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where the session names none, a folder of this machine is set in local mode (as in tests); on a cluster,
    whose machines would each write to their own, that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = "file:///tmp/checkpoints/cloakwork"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage: what follows survives the loss of any executor without recomputing ``df``.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble unsigned 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def rolling(tokens: np.ndarray, width: int, salt: int) -> np.ndarray:
    """A 64-bit fingerprint of each run of ``width`` consecutive tokens.

    Doubles the covered width while it can (two overlapping halves are then joined), so the work is
    about log2(width) vector operations instead of width.
    """
    h, w = mix(tokens + np.uint64(salt)), 1
    if len(tokens) < width:
        return h[:0]
    while w * 2 <= width:
        h = mix(h[:-w] * np.uint64(0xC2B2AE3D27D4EB4F) + h[w:] + np.uint64(w))
        w *= 2
    if w < width:
        d = width - w
        h = mix(h[:-d] * np.uint64(0x165667B19E3779F9) + h[d:] + np.uint64(width))
    return h


def trim() -> None:
    """Give memory that this worker has freed back to the machine (workers are used again)."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim  # noqa: B018
except (OSError, AttributeError):  # another C library keeps or frees memory as it likes
    _LIBC = None


def slices(batches: Iterable[pa.RecordBatch], text: int = 1, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into pieces whose texts (a binary column) hold ``limit`` bytes at most, or one row.

    Memory that the pieces took is given back at the end.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to
    _POWERS[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
    trim()


def chunks(batches: Iterable[pa.RecordBatch], text: int = 1, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """As slices, with the texts as a list."""
    for batch in slices(batches, text, limit):
        yield batch, batch.column(text).to_pylist()


#: Odd base of the polynomial that fingerprints a word, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Which bytes are white space, and A-Z as a-z.
SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words beyond this many bytes get their fingerprint from a strong hash instead.
LONG_WORD = 200


@lru_cache(maxsize=2)
def _byte_values(lower: bool) -> np.ndarray:
    """A random-looking 64-bit value for each byte; A-Z as a-z if lower."""
    value = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    if lower:
        value[65:91] = value[97:123]
    return value


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, base in enumerate((BASE, INVERSE)):
            _POWERS[i] = np.cumprod(np.r_[np.uint64(1), np.full(n, base, np.uint64)])
    return _POWERS


def word_parts(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(names, counts, raw, starts, ends) of a binary column's words: a 64-bit fingerprint of each, each row's number of words,
    the rows' joined bytes (A-Z folded if ``lower``) and where in them each word begins and ends.

    Words are runs of bytes other than the six ASCII white-space characters.  A
    fingerprint depends on the word's bytes alone.  All words of the column are done at once: sums of
    byte values times powers of an odd base, cut at the words' ends and shifted to a common power.
    """
    n = len(column)
    large = pa.types.is_large_binary(column.type)
    _, places, data = column.buffers()
    empty = np.zeros(0, np.uint64), np.zeros(n, np.int64), np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not n or data is None:
        return empty
    offsets = np.frombuffer(places, np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    if not len(raw):
        return empty
    space = SPACE[raw]
    begin = ~space
    begin[1:] &= space[:-1]
    inner = offsets[1:-1][offsets[1:-1] < len(raw)]
    begin[inner] = ~space[inner]  # a row's first byte begins a word whatever the row before ends with
    close = ~space
    close[:-1] &= space[1:]
    inner = offsets[1:-1][offsets[1:-1] > 0]
    close[inner - 1] = ~space[inner - 1]
    starts = np.flatnonzero(begin)
    ends = np.flatnonzero(close) + 1
    power, inverse = _powers(len(raw) + 1)
    sums = np.empty(len(raw) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_byte_values(lower)[raw] * power[: len(raw)], out=sums[1:])
    names = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    if lower:
        raw = LOWER[raw]
    for i in np.flatnonzero(ends - starts > LONG_WORD):
        names[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : ends[i]].tobytes())
    return names, np.diff(np.searchsorted(starts, offsets)), raw, starts, ends


def word_names(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The first two of word_parts."""
    return word_parts(column, lower)[:2]


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64, copy=False).view(np.int64)
