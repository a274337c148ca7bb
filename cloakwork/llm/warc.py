"""WARC archives as a Spark data source.

Writing (``df.write.format("warc")``): each task writes one file, a gzip member for every record.  The
member's header carries the ``sl`` extra field (the record's compressed and uncompressed length), so
a reader can step over a member without inflating it.  An append adds files, an overwrite replaces them.

Reading (``spark.read.format("warc")``): archives of any writer, ``.warc.gz`` (with or without that field, a
member for each record or for many) and plain ``.warc``.  One input partition for each run of small files up to
``partition_bytes``; a larger ``.warc.gz`` is split into ranges of that size, whose readers look for the first member that begins there.
Filters that Spark hands over on the record type and on headers are tested as soon as a record's header
block has been read; payloads of other records, and all payloads where the ``payload`` option is false, are
skipped undecoded: by a seek where lengths allow it, else by inflating without keeping.
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from cloakwork.llm.shared import shared_folder

#: Columns that are written as headers of these names and read back from them.
HEADERS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
    "payload_bytes": "WARC-Payload-Length",
    "page_id": "WARC-Page-ID",
}
NUMBERS = {"payload_bytes", "page_id"}
SCHEMA = "page_id long, record_type string, record_id string, target_uri string, date string, payload_digest string, refers_to string, payload_bytes long, payload binary"
GZIP = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff"


def files(path: str):
    """(filesystem, path in it): local folders directly, any other store by pyarrow's filesystems."""
    from pyarrow import fs

    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), parts.path or path
    return fs.FileSystem.from_uri(path)


def header_block(record: dict) -> bytes:
    lines = ["WARC/1.1"]
    for column, name in HEADERS.items():
        if record.get(column) is not None:
            lines.append(f"{name}: {str(record[column]).translate({13: 32, 10: 32})}")
    if record["record_type"] == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    return "\r\n".join(lines).encode()


def member(record: dict) -> bytes:
    """A record as one gzip member that knows its own length."""
    payload = b"" if record["record_type"] == "revisit" else bytes(record.get("payload") or b"")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % (record.get("payload_bytes") or 0) + payload
    raw = header_block(record) + b"\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    pack = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = pack.compress(raw) + pack.flush()
    length = len(GZIP) + 2 + 12 + len(body) + 8
    return GZIP + struct.pack("<H2sHII", 12, b"sl", 8, length, len(raw)) + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


class Bytes:
    """The bytes of an archive from one place on, inflated where it is gzip; what is skipped is never kept."""

    PIECE = 1 << 16

    def __init__(self, source, at: int, gzip: bool):
        self.source, self.gzip = source, gzip
        self.next = at  # first byte of the file that was not read yet
        self.size = source.size()
        self.held = b""
        self.member, self.unpack, self.raw = at, None, b""
        #: of the member that is open: its skip length and inflated length (0: unknown) and how much of it was given out
        self.length = self.total = self.given = 0
        source.seek(at)

    def _open(self) -> bool:
        """Begin the next member; False at the end of the file."""
        head = self.raw
        while len(head) < 12 and self.next < self.size:
            head += self._piece()
        if len(head) < 2 or head[:2] != b"\x1f\x8b":
            return False
        self.member = self.next - len(head)
        self.length = self.total = self.given = 0
        if len(head) >= 12 and head[3] & 4:
            size = struct.unpack("<H", head[10:12])[0]
            while len(head) < 12 + size and self.next < self.size:
                head += self._piece()
            extra = head[12 : 12 + size]
            while len(extra) >= 4:
                n = struct.unpack("<H", extra[2:4])[0]
                if extra[:2] == b"sl" and n == 8:
                    self.length, self.total = struct.unpack("<II", extra[4:12])
                extra = extra[4 + n :]
        self.unpack, self.raw = zlib.decompressobj(31), head
        return True

    def _piece(self) -> bytes:
        out = self.source.read(min(self.PIECE, self.size - self.next))
        self.next += len(out)
        return out

    def _more(self) -> bytes:
        """Some further bytes, b"" at the end (of the file, or of what is gzip)."""
        if not self.gzip:
            return self._piece() if self.next < self.size else b""
        while True:
            if self.unpack is None and not self._open():
                return b""
            data, self.raw = self.raw, b""
            if not data:
                if self.next >= self.size:
                    raise ValueError(f"the member at byte {self.member} is cut off")
                data = self._piece()
            out = self.unpack.decompress(data, self.PIECE)
            self.raw = self.unpack.unconsumed_tail or self.unpack.unused_data
            if self.unpack.eof:
                self.unpack = None
            if out:
                self.given += len(out)
                return out

    def line(self) -> bytes | None:
        """Up to the next line end, without it; None at the end."""
        while b"\n" not in self.held:
            more = self._more()
            if not more:
                out, self.held = self.held, b""
                return out or None
            self.held += more
        out, _, self.held = self.held.partition(b"\n")
        return out.rstrip(b"\r")

    def take(self, n: int) -> bytes:
        parts, have = [self.held], len(self.held)
        while have < n:
            more = self._more()
            if not more:
                raise ValueError(f"the record is cut off before byte {self.next}")
            parts.append(more)
            have += len(more)
        whole = b"".join(parts)
        self.held = whole[n:]
        return whole[:n]

    def skip(self, n: int) -> None:
        if n <= len(self.held):
            self.held = self.held[n:]
            return
        n -= len(self.held)
        self.held = b""
        if not self.gzip:
            self.next += n
            if self.next > self.size:
                raise ValueError(f"the record is cut off before byte {self.next}")
            self.source.seek(self.next)
            return
        if self.unpack is not None and self.length and self.given + n <= self.total <= self.given + n + 8:  # the rest of the member: step over it
            self.next = self.member + self.length
            self.unpack, self.raw = None, b""
            self.source.seek(self.next)
            return
        while n:
            more = self._more()
            if not more:
                raise ValueError(f"the record is cut off before byte {self.next}")
            self.held, n = more[n:], max(0, n - len(more))


def member_from(source, at: int) -> int:
    """Where the first record's gzip member at or after ``at`` begins (the file's size without one)."""
    size, step = source.size(), 1 << 20
    while at < size:
        source.seek(at)
        data = source.read(min(step + 64, size - at))
        i = data.find(b"\x1f\x8b\x08")
        while 0 <= i < step:
            source.seek(at + i)
            try:
                if zlib.decompressobj(31).decompress(source.read(4096), 5) == b"WARC/":
                    return at + i
            except zlib.error:
                pass
            i = data.find(b"\x1f\x8b\x08", i + 1)
        at += step
    return size


def records(source, payload: bool, wanted, start: int = 0, end: int | None = None, gzip: bool = True) -> Iterator[dict]:
    """Records of an open archive whose headers ``wanted`` accepts; others are stepped over.

    With ``start`` and ``end`` those of the gzip members that begin in this range.
    """
    if start:
        start = member_from(source, start)
    stop = source.size() if end is None else end
    if start >= stop:
        return
    data = Bytes(source, start, gzip)
    while True:
        first = data.line()
        while first == b"":  # blank lines end the record before
            if gzip and data.unpack is None and not data.held and data.next - len(data.raw) >= stop:
                return
            first = data.line()
        if first is None or (gzip and data.member >= stop):
            return
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no WARC record before byte {data.next}")
        fields: dict[str, str] = {}
        while line := data.line():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields.setdefault(name.strip().lower(), value.strip())
        try:
            row = {c: fields.get(n.lower()) for c, n in HEADERS.items()}
            for c in NUMBERS:
                row[c] = None if row[c] is None else int(row[c])
            length = int(fields["content-length"])
        except (KeyError, ValueError) as problem:
            raise ValueError(f"a record before byte {data.next} has no valid header") from problem
        row["payload"] = None
        if not wanted(row):
            data.skip(length)
        elif payload and row["record_type"] != "revisit":
            block = data.take(length)
            http = fields.get("content-type", "").lower().startswith("application/http")
            row["payload"] = block.partition(b"\r\n\r\n")[2] if http else block
            yield row
        else:
            data.skip(length)
            yield row


class Files(InputPartition):
    """Whole files, or (path, start, end) of a part of one."""

    def __init__(self, parts: list[tuple[str, int, int | None]]):
        self.parts = parts


class Done(WriterCommitMessage):
    def __init__(self, temporary: str | None, final: str | None):
        self.temporary, self.final = temporary, final


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path = schema, options["path"]
        self.payload = str(options.get("payload", "true")).lower() == "true" and "payload" in schema.names
        self.partition_bytes = int(options.get("partition_bytes", 128 << 20))
        self.tests: list[tuple[str, str, object]] = []
        if options.get("record_type"):
            self.tests.append(("=", "record_type", options["record_type"]))

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None
            if column in HEADERS and isinstance(f, EqualTo | In | IsNotNull | GreaterThanOrEqual | LessThanOrEqual):
                kind = {EqualTo: "=", In: "in", IsNotNull: "not null", GreaterThanOrEqual: ">=", LessThanOrEqual: "<="}[type(f)]
                self.tests.append((kind, column, getattr(f, "value", None)))
            else:
                yield f

    def wanted(self, row: dict) -> bool:
        for kind, column, value in self.tests:
            x = row[column]
            if x is None or (kind == "=" and x != value) or (kind == "in" and x not in value) or (kind == ">=" and x < value) or (kind == "<=" and x > value):
                return False
        return True

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, path = files(self.path)
        info = store.get_file_info(path)
        listed = [info] if info.is_file else store.get_file_info(fs.FileSelector(path, allow_not_found=True))
        found = sorted((x.path, x.size) for x in listed if x.is_file and x.path.endswith((".warc.gz", ".warc")) and not os.path.basename(x.path).startswith("_"))
        out: list[InputPartition] = []
        held: list[tuple[str, int, int | None]] = []
        size = 0
        for name, n in found:
            if n > self.partition_bytes and name.endswith(".gz"):
                out += [Files([(name, a, min(n, a + self.partition_bytes))]) for a in range(0, n, self.partition_bytes)]
                continue
            if held and size + n > self.partition_bytes:
                out.append(Files(held))
                held, size = [], 0
            held.append((name, 0, None))
            size += n
        return [*out, Files(held)]

    def read(self, partition: Files):
        store, _ = files(self.path)
        names = self.schema.names
        for path, start, end in partition.parts:
            with store.open_input_file(path) as source:
                for row in records(source, self.payload, self.wanted, start, end, path.endswith(".gz")):
                    yield tuple(row[n] for n in names)


class WarcWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex

    def write(self, rows) -> Done:
        """One file a task, under a name of its own: what a lost or repeated attempt wrote is never committed."""
        from pyspark import TaskContext

        store, path = files(self.path)
        context = TaskContext.get()
        final = f"{path}/part-{context.partitionId():06d}-{self.job}.warc.gz"  # another write's files have another name
        temporary = f"{path}/_attempt-{context.partitionId():06d}-{uuid.uuid4().hex}"
        first = next(iter(rows), None)
        if first is None:
            return Done(None, None)
        store.create_dir(path, recursive=True)
        with store.open_output_stream(temporary) as out:
            out.write(member(first.asDict()))
            for row in rows:
                out.write(member(row.asDict()))
        return Done(temporary, final)

    def commit(self, messages: list[Done]) -> None:
        store, path = files(self.path)
        from pyarrow import fs

        store.create_dir(path, recursive=True)
        old = [x.path for x in store.get_file_info(fs.FileSelector(path)) if x.is_file and x.path.endswith((".warc.gz", ".warc"))] if self.overwrite else []
        for m in messages:
            if m is not None and m.temporary:
                store.move(m.temporary, m.final)
        for x in old:
            store.delete_file(x)

    def abort(self, messages: list[Done]) -> None:
        store, _ = files(self.path)
        for m in messages:
            if m is not None and m.temporary:
                store.delete_file(m.temporary)


class Warc(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Warc)


def page_records(pages: DataFrame, *, least: int = 100) -> DataFrame:
    """One record a page, rows of the ``warc`` source.

    Equal payloads of at least ``least`` bytes are stored once: the record with the smallest page_id
    is the response, the others revisit it.  A null html is an empty payload.  Rows without a page_id,
    or that repeat one, keep a record each; among equal payloads of one id all rows but the
    responses' own id revisit.  Only digests are grouped (partially before the shuffle); pages then
    meet the few digests that occur twice in a join whose heavy keys Spark may split.
    """
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("target_uri"), body.alias("payload")).select("*", F.sha2("payload", 256).alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    keys = rows.filter(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("response_id"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").select("payload_digest", "response_id")
    repeat = F.col("response_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    return rows.join(keys, "payload_digest", "left").select(
        "page_id",
        F.when(repeat, "revisit").otherwise("response").alias("record_type"),
        F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">")).alias("record_id"),
        "target_uri",
        F.lit("1970-01-01T00:00:00Z").alias("date"),
        F.concat(F.lit("sha256:"), F.col("payload_digest")).alias("payload_digest"),
        F.when(repeat, F.concat(F.lit("<urn:page:"), F.col("response_id").cast("string"), F.lit(">"))).alias("refers_to"),
        "payload_bytes",
        F.when(~repeat, F.col("payload")).alias("payload"),
    )


def archive(pages: DataFrame, path: str | None = None) -> str:
    """Write ``pages`` as archives in the shared folder (or ``path``); returns the folder."""
    register(pages.sparkSession)
    path = path or f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    page_records(pages).write.format("warc").mode("append").save(path)
    return path


def read_archive(spark: SparkSession, path: str, **options) -> DataFrame:
    register(spark)
    return spark.read.format("warc").options(**options).load(path)


def digest_of(payload: bytes) -> str:
    return hashlib.sha256(payload).hexdigest()


def page_report(pages: DataFrame) -> DataFrame:
    """Write, read back, and report for each page what its record says of the full payload.

    A response's length and digest are taken from the payload that was read back; a revisit's are
    those that its header names (it holds no payload).
    """
    back = read_archive(pages.sparkSession, archive(pages))
    response = F.col("record_type") == "response"
    return back.select(
        "page_id",
        F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(response, F.sha2("payload", 256)).otherwise(F.substring_index("payload_digest", ":", -1)).alias("payload_digest"),
        "record_type",
        F.regexp_extract("refers_to", r"^<urn:page:(-?\d+)>$", 1).try_cast("long").alias("refers_to"),
    )


def size_on_disk(path: str) -> int:
    store, folder = files(path)
    from pyarrow import fs

    return sum(x.size for x in store.get_file_info(fs.FileSelector(folder)) if x.is_file and not os.path.basename(x.path).startswith("_"))
