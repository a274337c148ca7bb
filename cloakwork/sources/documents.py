"""Documents of several formats as Markdown text: text files, office files by their XML, tables, and scans by a pluggable reader."""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.operators.pages import LEAST_CHARS, MD_BETWEEN, MD_HEAD
from cloakwork.sources.tables import encoding_of, extension, parse_xlsx, separator_of

#: What a result that was recognised from a picture says.
SCAN_NOTICE = "Файл распознан с изображения."
LIKELY_SCAN = "Документ похож на скан: текста в нём нет. Запущено распознавание."

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_T = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"


class NotConverted(RuntimeError):
    """A document that cannot be turned into text."""


def markdown_table(rows: list[list]) -> str:
    """Rows, the first of them the header, as a Markdown table."""
    cell = lambda x: "" if x is None else str(x).replace("|", "\\|").replace("\n", " ")
    width = max(map(len, rows), default=0)
    lines = ["| " + " | ".join(cell(r[i]) if i < len(r) else "" for i in range(width)) + " |" for r in rows]
    return "\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]]) if lines else ""


def docx_text(data: bytes) -> str:
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{_W}body")
    inline = lambda p: "".join(t.text or "" if t.tag == f"{_W}t" else "\t" if t.tag == f"{_W}tab" else "\n" for t in p.iter() if t.tag in (f"{_W}t", f"{_W}tab", f"{_W}br"))
    out = []
    for block in body:
        if block.tag == f"{_W}p":
            style = block.find(f"{_W}pPr/{_W}pStyle")
            level = re.match(r"(?i)heading\s*([1-6])$", style.get(f"{_W}val", "")) if style is not None else None
            text = inline(block)
            out.append(f"{'#' * int(level[1])} {text}" if level and text else text)
        elif block.tag == f"{_W}tbl":
            out.append(markdown_table([["\n".join(map(inline, c.iter(f"{_W}p"))) for c in row.findall(f"{_W}tc")] for row in block.findall(f"{_W}tr")]))
    return "\n\n".join(x for x in out if x)


def pptx_text(data: bytes) -> str:
    book = zipfile.ZipFile(io.BytesIO(data))
    slides = sorted((int(m[1]), n) for n in book.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
    out = []
    for number, name in slides:
        lines = ["".join(t.text or "" for t in p.iter(f"{_A}t")) for p in ElementTree.fromstring(book.read(name)).iter(f"{_A}p")]
        out.append("\n".join([f"## {number}", *filter(None, lines)]))
    return "\n\n".join(out)


def odt_text(data: bytes) -> str:
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("content.xml"))
    out = []
    for p in root.iter():
        if p.tag in (f"{_T}p", f"{_T}h"):
            text = "".join(p.itertext())
            out.append(f"{'#' * int(p.get(f'{_T}outline-level', '1'))} {text}" if p.tag == f"{_T}h" and text else text)
    return "\n\n".join(x for x in out if x)


def table_text(data: bytes, kind: str) -> str:
    """A table or JSON file as Markdown."""
    if kind in ("xlsx", "xlsm"):
        return "\n\n".join(f"## {name}\n\n{markdown_table(rows)}" for name, rows in parse_xlsx(data).items())
    if kind == "json":
        return "```json\n" + json.dumps(json.loads(data.decode("utf-8-sig")), ensure_ascii=False, indent=2) + "\n```"
    text = data.decode("utf-8-sig" if encoding_of(data) == "utf-8" else "cp1251")
    return markdown_table([r for r in csv.reader(io.StringIO(text), delimiter=separator_of(text)) if r])


READERS: dict[str, Callable[[bytes], str]] = {
    "md": lambda b: b.decode("utf-8", "replace"),
    "txt": lambda b: b.decode("utf-8", "replace"),
    "docx": docx_text,
    "pptx": pptx_text,
    "odt": odt_text,
    **{k: (lambda b, k=k: table_text(b, k)) for k in ("xlsx", "xlsm", "csv", "json")},
}


def bound(pages: list[tuple[int, str]]) -> str:
    """Recognised pages (number, text) as Markdown; an error where no page has text."""
    if not any(text.strip() for _, text in pages):
        raise NotConverted("nothing was recognised")
    return MD_BETWEEN.join(f"{MD_HEAD[0]}{n}{MD_HEAD[1]}{text.strip()}" for n, text in sorted(pages))


def to_markdown(data: bytes, name: str, *, readers: dict[str, Callable[[bytes], str]] | None = None, scan: Callable[[bytes], list[tuple[int, str]]] | None = None, force_scan: bool = False) -> tuple[str, str | None]:
    """(text, notice) of one document.

    ``readers`` adds or replaces readers by extension (for pdf, say); ``scan`` recognises a pdf's pages.  A pdf goes to
    ``scan`` if that is forced, or if its own text is hardly any.
    """
    kind = extension(name)
    known = READERS | (readers or {})
    if kind == "pdf" and force_scan:
        if scan is None:
            raise NotConverted("no reader for scans")
        return bound(scan(data)), SCAN_NOTICE
    if kind not in known:
        raise NotConverted(f"unsupported: {kind}")
    try:
        text = known[kind](data)
    except NotConverted:
        raise
    except Exception as problem:  # noqa: BLE001  whatever a reader stumbles over
        raise NotConverted(f"cannot convert: {problem}") from problem
    if kind == "pdf" and len(re.sub(r"\s", "", text)) < LEAST_CHARS:
        if scan is None:
            raise NotConverted("no reader for scans")
        return bound(scan(data)), LIKELY_SCAN
    return text, None


def read_documents(spark: SparkSession, path: str, **options) -> DataFrame:
    """(path, text, notice, error) of every file under a path; a file that cannot be converted has an error and no text.

    One task converts its files one after the other; ``options`` as to_markdown (its functions travel to the tasks).
    """

    def converted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows.append((name, *to_markdown(bytes(content), name, **options), None))
                except NotConverted as problem:
                    rows.append((name, None, None, str(problem)))
            yield pd.DataFrame(rows, columns=["path", "text", "notice", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(converted, "path string, text string, notice string, error string")


def read_scans(spark: SparkSession, path: str, scan: Callable[[bytes], list[tuple[int, str]]]) -> DataFrame:
    """(path, page, text) of every file, pages from 1 on, texts stripped."""

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(name, n, text.strip()) for name, content in zip(batch["path"], batch["content"], strict=True) for n, text in scan(bytes(content))]
            yield pd.DataFrame(rows, columns=["path", "page", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(pages, "path string, page int, text string")


def write_texts(docs: DataFrame, path: str, text_col: str = "restored") -> None:
    """Texts as text files in a folder, one text after the other."""
    docs.select(F.coalesce(text_col, F.lit("")).alias("value")).write.mode("overwrite").text(path)
