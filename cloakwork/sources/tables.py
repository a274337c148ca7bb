"""Reading and writing tables: delimited text with probed encoding and separator, xlsx without libraries, JSON mappings."""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHEET = "Лист1"
#: Sheets and columns of a mapping workbook.
TEXT_SHEET, NUMERIC_SHEET = ("Текстовый маппинг", ("Оригинал", "Псевдоним")), ("Числовой маппинг", ("Колонка", "Коэффициент"))
#: Bytes of a file that its encoding and separator are judged by.
HEAD = 1 << 16
PREVIEW = 20
_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


class Unreadable(ValueError):
    """A file that no reader understands."""


class NoData(ValueError):
    """A file without rows."""


def extension(path: str) -> str:
    """What follows the last dot, in lower case."""
    return path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""


def head_of(spark: SparkSession, path: str) -> bytes:
    """The first HEAD bytes of a file, by Hadoop's file system; no more of it reaches the driver."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if store.getFileStatus(target).isDirectory():
        raise Unreadable("one file at a time: each has its own encoding and separator")
    stream = store.open(target)
    try:
        return bytes(stream.readNBytes(HEAD))
    finally:
        stream.close()


def encoding_of(head: bytes) -> str:
    """utf-8, with a mark or not, else cp1251; an error where the bytes are text in neither."""
    cut = head.rsplit(b"\n", 1)[0] if len(head) == HEAD else head  # a character may be cut at the end
    try:
        cut.decode("utf-8")
        found = "utf-8"
    except UnicodeDecodeError:
        try:
            cut.decode("cp1251")
        except UnicodeDecodeError as problem:
            raise Unreadable("cannot read") from problem
        found = "cp1251"
    if any(b < 9 or 13 < b < 32 for b in cut):
        raise Unreadable("cannot read")
    return found


def separator_of(text: str) -> str:
    """The first of , ; TAB that gives the header more than one column; else what a sniffer finds, else a comma."""
    line = next(csv.reader([text.split("\n", 1)[0].rstrip("\r")], delimiter="\x00"), [""])
    whole = "\x00".join(line)
    for sep in (",", ";", "\t"):
        if len(next(csv.reader([whole], delimiter=sep), [])) > 1:
            return sep
    try:
        return csv.Sniffer().sniff("\n".join(text.split("\n")[:20]), delimiters="|:^~ ").delimiter
    except csv.Error:
        return ","


def read_csv(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """One table named Лист1; encoding and separator are judged by the file's head.

    Spark reads cp1251 only under a setting of the whole session; it is put back once the schema is known and set again by
    the reader's own option, so here such files are decoded from their lines instead.
    """
    head = head_of(spark, path)
    if not head.strip():
        raise NoData("no data")
    encoding = encoding_of(head)
    sep = separator_of(head.decode("utf-8-sig" if encoding == "utf-8" else encoding, "ignore"))
    if encoding == "utf-8":
        df = spark.read.csv(path, header=True, inferSchema=True, sep=sep, multiLine=True, escape='"')
    else:
        lines = spark.read.format("binaryFile").load(path).select(F.explode(F.split(cp1251(F.col("content")), r"\r?\n")).alias("value")).filter("value != ''")
        df = spark.read.csv(lines.rdd.map(lambda r: r[0]), header=True, inferSchema=True, sep=sep, escape='"')
    if df.isEmpty():
        raise NoData("no data")
    return {SHEET: df}


def cp1251(content):
    """Bytes in cp1251 as text."""

    def decoded(values: pd.Series) -> pd.Series:
        return values.map(lambda b: None if b is None else bytes(b).decode("cp1251", "replace"))

    return F.pandas_udf(decoded, "string")(content)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def csv_bytes(sheets: dict[str, DataFrame]) -> bytes:
    """The first table as one small file: UTF-8 with a mark, a header, nulls empty."""
    df = next(iter(sheets.values()))
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(df.columns)
    for row in df.toLocalIterator():
        writer.writerow(["" if x is None else x for x in row])
    return out.getvalue().encode("utf-8-sig")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def _letters_to_column(ref: str) -> int:
    column = 0
    for letter in re.match("[A-Z]+", ref)[0]:
        column = column * 26 + ord(letter) - 64
    return column


def _sheet_parts(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part) of each sheet, through the workbook's relationships."""
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_NS}sheet"):
        target = links[s.get(f"{_REL}id")]
        out.append((s.get("name"), target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    return out


def _cell(c, shared: list[str]):
    """A cell's value by its type: shared, inline and formula strings, truth values, errors (null) and numbers."""
    kind, value = c.get("t"), c.find(f"{_NS}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in c.iter(f"{_NS}t"))
    if value is None or value.text is None or kind == "e":
        return None
    if kind == "s":
        return shared[int(value.text)]
    if kind == "b":
        return value.text == "1"
    if kind in ("str", "d"):
        return value.text
    x = float(value.text)
    return int(x) if x.is_integer() else x


def parse_xlsx(data: bytes) -> dict[str, list[list]]:
    """Rows of every sheet that is not empty."""
    book = zipfile.ZipFile(io.BytesIO(data))
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
    out = {}
    for name, part in _sheet_parts(book):
        rows = []
        for row in ElementTree.fromstring(book.read(part)).iter(f"{_NS}row"):
            cells = []
            for c in row.iter(f"{_NS}c"):
                if c.get("r"):
                    cells += [None] * (_letters_to_column(c.get("r")) - 1 - len(cells))
                cells.append(_cell(c, shared))
            rows.append(cells)
        if len(rows) > 1:
            out[name] = rows
    return out


def _column(values: list) -> list:
    """Cells of one column under one type: numbers as they are (all decimal if some are), anything mixed as text."""
    kinds = {type(x) for x in values if x is not None}
    if kinds == {int, float}:
        return [None if x is None else float(x) for x in values]
    return [None if x is None else str(x) for x in values] if len(kinds) > 1 else values


def tables_of(spark: SparkSession, data: bytes) -> dict[str, DataFrame]:
    """Every sheet of a workbook that has rows, by name; a workbook is read on the driver, as it cannot be split."""
    try:
        sheets = parse_xlsx(data)
    except (zipfile.BadZipFile, KeyError, ValueError, ElementTree.ParseError) as problem:
        raise Unreadable("cannot read") from problem
    if not sheets:
        raise NoData("no data")
    out = {}
    for name, (head, *rows) in sheets.items():
        names = [f"Unnamed: {i}" if h is None else str(h) for i, h in enumerate(head)]
        columns = [_column([r[i] if i < len(r) else None for r in rows]) for i in range(len(names))]
        kinds = {int: "bigint", float: "double", bool: "boolean"}
        types = [kinds.get(next((type(x) for x in c if x is not None), str), "string") for c in columns]
        ddl = ", ".join(f"`{n.replace('`', '``')}` {t}" for n, t in zip(names, types, strict=True))
        out[name] = spark.createDataFrame(list(zip(*columns, strict=True)), ddl)
    return out


def read_xlsx(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return tables_of(spark, bytes(spark.read.format("binaryFile").load(path).select("content").first()["content"]))


def read_bytes(spark: SparkSession, data: bytes, name: str) -> dict[str, DataFrame]:
    """Tables of a small file that was handed over as bytes; types as read_csv finds them."""
    kind = extension(name)
    if kind in ("xlsx", "xlsm"):
        return tables_of(spark, data)
    if kind != "csv":
        raise Unreadable(f"unsupported: {kind}")
    if not data.strip():
        raise NoData("no data")
    encoding = encoding_of(data[:HEAD])
    text = data.decode("utf-8-sig" if encoding == "utf-8" else encoding)
    lines = spark.sparkContext.parallelize([x for x in text.splitlines() if x], 1)
    df = spark.read.csv(lines, header=True, inferSchema=True, sep=separator_of(text), escape='"')
    if df.isEmpty():
        raise NoData("no data")
    return {SHEET: df}


def preview(sheets: dict[str, DataFrame], rows: int = PREVIEW) -> dict[str, DataFrame]:
    """The first rows of each table as the source gives them."""
    return {name: df.limit(rows) for name, df in sheets.items()}


def xlsx_bytes(sheets: dict[str, DataFrame]) -> bytes:
    """A workbook of small tables, built on the driver."""
    out = io.BytesIO()
    book = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
    kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
    book.writestr("[Content_Types].xml", f'<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
    book.writestr("_rels/.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
    listed = "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1))
    book.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{listed}</sheets></workbook>')
    links = "".join(f'<Relationship Id="r{i}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
    book.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
    cell = lambda x: "<c/>" if x is None else f"<c><v>{x}</v></c>" if isinstance(x, int | float) and not isinstance(x, bool) else f'<c t="inlineStr"><is><t>{escape(str(x))}</t></is></c>'
    for i, df in enumerate(sheets.values(), 1):
        rows = [df.columns, *df.toLocalIterator()]
        xml = "".join("<row>" + "".join(cell(x).replace("<c", f'<c r="{_letters(j)}{k}"', 1) for j, x in enumerate(r, 1)) + "</row>" for k, r in enumerate(rows, 1))
        book.writestr(f"xl/worksheets/sheet{i}.xml", f'<?xml version="1.0"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{xml}</sheetData></worksheet>')
    book.close()
    return out.getvalue()


def _letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def formatted_xlsx(data: bytes, sheets: dict[str, DataFrame], order: dict[str, str] | None = None) -> bytes:
    """The workbook ``data`` with the cells of these tables' columns replaced, everything else (formats too) as it was.

    Columns are found by the sheet's header row; row i of a table goes to row i + 2; a null empties the cell.  Unknown
    sheets and columns are skipped.  ``order`` names the column that a table's rows are sorted by.
    """
    book = zipfile.ZipFile(io.BytesIO(data))
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
    changed = {}
    ElementTree.register_namespace("", _NS[1:-1])
    ElementTree.register_namespace("r", _REL[1:-1])
    for name, part in _sheet_parts(book):
        if name not in sheets:
            continue
        root = ElementTree.fromstring(book.read(part))
        table = root.find(f"{_NS}sheetData")
        rows = {int(r.get("r", i)): r for i, r in enumerate(table, 1)}
        heads = {str(_cell(c, shared)): _letters_to_column(c.get("r")) for c in (rows[1] if 1 in rows else []) if _cell(c, shared) is not None}
        df = sheets[name].orderBy(order[name]) if order and name in order else sheets[name]
        for i, values in enumerate(df.toLocalIterator(), 2):
            if i not in rows:
                rows[i] = ElementTree.SubElement(table, f"{_NS}row", {"r": str(i)})
            cells = {_letters_to_column(c.get("r")): c for c in rows[i]}
            for column, value in zip(df.columns, values, strict=True):
                if column not in heads:
                    continue
                at = heads[column]
                cell = cells.get(at)
                if cell is None:
                    after = sum(k < at for k in cells)
                    cell = ElementTree.Element(f"{_NS}c", {"r": f"{_letters(at)}{i}"})
                    rows[i].insert(after, cell)
                    cells[at] = cell
                for child in list(cell):
                    cell.remove(child)
                cell.attrib.pop("t", None)
                if isinstance(value, bool) or (value is not None and not isinstance(value, int | float)):
                    cell.set("t", "inlineStr")
                    ElementTree.SubElement(ElementTree.SubElement(cell, f"{_NS}is"), f"{_NS}t").text = str(value)
                elif value is not None:
                    ElementTree.SubElement(cell, f"{_NS}v").text = repr(value)
        changed[part] = ElementTree.tostring(root, encoding="utf-8", xml_declaration=True)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as target:
        for item in book.infolist():
            target.writestr(item, changed.get(item.filename, book.read(item.filename)))
    return out.getvalue()


def mapping_xlsx(text: DataFrame, numeric: DataFrame) -> bytes:
    """A workbook of a mapping: text (original, pseudonym) and numeric (col, coefficient)."""
    sheets = {}
    for (name, columns), df in ((TEXT_SHEET, text.select("original", "pseudonym")), (NUMERIC_SHEET, numeric.select("col", "coefficient"))):
        sheets[name] = df.toDF(*columns)
    return xlsx_bytes(sheets)


def text_mapping_json(mapping: DataFrame) -> str:
    """A document's mapping (ord, label, placeholder, value) as JSON by label, in order."""
    out: dict[str, dict[str, str]] = {}
    for r in mapping.orderBy("ord").toLocalIterator():
        out.setdefault(r["label"], {})[r["placeholder"]] = r["value"]
    return json.dumps(out, ensure_ascii=False, indent=2)


def load_text_mapping(spark: SparkSession, data: str) -> DataFrame:
    """(ord, label, placeholder, value) of such a JSON, in its order."""
    rows = [(label, p, v) for label, entries in json.loads(data).items() for p, v in entries.items()]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord int, label string, placeholder string, value string")


def named_output(name: str, suffix: str, kind: str | None = None) -> str:
    """A result's file name: ``suffix`` put before the extension (or ``kind`` in its place), the mark of an anonymised file dropped."""
    stem = name.rsplit(".", 1)[0]
    if suffix == "_restored" and stem.endswith("_anon"):
        stem = stem[: -len("_anon")]
    return f"{stem}{suffix}.{kind or extension(name)}"


def mapping_json(text: dict[str, str], numeric: dict[str, float]) -> str:
    return json.dumps({"text": text, "numeric": numeric}, ensure_ascii=False, indent=2)


def load_mapping(data: str) -> dict | None:
    """A mapping with both parts, else None."""
    try:
        found = json.loads(data)
    except ValueError:
        return None
    return found if isinstance(found, dict) and {"text", "numeric"} <= found.keys() else None


def read_file(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of a csv or xlsx file, by extension."""
    kind = extension(path)
    if kind == "csv":
        return read_csv(spark, path)
    if kind in ("xlsx", "xlsm"):
        return read_xlsx(spark, path)
    raise Unreadable(f"unsupported: {kind}")
