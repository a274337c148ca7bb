"""Registered queries that write files of every kind to the shared folder and read them back."""

from __future__ import annotations

import io
import uuid
import zipfile

from pyspark.sql import functions as F

from cloakwork.operators import masking
from cloakwork.plans.registry import query, t
from cloakwork.sources import documents as D
from cloakwork.sources import tables as T
from cloakwork.sources.shared import shared_folder


def put(spark, name: str, data: bytes) -> str:
    """A small file in a new folder of the shared one."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/files-{uuid.uuid4().hex}/{name}")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
    out.write(bytearray(data))
    out.close()
    return path.toString()


def nations(spark, d):
    return t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("long").alias("n_regionkey")).coalesce(1).sortWithinPartitions("n_nationkey")


@query("SELECT CAST(n_nationkey AS INTEGER) AS n_nationkey, n_name, CAST(n_regionkey AS INTEGER) AS n_regionkey FROM nation")
def csv_roundtrip(spark, d):
    """The first table as a file with a mark, its encoding and separator found again."""
    return T.read_file(spark, put(spark, "x.csv", T.csv_bytes({"first": nations(spark, d), "second": nations(spark, d).limit(1)})))[T.SHEET]


@query("SELECT r_name || ' ёж' AS имя, CAST(r_regionkey AS INTEGER) AS ключ FROM region")
def csv_cp1251(spark, d):
    """A file in another encoding, by path and as bytes."""
    rows = [f"{r[0]} ёж;{r[1]}" for r in t(spark, d, "region").select("r_name", "r_regionkey").collect()]
    data = ("имя;ключ\n" + "\n".join(rows) + "\n").encode("cp1251")
    half = T.read_file(spark, put(spark, "x.csv", data))[T.SHEET].filter("`ключ` < 3")
    return half.unionByName(T.read_bytes(spark, data, "x.csv")[T.SHEET].filter("`ключ` >= 3"))


@query("SELECT n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey, 2 AS n_sheets FROM (SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, n_regionkey FROM nation)")
def xlsx_roundtrip(spark, d):
    """Every table that has rows, as a workbook."""
    n = nations(spark, d)
    found = T.read_file(spark, put(spark, "x.xlsx", T.xlsx_bytes({"Страны": n, "Пусто": n.limit(0), "Ещё": n.limit(2)})))
    return found["Страны"].withColumn("n_sheets", F.lit(len(found)))


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, 'N_name ' || chr(CAST(65 + n_nationkey AS INTEGER)) AS n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation")
def formatted_xlsx(spark, d):
    """A workbook whose column of names is replaced in place by its masked form."""
    n = nations(spark, d)
    mapping = masking.text_mapping(masking.values_of({"Страны": n}, {"Страны": {"n_name": "text"}}, {"Страны": "n_nationkey"}))
    masked = masking.mask_text(n, "n_name", mapping).orderBy("n_nationkey").select("n_name")
    return T.tables_of(spark, T.formatted_xlsx(T.xlsx_bytes({"Страны": n}), {"Страны": masked}))["Страны"]


@query("SELECT n_name AS original, 'N' || n_nationkey AS pseudonym FROM nation")
def mapping_workbook(spark, d):
    text = nations(spark, d).select(F.col("n_name").alias("original"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("pseudonym"))
    numeric = spark.createDataFrame([("n", 1.25)], "col string, coefficient double")
    back = T.tables_of(spark, T.mapping_xlsx(text, numeric))
    if back[T.NUMERIC_SHEET[0]].first()[T.NUMERIC_SHEET[1][1]] != 1.25:
        raise AssertionError("the coefficient changed")
    return back[T.TEXT_SHEET[0]].toDF("original", "pseudonym")


@query("SELECT n_name AS original, 'Имя ' || n_nationkey AS pseudonym FROM nation")
def mapping_json(spark, d):
    text = {r[0]: f"Имя {r[1]}" for r in nations(spark, d).select("n_name", "n_nationkey").collect()}
    back = T.load_mapping(T.mapping_json(text, {"n": 1.5}))
    return spark.createDataFrame(list(back["text"].items()), "original string, pseudonym string")


@query("SELECT CAST(n_nationkey AS INTEGER) AS ord, 'ФИО' AS label, '[ФИО_' || (n_nationkey + 1) || ']' AS placeholder, n_name AS value FROM nation")
def text_mapping_json(spark, d):
    n = nations(spark, d)
    rows = n.select(F.col("n_nationkey").cast("int").alias("ord"), F.lit("ФИО").alias("label"), F.concat(F.lit("[ФИО_"), (F.col("n_nationkey") + 1).cast("string"), F.lit("]")).alias("placeholder"), F.col("n_name").alias("value"))
    return T.load_text_mapping(spark, T.text_mapping_json(rows))


def _office(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


@query("SELECT kind, CASE kind WHEN 'csv' THEN '| a |' || chr(10) || '| --- |' || chr(10) || '| ' || r_name || ' |' WHEN 'docx' THEN '# ' || r_name WHEN 'exe' THEN NULL ELSE r_name END AS text FROM (VALUES ('txt'), ('md'), ('docx'), ('odt'), ('csv'), ('exe')) k(kind), (SELECT r_name FROM region WHERE r_regionkey = 0)")
def converted_documents(spark, d):
    """One document in several formats as Markdown; a format without a reader is an error of that file alone."""
    name = t(spark, d, "region").filter("r_regionkey = 0").first()["r_name"]
    w = D._W[1:-1]
    docx = _office({"word/document.xml": f'<d xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>{name}</w:t></w:r></w:p></w:body></d>'})
    odt = _office({"content.xml": f'<c xmlns:t="{D._T[1:-1]}"><t:p>{name}</t:p></c>'})
    files = {"txt": name.encode(), "md": name.encode(), "docx": docx, "odt": odt, "csv": f"a\n{name}\n".encode(), "exe": b"x"}
    parts = [D.read_documents(spark, put(spark, f"x.{k}", data)).select(F.lit(k).alias("kind"), "text") for k, data in files.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("SELECT CAST(r_regionkey + 1 AS INTEGER) AS page, r_name AS text FROM region")
def scanned_pages(spark, d):
    """Pages by a pluggable reader (here: parts between form feeds)."""
    names = [r[0] for r in t(spark, d, "region").orderBy("r_regionkey").select("r_name").collect()]
    path = put(spark, "x.pdf", "\f".join(f"  {n}\n" for n in names).encode())
    return D.read_scans(spark, path, lambda data: list(enumerate(data.decode().split("\f"), 1))).select("page", "text")


@query("SELECT string_agg('## Страница ' || (r_regionkey + 1) || chr(10) || chr(10) || r_name, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY r_regionkey) AS text, 'Документ похож на скан: текста в нём нет. Запущено распознавание.' AS notice FROM region")
def scanned_document(spark, d):
    """A pdf without text of its own goes to the reader of scans, with a notice."""
    names = [r[0] for r in t(spark, d, "region").orderBy("r_regionkey").select("r_name").collect()]
    path = put(spark, "x.pdf", "\f".join(names).encode())
    pages = lambda data: list(enumerate(data.decode().split("\f"), 1))
    return D.read_documents(spark, path, readers={"pdf": lambda data: " \n"}, scan=pages).select("text", "notice")


@query("SELECT * FROM (VALUES ('A.TXT', 'txt', 'A_anon.TXT'), ('b/c.tar.gz', 'gz', 'b/c.tar_anon.gz'), ('d', '', 'd_anon.')) v(name, extension, anonymised)")
def file_names(spark, d):
    names = ["A.TXT", "b/c.tar.gz", "d"]
    rows = [(n, T.extension(n), T.named_output(n, "_anon", n.rsplit(".", 1)[-1] if "." in n else "")) for n in names]
    return spark.createDataFrame(rows, "name string, extension string, anonymised string")


@query("SELECT doc_id, text FROM documents WHERE doc_id < 20 AND text IS NOT NULL")
def text_files(spark, d):
    """Texts written one a line (as JSON, so that line ends survive) and read whole."""
    docs = t(spark, d, "documents").filter("doc_id < 20 AND text IS NOT NULL")
    path = f"{shared_folder(spark)}/texts-{uuid.uuid4().hex}"
    D.write_texts(docs.select(F.to_json(F.struct("doc_id", "text")).alias("restored")), path)
    whole = T.read_text(spark, path).select(F.explode(F.split("text", "\n")).alias("line")).filter("line != ''")
    return whole.select(F.from_json("line", "doc_id long, text string").alias("r")).select("r.doc_id", "r.text")


@query("SELECT CAST(count(*) AS INTEGER) AS rows FROM (SELECT * FROM nation LIMIT 20)")
def file_preview(spark, d):
    n = T.preview(T.read_file(spark, put(spark, "x.csv", T.csv_bytes({"n": nations(spark, d)}))))
    return n[T.SHEET].agg(F.count(F.lit(1)).cast("int").alias("rows"))


@query("SELECT name, problem FROM (VALUES ('x.csv', 'Unreadable'), ('e.csv', 'NoData'), ('x.xlsx', 'Unreadable'), ('x.bin', 'Unreadable')) v(name, problem)")
def unreadable_files(spark, d):
    rows = []
    for name, data in (("x.csv", bytes(range(256)) * 3), ("e.csv", b" \n"), ("x.xlsx", b"nothing"), ("x.bin", b"x")):
        try:
            T.read_file(spark, put(spark, name, data))
        except ValueError as problem:
            rows.append((name, type(problem).__name__))
    return spark.createDataFrame(rows, "name string, problem string")

