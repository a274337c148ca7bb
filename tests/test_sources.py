import io
import json
import zipfile

import pytest

from cloakwork.sources import documents as D
from cloakwork.sources import tables as T

CELLS = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>N</t></is></c><c r="C1" t="str"><v>F</v></c><c r="D1" t="inlineStr"><is><t>B</t></is></c></row>'
CELLS += '<row r="2"><c r="A2" t="str"><v>formula text</v></c><c r="B2" s="7"><v>5</v></c><c r="C2" t="e"><v>#N/A</v></c><c r="D2" t="b"><v>1</v></c></row>'
CELLS += '<row r="3"><c r="A3" t="s"><v>1</v></c><c r="B3"><v>6</v></c><c r="C3"><v>2.5</v></c><c r="D3" t="b"><v>0</v></c></row>'


def workbook() -> bytes:
    """A workbook whose sheets are stored under other numbers than their order, with every kind of cell."""
    out = io.BytesIO()
    ns, rel = T._NS[1:-1], T._REL[1:-1]
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}" xmlns:r="{rel}"><sheets><sheet name="One" sheetId="1" r:id="x"/><sheet name="Two" sheetId="2" r:id="y"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="x" Target="worksheets/sheet2.xml"/><Relationship Id="y" Target="/xl/worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{ns}"><si><t>Name</t></si><si><r><t>Ann</t></r><r><t>a</t></r></si></sst>')
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet xmlns="{ns}"><cols><col min="1" max="1" width="33"/></cols><sheetData>{CELLS}</sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{ns}"><sheetData/></worksheet>')
        z.writestr("xl/styles.xml", "<styles/>")
    return out.getvalue()


def test_xlsx_cells(spark):
    found = T.tables_of(spark, workbook())
    assert list(found) == ["One"]
    assert [tuple(r) for r in found["One"].collect()] == [("formula text", 5, None, True), ("Anna", 6, 2.5, False)]
    with pytest.raises(T.NoData):
        T.tables_of(spark, T.xlsx_bytes({"E": spark.createDataFrame([], "a long")}))


def test_formatted_xlsx(spark):
    """Values change, formats, widths and other parts stay."""
    df = spark.createDataFrame([(1, "x", 50, "new"), (2, None, None, "new")], "id long, Name string, N long, Other string")
    data = T.formatted_xlsx(workbook(), {"One": df.select("Name", "N", "Other"), "Three": df})
    book = zipfile.ZipFile(io.BytesIO(data))
    sheet = book.read("xl/worksheets/sheet2.xml").decode()
    assert book.read("xl/styles.xml") == b"<styles/>" and 'width="33"' in sheet and 's="7"' in sheet
    assert [tuple(r) for r in T.tables_of(spark, data)["One"].collect()] == [("x", 50, None, True), (None, None, 2.5, False)]


def test_mapping_sinks(spark):
    text = spark.createDataFrame([("Альфа", "A"), ("Бета", "B")], "original string, pseudonym string")
    numeric = spark.createDataFrame([("n", 1.5)], "col string, coefficient double")
    back = T.tables_of(spark, T.mapping_xlsx(text, numeric))
    assert back["Текстовый маппинг"].columns == ["Оригинал", "Псевдоним"] and back["Числовой маппинг"].first()["Коэффициент"] == 1.5
    rows = spark.createDataFrame([(0, "ФИО", "[ФИО_1]", "Ян"), (1, "IP", "[IP_1]", "1.1.1.1"), (2, "ФИО", "[ФИО_2]", "Ия")], "ord int, label string, placeholder string, value string")
    said = T.text_mapping_json(rows)
    assert "Ян" in said and json.loads(said) == {"ФИО": {"[ФИО_1]": "Ян", "[ФИО_2]": "Ия"}, "IP": {"[IP_1]": "1.1.1.1"}}
    assert sorted(map(tuple, T.load_text_mapping(spark, said).select("label", "placeholder", "value").collect())) == sorted((r[1], r[2], r[3]) for r in rows.collect())
    data = T.csv_bytes({"a": text, "b": numeric})
    assert data.startswith(b"\xef\xbb\xbf") and data.decode("utf-8-sig") == "original,pseudonym\nАльфа,A\nБета,B\n"
    assert T.named_output("a/x_anon.md", "_restored") == "a/x_restored.md" and T.named_output("x.md", "_mapping", "json") == "x_mapping.json"


@pytest.mark.parametrize(("encoding", "sep"), [("utf-8", ";"), ("utf-8-sig", ","), ("cp1251", "\t"), ("utf-8", "|")])
def test_bytes_and_heads(spark, tmp_path, encoding, sep):
    data = f"Название{sep}Код{sep}Цена\nАльфа{sep}A7{sep}1.5\nБета{sep}{sep}2\n".encode(encoding)
    got = T.read_bytes(spark, data, "x.CSV")[T.SHEET]
    assert [tuple(r) for r in got.collect()] == [("Альфа", "A7", 1.5), ("Бета", None, 2.0)]
    (tmp_path / "x.csv").write_bytes(data)
    df = T.read_file(spark, str(tmp_path / "x.csv"))[T.SHEET]
    assert df.columns == ["Название", "Код", "Цена"] and df.count() == 2 and spark.conf.get("spark.sql.legacy.javaCharsets", "false") == "false"
    assert T.preview({"s": df}, 1)["s"].count() == 1


def test_unreadable(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes(bytes(range(256)) * 3)
    for f in (lambda: T.read_file(spark, str(tmp_path / "x.csv")), lambda: T.read_bytes(spark, bytes(range(256)), "x.csv"), lambda: T.read_bytes(spark, b"x", "x.xlsx"), lambda: T.read_bytes(spark, b"x", "x.bin")):
        with pytest.raises(T.Unreadable):
            f()
    (tmp_path / "e.csv").write_bytes(b" \n")
    with pytest.raises(T.NoData):
        T.read_file(spark, str(tmp_path / "e.csv"))
    assert T.separator_of("one\ntwo\n") == "," and T.extension("a.b/c") == "" and T.extension("A.TXT") == "txt"


def packed(**parts) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def test_documents(spark, tmp_path):
    w, a = D._W[1:-1], D._A[1:-1]
    docx = packed(**{"word/document.xml": f'<d xmlns="{w}" xmlns:w="{w}"><body><p><pPr><pStyle w:val="Heading1"/></pPr><r><t>Заголовок</t></r></p><p><r><t>один</t></r><r><tab/><t>два</t></r></p><tbl><tr><tc><p><r><t>a|b</t></r></p></tc><tc><p/></tc></tr></tbl></body></d>'})
    assert D.to_markdown(docx, "x.docx") == ("# Заголовок\n\nодин\tдва\n\n| a\\|b |  |\n| --- | --- |", None)
    pptx = packed(**{f"ppt/slides/slide{i}.xml": f'<s xmlns:a="{a}"><a:p><a:r><a:t>s{i}</a:t></a:r></a:p></s>' for i in (10, 2)})
    assert D.to_markdown(pptx, "x.pptx")[0] == "## 2\ns2\n\n## 10\ns10"
    odt = packed(**{"content.xml": f'<c xmlns:t="{D._T[1:-1]}"><t:h t:outline-level="2">H</t:h><t:p>p</t:p></c>'})
    assert D.to_markdown(odt, "x.odt")[0] == "## H\n\np"
    assert D.to_markdown("a;b\n1;2\n".encode(), "x.csv")[0] == "| a | b |\n| --- | --- |\n| 1 | 2 |"
    assert D.to_markdown(b'{"a": "\xd1\x8f"}', "x.json")[0] == '```json\n{\n  "a": "я"\n}\n```' and "## One" in D.to_markdown(workbook(), "x.xlsx")[0]
    assert D.to_markdown(b"a\xff", "x.md") == ("a�", None)
    pages = lambda b: [(2, " два "), (1, "раз")]
    want = "## Страница 1\n\nраз\n\n---\n\n## Страница 2\n\nдва"
    assert D.to_markdown(b"", "x.pdf", readers={"pdf": lambda b: " \n"}, scan=pages) == (want, D.LIKELY_SCAN)
    assert D.to_markdown(b"", "x.pdf", scan=pages, force_scan=True) == (want, D.SCAN_NOTICE)
    for bad in (lambda: D.to_markdown(b"x", "x.docx"), lambda: D.to_markdown(b"x", "x.exe"), lambda: D.to_markdown(b"", "x.pdf", scan=lambda b: [(1, " ")], force_scan=True)):
        with pytest.raises(D.NotConverted):
            bad()
    (tmp_path / "a.docx").write_bytes(docx)
    (tmp_path / "b.docx").write_bytes(b"broken")
    got = {r["path"][-6:]: r for r in D.read_documents(spark, str(tmp_path)).collect()}
    assert got["a.docx"]["text"].startswith("# Заголовок") and got["b.docx"]["text"] is None and "cannot convert" in got["b.docx"]["error"]
    scans = D.read_scans(spark, str(tmp_path), pages).orderBy("path", "page").collect()
    assert [(r["page"], r["text"]) for r in scans] == [(1, "раз"), (2, "два")] * 2
