import pytest
from pyspark.sql import functions as F

from cloakwork.functions import patterns as P
from cloakwork.functions import spans as S
from cloakwork.functions.normalize import derive_prefix, index_label, library_key, nfc, norm_key
from cloakwork.operators import library, masking, profile
from cloakwork.sources import tables
from cloakwork.streaming import anonymize as A


def texts(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "doc_id long, text string")


def test_keys(spark):
    rows = texts(spark, "  альфа  ", 'ООО "МАЯК-7"', "ООО МАЯК-7", None, "« x »").select(norm_key(F.col("text")), library_key(F.col("text"))).collect()
    assert rows[0][0] == "АЛЬФА" and rows[1][0] == rows[2][0] == "ООО МАЯК-7" and rows[3][0] is None and rows[4][1] == "X"
    assert texts(spark, "é").select(nfc(F.col("text"))).first()[0] == "é"


def test_prefix_and_labels(spark):
    assert derive_prefix("Имя предприятия") == "Предприятие" and derive_prefix("Автор изменения") == "Автор"
    n = [1, 2, 26, 27, 28, 702, 703]
    found = spark.createDataFrame([(x,) for x in n], "n long").select(index_label(F.col("n"))).collect()
    assert [r[0] for r in found] == ["A", "B", "Z", "AA", "AB", "ZZ", "AAA"]


def test_scaling(spark):
    df = spark.createDataFrame([(10, 1.005), (20, 2.5), (None, None)], "i long, d double")
    rows = df.select(masking.scale(F.col("i"), 0.7, True), masking.scale(F.col("d"), 1.0, False)).collect()
    assert [r[0] for r in rows] == [7, 14, None] and rows[0][1] == 1.0
    assert 0.5 <= masking.coefficient("Сумма", "secret") < 1.5


def test_workbook_roundtrip(spark):
    a = spark.createDataFrame([(1, "Альфа", 10), (2, "Бета", 20), (3, None, 30)], "id long, `Имя предприятия` string, n long")
    b = spark.createDataFrame([(1, "альфа", "Иванов")], "id long, `Имя предприятия` string, `Автор изменения` string")
    config = {"a": {"Имя предприятия": "text", "n": "numeric", "missing": "text"}, "b": {"Имя предприятия": "text", "Автор изменения": "text"}}
    masked, mapping, numeric = masking.mask_workbook({"a": a, "b": b}, config, {"a": "id", "b": "id"}, "secret")
    first = {r["id"]: r["Имя предприятия"] for r in masked["a"].collect()}
    assert first == {1: "Предприятие A", 2: "Предприятие B", 3: None}
    assert masked["b"].first()["Имя предприятия"] == "Предприятие A" and masked["b"].first()["Автор изменения"] == "Автор A"
    assert masked["a"].columns == a.columns
    back = masking.unmask_workbook(masked, mapping, numeric)
    assert sorted((r["id"], r["Имя предприятия"]) for r in back["a"].collect()) == [(1, "Альфа"), (2, "Бета"), (3, None)]
    stats = masking.mask_stats({"a": a, "b": b}, config, mapping).first()
    assert (stats["masked_values"], stats["unique_entities"]) == (7, 3)


def spans(spark, text, identity=True):
    return [(s["start"], s["end"], s["label"], s["value"]) for s in texts(spark, text).select(S.detect(F.col("text"), identity).alias("s")).first()["s"]]


def test_detectors(spark):
    text = "😀 пишите ivan@mail.ru, 10.0.0.1; Иванов И.И. и ООО «Ромашка» по № 12-3/4 от 01.02.2024, 5 марта 2024 г."
    found = spans(spark, text, False)
    assert all(text[a:b] == v for a, b, _, v in found)
    assert {x[2] for x in found} == {"EMAIL", "IP", "ФИО", "ОРГ", "ДОГОВОР", "ДАТА"}
    assert [x[2] for x in spans(spark, "серия 38 02 № 118822, 5203 774411")].count("ПАСПОРТ") == 2
    assert [x[2] for x in spans(spark, "+79015550124 112-233-445 95")].count("СНИЛС") == 2
    assert "ИНН" in [x[2] for x in spans(spark, "ИНН 5001007322")] and "КПП" in [x[2] for x in spans(spark, "КПП: 500101001")]
    assert "КПП" not in [x[2] for x in spans(spark, "500101001")]
    assert [x[3] for x in spans(spark, "Петров Иван Сергеевич\nэто Петров Иван Сергеевич", False)] == ["Петров Иван Сергеевич"]
    assert spans(spark, "Нижний Новгород Область", False) == []
    assert texts(spark, None).select(S.detect(F.col("text")).alias("s")).first()["s"] == []


def test_merge_and_overlap(spark):
    make = lambda xs: F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(c).alias("label"), F.lit(c).alias("value"), F.lit(0).alias("prio")) for a, b, c in xs])
    one = spark.range(1)
    got = one.select(S.merge(make([(0, 5, "A"), (3, 9, "B"), (0, 3, "C"), (9, 11, "D")])).alias("s")).first()["s"]
    assert [(s["start"], s["end"], s["label"]) for s in got] == [(0, 5, "A"), (9, 11, "D")]
    got = one.select(S.add_without_overlap(make([(0, 11, "A")]), make([(0, 11, "B"), (11, 12, "C"), (11, 13, "D")])).alias("s")).first()["s"]
    assert [s["label"] for s in got] == ["A", "C"]
    got = one.select(S.add_without_overlap(make([(0, 11, "A")]), make([(0, 11, "B")]), F.array(F.lit(0), F.lit(7))).alias("s")).first()["s"]
    assert [s["label"] for s in got] == ["B"]


def test_anonymise_and_restore(spark):
    df = texts(spark, "a@b.ru и c@d.ru и a@b.ru, 1.2.3.4", "", None, "ничего")
    rows = A.restore(A.anonymize(df)).orderBy("doc_id").collect()
    assert rows[0]["anonymised"] == "[EMAIL_1] и [EMAIL_2] и [EMAIL_1], [IP_1]"
    assert [r["restored"] for r in rows] == [r["text"] for r in rows]
    only = A.anonymize(df, labels=["IP"]).orderBy("doc_id").first()["anonymised"]
    assert only == "a@b.ru и c@d.ru и a@b.ru, [IP_1]"
    hidden = texts(spark, "Секрет и секрет [ФИО_1] фио").select(S.hide_terms(F.col("text"), ["секрет", "ФИО", "секрет"])).first()[0]
    assert hidden == "[СКРЫТО_1] и [СКРЫТО_1] [ФИО_1] [СКРЫТО_2]"


def test_stream_equals_batch(spark, tmp_path):
    df = texts(spark, "a@b.ru", "x 1.2.3.4")
    df.write.parquet(str(tmp_path / "in"))
    stream = A.anonymize(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).select("doc_id", "anonymised")
    stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == [(0, "[EMAIL_1]"), (1, "x [IP_1]")]


def test_postfilter(spark):
    make = lambda label, v: F.struct(F.lit(0).alias("start"), F.lit(3).alias("end"), F.lit(label).alias("label"), F.lit(v).alias("value"), F.lit(0).alias("prio"))
    got = spark.range(1).select(S.postfilter(F.array(make("ФИО", "Генеральный директор"), make("ФИО", "Иванов директор"), make("ОРГ", "Отдел"), make("EMAIL", "заказчик"))).alias("s")).first()["s"]
    assert [s["value"] for s in got] == ["Иванов директор", "заказчик"]


def test_profile(spark):
    df = spark.createDataFrame([("a@b.ru", 1), ("c@d.ru", 2), ("x", 3), (None, 4)], "mail string, `Документ закупки` long")
    kinds = {r["col"]: (r["kind"], r["sensitive"]) for r in profile.column_types({"s": df}).collect()}
    assert kinds == {"mail": ("text", False), "Документ закупки": ("text", True)}
    assert profile.category_vote(df, "mail").first()["category"] == "email"
    assert profile.scanner_hit(df, "mail").first()["hit"] and profile.column_samples(df, "mail").first()["sample"] == "a@b.ru, c@d.ru, x"
    assert profile.header_category("Телефон") == "phone" and profile.header_category("x") is None


def test_library(spark, tmp_path):
    lib = library.Library(spark, f"file://{tmp_path}/lib")
    row = lambda k, v: spark.createDataFrame([(k, v)], "norm_key string, pseudonym string")
    lib.save("text", row("A", "1"))
    lib.save("text", row("A", "2"))
    lib.save("text", row("B", "3"))
    assert sorted(map(tuple, lib.read("text").collect())) == [("A", "1"), ("B", "3")]
    got = library.fuzzy_candidates(spark.createDataFrame([("ALPHA BETAX",), ("ZZZ",)], "value string"), row("BETAX ALPHB", "p"), 85).collect()
    assert [r["best"] for r in got] == ["BETAX ALPHB"]


def test_surnames(spark):
    values = spark.createDataFrame([("Иванов И.", 0), ("Иванов Иван", 1), ("Петров П.", 2), ("Иванов", 3)], "value string, pos int")
    assert [tuple(r) for r in masking.surname_groups(values).collect()] == [("Иванов И.", "Иванов Иван")]


@pytest.mark.parametrize(("encoding", "sep"), [("utf-8", ";"), ("utf-8-sig", ","), ("cp1251", "\t")])
def test_csv(spark, tmp_path, encoding, sep):
    path = tmp_path / "x.csv"
    path.write_bytes(f"Название{sep}Цена\nАльфа{sep}1.5\nБета{sep}2.5\n".encode(encoding))
    df = tables.read_file(spark, str(path))[tables.SHEET]
    assert df.columns == ["Название", "Цена"] and [r[0] for r in df.collect()] == ["Альфа", "Бета"]


def test_xlsx_and_mapping(spark, tmp_path):
    a = spark.createDataFrame([("x", 1, 1.5), (None, 2, 2.5)], "s string, i long, d double")
    path = tmp_path / "x.xlsx"
    path.write_bytes(tables.xlsx_bytes({"One": a, "Empty": a.limit(0)}))
    back = tables.read_file(spark, str(path))
    assert list(back) == ["One"] and [tuple(r) for r in back["One"].collect()] == [("x", 1, 1.5), (None, 2, 2.5)]
    (tmp_path / "bad.xlsx").write_bytes(b"nothing")
    with pytest.raises(ValueError):
        tables.read_file(spark, str(tmp_path / "bad.xlsx"))
    with pytest.raises(ValueError):
        tables.read_file(spark, "x.bin")
    text = tables.mapping_json({"Альфа": "A"}, {"n": 1.5})
    assert "Альфа" in text and tables.load_mapping(text) == {"text": {"Альфа": "A"}, "numeric": {"n": 1.5}}
    assert tables.load_mapping("{}") is None and tables.load_mapping("x") is None


def test_labels_known():
    assert {label for label, _, _ in P.DETECTORS + P.IDENTITY} <= set(P.LABELS)
