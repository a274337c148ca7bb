from pyspark.sql import functions as F

from cloakwork.operators.pages import bind_pages, looks_scanned


def test_pages(spark):
    df = spark.createDataFrame([("a", 2, "два"), ("a", 1, "раз"), ("b", 1, None)], "path string, page int, text string")
    got = {r["path"]: r for r in bind_pages(df).collect()}
    assert got["a"]["txt"] == "--- Страница 1 ---\nраз\n\n--- Страница 2 ---\nдва"
    assert got["a"]["md"] == "## Страница 1\n\nраз\n\n---\n\n## Страница 2\n\nдва"
    assert got["a"]["json"] == '{"total_pages":2,"pages":[{"page":1,"text":"раз"},{"page":2,"text":"два"}]}'
    assert got["b"]["md"] == "## Страница 1\n\n" and bind_pages(df.limit(0)).count() == 0


def test_scanned(spark):
    df = spark.createDataFrame([("x \n" * 49,), ("x \n" * 50,), (None,)], "text string")
    assert [r[0] for r in df.select(looks_scanned(F.col("text"))).collect()] == [True, False, True]
