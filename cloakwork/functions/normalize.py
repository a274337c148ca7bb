"""Keys, header prefixes and ordinal labels."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Quote characters that keys drop, and header words that give no prefix.
QUOTES = "\"“”«»‘’'"
SKIP_WORDS = ("имя", "наименование", "название", "номер", "внеш", "внешний", "рабочего")


def nfc(text: Column) -> Column:
    """Canonical composition; only worth calling on distinct values."""

    def composed(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))

    return F.pandas_udf(composed, "string")(text.cast("string"))


def composed(df: DataFrame, column: str, name: str) -> DataFrame:
    """Adds ``name``: the column in canonical composition.  Rows in ASCII, which are composed, never leave the JVM; call it on distinct values."""
    plain = F.coalesce(~F.col(column).rlike(r"[^\x00-\x7F]"), F.lit(True))
    return df.filter(plain).withColumn(name, F.col(column)).unionByName(df.filter(~plain).withColumn(name, nfc(F.col(column))))


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _plain(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, QUOTES, ""), r"(?U)\s+", " ")


def norm_key(text: Column) -> Column:
    """Lookup key: stripped, upper case, quotes dropped, white space collapsed."""
    return _plain(F.upper(_strip(text)))


def norm_original(text: Column) -> Column:
    """As norm_key, in the original case."""
    return _plain(_strip(text))


def library_key(text: Column) -> Column:
    """The library's key strips last, so quotes at the edge leave no blank behind."""
    return _strip(_plain(F.upper(text)))


def derive_prefix(header: str) -> str:
    """First word of a header that carries meaning, capitalised, -ия turned into -ие."""
    words = header.split()
    word = next((w for w in words if w.lower() not in SKIP_WORDS), words[0] if words else "")
    return re.sub("ия$", "ие", word.lower()).capitalize()


def index_label(n: Column, letters: int = 8) -> Column:
    """1 is A, 26 is Z, 27 is AA (bijective base 26), without a Python UDF."""
    zero = F.struct(n.cast("long").alias("rest"), F.lit("").alias("out"))

    def step(acc: Column, _: Column) -> Column:
        rest = acc["rest"]
        letter = F.when(rest > 0, F.char(F.pmod(rest - 1, F.lit(26)) + 65)).otherwise("")
        return F.struct(F.when(rest > 0, F.floor((rest - 1) / 26)).otherwise(F.lit(0)).cast("long").alias("rest"), F.concat(letter, acc["out"]).alias("out"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(letters)), zero, step, lambda acc: acc["out"])
