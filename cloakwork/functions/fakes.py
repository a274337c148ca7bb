"""Stand-ins by category: the n-th person, company and so on, all different, in JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakwork.functions.normalize import index_label

SURNAMES = "Берёзов Вьюгин Гранин Долгов Ельцов Жаров Зимин Ильин Калинов Лесков Морозов Нилов Озеров Полянин Рощин Снегов Туманов Ушаков Холмов Цветков".split()
NAMES = "Алексей Борис Виктор Глеб Денис Егор Захар Игорь Кирилл Лев Максим Никита Олег Павел Роман Сергей Тимур Фёдор Юрий Ян".split()
FATHERS = "Алексеевич Борисович Викторович Глебович Денисович Егорович Захарович Игоревич Кириллович Львович".split()
FIRMS = "Вектор Гранит Заря Исток Кварц Луч Маяк Нива Орбита Парус Ритм Сфера Темп Утёс Факел Центр Эталон Якорь Алмаз Берег".split()
TOWNS = "Белогорье Верхнелесье Дальнеречье Заозерье Каменка Лесная Приморье Речное Солнечное Травино".split()
STREETS = "Берёзовая Весенняя Дубовая Зелёная Кленовая Луговая Мирная Озёрная Полевая Садовая".split()


def _pick(words: list[str], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), (F.pmod(n, F.lit(len(words))) + 1).cast("int"))


def _beyond(n: Column, size: int) -> Column:
    """What tells the words' second and later rounds apart: nothing, then A, B .."""
    turn = F.floor(n / size)
    return F.when(turn > 0, F.concat(F.lit(" "), index_label(turn))).otherwise("")


def fake(category: str, ordinal: Column) -> Column:
    """The stand-in with this number (from 1 on); different numbers give different ones.  Unknown categories give "Category A"."""
    n = ordinal.cast("long") - 1
    digits = lambda m, k: F.lpad(F.pmod(m, F.lit(10**k)).cast("string"), k, "0")
    if category == "person":
        a, b, c = len(SURNAMES), len(NAMES), len(FATHERS)
        return F.concat(_pick(SURNAMES, n), F.lit(" "), _pick(NAMES, F.floor(n / a)), F.lit(" "), _pick(FATHERS, F.floor(n / (a * b))), _beyond(n, a * b * c))
    if category == "company":
        return F.concat(F.lit("ООО «"), _pick(FIRMS, n), _beyond(n, len(FIRMS)), F.lit("»"))
    if category == "phone":  # 000 is no area code
        return F.concat(F.lit("+7 (000) "), digits(F.floor(n / 10000), 3), F.lit("-"), digits(F.floor(n / 100), 2), F.lit("-"), digits(n, 2), F.when(n >= 10**7, F.concat(F.lit("-"), F.floor(n / 10**7).cast("string"))).otherwise(""))
    if category == "email":
        return F.concat(F.lit("user"), ordinal.cast("string"), F.lit("@example.org"))
    if category == "ip":  # a private net, then further numbers that are no address
        part = lambda d: F.pmod(F.floor(n / d), F.lit(256)).cast("string")
        return F.concat(F.lit("10."), part(65536), F.lit("."), part(256), F.lit("."), part(1), F.when(n >= 1 << 24, F.concat(F.lit("."), F.floor(n / (1 << 24)).cast("string"))).otherwise(""))
    if category == "address":
        return F.concat(F.lit("г. "), _pick(TOWNS, n), F.lit(", ул. "), _pick(STREETS, F.floor(n / len(TOWNS))), F.lit(", д. "), (F.floor(n / (len(TOWNS) * len(STREETS))) + 1).cast("string"))
    if category == "city":
        return F.concat(_pick(TOWNS, n), _beyond(n, len(TOWNS)))
    return F.concat(F.lit(category.capitalize() + " "), index_label(ordinal.cast("long")))
