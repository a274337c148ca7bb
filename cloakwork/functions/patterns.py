"""Entity patterns, as Java regular expressions, and word lists."""

from __future__ import annotations

# Flags that make Java fold Cyrillic and treat classes as Unicode.
FLAGS = "(?iuU)"

# Building blocks of addresses, organisations and dates.
ORG_FORMS = ("ООО", "ОАО", "ЗАО", "АО", "ПАО", "ИП", "НКО", "ФГУП", "ГУП", "АНО")
VALUE_FORMS = ("ООО", "АО", "ПАО", "ЗАО", "ИП", "ОАО", "НКО", "ФГУП", "МУП", "ГУП")
MONTHS = "января|январе|январь|февраля|феврале|февраль|марта|марте|март|апреля|апреле|апрель|мая|мае|май|июня|июне|июнь|июля|июле|июль|августа|августе|август|сентября|сентябре|сентябрь|октября|октябре|октябрь|ноября|ноябре|ноябрь|декабря|декабре|декабрь"
STREET = r"(?:ул(?:\.|ица)|пр(?:\.|оспект)|пер(?:\.|еулок)|наб(?:\.|ережная)|шоссе|пл(?:\.|ощадь)|б(?:-р|ульвар)|проезд|тупик)"
STREET_NAME = r"[А-ЯЁа-яё0-9][\wа-яёА-ЯЁ\-]*(?:\s+[А-ЯЁа-яё0-9][\wа-яёА-ЯЁ\-]*){0,3}"
HOUSE = r",?\s*д(?:\.|ом\.?)\s*\d+[\w\-/]*"
BUILDING = r"(?:,?\s*(?:к(?:\.|орп\.?)|стр(?:\.?)?)\s*\d+[\w\-/]*)?"
FLAT = r"(?:,?\s*(?:кв(?:\.|арт\.?)|оф(?:\.)?)\s*\d+)?"
TOWN = r"(?:г(?:\.|ород)|п(?:\.|ос(?:\.|елок))|с(?:\.|ело)|д(?:\.|еревня))"
TOWN_NAME = r"[А-ЯЁ][а-яёА-ЯЁ\-]+(?:-[А-ЯЁ][а-яёА-ЯЁ\-]+)*"

# Detectors in order (the order breaks ties): (label, pattern, whole line only).
DETECTORS: list[tuple[str, str, bool]] = [
    ("EMAIL", r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}", False),
    ("ТЕЛЕФОН", r"(?<!\d)(?:\+7|8)[\s\-]?\(?\d{3}\)?[\s\-]?\d{3}[\s\-]?\d{2}[\s\-]?\d{2}(?!\d)", False),
    ("IP", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", False),
    ("ОРГ", r"(?<![Ѐ-ӿ\w])(?:" + "|".join(ORG_FORMS) + r")(?![Ѐ-ӿ\w])(?:\s+[«\"][А-ЯЁа-яёA-Za-z0-9][\w\s\-]*?[»\"]|\s+[А-ЯЁ][а-яёА-ЯЁ\w\-]{1,40}(?:\s+[А-ЯЁ][а-яёА-ЯЁ\w\-]{1,40}){0,3})?", False),
    ("ФИО", r"[А-ЯЁ][а-яё]+\s+[А-ЯЁ]\.[А-ЯЁ]\.", False),
    ("ФИО", r"[А-ЯЁ]\.[А-ЯЁ]\.\s+[А-ЯЁ][а-яё]+", False),
    ("ФИО", r"[А-ЯЁ][а-яё]{3,}\s+[А-ЯЁ][а-яё]{3,}\s+[А-ЯЁ][а-яё]{3,}", True),
    ("АДРЕС", TOWN + r"\s+" + TOWN_NAME + r",\s*" + STREET + r"\s+" + STREET_NAME + "(?:" + HOUSE + ")?" + BUILDING + FLAT, False),
    ("АДРЕС", STREET + r"\s+" + STREET_NAME + r",\s*" + HOUSE + BUILDING + FLAT, False),
    ("ДОГОВОР", r"№\s?\d+[\-/\d]*", False),
    ("ДАТА", r"\b(?:\d{2}\.\d{2}\.\d{4}|\d{4}-\d{2}-\d{2})\b", False),
    ("ДАТА", r"(?:«\d{1,2}»|\"\d{1,2}\"|\b\d{1,2})\s+(?:" + MONTHS + r")\s+\d{4}(?:\s*г\.?)?", False),
]

# Identity numbers, an optional group of detectors.
IDENTITY: list[tuple[str, str, bool]] = [
    ("ПАСПОРТ", r"(?:серия\s+)?(?:\d{4}|\d{2}\s\d{2})\s*(?:№|N|номер|no\.?)?\s*\d{6}", False),
    ("СНИЛС", r"\d{3}-\d{3}-\d{3}\s\d{2}|(?<!\d)\d{11}(?!\d)", False),
    ("ИНН", r"(?:ИНН\s*[:\-]?\s*)?(?:(?<!\d)\d{12}(?!\d)|(?<!\d)\d{10}(?!\d))", False),
    ("КПП", r"КПП\s*[:\-]?\s*(?<!\d)\d{9}(?!\d)", False),
]

# Place words that rule a whole-line name out.
GEO_WORDS = "москва санкт-петербург петербург новосибирск екатеринбург казань нижний новгород челябинск самара омск ростов уфа красноярск пермь воронеж волгоград краснодар саратов тюмень тольятти ижевск барнаул ульяновск иркутск хабаровск ярославль владивосток махачкала томск оренбург кемерово россия рф беларусь украина казахстан улица проспект переулок бульвар площадь район область край округ республика".split()

# Words that are no organisation on their own.
ORG_COMMON = "заказчик заказчика заказчику заказчиком исполнитель исполнителя исполнителю подрядчик подрядчика подрядчику покупатель поставщик арендодатель арендатор сторона стороны стороне доверенность доверенности доверенностю доверенностью договор договора договору договором соглашение соглашения приложение акт счет заключение работа работы работам услуга услуги услугам заказ заказа заказу заказом поставка оплата отдел департамент управление служба центр компания организация предприятие подразделение филиал руководитель директор менеджер сотрудник работник специалист председатель заместитель начальник проект программа проекты клиент партнер контрагент".split()

# Common words that taggers mistake for people.
COMMON = "приоритетным приоритетный приоритетная приоритетное продуктовым продуктовый продуктовая направлениям направление направления направлений заказчик заказчика заказчику заказчиком исполнитель исполнителя исполнителю подрядчик подрядчика подрядчику покупатель поставщик поставщика арендодатель арендатор сторона стороны стороне сторонам доверенность доверенности доверенностю договор договора договору договором договоры соглашение соглашения соглашению приложение приложения приложению спецификация спецификации акт акта акту актом счет счета счету счетом заключение заключения работа работы работам работу услуга услуги услугам заказ заказа заказу заказом заказы поставка поставки поставку оплата оплаты оплате вознаграждение вознаграждения отдел отдела отделу департамент департамента управление управления служба службы центр центра компания компании организация организации предприятие предприятия подразделение подразделения филиал филиала руководитель руководителя директор директора менеджер менеджера сотрудник сотрудника сотруднику работник работника специалист специалиста председатель председателя заместитель заместителя начальник начальника главный главного главной генеральный генеральная генеральное исполнительный исполнительная финансовый финансовая финансовое коммерческий коммерческая технический техническая операционный операционная стратегический стратегическая региональный региональная федеральный федеральная государственный государственная муниципальный муниципальная общий общая общее основной основная дополнительный дополнительная специальный специальная отдельный отдельная ключевой ключевая информация документ отчет платеж оплата сумма стоимость проект проекта проекту программа программы клиент клиента партнер контрагент".split()

# What an entity cannot be without, by label: a character, or a match of a simple pattern.
CYRILLIC = "[\u0400-\u052f\u1c80-\u1c8f]"
MARKS = {"EMAIL": "@", "ДОГОВОР": "№"}
NEEDS = {"ТЕЛЕФОН": r"(?U)\d{2}", "IP": r"(?U)\d\.\d", "ОРГ": CYRILLIC, "ФИО": CYRILLIC, "АДРЕС": CYRILLIC, "ДАТА": r"(?U)\d{4}", "ПАСПОРТ": r"(?U)\d{6}", "СНИЛС": r"(?U)\d{2}", "ИНН": r"(?U)\d{10}", "КПП": r"(?U)\d{9}"}

# Endings that part a name's stem, in the order in which they are tried.
STEM_ENDINGS = "овой овый евой евый еской еский овое евое еское ами ах ом ой ого ем ей его ю я е и у а".split()

# Lines of two to four capitalised words (for the recogniser by line), and the word put before them.
NAME_LINE = r"^[А-ЯЁ][а-яёА-ЯЁ\-]+(?:\s+[А-ЯЁ][а-яёА-ЯЁ\-]+){1,3}$"
NAME_PREFIX = "Работник "

# Labels of models by kind, labels that a model is asked for, and confidences by word.
MODEL_LABELS = {"PER": "ФИО", "ORG": "ОРГ"}
ASKED_LABELS = ("person", "organization", "address", "phone", "email", "date", "passport", "inn", "snils", "contract number")
CONFIDENCE = {"high": 0.9, "medium": 0.6, "low": 0.3}
LEAST_PERSON = 0.4

PERSON_LABELS = ("ФИО", "PER", "person")
ORG_LABELS = ("ОРГ", "ORG", "organization")
LABELS = ("ФИО", "ОРГ", "EMAIL", "ТЕЛЕФОН", "IP", "ДОГОВОР", "СУММА", "ДАТА", "АДРЕС", "ПАСПОРТ", "СНИЛС", "ИНН", "КПП")
HIDDEN = "СКРЫТО"

# Header substrings by use.
SENSITIVE_HEADERS = "предприятие,контрагент,поставщик,рабочее место,организация,компания,подрядчик,исполнитель,фио,имя,сотрудник,создал,обнаружил,автор,ответственный,сумма,цена,стоимость,тариф,договор,контракт,номер,документ,счёт,счет,заказ,заявка,сообщение,карточка".split(",")
IDENTIFIER_HEADERS = "документ,договор,контракт,номер,заказ,заявка,сообщение,карточка,счёт,счет,код,артикул,вагон,позиция,id,№".split(",")
CATEGORY_HEADERS = {
    "person": "фио,сотрудник,автор,ответственный,создал,обнаружил,специалист".split(","),
    "company": "контрагент,предприятие,организация,компания,поставщик,подрядчик,исполнитель,рабочее место".split(","),
    "phone": "телефон,тел.,phone,моб".split(","),
    "email": "email,почта,e-mail,mail".split(","),
    "address": "адрес,address,местонахождение".split(","),
    "city": "город,населённый пункт".split(","),
}

# Classes of whole values, in order of preference.
VALUE_CLASSES = {
    "email": r"(?U)^[^@\s]+@[^@\s]+\.[^@\s]+$",
    "phone": r"(?U)^[\+7\(8][\d\s\-\(\)]{8,}$",
    "ip": r"^\d{1,3}(?:\.\d{1,3}){3}$",
    "company": r"(?iu)^(?:" + "|".join(VALUE_FORMS) + r")\s",
}
