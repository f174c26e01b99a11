"""Small tables for queries whose shapes the driver's tables do not hold, as Spark frames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def frame(spark: SparkSession, fixture: tuple[str, list[tuple]]) -> DataFrame:
    schema, rows = fixture
    return spark.createDataFrame(rows, schema)


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, (int, float)):
        return str(v)
    return " || chr(10) || ".join("'" + part.replace("'", "''") + "'" for part in v.split("\n"))


def values(fixture: tuple[str, list[tuple]], name: str) -> str:
    """The fixture as a common table expression."""
    schema, rows = fixture
    kinds = {"string": "VARCHAR", "long": "BIGINT", "int": "INTEGER", "boolean": "BOOLEAN"}
    columns = [c.split() for c in schema.split(", ")]
    typed = ", ".join(f"CAST({c} AS {kinds[k]}) AS {c}" for c, k in columns)
    listed = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    return f"{name} AS (SELECT {typed} FROM (VALUES {listed}) AS t({', '.join(c for c, _ in columns)}))"


DICTIONARY = {
    "BANK": ["Тестбанк", "ПАО Тестбанк"],
    "INS": ["Тест-Полис", "Северный Щит"],
    "PRODUCT": ["Луч + Плюс", "Тариф (новый) [1]"],
    "ORG": ["Рога и Копыта"],
    "PERSON": ["Ольга Б. Тестова"],
}

#: case_id, text, and what has to be found after overlaps are resolved.
DETECTOR_CASES = (
    "case_id long, text string, type string, value string, start_at long",
    [
        (1, "пишите: anna.k@mail.example", "EMAIL", "anna.k@mail.example", 8),
        (2, "+7 (812) 555-10-20", "PHONE", "+7 (812) 555-10-20", 0),
        (3, "8 900 555-10-20", "PHONE", "8 900 555-10-20", 0),
        (4, "78125551020", "PHONE", "78125551020", 0),
        (5, "(812) 555-10-20", None, None, None),
        (6, "ИНН 7712345678", "INN", "7712345678", 4),
        (7, "ИНН: 771234567890", "INN", "771234567890", 5),
        (8, "код 771234567890 указан", "INN", "771234567890", 4),
        (9, "7712345678", None, None, None),
        (10, "СНИЛС 111-222-333 44", "SNILS", "111-222-333 44", 6),
        (11, "СНИЛС: 11122233344", "SNILS", "11122233344", 7),
        (12, "паспорт 4001 654321", "PASSPORT", "паспорт 4001 654321", 0),
        (13, "серия 40 01 номер 654321", "PASSPORT", "серия 40 01 номер 654321", 0),
        (14, "карта 5500 0000 0000 0004", "CARD", "5500 0000 0000 0004", 6),
        (15, "р/с 40700000000000000001", "ACCOUNT", "40700000000000000001", 4),
        (16, "перевод через ПАО Тестбанк", "BANK", "ПАО Тестбанк", 14),
        (17, "полис Tест-Полис", "INS", "Тест-Полис", 6),
        (18, "Клиент Сидоров Олег Львович", "PERSON", "Сидоров Олег Львович", 7),
        (19, "Заявитель: Сидоров О.Л.", "PERSON", "Сидоров О.Л.", 11),
        (20, "индекс 190000", "ADDR", "190000", 7),
        (21, "г. Тверь, ул. Мира, д. 7, кв. 3", "ADDR", "г. Тверь, ул. Мира, д. 7, кв. 3", 0),
        (22, "просто строка", None, None, None),
        (23, "тариф ЛУЧ+плюс выбран", "PRODUCT", "ЛУЧ + плюс", 6),
        (24, "тариф Луч  +Плюс выбран", "PRODUCT", "Луч + Плюс", 6),
        (25, "мы — рога и копыта!", "ORG", "рога и копыта", 5),
        (26, "Тариф (новый) [1] действует", "PRODUCT", "Тариф (новый) [1]", 0),
        (27, "", None, None, None),
        (28, None, None, None, None),
        (29, "анкета: ольга б. тестова", "PERSON", "ольга б. тестова", 8),
        (30, "Северный Щит", "INS", "Северный Щит", 0),
        (31, "СеверныйЩит и Тестбанкир", None, None, None),
    ],
)

NORMAL_CASES = (
    "case_id long, text string, normal string, fixed string",
    [
        (1, "a\u00a0b\u2007c\u202fd", "a b c d", "a b c d"),
        (2, "x\u00ady\u2010z\u2011w", "x-y-z-w", "x-y-z-w"),
        (3, "a\u200bb\u200cc\u200dd", "abcd", "abcd"),
        (4, "Cогласие-Вита", "Cогласие-Вита", "Согласие-Вита"),
        (5, "Allianz MetLife PRODUCT_0011", "Allianz MetLife PRODUCT_0011", "Allianz MetLife PRODUCT_0011"),
        (6, "Tест и Test, Tест-AX", "Tест и Test, Tест-AX", "Тест и Test, Тест-АХ"),
        (7, "", "", ""),
    ],
)

OVERLAP_CASES = (
    "case_id long, value string, type string, start_at int, end_at int, ord int, kept boolean",
    [
        (1, "abcdef", "A", 0, 6, 0, True), (1, "bc", "B", 1, 3, 1, False),
        (2, "abcd", "A", 0, 4, 0, False), (2, "cdefgh", "B", 2, 8, 1, True),
        (3, "abcd", "A", 0, 4, 3, False), (3, "abcd", "B", 0, 4, 1, True),
        (4, "abcd", "A", 0, 4, 0, True), (4, "cdef", "A", 2, 6, 0, False),
        (5, "abc", "A", 0, 3, 0, True), (5, "def", "B", 3, 6, 1, True),
        (6, "ab", "A", 0, 2, 0, True), (6, "bcdef", "B", 2, 7, 1, True), (6, "fg", "C", 6, 8, 2, False),
        (7, "only", "A", 5, 9, 0, True),
    ],
)

REVIEW_CASES = (
    "case_id long, text string",
    [
        (1, "доступные значения для выбора: Гармония; Тест-Полис"),
        (2, "Гармония на обработку данных"),
        (3, "для партнёра BANK_0007 и программы Луч Плюс: срок"),
        (4, "партнёра «ИП Василёк» и"),
        (5, "пользователь Tест-Полис (не смотрим)"),
        (6, ""),
        (7, "просто строка"),
        (8, "для выбора: Гармония, Заря(Юг"),
        (9, "пользователь (Кузьма) не вошёл"),
        (10, "программа Поле выбора; продукт 3000"),
        (11, "партнёр ГАРМОНИЯ для всех; партнёр Гармония, нет"),
    ],
)
REVIEW_EXPECTED = (
    "case_id long, value string, type_guess string, reason string",
    [
        (1, "Гармония", "INS", "значения для выбора"),
        (3, "Луч Плюс", "PRODUCT", "программа"),
        (4, "ИП Василёк", "ORG", "партнёр"),
        (8, "Гармония", "INS", "значения для выбора"),
        (8, "Заря", "INS", "значения для выбора"),
        (8, "Юг", "INS", "значения для выбора"),
        (9, "Кузьма", "PERSON", "пользователь"),
        (10, "3000", "PRODUCT", "продукт"),
        (11, "ГАРМОНИЯ", "ORG", "партнёр"),
    ],
)

STATUS_CASES = (
    "case_id long, kind string, raw string, expected string",
    [
        (1, "required", None, "unknown"), (2, "required", "Обязательное", "required"), (3, "required", "Обязательное поле", "required"),
        (4, "required", "Обязательное, если заполнен адрес", "conditional"), (5, "required", "Нет", "no"), (6, "required", "Необязательное", "required"),
        (7, "required", "Не обязательно", "no"), (8, "required", "Да", "conditional"), (9, "required", " обязательное ", "required"), (10, "required", "нет, всё", "no"),
        (11, "default", None, "no_default"), (12, "default", "—", "empty_default"), (13, "default", "нет", "empty_default"), (14, "default", "Если выбран тип", "needs_manual_check"),
        (15, "default", "RUB", "has_default"), (16, "default", "– пусто", "empty_default"), (17, "availability", None, "unknown"), (18, "availability", "Недоступно", "not_available"),
        (19, "availability", "нет", "not_available"), (20, "availability", "Только для чтения", "read_only"), (21, "availability", "Доступно", "available"), (22, "availability", "По роли", "conditional"),
        (23, "auto", "Заполняется автоматически", "true"), (24, "auto", "Вручную", "false"), (25, "hidden", "Поле скрыто на ЭФ", "true"), (26, "hidden", "Виден всем", "false"),
    ],
)

_HEAD = ["Название поля", "Тип поля", "Доступность для редактирования", "Обязательность", "Способ указания значения", "Значение по умолчанию", "Прочие особенности поведения", "Текст ошибки", "Тип (повтор)"]
_BODY = {
    4: ["Основной блок"],
    5: ["Фамилия", "Строка", "Доступно", "Обязательное", "Вручную", "—", None, "Заполните поле"],
    6: ["Валюта", "Список", "Только для чтения", "Нет", "Автоматически", "RUB"],
    7: ["Код", "Строка", "Недоступно", "Обязательное", None, "Если выбран тип", "Поле скрыто на ЭФ"],
    9: [None, "Строка", "Доступно"],
    10: ["Второй блок"],
    11: ["Комментарий", "Текст", "По роли", "Обязательное, если есть адрес"],
}
CELLS = (
    "doc_id long, sheet_index int, sheet_name string, row int, col int, value string, value_type string",
    [(1, 0, "Форма", 1, 1, "Спецификация", "string")]
    + [(1, 0, "Форма", 3, c, v, "string") for c, v in enumerate(_HEAD, 1)]
    + [(1, 0, "Форма", r, c, v, "string") for r, cells in _BODY.items() for c, v in enumerate(cells, 1) if v is not None]
    + [(1, 1, "Пусто", 1, 1, "Просто текст", "string"), (1, 2, "Без имени", 1, 1, "Тип поля", "string"), (1, 2, "Без имени", 2, 1, "Строка", "string")],
)

PATHS = (
    "path string, doc_ord long, base string",
    [
        ("/in/a.docx", 0, "a_anon"), ("/in/a.pdf", 1, "a_pdf_anon"), ("/in/a.txt", 2, "a_txt_anon"), ("/in/b.TXT", 3, "b_anon"),
        ("/in/sub/a.txt", 4, "a_txt_anon_2"), ("/in/sub/b.xlsx", 5, "b_xlsx_anon"), ("/in/zz/a.txt", 6, "a_txt_anon_3"),
    ],
)

SEEDED = ("type string, original string, pseudonym string", [("PERSON", "Customer#1", "PERSON_0001"), ("PERSON", "Customer#3", "PERSON_0003"), ("PERSON", "odd", "PERSON_x"), ("BANK", "b", "BANK_9999")])

TOKEN_TEXTS = (
    "doc_id long, text string",
    [(1, "PERSON_0001 и PERSON_0002, снова PERSON_0001"), (2, "BANK_9999, X_0001 и X_0001"), (3, "PERSON_10000 без границ"), (4, "ничего"), (5, "")],
)
TOKEN_MAPPING = ("type string, original string, pseudonym string", [("PERSON", "Анна", "PERSON_0001"), ("PERSON", "Борис", "PERSON_0002"), ("BANK", "Тестбанк", "BANK_9999"), ("PERSON", "Вера", "PERSON_1000")])
