"""Fixed values that results depend on: types, patterns, word lists and markers, in their natural order.

Patterns are Java's; (?U) makes \\s, \\d, \\w and case go by Unicode.
"""

# Entity types in the order of the registry, with the dictionary that some of them read.
ENTITY_TYPES = {
    "PERSON": "persons", "BANK": "banks", "INS": "insurance", "PRODUCT": "products", "ORG": "orgs", "PHONE": None, "EMAIL": None,
    "INN": None, "SNILS": None, "PASSPORT": None, "CARD": None, "ACCOUNT": None, "ADDR": None,
}

# The order in which detectors are registered; it decides ties between spans of one length and start.
DETECTOR_ORDER = ["EMAIL", "PHONE", "CARD", "ACCOUNT", "INN", "SNILS", "PASSPORT", "BANK", "INS", "PRODUCT", "ORG", "PERSON", "ADDR"]

# Fixed values: (type, pattern, group). Where a group is given it ends the match and is the value.
PATTERNS = [
    ("EMAIL", r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}(?![A-Za-z0-9])", 0),
    ("PHONE", r"(?U)(?<!\d)(?:\+7|7|8)\s*\(?\d{3}\)?[\s\-]*\d{3}[\s\-]*\d{2}[\s\-]*\d{2}|(?<!\d)\(?\d{3}\)?[\s\-]*\d{2}[\s\-]*\d{2}[\s\-]*\d{2}(?!\d)", 0),
    ("CARD", r"(?U)(?<!\d)(?:\d{4}[\s\-]?){3}\d{4}(?!\d)", 0),
    ("ACCOUNT", r"(?iU)(?:сч[её]т|р/с|к/с)[\s:№]*?(\d{20})(?!\d)", 1),
    ("ACCOUNT", r"(?U)(?<!\d)\d{20}(?!\d)", 0),
    ("INN", r"(?iU)ИНН[\s:№]*?(\d{12}|\d{10})(?!\d)", 1),
    ("INN", r"(?U)(?<!\d)\d{12}(?!\d)", 0),
    ("SNILS", r"(?U)(?<!\d)\d{3}-\d{3}-\d{3}\s\d{2}(?!\d)", 0),
    ("SNILS", r"(?iU)СНИЛС[\s:№]*?(\d{11})(?!\d)", 1),
    ("PASSPORT", r"(?U)(?<!\d)\d{4}\s\d{6}(?!\d)", 0),
    ("PASSPORT", r"(?iU)(?:серия|паспорт)[\s:№]*(\d{2}\s?\d{2})\s*(?:номер\s*)?(\d{6})(?!\d)", 0),
]

# What stands ahead of a name, the two shapes of names, and how far they are looked for.
PERSON_KEYS = r"(?iU)(страхователь|застрахованн(?:ый|ая|ое)|собственник|выгодоприобретатель|клиент|гражданин|гражданка|ФИО|Ф\.И\.О\.|заявитель|паспортодержатель|владелец|пользователь|застрахованное\s+лицо)"
FULL_NAME = r"(?U)[А-ЯЁ][а-яё]+(?:\s+[А-ЯЁ][а-яё]+){1,2}"
INITIALS = r"(?U)[А-ЯЁ][а-яё]+\s+[А-ЯЁ]\.[А-ЯЁ]\."
NAME_WINDOW = 60

# Words of an address, the name after one, and the postal index.
ADDRESS_WORDS = [
    r"г\.?", "город", r"обл\.?", "область", r"респ\.?", "республика", "край", r"ул\.?", "улица", r"пр\.?", r"пр-т\.?", "проспект", r"пер\.?", "переулок", r"ш\.?", "шоссе", r"пл\.?", "площадь",
    r"д\.?", "дом", r"корп\.?", "строение", r"стр\.?", r"кв\.?", "квартира", "офис", "литера", r"мкр\.?", "микрорайон", r"нп\.?", r"населённый\s+пункт",
]
ADDRESS_NAME = r"[ \t]*[А-ЯЁ][а-яё\-]+"
POSTAL_INDEX = r"(?iU)(?:индекс|почтовый\s+индекс)\s*[:№]?\s*(\d{6})"
LETTERS = "А-Яа-яЁёA-Za-z"

# Characters that normalisation replaces, the replacements (the last three have none), and look-alikes.
NORMAL_FROM, NORMAL_TO = "\u00a0\u2007\u202f\u00ad\u2010\u2011\u200b\u200c\u200d", "   ---"
LATIN, CYRILLIC = "AaCcEeOoPpHhKkMmTtXxYyBb", "АаСсЕеОоРрНнКкМмТтХхУуВв"

TOKEN = r"[A-Z]+_\d{4}"
#: Numbers run on past 9999; those of more digits have no zero ahead, so PHONE_00015 is PHONE_0001 and a 5.
LONG_TOKEN = r"[A-Z]+_(?:[1-9]\d{4,}|\d{4})"
CANDIDATE_START = "^[А-ЯЁA-Z0-9]"

# Contexts of review candidates: (reason, pattern, number of value groups, type guessed).
_ENDS_ORG = r"(?=\s+(?:и|или|для|по|не|при|то|если|кроме|без|после|до|только|указан|загружен|является)\b|[;:,\n]|$)"
_ENDS_PRODUCT = r"(?=\s+(?:на|по|для|при|то|если|кроме|без|после|до|только|не|и|или|указан|загружен|определяется|необходимо|должно|поле|значение|выводится|отображается)\b|[;:,\n]|$)"
_ENDS_PERSON = r"(?=\s+(?:не|для|по|при|то|если|и|или)\b|[;,\n]|\(|$)"
REVIEW_PATTERNS = [
    ("партнёр", r"(?iU)партн[её]р\w*\s+(?:«([^»]+)»|\(([^)]+)\)|([^\n;,]{1,40}?))" + _ENDS_ORG, 3, "ORG"),
    ("программа", r"(?iU)программ\w*\s+([^\n:;,]{1,40}?)" + _ENDS_PRODUCT, 1, "PRODUCT"),
    ("продукт", r"(?iU)продукт\w*\s+([^\n:;,]{1,40}?)" + _ENDS_PRODUCT, 1, "PRODUCT"),
    ("значения для выбора", r"(?iU)(?:для\s+выбора|доступные\s+значения[^\n:]*?)[:]\s*([^;\n]{1,120}?)(?=[;\n]|$)", 1, "INS"),
    ("пользователь", r"(?iU)пользовател\w*\s+(?:«([^»]+)»|\(([^)]+)\)|([^\n(;,]{1,40}?))" + _ENDS_PERSON, 3, "PERSON"),
]

# Words that are no name, and what no name begins with.
STOP_WORDS = (
    "и или не для по при если то все всех всем остальные остальных иных других другие на в с со выбора значения значение поле наименование поля нет да только кроме без до после укажите необходимо выбрать должно должен страхования страховки новое"
).split()
STOP_PREFIXES = ["блок ", "поле ", "наименование ", "документ ", "форма ", "раздел ", "группа ", "доступные значения "]

# Roles of a form table's columns with the markers that give them away, by priority.
ROLE_MARKERS = [
    ("default_value", ["значение, указываемое при открытии страницы", "значение по умолчанию", "значение при открытии", "default value", "default"]),
    ("field_name", ["группа полей / поле", "группа полей", "название поля", "наименование поля"]),
    ("type", ["тип поля", "тип элемента", "тип"]),
    ("availability", ["доступность для редактирования", "доступность"]),
    ("required", ["обязательность заполнения", "обязательность", "обязательное поле", "обязательное", "required", "mandatory"]),
    ("input_method", ["способ указания значения", "способ указания", "способ заполнения", "способ ввода", "input method"]),
    ("behavior_notes", ["прочие особенности поведения", "особенности поведения", "прочие особенности", "особенности"]),
    ("constraints", ["текст ограничений", "оповещения об ошибках", "текст ошибки", "сообщение об ошибке", "подсказка", "tooltip", "ограничения"]),
]
HEADER_MARKERS = ["обязательность", "тип поля", "способ указания", "значение, указываемое", "доступность для редактирования", "значение по умолчанию"]
HEADER_ROWS = 15
HIDDEN_MARKERS = ["поле скрыто на эф", "скрыто на эф", "поле скрыто"]
REQUIRED_IF = ["если", "при ", "услов", "то поле", "то оно", "то оно обязательно"]
NOT_REQUIRED = ["нет", "необязательное", "не обязательно", "нет обязательности"]
DEFAULT_IF = ["если", "при услов"]
NO_DEFAULT = ["—", "-", "–", "нет", "не предусмотрено", "нет значения", "n/a", "- нет -", "-нет-"]
READ_ONLY = ["только для чтения", "read-only", "read only", "только чтение"]
AUTO_INPUT = ["автоматически", "присваивается системой", "автоматич"]
NOTE_NO_HEADER = "Строка заголовков не обнаружена — лист пропущен (нет структуры спецификации)."
NOTE_NO_NAME = "Не найден столбец имени поля — структура не распознана, лист пропущен."
NOTE_HIDDEN = "Поле скрыто на ЭФ и помечено обязательным -> условная обязательность."
REASON_NAMELESS = "Строка с признаками параметра, но без имени поля."

# File suffixes and folders.
TEXT_SUFFIXES = [".txt", ".pdf", ".doc", ".docx"]
TABLE_SUFFIXES = [".xlsx"]
OUTPUT_FOLDER, RESTORED_FOLDER = "anonimized", "deanonimized"
