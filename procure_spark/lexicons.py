"""Word lists and patterns of the procurement domain, as defaults of operator parameters.

Fixed values: they must equal those that the operators' results are defined by.
"""

TOKEN_STOPWORDS = [
    "и", "или", "для", "по", "на", "с", "из", "под", "над", "в", "материал", "товар", "требуется", "аналог", "серый", "черный",
    "поставка", "закупка", "техническое", "задание", "описание", "объекта", "документация", "характеристики", "требования",
]

KEYWORD_STOPWORDS = [
    "не", "и", "или", "для", "на", "в", "с", "по", "из", "указано", "штука", "штук", "шт", "кг", "м2", "рул", "рулон", "упак",
    "литр", "единица", "ед", "марка", "тип", "вид", "класс", "материал", "товар", "продукт", "поставка", "закупка", "техническое",
    "задание", "описание", "объекта", "документация", "характеристики", "требования",
]

MARKS = ["тпп", "ткп", "хпп", "хкп", "эпп", "экп", "эмп"]

FIELD_NAMES = ["предмет закупки", "наименование", "описание", "объект закупки", "товар", "номенклатура", "позиция", "материал", "продукт", "изделие"]

PAREN_UNITS = ["штука", "штук", "шт", "м2", r"м\.кв", r"кв\.м", "м", "рулон", "рул", "кг", "г", "л", "литр", "упак", "уп", "комплект", "компл", "набор", "пара", r"п\.м", "пм", "погонный метр"]

QUANTITY_UNITS = (
    r"м2|м3|м|мм|кг|т|л|шт|упак(?:овка)?|меш(?:ок)?|рулон(?:ов)?|ведро|канистр(?:а|ы)?|лист(?:ов)?|компл(?:ект)?|паллет(?:а|ы)?|бухт(?:а|ы)?"
)

EXCLUDED_SECTIONS = [
    r"\bпорядок оплаты\b", r"\bответственност[ьи]\b", r"\bштраф\b", r"\bпен[яеи]\b", r"\bрасторжени[ея]\b", r"\bбанковск\w+\s+гарант",
    r"\bобеспечени[ея]\s+заявк", r"\bобеспечени[ея]\s+исполнени", r"\bреестр\b", r"\bнациональн\w+\s+режим\b", r"\bнмцк\b",
    r"\bобосновани\w+\s+цен", r"\bпорядок\s+подачи\s+заяв", r"\bкритери\w+\s+оценк", r"\bтребовани\w+\s+к\s+участник", r"\bанкет\w+\b",
    r"\bсогласие\s+на\s+обработку\b", r"\bцепочк\w+\s+собственник", r"\bантикоррупцион\w+\b", r"\bюридическ\w+\s+адрес\b",
    r"\bбанковск\w+\s+реквизит",
]

SECTION_STARTS = [
    r"\bтехническ\w+\s+задани", r"\bописани\w+\s+предмета\s+закупк", r"\bспецификаци", r"\bведомост\w+\s+материал", r"\bперечен\w+\s+материал",
    r"\bнаименование\s+товара", r"\bхарактеристик", r"\bтребования\s+к\s+продукци", r"\bобщие\s+требования\s+к\s+товар",
]

SECTION_ENDS = [
    r"\bпроект\s+договора\b", r"\bцена\s+договора\b", r"\bпорядок\s+приемк", r"\bответственност[ьи]\s+сторон\b",
    r"\bобстоятельств\w+\s+непреодолимой\s+силы\b", r"\bпорядок\s+рассмотрения\s+споров\b", r"\bзаключительн\w+\s+услов", r"\bреквизит",
    r"\bобосновани\w+\s+начальн", r"\bраздел\s+\d+\.\s+формы\s+документ",
]

MATERIAL_HINTS = [
    "кирпич", "блок", "цемент", "бетон", "раствор", "смесь", "шпатлев", "штукатур", "грунтовк", "краск", "эмаль", "лак", "герметик", "клей",
    "пена", "утеплител", "вата", "пенополистирол", "пеноплекс", "экструз", "гипсокартон", "гвл", "фанер", "осп", "osb", "дсп", "доска", "брус",
    "профнастил", "металлочерепиц", "лист оцинк", "арматур", "сетка", "труба", "фитинг", "муфт", "отвод", "кран", "кабель", "провод",
    "плитка", "керамогранит", "линолеум", "ламинат", "мембран", "геотекстил", "праймер", "мастик", "рубероид", "линокром", "техноэласт",
    "унифлекс", "рулемаст", "рубеmast", "брит", "изопласт", "битум", "шпонк", "лента",
]

SPEC_KEYWORDS = [
    "толщина", "ширина", "длина", "масса", "плотность", "фракция", "зернистость", "марка", "класс", "прочность", "разрывная сила", "гибкость",
    "теплостойкость", "теплопроводность", "влагостойкость", "морозостойкость", "горючесть", "водопоглощение", "адгезия", "расход",
    "время высыхания", "основа", "тип покрытия", "покрытие", "назначение", "применение", "цвет", "формат", "размер", "диаметр",
    "длина рулона", "ширина рулона", "температура", "давление", "напряжение", "сечение", "материал основы",
]

GENERAL_REQUIREMENTS = [
    "товар должен быть новым", "не бывшим в употреблении", "гарантийный срок", "сертификат", "декларация соответствия", "упаковка",
    "маркировка", "дата изготовления", "срок поставки", "доставка", "аналог", "эквивалент", "идентичности технических характеристик",
]

KEY_CHARACTERISTICS = [
    "толщина", "ширина", "длина", "масса", "плотность", "марка", "класс", "основа", "тип покрытия", "покрытие", "диаметр", "сечение",
    "прочность", "гибкость", "теплостойкость", "расход", "морозостойкость", "горючесть",
]

FORBIDDEN_EQUIVALENTS = [
    "эквивалент не допускается", "без эквивалента", "аналоги не допускаются", "поставка эквивалента не предусмотрена",
    "эквивалент не предусмотрен", "не допускается поставка эквивалента", "не подлежит замене на эквивалент",
    "поставка аналогов не допускается", "без аналогов",
]

EQUIVALENT_STEMS = ["эквивалент", "аналог"]

TOPICS = {
    "customer_info": ["заказчик", "инн", "кпп", "огрн", "адрес", "контакт", "телефон", "email", "почта", "реквизит"],
    "subject": ["предмет", "объект", "закупк", "товар", "работ", "услуг", "наименование", "описание"],
    "items_quantities": ["количеств", "объем", "единиц", "ед.", "штук", "спецификац", "таблиц"],
    "nmcc_prices": ["нмцк", "цена", "стоимость", "руб", "начальная", "максимальная", "смет"],
    "delivery_terms": ["срок", "поставк", "исполнени", "этап", "график", "период", "дней", "рабочих", "календарных"],
    "logistics": ["место", "доставк", "разгрузк", "приемк", "склад", "адрес", "транспорт"],
    "payment": ["оплат", "расчет", "аванс", "казначейск", "счет", "рабочих дней", "календарных дней"],
    "bid_docs": ["заявк", "участник", "документ", "декларац", "выписк", "свидетельств", "лиценз"],
    "delivery_docs": ["накладн", "акт", "упд", "счет-фактур", "сертификат", "паспорт", "при поставке"],
    "liability": ["штраф", "пен", "неустойк", "ответственност", "расторжени", "односторон"],
    "equivalents": ["эквивалент", "аналог", "товарный знак", "замен"],
    "restrictions": ["национальн", "режим", "запрет", "допуск", "пп рф", "постановлен", "реестр"],
    "conflicts": ["противореч", "разноглас", "несоответств", "разные значения"],
}

#: Topics of one value; all others gather theirs.
SELECT_TOPICS = ["equivalents", "nmcc_prices"]

#: Facts by pattern: topic, value type, confidence, pattern over lower-case text, group of the number.
FACT_RULES = [
    ("nmcc_prices", "nmcc", "high", r"(нмцк|начальная\s*\(?максимальная\)?\s*цена\s*контракта)[\s:.-]*([\d\s.,]+)\s*(руб|₽)", 2),
    ("payment", "advance_percent", "medium", r"(аванс|авансовый\s*платеж)[^\.]{0,120}?(\d+(?:[.,]\d+)?)\s*%", 2),
    ("liability", "penalty_percent", "medium", r"(штраф|пеня|пени|неустойка)[^\.]{0,160}?(\d+(?:[.,]\d+)?)\s*%", 2),
    ("payment", "payment_days", "high", r"оплат[^\.]{0,180}?в\s*течение\s*(\d+)\s*(рабочих|календарных)?\s*дней", 1, 2),
]

# The kind of days where a term names none; what a header of a table of items names; warnings about positions.
PLAIN_DAYS = "дней"
ITEM_WORDS = ["наименование", "товар", "услуг", "работ"]
QUANTITY_WORDS = ["количеств", "объем", "кол-во"]
NO_CHARACTERISTICS = "У найденных позиций отсутствуют характеристики"
NO_QUANTITIES = "У найденных позиций отсутствуют количества из-за неполного распознавания или их отсутствия в тексте"

MEASURES = {
    "thickness": [r"толщин[аы]?[^\d]{0,15}(\d+(?:\.\d+)?)", r"\b(\d+(?:\.\d+)?)\s*мм\b"],
    "mass": [r"масс[аы]?[^\d]{0,15}(\d+(?:\.\d+)?)", r"\b(\d+(?:\.\d+)?)\s*кг/?м2\b", r"\b(\d+(?:\.\d+)?)\s*кг/?м²"],
    "flexibility": [r"гибкост[ьи][^\-\d]{0,15}(-?\d+(?:\.\d+)?)", r"(?:^|[^\w.])(-?\d+(?:\.\d+)?)\s*°?c\b"],
}

BLANK_VALUES = ["не указано", "нет", "null", "none", ""]

FRAGMENT_TYPES = [
    ("GOODS_GENERAL_REQUIREMENTS", ["товар должен быть новым", "гарантийный срок", "сертификат", "декларация соответствия", "упаковка", "маркировка", "общие требования к товарам", "общие требования к товару"]),
    ("GOODS_SPEC", ["техническое задание", "описание объекта закупки", "спецификация", "наименование товара", "характеристики", "ведомость материалов", "товар", "материал", "ед. изм", "количество", "кол-во"]),
    ("CONTRACT_TERMS", ["оплата", "штраф", "пеня", "неустойка", "расторжение", "ответственность сторон", "порядок приемки", "приемка", "расчеты", "реквизиты", "порядок расчетов"]),
    ("PROCUREMENT_RULES", ["требования к участнику", "состав заявки", "критерии оценки", "инструкция", "форма заявки", "обеспечение заявки", "банковская гарантия", "участник закупки"]),
    ("PRICE_JUSTIFICATION", ["нмцк", "обоснование цены", "обоснование начальной", "смета", "коммерческое предложение", "расчет цены"]),
]

DOC_ROLES = [
    ("price_calc", ["нмцд", "нмцк", "обоснован", "расчет нмц", "смет"]),
    ("national_regime", ["нац режим", "национальн", "страна происх", "реестр российск", "ограничени", "запрет", "преференц"]),
    ("application_docs", ["инструкц", "заявк", "образц", "форма ", "требовани к содержанию", "критерии оценки", "участник закупки"]),
    ("tender_spec", ["техническое задание", "техзадание", "тз", "описание объекта закупки", "спецификац", "ведомость материалов", "перечень материалов", "товарная номенклатура", "технические характеристики"]),
    ("contract", ["договор", "контракт", "проект договора", "проект контракта"]),
    ("notice", ["извещение", "notice", "информационная карта"]),
]

MATERIAL_TERMS = [
    "гидроизол", "техноэласт", "унифлекс", "линокром", "биполь", "филизол", "рубитэкс", "эластобит", "стеклоэласт", "стеклоизол", "гидростеклоизол",
    "изоэласт", "мостослой", "тэксослой", "мастика", "праймер", "мембрана", "герметик", "лента", "геотекстиль", "геомембрана", "шпонка", "пароизоляция",
]

TECHNICAL_TERMS = ["характерист", "основа", "толщин", "масса", "гибкост", "теплостойк", "маркировк", "рулон", "кг", "мм", "м2", "м²", "ед. изм", "количество"]

RELEVANT_TERMS = ["техническое задание", "описание объекта закупки", "спецификац", "наименование товара", "характерист", "материал", "товар", "поставка", "основа", "толщин", "масса", "гибкост", "теплостойк"]

IRRELEVANT_TERMS = ["оплата", "штраф", "пеня", "неустойк", "расторжен", "ответственность", "реквизит", "участник закупки", "инструкция", "критерии оценки", "нмцд", "нмцк", "обоснован", "нац режим", "реестр", "банковская гарантия", "обеспечение исполнения", "срок оплаты", "порядок расчетов"]

REQUIREMENT_TERMS = [
    "техническое задание", "описание объекта закупки", "спецификац", "ведомость материалов", "наименование товара", "характерист", "материал", "товар",
    "поставка", "основа", "толщин", "масса", "параметр", "значение", "требован", "гост", "ту ", "ост ",
]

COLON_TERMS = ["характерист", "параметр", "значение"]

PROCESS_TERMS = [
    "оплата", "штраф", "пеня", "неустойк", "расторжен", "ответственность", "реквизит", "участник закупки", "инструкция", "заявка", "критерии оценки",
    "нмцд", "нмцк", "обоснован", "нац режим", "реестр", "банковская гарантия", "обеспечение исполнения", "порядок расчетов", "срок оплаты",
]

NOISE_TERMS = [
    "оплата", "штраф", "пеня", "неустойк", "расторжен", "ответственность", "реквизит", "участник закупки", "инструкция", "образцы форм", "критерии оценки",
    "нмцд", "нмцк", "обоснован", "нац режим", "реестр", "банковская гарантия", "обеспечение исполнения", "порядок расчетов", "срок оплаты", "извещение",
    "подача заявок", "комиссия", "жалоб", "протокол", "контактн",
]

PRODUCT_LINE_TERMS = [
    "гост", "ту ", "ост ", "характеристик", "параметр", "значение", "толщин", "масса", "вес ", "длина", "ширина", "высота", "диаметр", "марка", "модель",
    "артикул", "тип ", "состав", "свойства", "наименование", "материал", "товар", "количеств", "ед. изм", "ед изм",
]

SPEC_LINE_BARS = [
    "штраф", "пеня", "неустойк", "оплат", "аванс", "расчет", "расчёт", "приемк", "приёмк", "расторжен", "ответственност", "обеспечени", "реквизит",
    "подсудност", "гарант", "срок исполнен", "срок поставки", "нацрежим", "нац режим", "реестр", "нмцк", "обоснован", "извещени", "комисси", "заявк",
    "участник", "контракт", "договор", "проект договора", "пик", "стр.", ".doc", ".docx", ".pdf", ".xls", ".xlsx",
]

LINE_UNITS = r"мм|м2|м²|м|кг|л|шт|рулон|компл|уп|т|гр|см"

CATEGORY_WHITELIST = ["гидроизоляция", "мастика", "праймер", "рубероид", "гидроизол", "материалы", "кровля", "строительные", "битум", "изоляция", "утеплитель"]

#: (needed in the path, not allowed in it, rank); the first that fits holds.
HREF_RANKS = [("/common-info", "/printform/", 0), ("/documents", "/printform/", 1), ("/contract-info", "/printform/", 2), ("/plan.html", None, 100), ("/printform/.*/common-info|/common-info.*/printform/|/printform/common-info", None, 50)]

TECHNICAL_PARTS = ("/printform/", "/print-form/", "listmodal")

DROP_PARAMETERS = ("gclid", "fbclid", "yclid")

ASSETS = ("jpg", "jpeg", "png", "svg", "ico", "webp", "css", "js", "pdf", "zip")

CONTENT_TYPES = [("pdf", ".pdf"), ("wordprocessingml", ".docx"), ("msword", ".doc"), ("spreadsheetml", ".xlsx"), ("excel", ".xls"), ("zip", ".zip"), ("rar", ".rar"), ("7z", ".7z")]

#: (terms of which the name holds one, or a suffix that it has, priority, class); the first that fits holds.
GOODS_PRIORITY = [
    (["описан", "объект", "тех", "тз"], None, 1, "goods_main"),
    (["специфик", "ведомост", "номенклат"], None, 2, "goods_spec"),
    ([], r"\.xlsx?$", 3, "goods_excel"),
    (["проект", "контракт", "договор"], None, 4, "contract"),
    (["извещ"], None, 5, "notice"),
    (["нмцк", "обоснован", "смет"], None, 6, "price"),
]

MAGIC = {"pdf": ["25504446"], "docx": ["504B0304"], "xlsx": ["504B0304"], "zip": ["504B0304"], "doc": ["D0CF11E0A1B11AE1"], "xls": ["D0CF11E0A1B11AE1"]}

#: Marks of links to files.
DOWNLOAD_MARKS = ("download", "downloadfile", "download.html?id=", "attachment", "filestore")

#: A report's title, what an empty one says, and how its sections begin (a pattern).
REPORT_TITLE = "# Юридическое заключение по тендеру"
REPORT_EMPTY = "Отчет не сформирован."
REPORT_SECTION = r"\d|Краткое резюме"

REPORT_HEADERS = [
    "## 0. Карточка Заказчика",
    "## 1. Риски участия и исполнения договора",
    "## 2. Риски недопуска заявки и потери баллов",
    "## 3. Проверка соответствия требованиям ТД и закона",
    "## 3.1. Возможность поставки эквивалентов (аналогов)",
    "## 4. Условия поставки и приёмки",
    "## 5. Условия оплаты",
    "## 6. Ответственность сторон",
    "## 7. Полный перечень документов, которые должны входить в состав заявки",
    "## 8. Отдельный перечень документов, предоставляемых при поставке",
    "## 9. Требования к продукции по реестрам и ограничениям",
    "## 10. Рекомендации Поставщику",
]

REPORT_TABLES = ["## 0. Карточка Заказчика", "## 0.1. Сводная таблица товаров", "## 3.1. Возможность поставки эквивалентов"]

# Parts of a category and the material types that they tell; the type of all others.
MATERIAL_TYPES = [("рулон", "Рулонный")]
OTHER_MATERIAL = "Гидроизоляция"

# What the jobs say of documents and positions, and the marks in the texts that they put together.
NO_TEXT = "Текст не извлечен"
NO_FRAGMENTS = "Документ прочитан, но релевантные товарно-технические фрагменты не найдены (role={role})"
DESCRIPTION_NAME, DESCRIPTION_MARK = "CRM_DESCRIPTION", "[CRM_DESCRIPTION_FALLBACK]"
ONLY_DESCRIPTION = "Документы тендера отсутствуют. Использовано только описание из CRM как аварийный fallback."
NO_POSITIONS = "Позиции не выделены автоматически. Требуется ручная проверка блока ТЗ."
MANY_POSITIONS = "Найдено аномально много позиций. Возможна ошибка OCR или захват служебных таблиц."
FILE_HEAD = "=== FILE: {name} | DOC_CLASS_HINT: {kind} | PRIORITY: {priority} | STATUS: {status} | TEXT_LEN: {length} ==="
PAGE_HEAD = "--- PAGE_OR_SHEET: 1 | FRAGMENT_TYPE_HINT: {kind} ---"
TEXT_MARK = "[TEXT]"
ARCHIVES = ("zip", "7z", "rar")
ARCHIVE_REASON, SIZE_REASON = "archive_not_supported_for_direct_analysis", "max_total_chars_exceeded"

# Parts of content types and the extensions that they declare.
DECLARED = [("pdf", "pdf"), ("wordprocessingml", "docx"), ("spreadsheetml", "xlsx"), ("application/zip", "zip"), ("msword", "doc"), ("application/vnd.ms-excel", "xls")]
