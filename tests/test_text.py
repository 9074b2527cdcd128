"""Golden values of the column functions, Russian text included."""

import pytest
from pyspark.sql import functions as F

from procure_spark.functions import text as T


def values(spark, column, rows, **types):
    df = spark.createDataFrame([(r,) for r in rows], types.get("schema", "x string"))
    return [r[0] for r in df.select(column(F.col("x"))).collect()]


@pytest.mark.parametrize(
    ("function", "given", "wanted"),
    [
        (T.parse_price, ["1 234,56", "1.234,56", "1,234.56", "1 000 000 руб.", "12,5,7", "нет", "", None, "-5", "10,50"], [1234.56, 1234.56, 1234.56, 1000000.0, 1257.0, 0.0, 0.0, 0.0, -5.0, 10.5]),
        (T.first_number, ["Цена 1 200,50 руб", "1.2.3", "нет", None], [1200.5, None, None, None]),
        (T.norm_text, ["  а\xa0 б \n\n\n\n в ", None], ["а б \n\n в", ""]),
        (T.norm_name, ["1. Рубероид РКП-350 цена 100", "Мастика или эквивалент", "  Кирпич; "], ["Рубероид РКП-350", "Мастика", "Кирпич"]),
        (T.clean_query, ["Наименование | Техноэласт ЭПП | тз.docx, стр.2 |", "Мастика (кг)", "Праймер (не указано)*", "Лист ГОСТ 123-45", "Клей (10 кг)", "(кг)", None], ["Техноэласт ЭПП", "Мастика", "Праймер", "Лист", "Клей", "(кг)", ""]),
        (T.query_keywords, ["Рулонный материал ЭПП-4,0 (шт) 123 рубероид на битум мастика лист"], [["рулонный", "эпп-4", "рубероид", "битум", "мастика"]]),
        (T.tokens, ["Материал ТЁПЛЫЙ для ЭПП 4,0"], [["плый", "эпп", "4,0"]]),
        (T.marks, ["Техноэласт ЭПП и ХПП, эпп", "шэппа", None], [["хпп", "эпп"], [], []]),
        (T.deadline_date, ["05.03.2024 10:00", "2024-03-05", "-", "см. сайт", None], ["2024-03-05", "2024-03-05", None, None, None]),
        (T.registry_key, ["/x?regNumber=123", "/x?noticeInfoId=77", "№ 0123456789012345 ", "1234567890", None], ["123", "223-77", "0123456789012345", None, None]),
        (T.is_generic_query, ["труба", "гибкая труба длинная", "гибкая труба", "труба DN50 x", None], [True, False, True, False, True]),
        (T.repair_filename, ["Ð¢Ð\x97.docx", "a/b:c?.pdf", "..x..", None], ["ТЗ.docx", "a_b_c_.pdf", "x", ""]),
        (T.ext_from_ctype, ["application/pdf", "application/msword", "text/plain", None], [".pdf", ".doc", "", ""]),
        (T.strip_markdown, ["# Итог\n**да** _x_\n---\n\n\n\nк", None], ["Итог\nда x\n\nк", ""]),
        (T.senior_category, ["Кровля / Рулонная", "Кровля", None], ["Кровля", "Кровля", ""]),
        (T.catalog_price, ["1 250,50 р./м2 РОЗН", "100 р./шт 90 р./шт РОЗН", "нет", None], [250.5, 90.0, 0.0, 0.0]),
        (T.strip_artifacts, ["[FILE: тз] Кирпич | стр. 4 | шт\n--- СТРАНИЦА/ЛИСТ: 2\nещё"], ["Кирпич | | шт\n \nещё"]),
    ],
)
def test_golden(spark, function, given, wanted):
    got = values(spark, function, given)
    assert [str(g) if hasattr(g, "isoformat") else g for g in got] == wanted


def test_qty_unit_takes_the_first_number_with_a_unit(spark):
    got = values(spark, T.qty_unit, ["Кирпич 1 200 шт красный", "не менее 5 кг", "без числа", None])
    assert [(g["quantity"], g["unit"]) for g in got] == [("1200", "шт"), ("5", "кг"), (None, None), (None, None)]


def test_measure_keeps_signs(spark):
    assert values(spark, lambda c: T.measure(c, "flexibility"), ["Гибкость -25 °С", "при -15 °c", "нет"]) == [-25.0, -15.0, None]
    assert values(spark, lambda c: T.measure(c, "thickness"), ["толщина 4,2 мм", "5 мм"]) == [4.2, 5.0]


def test_urls(spark):
    given = ["http://www.a.ru/x/?utm_source=1&b=2#top", "/rel/", "", None]
    assert values(spark, lambda c: T.canonical_url(c, "a.ru", force=("city", "7")), given) == ["http://a.ru/x?b=2&city=7", "https://a.ru/rel?city=7", "", ""]
    assert values(spark, lambda c: T.allowed_url(c, "a.ru", ("city", "7")), ["http://a.ru/x?city=7", "http://a.ru/x?city=8", "http://b.ru/", "http://a.ru/x.PDF", "/y", None]) == [True, False, False, False, True, False]


def test_labelled_fields(spark):
    body = "Заказчик: ООО Ромашка Начальная цена 1 200,00 ₽ Окончание подачи заявок 05.03.2024"
    labels, stops = ["Заказчик"], ["Начальная цена", "Окончание подачи заявок"]
    assert values(spark, lambda c: T.labelled_field(c, labels, stops), [body]) == ["ООО Ромашка"]
    assert values(spark, lambda c: T.card_price(c, ["Начальная цена"], stops), [body]) == ["1 200,00"]
    assert values(spark, lambda c: T.card_deadline(c, ["Окончание подачи заявок"], stops), [body]) == ["05.03.2024"]


def test_signatures(spark):
    rows = [(b"%PDF-1.4" + b"x" * 200, "a.pdf"), (b"<html>" + b"x" * 200, "a.pdf"), (b"", "a.pdf"), (b"%PDF", "a.pdf"), (bytes.fromhex("D0CF11E0A1B11AE1") + b"x" * 200, "a.doc"), (b"PK\x03\x04" + b"x" * 200, "a.pdf"), (None, "x")]
    df = spark.createDataFrame(rows, "content binary, name string")
    assert [r[0] for r in df.select(T.audit_signature(F.col("content"), F.col("name"))).collect()] == ["ok", "html", "empty", "too_small", "ok", "mismatch", "empty"]


def test_json_status_and_compose(spark):
    assert values(spark, lambda c: T.parse_json_lenient(c, "k int")["k"], ['```json\n{"k": 3,}\n```', "нет", None]) == [3, None, None]
    assert values(spark, lambda c: T.step_status(c, True, ["a", "b"]), ["a", "b", "?"]) == ["b", "b", "a"]
    df = spark.createDataFrame([("1. Мембрана", ["толщина 2 мм", "цвет белый", "масса 3 кг"])], "n string, c array<string>")
    assert df.select(T.compose_query(F.col("n"), F.col("c"))).first()[0] == "Мембрана | толщина 2 мм; масса 3 кг"
