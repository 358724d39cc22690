"""Preparation: places in the source, look-alike letters, service parts, and names that an edit brought in."""

import pytest
from pyspark.sql import functions as F

from stylometra.operators import edits as E
from stylometra.operators import preparation as P

BIBLIOGRAPHY = "Проза о методах.\n\n## Список литературы\n\n**1.** Иванов И. И. Утомление // Транспорт. — 2023. — № 4.\n\nСнова проза."
AUTHORS = "Проза.\n\nЕщё проза.\n\nОб авторах\n\nИванов Иван, доцент.\n\n**Keywords:** sleep"
ABSTRACT = "Проза.\n\nA title\n\nIvanov I.\n\nAbstract\n\nWe compare methods.\nThey differ.\n\nПроза."
ENTRIES = "1. Орлов Б. Речь. – М. : Мир, 2001. – 100 с.\n\n" * 3


def parts(spark, *texts):
    rows = spark.createDataFrame([(1, t) for t in texts], "doc_id int, text string")
    return [[(p.kind, r.text[p.start : p.end]) for p in r.service] for r in P.service_parts(rows).collect()]


def test_parts(spark):
    found = parts(spark, BIBLIOGRAPHY, AUTHORS, ABSTRACT, ENTRIES + "Проза.", ENTRIES.replace("\n\n", "\n", 1)[:120], "", None)
    assert found[0] == [("bibliography", BIBLIOGRAPHY[BIBLIOGRAPHY.index("\n\n**1") + 1 : BIBLIOGRAPHY.index("\n\nСнова")])]
    assert found[1] == [("authors", AUTHORS[AUTHORS.index("Об авт") :])]
    assert found[2] == [("abstract", ABSTRACT[ABSTRACT.index("A title") : ABSTRACT.index("\n\nПроза.", 10)])]
    assert [k for k, _ in found[3]] == ["entries"] and found[3][0][1].count("2001") == 3
    assert found[4:] == [[], [], []]


def test_no_parts(spark):
    """A heading without entries, code, a menu entry at the top, and one label among prose are none."""
    found = parts(spark, "## Литература\n\nПроза о книгах и людях.", "```\n1. А. Б. // В. — 2001.\n## Литература\n1. А. Б. // В. — 2001.\n```", "Об авторе\n\nПроза.\n\nПроза.\n\nПроза.", "Abstract\n\nПроза.")
    assert found == [[], [], [], []]


def test_long_bibliography(spark):
    """Thousands of entries and of short parts are read without recursion."""
    text = "## Литература\n\n" + ENTRIES * 3000
    found = parts(spark, text, "УДК 1\n\nПроза.\n\n" * 300)
    assert len(found[0]) == 1 and found[0][0][1].count("2001") == 9000 and len(found[1]) == 300


@pytest.mark.parametrize(("word", "plain"), [("cмысл", "смысл"), ("тeкст", "текст"), ("Pythonе", "Pythonе"), ("FхG", "FхG"), ("PHPшник", "PHPшник"), ("fоr", "for"), ("HTTP-запрос", "HTTP-запрос"), ("вPython", "вPython")])
def test_letters(spark, word, plain):
    assert spark.range(1).select(P.repaired(F.lit(word))).first()[0] == plain


def test_places(spark):
    """Every sign of the prepared text leads to its own in the source; rows of one id and null texts stay."""
    texts = ["а\u200bб\u00ad\u2066в ёж\u2011", "\ufeffслово", "слово\u200b", "\u200b", "", None]
    rows = P.prepared(spark.createDataFrame([(1, t) for t in texts], "doc_id int, text string"))
    places = F.transform(F.sequence(F.lit(0), F.length("plain")), lambda i: P.to_source(F.col("moved"), i.cast("long")))
    for text, row in zip(texts, rows.withColumn("places", F.when(F.length("plain") > 0, places)).collect(), strict=True):
        kept = [i for i, c in enumerate(text or "") if c not in "\u200b\u00ad\u2066\ufeff"]
        assert len(row.plain) == len(row.prose) == len(kept)
        assert kept == ((row.places or [])[:-1])


def test_prose(spark):
    text = "Слова `код` и «цитата».\n> чужое\n\n" + BIBLIOGRAPHY
    row = P.prepared(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
    assert "код" not in row.prose and "цитата" not in row.prose and "чужое" not in row.prose and "Утомление" not in row.prose
    assert "Снова проза." in row.prose and row.prose.count("\n") == text.count("\n")


@pytest.mark.parametrize(
    ("before", "after", "names"),
    [
        ("Робот едет по складу.", "Робот марки Вектор едет по складу.", ["Вектор"]),
        ("Робот едет по складу.", "По складу едет GPS.", ["GPS"]),
        ("Самара купила станки.", "Станки купили в Самаре.", []),
        ("Выбор сделал Орел.", "Выбор был за Орлом.", []),
        ("Правила дорожного движения строги.", "ПДД строги.", []),
        ("Прошу ответить.", "Прошу Вас ответить.", []),
        ("Вывод: станок цел.", "Вывод: Станок цел. Станок стоит.", []),
        ("Пишет ИИ.", "Пишет AI.", []),
        ("", "Так сказал Петров, и Петров прав.", ["Петров"]),
        (None, None, []),
    ],
)
def test_names(spark, before, after, names):
    rows = spark.createDataFrame([(1, before, after)] * 2, "doc_id int, before string, after string")
    assert [r.names for r in E.new_names(rows).collect()] == [names] * 2
