"""The one-pass matcher against a regex for each entry, its phrase language, proximity, densities and exemptions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from stylometra.operators import dictionary as D
from stylometra.operators.dictionary import Entry, Matcher, judged, phrase, variants


def texts(found):
    return [(e.text, start, hit) for e, start, hit in found]


def by_regex(text, entry):
    """The pattern of an entry with Python's classes, one search after the other."""
    pattern = re.compile(r"(?<!\w)(?:" + phrase(entry).replace(r"\p{L}", r"[^\W\d_]") + r")(?!\w)", re.IGNORECASE)
    return [(m.start(), m.end()) for m in pattern.finditer(text)]


def test_one_walk_is_like_a_regex_for_each_entry():
    rng = random.Random(11)
    words = ["да", "дар", "дары", "за", "зайка", "не", "нет", "кое", "что"]
    make = lambda: rng.choice([rng.choice(words), rng.choice(words)[:2] + "*", f"({rng.choice(words)}|{rng.choice(words)})", "*" + rng.choice("арйт"), "кое-что"])
    entries = [*{" ".join(make() for _ in range(rng.randint(1, 3))) for _ in range(120)}]
    matcher = Matcher(entries)
    for _ in range(150):
        text = "".join(rng.choice([*words, "Кое-Что", "да1", "x_y"]) + rng.choice([" ", " ", " ", "  ", "\n", ", ", ". ", "-", " "]) for _ in range(rng.randint(0, 30)))
        got = {}
        for k, a, z, _, _ in matcher.find(text)[0]:
            got.setdefault(entries[k], []).append((a, z))
        assert got == {e: x for e in entries if (x := by_regex(text, e))}


def test_phrase_language():
    assert sorted(map(" ".join, variants("в (самом)? (конце|начале) дня*"))) == sorted(f"в {x}{y} дня*" for x in ("", "самом ") for y in ("конце", "начале"))
    for text, hit in (("в конце дня", True), ("В самом начале дням", True), ("в самомконце дня", False), ("в  самом\nконце дня", True), ("в дня", False), ("и в конце дня5", False)):
        assert bool(Matcher(["в (самом)? (конце|начале) дня*"]).find(text)[0]) == hit == bool(re.search(r"(?<!\w)" + phrase("в (самом)? (конце|начале) дня*").replace(r"\p{L}", r"[^\W\d_]") + r"(?!\w)", text, re.I)), text
    assert Matcher(["сло*"]).find("слово сло5 сло_ сло")[0] == [(0, 0, 5, 0, 0), (0, 16, 19, 3, 3)]
    assert Matcher([]).find("любой текст") == ([], 2) and Matcher(["слово"]).find("") == ([], 0)
    assert [h[:3] for h in Matcher(["да да"]).find("да да да да")[0]] == [(0, 0, 5), (0, 6, 11)]


def test_proximity():
    far = "раз два три четыре "
    entries = [Entry("g", "сервис", near=("выдача запросов",), within=2), Entry("g", "поток", unless=("вод*", "река"), within=3)]
    found = judged(entries)
    assert texts(found("сервис и выдача запросов", 4, "general")) == [("сервис", 0, "сервис")]
    assert texts(found(f"сервис {far} выдача запросов", 7, "general")) == []
    assert texts(found(f"выдача запросов {far} сервис", 7, "general")) == []
    assert texts(found("выдача запросов, сервис", 3, "general")) == [("сервис", 17, "сервис")]
    assert texts(found("поток воды", 2, "general")) == texts(found("река и поток", 3, "general")) == []
    assert texts(found(f"река {far} поток {far} вода", 11, "general")) == [("поток", 25, "поток")]


def test_density_and_exemption():
    found = judged([Entry("g", "мол*", density={"": 100, "chat": 300})], ("мол и пыль",))
    assert texts(found("молва раз два три четыре пять шесть семь восемь девять", 10, "general")) == [("мол*", 0, "молва")]
    assert found("молва раз два три четыре пять шесть семь восемь девять", 10, "chat") == []
    assert texts(found("мол и пыль, молва", 4, "general")) == [("мол*", 12, "молва")]


@pytest.mark.parametrize("mode, want", [("general", {"a", "b", "c"}), ("chat", {"a"}), ("social", {"a", "b"})])
def test_modes_and_rows(spark, mode, want):
    entries = [Entry("a", "раз", "P0"), Entry("b", "два", "P1"), Entry("c", "три", "P2", ("social",))]
    df = spark.createDataFrame([(1, "Раз, два, три"), (1, "раз"), (2, None), (None, "два"), (3, "")], "doc_id long, text string")
    got = [tuple(r) for r in D.dictionary_hits(df, entries, mode, F.lit(10)).collect()]
    assert {g[1] for g in got} == want and got.count((1, "a", "раз", 0, "раз")) == 1 and (1, "a", "раз", 0, "Раз") in got
    assert D.dictionary_hits(df.limit(0), entries, mode, F.lit(10)).collect() == []


def test_long_texts_and_many_entries():
    entries = [Entry("g", f"{a}{b}* {b}{a}") for a in "абвгдежзик" for b in "лмнопрстуфхцчшщэюя"]
    text = "абв лмн " * 50_000 + "алкаш ла"
    assert texts(judged(entries)(text, 100_002, "general")) == [("ал* ла", 400_000, "алкаш ла")]
