"""The checks of an edit on cases of our own: what is a change, and what only a paraphrase or a move."""

import pytest
from pyspark.sql import functions as F

from stylometra.operators import edits as E

PAIRS = "id long, before string, after string"


def found(spark, check, pairs):
    """The last column of each pair's row, in the order of the pairs; every id is the same one."""
    rows = spark.createDataFrame([(7, *p) for p in pairs], PAIRS).withColumn("n", F.monotonically_increasing_id()).orderBy("n")
    return [r[-1] for r in check(rows.coalesce(1)).orderBy("n").collect()]


def test_swapped_numbers(spark):
    pairs = [
        ("Лена сшила 16 юбок, Рома 7 курток.", "Лена сшила 7 юбок, Рома 16 курток."),
        ("В Ухте сдали 210 домов, в Канске 330 школ, в Ейске 450 дорог.", "В Ухте сдали 330 домов, в Канске 450 школ, в Ейске 210 дорог."),
        ("Лена сшила 16 юбок, Рома 7 курток.", "Рома сшил 7 курток, Лена 16 юбок."),  # parts moved with their numbers
        ("Утром ушло 16 писем. Ночью пришло 7 посылок.", "Ночью пришло 7 посылок. Утром ушло 16 писем."),
        ("- Лена: 16 юбок\n- Рома: 7 курток", "- Рома: 7 курток\n- Лена: 16 юбок"),
        ("1. Лена сшила 16 юбок.\n2. Рома сшил 7 курток.", "1. Рома сшил 7 курток.\n2. Лена сшила 16 юбок."),
        ("Доход лавки 90 тысяч, траты 35 тысяч.", "При тратах 35 тысяч лавка дала 90 тысяч дохода."),  # two numbers in one part
        ("Лена сшила 30 юбок, Рома тоже 30.", "Рома сшил 30 юбок, Лена тоже 30."),  # repeated
        ("Лена сшила 16 юбок, Рома 7 курток.", "За месяц Лена закончила 16 изделий, Рома сдал 7 курток."),  # one paraphrased
        ("Лена сшила 1 600 юбок и Рома 2,5 куртки.", "Лена сшила 2,5 юбки и Рома 1 600 курток."),
        (None, "Лена сшила 16 юбок."),
        ("", None),
    ]
    got = [[(s["numbers"], s["was"], s["now"]) for s in x] for x in found(spark, E.number_swaps, [*pairs, pairs[0]])]
    assert got[0] == got[-1] == [(["16", "7"], "Лена сшила 16 юбок", "Рома 16 курток")]
    assert got[1] == [(["210", "330", "450"], "В Ухте сдали 210 домов", "в Ейске 210 дорог")]
    assert got[2:9] == [[]] * 7 and got[10:12] == [[]] * 2
    assert got[9] == [(["1 600", "2,5"], "Лена сшила 1 600 юбок", "Рома 1 600 курток")]


def test_swaps_of_many_numbers(spark):
    words = [f"{a}{b}{c}" for a in "бвгдж" for b in "аеиоу" for c in "клмнп"]
    parts = [f"{w}т{w} {1000 + k}" for k, w in enumerate(words)]
    after = parts.copy()
    after[3], after[90] = parts[3].replace("1003", "1090"), parts[90].replace("1090", "1003")
    [got] = found(spark, E.number_swaps, [("; ".join(parts), "; ".join(reversed(after)))])
    assert [s["numbers"] for s in got] == [["1003", "1090"]]


def test_negation_flips(spark):
    pairs = [
        ("Мост не построен. Рома позвонил.", "Рома не позвонил. Мост построен."),  # both sentences moved
        ("Мост не построен.", "Строить мост так и не начали."),
        ("Мост не построен.", "Моста нет."),
        ("Это не только мост.", "Это только мост."),
        ("Не прошёл ни поезд, ни автобус.", "Не прошёл ни автобус, ни поезд."),
        (None, "Не было."),
    ]
    got = [sorted(tuple(f) for f in x) for x in found(spark, E.negation_flips, pairs)]
    assert got == [[("gained", "не", "позвонил"), ("lost", "не", "построен")], [], [], [], [], []]


def test_roles(spark):
    pairs = [
        ("Утром Лена отдала ключ Роману.", "Утром Лене отдал ключ Роман."),
        ("Утром пришла Лена. Она живёт в доме.", "Утром не было Лены. Она живёт в доме."),  # one name only
        ("По мнению Котова и Лисина, дом стар.", "Наутро Котов и Лисин сказали, что дом стар."),  # one list, one role
        ("По мнению Котова, Лисина и Волкова, дом стар у Лены.", "Наутро Котов, Лисин и Волков сказали, что дом стар, вместе с Леной."),
        ("Дом стар.", None),
    ]
    got = [sorted(map(tuple, x)) for x in found(spark, E.role_changes, pairs)]
    assert got[0] == [("Лена", "Лене"), ("Роману", "Роман")] and got[1] == got[2] == got[4] == []
    assert got[3] == sorted([("Котова", "Котов"), ("Лисина", "Лисин"), ("Волкова", "Волков"), ("Лены", "Леной")])


def test_units(spark):
    pairs = [("Вес 5 кг, рост 12 метров, 3 дня, 40 %.", "Вес 5 килограммов, рост 12 см, 3 дней, 40 процентов."), ("12 метров или 12 см", "12 см"), ("7 слонов", "7 кг"), (None, None)]
    assert [[tuple(u) for u in x] for x in found(spark, E.changed_units, pairs)] == [[("12", "метров", "см")], [], [], []]


@pytest.mark.parametrize("check", [E.number_swaps, E.negation_flips, E.role_changes, E.changed_units])
def test_rows_stay_and_nothing_is_shuffled(spark, check):
    rows = spark.createDataFrame([(1, "a 1", "b 2"), (1, "a 1", "b 2"), (None, None, None)], PAIRS).repartition(2)
    got = check(rows)
    assert got.count() == 3 and check(rows.limit(0)).count() == 0
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") == rows._jdf.queryExecution().executedPlan().toString().count("Exchange")
