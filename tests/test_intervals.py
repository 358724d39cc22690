"""Interval sets against sets of whole numbers; rows of one id in rule operators."""

import random

from pyspark.sql import functions as F

from stylometra.operators import evaluation, intervals, rules
from stylometra.operators.rules import Rule


def test_sets_of_intervals(spark):
    rng = random.Random(12)
    some = lambda: [(a, a + rng.randint(-1, 9)) for a in (rng.randint(0, 40) for _ in range(rng.randint(0, 7)))]
    rows = [(k, some(), some()) for k in range(300)] + [(300, [], []), (301, [(0, 5)], [(5, 9)]), (302, [(0, 9)], [(2, 4), (3, 3)]), (303, None, [(1, 2)]), (304, [(1, 1)], [(1, 1)])]
    df = spark.createDataFrame(rows, f"k int, p {intervals.SET}, t {intervals.SET}")
    full = lambda x: {n for a, z in x or [] for n in range(a, z)}
    want = {k: (full(p), full(t)) for k, p, t in rows}
    for r in intervals.measured(df, "p", "t").collect():
        p, t = want[r["k"]]
        assert (r["union"], r["both"], r["only_left"], r["only_right"]) == (len(p | t), len(p & t), len(p - t), len(t - p))
    for keep, f in (("union", set.union), ("both", set.intersection), ("only_left", set.difference)):
        for r in intervals.combined(df, "p", "t", "out", keep).collect():
            got = [tuple(x) for x in r["out"]]
            assert full(got) == f(*want[r["k"]]) and all(a < z for a, z in got) and all(x[1] < y[0] for x, y in zip(got, got[1:])), (keep, rows[r["k"]], got)
    [m] = intervals.span_metrics(df, "p", "t").collect()
    both, p, t = (sum(map(len, x)) for x in zip(*((p & t, p, t) for p, t in want.values())))
    assert abs(m["micro_precision"] - both / p) < 1e-6 and abs(m["micro_recall"] - both / t) < 1e-6 and m["n"] == len(rows)
    rates = [len(p & t) / len(p) if p else float(not t) for p, t in want.values()]
    assert abs(m["macro_precision"] - sum(rates) / len(rates)) < 1e-6


def test_rules_on_rows_of_one_id(spark):
    """Lights, sections and bags are those of each row; null texts and ids stay."""
    df = spark.createDataFrame([(1, "a x\n# b\n\n\nc"), (1, "y y"), (None, "x"), (2, None), (3, "")], "doc_id long, text string")
    some = [Rule("x", "red", "P0", "x"), Rule("y", "soft", "P2", "y")]
    assert sorted(map(str, map(tuple, rules.lights(df, some, ["red"], ["soft"]).collect()))) == sorted(map(str, [(1, "red", 1), (1, "yellow", 2), (None, "red", 1), (2, "green", 0), (3, "green", 0)]))
    assert sorted(map(str, map(tuple, rules.sections(df).collect()))) == sorted(map(str, [(1, "prose", 0, 1, 3), (1, "heading", 1, 1, 3), (1, "prose", 4, 1, 1), (1, "prose", 0, 1, 3), (None, "prose", 0, 1, 1)]))
    pairs = spark.createDataFrame([(1, ["a", "a"], ["a"]), (1, ["a"], ["b"]), (None, None, ["c"]), (2, ["z"], ["z"]), (3, None, None)], "doc_id long, b array<string>, a array<string>")
    got = evaluation.bag_changes(pairs, F.col("b"), F.col("a"), "part", "doc_id").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(1, "a", "missing", 1), (1, "a", "missing", 1), (1, "b", "added", 1), (None, "c", "added", 1)]))


def test_ranges_are_those_of_placed(spark):
    from stylometra.operators.rules import placed, ranges

    texts = [("abcdefgh ij\nabcdefghi",), ("",), (None,), ("x",), ("abcdefgh",), ("\U0001f600 сорокапяти ab12 cd",), ("a1 bc " * 4000,)]
    df = spark.createDataFrame(texts, "text string")
    for pattern in (r"\p{L}{7,}", "[0-9a-f]+ [a-z]+"):
        for r in df.select(placed(F.col("text"), pattern).alias("p"), ranges(F.col("text"), pattern).alias("r")).collect():
            want = None if r["p"] is None else [(x["start"], x["start"] + len(x["text"])) for x in r["p"]]
            assert want == (None if r["r"] is None else [(x["a"], x["z"]) for x in r["r"]])
