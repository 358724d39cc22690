"""Fragments of prose, moving type-token ratios and the explanation of a score, against plain computations."""

import math
import random

import pytest
from pyspark.sql import functions as F

from stylometra.operators import fragments as G
from stylometra.operators import style

W = lambda n, x="слово": " ".join([x] * n) + "."
ROW = "doc_id long, n_chars long, " + ", ".join(f"{x} double" for x in G.NAMES)


def spans(text):
    return [(n, "".join(t.split())) for _, _, n, t in G.packed(text)]


def test_packing():
    a, b, c, tail = W(30), W(15), W(40), W(10)
    join = lambda *x: "".join("".join(x).split())
    assert spans("\n\n".join([a, b, c, tail])) == [(45, join(a, b)), (50, join(c, tail))]  # a short rest joins the last fragment
    assert spans("\n\n".join([a, "# Title", b, c])) == [(30, join(a)), (55, join(b, c))]  # a heading closes half a fragment
    assert spans("\n\n".join([b, "# Title", c])) == [(55, join(b, c))]  # but not less
    assert spans("\n\n".join([a, "> quoted words", "| a | b |", "- point one", b])) == [(47, join(a, "- point one", b))]
    assert spans(tail) == [(10, join(tail))] and spans("") == [] and spans("# Only\n\n> this") == [] and spans("\n \n\n") == []


def test_fragments_cover_all_prose_and_name_places(spark):
    rng = random.Random(4)
    texts = []
    for _ in range(40):
        blocks = [rng.choice(["", "", "# ", "- ", "> ", "| "]) + W(rng.randint(1, 50)) for _ in range(rng.randint(0, 12))]
        texts.append(rng.choice(["\n\n", "\n \n\n"]).join(blocks))
    rows = [(k % 3, t, "x") for k, t in enumerate(texts)] + [(None, None, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, held string").withColumn("row", F.monotonically_increasing_id())
    known = {r["row"]: r["text"] or "" for r in df.collect()}
    got = {}
    for r in G.fragments(df).collect():
        assert r["held"] == "x"
        got.setdefault(r["row"], []).append(r)
    for row, text in known.items():
        found = sorted(got.get(row, []), key=lambda r: r["fragment"])
        assert [r["fragment"] for r in found] == [*range(len(found))]
        assert sum(r["n_words"] for r in found) == sum(len(b.split()) - (b[0] == "-") for b in text.replace(" \n", "").split("\n\n") if b.strip() and b.lstrip("\n")[0] not in "#>|")
        for r in found:
            assert (r["line"], r["end_line"]) == (text[: r["start"]].count("\n") + 1, text[: r["end"]].count("\n") + 1)
            assert text[r["start"] :].startswith(r["text"].split("\n\n")[0]) and text[: r["end"]].endswith(r["text"].split("\n\n")[-1])
    with pytest.raises(ValueError):
        G.fragments(df.withColumn("start", F.lit(1)))


def test_moving_ratio(spark):
    rng = random.Random(6)
    lists = [[rng.choice("abcdefgh") for _ in range(n)] for n in (0, 1, 49, 50, 51, 120, 400)] + [["a"] * 70]
    want = [None if len(w) < 50 else math.floor(sum(len(set(w[k : k + 50])) for k in range(len(w) - 49)) / (50 * (len(w) - 49)) * 1e6 + 0.5) / 1e6 for w in lists]
    df = spark.createDataFrame([(k, w) for k, w in enumerate(lists)], "k int, w array<string>")
    assert [r["m"] for r in style.with_moving_ratio(df, "w", "m").orderBy("k").collect()] == want


def test_explanation(spark):
    rng = random.Random(2)
    rows = [(k, 1, *(round(rng.random() * rng.choice([0, 1, 3]), 6) for _ in G.NAMES)) for k in range(200)] + [(200, 1, *[0.0] * 7), (201, 1, *[0.01] * 7)]
    green = math.log(0.4 / 0.6)
    reached = 0
    for r in G.explained(spark.createDataFrame(rows, ROW), "doc_id").collect():
        value = dict(zip(G.NAMES, rows[r["doc_id"]][2:]))
        weight = dict(zip(G.NAMES, G.WEIGHTS))
        assert abs(G.BIAS + sum(s["contribution"] for s in r["steps"]) - r["logit"]) < 1e-5 and abs(r["logit"] - green - r["excess"]) < 1e-5
        assert [s["contribution"] for s in r["steps"]] == sorted((s["contribution"] for s in r["steps"]), reverse=True)
        for s in r["steps"]:
            alone = r["logit"] - weight[s["feature"]] * (value[s["feature"]] - s["goal"])
            floor = G.FLOORS.get(s["feature"], 0.0)
            assert s["enough"] and (r["excess"] <= 0 or abs(alone - green) < 0.01) or not s["enough"] and s["goal"] == floor and alone > green - 0.01
        plan = {s["feature"]: s["plan"] for s in r["steps"] if s["plan"] is not None}
        if r["excess"] <= 0:
            assert not plan and r["reachable"]
        elif plan:
            after = r["logit"] - sum(weight[x] * (value[x] - v) for x, v in plan.items())
            reached += r["reachable"]
            assert abs(after - green) < 0.02 if r["reachable"] else after > green
    assert reached > 20
