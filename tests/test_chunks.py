"""Sentences, overlapping chunks, coverage and shares of chunks against plain computations."""

import random
import re

import pytest
from pyspark.sql import functions as F

from stylometra.functions import sentences as N
from stylometra.operators import chunks as C

SAID = {
    "В 1999 г. Иванов И. И. уехал. Потом вернулся.": ["В 1999 г. Иванов И. И. уехал.", "Потом вернулся."],
    "И т. д. Конец... Да? «Нет!» Всё": ["И т. д. Конец...", "Да?", "«Нет!»", "Всё"],
    "Строка\n- пункт\n2) другой\n\nабзац": ["Строка", "- пункт", "2) другой", "абзац"],
    "Это рост. и дальше. 25 кг": ["Это рост. и дальше.", "25 кг"],
    "Страна США. Потом. … !? ": ["Страна США. Потом. … !?"],
    "Слово. Другое": ["Слово.", "Другое"],
    "": [], " \n ": [], "...": [],
}


def test_sentences(spark):
    df = spark.createDataFrame([*enumerate(SAID), (99, None)], "k int, text string").select("k", N.sentences(F.col("text")).alias("s"))
    got = {r["k"]: r["s"] for r in df.collect()}
    assert [got[k] for k in range(len(SAID))] == [*SAID.values()] and got[99] is None


def by_steps(costs, width, keep):
    """The windows, unit by unit."""
    out, i = [], 0
    while i < len(costs):
        j = i + 1
        while j < len(costs) and sum(costs[i : j + 1]) <= width:
            j += 1
        if j == len(costs):
            while i > (out[-1][0] + 1 if out else 0) and sum(costs[i - 1 : j]) <= width:
                i -= 1
            return [*out, (i, j)]
        out.append((i, j))
        k = j
        while k - 1 > i and sum(costs[k - 1 : j]) <= keep:
            k -= 1
        i = max(k, i + 1)
    return out


def test_windows():
    rng = random.Random(3)
    for _ in range(3000):
        costs = [rng.choice([0, 1, 2, 5, 9, 30]) for _ in range(rng.randint(0, 25))]
        width = rng.randint(1, 30)
        keep = rng.randint(0, width)
        assert C.windows(costs, width, keep) == by_steps(costs, width, keep), (costs, width, keep)


def test_chunks_cover_texts_and_halve_long_sentences(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["слово", "и/или", "Word", "конец.", "Да!\n\n", "—"]) for _ in range(rng.randint(0, 400))) for _ in range(30)]
    texts += ["a" * 5000, "x " * 3000, "Раз." + " " * 200_000 + "Два.", "", None]
    df = spark.createDataFrame([(k % 4, t, k) for k, t in enumerate(texts)], "doc_id long, text string, k int")
    got = {}
    for r in C.chunks(df, 40).collect():
        got.setdefault(r["k"], []).append(r)
    words = lambda t: re.findall(r"[^\W_]+(?:[-’'][^\W_]+)*", t)
    for k, text in enumerate(texts):
        found = sorted(got.get(k, []), key=lambda r: r["chunk"])
        assert bool(found) == bool(words(text or ""))
        seen = set()
        for r in found:
            assert r["text"] == text[r["start"] : r["end"]] and r["n_words"] == len(words(r["text"])) <= 40
            assert r["word_start"] == len(words(text[: r["start"]])) and r["text_words"] == len(words(text))
            assert (r["line"], r["end_line"]) == (text.count("\n", 0, r["start"]) + 1, text.count("\n", 0, r["end"]) + 1)
            seen |= {*range(r["word_start"], r["word_start"] + r["n_words"])}
        assert seen == {*range(len(words(text or "")))}
        assert all(0 < b["start"] - a["start"] and b["start"] <= len(text) and b["end"] > a["end"] for a, b in zip(found, found[1:]))
    by_signs = C.chunks(df.where("k = 31"), 100, counts=lambda strings: [len(s) for s in strings]).collect()
    assert max(len(r["text"]) for r in by_signs) <= 100 and len(by_signs) > 60
    with pytest.raises(ValueError):
        C.chunks(df.withColumn("line", F.lit(1)), 40)


def test_coverage(spark):
    texts = ["one two three\nfour five", "one two", "", "a-b c/d e", "x" * 30, "  one two  ", None]
    df = spark.createDataFrame([*enumerate(texts)], "k int, text string")
    show = lambda words, chars: [tuple(r)[2:] for r in C.coverage(df, words, chars).orderBy("k").collect()]
    assert show(3, 20) == [(13, 23, 3, 5, 1, 2), (7, 7, 2, 2, 1, 1), (0, 0, 0, 0, 1, 1), (7, 9, 3, 4, 1, 1), (0, 30, 0, 1, 1, 1), (11, 11, 2, 2, 1, 1), (None,) * 6]
    assert show(4, 99)[0] == (18, 23, 4, 5, 2, 2) and show(9, 99)[0][0] == 23


def test_shares_of_chunks(spark):
    """Words that chunks have in common count once; words only in chunks nobody rated don't count; lines are joined."""
    rows = [
        (1, 1, 3, 10, 0, 30, 0.9), (1, 3, 4, 10, 5, 30, 0.8), (1, 6, 7, 10, 12, 30, 0.1), (1, 8, 9, 10, 20, 30, None),
        (2, 1, 1, 5, 0, 5, None), (3, 1, 2, 4, 0, 10, 0.5), (3, 3, 5, 4, 6, 10, 0.6),
    ]
    df = spark.createDataFrame(rows, "doc_id long, line long, end_line long, n_words long, word_start long, text_words long, probability double")
    got = {r["doc_id"]: (r["n_chunks"], r["n_skipped"], r["n_above"], r["share"], [tuple(x) for x in r["lines"]]) for r in C.scanned(df, ["doc_id"], 0.5).collect()}
    assert got == {1: (4, 1, 2, round(15 / 22, 4), [(1, 4)]), 2: (1, 1, 0, 0.0, []), 3: (2, 0, 2, 0.8, [(1, 5)])}


def test_signals_and_agreement(spark):
    cases = [(0.9, 0.8, True), (0.9, 0.1, True), (0.1, 0.2, True), (0.9, 0.9, False), (0.6, 0.65, True)]
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, p double, q double, r boolean")
    s = F.array(*(C.signal(F.col(x), 0.5, F.col("r")) for x in "pq"))
    rows = df.select("k", s.alias("s"), C.agreement(s).alias("a")).orderBy("k").collect()
    assert [tuple(r["a"]) for r in rows] == [(2, True), (1, False), (0, True), (0, None), (2, True)]
    assert [[x["near"] for x in r["s"]] for r in rows][3:] == [[False, False], [True, False]]
    assert rows[3]["s"][0]["probability"] is None
