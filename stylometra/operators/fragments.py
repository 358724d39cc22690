"""Fragments of prose: blocks packed up to a least number of words, and the explanation of a fragment's score."""

from __future__ import annotations

import math
import re
from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import style
from .rows import from_texts, once

# Words of a fragment; a fragment of fewer than half of them isn't closed by a heading and joins the one before.
LEAST_WORDS = 40
BLOCK = r"\n(?:[ \t]*\n)+"
# Kinds of blocks by their first signs; the others are prose. Fragments are made of prose and lists.
KINDS = {"heading": r"^#{1,6} ", "list": r"^\s*(?:[-*+]|[0-9]+[.)]) ", "quote": r"^>", "table": r"^\|"}
SCHEMA = "fragment int, start long, end long, line long, end_line long, n_words long, text string"
# The default model of fragments, its threshold, its features' names, the least logit worth a step of a plan.
BIAS, WEIGHTS, LIMIT = -4.4, (1.1, 2.6, 1.4, 0.35, 1.2, 1.3, 1.6), 0.5
NAMES = ("density", "uniformity", "typical_length", "clerical", "punctuation", "openers", "vocabulary")
FLOORS = {"typical_length": 0.1}
LEAST_STEP, GREEN_MARGIN = 0.05, 0.1


def packed(text: str) -> list[tuple]:
    """(start, end, words, text) of the fragments of a text: one pass over its blocks."""
    word = re.compile(r"[^\W_]+(?:[-’'][^\W_]+)*")
    kinds = [(name, re.compile(p)) for name, p in KINDS.items()]
    done: list[tuple] = []
    held: list[tuple] = []
    borders = [0, *(x for m in re.finditer(BLOCK, text) for x in m.span()), len(text)]

    def close() -> None:
        done.append((held[0][0], held[-1][1], sum(h[2] for h in held), "\n\n".join(h[3] for h in held)))
        held.clear()

    for a, z in zip(borders[::2], borders[1::2]):
        block = text[a:z]
        if not block.strip():
            continue
        kind = next((name for name, p in kinds if p.search(block)), "prose")
        n = sum(h[2] for h in held)
        if kind in ("prose", "list"):
            held.append((a, z, len(word.findall(block)), block))
            if n + held[-1][2] >= LEAST_WORDS:
                close()
        elif kind == "heading" and held and n * 2 >= LEAST_WORDS:
            close()
    if held and done and sum(h[2] for h in held) * 2 < LEAST_WORDS:
        start, _, n, whole = done.pop()
        done.append((start, held[-1][1], n + sum(h[2] for h in held), "\n\n".join([whole, *(h[3] for h in held)])))
    elif held:
        close()
    return done


def fragments(df: DataFrame, text_col: str = "text") -> DataFrame:
    """One row per fragment: the other columns of df, fragment (from 0), start, end, line, end_line, n_words and text.

    Offsets are those of the source in code points; blocks of other kinds between a fragment's blocks aren't part of its
    text. Texts without prose, empty and null ones give no rows. A task holds one batch of texts; nothing is shuffled.
    """

    def parts(text: str) -> list[tuple]:
        breaks = [m.start() for m in re.finditer("\n", text)]
        line = lambda place: bisect_left(breaks, place) + 1
        return [(n, a, z, line(a), line(z), words, whole) for n, (a, z, words, whole) in enumerate(packed(text))]

    return from_texts(df, text_col, SCHEMA, parts)


def measured(rows: DataFrame, rare: str, signals: Column, clerical: Column) -> DataFrame:
    """rows (one fragment each) with its measures: w (words in lower case), z (lengths of sentences of two words and more),
    o (first words of sentences), rare, signals, clerical, n_chars, mattr, n. Words and sentences are found once."""
    text = F.col("text")
    parts = F.split(F.regexp_replace(text, T.ENDS, f"$1{T.BORDER}"), T.BORDER)
    rows = once(rows, w=F.transform(T.words(text), F.lower), _s=F.filter(F.transform(parts, T.words), lambda s: F.size(s) > 0), rare=F.regexp_count(text, F.lit(rare)).cast("long"), signals=signals, clerical=clerical, n_chars=F.length(T.collapsed(text)).cast("long"))
    rows = once(rows, z=F.filter(F.transform("_s", lambda s: F.size(s).cast("long")), lambda n: n >= 2), o=F.transform("_s", lambda s: F.lower(F.get(s, F.lit(0)))))
    return style.with_moving_ratio(rows, "w", "mattr").withColumn("n", F.size("z")).drop("_s")


def features(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, n_chars and the seven features of measured fragments, rounded to six digits."""
    n, words, sentences = F.col("n"), F.greatest(F.size("w"), F.lit(1)), F.size("o")
    total = F.aggregate("z", F.lit(0).cast("long"), lambda s, x: s + x)
    squares = F.aggregate("z", F.lit(0).cast("long"), lambda s, x: s + x * x)
    rows = once(rows, _t=total, _q=squares)
    total, squares = F.col("_t"), F.col("_q")
    cv = F.sqrt(F.greatest(F.lit(0.0), (squares - total * total / n) / (n - 1))) / (total / n)
    # The scales of the features.
    values = (
        F.least(F.lit(4.0), F.col("signals") * 2 * 100 / words / 3),
        F.when(n >= 3, F.greatest(F.lit(0.0), 1 - cv / 0.6)).otherwise(0.3),
        F.when(n > 0, F.exp(-F.pow((total / n - 19) / 7, F.lit(2)))).otherwise(0.0),
        F.least(F.lit(3.0), F.col("clerical") * 100 / words / 2),
        F.when(n >= 3, F.greatest(F.lit(0.0), 1 - F.col("rare") / n / 0.5)).otherwise(0.3),
        F.when(sentences >= 3, 1 - F.size(F.array_distinct("o")) / sentences).otherwise(0.0),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), (0.85 - F.coalesce("mattr", F.lit(0.8))) / 0.2)),
    )
    return rows.select(*keys, "n_chars", *(T.rounded(v, 6).alias(name) for v, name in zip(values, NAMES)))


def explained(rows: DataFrame, *keys: str, bias: float = BIAS, weights: tuple = WEIGHTS, threshold: float = LIMIT) -> DataFrame:
    """keys, logit, excess (over the logit of the green zone), reachable, and `steps`: what to change in a fragment.

    A step is a feature that raises the score: its value and contribution; goal, the value at which this feature alone
    would bring the fragment into the green zone, or its floor where that isn't enough; enough; and plan, its value in the
    joint plan, null if it has no part in it. The plan takes the same share of what each feature can give. Features that
    give less than LEAST_STEP take part only if the others don't suffice. Largest contribution first.
    """
    green = threshold - GREEN_MARGIN
    excess = F.col("logit") - math.log(green / (1 - green))
    logit = sum((w * F.col(x) for w, x in zip(weights, NAMES)), F.lit(bias))
    rows = once(rows, logit=T.rounded(logit, 6))
    rows = once(rows, excess=T.rounded(excess, 6))
    each = F.array(*(F.struct((-T.rounded(w * F.col(x), 6)).alias("c"), F.lit(k).alias("k"), F.lit(x).alias("feature"), F.col(x).alias("value"), F.lit(float(w)).alias("weight"), F.lit(FLOORS.get(x, 0.0)).alias("floor")) for k, (w, x) in enumerate(zip(weights, NAMES)) if w > 0))
    rows = once(rows, _p=F.array_sort(F.filter(each, lambda x: x["value"] > 0)))
    give = lambda x: F.greatest(F.lit(0.0), (x["value"] - x["floor"]) * x["weight"])
    summed = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + give(x))
    rows = once(rows, _large=summed(F.filter("_p", lambda x: give(x) >= LEAST_STEP)), _all=summed(F.col("_p")))
    rows = once(rows, _least=F.when(F.col("_large") < F.col("excess"), 0.0).otherwise(LEAST_STEP), _sum=F.when(F.col("_large") < F.col("excess"), F.col("_all")).otherwise(F.col("_large")))
    part = F.least(F.lit(1.0), F.col("excess") / F.col("_sum"))
    wanted = (F.col("excess") > 0) & (F.col("_sum") > 0)

    def step(x: Column) -> Column:
        goal = x["value"] - F.col("excess") / x["weight"]
        enough = (F.col("excess") <= 0) | (goal > x["floor"])
        mover = (give(x) > 0) & (give(x) >= F.col("_least"))
        return F.struct(
            x["feature"].alias("feature"), x["value"].alias("value"), (-x["c"]).alias("contribution"), T.rounded(F.when(enough, F.least(goal, x["value"])).otherwise(x["floor"]), 3).alias("goal"),
            enough.alias("enough"), F.when(wanted & mover, T.rounded(x["value"] - part * (x["value"] - x["floor"]), 3)).alias("plan"),
        )

    return rows.select(*keys, "logit", "excess", (F.col("excess") <= F.col("_sum")).alias("reachable"), F.transform("_p", step).alias("steps"))
