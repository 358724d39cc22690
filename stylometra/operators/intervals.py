"""Sets of intervals in the row: union, intersection, difference, and metrics of spans by characters.

An interval is a struct of a and z, a to below z; empty ones (z <= a) and null ones count for nothing. A set is an array in
any order, with overlaps. Both sets become events that are sorted once and swept once, whatever the number of intervals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .rows import once

SET = "array<struct<a:bigint,z:bigint>>"
NAMES = ("union", "both", "only_left", "only_right")


def events(left: Column, right: Column) -> Column:
    """Where intervals begin and end: place, change of the left depth, change of the right one; sorted by place."""
    at = lambda x, side, end: F.struct((x["z"] if end else x["a"]).alias("at"), F.lit((-1 if end else 1) * (side == 0)).alias("l"), F.lit((-1 if end else 1) * (side == 1)).alias("r"))
    real = lambda c: F.filter(F.coalesce(c, F.array().cast(SET)), lambda x: x["z"] > x["a"])
    some = [F.transform(real(c), lambda x: at(x, side, end)) for side, c in ((0, left), (1, right)) for end in (False, True)]  # noqa: B023
    return F.array_sort(F.concat(*some))


def measured(df: DataFrame, left: str, right: str) -> DataFrame:
    """df with the lengths of the union, of what both sets cover, and of what only one does. One fold with four numbers."""
    number = lambda x: F.lit(x).cast("long")
    begin = F.struct(number(0).alias("at"), F.lit(0).alias("l"), F.lit(0).alias("r"), number(0).alias("both"), number(0).alias("only_left"), number(0).alias("only_right"))

    def step(s: Column, e: Column) -> Column:
        width = e["at"] - s["at"]
        add = lambda name, on: (s[name] + F.when(on, width).otherwise(0)).cast("long").alias(name)
        l, r = s["l"] > 0, s["r"] > 0  # noqa: E741
        return F.struct(e["at"].cast("long").alias("at"), (s["l"] + e["l"]).alias("l"), (s["r"] + e["r"]).alias("r"), add("both", l & r), add("only_left", l & ~r), add("only_right", ~l & r))

    rows = once(df, _e=events(F.col(left), F.col(right)))
    rows = once(rows, _s=F.aggregate("_e", begin, step))
    part = lambda n: F.col(f"_s.{n}").alias(n)
    return rows.select(*df.columns, (F.col("_s.both") + F.col("_s.only_left") + F.col("_s.only_right")).alias("union"), *map(part, NAMES[1:]))


def combined(df: DataFrame, left: str, right: str, name: str, keep: str) -> DataFrame:
    """df with the set `name` of disjoint intervals in order, touching ones joined: of the union, of what is in both, or
    only_left. Depths before each event are running sums over the sorted events, carried by one fold."""
    inside = {"union": lambda l, r: (l > 0) | (r > 0), "both": lambda l, r: (l > 0) & (r > 0), "only_left": lambda l, r: (l > 0) & (r <= 0)}[keep]
    rows = once(df, _e=events(F.col(left), F.col(right)))
    begin = F.struct(F.lit(0).alias("l"), F.lit(0).alias("r"), F.lit(None).cast("long").alias("open"), F.array().cast(SET).alias("out"))

    def step(s: Column, e: Column) -> Column:
        l, r = s["l"] + e["l"], s["r"] + e["r"]  # noqa: E741
        on = inside(l, r)
        closes = s["open"].isNotNull() & ~on & (e["at"] > s["open"])
        joins = (F.size(s["out"]) > 0) & (F.try_element_at(s["out"], F.lit(-1))["z"] == s["open"])
        done = F.struct(F.when(joins, F.try_element_at(s["out"], F.lit(-1))["a"]).otherwise(s["open"]).alias("a"), e["at"].cast("long").alias("z"))
        kept = F.when(joins, F.slice(s["out"], F.lit(1), F.size(s["out"]) - 1)).otherwise(s["out"])
        return F.struct(l.alias("l"), r.alias("r"), F.when(on, F.coalesce(s["open"], e["at"])).cast("long").alias("open"), F.when(closes, F.concat(kept, F.array(done))).otherwise(s["out"]).alias("out"))

    rows = once(rows, _s=F.aggregate("_e", begin, step))
    return rows.select(*df.columns, F.col("_s.out").alias(name))


def span_metrics(df: DataFrame, predicted: str, true: str, *keys: str) -> DataFrame:
    """keys, micro and macro precision, recall and F1 by characters. Micro: of all characters together; macro: means over
    rows, where a row without predicted (true) characters has precision (recall) 1 if the other side has none either, else 0."""
    rows = measured(df, predicted, true)
    both, p, t = F.col("both"), F.col("both") + F.col("only_left"), F.col("both") + F.col("only_right")
    ratio = lambda whole, other: F.when(whole > 0, both / whole).when(other == 0, 1.0).otherwise(0.0)
    rows = once(rows, _p=ratio(p, t), _r=ratio(t, p))
    f1 = F.when(F.col("_p") + F.col("_r") > 0, 2 * F.col("_p") * F.col("_r") / (F.col("_p") + F.col("_r"))).otherwise(0.0)
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), *(F.sum(c).alias(n) for n, c in (("b", both), ("p", p), ("t", t))), *(T.rounded(F.avg(c), 6).alias(n) for n, c in (("macro_precision", F.col("_p")), ("macro_recall", F.col("_r")), ("macro_f1", f1))))
    micro = lambda x, y: F.when(y > 0, T.rounded(x / y, 6))
    return out.select(*keys, "n", micro(F.col("b"), F.col("p")).alias("micro_precision"), micro(F.col("b"), F.col("t")).alias("micro_recall"), micro(2 * F.col("b"), F.col("p") + F.col("t")).alias("micro_f1"), "macro_precision", "macro_recall", "macro_f1")
