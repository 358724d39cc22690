"""Overlapping chunks of whole sentences for models with a window, how far such a model reads, and what chunks' scores say
of a text: its share of words above the threshold, its signal, and whether several scores agree."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sentences as N
from ..functions import text as T
from . import intervals
from .rows import from_texts, once

# Shares of the window that chunks have in common and that one unit may take; the least share of letters of
# the model's script; the band around the threshold in which a score decides nothing.
OVERLAP, UNIT, LEAST_SHARE, NEAR = 0.25, 0.25, 0.5, 0.15
SCHEMA = "chunk int, start long, end long, line long, end_line long, n_words long, word_start long, text_words long, text string"
SET = "array<struct<a:bigint,z:bigint>>"


def windows(costs: list[int], width: int, keep: int) -> list[tuple[int, int]]:
    """Ranges of units: each takes as many units as fit into width, at least one; the next begins with those last units of
    it that fit into keep, and later than it; the last one is filled up backwards."""
    sums, out, first = [0, *accumulate(costs)], [], 0
    while first < len(costs):
        last = max(first + 1, bisect_right(sums, sums[first] + width) - 1)
        if last == len(costs):
            least = out[-1][0] + 1 if out else 0
            out.append((max(least, min(first, bisect_left(sums, sums[last] - width))), last))
            break
        out.append((first, last))
        first = max(first + 1, min(last, bisect_left(sums, sums[last] - keep)))
    return out


def chunks(df: DataFrame, width: int, overlap: float = OVERLAP, unit: float = UNIT, counts: Callable[[list[str]], list[int]] | None = None, text_col: str = "text") -> DataFrame:
    """One row per chunk: the other columns of df, chunk (from 0), start, end, line, end_line (of the source, in code
    points), n_words, word_start (words of the text before it), text_words (of the whole text) and the chunk's text.

    Units are sentences; one of more than unit * width tokens is halved between words until its parts fit or are one word.
    `counts` gives the tokens of each of a list of strings, words if it isn't given. Empty and null texts, and those
    without a word, give no rows. Long runs of blanks cost no more than others.
    """
    cap, keep = max(1, round(width * unit)), round(width * overlap)

    def parts(text: str) -> list[tuple]:
        import regex

        word = regex.compile(T.WORD)
        of_words = lambda strings: [sum(1 for _ in word.finditer(s)) for s in strings]
        cost = counts or of_words
        ends = [m.end() for m in regex.finditer(N.END.replace("(?iu:", "(?i:"), text)]
        solid = regex.compile(rf"[^{N.BLANK[1:-1]}]+")
        # A sentence is its runs of signs between blanks, as spans.
        found = [[m.span() for m in solid.finditer(text, a, z)] for a, z in zip([0, *ends], [*ends, len(text)])]
        found = [s for s in found if s and word.search(text, s[0][0], s[-1][1])]
        units: list[tuple[int, int, int]] = []
        cut = lambda spans: text[spans[0][0] : spans[-1][1]]
        waiting = list(zip(found, cost([*map(cut, found)])))[::-1]
        while waiting:
            spans, n = waiting.pop()
            if n <= cap or len(spans) == 1:
                units.append((spans[0][0], spans[-1][1], n))
                continue
            halves = spans[: len(spans) // 2], spans[len(spans) // 2 :]
            waiting += [*zip(halves, cost([*map(cut, halves)]))][::-1]
        before = [0, *accumulate(of_words(text[a:z] for a, z, _ in units))]
        breaks = [m.start() for m in regex.finditer("\n", text)]
        line = lambda place: bisect_left(breaks, place) + 1
        out = []
        for k, (i, j) in enumerate(windows([n for *_, n in units], width, keep)):
            a, z = units[i][0], units[j - 1][1]
            out.append((k, a, z, line(a), line(z), before[j] - before[i], before[i], before[-1], text[a:z]))
        return out

    return from_texts(df, text_col, SCHEMA, parts)


def coverage(df: DataFrame, most_words: int, most_chars: int, text_col: str = "text") -> DataFrame:
    """df with how far a model reads that takes at most these words and characters: read_chars, n_chars, read_words,
    n_words, read_lines, n_lines. It stops after the last whole run of signs that fits. One fold in the row over the runs;
    a null text has nulls."""
    text = F.col(text_col)
    runs = F.regexp_extract_all(text, F.lit(rf"{N.BLANK}*[^{N.BLANK[1:-1]}]+"), F.lit(0))
    sized = F.transform(runs, lambda r: F.struct(F.length(r).alias("c"), F.size(T.words(r)).alias("w")))
    rows = once(df, _t=sized)
    zero = F.lit(0).cast("long")
    fits = lambda s, r: s["open"] & (s["w"] + r["w"] <= most_words) & (s["c"] + r["c"] <= most_chars)

    def step(s: Column, r: Column) -> Column:
        add = lambda n, on: (s[n] + F.when(on, r[n]).otherwise(0)).cast("long").alias(n)
        on = fits(s, r)
        return F.struct(add("c", on), add("w", on), (s["all"] + r["w"]).cast("long").alias("all"), on.alias("open"))

    rows = once(rows, _s=F.aggregate("_t", F.struct(zero.alias("c"), zero.alias("w"), zero.alias("all"), F.lit(True).alias("open")), step))
    whole = F.col("_s.open") & (F.length(text) <= most_chars)
    end = F.when(whole, F.length(text)).otherwise(F.col("_s.c")).cast("long")
    rows = once(rows, read_chars=end)
    lines = lambda c: F.regexp_count(c, F.lit("\n")).cast("long") + 1
    return rows.select(
        *df.columns, "read_chars", F.length(text).cast("long").alias("n_chars"), F.col("_s.w").alias("read_words"),
        F.col("_s.all").alias("n_words"), lines(F.left(text, F.col("read_chars"))).alias("read_lines"), lines(text).alias("n_lines"),
    )


def readable(text: Column, script: str) -> Column:
    """Whether at least LEAST_SHARE of the Cyrillic and Latin letters of a text are of a script; false without letters."""
    own, other = T.letters(text, script), T.letters(text, "Latin" if script == "Cyrillic" else "Cyrillic")
    return F.coalesce((own + other > 0) & (own >= LEAST_SHARE * (own + other)), F.lit(False))


def scanned(rated: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """keys, n_chunks, n_skipped, n_above, share and lines of texts whose chunks have a probability (null: not rated).

    share: words in chunks above the threshold, those that chunks have in common once, by the words of the text without
    those in chunks that were not rated alone. lines: ranges of lines above the threshold, neighbours joined. Only numbers
    are shuffled; keys must tell texts apart. Words are the places of a line of words, so sets of words are intervals.
    """
    p, above = F.col("probability"), F.col("probability") >= threshold
    word = F.struct(F.col("word_start").alias("a"), (F.col("word_start") + F.col("n_words")).alias("z"))
    line = F.struct(F.col("line").alias("a"), (F.col("end_line") + 1).alias("z"))
    some = lambda on, x: F.collect_list(F.when(on, x)).cast(SET)
    count = lambda on: F.sum(on.cast("long"))
    per = rated.groupBy(*keys).agg(
        F.count("*").alias("n_chunks"), count(p.isNull()).alias("n_skipped"), F.coalesce(count(above), F.lit(0)).alias("n_above"),
        F.max("text_words").alias("_w"), some(above, word).alias("_above"), some(p.isNull(), word).alias("_skipped"),
        some(p.isNotNull(), word).alias("_rated"), some(above, line).alias("_lines"),
    )
    first = intervals.measured(per, "_skipped", "_rated").withColumnRenamed("only_left", "_lost").drop("union", *intervals.NAMES[1:])
    rows = intervals.measured(first.withColumn("_none", F.array().cast(SET)), "_above", "_none")
    rows = intervals.combined(rows.withColumnRenamed("union", "_hit"), "_lines", "_none", "lines", "union")
    left = F.col("_w") - F.col("_lost")
    share = F.when(left > 0, T.rounded(F.col("_hit") / left, 4)).otherwise(0.0)
    closed = F.transform("lines", lambda x: F.struct(x["a"].alias("first"), (x["z"] - 1).alias("last")))
    return rows.select(*keys, "n_chunks", "n_skipped", "n_above", share.alias("share"), closed.alias("lines"))


def signal(probability: Column, threshold: float, can_read: Column) -> Column:
    """Struct of probability (null where the model can't read the text), above, and near (decides nothing)."""
    p = F.when(can_read, probability)
    return F.struct(p.alias("probability"), F.coalesce(p >= threshold, F.lit(False)).alias("above"), F.coalesce(F.abs(p - threshold) < NEAR, F.lit(False)).alias("near"))


def agreement(signals: Column) -> Column:
    """Struct of n_above and agree for an array of signals: whether all are on one side; null where none was read."""
    n = F.size(F.filter(signals, lambda s: s["above"]))
    none = F.forall(signals, lambda s: s["probability"].isNull())
    return F.struct(n.cast("long").alias("n_above"), F.when(~none, (n == 0) | (n == F.size(signals))).alias("agree"))
