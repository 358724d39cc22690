"""Segments and style measures of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from .rows import once


def spread(values: Column) -> tuple[Column, Column]:
    """Mean and coefficient of variation (sample) of an array of whole numbers, rounded; null below two."""
    n = F.size(values)
    total = F.aggregate(values, F.lit(0).cast("long"), lambda s, x: s + x)
    squares = F.aggregate(values, F.lit(0).cast("long"), lambda s, x: s + x * x)
    mean = total / n
    variance = F.greatest(F.lit(0.0), (squares - total * total / n) / (n - 1))
    return F.when(n > 0, T.rounded(mean, 4)), F.when((n > 1) & (total > 0), T.rounded(F.sqrt(variance) / mean, 4))


def sentence_spread(docs: DataFrame) -> DataFrame:
    """Sentences of each document: how many, mean length in words, coefficient of variation."""
    sizes = F.transform(T.sentences(F.col("text")), lambda s: F.size(T.words(s)).cast("long"))
    rows = docs.select("doc_id", sizes.alias("sizes"))
    mean, cv = spread(F.col("sizes"))
    return rows.select("doc_id", F.size("sizes").cast("long").alias("n_sentences"), mean.alias("mean_words"), cv.alias("cv"))


def with_moving_ratio(rows: DataFrame, words: str, name: str, window: int = 50) -> DataFrame:
    """rows with the moving-average type-token ratio of an array of words; null below `window` words.

    A word counts in a window unless the same word stands before it there, so each word adds to as many windows as lie
    between its last occurrence and itself. Last occurrences are neighbours once words are sorted with their places: one
    sort in the row, and no window is built.
    """
    n = F.size(words)
    rows = once(rows, _sorted=F.when(n >= window, F.array_sort(F.transform(words, lambda x, i: F.struct(x.alias("w"), i.alias("i"))))))

    def added(x: Column, k: Column) -> Column:
        previous = F.get("_sorted", k - 1)
        last = F.when(previous["w"] == x["w"], previous["i"] + 1).otherwise(0)
        first = F.greatest(F.coalesce(last, F.lit(0)), x["i"] - (window - 1), F.lit(0))
        return F.greatest(F.lit(0), F.least(x["i"], n - window) - first + 1).cast("long")

    types = F.aggregate(F.transform("_sorted", added), F.lit(0).cast("long"), lambda s, x: s + x)
    return rows.withColumn(name, F.when(n >= window, T.rounded(types / (window * (n - window + 1)), 6))).drop("_sorted")


def diversity(docs: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, n_words and moving-average type-token ratio of every row; the ratio is null below `window` words."""
    rows = once(docs.select("doc_id", "text"), w=F.transform(T.words(F.col("text")), F.lower))
    return with_moving_ratio(rows, "w", "mattr", window).select("doc_id", F.size("w").cast("long").alias("n_words"), "mattr")


def runs(keys: Column, least: int) -> Column:
    """Runs of at least `least` equal keys in an array of strings, in the row: array of key, first_pos, n. Null ends a run."""
    begin = F.struct(
        F.lit(None).cast("string").alias("key"), F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("n"),
        F.array().cast("array<struct<key:string,first_pos:bigint,n:bigint>>").alias("out"),
    )
    closed = lambda s: F.when(s["n"] >= least, F.concat(s["out"], F.array(F.struct(s["key"].alias("key"), s["first"].alias("first_pos"), s["n"].alias("n"))))).otherwise(s["out"])

    def step(s: Column, x: Column) -> Column:
        same = F.coalesce(s["key"] == x["k"], F.lit(False))
        fresh = F.when(x["k"].isNotNull(), 1).otherwise(0).cast("long")
        return F.struct(
            x["k"].alias("key"), F.when(same, s["first"]).otherwise(x["i"]).alias("first"),
            F.when(same, s["n"] + 1).otherwise(fresh).alias("n"), F.when(same, s["out"]).otherwise(closed(s)).alias("out"),
        )

    numbered = F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.cast("long").alias("i")))
    return F.aggregate(numbered, begin, step, closed)


def run_rows(docs: DataFrame, keys: Column, least: int, key: str | None = None) -> DataFrame:
    """A row per run: doc_id, first_pos, n, and the key under a name if one is given. No shuffle; repeated ids stay apart."""
    each = docs.select("doc_id", F.explode(runs(keys, least)).alias("r"))
    return each.select("doc_id", *([F.col("r.key").alias(key)] if key else []), "r.first_pos", "r.n")


def where(flag: Column) -> Column:
    """A run's key for what has a flag."""
    return F.when(flag, F.lit("x"))


def staccato(docs: DataFrame, least: int = 3, most_words: int = 4) -> DataFrame:
    """Runs of short sentences that neither ask nor announce."""
    return run_rows(docs, F.transform(T.sentences(F.col("text")), lambda s: where((F.size(T.words(s)) <= most_words) & ~s.rlike("[?:]$"))), least)


def same_opener(docs: DataFrame, least: int = 3) -> DataFrame:
    """Runs of sentences that begin with the same word of two letters or more."""
    opener = lambda s: F.lower(F.get(T.words(s), F.lit(0)))
    return run_rows(docs, F.transform(T.sentences(F.col("text")), lambda s: F.when(F.length(opener(s)) > 1, opener(s))), least, "opener")


def score(raw: Column, n_words: Column) -> Column:
    """0 to 100 from the weights of distinct findings and the words of the text."""
    # What the scale begins with, and the words it begins at.
    scale = 8 * F.greatest(F.lit(1.0), F.log2(F.greatest(n_words, F.lit(1)) / 50))
    return F.floor(100 * (1 - F.exp(-raw / scale)) + 0.5).cast("long")


def scored(docs: DataFrame, found: Column, *keep: str) -> DataFrame:
    """doc_id, the columns to keep, score and label of every row; found: array of kind, text, weight. A text without
    findings has score 0."""
    rows = docs.select("doc_id", *keep, F.size(T.words(F.col("text"))).alias("n_words"), F.array_distinct(F.transform(found, lambda x: F.struct(x["kind"].alias("kind"), F.lower(x["text"]).alias("text"), x["weight"].alias("weight")))).alias("f"))
    raw = F.aggregate("f", F.lit(0.0), lambda s, x: s + x["weight"])
    value = rows.select("doc_id", *keep, score(raw, F.col("n_words")).alias("score"))
    return value.select("doc_id", *keep, "score", T.label(F.col("score")).alias("label"))


def longest_of_equal(findings: DataFrame) -> DataFrame:
    """Of findings with the same document, kind and place the one with the longest text."""
    order = W.partitionBy("doc_id", "kind", "place").orderBy(F.desc(F.length("text")), "text")
    return findings.withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")
