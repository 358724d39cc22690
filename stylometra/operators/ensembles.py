"""Features of a text as one vector, and scores of tree ensembles on vectors, all in the row: no Python, no shuffle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import style
from .rows import once

# Words and signs whose rates count, the letters of a long word and the words of a window.
FUNCTION_WORDS = (
    "и в не на что с как а но это по к же ли бы то вот уж ведь даже еще так который которые которая "
    "является данный также однако кроме того более важно позволяет обеспечивает именно просто очень "
    "я мы вы ты он она они мой наш свой этот там тут здесь потом когда если чтобы или да нет ну вообще "
    "кстати типа может можно нужно будет был была были"
).split()
SIGNS = {"comma": ",", "colon": ":", "semicolon": ";", "paren": "(", "question": "?", "exclam": "!"}
LONG_WORD, WINDOW = 10, 100


def feature_names(rules: tuple[str, ...] = ()) -> list[str]:
    """The order of the vector: a flag for each rule, measures, rates of signs, rates of words."""
    return [*(f"rule:{r}" for r in rules), "sentence-mean", "sentence-cv", "mattr", "word-length", "long-words", *SIGNS, *(f"word:{w}" for w in FUNCTION_WORDS)]


def with_features(docs: DataFrame, rules: dict[str, Column] | None = None, text_col: str = "text", name: str = "features") -> DataFrame:
    """docs with a vector in the order of feature_names(tuple(rules)); rates are for 100 words.

    rules: whether a rule fired. Sentences below three words don't count. What a text is too short for is 0, and a null
    text counts as an empty one.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Words and sentences are found once; a rule's flag is computed before them, so it may read any column of docs.
    flags = F.array(*(F.coalesce(c.cast("double"), F.lit(0.0)) for c in (rules or {}).values())).cast("array<double>")
    sizes = F.filter(F.transform(T.sentences(text), lambda s: F.size(T.words(s)).cast("long")), lambda n: n >= 3)
    rows = once(docs, _flags=flags, _text=text, _sizes=sizes, _words=F.transform(T.words(text), F.lower))
    rows = once(rows, _plain=F.transform("_words", lambda w: F.translate(w, "ё", "е")))
    rows = style.with_moving_ratio(rows, "_words", "_ratio", WINDOW)
    rows = once(rows, _function=F.filter("_plain", lambda w: w.isin(FUNCTION_WORDS)), _n=F.greatest(F.size("_words"), F.lit(1)).cast("double"), _mattr=F.coalesce(F.col("_ratio"), F.lit(0.0)))
    mean, cv = style.spread(F.col("_sizes"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)
    rate = lambda x: F.lit(100.0) * x / F.col("_n")
    measures = F.array(
        F.coalesce(T.rounded(mean, 2), F.lit(0.0)), F.coalesce(T.rounded(cv, 3), F.lit(0.0)), "_mattr",
        total(F.transform("_words", lambda w: F.length(w).cast("long"))) / F.col("_n"),
        rate(F.size(F.filter("_words", lambda w: F.length(w) >= LONG_WORD))),
    )
    signs = F.array(*(rate(F.length("_text") - F.length(F.replace("_text", F.lit(s)))) for s in SIGNS.values()))
    words = F.transform(F.array(*map(F.lit, FUNCTION_WORDS)), lambda w: rate(F.size(F.filter("_function", lambda x: x == w))))
    return rows.select(*docs.columns, F.concat("_flags", measures, signs, words).alias(name))


@dataclass(frozen=True)
class Node:
    """A node of a tree: below or at the threshold of a feature to the left, else to the right; a leaf has no feature (-1)."""

    tree: int
    node: int
    feature: int
    threshold: float
    left: int
    right: int
    value: float


def ensemble_score(vector: Column, nodes: list[Node], start: float = 0.0) -> Column:
    """start plus the leaf that the vector reaches in every tree, by ascending tree.

    Nodes of all trees are one table of constant arrays, and a tree is walked from its root (its smallest node) for as many steps as the
    deepest tree has, so the expression doesn't grow with the trees. A null or missing feature goes to the right. A table without nodes gives start.
    """
    order = sorted(nodes, key=lambda n: (n.tree, n.node))
    place = {(n.tree, n.node): i for i, n in enumerate(order)}
    if len(place) < len(order):
        raise ValueError("a node is given twice")
    roots = [i for i, n in enumerate(order) if i == 0 or order[i - 1].tree != n.tree]
    depth, level, seen = 0, roots, 0
    while level:
        seen += len(level)
        if seen > len(order):
            raise ValueError("a node has two parents or is its own ancestor")
        level = [place[order[i].tree, k] for i in level if order[i].feature >= 0 for k in (order[i].left, order[i].right)]
        depth += bool(level)
    if not order:
        return F.lit(float(start))
    table = lambda kind, values: F.lit(list(values)).cast(f"array<{kind}>")
    feature, threshold, value = table("int", (n.feature for n in order)), table("double", (float(n.threshold) for n in order)), table("double", (float(n.value) for n in order))
    child = lambda side: table("int", (place[n.tree, getattr(n, side)] if n.feature >= 0 else i for i, n in enumerate(order)))
    left, right = child("left"), child("right")
    goes_left = lambda at: F.coalesce(F.get(vector, F.get(feature, at)) <= F.get(threshold, at), F.lit(False))
    step = lambda at, _: F.when(F.get(feature, at) < 0, at).when(goes_left(at), F.get(left, at)).otherwise(F.get(right, at))
    leaf = lambda root: F.aggregate(F.sequence(F.lit(1), F.lit(depth)), root, step) if depth else root
    return F.aggregate(table("int", roots), F.lit(float(start)), lambda s, root: s + F.get(value, leaf(root)))
