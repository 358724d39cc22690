"""Feature vectors against plain counting, ensembles against a walk node by node."""

import random

import pytest
from pyspark.sql import functions as F

from stylometra.operators import ensembles as M


def grown(rng, tree, levels, width):
    """A random tree, its nodes numbered as they come."""
    nodes = []

    def grow(level):
        k = len(nodes)
        nodes.append(None)
        if level == 0 or rng.random() < 0.2:
            nodes[k] = M.Node(tree, k, -1, 0.0, 0, 0, rng.uniform(-1, 1))
        else:
            left, right = grow(level - 1), grow(level - 1)
            nodes[k] = M.Node(tree, k, rng.randrange(width), rng.choice([0.0, 0.5, 1.0]), left, right, 0.0)
        return k

    grow(levels)
    return nodes


def walked(vector, nodes, start):
    table, total = {(n.tree, n.node): n for n in nodes}, start
    for tree in sorted({n.tree for n in nodes}):
        node = table[tree, 0]
        while node.feature >= 0:
            x = vector[node.feature] if vector is not None and node.feature < len(vector) else None
            node = table[tree, node.left if x is not None and x <= node.threshold else node.right]
        total += node.value
    return total


def test_scores(spark):
    rng = random.Random(11)
    nodes = [n for t in range(60) for n in grown(rng, t, rng.randrange(7), 5)]
    vectors = [[rng.choice([0.0, 0.25, 0.5, 0.75, 1.0, None]) for _ in range(rng.choice([5, 5, 3]))] for _ in range(80)] + [[], None]
    rng.shuffle(nodes)
    rows = spark.createDataFrame([(1, v) for v in vectors], "doc_id int, v array<double>")
    assert [r.s for r in rows.select(M.ensemble_score(F.col("v"), nodes, 0.5).alias("s")).collect()] == [walked(v, nodes, 0.5) for v in vectors]


def test_odd_tables(spark):
    score = lambda nodes: spark.range(1).select(M.ensemble_score(F.array(F.lit(1.0)), nodes, 2.0)).first()[0]
    assert score([]) == 2.0 and score([M.Node(0, 0, -1, 0.0, 0, 0, 3.0)]) == 5.0
    for wrong in ([M.Node(0, 0, 0, 0.0, 0, 0, 0.0)], [M.Node(0, 0, -1, 0.0, 0, 0, 0.0)] * 2):
        with pytest.raises(ValueError):
            score(wrong)


def test_features(spark):
    text = "Ещё вот это: и кот, и преподаватель! Так (и) надо?"
    rows = spark.createDataFrame([(1, text, "x"), (1, None, None), (1, "", "x")], "doc_id int, text string, _kind string")
    names, found = M.feature_names(("own",)), M.with_features(rows, {"own": F.col("_kind") == "x"}).collect()
    full = dict(zip(names, found[0].features, strict=True))
    assert len(names) == 1 + 5 + len(M.SIGNS) + len(M.FUNCTION_WORDS) and full["rule:own"] == 1.0
    assert full["word:и"] == 30.0 and full["word:еще"] == 10.0 and full["long-words"] == 10.0 and full["word-length"] == 3.5
    assert [full[s] for s in M.SIGNS] == [10.0, 10.0, 0.0, 10.0, 10.0, 10.0] and full["sentence-mean"] == 5.0 and full["mattr"] == 0.0
    assert not any(found[1].features) and found[2].features[0] == 1.0 and not any(found[2].features[1:])
