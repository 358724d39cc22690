"""Fits against a direct solve, groups against union-find, and the transfer check against a plain loop over folds."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stylometra.operators import calibration as C
from stylometra.operators.groups import linked_groups, ranked

SAMPLE = "f array<double>, y int, doc string, part string"


def draw(rng, n, doc=None, part=None, shift=1.0):
    out = []
    for k in range(n):
        y = int(rng.random() < 0.4)
        out.append(([round(abs(rng.gauss(0.3 + shift * 0.4 * y * (j % 3), 0.4)), 3) for j in range(7)], y, doc, part and f"{part}{k}"))
    return out


def direct(samples, start=C.Model(), penalty=C.PENALTY):
    """The same minimum by plain gradient descent with small steps and many of them."""
    x, y = np.array([s[0] for s in samples]), np.array([s[1] for s in samples])
    c = np.where(y == 1, len(y) / (2 * max(y.sum(), 1)), len(y) / (2 * max((1 - y).sum(), 1)))
    w, b = np.array(start.weights), start.bias
    for _ in range(200_000):
        e = (1 / (1 + np.exp(-(x @ w + b))) - y) * c
        gw, gb = x.T @ e / len(y) + penalty * (w - start.weights), e.mean()
        w, b = w - 0.5 * gw, b - 0.5 * gb
        if max(abs(gw).max(), abs(gb)) < 1e-10:
            break
    return b, w


def test_fit(spark):
    samples = draw(random.Random(1), 400)
    noise = [(None, 1, None, None), ([0.1] * 7, None, None, None), ([0.1] * 7, 5, None, None)]
    got = C.fit(spark.createDataFrame([*samples, *noise], SAMPLE))
    b, w = direct(samples)
    assert abs(got.bias - b) < 1e-4 and np.abs(np.array(got.weights) - w).max() < 1e-4
    p = 1 / (1 + np.exp(-(np.array([s[0] for s in samples]) @ w + b)))
    y = np.array([s[1] for s in samples])
    balanced = [((p >= t / 100)[y == 1].mean() + (p < t / 100)[y == 0].mean(), -t) for t in C.THRESHOLDS]
    assert got.threshold == -max(balanced)[1] / 100


def test_fit_of_separable_and_short_samples(spark):
    samples = [([float(k > 20)] * 3, int(k > 20), None, None) for k in range(40)]
    got = C.fit(spark.createDataFrame(samples, SAMPLE))
    b, w = direct([(s[0] + [0.0] * 4, s[1]) for s in samples])
    assert abs(got.bias - b) < 1e-3 and np.abs(np.array(got.weights) - w).max() < 1e-3


@pytest.mark.parametrize("samples", [[], [([0.5] * 7, 1, None, None)] * 3, [([0.5] * 7, 0, None, None)]])
def test_degenerate_fits_give_the_start_back(spark, samples):
    assert C.fit(spark.createDataFrame(samples, SAMPLE)) == C.Model()


def roots(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for k, p in pairs:
        a, b = find(("k", k)), find(("p", p) if p is not None else ("k", k))
        parent[max(a, b)] = min(a, b)
    groups = {}
    for k, _ in pairs:
        groups.setdefault(find(("k", k)), set()).add(k)
    return {k: min(g) for g in groups.values() for k in g}


def test_linked_groups(spark):
    rng = random.Random(9)
    chain = [(f"v{k:04d}", f"c{k + d}") for k in range(100) for d in (0, 1)]  # every version shares a part with the next
    hot = [(f"h{k}", "common") for k in range(500)]
    odd = [("alone", None), ("alone", "own"), ("a", "x"), ("a", "x"), ("b", "x")]
    some = [(f"r{rng.randint(0, 80)}", f"q{rng.randint(0, 90)}") for _ in range(120)]
    pairs = chain + hot + odd + some
    df = spark.createDataFrame([*pairs, (None, "x"), (None, None)], "doc string, part string")
    assert {r["doc"]: r["group"] for r in linked_groups(df, "doc", "part").collect()} == roots(pairs)
    assert linked_groups(df.where("doc = 'alone'"), "doc", "part").collect() == [("alone", "alone")]
    assert linked_groups(df.limit(0), "doc", "part").collect() == []


def test_ranked(spark):
    names = [f"n{k * 7919 % 1000:03d}" for k in range(1000)]
    df = spark.createDataFrame([(n,) for n in names], "group string").repartition(7)
    assert [(r["group"], r["rank"]) for r in ranked(df, "group").orderBy("rank").collect()] == list(zip(sorted(names), range(1000)))


def test_transfer(spark):
    rng = random.Random(5)
    samples = [s for k in range(13) for s in draw(rng, 30, f"d{k:02d}", f"p{k:02d}-")]
    samples += [(f, y, "e", "p03-0") for f, y, _, _ in draw(rng, 10)]  # an edited version of d03
    samples += [(f, y, None, None) for f, y, _, _ in draw(rng, 10)]
    df = spark.createDataFrame(samples, SAMPLE)
    dealt, n = C.folds_of(df, most=4)
    rows = dealt.collect()
    assert n == 14 and len(rows) == len(samples)
    assert {r["group"] for r in rows if r["doc"] in ("d03", "e")} == {"d03"} and len({r["fold"] for r in rows}) == 4
    for g in {r["group"] for r in rows}:
        assert len({r["fold"] for r in rows if r["group"] == g}) == 1
    by_fold = {}
    for r in rows:
        by_fold.setdefault(r["fold"], []).append((r["f"], r["y"]))
    hits, standard = [], []
    for fold, held in by_fold.items():
        m = C.fit(spark.createDataFrame([(f, y, None, None) for k, v in by_fold.items() if k != fold for f, y in v], SAMPLE))
        p = lambda f, m: 1 / (1 + np.exp(-(np.dot(m.weights, f) + m.bias)))
        hits += [(p(f, m) >= m.threshold, y) for f, y in held]
        standard += [(p(f, C.Model()) >= 0.5, y) for f, y in held]
    balanced = lambda x: (np.mean([h for h, y in x if y == 1]) + np.mean([not h for h, y in x if y == 0])) / 2
    got = C.transfer_check(df, most=4).first()
    assert got["documents"] == 14 and abs(got["accuracy"] - balanced(hits)) < 1e-12 and abs(got["default_accuracy"] - balanced(standard)) < 1e-12


def test_transfer_of_too_little(spark):
    one = spark.createDataFrame(draw(random.Random(3), 20, "a", "p"), SAMPLE)
    assert C.transfer_check(one).first() == (1, None, None)
    assert C.transfer_check(one.limit(0)).first() == (0, None, None)
    assert C.transfer_check(one.withColumn("y", F.lit(1)).unionByName(one.withColumns({"doc": F.lit("b"), "part": F.lit("q"), "y": F.lit(1)}))).first() == (2, None, None)


def test_grouping_makes_samples_once(spark):
    """Samples are made once, however often grouping reads them."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    plain = spark.createDataFrame([(f"d{k % 7}", f"p{k % 5}", k) for k in range(60)], "doc string, part string, n int")
    dealt, n = C.folds_of(plain.mapInArrow(counted, plain.schema))
    assert n == 1 and dealt.count() == 60 and made.value == 60
