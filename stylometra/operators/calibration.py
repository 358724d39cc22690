"""Calibration of the fragments' model: class-balanced logistic fits, and how a fit carries over to other documents.

Samples are rows of f (array of features), y (0 or 1), and for the transfer check doc and part. A round of a fit is one
aggregation of all samples into a few dozen sums for each model; nothing else reaches the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import scratch
from .fragments import BIAS, LIMIT, NAMES, WEIGHTS  # noqa: F401
from .groups import linked_groups, ranked

# The penalty, the thresholds that are tried (in hundredths), and the most folds.
PENALTY, THRESHOLDS, FOLDS = 0.01, range(20, 81, 2), 10
#: rounds of Newton's method at most, and the step at which it has arrived
ROUNDS, ARRIVED = 50, 1e-9


@dataclass(frozen=True)
class Model:
    bias: float = BIAS
    weights: tuple[float, ...] = WEIGHTS
    threshold: float = LIMIT


def half_up(x: float, digits: int) -> float:
    return math.floor(x * 10**digits + 0.5) / 10**digits


def logit(f: Column, bias: Column, weights: Column) -> Column:
    """Missing features count as 0, further ones not at all."""
    return F.aggregate(F.zip_with(weights, f, lambda w, x: w * F.coalesce(x, F.lit(0.0))), bias, lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def _sums(samples: DataFrame, models: dict[int, np.ndarray], counts: dict[int, tuple[int, int]], size: int) -> dict[int, np.ndarray]:
    """Of every model: loss, gradient and second derivatives over the samples outside its fold, in one array.

    Each task multiplies its samples batch by batch and gives size * (size + 1) + 1 sums a model, whatever it has read.
    """
    weights = {g: [sum(counts[g]) / (2 * n) for n in counts[g]] for g in models}

    def run(batches):
        import pyarrow as pa

        sums = {g: np.zeros(1 + size + size * size) for g in models}
        for b in batches:
            x = b.column(0).values.to_numpy().reshape(-1, size)[b.column(0).offset :][: b.num_rows]
            y, fold = b.column(1).to_numpy(), b.column(2).fill_null(-1).to_numpy()
            for g, m in models.items():
                z, on = x @ m, fold != g
                c = np.where(y == 1, weights[g][1], weights[g][0]) * on
                p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
                loss = np.maximum(z, 0) - y * z + np.log1p(np.exp(-np.abs(z)))
                sums[g] += np.concatenate([[c @ loss], (c * (p - y)) @ x, ((x * (c * p * (1 - p))[:, None]).T @ x).ravel()])
        flat = [(g, k, v) for g, s in sums.items() for k, v in enumerate(s.tolist())]
        yield pa.record_batch([pa.array(v, t) for v, t in zip(zip(*flat), (pa.int32(), pa.int32(), pa.float64()))], names=["g", "k", "v"])

    each = samples.select("x", "y", "fold").mapInArrow(run, "g int, k int, v double")
    out = {g: np.zeros(1 + size + size * size) for g in models}
    for r in each.groupBy("g", "k").agg(F.sum("v").alias("v")).collect():
        out[r["g"]][r["k"]] = r["v"]
    return out


def fits(samples: DataFrame, folds: int, start: Model = Model(), penalty: float = PENALTY) -> dict[int, Model]:
    """The model of every fold, fitted on the samples of the other folds (fold null: of none); all folds in one job a round.

    Minimises the mean of class-balanced log losses plus penalty/2 times the squared distance of the weights from the
    starting ones. Newton's method; a step that makes a loss larger is halved. Folds whose other samples have one class
    only, or none, have no model.
    """
    size = len(start.weights) + 1
    features = F.array(F.lit(1.0), *(F.coalesce(F.get("f", F.lit(k)).cast("double"), F.lit(0.0)) for k in range(size - 1)))
    rows, path = scratch.written(samples.where(F.col("y").isin(0, 1) & F.col("f").isNotNull()).select(features.alias("x"), F.col("y").cast("int").alias("y"), F.col("fold").cast("int").alias("fold")), "samples")
    known = {(r["fold"], r["y"]): r["n"] for r in rows.groupBy("fold", "y").agg(F.count("*").alias("n")).collect()}  # two rows for each fold
    total = [sum(n for (_, y), n in known.items() if y == c) for c in (0, 1)]
    counts = {g: (total[0] - known.get((g, 0), 0), total[1] - known.get((g, 1), 0)) for g in range(folds)}
    counts = {g: c for g, c in counts.items() if min(c)}
    origin = np.array([start.bias, *start.weights])
    models = {g: origin.copy() for g in counts}
    base = {g: (origin.copy(), np.zeros(size), math.inf) for g in counts}  # the last point, the step from it and its loss
    open_ = set(models)
    for _ in range(ROUNDS):
        if not open_:
            break
        for g, r in _sums(rows, {g: models[g] for g in open_}, counts, size).items():
            n, away = sum(counts[g]), models[g] - origin
            away[0] = 0
            loss = r[0] / n + penalty / 2 * float(away @ away)
            if loss > base[g][2] + 1e-12:
                point, step, best = base[g]
                base[g] = (point, step / 2, best)
                models[g] = point + step / 2
                continue
            slope = r[1 : size + 1] / n + penalty * away
            bend = r[size + 1 :].reshape(size, size) / n + np.diag([1e-12] + [penalty] * (size - 1))
            step = -np.linalg.solve(bend, slope)
            base[g] = (models[g].copy(), step, loss)
            if np.abs(step).max() < ARRIVED:
                open_.discard(g)
            models[g] = models[g] + step
    chosen = _thresholds(rows, models, counts)
    scratch.removed(samples.sparkSession, path)
    return {g: Model(half_up(m[0], 4), tuple(half_up(w, 4) for w in m[1:]), chosen[g]) for g, m in models.items()}


def _thresholds(rows: DataFrame, models: dict[int, np.ndarray], counts: dict[int, tuple[int, int]]) -> dict[int, float]:
    """Of every model the threshold of the largest balanced accuracy on its samples; ties: the smallest."""
    if not models:
        return {}
    one = lambda g: F.struct(F.lit(g).alias("g"), F.array(*(F.lit(float(x)) for x in models[g])).alias("m"))
    each = rows.select("x", "y", "fold", F.explode(F.array(*map(one, models))).alias("g")).where("fold is null or fold != g.g")
    p = T.sigmoid(F.aggregate(F.zip_with("g.m", "x", lambda w, x: w * x), F.lit(0.0), lambda s, x: s + x))
    hits = each.select("y", F.col("g.g").alias("g"), p.alias("p")).groupBy("g").agg(*(F.sum(((F.col("p") >= t / 100) == (F.col("y") == 1)).cast("long") * (F.col("y") == y).cast("long")).alias(f"t{t}_{y}") for t in THRESHOLDS for y in (0, 1)))
    best = {}
    for r in hits.collect():
        n = counts[r["g"]]
        best[r["g"]] = max(THRESHOLDS, key=lambda t: (r[f"t{t}_0"] / n[0] + r[f"t{t}_1"] / n[1], -t)) / 100  # noqa: B023
    return best


def fit(samples: DataFrame, start: Model = Model(), penalty: float = PENALTY) -> Model:
    """The model of all samples; `start` itself where they have one class only, or there are none. Samples whose y isn't 0 or 1, or whose f is null, don't count."""
    return fits(samples.withColumn("fold", F.lit(None).cast("int")), 1, start, penalty).get(0, start)


def probability(f: Column, model: Model) -> Column:
    return T.sigmoid(logit(f, F.lit(float(model.bias)), F.array(*(F.lit(float(w)) for w in model.weights))))


def folds_of(samples: DataFrame, most: int = FOLDS) -> tuple[DataFrame, int]:
    """samples with group and fold, and the number of groups. Documents that share a part are one group; samples without
    document are a group of their own. Groups are dealt to at most `most` folds in the order of their names."""
    # written once: grouping reads documents and parts several times, and would make every sample again each time
    named, _ = scratch.written(samples.withColumn("doc", F.coalesce("doc", F.lit(""))), "named")
    groups = linked_groups(named, "doc", "part")
    names = ranked(groups.select("group").distinct(), "group")
    n = names.count()
    dealt = groups.join(names.select("group", F.pmod("rank", F.lit(min(most, max(n, 1)))).cast("int").alias("fold")), "group")
    return named.join(dealt, "doc"), n


def transfer_check(samples: DataFrame, most: int = FOLDS) -> DataFrame:
    """One row: documents (groups), accuracy and default_accuracy, the balanced accuracy of fitted models and of the
    default one on documents that a fit hasn't seen. Null with fewer than two groups or without both classes held out."""
    dealt, n = folds_of(samples, most)
    spark = samples.sparkSession
    nothing = spark.createDataFrame([(n, None, None)], "documents long, accuracy double, default_accuracy double")
    if n < 2:
        return nothing
    dealt, path = scratch.written(dealt.select("f", F.col("y").cast("int").alias("y"), "fold"), "dealt")
    models = fits(dealt, min(most, n))
    if not models:
        scratch.removed(spark, path)
        return nothing
    hit = lambda m: probability(F.col("f"), m) >= m.threshold
    own = F.lit(None).cast("boolean")
    for g, m in models.items():
        own = F.when(F.col("fold") == g, hit(m)).otherwise(own)
    judged = dealt.where(F.col("fold").isin(*models) & F.col("y").isin(0, 1) & F.col("f").isNotNull()).select("y", own.alias("own"), hit(Model()).alias("standard"))
    rate = lambda c, y: F.avg(F.when(F.col("y") == y, (F.col(c) == (F.lit(y) == 1)).cast("double")))
    out, _ = scratch.written(judged.agg(F.lit(n).cast("long").alias("documents"), ((rate("own", 1) + rate("own", 0)) / 2).alias("accuracy"), ((rate("standard", 1) + rate("standard", 0)) / 2).alias("default_accuracy")), "transfer")
    scratch.removed(spark, path)
    return out
