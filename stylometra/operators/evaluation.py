"""Corpus evaluation: ranking quality, thresholds, reliability, raters' agreement, differences of bags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from .rows import once


def roc_auc(rows: DataFrame, keys: tuple[str, ...] = (), ranges: int = 4096) -> DataFrame:
    """Area under the ROC curve of (score in 0 to 1, positive boolean), of each group of `keys`; ties count half.

    Rows are counted per score, scores are dealt into ranges, and running totals go over the ranges first (at most
    `ranges` rows of a group) and then within each; no window sees all distinct scores.
    """
    at = F.least(F.floor(F.col("score") * ranges), F.lit(ranges - 1)).cast("int")
    per = rows.groupBy(*keys, at.alias("at"), "score").agg(F.sum(F.col("positive").cast("long")).alias("p"), F.sum((~F.col("positive")).cast("long")).alias("n"))
    coarse = per.groupBy(*keys, "at").agg(F.sum("n").alias("m")).withColumn("before", F.coalesce(F.sum("m").over(W.partitionBy(*keys).orderBy("at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("m")
    within = F.coalesce(F.sum("n").over(W.partitionBy(*keys, "at").orderBy("score").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = per.withColumn("within", within).join(coarse, [*keys, "at"])
    total = placed.groupBy(*keys).agg(F.sum(F.col("p") * (2 * (F.col("before") + F.col("within")) + F.col("n"))).alias("wins"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    area = F.when((F.col("p") > 0) & (F.col("n") > 0), T.rounded(F.col("wins") / (2 * F.col("p") * F.col("n")), 6))
    return total.select(*keys, area.alias("auc"), F.col("p").alias("n_positive"), F.col("n").alias("n_negative"))


def confusions(rows: DataFrame, thresholds: list[int], keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, t, tp, fp, fn, tn for thresholds in hundredths; scores are counted by thousandth before."""
    per = rows.groupBy(*keys, F.floor(F.col("score") * 1000 + 0.5).cast("long").alias("s"), "positive").agg(F.count("*").alias("c"))
    grid = per.withColumn("t", F.explode(F.array(*(F.lit(t).cast("long") for t in thresholds))))
    over = F.col("s") >= F.col("t") * 10
    count = lambda x: F.sum(F.when(x, F.col("c")).otherwise(0))
    return grid.groupBy(*keys, "t").agg(count(F.col("positive") & over).alias("tp"), count(~F.col("positive") & over).alias("fp"), count(F.col("positive") & ~over).alias("fn"), count(~F.col("positive") & ~over).alias("tn"))


def share(part, whole, digits: int = 6) -> Column:
    """part / whole, rounded; null where whole is 0."""
    return F.when(whole != 0, T.rounded(part / whole, digits))


def metrics(counts: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Accuracy, precision, recall, F1, balanced accuracy, false positive and false negative rate of confusions."""
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return counts.select(*keys, "t", share(tp + tn, tp + fp + fn + tn).alias("accuracy"), share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"), T.rounded((tp / F.nullif(tp + fn, F.lit(0)) + tn / F.nullif(tn + fp, F.lit(0))) / 2, 6).alias("balanced_accuracy"), share(fp, fp + tn).alias("fpr"), share(fn, tp + fn).alias("fnr"))


def best_f1(rows: DataFrame) -> DataFrame:
    """The threshold of 1 to 100 hundredths with the largest F1; ties: the smallest."""
    per = confusions(rows, [*range(1, 101)]).withColumn("f1", share(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))
    best = per.agg(F.max(F.struct("f1", (-F.col("t")).alias("t"))).alias("best"))
    return best.select((-F.col("best.t")).alias("threshold"), F.col("best.f1").alias("f1"))


def class_report(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of either class and their plain means, from one row of confusions."""
    one = lambda name, hit, wrong, missed: F.struct(F.lit(name).alias("class"), hit.alias("hit"), wrong.alias("wrong"), missed.alias("missed"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    each = counts.select(F.explode(F.array(one("positive", tp, fp, fn), one("negative", tn, fn, fp))).alias("c")).select("c.*")
    hit, wrong, missed = F.col("hit"), F.col("wrong"), F.col("missed")
    table = each.select("class", share(hit, hit + wrong).alias("precision"), share(hit, hit + missed).alias("recall"), share(2 * hit, 2 * hit + wrong + missed).alias("f1"), (hit + missed).alias("support"))
    macro = table.agg(*(T.rounded(F.avg(x), 6).alias(x) for x in ("precision", "recall", "f1")), F.sum("support").alias("support")).withColumn("class", F.lit("macro"))
    return table.unionByName(macro)


def brier_logloss(rows: DataFrame, least: float = 1e-6) -> DataFrame:
    """Mean squared error and mean log loss of probabilities, clipped at `least`."""
    y = F.col("positive").cast("long")
    s = F.floor(F.col("score") * 1000 + 0.5).cast("long")
    per = rows.groupBy(s.alias("s"), y.alias("y")).agg(F.count("*").alias("c"))
    p = F.greatest(F.lit(least), F.least(F.lit(1 - least), F.when(F.col("y") == 1, F.col("s") / 1000).otherwise(1 - F.col("s") / 1000)))
    error = F.col("s") - 1000 * F.col("y")
    out = per.agg(F.sum(error * error * F.col("c")).alias("e"), F.sum(-F.log(p) * F.col("c")).alias("l"), F.sum("c").alias("n"))
    return out.select(T.rounded(F.col("e") / F.col("n") / 1_000_000, 6).alias("brier"), T.rounded(F.col("l") / F.col("n"), 5).alias("log_loss"), "n")


def reliability_table(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Every bin, empty ones too, with its rows, mean prediction and share of positives, and the calibration error of all."""
    s = F.floor(F.col("score") * 1000 + 0.5).cast("long")
    per = rows.groupBy(F.least(F.floor(s * bins / 1000), F.lit(bins - 1)).cast("long").alias("bin")).agg(F.count("*").alias("n"), F.sum(s).alias("s"), F.sum(F.col("positive").cast("long")).alias("p"))
    every = rows.sparkSession.range(bins).withColumnRenamed("id", "bin").join(per, "bin", "left").select("bin", *(F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("n", "s", "p")))
    all_ = every.agg(share(F.sum(F.abs(F.col("s") - 1000 * F.col("p"))), 1000 * F.sum("n")).alias("ece"))
    return every.join(F.broadcast(all_)).select("bin", "n", share(F.col("s"), 1000 * F.col("n")).alias("mean_score"), share(F.col("p"), F.col("n")).alias("share_positive"), "ece")


def rates_by_group(rows: DataFrame, group: str, threshold: int = 500) -> DataFrame:
    """False positive and false negative rate of all and of each group, in one grouping-sets aggregation."""
    over = F.floor(F.col("score") * 1000 + 0.5) >= threshold
    count = lambda x: F.sum(F.when(x, 1).otherwise(0))
    out = rows.rollup(group).agg(F.grouping(group).alias("g"), share(count(~F.col("positive") & over), count(~F.col("positive"))).alias("fpr"), share(count(F.col("positive") & ~over), count(F.col("positive"))).alias("fnr"), F.count("*").alias("n"))
    return out.select(F.when(F.col("g") == 1, "all").otherwise(F.col(group)).alias("grp"), "fpr", "fnr", "n")


def import_reports(previous: DataFrame, incoming: DataFrame) -> DataFrame:
    """What becomes of each incoming report (doc_key, markup_key): known, conflict with another markup, or new."""
    old = previous.select("doc_key", F.col("markup_key").alias("known")).distinct()
    return incoming.join(old, "doc_key", "left").select("doc_key", "markup_key", F.when(F.col("known").isNull(), "new").when(F.col("known") == F.col("markup_key"), "known").otherwise("conflict").alias("status"))


def share_error(rows: DataFrame, group: str, threshold: int = 500) -> DataFrame:
    """Mean over groups of |share of weight predicted positive - share of weight positive|, in points."""
    over = F.floor(F.col("score") * 1000 + 0.5) >= threshold
    weight = lambda x: F.sum(F.when(x, F.col("weight")).otherwise(0))
    per = rows.groupBy(group).agg(weight(over).alias("a"), weight(F.col("positive")).alias("b"), F.sum("weight").alias("w"))
    return per.agg(T.rounded(F.avg(F.floor(F.abs(F.col("a") - F.col("b")) * 1_000_000 / F.col("w"))) / 10_000, 4).alias("error"), F.count("*").alias("n_groups"))


def reliability(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Per bin of predicted probability: rows, mean prediction, share of positives."""
    b = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("long")
    per = rows.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.sum(F.floor(F.col("score") * 1000 + 0.5).cast("long")).alias("s"), F.sum(F.col("positive").cast("long")).alias("p"))
    return per.select("bin", "n", T.rounded(F.col("s") / F.col("n") / 1000, 6).alias("mean_score"), T.rounded(F.col("p") / F.col("n"), 6).alias("share_positive"))


def threshold_grid(rows: DataFrame, first: int = 20, last: int = 80, step: int = 2) -> DataFrame:
    """Balanced accuracy at each threshold of a grid in hundredths; scores are counted by thousandth before."""
    per = rows.groupBy(F.floor(F.col("score") * 1000 + 0.5).cast("long").alias("s"), "positive").agg(F.count("*").alias("c"))
    grid = per.withColumn("t", F.explode(F.sequence(F.lit(first), F.lit(last), F.lit(step))))
    over = F.col("s") >= F.col("t") * 10
    count = lambda x: F.sum(F.when(x, F.col("c")).otherwise(0))
    out = grid.groupBy("t").agg(count(F.col("positive") & over).alias("tp"), count(F.col("positive")).alias("p"), count(~F.col("positive") & ~over).alias("tn"), count(~F.col("positive")).alias("n"))
    return out.select(F.col("t").cast("long").alias("threshold"), T.rounded((F.col("tp") / F.nullif(F.col("p"), F.lit(0)) + F.col("tn") / F.nullif(F.col("n"), F.lit(0))) / 2, 6).alias("balanced_accuracy"))


def agreement(answers: DataFrame) -> DataFrame:
    """Share of equal levels of each two raters (doc_id, run, level)."""
    other = answers.select("doc_id", F.col("run").alias("run_b"), F.col("level").alias("level_b"))
    pairs = answers.join(other, "doc_id").where("run < run_b and level is not null and level_b is not null")
    per = pairs.groupBy(F.col("run").cast("long").alias("run_a"), F.col("run_b").cast("long").alias("run_b")).agg(F.count("*").alias("n"), F.sum((F.col("level") == F.col("level_b")).cast("long")).alias("same"))
    return per.select("run_a", "run_b", "n", T.rounded(F.col("same") / F.col("n"), 6).alias("agreement"))


def bag_difference(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """What either bag has more of: keys, side, surplus. One aggregation of both, no join."""
    both = before.select(*keys, F.lit(1).alias("d")).unionByName(after.select(*keys, F.lit(-1).alias("d")))
    out = both.groupBy(*keys).agg(F.sum("d").alias("d")).where("d != 0")
    return out.select(*keys, F.when(F.col("d") > 0, "missing").otherwise("added").alias("side"), F.abs("d").cast("long").alias("surplus"))


def bag_changes(rows: DataFrame, before: Column, after: Column, name: str, *keys: str) -> DataFrame:
    """What either of two arrays of strings of a row has more of: keys, the part, side, surplus. Compared in the row: one
    scan, no shuffle, and rows of one key stay apart. Null arrays count as empty ones."""
    none = F.array().cast("array<string>")
    rows = once(rows.select(*keys, F.coalesce(before, none).alias("_b"), F.coalesce(after, none).alias("_a")).where("size(_b) + size(_a) > 0"), _p=F.array_distinct(F.concat("_b", "_a")))
    n = lambda c, p: F.size(F.filter(c, lambda x: x == p))
    each = F.transform("_p", lambda p: F.struct(p.alias(name), (n("_b", p) - n("_a", p)).cast("long").alias("d")))
    out = rows.select(*keys, F.explode(each).alias("x")).where("x.d != 0")
    return out.select(*keys, f"x.{name}", F.when(F.col("x.d") > 0, "missing").otherwise("added").alias("side"), F.abs("x.d").alias("surplus"))


def every_nth(rows: DataFrame, order: str, step: Column) -> DataFrame:
    """A systematic sample of rows whose running id is known: those at whole multiples of step."""
    return rows.where(F.floor((F.col(order) + 1) / step) > F.floor(F.col(order) / step))
