"""Groups of rows that share something: connected components by contraction, and ranks without a global window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources import scratch


def linked_groups(rows: DataFrame, key: str, part: str, name: str = "group") -> DataFrame:
    """key, group of every distinct key: keys that share a part, directly or through others, have the smallest key of
    them all as group. Null keys have no row, null parts link nothing.

    Keys of a part are linked to its first one only, so a part of n keys has n links. Each round points every node at the
    first of itself and its neighbours, in the order of a hash, and joins only what is left of the links after their ends
    are replaced; by a hash, long chains of versions shrink by a share in every round instead of by one node.
    """
    spark = rows.sparkSession
    at = F.struct(F.xxhash64(key).alias("h"), F.col(key).alias("k"))
    keys, kept = scratch.written(rows.where(F.col(key).isNotNull()).select(key).distinct(), "keys")
    shared = rows.where(F.col(key).isNotNull() & F.col(part).isNotNull()).select(at.alias("a"), F.col(part).alias("part"))
    first = shared.groupBy("part").agg(F.min("a").alias("b"), F.max("a").alias("last")).where("b != last").drop("last")
    links, path = scratch.written(shared.join(first, "part").where("a != b").select("a", "b").distinct(), "links")
    labels, old = None, [kept, path]
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step, path = scratch.written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("to")), "step")
        old.append(path)
        now = step.select(F.col("a").alias("node"), "to")
        if labels is None:
            labels = now.select("node", F.col("to").alias("label"))
        else:
            moved = labels.join(now.withColumnRenamed("node", "label"), "label", "left")
            labels = moved.select("node", F.coalesce("to", "label").alias("label"))
        labels, path = scratch.written(labels, "labels")
        old.append(path)
        end = lambda c: now.select(F.col("node").alias(c), F.col("to").alias(f"{c}2"))  # noqa: B023, E731
        links, path = scratch.written(links.join(end("a"), "a").join(end("b"), "b").select(F.col("a2").alias("a"), F.col("b2").alias("b")).where("a != b").distinct(), "links")
        old.append(path)
    if labels is None:
        out = keys.select(key, F.col(key).alias(name))
    else:
        smallest = labels.groupBy("label").agg(F.least(F.min("node.k"), F.first("label.k")).alias(name))
        known = labels.join(smallest, "label").select(F.col("node.k").alias(key), name)
        out = keys.join(known, key, "left").select(key, F.coalesce(name, key).alias(name))
    out, _ = scratch.written(out, "groups")
    scratch.removed(spark, *old)
    return out


def ranked(rows: DataFrame, key: str, name: str = "rank") -> DataFrame:
    """rows (distinct keys) with their rank from 0: ranges are sorted and numbered on their own, and only one count for
    each range goes through the driver."""
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(key).withColumn("_range", F.spark_partition_id())
    dealt, path = scratch.written(dealt, "ranges")
    begins, at = [], 0
    for r in sorted(dealt.groupBy("_range").count().collect(), key=lambda r: r["_range"]):
        begins.append((r["_range"], at))
        at += r["count"]
    begins = spark.createDataFrame(begins, "_range int, _at long")
    within = F.row_number().over(W.partitionBy("_range").orderBy(key)) - 1
    out = dealt.withColumn("_k", within).join(F.broadcast(begins), "_range").withColumn(name, F.col("_k") + F.col("_at")).drop("_range", "_k", "_at")
    out, _ = scratch.written(out, "ranked")
    scratch.removed(spark, path)
    return out
