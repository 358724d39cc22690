"""Hard-negative mining: every anchor's integer scores, sorted, with each positive's limits searched in the sorted run.

Rows are packed into blocks, anchors too. A block of anchors and a block of rows meet exactly once, in the task of their
cell of a grid; a cell's rows are scored and sorted block by block, so a task holds one block of scores whatever the
table's size. What a block yields for an anchor is merged with that of the blocks before, then over the cells.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .shared import discard, materialize, partitions, table
from .vectors import products, whole_vectors

SCALE, POSITIVES, NEGATIVES, EVERY = 256, 5, 3, 50
#: a negative's score is between these shares, in percent, of the positive's
LOWEST, HIGHEST = 50, 95
#: rows and anchors of a block; cells of the grid for each shuffle partition
ROWS, ANCHORS, CELLS = 4096, 512, 4
BLOCK = "dims int, rows binary, ids binary, labels array<string>, data binary"


def blocks(rows: DataFrame, size: int, limits: bool = False) -> DataFrame:
    """Rows (row, id, label, dims, v; limits, an array of numbers) in blocks of at most `size` rows and 16 MB of one length, ids ascending."""
    more = ["limits"] * limits

    def run(batches):
        import pyarrow as pa

        def block(dims, found):
            found.sort(key=lambda r: (r[1], r[0]))
            column = lambda k: [r[k] for r in found]
            arrays = [pa.array([dims], pa.int32()), *(pa.array([np.array(column(k), "<i8").tobytes()], pa.binary()) for k in (0, 1)), pa.array([column(2)], pa.list_(pa.string())), pa.array([b"".join(column(4))], pa.binary())]
            arrays += [pa.array([np.array(column(5), "<i8").tobytes()], pa.binary())] if limits else []
            return pa.record_batch(arrays, names=["dims", "rows", "ids", "labels", "data", *more])

        held: dict[int, list] = {}
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                some = held.setdefault(r[3], [])
                some.append(r)
                if len(some) >= min(size, max(1, (16 << 20) // (8 * r[3] or 1))):
                    yield block(r[3], held.pop(r[3]))
        for dims, found in held.items():
            yield block(dims, found)

    return rows.select("row", "id", "label", "dims", "v", *more).mapInArrow(run, BLOCK + ", limits binary" * limits)


class Block:
    def __init__(self, dims: int, rows: bytes, ids: bytes, labels: list[str], data: bytes, *more: bytes):
        self.dims, self.rows, self.ids = dims, np.frombuffer(rows, "<i8"), np.frombuffer(ids, "<i8")
        self.labels, self.data, self.more = np.array(labels, dtype=object), np.frombuffer(data, "<i8").reshape(len(labels), dims), more


def sorted_scores(anchors: Block, rows: Block, equal: bool):
    """For each label of the anchors: their places, and of the block's rows of this label (or of all others) the places,
    sorted by descending score, ties by smaller id, and the scores in that order: [anchors, rows]."""
    for label in sorted(set(anchors.labels)):
        own, others = np.flatnonzero(anchors.labels == label), np.flatnonzero((rows.labels == label) == equal)
        if len(others):
            scores = products(anchors.data[own], rows.data[others]).astype(np.int64)
            order = np.lexsort((np.broadcast_to(rows.ids[others], scores.shape), -scores), axis=1)
            yield own, others[order], np.take_along_axis(scores, order, axis=1)


class Positives:
    """The first rows of an anchor's own label in all blocks seen."""

    schema = "row long, positive_id long, positive_score long"

    def __init__(self, anchors: Block, most: int):
        self.anchors, self.most, self.best = anchors, most, [[] for _ in anchors.rows]

    def see(self, rows: Block) -> None:
        for own, order, scores in sorted_scores(self.anchors, rows, equal=True):
            for a, places, values in zip(own.tolist(), order[:, : self.most + 1], scores):
                found = [(-s, i) for s, i, r in zip(values.tolist(), rows.ids[places].tolist(), rows.rows[places].tolist()) if r != self.anchors.rows[a]]
                self.best[a] = sorted(self.best[a] + found)[: self.most]

    def out(self):
        for row, best in zip(self.anchors.rows.tolist(), self.best):
            for s, i in best:
                yield row, i, -s


class Negatives:
    """For each positive of an anchor: the first rows of other labels within its limits in all blocks seen."""

    schema = "row long, n int, negative_id long, negative_score long"

    def __init__(self, anchors: Block, most: int, lowest: int, highest: int, positives: int):
        self.anchors, self.most = anchors, most
        limits = np.frombuffer(anchors.more[0], "<i8").reshape(len(anchors.rows), positives + 1)
        # a score s is allowed if lowest * p <= 100 * s <= highest * p; whole numbers, so the bounds are rounded inwards
        self.limits = [[(-(-lowest * p // 100), highest * p // 100) for p in r[1 : 1 + r[0]]] for r in limits.tolist()]
        self.best = [[[] for _ in x] for x in self.limits]

    def see(self, rows: Block) -> None:
        for own, order, scores in sorted_scores(self.anchors, rows, equal=False):
            for a, places, values in zip(own.tolist(), order, scores):
                falling = -values
                begins = np.searchsorted(falling, [-high for _, high in self.limits[a]])
                for n, ((low, _), at) in enumerate(zip(self.limits[a], begins.tolist())):
                    taken = [(-s, i) for s, i in zip(values[at : at + self.most].tolist(), rows.ids[places[at : at + self.most]].tolist()) if s >= low]
                    if taken:
                        self.best[a][n] = sorted(self.best[a][n] + taken)[: self.most]

    def out(self):
        for row, best in zip(self.anchors.rows.tolist(), self.best):
            for n, found in enumerate(best):
                for s, i in found:
                    yield row, n, i, -s


def met(rows: DataFrame, n_rows: int, anchors: DataFrame, n_anchors: int, kind, *options) -> DataFrame:
    """What `kind` finds where all blocks of rows meet all blocks of anchors; kind sees an anchor block's rows cell by cell."""
    spark = rows.sparkSession
    groups = max(1, n_anchors)
    stripes = max(1, min(n_rows, -(-CELLS * partitions(spark) // groups)))
    number = lambda n: F.pmod(F.xxhash64("rows"), F.lit(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = anchors.select(number(groups).alias("g"), each(stripes).alias("s"), F.lit(0).alias("kind"), *anchors.columns)
    right = rows.select(each(groups).alias("g"), number(stripes).alias("s"), F.lit(1).alias("kind"), *rows.columns)
    both = left.unionByName(right, allowMissingColumns=True).repartition(partitions(spark), "g", "s").sortWithinPartitions("g", "s", "kind")

    def run(batches):
        import pyarrow as pa

        def flush(held):
            found = [x for h in held for x in h.out()]
            if found:
                yield pa.record_batch([pa.array(c) for c in zip(*found)], schema=schema)

        kinds = {"long": pa.int64(), "int": pa.int32()}
        schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in kind.schema.split(", ")])
        key, held = None, []
        for b in batches:
            for k in range(b.num_rows):
                r = {c: v[0] for c, v in b.slice(k, 1).to_pydict().items()}
                if (r["g"], r["s"]) != key:
                    yield from flush(held)
                    key, held = (r["g"], r["s"]), []
                block = Block(*(r[c] for c in r if c not in ("g", "s", "kind")))
                if r["kind"] == 0:
                    held.append(kind(block, *options))
                else:
                    for h in held:
                        if h.anchors.dims == block.dims:
                            h.see(block)
        yield from flush(held)

    return both.mapInArrow(run, kind.schema)


def hard_negatives(df: DataFrame, anchor: Column, label: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, lowest: int = LOWEST, highest: int = HIGHEST, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", rows_a_block: int = ROWS, anchors_a_block: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(scale * x); a score is the integer inner product. Anchors are the rows whose id meets
    `anchor`, a condition on a column `id`. An anchor's positives are its first other rows of its label (score
    descending, then id); a positive's negatives the first rows of other labels whose score is from `lowest` to
    `highest` percent of the positive's. Every anchor meets every row.

    Rows with a null id, a null label or an unusable vector take no part. Vectors of different lengths don't meet. Of
    repeated rows each counts: a copy of an anchor is an anchor, and another row to it. An anchor without positives,
    and a positive without negatives, give no rows. An empty table gives none. Other columns are ignored.
    """
    usable = whole_vectors(df, id_col, vector_col, label, scale).where("id is not null and label is not null")
    rows, first = materialize(usable.withColumn("row", F.monotonically_increasing_id()), "whole")
    packed, second = materialize(blocks(rows, rows_a_block), "blocks")
    chosen = rows.where(anchor)
    some, third = materialize(blocks(chosen, anchors_a_block), "anchors")
    n_rows, n_anchors = packed.count(), some.count()
    order = W.partitionBy("row").orderBy(F.desc("positive_score"), "positive_id")
    best = met(packed, n_rows, some, n_anchors, Positives, positives).withColumn("n", F.row_number().over(order)).where(F.col("n") <= positives)
    best, fourth = materialize(best.withColumn("n", (F.col("n") - 1).cast("int")), "positives")
    numbers = [F.coalesce(F.max(F.when(F.col("n") == k, F.col("positive_score"))), F.lit(0)).alias(f"p{k}") for k in range(positives)]
    limits = best.groupBy("row").agg(F.count("*").alias("c"), *numbers).select("row", F.array("c", *(f"p{k}" for k in range(positives))).alias("limits"))
    asked, fifth = materialize(blocks(chosen.join(limits, "row"), anchors_a_block, limits=True), "asked")
    found = met(packed, n_rows, asked, asked.count(), Negatives, negatives, lowest, highest, positives)
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("row", "n").orderBy(F.desc("negative_score"), "negative_id"))).where(F.col("rank") <= negatives)
    out = ranked.join(best, ["row", "n"]).join(chosen.select("row", F.col("id").alias("anchor_id")), "row")
    out, _ = materialize(out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"), "negatives")
    discard(df.sparkSession, first, second, third, fourth, fifth)
    return out


def op11_sorted_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the embeddings: anchors are ids divisible by 50, labels of ids divisible by 7 are moved by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("id") % EVERY == 0, moved)


OP11_SQL = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS MATERIALIZED (
  SELECT a.r AS a, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS own, list_dot_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.r <> b.r AND len(a.e) = len(b.e) WHERE a.vec_id % 50 = 0
), p AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) AS n FROM s WHERE own QUALIFY n <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.a, p.n ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.a = s.a AND NOT s.own AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
QUALIFY rank <= 3
"""
