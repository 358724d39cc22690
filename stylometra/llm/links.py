"""Links between rows that share a bucket, counted without emitting pairs, and connected components of links."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .shared import discard, materialize, partitions, prepare, trimmed

#: members of a group that are compared at once; a larger group is cut into blocks, and each two blocks are a task's group
BLOCK = 1024
#: place of a group that is a whole component of what meets
WHOLE = -1
#: edges that are few enough to be followed to their ends in one task, without further rounds
FEW = 4096
Judge = Callable[[list[bytes], list[bytes]], tuple[np.ndarray, np.ndarray]]


def local_roots(linked: np.ndarray, names: np.ndarray) -> np.ndarray:
    """The smallest name of each row's component in a symmetric matrix of links."""
    root = names.copy()
    a, b = np.nonzero(linked)
    while len(a):
        before = root.copy()
        np.minimum.at(root, a, before[b])
        if (root == before).all():
            break
    return root


def plan_groups(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, list[str]]:
    """Who is compared with whom. rows: node, place, key, own (false: the node looks into a neighbour's bucket).

    Returns (met, member, plan, scratch): met has the rows of buckets with company, member the component of each node
    in the graph of meetings, plan a row per component: root, c (nodes), x (hash of its nodes), whole. A component is
    one group if it fits in a block or if that ships less than its buckets would, one by one; so each node of a group
    of near copies, which meet in many buckets, is sent once for each block and not once for each bucket.
    """
    buckets = rows.groupBy("place", "key").agg(F.count("*").alias("n"), F.min("node").alias("low"), F.bool_or("own").alias("owned")).where("n > 1 and owned").drop("owned")
    met, first = materialize(rows.join(buckets, ["place", "key"]), "met")
    member, second = components_of(met.select("node", F.col("low").alias("root")))
    shipped = F.col("n") * F.ceil(F.col("n") / BLOCK)
    work = met.where("node = low").groupBy("place", "key", "node").agg(F.max(shipped).alias("w")).join(member, "node").groupBy("root").agg(F.sum("w").alias("work"))
    sizes = member.groupBy("root").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("node")).alias("x"))
    whole = (F.col("c") <= BLOCK) | (F.col("c") * F.ceil(F.col("c") / BLOCK) <= F.coalesce("work", F.lit(0)))
    plan, third = materialize(sizes.join(work, "root", "left").select("root", "c", "x", whole.alias("whole")), "plan")
    return met, member, plan, [first, second, third]


def judged_links(met: DataFrame, member: DataFrame, plan: DataFrame, nodes: DataFrame, payload: DataFrame, judge: Judge, chances: Sequence[Callable[[np.ndarray], np.ndarray]] = ()) -> DataFrame:
    """Per node and root with links: node, root (smallest node it reaches in a group), links (sum of the copies of
    linked nodes), pairs (linked nodes) and w0, w1, ... for each of `chances`: 1 / the chance that buckets show a pair
    of that likeness, summed over the linked nodes (w0: over those that these buckets do show).

    nodes: node, copies, parts array<long>, reach int (bits in which parts of one place may differ and still meet).
    payload: node, data binary. In a component that is compared bucket by bucket every pair is judged once, at the
    first place where it meets. Only counts and roots leave a group, at most a row for each member of a block.
    """
    spark, weights = prepare(plan.sparkSession), [f"w{k}" for k in range(len(chances))]
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int").alias("blocks")
    whole = member.join(plan.where("whole"), "root").select("node", F.lit(WHOLE).alias("place"), F.col("root").alias("key"), F.lit(True).alias("own"), blocks("c"))
    apart = met.join(member.join(plan.where("not whole").select("root"), "root", "left_semi").select("node"), "node", "left_semi").select("node", "place", "key", "own", blocks("n"))
    rows = whole.unionByName(apart)
    block = F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks")).cast("int")
    dealt = rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("place", "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "own", "node")

    def run(batches):
        import pyarrow as pa

        held, at = [], None

        def done():
            if len(held) < 2:
                return
            place, i, j = at[0], at[2], at[3]
            left = [r for r in held if r[0] == i]
            right = left if i == j else [r for r in held if r[0] == j]
            if not left or not right:
                return
            na, nb = (np.array([r[2] for r in side], dtype=np.int64) for side in (left, right))
            fresh = na[:, None] != nb[None, :]
            met = np.zeros_like(fresh)
            if chances or place != WHOLE:
                xa, xb = (np.array([r[4] for r in side], dtype=np.int64) for side in (left, right))
                for t in range(xa.shape[1] if place == WHOLE else place):
                    met |= np.bitwise_count(xa[:, t][:, None] ^ xb[:, t][None, :]) <= left[0][5]
            if place != WHOLE:
                oa, ob = (np.array([r[1] for r in side]) for side in (left, right))
                fresh &= ~met & (oa[:, None] | ob[None, :])
            if not fresh.any():
                return
            linked, like = judge([r[6] for r in left], [r[6] for r in right])
            linked &= fresh
            if not linked.any():
                return
            ca, cb = (np.array([r[3] for r in side], dtype=np.int64) for side in (left, right))
            shown = linked & met if place == WHOLE else linked
            shares = []
            for k, chance in enumerate(chances):
                shares.append(np.zeros(linked.shape))
                use = shown if k == 0 else linked
                shares[-1][use] = 1 / chance(like[use])
            if i == j:
                names, links, both = na, linked @ ca, linked
                sums = [x.sum(axis=1) for x in (linked, *shares)]
            else:
                names, links = np.concatenate([na, nb]), np.concatenate([linked @ cb, linked.T @ ca])
                sums = [np.concatenate([x.sum(axis=1), x.sum(axis=0)]) for x in (linked, *shares)]
                both = np.zeros((len(names), len(names)), bool)
                both[: len(na), len(na) :], both[len(na) :, : len(na)] = linked, linked.T
            root, some = local_roots(both, names), links > 0
            yield pa.record_batch([pa.array(x[some]) for x in (names, root, links, *sums)], names=["node", "root", "links", "pairs", *weights])

        for b in batches:
            columns = [b.column(k).to_pylist() for k in range(b.num_columns)]
            for place, key, i, j, *row in zip(*columns):
                group = (place, key, i, j)
                if group != at:
                    yield from done()
                    held, at = [], group
                held.append(row)
        yield from done()

    full = dealt.join(nodes.select("node", "copies", "parts", "reach").join(payload, "node"), "node").select("place", "key", "i", "j", "block", "own", "node", "copies", "parts", "reach", "data")
    order = ["place", "key", "i", "j"]
    judged = full.repartition(partitions(spark), *order).sortWithinPartitions(*order, "node").mapInArrow(trimmed(run), "node long, root long, links long, pairs long" + "".join(f", {w} double" for w in weights))
    return judged.groupBy("node", "root").agg(*(F.sum(x).alias(x) for x in ("links", "pairs", *weights)))


def ends_of(batches):
    """node, to (the smallest node it reaches) of the nodes of few edges (a, b), in one task."""
    import pyarrow as pa

    to: dict[int, int] = {}

    def end(x):
        while to.setdefault(x, x) != x:
            to[x] = x = to[to[x]]
        return x

    for batch in batches:
        for x, y in zip(*(c.to_pylist() for c in batch.columns)):
            x, y = end(x), end(y)
            to[max(x, y)] = min(x, y)
    yield pa.record_batch([pa.array(list(to), pa.int64()), pa.array([end(x) for x in to], pa.int64())], names=["node", "to"])


def components_of(edges: DataFrame) -> tuple[DataFrame, str]:
    """node, root (the smallest node that each node of edges (node, root) reaches) and the path of that table.

    Rounds of contraction: each node goes over to the one with the least hash among itself and its neighbours, edges go
    with their ends, and what lies within one node or is there twice is dropped. The order is another one each round, so
    that long paths shrink by a share of their nodes too. A round joins only the edges that are left, not all of them
    again; the last FEW are followed in one task. The steps are then followed backwards. All is written to the shared
    folder; nothing but the number of edges left comes to the driver. A node alone in its edges is its own root.
    """
    spark, steps, scratch = prepare(edges.sparkSession), [], []

    def keep(df: DataFrame, name: str) -> DataFrame:
        kept, path = materialize(df, name)
        scratch.append(path)
        return kept

    def remaining(a, b, df: DataFrame) -> tuple[DataFrame, int]:
        left = Observation()
        rest = df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
        return keep(rest.observe(left, F.count("*").alias("n")), "edges"), left.get["n"]

    rest, n = remaining("node", "root", edges)
    while n > FEW:
        rank = lambda x: F.xxhash64(x, F.lit(len(steps)))
        near = rest.union(rest.select("b", "a")).withColumn("h", rank("b")).groupBy("a").agg(F.min("h").alias("h"), F.min_by("b", "h").alias("b"))
        step = keep(near.select(F.col("a").alias("node"), F.when(rank("a") <= F.col("h"), F.col("a")).otherwise(F.col("b")).alias("to")), "steps")
        rest, n = remaining("x", "y", rest.where("a <> b").join(step.toDF("a", "x"), "a").join(step.toDF("b", "y"), "b").where("x <> y"))
        steps.append(step)
    ends = keep(rest.coalesce(1).mapInArrow(trimmed(ends_of), "node long, to long"), "ends")
    while steps:
        ends = keep(steps.pop().join(ends.toDF("to", "end"), "to", "left").select("node", F.coalesce("end", "to").alias("to")), "ends")
    smallest = ends.groupBy("to").agg(F.min("node").alias("root"))
    labels, path = materialize(ends.join(smallest, "to").select("node", "root"), "labels")
    discard(spark, *scratch)
    return labels, path


def components(edges: DataFrame) -> DataFrame:
    return components_of(edges)[0]
