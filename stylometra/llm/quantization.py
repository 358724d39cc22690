"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, reranking with original vectors."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .links import components, judged_links, plan_groups
from .shared import discard, materialize, prepare, table

#: bits of a code, vectors to learn a rotation from, dimensions with a rotation of their own, recall to be measured
BITS, SAMPLE, MODELS, RECALL = 64, 20_000, 8, 0.97
#: bits of a table's key by the number of vectors of the largest label
KEY_BITS = ((1 << 17, 8), (1 << 21, 12), (1 << 63, 16))
#: bits in which keys may differ at most before a label is compared as a whole instead
FLIPS = 2
THRESHOLD = 0.93


def learn_rotation(vectors: np.ndarray, bits: int = BITS, rounds: int = 40, seed: int = 9) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection [dims, bits]: principal axes, rotated so that signs lose least (Gong and Lazebnik's ITQ)."""
    x = np.asarray(vectors, dtype=np.float64)
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    mean = x.mean(axis=0)
    x = x - mean
    _, _, axes = np.linalg.svd(x.T @ x)
    axes = axes[: min(bits, x.shape[1])].T
    v = x @ axes
    rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(axes.shape[1],) * 2))[0]
    for _ in range(rounds):
        code = np.where(v @ rotation >= 0, 1.0, -1.0)
        u, _, w = np.linalg.svd(code.T @ v)
        rotation = (u @ w).T
    return mean, axes @ rotation


@dataclass
class Index:
    """Multi-index Hamming tables: each has key_bits of a code; two vectors meet if a table's keys differ in at most
    `flips` bits, so every pair within a radius of tables * (flips + 1) - 1 meets. No tables: all of a label meet."""

    mean: np.ndarray
    projection: np.ndarray
    key_bits: int
    tables: int
    flips: int
    recall: float

    def parts(self, vectors: np.ndarray) -> np.ndarray:
        if not self.tables:
            return np.zeros((len(vectors), 1), np.int64)
        x = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        bits = (x - self.mean) @ self.projection[:, : self.tables * self.key_bits] >= 0
        return bits.reshape(len(x), self.tables, self.key_bits) @ (np.int64(1) << np.arange(self.key_bits, dtype=np.int64))

    def probes(self, parts: np.ndarray) -> list[list[tuple[int, int, bool]]]:
        """Of each row the (table, key, own) of its own buckets and of those with a smaller key within `flips` bits."""
        masks = [sum(1 << k for k in some) for n in range(self.flips + 1) for some in combinations(range(self.key_bits), n)]
        return [[(t, p ^ m, m == 0) for t, p in enumerate(row) for m in masks if m == 0 or p ^ m < p] for row in parts.tolist()]


def likely_pairs(vectors: np.ndarray, labels: list[str], threshold: float, queries: int = 1000) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of vectors at the threshold or above: those of the sample by brute force, and if they are fewer than 100,
    vectors with partners made at random angles up to the threshold's."""
    x = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    label = np.unique(np.array(labels, dtype=object).astype(str), return_inverse=True)[1]
    left, right = [], []
    for a in range(0, min(queries, len(x)), 200):
        i, j = np.nonzero((x[a : a + 200] @ x.T >= threshold) & (label[a : a + 200, None] == label[None, :]))
        other = i + a != j
        left.append(x[i[other] + a])
        right.append(x[j[other]])
    left, right = np.concatenate(left), np.concatenate(right)
    if len(left) >= 100 or x.shape[1] < 2:
        return left, right
    rng = np.random.default_rng(12)
    base = x[rng.integers(0, len(x), queries)]
    side = rng.normal(size=base.shape)
    side -= (side * base).sum(axis=1, keepdims=True) * base
    side /= np.maximum(np.linalg.norm(side, axis=1, keepdims=True), 1e-12)
    cosine = rng.uniform(threshold, 1.0, (queries, 1))
    return np.concatenate([left, base]), np.concatenate([right, cosine * base + np.sqrt(1 - cosine**2) * side])


def learn_index(vectors: np.ndarray, labels: list[str], largest: int, threshold: float, recall: float = RECALL, bits: int = BITS) -> Index:
    """Rotations, each from a start of its own until there are `bits` bits, and as many flips as the recall asks for."""
    dims = vectors.shape[1]
    learned = [learn_rotation(vectors, min(bits, dims), seed=9 + k) for k in range(-(-bits // min(bits, dims)))]
    mean, projection = learned[0][0], np.concatenate([p for _, p in learned], axis=1)[:, :bits]
    key_bits = next(k for most, k in KEY_BITS if largest <= most)
    left, right = likely_pairs(vectors, labels, threshold)
    for flips in range(FLIPS + 1) if len(left) else ():
        index = Index(mean, projection, key_bits, projection.shape[1] // key_bits, flips, 0.0)
        near = np.bitwise_count(index.parts(left) ^ index.parts(right)) <= flips
        index.recall = float(near.any(axis=1).mean()) if index.tables else 0.0
        if index.recall >= recall:
            return index
    return Index(mean, projection, key_bits, 0, 0, 1.0)


def cosine_judge(threshold: float):
    """Which pairs of vectors (bytes of doubles) have at least this cosine, and their cosines."""

    def judge(left: list[bytes], right: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        a, b = (np.frombuffer(b"".join(x), "<f8").reshape(len(x), -1) for x in (left, right))
        cosine = (a @ b.T) / (np.sqrt((a * a).sum(axis=1))[:, None] * np.sqrt((b * b).sum(axis=1))[None, :])
        return cosine >= threshold, cosine

    return judge


def embedding_links(df: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", sample: int = SAMPLE, recall: float = RECALL) -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors of its label with at least this cosine), component_id, kept.

    Equal vectors of a label are one node with a number of copies. Each dimension is an index of its own: rotations are
    learned from at most `sample` nodes of it, those of the smallest hashes, and every node is indexed. Keys are longer
    where labels are larger; flips are added until the recall, measured on the sample against brute force, is reached,
    and where two flips don't reach it, a label is compared as a whole. Vectors of dimensions that aren't among the
    MODELS commonest are few and compared likewise. All pairs that meet are judged by cosine in double precision.

    Vectors without label, null or zero ones, and those with null or non-finite components link with nothing: 0 links,
    a component of their own. Null ids: null component, not kept, no links. Equal ids: each row counts for itself.
    Other columns are ignored. An empty table gives no rows.
    """
    spark = prepare(df.sparkSession)
    vector = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), vector.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("v", F.when(usable, F.transform("v", lambda x: x + F.lit(0.0))))
    name = lambda *x: F.when(F.col("v").isNotNull(), F.xxhash64(*x))
    rows, first = materialize(rows.withColumns({"hi": name("label", "v"), "lo": name(F.lit(1), F.size("v"), F.reverse("v"), "label")}), "vectors")
    usable_rows = rows.where("hi is not null")
    nodes = usable_rows.groupBy("hi", "lo").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("v").alias("v"))
    nodes, second = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    sizes = nodes.groupBy(F.size("v").alias("d"), "label").count().groupBy("d").agg(F.sum("count").alias("n"), F.max("count").alias("largest"))
    indexes = {}
    for r in sizes.orderBy(F.desc("n"), "d").limit(MODELS).collect():
        some = nodes.where(F.size("v") == r["d"]).orderBy(F.xxhash64("hi", F.lit(3))).limit(sample).select("v", "label").toLocalIterator()
        vectors, labels = zip(*((x["v"], x["label"]) for x in some))
        indexes[r["d"]] = learn_index(np.array(vectors), list(labels), r["largest"], threshold, recall)
    shared = spark.sparkContext.broadcast(indexes)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            names, vectors = b.column(0).to_pylist(), b.column(1).to_pylist()
            by: dict[int, list[int]] = {}
            for k, v in enumerate(vectors):
                by.setdefault(len(v), []).append(k)
            out = []
            for d, places in by.items():
                x, index = np.array([vectors[k] for k in places], dtype=np.float64), shared.value.get(d)
                parts = index.parts(x) if index else np.zeros((len(x), 1), np.int64)
                probes = index.probes(parts) if index and index.tables else [[(0, 0, True)]] * len(x)
                out += [(names[k], p.tolist(), index.flips if index else 0, [{"place": t, "raw": raw, "own": own} for t, raw, own in q], row.tobytes()) for k, p, q, row in zip(places, parts, probes, x)]
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.list_(pa.struct([("place", pa.int32()), ("raw", pa.int64()), ("own", pa.bool_())])), pa.binary())
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["node", "parts", "reach", "probes", "data"])

    schema = "node long, parts array<long>, reach int, probes array<struct<place:int,raw:bigint,own:boolean>>, data binary"
    coded, third = materialize(nodes.select("node", "v").mapInArrow(run, schema), "codes")
    whose = nodes.select("node", "copies", "label", F.size("v").alias("d"))
    members = coded.select("node", "parts", "reach").join(whose, "node")
    probing = coded.select("node", F.explode("probes").alias("p")).join(whose.select("node", "label", "d"), "node")
    met, member, plan, scratch = plan_groups(probing.select("node", F.col("p.place").alias("place"), F.xxhash64("label", "d", "p.raw").alias("key"), F.col("p.own").alias("own")))
    found, fourth = materialize(judged_links(met, member, plan, members, coded.select("node", "data"), cosine_judge(threshold)), "links")
    roots = components(found.select("node", "root"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.select("node", "hi", "lo", "id", "copies").join(links, "node", "left").join(roots, "node", "left")
    known, fifth = materialize(known.select("hi", "lo", "id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")), "known")
    smallest = known.groupBy("root").agg(F.min("id").alias("component_id"))
    per = known.join(smallest, "root").select("hi", "lo", "n_links", "component_id")
    linked = usable_rows.select("id", "hi", "lo").join(per, ["hi", "lo"]).select(F.col("id").alias("vec_id"), F.col("n_links").cast("long").alias("n_links"), "component_id")
    alone = rows.where("hi is null").select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    out, _ = materialize(out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))), "links")
    discard(spark, first, second, third, fourth, fifth, *scratch)
    return out


def op9_itq_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings, within labels, at cosine 0.93."""
    return embedding_links(table(spark, sf_dir, "embeddings"))


OP9_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS low FROM r GROUP BY x), n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
FROM embeddings LEFT JOIN c ON c.x = vec_id LEFT JOIN n ON n.x = vec_id
"""
