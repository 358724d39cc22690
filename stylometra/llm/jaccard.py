"""N-gram Jaccard join: MinHash LSH forest over sets of word shingles, then exact verification."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .links import components, judged_links, plan_groups
from .shared import HashedWords, SHINGLE_WORDS, SIMILARITY, discard, grouped, materialize, prepare, rolling, table, trimmed

#: tries, their depth, bits of a level's symbol, and the recall down to which prefixes are shortened
TREES, DEPTH, SYMBOL, RECALL = 16, 6, 21, 0.999


def meeting_chance(level: int, trees: int = TREES):
    """The chance that two sets of a similarity share a prefix of this many levels in a trie at least."""
    return lambda similarity: 1 - (1 - np.clip(similarity, 1e-9, 1.0) ** level) ** trees


def shortest_prefix(similarity: float, recall: float = RECALL) -> int:
    """The longest prefix at which even pairs at the threshold are met with a quarter of the misses allowed, or 1."""
    return next((k for k in range(DEPTH, 1, -1) if 1 - meeting_chance(k)(similarity) <= (1 - recall) / 4), 1)


def shingles(hashes: np.ndarray, n: int = SHINGLE_WORDS) -> np.ndarray:
    """The sorted distinct hashes of all runs of n words; a text of fewer words is one shingle of all of them."""
    if len(hashes) < n:
        return rolling(hashes, len(hashes)) if len(hashes) else np.empty(0, np.uint64)
    return np.unique(rolling(hashes, n))


def minhashes(values: np.ndarray, odd: np.ndarray) -> np.ndarray:
    out = np.full(len(odd), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for a in range(0, len(values), 4096):
            v = values[a : a + 4096, None] * odd[None, :]
            v ^= v >> np.uint64(32)
            np.minimum(out, (v * np.uint64(0xD6E8FEB86659FD93)).min(axis=0), out=out)
    return out


def set_name(values: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set of shingles."""
    import xxhash

    name = xxhash.xxh3_128_intdigest(values.astype("<u8").tobytes(), seed=len(values))
    return (name >> 64) - (1 << 63), (name & ((1 << 64) - 1)) - (1 << 63)


def signatures(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, hi, lo (128 bits of the hash of the shingle set; null without words), paths: two longs for each trie, that
    hold the DEPTH symbols from the root to the set's leaf, so that numbers in order are prefixes in order."""

    def run(batches):
        import pyarrow as pa

        hashed = HashedWords()
        odd = np.random.default_rng(41).integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        half = DEPTH // 2
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            names, paths = [], []
            for group in grouped(texts, [len(t or "") for t in texts], 4_000_000):
                for h in hashed.many(group):
                    found = shingles(h)
                    if not len(found):
                        names.append((None, None))
                        paths.append(None)
                        continue
                    names.append(set_name(found))
                    symbols = (minhashes(found, odd) >> np.uint64(64 - SYMBOL)).astype(np.int64).reshape(TREES * 2, half)
                    path = np.zeros(TREES * 2, np.int64)
                    for k in range(half):
                        path = (path << SYMBOL) | symbols[:, k]
                    paths.append(path)
            columns = [pa.array(ids, pa.int64()), *(pa.array(x, pa.int64()) for x in zip(*names)), pa.array(paths, pa.list_(pa.int64()))]
            if names:
                yield pa.record_batch(columns, names=["id", "hi", "lo", "paths"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(trimmed(run), "id long, hi long, lo long, paths array<long>")


def prefixes(level: int):
    """One long for each trie: the prefix of this many levels of the path there."""
    half = DEPTH // 2
    cut = lambda x, k: F.shiftright(x, SYMBOL * (half - k)) if k < half else x
    one = lambda i: F.get("paths", 2 * i)
    two = lambda i: F.get("paths", 2 * i + 1)
    if level <= half:
        return F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda i: cut(one(i), level))
    return F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda i: F.xxhash64(one(i), cut(two(i), level - half)))


def sets(df: DataFrame, text_col: str) -> DataFrame:
    """hi, lo and the shingle set as bytes, of texts with words."""

    def run(batches):
        import pyarrow as pa

        hashed = HashedWords()
        for b in batches:
            texts = b.column(0).to_pylist()
            for group in grouped(texts, [len(t or "") for t in texts], 4_000_000):
                found = [x for x in map(shingles, hashed.many(group)) if len(x)]
                if found:
                    hi, lo = zip(*map(set_name, found))
                    yield pa.record_batch([pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array([x.astype("<u8").tobytes() for x in found], pa.binary())], names=["hi", "lo", "data"])

    return df.select(F.col(text_col).alias("text")).mapInArrow(trimmed(run), "hi long, lo long, data binary")


def jaccard_judge(similarity: float):
    """Which pairs of sets have at least this Jaccard similarity, exactly, and how similar they are."""

    def judge(left: list[bytes], right: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        a, b = ([np.frombuffer(x, "<u8") for x in side] for side in (left, right))
        na, nb = (np.array([len(x) for x in side]) for side in (a, b))
        if len(a) * len(b) <= 16:
            shared = np.array([[len(np.intersect1d(x, y, assume_unique=True)) if similarity * max(len(x), len(y)) <= min(len(x), len(y)) else 0 for y in b] for x in a])
        else:
            values, at = np.unique(np.concatenate([*a, *b]), return_inverse=True)
            row = np.repeat(np.arange(len(a) + len(b)), np.concatenate([na, nb]))
            often = np.bincount(at, minlength=len(values)) > 1
            place = np.cumsum(often) - 1
            use = often[at]
            at, row, width = place[at[use]], row[use], int(often.sum())
            order = np.argsort(at, kind="stable")
            at, row = at[order], row[order]
            shared = np.zeros((len(a), len(b)), np.float32)
            for c in range(0, width, 2048):
                lo, hi = np.searchsorted(at, [c, c + 2048])
                x = np.zeros((len(a) + len(b), min(2048, width - c)), np.float32)
                x[row[lo:hi], at[lo:hi] - c] = 1
                shared += x[: len(a)] @ x[len(a) :].T
        either = na[:, None] + nb[None, :] - shared
        return shared >= similarity * either - 1e-9, shared / either

    return judge


def forest_links(nodes: DataFrame, payload: DataFrame, similarity: float, recall: float = RECALL) -> tuple[DataFrame, list[str], float, int]:
    """Links of nodes (node, copies, paths), found in the forest: per node and root as judged_links has them, the
    scratch tables to discard later, the recall measured, and the level at which the search ended.

    All tries begin with whole paths: what shares one is compared exactly. Then matched prefixes are shortened by a level,
    and the components that grew are compared anew, until the recall is reached: the links seen so far, each divided by
    the chance that the forest shows a pair of its similarity at this level, say how many there are in all.
    """
    spark = nodes.sparkSession
    found = reached = done = None
    levels = [*range(DEPTH, shortest_prefix(similarity, recall) - 1, -1)]
    for at, level in enumerate(levels):
        at_level = nodes.select("node", "copies", prefixes(level).alias("parts"), F.lit(0).alias("reach"))
        rows = at_level.select("node", F.posexplode("parts").alias("place", "key"), F.lit(True).alias("own"))
        met, member, plan, scratch = plan_groups(rows)
        todo = plan if done is None else plan.join(done, ["root", "c", "x"], "left_anti")
        links = judged_links(met, member, todo, at_level, payload, jaccard_judge(similarity), [meeting_chance(k) for k in levels[at:]])
        if found is not None:
            same = member.join(plan.join(done, ["root", "c", "x"], "left_semi").select("root"), "root", "left_semi").select("node")
            kept = found.join(same, "node", "left_semi").drop("w0").withColumnsRenamed({f"w{k}": f"w{k - 1}" for k in range(1, len(levels) - at + 1)})
            links = links.unionByName(kept)
        found, path = materialize(links, "links")
        seen = found.agg(F.sum("pairs").alias("pairs"), F.sum("w0").alias("weight")).first()
        if reached is not None:
            discard(spark, *reached)
        reached, done = [path, *scratch], plan.where("whole").select("root", "c", "x")
        share = min(1.0, (seen["pairs"] or 0) / seen["weight"]) if seen["weight"] else 1.0
        if share >= recall and (seen["pairs"] or meeting_chance(level)(similarity) >= recall):
            break
    return found, reached, share, level


def jaccard_join(df: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id (smallest id reachable by links, its own included), n_links (other documents
    with a similarity of at least the threshold), set_id (smallest id with the same shingle set).

    Documents with equal shingle sets (128 bits of their hash) are one node with a number of copies; nodes meet in the
    forest, and each pair that meets is verified once on the sets of 64-bit shingle hashes. Null texts and texts without
    words have no links: they are classes of their own. A null id has a null class and no links, and isn't counted.
    Repeated rows count as documents of their own. Other columns are ignored. An empty table gives no rows.
    """
    spark = prepare(df.sparkSession)
    signed, first = materialize(signatures(df, id_col, text_col), "signatures")
    there = signed.where("id is not null and hi is not null")
    named = there.groupBy("hi", "lo").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("paths").alias("paths"))
    nodes, second = materialize(named.withColumn("node", F.monotonically_increasing_id()), "nodes")
    met = nodes.select("node", F.posexplode(prefixes(shortest_prefix(similarity))).alias("place", "key"))
    several = met.groupBy("place", "key").agg(F.count("*").alias("n")).where("n > 1")
    company, third = materialize(met.join(several, ["place", "key"], "left_semi").select("node").distinct(), "company")
    wanted = nodes.join(company, "node", "left_semi")
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(wanted.select("id").distinct(), "id", "left_semi")
    payload, fourth = materialize(sets(texts, "text").join(wanted.select("hi", "lo", "node"), ["hi", "lo"]).dropDuplicates(["node"]).select("node", "data"), "sets")
    found, scratch, _, _ = forest_links(wanted, payload, similarity)
    roots = components(found.select("node", "root"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.select("node", "hi", "lo", F.col("id").alias("set_id"), "copies").join(links, "node", "left").join(roots, "node", "left")
    known = known.select("hi", "lo", "set_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    known, fifth = materialize(known, "known")
    smallest = known.groupBy("root").agg(F.min("set_id").alias("class_id"))
    per = known.join(smallest, "root").select("hi", "lo", "class_id", "set_id", "n_links")
    classed = there.join(per, ["hi", "lo"]).select(F.col("id").alias("doc_id"), "class_id", F.col("n_links").cast("long").alias("n_links"), "set_id")
    alone = signed.where("id is null or hi is null").select(F.col("id").alias("doc_id"), F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("set_id"))
    out, _ = materialize(classed.unionByName(alone), "classes")
    discard(spark, first, second, third, fourth, fifth, *scratch)
    return out


def op8_minhash_forest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes and link counts of all documents."""
    return jaccard_join(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(2, len(w) - 3)), lambda k: array_to_string(w[k : k + 4], ' ')))) AS s FROM w WHERE len(w) > 0),
n AS (SELECT s, min(doc_id) AS set_id, count(*) AS copies FROM s GROUP BY s),
u AS (SELECT set_id, len(s) AS n, unnest(s) AS x FROM n),
j AS (SELECT a.set_id AS x, b.set_id AS y, count(*) AS c, any_value(a.n) AS p, any_value(b.n) AS q FROM u a JOIN u b ON a.x = b.x AND a.set_id <> b.set_id GROUP BY a.set_id, b.set_id),
l AS (SELECT x, y FROM j WHERE c >= 0.8 * (p + q - c) - 1e-9),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS low FROM r GROUP BY x),
k AS (SELECT l.x, CAST(sum(copies) AS BIGINT) AS links FROM l JOIN n ON n.set_id = l.y GROUP BY l.x)
SELECT d.doc_id, coalesce(least(n.set_id, c.low), n.set_id, d.doc_id) AS class_id, coalesce(k.links, 0) + coalesce(n.copies, 1) - 1 AS n_links, coalesce(n.set_id, d.doc_id) AS set_id
FROM documents d LEFT JOIN s USING (doc_id) LEFT JOIN n ON n.s = s.s LEFT JOIN c ON c.x = n.set_id LEFT JOIN k ON k.x = n.set_id
"""
