"""Vector code compression: product codes by Lloyd's rounds in integers, with Hamerly's two bounds for each part."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import discard, materialize, table
from .vectors import products, whole_vectors

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: bounds are widened by this share, far more than the rounding of square roots and sums
SLACK = 1e-12
#: rows of totals by label that are broadcast; beyond it labels are joined by a shuffle in so many salted parts
FEW_LABELS, SALTS = 100_000, 16
STATE = "row long, id long, label string, dims int, v binary, code binary, upper binary, lower binary, scans int, error long"


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of integer rows to entries, exact."""
    dots = products(x, entries)
    kind = dots.dtype
    return (x * x).sum(axis=1)[:, None].astype(kind) - 2 * dots + (entries * entries).sum(axis=1)[None, :].astype(kind)


class Rounds:
    """One round's codebook [parts, entries, width] and how far its entries have moved since the round before."""

    def __init__(self, book: np.ndarray, before: np.ndarray | None):
        self.book, self.moves, self.parts = book, None, len(book)
        gaps = np.stack([distances(c, c).astype(float) for c in book])
        gaps[:, np.arange(book.shape[1]), np.arange(book.shape[1])] = np.inf
        self.half = np.sqrt(gaps.min(axis=2)) / 2 * (1 - SLACK)
        if before is not None:
            self.moves = np.sqrt(((book - before) ** 2).sum(axis=2).astype(float)) * (1 + SLACK)
            top = np.argsort(self.moves, axis=1)
            self.most, second = top[:, -1], top[:, -2] if book.shape[1] > 1 else top[:, -1]
            self.far = self.moves[np.arange(self.parts), self.most]
            self.next = self.moves[np.arange(self.parts), second]

    def assign(self, x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Assign x [rows, parts, width]; code and bounds [rows, parts] are changed in place. Returns full scans by row.

        The upper bound is that of the distance to the own entry, the lower one that of the distance to any other. A
        part keeps its entry only where the upper bound is strictly below the lower one or half the way to the nearest
        other entry, so an equal distance to an entry of lower index is never overlooked.
        """
        scans = np.zeros(len(x), np.int32)
        for p in range(self.parts):
            rows = np.arange(len(x))
            if self.moves is not None:
                own = code[:, p]
                upper[:, p] = (upper[:, p] + self.moves[p][own]) * (1 + SLACK)
                lower[:, p] = (lower[:, p] - np.where(own == self.most[p], self.next[p], self.far[p])) * (1 - SLACK)
                limit = np.maximum(lower[:, p], self.half[p][own])
                rows = np.flatnonzero(~(upper[:, p] < limit))
                exact = ((x[rows, p] - self.book[p][own[rows]]) ** 2).sum(axis=1)
                upper[rows, p] = np.sqrt(exact.astype(float)) * (1 + SLACK)
                rows = rows[~(upper[rows, p] < limit[rows])]
            if not len(rows):
                continue
            d = distances(x[rows, p], self.book[p])
            best = d.argmin(axis=1)
            code[rows, p] = best
            d = d.astype(float)
            upper[rows, p] = np.sqrt(d[np.arange(len(rows)), best]) * (1 + SLACK)
            d[np.arange(len(rows)), best] = np.inf
            lower[rows, p] = np.sqrt(d.min(axis=1)) * (1 - SLACK)
            scans[rows] += 1
        return scans


def assigned(state: DataFrame, book: np.ndarray, before: np.ndarray | None) -> DataFrame:
    """state after one more assignment; codes and bounds of the round before are read from it, unless it is the first."""

    def run(batches):
        import pyarrow as pa

        now, (parts, _, width) = Rounds(book, before), book.shape
        for b in batches:
            n = b.num_rows
            get = lambda k, kind: np.frombuffer(b"".join(b.column(k).to_pylist()), kind).reshape(n, parts).copy()  # noqa: B023, E731
            x = np.frombuffer(b"".join(b.column(4).to_pylist()), "<i8").reshape(n, parts, width)
            code, upper, lower = (np.zeros((n, parts), np.uint8), *np.zeros((2, n, parts))) if before is None else (get(5, np.uint8), get(6, "<f8"), get(7, "<f8"))
            scans = now.assign(x, code, upper, lower)
            if before is not None:
                scans += np.array(b.column(8).to_pylist(), np.int32)
            error = ((x - book[np.arange(parts), code]) ** 2).sum(axis=(1, 2))
            packed = [pa.array([r.tobytes() for r in y], pa.binary()) for y in (code, upper.astype("<f8"), lower.astype("<f8"))]
            yield pa.record_batch([*(b.column(k) for k in range(5)), *packed, pa.array(scans, pa.int32()), pa.array(error, pa.int64())], names=[c.split()[0] for c in STATE.split(", ")])

    return state.mapInArrow(run, STATE)


def totals(state: DataFrame, shape: tuple[int, int, int]) -> list:
    """(part, entry, place, n, total) of all entries in use: summed in each task first, then over tasks."""

    def run(batches):
        import pyarrow as pa

        counts, sums = np.zeros(shape[:2], np.int64), np.zeros(shape, np.int64)
        for b in batches:
            code = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(-1, shape[0])
            x = np.frombuffer(b"".join(b.column(1).to_pylist()), "<i8").reshape(-1, shape[0], shape[2])
            for p in range(shape[0]):
                np.add.at(counts[p], code[:, p], 1)
                np.add.at(sums[p], code[:, p], x[:, p])
        p, e, k = (y.ravel() for y in np.indices(shape))
        used = counts[p, e] > 0
        yield pa.record_batch([pa.array(y[used]) for y in (p, e, k, counts[p, e], sums.ravel())], names=["part", "entry", "place", "n", "total"])

    each = state.select("code", "v").mapInArrow(run, "part long, entry long, place long, n long, total long")
    return each.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()


def product_codes(df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per usable vector: vec_id, code, error, label_error, codebooks_sha256, scans (full scans made for it).

    Components become floor(scale * x). Each part's codebook starts as that part of the vectors of the smallest ids
    (ties by the vector); each round assigns all parts and replaces an entry by the componentwise floor of its parts'
    mean; entries in no use stay. Vector, codes and both bounds of each part are written after each round to the shared
    folder, and the next round reads them: a lost executor repeats its part of one round only. The driver sees the
    first codebook and sums for each place of a codebook, whatever the table's size.

    Null and non-finite vectors are left out. Null ids are coded, but start no codebook. Vectors of another length than
    that of the smallest id get null code and error. Fewer rows than entries: fewer entries. Repeated rows are coded
    alike. An empty table gives no rows. A length that can't be cut into equal parts is an error. Other columns are
    ignored.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code of one byte has 1 to 256 entries")
    rows = whole_vectors(df, id_col, vector_col, F.col(label_col), scale).withColumn("row", F.monotonically_increasing_id())
    rows, scratch = materialize(rows.where("dims > 0"), "whole")
    spark, old = df.sparkSession, [scratch]
    smallest = rows.where("id is not null").orderBy("id", "v").select("dims").first()
    dims = smallest["dims"] if smallest else 0
    if dims % parts:
        raise ValueError(f"{dims} components can't be cut into {parts} equal parts")
    first = rows.where((F.col("dims") == dims) & F.col("id").isNotNull()).orderBy("id", "v").select("v").limit(entries).collect()
    named = F.col("id").alias("vec_id")
    none = rows.where(F.col("dims") != dims).select(named, F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"), "label", F.lit(0).alias("scans"))
    coded, digest = none.limit(0), hashlib.sha256(b"").hexdigest()
    if first:
        book = np.stack([np.frombuffer(r["v"], "<i8") for r in first]).reshape(len(first), parts, dims // parts).transpose(1, 0, 2)
        empty = {"code": "binary", "upper": "binary", "lower": "binary", "scans": "int", "error": "long"}
        state = rows.where(F.col("dims") == dims).select("row", "id", "label", "dims", "v", *(F.lit(None).cast(t).alias(c) for c, t in empty.items()))
        before = None
        for k in range(rounds + 1):
            state, scratch = materialize(assigned(state, book, before), f"codes{k}")
            discard(spark, *old[1:])
            old[1:] = [scratch]
            if k < rounds:
                before, book = book, book.copy()
                for r in totals(state, book.shape):
                    book[r["part"], r["entry"], r["place"]] = r["total"] // r["n"]
        coded = state.select(named, F.lower(F.hex("code")).alias("code"), "error", "label", "scans")
        digest = hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()
    out, scratch = materialize(with_label_errors(coded.unionByName(none)).withColumn("codebooks_sha256", F.lit(digest)), "coded")
    discard(spark, *old)
    return out


def with_label_errors(coded: DataFrame) -> DataFrame:
    """label_error: error summed over equal labels, nulls together. Totals are few and broadcast, unless they are counted
    to be many; then rows of a label are spread over SALTS tasks."""
    sums, _ = materialize(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label_errors")
    sums = sums.withColumnRenamed("label", "_label")
    same = F.col("label").eqNullSafe(F.col("_label"))
    if sums.count() <= FEW_LABELS:
        joined = coded.join(F.broadcast(sums), same, "left")
    else:
        many = sums.withColumn("_salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
        salted = coded.withColumn("_s", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
        joined = salted.join(many, same & (F.col("_s") == F.col("_salt")), "left").drop("_s", "_salt")
    return joined.select("vec_id", "code", "error", "label_error", "scans")


def op12_hamerly_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings: 16 parts, 64 entries, 2 rounds."""
    return product_codes(table(spark, sf_dir, "embeddings")).drop("scans")


def _assignment(k: int) -> str:
    """CTEs: the nearest entry of every part in codebook b{k}, and codebook b{k + 1} of their floored means."""
    return f"""
d{k} AS (
  SELECT r, x.p, q, e, list_sum(list_transform(list_zip(q, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM x JOIN b{k} b ON x.p = b.p
), a{k} AS MATERIALIZED (SELECT r, p, any_value(q) AS q, arg_min(e, (d, e)) AS e, min(d) AS d FROM d{k} GROUP BY r, p),
m{k} AS (
  SELECT p, e, list(m ORDER BY i) AS c FROM (
    SELECT p, e, i, floor(sum(q[i])::DOUBLE / count(*))::BIGINT AS m FROM (SELECT p, e, q, unnest(range(1, len(q) + 1)) AS i FROM a{k}) GROUP BY p, e, i
  ) GROUP BY p, e
), b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN m{k} m ON m.p = b.p AND m.e = b.e)"""


OP12_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda y: floor(256 * CAST(y AS DOUBLE))::BIGINT) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0
), x AS MATERIALIZED (SELECT r, p, w[p * (len(w) // 16) + 1 : (p + 1) * (len(w) // 16)] AS q FROM v, range(16) t(p)),
b0 AS MATERIALIZED (SELECT p, r - 1 AS e, q AS c FROM x WHERE r <= 64), {_assignment(0)}, {_assignment(1)},
{_assignment(2).rsplit("m2 AS", 1)[0].rstrip().rstrip(",")},
c AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM b2) AS codebooks_sha256
FROM c JOIN v USING (r)
"""
