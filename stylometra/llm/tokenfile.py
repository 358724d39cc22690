"""Token files: documents' ids in ascending doc_id order as rANS blocks in Parquet shards, written and read in parallel."""

from __future__ import annotations

import uuid
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .encoding import encoder, vocabulary
from .rans import Table, blocks, decode
from .shared import discard, grouped, materialize, partitions, prepare, shared_dir, table, trimmed

BLOCK = 1 << 17
SHARD = "shard int, first long, doc_ids array<long>, lengths array<long>, block binary"


def width(path: str, end_id: int | None) -> str:
    """The type that scratch tables keep ids in."""
    return "<u2" if max(encoder(path).size, end_id or 0) < 1 << 16 else "<u4"


def tokenize(df: DataFrame, path: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids in the type of width()) of each row, and one row per task with the counts of all ids it saw (counts binary, int64)."""

    kind = width(path, end_id)

    def run(batches):
        import pyarrow as pa

        encode = encoder(path)
        ending = b"" if end_id is None else int(end_id).to_bytes(4, "little")
        counts = np.zeros(encode.size + 1, dtype=np.int64)
        out = lambda ids, found, seen: pa.record_batch([pa.array(ids, pa.int64()), pa.array(found, pa.binary()), pa.array(seen, pa.binary())], names=["doc_id", "ids", "counts"])
        for b in batches:
            names, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for group in grouped([*zip(names, texts)], [len(t or "") for t in texts], 4_000_000):
                found = [x + ending for x in encode.many([t for _, t in group])]
                ids = np.frombuffer(b"".join(found), "<u4")
                seen = np.bincount(ids, minlength=len(counts))
                counts = seen + np.pad(counts, (0, len(seen) - len(counts)))
                yield out([i for i, _ in group], [np.frombuffer(x, "<u4").astype(kind).tobytes() for x in found] if kind != "<u4" else found, [None] * len(group))
        yield out([None], [None], [counts.astype("<i8").tobytes()])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(trimmed(run), "doc_id long, ids binary, counts binary")


def frequencies(tokens: DataFrame) -> Table:
    """One table for all blocks; what reaches the driver is one number per id of the vocabulary."""

    def run(batches):
        import pyarrow as pa

        total = None
        for b in batches:
            for x in b.column(0).to_pylist():
                x = np.frombuffer(x, "<i8")
                total = x.copy() if total is None else total + x
        if total is not None:
            used = np.flatnonzero(total)
            yield pa.record_batch([pa.array(used), pa.array(total[used])], names=["id", "n"])
            yield pa.record_batch([pa.array([len(total) - 1]), pa.array([0])], names=["id", "n"])

    counted = tokens.where("counts is not null").select("counts").mapInArrow(trimmed(run), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(counted["id"].max()) + 1 if len(counted) else 1, dtype=np.int64)
    counts[counted["id"].to_numpy(dtype=np.int64)] = counted["n"].to_numpy(dtype=np.int64)
    return Table(counts)


def write(df: DataFrame, out: str, path: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> None:
    """Write df's texts as a token file: out/shards (SHARD rows) and out/table (id, frequency).

    Texts are encoded once into a table in the shared folder, together with the counts; then rows are dealt by ranges of
    doc_id (ties by their ids' hash, so that a doc_id that many rows share splits) and each shard is coded in one pass.
    Null text: empty. Null doc_id: first. Equal doc_id: in the order of a hash of the ids. Other columns are ignored.
    """
    spark = prepare(df.sparkSession)
    tokens, scratch = materialize(tokenize(df, path, end_id, id_col, text_col), "tokens")
    freq = frequencies(tokens)
    counts = freq.freq.astype(np.int64)
    used = np.flatnonzero(counts)
    spark.createDataFrame([(int(i), int(counts[i])) for i in used], "id int, frequency int").coalesce(1).write.parquet(f"{out}/table")

    kind = width(path, end_id)

    def code(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        rows = ((i, x) for b in batches for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        for first, names, lengths, data in blocks(rows, Table(counts), block, kind):
            yield pa.record_batch([pa.array([shard], pa.int32()), pa.array([first]), pa.array([names], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())), pa.array([data], pa.binary())], names=[x.split()[0] for x in SHARD.split(", ")])

    rows = tokens.where("counts is null").select("doc_id", "ids", F.xxhash64("ids").alias("tie"))
    dealt = rows.repartitionByRange(partitions(spark), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    dealt.select("doc_id", "ids").mapInArrow(trimmed(code), SHARD).write.option("compression", "uncompressed").parquet(f"{out}/shards")
    discard(spark, scratch)


def read(spark: SparkSession, out: str) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit bytes).

    Every block is decoded and checked on its own, in any task; the driver only sums one number per shard.
    """
    prepare(spark)
    kept = spark.read.parquet(f"{out}/table").toPandas()
    counts = np.zeros(int(kept["id"].max()) + 1 if len(kept) else 1, dtype=np.int64)
    counts[kept["id"].to_numpy(dtype=np.int64)] = kept["frequency"].to_numpy(dtype=np.int64)
    shards = spark.read.schema(SHARD).parquet(f"{out}/shards")
    sizes = sorted((r["shard"], r["n"]) for r in shards.groupBy("shard").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).collect())
    begins = dict(zip([s for s, _ in sizes], accumulate((n for _, n in sizes), initial=0)))

    def run(batches):
        import pyarrow as pa

        freq = Table(counts)
        for b in batches:
            for shard, first, names, lengths, block in zip(*(b.column(k).to_pylist() for k in range(5))):
                ids = decode(block, freq).astype("<u4").tobytes()
                at = [*accumulate(lengths, initial=0)]
                if at[-1] * 4 != len(ids):
                    raise ValueError("a block's lengths don't sum to its ids")
                starts = [begins[shard] + first + a for a in at[:-1]]
                yield pa.record_batch([pa.array(names, pa.int64()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array([ids[4 * a : 4 * z] for a, z in zip(at, at[1:])], pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return shards.mapInArrow(trimmed(run), "doc_id long, start long, n_tokens long, ids binary")


def op3_rans_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents' ids as a token file in the shared folder, read it back and return a digest per document."""
    docs = table(spark, sf_dir, "documents")
    out = f"{shared_dir(spark)}/token-file-{uuid.uuid4().hex}"
    write(docs, out, vocabulary("word_bpe_49k.json"), 2)
    return read(spark, out).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
