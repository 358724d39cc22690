"""What the training-data operators share: shared-storage scratch tables, worker imports and word splitting."""

from __future__ import annotations

import functools
import gc
import re
import sys
import tempfile
import uuid
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import spread

ROOT = str(Path(__file__).resolve().parents[2])
SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: rows and bytes of one Arrow batch: texts are long, and the JVM and the worker each hold whole batches
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8388608"}
WORD = re.compile(r"\w+")


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package wherever the driver was started; small Arrow batches, unless the application's settings name others."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", ""):
        env["PYTHONPATH"] = ":".join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    given = spark.sparkContext.getConf()
    for key, most in BATCH.items():
        if not given.contains(key) and spark.conf.get(key) != most:
            spark.conf.set(key, most)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet"))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session. A temporary one where it is unset and all
    runs on this machine; an error on a cluster, where executors would write to disks of their own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="stylometra-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df as Parquet to the shared folder and read it again: lineage ends there and a lost executor costs nothing."""
    spark = df.sparkSession
    release(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(spark: SparkSession, *paths: str) -> None:
    """Remove scratch tables that no later plan reads."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def trimmed(run):
    """run, after which a Python worker gives the memory of its batches back; idle workers would hold it otherwise."""

    def whole(batches):
        yield from run(batches)
        import ctypes

        import pyarrow as pa

        gc.collect()
        pa.default_memory_pool().release_unused()
        getattr(ctypes.CDLL(None), "malloc_trim", int)(0)

    return whole


class HashedWords:
    """Texts as arrays of 64-bit hashes (xxh64 of UTF-8) of their lower-cased words (runs of letters, digits and underscores).

    Words of all texts of a call are found and hashed by array operations; only those of 32 bytes and more go to the library.
    """

    def many(self, texts: list[str | None]) -> list[np.ndarray]:
        raw = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
        data = b"\n".join([b"", *raw, b"\n" * 8])
        begins = np.cumsum([1, *(len(r) + 1 for r in raw)])
        edges = np.flatnonzero(np.diff(in_words(np.frombuffer(data, np.uint8)))) + 1
        starts, ends = edges[::2], edges[1::2]
        hashes = hashed(data, starts, ends - starts)
        at = np.searchsorted(starts, begins).tolist()
        return [hashes[x:y] for x, y in zip(at, at[1:])]


@functools.cache
def word_signs() -> np.ndarray:
    """For every code point, whether it is part of words."""
    return np.array([c == 95 or chr(c).isalnum() for c in range(sys.maxunicode + 1)])


def in_words(data: np.ndarray) -> np.ndarray:
    """For every byte of UTF-8, whether it is of a sign that is part of words."""
    signs = word_signs()
    inside = np.concatenate([signs[:128], np.ones(128, bool)])[data]
    lead = np.flatnonzero(data >= 0xC0)
    size = 2 + (data[lead] >= 0xE0) + (data[lead] >= 0xF0)
    for n in (2, 3, 4):
        at = lead[size == n]
        code = data[at].astype(np.int64) & (0xFF >> (n + 1))
        for k in range(1, n):
            code = code << 6 | data[at + k] & 0x3F
        inside[(at[~signs[code]][:, None] + np.arange(n)).ravel()] = False
    return inside


PRIMES = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def hashed(data: bytes, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """xxh64 of each of these parts of data; at least 8 more bytes follow the last part."""
    import xxhash

    one, two, three, four, five = PRIMES
    turned = lambda x, n: x << np.uint64(n) | x >> np.uint64(64 - n)
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))  # the eight bytes from each place
    h = lengths.astype(np.uint64) + five
    for k in range(3):
        on = np.flatnonzero((lengths >= 8 * (k + 1)) & (lengths < 32))
        h[on] = turned(h[on] ^ turned(eight[starts[on] + 8 * k] * two, 31) * one, 27) * one + four
    rest = lengths & 7
    tail = eight[starts + lengths - rest]
    on = np.flatnonzero(rest & 4)
    h[on] = turned(h[on] ^ (tail[on] & np.uint64(0xFFFFFFFF)) * one, 23) * two + three
    tail[on] >>= np.uint64(32)
    for k in range(3):
        on = np.flatnonzero((rest & 3) > k)
        h[on] = turned(h[on] ^ (tail[on] >> np.uint64(8 * k) & np.uint64(0xFF)) * five, 11) * one
    for shift, by in ((33, two), (29, three)):
        h = (h ^ h >> np.uint64(shift)) * by
    h ^= h >> np.uint64(32)
    for k in np.flatnonzero(lengths >= 32).tolist():
        h[k] = xxhash.xxh64_intdigest(data[starts[k] : starts[k] + lengths[k]])
    return h


def words(text: str | None) -> list[str]:
    """The words that HashedWords hashes: of each piece between blanks, in lower case."""
    return [w for p in (text or "").split(" ") for w in WORD.findall(p.lower())]


def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each n consecutive values."""
    m = len(hashes) - n + 1
    if m < 1:
        return np.empty(0, np.uint64)
    out = np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = (out ^ hashes[k : k + m]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out


def grouped(items: list, sizes: list[int], most: int):
    """Consecutive groups of items of about `most` in size, so that one batch of long rows doesn't multiply in memory."""
    begin = total = 0
    for k, n in enumerate(sizes):
        if total and total + n > most:
            yield items[begin:k]
            begin, total = k, 0
        total += n
    if begin < len(items):
        yield items[begin:]
