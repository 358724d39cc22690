"""Stateless and windowed scans of streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def scanned(stream: DataFrame) -> DataFrame:
    """Words and fingerprint of each document of a stream; the same plan as for a table."""
    return stream.select("doc_id", F.size(T.words(F.col("text"))).cast("long").alias("n_words"), T.fingerprint(F.col("text")).alias("fingerprint"))


def run_once(spark: SparkSession, source: str, schema, out: str, checkpoint: str) -> None:
    """All that is new in a folder of Parquet files, scanned and appended to out, once."""
    query = scanned(spark.readStream.schema(schema).parquet(source)).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
