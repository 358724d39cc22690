"""Sources: Parquet tables, whole text files, JSON lines, and files of highlighted pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its rows are in fewer tasks: a row group can't be split, so a scan of it keeps one core busy,
    however many partitions its file is cut into.

    How many rows the partitions have is read from the footers of the files. Tables in which no partition has more than
    twice a core's share stay as they are, as large ones do.
    """
    cores, parts = df.sparkSession.sparkContext.defaultParallelism, df._jdf.queryExecution().toRdd().getNumPartitions()
    if parts >= cores:
        counted = df.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n"))
        most, total = counted.agg(F.max("n"), F.sum("n")).first()
        if (most or 0) * cores <= 2 * (total or 0):
            return df
    return df.repartition(max(cores, parts))


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """One document per file, without a byte order mark."""
    return spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^﻿", "").alias("text"))


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """id and text of JSON lines; a line that is no object with a string `text` stops the read."""
    return spark.read.schema("id string, text string").option("mode", "FAILFAST").json(path)


def parsed(line: Column) -> Column:
    """The JSON object of a line, null if it has none."""
    return F.from_json(line, "map<string,string>", {"mode": "PERMISSIVE"})


def marked_pieces(text: Column) -> Column:
    """Highlighted pieces of a file: parts between blank lines, blank ones left out."""
    return F.filter(F.transform(F.split(text, r"\n[ \t]*\n"), lambda x: F.trim(x)), lambda x: x != "")


def red_pieces(raw: Column, least: int = 3) -> Column:
    """Texts of a heat map (JSON array of level, text, pages) at or above a level."""
    items = F.from_json(raw, "array<struct<level:int,text:string,pages:array<int>>>")
    return F.transform(F.filter(items, lambda x: x["level"] >= least), lambda x: x["text"])
