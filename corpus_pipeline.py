"""A corpus pipeline of five operators: language, near-duplicates, benchmark passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as Parquet and read again as
the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stylometra.llm.decontamination import clean
from stylometra.llm.encoding import vocabulary
from stylometra.llm.jaccard import jaccard_join
from stylometra.llm.language import UNKNOWN, learn, predict, sample
from stylometra.llm.packing import Limits, pack
from stylometra.llm.pseudonyms import pseudonymize, secret
from stylometra.llm.shared import materialize, prepare, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: documents whose words belong to one language by less than this are rejected
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters whose language is clear; lang becomes the predicted one."""
    found = predict(prepare(spark) and docs.select(*COLUMNS), learn(sample(docs)))
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicate texts: the one with the smallest id, a null id last.

    Rows are told apart by a number of their own, not by doc_id: of repeated rows one stays, rows of one id with texts of
    different classes are judged apart, and rows without id take part. Among rows of one id in a class the smallest hash
    of the text decides, then the other columns. Null texts and texts without words stay.
    """
    ids = docs.select(*COLUMNS).withColumns({"_row": F.monotonically_increasing_id(), "_hash": F.xxhash64("text")})
    rows, _ = materialize(ids, "rows")  # the numbers hold only once they are written
    linked = jaccard_join(rows, id_col="_row").where("n_links > 0").select(F.col("doc_id").alias("_row"), "class_id")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_hash", "lang", "source", "n_chars", "_row")
    first = rows.drop("text").join(linked, "_row").groupBy("class_id").agg(F.min(order).alias("first")).select(F.col("first._row").alias("_row"))
    gone = linked.select("_row").join(first, "_row", "left_anti")
    return rows.join(gone, "_row", "left_anti").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark passage."""
    return clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms; n_chars counts the new text."""
    return pseudonymize(docs, secret(spark)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens: one row per piece, with its ids."""
    return pack(docs, Limits(), vocabulary("byte_bpe_50k.json"))


STAGES = [("language", language), ("near duplicates", near_duplicates), ("decontamination", decontaminate), ("personal data", personal_data), ("packing", packed)]
#: models, candidate search and packing are not SQL; tests/llm holds every stage against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs, _ = materialize(docs, f"stage{k}")
    return docs
