"""Queries of highlighted pieces and of the calibration they feed. SQL has no counterpart of them: tests hold the operators
against plain computations.

Every third sentence of every second text is its highlighted piece, without quote marks and in lines of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import calibration as C
from ..operators import dictionary as D
from ..operators import marking as M
from ..operators.rows import once
from .dictionaries import RARE, _paragraphs


def _highlighted(spark, sf_dir) -> DataFrame:
    rows = once(_paragraphs(spark, sf_dir), _s=T.sentences(F.col("text")))
    piece = lambda s: F.regexp_replace(F.translate(s, "«»“”\"", ""), " ", "\n")
    some = F.transform(F.filter("_s", lambda s, i: i % 3 == 1), piece)
    return rows.select("doc_id", "text", F.when(F.col("doc_id") % 2 == 0, some).otherwise(F.array().cast("array<string>")).alias("pieces"))


def _samples(spark, sf_dir) -> DataFrame:
    text = F.col("text")
    return M.label_samples(_highlighted(spark, sf_dir), RARE, D.count(text, "важно|кроме того|однако"), D.count(text, "повышение|реализации|деятельности"), F.col("doc_id").cast("string"))


def marked_ranges(spark, sf_dir):
    """Where the highlighted pieces are in their texts."""
    return M.marked_spans(_highlighted(spark, sf_dir)).select("doc_id", F.col("piece").cast("long").alias("piece"), "start", "end")


def marked_fragments(spark, sf_dir):
    """How much of every fragment is highlighted."""
    rows = M.marked_fragments(_highlighted(spark, sf_dir))
    return rows.select("doc_id", F.col("fragment").cast("long").alias("fragment"), T.rounded(F.col("coverage"), 6).alias("coverage"), "holds_piece", "marked")


def v_unedited(spark, sf_dir):
    """Highlighted paragraphs that an edit left as they were; it doubles every blank, and changes the words "and" and "und"."""
    rows = _highlighted(spark, sf_dir).withColumn("after", F.replace(F.regexp_replace("text", r"\b(?:and|und)\b", "et"), F.lit(" "), F.lit("  ")))
    return M.unedited(rows.withColumnRenamed("text", "before")).select("doc_id", "start", "line", T.rounded(F.col("similarity"), 6).alias("similarity"), F.length("text").cast("long").alias("n_chars"))


def calibration_samples(spark, sf_dir):
    """A sample for each fragment: fingerprint, label and features."""
    return _samples(spark, sf_dir).select("doc", "part", "y", F.array_join(F.transform("f", lambda x: F.format_string("%.4f", x)), " ").alias("f"))


def calibration_fit(spark, sf_dir):
    """The model fitted on all samples."""
    m = C.fit(_samples(spark, sf_dir))
    return spark.createDataFrame([(name, value) for name, value in (("bias", m.bias), *zip(C.NAMES, m.weights), ("threshold", m.threshold))], "name string, value double")


def calibration_transfer(spark, sf_dir):
    """How the fit does on documents it hasn't seen; versions of a text that share a fragment are one document."""
    return C.transfer_check(_samples(spark, sf_dir)).select("documents", T.rounded(F.col("accuracy"), 6).alias("accuracy"), T.rounded(F.col("default_accuracy"), 6).alias("default_accuracy"))


QUERIES = {f.__name__: f for f in (marked_ranges, marked_fragments, v_unedited, calibration_samples, calibration_fit, calibration_transfer)}
ORACLE_SQL: dict[str, str] = {}
