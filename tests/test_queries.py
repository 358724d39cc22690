"""Every query of the library itself against its DuckDB SQL; the streaming scan against the same scan of the table."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from stylometra.functions import text as T
from stylometra.plans import CORE_QUERIES as QUERIES
from stylometra.plans import CORE_SQL as ORACLE_SQL
from stylometra.streaming import scan

TABLES = "documents labels events".split()


def rows(names, values):
    order = sorted(range(len(names)), key=lambda k: names[k])
    show = lambda x: "nan" if isinstance(x, float) and math.isnan(x) else str(x)
    return sorted(tuple(show(v[k]) for k in order) for v in values)


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query(spark, sf, name):
    df = QUERIES[name](spark, sf)
    got = rows(df.columns, map(tuple, df.collect()))
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    found = c.execute(ORACLE_SQL[name])
    names = [x[0] for x in found.description]
    want = rows(names, found.fetchall())
    assert sorted(names) == sorted(df.columns) and got == want and got


def test_queries_without_sql(spark, sf):
    """Their operators have tests of their own; here only that every query runs over its table and what it must agree in."""
    assert {*QUERIES} - {*ORACLE_SQL} == {"marked_ranges", "marked_fragments", "v_unedited", "calibration_samples", "calibration_fit", "calibration_transfer"}
    marked = QUERIES["marked_fragments"](spark, sf).cache()
    assert marked.count() == QUERIES["fragment_spans"](spark, sf).count() and marked.where("marked").count() > 0
    assert marked.where("doc_id % 2 = 1 and marked").count() == 0
    samples = QUERIES["calibration_samples"](spark, sf)
    assert samples.where("y = 1").count() == marked.where("marked").count()
    marked.unpersist()
    assert QUERIES["marked_ranges"](spark, sf).where("start >= end").count() == 0
    assert QUERIES["v_unedited"](spark, sf).where("similarity < 0.98").count() == 0
    assert [r["name"] for r in QUERIES["calibration_fit"](spark, sf).collect()][::8] == ["bias", "threshold"]
    assert QUERIES["calibration_transfer"](spark, sf).first()["documents"] > 10


def test_plural_and_rounding(spark):
    r = spark.range(1).select(*(T.plural(F.lit(n), "a", "b", "c").alias(f"p{n}") for n in (1, 2, 5, 11, 21, 112)), T.rounded(F.lit(1.005), 2).alias("x")).first()
    assert [*r][:6] == ["a", "b", "c", "c", "a", "c"] and r["x"] == 1.0


def test_stream(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs.repartition(3).write.parquet(f"{tmp_path}/in")
    scan.run_once(spark, f"{tmp_path}/in", docs.schema, f"{tmp_path}/out", f"{tmp_path}/cp")
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == sorted(map(tuple, scan.scanned(docs).collect()))


def test_sources(spark, tmp_path):
    from stylometra.sources import tables as S

    (tmp_path / "a.md").write_text("\ufeffone\n\ntwo", encoding="utf-8")
    assert [r["text"] for r in S.text_files(spark, str(tmp_path / "a.md")).collect()] == ["one\n\ntwo"]
    (tmp_path / "b.jsonl").write_text('{"id": "1", "text": "x"}\n{"id": "2", "text": "y"}\n')
    assert sorted((r["id"], r["text"]) for r in S.json_documents(spark, str(tmp_path / "b.jsonl")).collect()) == [("1", "x"), ("2", "y")]
    (tmp_path / "c.jsonl").write_text('{"id": "1", "text": "x"}\nnot json\n')
    with pytest.raises(Exception):
        S.json_documents(spark, str(tmp_path / "c.jsonl")).collect()


def test_findings_of_repeated_ids(spark):
    """Rows of one id have places of their own; lines and columns are those of each text."""
    from stylometra.operators.rules import Rule, findings

    rows = [(1, "ab\ncab ab"), (1, "xx ab"), (2, None), (3, "none")]
    got = sorted((r["doc_id"], r["start"], r["line"], r["col"]) for r in findings(spark.createDataFrame(rows, "doc_id long, text string"), [Rule("r", "k", "P1", "ab")]).collect())
    assert got == sorted([(1, 0, 1, 1), (1, 4, 2, 2), (1, 7, 2, 5), (1, 3, 1, 4)])


def test_measures_of_repeated_ids_and_short_texts(spark):
    from stylometra.operators import style

    words = [" ".join(f"{c}{k}" for k in range(60)) for c in "ab"]
    docs = spark.createDataFrame([(1, words[0]), (1, words[1]), (2, "short"), (3, "")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["n_words"], r["mattr"]) for r in style.diversity(docs).collect() if r["mattr"]) == [(1, 60, 1.0)] * 2
    assert style.diversity(docs).count() == 4
