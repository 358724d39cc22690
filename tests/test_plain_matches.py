"""Words of the prepared text with their places: against SQL and the columns of `prepared`, and in a text with very many of them."""

import time

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as E
from stylometra.operators import preparation as P
from stylometra.operators.rules import placed
from stylometra.plans.preparations import HEADS

CAPITAL = r"\p{Lu}\p{L}+"
TEXTS = [
    "", None, "\u200b", "А", "Ёлка", "\u200bЁл\u00ad\u00adка\u2066", "cмысл, Cмысл и Pythonе\nFхG вPython Fоr\n\nТeкст", "Слово\nfоr\n", "нет",
    "\U0001f600 Да\U000e0041т \U00010400\U00010428\U00010428 Нет", "Å\u200db Çà‑Là A1б Бв", "\n\n\nДом\r\n\u180eСад\u061c", "Aб\u200b1Вг", "Ab\u200b " * 700, "ПОЛЕ" * 300,
]


def documents(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return f"{folder}/documents.parquet/*.parquet"


def test_odd_texts(spark, tmp_path):
    found = documents(spark, str(tmp_path), [(9 * k + i, t) for k, t in enumerate(TEXTS) for i in range(9)])
    got = E.queries()["prepared_words"](spark, str(tmp_path))
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW documents AS SELECT * FROM '{found}'")
        assert sorted(map(tuple, got.collect())) == sorted(db.sql(E.oracle_sql()["prepared_words"]).fetchall())


def test_columns_and_rows_of_one_id(spark):
    docs = spark.createDataFrame([(1, "a", t) for t in TEXTS], "doc_id int, lang string, text string").coalesce(1)
    rows = P.prepared(docs).select("doc_id", "lang", "moved", F.explode(placed(F.col("plain"), CAPITAL)).alias("h"))
    want = rows.select("doc_id", "lang", "h.text", "h.start", P.to_source(F.col("moved"), F.col("h.start")))
    got = P.plain_matches(docs, CAPITAL)
    assert got.columns == ["doc_id", "lang", "word", "plain_at", "source_at"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 700
    assert P.plain_matches(docs.limit(0), CAPITAL).count() == 0


def test_very_many_matches_and_signs(spark, tmp_path):
    """40 000 words, each with a sign of no width in it: no step looks at all signs for each word or copies all words so far."""
    n, head = 40_000, len(HEADS[2]) + 2
    documents(spark, str(tmp_path), [(2, "Ab\u200bc " * n)])
    began = time.time()
    rows = E.queries()["prepared_words"](spark, str(tmp_path)).where("word = 'Abc'").collect()
    assert time.time() - began < 60
    assert sorted((r.plain_at, r.source_at) for r in rows) == [(head + 4 * k, head + 5 * k) for k in range(n)]


def test_no_service_parts_are_made(spark, tmp_path):
    documents(spark, str(tmp_path), [(2, "Слово")])
    plan = E.queries()["prepared_words"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "_signs" in plan and "_k#" not in plan and "_m#" not in plan
