"""Texts without a block, and words of very many parts, against SQL."""

import duckdb

import __spark_entry__ as E

LINE = "one two three four five six seven eight nine,"
TEXTS = ["", " \n\n\t\n ", "\n" * 50, None, LINE, "- " + LINE, LINE + " \r\n\n", LINE + "\x0b", LINE + "\x85", "a-" * 20_000 + "b c d e f g h i j,", "x" + " " * 100_000 + LINE]


def test_tails(spark, tmp_path):
    rows = [(2 * k + odd, t) for k, t in enumerate(TEXTS) for odd in (0, 1)]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(path)
    got = sorted((r.doc_id, r.start, r.tail) for r in E.queries()["truncated_tail"](spark, str(tmp_path)).collect())
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
        assert got == sorted(db.sql(E.oracle_sql()["truncated_tail"]).fetchall())
    assert {9, 13, 19, 21} <= {i for i, _, _ in got} and not {1, 3, 5, 7, 11} & {i for i, _, _ in got}
