import shutil

import pytest
from pyspark.sql import functions as F

import __spark_entry__


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    import duckdb

    path = tmp_path_factory.mktemp("phrases")
    shutil.copytree("/root/testdata/sf0.001", path, dirs_exist_ok=True, copy_function=shutil.copyfile)
    # ids of several rows with repeats within a row and only across rows, texts without words, null texts and ids
    odd = "(900001, 'a b c d'), (900001, 'A b c a b c'), (900002, 'x y z'), (900002, 'x y z'), (900003, ''), (900004, null), (900005, 'one two'), (900006, 'q q q q q'), (null, 'u v w u v w'), (900007, 'p q r. p q r')"
    (path / "documents.parquet").unlink()
    duckdb.sql(f"copy (select doc_id, text, lang, source, n_chars from '/root/testdata/sf0.001/documents.parquet' union all select i, t, 'en', 's', length(t) from (values {odd}) v(i, t)) to '{path}/documents.parquet' (format parquet)")
    return str(path)


def test_phrases_of_ids_of_several_rows(spark, tables):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view documents as from '{tables}/documents.parquet'")
    expected = sorted(con.sql(__spark_entry__.oracle_sql()["phrase3"]).fetchall(), key=str)
    found = sorted((tuple(r) for r in __spark_entry__.queries()["phrase3"](spark, tables).collect()), key=str)
    assert found == expected and len(found) > 3


def test_texts_are_shuffled_instead_of_phrases(spark, sf):
    """Bytes that the query shuffles, beside those of the texts."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def written() -> int:
        found = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
        return sum(found.apply(k).shuffleWriteBytes() for k in range(found.size()))

    documents = spark.read.parquet(f"{sf}/documents.parquet")
    n = [written()]
    documents.repartition(4, "doc_id").write.format("noop").mode("overwrite").save()
    n.append(written())
    __spark_entry__.queries()["phrase3"](spark, sf).agg(F.count("*")).collect()
    n.append(written())
    assert 0 < n[2] - n[1] < 2.5 * (n[1] - n[0])
