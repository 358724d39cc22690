"""Workers put out slices, whatever a batch holds."""

import pyarrow as pa
from pyspark.sql import functions as F

from stylometra.operators import rows


def test_large_batches_leave_in_slices(monkeypatch):
    batch = pa.record_batch([pa.array(range(5000)), pa.array(["ab cd"] * 4999 + [None])], names=["id", "text"])
    parts = [*rows.sliced([batch], 1, lambda t: [(k, w) for k, w in enumerate((t or "").split())])]
    assert max(len(out) for _, out in parts) <= rows.SLICE and sum(len(out) for _, out in parts) == 9998
    assert [i for kept, _ in parts for i in kept[0].to_pylist()] == [i for i in range(4999) for _ in range(2)]
    monkeypatch.setattr(rows, "CHARACTERS", 10)
    assert max(len(out) for _, out in rows.sliced([batch], 1, lambda t: [(w,) for w in (t or "").split()])) == 5


def test_batches_are_small(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows.from_texts(spark.createDataFrame([(1, "a b")], "id long, text string"), "text", "w string", lambda t: [(w,) for w in t.split()])
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == rows.BATCH["spark.sql.execution.arrow.maxRecordsPerBatch"]


def test_dictionary_asks_for_small_batches(spark):
    from stylometra.operators import dictionary

    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    df = spark.createDataFrame([(1, "one thing " * 3000)], "doc_id long, text string")
    hits = dictionary.dictionary_hits(df, [dictionary.Entry("g", "thing")], "general", F.lit(10))
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == rows.BATCH["spark.sql.execution.arrow.maxRecordsPerBatch"]
    assert hits.count() == 3000
