"""What operators that work in the row share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: rows and bytes of one Arrow batch that workers read; rows and characters of one that they put out
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8388608"}
SLICE, CHARACTERS = 2000, 2_000_000


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once per row, however often later steps read them: a generator keeps Catalyst
    from merging projections, which would evaluate them again for every reader and every element of a lambda."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def small_batches(df: DataFrame) -> DataFrame:
    """df, after Arrow batches of its session are made small, unless the application's settings name others: texts are long,
    and the JVM and the worker each hold whole batches."""
    spark = df.sparkSession
    given = spark.sparkContext.getConf()
    for key, most in BATCH.items():
        if not given.contains(key) and spark.conf.get(key) != most:
            spark.conf.set(key, most)
    return df


def sliced(batches, n: int, found):
    """(columns of the rows before the last n columns, as often as due, and the tuples that found(*values of the last n)
    gives) of Arrow batches, some SLICE rows or CHARACTERS of text at a time, whatever a batch or a text holds."""
    import pyarrow as pa

    for b in batches:
        others, at, out, size = b.num_columns - n, [], [], 0
        for k in range(b.num_rows):
            for x in found(*(b.column(others + c)[k].as_py() for c in range(n))):
                at.append(k)
                out.append(x)
                size += sum(len(v) for v in x if isinstance(v, str))
                if len(out) >= SLICE or size >= CHARACTERS:
                    yield [b.column(c).take(pa.array(at)) for c in range(others)], out
                    at, out, size = [], [], 0
        if out:
            yield [b.column(c).take(pa.array(at)) for c in range(others)], out


def from_texts(df: DataFrame, text_col: str, schema: str, parts) -> DataFrame:
    """The other columns of df beside the rows that `parts` (text to tuples in the order of schema) makes of each text.

    A task holds one small batch of texts and puts out slices; nothing is shuffled, and rows of one id stay apart. A null text counts as empty.
    """
    others = [c for c in df.columns if c != text_col]
    names, types = zip(*(c.split() for c in schema.split(", ")))
    taken = {*names} & {*others}
    if taken:
        raise ValueError(f"columns of these names are made here: {sorted(taken)}")
    ordered = small_batches(df).select(*others, F.col(text_col).alias("text"))

    def run(batches):
        import pyarrow as pa

        kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
        made = sliced(batches, 1, lambda text: parts(text or ""))
        for kept, out in made:
            columns = [pa.array(c, kinds[t]) for c, t in zip(zip(*out), types)]
            yield pa.record_batch([*kept, *columns], names=[*others, *names])

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema.fields[:-1]]
    return ordered.mapInArrow(run, ", ".join([*kept, schema]))
