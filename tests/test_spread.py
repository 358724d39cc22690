from pyspark.sql import functions as F

from stylometra.sources.tables import spread


def test_one_row_group_in_many_partitions(spark, tmp_path):
    """The file is cut into a partition for each core at least, but all of its rows are in one of them."""
    path = str(tmp_path / "t.parquet")
    spark.range(0, 40_000, 1, 1).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text")).write.parquet(path)
    known = {k: spark.conf.get(k) for k in ("spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes")}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
        cores = spark.sparkContext.defaultParallelism
        plain = spark.read.parquet(path)
        rows = lambda df: [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
        assert plain.rdd.getNumPartitions() >= cores and rows(plain) == [40_000]
        found = spread(plain)
        assert len(rows(found)) >= cores and max(rows(found)) <= 2 * 40_000 // cores
        assert found.agg(F.count("*"), F.sum("id"), F.count_distinct("text")).first()[:] == (40_000, sum(range(40_000)), 40_000)
        assert spread(plain.where("id < 0")).count() == 0
        even = spark.range(0, 800, 1, 2 * cores)
        assert spread(even) is even
    finally:
        for k, v in known.items():
            spark.conf.set(k, v)
