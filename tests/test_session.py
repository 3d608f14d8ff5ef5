"""Intermediate tables and sharing out of small tables."""

from pyspark.sql import functions as F

from digestry.session import scratch_path, scratch_root, settle, spread


def test_settled_rows_are_the_same_and_lie_in_the_named_folder(spark):
    df = spark.range(10).select("id", F.array(F.col("id").cast("string")).alias("a"),
                                F.when(F.col("id") > 5, F.col("id")).alias("n"))
    stored = settle(df, "some-rows")
    assert sorted(map(str, stored.collect())) == sorted(map(str, df.collect()))
    assert all(scratch_root(spark).removeprefix("file:") in f for f in stored.inputFiles())
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
    assert settle(df.where("id < 0"), "no-rows").isEmpty()


def test_only_tables_of_few_splits_are_spread(spark):
    cores = spark.sparkContext.defaultParallelism
    assert spread(spark.range(0, 100, 1, 1), "id").rdd.getNumPartitions() == cores
    assert spread(spark.range(0, 100, 1, cores), "id").rdd.getNumPartitions() == cores
    assert spread(spark.range(0, 100, 1, 2), "id", small_splits=2).rdd.getNumPartitions() == 2
