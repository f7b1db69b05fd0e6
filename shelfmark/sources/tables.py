"""Reading stored tables for work that is heavy per row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_wide(spark: SparkSession, path: str, key: str) -> DataFrame:
    """A stored table in at least as many partitions as there are cores.

    Large tables are read in more splits than that and pass unchanged. A small one that sits in
    a single row group would keep one core busy with all of its texts, so it is spread by key.
    """
    rows = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores, key)
