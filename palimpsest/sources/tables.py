"""Tables for work that is long for its bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores where it comes in fewer, as from one small file; larger tables are left as they are."""
    width = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= width else df.repartition(width)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df.select(*columns) if columns else df)
