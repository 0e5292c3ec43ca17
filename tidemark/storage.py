"""Tables in the folder that all executors share, and running sums that no group's size can hold up."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder where none is set and the master is local."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-"))
    return sc.getCheckpointDir()


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """df written as Parquet and read back: what follows does not compute it again, a lost executor costs a reread, and Spark knows its size."""
    path = path or f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def running_sums(df: DataFrame, group: list[str], order: list[str], value: Column, name: str, most_rows: int = 1 << 20) -> DataFrame:
    """Adds the running sum of value within each group in the order given. Rows are dealt in ranges of that order, so that a group of any
    size is shared by many tasks; each adds to its own running sum what the ranges before it have summed up. A task gets about `most_rows` rows:
    left to their size, which compression makes small, shuffled rows would be sorted in a few tasks whose memory grows with the table."""
    parts = max(tasks(df.sparkSession), -(-df.count() // most_rows))
    ranged = written(df.withColumn("_v", value).repartitionByRange(parts, *order, *group).withColumn("_range", F.spark_partition_id()))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy(*group, "_range").agg(F.sum("_v").alias("_s")).withColumn("_start", F.coalesce(F.sum("_s").over(before), F.lit(0))).drop("_s")
    inside = Window.partitionBy(*group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    dealt = ranged.repartition(parts, *group, "_range").join(starts, [*group, "_range"])
    return dealt.withColumn(name, F.col("_start") + F.sum("_v").over(inside)).drop("_v", "_range", "_start")
