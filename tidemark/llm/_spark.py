"""Cutting lineage in the cluster's shared folder."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.arrow import runs
from tidemark.storage import shared_folder

__all__ = ["cut", "forget", "passing", "perhaps_in", "runs"]

BITMAP = 1 << 15  # bits of one bitmap of Spark's


def cut(df: DataFrame, keep: bool = False) -> DataFrame:
    """df written once to the shared folder and read back: a lost executor costs a reread, not a recomputation, and Spark knows its size.
    With keep, it outlives passing()."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_to = path
    if _scopes and not keep:
        _scopes[-1].append(out)
    return out


_scopes: list[list[DataFrame]] = []


def forget(*tables: DataFrame) -> None:
    """Deletes tables that cut() wrote and that nothing reads any more."""
    for t in tables:
        jvm = t.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(t.cut_to)
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def perhaps_in(df: DataFrame, few: DataFrame, on: list[str], most_bitmaps: int = 4096) -> tuple[DataFrame, Column]:
    """df with one more column, `_perhaps`, and that column: true for every row whose values of `on` are among those of few, and for about one in 64 of
    the others (more where few has over two million rows). Rows for which it is false need not be shuffled to meet few. few is read twice: it
    should be a table. At most `most_bitmaps` bitmaps of 4 KB are broadcast."""
    bitmaps = min(most_bitmaps, max(1, -(-few.count() * 64 // BITMAP)))
    at = F.pmod(F.xxhash64(*on), F.lit(bitmaps * BITMAP))
    bits = few.select(at.alias("_at")).groupBy(F.expr(f"_at div {BITMAP}").alias("_map")).agg(F.bitmap_construct_agg(F.col("_at") % BITMAP).alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", (F.col("_at") % BITMAP / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    known = F.coalesce(F.getbit(byte, (F.col("_at") % 8).cast("int")) == 1, F.lit(False))
    placed = df.withColumn("_at", at).withColumn("_map", F.expr(f"_at div {BITMAP}")).join(F.broadcast(bits), "_map", "left")
    return placed.withColumn("_perhaps", known).drop("_at", "_map", "_bits"), F.col("_perhaps")


@contextlib.contextmanager
def passing():
    """Tables cut inside are deleted at the end."""
    _scopes.append([])
    try:
        yield
    finally:
        forget(*_scopes.pop())
