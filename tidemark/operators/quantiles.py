"""Quantile synopses."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.sampling import last_rows


def approximate(df: DataFrame, keys: list[str], value: str, quantiles: list[float], eps: float) -> DataFrame:
    """(keys, q, value): each within eps * n ranks of the exact quantile (Greenwald and Khanna's summary, merged by Spark)."""
    got = df.groupBy(*keys).agg(F.percentile_approx(value, quantiles, math.ceil(1 / eps)).alias("_v"))
    return got.select(
        *keys, F.explode(F.arrays_zip(F.array(*map(F.lit, quantiles)).alias("q"), F.col("_v").alias("v"))).alias("_p")
    ).select(*keys, "_p.q", F.col("_p.v").alias("value"))


def of_last(df: DataFrame, key: str, order: list[str], value: str, quantile: float, window: int) -> DataFrame:
    """(key, n, value): the quantile of the last `window` values of each key."""
    return last_rows(df, key, order, window).groupBy(key).agg(
        F.count(value).alias("n"),
        F.percentile_disc(value, quantile).alias("value") if hasattr(F, "percentile_disc") else F.expr(f"percentile_disc({quantile}) WITHIN GROUP (ORDER BY {value})").alias("value")
    )
