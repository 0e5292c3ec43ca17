"""Final aggregations of partial estimates that are numbers or booleans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merged(partials: DataFrame, keys: list[str], value: str, how: str, partitions: int | None = None) -> DataFrame:
    """(keys, merged) of partial estimates: their sum, the largest but 0 at least, the whole part of the sum over the number of partitions,
    or whether any is true. Distinct counts and quantiles are not merged like this; their sketches are."""
    ways: dict[str, Column] = {
        "sum": F.sum(value), "max": F.greatest(F.max(value), F.lit(0)), "or": F.bool_or(value) if how == "or" else F.lit(None),
        "avg": F.expr(f"cast(sum({value}) AS bigint) div {partitions}") if how == "avg" else F.lit(None),
    }
    return partials.groupBy(*keys).agg(ways[how].alias("merged"))
