"""Samples decided by hashes, so that partial samples merge to the sample of the whole; and the trajectory sampler."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.hashing import coefficients, hashed, number


def sample_hash(id_col: str, seed: int) -> Column:
    return hashed(number(F.col(id_col)), coefficients(1, seed)[0])


def last_rows(df: DataFrame, key: str, order: list[str], window: int) -> DataFrame:
    """The last `window` rows of each key."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= window).drop("_n")


def lowest(df: DataFrame, keys: list[str], id_col: str, size: int, seed: int) -> DataFrame:
    """A uniform sample without replacement of `size` rows of each key: those with the lowest hashes."""
    w = Window.partitionBy(*keys).orderBy("_h", id_col)
    return df.withColumn("_h", sample_hash(id_col, seed)).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= size).drop("_h", "_n")


def chain_sample(df: DataFrame, key: str, order: list[str], id_col: str, size: int, window: int, seed: int = 21) -> DataFrame:
    """`size` of the last `window` rows of each key."""
    return lowest(last_rows(df, key, order, window), [key], id_col, size, seed)


def without_replacement(df: DataFrame, id_col: str, size: int, seed: int = 22) -> DataFrame:
    """`size` rows of all, by a distributed top-k on the hash."""
    return df.withColumn("_h", sample_hash(id_col, seed)).orderBy("_h", id_col).limit(size).drop("_h")


def merge_samples(id_col: str, size: int, *samples: DataFrame, seed: int = 22) -> DataFrame:
    """What a coordinator keeps of the samples of its sites: the sample of all they saw."""
    return without_replacement(reduce(DataFrame.unionByName, samples), id_col, size, seed)


def bernoulli(df: DataFrame, id_col: str, p: int, seed: int = 23) -> DataFrame:
    """Rows whose first p coin flips are zero: a share of 2**-p."""
    return df.filter(sample_hash(id_col, seed) % (1 << p) == 0)


def trajectory_sample(df: DataFrame, ship: str, order: list[str], period: float, distance: float, knots: float, course: float) -> DataFrame:
    """Positions worth keeping: the first of a ship, and those that differ from the last kept one by more than `period` seconds, `distance`
    metres, `course` degrees or `knots`; a missing course or speed keeps the position. Columns: ship, t, lat, lon, course, speed and others.

    Ships are dealt to partitions, each read once in order; the state is the last kept position of the ship at hand.
    """

    def keep(frames):
        from tidemark.functions.geo import far_apart

        at, last = None, None
        for frame in frames:
            chosen = []
            for s, *now in zip(frame[ship], frame["t"], frame["lat"], frame["lon"], frame["course"], frame["speed"]):
                new = s != at or far_apart(last, now, period, distance, knots, course)
                if new:
                    at, last = s, now
                chosen.append(new)
            yield frame[chosen]

    return df.repartition(ship).sortWithinPartitions(ship, *order).mapInPandas(keep, df.schema)
