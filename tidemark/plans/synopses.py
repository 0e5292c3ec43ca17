"""Synopses behind one interface: build, merge, estimate. register() adds kinds of a user's own."""

from __future__ import annotations

from abc import ABC, abstractmethod
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import frequency, quantiles, sampling
from tidemark.plans.spec import SynopsisSpec


class Synopsis(ABC):
    """build and merge return sketches as DataFrames; merge(build(a), build(b)) estimates as build(a union b) does."""

    #: Whether a series must be in one part of the data as a whole: such synopses are always dealt by key.
    by_series = False

    def __init__(self, spec: SynopsisSpec):
        self.spec = spec

    @abstractmethod
    def build(self, df: DataFrame) -> DataFrame: ...

    @abstractmethod
    def merge(self, *sketches: DataFrame) -> DataFrame: ...

    @abstractmethod
    def estimate(self, sketch: DataFrame, *params: str) -> DataFrame:
        """(key, estimation), both text."""


def asked(spark: SparkSession, params) -> DataFrame:
    return spark.createDataFrame([(str(p),) for p in params], "key string")


def as_text(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.select(F.col(key).cast("string").alias("key"), F.col(value).cast("string").alias("estimation"))


class CountMin(Synopsis):
    def __init__(self, spec):
        super().__init__(spec)
        self.sketch = frequency.CountMin(spec.params.get("eps", 0.01), spec.params.get("confidence", 0.99), spec.params.get("seed", 1), text=True)

    def build(self, df):
        return self.sketch.build(df.withColumn(self.spec.key, F.col(self.spec.key).cast("string")), self.spec.key, self.spec.value)

    def merge(self, *sketches):
        return frequency.merge_counters(*sketches)

    def estimate(self, sketch, *params):
        return as_text(self.sketch.estimate(sketch, asked(sketch.sparkSession, params), "key"), "key", "estimate")


class Ams(CountMin):
    def __init__(self, spec):
        Synopsis.__init__(self, spec)
        self.sketch = frequency.AMS(spec.params.get("depth", 5), spec.params.get("width", 512), spec.params.get("seed", 2), text=True)


class BloomFilter(Synopsis):
    def __init__(self, spec):
        super().__init__(spec)
        self.sketch = frequency.Bloom(spec.params.get("elements", 10_000), spec.params.get("fpp", 0.01), text=True)

    def build(self, df):
        return self.sketch.build(df.withColumn(self.spec.key, F.col(self.spec.key).cast("string")), self.spec.key)

    def merge(self, *sketches):
        return frequency.merge_bits(*sketches)

    def estimate(self, sketch, *params):
        return as_text(self.sketch.contains(sketch, asked(sketch.sparkSession, params), "key"), "key", "maybe_member")


class HyperLogLog(Synopsis):
    def build(self, df):
        return df.agg(F.hll_sketch_agg(F.col(self.spec.value or self.spec.key).cast("string"), self.spec.params.get("lg", 12)).alias("sketch"))

    def merge(self, *sketches):
        return reduce(DataFrame.unionByName, sketches).agg(F.hll_union_agg("sketch").alias("sketch"))

    def estimate(self, sketch, *params):
        return sketch.select(F.lit(self.spec.value or self.spec.key).alias("key"), F.hll_sketch_estimate("sketch").cast("string").alias("estimation"))


class FlajoletMartin(Synopsis):
    def __init__(self, spec):
        super().__init__(spec)
        self.sketch = frequency.FlajoletMartin(spec.params.get("bitmaps", 64))

    def build(self, df):
        return self.sketch.build(df, self.spec.key)

    def merge(self, *sketches):
        return self.sketch.merge(*sketches)

    def estimate(self, sketch, *params):
        return self.sketch.estimate(sketch).select(F.lit(self.spec.key).alias("key"), F.col("estimate").cast("string").alias("estimation"))


class Quantiles(Synopsis):
    """KLL sketches, as they merge."""

    def build(self, df):
        return df.agg(F.expr(f"kll_sketch_agg_double(cast(`{self.spec.value}` AS double))").alias("sketch"))

    def merge(self, *sketches):
        return reduce(
            lambda a,
            b: a.withColumnRenamed("sketch", "a").withColumn("_k", F.lit(1)).join(b.withColumnRenamed("sketch", "b").withColumn("_k", F.lit(1)), "_k").select(F.expr("kll_sketch_merge_double(a, b)").alias("sketch")),
            sketches
        )

    def estimate(self, sketch, *params):
        return sketch.select(F.explode(F.array(*[F.struct(
            F.lit(str(q)).alias("key"), F.expr(f"kll_sketch_get_quantile_double(sketch, {float(q)}D)").cast("string").alias("estimation")
        ) for q in params])).alias("p")).select("p.key", "p.estimation")


class Lossy(Synopsis):
    """Lossy counts of `partitions` pieces of the stream."""

    def build(self, df):
        return frequency.lossy_sketch(
            df.withColumn(self.spec.key, F.col(self.spec.key).cast("string")), self.spec.key, self.spec.params["order"],
            self.spec.params.get("eps", 0.01), self.spec.partitions
        )

    def merge(self, *sketches):
        return frequency.merge_lossy(*sketches)

    def estimate(self, sketch, *params):
        return as_text(asked(sketch.sparkSession, params).join(sketch, "key", "left").withColumn("f", F.coalesce("f", F.lit(0))), "key", "f")


class Sticky(Lossy):
    """Sticky sampling of `partitions` pieces of the stream."""

    def build(self, df):
        p = self.spec.params
        rows = df.withColumn(self.spec.key, F.col(self.spec.key).cast("string"))
        return frequency.sticky_counts(
            rows, self.spec.key, p["order"], p.get("support", 0.05), p.get("eps", 0.01), p.get("failure", 0.01), self.spec.partitions
        ).select("key", "f")

    def merge(self, *sketches):
        return reduce(DataFrame.unionByName, sketches).groupBy("key").agg(F.sum("f").alias("f"))


class Sample(Synopsis):
    """Without replacement, `size` rows by the hash of the key."""

    def build(self, df):
        return sampling.without_replacement(df, self.spec.key, self.spec.params.get("size", 100))

    def merge(self, *sketches):
        return sampling.merge_samples(self.spec.key, self.spec.params.get("size", 100), *sketches)

    def estimate(self, sketch, *params):
        return as_text(sketch, self.spec.key, self.spec.value or self.spec.key)


class WindowQuantiles(Synopsis):
    """Quantiles of the last `window` values of each key; the sketch is those rows."""

    by_series = True

    def build(self, df):
        return sampling.last_rows(df, self.spec.key, self.spec.params["order"], self.spec.params.get("window", 100))

    def merge(self, *sketches):
        return self.build(reduce(DataFrame.unionByName, sketches))

    def estimate(self, sketch, *params):
        parts = [quantiles.of_last(
            sketch, self.spec.key, self.spec.params["order"], self.spec.value, float(q), self.spec.params.get("window", 100)
        ).withColumn(self.spec.key, F.concat_ws("_", F.col(self.spec.key).cast("string"), F.lit(str(q)))) for q in params]
        return as_text(reduce(DataFrame.unionByName, parts), self.spec.key, "value")


KINDS: dict[str, type[Synopsis]] = {
    "count_min": CountMin, "ams": Ams, "bloom": BloomFilter, "hyperloglog": HyperLogLog, "flajolet_martin": FlajoletMartin, "quantiles": Quantiles, "lossy": Lossy, "sticky": Sticky, "wor_sample": Sample, "window_quantiles": WindowQuantiles,
}


def register(name: str, kind: type[Synopsis]) -> None:
    """Makes a synopsis of one's own known under a name. Code is never loaded because a message names it."""
    if not issubclass(kind, Synopsis):
        raise TypeError("a synopsis has build, merge and estimate")
    KINDS[name] = kind
