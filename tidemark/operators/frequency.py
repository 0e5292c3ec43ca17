"""Frequency, membership and cardinality synopses as tables of counters.

A sketch is a DataFrame of at most depth * width rows (or bits), so a merge is a union and a group-by, and a sketch can be broadcast: its
size is fixed by its parameters, whatever the input. Building first sums each key's weights, then hashes each distinct key.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.hashing import coefficients, hashed, number, trailing_zeros
from tidemark.storage import running_sums, tasks


@dataclass(frozen=True)
class CountMin:
    """Counters of ceil(2 / eps) buckets in ceil(-log2(1 - confidence)) rows. A point estimate is never below the true weight."""

    eps: float
    confidence: float
    seed: int = 1
    text: bool = False

    def __post_init__(self):
        if not (0 < self.eps < 1 and 0 < self.confidence < 1):
            raise ValueError("eps and confidence lie between 0 and 1")

    @property
    def width(self) -> int:
        return math.ceil(2 / self.eps)

    @property
    def depth(self) -> int:
        return math.ceil(-math.log(1 - self.confidence) / math.log(2))

    @property
    def hashes(self) -> list[tuple[int, int]]:
        return coefficients(self.depth, self.seed)

    def buckets(self, key: Column) -> Column:
        return F.array(*[hashed(number(key, self.text), ab, self.width) for ab in self.hashes])

    def build(self, df: DataFrame, key: str, value: str | None = None) -> DataFrame:
        """(row, bucket, cnt). Weights are truncated to whole numbers; a null weight counts one; a negative one is an error."""
        weight = F.lit(1).cast("long") if value is None else F.coalesce(F.col(value).cast("long"), F.lit(1).cast("long"))
        if value is not None:
            weight = F.when(weight < 0, F.raise_error(F.lit("negative weight"))).otherwise(weight).cast("long")
        sums = df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.sum(weight).alias("w"))
        return sums.select("w", F.posexplode(self.buckets(F.col("key"))).alias("row", "bucket")).groupBy("row", "bucket").agg(F.sum("w").alias("cnt"))

    def estimate(self, sketch: DataFrame, keys: DataFrame, key: str) -> DataFrame:
        """(key, estimate) for every row of keys."""
        asked = keys.select(key, F.posexplode(self.buckets(F.col(key))).alias("row", "bucket"))
        return asked.join(F.broadcast(sketch), ["row", "bucket"], "left").groupBy(key).agg(F.min(F.coalesce("cnt", F.lit(0))).cast("long").alias("estimate"))

    def running(self, df: DataFrame, key: str, order: list[str], value: str | None = None) -> DataFrame:
        """Each element with the estimate of its key right after it: running sums of each counter, the least over the rows."""
        weight = F.lit(1) if value is None else F.col(value).cast("long")
        spread = df.select(*dict.fromkeys([key, *order]), weight.cast("long").alias("w"), F.posexplode(self.buckets(F.col(key))).alias("row", "bucket"))
        return running_sums(spread, ["row", "bucket"], order, F.col("w"), "cnt").groupBy(*dict.fromkeys([key, *order])).agg(F.min("cnt").alias("estimate"))


def merge_counters(*sketches: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, sketches).groupBy("row", "bucket").agg(F.sum("cnt").alias("cnt"))


def join_size(*sketches: DataFrame) -> DataFrame:
    """The estimated size of the equi-join of what the Count-Min sketches (of one spec) have counted: products of counters, summed by row, the least."""
    product = sketches[0].withColumnRenamed("cnt", "product")
    for s in sketches[1:]:
        product = product.join(F.broadcast(s), ["row", "bucket"]).select("row", "bucket", (F.col("product") * F.col("cnt")).alias("product"))
    return product.groupBy("row").agg(F.sum("product").alias("size")).agg(F.coalesce(F.min("size"), F.lit(0)).cast("long").alias("join_size"))


@dataclass(frozen=True)
class AMS:
    """Signed counters in an odd number of rows: unbiased counts, second moment and join size by medians over the rows."""

    depth: int
    width: int
    seed: int = 2
    text: bool = False

    def __post_init__(self):
        if self.depth % 2 == 0 or self.width < 1:
            raise ValueError("depth is odd, width is positive")

    @property
    def hashes(self) -> list[tuple[tuple[int, int], tuple[int, int]]]:
        c = coefficients(2 * self.depth, self.seed)
        return list(zip(c[: self.depth], c[self.depth :]))

    def places(self, key: Column) -> Column:
        x = number(key, self.text)
        return F.array(*[F.struct(hashed(x, b, self.width).alias("bucket"), (hashed(x, s, 2) * 2 - 1).alias("sign")) for b, s in self.hashes])

    def build(self, df: DataFrame, key: str, value: str | None = None) -> DataFrame:
        sums = df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg((F.count("*") if value is None else F.sum(F.col(value).cast("long"))).alias("w"))
        spread = sums.select("w", F.posexplode(self.places(F.col("key"))).alias("row", "p"))
        return spread.groupBy("row", F.col("p.bucket").alias("bucket")).agg(F.sum(F.col("w") * F.col("p.sign")).alias("cnt"))

    def estimate(self, sketch: DataFrame, keys: DataFrame, key: str) -> DataFrame:
        asked = keys.select(key, F.posexplode(self.places(F.col(key))).alias("row", "p")).select(key, "row", "p.bucket", "p.sign")
        return asked.join(F.broadcast(sketch), ["row", "bucket"], "left").groupBy(key).agg(F.median(F.col("sign") * F.coalesce("cnt", F.lit(0))).cast("long").alias("estimate"))

    def second_moment(self, sketch: DataFrame) -> DataFrame:
        return sketch.groupBy("row").agg(F.sum(F.col("cnt") * F.col("cnt")).alias("f2")).agg(F.median("f2").cast("long").alias("f2"))

    def join_size(self, a: DataFrame, b: DataFrame) -> DataFrame:
        both = a.join(F.broadcast(b.withColumnRenamed("cnt", "other")), ["row", "bucket"])
        return both.groupBy("row").agg(F.sum(F.col("cnt") * F.col("other")).alias("s")).agg(F.median("s").cast("long").alias("join_size"))


@dataclass(frozen=True)
class Bloom:
    """Set membership by k bits of m; no false negatives."""

    elements: int
    fpp: float
    seed: int = 3
    text: bool = False

    @property
    def bits(self) -> int:
        return math.ceil(-self.elements * math.log(self.fpp) / math.log(2) ** 2)

    @property
    def k(self) -> int:
        return max(1, round(self.bits / self.elements * math.log(2)))

    @property
    def hashes(self) -> list[tuple[int, int]]:
        return coefficients(self.k, self.seed)

    def positions(self, key: Column) -> Column:
        return F.array(*[hashed(number(key, self.text), ab, self.bits) for ab in self.hashes])

    def build(self, df: DataFrame, key: str) -> DataFrame:
        """(bit): the bits that are set."""
        return df.filter(F.col(key).isNotNull()).select(key).distinct().select(F.explode(self.positions(F.col(key))).alias("bit")).distinct()

    def pack(self, bits: DataFrame) -> DataFrame:
        """(bucket, bitmap): the same filter as bitmaps of 32,768 bits."""
        return bits.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bitmap"))

    def contains(self, bits: DataFrame, keys: DataFrame, key: str) -> DataFrame:
        asked = keys.select(key, F.explode(self.positions(F.col(key))).alias("bit"))
        return asked.join(bits.withColumn("is_set", F.lit(True)), "bit", "left").groupBy(key).agg(F.bool_and(F.coalesce("is_set", F.lit(False))).alias("maybe_member"))


def merge_bits(*filters: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, filters).distinct()


@dataclass(frozen=True)
class FlajoletMartin:
    """Distinct count from the lowest bits never set in m bitmaps (stochastic averaging). Keys of any kind are digested first, as the low
    bits of a linear hash of consecutive numbers are too regular."""

    bitmaps: int = 64
    seed: int = 4

    @property
    def hashes(self) -> list[tuple[int, int]]:
        return coefficients(2, self.seed)

    def build(self, df: DataFrame, key: str) -> DataFrame:
        """(slot, bitmap). A merge is bit_or by slot."""
        x = number(F.col(key), text=True)
        low = hashed(x, self.hashes[1]).bitwiseOR(F.lit(1 << 30).cast("long"))
        rows = df.filter(F.col(key).isNotNull()).select(
            hashed(x, self.hashes[0], self.bitmaps).alias("slot"), F.pow(F.lit(2), trailing_zeros(low)).cast("long").alias("bit")
        )
        return rows.groupBy("slot").agg(F.bit_or("bit").alias("bitmap"))

    def merge(self, *sketches: DataFrame) -> DataFrame:
        return reduce(DataFrame.unionByName, sketches).groupBy("slot").agg(F.bit_or("bitmap").alias("bitmap"))

    def estimate(self, sketch: DataFrame) -> DataFrame:
        unset = trailing_zeros(F.bitwise_not("bitmap"))
        return sketch.agg(F.round(F.lit(self.bitmaps) / 0.77351 * F.pow(F.lit(2.0), F.coalesce(F.sum(unset), F.lit(0)) / self.bitmaps), 4).alias("estimate"))


def hll(df: DataFrame, keys: list[str], value: str, lg: int = 12) -> DataFrame:
    """(keys, sketch): Spark's HyperLogLog, merged with hll_union_agg."""
    return df.groupBy(*keys).agg(F.hll_sketch_agg(value, lg).alias("sketch"))


def counted_pieces(df: DataFrame, key: str, by: list[str] | Column, pieces: int | None) -> DataFrame:
    """(piece, key, c): rows dealt to pieces by a hash of the columns `by` (or as a column says), and each piece's keys counted. A hot key's rows are in all pieces."""
    piece = by if isinstance(by, Column) else F.pmod(F.xxhash64(*by), F.lit(pieces or tasks(df.sparkSession))).cast("int")
    return df.filter(F.col(key).isNotNull()).groupBy(piece.alias("piece"), F.col(key).alias("key")).agg(F.count("*").alias("c"))


def lossy_sketch(df: DataFrame, key: str, by: list[str] | Column, eps: float, pieces: int | None = None) -> DataFrame:
    """(key, f, allowed, seen): a lossy count of each piece of the stream, added up.

    A piece of n rows keeps the keys that it has more than eps * n times, at most 1 / eps of them. The row with a null key says what a
    key may have lost in all pieces (allowed) and how many rows there were (seen); a key's own `allowed` is of the pieces that keep it.
    """
    counts = counted_pieces(df, key, by, pieces)
    sizes = counts.groupBy("piece").agg(F.sum("c").alias("n")).withColumn("lost", F.floor(F.col("n") * eps))
    kept = counts.join(sizes, "piece").filter("c > lost").groupBy("key").agg(F.sum("c").alias("f"), F.sum("lost").alias("allowed"), F.lit(0).cast("long").alias("seen"))
    kind = counts.schema["key"].dataType.simpleString()
    return kept.unionByName(sizes.agg(
        F.lit(None).cast(kind).alias("key"), F.lit(0).cast("long").alias("f"), F.coalesce(F.sum("lost"), F.lit(0)).alias("allowed"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("seen")
    ))


def merge_lossy(*sketches: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, sketches).groupBy("key").agg(*[F.sum(c).alias(c) for c in ("f", "allowed", "seen")])


def lossy_result(sketch: DataFrame) -> DataFrame:
    """(key, f, delta, seen): f <= true count <= f + delta, and delta <= eps * seen; a key that is not listed has at most eps * seen."""
    whole = sketch.filter("key IS NULL")
    allowed, seen = whole.agg(F.sum("allowed")).scalar(), whole.agg(F.sum("seen")).scalar()
    return sketch.filter("key IS NOT NULL").select("key", "f", (allowed - F.col("allowed")).alias("delta"), seen.alias("seen"))


def lossy_counts(df: DataFrame, key: str, by: list[str] | Column, eps: float, pieces: int | None = None) -> DataFrame:
    return lossy_result(lossy_sketch(df, key, by, eps, pieces))


def sticky_counts(df: DataFrame, key: str, by: list[str] | Column, support: float, eps: float, failure: float, pieces: int | None = None, seed: int = 7) -> DataFrame:
    """(key, f, seen): sticky sampling in every piece of the stream, added up. f <= true count, and a key with at least support * seen
    elements has f >= (support - eps) * seen with probability 1 - failure.

    A piece's rate doubles each time its length does, beyond 2 * t rows; after the doublings an entry is as if it had been sampled at the
    last rate from the start. So an entry has its key's count without what went by before the first hit, which is geometric: one
    draw, by a hash of piece and key, instead of one for every row.
    """
    t = math.ceil(math.log(1 / (support * failure)) / eps)
    counts = counted_pieces(df, key, by, pieces)
    sizes = counts.groupBy("piece").agg(F.sum("c").alias("n"))
    rate = F.pow(F.lit(2.0), F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / (2 * t)))))
    coin = F.substring(F.md5(F.concat_ws("|", F.col("piece").cast("string"), F.col("key").cast("string"), F.lit(str(seed))).cast("binary")), 1, 12)
    u = (F.conv(coin, 16, 10).cast("double") + 0.5) / float(1 << 48)  # one draw for each key of a piece
    missed = F.when(F.col("rate") > 1, F.floor(F.log(u) / F.log(1 - 1 / F.col("rate")))).otherwise(0)
    found = counts.join(sizes.withColumn("rate", rate), "piece").withColumn("left", F.col("c") - missed).filter("left > 0").groupBy("key").agg(F.sum("left").cast("long").alias("f"))
    return found.select("key", "f", sizes.agg(F.sum("n")).scalar().alias("seen"))
