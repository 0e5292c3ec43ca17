"""Pairs of similar vectors and windows: random hyperplanes, radius sketches, simulation windows, and a stated query set against all rows."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.arrays import dot, projected, projection, standard
from tidemark.functions.hashing import random_signs
from tidemark.operators import blocks
from tidemark.storage import written


def product_sql(vector: str, matrix: list[list[float]]) -> str:
    """SQL of a list of products of a list with the rows of a matrix."""
    return "[" + ", ".join(f"list_dot_product({vector}, {row}::DOUBLE[])" for row in matrix) + "]"


def scaled(df: DataFrame, vector: str) -> DataFrame:
    """Adds z, the vector with mean 0 and length 1."""
    return df.withColumn("z", standard(F.col(vector)))


def lsh(df: DataFrame, vector: str, dims: int, bits: int, seed: int) -> DataFrame:
    """Adds bits (signs of random projections of the centred vector) and hw, their number of ones. The angle of two vectors is about
    pi / `bits` times the number of different bits."""
    return scaled(df, vector).withColumn(
        "bits", F.transform(projected(F.col("z"), projection(bits, dims, seed)), lambda x: x > 0)
    ).withColumn("hw", F.size(F.filter("bits", lambda b: b)))


def bands_for(threshold: float, recall: float, width: int) -> int:
    """The fewest bands of `width` bits that find a pair whose correlation is the threshold with the recall wanted. A bit differs with probability
    angle / pi; as random vectors share a band with probability 2**-width, width goes with the logarithm of their number."""
    agree = 1 - math.acos(threshold) / math.pi
    return math.ceil(math.log(1 - recall) / math.log(1 - agree**width))


def lsh_codes(df: DataFrame, key: str, vector: str, dims: int, bands: int, width: int, seed: int, text_id: bool = False) -> DataFrame:
    """(id, codes, x): the scaled vector and, for each band, `width` signs of random projections as one number. Vectors that are null, or of
    another length, or have null or non-finite components, are left out."""
    matrix = np.array(random_signs(bands * width * dims, seed)).reshape(-1, dims)
    whole = df.filter((F.size(vector) == dims) & ~F.exists(vector, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf"))))
    rows = scaled(whole, vector).select(F.col(key).cast("string" if text_id else "long").alias("id"), "z")

    def code(batches):
        weights = np.int64(1) << np.arange(width, dtype=np.int64)
        for b in batches:
            z = b.column(1)
            x = z.flatten().to_numpy(zero_copy_only=False).reshape(len(z), dims)
            bits = (x @ matrix.T > 0).reshape(len(z), bands, width)
            codes = (bits * weights).sum(2)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.ListArray.from_arrays(np.arange(len(z) + 1, dtype=np.int32) * bands, pa.array(codes.ravel())), z],
                ["id", "codes", "x"]
            )

    return rows.mapInArrow(code, f"id {'string' if text_id else 'long'}, codes array<long>, x array<double>")


def _coded(df: DataFrame, key: str, vector: str, dims: int, threshold: float, recall: float, width: int, seed: int) -> tuple[DataFrame, bool]:
    """Rows for blocks.pairs(), and whether all of them are to meet: so many bands of so few bits that a pair is expected in more than one band in eight of
    its copies would be compared as often in buckets, with a copy of each row for every band."""
    bands = bands_for(threshold, recall, width)
    together = bands > (1 << width) / 8
    rows = lsh_codes(df, key, vector, dims, bands, width, seed)
    if together and width < 16:
        rows = rows.withColumn("codes", F.col("codes").cast("array<smallint>"))
    return written(rows), together


def lsh_pairs(df: DataFrame, key: str, vector: str, dims: int, threshold: float, recall: float = 0.9, width: int = 8, seed: int = 31) -> DataFrame:
    """(a, b, corr): pairs that agree on all bits of a band, verified by their correlation; of pairs at the threshold the share `recall` at least, of
    closer ones more. probes_against_all() is the exact way for a stated query set."""
    rows, together = _coded(df, key, vector, dims, threshold, recall, width, seed)
    return blocks.pairs(rows, threshold, together=together).withColumnRenamed("score", "corr")


def lsh_links(df: DataFrame, key: str, vector: str, dims: int, threshold: float, recall: float = 0.9, width: int = 8, seed: int = 31) -> DataFrame:
    """(id, n_links, best, best_corr) of every vector: how many others it has such a pair with, and the closest of them (null where it has none)."""
    rows, together = _coded(df, key, vector, dims, threshold, recall, width, seed)
    found = blocks.links(rows, threshold, together=together).withColumnRenamed("best_score", "best_corr")
    return df.select(F.col(key).cast("long").alias("id")).join(found, "id", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)))


def lsh_windows(windows: DataFrame, keys: list[str], length: int, bits: int, seed: int) -> DataFrame:
    """(keys, hw) of scaled windows z of a series: the Hamming weight of their signs under random projections."""
    return windows.filter("z IS NOT NULL").select(*keys, F.size(F.filter(projected(F.col("z"), projection(bits, length, seed)), lambda v: v > 0)).alias("hw"))


def radius_groups(df: DataFrame, key: str, vector: str, dims: int, groups: int, side: float, seed: int) -> DataFrame:
    """(key, group, cx, cy): each group has two components of the vector's random sign projection, on a grid of its own."""
    matrix = projection(2 * groups, dims, seed, signs=True)
    sketch = scaled(df, vector).select(key, projected(F.col("z"), matrix).alias("s"))
    spread = sketch.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    cell = lambda k: F.floor(F.get("s", 2 * F.col("group") + k) / side)
    return spread.select(key, "group", cell(0).alias("cx"), cell(1).alias("cy"))


def radius_cells(df: DataFrame, key: str, vector: str, dims: int, groups: int, side: float, seed: int) -> DataFrame:
    """(key, cells): the same as one row, a number for each group's cell."""
    sketch = scaled(df, vector).select(key, projected(F.col("z"), projection(2 * groups, dims, seed, signs=True)).alias("s"))
    cell = lambda k: F.floor(F.get("s", F.lit(k)) / side)
    return sketch.select(key, F.array(*[F.xxhash64(cell(2 * g), cell(2 * g + 1)).cast("double") for g in range(groups)]).alias("cells"))


def _vote_rows(cells: DataFrame, key: str, groups: int, percent: float) -> tuple[DataFrame, int]:
    least = math.floor(groups * percent / 100) + 1
    chunks = groups - least + 1  # groups that a pair may miss fall into all chunks but one
    at = written(cells.groupBy(F.col(key).cast("long").alias("id")).agg(F.sort_array(F.collect_list(F.struct("group", "cx", "cy"))).alias("c")))
    slices = [F.slice("c", groups * k // chunks + 1, groups * (k + 1) // chunks - groups * k // chunks) for k in range(chunks)]
    cell = F.transform("c", lambda g: F.xxhash64(g["cx"], g["cy"]).cast("double"))
    return written(at.select("id", F.array(*map(F.xxhash64, slices)).alias("codes"), cell.alias("x"))), least


def radius_vote(cells: DataFrame, key: str, groups: int, percent: float) -> DataFrame:
    """(a, b, votes): pairs that share the cell in more than `percent` of the groups.

    A pair that shares so many shares all groups of one of a few chunks at least, so chunks are what is joined: no pair is missed, and
    a bucket holds those that agree in several groups at once.
    """
    rows, least = _vote_rows(cells, key, groups, percent)
    return blocks.pairs(rows, least, blocks.equal_places).select("a", "b", F.col("score").cast("long").alias("votes"))


def radius_links(cells: DataFrame, key: str, groups: int, percent: float) -> DataFrame:
    """(id, n_links, best, votes) of the rows that have such a pair: how many, and the one with the most votes."""
    rows, least = _vote_rows(cells, key, groups, percent)
    return blocks.links(rows, least, blocks.equal_places).select("id", "n_links", "best", F.col("best_score").cast("long").alias("votes"))


def probes_against_all(df: DataFrame, probes: DataFrame, key: str, vector: str, threshold: float, block: int = 256) -> DataFrame:
    """(probe, other, corr): a stated set of query rows against all rows, in blocks.

    Blocks of probes meet blocks of rows: a row is copied once for each block of probes, not for each probe, and a task multiplies one
    block of each at a time. Blocks of rows have about `block` rows, however many rows there are. A constant vector correlates with none.
    """
    good = F.col("z").isNotNull() & ~F.exists("z", lambda v: v.isNull())
    rows, asked = (written(scaled(x, vector).select(F.col(key).cast("long").alias("id"), "z")).filter(good) for x in (df, probes))
    return _multiplied(rows, asked, threshold, block)


def _multiplied(rows: DataFrame, asked: DataFrame, threshold: float, block: int) -> DataFrame:
    """(probe, other, corr) of vectors (id, z) whose product reaches the threshold."""
    n, m = (max(1, -(-x.count() // block)) for x in (asked, rows))
    left = asked.select(F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("p"), "id", "z").groupBy("p").agg(F.collect_list("id").alias("ids"), F.flatten(F.collect_list("z")).alias("zs"))
    right = rows.select(F.pmod(F.xxhash64("id"), F.lit(m)).cast("int").alias("r"), "id", "z").groupBy("r").agg(
        F.collect_list("id").alias("others"), F.flatten(F.collect_list("z")).alias("os")
    )
    met = right.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).join(left, "p").select("ids", "zs", "others", "os")

    def multiply(batches):
        for batch in batches:
            for a, x, b, y in zip(*(batch.column(k) for k in range(4))):
                a, x, b, y = (v.values.to_numpy(zero_copy_only=False) for v in (a, x, b, y))
                corr = np.round(x.reshape(len(a), -1) @ y.reshape(len(b), -1).T, 6)
                i, j = np.nonzero((corr >= threshold) & (a[:, None] != b[None, :]))
                yield pa.RecordBatch.from_arrays([pa.array(a[i]), pa.array(b[j]), pa.array(corr[i, j])], ["probe", "other", "corr"])

    return met.mapInArrow(multiply, "probe long, other long, corr double")


def simulation_windows(df: DataFrame, sim: str, time: str, channels: list[str], width: int, step: int, bits: int, seed: int) -> DataFrame:
    """(sim, start, vals, hw) of whole-number channels at every whole time: windows of `width` times from each multiple of `step`;
    channels are taken from their half maximum (a whole number), and hw counts the positive signs of random projections of the window."""
    spread = df.withColumn(
        "start",
        F.explode(F.expr(f"sequence(({time} div {step}) * {step}, (greatest({time} - {width} + 1, 0) + {step} - 1) div {step} * {step}, -{step})"))
    )
    spread = spread.filter((F.col("start") <= F.col(time)) & (F.col(time) < F.col("start") + width))
    got = spread.groupBy(sim, "start").agg(
        F.count("*").alias("n"), *[F.max(c).alias(f"_max_{c}") for c in channels], F.sort_array(F.collect_list(F.struct(time, *channels))).alias("x")
    ).filter(F.col("n") == width)
    vals = [F.transform(F.col(f"x.{c}"), lambda v: v.cast("double")) for c in channels]
    centred = F.concat(*[F.zip_with(v, F.array_repeat(F.expr(f"_max_{c} div 2"), F.size("x")), lambda a, m: a - m) for v, c in zip(vals, channels)])
    return got.select(
        sim, "start", F.array(*vals).alias("vals"),
        F.size(F.filter(projected(centred, projection(bits, width * len(channels), seed)), lambda v: v > 0)).alias("hw")
    )


def weighted_correlation(a: Column, b: Column, weights: list[float]) -> Column:
    """Of windows with their channels scaled: the weighted sum of the channels' correlations."""
    return F.round(sum((w * dot(F.get(a, F.lit(k)), F.get(b, F.lit(k))) for k, w in enumerate(weights)), F.lit(0.0)), 6)


def angle_width(threshold: float, bits: int) -> int:
    """The number of bits by which windows with a correlation of the threshold are expected to differ, rounded up."""
    return math.ceil(math.acos(threshold) / math.pi * bits)


def simulation_pairs(windows: DataFrame, sim: str, threshold: float, bits: int, weights: list[float], k: int) -> DataFrame:
    """(a_sim, a_start, b_sim, b_start, gap, corr): for each window the `k` windows of other simulations whose Hamming weights are nearest, at most
    the angle's width apart (of equals the first by simulation and start); of these, those with the threshold's weighted correlation.

    Of the windows with one weight only the first k of a simulation, and of these the first 2 * k, can be among anyone's k: that leaves
    2 * k * (bits + 1) windows at most, whatever the input, which every window looks at.
    """
    width = angle_width(threshold, bits)
    z = written(windows.select(F.col(sim).alias("sim"), "start", "hw", F.transform("vals", standard).alias("z")))
    own, all_ = Window.partitionBy("hw", "sim").orderBy("start"), Window.partitionBy("hw").orderBy("sim", "start")
    few = z.select("sim", "start", "hw").withColumn("n", F.row_number().over(own)).filter(F.col("n") <= k).withColumn("n", F.row_number().over(all_)).filter(F.col("n") <= 2 * k)
    b = few.select(F.col("sim").alias("b_sim"), F.col("start").alias("b_start"), F.col("hw").alias("near"))
    a = z.select(F.col("sim").alias("a_sim"), F.col("start").alias("a_start"), "hw", F.explode(F.sequence(F.col("hw") - width, F.col("hw") + width)).alias("near"))
    met = a.join(F.broadcast(b), "near").filter("a_sim <> b_sim").withColumn("gap", F.abs(F.col("hw") - F.col("near")))
    nearest = Window.partitionBy("a_sim", "a_start").orderBy("gap", "b_sim", "b_start")
    best = met.withColumn("place", F.row_number().over(nearest)).filter(F.col("place") <= k)  # on ids alone; the values of the k chosen are joined
    for p in "ab":
        best = best.join(z.select(F.col("sim").alias(f"{p}_sim"), F.col("start").alias(f"{p}_start"), F.col("z").alias(f"{p}_z")), [f"{p}_sim", f"{p}_start"])
    return best.withColumn("corr", weighted_correlation(F.col("a_z"), F.col("b_z"), weights)).filter(F.col("corr") >= threshold).select("a_sim", "a_start", "b_sim", "b_start", "gap", "corr")


def similar_to(windows: DataFrame, asked: DataFrame, sim: str, threshold: float, weights: list[float], k: int, before: int | None = None, block: int = 64) -> DataFrame:
    """For each window that is asked for (sim, start), the k most correlated windows of other simulations, of those that start before `before` where given.

    A window's scaled channels, each times the root of its weight, are one vector, whose products with others are the weighted correlations; so
    the list asked for meets all windows in blocks, as any stated query set does. Windows have ids by simulation and start.
    """
    z = windows.withColumn(
        "z",
        F.flatten(F.transform(
            F.zip_with(F.transform("vals", standard), F.array(*[F.lit(w**0.5) for w in weights]), lambda c, w: F.struct(c.alias("c"), w.alias("w"))),
            lambda s: F.transform(s["c"], lambda v: v * s["w"])
        ))
    )
    rows = written(z.select(sim, "start", "z").withColumn("id", F.xxhash64(sim, "start")))
    found = _multiplied(rows if before is None else rows.filter(F.col("start") < before), rows.join(asked, [sim, "start"], "left_semi"), threshold, block)
    for p, c in (("a", "probe"), ("b", "other")):
        found = found.join(rows.select(F.col("id").alias(c), F.col(sim).alias(f"{p}_sim"), F.col("start").alias(f"{p}_start")), c)
    best = Window.partitionBy("a_sim", "a_start").orderBy(F.desc("corr"), "b_sim", "b_start")
    return found.filter("a_sim <> b_sim").withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k).select("a_sim", "a_start", "b_sim", "b_start", "corr")
