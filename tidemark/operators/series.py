"""Time-series synopses: basic and sliding windows, Fourier digests, past windows, gap filling, returns, segments."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.arrays import interpolated
from tidemark.operators import blocks
from tidemark.storage import written


def numbered(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adds rn, the place of each row in its series from 0."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)


def basic_windows(df: DataFrame, key: str, value: str, size: int, coefs: int, more: tuple[Column, ...] = ()) -> DataFrame:
    """(key, bw, s, ss, re1, im1, ...): sums and Fourier sums of each full basic window of a numbered series, and more aggregates. They add up."""
    at = F.col("rn") % size
    aggs = [F.count("*").alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("ss")]
    for m in range(1, coefs + 1):
        angle = F.lit(2 * math.pi * m / size) * at
        aggs += [F.sum(F.col(value) * F.cos(angle)).alias(f"re{m}"), F.sum(-F.col(value) * F.sin(angle)).alias(f"im{m}")]
    return df.groupBy(key, F.expr(f"rn div {size}").alias("bw")).agg(*aggs, *more).filter(F.col("n") == size).drop("n")


def sliding_dft(basic: DataFrame, key: str, size: int, windows: int, coefs: int, more: dict[str, Column] | None = None) -> DataFrame:
    """(key, w, mean, sigma, re1, im1, ...) of every sliding window of `windows` basic windows, w the last of them: the Fourier
    coefficients m * windows of the window scaled to mean 0 and length 1, and more aggregates of its basic windows. Constant windows are left out."""
    over = Window.partitionBy(key).orderBy("bw").rowsBetween(1 - windows, 0)
    names = ["s", "ss", *[f"{c}{m}" for m in range(1, coefs + 1) for c in ("re", "im")]]
    summed = basic.select(
        key, "bw", F.count("*").over(over).alias("n"), (F.col("bw") - F.min("bw").over(over)).alias("span"),
        *[F.sum(c).over(over).alias(c) for c in names], *[c.over(over).alias(n) for n, c in (more or {}).items()]
    )
    length = size * windows
    full = summed.filter((F.col("n") == windows) & (F.col("span") == windows - 1)).withColumn("mean", F.col("s") / length)
    full = full.withColumn("var", F.col("ss") / length - F.col("mean") * F.col("mean")).filter("var > 1e-9").withColumn("sigma", F.sqrt("var"))
    return full.select(key, F.col("bw").alias("w"), "mean", "sigma", *[(F.col(c) / (F.col("sigma") * length)).alias(c) for c in names[2:]], *(more or {}))


def _collected(value: str, time: str) -> tuple[Column, ...]:
    """Of a basic window: its last time, and its values in their order."""
    return F.max(time).alias("at"), F.sort_array(F.collect_list(F.struct("rn", F.col(value).alias("v")))).alias("x")


def _put_together() -> dict[str, Column]:
    """Of a window: the same of its basic windows."""
    return {"at": F.max("at"), "vals": F.collect_list(F.transform("x", lambda s: s["v"]))}


def with_scaled(windows: DataFrame, length: int) -> DataFrame:
    """Adds z, the values vals scaled to mean 0 and length 1, null where they are all equal."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    got = windows.withColumn("_m", total("vals") / length).withColumn(
        "_sd",
        F.when(F.array_min("vals") < F.array_max("vals"), F.sqrt(total(F.transform("vals", lambda v: (v - F.col("_m")) * (v - F.col("_m")))) / length))
    )
    return got.withColumn("z", F.transform("vals", lambda v: (v - F.col("_m")) / (F.col("_sd") * math.sqrt(length)))).drop("_m", "_sd")


def raw_windows(df: DataFrame, key: str, value: str, time: str, size: int, windows: int, slide: int = 1) -> DataFrame:
    """(key, w, at, vals, z): the values of every sliding window of a numbered series whose number is a multiple of `slide`, its last time,
    and the values scaled to mean 0 and length 1 (null where they are all equal). Values are collected once, in basic windows, which a frame puts together."""
    basic = df.groupBy(key, F.expr(f"rn div {size}").alias("bw")).agg(F.count("*").alias("n"), *_collected(value, time)).filter(F.col("n") == size)
    over = Window.partitionBy(key).orderBy("bw").rowsBetween(1 - windows, 0)
    whole = (F.count("*").over(over) == windows) & (F.col("bw") - F.min("bw").over(over) == windows - 1)
    got = basic.select(key, F.col("bw").alias("w"), whole.alias("whole"), *[c.over(over).alias(n) for n, c in _put_together().items()])
    got = got.filter(F.col("whole") & (F.col("w") % slide == 0)).withColumn("vals", F.flatten("vals"))
    return with_scaled(got, size * windows).select(key, "w", "at", "vals", "z")


#: A cell's neighbours that it looks at, so that every pair of cells meets once: itself, right, below, below right, above right.
FORWARD = ((0, 0), (1, 0), (0, 1), (1, 1), (1, -1))


def on_grid(digests: DataFrame, threshold: float) -> DataFrame:
    """Adds cx, cy, the cell of the first coefficient. Windows with a correlation of at least `threshold` are at most one cell apart."""
    side = math.sqrt(1 - threshold)
    return digests.withColumns({"cx": F.floor(F.col("re1") / side), "cy": F.floor(F.col("im1") / side)})


def correlated(
    left: DataFrame, right: DataFrame, key: str, equal: list[str], condition: Column | None, threshold: float, coefs: int, both_ways: bool = False,
    band: tuple[str, float] | None = None
) -> DataFrame:
    """Pairs of digests (columns key, w, cx, cy, re1, ...) in the same or neighbouring cells with 1 - sum |difference|**2 >= threshold.

    left and right have the columns prefixed a_ and b_. With both_ways left probes every neighbour of its cell, as right has other rows; else
    each unordered pair of one table is met once. With a band (a column, a width), the two differ by at most the width in that column, and
    only cells of the same or a neighbouring stretch of it meet. bound is an upper bound of the correlation.
    """
    offsets = [(x, y) for x in (-1, 0, 1) for y in (-1, 0, 1)] if both_ways else FORWARD
    moved = left.withColumn("o", F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in offsets])))
    moved = moved.withColumns({"nx": F.col("a_cx") + F.col("o.x"), "ny": F.col("a_cy") + F.col("o.y"), "home": (F.col("o.x") == 0) & (F.col("o.y") == 0)}).drop("o")
    on = (F.col("nx") == F.col("b_cx")) & (F.col("ny") == F.col("b_cy"))
    if band is not None:
        column, width = band
        stretch = lambda p: F.floor(F.col(f"{p}_{column}") / width)
        moved = moved.withColumn("stretch", F.explode(F.sequence(stretch("a") - 1, stretch("a") + 1)))
        right = right.withColumn("b_stretch", stretch("b"))
        on &= (F.col("stretch") == F.col("b_stretch")) & (F.abs(F.col(f"a_{column}") - F.col(f"b_{column}")) <= width)
    for c in equal:
        on &= F.col(f"a_{c}") == F.col(f"b_{c}")
    if condition is not None:
        on &= condition
    first = F.struct(f"a_{key}", "a_w") < F.struct(f"b_{key}", "b_w")
    met = moved.join(right, on)
    if not both_ways:
        met = met.filter(~F.col("home") | first)
    gap = sum((F.pow(F.col(f"a_{c}{m}") - F.col(f"b_{c}{m}"), 2) for m in range(1, coefs + 1) for c in ("re", "im")), F.lit(0.0))
    return met.withColumn("bound", F.round(1 - gap, 6)).filter(F.col("bound") >= threshold)


def prefixed(df: DataFrame, p: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns])


def past_windows(df: DataFrame, key: str, value: str, time: str, order: list[str], size: int, windows: int, coefs: int, threshold: float) -> DataFrame:
    """(key, w, at, vals, z, re1, ..., cx, cy): all past windows of all series with their digests, on the grid. Values and digests are collected together, so that
    a series is shuffled once."""
    rows = numbered(df.select(*dict.fromkeys([key, value, time, *order])), key, order)
    basic = basic_windows(rows, key, value, size, coefs, _collected(value, time))
    both = sliding_dft(basic, key, size, windows, coefs, _put_together()).withColumn("vals", F.flatten("vals"))
    return with_scaled(on_grid(both, threshold), size * windows)


def verified(pairs: DataFrame, threshold: float, length: int) -> DataFrame:
    """Candidate pairs of windows of `length` values with their exact correlation, of at least the threshold. The scaled values go along with the digests:
    where a threshold is low most candidates stay, and joining values to them would cost more than they do."""
    if length <= 64:  # few enough terms to be compiled
        corr = sum((F.get("a_z", F.lit(i)) * F.get("b_z", F.lit(i)) for i in range(length)), F.lit(0.0))
    else:
        corr = F.aggregate(F.zip_with("a_z", "b_z", lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    return pairs.withColumn("corr", F.round(corr, 6)).filter(F.col("corr") >= threshold)


def closeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """1 - the squared distance of every two rows: for digests, the bound of their windows' correlation."""
    return 1 - ((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T)


def grid_pairs(
    windows: DataFrame, key: str, vector: str, threshold: float, score=blocks.correlation, equal: tuple[str, ...] = (), band: tuple[str, float] | None = None, name: str = "corr", told=None,
) -> DataFrame:
    """(a_key, a_w, b_key, b_w, corr): pairs of windows (key, w, re1, im1, a vector) of different series with a score of at least the threshold, alike in the
    columns `equal`, at most a width apart in the column of a band, a before b. With told, what it says of the vectors of the pairs found instead of their score.

    Such windows are at most sqrt(1 - threshold) apart in each part of their first coefficient. On a grid with cells of that side, the cells that a
    square of that side around a window touches, one of each parity in each direction, are its codes: two such windows share the cell between them. A band is
    one more direction. Where thresholds are so low that cells spare little, all windows alike in `equal` share one code instead. Who shares a code is compared in
    blocks, as matrix products; no candidate is ever a row, and no pair is shuffled.
    """
    side = math.sqrt(1 - threshold) * (1 + 1e-9)
    axes = [("re1", side), ("im1", side)] + ([(band[0], band[1] * (1 + 1e-9))] if band else [])
    low = [F.floor(F.col(c) / s - 0.5) for c, s in axes]
    cell = lambda k, parity: low[k] + F.when(F.pmod(low[k], F.lit(2)) == parity, 0).otherwise(1)
    codes = F.array(*[F.xxhash64(F.lit(c), *[cell(k, c >> k & 1) for k in range(len(axes))], *equal) for c in range(1 << len(axes))], F.xxhash64(F.lit(-1), *equal))
    more = [band[0]] if band and band[0] not in (key, "w") else []
    ids = written(windows.select(key, "w", *more, codes.alias("codes"), F.col(vector).alias("x")).filter(F.col("x").isNotNull() & F.col(key).isNotNull()).withColumn("id", F.xxhash64(key, "w")))  # deals windows to blocks
    ids, block = blocks.sparing(ids)
    found = blocks.named_pairs(ids, key, threshold, score, told, band, block)
    return found.withColumnRenamed("score", name)


def gap_filled(df: DataFrame, key: str, time: str, value: str, step: int) -> DataFrame:
    """Each value repeated for every `step` seconds since the one before it (columns key, time, value; time in seconds)."""
    before = F.lag(time).over(Window.partitionBy(key).orderBy(time))
    times = F.greatest(F.lit(1), F.floor((F.col(time) - F.coalesce("_before", F.col(time))) / step))
    return df.withColumn("_before", before).withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), times.cast("long")))).withColumn("_back", (times - F.col("_k")) * step).select(key, (F.col(time) - F.col("_back")).cast("long").alias(time), value)


def resampled(df: DataFrame, key: str, time: str, channels: list[str]) -> DataFrame:
    """Whole-number channels at every whole time between the first and the last of a series, linearly interpolated."""
    w = Window.partitionBy(key).orderBy(time)
    nxt = df.select("*", F.lead(time).over(w).alias("_t1"), *[F.lead(c).over(w).alias(f"_n_{c}") for c in channels])
    spread = nxt.withColumn("_t", F.explode(F.sequence(F.col(time), F.coalesce(F.col("_t1") - 1, F.col(time)))))
    return spread.select(
        key, F.col("_t").alias(time),
        *[F.when(F.col("_t1").isNull(), F.col(c)).otherwise(interpolated(
            F.col("_t"), F.col(time), F.col(c), F.coalesce("_t1", F.col(time)), F.coalesce(f"_n_{c}", F.col(c))
        )).cast("int").alias(c) for c in channels]
    )


def returns(df: DataFrame, key: str, order: list[str], value: str, size: int) -> DataFrame:
    """(key, w, returns): full tumbling windows of `size` returns value / before - 1. A value after a zero has none, as the first has none."""
    change = F.try_divide(F.col(value), F.lag(value).over(Window.partitionBy(key).orderBy(*order))) - 1
    rows = numbered(df.withColumn("r", change).filter("r IS NOT NULL"), key, order)
    got = rows.groupBy(key, F.expr(f"rn div {size}").alias("w")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("rn", "r"))).alias("x"))
    return got.filter(F.col("n") == size).select(key, "w", F.transform("x", lambda s: s["r"]).alias("returns"))


def segments(df: DataFrame, key: str, order: list[str], counted: Column, closing: Column) -> DataFrame:
    """(key, segment, cnt): the counted rows before each closing row, since the closing row before it."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = df.withColumn("_c", counted.cast("int")).withColumn("_e", closing.cast("int"))
    rows = rows.withColumn("segment", F.sum("_e").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_e"))
    return rows.groupBy(key, "segment").agg(F.sum("_c").alias("cnt"), F.max("_e").alias("closed")).filter("closed = 1").drop("closed")


def last_counts(counts: DataFrame, key: str, length: int) -> DataFrame:
    """(key, segment, counts): for every segment, the counts of the last `length` segments up to it."""
    w = Window.partitionBy(key).orderBy("segment").rowsBetween(1 - length, 0)
    return counts.select(key, "segment", F.collect_list("cnt").over(w).alias("counts"))


def cell_number(threshold: float) -> Column:
    """One number for the cell cx, cy of on_grid(): a coefficient of a scaled window is at most the root of a half, so there are 2 * k cells a side."""
    k = math.ceil(math.sqrt(0.5) / math.sqrt(1 - threshold))
    return (F.col("cx") + k) * (2 * k) + F.col("cy") + k


def magnitude(coefs: int) -> Column:
    """The sum of the coefficients' absolute values."""
    return sum((F.sqrt(F.col(f"re{m}") * F.col(f"re{m}") + F.col(f"im{m}") * F.col(f"im{m}")) for m in range(1, coefs + 1)), F.lit(0.0))


