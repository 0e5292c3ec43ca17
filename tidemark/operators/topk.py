"""The k lowest series at a time, with and without pruning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.storage import written


def lowest_at(df: DataFrame, series: str, time: str, value: str, at, k: int) -> DataFrame:
    return df.filter(F.col(time) == at).orderBy(value, series).limit(k).select(series, value)


def merge_lowest(k: int, value: str, *partials: DataFrame) -> DataFrame:
    """Of partial answers with k + 1 rows each, the rows strictly below the (k + 1)-th value of all."""
    rows = reduce(DataFrame.unionByName, partials)
    bar = F.nth_value(value, k + 1).over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))  # over the few rows of the partials
    return rows.withColumn("_bar", bar).filter(F.col("_bar").isNull() | (F.col(value) < F.col("_bar"))).drop("_bar")


def pruned(df: DataFrame, group: str, series: str, time: str, value: str, k: int, countdown: int) -> DataFrame:
    """(group, series, value, pruned_at): in each group (a partition of the series) the k lowest series after the last time; a series
    above the k-th whose gap to it has grown `countdown` times running is dropped and not looked at again. Groups are read as ordered
    streams; the state is one value for each series of the group."""

    def watch(frames):
        from bisect import bisect_left, insort

        import pandas as pd

        def result(g, values, gone):
            alive = sorted((v, s) for s, v in values.items() if s not in gone)[:k]
            return pd.DataFrame([(g, s, v, None) for v, s in alive] + [(g, s, values[s], t) for s, t in gone.items()], columns=["group", "series", "value", "pruned_at"])

        at, values, gaps, gone, alive = None, {}, {}, {}, []  # alive: the values of the series still looked at, in order
        for frame in frames:
            for g, s, t, v in zip(frame[group], frame[series], frame[time], frame[value]):
                if g != at:
                    if at is not None:
                        yield result(at, values, gone)
                    at, values, gaps, gone, alive = g, {}, {}, {}, []
                if s in gone:
                    continue
                if s in values:
                    del alive[bisect_left(alive, values[s])]
                values[s] = v
                insort(alive, v)
                if len(alive) > k and v > alive[k - 1]:
                    gap, left = v - alive[k - 1], gaps.get(s, (0.0, countdown))
                    left = (gap, left[1] - 1 if gap > left[0] else countdown)
                    gaps[s] = left
                    if left[1] <= 0:
                        gone[s] = t
                        del alive[bisect_left(alive, v)]
                else:
                    gaps.pop(s, None)
        if at is not None:
            yield result(at, values, gone)

    types = {f.name: f.dataType.simpleString() for f in df.schema}
    rows = df.select(*dict.fromkeys([group, series, time, value])).repartition(group).sortWithinPartitions(group, time, series)
    return rows.mapInPandas(watch, f"group {types[group]}, series {types[series]}, value {types[value]}, pruned_at {types[time]}")


def kth_lowest(df: DataFrame, time: str, value: str, series: str, k: int) -> DataFrame:
    """(time, bar): the k-th lowest value of each time that has so many. Only k rows of a time leave a task."""
    place = F.row_number().over(Window.partitionBy(time).orderBy(value, series))
    return df.select(time, value, series).withColumn("_n", place).filter(F.col("_n") <= k).groupBy(time).agg(F.count("*").alias("_c"), F.max(value).alias("bar")).filter(F.col("_c") == k).drop("_c")


def pruned_together(df: DataFrame, series: str, time: str, value: str, k: int, countdown: int) -> DataFrame:
    """(series, value, pruned_at): the k lowest series at the last time, and those that were dropped on the way, with the time and the value.

    All series step through the times together, wherever their rows lie: at each time the k-th lowest value of the series still looked
    at is the bar of all. A series above it whose gap to it has grown `countdown` times running is dropped and not looked at again.
    Bars depend on drops and drops on bars. So both are computed for all times at once, first as if nothing were dropped, and again with the drops found until
    these stay the same: a round is right at least up to one more time at which something is dropped.
    """
    rows = written(df.select(series, time, F.col(value).cast("double").alias(value)).filter(f"{value} IS NOT NULL AND NOT isnan({value})"))
    kind = {f.name: f.dataType for f in rows.schema}
    gone = written(rows.limit(0).select(series, F.col(time).alias("pruned_at")))
    by_series = Window.partitionBy(series).orderBy(time)
    while True:
        looked = rows.join(gone, series, "left").filter(F.col("pruned_at").isNull() | (F.col(time) <= F.col("pruned_at"))).drop("pruned_at")
        bars = written(kth_lowest(looked, time, value, series, k))
        gap = looked.join(bars, time, "left").withColumn("_gap", F.greatest(F.col(value) - F.coalesce("bar", F.lit(float("inf"))), F.lit(0.0)))
        grown = gap.withColumn("_grown", (F.col("_gap") > F.coalesce(F.lag("_gap").over(by_series), F.lit(0.0))).cast("int"))
        island = grown.withColumn("_island", F.sum(1 - F.col("_grown")).over(by_series.rowsBetween(Window.unboundedPreceding, 0)))
        times = island.withColumn("_run", F.sum("_grown").over(Window.partitionBy(series, "_island").orderBy(time).rowsBetween(Window.unboundedPreceding, 0)))
        before, gone = gone, written(times.filter(F.col("_run") >= countdown).groupBy(series).agg(F.min(time).alias("pruned_at")))
        if not before.exceptAll(gone).limit(1).count() and not gone.exceptAll(before).limit(1).count():
            break
    last = rows.agg(F.max(time)).scalar()
    left = rows.join(gone, series, "left_anti").filter(F.col(time) == last).orderBy(value, series).limit(k)
    out = rows.join(gone, series).filter(F.col(time) == F.col("pruned_at")).select(F.col(series).alias("series"), F.col(value).alias("value"), "pruned_at")
    return out.unionByName(left.select(F.col(series).alias("series"), F.col(value).alias("value"), F.lit(None).cast(kind[time]).alias("pruned_at")))
