"""Synopses kept up to date by Structured Streaming."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.frequency import CountMin


def count_min_stream(stream: DataFrame, spec: CountMin, key: str, value: str | None = None) -> DataFrame:
    """(row, bucket, cnt), to be written in update or complete mode: the counters are the query's state, at most depth * width of them."""
    weight = F.lit(1).cast("long") if value is None else F.col(value).cast("long")
    return stream.select(weight.alias("w"), F.posexplode(spec.buckets(F.col(key))).alias("row", "bucket")).groupBy("row", "bucket").agg(F.sum("w").alias("cnt"))


def distinct_by_window(stream: DataFrame, time: str, window: str, late: str, value: str) -> DataFrame:
    """(start, distinct): approximate distinct values of event-time windows; data later than `late` are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window)).agg(F.approx_count_distinct(value).alias("distinct")).select(F.col("window.start").alias("start"), "distinct")


def trajectory_stream(stream: DataFrame, ship: str, period: float, distance: float, knots: float, course: float) -> DataFrame:
    """(ship, t, lat, lon, course, speed) of the positions worth keeping, as the batch operator; the state is a ship's last kept position."""
    from tidemark.functions.geo import far_apart

    def keep(key, frames, state: GroupState):
        last = state.get if state.exists else None
        for frame in frames:
            chosen = []
            for r in frame.sort_values("t", kind="stable").itertuples(index=False):
                now = (r.t, r.lat, r.lon, r.course, r.speed)
                if last is None or far_apart(last, now, period, distance, knots, course):
                    chosen.append((key[0], *now))
                    last = now
            yield pd.DataFrame(chosen, columns=["ship", "t", "lat", "lon", "course", "speed"])
        if last is not None:
            state.update(last)

    kind = stream.schema[ship].dataType.simpleString()
    return stream.groupBy(ship).applyInPandasWithState(
        keep, f"ship {kind}, t long, lat double, lon double, course double, speed double", "t long, lat double, lon double, course double, speed double", "append", GroupStateTimeout.NoTimeout
    )


def into_table(sketch: DataFrame, path: str, checkpoint: str):
    """Starts writing every batch's counters to its own folder of a Parquet table; the newest row of a counter is its value."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")  # a batch that is repeated after a failure replaces itself

    return sketch.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest(counters: DataFrame) -> DataFrame:
    """The sketch of a table of updates (row, bucket, cnt, batch)."""
    return counters.groupBy("row", "bucket").agg(F.max_by("cnt", "batch").alias("cnt"))
