"""Queries of samples, quantiles and top-k series."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.hashing import coefficients, hashed_sql
from tidemark.operators import quantiles, sampling, topk
from tidemark.plans.spec import REQUEST
from tidemark.storage import shared_folder
from tidemark.streaming.serving import served

from ._tables import as_stream, finished, table

ORDER = ["ts", "event_id"]


def hash_sql(seed: int) -> str:
    return hashed_sql("event_id", coefficients(1, seed)[0])


def events(spark, d):
    return table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")


def chain_sample(spark, d):
    return sampling.chain_sample(events(spark, d), "event_type", ORDER, "event_id", size=20, window=500).select("event_type", "event_id", "value")


CHAIN = f"""WITH l AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 500)
SELECT event_type, event_id, value FROM l QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY {hash_sql(21)}, event_id) <= 20"""


def wor_sample(spark, d):
    return sampling.without_replacement(events(spark, d), "event_id", 100).select("event_id", "value")


WOR = f"SELECT event_id, value FROM events ORDER BY {hash_sql(22)}, event_id LIMIT 100"


def coordinator_sample(spark, d):
    """The same sample from four sites that each send theirs."""
    e = events(spark, d)
    return sampling.merge_samples(
        "event_id", 100, *[sampling.without_replacement(e.filter(F.col("user_id") % 4 == k), "event_id", 100) for k in range(4)]
    ).select("event_id", "value")


def bernoulli_sample(spark, d):
    return sampling.bernoulli(events(spark, d), "event_id", 4).select("event_id", "user_id")


BERNOULLI = f"SELECT event_id, user_id FROM events WHERE {hash_sql(23)} % 16 = 0"


def window_wor_sample(spark, d):
    """Ten events of each day."""
    return sampling.lowest(events(spark, d).withColumn("day", F.date_format("ts", "yyyy-MM-dd")), ["day"], "event_id", 10, 24).select("day", "event_id")


WINDOW_WOR = f"SELECT strftime(ts, '%Y-%m-%d') AS day, event_id FROM events QUALIFY row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY {hash_sql(24)}, event_id) <= 10"

LAT, LON = coefficients(2, 25)


def positions(spark, d):
    """Events as ships' positions: the user is the ship, place and motion follow from hashes of the event."""
    x = sampling.number(F.col("event_id"))
    return events(spark, d).select(
        F.col("user_id").alias("ship"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"), "event_id",
        (F.lit(37.0) + sampling.hashed(x, LAT, 1000) / 1e6).alias("lat"), (F.lit(23.0) + sampling.hashed(x, LON, 1000) / 1e6).alias("lon"),
        (F.col("event_id") % 7 * 2.0).alias("course"), F.when(F.col("event_id") % 50 != 0, F.col("event_id") % 5 * 1.0).alias("speed"),
    )


def trajectory_sample(spark, d):
    return sampling.trajectory_sample(positions(spark, d), "ship", ["t", "event_id"], period=40_000, distance=80, knots=3, course=9).select("ship", "t", "event_id")


TRAJECTORY = f"""WITH RECURSIVE p AS (SELECT user_id AS ship, floor(epoch(ts))::BIGINT AS t, event_id, 37.0 + {hashed_sql('event_id', LAT, 1000)} / 1e6::DOUBLE AS lat, 23.0 + {hashed_sql('event_id', LON, 1000)} / 1e6::DOUBLE AS lon,
  event_id % 7 * 2.0::DOUBLE AS course, CASE WHEN event_id % 50 <> 0 THEN event_id % 5 * 1.0::DOUBLE END AS speed, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts))::BIGINT, event_id) AS rn FROM events),
k(ship, rn, event_id, t, lt, lla, llo, lc, ls, kept) AS (
  SELECT ship, rn, event_id, t, t, lat, lon, course, speed, true FROM p WHERE rn = 1
  UNION ALL
  SELECT ship, rn, event_id, t, CASE WHEN new THEN t ELSE lt END, CASE WHEN new THEN lat ELSE lla END, CASE WHEN new THEN lon ELSE llo END, CASE WHEN new THEN course ELSE lc END, CASE WHEN new THEN speed ELSE ls END, new FROM (
    SELECT p.*, lt, lla, llo, lc, ls, (p.t - lt > 40000 OR 2 * 6371008.8 * asin(sqrt(pow(sin((radians(lat) - radians(lla)) / 2), 2) + cos(radians(lla)) * cos(radians(lat)) * pow(sin((radians(lon) - radians(llo)) / 2), 2))) > 80
      OR course IS NULL OR speed IS NULL OR lc IS NULL OR ls IS NULL OR abs(course - lc) > 9 OR abs(speed - ls) > 3) AS new
    FROM k JOIN p ON p.ship = k.ship AND p.rn = k.rn + 1))
SELECT ship, t, event_id FROM k WHERE kept"""


def gk_quantile(spark, d):
    """Price quantiles of each return flag; whether each is within eps of its rank."""
    lines = table(spark, d, "lineitem")
    got = quantiles.approximate(lines, ["l_returnflag"], "l_extendedprice", [0.1, 0.5, 0.9, 0.99], eps=0.001)
    rows = lines.join(F.broadcast(got), "l_returnflag").groupBy("l_returnflag", "q").agg(
        F.count("*").alias("n"), F.sum((F.col("l_extendedprice") < F.col("value")).cast("int")).alias("below"), F.sum((F.col("l_extendedprice") <= F.col("value")).cast("int")).alias("upto")
    )
    return rows.select(
        "l_returnflag", "q", "n",
        ((F.col("below") <= (F.col("q") + 0.001) * F.col("n") + 1) & (F.col("upto") >= (F.col("q") - 0.001) * F.col("n") - 1)).alias("within")
    )


GK = "SELECT l_returnflag, q::DOUBLE AS q, count(*) AS n, true AS within FROM lineitem, (SELECT unnest([0.1, 0.5, 0.9, 0.99]) AS q) GROUP BY l_returnflag, q"


def window_quantile(spark, d):
    return quantiles.of_last(events(spark, d), "user_id", ORDER, "value", 0.75, 50)


WINDOW_Q = "WITH l AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 50) SELECT user_id, count(value) AS n, quantile_disc(value, 0.75) AS value FROM l GROUP BY user_id"


def window_ranks_stream(spark, d):
    """The third quartile of the last 200 values of each event type, asked of a stream that holds blocks of doubling length: whether it is within a twentieth
    of the window's ranks."""
    events_ = as_stream(spark, d, "events")
    order = F.unix_timestamp(F.col("ts").cast("timestamp")) * 1_000_000_000 + F.pmod("event_id", F.lit(1_000_000_000))
    fields = F.create_map(F.lit("type"), "event_type", F.lit("value"), F.col("value").cast("string"))
    elements = events_.select(F.lit("events").alias("dataset"), F.col("event_type").alias("stream"), fields.alias("fields"), order.alias("at"))
    folder = f"{shared_folder(spark)}/asked-{uuid.uuid4().hex}"
    rows = [("events", 1, 16, 1, "all", ["type", "value", "Queryable", "0.05", "200"], 3, -1), ("events", 3, 16, 1, "all", ["0.75"], 3, 1 << 62)]
    schema = T.StructType([*REQUEST.fields, T.StructField("at", T.LongType())])
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(folder)
    said = finished(served(elements, spark.readStream.schema(schema).parquet(folder), parts=3)).select(
        F.substring_index("key", "_", 1).alias("event_type"), F.col("estimation").cast("double").alias("said")
    )
    last = sampling.last_rows(events(spark, d), "event_type", ORDER, 200).join(said, "event_type")
    ranks = last.groupBy("event_type").agg(
        F.count("*").alias("n"), F.sum((F.col("value") < F.col("said")).cast("int")).alias("below"),
        F.sum((F.col("value") <= F.col("said")).cast("int")).alias("upto")
    )
    return ranks.select("event_type", "n", ((F.col("below") - 11 <= 0.75 * F.col("n")) & (0.75 * F.col("n") <= F.col("upto") + 11)).alias("within"))


WINDOW_RANKS = "SELECT event_type, least(count(*), 200) AS n, true AS within FROM events GROUP BY event_type"


def daily(spark, d):
    return events(spark, d).groupBy("user_id", F.dayofmonth("ts").alias("day")).agg(F.round(F.sum("value"), 2).alias("total"))


DAILY = "daily AS (SELECT user_id, day(ts)::INT AS day, round(sum(value), 2) AS total FROM events GROUP BY ALL)"


def topk_series(spark, d):
    """The five users with the lowest sums on the tenth day."""
    return topk.lowest_at(daily(spark, d), "user_id", "day", "total", 10, 5)


TOPK = f"WITH {DAILY} SELECT user_id, total FROM daily WHERE day = 10 ORDER BY total, user_id LIMIT 5"


def topk_merged(spark, d):
    """The users strictly below the sixth lowest, from the answers of three partitions of the users."""
    rows = daily(spark, d)
    return topk.merge_lowest(5, "total", *[topk.lowest_at(rows.filter(F.col("user_id") % 3 == k), "user_id", "day", "total", 10, 6) for k in range(3)])


TOPK_MERGED = f"WITH {DAILY} SELECT user_id, total FROM daily WHERE day = 10 AND total < coalesce((SELECT total FROM daily WHERE day = 10 ORDER BY total OFFSET 5 LIMIT 1), 1e300)"


def topk_pruned(spark, d):
    """In ten groups of users, the three lowest at the end and the users that pruning dropped."""
    rows = daily(spark, d).withColumn("part", F.col("user_id") % 10)
    return topk.pruned(rows, "part", "user_id", "day", "total", k=3, countdown=4).withColumn("pruned_at", F.coalesce("pruned_at", F.lit(-1)))


#: The same row by row, with a list of what each group knows of its series.
TOPK_PRUNED = f"""WITH RECURSIVE {DAILY}, r AS (SELECT user_id % 10 AS part, user_id AS s, day AS t, total AS v, row_number() OVER (PARTITION BY user_id % 10 ORDER BY day, user_id) AS rn FROM daily),
k(part, rn, st) AS (
  SELECT part, 0::BIGINT, CAST([] AS STRUCT(s BIGINT, v DOUBLE, gap DOUBLE, "left" INTEGER, gone INTEGER)[]) FROM r GROUP BY part
  UNION ALL
  SELECT part, rn, CASE WHEN old.gone IS NOT NULL THEN st ELSE list_append(others, {{'s': s, 'v': v, 'gap': gap, 'left': still, 'gone': CASE WHEN still <= 0 THEN t END}}) END FROM (
    SELECT *, CASE WHEN gap IS NOT NULL THEN CASE WHEN gap > coalesce(old.gap, 0.0) THEN coalesce(old.left, 4) - 1 ELSE 4 END END AS still FROM (
      SELECT *, CASE WHEN len(alive) > 3 AND v > alive[3] THEN v - alive[3] END AS gap FROM (
        SELECT *, list_sort(list_append(list_transform(list_filter(others, lambda x: x.gone IS NULL), lambda x: x.v), v)) AS alive FROM (
          SELECT r.part, r.rn, r.s, r.t, r.v, st, list_filter(st, lambda x: x.s = r.s)[1] AS old, list_filter(st, lambda x: x.s <> r.s) AS others FROM k JOIN r ON r.part = k.part AND r.rn = k.rn + 1))))),
e AS (SELECT part, unnest(arg_max(st, rn)) AS x FROM k GROUP BY part)
SELECT part AS "group", x.s AS series, x.v AS value, coalesce(x.gone, -1) AS pruned_at FROM e QUALIFY x.gone IS NOT NULL OR row_number() OVER (PARTITION BY part, x.gone IS NULL ORDER BY x.v, x.s) <= 3"""

def topk_together(spark, d):
    """The five users with the lowest sums of the last day when all users step through the days together, and those dropped on the way."""
    return topk.pruned_together(daily(spark, d), "user_id", "day", "total", 5, 3).withColumn("pruned_at", F.coalesce("pruned_at", F.lit(-1)))


TOGETHER = f"""WITH RECURSIVE {DAILY}, days AS (SELECT day, row_number() OVER (ORDER BY day) AS n FROM (SELECT DISTINCT day FROM daily)),
r AS (SELECT 0::BIGINT AS n, user_id, 0.0::DOUBLE AS gap, 0 AS grown, NULL::INT AS pruned_at, NULL::DOUBLE AS total FROM (SELECT DISTINCT user_id FROM daily) UNION ALL
SELECT n + 1, user_id, CASE WHEN live THEN new_gap ELSE gap END, CASE WHEN live THEN CASE WHEN new_gap > gap THEN grown + 1 ELSE 0 END ELSE grown END,
  CASE WHEN live AND new_gap > gap AND grown + 1 >= 3 THEN day ELSE pruned_at END, CASE WHEN pruned_at IS NULL THEN now ELSE total END
FROM (SELECT *, pruned_at IS NULL AND now IS NOT NULL AS live, greatest(now - coalesce(list_sort(list(now) FILTER (WHERE pruned_at IS NULL AND now IS NOT NULL) OVER ())[5], 'inf'::DOUBLE), 0.0) AS new_gap
  FROM (SELECT r.*, x.day, daily.total AS now FROM r JOIN days x ON x.n = r.n + 1 LEFT JOIN daily ON daily.user_id = r.user_id AND daily.day = x.day))),
l AS (SELECT * FROM r WHERE n = (SELECT max(n) FROM days))
SELECT user_id AS series, total AS value, pruned_at FROM l WHERE pruned_at IS NOT NULL
UNION ALL (SELECT user_id, total, -1 FROM l WHERE pruned_at IS NULL AND total IS NOT NULL ORDER BY total, user_id LIMIT 5)"""

QUERIES = {
    "chain_sample": (chain_sample, CHAIN), "wor_sample": (wor_sample, WOR), "coordinator_sample": (coordinator_sample, WOR), "bernoulli_sample": (bernoulli_sample, BERNOULLI),
    "window_wor_sample": (window_wor_sample, WINDOW_WOR), "trajectory_sample": (trajectory_sample, TRAJECTORY), "gk_quantile": (gk_quantile, GK), "window_quantile": (window_quantile, WINDOW_Q), "window_ranks_stream": (window_ranks_stream, WINDOW_RANKS),
    "topk_series": (topk_series, TOPK), "topk_merged": (topk_merged, TOPK_MERGED), "topk_pruned": (topk_pruned, TOPK_PRUNED), "topk_together": (topk_together, TOGETHER),
}
