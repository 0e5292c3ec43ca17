"""Queries of the control plane, the router and the payloads."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.hashing import hashed_sql, number, text_number_sql
from tidemark.operators.frequency import CountMin
from tidemark.operators.merging import merged
from tidemark.plans.engine import Engine
from tidemark.plans.routing import routed_elements, routed_requests
from tidemark.plans.spec import REQUEST
from tidemark.sources.connectors import datapoints, lines, multiplied, parsed
from tidemark.storage import shared_folder
from tidemark.streaming.control import controlled
from tidemark.streaming.serving import served

from ._tables import as_stream, finished, table
from .frequency import cm_sql, probe_sql
from .samples import hash_sql
from .series import SEGMENTS

KINDS = ["click", "error", "purchase", "signup", "view"]
SPEC = CountMin(eps=0.02, confidence=0.99, seed=5, text=True)


def request(number, uid, synopsis=1, param=(), parts=1):
    return {"dataSetkey": "events", "requestID": number, "synopsisID": synopsis, "uid": uid, "streamID": "all", "param": list(param), "noOfP": parts}


def request_lifecycle(spark, d):
    """Add a sketch in four partitions, estimate, delete, estimate again: the second estimate has no rows."""
    engine = Engine(spark)
    engine.register_dataset("events", table(spark, d, "events"))
    return engine.run([
        request(1, 7, param=["event_type", "null", "Queryable", "0.02", "0.99", "5"], parts=4), request(3, 7, param=KINDS), request(2, 7),
        request(3, 7, param=KINDS)
    ])


LIFECYCLE = f"""WITH {cm_sql(SPEC, 'events', 'event_type', '1')}, kinds AS (SELECT unnest({KINDS}) AS event_type), e AS ({probe_sql(SPEC, 'kinds', 'event_type')})
SELECT 7 AS uid, 3 AS "requestID", 1 AS "synopsisID", event_type AS key, estimate::VARCHAR AS estimation FROM e"""


def request_kinds(spark, d):
    """Synopses of many kinds added by requests, and what they say: the second message of each pair asks."""
    engine = Engine(spark)
    events = table(spark, d, "events").withColumn("day", F.dayofmonth("ts"))
    engine.register_dataset("events", events, ["ts", "event_id"])
    flags = events.select(
        "user_id", "ts", "event_id",
        F.when(F.col("event_type") == "view", "v1").when(F.col("event_type") == "purchase", "p2").otherwise("x").alias("flag")
    )
    engine.register_dataset("flags", flags, ["ts", "event_id"])
    engine.register_dataset("daily", events.groupBy("user_id", "day").agg(F.round(F.sum("value"), 2).alias("total")), ["day"])
    ask = [
        request(1, 1, 16, ["user_id", "value", "Queryable", "0.01", "50"]), request(3, 1, 16, ["0.75"]),
        {**request(1, 2, 13, ["user_id", "total", "day", "5", "4"]), "dataSetkey": "daily"}, request(3, 2, 13, ["5", "10"]),
        {**request(1, 3, 26, ["user_id", "flag", "Queryable"]), "dataSetkey": "flags"}, request(3, 3, 26),
        {**request(1, 4, 27, ["user_id", "flag", "Queryable", "5"]), "dataSetkey": "flags"}, request(3, 4, 27),
        request(1, 5, 10, ["event_type", "event_id", "Queryable", "20", "500"]), request(3, 5, 10),
    ]
    return engine.run(ask)


KINDS_SQL = f"""WITH q AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 50),
daily AS (SELECT user_id, day(ts)::INT AS day, round(sum(value), 2) AS total FROM events GROUP BY ALL), {SEGMENTS},
c AS (SELECT user_id, segment, list(cnt) OVER (PARTITION BY user_id ORDER BY segment ROWS 4 PRECEDING) AS counts FROM g QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY segment DESC) = 1),
l AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 500),
chain AS (SELECT event_type, event_id FROM l QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY {hash_sql(21)}, event_id) <= 20),
e AS (SELECT 1 AS uid, 16 AS "synopsisID", user_id || '_0.75' AS key, quantile_disc(value, 0.75)::VARCHAR AS estimation FROM q GROUP BY user_id
UNION ALL SELECT 2, 13, user_id::VARCHAR, total::VARCHAR FROM daily WHERE day = 10 AND total < coalesce((SELECT total FROM daily WHERE day = 10 ORDER BY total OFFSET 5 LIMIT 1), 1e300)
UNION ALL SELECT 3, 26, user_id || '|' || segment, cnt::VARCHAR FROM g
UNION ALL SELECT 4, 27, user_id::VARCHAR, array_to_string(counts, ',') FROM c
UNION ALL SELECT 5, 10, event_type, event_id::VARCHAR FROM chain)
SELECT uid, 3 AS "requestID", "synopsisID", key, estimation FROM e"""


def continuous_request(spark, d):
    """A continuous sketch: for each element, its key's weight up to it."""
    engine = Engine(spark)
    engine.register_dataset("events", table(spark, d, "events"), ["ts", "event_id"])
    return engine.run([request(5, 9, 1, ["event_type", "null", "Queryable", "0.02", "0.99", "5"])])


CONTINUOUS = f"""WITH spread AS ({' UNION ALL '.join(f"SELECT ts, event_id, event_type, {i} AS row, {hashed_sql(text_number_sql('event_type'), ab, SPEC.width)} AS bucket FROM events" for i, ab in enumerate(SPEC.hashes))}),
run AS (SELECT *, count(*) OVER (PARTITION BY row, bucket ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS cnt FROM spread)
SELECT 9 AS uid, 5 AS "requestID", 1 AS "synopsisID", event_type AS key, min(cnt)::VARCHAR AS estimation FROM run GROUP BY ts, event_id, event_type"""


def update_request(spark, d):
    """A sketch of one site's events that takes up another site's by a request, which is passed on."""
    engine = Engine(spark)
    e = table(spark, d, "events")
    engine.register_dataset("events", e.filter("user_id % 2 = 0"))
    engine.register_dataset("other", e.filter("user_id % 2 = 1"))
    found = engine.run([
        request(1, 7, param=["event_type", "null", "Queryable", "0.02", "0.99", "5"]), {**request(7, 7), "dataSetkey": "other"},
        request(3, 7, param=KINDS)
    ])
    return found.select(
        "uid", "requestID", "key",
        F.when(F.col("requestID") == 7, F.get_json_object("estimation", "$.dataSetkey")).otherwise(F.col("estimation")).alias("estimation")
    )


UPDATE = f"""WITH {cm_sql(SPEC, 'events', 'event_type', '1')}, kinds AS (SELECT unnest({KINDS}) AS event_type), e AS ({probe_sql(SPEC, 'kinds', 'event_type')})
SELECT 7 AS uid, 3 AS "requestID", event_type AS key, estimate::VARCHAR AS estimation FROM e UNION ALL SELECT 7, 7, 'other', 'other'"""

MIDDLE = 1_705_276_800  # 15 January 2024


def control_stream(spark, d):
    """Events and requests as two streams: a sketch is added before the first event, asked half way and at the end."""
    folder = f"{shared_folder(spark)}/control-{uuid.uuid4().hex}"
    param = ["event_type", "null", "Queryable", "0.02", "0.99", "5"]
    asked = [
        {**request(1, 7, param=param), "at": -1}, {**request(3, 7, param=KINDS), "at": MIDDLE}, {**request(3, 7, param=KINDS), "at": 1 << 40},
        {**request(3, 8, param=KINDS), "at": 1 << 40}
    ]
    spark.createDataFrame([(json.dumps(r),) for r in asked], "value string").coalesce(1).write.text(f"{folder}/requests")
    schema = T.StructType([*REQUEST.fields, T.StructField("at", T.LongType())])
    requests = parsed(lines(spark, f"{folder}/requests", stream=True), schema)
    path = f"{d}/events.parquet"
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[t]")  # a pattern, as the table may be one file or a folder
    elements = events.select(
        F.lit("events").alias("dataset"), F.col("event_type").alias("key"), F.lit(1).alias("weight"),
        F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at")
    )
    answers = controlled(elements, requests, parts=4)
    answers.writeStream.format("parquet").option("path", f"{folder}/answers").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(answers.schema).parquet(f"{folder}/answers")


def control_sql(at: str, where: str) -> str:
    part = f"{text_number_sql('key')} % 4"
    rows = lambda of, more: " UNION ALL ".join(f"SELECT key, {part} AS part, {i} AS row, {hashed_sql(text_number_sql('key'), ab, SPEC.width)} AS bucket{more} FROM {of}" for i, ab in enumerate(SPEC.hashes))
    return f"""SELECT key, {at} AS "at", min(coalesce(cnt, 0))::BIGINT::VARCHAR AS estimation FROM ({rows('kinds', '')}) p
LEFT JOIN (SELECT part, row, bucket, sum(w) AS cnt FROM ({rows(f"(SELECT event_type AS key, count(*) AS w FROM events WHERE {where} GROUP BY 1)", ', w')}) GROUP BY ALL) s USING (part, row, bucket) GROUP BY key"""


CONTROL = f"""WITH kinds AS (SELECT unnest({KINDS}) AS key), a AS ({control_sql(f'{MIDDLE}::BIGINT', f'floor(epoch(ts)) < {MIDDLE}')} UNION ALL {control_sql(f'{1 << 40}::BIGINT', 'true')})
SELECT 7 AS uid, 3 AS "requestID", 1 AS "synopsisID", key, estimation, "at" FROM a"""


LAST, EARLY, MONTH = 1 << 62, -1, "1995-03"


def served_requests(spark, d):
    """Events and requests as two streams, in two stateful stages: sketches of elements that are dealt at random to three parts, the lowest
    prices of a month, synopses of each user's series, a join size, a deletion, and requests that can't be served."""
    folder = f"{shared_folder(spark)}/served-{uuid.uuid4().hex}"
    counts, prices, flags = ["event_type", "null", "Queryable", "0.02", "0.99", "5"], ["order", "price", "month", "5", "4"], ["user_id", "flag", "Queryable"]
    adds = [
        request(4, 1, 1, counts), request(4, 2, 2, ["user_id", "null", "Queryable", "1000", "0.0001"]),
        {**request(4, 3, 13, prices), "dataSetkey": "orders"}, request(1, 4, 26, flags), request(1, 5, 27, [*flags, "5"]), request(1, 6, 1, counts),
        request(1, 7, 9, ["event_type"]), request(1, 8, 999, flags)
    ]
    asks = [
        request(3, 1, 1, KINDS), request(3, 2, 2, ["0", "7", "nobody"]), {**request(3, 3, 13, ["5", MONTH]), "dataSetkey": "orders"},
        request(3, 4, 26), request(3, 5, 27), request(6, 1, 1, ["2", "1", "6"]), request(3, 9, 1, KINDS)
    ]
    after = [request(2, 6), request(3, 6, 1, KINDS)]
    asked = [{**r, "at": at} for rs, at in ((adds, EARLY), (asks, LAST), (after, LAST + 1)) for r in rs]
    spark.createDataFrame([(json.dumps(r),) for r in asked], "value string").coalesce(1).write.text(f"{folder}/requests")
    requests = parsed(lines(spark, f"{folder}/requests", stream=True), T.StructType([*REQUEST.fields, T.StructField("at", T.LongType())]))
    events = as_stream(spark, d, "events")
    flag = F.when(F.col("event_type") == "view", "v1").when(F.col("event_type") == "purchase", "p2").otherwise("x")
    fields = lambda **named: F.create_map(*[x for n, c in named.items() for x in (F.lit(n), c.cast("string"))]).alias("fields")
    order = F.unix_timestamp(F.col("ts").cast("timestamp")) * 1_000_000_000 + F.pmod("event_id", F.lit(1_000_000_000))
    elements = events.select(
        F.lit("events").alias("dataset"), F.col("user_id").cast("string").alias("stream"),
        fields(event_type=F.col("event_type"), user_id=F.col("user_id"), flag=flag), order.alias("at")
    )
    of_orders = fields(order=F.col("o_orderkey"), price=F.col("o_totalprice"), month=F.date_format("o_orderdate", "yyyy-MM"))
    elements = elements.unionByName(as_stream(spark, d, "orders").select(
        F.lit("orders").alias("dataset"), F.col("o_orderkey").cast("string").alias("stream"), of_orders, F.col("o_orderkey").alias("at")
    ))
    return finished(served(elements, requests, parts=3, routes=("keyed", "random"))).drop("at")


SERVED = f"""WITH {cm_sql(SPEC, 'events', 'event_type', '1')}, kinds AS (SELECT unnest({KINDS}) AS event_type), e AS ({probe_sql(SPEC, 'kinds', 'event_type')}), {SEGMENTS},
c AS (SELECT user_id, segment, list(cnt) OVER (PARTITION BY user_id ORDER BY segment ROWS 4 PRECEDING) AS counts FROM g QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY segment DESC) = 1),
d AS (SELECT o_orderkey, o_totalprice AS value FROM orders WHERE strftime(o_orderdate, '%Y-%m') = '{MONTH}'),
j AS (SELECT "row", sum(cnt * cnt) AS s FROM sketch GROUP BY 1)
SELECT 1 AS uid, 3 AS "requestID", 1 AS "synopsisID", event_type AS key, estimate::VARCHAR AS estimation FROM e
UNION ALL SELECT 2, 3, 2, k, CASE WHEN k IN (SELECT user_id::VARCHAR FROM events) THEN 'true' ELSE 'false' END FROM (SELECT unnest(['0', '7', 'nobody']) AS k)
UNION ALL SELECT 3, 3, 13, o_orderkey::VARCHAR, value::VARCHAR FROM d WHERE value < coalesce((SELECT value FROM d ORDER BY value OFFSET 5 LIMIT 1), 1e300)
UNION ALL SELECT 4, 3, 26, user_id || '|' || segment, cnt::VARCHAR FROM g
UNION ALL SELECT 5, 3, 27, user_id::VARCHAR, array_to_string(counts, ',') FROM c
UNION ALL SELECT 1, 6, 1, '1,6', min(s)::BIGINT::VARCHAR FROM j
UNION ALL SELECT * FROM (VALUES (6, 3, 1, 'status', 'refused: no such synopsis is live'), (7, 1, 9, 'status', 'refused: lossy takes the parameters eps'), (8, 1, 999, 'status', 'refused: no synopsis has the number 999'), (9, 3, 1, 'status', 'refused: no such synopsis is live'))"""


def random_partitioning(spark, d):
    """The same with rows dealt at random, a Bloom filter beside it."""
    engine = Engine(spark)
    engine.register_dataset("events", table(spark, d, "events"))
    return engine.run([request(4, 8, 2, ["event_type", "null", "Queryable", "1000", "0.001"], 3), request(3, 8, 2, [*KINDS])])


RANDOM = f'SELECT 8 AS uid, 3 AS "requestID", 2 AS "synopsisID", k AS key, CASE WHEN k IN (SELECT event_type FROM events) THEN \'true\' ELSE \'false\' END AS estimation FROM (SELECT unnest({KINDS}) AS k)'


def keyed_routing(spark, d):
    """Elements and streams of each of four partitions by key."""
    e = table(spark, d, "events").withColumn("partition", (number(F.col("user_id")) % 4).cast("int"))
    return e.groupBy("partition").agg(F.count("*").alias("elements"), F.count_distinct("user_id").alias("streams"))


ROUTING = "SELECT (user_id % 2147483647 % 4)::INT AS partition, count(*) AS elements, count(DISTINCT user_id) AS streams FROM events GROUP BY 1"


def ingestion_multiplier(spark, d):
    return multiplied(table(spark, d, "events"), 10).groupBy("event_type").agg(F.count("*").alias("elements"))


def route_requests(spark):
    at = lambda k, r: {**r, "at": k}
    rows = [
        at(1, request(1, 1, 1, KINDS, 4)), at(2, request(4, 2, 2, KINDS, 3)), at(3, request(1, 3, 7, KINDS, 4)), at(4, request(1, 4, 9, KINDS, 2)), at(5, request(2, 4)), at(6, request(5, 5, 1, KINDS, 5)),
        at(7, request(3, 1, 1, KINDS, 4)), {**at(8, request(6, 9, 1, ["2", "1", "2"], 2)), "dataSetkey": "events, orders"}, at(9, request(8, 9)), at(10, request(1, 6, 100, ["a", "b", "3"], 1)), at(11, request(3, 7)),
    ]
    return spark.createDataFrame(rows, T.StructType([*REQUEST.fields, T.StructField("at", T.LongType())]))


def data_router(spark, d):
    """Events dealt to the partitions of every parallelism that live requests ask for, counted."""
    elements = table(spark, d, "events").select(
        F.lit("events").alias("dataset"), F.col("user_id").cast("string").alias("stream"), F.col("event_id").cast("string").alias("event")
    )
    return routed_elements(elements, route_requests(spark)).groupBy("route").agg(F.count("*").alias("elements"), F.count_distinct("stream").alias("streams"))


DATA_ROUTER = f"""WITH e AS (SELECT user_id::VARCHAR AS stream, 'events|' || event_id || '|' || user_id AS content FROM events), g AS (SELECT * FROM (VALUES (4, 'KEYED'), (3, 'RANDOM'), (5, 'KEYED')) g(n, how))
SELECT 'events_' || n || '_' || how || '_' || ((CASE how WHEN 'KEYED' THEN {text_number_sql('stream')} ELSE {text_number_sql('content')} END) % n) AS route, count(*) AS elements, count(DISTINCT stream) AS streams FROM e, g GROUP BY 1"""


def request_router(spark, d):
    """Where these requests go, with the events that wait for each at its route."""
    there = data_router(spark, d).select("route", "elements")
    sent = routed_requests(route_requests(spark), groups=3).select("requestID", "uid", "synopsisID", "route")
    return sent.join(there, "route", "left").withColumn("elements", F.coalesce("elements", F.lit(0)))


REQUEST_ROUTER = f"""WITH there AS ({DATA_ROUTER}), r(id, uid, syn, n, how) AS (VALUES (1, 1, 1, 4, 'KEYED'), (4, 2, 2, 3, 'RANDOM'), (1, 3, 7, 4, 'KEYED'), (1, 4, 9, 2, 'KEYED'), (5, 5, 1, 5, 'KEYED'), (3, 1, 1, 4, 'KEYED')),
s AS (SELECT id, uid, syn, 'events_' || n || '_' || how || '_' || unnest(range(n)) AS route FROM r UNION ALL SELECT 6, 1, 1, 'events_2_KEYED_' || unnest(range(2)) UNION ALL SELECT 6, 2, 1, 'orders_2_KEYED_' || unnest(range(2))
UNION ALL SELECT 2, 4, 1, 'events' UNION ALL SELECT 3, 7, 1, 'events' UNION ALL SELECT 1, 6, 100, 'events_' || unnest(range(3)))
SELECT id AS "requestID", uid, syn AS "synopsisID", route, coalesce(elements, 0) AS elements FROM s LEFT JOIN there USING (route)"""


def datapoint_payload(spark, d):
    """Events written as JSON messages and read again as data points, summed by a payload field."""
    e = table(spark, d, "events")
    payload = F.to_json(F.struct(F.col("value").cast("string").alias("value"), F.get_json_object("props", "$.k").alias("k")))
    messages = e.select(F.to_json(F.struct(
        F.lit("events").alias("dataSetkey"), F.col("user_id").cast("string").alias("streamID"), payload.alias("values")
    )).alias("value"))
    points = datapoints(messages, T.StructType([T.StructField("value", T.StringType()), T.StructField("k", T.StringType())]))
    return points.groupBy("dataset", F.col("k").cast("long").alias("k")).agg(
        F.count("*").alias("elements"), F.round(F.sum(F.col("value").cast("double")), 2).alias("total")
    )


PAYLOAD = "SELECT 'events' AS dataset, json_extract_string(props, '$.k')::BIGINT AS k, count(*) AS elements, round(sum(value), 2) AS total FROM events GROUP BY 2"

def merged_partials(spark, d):
    """Counts of each event type in four partitions, merged in four ways."""
    part = table(spark, d, "events").groupBy("event_type", (F.col("user_id") % 4).alias("p")).agg(F.count("*").alias("n"), (F.max("value") > 480).alias("high"))
    out = merged(part, ["event_type"], "n", "sum").withColumnRenamed("merged", "total")
    for how, value in (("max", "n"), ("avg", "n"), ("or", "high")):
        out = out.join(merged(part, ["event_type"], value, how, 4).withColumnRenamed("merged", how), "event_type")
    return out.withColumnRenamed("max", "most").withColumnRenamed("avg", "mean").withColumnRenamed("or", "any_high")


MERGED = """WITH p AS (SELECT event_type, user_id % 4 AS p, count(*) AS n, max(value) > 480 AS high FROM events GROUP BY 1, 2)
SELECT event_type, sum(n)::BIGINT AS total, greatest(max(n), 0) AS most, (sum(n) // 4)::BIGINT AS mean, bool_or(high) AS any_high FROM p GROUP BY event_type"""

QUERIES = {
    "merged_partials": (merged_partials, MERGED),
    "request_lifecycle": (request_lifecycle, LIFECYCLE), "request_kinds": (request_kinds, KINDS_SQL), "continuous_request": (continuous_request, CONTINUOUS), "update_request": (update_request, UPDATE), "control_stream": (control_stream, CONTROL), "served_requests": (served_requests, SERVED), "random_partitioning": (random_partitioning, RANDOM), "keyed_routing": (keyed_routing, ROUTING), "data_router": (data_router, DATA_ROUTER), "request_router": (request_router, REQUEST_ROUTER),
    "ingestion_multiplier": (
        ingestion_multiplier, "SELECT event_type, count(*) * 10 AS elements FROM events GROUP BY event_type"
    ), "datapoint_payload": (datapoint_payload, PAYLOAD),
}
