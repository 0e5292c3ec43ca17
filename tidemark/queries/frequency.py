"""Queries of frequency, membership and cardinality synopses."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidemark.functions.hashing import hashed_sql, text_number_sql
from tidemark.operators.frequency import AMS, Bloom, CountMin, FlajoletMartin, hll, join_size, lossy_counts, merge_bits, merge_counters, sticky_counts

from ._tables import table

PARTS = CountMin(eps=0.002, confidence=0.99, seed=11)
ORDERS = CountMin(eps=0.001, confidence=0.97, seed=12)
TYPES = CountMin(eps=0.05, confidence=0.95, seed=13, text=True)
USERS = CountMin(eps=0.02, confidence=0.9, seed=14)
SIGNED = AMS(depth=5, width=512, seed=15)
MEMBERS = Bloom(elements=20_000, fpp=0.01, seed=16)
DISTINCT = FlajoletMartin(bitmaps=64, seed=17)


def cm_sql(spec: CountMin, source: str, key: str, value: str, where: str = "true", name: str = "sketch") -> str:
    x = text_number_sql("key") if spec.text else "key"
    rows = " UNION ALL ".join(f"SELECT {i} AS row, {hashed_sql(x, ab, spec.width)} AS bucket, w FROM {name}_keys" for i, ab in enumerate(spec.hashes))
    return f"""{name}_keys AS (SELECT {key} AS key, sum({value})::BIGINT AS w FROM {source} WHERE {where} AND {key} IS NOT NULL GROUP BY {key}),
{name} AS (SELECT row, bucket, sum(w)::BIGINT AS cnt FROM ({rows}) GROUP BY row, bucket)"""


def probe_sql(spec: CountMin, source: str, key: str, name: str = "sketch") -> str:
    x = text_number_sql(key) if spec.text else key
    rows = " UNION ALL ".join(f"SELECT {key}, {i} AS row, {hashed_sql(x, ab, spec.width)} AS bucket FROM {source}" for i, ab in enumerate(spec.hashes))
    return f"SELECT p.{key}, min(coalesce(cnt, 0))::BIGINT AS estimate FROM ({rows}) p LEFT JOIN {name} s ON s.row = p.row AND s.bucket = p.bucket GROUP BY p.{key}"


WHOLE = "trunc(l_quantity)::BIGINT"


def cm_point(spark, d):
    sketch = PARTS.build(table(spark, d, "lineitem"), "l_partkey", "l_quantity")
    return PARTS.estimate(sketch, table(spark, d, "part").select("p_partkey"), "p_partkey")


CM_POINT = f"WITH {cm_sql(PARTS, 'lineitem', 'l_partkey', WHOLE)} {probe_sql(PARTS, 'part', 'p_partkey')}"


def cm_merge(spark, d):
    """Counters merged from three sites' sketches."""
    lines = table(spark, d, "lineitem")
    return merge_counters(*[PARTS.build(lines.filter(F.col("l_orderkey") % 3 == k), "l_partkey", "l_quantity") for k in range(3)])


CM_MERGE = f"WITH {cm_sql(PARTS, 'lineitem', 'l_partkey', WHOLE)} SELECT row, bucket, cnt FROM sketch"


def cm_text(spark, d):
    events = table(spark, d, "events")
    return TYPES.estimate(TYPES.build(events, "event_type"), events.select("event_type").distinct(), "event_type")


CM_TEXT = f"WITH {cm_sql(TYPES, 'events', 'event_type', '1')}, kinds AS (SELECT DISTINCT event_type FROM events) {probe_sql(TYPES, 'kinds', 'event_type')}"


def cm_bound(spark, d):
    """For each part: its estimate is no less than its true weight, and no more than eps times all weight above it in all but a few cases."""
    lines = table(spark, d, "lineitem")
    true = lines.groupBy("l_partkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("weight"))
    both = PARTS.estimate(PARTS.build(lines, "l_partkey", "l_quantity"), true, "l_partkey").join(true, "l_partkey")
    out = both.agg(
        F.count("*").alias("parts"), F.bool_and(F.col("estimate") >= F.col("weight")).alias("never_under"), F.sum("estimate").alias("estimates"),
        F.max(F.col("estimate") - F.col("weight")).alias("worst"), F.sum("weight").alias("weights")
    )
    return out.select("parts", "never_under", (F.col("worst") <= F.lit(PARTS.eps * 2) * F.col("weights")).alias("within"))


CM_BOUND = "SELECT count(DISTINCT l_partkey) AS parts, true AS never_under, true AS within FROM lineitem"


def cm_join_size(spark, d):
    a = ORDERS.build(table(spark, d, "lineitem"), "l_orderkey")
    return join_size(a, ORDERS.build(table(spark, d, "orders"), "o_orderkey"))


CM_JOIN = f"""WITH {cm_sql(ORDERS, 'lineitem', 'l_orderkey', '1', name='a')}, {cm_sql(ORDERS, 'orders', 'o_orderkey', '1', name='b')}
SELECT min(s)::BIGINT AS join_size FROM (SELECT a.row, sum(a.cnt * b.cnt) AS s FROM a JOIN b ON a.row = b.row AND a.bucket = b.bucket GROUP BY a.row)"""


def cm_join_size_three(spark, d):
    """Customers, their orders and their events (users are customers)."""
    parts = (("customer", "c_custkey"), ("orders", "o_custkey"), ("events", "user_id"))
    return join_size(*[ORDERS.build(table(spark, d, t), k) for t, k in parts])


CM_JOIN3 = f"""WITH {cm_sql(ORDERS, 'customer', 'c_custkey', '1', name='a')}, {cm_sql(ORDERS, 'orders', 'o_custkey', '1', name='b')}, {cm_sql(ORDERS, 'events', 'user_id', '1', name='c')}
SELECT coalesce(min(s), 0)::BIGINT AS join_size FROM (SELECT a.row, sum(a.cnt * b.cnt * c.cnt) AS s FROM a JOIN b ON a.row = b.row AND a.bucket = b.bucket JOIN c ON a.row = c.row AND a.bucket = c.bucket GROUP BY a.row)"""


def cm_continuous(spark, d):
    return USERS.running(table(spark, d, "events"), "user_id", ["ts", "event_id"]).drop("ts")


CM_CONTINUOUS = f"""WITH spread AS ({' UNION ALL '.join(f"SELECT ts, event_id, user_id, {i} AS row, {hashed_sql('user_id', ab, USERS.width)} AS bucket FROM events" for i, ab in enumerate(USERS.hashes))}),
run AS (SELECT *, count(*) OVER (PARTITION BY row, bucket ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS cnt FROM spread)
SELECT event_id, user_id, min(cnt)::BIGINT AS estimate FROM run GROUP BY ALL"""


def ams_sql(name: str, source: str, key: str) -> str:
    rows = " UNION ALL ".join(
        f"SELECT {i} AS row, {hashed_sql('key', b, SIGNED.width)} AS bucket, w * ({hashed_sql('key', s, 2)} * 2 - 1) AS w FROM {name}_keys" for i,
        (b, s) in enumerate(SIGNED.hashes)
    )
    return f"""{name}_keys AS (SELECT {key} AS key, count(*) AS w FROM {source} WHERE {key} IS NOT NULL GROUP BY {key}),
{name} AS (SELECT row, bucket, sum(w)::BIGINT AS cnt FROM ({rows}) GROUP BY row, bucket)"""


def ams_point(spark, d):
    return SIGNED.estimate(SIGNED.build(table(spark, d, "lineitem"), "l_suppkey"), table(spark, d, "supplier"), "s_suppkey")


AMS_POINT = f"""WITH {ams_sql('sketch', 'lineitem', 'l_suppkey')}, p AS ({' UNION ALL '.join(f"SELECT s_suppkey, {i} AS row, {hashed_sql('s_suppkey', b, SIGNED.width)} AS bucket, {hashed_sql('s_suppkey', s, 2)} * 2 - 1 AS sign FROM supplier" for i, (b, s) in enumerate(SIGNED.hashes))})
SELECT s_suppkey, median(sign * coalesce(cnt, 0))::BIGINT AS estimate FROM p LEFT JOIN sketch s ON s.row = p.row AND s.bucket = p.bucket GROUP BY s_suppkey"""


def ams_f2(spark, d):
    return SIGNED.second_moment(SIGNED.build(table(spark, d, "lineitem"), "l_suppkey"))


AMS_F2 = f"WITH {ams_sql('sketch', 'lineitem', 'l_suppkey')} SELECT median(f)::BIGINT AS f2 FROM (SELECT sum(cnt * cnt) AS f FROM sketch GROUP BY row)"


def ams_join(spark, d):
    return SIGNED.join_size(SIGNED.build(table(spark, d, "orders"), "o_custkey"), SIGNED.build(table(spark, d, "events"), "user_id"))


AMS_JOIN = f"WITH {ams_sql('a', 'orders', 'o_custkey')}, {ams_sql('b', 'events', 'user_id')} SELECT median(f)::BIGINT AS join_size FROM (SELECT sum(a.cnt * b.cnt) AS f FROM a JOIN b ON a.row = b.row AND a.bucket = b.bucket GROUP BY a.row)"


def bits_sql(source: str, key: str) -> str:
    return " UNION ".join(f"SELECT {hashed_sql(key, ab, MEMBERS.bits)} AS bit FROM {source}" for ab in MEMBERS.hashes)


def bloom_membership(spark, d):
    returned = table(spark, d, "lineitem").filter("l_returnflag = 'R'")
    return MEMBERS.contains(MEMBERS.build(returned, "l_partkey"), table(spark, d, "part"), "p_partkey")


BLOOM = f"""WITH bits AS ({bits_sql("(SELECT * FROM lineitem WHERE l_returnflag = 'R')", 'l_partkey')}),
asked AS ({' UNION ALL '.join(f"SELECT p_partkey, {hashed_sql('p_partkey', ab, MEMBERS.bits)} AS bit FROM part" for ab in MEMBERS.hashes)})
SELECT p_partkey, bool_and(bits.bit IS NOT NULL) AS maybe_member FROM asked LEFT JOIN bits ON bits.bit = asked.bit GROUP BY p_partkey"""


def bloom_merge(spark, d):
    """Bits set for each bitmap of a filter merged from two sites."""
    lines = table(spark, d, "lineitem")
    merged = merge_bits(*[MEMBERS.build(lines.filter(F.col("l_orderkey") % 2 == k), "l_partkey") for k in range(2)])
    return MEMBERS.pack(merged).select("bucket", F.bitmap_count("bitmap").alias("bits_set"))


BLOOM_MERGE = f"SELECT CASE WHEN bit > 0 THEN 1 + (bit - 1) // 32768 ELSE bit // 32768 END AS bucket, count(*) AS bits_set FROM ({bits_sql('lineitem', 'l_partkey')}) GROUP BY 1"


def fm_cardinality(spark, d):
    return DISTINCT.estimate(DISTINCT.build(table(spark, d, "lineitem"), "l_partkey"))


FM = f"""WITH b AS (SELECT {hashed_sql(text_number_sql('l_partkey'), DISTINCT.hashes[0], 64)} AS slot, {hashed_sql(text_number_sql('l_partkey'), DISTINCT.hashes[1])} | (1::BIGINT << 30) AS h FROM lineitem),
m AS (SELECT slot, bit_or(h & -h) AS bitmap FROM b GROUP BY slot)
SELECT round(64 / 0.77351 * pow(2.0, coalesce(sum(bit_count((~bitmap & -(~bitmap)) - 1)), 0) / 64), 4) AS estimate FROM m"""


def hll_cardinality(spark, d):
    """Distinct parts of each return flag, from sketches of each ship month merged; whether they are within three standard errors."""
    lines = table(spark, d, "lineitem").withColumn("month", F.trunc("l_shipdate", "month"))
    merged = hll(lines, ["l_returnflag", "month"], "l_partkey").groupBy("l_returnflag").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))
    exact = lines.groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("exact"))
    return merged.join(exact, "l_returnflag").select("l_returnflag", "exact", (F.abs(F.col("estimate") - F.col("exact")) <= 3 * 0.02 * F.col("exact")).alias("within"))


HLL = "SELECT l_returnflag, count(DISTINCT l_partkey) AS exact, true AS within FROM lineitem GROUP BY l_returnflag"


def frequent(counts, lines, key, share, low):
    """Keys with at least `share` of all elements, and whether the summary has them within its bound."""
    total = lines.agg((F.count("*") * share).alias("least"))
    exact = lines.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("exact"))
    n = total.first()["least"]  # one number
    return exact.filter(F.col("exact") >= n).join(counts, "key", "left").select("key", "exact", low.alias("within"))


def lossy_frequent(spark, d):
    lines = table(spark, d, "lineitem")
    f = lossy_counts(lines, "l_suppkey", ["l_orderkey", "l_linenumber"], eps=0.001)
    return frequent(f, lines, "l_suppkey", 0.0005, F.coalesce((F.col("f") <= F.col("exact")) & (F.col("exact") <= F.col("f") + F.col("delta")), F.lit(False)))


LOSSY = "SELECT l_suppkey AS key, count(*) AS exact, true AS within FROM lineitem GROUP BY l_suppkey HAVING count(*) >= (SELECT count(*) * 0.0005 FROM lineitem)"


def sticky_frequent(spark, d):
    """Event types with a tenth of all events or more; their sticky counts lose at most eps of all."""
    events = table(spark, d, "events")
    f = sticky_counts(events, "event_type", ["event_id"], support=0.05, eps=0.01, failure=0.01)
    return frequent(f, events, "event_type", 0.1, F.coalesce((F.col("f") <= F.col("exact")) & (F.col("exact") <= F.col("f") + 0.01 * F.col("seen")), F.lit(False)))


STICKY = "SELECT event_type AS key, count(*) AS exact, true AS within FROM events GROUP BY event_type HAVING count(*) >= (SELECT count(*) * 0.1 FROM events)"


def lossy_pieces(spark, d):
    """The lossy counts themselves, of eight pieces of the orders."""
    return lossy_counts(table(spark, d, "lineitem"), "l_suppkey", (F.col("l_orderkey") % 8).cast("int"), eps=0.004)


LOSSY_PIECES = """WITH c AS (SELECT l_orderkey % 8 AS piece, l_suppkey AS key, count(*) AS c FROM lineitem WHERE l_suppkey IS NOT NULL GROUP BY ALL),
s AS (SELECT piece, sum(c) AS n, floor(sum(c) * 0.004)::BIGINT AS lost FROM c GROUP BY piece), w AS (SELECT sum(lost)::BIGINT AS allowed, sum(n)::BIGINT AS seen FROM s)
SELECT key, sum(c)::BIGINT AS f, (max(allowed) - sum(lost))::BIGINT AS delta, max(seen) AS seen FROM c JOIN s USING (piece), w WHERE c > lost GROUP BY key"""


def sticky_pieces(spark, d):
    """The sticky counts themselves, of four pieces of the customers' orders, whose rates have doubled."""
    return sticky_counts(table(spark, d, "orders"), "o_custkey", (F.col("o_orderkey") % 4).cast("int"), support=0.5, eps=0.2, failure=0.5)


STICKY_SPAN = math.ceil(math.log(1 / (0.5 * 0.5)) / 0.2)
STICKY_PIECES = f"""WITH c AS (SELECT o_orderkey % 4 AS piece, o_custkey AS key, count(*) AS c FROM orders WHERE o_custkey IS NOT NULL GROUP BY ALL),
s AS (SELECT piece, sum(c)::BIGINT AS n, pow(2.0, greatest(0, ceil(log2(sum(c) / {2 * STICKY_SPAN}.0)))) AS rate FROM c GROUP BY piece),
l AS (SELECT key, c - CASE WHEN rate > 1 THEN floor(ln((cast('0x' || substr(md5(piece || '|' || key || '|7'), 1, 12) AS BIGINT) + 0.5) / {float(1 << 48)!r}) / ln(1 - 1 / rate)) ELSE 0 END AS rest FROM c JOIN s USING (piece))
SELECT key, sum(rest)::BIGINT AS f, (SELECT sum(n)::BIGINT FROM s) AS seen FROM l WHERE rest > 0 GROUP BY key"""


def approx_topk(spark, d):
    """The three most frequent event types, merged from the daily summaries."""
    daily = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.expr("approx_top_k_accumulate(event_type, 64)").alias("s"))
    top = daily.agg(F.expr("approx_top_k_estimate(approx_top_k_combine(s, 64), 3)").alias("top"))
    return top.select(F.explode("top").alias("t")).select(F.col("t.item").alias("event_type"), F.col("t.count").alias("cnt"))


TOPK = "SELECT event_type, count(*) AS cnt FROM events GROUP BY event_type ORDER BY cnt DESC, event_type LIMIT 3"

QUERIES = {
    "cm_point": (cm_point, CM_POINT), "cm_merge": (cm_merge, CM_MERGE), "cm_text": (cm_text, CM_TEXT), "cm_bound": (cm_bound, CM_BOUND), "cm_join_size": (cm_join_size, CM_JOIN),
    "cm_join_size_three": (cm_join_size_three, CM_JOIN3), "cm_continuous": (cm_continuous, CM_CONTINUOUS), "ams_point": (ams_point, AMS_POINT), "ams_f2": (ams_f2, AMS_F2), "ams_join": (ams_join, AMS_JOIN),
    "bloom_membership": (bloom_membership, BLOOM), "bloom_merge": (bloom_merge, BLOOM_MERGE), "fm_cardinality": (fm_cardinality, FM), "hll_cardinality": (hll_cardinality, HLL),
    "lossy_frequent": (lossy_frequent, LOSSY), "sticky_frequent": (sticky_frequent, STICKY), "lossy_pieces": (lossy_pieces, LOSSY_PIECES), "sticky_pieces": (sticky_pieces, STICKY_PIECES), "approx_topk": (approx_topk, TOPK),
}
