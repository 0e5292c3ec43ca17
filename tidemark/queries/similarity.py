"""Queries of similarity joins and clustering."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.arrays import projected, projection
from tidemark.functions.hashing import random_sign_sql
from tidemark.operators import clustering, similarity
from tidemark.operators import series as S
from tidemark.operators.similarity import product_sql
from tidemark.plans.routing import grid_elements

from tidemark.storage import written
from tidemark.streaming import digests as streamed

from ._tables import as_stream, finished, table

DIMS, BITS, CORR = 64, 16, 0.25
STRONG, RECALL, BAND = 0.4, 0.95, 8


def vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "embedding")


Z = """c AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE - m) AS c FROM (SELECT vec_id, embedding, list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / len(embedding) AS m FROM embeddings)),
z AS (SELECT vec_id, list_transform(c, lambda x: x / l) AS z FROM (SELECT *, sqrt(list_dot_product(c, c)) AS l FROM c))"""
LSH_SQL = f"{Z}, p AS (SELECT vec_id, z, {product_sql('z', projection(BITS, DIMS, 31))} AS p FROM z), h AS (SELECT vec_id, z, array_to_string(list_transform(p, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS bits FROM p)"


def lsh_bits(spark, d):
    return similarity.lsh(vectors(spark, d), "embedding", DIMS, BITS, 31).select(
        "vec_id", F.array_join(F.transform("bits", lambda b: b.cast("int").cast("string")), "").alias("bits"), "hw"
    )


LSH_BITS = f"WITH {LSH_SQL} SELECT vec_id, bits, len(replace(bits, '0', ''))::INT AS hw FROM h"


def lsh_pairs(spark, d):
    """Pairs with the threshold's correlation that agree in a band of eight signs; as many bands as find 95 % of pairs at the threshold."""
    return similarity.lsh_pairs(vectors(spark, d), "vec_id", "embedding", DIMS, STRONG, RECALL, BAND)


def lsh_links(spark, d):
    """For every vector, how many others it has such a pair with, and the closest of them."""
    return similarity.lsh_links(vectors(spark, d), "vec_id", "embedding", DIMS, STRONG, RECALL, BAND).select(
        "id", "n_links", F.coalesce("best", F.lit(-1)).alias("best"), F.coalesce("best_corr", F.lit(0.0)).alias("best_corr")
    )


BANDS = similarity.bands_for(STRONG, RECALL, BAND)
LSH_CODES = f"""{Z}, m AS (SELECT k // {DIMS} AS r, list({random_sign_sql('k', 31)} ORDER BY k) AS m FROM range({BANDS * BAND * DIMS}) t(k) GROUP BY r),
h AS (SELECT vec_id, r // {BAND} AS band, string_agg(CASE WHEN list_dot_product(z, m) > 0 THEN '1' ELSE '0' END, '' ORDER BY r) AS code FROM z, m GROUP BY ALL),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.z, b.z), 6) AS corr FROM z a JOIN z b ON a.vec_id <> b.vec_id WHERE round(list_dot_product(a.z, b.z), 6) >= {STRONG}),
l AS (SELECT DISTINCT s.* FROM s JOIN h x ON x.vec_id = a JOIN h y ON y.vec_id = b AND y.band = x.band AND y.code = x.code)"""
LSH_PAIRS = f"WITH {LSH_CODES} SELECT a, b, corr FROM l WHERE a < b"
LSH_LINKS = f"""WITH {LSH_CODES}, t AS (SELECT a, count(*) AS n_links, (min({{'c': -corr, 'b': b}})).b AS best, max(corr) AS best_corr FROM l GROUP BY a)
SELECT vec_id AS id, coalesce(n_links, 0) AS n_links, coalesce(best, -1) AS best, coalesce(best_corr, 0.0) AS best_corr FROM embeddings LEFT JOIN t ON t.a = vec_id"""


def radius_cells(spark, d):
    return similarity.radius_groups(vectors(spark, d), "vec_id", "embedding", DIMS, 6, 0.8, 32)


RADIUS_SQL = f"{Z}, s AS (SELECT vec_id, {product_sql('z', projection(12, DIMS, 32, signs=True))} AS s FROM z), g AS (SELECT vec_id, k::INT AS \"group\", floor(s[2 * k + 1] / 0.8)::BIGINT AS cx, floor(s[2 * k + 2] / 0.8)::BIGINT AS cy FROM s, range(6) r(k))"


def radius_vote(spark, d):
    return similarity.radius_vote(radius_cells(spark, d), "vec_id", 6, 50)


RADIUS_VOTE = f"WITH {RADIUS_SQL} SELECT a.vec_id AS a, b.vec_id AS b, count(*) AS votes FROM g a JOIN g b ON a.\"group\" = b.\"group\" AND a.cx = b.cx AND a.cy = b.cy AND a.vec_id < b.vec_id GROUP BY 1, 2 HAVING count(*) > 3"


def grid_router(spark, d):
    """Vectors as elements of the datasets of their grid's groups, counted by cell; half of them belong to a dataset without a radius sketch."""
    dataset = F.when(F.col("vec_id") % 2 == 0, "even").otherwise("odd")
    windows = vectors(spark, d).select(dataset.alias("dataset"), F.col("vec_id").cast("string").alias("stream"), "embedding")
    requests = spark.createDataFrame(
        [("even", 5, 100, 1, 0), ("odd", 5, 100, 2, 1), ("odd", 2, 100, 2, 2)], "dataSetkey string, requestID int, synopsisID int, uid int, at long"
    )
    return grid_elements(windows, requests, "embedding", DIMS, 6, 0.8, seed=32).groupBy("dataset", "cx", "cy").agg(F.count("*").alias("elements"))


def radius_stream(spark, d):
    """The pairs of radius_vote, as they arise in a stream of vectors."""
    rows = as_stream(spark, d, "embeddings").filter("embedding IS NOT NULL").withColumn("w", F.lit(0))
    pairs = finished(streamed.radius_as_it_arises(rows, "vec_id", "w", "embedding", DIMS, 6, 0.8, 50, keep=1, seed=32))
    ids = [F.col(c).cast("long") for c in "ab"]
    return pairs.select(F.least(*ids).alias("a"), F.greatest(*ids).alias("b"))


def radius_links(spark, d):
    """For every vector with such a pair, how many, and the one with the most votes."""
    return similarity.radius_links(radius_cells(spark, d), "vec_id", 6, 50)


RADIUS_LINKS = f"""WITH v AS ({RADIUS_VOTE}), u AS (SELECT a, b, votes FROM v UNION ALL SELECT b, a, votes FROM v)
SELECT a AS id, count(*) AS n_links, (min({{'v': -votes, 'b': b}})).b AS best, max(votes) AS votes FROM u GROUP BY a"""


def naive_pearson(spark, d):
    """Every vector whose id is divisible by 50 against all vectors."""
    rows = vectors(spark, d)
    return similarity.probes_against_all(rows, rows.filter("vec_id % 50 = 0"), "vec_id", "embedding", CORR)


NAIVE = f"WITH {Z} SELECT a.vec_id AS probe, b.vec_id AS other, round(list_dot_product(a.z, b.z), 6) AS corr FROM z a JOIN z b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 AND round(list_dot_product(a.z, b.z), 6) >= {CORR}"

SKETCH = 20


def sketch_pearson(spark, d):
    """The same on radius sketches of the vectors."""
    rows = similarity.scaled(vectors(spark, d), "embedding").select("vec_id", projected(F.col("z"), projection(SKETCH, DIMS, 34, signs=True)).alias("sketch"))
    rows = written(rows)  # once, for the probes and all
    return similarity.probes_against_all(rows, rows.filter("vec_id % 50 = 0"), "vec_id", "sketch", 0.5)


SKETCH_PEARSON = f"""WITH {Z}, s AS (SELECT vec_id, {product_sql('z', projection(SKETCH, DIMS, 34, signs=True))} AS s FROM z),
m AS (SELECT vec_id, list_transform(s, lambda x: x - list_avg(s)) AS c FROM s), n AS (SELECT vec_id, c, sqrt(list_dot_product(c, c)) AS l FROM m)
SELECT a.vec_id AS probe, b.vec_id AS other, round(list_dot_product(a.c, b.c) / (a.l * b.l), 6) AS corr FROM n a JOIN n b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 AND round(list_dot_product(a.c, b.c) / (a.l * b.l), 6) >= 0.5"""

KINDS, WIDTH, STEP, SIM_BITS, SIM = ["click", "view", "purchase"], 10, 5, 20, 0.6
WEIGHTS = [0.5, 0.25, 0.25]


def simulations(spark, d):
    """Users as simulations: three kinds of events a day, the days between interpolated."""
    e = table(spark, d, "events").groupBy("user_id", F.dayofmonth("ts").alias("day")).agg(*[F.count_if(F.col("event_type") == k).cast("int").alias(k) for k in KINDS])
    return similarity.simulation_windows(S.resampled(e, "user_id", "day", KINDS), "user_id", "day", KINDS, WIDTH, STEP, SIM_BITS, 33)


SIM_SQL = f"""r AS (SELECT user_id, day(ts)::INT AS day, {', '.join(f"count(*) FILTER (event_type = '{k}')::INT AS {k}" for k in KINDS)} FROM events GROUP BY ALL),
b AS (SELECT *, lead(day) OVER w AS d1, {', '.join(f'lead({k}) OVER w AS n_{k}' for k in KINDS)} FROM r WINDOW w AS (PARTITION BY user_id ORDER BY day)),
x AS (SELECT *, unnest(range(day, coalesce(d1, day + 1)))::INT AS t FROM b),
i AS (SELECT user_id, t, {', '.join(f'CASE WHEN d1 IS NULL THEN {k} ELSE trunc({k} + (n_{k} - {k}) * (t - day) / (d1 - day))::INT END AS {k}' for k in KINDS)} FROM x),
w AS (SELECT user_id, start::BIGINT AS start, {', '.join(f'list({k} ORDER BY t) AS v_{k}, max({k}) // 2 AS h_{k}' for k in KINDS)} FROM i, (SELECT unnest(range(0, 31, {STEP})) AS start) WHERE t >= start AND t < start + {WIDTH} GROUP BY user_id, start HAVING count(*) = {WIDTH}),
f AS (SELECT *, list_concat({', '.join(f'list_transform(v_{k}, lambda v: (v - h_{k})::DOUBLE)' for k in KINDS)}) AS flat FROM w),
h AS (SELECT user_id, start, len(list_filter({product_sql('flat', projection(SIM_BITS, WIDTH * 3, 33))}, lambda v: v > 0))::INT AS hw, {', '.join(f'list_transform(v_{k}, lambda v: v - list_avg(v_{k})) AS c_{k}' for k in KINDS)} FROM f)"""
SIM_CORR = "round(" + " + ".join(
    f"{w} * CASE WHEN list_dot_product(a.c_{k}, a.c_{k}) > 1e-12 AND list_dot_product(b.c_{k}, b.c_{k}) > 1e-12 THEN list_dot_product(a.c_{k}, b.c_{k}) / (sqrt(list_dot_product(a.c_{k}, a.c_{k})) * sqrt(list_dot_product(b.c_{k}, b.c_{k}))) ELSE 0 END" for w,
    k in zip(WEIGHTS, KINDS)
) + ", 6)"
GAP = similarity.angle_width(SIM, SIM_BITS)


def wlsh_windows(spark, d):
    return simulations(spark, d).select("user_id", "start", "hw")


WLSH = f"WITH {SIM_SQL} SELECT user_id, start, hw FROM h"


def wlsh_nearest(spark, d):
    return similarity.simulation_pairs(simulations(spark, d), "user_id", SIM, SIM_BITS, WEIGHTS, 15)


WLSH1 = f"""WITH {SIM_SQL}, m AS (SELECT a.user_id AS a_sim, a.start AS a_start, b.user_id AS b_sim, b.start AS b_start, abs(a.hw - b.hw) AS gap, {SIM_CORR} AS corr FROM h a JOIN h b ON a.user_id <> b.user_id AND abs(a.hw - b.hw) <= {GAP}
QUALIFY row_number() OVER (PARTITION BY a.user_id, a.start ORDER BY abs(a.hw - b.hw), b.user_id, b.start) <= 15) SELECT * FROM m WHERE corr >= {SIM}"""


def wlsh_similar(spark, d):
    """The ten windows most similar to each of a request's windows: the first windows of two users."""
    windows = simulations(spark, d)
    asked = windows.filter("user_id IN (5, 30) AND start = 5").select("user_id", "start")
    return similarity.similar_to(windows, asked, "user_id", SIM, WEIGHTS, 10)


WLSH3 = f"""WITH {SIM_SQL} SELECT a.user_id AS a_sim, a.start AS a_start, b.user_id AS b_sim, b.start AS b_start, {SIM_CORR} AS corr FROM h a JOIN h b ON a.user_id <> b.user_id
WHERE a.user_id IN (5, 30) AND a.start = 5 AND {SIM_CORR} >= {SIM} QUALIFY row_number() OVER (PARTITION BY a.user_id, a.start ORDER BY {SIM_CORR} DESC, b.user_id, b.start) <= 10"""


def wlsh_one(spark, d):
    """The five windows most similar to one, of those that start before the 15th day."""
    windows = simulations(spark, d)
    return similarity.similar_to(windows, windows.filter("user_id = 7 AND start = 5").select("user_id", "start"), "user_id", 0.3, WEIGHTS, 5, before=15)


WLSH2 = f"""WITH {SIM_SQL} SELECT a.user_id AS a_sim, a.start AS a_start, b.user_id AS b_sim, b.start AS b_start, {SIM_CORR} AS corr FROM h a JOIN h b ON a.user_id <> b.user_id
WHERE a.user_id = 7 AND a.start = 5 AND b.start < 15 AND {SIM_CORR} >= 0.3 QUALIFY row_number() OVER (PARTITION BY a.user_id, a.start ORDER BY {SIM_CORR} DESC, b.user_id, b.start) <= 5"""


def coreset_points(spark, d):
    """The number of representatives is bounded and their weights sum to the number of vectors."""
    c = clustering.coreset(vectors(spark, d), "embedding", "vec_id", 100)
    return c.agg((F.count("*") <= 100).alias("bounded"), F.sum("weight").cast("long").alias("weight"))


CORESET = "SELECT true AS bounded, count(*) AS weight FROM embeddings WHERE embedding IS NOT NULL"


def coreset_kmeans(spark, d):
    """Five clusters of points of four consecutive values of each user's events."""
    points = clustering.joined_points(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value", 4).withColumn("id", F.concat_ws("_", "user_id", "n"))
    return clustering.kmeans(clustering.coreset(points, "coords", "id", 200), 5).select("centre", F.round("weight").cast("long").alias("weight"))


def coreset_kmeans_cost(spark, d):
    """The points, and whether what five centres cost the coreset is within a fifth of what they cost all points."""
    points = clustering.joined_points(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value", 4).withColumn("id", F.concat_ws("_", "user_id", "n"))
    points = written(points)
    few = written(clustering.coreset(points, "coords", "id", 200))
    centres = written(clustering.kmeans(few, 5))
    own = clustering.cost(few, "coords", centres, "weight", "spread").select(F.col("cost").alias("of_few"), F.lit(0).alias("one"))
    every = clustering.cost(points, "coords", centres).withColumn("one", F.lit(0))
    return every.join(own, "one").select("points", (F.abs(F.col("of_few") - F.col("cost")) <= 0.2 * F.col("cost")).alias("within"))


COST = "SELECT sum(n // 4)::BIGINT AS points, true AS within FROM (SELECT count(*) AS n FROM events GROUP BY user_id)"

QUERIES = {
    "lsh_bits": (lsh_bits, LSH_BITS), "lsh_pairs": (lsh_pairs, LSH_PAIRS), "lsh_links": (lsh_links, LSH_LINKS), "radius_links": (radius_links, RADIUS_LINKS), "radius_groups": (radius_cells, f'WITH {RADIUS_SQL} SELECT vec_id, "group", cx, cy FROM g'), "radius_vote": (radius_vote, RADIUS_VOTE), "grid_router": (
        grid_router,
        f"WITH {RADIUS_SQL} SELECT 'even_' || \"group\" AS dataset, cx, cy, count(*) AS elements FROM g WHERE vec_id % 2 = 0 GROUP BY ALL"
    ), "radius_stream": (radius_stream, f"SELECT a, b FROM ({RADIUS_VOTE})"), "naive_pearson": (naive_pearson, NAIVE), "sketch_pearson": (sketch_pearson, SKETCH_PEARSON),
    "wlsh_windows": (wlsh_windows, WLSH), "wlsh_nearest": (wlsh_nearest, WLSH1), "wlsh_one": (wlsh_one, WLSH2), "wlsh_similar": (wlsh_similar, WLSH3), "coreset_kmeans_cost": (coreset_kmeans_cost, COST), "coreset_points": (coreset_points, CORESET), "coreset_kmeans": (coreset_kmeans, None),
}
