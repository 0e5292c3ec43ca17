"""Queries of time-series synopses over the events of each user, in the order of time and id."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.arrays import projection, ranks, standard
from tidemark.operators import series as S
from tidemark.operators import similarity
from tidemark.storage import tasks
from tidemark.streaming import digests as streamed

from ._tables import as_stream, finished, table

ORDER = ["ts", "event_id"]
BASIC, WINDOWS, COEFS, THRESHOLD = 8, 2, 3, 0.7
PAST = 0.6


def events(spark, d):
    return table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")


def rounded(df, digits=6, keep=("user_id", "w", "bw", "a_user_id", "b_user_id", "a_w", "b_w")):
    return df.select(*[F.col(c) if c in keep else (F.round(c, digits) + 0.0).alias(c) for c in df.columns])


def digests(spark, d):
    return S.sliding_dft(S.basic_windows(S.numbered(events(spark, d), "user_id", ORDER), "user_id", "value", BASIC, COEFS), "user_id", BASIC, WINDOWS, COEFS)


RN = "e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn FROM events)"
SUMS = ", ".join(f"sum(value * cos({2 * math.pi * m / BASIC!r} * (rn % {BASIC}))) AS re{m}, sum(-value * sin({2 * math.pi * m / BASIC!r} * (rn % {BASIC}))) AS im{m}" for m in range(1, COEFS + 1))
NAMES = [f"{c}{m}" for m in range(1, COEFS + 1) for c in ("re", "im")]
LENGTH = BASIC * WINDOWS
SLIDING = f"""x AS (SELECT user_id, value, rn, unnest(range(rn // {BASIC}, rn // {BASIC} + {WINDOWS})) AS w FROM e),
g AS (SELECT user_id, w, avg(value) AS mean, avg(value * value) - avg(value) * avg(value) AS var, {SUMS} FROM x GROUP BY user_id, w HAVING count(*) = {LENGTH}),
s AS (SELECT user_id, w, mean, sqrt(var) AS sigma, {', '.join(f'{c} / (sqrt(var) * {LENGTH}) AS {c}' for c in NAMES)} FROM g WHERE var > 1e-9)"""


def dft_basic(spark, d):
    return rounded(S.basic_windows(S.numbered(events(spark, d), "user_id", ORDER), "user_id", "value", BASIC, COEFS), 4)


DFT_BASIC = f"""WITH {RN} SELECT user_id, rn // {BASIC} AS bw, round(sum(value), 4) AS s, round(sum(value * value), 4) AS ss, {', '.join(f"round(sum(value * cos({2 * math.pi * m / BASIC!r} * (rn % {BASIC}))), 4) + 0.0 AS re{m}, round(sum(-value * sin({2 * math.pi * m / BASIC!r} * (rn % {BASIC}))), 4) + 0.0 AS im{m}" for m in range(1, COEFS + 1))}
FROM e GROUP BY user_id, rn // {BASIC} HAVING count(*) = {BASIC}"""


def dft_sliding(spark, d):
    return rounded(digests(spark, d))


DFT_SLIDING = f"WITH {RN}, {SLIDING} SELECT user_id, w, round(mean, 6) AS mean, round(sigma, 6) AS sigma, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in NAMES)} FROM s"


def dft_cells(spark, d):
    """The cell of each window's digest and its magnitude."""
    on = S.on_grid(digests(spark, d), THRESHOLD)
    return on.select("user_id", "w", S.cell_number(THRESHOLD).alias("cell"), (F.round(S.magnitude(COEFS), 6) + 0.0).alias("magnitude"))


K = math.ceil(math.sqrt(0.5) / math.sqrt(1 - THRESHOLD))
DFT_CELLS = f"""WITH {RN}, {SLIDING} SELECT user_id, w, (floor(re1 / {math.sqrt(1 - THRESHOLD)!r})::BIGINT + {K}) * {2 * K} + floor(im1 / {math.sqrt(1 - THRESHOLD)!r})::BIGINT + {K} AS cell,
round({' + '.join(f'sqrt(re{m} * re{m} + im{m} * im{m})' for m in range(1, COEFS + 1))}, 6) + 0.0 AS magnitude FROM s"""


def dft_corr_pairs(spark, d):
    """Pairs of users whose digests of the same window allow a correlation of the threshold."""
    vectors = digests(spark, d).withColumn("x", F.array(*NAMES))
    pairs = S.grid_pairs(vectors, "user_id", "x", THRESHOLD, S.closeness, equal=("w",), name="bound")
    return pairs.select(F.col("a_user_id").alias("u"), F.col("b_user_id").alias("v"), F.col("a_w").alias("w"), "bound")


GAP = " + ".join(f"pow(a.{c} - b.{c}, 2)" for c in NAMES)
DFT_PAIRS = f"WITH {RN}, {SLIDING} SELECT a.user_id AS u, b.user_id AS v, a.w, round(1 - ({GAP}), 6) AS bound FROM s a JOIN s b ON a.w = b.w AND a.user_id < b.user_id WHERE round(1 - ({GAP}), 6) >= {THRESHOLD}"


def digest_stream(spark, d):
    order = F.unix_timestamp(F.col("ts").cast("timestamp")) * 1_000_000_000 + F.pmod("event_id", F.lit(1_000_000_000))
    return streamed.sliding_digests(as_stream(spark, d, "events").withColumn("order", order), "user_id", "value", "order", BASIC, WINDOWS, COEFS)


def dft_stream(spark, d):
    """The digests of sliding windows of a stream, as they get full."""
    return rounded(finished(digest_stream(spark, d)))


def dft_stream_pairs(spark, d):
    """Pairs of users whose digests of the same window allow a correlation of the threshold, as they arise in a stream."""
    met = finished(streamed.windows_that_meet(digest_stream(spark, d), "user_id", THRESHOLD, COEFS, keep=1 << 40))
    pairs = streamed.told(met.repartition(tasks(spark)), THRESHOLD)  # the stream's windows are kept, and each of its meetings is a task's
    users = [F.col(c).cast("long") for c in "ab"]
    return pairs.select(F.least(*users).alias("u"), F.greatest(*users).alias("v"), F.col("a_w").alias("w"), "bound")


def past(spark, d, users="true"):
    windows = S.past_windows(events(spark, d).filter(users), "user_id", "value", "ts", ORDER, BASIC, WINDOWS, COEFS, PAST)
    return windows.withColumn("minute", F.expr("unix_timestamp(cast(at AS timestamp)) div 60"))


def half(windows, p):
    return S.prefixed(windows.drop("at", "mean", "sigma", "vals"), p)


PAST_SQL = f"""{RN}, {SLIDING},
r AS (SELECT user_id, w, floor(epoch(max(ts)))::BIGINT // 60 AS minute, list(value ORDER BY rn) AS vals FROM (SELECT user_id, value, ts, rn, unnest(range(rn // {BASIC}, rn // {BASIC} + {WINDOWS})) AS w FROM e) GROUP BY user_id, w HAVING count(*) = {LENGTH}),
p AS (SELECT s.*, minute, vals, list_avg(vals) AS mu FROM s JOIN r ON r.user_id = s.user_id AND r.w = s.w),
z AS (SELECT * EXCLUDE (mu, vals), list_transform(vals, lambda x: x - mu) AS c FROM p),
n AS (SELECT *, sqrt(list_dot_product(c, c)) AS len FROM z)"""
CORR = "round(list_dot_product(a.c, b.c) / (a.len * b.len), 6)"
OUT = ["a_user_id", "a_w", "b_user_id", "b_w", "corr"]
OUT_SQL = f"a.user_id AS a_user_id, a.w AS a_w, b.user_id AS b_user_id, b.w AS b_w, {CORR} AS corr"
NEAR = f"a.user_id <> b.user_id AND round(1 - ({GAP}), 6) >= {PAST} AND {CORR} >= {PAST}"
GIVEN, MINUTES = [3, 17, 42, 99], 720


def probe(a, windows, minutes):
    pairs = S.correlated(half(a, "a"), half(windows, "b"), "user_id", [], F.expr("a_user_id <> b_user_id"), PAST, COEFS, both_ways=True, band=("minute", minutes))
    return S.verified(pairs, PAST, LENGTH)


def past_dft_near_given(spark, d):
    """For each window of given users, the three most correlated windows of others within half a day."""
    windows = past(spark, d)
    found = probe(windows.filter(F.col("user_id").isin(GIVEN)), windows, MINUTES)
    best = Window.partitionBy("a_user_id", "a_w").orderBy(F.desc("corr"), "b_user_id", "b_w")
    return found.withColumn("place", F.row_number().over(best)).filter("place <= 3").select(*OUT)


PAST1 = f"""WITH {PAST_SQL} SELECT {OUT_SQL} FROM n a JOIN n b ON {NEAR} AND abs(a.minute - b.minute) <= {MINUTES} WHERE a.user_id IN ({', '.join(map(str, GIVEN))})
QUALIFY row_number() OVER (PARTITION BY a.user_id, a.w ORDER BY {CORR} DESC, b.user_id, b.w) <= 3"""


def past_dft_among_given(spark, d):
    return S.grid_pairs(past(spark, d, "user_id <= 20"), "user_id", "z", PAST, band=("minute", MINUTES))


PAST2 = f"WITH {PAST_SQL} SELECT {OUT_SQL} FROM n a JOIN n b ON a.user_id < b.user_id AND {NEAR} AND abs(a.minute - b.minute) <= {MINUTES} WHERE a.user_id <= 20 AND b.user_id <= 20"


def past_dft_any_time(spark, d):
    return S.grid_pairs(past(spark, d), "user_id", "z", PAST)


PAST3 = f"WITH {PAST_SQL} SELECT {OUT_SQL} FROM n a JOIN n b ON a.user_id < b.user_id AND {NEAR}"


def past_dft_same_window(spark, d):
    return S.grid_pairs(past(spark, d), "user_id", "z", PAST, equal=("w",))


PAST4 = f"WITH {PAST_SQL} SELECT {OUT_SQL} FROM n a JOIN n b ON a.w = b.w AND a.user_id < b.user_id AND {NEAR}"


def rank_correlation(x, y):
    """Of windows whose scaled values are followed by their scaled ranks."""
    return np.round((x[:, LENGTH:] * y[:, LENGTH:]).sum(1), 6) + 0.0


def past_spearman(spark, d):
    """Rank correlations of the pairs of windows with the same number."""
    windows = past(spark, d).withColumn("both", F.concat("z", standard(ranks(F.col("vals")))))
    return S.grid_pairs(windows, "user_id", "both", PAST, lambda x, y: x[:, :LENGTH] @ y[:, :LENGTH].T, equal=("w",), told=rank_correlation)


PAST_RANK = f"""WITH {PAST_SQL}, v AS (SELECT user_id, w, unnest(vals) AS v, unnest(range(len(vals))) AS i FROM r),
k AS (SELECT user_id, w, i, (rank() OVER o + count(*) OVER (PARTITION BY user_id, w, v) / 2 - 0.5)::DOUBLE AS k FROM v WINDOW o AS (PARTITION BY user_id, w ORDER BY v)),
p4 AS (SELECT a.user_id AS a_user_id, a.w AS a_w, b.user_id AS b_user_id, b.w AS b_w FROM n a JOIN n b ON a.w = b.w AND a.user_id < b.user_id AND {NEAR})
SELECT a_user_id, a_w, b_user_id, b_w, round(corr(x.k, y.k), 6) + 0.0 AS corr FROM p4 JOIN k x ON x.user_id = a_user_id AND x.w = a_w JOIN k y ON y.user_id = b_user_id AND y.w = b_w AND y.i = x.i GROUP BY a_user_id, a_w, b_user_id, b_w"""


def past_dft_latest(spark, d):
    """The latest window of given users against all windows of others within a day."""
    windows = past(spark, d)
    latest = windows.filter(F.col("user_id").isin(GIVEN)).groupBy("user_id").agg(F.max("w").alias("w")).join(windows, ["user_id", "w"]).select(*windows.columns)
    return probe(latest, windows, 2 * MINUTES).select(*OUT)


PAST5 = f"""WITH {PAST_SQL}, l AS (SELECT user_id, max(w) AS w FROM n WHERE user_id IN ({', '.join(map(str, GIVEN))}) GROUP BY user_id)
SELECT {OUT_SQL} FROM n a JOIN l ON l.user_id = a.user_id AND l.w = a.w JOIN n b ON {NEAR} AND abs(a.minute - b.minute) <= {2 * MINUTES}"""


def lsh_windows(spark, d):
    """Hamming weights of sixteen signs of every sliding window of each user's values."""
    return similarity.lsh_windows(past(spark, d), ["user_id", "w"], LENGTH, 16, 35)


LSH_WINDOWS = f"WITH {PAST_SQL} SELECT user_id, w, len(list_filter({similarity.product_sql('c', projection(16, LENGTH, 35))}, lambda v: v > 0))::INT AS hw FROM n"


def gap_fill(spark, d):
    """Clicks repeated for every hour since the user's click before."""
    rows = events(spark, d).filter("event_type = 'click'").groupBy("user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t")).agg(F.max("value").alias("value"))
    return S.gap_filled(rows, "user_id", "t", "value", 3600)


GAP_FILL = """WITH r AS (SELECT user_id, floor(epoch(ts))::BIGINT AS t, max(value) AS value FROM events WHERE event_type = 'click' GROUP BY ALL),
b AS (SELECT *, greatest(1, (t - coalesce(lag(t) OVER (PARTITION BY user_id ORDER BY t), t)) // 3600) AS times FROM r)
SELECT user_id, t - (times - k) * 3600 AS t, value FROM (SELECT *, unnest(range(1, times + 1)) AS k FROM b)"""


def interpolation(spark, d):
    """Daily counts of three kinds of events of each user, the days without any interpolated."""
    rows = events(spark, d).groupBy("user_id", F.dayofmonth("ts").alias("day")).agg(*[F.count_if(F.col("event_type") == k).cast("int").alias(k) for k in ("click", "view", "purchase")])
    return S.resampled(rows, "user_id", "day", ["click", "view", "purchase"])


INTERPOLATION = f"""WITH r AS (SELECT user_id, day(ts)::INT AS day, {', '.join(f"count(*) FILTER (event_type = '{k}')::INT AS {k}" for k in ('click', 'view', 'purchase'))} FROM events GROUP BY ALL),
b AS (SELECT *, lead(day) OVER w AS d1, {', '.join(f'lead({k}) OVER w AS n_{k}' for k in ('click', 'view', 'purchase'))} FROM r WINDOW w AS (PARTITION BY user_id ORDER BY day)),
x AS (SELECT *, unnest(range(day, coalesce(d1, day + 1)))::INT AS t FROM b)
SELECT user_id, t AS day, {', '.join(f'CASE WHEN d1 IS NULL THEN {k} ELSE trunc({k} + (n_{k} - {k}) * (t - day) / (d1 - day))::INT END AS {k}' for k in ('click', 'view', 'purchase'))} FROM x"""


def returns_windows(spark, d):
    return S.returns(events(spark, d), "user_id", ORDER, "value", 10).select(
        "user_id", "w", F.aggregate("returns", F.lit(0).cast("long"), lambda s, v: s + F.round(v * 1e6).cast("long")).alias("millionths"),
        F.size("returns").alias("n")
    )


RETURNS = """WITH c AS (SELECT user_id, ts, event_id, value / lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS r FROM events),
k AS (SELECT user_id, r, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn FROM c WHERE r IS NOT NULL)
SELECT user_id, rn // 10 AS w, sum(round(r * 1e6)::BIGINT)::BIGINT AS millionths, count(*)::INT AS n FROM k GROUP BY user_id, rn // 10 HAVING count(*) = 10"""


def bought(spark, d):
    return S.segments(events(spark, d), "user_id", ORDER, F.col("event_type") == "view", F.col("event_type") == "purchase")


def finjoin_segments(spark, d):
    """Views before each purchase since the purchase before."""
    return bought(spark, d)


SEGMENTS = """s AS (SELECT user_id, event_type, sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - (event_type = 'purchase')::INT AS segment FROM events),
g AS (SELECT user_id, segment::BIGINT AS segment, sum((event_type = 'view')::INT)::BIGINT AS cnt FROM s GROUP BY user_id, segment HAVING max((event_type = 'purchase')::INT) = 1)"""
FINJOIN = f"WITH {SEGMENTS} SELECT user_id, segment, cnt FROM g"


def finjoin_dft(spark, d):
    """Fourier digests of the series of those counts."""
    rows = bought(spark, d).withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy("segment")) - 1)
    return rounded(S.basic_windows(rows, "user_id", "cnt", 4, 1), 4)


FINJOIN_DFT = f"""WITH {SEGMENTS}, q AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY segment) - 1 AS rn FROM g)
SELECT user_id, rn // 4 AS bw, round(sum(cnt), 4)::DOUBLE AS s, round(sum(cnt * cnt), 4)::DOUBLE AS ss, round(sum(cnt * cos({math.pi / 2!r} * (rn % 4))), 4) + 0.0 AS re1, round(sum(-cnt * sin({math.pi / 2!r} * (rn % 4))), 4) + 0.0 AS im1 FROM q GROUP BY ALL HAVING count(*) = 4"""


def counters_last(spark, d):
    """For every segment, the sum and number of the last five counts."""
    return S.last_counts(bought(spark, d), "user_id", 5).select(
        "user_id", "segment", F.size("counts").alias("n"), F.aggregate("counts", F.lit(0).cast("long"), lambda s, v: s + v).alias("total")
    )


COUNTERS = f"WITH {SEGMENTS} SELECT user_id, segment, count(*) OVER w AS n, sum(cnt) OVER w AS total FROM g WINDOW w AS (PARTITION BY user_id ORDER BY segment ROWS 4 PRECEDING)"
COUNTERS = f"SELECT user_id, segment, n::INT AS n, total::BIGINT AS total FROM ({COUNTERS})"


def phase_counts(spark, d):
    """Conditional bucket counts of the values of each day."""
    v = F.col("value")
    return events(spark, d).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
        F.count_if(v < 100).alias("low"), F.count_if((v >= 100) & (v < 101)).alias("middle"), F.count_if((v >= 101) & (v <= 300)).alias("high"),
        F.count_if(v > 300).alias("rest")
    )


PHASES = "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (value < 100) AS low, count(*) FILTER (value >= 100 AND value < 101) AS middle, count(*) FILTER (value >= 101 AND value <= 300) AS high, count(*) FILTER (value > 300) AS rest FROM events GROUP BY 1"

QUERIES = {
    "dft_basic": (dft_basic, DFT_BASIC), "dft_sliding": (dft_sliding, DFT_SLIDING), "dft_cells": (dft_cells, DFT_CELLS), "dft_corr_pairs": (dft_corr_pairs, DFT_PAIRS), "dft_stream": (dft_stream, DFT_SLIDING), "dft_stream_pairs": (dft_stream_pairs, DFT_PAIRS),
    "past_dft_near_given": (past_dft_near_given, PAST1), "past_dft_among_given": (past_dft_among_given, PAST2), "past_dft_any_time": (past_dft_any_time, PAST3), "past_dft_same_window": (past_dft_same_window, PAST4), "past_dft_latest": (past_dft_latest, PAST5), "lsh_windows": (lsh_windows, LSH_WINDOWS), "past_spearman": (past_spearman, PAST_RANK),
    "gap_fill": (gap_fill, GAP_FILL), "interpolation": (interpolation, INTERPOLATION), "returns_windows": (returns_windows, RETURNS), "finjoin_segments": (finjoin_segments, FINJOIN), "finjoin_dft": (finjoin_dft, FINJOIN_DFT),
    "counters_last": (counters_last, COUNTERS), "phase_counts": (phase_counts, PHASES),
}
