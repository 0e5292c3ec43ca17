import json
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.arrays import complex_product, complex_quotient, pearson
from tidemark.operators import blocks, clustering, frequency, quantiles, sampling, series, similarity, topk
from tidemark.plans.engine import Engine, routed
from tidemark.plans.spec import SynopsisSpec
from tidemark.plans.synopses import KINDS, Synopsis, register
from tidemark.sources import connectors
from tidemark.storage import running_sums
from tidemark.streaming import continuous


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_count_min_is_exact_without_collisions_and_never_under(spark):
    spec = frequency.CountMin(0.001, 0.99, seed=1, text=True)
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 1), ("b", 1)], "k string, v int")
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    assert dict(rows(spec.estimate(spec.build(df, "k", "v"), asked, "k"))) == {"a": 3, "b": 1, "c": 0}
    narrow = frequency.CountMin(0.5, 0.5, seed=1)
    keys = spark.range(50).withColumn("v", F.col("id") % 7)
    got = {r.id: r.estimate for r in narrow.estimate(narrow.build(keys, "id", "v"), keys.select("id"), "id").collect()}
    assert all(got[i] >= i % 7 for i in range(50))
    with pytest.raises(ValueError):
        frequency.CountMin(2, 0.5)
    with pytest.raises(Exception, match="negative"):
        narrow.build(keys.withColumn("v", F.lit(-1)), "id", "v").collect()


@pytest.mark.parametrize("kind,params", [("count_min", {}), ("ams", {}), ("bloom", {}), ("flajolet_martin", {}), ("wor_sample", {"size": 20})])
def test_merge_of_parts_is_the_sketch_of_the_whole(spark, kind, params):
    df = spark.range(300).select((F.col("id") % 90).alias("k"), F.lit(1).alias("v"), "id")
    key = "id" if kind == "wor_sample" else "k"
    s = KINDS[kind](SynopsisSpec(1, kind, "d", key, None, params))
    whole = s.build(df)
    merged = s.merge(*[s.build(df.filter(F.col("id") % 3 == p)) for p in range(3)])
    assert rows(merged.select(*whole.columns)) == rows(whole)


def test_bloom_has_no_false_negative_and_few_positives(spark):
    b = frequency.Bloom(100, 0.01)
    got = b.contains(b.build(spark.range(1, 101), "id"), spark.range(1, 1101), "id").collect()
    assert all(r.maybe_member for r in got if r.id <= 100)
    assert sum(r.maybe_member for r in got if r.id > 100) < 40


def test_cardinality_within_bounds(spark):
    df = spark.range(4000).select((F.col("id") % 1000).alias("v"))
    fm = frequency.FlajoletMartin(64)
    assert abs(fm.estimate(fm.build(df, "v")).first()[0] - 1000) < 300
    assert abs(df.agg(F.hll_sketch_estimate(F.hll_sketch_agg("v", 12))).first()[0] - 1000) < 60


def test_ams_second_moment(spark):
    df = spark.range(2000).select((F.col("id") % 20).alias("k"))
    a = frequency.AMS(7, 256)
    assert abs(a.second_moment(a.build(df, "k")).first()[0] - 20 * 100**2) < 0.3 * 20 * 100**2


def test_lossy_and_sticky_bounds(spark):
    random.seed(1)
    data = [(i, random.choice([1, 1, 1, 2, 2, *range(3, 60)])) for i in range(6000)]
    df = spark.createDataFrame(data, "o int, k int")
    true = {k: sum(x == k for _, x in data) for k in range(60)}
    for r in frequency.lossy_counts(df, "k", ["o"], 0.01, pieces=2).collect():
        assert r.f <= true[r.key] <= r.f + r.delta and r.delta <= 0.01 * r.seen
    got = {r.key: r.f for r in frequency.sticky_counts(df, "k", ["o"], 0.03, 0.01, 0.01, pieces=2).collect()}
    assert 1 in got and true[1] - 0.01 * 6000 <= got[1] <= true[1]
    halves = [frequency.lossy_sketch(df.filter(F.col("o") % 2 == p), "k", ["o"], 0.01, pieces=3) for p in range(2)]
    merged = {r.key: r for r in frequency.lossy_result(frequency.merge_lossy(*halves)).collect()}
    assert all(r.f <= true[k] <= r.f + r.delta and r.delta <= 0.01 * r.seen and r.seen == 6000 for k, r in merged.items())
    assert all(k in merged for k in true if true[k] > 0.01 * 6000)
    big = spark.range(200_000).select("id", F.when(F.col("id") % 10 == 0, 0).otherwise(F.col("id")).alias("k"))
    lost = {r.key: r for r in frequency.sticky_counts(big, "k", ["id"], 0.05, 0.01, 0.01, pieces=2).collect()}
    assert 20_000 - 0.01 * 200_000 <= lost[0].f <= 20_000 and lost[0].seen == 200_000 and len(lost) < 20_000  # most keys are not sampled


def test_running_sums_cross_ranges(spark):
    df = spark.range(4000, numPartitions=5).select((F.col("id") * 7919 % 4000).alias("o"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("g"))
    got = running_sums(df, ["g"], ["o"], F.col("o"), "s").collect()
    total = {"a": 0, "b": 0}
    for r in sorted(got, key=lambda r: r.o):
        total[r.g] += r.o
        assert r.s == total[r.g]
    assert len(got) == 4000


def test_running_sums_deal_few_rows_to_a_task(spark):
    df = spark.range(40_000, numPartitions=3).select(F.col("id").alias("o"), (F.col("id") % 3).alias("g"))
    got = running_sums(df, ["g"], ["o"], F.lit(1), "s", most_rows=1000).withColumn("task", F.spark_partition_id()).cache()
    assert got.filter("s <> o div 3 + 1").count() == 0 and got.count() == 40_000
    assert got.groupBy("task").count().agg(F.max("count")).first()[0] <= 5000


def test_quantiles_within_rank_error(spark):
    df = spark.range(10_000).select(F.lit(1).alias("g"), F.col("id").cast("double").alias("v"))
    for r in quantiles.approximate(df, ["g"], "v", [0.1, 0.5, 0.99], 0.01).collect():
        assert abs(r.value - r.q * 10_000) <= 101


def positions(spark, rows_):
    return spark.createDataFrame(rows_, "ship int, t long, lat double, lon double, course double, speed double")


def test_trajectory_sampler_keeps_a_jump_and_missing_fields(spark):
    still = [(1, t, 37.0, 23.0, 10.0, 5.0) for t in range(0, 50, 10)]
    jump = [(1, 50, 37.006, 23.0, 10.0, 5.0), (1, 55, 37.006, 23.0, None, 5.0), (2, 0, 1.0, 1.0, 0.0, 0.0)]
    got = sampling.trajectory_sample(positions(spark, still + jump), "ship", ["t"], 60, 500, 1, 1)
    assert sorted((r.ship, r.t) for r in got.collect()) == [(1, 0), (1, 50), (1, 55), (2, 0)]


def test_topk_lowest_merge_and_pruning(spark):
    df = spark.createDataFrame([(s, t, float(s * 10 + (t * s if s == 4 else 0))) for s in range(5) for t in range(9)], "s int, t int, v double")
    assert [r.s for r in topk.lowest_at(df, "s", "t", "v", 3, 2).collect()] == [0, 1]
    parts = [topk.lowest_at(df.filter(F.col("s") % 2 == p), "s", "t", "v", 3, 3) for p in range(2)]
    assert sorted(r.s for r in topk.merge_lowest(2, "v", *parts).collect()) == [0, 1]
    got = {r.series: r.pruned_at for r in topk.pruned(df.withColumn("g", F.lit(0)), "g", "s", "t", "v", 2, 3).collect()}
    assert got[0] is None and got[1] is None and got[4] is not None


def test_pruning_of_ties_and_many_series(spark):
    rng = random.Random(8)
    data = [(g, s, t, float(rng.randint(0, 6))) for g in range(3) for t in range(25) for s in range(12)]
    got = {(r.group, r.series): (r.value, r.pruned_at) for r in topk.pruned(
        spark.createDataFrame(data, "g int, s int, t int, v double"), "g", "s", "t", "v", 3, 3
    ).collect()}
    for g in range(3):
        values, gaps, gone = {}, {}, {}
        for _, s, t, v in (r for r in data if r[0] == g):
            if s in gone:
                continue
            values[s] = v
            alive = sorted(x for y, x in values.items() if y not in gone)
            if len(alive) > 3 and v > alive[2]:
                gap, left = v - alive[2], gaps.get(s, (0.0, 3))
                gaps[s] = (gap, left[1] - 1 if gap > left[0] else 3)
                if gaps[s][1] <= 0:
                    gone[s] = t
            else:
                gaps.pop(s, None)
        best = sorted((v, s) for s, v in values.items() if s not in gone)[:3]
        assert {k[1]: x for k, x in got.items() if k[0] == g} == {s: (v, None) for v, s in best} | {s: (values[s], t) for s, t in gone.items()}


def series_of(spark, values, key="a"):
    return spark.createDataFrame([(key, i, float(v)) for i, v in enumerate(values)], "k string, rn long, v double")


def test_sliding_digest_equals_recomputing_and_scaling_keeps_it(spark):
    random.seed(2)
    x = [random.random() for _ in range(48)]
    got = series.sliding_dft(series.basic_windows(series_of(spark, x), "k", "v", 8, 2), "k", 8, 4, 2).orderBy("w").collect()
    assert [r.w for r in got] == [3, 4, 5]
    for r in got:
        w = np.array(x[8 * (r.w - 3) : 8 * (r.w + 1)])
        z = (w - w.mean()) / (w.std() * math.sqrt(32))
        f = np.fft.fft(z) / math.sqrt(32)
        assert abs(complex(r.re1, r.im1) - f[4]) < 1e-9 and abs(complex(r.re2, r.im2) - f[8]) < 1e-9
    twice = series.sliding_dft(series.basic_windows(series_of(spark, [2 * v + 3 for v in x]), "k", "v", 8, 2), "k", 8, 4, 2).orderBy("w").collect()
    assert all(abs(a.re1 - b.re1) < 1e-9 and abs(a.im2 - b.im2) < 1e-9 for a, b in zip(got, twice))


def test_grid_join_misses_no_pair(spark):
    random.seed(3)
    base = [math.sin(i / 2) for i in range(16)]
    df = None
    for k in range(30):
        one = series_of(spark, [b * random.choice([1, -1, 3]) + random.gauss(0, 0.6) for b in base], f"s{k:02}")
        df = one if df is None else df.unionByName(one)
    d = series.on_grid(series.sliding_dft(series.basic_windows(df, "k", "v", 8, 2), "k", 8, 2, 2), 0.7)
    pairs = {tuple(sorted((r.a_k, r.b_k))) for r in series.correlated(series.prefixed(d, "a"), series.prefixed(d, "b"), "k", ["w"], None, 0.7, 2).collect()}
    every = d.collect()
    want = {(a.k, b.k) for a in every for b in every if a.k < b.k and round(1 - sum((a[f"{c}{m}"] - b[f"{c}{m}"]) ** 2 for m in (1, 2) for c in ("re", "im")), 6) >= 0.7}
    assert pairs == want and want


def test_gap_fill_and_interpolation(spark):
    df = spark.createDataFrame([(1, 0, 5.0), (1, 30, 7.0)], "k int, t long, v double")
    assert rows(series.gap_filled(df, "k", "t", "v", 10)) == [(1, 0, 5.0), (1, 10, 7.0), (1, 20, 7.0), (1, 30, 7.0)]
    df = spark.createDataFrame([(1, 0, 0), (1, 10, 7)], "k int, t int, c int")
    got = {r.t: r.c for r in series.resampled(df, "k", "t", ["c"]).collect()}
    assert got == {t: int(7 * t / 10) for t in range(11)}


def test_complex_numbers(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, -1.0), (1.0, 2.0, 0.0, 0.0)], "a double, b double, c double, d double")
    a, b = (F.col("a"), F.col("b")), (F.col("c"), F.col("d"))
    got = df.select(*complex_product(a, b), *complex_quotient(a, b)).collect()
    p, q = (1 + 2j) * (3 - 1j), (1 + 2j) / (3 - 1j)
    assert np.allclose(got[0], [p.real, p.imag, q.real, q.imag]) and got[1][2] is None and got[1][3] is None


def test_pearson_of_constants(spark):
    df = spark.createDataFrame([([1.0, 1.0], [1.0, 1.0]), ([1.0, 1.0], [1.0, 2.0]), ([1.0, 2.0], [2.0, 4.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(pearson(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 1.0]


def test_equal_vectors_share_every_radius_cell(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 5.0]), (2, [1.0, 2.0, 3.0, 5.0])], "id int, x array<double>")
    cells = similarity.radius_groups(df, "id", "x", 4, 5, 0.5, 1)
    assert [tuple(r) for r in similarity.radius_vote(cells, "id", 5, 90).collect()] == [(1, 2, 5)]


def test_lsh_finds_what_it_promises(spark, sf):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    x = np.array([r.embedding for r in df.orderBy("vec_id").collect()])
    ids = np.array([r.vec_id for r in df.orderBy("vec_id").select("vec_id").collect()])
    z = x - x.mean(1, keepdims=True)
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    i, j = np.nonzero(np.triu(z @ z.T >= 0.4, 1))
    every = set(zip(ids[i].tolist(), ids[j].tolist()))
    got = {(r.a, r.b) for r in similarity.lsh_pairs(df, "vec_id", "embedding", 64, 0.4, 0.95, 8).collect()}
    assert got <= every and len(got) >= 0.92 * len(every)
    codes = similarity.lsh_codes(df, "vec_id", "embedding", 64, 20, 8, 1)
    assert {(r.a, r.b) for r in blocks.pairs(codes, 0.4, block=16).collect()} == {(r.a, r.b) for r in blocks.pairs(codes, 0.4, block=4096).collect()}


def test_votes_by_chunks_miss_no_pair(spark):
    rng = random.Random(6)
    cells = [(i, g, rng.randint(0, 1), 0) for i in range(60) for g in range(6)]
    at = {i: [c[2] for c in cells if c[0] == i] for i in range(60)}
    want = {(a, b, v) for a in at for b in at if a < b and (v := sum(p == q for p, q in zip(at[a], at[b]))) > 3}
    got = similarity.radius_vote(spark.createDataFrame(cells, "id long, group int, cx long, cy long"), "id", 6, 50).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_coreset_keeps_weight_and_finds_clusters(spark):
    rng = np.random.default_rng(0)
    points = [(i, (np.array([10.0 * (i % 3), 0.0]) + rng.normal(0, 0.1, 2)).tolist()) for i in range(600)]
    df = spark.createDataFrame(points, "id int, x array<double>")
    c = clustering.coreset(df, "x", "id", 50, parts=16, fan_in=4)
    assert c.count() <= 50 and abs(c.agg(F.sum("weight")).first()[0] - 600) < 1e-6
    centres = sorted(r.coords[0] for r in clustering.kmeans(c, 3).collect())
    assert np.allclose(centres, [0, 10, 20], atol=0.3)


@pytest.mark.parametrize("parts", [3, 12])
def test_coreset_costs_what_its_points_cost(spark, parts):
    rng = np.random.default_rng(5)
    points = rng.exponential(50, (20_000, 4)) * rng.integers(1, 3, (20_000, 1))
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, x array<double>")
    few = pd.DataFrame([r.asDict() for r in clustering.coreset(df, "x", "id", 200, parts=parts).collect()])
    x, w = np.stack(few["coords"].to_numpy()), few["weight"].to_numpy()
    whole = ((points - points.mean(0)) ** 2).sum()
    one = (w * ((x - points.mean(0)) ** 2).sum(1)).sum()
    assert abs(one + few["spread"].sum() - whole) < 1e-6 * whole  # a single centre tears no cell apart: the cost is exact
    centres = clustering.lloyd(x, w, 5, 5, 50, 1)[1]
    gap = lambda p: ((p[:, None] - centres[None]) ** 2).sum(2).min(1)
    exact = gap(points).sum()
    assert exact <= (w * gap(x)).sum() + few["spread"].sum() <= 1.2 * exact  # without the spreads: below 0.8 of it on events


def test_engine_lifecycle_update_and_own_synopsis(spark):
    engine = Engine(spark)
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "k string")
    engine.register_dataset("d", df)
    engine.add(SynopsisSpec(1, "count_min", "d", "k"))
    get = lambda: {r.key: r.estimation for r in engine.estimate(1, "a", "b").collect()}
    assert get() == {"a": "2", "b": "1"}
    engine.update(1, engine.live[1][0].build(df))
    assert get() == {"a": "4", "b": "2"}
    engine.delete(1)
    engine.delete(1)
    assert get() == {}
    with pytest.raises(ValueError):
        engine.add(SynopsisSpec(2, "nothing", "d", "k"))
    with pytest.raises(ValueError):
        engine.handle({"dataSetkey": "d", "requestID": 1, "synopsisID": 1, "uid": 3, "streamID": "", "param": ["k", "null", "Queryable"], "noOfP": 1})

    class Total(Synopsis):
        def build(self, df):
            return df.agg(F.count("*").alias("n"))

        def merge(self, *sketches):
            return sketches[0]

        def estimate(self, sketch, *params):
            return sketch.select(F.lit("all").alias("key"), F.col("n").cast("string").alias("estimation"))

    register("total", Total)
    engine.add(SynopsisSpec(4, "total", "d", "k"))
    assert engine.estimate(4).first().estimation == "3"
    assert routed(df, "k", 4, "random").filter("partition not between 0 and 3").count() == 0


def test_quantile_and_window_synopses(spark):
    df = spark.range(1000).select(F.lit("x").alias("k"), F.col("id").cast("double").alias("v"), "id")
    s = KINDS["quantiles"](SynopsisSpec(1, "quantiles", "d", "k", "v"))
    merged = s.merge(*[s.build(df.filter(F.col("id") % 2 == p)) for p in range(2)])
    assert abs(float(s.estimate(merged, "0.5").first().estimation) - 500) < 30
    w = KINDS["window_quantiles"](SynopsisSpec(1, "window_quantiles", "d", "k", "v", {"order": ["id"], "window": 100}))
    assert float(w.estimate(w.build(df), "0.5").first().estimation) == 949.0


def test_messages(spark, tmp_path):
    request = {"dataSetkey": "d", "requestID": 1, "synopsisID": 1, "uid": 5, "streamID": "s", "param": ["k", "v"], "noOfP": 2}
    got = connectors.requests(spark.createDataFrame([(json.dumps(request),), ("no json",)], "value string")).collect()
    assert got[0].asDict() == request and got[1].uid is None
    old = connectors.csv_requests(spark.createDataFrame([("d, 1, 5, 1, s, k;v, 2",)], "value string")).first()
    assert old.uid == 5 and old.param == ["k", "v"] and old.noOfP == 2
    estimates = spark.createDataFrame([(1, "x", "2")], "uid int, key string, estimation string")
    connectors.write_estimations(estimates, str(tmp_path / "out"))
    assert json.loads(spark.read.text(str(tmp_path / "out")).first().value) == {"uid": 1, "key": "x", "estimation": "2"}


def test_stream_equals_batch_and_restarts(spark, tmp_path):
    spec = frequency.CountMin(0.05, 0.9, seed=3)
    schema = T.StructType([T.StructField("k", T.LongType())])
    data, table, ck = (str(tmp_path / x) for x in ("in", "table", "ck"))
    for _ in range(2):  # a second run goes on from the checkpoint
        spark.range(200).select((F.col("id") % 17).alias("k")).coalesce(2).write.mode("append").parquet(data)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(data)
        continuous.into_table(continuous.count_min_stream(stream, spec, "k"), table, ck).awaitTermination()
        assert rows(continuous.newest(spark.read.parquet(table))) == rows(spec.build(spark.read.parquet(data), "k"))


def test_trajectory_stream_equals_batch(spark, tmp_path):
    random.seed(4)
    points = [(s, t, 37 + random.random() / 100, 23.0, 10.0 * random.randint(0, 2), 5.0) for s in range(4) for t in range(0, 300, 20)]
    df = positions(spark, points)
    want = sampling.trajectory_sample(df, "ship", ["t"], 60, 500, 1, 15)
    path = str(tmp_path / "in")
    for low in (0, 140):
        df.filter((F.col("t") >= low) & (F.col("t") < low + 140 + (low > 0) * 100)).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    q = continuous.trajectory_stream(stream, "ship", 60, 500, 1, 15).writeStream.format("memory").queryName("kept").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("kept")) == rows(want)


def test_event_time_windows(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.createDataFrame(
        [("2024-01-01 00:00:01", 1), ("2024-01-01 00:00:02", 2), ("2024-01-01 00:30:00", 3), ("2024-01-01 03:00:00", 4)], "ts string, v int"
    ).select(F.col("ts").cast("timestamp").alias("ts"), "v").coalesce(1).write.parquet(path)
    stream = spark.readStream.schema("ts timestamp, v int").parquet(path)
    q = continuous.distinct_by_window(stream, "ts", "10 minutes", "1 hour", "v").writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.distinct for r in spark.table("windows").collect()) == [1, 1, 2]


def test_rank_summaries_keep_their_bounds():
    from tidemark.operators.summaries import RankSummary, WindowRanks

    r = np.random.default_rng(1)
    for n in (3, 1000, 50_000):
        x = r.permutation(n).astype(float)
        parts = [RankSummary(0.01) for _ in range(4)]
        for k, p in enumerate(np.array_split(x, 17)):
            parts[k % 4].add(p)
        for p in parts[1:]:
            parts[0].merge(p)
        assert parts[0].n == n and parts[0].weighted()[1].sum() == n
        assert all(abs(parts[0].quantile(q) - q * n) <= 0.01 * n + 1 for q in (0.01, 0.25, 0.5, 0.9, 1.0))
    x, held = np.concatenate([r.standard_normal(9000), np.arange(9000.0), np.zeros(9000)]), []
    for window, eps in ((1, 0.5), (10, 0.1), (997, 0.05), (8000, 0.05)):
        w, at = WindowRanks(eps, window), 0
        assert w.quantile(0.5) is None
        for size in r.integers(1, 300, 400):
            w.add(x[at : at + size])
            at += min(size, len(x) - at)
            last = np.sort(x[max(0, at - window) : at])
            for q in (0.05, 0.5, 0.95):
                v = w.quantile(q)
                assert np.searchsorted(last, v) - eps * window - 1 <= q * len(last) <= np.searchsorted(last, v, side="right") + eps * window + 1
        held.append(w.points())
    sizes = []
    for window in (20_000, 80_000, 320_000):  # what is held grows far slower than the window
        w = WindowRanks(0.1, window)
        for _ in range(12):
            w.add(r.standard_normal(window // 8))
        sizes.append(w.points())
    assert sizes[-1] < 4 * sizes[0] and sizes[-1] < 320_000 / 5


def test_windowed_sample_of_sites_is_that_of_all():
    from tidemark.operators.summaries import WindowSample, priority

    r = random.Random(2)
    rows = [(t, priority(t, k), (f"e{t}", str(k))) for t in range(3000) for k in range(2)]
    sites = [WindowSample(8, 200) for _ in range(4)]
    for low in range(0, len(rows), 500):
        for x in rows[low : low + 500]:
            sites[r.randrange(4)].add([x])
        whole = WindowSample(8, 200)
        for s in sites:
            whole.merge(s)
        now = rows[min(low + 499, len(rows) - 1)][0]
        want = sorted((x for x in rows[: low + 500] if now - 200 < x[0] <= now), key=lambda x: x[1])[:8]
        assert whole.sample(now) == want and whole.sample() == want
        assert all(len(s.held) <= 8 * 12 for s in sites)


def test_buckets_reduce_a_point_once_for_each_doubling():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, 3)) * [[1], [1], [1], [10], [60]]
    share = [0.6, 0.3, 0.08, 0.015, 0.005]  # skewed
    points = np.concatenate([c + rng.normal(size=(int(40_000 * s), 3)) * 0.1 for c, s in zip(centres, share)])
    points = points[rng.permutation(len(points))]
    for many in (10, 1000):
        size = len(points) // many
        b = clustering.Buckets(size, 1)
        for p in np.array_split(points, 97):
            b.add(p, np.ones(len(p)))
        assert sum(x is not None for x in b.full) <= math.log2(many) + 2 and b.reductions <= many
        few, weights = b.coreset()
        assert len(few) <= size and abs(weights.sum() - len(points)) < 1e-6
        found = clustering.lloyd(few, weights, 5, 5, 50, 1)[1]
        exact = clustering.lloyd(points, np.ones(len(points)), 5, 5, 50, 1)[0]
        assert ((points[:, None] - found[None]) ** 2).sum(2).min(1).sum() <= (1.1 if many == 10 else 2.0) * exact
    a, b = clustering.Buckets(50, 1), clustering.Buckets(50, 2)
    a.add(points[:3000], np.ones(3000)), b.add(points[3000:3777], np.ones(777))
    a.merge(b)
    assert abs(a.coreset()[1].sum() - 3777) < 1e-6 and clustering.Buckets(5, 1).coreset() is None


def test_coreset_tree_is_near_the_exact_cost_with_few_distances():
    rng = np.random.default_rng(4)
    points = np.concatenate([rng.normal(size=(20_000, 4)), 30 + rng.normal(size=(200, 4)), [[500.0] * 4] * 5])
    tree = clustering.Tree(points, np.ones(len(points)), np.random.default_rng(1))
    few, weights = tree.grow(400)
    assert len(few) == len(weights) == 400 and weights.sum() == len(points)
    assert tree.distances < len(points) * 400 / 4
    centres = clustering.lloyd(few, weights, 3, 5, 50, 1)[1]
    exact = clustering.lloyd(points, np.ones(len(points)), 3, 5, 50, 1)[0]
    assert ((points[:, None] - centres[None]) ** 2).sum(2).min(1).sum() <= 1.1 * exact
    same = clustering.reduce_points(np.ones((50, 2)), np.ones(50), 10, np.random.default_rng(1))
    assert same[0].tolist() == [[1.0, 1.0]] and same[1].tolist() == [50.0]


def test_columns_come_in_the_same_order_in_every_process():
    import os
    import subprocess
    import sys

    code = "import re, pathlib; print([str(p) for p in sorted(pathlib.Path('tidemark').rglob('*.py')) if re.search(r'(?<!\\*)\\*\\{[^{}:]*\\}', p.read_text())])"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout.strip() == "[]"  # no column list is unpacked from a set


def test_pruning_together_does_not_depend_on_partitions(spark):
    r = random.Random(12)
    trend = {s: r.choice([-1.0, 0.0, 0.5, 2.0]) for s in range(40)}
    rows = [(s, t, trend[s] * t + r.gauss(0, 1) + s % 4) for t in range(25) for s in range(40) if r.random() < 0.95] + [(3, 99, None), (4, 99, float("nan"))]

    def plain(k, countdown):
        gap, grown, gone = {}, {}, {}
        for t in range(25):
            now = {s: v for s, u, v in rows if u == t and s not in gone}
            bar = sorted(now.values())[k - 1] if len(now) >= k else math.inf
            for s, v in now.items():
                g = max(v - bar, 0.0)
                grown[s] = grown.get(s, 0) + 1 if g > gap.get(s, 0.0) else 0
                gap[s] = g
                if grown[s] >= countdown:
                    gone[s] = t
        value = {(s, t): v for s, t, v in rows}
        left = sorted((v, s) for s, t, v in rows if t == 24 and s not in gone)[:k]
        return sorted([(s, value[s, t], t) for s, t in gone.items()] + [(s, v, None) for v, s in left], key=str)

    for k, countdown, parts in ((3, 2, 1), (3, 2, 7), (5, 3, 4), (100, 2, 2)):
        df = spark.createDataFrame(rows, "s long, t int, v double").repartition(parts)
        got = sorted((tuple(x) for x in topk.pruned_together(df, "s", "t", "v", k, countdown).collect()), key=str)
        assert got == plain(k, countdown) and (k == 100 or sum(x[2] is not None for x in got) > 5)
    assert topk.pruned_together(df.limit(0), "s", "t", "v", 3, 2).count() == 0


def test_returns_after_a_zero_are_left_out(spark):
    from tidemark.operators.series import returns

    rows = spark.createDataFrame([("a", k, v) for k, v in enumerate([2.0, 4.0, 0.0, 3.0, 6.0, 3.0])], "key string, t int, v double")
    assert [r["returns"] for r in returns(rows, "key", ["t"], "v", 2).orderBy("w").collect()] == [[1.0, -1.0], [1.0, -0.5]]


def test_copies_of_a_row_do_not_grow_with_its_bucket(spark, monkeypatch):
    import numpy as np

    from tidemark.operators import blocks

    monkeypatch.setattr(blocks, "TILE", 32)
    x = np.random.default_rng(4).normal(size=(300, 4))
    rows = spark.createDataFrame([(i, [7, i % 2], v.tolist(), f"n{i}", 0) for i, v in enumerate(x)], "id long, codes array<long>, x array<double>, name string, w long")
    assert blocks.grouped(rows, 1).count() == 2 * 300 * blocks.MOST
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if x[i] @ x[j] >= 2}
    assert {(r.a, r.b) for r in blocks.pairs(rows, 2, block=1).collect()} == want
    assert [(int(r.a_name[1:]), int(r.b_name[1:])) for r in blocks.named_pairs(rows, "name", 2, block=1).collect() if not r.a_name < r.b_name] == []
    assert blocks.named_pairs(rows, "name", 2, block=1).count() == len(want)


def test_rows_that_all_meet_have_the_pairs_of_their_buckets(spark):
    import numpy as np

    from tidemark.operators import blocks

    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(i, rng.integers(0, 3, 2).tolist(), rng.normal(size=4).tolist()) for i in range(200)], "id long, codes array<long>, x array<double>")
    for of in (blocks.pairs, blocks.links):
        assert sorted(of(rows, 1.0, block=30).collect()) == sorted(of(rows, 1.0, block=30, together=True).collect())
    assert blocks.all_together(rows, 1).count() == 200 * blocks.MOST


def test_a_long_block_costs_a_window_what_its_window_does(monkeypatch):
    import numpy as np

    from tidemark.operators import summaries

    calls, add = [], summaries.RankSummary.add
    monkeypatch.setattr(summaries.RankSummary, "add", lambda self, values: (calls.append(len(values)), add(self, values)))
    x = np.random.default_rng(6).random(20_000)
    once, often = summaries.WindowRanks(0.05, 200), summaries.WindowRanks(0.05, 200)
    once.add(x)
    assert sum(calls) < 10_000
    for part in np.array_split(x, 999):
        often.add(part)
    assert [once.quantile(q) for q in (0.1, 0.5, 0.75)] == [often.quantile(q) for q in (0.1, 0.5, 0.75)] and once.points() == often.points()


def test_elements_of_a_part_are_packed(spark):
    from pyspark.sql import functions as F

    from tidemark.streaming.serving import packed, unpacked

    e = spark.range(0, 3000, 1, 1).select(
        F.lit("d").alias("dataset"), F.lit("keyed").alias("route"), (F.col("id") % 2).cast("int").alias("part"), F.col("id").alias("at"), F.lit("s").alias("stream"),
        F.when(F.col("id") == 5, F.lit(None)).otherwise(F.create_map(F.lit("a"), F.col("id").cast("string"))).alias("fields")
    )
    rows = packed(e).collect()
    assert len(rows) == 2
    found = sorted((r["at"], r["field a"]) for row in rows for r in unpacked([bytes(row["block"])]).to_pylist())
    assert found == [(i, None if i == 5 else str(i)) for i in range(3000)]


def test_windows_that_are_alike_are_shuffled_a_few_times_and_told_together(spark, monkeypatch, tmp_path):
    """1500 windows, 1000 of them copies of ten and 300 of one: in a third of the copies that each cell's blocks took, and in less than half the bytes that pairs in any order take."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=(211, 6)) / 4
    x = base[[*(k % 10 for k in range(1000)), *[10] * 300, *range(11, 211)]]
    users = rng.permutation(1500)
    names = ["re1", "im1", *"abcd"]
    windows = spark.createDataFrame(
        [(int(u), int(u) % 2, int(u) % 7, *v.tolist()) for u, v in zip(users, x)], f"user long, w long, minute long, {', '.join(f'{n} double' for n in names)}"
    ).withColumn("x", F.array(*names))
    met, grouped = [], blocks.grouped
    monkeypatch.setattr(blocks, "grouped", lambda *a: met.append(grouped(*a)) or met[-1])

    def near(least, equal, apart):
        s = np.round(series.closeness(x, x), 6)
        ok = (s >= least) & (users[:, None] < users[None])
        if equal:
            ok &= users[:, None] % 2 == users[None] % 2
        if apart is not None:
            ok &= abs(users[:, None] % 7 - users[None] % 7) <= apart
        i, j = np.nonzero(ok)
        return sorted(zip(users[i].tolist(), users[j].tolist(), s[i, j].tolist()))

    for least, equal, band in ((0.7, ("w",), None), (0.7, (), ("minute", 2)), (0.98, (), None), (0.6, (), None)):
        found = series.grid_pairs(windows, "user", "x", least, series.closeness, equal=equal, band=band)
        assert sorted((r.a_user, r.b_user, r["corr"]) for r in found.collect()) == near(least, equal, band and band[1])
        assert met[-1].count() <= 16 * 1500  # MOST copies in each of four or eight cells before
    size = lambda df, name: (df.coalesce(1).write.parquet(f"{tmp_path}/{name}"), sum(f.stat().st_size for f in (tmp_path / name).iterdir()))[1]
    found = found.localCheckpoint()
    assert 2 * size(found, "told") < size(found.orderBy(F.rand(1)), "any order")
    named = windows.withColumn("user", F.concat(F.lit("u"), F.col("user")))
    got = {(r.a_user, r.b_user) for r in series.grid_pairs(named, "user", "x", 0.7, series.closeness, equal=("w",)).collect()}
    assert got == {tuple(sorted((f"u{a}", f"u{b}"))) for a, b, _ in near(0.7, ("w",), None)}
