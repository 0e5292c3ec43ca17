"""Digests, pairs and radius votes of a stream are those of the batch operators, whatever comes in which batch, and across restarts."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import series, similarity
from tidemark.plans.engine import Engine
from tidemark.plans.spec import SynopsisSpec
from tidemark.streaming import digests

SIZE, WINDOWS, COEFS, THRESHOLD = 4, 3, 2, 0.6
R = random.Random(6)
ROWS = [(
    f"s{k}", t, None if R.random() < 0.02 else R.gauss(0, 1) * (k % 3) + (t % 8) * (-1) ** (k // 5)
) for t in range(50) for k in range(10)] + [("flat", t, 1.0) for t in range(20)] + [("short", 0, 1.0), (None, 0, 1.0)]
SCHEMA = "k string, t long, v double"


def run(spark, folder, make, batches, schema):
    """The rows of a streaming query after one run for each batch."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        made = make(spark.readStream.schema(schema).parquet(f"{folder}/in"))
        made.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{folder}/out")


def cut_up(rows, times):
    edges = [-1, *times, 10**9]
    return [R.sample(b, len(b)) for b in ([r for r in rows if low < r[1] <= high] for low, high in zip(edges, edges[1:])) if b]


def batch_digests(spark):
    rows = series.numbered(spark.createDataFrame(ROWS, SCHEMA).filter("k IS NOT NULL"), "k", ["t"])
    return series.sliding_dft(series.basic_windows(rows.withColumn("v", F.coalesce("v", F.lit(0.0))), "k", "v", SIZE, COEFS), "k", SIZE, WINDOWS, COEFS)


def sliding(stream):
    return digests.sliding_digests(stream, "k", "v", "t", SIZE, WINDOWS, COEFS)


def near(a, b):
    return a.keys() == b.keys() and all(abs(x - y) < 1e-6 for k in a for x, y in zip(a[k], b[k]))


@pytest.mark.parametrize("times", [[], [17, 18, 30], [3, 9, 41]])
def test_sliding_digests(spark, tmp_path, times):
    want = {(r.k, r.w): tuple(r)[2:] for r in batch_digests(spark).collect()}
    got = run(spark, str(tmp_path), sliding, cut_up(ROWS, times), SCHEMA).collect()
    assert len(got) == len(want) > 60 and near({(r.k, r.w): tuple(r)[2:] for r in got}, want)


@pytest.mark.parametrize("apart,times", [(0, [11, 25, 26]), (2, [20])])
def test_pairs_as_they_arise(spark, tmp_path, apart, times):
    on = series.on_grid(batch_digests(spark), THRESHOLD)
    condition = F.expr(f"abs(a_w - b_w) <= {apart} AND a_k <> b_k")
    pairs = series.correlated(series.prefixed(on, "a"), series.prefixed(on, "b"), "k", [], condition, THRESHOLD, COEFS).collect()
    pair = lambda a, aw, b, bw: tuple(sorted([(a, aw), (b, bw)]))
    want = {pair(r.a_k, r.a_w, r.b_k, r.b_w): (r.bound,) for r in pairs}
    make = lambda s: digests.pairs_as_they_arise(sliding(s), "k", THRESHOLD, COEFS, keep=1000, apart=apart)
    rows = run(spark, str(tmp_path), make, cut_up(ROWS, times), SCHEMA).collect()
    got = {pair(r.a, r.a_w, r.b, r.b_w): (r.bound,) for r in rows}
    assert len(rows) == len(got) == len(want) > 20 and near(got, want)
    state = spark.read.format("statestore").option("operatorId", 0).option("stateVarName", "live").load(f"{tmp_path}/checkpoint")
    assert state.filter("size(value.w) > 0").count() > 1


def test_cells_forget_what_is_past(spark, tmp_path):
    make = lambda s: digests.pairs_as_they_arise(sliding(s), "k", THRESHOLD, COEFS, keep=2)
    run(spark, str(tmp_path), make, cut_up(ROWS, [10, 20, 30, 40]), SCHEMA)
    state = spark.read.format("statestore").option("operatorId", 0).option("stateVarName", "live").load(f"{tmp_path}/checkpoint")
    assert all(max(r.w) - min(r.w) < 2 for r in state.select("value.w").collect())


def test_radius_votes_as_they_arise(spark, tmp_path):
    base = [[R.gauss(0, 1) for _ in range(16)] for _ in range(4)]
    rows = [(f"s{k}", w, [x + R.gauss(0, 0.05) for x in base[(k + w) % 4]]) for w in range(3) for k in range(12)]
    schema = "k string, w long, x array<double>"
    df = spark.createDataFrame(rows, schema)
    want = set()
    for w in range(3):
        own = df.filter(F.col("w") == w).withColumn("id", F.expr("cast(substr(k, 2) AS long)"))
        votes = similarity.radius_vote(similarity.radius_groups(own, "id", "x", 16, 8, 0.8, 100), "id", 8, 60)
        want |= {(*sorted([f"s{r.a}", f"s{r.b}"]), w) for r in votes.collect()}
    make = lambda s: digests.radius_as_it_arises(s, "k", "w", "x", 16, 8, 0.8, 60, keep=10)
    got = run(spark, str(tmp_path), make, [rows[:7], rows[7:20], rows[20:]], schema).collect()
    assert len(got) == len(want) > 5 and {tuple(r) for r in got} == want
    engine = Engine(spark)
    engine.register_dataset("windows", df, ["w"])
    told = engine.add_continuous(SynopsisSpec(1, "radius", "windows", "k", "x", {"window": 16, "groups": 8, "side": 0.8, "percent": 60})).collect()
    assert {(*r.key.split("|"), int(r.estimation)) for r in told} == want and {(r.requestID, r.synopsisID) for r in told} == {(5, 100)}


def test_lsh_pairs_as_they_arise(spark, tmp_path):
    base = [[R.gauss(0, 1) for _ in range(16)] for _ in range(4)]
    rows = [(f"s:{k}", w, [x + R.gauss(0, 0.2) for x in base[(k + w) % 4]]) for w in range(2) for k in range(12)] + [("none", 0, None), ("short", 0, [1.0])]
    schema = "k string, w long, x array<double>"
    want = set()
    for w in range(2):
        own = spark.createDataFrame([r for r in rows if r[1] == w], schema).withColumn("id", F.expr("try_cast(substr(k, 3) AS long)")).filter("id IS NOT NULL")
        want |= {(*sorted([f"s:{r.a}", f"s:{r.b}"]), w) for r in similarity.lsh_pairs(own, "id", "x", 16, 0.8, 0.95, 6).collect()}
    make = lambda s: digests.lsh_as_it_arises(s, "k", "w", "x", 16, 0.8, keep=10, recall=0.95, width=6)
    got = run(spark, str(tmp_path), make, [rows[:5], rows[5:16], rows[16:]], schema).collect()
    assert len(got) == len(want) > 5 and {tuple(r) for r in got} == want


def test_streams_run_from_any_folder(tmp_path):
    """The entry's streaming queries in a session whose workers do not find the package in their folder."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""import sys; sys.path.insert(0, {root!r})
import __spark_entry__ as e
from pyspark.sql import SparkSession
spark = SparkSession.builder.master('local[2]').config('spark.sql.shuffle.partitions', '2').config('spark.ui.enabled', 'false').config('spark.checkpoint.dir', 'file://{tmp_path}/shared').getOrCreate()
print('rows', e.queries()['dft_stream'](spark, '/root/testdata/sf0.001').count())"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 103" in out.stdout, out.stderr[-2000:]


def test_only_windows_of_the_same_number_are_compared(monkeypatch):
    import numpy as np

    seen, near = [], digests.Cell._near
    monkeypatch.setattr(digests.Cell, "_near", lambda self, wa, va, own, wb, vb, other: (seen.append(len(own) * len(other)), near(self, wa, va, own, wb, vb, other))[1])
    rows = np.array([f"n{i}" for i in range(60)], object), np.arange(60) // 3, np.zeros((60, 2))
    found = [f for f in digests.Cell("k", 0, 5, 0.5)._pairs(rows, rows, True)]
    assert sum(map(len, found)) == 60 and sum(seen) == 20 * 9


def test_windows_that_meet_are_told_once_whatever_blocks_they_are_in(spark, monkeypatch):
    """One cell in two batches: windows at home and visitors, of two numbers, half of them copies, in blocks of 40 at least."""
    import numpy as np
    import pandas as pd

    class State:
        held = None
        exists, get = lambda self: self.held is not None, lambda self: self.held

        def update(self, value):
            self.held = value

    monkeypatch.setattr(digests, "LEAST", 40)
    rng = np.random.default_rng(3)
    v = rng.normal(size=(900, 6)) / 4
    v[::2] = v[rng.integers(0, 9, 450) * 2]
    names, w, home = [f"s{k % 700}" for k in range(900)], np.where(np.arange(900) % 3, 65, 1), np.arange(900) % 5 > 0
    cell = digests.Cell("k", 0, 1 << 40, 0.7, packed=True)
    cell.live, met = State(), []
    for low, high in ((0, 500), (500, 900)):
        frame = pd.DataFrame({"name": names[low:high], "w": w[low:high], "home": home[low:high], "v": list(v[low:high])})
        met += list(cell.handleInputRows((0, 0, 1), iter([frame]), None))
    meetings = spark.createDataFrame([tuple(None if x is None else bytearray(x) for x in r) for r in pd.concat(met).values.tolist()], "a binary, b binary")
    assert 100 < len(met) < 300
    got = sorted((r.a, r.a_w, r.b, r.b_w, r.bound) for r in digests.told(meetings, 0.7).collect())
    bound, want = np.round(1 - ((v[:, None] - v[None]) ** 2).sum(2), 6), []
    for i in range(900):
        for j in range(i + 1, 900):
            if w[i] == w[j] and names[i] != names[j] and (home[i] or home[j]) and bound[i, j] >= 0.7:
                a, b = sorted([names[i], names[j]], key=lambda s: (len(s), s))
                want.append((a, w[i], b, w[j], bound[i, j]))
    assert len(got) > 20_000 and got == sorted(want)


def test_a_stream_writes_the_windows_that_meet_and_not_their_pairs(spark, tmp_path, monkeypatch):
    from tidemark.queries import series as queries

    rows = [(k, f"2024-01-01 00:{k // 1200:02}:00", k % 1200, R.gauss(0, 1)) for k in range(1200 * 16)]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumn("event_type", F.lit("view"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    wrote, finished = [], queries.finished
    monkeypatch.setattr(queries, "finished", lambda stream: wrote.append(finished(stream)) or wrote[-1])
    got = {tuple(r)[:3] for r in queries.dft_stream_pairs(spark, str(tmp_path)).collect()}
    assert got == {tuple(r)[:3] for r in queries.dft_corr_pairs(spark, str(tmp_path)).collect()} and len(got) > 100_000
    assert wrote[0].count() < 300
