"""The control plane: every kind by a request, continuous ones, saving, and requests as a stream."""

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.frequency import CountMin
from tidemark.plans.engine import Engine, fanned_out
from tidemark.plans.spec import REQUEST, SynopsisSpec
from tidemark.sources import connectors
from tidemark.streaming.control import controlled


def ask(number, uid, synopsis=1, *param, data="d", parts=1):
    return {"dataSetkey": data, "requestID": number, "synopsisID": synopsis, "uid": uid, "streamID": "all", "param": list(param), "noOfP": parts}


@pytest.fixture(scope="module")
def engine(spark):
    random.seed(3)
    rows = [(
        f"s{k % 6}", t * 6 + k % 6, float(t % 8 * (1 if k % 2 else -1) + random.random() * (k % 3)), random.choice(["a1", "b1", "c2", "x"])
    ) for t in range(40) for k in range(6)]
    e = Engine(spark)
    e.register_dataset("d", spark.createDataFrame(rows, "k string, t long, v double, flag string"), ["t"])
    return e


def said(engine, uid, *params):
    return {r.key: r.estimation for r in engine.estimate(uid, *params).collect()}


def test_every_kind_is_added_by_a_request(engine):
    add = lambda uid, synopsis, *param, number=1: engine.handle(ask(number, uid, synopsis, *param, parts=3))
    add(1, 1, "k", "null", "Queryable", "0.01", "0.99", "1", number=4)
    assert said(engine, 1, "s0", "none") == {"s0": "40", "none": "0"}
    add(2, 2, "k", "null", "Queryable", "100", "0.001")
    assert said(engine, 2, "s1", "none") == {"s1": "true", "none": "false"}
    add(3, 3, "k", "null", "Queryable", "5", "128")
    assert said(engine, 3, "s2") == {"s2": "40"}
    add(4, 7, "k", "k", "Queryable")
    assert said(engine, 4) == {"k": "6"}
    add(5, 8, "k", "null", "Queryable", "0.05", "0.01", "0.01")
    add(6, 9, "k", "null", "Queryable", "0.01")
    assert said(engine, 5, "s3") == said(engine, 6, "s3") == {"s3": "40"}
    add(7, 10, "k", "t", "Queryable", "3", "10")
    assert len(engine.estimate(7).collect()) == 18
    add(8, 11, "k", "v", "Queryable", "0.01")
    assert abs(float(said(engine, 8, "0.5")["0.5"])) < 3
    add(9, 16, "k", "v", "Queryable", "0.01", "8")
    assert set(said(engine, 9, "0.5")) == {f"s{k}_0.5" for k in range(6)}
    add(10, 15, "t", "k", "Queryable", "30")
    assert engine.estimate(10).count() == 30
    add(11, 26, "k", "flag", "Queryable")
    add(12, 27, "k", "flag", "Queryable", "2")
    counts = said(engine, 11)
    for key, last in said(engine, 12).items():
        own = [int(v) for s, v in sorted(((int(s.split("|")[1]), v) for s, v in counts.items() if s.split("|")[0] == key))]
        assert last == ",".join(map(str, own[-2:]))
    add(13, 4, "k", "v", "t", "1", "8", "16", "2")
    add(14, 29, "k", "v", "t", "1", "8", "16", "2", "0.6")
    past = said(engine, 14, "0.6", "s1")
    assert {tuple(sorted(p.split("|"))) for p in said(engine, 13, "0.9")} >= {("s1", "s3")} and past and all("s1_" in p for p in past)
    add(15, 5, "k", "v", "Queryable", "16", "16")
    assert len(said(engine, 15)) == 6 and "s0|s2" in said(engine, 15, "0.5") or said(engine, 15, "0.5")
    add(16, 6, "k", "v", "Queryable", "4", "20")
    assert sorted(said(engine, 16, "2")) == ["0", "1"]
    add(17, 100, "k", "v", "Queryable", "5", "0.8", "16", "50")
    assert all(int(n) >= 1 for n in said(engine, 17).values())
    live = {r.uid: r for r in engine.synopses().collect()}
    assert set(live) == set(range(1, 18)) and live[13].kind == "dft" and live[1].partitioning == "random" and live[1].partitions == 3
    with pytest.raises(ValueError):
        add(18, 99, "k", "v", "Queryable")


def test_topk_simulation_and_all_equal_coresets(spark):
    e = Engine(spark)
    e.register_dataset("d", spark.createDataFrame([(s, t, float(s * 10 + t)) for s in range(6) for t in range(5)], "s int, t int, v double"), ["t"])
    e.handle(ask(1, 1, 13, "s", "v", "t", "3", "4"))
    assert said(e, 1, "3", "2") == {"0": "2.0", "1": "12.0", "2": "22.0"}
    sims = [(s, t, (t * (s % 2 + 1)) % 7, (t + s) % 5, t % 3) for s in range(6) for t in range(20)]
    e.register_dataset("sims", spark.createDataFrame(sims, "s int, t int, a int, b int, c int"), ["t"])
    e.handle(ask(1, 2, 28, "s", "a,b,c", "t", "10", "16", data="sims"))
    assert all(float(v) >= 0.5 for v in said(e, 2, "0.5", "4", "1").values())
    one = said(e, 2, "0.5", "4", "3", "0_0&1_0", "20")
    assert {k.split("|")[0] for k in one} == {"0_0", "1_0"} and all(int(k.rsplit("_", 1)[1]) < 10 for k in one)
    e.add(SynopsisSpec(3, "coreset", "d", "s", "v", {"dims": 3, "size": 10, "all_equal": True}))
    assert all(len(set(v.split(" ")[1:])) == 1 for v in said(e, 3, "2").values())


def test_saved_synopsis_is_live_elsewhere(spark, engine, tmp_path):
    engine.add(SynopsisSpec(40, "count_min", "d", "k", params={"eps": 0.01, "confidence": 0.9, "seed": 4}))
    engine.save(40, str(tmp_path / "s"))
    other = Engine(spark)
    assert other.load(str(tmp_path / "s")) == 40 and said(other, 40, "s1") == said(engine, 40, "s1") == {"s1": "40"}


def test_update_is_passed_on_and_messages_have_their_forms(spark, engine):
    engine.add(SynopsisSpec(41, "count_min", "d", "k"))
    again = engine.handle(ask(7, 41)).first()
    assert said(engine, 41, "s0") == {"s0": "80"} and json.loads(again.estimation)["requestID"] == 7
    rows = spark.createDataFrame(
        [(1, 7, 1, "d", '{"uid": 1}'), (2, 3, 29, "a|b", "0.9"), (3, 3, 1, "x", None), (4, 3, 1, "y", "5")],
        "uid int, requestID int, synopsisID int, key string, estimation string"
    )
    got = {r.key: r.value for r in connectors.estimation_messages(rows).collect()}
    assert got["1"] == '{"uid": 1}' and got["2"] == "2,a|b,0.9" and json.loads(got["3"])["estimation"] == "NULL_ESTIMATION" and json.loads(got["4"])["estimation"] == "5"
    old = connectors.csv_estimations(spark.createDataFrame([("k, e, s, 5, 3, 1, 12, a;b, 2",)], "value string"))
    assert old.first().param == ["a", "b"] and {k: v.count() for k, v in connectors.multiplexed(old).items()} == {"single": 0, "partial": 1, "updates": 0, "estimations": 1}
    lines = connectors.tuple_lines(spark.createDataFrame([(1, [0.5, 2.0], None)], "a int, b array<double>, c string"), "a", "b", "c")
    assert lines.first().value == "(1,[0.5, 2.0],null)"


def test_requests_fan_out(spark):
    schema = REQUEST
    rows = [("d", 1, 1, 5, "s", ["k"], 3), ("a, b", 6, 1, 6, "s", ["2", "1", "2"], 1)]
    got = fanned_out(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.uid, r.dataSetkey, r.partition) for r in got) == [(5, "d", 0), (5, "d", 1), (5, "d", 2), (6, "a", 0), (6, "b", 0)]


def run_stream(df, path):
    df.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/ck").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/out").collect()


def test_requests_and_elements_as_streams(spark, tmp_path):
    """Three runs of one query: what is added in the first goes on in the second, and is gone after the third deletes it."""
    schema = T.StructType([*REQUEST.fields, T.StructField("at", T.LongType())])
    data, req = str(tmp_path / "data"), str(tmp_path / "req")
    steps = [(
        [("a", 1), ("a", 2), ("b", 3)],
        [
            (ask(1, 5, 1, "k", "null", "Queryable", "0.05", "0.9", "1"), 0), (ask(5, 6, 1, "k", "null", "Queryable", "0.05", "0.9", "1"), 2),
            (ask(1, 7, 2, "k", "null", "Queryable", "50", "0.01"), 0), (ask(3, 5, 1, "a", "b"), 9)
        ]
    ),
             ([("a", 11)], [(ask(3, 5, 1, "a"), 19), (ask(3, 7, 2, "b", "z"), 19)]), ([("a", 21)], [(ask(2, 5), 20), (ask(3, 5, 1, "a"), 29)])]
    seen = 0
    for elements, asked in steps:
        spark.createDataFrame([("d", k, 1, t) for k, t in elements], "dataset string, key string, weight int, at long").coalesce(1).write.mode("append").parquet(data)
        spark.createDataFrame([(json.dumps({**r, "at": t}),) for r, t in asked], "value string").coalesce(1).write.mode("append").text(req)
        stream = spark.readStream.schema("dataset string, key string, weight int, at long").parquet(data)
        answers = run_stream(controlled(stream, connectors.parsed(connectors.lines(spark, req, stream=True), schema), parts=2), str(tmp_path))
        new = sorted((r.uid, r.requestID, r.key, r.estimation) for r in answers)
        if seen == 0:
            assert new == [(5, 3, "a", "2"), (5, 3, "b", "1"), (6, 5, "a", "1"), (6, 5, "b", "1")]  # the continuous one is added before the second element
        elif seen == 1:
            assert {(5, 3, "a", "3"), (7, 3, "b", "true"), (7, 3, "z", "false"), (6, 5, "a", "2")} <= set(new)
        else:
            assert len(new) == 9 and (6, 5, "a", "3") in new
        seen += 1


def test_continuous_request_on_a_stream_and_a_table(spark, tmp_path):
    spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), ("a", 4)], "k string, at long").coalesce(1).write.parquet(str(tmp_path / "in"))
    e = Engine(spark)
    e.register_dataset("d", spark.read.parquet(str(tmp_path / "in")), ["at"])
    e.register_dataset("s", spark.readStream.schema("k string, at long").parquet(str(tmp_path / "in")))
    want = sorted((r.key, r.estimation) for r in e.handle(ask(5, 1, 1, "k", "null", "Queryable", "0.05", "0.9", "1")).collect())
    assert want == [("a", "1"), ("a", "2"), ("a", "3"), ("b", "1")]
    assert e.handle(ask(5, 2, 1, "k", "null", "Queryable", "0.05", "0.9", "1", data="s")) is None
    e.streams[2].processAllAvailable()
    folder = spark.sparkContext.getCheckpointDir()
    got = [json.loads(r.value) for r in spark.read.text(f"{folder}/continuous-2/messages").collect()]
    assert sorted((r["key"], r["estimation"]) for r in got) == want and {r["requestID"] for r in got} == {5}
    e.delete(2)
    assert not spark.streams.active
    half = e.handle(ask(5, 3, 15, "at", "k", "Queryable", "1")).count()
    assert 0 <= half <= 4
    with pytest.raises(ValueError):
        e.handle(ask(5, 4, 2, "k", "null", "Queryable", "10", "0.1"))


def test_sketch_is_not_built_again(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).selectExpr("id % 3 AS k").write.parquet(path)
    e = Engine(spark)
    e.register_dataset("d", spark.read.parquet(path))
    e.add(SynopsisSpec(1, "count_min", "d", "k", partitions=4))
    assert all(path not in f for f in e.sketch(1).inputFiles()) and CountMin(0.01, 0.99).width >= 200
    assert e.estimate(1, "0").filter(F.col("estimation") == "34").count() == 1


def test_routers(spark):
    from tidemark.plans.routing import grid_elements, routed_elements

    asked = spark.createDataFrame(
        [
            (*ask(1, 1, 1, parts=3).values(), 1), (*ask(1, 2, 2, parts=3).values(), 2), (*ask(2, 1).values(), 3),
            (*ask(4, 3, 1, parts=2).values(), 4), (*ask(1, 4, 1, data="e").values(), 5), (*ask(2, 9).values(), 6)
        ],
        T.StructType([*REQUEST.fields, T.StructField("at", T.LongType())])
    )
    rows = [("d", f"s{k % 5}", str(k)) for k in range(40)] + [("d", None, None), ("other", "s", "1")]
    got = routed_elements(spark.createDataFrame(rows, "dataset string, stream string, v string"), asked).collect()
    assert len(got) == 2 * 41  # uid 2 still asks for three partitions by key, uid 3 for two at random
    keyed = {}
    for r in got:
        assert r.route.rsplit("_", 1)[0] in ("d_3_KEYED", "d_2_RANDOM")
        if "KEYED" in r.route:
            keyed.setdefault(r.stream, set()).add(r.route)
    assert all(len(v) == 1 for v in keyed.values())
    windows = spark.createDataFrame([("d", "a", [1.0, 2.0, 4.0, 3.0]), ("e", "b", [4.0, 1.0, 2.0, 2.0])], "dataset string, stream string, x array<double>")
    assert grid_elements(windows, asked, "x", 4, 3).count() == 0
    assert {r.dataset for r in grid_elements(windows, asked, "x", 4, 3, automatic=True).collect()} == {f"{d}_{g}" for d in "de" for g in range(3)}
