"""Requests of every kind beside the data, in two stages: the stream answers as one summary of all elements does."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.engine import Engine
from tidemark.plans.spec import REQUEST
from tidemark.streaming import kinds, serving

ASKED = T.StructType([*REQUEST.fields, T.StructField("at", T.LongType())])
DATA = "dataset string, stream string, fields map<string,string>, at long"
R = random.Random(8)
ROWS = [(
    "d", f"s{k % 9}",
    {"k": f"s{k % 9}", "v": str(round(R.gauss(0, 10), 3)), "t": str(k // 9), "flag": R.choice(["a1", "b1", "c2", "x"]), "who": f"u{int(R.random() ** 3 * 400)}"},
    k
) for k in range(1800)]


def ask(number, uid, synopsis=1, *param, at=10**9, data="d"):
    return (data, number, synopsis, uid, "all", list(param), 4, at)


class Served:
    """Files of elements and requests that a query is run over, some at a time."""

    def __init__(self, spark, folder, parts=4, routes=("keyed", "random")):
        self.spark, self.folder, self.parts, self.routes, self.batch = spark, folder, parts, routes, 0

    def run(self, rows=(), requests=()):
        for name, data, schema in (("elements", rows, DATA), ("requests", requests, ASKED)):
            self.spark.createDataFrame(list(data), schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/{name}")
        read = lambda name, schema: self.spark.readStream.schema(schema).parquet(f"{self.folder}/{name}")
        answers = serving.served(read("elements", DATA), read("requests", ASKED), self.parts, self.routes)
        query = answers.writeStream.format("parquet").option("path", f"{self.folder}/answers").option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        return self

    def answers(self):
        out = {}
        for r in self.spark.read.schema(serving.ANSWERS).parquet(f"{self.folder}/answers").collect():
            out.setdefault((r.uid, r.at) if r.requestID == 3 or r.key == "status" else (r.requestID, r.uid, r.at), {})[r.key] = r.estimation
        return out


def block(rows):
    return kinds.Block([r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows])


def whole(kind, *param, rows=ROWS):
    s = serving.summary_of(kind, list(param))
    s.add(block(rows))
    return s


KINDS = {
    1: (
        "count_min", 1, ["who", "null", "Queryable", "0.01", "0.9", "3"], ["u1", "u7", "none"]
    ), 2: ("bloom", 2, ["who", "null", "Queryable", "500", "0.01"], ["u1", "none"]), 3: ("ams", 3, ["who", "null", "Queryable", "5", "64"], ["u1", "u2"]),
    7: ("hyperloglog", 7, ["who", "null", "Queryable"], []), 9: ("lossy", 9, ["who", "null", "Queryable", "0.005"], ["u0", "u1"]), 8: ("sticky", 8, ["who", "null", "Queryable", "0.05", "0.01", "0.01"], ["u0"]), 10: ("chain_sample", 10, ["k", "v", "Queryable", "12", "300"], []),
    11: ("quantiles", 11, ["k", "v", "Queryable", "0.02"], ["0.1", "0.5", "0.9"]), 13: ("topk", 13, ["k", "v", "t", "3", "4"], ["3", "150"]), 15: ("wor_sample", 15, ["who", "v", "Queryable", "20"], []), 16: ("window_quantiles", 16, ["k", "v", "Queryable", "0.05", "60"], ["0.5"]),
    26: ("finjoin", 26, ["k", "flag", "Queryable"], []), 27: ("counters", 27, ["k", "flag", "Queryable", "4"], []), 5: ("lsh", 5, ["k", "v", "Queryable", "16", "12"], []), 6: ("coreset", 6, ["k", "v", "Queryable", "2", "40"], ["3"]),
}


@pytest.fixture(scope="module")
def served(spark, tmp_path_factory):
    """Every kind, with elements dealt at random where its keys allow it (request 4) and in three runs of the query, and faulty requests beside them."""
    s = Served(spark, str(tmp_path_factory.mktemp("served")))
    adds = [ask(4, uid, synopsis, *param, at=-1) for uid, (_, synopsis, param, _) in KINDS.items()] + [ask(1, 101, *[1, *KINDS[1][2]], at=-1)]
    wrong = [
        ask(1, 50, 1, "who", "null", "Queryable", at=-1), ask(1, 51, 999, "who", at=-1),
        ask(1, 52, 1, "who", "null", "Queryable", "x", "y", "z", at=-1), ask(7, 53, at=-1), ask(3, 54, 1, "u1", at=-1),
        ask(5, 55, 9, "who", "null", "Queryable", "0.1", at=-1), ask(1, 56, 29, "k", "v", at=-1), (None, 1, 1, 57, "all", [], 4, 0)
    ]
    s.run(ROWS[:700], adds + wrong)
    s.run(ROWS[700:1500] + [(None, "s", None, 3), ("d", None, None, 1400), ("other", "s", {"who": "u1"}, 1401)], [ask(3, 1, 1, *KINDS[1][3], at=899)])
    return s.run(
        ROWS[1500:],
        [ask(3, uid, synopsis, *asked) for uid, (_, synopsis, _, asked) in KINDS.items()] + [
            ask(3, 101, 1, "u1", "u7"), ask(6, 1, 1, "2", "1", "101"), ask(2, 101, at=10**9 + 1), ask(3, 101, 1, "u1", at=10**9 + 2)
        ]
    )


@pytest.mark.parametrize("uid", [1, 2, 3, 5, 7, 10, 13, 15, 26, 27])
def test_answers_of_parts_are_those_of_the_whole(served, uid):
    kind, _, param, asked = KINDS[uid]
    assert served.answers()[uid, 10**9] == dict(whole(kind, *param).answer(asked))


def test_counts_are_those_of_the_batch_engine(spark, served):
    engine = Engine(spark)
    engine.register_dataset("d", spark.createDataFrame([(r[2]["who"],) for r in ROWS], "who string"))
    engine.handle({"dataSetkey": "d", "requestID": 1, "synopsisID": 1, "uid": 1, "streamID": "all", "param": KINDS[1][2], "noOfP": 1})
    want = {r.key: r.estimation for r in engine.estimate(1, "u1", "u7", "none").collect()}
    got = served.answers()
    assert got[1, 10**9] == want and got[101, 10**9] == {k: want[k] for k in ("u1", "u7")}
    engine.register_dataset("series", spark.createDataFrame([(r[2]["k"], float(r[2]["v"]), r[3]) for r in ROWS], "k string, v double, at long"), ["at"])
    engine.handle({"dataSetkey": "series", "requestID": 1, "synopsisID": 5, "uid": 5, "streamID": "all", "param": KINDS[5][2], "noOfP": 1})
    assert got[5, 10**9] == {r.key: r.estimation for r in engine.estimate(5).collect()}
    assert got[1, 899] == dict(whole("count_min", *KINDS[1][2], rows=[r for r in ROWS[700:1500] if r[3] < 899] + ROWS[:700]).answer(KINDS[1][3]))  # time decides within a batch


def test_bounded_answers(served):
    got, n = served.answers(), len(ROWS)
    true = {}
    for r in ROWS:
        true[r[2]["who"]] = true.get(r[2]["who"], 0) + 1
    assert all(true[k] - 0.005 * n - 4 <= int(v) <= true[k] for k, v in got[9, 10**9].items())
    assert true["u0"] - 0.01 * n - 4 <= int(got[8, 10**9]["u0"]) <= true["u0"]
    assert abs(int(got[7, 10**9]["who"]) / len(true) - 1) < 0.06
    values = np.sort([float(r[2]["v"]) for r in ROWS])
    assert all(abs(np.searchsorted(values, float(v)) - float(q) * n) <= 0.02 * n + 1 for q, v in got[11, 10**9].items())
    for k, v in got[16, 10**9].items():
        last = np.sort([float(r[2]["v"]) for r in ROWS if r[1] == k.split("_")[0]][-60:])
        assert abs(np.searchsorted(last, float(v)) - 30) <= 0.05 * 60 + 1
    assert sum(float(v.split()[0]) for v in got[6, 10**9].values()) == n // 2 and len(got[6, 10**9]) == 3
    sizes = [sum(c * c for c in true.values())]
    assert int(got[6, 1, 10**9]["1,101"]) >= sizes[0]


def test_faulty_requests_are_answered_and_harm_nothing(served):
    got = served.answers()
    for uid in (50, 51, 52, 53, 54, 55, 56):
        assert list(got[uid, -1]) == ["status"] and got[uid, -1]["status"].startswith("refused"), uid
    assert got[101, 10**9 + 2] == {"status": "refused: no such synopsis is live"} and (57, 0) not in got


def test_state_is_read_while_the_query_lives(spark, served):
    live = serving.live_synopses(spark, f"{served.folder}/checkpoint").filter("dataset = 'd'")
    found = {r.uid: (r.synopsisID, r.n) for r in live.groupBy("uid", "synopsisID").agg(F.count("*").alias("n")).collect()}
    assert found == {uid: (synopsis, 4) for uid, (_, synopsis, *_) in KINDS.items()}
    rows = serving.ask_live(spark, f"{served.folder}/checkpoint", 1, "u1", "u7", "none").collect()
    assert {r.key: r.estimation for r in rows} == served.answers()[1, 10**9]
    assert serving.ask_live(spark, f"{served.folder}/checkpoint", 77).count() == 0


def test_continuous_counts_go_along_with_elements(spark, tmp_path):
    rows = ROWS[:300]
    s = Served(spark, str(tmp_path), parts=2, routes=("keyed",)).run(
        rows, [ask(5, 1, 1, "k", "null", "Queryable", "0.01", "0.99", "1", at=50), ask(5, 2, 15, "who", "v", "Queryable", "5", at=-1)]
    )
    got = [(r.key, r.at, r.estimation) for r in s.spark.read.schema(serving.ANSWERS).parquet(f"{tmp_path}/answers").filter("uid = 1").collect()]
    seen, want = {}, []
    for r in rows:
        if r[3] >= 50:
            seen[r[1]] = seen.get(r[1], 0) + 1
            want.append((r[1], r[3], str(seen[r[1]])))
    assert sorted(got) == sorted(want)
    coins = s.spark.read.schema(serving.ANSWERS).parquet(f"{tmp_path}/answers").filter("uid = 2").count()
    assert 80 < coins < 220


def test_answers_do_not_depend_on_batches(spark, tmp_path):
    requests = [
        ask(1, 1, 16, "k", "v", "Queryable", "0.1", "20", at=-1), ask(1, 2, 26, "k", "flag", "Queryable", at=-1),
        ask(1, 3, 10, "k", "v", "Queryable", "5", "100", at=-1)
    ]
    s = Served(spark, str(tmp_path), parts=3, routes=("keyed",)).run((), requests)
    for low in range(0, 400, 100):
        s.run(ROWS[low : low + 100])
    s.run((), [ask(3, 1, 16, "0.5"), ask(3, 2, 26), ask(3, 3, 10)])
    got = s.answers()
    assert got[2, 10**9] == dict(whole("finjoin", "k", "flag", "Queryable", rows=ROWS[:400]).answer([]))
    assert got[3, 10**9] == dict(whole("chain_sample", "k", "v", "Queryable", "5", "100", rows=ROWS[:400]).answer([]))
    assert set(got[1, 10**9]) == {f"s{k}_0.5" for k in range(9)}


def test_all_segments_and_times_are_served(spark, sf, tmp_path):
    """A user with 1206 segments, and a month that 300 months follow."""
    import duckdb
    from oracle import same

    from tidemark import catalog

    for name in ("events", "orders"):
        copies = spark.read.parquet(f"{sf}/{name}.parquet").crossJoin(spark.range(6).select(F.col("id").alias("copy")))
        if name == "events":
            copies = copies.withColumns({"event_id": F.col("event_id") + F.col("copy") * 1_000_000, "user_id": F.lit(1).cast("long")})
        else:
            copies = copies.withColumns({"o_orderkey": F.col("o_orderkey") + F.col("copy") * 10_000_000, "o_orderdate": (F.col("o_orderdate") + F.make_interval(F.col("copy") * 7)).cast("timestamp")})
        copies.drop("copy").coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    duck = duckdb.connect()
    for name in ("events", "orders"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert duck.execute("SELECT count(*) FILTER (event_type = 'purchase') > 1000 FROM events").fetchone()[0]
    assert duck.execute("SELECT count(DISTINCT strftime(o_orderdate, '%Y-%m')) > 300 FROM orders WHERE o_orderdate > '1995-04-01'").fetchone()[0]
    same(spark, duck, tmp_path, catalog.queries()["served_requests"], catalog.oracle_sql()["served_requests"])
