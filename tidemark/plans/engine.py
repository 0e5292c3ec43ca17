"""Synopses that are added, estimated, updated and deleted while data are there: the control plane.

A sketch is built in one scan of its dataset when it is added, and written to the shared folder: estimates read the sketch. Requests are
messages of a few bytes, handled one by one on the driver; only they are. Requests that arrive as a stream beside the data are
handled by streaming/control.py.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import frequency, sampling, similarity
from tidemark.plans import series_synopses  # noqa: F401 - makes its kinds known
from tidemark.plans.spec import ESTIMATION, REQUEST_IDS, SYNOPSIS_IDS, SynopsisSpec
from tidemark.plans.synopses import KINDS
from tidemark.storage import written

#: What a request's parameters after key, value and mode (for kinds with a time field, the field) are, by kind.
PARAMETERS = {
    "count_min": (("eps", float), ("confidence", float), ("seed", int)), "bloom": (("elements", int), ("fpp", float)), "ams": (("depth", int), ("width", int)),
    "hyperloglog": (), "flajolet_martin": (), "quantiles": (("eps", float),), "wor_sample": (("size", int),), "lossy": (("eps", float),), "sticky": (("support", float), ("eps", float), ("failure", float)),
    "chain_sample": (("size", int), ("window", int)), "window_quantiles": (("eps", float), ("window", int)), "trajectory": (("period", float), ("distance", float), ("knots", float), ("course", float)),
    "topk": (("k", int), ("countdown", int)), "dft": (("interval", int), ("basic", int), ("sliding", int), ("coefs", int)), "past_dft": (
        ("interval", int), ("basic", int), ("sliding", int), ("coefs", int), ("threshold", float)
    ),
    "lsh": (("window", int), ("bits", int)), "coreset": (("dims", int), ("size", int)), "finjoin": (), "counters": (("length", int),), "simulation_windows": (("width", int), ("bits", int)),
    "radius": (("groups", int), ("side", float), ("window", int), ("percent", float)),
}
#: Kinds whose third parameter names the time field.
TIMED = ("topk", "dft", "past_dft", "simulation_windows")


def routed(df: DataFrame, key: str, partitions: int, partitioning: str = "keyed") -> DataFrame:
    """Adds partition: of the key's hash, or, at random, of a row's whole content, so that a rerun deals alike."""
    by: Column = F.xxhash64(key) if partitioning == "keyed" else F.xxhash64(*df.columns)
    return df.withColumn("partition", F.pmod(by, F.lit(partitions)).cast("int"))


def fanned_out(requests: DataFrame) -> DataFrame:
    """Each request once for each of its partitions, estimates of join sizes once for each of their datasets."""
    copies = F.sequence(F.lit(0), F.greatest(F.coalesce("noOfP", F.lit(1)), F.lit(1)) - 1)
    datasets = F.when(F.col("requestID") == 6, F.split("dataSetkey", r"\s*,\s*")).otherwise(F.array("dataSetkey"))
    return requests.withColumn("dataSetkey", F.explode(datasets)).withColumn("partition", F.explode(copies))


def number_of(kind: str) -> int | None:
    return next((k for k, v in SYNOPSIS_IDS.items() if v == kind), None)


class Engine:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.datasets: dict[str, tuple[DataFrame, list[str] | None]] = {}
        self.live: dict[int, tuple] = {}
        self.streams: dict[int, object] = {}

    def register_dataset(self, name: str, df: DataFrame, order: list[str] | None = None) -> None:
        """order: the columns by which the dataset is a stream."""
        self.datasets[name] = (df, order)

    def _synopsis(self, spec: SynopsisSpec):
        if spec.kind not in KINDS:
            raise ValueError(f"no synopsis is called {spec.kind}")
        order = self.datasets[spec.dataset][1]
        if order is not None:
            spec.params.setdefault("order", order)
        return KINDS[spec.kind](spec)

    def add(self, spec: SynopsisSpec) -> None:
        """Builds and writes the sketch in one scan. Partitions are Spark's: every task makes its part of a sum, and merges are the final aggregation;
        summaries that are no sums have as many pieces as the spec says. Series are never torn apart, whatever the partitioning."""
        synopsis = self._synopsis(spec)
        self.live[spec.uid] = (synopsis, written(synopsis.build(self.datasets[spec.dataset][0])))

    def delete(self, uid: int) -> None:
        self.live.pop(uid, None)
        if uid in self.streams:
            self.streams.pop(uid).stop()

    def sketch(self, uid: int) -> DataFrame:
        return self.live[uid][1]

    def estimate(self, uid: int, *params: str) -> DataFrame:
        """(uid, requestID, synopsisID, key, estimation); no rows where no such synopsis is live."""
        if uid not in self.live:
            return self.spark.createDataFrame([], ESTIMATION)
        synopsis, sketch = self.live[uid]
        return self._estimations(uid, 3, synopsis.spec.kind, synopsis.estimate(sketch, *params))

    def _estimations(self, uid: int, request: int, kind: str, rows: DataFrame) -> DataFrame:
        return rows.select(F.lit(uid).alias("uid"), F.lit(request).alias("requestID"), F.lit(number_of(kind)).cast("int").alias("synopsisID"), "key", "estimation")

    def join_size(self, uids: list[int]) -> DataFrame:
        specs = [self.live[u][0].sketch for u in uids]
        if any((s.width, s.depth, s.seed) != (specs[0].width, specs[0].depth, specs[0].seed) for s in specs):
            raise ValueError("the sketches differ in shape or seed")
        size = frequency.join_size(*[self.sketch(u) for u in uids])
        return size.select(
            F.lit(uids[0]).alias("uid"), F.lit(6).alias("requestID"), F.lit(1).alias("synopsisID"), F.lit(",".join(map(str, uids))).alias("key"),
            F.col("join_size").cast("string").alias("estimation")
        )

    def update(self, uid: int, sketch: DataFrame) -> None:
        """Merges a sketch of more data, such as another site's, into a live one."""
        synopsis, old = self.live[uid]
        self.live[uid] = (synopsis, written(synopsis.merge(old, sketch)))

    def update_from(self, uid: int, dataset: str) -> DataFrame:
        """Merges what a dataset adds into a live synopsis, and passes the update on as a request, which other sites can follow."""
        synopsis, _ = self.live[uid]
        self.update(uid, synopsis.build(self.datasets[dataset][0]))
        again = {
            "dataSetkey": dataset, "requestID": 7, "synopsisID": number_of(synopsis.spec.kind), "uid": uid, "streamID": "all",
            "param": [synopsis.spec.key, synopsis.spec.value or "null"], "noOfP": synopsis.spec.partitions
        }
        return self.spark.createDataFrame([(uid, 7, number_of(synopsis.spec.kind), dataset, json.dumps(again))], ESTIMATION)

    def add_continuous(self, spec: SynopsisSpec) -> DataFrame | None:
        """Estimates that go along with the elements: (uid, requestID 5, synopsisID, key, estimation) for each element (count_min: its key's weight up to
        it) or each one that is kept (trajectory, wor_sample: one in two by its hash). Of a dataset that is a stream a streaming query is
        started, kept in `streams`, that writes these as messages to its folder in the shared one."""
        df, order = self.datasets[spec.dataset]
        if df.isStreaming:
            from tidemark.streaming import control

            self.streams[spec.uid] = control.start_continuous(df, spec)
            return None
        synopsis = self._synopsis(spec)
        if spec.kind == "count_min":
            rows = synopsis.sketch.running(
                df.withColumn(spec.key, F.col(spec.key).cast("string")), spec.key, order, spec.value
            ).withColumnRenamed("estimate", "estimation")
        elif spec.kind == "trajectory":
            rows = synopsis.build(df).withColumn("estimation", F.concat_ws(",", "t", "lat", "lon"))
        elif spec.kind == "wor_sample":
            rows = sampling.bernoulli(df, spec.key, 1).withColumn("estimation", F.col(spec.value or spec.key))
        elif spec.kind == "radius":
            rows = self._radius_pairs(df, spec, order)
        else:
            raise ValueError(f"{spec.kind} has no continuous form")
        return self._estimations(spec.uid, 5, spec.kind, rows.select(F.col(spec.key).cast("string").alias("key"), F.col("estimation").cast("string")))

    def _radius_pairs(self, df: DataFrame, spec: SynopsisSpec, order: list[str]) -> DataFrame:
        """Pairs of series whose windows (arrays, numbered by the last column of the order) share enough cells, as their stream tells them."""
        p, number = spec.params, order[-1]
        series = F.col(spec.key).cast("string")
        ids = written(df.select(F.xxhash64(series, number).alias("id"), series.alias("name"), F.col(number).alias("w"), F.col(spec.value).alias("x")))
        groups = p.get("groups", 10)
        cells = similarity.radius_groups(ids.select("id", "x"), "id", "x", p.get("window", 20), groups, p.get("side", 0.8), 100)
        pairs = similarity.radius_vote(cells, "id", groups, p.get("percent", 70))
        for side in "ab":
            pairs = pairs.join(ids.select(F.col("id").alias(side), F.col("name").alias(f"{side}_name"), F.col("w").alias(f"{side}_w")), side)
        pairs = pairs.filter("a_w = b_w AND a_name <> b_name")
        names = F.concat_ws("|", F.least("a_name", "b_name"), F.greatest("a_name", "b_name"))
        return pairs.select(names.alias(spec.key), F.col("a_w").cast("string").alias("estimation"))

    def synopses(self) -> DataFrame:
        """(uid, synopsisID, kind, dataset, key, value, params, partitioning, partitions) of what is live."""
        rows = [
            (
                u, number_of(s.spec.kind), s.spec.kind, s.spec.dataset, s.spec.key, s.spec.value, json.dumps(s.spec.params, sort_keys=True),
                s.spec.partitioning, s.spec.partitions
            ) for u,
            (s, _) in sorted(self.live.items())
        ]
        return self.spark.createDataFrame(
            rows, "uid int, synopsisID int, kind string, dataset string, key string, value string, params string, partitioning string, partitions int"
        )

    def save(self, uid: int, path: str) -> None:
        """The sketch and its spec, as two Parquet tables."""
        self.synopses().filter(F.col("uid") == uid).coalesce(1).write.parquet(f"{path}/spec")
        self.sketch(uid).write.parquet(f"{path}/sketch")

    def load(self, path: str) -> int:
        """Makes a saved synopsis live; its dataset need not be there."""
        r = self.spark.read.parquet(f"{path}/spec").first()
        spec = SynopsisSpec(r["uid"], r["kind"], r["dataset"], r["key"], r["value"], json.loads(r["params"]), r["partitioning"], r["partitions"])
        self.live[spec.uid] = (KINDS[spec.kind](spec), self.spark.read.parquet(f"{path}/sketch"))
        return spec.uid

    def spec_of(self, request) -> SynopsisSpec:
        """What a request to add asks for."""
        kind, param = SYNOPSIS_IDS.get(request["synopsisID"]), list(request["param"])
        names = PARAMETERS.get(kind)
        if names is None:
            raise ValueError(f"no synopsis has the number {request['synopsisID']}")
        key, value, third, *rest = [*param, *[None] * (3 - len(param))]
        if len(rest) < len(names):
            raise ValueError(f"{kind} takes the parameters {', '.join(n for n, _ in names)}")
        params = {n: f(x) for (n, f), x in zip(names, rest)}
        if kind in TIMED:
            params["time"] = third
        return SynopsisSpec(
            request["uid"], kind, request["dataSetkey"], key, None if value in (None, "", "null") else value, params,
            "random" if request["requestID"] == 4 else "keyed", request["noOfP"] or 1
        )

    def handle(self, request) -> DataFrame | None:
        """One request (fields of REQUEST); estimates, updates and continuous synopses of tables return rows."""
        action = REQUEST_IDS[request["requestID"]]
        if action == "delete":
            return self.delete(request["uid"])
        if action == "estimate":
            return self.estimate(request["uid"], *request["param"])
        if action == "join_size":
            return self.join_size([int(u) for u in request["param"][1 : 1 + int(request["param"][0])]])
        if action == "update":
            return self.update_from(request["uid"], request["dataSetkey"])
        if action == "add_continuous":
            return self.add_continuous(self.spec_of(request))
        return self.add(self.spec_of(request))

    def run(self, requests) -> DataFrame:
        """The estimates of a list of requests, in order."""
        found = [x for x in map(self.handle, requests) if x is not None]
        return reduce(DataFrame.unionByName, found) if found else self.spark.createDataFrame([], ESTIMATION)
