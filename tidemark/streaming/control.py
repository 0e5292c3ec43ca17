"""Requests that arrive as a stream beside the data, for keys that a single part answers for: the first stage of streaming/serving.py alone.

Elements are routed to parts of their dataset by the hash of their key; requests to add or delete go to all parts, estimates to the part of the
key that is asked for. A part's state maps the numbers of the live Count-Min sketches and Bloom filters of its dataset to them.
Within a batch, rows are handled in the order of their time, requests before elements of the same time.
"""

from __future__ import annotations

import pickle

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.hashing import number
from tidemark.plans.spec import SynopsisSpec
from tidemark.storage import shared_folder
from tidemark.streaming.serving import ANSWERS, PARTIALS, Parts, packed, use_rocksdb


def answered(frames):
    """Rows of the first stage -> the answers that they hold; what is refused or unknown has none."""
    import pandas as pd

    for frame in frames:
        out = frame.loc[frame["key"].notna(), ["uid", "requestID", "synopsisID", "key", "estimation", "at"]].values.tolist()
        for r in frame[frame["summary"].notna()].itertuples(index=False):
            out += [[r.uid, r.requestID, r.synopsisID, k, v, r.at] for k, v in pickle.loads(r.summary).answer(list(r.param))]
        yield pd.DataFrame(out, columns=["uid", "requestID", "synopsisID", "key", "estimation", "at"])


def controlled(elements: DataFrame, requests: DataFrame | None, parts: int = 8, standing: tuple[int, list[str]] | None = None) -> DataFrame:
    """(uid, requestID, synopsisID, key, estimation, at) of elements (dataset, key, weight, at) and requests (as REQUEST, and at) for synopses 1 and 2: an
    answer for each key of an estimate, in append mode, and for each element one of each continuous synopsis. An estimate of what is not live
    has no row, a request of another kind is left out. standing: the uid and parameters of a continuous Count-Min sketch that is there from the start, so that
    requests may be None."""
    use_rocksdb(elements.sparkSession)
    part = lambda c: (number(F.col(c), text=True) % parts).cast("int")
    none = lambda kind: F.lit(None).cast(kind)
    text = elements.select(
        "dataset", F.col("key").cast("string").alias("key"), F.col("weight").cast("long").cast("string").alias("weight"),
        F.col("at").cast("long").alias("at")
    ).filter("key IS NOT NULL").withColumn("part", part("key"))
    both = packed(text.select(
        "dataset", F.lit("keyed").alias("route"), "part", "at", F.col("key").alias("stream"), F.create_map(F.lit("key"), "key", F.lit("weight"), "weight").alias("fields")
    ))
    if requests is not None:
        asked = requests.filter("synopsisID IN (1, 2)").select(
            F.col("dataSetkey").alias("dataset"), F.col("at").cast("long").alias("at"), "requestID", "synopsisID", "uid", "param"
        )
        estimates = asked.filter("requestID = 3").withColumn("key", F.explode("param")).withColumn("part", part("key")).withColumn("param", F.array("key")).drop("key")
        own = F.concat(F.array(F.lit("key"), F.lit("weight")), F.slice("param", 3, 99))  # elements have these two fields, whatever they were called
        adds = asked.filter("requestID <> 3").withColumn("param", F.when(F.col("requestID") == 2, F.col("param")).otherwise(own)).withColumn("requestID", F.when(F.col("requestID") == 4, 1).otherwise(F.col("requestID")))
        both = both.unionByName(
            estimates.unionByName(adds.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))))
            .withColumns({"route": F.lit("keyed"), "ask": F.lit(0).cast("long"), "block": none("binary")})
        )
    there = [] if standing is None else [(standing[0], 1, ["key", "weight", "Queryable", *standing[1]])]
    stage = both.groupBy("dataset", "route", "part").transformWithStateInPandas(Parts(parts, ("keyed",), there), PARTIALS, "append", "None")
    return stage.mapInPandas(answered, ANSWERS)


def start_continuous(stream: DataFrame, spec: SynopsisSpec):
    """Starts a query that writes, as JSON lines in continuous-<uid> of the shared folder, an estimate for each element of a stream with columns key and
    at (count_min), or each position kept (trajectory), element sampled (wor_sample) or pair of series that share enough cells (radius: value is the array of a window, at its number)."""
    from tidemark.operators.sampling import bernoulli
    from tidemark.sources.connectors import write_estimations
    from tidemark.streaming.continuous import trajectory_stream

    p, folder = spec.params, f"{shared_folder(stream.sparkSession)}/continuous-{spec.uid}"
    if spec.kind == "count_min":
        weight = F.lit(1) if spec.value is None else F.col(spec.value)
        elements = stream.select(F.lit(spec.dataset).alias("dataset"), F.col(spec.key).cast("string").alias("key"), weight.alias("weight"), F.col("at"))
        rows = controlled(
            elements, None, standing=(spec.uid, [str(p.get("eps", 0.01)), str(p.get("confidence", 0.99)), str(p.get("seed", 1))])
        ).withColumnRenamed("key", spec.key)
    elif spec.kind == "trajectory":
        rows = trajectory_stream(
            stream, spec.key, p.get("period", 60), p.get("distance", 500), p.get("knots", 1), p.get("course", 1)
        ).withColumn("estimation", F.concat_ws(",", "t", "lat", "lon"))
    elif spec.kind == "wor_sample":
        rows = bernoulli(stream, spec.key, 1).withColumn("estimation", F.col(spec.value or spec.key).cast("string"))
    elif spec.kind == "radius":
        from tidemark.streaming.digests import radius_as_it_arises

        pairs = radius_as_it_arises(
            stream, spec.key, "at", spec.value, p.get("window", 20), p.get("groups", 10), p.get("side", 0.8), p.get("percent", 70), p.get("keep", 10)
        )
        rows = pairs.select(F.concat_ws("|", "a", "b").alias(spec.key), F.col("w").cast("string").alias("estimation"))
    else:
        raise ValueError(f"{spec.kind} has no continuous form")
    out = rows.select(F.lit(spec.uid).alias("uid"), F.lit(5).alias("requestID"), F.col(spec.key).cast("string").alias("key"), "estimation")
    return write_estimations(out, f"{folder}/messages", f"{folder}/checkpoint")
