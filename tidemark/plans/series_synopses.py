"""Synopses of series, samples and windows behind the same interface. Those that read a series in order are built of whole series: parts of the
data dealt by key are put together by a union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import clustering, sampling, series, similarity, topk
from tidemark.plans.synopses import KINDS, Synopsis, as_text

WEIGHTS = [0.5, 0.25, 0.25]  # of the channels of a simulation


def tail(a: str, b: str):
    return F.concat_ws("|", F.col(a).cast("string"), F.col(b).cast("string"))


class OfSeries(Synopsis):
    by_series = True

    @property
    def order(self) -> list[str]:
        return self.spec.params["order"]

    def merge(self, *sketches):
        return reduce(DataFrame.unionByName, sketches)


class ChainSample(OfSeries):
    """`size` of the last `window` rows of each key."""

    def build(self, df):
        return sampling.chain_sample(df, self.spec.key, self.order, self.order[-1], self.spec.params.get("size", 20), self.spec.params.get("window", 500))

    def estimate(self, sketch, *params):
        return as_text(sketch, self.spec.key, self.spec.value or self.spec.key)


class Trajectory(OfSeries):
    """The positions worth keeping of data with t, lat, lon, course and speed."""

    def build(self, df):
        p = self.spec.params
        return sampling.trajectory_sample(df, self.spec.key, self.order, p.get("period", 60), p.get("distance", 500), p.get("knots", 1), p.get("course", 1))

    def estimate(self, sketch, *params):
        return sketch.select(F.col(self.spec.key).cast("string").alias("key"), F.concat_ws(",", "t", "lat", "lon").alias("estimation"))


class TopK(Synopsis):
    """At each time the k + 1 lowest series; params of an estimate: k and the time."""

    def build(self, df):
        time = self.spec.params["time"]
        w = Window.partitionBy(time).orderBy(self.spec.value, self.spec.key)
        return df.select(self.spec.key, time, self.spec.value).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= self.spec.params.get("k", 5) + 1).drop("_n")

    def merge(self, *sketches):
        return self.build(reduce(DataFrame.unionByName, sketches))

    def estimate(self, sketch, *params):
        k, at = int(params[0]), params[1]
        return as_text(
            topk.merge_lowest(k, self.spec.value, topk.lowest_at(sketch, self.spec.key, self.spec.params["time"], self.spec.value, at, k + 1)),
            self.spec.key, self.spec.value
        )


class SlidingDft(OfSeries):
    """Digests of sliding windows; param of an estimate: the threshold. Pairs of series whose digests of their last common window allow it."""

    def shape(self) -> tuple[int, int, int]:
        p = self.spec.params
        basic = max(1, p.get("basic", 5) // p.get("interval", 1))
        return basic, max(1, p.get("sliding", 20) // p.get("basic", 5)), p.get("coefs", 8)

    def build(self, df):
        size, windows, coefs = self.shape()
        rows = series.numbered(
            df.select(*dict.fromkeys([self.spec.key, *self.order]), F.col(self.spec.value).cast("double").alias(self.spec.value)), self.spec.key,
            self.order
        )
        return series.sliding_dft(series.basic_windows(rows, self.spec.key, self.spec.value, size, coefs), self.spec.key, size, windows, coefs)

    def estimate(self, sketch, *params):
        threshold = float(params[0])
        last = sketch.filter(F.col("w") == sketch.agg(F.max("w")).scalar())
        on = series.on_grid(last, threshold)
        pairs = series.correlated(series.prefixed(on, "a"), series.prefixed(on, "b"), self.spec.key, ["w"], None, threshold, self.shape()[2])
        a, b = f"a_{self.spec.key}", f"b_{self.spec.key}"
        return pairs.select(
            F.concat_ws("|", F.least(a, b).cast("string"), F.greatest(a, b).cast("string")).alias("key"),
            F.col("bound").cast("string").alias("estimation")
        )


class PastDft(SlidingDft):
    """All past windows with their values and times; params of an estimate: the threshold, and keys whose windows are asked for (none: all pairs of
    the same window). Pairs are verified by their values."""

    def build(self, df):
        size, windows, coefs = self.shape()
        rows = df.withColumn(self.spec.value, F.col(self.spec.value).cast("double"))
        return series.past_windows(
            rows, self.spec.key, self.spec.value, self.spec.params["time"], self.order, size, windows, coefs, self.spec.params.get("threshold", 0.8)
        )

    def estimate(self, sketch, *params):
        size, windows, coefs = self.shape()
        threshold, asked = max(float(params[0]), self.spec.params.get("threshold", 0.8)), [k for p in params[1:] for k in p.split(";") if k]
        digests = sketch.drop("vals", "at", "mean", "sigma")
        others, left = F.expr(f"a_{self.spec.key} <> b_{self.spec.key}"), series.prefixed(digests, "a")
        if asked:
            left = left.filter(F.col(f"a_{self.spec.key}").cast("string").isin(asked))
        pairs = series.correlated(
            left, series.prefixed(digests, "b"), self.spec.key, [] if asked else ["w"], others, self.spec.params.get("threshold", 0.8), coefs,
            both_ways=bool(asked)
        )
        found = series.verified(pairs, threshold, size * windows)
        name = [F.concat_ws("_", F.col(f"{p}_{self.spec.key}").cast("string"), F.col(f"{p}_w").cast("string")) for p in "ab"]
        return found.select(F.concat_ws("|", *name).alias("key"), F.col("corr").cast("string").alias("estimation"))


class LastWindow(OfSeries):
    """(key, z): the last `window` values of each series, scaled; series with fewer are left out."""

    def build(self, df):
        n = self.spec.params.get("window", 20)
        last = sampling.last_rows(df.select(*dict.fromkeys([self.spec.key, *self.order, self.spec.value])), self.spec.key, self.order, n)
        got = last.groupBy(self.spec.key).agg(
            F.count("*").alias("_n"),
            F.transform(F.sort_array(F.collect_list(F.struct(*self.order, F.col(self.spec.value).cast("double").alias("_v")))), lambda r: r["_v"]).alias("vals")
        )
        return similarity.scaled(got.filter(F.col("_n") == n), "vals").select(self.spec.key, "z")


class Lsh(LastWindow):
    """Signs of random projections of the last window. Estimate without a param: the Hamming weight of each series; with a threshold: pairs of series."""

    def estimate(self, sketch, *params):
        n = self.spec.params.get("window", 20)
        if not params:
            return as_text(similarity.lsh_windows(sketch, [self.spec.key], n, self.spec.params.get("bits", 16), 35), self.spec.key, "hw")
        ids = sketch.select(F.xxhash64(self.spec.key).alias("id"), F.col(self.spec.key).cast("string").alias("name"), "z")
        pairs = similarity.lsh_pairs(ids, "id", "z", n, float(params[0]))
        for p in "ab":
            pairs = pairs.join(ids.select(F.col("id").alias(p), F.col("name").alias(f"{p}_name")), p)
        return pairs.select(F.concat_ws("|", F.least("a_name", "b_name"), F.greatest("a_name", "b_name")).alias("key"), F.col("corr").cast("string").alias("estimation"))


class Radius(LastWindow):
    """Radius sketches of the last window; param of an estimate: per cent of the groups that a pair must share. For each series the number of others
    that it shares so many with."""

    def estimate(self, sketch, *params):
        groups = self.spec.params.get("groups", 10)
        ids = sketch.select(F.xxhash64(self.spec.key).alias("id"), F.col(self.spec.key).cast("string").alias("name"), "z")
        cells = similarity.radius_groups(ids, "id", "z", self.spec.params.get("window", 20), groups, self.spec.params.get("side", 0.8), 100)
        found = similarity.radius_links(cells, "id", groups, float(params[0]) if params else self.spec.params.get("percent", 70))
        return as_text(found.join(ids.select("id", "name"), "id"), "name", "n_links")


class Coreset(Synopsis):
    """Representatives of points of `dims` consecutive values of a series, or (all_equal) of one value in every dimension; param of an estimate: the
    number of clusters."""

    by_series = True

    def build(self, df):
        p, rows = self.spec.params, df.filter(F.col(self.spec.value).isNotNull())
        if p.get("all_equal"):
            points = clustering.constant_points(rows.withColumn("_id", F.concat_ws("_", *p["order"])), "_id", self.spec.value, p.get("dims", 4))
        else:
            points = clustering.joined_points(rows, self.spec.key, p["order"], self.spec.value, p.get("dims", 4)).withColumn("_id", F.concat_ws("_", self.spec.key, "n"))
        return clustering.coreset(points, "coords", "_id", p.get("size", 200))

    def merge(self, *sketches):
        return clustering.merge_coresets(self.spec.params.get("size", 200), *sketches)

    def estimate(self, sketch, *params):
        found = clustering.kmeans(sketch, int(params[0]))
        return found.select(
            F.col("centre").cast("string").alias("key"),
            F.concat_ws(" ", F.round("weight").cast("string"), F.transform("coords", lambda v: F.round(v, 6).cast("string"))).alias("estimation")
        )


class FinJoin(OfSeries):
    """Counts of rows whose value ends in 1 before each row whose value ends in 2, since the one before it."""

    def build(self, df):
        v = F.col(self.spec.value).cast("string")
        return series.segments(df, self.spec.key, self.order, v.endswith("1"), v.endswith("2"))

    def estimate(self, sketch, *params):
        return sketch.select(tail(self.spec.key, "segment").alias("key"), F.col("cnt").cast("string").alias("estimation"))


class Counters(FinJoin):
    """The last `length` of these counts."""

    def estimate(self, sketch, *params):
        length = self.spec.params.get("length", 5)
        last = Window.partitionBy(self.spec.key).orderBy(F.desc("segment"))
        lists = series.last_counts(sketch, self.spec.key, length).withColumn("_n", F.row_number().over(last)).filter("_n = 1")
        return lists.select(F.col(self.spec.key).cast("string").alias("key"), F.array_join(F.transform("counts", lambda c: c.cast("string")), ",").alias("estimation"))


class SimulationWindows(OfSeries):
    """Windows of three channels (value: their columns joined by commas) at whole times; params of an estimate as requests have them: threshold, k,
    the query (1: nearest weights, 2 or 3: the most similar to the windows given as sim_start&sim_start), the windows, and the end of time T."""

    def build(self, df):
        p, channels = self.spec.params, self.spec.value.split(",")
        return similarity.simulation_windows(
            series.resampled(df, self.spec.key, p["time"], channels), self.spec.key, p["time"], channels, p.get("width", 40), p.get("step", 10),
            p.get("bits", 10), 33
        )

    def estimate(self, sketch, *params):
        threshold, k, query = float(params[0]), int(params[1]), int(params[2])
        width, bits = self.spec.params.get("width", 40), self.spec.params.get("bits", 10)
        if query == 1:
            found = similarity.simulation_pairs(sketch, self.spec.key, threshold, bits, WEIGHTS, k)
        else:
            names = [w.rsplit("_", 1) for w in params[3].split("&")]
            kind = {f.name: f.dataType.simpleString() for f in sketch.schema}
            asked = sketch.sparkSession.createDataFrame([(s, int(t)) for s, t in names], "s string, t long").select(
                F.col("s").cast(kind[self.spec.key]).alias(self.spec.key), F.col("t").cast(kind["start"]).alias("start")
            )
            found = similarity.similar_to(sketch, asked, self.spec.key, threshold, WEIGHTS, k, int(params[4]) - width if len(params) > 4 else None)
        a, b = (F.concat_ws("_", F.col(f"{p}_sim").cast("string"), F.col(f"{p}_start").cast("string")) for p in "ab")
        return found.select(F.concat_ws("|", a, b).alias("key"), F.col("corr").cast("string").alias("estimation"))


KINDS |= {
    "chain_sample": ChainSample, "trajectory": Trajectory, "topk": TopK, "dft": SlidingDft, "past_dft": PastDft, "lsh": Lsh, "radius": Radius, "coreset": Coreset,
    "finjoin": FinJoin, "counters": Counters, "simulation_windows": SimulationWindows,
}

