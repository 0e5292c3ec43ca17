"""Coresets for k-means: weighted representatives from a tree of clusters, merged and reduced in buckets, and clusters of them."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.storage import tasks

SCHEMA = "part int, weight double, coords array<double>, spread double"
FINER = 4


def seed_points(points: np.ndarray, weights: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """`size` of the points as seeds of clusters, fewer where fewer differ: each next one is drawn in proportion to weight times squared distance."""
    chosen = [int(rng.choice(len(points), p=weights / weights.sum()))]
    near = ((points - points[chosen[0]]) ** 2).sum(1)
    while len(chosen) < size and (mass := weights * near).sum() > 0:
        chosen.append(int(rng.choice(len(points), p=mass / mass.sum())))
        near = np.minimum(near, ((points - points[chosen[-1]]) ** 2).sum(1))
    return points[chosen]


class Tree:
    """A binary tree of clusters (Ackermann et al., 2012). A leaf is found from the root, at each node by the costs of its children; a point of
    it, drawn in proportion to its cost, becomes a centre of its own, the best of `trials` draws, and the leaf's points go to the nearer of the
    two. So a split touches the points of one leaf, not all."""

    def __init__(self, points: np.ndarray, weights: np.ndarray, rng: np.random.Generator, trials: int = 3):
        self.points, self.weights, self.rng, self.trials = points, weights, rng, trials
        first = int(rng.choice(len(points), p=weights / weights.sum()))
        self.near = ((points - points[first]) ** 2).sum(1)
        self.own, self.centre, self.up, self.kids = [np.arange(len(points))], [first], [-1], [None]
        self.cost, self.distances = [float((weights * self.near).sum())], len(points)

    def leaf(self) -> int:
        node = 0
        while self.kids[node] is not None:
            a, b = self.kids[node]
            node = a if self.rng.random() * (self.cost[a] + self.cost[b]) < self.cost[a] else b
        return node

    def split(self, node: int) -> bool:
        at = self.own[node]
        mass = self.weights[at] * self.near[at]
        if mass.sum() <= 0:
            return False
        tried = []
        for c in self.rng.choice(len(at), self.trials, p=mass / mass.sum()):
            gap = ((self.points[at] - self.points[at[c]]) ** 2).sum(1)
            tried.append((float((self.weights[at] * np.minimum(gap, self.near[at])).sum()), int(c), gap))
        self.distances += self.trials * len(at)
        _, c, gap = min(tried, key=lambda x: x[:2])
        moved = gap < self.near[at]
        self.near[at[moved]] = gap[moved]
        self.kids[node] = (len(self.own), len(self.own) + 1)
        for part, centre in ((at[~moved], self.centre[node]), (at[moved], int(at[c]))):
            self.own.append(part), self.centre.append(centre), self.up.append(node), self.kids.append(None)
            self.cost.append(float((self.weights[part] * self.near[part]).sum()))
        self.own[node] = None
        while node >= 0:
            self.cost[node] = sum(self.cost[k] for k in self.kids[node])
            node = self.up[node]
        return True

    def leaves(self, size: int) -> list[int]:
        """Up to `size` leaves."""
        for _ in range(size - 1):
            if self.cost[0] <= 0 or not self.split(self.leaf()):
                break
        return [k for k, kids in enumerate(self.kids) if kids is None]

    def grow(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The centres and weights of up to `size` leaves."""
        leaves = self.leaves(size)
        return self.points[[self.centre[k] for k in leaves]], np.array([self.weights[self.own[k]].sum() for k in leaves])

    def cells(self, size: int, spread: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The means, weights and spreads of up to `size` leaves; `spread` is what each point itself stands for."""
        means, weights, spreads = [], [], []
        for k in self.leaves(size):
            at = self.own[k]
            w, x = self.weights[at], self.points[at]
            mean = x[0] + (w[:, None] * (x - x[0])).sum(0) / w.sum()
            means.append(mean), weights.append(w.sum()), spreads.append(spread[at].sum() + (w * ((x - mean) ** 2).sum(1)).sum())
        return np.stack(means), np.array(weights), np.array(spreads)


def reduce_points(
    points: np.ndarray, weights: np.ndarray, size: int, rng: np.random.Generator, spread: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """At most `size` representatives, the leaves of a coreset tree: their means, weights and spreads (squared distances to the mean, summed). A leaf
    costs a centre weight * |mean - centre|**2 + spread, exactly what its points do; points alone would lose the spread at each reduction."""
    spread = np.zeros(len(points)) if spread is None else spread
    return (points, weights, spread) if len(points) <= size else Tree(points, weights, rng).cells(size, spread)


class Buckets:
    """Merge and reduce as a binary counter: a bucket i > 0 is empty or stands for 2**(i - 1) * size points by at most `size` of them. Two full ones
    of a level make one of the next, so that a point goes through one reduction for each doubling of the stream."""

    def __init__(self, size: int, seed):
        self.size, self.rng = size, np.random.default_rng(seed)
        self.open: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.full: list[tuple[np.ndarray, np.ndarray, np.ndarray] | None] = []
        self.reductions = 0

    def _reduced(self, *parts, size: int | None = None):
        self.reductions += 1
        points, weights, spread = map(np.concatenate, zip(*parts))
        return reduce_points(points, weights, size or self.size, self.rng, spread)

    def _carry(self, bucket, level: int = 0) -> None:
        while level < len(self.full) and self.full[level] is not None:
            bucket, self.full[level] = self._reduced(self.full[level], bucket), None
            level += 1
        self.full += [None] * (level + 1 - len(self.full))
        self.full[level] = bucket

    def add(self, points: np.ndarray, weights: np.ndarray, spread: np.ndarray | None = None) -> None:
        rows = points, weights, np.zeros(len(points)) if spread is None else spread
        for at in range(0, len(points), self.size):
            self.open.append(tuple(x[at : at + self.size] for x in rows))
            have = tuple(map(np.concatenate, zip(*self.open)))
            if len(have[0]) >= self.size:
                self._carry(tuple(x[: self.size] for x in have))
                have = tuple(x[self.size :] for x in have)
            self.open = [have] if len(have[0]) else []

    def merge(self, other: Buckets) -> None:
        """What another stream's buckets hold, level by level."""
        for level, bucket in enumerate(other.full):
            if bucket is not None:
                self._carry(bucket, level)
        for bucket in other.open:
            self.add(*bucket)

    def cells(self, size: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """The union of all buckets, reduced once (to `size`, a bucket's where it is not given): means, weights and spreads."""
        parts = [*self.open, *[b for b in self.full if b is not None]]
        return self._reduced(*parts, size=size) if parts else None

    def coreset(self) -> tuple[np.ndarray, np.ndarray] | None:
        """The means and weights of the cells."""
        cells = self.cells()
        return None if cells is None else cells[:2]


def _reducer(size: int, seed: int, out: int | None = None):
    """Buckets of `size` points for each part, and in the end `out` of them (as many as a bucket's where it is not given)."""

    def run(frames):
        import pandas as pd

        held: dict[int, Buckets] = {}
        for frame in frames:
            for part, rows in frame.groupby("part", sort=True):
                own = held.setdefault(int(part), Buckets(size, [seed, int(part)]))
                own.add(np.stack(rows["coords"].to_numpy()).astype(float), rows["weight"].to_numpy(float), rows["spread"].to_numpy(float))
        for part, own in sorted(held.items()):
            p, w, spread = own.cells(out)
            yield pd.DataFrame({"part": part, "weight": w, "coords": list(p), "spread": spread})

    return run


def coreset(df: DataFrame, vector: str, order: str, size: int, parts: int | None = None, fan_in: int = 8, seed: int = 1) -> DataFrame:
    """(weight, coords, spread): at most `size` representatives whose weights sum to the number of vectors; each is the mean of those that it stands
    for, spread the sum of their squared distances to it. Vectors without coordinates are left out.

    Each of `parts` parts of the rows (as many as the session has shuffle partitions) is read as a stream into buckets that are merged and reduced;
    then `fan_in` parts at a time are, up to one. Until then buckets are FINER times as large, so that what merging adds to the cells stays small
    beside what the last reduction does.
    """
    parts = parts or tasks(df.sparkSession)
    rows = df.filter(F.col(vector).isNotNull()).select(
        F.pmod(F.xxhash64(order), F.lit(parts)).cast("int").alias("part"), F.lit(1.0).alias("weight"),
        F.transform(vector, lambda v: v.cast("double")).alias("coords"), F.lit(0.0).alias("spread"), F.col(order).alias("_o")
    )
    reducer = lambda: _reducer(FINER * size, seed, size if parts == 1 else None)
    level = rows.repartition("part").sortWithinPartitions("part", "_o").drop("_o").mapInPandas(reducer(), SCHEMA)
    while parts > 1:
        parts = -(-parts // fan_in)
        level = level.withColumn("part", F.expr(f"part % {parts}")).repartition("part").sortWithinPartitions("part", "weight", "coords").mapInPandas(reducer(), SCHEMA)
    return level.select("weight", "coords", "spread")


def merge_coresets(size: int, *sketches: DataFrame) -> DataFrame:
    """The coreset of what several coresets stand for; each has at most `size` points."""
    rows = reduce(DataFrame.unionByName, sketches).withColumn("part", F.lit(0)).select("part", "weight", "coords", "spread")
    return rows.repartition(1).sortWithinPartitions("weight", "coords").mapInPandas(_reducer(size, 1), SCHEMA).select("weight", "coords", "spread")


def lloyd(x: np.ndarray, w: np.ndarray, k: int, runs: int, rounds: int, seed: int) -> tuple[float, np.ndarray, np.ndarray]:
    """The cost, centres and weights of the best of several runs from k-means++ seeds."""
    best = None
    for run in range(runs):
        centres = seed_points(x, w, k, np.random.default_rng([seed, run]))
        for _ in range(rounds):
            d = (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None, :]
            own = d.argmin(1)
            total = np.bincount(own, weights=w, minlength=len(centres))
            new = np.stack([np.bincount(own, weights=w * x[:, j], minlength=len(centres)) for j in range(x.shape[1])], 1) / np.maximum(total, 1e-12)[:, None]
            new[total == 0] = centres[total == 0]
            if np.allclose(new, centres):
                break
            centres = new
        cost_ = float((w * d.min(1)).sum())
        if best is None or cost_ < best[0]:
            best = (cost_, centres, total)
    return best


def kmeans(points: DataFrame, k: int, runs: int = 5, rounds: int = 50, seed: int = 1) -> DataFrame:
    """(centre, weight, coords): the best of several runs of Lloyd's iterations from k-means++ seeds over a coreset (weight, coords)."""

    def cluster(frame):
        import pandas as pd

        frame = frame.sort_values("weight", kind="stable")
        _, centres, total = lloyd(np.stack(frame["coords"].to_numpy()).astype(float), frame["weight"].to_numpy(float), k, runs, rounds, seed)
        return pd.DataFrame({"centre": range(len(centres)), "weight": total, "coords": list(centres)})

    return points.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(cluster, "centre int, weight double, coords array<double>")  # a coreset has a fixed size


def cost(points: DataFrame, vector: str, centres: DataFrame, weight: str | None = None, spread: str | None = None) -> DataFrame:
    """(points, cost): the number of points (the sum of their weights) and of their squared distances to the nearest centre, with the spreads that
    they have themselves. Centres are few."""
    to = F.array(*[F.array(*[F.lit(float(v)) for v in r["coords"]]) for r in centres.select("coords").collect()])
    gap = lambda c: F.aggregate(F.zip_with(vector, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    own = F.lit(0.0) if spread is None else F.col(spread)
    rows = points.select(F.array_min(F.transform(to, gap)).alias("d"), (F.lit(1) if weight is None else F.col(weight)).alias("w"), own.alias("s"))
    return rows.agg(F.sum("w").alias("points"), F.sum(F.col("w") * F.col("d") + F.col("s")).alias("cost"))


def constant_points(df: DataFrame, key: str, value: str, dims: int) -> DataFrame:
    """(key, coords): points whose every coordinate is the row's value."""
    return df.select(key, F.array_repeat(F.col(value).cast("double"), dims).alias("coords"))


def joined_points(df: DataFrame, key: str, order: list[str], value: str, dims: int) -> DataFrame:
    """(key, n, coords): points of `dims` consecutive values of a series, without overlap."""
    from tidemark.operators.series import numbered

    got = numbered(df, key, order).groupBy(key, F.expr(f"rn div {dims}").alias("n")).agg(
        F.count("*").alias("_n"), F.sort_array(F.collect_list(F.struct("rn", F.col(value).alias("v")))).alias("x")
    )
    return got.filter(F.col("_n") == dims).select(key, "n", F.transform("x", lambda s: s["v"].cast("double")).alias("coords"))
