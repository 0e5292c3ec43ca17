"""Pairs of rows that share a code, verified in blocks.

Each row has a list of codes, one for each band, and values. Rows with the same code in a band form a bucket. A bucket of more than
`block` rows is cut into blocks, and every two of its blocks meet in a group of their own, so that no task holds a whole bucket. A bucket has
at most MOST blocks: a row has that many copies in a band at most, so what is shuffled grows with the rows, not with their pairs, and a group
with blocks of more rows multiplies them a tile at a time. A group compares its rows in numpy and counts a pair in the first band that it shares only.

Where codes only spare comparisons (sparing()), buckets are cut no finer than the tasks need. named_pairs() compares rows with the same values as one and tells
their pairs together, which also keeps the result small where it is written in columns.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.arrow import edges, runs
from tidemark.storage import tasks, written

KEYS = ["band", "h", "bi", "bj"]
MOST, TILE, FEW, EACH = 12, 1024, 1 << 16, 3


def correlation(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return x @ y.T


def equal_places(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return sum((x[:, None, k] == y[None, :, k]).astype(np.float64) for k in range(x.shape[1]))


def grouped(rows: DataFrame, block: int) -> DataFrame:
    """(band, h, bi, bj, part, codes, and the columns of rows but codes) of rows (id, codes, x, ...): of the codes those of earlier bands, which a group has to look at."""
    spread = rows.select("id", F.posexplode("codes").alias("band", "h"))
    full = written(spread.groupBy("band", "h").agg(F.count("*").alias("m")).filter("m > 1"))  # a table of its own, so that Spark can split the join's hot keys
    blocks = F.least(F.ceil(F.col("m") / block), F.lit(MOST)).cast("int")
    every = rows.select("*", F.posexplode("codes").alias("band", "h")).withColumn("codes", F.slice("codes", 1, F.col("band")))
    dealt = every.join(full, ["band", "h"]).withColumn("blocks", blocks).withColumn("part", F.pmod(F.xxhash64("id", "band"), F.col("blocks")).cast("int"))
    return _met(dealt)


def _met(dealt: DataFrame) -> DataFrame:
    """Rows (blocks, part) as often as their bucket has blocks."""
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return met.withColumns({"bi": F.least("part", "other"), "bj": F.greatest("part", "other")}).drop("blocks", "m", "other")


def all_together(rows: DataFrame, block: int) -> DataFrame:
    """The same with all rows in one bucket, and all codes: a pair counts where it shares one of them. Where bands are so many and codes so few that most pairs meet
    in some band, each is compared once, and a row has a copy for each block and not for each band and block."""
    blocks = max(1, min(MOST, -(-rows.count() // block)))
    dealt = rows.withColumns({"band": F.lit(-1), "h": F.lit(0).cast("long"), "blocks": F.lit(blocks), "part": F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")})
    return _met(dealt)


def _near(t: pa.Table, least: float, score: Callable[[np.ndarray, np.ndarray], np.ndarray]):
    """For tiles of each group's pairs of rows: the first row of the group and the one after its last, and i, j, s: places in the table and the score of the pairs with a shared code and a
    score of at least `least`, without those of one block (where two meet) and of an earlier band."""
    part, band, bi, bj = (t.column(k).to_numpy() for k in ("part", "band", "bi", "bj"))
    values, own = t.column("x").combine_chunks(), t.column("codes").combine_chunks()
    x = values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)
    codes, start = own.flatten().to_numpy(zero_copy_only=False), own.offsets.to_numpy() - own.offsets[0].as_py() if len(own) else np.zeros(1, int)
    at = edges(t, KEYS)
    for a, b in zip(at[:-1], at[1:]):
        if b - a < 2:
            continue
        before = codes[start[a] : start[b]].reshape(b - a, -1)  # as many as the group's band
        same = bi[a] == bj[a]
        left = np.arange(a, b) if same else a + np.flatnonzero(part[a:b] == bi[a])
        right = left if same else a + np.flatnonzero(part[a:b] == bj[a])
        for p in range(0, len(left), TILE):
            for q in range(p if same else 0, len(right), TILE):
                li, rj = left[p : p + TILE], right[q : q + TILE]
                s = score(x[li], x[rj])
                good = s >= least - 1e-6
                if same and p == q:
                    good &= np.tri(len(li), dtype=bool).T & ~np.eye(len(li), dtype=bool)
                i, j = np.nonzero(good)
                for low in range(0, len(i), FEW):
                    u, v = i[low : low + FEW], j[low : low + FEW]
                    found = np.round(s[u, v], 6)
                    u, v = li[u], rj[v]
                    keep = found >= least
                    if band[a] < 0:
                        keep &= (before[u - a] == before[v - a]).any(1)
                    for k in range(band[a]):
                        keep &= before[u - a, k] != before[v - a, k]
                    if keep.any():
                        yield a, b, u[keep], v[keep], found[keep]


def _dealt(met: DataFrame) -> DataFrame:
    return met.repartition(*KEYS).sortWithinPartitions(*KEYS)


def pairs(rows: DataFrame, least: float, score=correlation, block: int = 256, together: bool = False) -> DataFrame:
    """(a, b, score): every pair with a common code and a score of at least `least`, a < b, once."""

    def run(batches):
        for t in runs(batches, KEYS):
            ids = t.column("id").to_numpy()
            for _, _, i, j, s in _near(t, least, score):
                a, b, s = (v[ids[i] != ids[j]] for v in (ids[i], ids[j], s))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(s)], ["a", "b", "score"])

    return _dealt((all_together if together else grouped)(rows, block)).mapInArrow(run, "a long, b long, score double")


def sparing(rows: DataFrame) -> tuple[DataFrame, int]:
    """Rows (codes, ...) whose last code is shared by all rows that may be pairs and whose other codes, together, by all that are: with the last one alone where the others spare less than
    half of the comparisons, as each is a copy of a row; else with the others. And how many rows a block of theirs needs for some groups for each core, 256 at least."""
    sizes = rows.select(F.posexplode("codes").alias("band", "h"), (F.size("codes") - 1).alias("last")).groupBy("band", "h", "last").agg(F.count("*").cast("double").alias("m"))
    work = {r["whole"]: r["work"] for r in sizes.groupBy((F.col("band") == F.col("last")).alias("whole")).agg(F.sum(F.col("m") * F.col("m")).alias("work")).collect()}
    whole = work.get(True, 0.0) <= 2 * work.get(False, 0.0)
    codes = F.slice("codes", F.size("codes"), F.lit(1)) if whole else F.slice("codes", F.lit(1), F.size("codes") - 1)
    groups = EACH * rows.sparkSession.sparkContext.defaultParallelism
    return rows.withColumn("codes", codes), max(256, int((work.get(whole, 0.0) / 2 / groups) ** 0.5))


def _alike(rows: DataFrame, block: int) -> DataFrame:
    """rows with `same`, a number that rows with the same values share, and `id`, which deals them to blocks: by `same`, so that they meet in one, but for those that are too many for that."""
    numbered = rows.withColumn("same", F.xxhash64("x", "codes"))
    many = written(numbered.groupBy("same").count().filter(F.col("count") > max(1, block // 4)).select("same", F.lit(True).alias("many")))
    return numbered.join(F.broadcast(many), "same", "left").withColumn("id", F.when(F.col("many"), F.col("id")).otherwise(F.col("same"))).drop("many")


def _classes(t: pa.Table) -> np.ndarray:
    """The first row of each run of rows of a group and part that have the same codes and values, and the number of rows."""
    new = np.zeros(t.num_rows, bool)
    new[edges(t, [*KEYS, "part", "same"])[:-1]] = True
    for name in ("codes", "x"):
        own = t.column(name).combine_chunks()
        start, size, values = own.offsets.to_numpy()[:-1] - own.offsets[0].as_py(), own.value_lengths().to_numpy(), own.flatten().to_numpy(zero_copy_only=False)
        for k in range(size.max()):  # rows of a group have as many
            v = values[np.where(size > k, start + k, 0)]
            new[1:] |= (v[1:] != v[:-1]) & (size[1:] > k)
    return np.append(np.flatnonzero(new), t.num_rows)


def members(at: np.ndarray, u: np.ndarray, v: np.ndarray, s: np.ndarray, other: np.ndarray | None = None):
    """i, j, s of the rows of each pair of classes u, v, some at a time; a class's own rows each once. The classes begin at `at`, or v's at `other`, where these are other rows."""
    own, other = other is None, at if other is None else other
    n, m = at[u + 1] - at[u], other[v + 1] - other[v]
    until = np.cumsum(n * m)
    for low in range(0, int(until[-1]) if len(until) else 0, FEW):
        high = min(low + FEW, int(until[-1]))
        first, last = np.searchsorted(until, [low, high - 1], "right")
        p = np.repeat(np.arange(first, last + 1), np.diff(np.clip(np.concatenate([[low], until[first : last + 1]]), low, high)))
        place = np.arange(low, high) - (until[p] - n[p] * m[p])
        i, j = at[u[p]] + place // m[p], other[v[p]] + place % m[p]
        keep = (u[p] != v[p]) | (i < j) if own else np.ones(len(i), bool)
        yield (i, j, s[p]) if keep.all() else (i[keep], j[keep], s[p][keep])


def named_pairs(rows: DataFrame, key: str, least: float, score=correlation, told=None, band: tuple[str, float] | None = None, block: int = 256) -> DataFrame:
    """(a_key, a_w, b_key, b_w, score) of rows (id, codes, x, key, w): every such pair of different keys, the lower (key, w) before the other, once. A group's rows bring their names along,
    so pairs are neither shuffled nor joined. With told, what it says of the rows' x instead of the score; with a band (a column of rows, a width), only pairs at most the width apart in it."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        for t in runs(batches, KEYS):
            at = _classes(t)
            names, w = t.column(key).combine_chunks(), t.column("w").to_numpy()
            few = t if len(at) > t.num_rows else t.take(pa.array(at[:-1])).combine_chunks()
            values = few.column("x").combine_chunks()
            x = values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)
            distinct = names.dictionary_encode()
            n = names.to_numpy() if pa.types.is_integer(names.type) else None
            if n is None:  # numbered in the order of the names
                order = np.empty(len(distinct.dictionary), np.int64)
                order[pc.array_sort_indices(distinct.dictionary).to_numpy()] = np.arange(len(order))
                n = order[distinct.indices.to_numpy()]
            place = t.column(band[0]).to_numpy() if band else None
            for u, v, s in itertools.chain(_selves(few, np.diff(at), x, least, score), (found[2:] for found in _near(few, least, score))):
                if told is not None:
                    s = told(x[u], x[v])
                for i, j, s in members(at, u, v, s):
                    keep = n[i] != n[j]
                    if band:
                        keep &= np.abs(place[i] - place[j]) <= band[1]
                    turn = n[i] > n[j]
                    on, back = np.flatnonzero(keep & ~turn), np.flatnonzero(keep & turn)
                    i, j, s = np.concatenate([i[on], j[back]]), np.concatenate([j[on], i[back]]), np.concatenate([s[on], s[back]])
                    if len(i):
                        yield pa.RecordBatch.from_arrays([names.take(pa.array(i)), pa.array(w[i]), names.take(pa.array(j)), pa.array(w[j]), pa.array(s)], [f"a_{key}", "a_w", f"b_{key}", "b_w", "score"])

    dealt = grouped(_alike(rows, block), block).repartition(tasks(rows.sparkSession), *KEYS).sortWithinPartitions(*KEYS, "part", "same", key)
    return dealt.mapInArrow(run, f"a_{key} {kind}, a_w long, b_{key} {kind}, b_w long, score double")


def _selves(t: pa.Table, size: np.ndarray, x: np.ndarray, least: float, score):
    """u, v, s as of _near() of the classes of more than one row with themselves: in the first band, and in the group where their block meets itself."""
    u = np.flatnonzero((size > 1) & (t.column("band").to_numpy() == 0) & (t.column("bi").to_numpy() == t.column("bj").to_numpy()))
    for low in range(0, len(u), TILE):
        own = u[low : low + TILE]
        s = np.round(np.array([score(x[k : k + 1], x[k : k + 1])[0, 0] for k in own]), 6)
        yield own[s >= least], own[s >= least], s[s >= least]


def links(rows: DataFrame, least: float, score=correlation, block: int = 256, together: bool = False) -> DataFrame:
    """(id, n_links, best, best_score) of every row that has a pair: how many, and the one with the highest score (of equals the smallest id).
    Groups send one row for each of theirs, never the pairs."""

    def run(batches):
        for t in runs(batches, KEYS):
            ids = t.column("id").to_numpy()
            n, top, best = np.zeros(len(ids), np.int64), np.full(len(ids), -np.inf), np.full(len(ids), np.iinfo(np.int64).max)
            for a, b, i, j, s in _near(t, least, score):
                n[a:b] += np.bincount(np.concatenate([i, j]) - a, minlength=b - a)
                for u, v in ((i, j), (j, i)):
                    new = top[a:b].copy()
                    np.maximum.at(new, u - a, s)
                    best[a:b][new > top[a:b]] = np.iinfo(np.int64).max
                    top[a:b] = new
                    first = s == top[u]
                    np.minimum.at(best, u[first], ids[v[first]])
            some = n > 0
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array(v[some]) for v in (ids, n, best, top)], ["id", "n", "best", "top"])

    found = _dealt((all_together if together else grouped)(rows, block)).mapInArrow(run, "id long, n long, best long, top double")
    return found.groupBy("id").agg(
        F.sum("n").alias("n_links"), F.min(F.struct((-F.col("top")).alias("t"), "best")).alias("m")
    ).select("id", "n_links", F.col("m.best").alias("best"), (-F.col("m.t")).alias("best_score"))
