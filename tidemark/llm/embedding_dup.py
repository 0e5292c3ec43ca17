"""Embedding near-dedup with a pivot-permutation index.

Every vector is described by its nearest reference points (pivots) in order. Vectors are put on inverted lists of their pivots; two
vectors that are close share most of them. With k pivots a vector and at least t shared, the smallest common pivot is among the first
k - t + 1 of either vector in the order of pivot numbers, so only those lists are written. Each list counts the shared pivots of its
members, keeps pairs with t or more whose smallest common pivot is the list's own (so no pair meets twice), and verifies their cosine
in double precision. A list of more than `block` members is cut into blocks and works on pairs of blocks in separate groups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import components
from ._spark import cut, runs
from .near_dup import local_roots


def pivot_count(n: int) -> int:
    """About the square root of the number of vectors, 256 at least: lists then grow with the root too."""
    return max(256, 1 << max(1, int(n) - 1).bit_length() // 2)


def choose_pivots(reps: DataFrame, count: int) -> np.ndarray:
    """Up to `count` unit vectors out of a sample of at most 4 * count (by hash of the vector), none closer than cosine 0.9 to an earlier one."""
    rows = reps.select("emb", "label").orderBy(F.xxhash64("emb"), "emb", "label").limit(4 * count).select("emb").collect()
    dim = max((len(r[0]) for r in rows), default=1)
    kept, n = np.zeros((count, dim)), 0
    for r in rows:
        v = np.zeros(dim)
        v[: len(r[0])] = r[0]
        v /= np.linalg.norm(v)
        if n < count and (kept[:n] @ v < 0.9).all():
            kept[n] = v
            n += 1
    return kept[:n]


def permutations(batches, pivots: np.ndarray, nearest: int):
    """rep, label, copies, emb -> the same and perm: the numbers of the nearest pivots, nearest first."""
    for batch in batches:
        embs = batch.column("emb").to_pylist()
        perm = []
        step = max(1, (1 << 21) // len(pivots))
        for at in range(0, len(embs), step):
            part = embs[at : at + step]
            x = np.zeros((len(part), pivots.shape[1]))
            for i, v in enumerate(part):
                n = min(len(v), pivots.shape[1])
                x[i, :n] = v[:n]
            cos = x @ pivots.T
            best = np.sort(np.argpartition(-cos, nearest - 1, axis=1)[:, :nearest], axis=1)
            perm += np.take_along_axis(best, np.argsort(-np.take_along_axis(cos, best, 1), axis=1, kind="stable"), 1).tolist()
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(k) for k in ("rep", "label", "copies", "emb")), pa.array(perm, pa.list_(pa.int32()))],
            ["rep", "label", "copies", "emb", "perm"]
        )


def verify(batches, threshold: float, enough: int):
    """Groups (gid, bi, bj, pivot, rep, part, copies, emb, perm), sorted by group -> rep, links, root."""
    for t in runs(batches, ["gid", "bi", "bj"], most_rows=8192):
        gid, bi, bj, pivot, rep, part, copies = (t.column(k).to_numpy() for k in ("gid", "bi", "bj", "pivot", "rep", "part", "copies"))
        embs, perms = t.column("emb").combine_chunks(), t.column("perm").combine_chunks()
        start, flat = embs.offsets.to_numpy(), embs.values.to_numpy(zero_copy_only=False).astype(np.float64)
        pstart, pflat = perms.offsets.to_numpy(), perms.values.to_numpy()
        edge = np.flatnonzero(np.concatenate([[True], (gid[1:] != gid[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])]))
        reps, links, roots = [], [], []
        for a, b in zip(edge, [*edge[1:], len(gid)]):
            m = b - a
            if m < 2:
                continue
            own, which = np.unique(pflat[pstart[a] : pstart[b]], return_inverse=True)  # the group's pivots
            on = np.zeros((m, len(own)), np.float32)
            on[np.repeat(np.arange(m), np.diff(pstart[a : b + 1])), which] = 1
            low = on[:, : np.searchsorted(own, pivot[a])]
            near = (on @ on.T >= enough) & (low @ low.T == 0)
            np.fill_diagonal(near, False)
            if bi[a] != bj[a]:
                near &= part[a:b, None] != part[None, a:b]
            i, j = np.nonzero(np.triu(near))
            if not len(i):
                continue
            x = flat[start[a] : start[b]].reshape(m, -1)
            length = np.sqrt((x * x).sum(1))
            linked = np.zeros((m, m), bool)
            if len(i) * 4 > m * m:
                linked[i, j] = ((x @ x.T) / (length[:, None] * length[None, :]))[i, j] >= threshold
            else:
                linked[i, j] = np.einsum("ij,ij->i", x[i], x[j]) / (length[i] * length[j]) >= threshold
            linked |= linked.T
            some = linked.any(1)
            if some.any():
                reps.append(rep[a:b][some]), links.append((linked * copies[None, a:b]).sum(1)[some]), roots.append(local_roots(linked, rep[a:b])[some])
        if reps:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (reps, links, roots)], ["rep", "links", "root"])


def embedding_dedup(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    threshold: float = 0.98, nearest: int = 8, enough: int = 3, block: int = 256,
) -> DataFrame:
    """One row per row of df: vec_id, n_links, component_id, kept.

    Vectors are compared when their labels are equal and not null and their lengths are equal. A vector that is null, empty, zero or
    holds null or non-finite components links with nothing and is its own component. Equal vectors are one class, whose members are all
    linked (repeated rows included). Every row is a vector of its own: of rows that share an id each has its own links and component, and
    kept tells whether that component's smallest id is its own. Rows with a null id link with nothing; their component is null and they
    are not kept. Other columns are not read. The index finds nearly every pair at or above the threshold (see the tests for the measured recall) and no other.
    """
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("emb"), F.col(label_col).alias("label"))
    finite = F.forall("emb", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("emb", lambda x: x != 0), F.lit(False))
    marked = rows.withColumn("usable", usable)
    good, bad = marked.filter("usable"), marked.filter("NOT usable")
    same = cut(good.groupBy("label", "emb").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies")).withColumn("rep", F.monotonically_increasing_id()))  # written once: the numbers stay
    pivots = choose_pivots(same, pivot_count(same.count()))
    first = [(bad.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))]
    if len(pivots):
        k = min(nearest, len(pivots))
        t = min(enough, k)
        box = df.sparkSession.sparkContext.broadcast(pivots)
        label = same.schema["label"].dataType.simpleString()
        kind = same.schema["emb"].dataType.simpleString()
        lists = (
            same.select("rep", "label", "copies", "emb").mapInArrow(
                lambda it: permutations(it, box.value, k), f"rep long, label {label}, copies long, emb {kind}, perm array<int>"
            )
            .withColumn("dim", F.size("emb")).withColumn("pivot", F.explode(F.slice(F.sort_array("perm"), 1, k - t + 1)))
        )
        lists = cut(lists)
        blocks = F.ceil(F.col("m") / block).cast("int")
        sizes = cut(lists.groupBy("label", "dim", "pivot").agg(F.count("*").alias("m")).filter("m > 1"))  # a table of its own, so that Spark can split the join's hot keys
        verified = cut(
            lists.join(sizes, ["label", "dim", "pivot"])
            .select(
                F.xxhash64("label", "dim", "pivot").alias("gid"), "pivot", "rep", "copies", "emb", "perm", blocks.alias("blocks"),
                F.pmod(F.xxhash64("rep", "pivot"), blocks).cast("int").alias("part")
            )
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("gid", F.least("part", "other").alias("bi"), F.greatest("part", "other").alias("bj"), "pivot", "rep", "part", "copies", "emb", "perm")
            .repartition("gid", "bi", "bj").sortWithinPartitions("gid", "bi", "bj")
            .mapInArrow(lambda it: verify(it, threshold, t), "rep long, links long, root long")
        )
        joined = components(verified, "rep", "root").withColumnRenamed("node", "rep")
        roots = cut(same.select("rep", "first").join(joined, "rep"))
        roots = roots.select("rep", "component").join(roots.groupBy("component").agg(F.min("first").alias("root")), "component").select("rep", "root")
        classes = (
            same.join(verified.groupBy("rep").agg(F.sum("links").alias("links")), "rep", "left").join(roots, "rep", "left")
            .select("label", "emb", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "first").alias("component_id"))
        )
        first.append(good.join(classes, ["label", "emb"]).select("vec_id", "n_links", "component_id"))
    out = first[0] if len(first) == 1 else first[0].unionByName(first[1])
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
