"""N-gram Jaccard join by MinHash banding.

1. Documents with the same sequence of words form one class, which gets a number of its own; so ids may be null or shared.
2. Each representative gets bands of MinHash values over its shingles of five words; the numbers of bands and rows follow from the
   target recall at the threshold.
3. Representatives that share a band's hash form a bucket. A bucket with the same members as another is kept once; a bucket of more
   than `block` members or `most_words` words is cut into blocks, and every pair of its blocks becomes a group, so that no task ever
   holds a whole bucket.
4. Each group verifies its pairs on the full sets of shingles and returns counts of links and one edge for each member to the
   smallest member it is joined to - never the pairs. A pair that shares several bands is counted in the first of them only.
5. The edges give connected components; a document's class is the smallest id of its component.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import components
from ._spark import cut, perhaps_in, runs
from ._text import BASE, mixed, shingle_rows

M = (1 << 64) - 1


def banding(threshold: float, recall: float, most_rows: int = 5) -> tuple[int, int]:
    """(bands, rows): so many rows as given, and the fewest bands that find a pair at the threshold with the target recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**most_rows)), most_rows


def _multipliers(n: int) -> np.ndarray:
    x, out = BASE, []
    for _ in range(n):
        x = (x * 6364136223846793005 + 1442695040888963407) & M
        out.append((x ^ (x >> 29)) | 1)
    return np.array(out, np.uint64)


def signatures(batches, bands: int, rows: int, width: int):
    """doc_id, th, text -> doc_id, th, n_words, two hashes of the word sequence, band hashes (empty where there are no words)."""
    many = _multipliers(bands * rows)
    for batch in batches:
        out: list[list] = [[], [], [], [], [], []]
        for i, j, n_words, wh, first, sh, at in shingle_rows(batch.column(2), width):
            n = j - i
            place = np.arange(len(wh), dtype=np.uint64) - np.repeat(first[:-1], n_words).astype(np.uint64)
            sums = [np.concatenate([[np.uint64(0)], np.cumsum(mixed(wh + mixed(place + np.uint64(k))))]) for k in (1, 1 << 40)]
            k1, k2 = (s[first[1:]] - s[first[:-1]] for s in sums)
            full = np.flatnonzero(np.diff(at))
            hashed = np.zeros((n, bands), np.uint64)
            if len(full):
                for b in range(bands):
                    h = np.full(len(full), b, np.uint64)
                    for r in range(rows):
                        h = mixed(h * np.uint64(BASE) + np.minimum.reduceat(sh * many[b * rows + r], at[full]))
                    hashed[full, b] = h
            out[0].append(batch.column(0).slice(i, n))
            out[1].append(batch.column(1).slice(i, n))
            for k, x in ((2, n_words.astype(np.int64)), (3, k1.view(np.int64)), (4, k2.view(np.int64))):
                out[k].append(pa.array(x))
            counts = np.where(np.diff(at) > 0, bands, 0)
            out[5].append(pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), pa.array(hashed[full].ravel().view(np.int64))))
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in out], ["doc_id", "th", "n_words", "k1", "k2", "bands"])


def shared(sets: list[np.ndarray]) -> np.ndarray:
    """The number of common elements of every two sets (sorted, without repeats)."""
    m = len(sets)
    if m == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]], np.float64)
    values = np.concatenate(sets)
    who = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(values)
    values, who = values[order], who[order]
    new = np.concatenate([[True], values[1:] != values[:-1]])
    ids = np.cumsum(new) - 1
    often = np.bincount(ids) > 1
    keep = often[ids]
    ids, who = (np.cumsum(often) - 1)[ids[keep]], who[keep]
    out = np.zeros((m, m), np.float64)
    for low in range(0, int(often.sum()), 4096):
        part = slice(*np.searchsorted(ids, [low, low + 4096]))
        x = np.zeros((m, 4096), np.float32)
        x[who[part], ids[part] - low] = 1
        out += x @ x.T
    out[np.arange(m), np.arange(m)] = [len(s) for s in sets]
    return out


def local_roots(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each node the smallest id that it reaches through the boolean matrix `linked`."""
    root = ids.copy()
    while True:
        best = np.minimum(root, np.where(linked, root[None, :], np.iinfo(np.int64).max).min(1)) if len(ids) else root
        if (best == root).all():
            return root
        root = best


def verify(batches, threshold: float, width: int):
    """Groups (gid, bi, bj, band, rep, part, copies, bands, text), sorted by group -> rep, links, root for members with a link."""
    for t in runs(batches, ["gid", "bi", "bj"]):
        sets: list[np.ndarray] = []
        for i, j, _, _, _, sh, at in shingle_rows(t.column("text").combine_chunks(), width):
            for a, b in zip(at[:-1], at[1:]):
                s = np.sort(sh[a:b])
                sets.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s)
        gid, bi, bj, band, rep, part, copies = (t.column(k).to_numpy() for k in ("gid", "bi", "bj", "band", "rep", "part", "copies"))
        flat = t.column("bands").combine_chunks()
        bands = flat.flatten().to_numpy().reshape(len(flat), -1) if len(flat) else np.zeros((0, 0))
        edge = np.flatnonzero(np.concatenate([[True], (gid[1:] != gid[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])]))
        reps, links, roots = [], [], []
        for a, b in zip(edge, [*edge[1:], len(gid)]):
            if b - a < 2:
                continue
            common = shared(sets[a:b])
            size = np.diag(common)
            near = common >= threshold * (size[:, None] + size[None, :] - common) - 1e-9
            np.fill_diagonal(near, False)
            if bi[a] != bj[a]:  # two blocks: only pairs across them
                near &= part[a:b, None] != part[None, a:b]
            own = near.copy()
            for k in range(band[a]):  # an earlier common band has counted the pair
                own &= bands[a:b, k][:, None] != bands[None, a:b, k]
            n = (own * copies[None, a:b]).sum(1)
            root = local_roots(near, rep[a:b])
            some = near.any(1)
            reps.append(rep[a:b][some]), links.append(n[some]), roots.append(root[some])
        if reps:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (reps, links, roots)], ["rep", "links", "root"])


def jaccard_join(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, width: int = 5,
    recall: float = 0.9995, small: int = 128, block: int = 256, most_words: int = 1 << 19,
) -> DataFrame:
    """One row per row of df: doc_id, class_id, n_links, n_copies, kept, text_hash.

    Two documents are linked when the Jaccard similarity of their sets of `width`-word shingles is at least `threshold`. Words are runs
    of bytes that are not white space, A-Z as a-z. A text of fewer words has one shingle, all its words; a text without words (or
    null) is linked with nothing. n_links counts all other documents linked directly, equal texts included; class_id is the smallest id
    reachable by links. Every row is a document of its own, whatever its id: rows that share an id are told apart by their texts, and rows
    without an id are linked like any other (class_id is null where no row of the class has an id). kept: the row has the class's smallest
    id (null is larger than all) and, of the rows with that id, the text with the smallest text_hash (xxhash64); so of rows that repeat
    each other all are kept or none. Other columns are not read.
    """
    n_bands, n_rows = banding(threshold, recall)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    signed = cut(docs.select("doc_id", "th", "text").mapInArrow(
        lambda it: signatures(it, n_bands, n_rows, width), "doc_id long, th long, n_words long, k1 long, k2 long, bands array<long>"
    ))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "th")).alias("first")
    same = cut(signed.filter("n_words > 0").groupBy("n_words", "k1", "k2", "bands").agg(first, F.count("*").alias("copies")).withColumn("rep", F.monotonically_increasing_id()))  # written once: the numbers stay

    spread = same.select("rep", "n_words", F.posexplode("bands").alias("band", "h"))
    full = cut(spread.groupBy("band", "h").agg(F.count("*").alias("m"), F.sum("n_words").alias("words")).filter("m > 1"))  # a table of its own, so that Spark can split the join's hot keys
    members = cut(spread.drop("n_words").join(full, ["band", "h"]))
    few = (F.col("m") <= small) & (F.col("words") <= most_words)
    lists = members.filter(few).groupBy("band", "h").agg(F.sort_array(F.collect_list("rep")).alias("reps"))
    lists = lists.groupBy("reps").agg(F.min("band").alias("band"))
    one = F.lit(0)
    listed = lists.select(F.xxhash64("reps").alias("gid"), "band", F.explode("reps").alias("rep")).select("gid", one.alias("bi"), one.alias("bj"), "band", "rep", one.alias("part"))
    blocks = F.ceil(F.greatest(F.col("m") / block, F.col("words") / most_words)).cast("int")
    large = (
        members.filter(~few)
        .select(F.xxhash64("band", "h").alias("gid"), "band", "rep", blocks.alias("blocks"), F.pmod(F.xxhash64("rep", "band"), blocks).cast("int").alias("part"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("gid", F.least("part", "other").alias("bi"), F.greatest("part", "other").alias("bj"), "band", "rep", "part")
    )
    groups = cut(listed.unionByName(large))
    reps = cut(same.join(groups.select("rep").distinct(), "rep", "left_semi").select("rep", "first.doc_id", "first.th"))
    marked, perhaps = perhaps_in(docs, reps, ["doc_id", "th"])
    d, r = marked.filter(perhaps).alias("d"), reps.hint("merge").alias("r")
    texts = d.join(r, F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("d.th") == F.col("r.th"))).select("rep", "text").dropDuplicates(["rep"])
    verified = cut(
        groups.join(same.select("rep", "copies", "bands"), "rep").join(texts, "rep")
        .select("gid", "bi", "bj", "band", "rep", "part", "copies", "bands", "text")
        .repartition("gid", "bi", "bj").sortWithinPartitions("gid", "bi", "bj")
        .mapInArrow(lambda it: verify(it, threshold, width), "rep long, links long, root long")
    )
    joined = components(verified, "rep", "root").withColumnRenamed("node", "rep")
    roots = cut(same.select("rep", "first").join(joined, "rep"))
    roots = roots.select("rep", "component").join(roots.groupBy("component").agg(F.min("first").alias("root")), "component").select("rep", "root")
    classes = (
        same.join(verified.groupBy("rep").agg(F.sum("links").alias("links")), "rep", "left").join(roots, "rep", "left")
        .select("n_words", "k1", "k2", F.coalesce("root", "first").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "copies")
    )
    kept = F.col("doc_id").eqNullSafe(F.col("root.doc_id")) & (F.col("th") == F.col("root.th"))
    some = signed.filter("n_words > 0").join(classes, ["n_words", "k1", "k2"]).select(
        "doc_id", F.col("root.doc_id").alias("class_id"), "n_links", F.col("copies").alias("n_copies"), kept.alias("kept"),
        F.col("th").alias("text_hash")
    )
    zero, one_copy = F.lit(0).cast("long"), F.lit(1).cast("long")
    alone = signed.filter("n_words = 0").select(
        "doc_id", F.col("doc_id").alias("class_id"), zero.alias("n_links"), one_copy.alias("n_copies"), F.lit(True).alias("kept"),
        F.col("th").alias("text_hash")
    )
    return some.unionByName(alone)
