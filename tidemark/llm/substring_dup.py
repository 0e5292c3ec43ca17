"""Suffix-array dedup: bytes covered by a string of `length` bytes that also starts elsewhere are removed.

1. Anchors. A window of `length` bytes is represented by its anchor, the `gram` bytes inside it with the least hash (the leftmost of
   equals). Equal windows have equal anchors at equal places. Consecutive windows whose anchors have equal bytes make a run (one for each
   place of the anchor, or one for a whole stretch of periodic text); the slice of a run is all bytes of its windows. Each window is in
   one run. A run whose anchor has one place, and occurs nowhere else, has no repeated window and is done; runs with equal slices (by
   the anchor's hash and a BLAKE2 digest of the slice) are repeated throughout and are looked into once.
2. Shards. The distinct slices of an anchor meet in one shard, or in several where they are more than `shard` or large. A task
   concatenates the slices of its shards, builds the suffix array with Larsson and Sadakane's refinement (only groups that are not yet
   sorted are sorted again, by the rank twice as far on), and gets common prefixes by Kasai's recurrence in its permuted form: the common
   prefix at a place is one less than at the place before, unless the bytes before the two suffixes differ. Neighbours with `length`
   common bytes mark repeated windows.
3. Merging. The shards of a divided anchor send their sorted window digests, cut by binary search at fixed points, to merge tasks,
   where every shard's windows are searched for among those of the others.
4. The repeated windows of a document are united, and the rest of its bytes digested.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import cut, runs
from ._text import pieces, prefix_hash, raw, rolled, rolling, span_hash, trim

SEGMENT = 1 << 18  # bytes of text in one go; a task that sorts suffixes needs some 100 bytes for each byte it sorts


def sliding_least(v: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive values."""
    n = len(v)
    if n < w:
        return v[:0]
    p = np.full(-(-n // w) * w, np.iinfo(v.dtype).max, v.dtype)
    p[:n] = v
    blocks = p.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def window_runs(buf: np.ndarray, first: np.ndarray, last: np.ndarray, length: int, gram: int):
    """Runs of the windows that start from first[k] to last[k] - 1: start, number of windows, anchor, digest of the slice, whether the anchor has several places."""
    if len(buf) < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.int64, bool))
    at = np.arange(len(buf) - gram + 1)
    g = rolled(rolling(buf), at, at + gram)
    least = sliding_least((g & ~np.uint64(0xFFFFFF)) | at.astype(np.uint64), length - gram + 1)
    anchor = (least & np.uint64(0xFFFFFF)).astype(np.int64)
    moved = np.zeros(len(anchor), bool)
    moved[1:] = anchor[1:] != anchor[:-1]
    h = g[anchor]
    new = np.zeros(len(anchor) + 1, bool)
    new[1:-1] = h[1:] != h[:-1]
    good = np.zeros(len(anchor) + 1, np.int8)
    keep = first < last
    np.add.at(good, first[keep], 1)
    np.add.at(good, last[keep], -1)
    good = np.cumsum(good) > 0
    new[first[keep]] = True
    new[last[keep]] = True
    edges = np.flatnonzero(new)
    start = edges[good[edges]]
    end = np.append(edges, len(anchor))[np.searchsorted(edges, start, side="right")]
    moves = np.cumsum(moved)
    data = memoryview(np.ascontiguousarray(buf))
    digests = b"".join([hashlib.blake2b(data[a:b], digest_size=8).digest() for a, b in zip(start.tolist(), (end + length - 1).tolist())])
    return start, end - start, h[start], np.frombuffer(digests, np.int64), moves[end - 1] > moves[start]


def all_runs(batches, length: int, gram: int):
    """doc_id, th, text -> doc_id, th, h, fp, s0, n, several: one row for each run."""
    for batch in batches:
        data, offsets = raw(batch.column(2))
        ids, th = batch.column(0), batch.column(1)
        for i, j in pieces(offsets, SEGMENT):
            base, size = offsets[i], offsets[j] - offsets[i]
            for low in range(0, max(1, size if j - i == 1 else 1), SEGMENT):
                part = data[base + low : base + size if j - i > 1 else min(base + size, base + low + SEGMENT + length - 1)]
                starts = offsets[i:j] - base - low
                ends = offsets[i + 1 : j + 1] - base - low
                s, n, h, fp, several = window_runs(
                    part, np.maximum(starts, 0), np.minimum(np.minimum(ends, len(part)) - length + 1, SEGMENT if j - i == 1 else size), length, gram
                )
                if not len(s):
                    continue
                row = np.searchsorted(starts, s, side="right") - 1
                take = pa.array(row + i)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(take), th.take(take),
                        *(pa.array(x) for x in (h.view(np.int64), fp, s - starts[row] if j - i > 1 else s + low, n.astype(np.int32), several))
                    ], ["doc_id", "th", "h", "fp", "s0", "n", "several"]
                )


def slices(batches, length: int):
    """text, wanted (a list of h, fp, c, parts, s0, n) -> h, part, parts, fp, n, slice."""
    for batch in batches:
        data, offsets = raw(batch.column(0))
        wanted = batch.column(1)
        f = wanted.flatten()
        cols = {k: f.field(k).to_numpy(zero_copy_only=False) for k in ("h", "fp", "parts", "s0", "n")}
        at = np.repeat(offsets[:-1], np.diff(wanted.offsets.to_numpy())) + cols["s0"]
        upto = np.concatenate([[0], np.cumsum(cols["n"].astype(np.int64) + length - 1)])
        for low, high in pieces(upto):
            p = slice(low, high)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(cols["h"][p]), pa.array((cols["fp"][p].view(np.uint64) % cols["parts"][p].astype(np.uint64)).astype(np.int32)), pa.array(cols["parts"][p].astype(np.int32)), pa.array(cols["fp"][p]), pa.array(cols["n"][p].astype(np.int32)),
                    pa.array([data[a : a + n + length - 1].tobytes() for a, n in zip(at[p], cols["n"][p])], pa.binary()),
                ],
                ["h", "part", "parts", "fp", "n", "slice"],
            )


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Larsson-Sadakane refinement: the sorted suffixes, and the first seven bytes of each place (and of the end) as one integer."""
    n, step = len(text), 7
    wide = np.zeros(n + step + 1, np.uint64)
    wide[:n] = text
    wide[:n] += np.uint64(1)
    key = np.zeros(n + 1, np.uint64)
    for j in range(step):
        key = (key << np.uint64(9)) | wide[j : j + n + 1]
    sa = np.argsort(key[:n])
    rank = np.zeros(n + 1, np.int64)  # the place of the first suffix of its group, plus one; zero past the end
    new = np.concatenate([[True], key[sa[1:]] != key[sa[:-1]]]) if n else np.zeros(0, bool)
    place = np.arange(n)
    rank[sa] = np.maximum.accumulate(np.where(new, place, 0)) + 1
    open_ = np.flatnonzero(~(new & np.append(new[1:], True)))
    while len(open_):
        a = sa[open_]
        both = (rank[a].astype(np.uint64) << np.uint64(32)) | rank[np.minimum(a + step, n)].astype(np.uint64)
        order = np.argsort(both)
        a, both = a[order], both[order]
        sa[open_] = a
        new = np.concatenate([[True], both[1:] != both[:-1]])
        rank[a] = np.maximum.accumulate(np.where(new, open_, 0)) + 1
        open_ = open_[~(new & np.append(new[1:], True))]
        step *= 2
    return sa, key


def common_prefixes(text: np.ndarray, sa: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Of each place in the text, the bytes it has in common with the suffix sorted before it (Kasai's recurrence, permuted)."""
    n = len(sa)
    before = np.full(n, -1)
    before[sa[1:]] = sa[:-1]
    i = np.arange(n)
    fresh = (i == 0) | (before <= 0) | (text[i - 1] != text[np.maximum(before - 1, 0)])
    at = np.flatnonzero(fresh & (before >= 0))
    a, b, common = at.copy(), before[at], np.zeros(n, np.int64)
    live = np.arange(len(at))
    while len(live):
        same = key[a[live]] == key[b[live]]
        live = live[same]
        a[live] += 7
        b[live] += 7
    padded = np.append(text, 0)
    live = np.arange(len(at))
    for _ in range(7):
        live = live[(a[live] < n) & (b[live] < n)]
        live = live[padded[a[live]] == padded[b[live]]]
        a[live] += 1
        b[live] += 1
    common[at] = a - at
    last = np.maximum.accumulate(np.where(fresh, i, 0))
    return np.maximum(common[last] - (i - last), 0)


def shard_repeats(batches, length: int):
    """Slices (h, part, parts, fp, n, slice), sorted by shard -> rows of two kinds: repeated windows of a slice (fp, from, to), and, of divided anchors, digests for merging."""
    for t in runs(batches, ["h", "part"], most_bytes=1 << 19):
        h, part, parts, fp, n = (t.column(k).to_numpy() for k in ("h", "part", "parts", "fp", "n"))
        once = np.ones(len(h), bool)  # a repeated row's slice counts once
        order = np.lexsort((fp, part, h))
        again = (h[order[1:]] == h[order[:-1]]) & (part[order[1:]] == part[order[:-1]]) & (fp[order[1:]] == fp[order[:-1]])
        once[order[1:][again]] = False
        text, offsets = raw(t.column("slice"))
        valid = np.zeros(len(text) + 1, np.int32)
        np.add.at(valid, offsets[:-1][once], 1)
        np.add.at(valid, (offsets[:-1] + n)[once], -1)
        valid = np.cumsum(valid[:-1]) > 0
        sa, key = suffix_array(text)
        common = common_prefixes(text, sa, key)
        group = np.cumsum(common[sa] < length) - (0 if len(sa) and common[sa[0]] < length else -1)
        counts = np.bincount(group, weights=valid[sa])
        repeated = np.zeros(len(text), bool)
        repeated[sa] = valid[sa] & (counts[group] > 1)

        edge = np.diff(np.concatenate([[False], repeated, [False]]).astype(np.int8))
        cutting = np.zeros(len(text) + 1, bool)
        cutting[offsets] = True
        start = np.flatnonzero((edge == 1) | (cutting & np.append(repeated, False)))
        stop = np.flatnonzero((edge == -1) | (cutting & np.concatenate([[False], repeated])))
        row = np.searchsorted(offsets, start, side="right") - 1
        empty = pa.array([None] * len(start), pa.binary())
        out = [[
            pa.array(h[row]), pa.array(fp[row]), pa.array((start - offsets[row]).astype(np.int32)), pa.array((stop - offsets[row]).astype(np.int32)),
            pa.array(np.full(len(start), -1, np.int32)), empty
        ]]
        divided = np.flatnonzero((parts > 1) & once)
        if len(divided):
            hashed = prefix_hash(text)
            edges = np.flatnonzero(np.concatenate([[True], (h[divided][1:] != h[divided][:-1]) | (part[divided][1:] != part[divided][:-1])]))
            for a, b in zip(edges, [*edges[1:], len(divided)]):
                own = divided[a:b]
                at = np.concatenate([np.arange(offsets[r], offsets[r] + n[r]) for r in own])
                digest = span_hash(hashed, at, at + length)
                where = np.stack(
                    [
                        digest, np.repeat(fp[own], n[own]).view(np.uint64),
                        (at - np.repeat(offsets[own], n[own])).astype(np.uint64) | (repeated[at].astype(np.uint64) << np.uint64(32))
                    ],
                    1
                )
                where = where[np.argsort(digest)]
                k = int(parts[own[0]])
                cuts = np.searchsorted(where[:, 0], np.array([(r << 64) // k for r in range(1, k)], np.uint64))
                bounds = np.concatenate([[0], cuts, [len(where)]])
                some = np.flatnonzero(np.diff(bounds))  # ranges without a window have no row: there are never more rows than windows
                blobs, m = [where[bounds[r] : bounds[r + 1]].tobytes() for r in some], len(some)
                out.append([
                    pa.array([h[own[0]]] * m, pa.int64()), pa.array([0] * m, pa.int64()), pa.array([0] * m, pa.int32()),
                    pa.array([0] * m, pa.int32()), pa.array(some.astype(np.int32)), pa.array(blobs, pa.binary())
                ])
        for x in out:
            if len(x[0]):
                yield pa.RecordBatch.from_arrays(x, ["h", "fp", "a", "b", "range", "windows"])
        del sa, key, common, group, counts, repeated, valid
        trim()


def merge_repeats(batches):
    """Digest lists (h, range, windows) of the shards of divided anchors, sorted by h and range -> h, fp, a, b of windows that several shards have."""
    for t in runs(batches, ["h", "range"], most_rows=64):
        h, r = (t.column(k).to_numpy() for k in ("h", "range"))
        blobs = t.column("windows").to_pylist()
        edges = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])]))
        for a, b in zip(edges, [*edges[1:], len(h)]):
            lists = [np.frombuffer(x, np.uint64).reshape(-1, 3) for x in blobs[a:b]]
            distinct = [x[:, 0][np.concatenate([[True], x[1:, 0] != x[:-1, 0]])] if len(x) else x[:, 0] for x in lists]
            every = np.sort(np.concatenate(distinct))
            for x in lists:
                found = np.searchsorted(every, x[:, 0], side="right") - np.searchsorted(every, x[:, 0]) > 1
                x = x[found & (x[:, 2] >> np.uint64(32) == 0)]
                if not len(x):
                    continue
                x = x[np.lexsort((x[:, 2], x[:, 1]))]
                new = np.concatenate([[True], (x[1:, 1] != x[:-1, 1]) | (x[1:, 2] != x[:-1, 2] + np.uint64(1))])
                first, last = x[new], x[np.append(new[1:], True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(first), h[a])), pa.array(first[:, 1].view(np.int64)), pa.array(first[:, 2].astype(np.int32)),
                        pa.array((last[:, 2] + np.uint64(1)).astype(np.int32))
                    ],
                    ["h", "fp", "a", "b"]
                )


def removals(batches, length: int):
    """doc_id, text, spans (a list of from, to; may be null) -> the digest columns and the spans that are removed."""
    for batch in batches:
        ids = batch.column(0)
        out = []
        for text, spans in zip(batch.column(1), batch.column(2)):
            data = memoryview(text.as_buffer() or b"")
            removed = []
            if spans.is_valid:
                x = spans.values
                a, b = x.field("from").to_numpy(), x.field("to").to_numpy()
                order = np.argsort(a, kind="stable")
                a, b = a[order], np.maximum.accumulate(b[order])
                new = np.concatenate([[True], a[1:] > b[:-1]])
                removed = list(zip(a[new].tolist(), b[np.append(new[1:], True)].tolist()))
            digest, at = hashlib.sha256(), 0
            for a, b in removed:
                digest.update(data[at:a])
                at = b
            digest.update(data[at:])
            out.append((len(data), sum(b - a for a, b in removed), len(removed), digest.hexdigest(), [{"from": a, "to": b} for a, b in removed]))
        cols = list(zip(*out)) or [()] * 5
        yield pa.RecordBatch.from_arrays(
            [
                ids, *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string()),
                pa.array(cols[4], pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())])))
            ],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"],
        )


def substring_dedup(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, gram: int = 64, shard: int = 256, shard_bytes: int = 1 << 18
) -> DataFrame:
    """One row per row of df: doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed (the spans, in bytes).

    Texts are UTF-8 bytes, null is empty; matches never cross documents. A byte is removed when a string of `length` bytes that covers it
    also starts at another place in any document, overlapping or not; strings are judged on the input. Texts shorter than
    `length` lose nothing. Rows with a null id are documents like any other; of repeated rows each is one, so all of it (from `length`
    bytes on) is removed. An empty table gives no rows. Other columns are not read.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    runs_ = cut(docs.select("doc_id", "th", "text").filter(F.octet_length("text") >= length).mapInArrow(
        lambda it: all_runs(it, length, gram), "doc_id long, th long, h long, fp long, s0 long, n int, several boolean"
    ))
    kinds = cut(
        runs_.groupBy("h", "fp").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "th", "s0", "n", "several")).alias("one"))
        .select("h", "fp", "c", "one.*")
    )
    parts = F.ceil(F.greatest(F.col("kinds") / shard, F.col("bytes") / shard_bytes)).cast("int")
    anchors = kinds.groupBy("h").agg(
        F.count("*").alias("kinds"), F.sum(F.col("n").cast("long") + (length - 1)).alias("bytes"),
        F.max(F.col("several") & (F.col("c") == 1)).alias("within")
    )
    anchors = cut(anchors.filter("kinds > 1 OR within").select("h", parts.alias("parts")))  # a table of its own, so that Spark can split the join's hot keys
    wanted = kinds.join(anchors, "h").groupBy("doc_id", "th").agg(F.collect_list(F.struct("h", "fp", "parts", "s0", "n")).alias("wanted"))
    d, w = docs.alias("d"), wanted.hint("merge").alias("w")
    cut_out = d.join(w, F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.th") == F.col("w.th"))).select("d.text", "w.wanted")
    marked = cut(
        cut_out.mapInArrow(lambda it: slices(it, length), "h long, part int, parts int, fp long, n int, slice binary")
        .repartition("h", "part").sortWithinPartitions("h", "part")
        .mapInArrow(lambda it: shard_repeats(it, length), "h long, fp long, a int, b int, range int, windows binary")
    )
    merged = (
        marked.filter("range >= 0").select("h", "range", "windows").repartition("h", "range").sortWithinPartitions("h", "range")
        .mapInArrow(merge_repeats, "h long, fp long, a int, b int")
    )
    parts = marked.filter("range < 0").select("h", "fp", "a", "b").unionByName(merged).groupBy("h", "fp").agg(F.collect_list(F.struct("a", "b")).alias("parts"))
    repeated = kinds.filter("c > 1").select("h", "fp", F.array(F.struct(F.lit(0).alias("a"), F.col("n").alias("b"))).alias("parts")).unionByName(
        parts.join(kinds.filter("c > 1").select("h", "fp"), ["h", "fp"], "left_anti")
    )
    spans = (
        runs_.join(repeated, ["h", "fp"]).select("doc_id", "th", "s0", F.explode("parts").alias("p"))
        .groupBy("doc_id", "th").agg(F.collect_set(F.struct(
            (F.col("s0") + F.col("p.a")).alias("from"), (F.col("s0") + F.col("p.b") + (length - 1)).alias("to")
        )).alias("spans"))
    )
    s = spans.hint("merge").alias("s")
    return (
        docs.alias("d").join(
            s, F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.th") == F.col("s.th")), "left"
        ).select("d.doc_id", F.col("d.text").alias("text"), "s.spans")
        .mapInArrow(
            lambda it: removals(it, length),
            "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<from:long,to:long>>"
        )
    )
