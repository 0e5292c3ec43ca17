"""Packing by order-preserving dynamic programming.

The documents of a partition, in the table's order and each ended by the end id, form one stream of tokens. Windows are consecutive
stretches of the stream of at most `length` tokens. They may end at the end of a document (free), at the end of a sentence (a small
penalty), or, in sentences that are long, every `stride` tokens (a larger penalty). A window is padded to `length` unless it is as long
as a power of two. The programme finds the cuts with the least padding plus penalties:

    cost(i) = penalty(i) + min over places j before i, at most `length` back, of cost(j) + padding(i - j).

As padding falls by one for each token, the minimum over j is that of cost(j) + place(j) in a sliding window, which a monotone queue
keeps in constant time; powers of two below `length` are looked up. Partitions are packed apart, without a shuffle, in bounded memory.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import pieces, raw
from ._tokens import encoded, tokenizer

OUT = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@lru_cache(maxsize=2)
def sentence_ends(file: str) -> np.ndarray:
    """For each id, whether its text has a sentence's end or a line's."""
    t = tokenizer(file)
    return np.array([not set(".!?\n").isdisjoint(t.decode([k])) for k in range(t.get_vocab_size())])


def best_cuts(places: list[int], penalties: list[float], length: int, bare: tuple[int, ...]) -> list[int]:
    """Indexes into places (the first is the stream's start, the last its end) of the best cuts, first and last included."""
    n, at = len(places), np.array(places)
    lows = np.searchsorted(at, at - length).tolist()  # the first place within reach
    exact = []  # for each power of two, the place just so far back, or -1
    for size in bare:
        q = np.minimum(np.searchsorted(at, at - size), n - 1)
        exact.append(np.where(at[q] == at - size, q, -1).tolist())
    cost, back = [0.0] * n, [0] * n
    keys, nodes, head = [float(places[0])], [0], 0  # cost + place, rising; nodes before head are out of reach
    for i in range(1, n):
        p, low = places[i], lows[i]
        while nodes[head] < low:
            head += 1
        j = nodes[head]
        best = keys[head] + length - p
        for of in exact:
            q = of[i]
            if q >= 0 and cost[q] < best:
                best, j = cost[q], q
        best += penalties[i]
        cost[i], back[i] = best, j
        key = best + p
        if keys[-1] >= key:
            keys.pop()
            nodes.pop()
            while len(keys) > head and keys[-1] >= key:
                keys.pop()
                nodes.pop()
        keys.append(key)
        nodes.append(i)
    path = [n - 1]
    while path[-1]:
        path.append(back[path[-1]])
    return path[::-1]


def pack_partition(batches, file: str, end_id: int, length: int, sentence: float, inside: float, stride: int, bare: tuple[int, ...], most: int, partition):
    ends = sentence_ends(file)
    serial = partition() << 32
    ids, docs, places, penalties, size = [], [], [0], [0.0], 0  # docs: [id, place in the stream, tokens before that place, tokens in all]

    def windows(keep_last: bool):
        """The rows of the windows found, and what is left of the stream."""
        nonlocal ids, docs, places, penalties, size, serial
        stream = np.concatenate(ids)
        path = best_cuts(places, penalties, length, bare)
        if keep_last and len(path) > 2:
            path.pop()
        out, d = [], 0
        for a, b in zip(path[:-1], path[1:]):
            low, high = places[a], places[b]
            while d < len(docs) and docs[d][1] < high:
                doc_id, place, before, total = docs[d]
                s, e = max(low, place), min(high, place + total - before)
                out.append((doc_id, before + s - place, e - s, zlib.crc32(stream[s:e]), total, serial, s - low))
                if place + total - before > high:
                    break
                d += 1
            serial += 1
        cut = places[path[-1]]
        ids, docs = [stream[cut:]], [[x, max(p, cut) - cut, b + max(0, cut - p), t] for x, p, b, t in docs[d:] if p + t - b > cut]
        kept = path[-1]
        places, penalties, size = [0, *(p - cut for p in places[kept + 1 :])], [0.0, *penalties[kept + 1 :]], size - cut
        return out

    def batch_of(rows, kind):
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays(
            [pa.array(cols[0], kind), *(pa.array(c, pa.int64()) for c in cols[1:])],
            ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        )

    kind = None
    for batch in batches:
        kind = batch.column(0).type
        data, offsets = raw(batch.column(1))
        for i, j in pieces(offsets, 1 << 20):
            own, counts = encoded(file)(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            stop = np.cumsum(counts + 1)
            x = np.full(stop[-1], end_id, np.uint32)
            x[np.arange(len(own)) + np.repeat(np.arange(j - i), counts)] = own
            sentences = np.flatnonzero(ends[x]) + 1
            sentences = sentences[~np.isin(sentences, np.concatenate([stop, stop - 1]))]
            where = np.concatenate([stop, sentences])
            cost = np.concatenate([np.zeros(len(stop)), np.full(len(sentences), sentence)])
            order = np.argsort(where)
            where, cost = where[order], cost[order]
            before = np.concatenate([[0], where[:-1]])
            more = (where - before - 1) // stride  # places inside long sentences
            if more.any():
                extra = np.repeat(before, more) + stride * (np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1)
                where, cost = np.concatenate([where, extra]), np.concatenate([cost, np.full(len(extra), inside)])
                order = np.argsort(where)
                where, cost = where[order], cost[order]
            places += (where + size).tolist()
            penalties += cost.tolist()
            docs += [[d, size + b - n - 1, 0, n + 1] for d, b, n in zip(batch.column(0).slice(i, j - i).to_pylist(), stop.tolist(), counts.tolist())]
            ids.append(x)
            size += int(stop[-1])
            if size >= most:
                yield batch_of(windows(True), kind)
    if size:
        yield batch_of(windows(False), kind)


def pack(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", file: str = "byte_bpe_50k.json", end_id: int = 0, length: int = 1024,
    sentence: float = 2.0, inside: float = 12.0, stride: int = 20, bare: tuple[int, ...] = (512, 256), most: int = 1 << 19,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A piece is a stretch of one document's ids (its end id is the last) in one sequence. Null text is empty: one piece, the end id. Rows
    are packed in the order in which Spark reads them; null ids and repeated rows are documents like any other. sequence_id is unique in the
    result: the partition's number and a count. An empty table gives no rows. Other columns are not read.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def partition() -> int:
        from pyspark import TaskContext

        return TaskContext.get().partitionId()

    return rows.mapInArrow(lambda it: pack_partition(it, file, end_id, length, sentence, inside, stride, bare, most, partition), f"doc_id {kind}, {OUT}")
