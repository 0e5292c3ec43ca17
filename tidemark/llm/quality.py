"""Quality classifier from weak labels.

Eight overlapping heuristics vote good (1), bad (0) or abstain (2) on every document. Expectation-maximisation over the counts of vote
patterns (at most 3**8 rows, counted over all documents) estimates what each heuristic says of good and of bad documents, and so the
posterior of each pattern. About `most_rows` documents, chosen by the hash of their id, then train a linear scorer on hashed byte
trigrams and word-pair kinds with the posteriors as labels; it scores every document on its whole text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import pieces, prefix_hash, raw, span_hash, words

HEURISTICS = ("capitals", "symbols", "bars", "repeats", "punctuation", "variety", "word_length", "size")
DIMS = 1 << 15
UPPER, SYMBOL, STOP = (np.zeros(256, np.int64) for _ in range(3))
UPPER[65:91] = 1
SYMBOL[[ord(c) for c in "!#$%&*<>@^_`{|}~\\=+"]] = 1
STOP[[ord(c) for c in ".,;:?!"]] = 1


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


def look(buf: np.ndarray, offsets: np.ndarray):
    """Votes (row, heuristic), and for each row the hashed features: bucket of each trigram and word-pair kind, and the first of each row."""
    s, e, first = words(buf, offsets)
    n = np.diff(first)
    some = np.maximum(n, 1)
    size = np.maximum(np.diff(offsets), 1)
    h = span_hash(prefix_hash(buf), s, e)
    row = np.repeat(np.arange(len(n)), n)
    again = np.zeros(len(h), np.int64)
    if len(h) > 1:
        again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    order = np.lexsort((h, row))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (row[1:] != row[:-1])
    distinct = np.bincount(row, weights=new, minlength=len(n)) / some
    black = row_sums(e - s, first)
    ends = STOP[buf[e - 1]] if len(e) else np.zeros(0, np.int64)
    stats = {
        "capitals": row_sums(UPPER[buf], offsets) / size, "symbols": row_sums(SYMBOL[buf], offsets) / size,
        "bars": row_sums(((e - s) == 1) & (SYMBOL[buf[s]] == 1), first) / some if len(s) else np.zeros(len(n)),
        "repeats": row_sums(again, first) / some, "punctuation": row_sums(ends, first) / some, "variety": distinct, "word_length": black / some, "size": n,
    }
    bad = {
        "capitals": stats["capitals"] > 0.3, "symbols": stats["symbols"] > 0.04, "bars": stats["bars"] > 0.15, "repeats": stats["repeats"] > 0.1,
        "punctuation": (n >= 20) & ((stats["punctuation"] < 0.02) | (stats["punctuation"] > 0.6)), "variety": (n >= 20) & (distinct < 0.25),
        "word_length": (n > 0) & ((stats["word_length"] < 2) | (stats["word_length"] > 14)), "size": n < 2,
    }
    good = {
        "capitals": (n > 0) & (stats["capitals"] < 0.15), "symbols": (n > 0) & (stats["symbols"] < 0.02), "bars": (n >= 5) & (stats["bars"] < 0.05), "repeats": (n >= 5) & (stats["repeats"] < 0.04),
        "punctuation": (n >= 5) & (stats["punctuation"] > 0.03) & (stats["punctuation"] < 0.4), "variety": (n >= 20) & (distinct > 0.35),
        "word_length": (stats["word_length"] >= 3) & (stats["word_length"] <= 11), "size": n >= 8,
    }
    votes = np.stack([np.where(bad[k], 0, np.where(good[k], 1, 2)) for k in HEURISTICS], 1)

    x = buf.astype(np.uint32)
    code = ((((x[:-2] << 16) | (x[1:-1] << 8) | x[2:]) * np.uint32(2654435769)) >> np.uint32(17)).astype(np.int64) if len(x) > 2 else np.zeros(0, np.int64)
    inside = np.ones(len(buf), bool)
    for back in (1, 2):
        at = offsets[1:] - back
        inside[at[at >= 0]] = False
    code = code[inside[: len(code)]]
    return votes, code, np.concatenate([[0], np.cumsum(np.maximum(np.diff(offsets) - 2, 0))]), again, first


def _parts(column: pa.Array):
    data, offsets = raw(column)
    for i, j in pieces(offsets):
        yield i, j, *look(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def pattern(votes: np.ndarray) -> np.ndarray:
    return votes @ 3 ** np.arange(votes.shape[1])


def count_patterns(batches):
    """text -> pattern, n."""
    counts = np.zeros(3 ** len(HEURISTICS), np.int64)
    for batch in batches:
        for _, _, votes, *_ in _parts(batch.column(0)):
            counts += np.bincount(pattern(votes), minlength=len(counts))
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], ["pattern", "n"])


def fit_votes(patterns: np.ndarray, n: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of good for every pattern, P(vote | class) as (class, heuristic, vote)) by expectation-maximisation from a majority start.

    P is of votes that are given: an abstention says nothing, so that short texts, on which most heuristics abstain, aren't taken for bad ones.
    """
    m = len(HEURISTICS)
    every = np.arange(3**m)[:, None] // 3 ** np.arange(m)[None, :] % 3
    count = np.zeros(len(every))
    count[patterns] = n
    good, bad = (every == 1).sum(1), (every == 0).sum(1)
    post = (good + 1.0) / (good + 3 * bad + 2.0)  # one bad vote weighs as three good ones at the start
    for _ in range(rounds):
        table = np.ones((2, m, 2))
        for c, weight in ((0, count * (1 - post)), (1, count * post)):
            for v in range(2):
                table[c, :, v] += weight @ (every == v)
        table /= table.sum(2, keepdims=True)
        share = np.array([(count * (1 - post)).sum() + 1, (count * post).sum() + 1])
        log = np.log(share / share.sum())[:, None] + sum(np.append(np.log(table[:, k, :]), [[0.0], [0.0]], 1)[:, every[:, k]] for k in range(m))
        after = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        moved, post = np.abs(after - post).max(), after
        if moved < 1e-9:
            break
    return post, table


def sampled(batches):
    """u, text -> u, pattern, buckets and shares of the hashed features of the whole text."""
    for batch in batches:
        pats, idx, val = [], [], []
        for i, j, votes, code, at, again, first in _parts(batch.column(1)):
            pats += pattern(votes).tolist()
            for k in range(j - i):
                b, c = np.unique(np.concatenate([code[at[k] : at[k + 1]], [DIMS]]), return_counts=True)
                idx.append(np.append(b[:-1], DIMS)), val.append(np.append(
                    c[:-1] / max(1, at[k + 1] - at[k]), again[first[k] : first[k + 1]].mean() if first[k + 1] > first[k] else 0.0
                ))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), pa.array(pats, pa.int32()), pa.array([x.astype(np.int32) for x in idx], pa.list_(pa.int32())),
                pa.array([x.astype(np.float32) for x in val], pa.list_(pa.float32()))
            ],
            ["u", "pattern", "idx", "val"]
        )


def fit_scorer(rows: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, rounds: int = 120, rate: float = 2.0) -> np.ndarray:
    """Weights (features, and the constant last) of a logistic model, by full gradients with adaptive steps."""
    w, seen = np.zeros(DIMS + 2), np.full(DIMS + 2, 1e-8)
    if not len(labels):
        return w
    at = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    idx, val = np.concatenate(rows), np.concatenate(values).astype(np.float64)
    who = np.repeat(np.arange(len(rows)), np.diff(at))
    balance = np.where(labels > 0.5, 0.5 / max(1.0, labels.sum()), 0.5 / max(1.0, (1 - labels).sum())) * len(labels)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.add.reduceat(w[idx] * val, at[:-1]) + w[-1], -30, 30)))
        g = balance * (p - labels) / len(labels)
        grad = np.bincount(idx, weights=val * g[who], minlength=DIMS + 2)
        grad[-1] = g.sum()
        grad += 1e-7 * w
        seen += grad * grad
        w -= rate * grad / np.sqrt(seen)
    return w


def score_rows(batches, w: np.ndarray, post: np.ndarray):
    """doc_id, text -> doc_id, votes, weak_label, score."""
    for batch in batches:
        for i, j, votes, code, at, again, first in _parts(batch.column(1)):
            mean = row_sums(w[code], at) / np.maximum(np.diff(at), 1)
            logit = mean + w[DIMS] * row_sums(again, first) / np.maximum(np.diff(first), 1) + w[-1]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(i, j - i),
                    pa.ListArray.from_arrays(np.arange(j - i + 1, dtype=np.int32) * votes.shape[1], pa.array(votes.ravel().astype(np.int32))),
                    pa.array(post[pattern(votes)]), pa.array(1 / (1 + np.exp(-np.clip(logit, -30, 30))))
                ],
                ["doc_id", "votes", "weak_label", "score"],
            )


def quality_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_rows: int = 8_000, least: float = 0.5) -> DataFrame:
    """One row per row of df: doc_id, votes, weak_label, score, kept.

    weak_label is the posterior that the document is good given its votes, score the linear scorer's, kept whether score reaches `least`.
    Null text is empty. Null ids and repeated rows are rows like any other. An empty table gives no rows. Other columns are not read.
    """
    docs = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = docs.select("text").mapInArrow(count_patterns, "pattern int, n long").groupBy("pattern").agg(F.sum("n").alias("n")).toPandas()  # at most 3**8 rows
    post, _ = fit_votes(found["pattern"].to_numpy(dtype=int), found["n"].to_numpy(dtype=float))
    share = min(1.0, most_rows / max(1, int(found["n"].sum())))
    chosen = docs.select((F.xxhash64("doc_id", "text") / F.lit(2.0**64) + 0.5).alias("u"), "text").filter(F.col("u") <= share)
    sample = chosen.mapInArrow(sampled, "u double, pattern int, idx array<int>, val array<float>").orderBy("u", "pattern").limit(2 * most_rows).toArrow()  # about most_rows rows; repeated ones are chosen together
    idx, val = (sample.column(k).combine_chunks() for k in ("idx", "val"))
    at = idx.offsets.to_numpy() if len(idx) else np.zeros(1, int)
    flat_idx, flat_val = (x.values.to_numpy() if len(x) else np.zeros(0) for x in (idx, val))
    labels = post[sample.column("pattern").to_numpy().astype(int)] if len(idx) else np.zeros(0)
    w = fit_scorer([flat_idx[a:b] for a, b in zip(at[:-1], at[1:])], [flat_val[a:b] for a, b in zip(at[:-1], at[1:])], labels)
    box = df.sparkSession.sparkContext.broadcast((w, post))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(
        lambda it: score_rows(it, *box.value), f"doc_id {kind}, votes array<int>, weak_label double, score double"
    ).withColumn("kept", F.col("score") >= least)
