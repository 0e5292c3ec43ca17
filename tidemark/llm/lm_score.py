"""LM scoring by prediction by partial matching, beside a word unigram baseline.

Training counts, over all documents that are not held out, every byte (or end of text) after its context of `order` bytes; places
before the start of a text are a symbol of their own, so that counts of shorter contexts are sums over longer ones. The trie is a table
for each order and keeps every entry.

A symbol's probability is that of method D: in the longest context that the trie has, (2n - 1) / 2T for a symbol seen there n times of T;
what is left, half a count for each symbol, is the escape to the context shortened by one, where the symbols of the longer one are
excluded. Below the empty context, all symbols not yet excluded are alike. The probabilities of a text's symbols, its end included, are
those of a proper distribution over texts.

Each distinct place (context and symbol) is scored once: places of the training texts by their own counts, others by joins from order to
order. The log probabilities of the most frequent places (at most `most_nodes`) are given to each task; those of all others are joined.

The baseline counts words. The most frequent words are given to each task (at most `most_words`), the others are looked up by a join.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import cut
from ._text import LOWER, pieces, prefix_hash, raw, span_hash, words

BITS, END, PAD, SYMBOLS = np.uint64(9), 256, 257, 257
END_WORD = -7046029254386353131  # stands for the end token among word hashes


def grams(buf: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Context and symbol of every place and text end as one integer, and the number of such places in each row."""
    n, rows = len(buf), len(offsets) - 1
    size = np.diff(offsets)
    text = np.full(n + rows * (order + 1), PAD, np.uint64)
    start = offsets[:-1] + np.arange(rows) * (order + 1) + order
    row = np.repeat(np.arange(rows), size)
    text[np.arange(n) - offsets[row] + start[row]] = buf
    text[start + size] = END
    key = np.zeros(len(text) - order, np.uint64)
    for j in range(order + 1):
        key = (key << BITS) | text[j : len(text) - order + j]
    keep = np.ones(len(key), bool)
    pads = (start[1:, None] - order + np.arange(order)[None, :]).ravel() - order  # places whose symbol is a pad of the next row
    keep[pads] = False
    return key[keep], size + 1


def tally(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their counts."""
    if counts is None:
        keys = np.sort(keys)
        new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
        return keys[new], np.diff(np.append(new, len(keys)))
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[new], np.add.reduceat(counts, new) if len(new) else counts


def count_partition(batches, of, most: int = 1 << 22):
    """of(buf, offsets) -> keys of a part; yields key, n with the part's counts added up while they fit in memory."""
    held, size = [], 0

    def out():
        k, c = tally(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
        return k, c

    for batch in batches:
        data, offsets = raw(batch.column(0))
        for i, j in pieces(offsets, 2 << 20):
            held.append(tally(of(LOWER[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i])))
            size += len(held[-1][0])
            if size > most:
                held = [out()]
                size = len(held[0][0])
                if size > most // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(held[0][0].view(np.int64)), pa.array(held[0][1].astype(np.int64))], ["key", "n"])
                    held, size = [], 0
    if held:
        k, c = out()
        yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(c.astype(np.int64))], ["key", "n"])


def word_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s, e, first = words(buf, offsets)
    return span_hash(prefix_hash(buf), s, e), first


def frequent(counts: DataFrame, most: int) -> int:
    """A count that at most `most` rows reach: the least, up to its first sixteen binary digits."""
    coarse = F.expr("shiftleft(shiftright(n, greatest(length(bin(n)) - 16, 0)), greatest(length(bin(n)) - 16, 0))")
    total, least = 0, 1 << 62
    for n, rows in counts.groupBy("n").agg(F.count("*").alias("rows")).groupBy(coarse.alias("n")).agg(F.sum("rows").alias("rows")).orderBy(F.desc("n")).collect():  # some 2**15 for each further doubling
        total += rows
        if total > most:
            return least
        least = n
    return 1


class Trie:
    """Sorted entries and contexts of each order, with what escapes cost.

    The model in memory, for tries that fit; a pruned one (closed under shortening) lets what it does not keep escape.
    A context's T is the count of the entry, one order lower, whose context and symbol spell it: every symbol but the end has one after it.
    The context of a text's start has one for each text; the empty context has all.
    """

    def __init__(self, per_order: list[tuple[np.ndarray, np.ndarray]], texts: int, symbols: int):
        self.order = len(per_order) - 1
        self.entry, self.log_n, self.context, self.log_total, self.log_escape, self.log_rest, self.log_next = [], [], [], [], [], [], []
        below = None
        for k, (keys, n) in enumerate(per_order):
            all_contexts = keys >> BITS
            new = np.flatnonzero(np.concatenate([[True], all_contexts[1:] != all_contexts[:-1]])) if len(keys) else np.zeros(0, int)
            contexts = all_contexts[new]
            if k == 0:
                total = np.full(len(contexts), symbols, np.int64)
            elif len(contexts):
                place = np.minimum(np.searchsorted(below[0], contexts), len(below[0]) - 1)
                total = np.where(below[0][place] == contexts, below[1][place], texts)
            else:
                total = np.zeros(0, np.int64)
            mass = np.add.reduceat(2 * n - 1, new) if len(new) else total
            self.entry.append(keys)
            self.log_n.append(np.log10(2 * n - 1))
            self.context.append(contexts)
            self.log_total.append(np.log10(2 * total))
            self.log_escape.append(np.log10(2 * total - mass) - np.log10(2 * total))
            if k and len(contexts):  # the shorter context without the symbols of this one: what is left of it, and its escape
                excluded = np.add.reduceat(2 * below[1][np.searchsorted(below[0], keys & np.uint64((1 << 9 * k) - 1))] - 1, new)
                parent = np.searchsorted(self.context[k - 1], contexts & np.uint64((1 << 9 * (k - 1)) - 1))
                rest = 2 * below[2][parent] - excluded
                self.log_rest.append(np.log10(rest))
                self.log_next.append(np.log10(2 * below[2][parent] - below[3][parent]) - np.log10(rest))
            else:
                self.log_rest.append(np.zeros(0))
                self.log_next.append(np.zeros(0))
            below = (keys, n, total, mass)
        self.left = SYMBOLS - len(per_order[0][0])

    def scores(self, keys: np.ndarray) -> np.ndarray:
        """log10 of the probabilities of distinct sorted keys (contexts of the full order)."""
        out, open_ = np.zeros(len(keys)), np.arange(len(keys))
        above = np.full(len(keys), -1)  # the context one longer, where the trie has it
        for k in range(self.order, -1, -1):
            own = keys[open_] & np.uint64((1 << 9 * (k + 1)) - 1)
            ctx = own >> BITS
            at = np.searchsorted(self.context[k], ctx)
            have = (at < len(self.context[k])) & (self.context[k][np.minimum(at, len(self.context[k]) - 1)] == ctx) if len(self.context[k]) else np.zeros(len(ctx), bool)
            e = np.searchsorted(self.entry[k], own)
            hit = have & (self.entry[k][np.minimum(e, len(self.entry[k]) - 1)] == own) if len(self.entry[k]) else have
            longer = above[open_]
            free = have & (longer < 0)
            if k < self.order and len(self.context[k + 1]):
                bound = np.where(
                    free, self.log_total[k][np.minimum(at, len(self.context[k]) - 1)] if len(self.context[k]) else 0.0,
                    self.log_rest[k + 1][np.maximum(longer, 0)]
                )
                escape = np.where(
                    longer < 0, np.where(free, self.log_escape[k][np.minimum(at, len(self.context[k]) - 1)] if len(self.context[k]) else 0.0, 0.0),
                    self.log_next[k + 1][np.maximum(longer, 0)]
                )
            elif len(self.context[k]):
                i = np.minimum(at, len(self.context[k]) - 1)
                bound, escape = self.log_total[k][i], np.where(have, self.log_escape[k][i], 0.0)
            else:
                bound = escape = np.zeros(len(ctx))
            out[open_[hit]] += self.log_n[k][e[hit]] - bound[hit]
            out[open_[~hit]] += escape[~hit]
            above[open_] = np.where(have, at, -1)
            open_ = open_[~hit]
        out[open_] -= np.log10(max(self.left, 1))
        return out


def looked_up(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The value of each asked key (0 where sorted `keys` lack it), and whether it is there."""
    value, found = np.zeros(len(asked)), np.zeros(len(asked), bool)
    if len(keys):
        by = np.argsort(asked)
        place = np.minimum(np.searchsorted(keys, asked[by]), len(keys) - 1)
        found[by] = keys[place] == asked[by]
        value[by] = values[place]
        value[~found] = 0.0
    return value, found


def score_partition(batches, places: tuple[np.ndarray, np.ndarray], common: tuple[np.ndarray, np.ndarray], order: int):
    """doc_id, held_out, text -> doc_id, held_out, n_tokens, known, base (sum of log10(c + 0.1) over common words), rare (hashes of the others),
    score (sum of the logs of common places), open (keys of the others)."""

    def lists(values, row, rows):
        return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))]).astype(np.int32), pa.array(values.view(np.int64)))

    for batch in batches:
        data, offsets = raw(batch.column(2))
        for i, j in pieces(offsets, 1 << 20):
            buf, at = LOWER[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
            g, sizes = grams(buf, at, order)
            row = np.repeat(np.arange(j - i), sizes)
            log, found = looked_up(*places, g)
            score = np.bincount(row, weights=log, minlength=j - i)
            open_ = lists(g[~found], row[~found], j - i)

            h, first = word_hashes(buf, at)
            row = np.repeat(np.arange(j - i), np.diff(first))
            value, found = looked_up(*common, h)
            known = np.bincount(row[found], minlength=j - i)
            base = np.bincount(row, weights=value, minlength=j - i).astype(np.float64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(np.diff(first) + 1), pa.array(known), pa.array(base),
                    lists(h[~found], row[~found], j - i), pa.array(score), open_
                ],
                ["doc_id", "held_out", "n_tokens", "known", "base", "rare", "score", "open"],
            )


def unseen(keys: DataFrame, levels: list[DataFrame], symbols_seen: int) -> DataFrame:
    """(key, log) of distinct places that no training text has; levels are the trie's entries (key, n) from order 0 up.

    At each order, the contexts that are asked for get T, the number of their symbols and, for the next order, what these count there;
    a place is settled at the first order that has it. Tables of contexts of two bytes or less are small whatever the input.
    """
    settled = []
    open_ = keys.select("key", F.lit(0.0).alias("log"), F.lit(None).cast("long").alias("excluded"))
    for k in range(len(levels) - 1, -1, -1):
        own = F.col("key").bitwiseAND((1 << 9 * (k + 1)) - 1)
        open_ = open_.withColumn("own", own).withColumn("context", F.shiftright("own", 9))
        entries = levels[k].select(F.col("key").alias("own"), "n")
        inside = entries.withColumn("context", F.shiftright("own", 9)).join(open_.select("context").distinct(), "context", "left_semi")
        counts = F.lit(None).cast("long")
        if k:
            inside = inside.withColumn("shorter", F.col("own").bitwiseAND((1 << 9 * k) - 1)).join(
                levels[k - 1].select(F.col("key").alias("shorter"), F.col("n").alias("below")), "shorter"
            )
            counts = F.sum(2 * F.col("below") - 1)
        contexts = inside.groupBy("context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), counts.alias("next"))
        at = open_.join(F.broadcast(contexts) if k < 3 else contexts, "context", "left").join(F.broadcast(entries) if k < 2 else entries, "own", "left")
        left = F.log10(2 * F.col("total") - F.coalesce("excluded", F.lit(0)))
        gain = F.when(F.col("n").isNotNull(), F.log10(2 * F.col("n") - 1) - left).when(F.col("total").isNotNull(), F.log10("kinds") - left).otherwise(0.0)
        step = cut(at.select("key", (F.col("log") + gain).alias("log"), F.col("next").alias("excluded"), F.col("n").isNotNull().alias("hit")))
        settled.append(step.filter("hit").select("key", "log"))
        open_ = step.filter("NOT hit").drop("hit")
    settled.append(open_.select("key", (F.col("log") - float(np.log10(max(SYMBOLS - symbols_seen, 1)))).alias("log")))
    return reduce(DataFrame.unionByName, settled)


def lm_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 6, most_nodes: int = 1 << 20, most_words: int = 1 << 20) -> DataFrame:
    """One row per row of df: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Held out are documents whose crc32(id as text) is divisible by ten (a null id has the empty text); the others train both models.
    Null text is empty and has one token, its end. A-Z count as a-z in both. Repeated rows train and are scored as often as they stand.
    An empty table gives no rows; with no training document, every symbol is equally likely. Other columns are not read.
    """
    held = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 10 == 0
    docs = df.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    train = docs.filter("NOT held_out").select("text")
    ends = train.count()

    def count_grams(it):
        return count_partition(it, lambda b, o: grams(b, o, order)[0])

    def count_words(it):
        return count_partition(it, lambda b, o: word_hashes(b, o)[0])

    whole = Window.partitionBy(F.shiftright("key", 9))
    level = train.mapInArrow(count_grams, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    level = cut(level.withColumn("log", F.log10(2 * F.col("n") - 1) - F.log10(2 * F.sum("n").over(whole))))
    seen, levels = level, [level]
    for k in range(order - 1, -1, -1):
        level = level.groupBy(F.col("key").bitwiseAND((1 << 9 * (k + 1)) - 1).alias("key")).agg(F.sum("n").alias("n"))
        level = cut(level)
        levels.insert(0, level)
    least = frequent(seen, most_nodes)
    kept = seen.filter(F.col("n") >= least).select("key", "log").toArrow()  # at most most_nodes rows
    places, place_logs = kept.column("key").to_numpy().astype(np.uint64), kept.column("log").to_numpy()
    del kept
    by = np.argsort(places)
    places, place_logs = places[by], place_logs[by]

    counts = cut(train.mapInArrow(count_words, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")))
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total, kinds = total + ends, kinds + (ends > 0)
    least_word = frequent(counts, most_words)
    top = counts.filter(F.col("n") >= least_word).toArrow()  # at most most_words rows
    hashes, logs = top.column("key").to_numpy().astype(np.uint64), np.log10(top.column("n").to_numpy() + 0.1)
    by = np.argsort(hashes)
    sc = df.sparkSession.sparkContext
    box, common = sc.broadcast((places, place_logs)), sc.broadcast((hashes[by], logs[by]))

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.mapInArrow(
        lambda it: score_partition(it, box.value, common.value, order),
        f"doc_id {kind}, held_out boolean, n_tokens long, known long, base double, rare array<long>, score double, open array<long>"
    )
    scored = cut(scored.withColumn("row", F.monotonically_increasing_id()))
    rare = (
        scored.select("row", F.explode("rare").alias("key")).groupBy("row", "key").agg(F.count("*").alias("times"))
        .join(counts.filter(F.col("n") < least_word), "key", "left")
        .groupBy("row").agg(
            F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("rare_known"),
            F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.1)).alias("rare_base")
        )
    )
    open_ = scored.select("row", "held_out", F.explode("open").alias("key"))
    infrequent = seen.filter(F.col("n") < least).select("key", "log")
    novel = cut(open_.filter("held_out").select("key").distinct().join(infrequent, "key", "left_anti"))  # training texts have none
    logs = infrequent.unionByName(unseen(novel, levels, levels[0].count()))
    joined = open_.select("row", "key").join(logs, "key").groupBy("row").agg(F.sum("log").alias("open_score"))
    log_whole, log_end = float(np.log10(total + 0.1 * (kinds + 1))), float(np.log10(ends + 0.1))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return scored.drop("rare", "open").join(rare, "row", "left").join(joined, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + zero("rare_known") + int(ends > 0)).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + zero("rare_base") + log_end - F.col("n_tokens") * log_whole).alias("base_score"), (F.col("score") + zero("open_score")).alias("score"),
    )
