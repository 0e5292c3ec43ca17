"""Phrase collocation mining by SON partitioning.

1. Words are counted by hash, for each language; their sum is n. A Bloom filter of words with the wanted support goes to all tasks.
2. The table is cut into shards: groups of its files, so that a shard may span any number of tasks, and its share w of a language's words
   does not shrink as the table grows. Each is mined completely at the local support ceil(support * w), in two jobs over all shards: runs
   of two words with the wanted support, then runs of three and more whose neighbouring pairs are all possible. Tasks count what they
   read, Spark adds up by shard and run. A phrase with the wanted support is locally frequent in some shard.
3. The locally frequent phrases are united. What a phrase can have at most is the sum of its reported counts and of one less than the
   local support of each shard that did not report it; phrases that can't reach the support go. The rest is a Bloom filter.
4. All runs of words that the filter knows are counted, by their words themselves, over all texts. A run that it knows by mistake is
   counted as exactly, and has less than the support.

The filters have a fixed size. If they fill up (with some 10**7 phrases), more runs are counted; no result changes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import cut
from ._text import BASE, LOWER, mixed, pieces, prefix_hash, raw, rolled, rolling, span_hash, trim

BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
GAP = BREAK.copy()
GAP[[0x20, 0x09]] = True
PART = 1 << 20  # bytes of text in one go


class HashFilter:
    """A Bloom filter of 64-bit hashes with two places each."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def of(hashes: DataFrame, column: str, log_bits: int) -> HashFilter:
        """Built by Spark's bitmap functions; the driver gets the bits alone."""
        mask = (1 << log_bits) - 1
        places = F.explode(F.array(F.col(column).bitwiseAND(mask) + 1, F.shiftrightunsigned(column, 64 - log_bits) + 1))  # bitmaps count from one
        found = hashes.select(places.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
        bits = np.zeros(max(1 << log_bits - 3, 4096), np.uint8)
        for r in found.toLocalIterator():
            bits[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(r["bits"], np.uint8)
        return HashFilter(bits[: 1 << log_bits - 3])

    def has(self, h: np.ndarray) -> np.ndarray:
        log_bits = np.uint64(len(self.bits).bit_length() + 2)
        one = h & np.uint64(8 * len(self.bits) - 1)
        other = h >> (np.uint64(64) - log_bits)
        get = lambda p: (self.bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1
        return (get(one) & get(other)).astype(bool)


def stretches(data: np.ndarray, offsets: np.ndarray):
    """Parts of the rows' bytes, lower case, with the offsets of their rows and the number of the first row. A long row is cut at places
    where pieces end, if it has any."""
    for i, j in pieces(offsets, PART):
        low, end = int(offsets[i]), int(offsets[j])
        if j - i > 1 or end - low <= PART:
            yield LOWER[data[low:end]], offsets[i : j + 1] - low, i
            continue
        ends = np.flatnonzero(BREAK[data[low:end]]) + low + 1
        while low < end:
            k = int(np.searchsorted(ends, low + PART, side="right"))
            high = end if end - low <= PART else int(ends[k - 1]) if k and ends[k - 1] > low else int(ends[k]) if k < len(ends) else end
            yield LOWER[data[low:high]], np.array([0, high - low]), i
            low = high


def phrase_words(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, whether each word and the next are in one piece, and each word's row."""
    black = ~GAP[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[at] = True
    starts, ends = black.copy(), black.copy()
    starts[1:] &= ~black[:-1] | edge[1:-1]
    ends[:-1] &= ~black[1:] | edge[1:-1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    row = np.searchsorted(at, s, side="right") - 1
    piece = np.cumsum(BREAK[buf], dtype=np.int64)[s] + row
    joined = np.zeros(len(s), bool)
    joined[:-1] = piece[1:] == piece[:-1]
    return s, e, joined, row


def language_hash(lang: str) -> np.uint64:
    return np.frombuffer(hashlib.blake2b(lang.encode(), digest_size=8).digest(), np.uint64)[0]


def extended(g: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mixed(g * np.uint64(BASE) + word)


def texts(batches):
    """lang, text, ... -> for each stretch: languages of the batch, its bytes, words (as phrase_words), hashes with the language in them, the code
    of each word's language, the batch, and each word's row in it."""
    for batch in batches:
        coded = batch.column(0).dictionary_encode()
        names, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        salt = np.array([language_hash(x) for x in names], np.uint64)
        for buf, at, first in stretches(*raw(batch.column(1))):
            s, e, joined, row = phrase_words(buf, at)
            row += first
            yield names, buf, s, e, joined, mixed(span_hash(prefix_hash(buf), s, e) ^ salt[codes[row]] if len(s) else np.zeros(0, np.uint64)), codes[row], batch, row
    trim()


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the keys, where each group of equal ones begins in it, and the groups' sizes."""
    order = np.argsort(keys)
    s = keys[order]
    new = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    return order, new, np.diff(np.append(new, len(s)))


def distinct_counts(held):
    """(hash, group) of stretches -> group, h, n."""
    h, group = (np.concatenate(x) for x in zip(*held))
    order, new, n = counted(h)  # a hash has its language in it, and a task's rows mostly one shard
    if (group != group[:1]).any():
        order = np.lexsort((group, h))
        new = np.flatnonzero(np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (group[order][1:] != group[order][:-1])]))
        n = np.diff(np.append(new, len(order)))
    first = order[new]
    return pa.RecordBatch.from_arrays([pa.array(group[first]), pa.array(h[first].view(np.int64)), pa.array(n)], ["g", "h", "n"])


def grouped(found, most: int = 1 << 22):
    """Hashes and groups of stretches -> their counts, `most` occurrences at a time."""
    held, size = [], 0
    for x in found:
        if len(x[0]):
            held.append(x)
            size += len(x[0])
        if size > most:
            yield distinct_counts(held)
            held, size = [], 0
    if held:
        yield distinct_counts(held)
    del held
    trim()


def word_hashes(batches):
    """lang, text, g -> of each stretch the hashes and groups of its words."""
    for _, _, _, _, _, h, _, batch, row in texts(batches):
        yield h, batch.column(2).to_numpy()[row]


def run_hashes(batches, words: HashFilter, pairs: HashFilter | None, longest: int):
    """lang, text, g -> of each stretch the hashes and groups of its runs of two frequent words or, where pairs are known, of three to `longest`."""
    for _, _, _, _, joined, h, _, batch, row in texts(batches):
        if not len(h):
            continue
        group = batch.column(2).to_numpy()[row]
        live = np.append(words.has(h), False)
        at = np.flatnonzero(live[:-1] & live[1:] & joined)
        g = h.copy()
        g[at] = extended(g[at], h[at + 1])
        if pairs is None:
            yield g[at], group[at]
            continue
        possible = np.zeros(len(h) + 1, bool)
        possible[at[pairs.has(g[at])]] = True
        whole = possible.copy()  # runs whose pairs are all possible
        for m in range(3, longest + 1):
            at = np.flatnonzero(whole[: len(h) - m + 2] & possible[m - 2 : len(h)])
            whole[:] = False
            whole[at] = True
            if not len(at):
                break
            g[at] = extended(g[at], h[at + m - 1])
            yield g[at], group[at]


def count_phrases(batches, longest: int, words: HashFilter, phrases: HashFilter):
    """lang, text -> lang, words, phrase, n: runs of words that the filters know, counted by their words."""
    for names, buf, s, e, joined, h, code, *_ in texts(batches):
        if not len(h):
            continue
        exact = rolled(rolling(buf), s, e)  # beside the hash: the words of a group are alike in both
        live = np.append(words.has(h), False)
        at, g, x = np.flatnonzero(live), h.copy(), exact.copy()
        data = buf.tobytes()
        for m in range(1, longest + 1):
            if m > 1:
                at = np.flatnonzero(live[:-1] & live[1:] & joined)
                g[at], x[at] = extended(g[at], h[at + m - 1]), extended(x[at], exact[at + m - 1])
                at = at[phrases.has(g[at])]
            live[:] = False
            live[at] = True
            if not len(at):
                break
            order = np.lexsort((x[at], g[at]))
            a, b = g[at][order], x[at][order]
            new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            first, n = at[order[new]], np.diff(np.append(new, len(at)))
            phrase = [b" ".join([data[s[k + i] : e[k + i]] for i in range(m)]) for k in first.tolist()]
            lang = pa.DictionaryArray.from_arrays(pa.array(code[first].astype(np.int32)), pa.array(names)).dictionary_decode()
            yield pa.RecordBatch.from_arrays(
                [lang, pa.array(np.full(len(first), m, np.int32)), pa.array(phrase, pa.binary()).cast(pa.string()), pa.array(n)],
                ["lang", "m", "phrase", "n"]
            )


def first_words(phrase: Column, k: Column | int) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), 1, k), " ")


def last_words(phrase: Column, k: Column | int) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), -k, k), " ")


def score_phrases(counts: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    """The best phrases of a table lang, m, phrase, n of all phrases with the support, single words among them."""
    candidates = counts.filter("m > 1").withColumnRenamed("n", "a")
    parts = (
        candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 1)))
        .withColumns({"first": first_words(F.col("phrase"), F.col("k")), "rest": last_words(F.col("phrase"), F.col("m") - F.col("k"))})
        .join(counts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"])
        .join(counts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
        .join(totals, "lang")
    )
    score = F.expr("(CAST(1000 AS DECIMAL(38, 0)) * a * total) DIV (CAST(l AS DECIMAL(19, 0)) * r)")
    exact = parts.withColumns({
        "a": F.col("a").cast("decimal(17,0)"), "total": F.col("total").cast("decimal(17,0)"), "r": F.col("r").cast("decimal(19,0)")
    }).withColumn("score", score)
    scored = exact.groupBy("lang", "phrase").agg(F.min(F.struct(
        "score", "k", F.col("l").alias("l"), F.col("r").cast("long").alias("r"), F.col("a").cast("long").alias("a"),
        F.col("total").cast("long").alias("n")
    )).alias("c"))
    # a phrase that a longer one holds with the same count is also held, with that count, by one of a single word more
    longer = candidates.filter("m > 2").select(
        "lang", "a", F.explode(F.array(first_words(F.col("phrase"), F.col("m") - 1), last_words(F.col("phrase"), F.col("m") - 1))).alias("phrase")
    ).groupBy("lang", "phrase").agg(F.max("a").alias("within"))
    free = scored.join(longer, ["lang", "phrase"], "left").filter("within IS NULL OR within < c.a")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("c.score"), F.desc("c.a"), F.asc("phrase")))
    return free.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "c.a", "c.l", "c.r", "c.n", "c.score")


def possible_runs(docs: DataFrame, shards: DataFrame, support: int, find) -> DataFrame:
    """h of the runs that may have the support: locally frequent in some shard, and not ruled out by what all shards report.
    shards: (g, need, slack) with the local support of each shard and language, and the language's sum of these less one."""
    found = docs.mapInArrow(lambda it: grouped(find(it)), "g long, h long, n long").groupBy("g", "h").agg(F.sum("n").alias("n"))
    local = found.join(shards, "g").filter(F.col("n") >= F.col("need"))
    return cut(local.groupBy("h").agg((F.sum(F.col("n") - F.col("need") + 1) + F.max("slack")).alias("most")).filter(F.col("most") >= support).select("h"))


def collocations(
    df: DataFrame, text_col: str = "text", lang_col: str = "lang", support: int = 100, longest: int = 5, top: int = 2000, shards: int = 16, log_bits: int = 26, shard: Column | None = None,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: of each language the `top` phrases of 2 to `longest` words.

    A text (A-Z as a-z; null is empty) is cut into pieces at .,;:!? and line ends, a piece into words at blanks and tabs. A null language
    is und. n counts all words of the language, a the phrase's occurrences (at least `support`) inside pieces, l and r those of the parts
    of its worst cut, score = floor(1000 a n / (l r)). A phrase that a longer one of at most `longest` words holds each time is left out.
    Ties go by a (larger first), then by the phrase's bytes. Rows are counted as they are, repeated ones too. An empty table, or one
    without a frequent phrase, gives no rows. Other columns are not read. shard: what deals rows to `shards` shards (the file a row is
    read from; rows of no file are one shard); results do not depend on it.
    """
    spark = df.sparkSession
    part = F.pmod(F.xxhash64(F.input_file_name() if shard is None else shard), F.lit(shards))
    docs = df.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        part.alias("part")
    )
    docs = docs.select("lang", "text", F.xxhash64("lang", "part").alias("g"))
    single = cut(docs.mapInArrow(lambda it: grouped(word_hashes(it)), "g long, h long, n long").groupBy("g", "h").agg(F.sum("n").alias("n")))
    share = docs.select("lang", "g").distinct().join(single.groupBy("g").agg(F.sum("n").alias("words")), "g")
    totals = cut(share.groupBy("lang").agg(F.sum("words").alias("total")))
    need = F.expr(f"({support} * words + total - 1) DIV total")
    local = share.join(totals, "lang").withColumn("need", need)
    local = cut(local.join(local.groupBy("lang").agg(F.sum(F.col("need") - 1).alias("slack")), "lang").select("g", "need", "slack"))
    words = spark.sparkContext.broadcast(HashFilter.of(single.groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= support), "h", log_bits))
    two = possible_runs(docs, local, support, lambda it: run_hashes(it, words.value, None, 2))
    pairs = spark.sparkContext.broadcast(HashFilter.of(two, "h", log_bits))
    more = possible_runs(docs, local, support, lambda it: run_hashes(it, words.value, pairs.value, longest))
    phrases = spark.sparkContext.broadcast(HashFilter.of(two.unionByName(more), "h", log_bits))
    counts = cut(
        docs.select("lang", "text").mapInArrow(lambda it: count_phrases(it, longest, words.value, phrases.value), "lang string, m int, phrase string, n long")
        .groupBy("lang", "m", "phrase").agg(F.sum("n").alias("n")).filter(F.col("n") >= support)
    )
    return score_phrases(counts, totals, top)
