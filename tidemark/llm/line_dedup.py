"""Line dedup by sharded minimal perfect hashing.

1. The key of a line has a digest of 128 bits. Every document sends each of its digests once; digests are counted by Spark, and those of
   `least` documents or more stay.
2. The digests are dealt to shards. A shard is a minimal perfect hash of its digests (levels of bits; a digest that meets another in a
   level goes on to the next one, and the place of a digest is the number of bits before its own) and the arrays that it indexes: a
   fingerprint, the number of documents and the largest id of each. A task builds one shard at a time.
3. Documents probe the arrays: a line is known when the fingerprint at its place is its own, so that a foreign line is taken for a known
   one with a chance of 2**-64. The shards of the `most` most frequent digests are broadcast (some 26 bytes a digest), and answer in the
   task that reads the document. So no line is hot beyond them.
4. Digests past the first `most` stay in tables. Only if there are any, documents send what the broadcast does not know to the digests'
   shards, where it is probed as a stream, and the lines to be dropped come back to their documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import cut, runs
from ._text import BASE, mixed, trim

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
CONTINUED = bytes(range(0x80, 0xC0))  # bytes that begin no code point


class PerfectHash:
    """A minimal perfect hash of distinct pairs of 64-bit integers, in about three bits each."""

    def __init__(self, sizes, words: np.ndarray):
        self.sizes, self.words = [int(x) for x in sizes], words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])  # bits before each word

    @staticmethod
    def _at(pairs: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mixed(pairs[:, 0] + mixed(pairs[:, 1] + np.uint64(BASE * (level + 1) & 0xFFFFFFFFFFFFFFFF))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def of(cls, pairs: np.ndarray) -> PerfectHash:
        sizes, words, rest = [], [np.zeros(0, np.uint64)], pairs
        while len(rest):
            size = 64 * -(-2 * len(rest) // 64)
            at = cls._at(rest, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            words.append(np.packbits(alone, bitorder="little").view(np.uint64))
            sizes.append(size)
            rest = rest[~alone[at]]
        return cls(sizes, np.concatenate(words))

    def places(self, pairs: np.ndarray) -> np.ndarray:
        """The place of each pair; of a pair that was not there, any place, or -1."""
        out = np.full(len(pairs), -1, np.int64)
        open_, base = np.arange(len(pairs)), 0
        for level, size in enumerate(self.sizes):
            at = base + self._at(pairs[open_], level, size)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            here = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[open_[here]] = (self.before[at >> 6] + below)[here]
            open_, base = open_[~here], base + size
        return out


def shard_of(pairs: np.ndarray, shards: int) -> np.ndarray:
    return (mixed(pairs[:, 0] ^ np.uint64(BASE)) % np.uint64(shards)).astype(np.int64)


class Shard:
    """Arrays of one shard: a fingerprint, a count and the largest id (and whether there is one) at each digest's place."""

    def __init__(self, sizes, words, prints, docs, top, named):
        self.hash, self.prints, self.docs, self.top, self.named = PerfectHash(sizes, words), prints, docs, top, named

    @classmethod
    def read(cls, r) -> Shard:
        return cls(
            r["sizes"], np.frombuffer(r["words"], np.uint64),
            *(np.frombuffer(r[k], t) for k, t in (("prints", np.uint64), ("docs", np.int64), ("top", np.int64), ("named", bool)))
        )

    def find(self, pairs: np.ndarray) -> np.ndarray:
        """The place of each pair that is known, or -1."""
        at = self.hash.places(pairs)
        if len(self.prints):
            at[(at >= 0) & (self.prints[at] != pairs[:, 1])] = -1
        return at

    def drops(self, pairs: np.ndarray, least: int, has_id: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each pair is known, and whether its line goes from the row with the id given."""
        at = self.find(pairs)
        known = at >= 0
        drop = known.copy()
        own = np.where(self.named[at[known]], has_id[known] & (ids[known] == self.top[at[known]]), ~has_id[known])
        drop[known] = (self.docs[at[known]] >= least) & ~own
        return known, drop


SHARD = "shard int, sizes array<long>, words binary, prints binary, docs binary, top binary, named binary"


def build(batches):
    """h1, h2, docs, top, shard, sorted by shard -> a row for each shard."""
    for t in runs(batches, ["shard"]):
        shard = t.column("shard").to_numpy()
        pairs = np.stack([t.column(k).to_numpy().view(np.uint64) for k in ("h1", "h2")], 1)
        top = t.column("top").combine_chunks()
        docs, named, ids = t.column("docs").to_numpy(), top.is_valid().to_numpy(zero_copy_only=False), top.fill_null(0).to_numpy()
        edge = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
        for a, b in zip(edge, [*edge[1:], len(shard)]):
            own = PerfectHash.of(pairs[a:b])
            order = np.argsort(own.places(pairs[a:b])) + a
            blobs = [own.words, pairs[order, 1], docs[order], ids[order], named[order]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([int(shard[a])], pa.int32()), pa.array([own.sizes], pa.list_(pa.int64())),
                    *(pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in blobs)
                ],
                ["shard", "sizes", "words", "prints", "docs", "top", "named"],
            )


def digest(line: bytes, least_chars: int) -> bytes | None:
    """The digest of a line's key, or None where the key has fewer code points."""
    key = line.strip(SPACES)
    if len(key) < least_chars or (not key.isascii() and len(key.translate(None, CONTINUED)) < least_chars):
        return None
    return hashlib.blake2b(key.lower(), digest_size=16).digest()  # bytes.lower() changes A-Z alone


def sent(batches, least_chars: int):
    """doc_id, text -> h1, h2, doc_id: each digest of a document once."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            found, rows = [], []
            for i, text in enumerate(part.column(1).cast(pa.binary()).to_pylist()):
                own = {digest(x, least_chars) for x in text.split(b"\n")} - {None}
                found += own
                rows += [i] * len(own)
            pairs = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), part.column(0).take(pa.array(rows, pa.int64()))], ["h1", "h2", "doc_id"])
    trim()


def _lines(batch, least_chars: int):
    """For parts of a batch: its rows (from, to), their lines, the row and number of each line that has a digest, and the digests."""
    texts = batch.column(1).cast(pa.binary())
    sizes = pc.binary_length(texts).to_numpy()
    low = 0
    while low < batch.num_rows:
        high, size = low + 1, int(sizes[low])
        while high < batch.num_rows and size + sizes[high] <= 1 << 22:
            size += int(sizes[high])
            high += 1
        lines = [x.split(b"\n") for x in texts.slice(low, high - low).to_pylist()]
        row, nth, digests = [], [], []
        for i, own in enumerate(lines):
            for k, line in enumerate(own):
                d = digest(line, least_chars)
                if d is not None:
                    row.append(i), nth.append(k), digests.append(d)
        yield low, high, lines, np.array(row, np.int64), np.array(nth, np.int64), np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
        low = high
    trim()


def _ids(column) -> tuple[np.ndarray, np.ndarray]:
    return column.is_valid().to_numpy(zero_copy_only=False), column.fill_null(0).to_numpy()


def _probe(shards: dict[int, Shard], n: int, pairs: np.ndarray, least: int, has_id: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    known, drop = np.zeros(len(pairs), bool), np.zeros(len(pairs), bool)
    where = shard_of(pairs, n)
    order = np.argsort(where, kind="stable")
    cuts = np.searchsorted(where[order], np.arange(n + 1))
    for s, shard in shards.items():
        at = order[cuts[s] : cuts[s + 1]]
        if len(at):
            known[at], drop[at] = shard.drops(pairs[at], least, has_id[at], ids[at])
    return known, drop


def unknown(batches, shards: dict[int, Shard], n: int, least: int, least_chars: int):
    """doc_id, text, th -> h1, h2, doc_id, th, nth of the lines that the broadcast shards don't know."""
    for batch in batches:
        has, ids = _ids(batch.column(0))
        for low, _, _, row, nth, pairs in _lines(batch, least_chars):
            known, _ = _probe(shards, n, pairs, least, has[row + low], ids[row + low])
            take = pa.array(row[~known] + low)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(pairs[~known, k].view(np.int64)) for k in (0, 1)), batch.column(0).take(take), batch.column(2).take(take), pa.array(nth[~known])],
                ["h1", "h2", "doc_id", "th", "nth"]
            )


def probe_tables(batches, least: int):
    """Rows of shards (kind 0: its arrays, kind 1: lines), sorted by shard and kind -> doc_id, th, nth of the lines that go."""
    now, shard = None, None
    for batch in batches:
        kinds, at = batch.column("kind").to_numpy(), batch.column("shard").to_numpy()
        edge = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (kinds[1:] == 0) | (kinds[1:] != kinds[:-1])])) if len(at) else []
        for a, b in zip(edge, [*edge[1:], len(at)]):
            if kinds[a] == 0:
                now, shard = int(at[a]), Shard.read({k: batch.column(k)[int(a)].as_py() for k in ("sizes", "words", "prints", "docs", "top", "named")})
            elif now == at[a]:
                part = batch.slice(a, b - a)
                pairs = np.stack([part.column(k).to_numpy().view(np.uint64) for k in ("h1", "h2")], 1)
                _, drop = shard.drops(pairs, least, *_ids(part.column("doc_id")))
                yield part.select(["doc_id", "th", "nth"]).filter(pa.array(drop))


def kept_lines(batches, shards: dict[int, Shard], n: int, least: int, least_chars: int):
    """doc_id, text, gone (numbers of lines, or null) -> the digest columns."""
    for batch in batches:
        has, ids = _ids(batch.column(0))
        for low, high, lines, row, nth, pairs in _lines(batch, least_chars):
            _, drop = _probe(shards, n, pairs, least, has[row + low], ids[row + low])
            gone = [set() for _ in lines]
            for i, k in zip(row[drop].tolist(), nth[drop].tolist()):
                gone[i].add(k)
            for i, more in enumerate(batch.column(2).slice(low, high - low).to_pylist()):
                gone[i].update(more or ())
            digests = [hashlib.sha256(b"\n".join([x for k, x in enumerate(own) if k not in g] if g else own)).hexdigest() for own, g in zip(lines, gone)]
            counts = (pa.array([len(x) for x in y], pa.int64()) for y in (lines, gone))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(low, high - low), *counts, pa.array(digests, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
            )


def shards_of(digests: DataFrame, n: int) -> DataFrame:
    """The shards (rows of SHARD) of a table h1, h2, docs, top."""

    def dealt(batches):
        for b in batches:
            pairs = np.stack([b.column(k).to_numpy().view(np.uint64) for k in ("h1", "h2")], 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shard_of(pairs, n).astype(np.int32))], [*b.schema.names, "shard"])

    rows = digests.select("h1", "h2", "docs", "top").mapInArrow(dealt, "h1 long, h2 long, docs long, top long, shard int")
    return rows.repartition("shard").sortWithinPartitions("shard").mapInArrow(build, SHARD)


def line_dedup(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 3, least_chars: int = 20, most: int = 1 << 20,
    shard_keys: int = 1 << 17
) -> DataFrame:
    """One row per row of df: doc_id, n_lines, n_dropped, kept_sha256.

    A text is split at \\n; a null or empty one is one empty line. A line's key is the line without white space at its ends, A-Z as a-z.
    Keys of at least `least_chars` code points that at least `least` rows hold lose all their lines but those of the largest id that
    holds the key. Rows are documents: repeated rows count one by one, and rows that share the largest id all keep their lines. A null id
    is smaller than every other; where only such rows hold a key, they keep it. An empty table gives no rows. Other columns are not read.
    most: the most frequent keys, whose arrays are broadcast. Results do not depend on it, nor on shard_keys.
    """
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    often = cut(
        docs.mapInArrow(lambda it: sent(it, least_chars), "h1 long, h2 long, doc_id long")
        .groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.max("doc_id").alias("top")).filter(F.col("docs") >= least)
    )
    count = often.count()
    order = [F.desc("docs"), F.col("h1"), F.col("h2")]
    hot = cut(often.orderBy(*order).limit(most)) if count > most else often
    n = max(1, -(-min(count, most) // shard_keys))
    box = spark.sparkContext.broadcast({r["shard"]: Shard.read(r) for r in cut(shards_of(hot, n)).toLocalIterator()})  # at most `most` digests
    gone = docs.select("doc_id", "text", F.lit(None).cast("array<long>").alias("gone"))
    if count > most:
        last = hot.orderBy(F.col("docs"), F.desc("h1"), F.desc("h2")).first()
        bound = [F.lit(x).cast("long") for x in (-last["docs"], last["h1"], last["h2"])] if last else []
        after = F.struct((-F.col("docs")).alias("d"), "h1", "h2") > F.struct(*[x.alias(n) for x, n in zip(bound, ("d", "h1", "h2"))]) if last else F.lit(True)
        parts = -(-(count - most) // shard_keys)
        tables = cut(shards_of(often.filter(after), parts))
        marked = docs.withColumn("th", F.xxhash64("text"))

        def dealt(batches):
            for b in unknown(batches, box.value, n, least, least_chars):
                pairs = np.stack([b.column(k).to_numpy().view(np.uint64) for k in (0, 1)], 1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shard_of(pairs, parts).astype(np.int32))], [*b.schema.names, "shard"])

        probes = marked.mapInArrow(dealt, "h1 long, h2 long, doc_id long, th long, nth long, shard int").withColumn("kind", F.lit(1))
        both = tables.withColumn("kind", F.lit(0)).unionByName(probes, allowMissingColumns=True)
        found = both.repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(lambda it: probe_tables(it, least), "doc_id long, th long, nth long")
        lists = cut(found.groupBy("doc_id", "th").agg(F.collect_set("nth").alias("gone"))).hint("merge").alias("g")
        d = marked.alias("d")
        gone = d.join(lists, F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("d.th") == F.col("g.th")), "left").select("d.doc_id", "d.text", "g.gone")
    return gone.mapInArrow(lambda it: kept_lines(it, box.value, n, least, least_chars), "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
