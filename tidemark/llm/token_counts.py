"""Token counts, huge documents by overlap resynchronisation.

A document of more than `huge` characters is cut into chunks that overlap and are encoded in different tasks, with offsets. Where two
chunks overlap, a place is a proven boundary if a token starts there in both encodings and a white-space character stands before it:
the tokenizer drops white space and encodes what stands between independently, so neither the cut before it nor the one after it can
change what follows. Chunks are spliced at the first such place. A document with an overlap that has none is encoded again with an
overlap eight times as wide, until every seam is found (the end of a document is always one).

Shorter documents are encoded word by word for the same reason, each distinct word of a worker once.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import cut
from ._text import pieces, raw
from ._tokens import counted, tokenizer

BLANK = frozenset(" \t\n\r\x0b\x0c")
#: str.split() takes the first four for white space, the tokenizer does not; special strings and the mark between words are left to the library.
ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "\x01", "<|")


def count_words(texts: list[str], file: str) -> list[int]:
    cache = counted(file)
    whole = {k for k, t in enumerate(texts) if any(c in t for c in ODD)}
    split = [[] if k in whole else t.split() for k, t in enumerate(texts)]
    cache.learn(set().union(*split))
    out = [sum(map(cache.__getitem__, ws)) for ws in split]
    for k in whole:
        out[k] = len(tokenizer(file).encode(texts[k], add_special_tokens=False).ids)
    return out


def count_short(batches, file: str):
    for batch in batches:
        column = batch.column("text")
        counts: list[int] = []
        for i, j in pieces(raw(column)[1], 2 << 20):
            counts += count_words(column.slice(i, j - i).to_pylist(), file)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])


def chunked(frames, chunk: int, overlap: int):
    for frame in frames:
        for key, text in zip(frame["key"], frame["text"]):
            n = max(1, -(-len(text) // chunk))
            for at in range(0, n, 64):
                nos = range(at, min(n, at + 64))
                yield pd.DataFrame({"key": key, "no": list(nos), "n": n, "whole": len(text), "text": [text[k * chunk : (k + 1) * chunk + overlap] for k in nos]})


def boundaries(frames, file: str, chunk: int, overlap: int):
    """Per chunk: total tokens; proven boundaries in the overlap with the chunk before and with the one after, as places in the document, with the tokens of this chunk before them."""
    for frame in frames:
        out = []
        for r in frame.itertuples(index=False):
            starts = [s for s, _ in tokenizer(file).encode(r.text, add_special_tokens=False).offsets]
            base, end = r.no * chunk, r.no * chunk + len(r.text)
            sides = []
            for low, to in ((base, base + overlap), (base + chunk, base + chunk + overlap)):
                at, upto = [], []
                for k, s in enumerate(starts):
                    if low < base + s < to and s and r.text[s - 1] in BLANK and (not at or at[-1] != base + s):
                        at.append(base + s), upto.append(k)
                if low < r.whole <= to and end == r.whole:
                    at.append(r.whole), upto.append(len(starts))
                sides += [at, upto]
            out.append((r.key, r.no, r.n, len(starts), *sides))
        yield pd.DataFrame(out, columns=["key", "no", "n", "total", "left_at", "left_upto", "right_at", "right_upto"])


def count_huge(texts: DataFrame, file: str, chunk: int, overlap: int) -> DataFrame:
    """(key, n_tokens) of distinct texts (key, text)."""
    found, w = [], Window.partitionBy("key").orderBy("no")
    while True:
        rows = (
            texts.mapInPandas(lambda it, c=chunk, o=overlap: chunked(it, c, o), "key string, no int, n int, whole long, text string").repartition("key", "no")
            .mapInPandas(
                lambda it, c=chunk, o=overlap: boundaries(it, file, c, o),
                "key string, no int, n int, total long, left_at array<long>, left_upto array<long>, right_at array<long>, right_upto array<long>"
            )
            .withColumn("seam", F.array_min(F.array_intersect("right_at", F.lead("left_at").over(w))))
            .withColumn("before", F.lag("seam").over(w))
        )
        here = lambda at, upto, place: F.element_at(upto, F.array_position(F.col(at), F.col(place)).cast("int"))
        first = F.when(F.col("no") == 0, F.lit(0)).otherwise(here("left_at", "left_upto", "before"))
        last = F.when(F.col("no") == F.col("n") - 1, F.col("total")).otherwise(here("right_at", "right_upto", "seam"))
        ready = (F.col("no") == F.col("n") - 1) | F.col("seam").isNotNull()
        done = cut(rows.withColumn("ready", ready & ((F.col("no") == 0) | F.col("before").isNotNull())).groupBy("key").agg(
            F.bool_and("ready").alias("ready"), F.sum(F.when(F.col("ready"), last - first)).alias("n_tokens")
        ))
        found.append(done.filter("ready").select("key", "n_tokens"))
        if not done.filter("NOT ready").limit(1).count():
            break
        texts, overlap = cut(texts.join(done.filter("NOT ready").select("key"), "key", "left_semi")), overlap * 8
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def token_counts(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", file: str = "word_bpe_49k.json", limit: int = 2048,
    huge: int = 32_768, chunk: int = 16_384, overlap: int = 512,
) -> DataFrame:
    """One row per row of df: doc_id, n_bytes, n_tokens, over_limit.

    Null text is empty and has no tokens. Counts are those of the library for the whole text, without added special tokens; special
    strings in a text are handled as the library does by default. Null ids and repeated rows are returned as they are. Other columns
    are not read. The tokenizer must drop white space and encode the words between independently, as word_bpe_49k.json does.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    short = rows.filter(F.char_length("text") <= huge).mapInArrow(lambda it: count_short(it, file), f"doc_id {kind}, n_bytes long, n_tokens long")
    large = rows.filter(F.char_length("text") > huge).withColumn("key", F.sha2("text", 256))
    counts = count_huge(cut(large.select("key", "text").dropDuplicates(["key"])), file, chunk, overlap)
    out = short.unionByName(large.select("key", "doc_id", "n_bytes").join(counts, "key").drop("key"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
