"""Language identification by Bayesian evidence fusion.

The posterior of a row's language multiplies
- the likelihood of its text: hashed byte trigrams under smoothed frequencies of each language, trained on a bounded sample of
  each declared language's rows; trigrams overlap, so a text counts as at most `evidence` independent ones,
- the likelihood of what it declares (a markup language attribute or a column): right with probability `trust`, if it names a known language,
- a prior for its place: everywhere, address suffix, domain, host - each level is smoothed with the one above by `kappa` pseudo-rows.
  The levels' counts are sums, by grouped aggregation over all rows, of the posterior from text and declaration alone, and a row's own
  share is taken off before its prior is formed.

Beside the known languages stands an unknown one, to which every trigram is alike. Its prior is one part of n + 1 everywhere, so that
neither a place nor the size of a table decides whether a text fits a known language. Known languages are smoothed towards it by
`SMOOTH` of their total, whatever that is: text of none of them is less likely under each than under the unknown one.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import cut
from ._text import LOWER, pieces, raw

BUCKETS = 1 << 16
SMOOTH = 0.1


def trigrams(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each trigram inside a row, white space as one kind, and the first of each row (one more than rows)."""
    x = buf.astype(np.uint32)
    if len(x) < 3:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    code = (x[:-2] << 16) | (x[1:-1] << 8) | x[2:]
    bucket = ((code * np.uint32(2654435769)) >> np.uint32(16)).astype(np.int64)
    inside = np.ones(len(buf), bool)
    for back in (1, 2):
        at = offsets[1:] - back
        inside[at[at >= 0]] = False
    size = np.maximum(np.diff(offsets) - 2, 0)
    return bucket[inside[: len(bucket)]], np.concatenate([[0], np.cumsum(size)])


def plain_bytes(column: pa.Array):
    data, offsets = raw(column)
    for i, j in pieces(offsets):
        buf = LOWER[data[offsets[i] : offsets[j]]]
        yield i, j, np.where((buf <= 0x20), np.uint8(0x20), buf), offsets[i : j + 1] - offsets[i]


def count_trigrams(batches):
    """lang, text -> lang, bucket, n."""
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        for i, j, buf, at in plain_bytes(batch.column(1)):
            b, first = trigrams(buf, at)
            who = np.repeat(langs[i:j], np.diff(first))
            for lang in set(langs[i:j]):
                totals[lang] = totals.get(lang, 0) + np.bincount(b[who == lang], minlength=BUCKETS)
    for lang, n in totals.items():
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(n[some])], ["lang", "bucket", "n"])


def train(rows: DataFrame, lang: Column, text: Column, most_rows: int = 20_000, key: Column | None = None, most_langs: int = 100) -> tuple[list[str], np.ndarray]:
    """Languages in order and log frequencies (language, bucket), the unknown language's last, from about `most_rows` rows of each
    language (all rows where it has fewer), chosen by the hash of their key. Known is every language that some row with a trigram has; of
    more than `most_langs` different tags, which bound the model, those with the most rows (ties by name)."""
    named = rows.select(
        lang.alias("lang"), F.coalesce(text, F.lit("")).alias("text"),
        (F.xxhash64(*([key] if key is not None else []), text) / F.lit(2.0**64) + 0.5).alias("u")
    ).filter("lang IS NOT NULL")
    rates = cut(rows.select(lang.alias("lang")).filter("lang IS NOT NULL").groupBy("lang").agg(
        F.count("*").alias("rows"), F.least(F.lit(1.0), F.lit(float(most_rows)) / F.count("*")).alias("rate")
    ).orderBy(F.desc("rows"), "lang").limit(most_langs).drop("rows"))
    named = named.join(rates, "lang")  # a table of its own, a row for each language, so that Spark knows its size
    found = named.filter(F.col("u") <= F.col("rate")).select("lang", "text").mapInArrow(count_trigrams, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(found["lang"].unique())
    n = np.zeros((len(langs), BUCKETS))
    np.add.at(n, (found["lang"].map({x: k for k, x in enumerate(langs)}).to_numpy(dtype=int), found["bucket"].to_numpy(dtype=int)), found["n"].to_numpy(dtype=float))
    known = (1 - SMOOTH) * n / n.sum(1, keepdims=True) + SMOOTH / BUCKETS
    return langs, np.log(np.concatenate([known, np.full((1, BUCKETS), 1 / BUCKETS)])).astype(np.float32)


def likelihoods(batches, model: np.ndarray, evidence: float):
    """All columns but the first, text, with ll (one number for each language) and letters in place of it."""
    letter = np.zeros(256, bool)
    letter[97:123] = True
    letter[128:] = True
    for batch in batches:
        ll = np.zeros((batch.num_rows, len(model)))
        letters = np.zeros(batch.num_rows, np.int64)
        for i, j, buf, at in plain_bytes(batch.column(0)):
            b, first = trigrams(buf, at)
            sizes = np.diff(first)
            full = np.flatnonzero(sizes)
            if len(full):
                weight = np.minimum(sizes[full], evidence) / sizes[full]
                for k in range(len(model)):
                    ll[i + full, k] = np.add.reduceat(model[k][b], first[full], dtype=np.float64) * weight
            some = np.flatnonzero(np.diff(at))
            if len(some):
                letters[i + some] = np.add.reduceat(letter[buf].astype(np.int64), at[some])
        values = pa.ListArray.from_arrays(np.arange(batch.num_rows + 1, dtype=np.int32) * len(model), pa.array(ll.ravel()))
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], values, pa.array(letters)], [*batch.schema.names[1:], "ll", "letters"])


def softmax(x: Column) -> Column:
    e = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def identify(
    rows: DataFrame, keep: list[str], text: Column, declared: Column, levels: list[Column], model: tuple[list[str], np.ndarray],
    trust: float = 0.9, kappa: float = 20.0, evidence: float = 40.0, least: float = 0.5,
) -> DataFrame:
    """The columns `keep` of each row with lang, confidence, text_lang, declared and accepted.

    levels go from the widest (an address suffix) to the narrowest (a host). lang is und, and the row not accepted, where the text has
    no letter, or the best known language has a posterior under `least` (the unknown language has the rest). text_lang is und where the
    text alone fits the unknown language best. Null texts are empty, null places are a place of their own, a null
    or unknown declaration is no evidence. Repeated rows are rows like any other; an empty table gives no rows.
    """
    langs, logs = model
    if not langs:
        return rows.select(
            *keep, F.lit("und").alias("lang"), F.lit(0.0).alias("confidence"), F.lit("und").alias("text_lang"), declared.alias("declared"),
            F.lit(False).alias("accepted")
        )
    places = [f"place_{k}" for k in range(len(levels))]
    box = rows.sparkSession.sparkContext.broadcast(logs)
    flat = rows.select(
        F.coalesce(text, F.lit("")).alias("_text"), *keep, declared.alias("declared"),
        *[F.coalesce(x.cast("string"), F.lit("")).alias(p) for x, p in zip(levels, places)]
    )
    types = {f.name: f.dataType.simpleString() for f in flat.schema}
    schema = ", ".join(f"`{c}` {types[c]}" for c in flat.columns[1:]) + ", ll array<double>, letters long"
    scored = flat.mapInArrow(lambda it: likelihoods(it, box.value, evidence), schema)
    n = len(langs)
    names = F.array(*map(F.lit, langs))
    wrong = (1 - trust) / max(1, n - 1)
    said = [F.when(
        F.coalesce(F.array_contains(names, F.col("declared")), F.lit(False)),
        F.when(F.col("declared") == x, math.log(trust)).otherwise(math.log(wrong))
    ).otherwise(0.0) for x in langs]
    said.append(F.when(F.coalesce(F.array_contains(names, F.col("declared")), F.lit(False)), math.log(wrong)).otherwise(0.0))  # the unknown language's
    scored = scored.withColumn("ll2", F.array(*[F.col("ll")[k] + said[k] for k in range(n + 1)]))
    first = cut(scored.withColumn("post", F.when(F.col("letters") > 0, F.slice(softmax(F.col("ll2")), 1, n)).otherwise(F.array_repeat(F.lit(0.0), n))))

    sums = [F.sum(F.col("post")[k]).alias(f"s{k}") for k in range(n)]
    out = first
    top = first.agg(*sums).first()  # one row, a number for each language
    out = out.withColumn("sum_top", F.array(*[F.lit(float(x or 0.0)) for x in top]))
    for p in places:
        out = out.join(cut(first.groupBy(p).agg(*sums).select(p, F.array(*[f"s{k}" for k in range(n)]).alias(f"sum_{p}"))), p)  # a table of its own, so that Spark can split the join's hot keys
    prior = F.array_repeat(F.lit(1.0 / n), n)
    for p in ["top", *places]:
        own = F.zip_with(f"sum_{p}", "post", lambda a, b: F.greatest(a - b, F.lit(0.0)))
        total = F.aggregate(own, F.lit(0.0), lambda s, y: s + y)
        out = out.withColumn("own", own).withColumn("total", total).withColumn(
            "prior", F.zip_with("own", prior if p == "top" else F.col("prior"), lambda a, q: (a + kappa * q) / (F.col("total") + kappa))
        )
    priors = F.concat(F.transform("prior", lambda q: q * (n / (n + 1))), F.array(F.lit(1 / (n + 1))))
    fused = F.slice(softmax(F.zip_with("ll2", priors, lambda a, q: a + F.log(q))), 1, n)
    classes = F.array(*map(F.lit, [*langs, "und"]))
    best = lambda x: classes[(F.array_position(x, F.array_max(x)) - 1).cast("int")]
    out = out.withColumn("fused", fused).withColumn("confidence", F.when(F.col("letters") > 0, F.round(F.array_max("fused"), 6)).otherwise(0.0))
    accepted = (F.col("letters") > 0) & (F.col("confidence") >= least)
    return out.select(
        *keep, F.when(accepted, best(F.col("fused"))).otherwise("und").alias("lang"), "confidence",
        F.when(F.col("letters") > 0, best(F.col("ll"))).otherwise("und").alias("text_lang"), "declared", accepted.alias("accepted")
    )


HIDDEN = {k: re.compile(rb"</%s\s*>" % k, re.I) for k in (b"script", b"style")}
OPENS = re.compile(rb"(script|style)\b", re.I)
ENTITY = re.compile(rb"&#?\w+;")
ROOT, SAYS = re.compile(rb"<html\b", re.I), re.compile(rb"\blang\s*=\s*[\"']?([a-z]{2,3})\b", re.I)


def visible(html: bytes) -> bytes:
    """What a page shows: without scripts, styles, comments, tags and entities. One pass: what is not closed once is not looked for again."""
    out, at, open_ = [], 0, {b"-->", *HIDDEN}
    while (start := html.find(b"<", at)) >= 0:
        end = -1
        if html.startswith(b"<!--", start):
            if b"-->" in open_:
                end = html.find(b"-->", start + 4) + 3
                if end < 3:
                    open_.discard(b"-->")
                    end = -1
        elif kind := OPENS.match(html, start + 1):
            name = kind[1].lower()
            if name in open_:
                close = HIDDEN[name].search(html, kind.end())
                end = close.end() if close else -1
                if not close:
                    open_.discard(name)
        if end < 0:
            end = html.find(b">", start) + 1
            if not end:
                break
        out += html[at:start], b" "
        at = end
    out.append(html[at:])
    return ENTITY.sub(b" ", b"".join(out))


def declared_language(html: bytes) -> bytes:
    """The lang of the first html tag that has one; each stretch up to a > is looked into once."""
    at = 0
    while at < len(html):
        end = html.find(b">", at)
        end = len(html) if end < 0 else end
        if (tag := ROOT.search(html, at, end)) and (says := SAYS.search(html, tag.end(), end)):
            return says[1].lower()
        at = end + 1
    return b""


def page_texts(batches):
    """page_id, host, html -> page_id, host, shown, declared."""
    for batch in batches:
        for low in range(0, batch.num_rows, 64):
            part = batch.slice(low, 64)
            pages = part.column(2).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), *(pa.array([f(x) for x in pages], pa.binary()).cast(pa.string()) for f in (visible, declared_language))],
                ["page_id", "host", "shown", "declared"]
            )


def identify_pages(pages: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **options) -> DataFrame:
    """Language of web pages from their visible text, the html element's lang, and the address: suffix, domain (last two labels) and host.
    Pages of any form take time in proportion to their length."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@]*@)?([^/:?#]*)", 1))
    labels = F.split("host", r"\.")
    raw_ = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = raw_.mapInArrow(page_texts, f"page_id {raw_.schema['page_id'].dataType.simpleString()}, host string, shown string, declared string")
    return identify(
        rows, ["page_id", "host"], F.col("shown"), F.col("declared"),
        [F.element_at(labels, -1), F.array_join(F.slice(labels, -F.least(F.lit(2), F.size(labels)), F.lit(2)), "."), F.col("host")], model, **options
    )


def identify_documents(
    docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text", declared_col: str = "lang",
    source_col: str = "source", **options
) -> DataFrame:
    """Language of documents from their text, the language they are said to have, and their source. key tells rows of one id apart."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(declared_col).alias("said"),
        F.col(source_col).alias("place")
    ).withColumn("key", F.xxhash64("text"))
    return identify(rows, ["doc_id", "key"], F.col("text"), F.col("said"), [F.col("place")], model, **options)
