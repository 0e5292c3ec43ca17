"""Whitening, line dedup and collocations against plain Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from cases import awkward, empty

from tidemark.llm import line_dedup, phrases, whitening

LOWER = {c: c + 32 for c in range(65, 91)}


def brute_lines(rows, least=3, chars=20):
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    held = defaultdict(list)
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= chars:
                held[k].append(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = []
        for x in lines:
            own = held.get(key(x), [])
            ids = [j for j in own if j is not None]
            if len(own) < least or i == (max(ids) if ids else None):
                kept.append(x)
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def lined(spark):
    r = random.Random(5)
    pool = [f"  A line of {w} that Many share\t" for w in "stone river élan winter light harbour garden".split()] + ["short one", "ÄÖÜ" * 6 + "xy", "ÄÖÜ" * 6 + "x"]
    rows = [(k, "\n".join([*r.choices(pool, k=r.randint(0, 6)), f"line {k} of its own, long enough", *r.choices(pool, k=2)])) for k in range(60)]
    rows += [(7, rows[7][1]), (None, rows[3][1]), (None, rows[3][1].lower()), (99, "\r\n".join(pool)), (98, None), (97, ""), (96, "\n\n")]
    rows += [(None, "only rows without an id hold it")] * 4 + [(500, "x" * 3_000_000 + "\n" + pool[0]), (501, "\n" * 300_000 + pool[1])]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("most,shard_keys", [(1 << 20, 1 << 17), (1 << 20, 2), (3, 2), (1, 1), (0, 4)])
def test_line_dedup(spark, most, shard_keys):
    rows, df = lined(spark)
    got = sorted((tuple(r) for r in line_dedup.line_dedup(df.repartition(5), most=most, shard_keys=shard_keys).collect()), key=str)
    assert got == brute_lines(rows)
    assert sum(r[2] for r in got) > 100


def test_line_dedup_takes_awkward_tables(spark):
    df = awkward(spark)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert sorted((tuple(r) for r in line_dedup.line_dedup(df).collect()), key=str) == brute_lines(rows)
    assert line_dedup.line_dedup(empty(spark)).count() == 0


def test_perfect_hash_is_minimal_and_knows_its_own():
    r = np.random.default_rng(1)
    pairs = r.integers(0, 1 << 63, (20_000, 2)).astype(np.uint64)
    pairs[::7, 0] = pairs[0, 0]  # one half alike
    h = line_dedup.PerfectHash.of(pairs)
    assert sorted(h.places(pairs)) == list(range(len(pairs)))
    assert 64 * len(h.words) < 5 * len(pairs)
    assert len(line_dedup.PerfectHash.of(pairs[:0]).places(pairs)) == len(pairs)


def brute_phrases(rows, support, top=2000):
    n, f = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for m in range(1, 6):
                for i in range(len(w) - m + 1):
                    f[lang or "und", tuple(w[i : i + m])] += 1
    often = {k: c for k, c in f.items() if c >= support}
    hidden = set()
    for (lang, w), c in often.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                if c >= often[lang, w[i : i + m]]:
                    hidden.add((lang, w[i : i + m]))
    found = defaultdict(list)
    for (lang, w), a in often.items():
        if len(w) > 1 and (lang, w) not in hidden:
            cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            found[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, rank, p.decode(), -a, lo, r, n[lang], -s) for lang, rows in found.items() for rank, (s, a, p, lo, r) in enumerate(sorted(rows)[:top], 1))


@pytest.mark.parametrize("shards,log_bits,most", [(1, 26, 1 << 22), (4, 26, 100), (50, 15, 1 << 22), (7, 15, 5000)])
def test_collocations(spark, monkeypatch, shards, log_bits, most):
    r = random.Random(9)
    vocabulary = "the of a river stone New York élan winter, go! seven light harbour is new york city".split()
    rows = [(
        r.choice(["en", "en", "fr", None]), "  ".join(r.choices(vocabulary, k=r.randint(0, 60))) + r.choice([".", "\n", "\tin new york city today;"])
    ) for _ in range(300)]
    rows += [("en", None), ("en", ""), (None, "?!"), ("zz", "once only")]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    monkeypatch.setattr(phrases.grouped, "__defaults__", (most,))
    got = sorted(tuple(x) for x in phrases.collocations(df, support=20, shards=shards, shard=F.col("text"), log_bits=log_bits).collect())
    want = brute_phrases(rows, 20)
    assert got == want and len({x[0] for x in want}) == 3
    assert sorted(tuple(x) for x in phrases.collocations(df, support=20, top=5).collect()) == brute_phrases(rows, 20, 5)


def test_collocations_take_awkward_tables(spark):
    df = awkward(spark)
    assert sorted(tuple(x) for x in phrases.collocations(df, support=6).collect()) == brute_phrases([(r.lang, r.text) for r in df.collect()], 6)
    assert phrases.collocations(empty(spark)).count() == 0


def test_collocations_of_texts_longer_than_a_stretch(spark, monkeypatch):
    monkeypatch.setattr(phrases, "PART", 64)
    rows = [("en", " ".join(f"w{(k * k) % 7}" for k in range(400)) + ". " + "tick tock! " * 300 + "x" * 500), ("en", "tick tock " * 50)]
    words = sum(
        len(h) for batch in [phrases.pa.RecordBatch.from_arrays([phrases.pa.array(x) for x in zip(*rows)], ["lang", "text"])] for *_, h, _, _,
        _ in phrases.texts([batch])
    )
    assert words == sum(len(re.findall(r"[^ .!]+", t)) for _, t in rows)
    df = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(tuple(x) for x in phrases.collocations(df, support=30).collect()) == brute_phrases(rows, 30)


def plain_whitening(vectors, k=4):
    x = np.unique(np.floor(256 * np.array(vectors, float)).astype(np.int64), axis=0)
    c = x - x.mean(0)
    values, q = np.linalg.eigh(c.T @ c / len(x))
    return x, values[::-1][:k], q[:, ::-1][:, :k], values.sum()


def check_whitening(got, rows, k=4):
    """got: the rows of whiten(); rows: (vec_id, vector) that it should use."""
    x, values, q, trace = plain_whitening([v for _, v in rows])
    n, s = len(x), [int(t) for t in x.sum(0)]
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {})[r.component] = r
        assert r.identity_error <= 1e-9 and r.n == n
    assert sorted(by) == sorted(i for i, _ in rows) and all(sorted(v) == list(range(1, k + 1)) for v in by.values())
    ids = [i for i, _ in rows]
    own = np.floor(256 * np.array([v for _, v in rows], float)).astype(np.int64)
    for i, v in zip(ids, own):
        assert by[i][1].deviation == sum((n * int(a) - b) ** 2 for a, b in zip(v, s))
    for j in range(k):
        w = np.array([by[i][j + 1].whitened for i in ids])
        want = (own - x.mean(0)) @ q[:, j] / np.sqrt(values[j])
        sign = np.sign(w @ want)
        assert np.abs(w * sign - want).max() < 1e-6
        assert abs(by[ids[0]][j + 1].explained / (values[j] / trace) - 1) < 1e-9


def test_whitening_equals_an_eigendecomposition(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    check_whitening(whitening.whiten(df, block=12).collect(), rows)
    check_whitening(whitening.whiten(df).collect(), rows)


def test_whitening_takes_awkward_tables(spark):
    r = np.random.default_rng(3)
    good = [(k, (r.standard_normal(6) * [5, 4, 3, 2, 1, 0]).tolist()) for k in range(50)]
    good += [(k + 100, v) for k, v in good[:20]]  # equal vectors are fitted once
    bad = [(900, None), (901, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (902, [1.0, float("nan"), 2.0, 3.0, 4.0, 5.0]), (903, [float("-inf")] * 6)]
    schema = "vec_id long, embedding array<double>, x string, n string"
    df = spark.createDataFrame([(i, v, "x", "n") for i, v in good + bad], schema)
    check_whitening(whitening.whiten(df).collect(), good)
    check_whitening(whitening.whiten(df, block=5).collect(), good)
    assert whitening.whiten(df.filter("vec_id >= 900")).count() == 0
    same = spark.createDataFrame([(1, [1.0, 2.0], "", ""), (2, [1.0, 2.0], "", "")], schema)
    assert whitening.whiten(same).count() == 0
    flat = spark.createDataFrame([(k, [float(k), 0.0], "", "") for k in range(5)] + [(None, [1.0], "", "")], schema)  # one direction, a short vector, a null id
    assert {(x.vec_id, x.component) for x in whitening.whiten(flat).collect()} == {(k, 1) for k in (0, 1, 2, 3, 4, None)}
    huge = spark.createDataFrame([(1, [1e300, 0.0], "", ""), (2, [-1e300, 1.0], "", "")], schema)
    assert [x.deviation for x in whitening.whiten(huge).collect()] == [None, None]
