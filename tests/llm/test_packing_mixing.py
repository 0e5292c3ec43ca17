import zlib

import numpy as np
import pytest
from cases import awkward, empty

from tidemark.llm import mixing, packing, token_counts
from tidemark.llm._tokens import encoded, tokenizer

SPECIAL = [
    "<|endoftext|> hi <|startoftext|>x", "a  b   c\n\n d\t e ", " lead and trail ", "x  y  z", "don't we'll\r\nI'M", "\x1c a\x1fb \x01 c",
    "日本語 テキスト  です", "É̈ ΟΔΟΣ", "a <|endoftext|>", " ", "\n", "1234 5.6-7"
]


def test_encoding_by_stretches_is_the_librarys():
    import pyarrow as pa

    from tidemark.llm._text import raw

    texts = SPECIAL + ["", "plain words again and again"]
    buf, at = raw(pa.array(texts))
    for _ in range(2):  # from the cache, too
        ids, counts = encoded("byte_bpe_50k.json")(buf, at)
        got = np.split(ids, np.cumsum(counts)[:-1])
        assert [g.tolist() for g in got] == [tokenizer("byte_bpe_50k.json").encode(t, add_special_tokens=False).ids for t in texts]


def test_pack_is_a_round_trip_with_little_padding(spark):
    df = awkward(spark).unionByName(
        spark.createDataFrame([(600 + k, t) for k, t in enumerate(SPECIAL)], "doc_id long, text string"), allowMissingColumns=True
    ).coalesce(2)
    texts = {}
    for r in df.collect():
        texts.setdefault(r.doc_id, []).append(np.array([*tokenizer("byte_bpe_50k.json").encode(r.text or "", add_special_tokens=False).ids, 0], "<u4"))
    got = packing.pack(df, most=3000).toPandas()
    for i, docs in texts.items():
        rows = got[got.doc_id.isna()] if i is None else got[got.doc_id == i]
        pieces = sorted(zip(rows.doc_tokens, rows.start, rows.length, rows.ids_crc32))
        want = []
        for n, start, length, _ in pieces:
            want.append({zlib.crc32(d[start : start + length].tobytes()) for d in docs if len(d) == n})
        assert all(p[3] in w for p, w in zip(pieces, want))
        assert rows.length.sum() == sum(map(len, docs))
        if len(docs) == 1:
            assert np.array_equal(np.cumsum([0, *(p[2] for p in pieces)])[:-1], [p[1] for p in pieces])
    padding = 0
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert (s.offset.to_numpy() == np.cumsum([0, *s.length])[:-1]).all() and s.length.sum() <= 1024
        n = int(s.length.sum())
        padding += 0 if n & (n - 1) == 0 else 1024 - n
    assert packing.pack(empty(spark)).count() == 0


def test_best_cuts_cost_what_an_exhaustive_search_finds():
    rng = np.random.default_rng(0)
    for _ in range(30):
        places = np.concatenate([[0], np.cumsum(rng.integers(1, 9, 25))]).tolist()
        penalties = [0.0, *rng.integers(0, 4, 25).astype(float)]
        cost = lambda path: sum(penalties[b] + (0 if places[b] - places[a] in (8, 16) else 16 - (places[b] - places[a])) for a, b in zip(path, path[1:]))  # noqa: B023,E731
        best = {0: 0.0}
        for b in range(1, 26):
            best[b] = min(best[a] + cost([a, b]) for a in best if places[b] - places[a] <= 16)
        assert abs(cost(packing.best_cuts(places, penalties, 16, (8,))) - best[25]) < 1e-9


@pytest.mark.parametrize("kw", [{}, {"huge": 40, "chunk": 32, "overlap": 8}])
def test_token_counts(spark, kw):
    df = awkward(spark).select("doc_id", "text").unionByName(spark.createDataFrame(
        [(600 + k, t) for k, t in enumerate([*SPECIAL, "a b " * 300 + "y" * 500 + " tail"])], "doc_id long, text string"
    ))
    t = tokenizer("word_bpe_49k.json")
    want = sorted((str(r.doc_id), len((r.text or "").encode()), len(t.encode(r.text or "", add_special_tokens=False).ids)) for r in df.collect())
    got = token_counts.token_counts(df, **kw).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got)
    assert token_counts.token_counts(empty(spark)).count() == 0


def brute_targets(sizes, weights=(1, 2, 3), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    capped, total = set(), sum(sizes.values())
    while True:
        left = total - sum(cap * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        t = {s: left * w[s] / sum(w[x] for x in free) for s in free} | {s: cap * sizes[s] for s in capped}
        over = {s for s in free if t[s] > cap * sizes[s] + 1e-9}
        if not over:
            return t
        capped |= over


def test_mixing(spark):
    rng = np.random.default_rng(2)
    rows = [
        (k, " ".join(["w"] * int(n)), s) for k,
        (n, s) in enumerate(zip(rng.lognormal(3, 1, 1500).astype(int), rng.choice(["a", "b", "c", "ä", None, "tiny"], 1500, p=[0.4, 0.1, 0.2, 0.2, 0.095, 0.005])))
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS size", "2 AS target", "3 AS skey")
    got = mixing.mix_sources(df).toPandas()
    again = mixing.mix_sources(df.repartition(5)).toPandas()
    assert got.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = brute_targets(sizes)
    assert len(got) == len(rows) and ((got.taken % got["size"].clip(lower=1)) == 0).all() and (got.taken <= 3 * got["size"]).all()
    for s, g in got.groupby(got.source.fillna("null")):
        name = None if s == "null" else s
        assert abs(g.target.iloc[0] - want[name]) < 1e-6 and g.source_size.iloc[0] == sizes[name]
        assert abs(g.taken.sum() - want[name]) <= max(10, 0.01 * want[name])


def test_rates_are_those_of_an_independent_solution(spark):
    rng = np.random.default_rng(5)
    rows = [
        (k, " ".join(["w"] * int(n)), s) for k,
        (n, s) in enumerate(zip(rng.lognormal(2.5, 0.8, 900).astype(int) + 1, rng.choice(["a", "b", "c", "d"], 900, p=[0.6, 0.2, 0.15, 0.05])))
    ]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    for source, g in got.groupby("source"):
        size, target = g["size"].to_numpy(float), g.target.iloc[0]
        low, high = -100.0, 100.0
        for _ in range(200):  # bisection: the words grow with the tilt
            tilt = (low + high) / 2
            words = (np.minimum(3, np.exp(np.minimum(tilt * size / size.mean(), 50))) * size).sum()
            low, high = (tilt, high) if words < target else (low, tilt)
        want = np.minimum(3, np.exp(np.minimum(low * size / size.mean(), 50)))
        if target < 3 * size.sum() * (1 - 1e-9):
            assert np.abs(g.rate - want).max() < 1e-3
        assert (np.abs(g.copies - g.rate) >= 1 + 1e-6).sum() <= 4  # rounded up or down, but for a few repairs
        assert abs(g.taken.sum() - target) <= size.min() + 2  # repairs bring a source to within its shortest document


def test_mixing_of_awkward_rows(spark):
    df = awkward(spark)
    got = mixing.mix_sources(df).toPandas()
    assert len(got) == df.count() and (got[got["size"] == 0].taken == 0).all()
    assert mixing.mix_sources(empty(spark)).count() == 0
    none = mixing.mix_sources(spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")).collect()
    assert all(r.taken == 0 and r.target == 0 for r in none)
