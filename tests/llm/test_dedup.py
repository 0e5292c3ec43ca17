import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from cases import awkward, empty
from oracle import same

from tidemark.llm import embedding_dup, exact_dedup, near_dup, queries, substring_dup
from tidemark.llm._graph import components


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, duck, sf, name):
    same(spark, duck, sf, queries.queries()[name], queries.oracle_sql()[name])


@pytest.mark.parametrize("block", [4096, 16])
def test_exact_dedup(spark, block):
    df = awkward(spark)
    rows = [(r.doc_id, re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")) for r in df.collect()]
    groups = {}
    for i, t in rows:
        groups.setdefault(t, []).append(i)
    want = []
    for i, t in rows:
        ids = [x for x in groups[t] if x is not None]
        keep = min(ids) if ids else None
        want.append((i, keep, len(groups[t]), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    got = [tuple(r) for r in exact_dedup.exact_dedup(df, block_bytes=block).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


def test_exact_dedup_texts_of_equal_probes_differ(spark):
    base = "ab" * 4000
    texts = [base, base[:4001] + "X" + base[4002:], base, base[:77] + "Y" + base[78:]]
    got = {r.doc_id: r.keep_id for r in exact_dedup.exact_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), block_bytes=64).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 3}


def brute_jaccard(rows, t=0.8):
    def shingles(text):
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [(i, shingles(x)) for i, x in rows]
    links = [[b for b, (_, y) in enumerate(sets) if a != b and x and y and len(x & y) >= t * len(x | y) - 1e-9] for a, (_, x) in enumerate(sets)]
    first = [(i is None, i or 0, xxhash.xxh64_intdigest((x or "").encode(), 42)) for i, x in rows]
    first = [(n, i, h - (1 << 64) if h >> 63 else h) for n, i, h in first]
    root, before = list(first), None
    while root != before:
        before = list(root)
        for a, near in enumerate(links):
            root[a] = min([root[a], *(root[b] for b in near)])
    return sorted(((i, None if root[a][0] else root[a][1], len(links[a]), first[a] == root[a]) for a, (i, _) in enumerate(sets)), key=str)


@pytest.mark.parametrize("small,block", [(128, 512), (2, 4)])
def test_jaccard_join(spark, small, block):
    df = awkward(spark)
    random.seed(3)
    base = [f"w{k}" for k in range(60)]
    near = []
    for k in range(40):  # a large group of near copies of one text
        x = list(base)
        for _ in range(random.randint(0, 2)):
            x[random.randrange(60)] = f"z{random.randint(0, 9)}"
        near.append((1000 + k, " ".join(x)))
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()] + near
    both = df.select("doc_id", "text").unionByName(spark.createDataFrame(near, "doc_id long, text string"))
    got = near_dup.jaccard_join(both, small=small, block=block, recall=0.99999)
    assert sorted(((r.doc_id, r.class_id, r.n_links, r.kept) for r in got.collect()), key=str) == brute_jaccard(rows)
    assert near_dup.jaccard_join(empty(spark)).count() == 0


def test_jaccard_join_tells_rows_that_share_an_id_apart(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(1, a), (5, a + " x"), (5, b), (6, b + " y"), (None, b + " z"), (None, c), (None, c + " x"), (9, b), (9, b), (0, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.class_id, r.n_links, r.kept) for r in near_dup.jaccard_join(df).collect()), key=str)
    assert got == brute_jaccard(rows) and (6, 5, 4, False) in got and (5, 5, 4, True) in got and (5, 1, 1, False) in got


def test_embedding_dedup_tells_rows_that_share_an_id_apart(spark):
    u, v = [1.0] + [0.0] * 7, [0.0, 1.0] + [0.0] * 6
    rows = [(1, u, 0), (2, [1.0, 0.01] + [0.0] * 6, 0), (2, v, 0), (3, [0.01, 1.0] + [0.0] * 6, 0), (3, [0.0] * 7 + [1.0], 0)]
    got = embedding_dup.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, 1, True), (2, 1, 1, False), (2, 1, 2, True), (3, 0, 3, True), (3, 1, 2, False)]


def test_jaccard_takes_clashing_columns(spark):
    assert near_dup.jaccard_join(awkward(spark)).count() == awkward(spark).count()


def test_banding_reaches_its_recall():
    bands, rows = near_dup.banding(0.8, 0.9995)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9995


def test_components_of_long_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(60)] + [(500, k) for k in range(600, 640)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert {got[k] for k in range(61)} == {0} and {got[k] for k in [500, *range(600, 640)]} == {500}


def test_embedding_dedup(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(900):
        rows.append((k, rng.normal(size=16), int(k % 3)))
    centre = rng.normal(size=16)
    rows += [(2000 + k, centre + rng.normal(size=16) * 0.12, 1) for k in range(300)]  # one dense group, some of its pairs under the threshold
    rows += [(3000 + k, rows[k][1] * 2 + rng.normal(size=16) * 0.1, k % 3) for k in range(200)]
    rows += [(4000, rows[5][1], 2), (4000, rows[5][1], 2), (4001, rows[5][1], 2)]
    data = [(i, [float(v) for v in x], lab) for i, x, lab in rows]
    odd = [
        (5000, None, 1), (5001, [0.0] * 16, 1), (5002, [float("nan")] + [1.0] * 15, 1), (5003, [None] + [1.0] * 15, 1),
        (5004, [float("inf")] + [1.0] * 15, 1), (5005, data[0][1], None), (5006, [], 1), (5007, [1.0], 1), (None, data[0][1], 0)
    ]
    df = spark.createDataFrame(data + odd, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS rep", "2 AS emb", "3 AS copies")
    got = embedding_dup.embedding_dedup(df, block=64).collect()
    assert len(got) == len(data) + len(odd)
    x = np.array([v for _, v, _ in data])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    lab = np.array([c for *_, c in data])
    want = (unit @ unit.T >= 0.98) & (lab[:, None] == lab[None, :])
    np.fill_diagonal(want, False)
    n = {}
    for k, (i, *_) in enumerate(data):
        n[i] = int(want[k].sum())
    found = {r.vec_id: r.n_links for r in got if r.vec_id in n}
    assert all(found[i] <= n[i] for i in n)
    assert sum(found.values()) >= 0.97 * sum(n.values())
    assert all(r.n_links == 0 for r in got if r.vec_id is None or r.vec_id >= 5000)
    assert {r.vec_id for r in got if r.kept and r.vec_id and r.vec_id >= 5000} == set(range(5000, 5008))
    assert {r.component_id for r in got if r.vec_id in (4000, 4001)} == {min(r.component_id for r in got if r.vec_id == 5)}
    assert embedding_dup.embedding_dedup(df.filter("vec_id < 0")).count() == 0


def brute_spans(texts, length):
    seen = {}
    data = [(t or "").encode() for t in texts]
    for k, b in enumerate(data):
        for i in range(len(b) - length + 1):
            seen.setdefault(b[i : i + length], []).append((k, i))
    cover = [np.zeros(len(b), bool) for b in data]
    for places in seen.values():
        if len(places) > 1:
            for k, i in places:
                cover[k][i : i + length] = True
    return [
        (len(b), int(c.sum()), int((np.diff(np.concatenate([[0], c.astype(int)])) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~c])).hexdigest()) for b,
        c in zip(data, cover)
    ]


@pytest.mark.parametrize("shard", [256, 3])
def test_substring_dedup(spark, shard):
    random.seed(5)
    shared = ["".join(random.choice("abcdefghij ") for _ in range(random.randint(30, 90))) for _ in range(4)]
    texts = [" ".join(random.choice(["alpha", "be", "épsilon", "th"]) for _ in range(random.randint(0, 20))) + random.choice(shared) + str(random.random()) for _ in range(60)]
    texts += [texts[3], texts[3], "a" * 100, "ab" * 60, None, "", *(f"x{k}{shared[0]}y{k}" for k in range(30))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS h", "2 AS fp")
    got = substring_dup.substring_dedup(df, length=24, gram=6, shard=shard).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == brute_spans(texts, 24)


def test_substring_dedup_of_periodic_texts(spark):
    import pyarrow as pa

    texts = ["a" * 60_000, "ab" * 30_000 + "c", "the cat " * 4000, "a" * 500, "b" + "a" * 420 + "b", "z" * 399, "z" * 400, "y" * 401]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for shard_bytes in (1 << 20, 20_000):
        got = substring_dup.substring_dedup(df, shard_bytes=shard_bytes).orderBy("doc_id").collect()
        assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == brute_spans(texts, 400)
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array(["a" * 200_000])], ["doc_id", "th", "text"])
    assert sum(b.num_rows for b in substring_dup.all_runs([batch], 400, 64)) == 1
    big = spark.createDataFrame([(1, "a" * 5_000_000), (2, "\n" * 300_000)], "doc_id long, text string")
    assert [(r.n_removed, r.n_spans) for r in substring_dup.substring_dedup(big).orderBy("doc_id").collect()] == [(5_000_000, 1), (300_000, 1)]


def test_substring_dedup_tells_rows_without_id_apart(spark):
    rows = spark.range(70_000).selectExpr("CASE WHEN id < 2 THEN id END AS doc_id", "concat(sha2(string(id), 256), if(id % 7 = 0, ' and these are shared', '')) AS text")
    got = substring_dup.substring_dedup(rows, length=12, gram=4)
    n = got.groupBy("n_bytes").agg(F.sum((F.col("n_removed") >= 17).cast("long")).alias("some"), F.count("*").alias("rows")).collect()
    assert {(r.n_bytes, r.some, r.rows) for r in n if r.n_bytes > 64} == {(85, 10_000, 10_000)} and all(r.some == 0 for r in n if r.n_bytes == 64)


def test_substring_dedup_of_awkward_rows(spark):
    df = awkward(spark)
    rows = df.collect()
    want = sorted(zip([str(r.doc_id) for r in rows], brute_spans([r.text for r in rows], 400)))
    got = substring_dup.substring_dedup(df).collect()
    assert sorted((str(r.doc_id), (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in got) == want
    assert substring_dup.substring_dedup(empty(spark)).count() == 0


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 50, 300):
        for kinds in (1, 2, 4):
            t = rng.integers(0, kinds, n).astype(np.uint8)
            b = t.tobytes()
            sa, key = substring_dup.suffix_array(t)
            assert sa.tolist() == sorted(range(n), key=lambda i: b[i:])
            common = substring_dup.common_prefixes(t, sa, key)
            for p, q in zip(sa[1:], sa[:-1]):
                k = 0
                while p + k < n and q + k < n and b[p + k] == b[q + k]:
                    k += 1
                assert common[p] == k


def test_long_row_is_cut_into_segments(monkeypatch):
    import pyarrow as pa

    rng = random.Random(1)
    text = "".join(rng.choice("abc") for _ in range(3000))
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2], pa.int32()), pa.array([text])], ["doc_id", "th", "text"])

    def places(segment):
        monkeypatch.setattr(substring_dup, "SEGMENT", segment)
        found = {}
        for b in substring_dup.all_runs([batch], 40, 8):
            for r in b.to_pylist():
                for k in range(r["n"]):
                    found[r["s0"] + k] = r["h"]
        return found

    assert places(1 << 22) == places(700) and len(places(700)) == 3000 - 39


def test_rows_that_need_not_be_shuffled_are_told_by_a_bitmap(spark):
    from tidemark.llm._spark import perhaps_in

    df = spark.range(30_000).select("id", F.when(F.col("id") % 5 > 0, F.col("id").cast("string")).alias("k"))
    few = df.filter("id % 7 = 0").localCheckpoint()
    for most in (4096, 3):  # three bitmaps are too few for one in 64, but no row of few may be missed
        got, perhaps = perhaps_in(df, few, ["id", "k"], most)
        assert got.columns == ["id", "k", "_perhaps"] and got.count() == 30_000
        assert got.filter(perhaps).filter("id % 7 = 0").count() == few.count()
        if most == 4096:
            assert got.filter(perhaps).filter("id % 7 > 0").count() < 30_000 / 30
    nothing, perhaps = perhaps_in(df, few.filter("id < 0"), ["id", "k"])
    assert nothing.filter(~perhaps).count() == 30_000
