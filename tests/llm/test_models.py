import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from cases import awkward, empty
from pyspark.sql import functions as F

from tidemark.llm import language_id, lm_score, quality
from tidemark.llm._text import LOWER


def lower(t):
    return bytes(LOWER[np.frombuffer((t or "").encode(), np.uint8)])


def brute_lm(docs, order):
    def symbols(t):
        return [257] * order + list(lower(t)) + [256]

    def tokens(t):
        return [w for w in re.split(rb"[\x20\x09-\x0d]+", lower(t)) if w] + [None]

    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    counts, vocabulary = collections.defaultdict(collections.Counter), collections.Counter()
    for i, t in docs:
        if not held(i):
            s = symbols(t)
            vocabulary.update(tokens(t))
            for p in range(order, len(s)):
                for k in range(order + 1):
                    counts[tuple(s[p - k : p])][s[p]] += 1
    n, v = sum(vocabulary.values()), len(vocabulary)
    out = []
    for i, t in docs:
        s, total = symbols(t), 0.0
        for p in range(order, len(s)):
            excluded = set()
            for k in range(order, -1, -1):
                seen = counts.get(tuple(s[p - k : p]), {})
                if not seen:
                    continue
                rest = 2 * sum(seen.values()) - sum(2 * b - 1 for a, b in seen.items() if a in excluded)
                if s[p] in seen and s[p] not in excluded:
                    total += math.log10((2 * seen[s[p]] - 1) / rest)
                    break
                total += math.log10(len(seen) / rest)
                excluded |= set(seen)
            else:
                total -= math.log10(257 - len(excluded))
        w = tokens(t)
        out.append((
            str(i), held(i), len(w), sum(vocabulary[x] > 0 for x in w), n,
            round(sum(math.log10((vocabulary[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 4), round(total, 4)
        ))
    return sorted(out)


@pytest.mark.parametrize("order,most_words", [(2, 1 << 20), (6, 30)])
def test_lm_scores(spark, order, most_words):
    df = awkward(spark).filter("text IS NULL OR length(text) < 5000")
    got = lm_score.lm_scores(df, order=order, most_words=most_words).collect()
    assert sorted((
        str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), round(r.score, 4)
    ) for r in got) == brute_lm([(r.doc_id, r.text) for r in df.collect()], order)
    assert lm_score.lm_scores(empty(spark)).count() == 0


@pytest.mark.parametrize("order,most_nodes", [(3, 0), (6, 40)])
def test_lm_scores_do_not_depend_on_what_tasks_get(spark, order, most_nodes):
    df = awkward(spark).filter("text IS NULL OR length(text) < 5000")
    got = lm_score.lm_scores(df, order=order, most_nodes=most_nodes, most_words=30).collect()
    assert sorted((
        str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), round(r.score, 4)
    ) for r in got) == brute_lm([(r.doc_id, r.text) for r in df.collect()], order)


def test_frequent_never_exceeds_its_bound(spark):
    counts = spark.createDataFrame([(70_000,)] * 50 + [(1 << 40,)] * 2 + [(3,)] * 5, "n long")
    for most, kept in ((1, 0), (3, 2), (51, 2), (52, 52), (56, 52), (57, 57)):
        assert counts.filter(F.col("n") >= lm_score.frequent(counts, most)).count() == kept


def test_lm_without_training_rows_is_uniform(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:2]
    got = lm_score.lm_scores(spark.createDataFrame([(i, "abc") for i in held], "doc_id long, text string")).collect()
    assert all(abs(r.score + 4 * math.log10(257)) < 1e-9 and r.n_known == 0 for r in got)


def test_pruned_trie_is_still_a_distribution():
    text = "abracadabra abracadabra " * 3
    buf, at = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)])
    keys, n = lm_score.tally(lm_score.grams(buf, at, 3)[0])
    levels = [(keys, n)]
    for k in range(2, -1, -1):
        levels.append(lm_score.tally(levels[-1][0] & np.uint64((1 << 9 * (k + 1)) - 1), levels[-1][1]))
    trie = lm_score.Trie([(k[c >= 3], c[c >= 3]) for k, c in levels[::-1]], 1, len(text) + 1)
    for context in ("abr", "cad", "zzz", "a a"):
        base = sum(b << (9 * (3 - k)) for k, b in enumerate(context.encode()))
        probabilities = 10 ** trie.scores(np.array([base | s for s in range(257)], np.uint64))
        assert abs(probabilities.sum() - 1) < 1e-9


def test_lm_beats_words_on_held_out_documents(spark):
    got = lm_score.lm_scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return language_id.train(docs.filter("doc_id % 2 = 0"), F.col("lang"), F.col("text"), key=F.col("doc_id"))


def test_language_of_documents_not_trained_on(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("doc_id % 2 = 1")
    blind = language_id.identify_documents(docs.withColumn("true", F.col("lang")).withColumn("lang", F.lit(None).cast("string")), model)
    right = blind.join(docs.select("doc_id", F.col("lang").alias("true")), "doc_id").agg(F.avg((F.col("lang") == F.col("true")).cast("double"))).first()[0]
    assert right > 0.97


def test_pages(spark, model, sf):
    got = language_id.identify_pages(spark.read.parquet(f"{sf}/pages.parquet"), model)
    assert got.filter("lang = declared").count() >= 0.95 * got.count()
    odd = spark.createDataFrame(
        [
            (1, None, None), (2, "", ""), (3, "no address", "<p>the of and with from that this</p>"),
            (None, "https://u@h.example.fr:80/x", "<html lang='de'><script>the and of</script>")
        ],
        "page_id long, url string, html string"
    ).selectExpr("*", "1 AS host", "2 AS ll")
    rows = {r.page_id: r for r in language_id.identify_pages(odd, model).collect()}
    assert rows[1].lang == rows[2].lang == "und" and not rows[1].accepted and rows[3].lang == "en" and rows[None].host == "h.example.fr" and rows[None].declared == "de"


def test_hostile_pages_take_time_in_proportion():
    import time

    for part in ("<", "<!--", "<script", "<style>", "<html", "<html lang ", "</script ", "&a", "<!-- -->", "<b>", "lang="):
        page = (part * (5_000_000 // len(part))).encode()
        start = time.perf_counter()
        language_id.visible(page), language_id.declared_language(page)
        assert time.perf_counter() - start < 10, part


def test_visible_equals_a_plain_pattern():
    r = random.Random(4)
    parts = [
        "<", ">", "<!--", "-->", "<script>", "</script>", "</SCRIPT >", "<style x>", "</style>", "<scripts>", "<p a='b'>", "text", "&amp;", "&#12;",
        " ", "<html lang=fr>", "<HTML class=x LANG = 'De-at'>", "é"
    ]
    for _ in range(3000):
        page = "".join(r.choices(parts, k=r.randint(0, 14)))
        want = re.sub(r"&#?[A-Za-z0-9_]+;", " ", re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ", page))
        assert language_id.visible(page.encode()).decode() == want
        says = re.search(r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})\b", page)
        assert language_id.declared_language(page.encode()).decode() == (says[1].lower() if says else "")


def test_many_dirty_tags_bound_the_model(spark):
    rows = spark.range(400).selectExpr("id", "if(id < 300, if(id < 200, 'en', 'fr'), concat('tag', id)) AS lang", "'the of and with from that this' AS text")
    langs, logs = language_id.train(rows, F.col("lang"), F.col("text"), key=F.col("id"), most_langs=4)
    assert langs == ["en", "fr", "tag300", "tag301"] and len(logs) == 5


def test_host_prior_decides_where_the_text_does_not(spark, model):
    known = [(k, "http://h.example.com/a", f"<html><p>{w}</p></html>") for k, w in enumerate(["der die und nicht mit für eine"] * 30)]
    rows = known + [(99, "http://h.example.com/b", "<p>in</p>"), (98, "http://other.example.net/", "<p>in</p>")]
    got = {r.page_id: r for r in language_id.identify_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), model).collect()}
    assert got[99].lang == "de" and got[99].confidence > got[98].confidence - 1e-9


def test_awkward_documents_have_a_language_row(spark, model):
    df = awkward(spark)
    got = language_id.identify_documents(df, model).collect()
    assert len(got) == df.count() and {r.lang for r in got if r.doc_id in (300, 301, 302)} == {"und"}
    assert language_id.identify_documents(empty(spark), model).count() == 0
    assert language_id.identify_documents(df, language_id.train(empty(spark), F.col("lang"), F.col("text"))).filter("accepted").count() == 0


def test_text_of_no_known_language_is_not_accepted(spark, model):
    strange = [
        "Все люди рождаются свободными и равными в своем достоинстве и правах", "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan", "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw",
        "qzvkx jwpfh gtrbn zxqwv kjhgf plmok ijnuh bygvt fcrdx eszwa", "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b2b0b822cd15d6c15b0f00a08",
    ]
    rows = [(k, t, said, "web") for k, t in enumerate(strange) for said in (None, "en")] + [(100 + k, "the of and with from that this", "en", "web") for k in range(200)]
    got = language_id.identify_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), model).collect()
    assert all((r.lang, r.accepted) == (("en", True) if r.doc_id >= 100 else ("und", False)) for r in got)


def test_rare_language_is_known_at_any_size(spark):
    ids = spark.range(3000).withColumn("u", F.xxhash64("id") / F.lit(2.0**64) + 0.5)
    last = [r.id for r in ids.orderBy(F.desc("u")).limit(3).collect()]  # the last that a flat sample takes
    rows = ids.withColumn("lang", F.when(F.col("id").isin(last), "fi").otherwise("en")).withColumn(
        "text", F.when(F.col("lang") == "fi", "kaikki ihmiset syntyvät vapaina").otherwise("the of and with from that this")
    )
    langs, logs = language_id.train(rows, F.col("lang"), F.col("text"), most_rows=100, key=F.col("id"))
    assert langs == ["en", "fi"] and len(logs) == 3


def brute_language(docs, trust=0.9, kappa=20.0, evidence=40.0, least=0.5):
    """(id, lang, confidence) in plain Python: rows (id, text, said, place) train and are judged."""

    def grams(t):
        b = [0x20 if x <= 0x20 else x for x in lower(t)]
        return [((b[k] << 16 | b[k + 1] << 8 | b[k + 2]) * 2654435769 % (1 << 32)) >> 16 for k in range(len(b) - 2)]

    langs = sorted({said for _, t, said, _ in docs if said and grams(t)})
    n = len(langs)
    counts = {x: collections.Counter(g for _, t, said, _ in docs if said == x for g in grams(t)) for x in langs}
    p = lambda x, g: 0.9 * counts[x][g] / sum(counts[x].values()) + 0.1 / 65536 if x else 1 / 65536
    soft = lambda v: [math.exp(x - max(v)) / sum(math.exp(y - max(v)) for y in v) for x in v]
    rows = []
    for i, t, said, place in docs:
        g = grams(t)
        ll = [sum(math.log(p(x, y)) for y in g) * min(len(g), evidence) / max(1, len(g)) for x in [*langs, None]]
        if said in langs:
            ll = [v + math.log(trust if x == said else (1 - trust) / max(1, n - 1)) for v, x in zip(ll, [*langs, None])]
        letters = any(97 <= x <= 122 or x >= 128 for x in lower(t))
        rows.append((i, ll, soft(ll)[:n] if letters else [0.0] * n, letters, place or ""))
    out = []
    for i, ll, post, letters, place in rows:
        prior = [1 / n] * n
        for group in (rows, [r for r in rows if r[4] == place]):
            own = [max(0.0, sum(r[2][k] for r in group) - post[k]) for k in range(n)]
            prior = [(a + kappa * q) / (sum(own) + kappa) for a, q in zip(own, prior)]
        fused = soft([a + math.log(q) for a, q in zip(ll, [*(q * n / (n + 1) for q in prior), 1 / (n + 1)])])[:n]
        good = letters and max(fused) >= least
        out.append((str(i), langs[fused.index(max(fused))] if good else "und", round(max(fused) if letters else 0.0, 4)))
    return sorted(out)


def test_language_equals_plain_python(spark):
    sample = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("length(text) < 1500").select("doc_id", "text", "lang", "source").limit(60)
    df = awkward(spark).filter("text IS NULL OR length(text) < 2000").select("doc_id", "text", "lang", "source").unionByName(sample)
    df = df.unionByName(spark.createDataFrame(
        [(900, "Все люди рождаются свободными", "en", "s1"), (901, "le la les des une", None, "s9"), (902, "ok", "zz", "s0")], df.schema
    ))
    docs = [tuple(r) for r in df.collect()]
    frame = spark.createDataFrame(docs, df.schema)
    got = language_id.identify_documents(frame, language_id.train(frame, F.col("lang"), F.col("text"), key=F.col("doc_id"))).collect()
    want = brute_language(docs)
    mine = sorted((str(r.doc_id), r.lang, round(r.confidence, 4)) for r in got)
    assert [(a, b) for a, b, _ in mine] == [(a, b) for a, b, _ in want] and np.allclose([c for *_, c in mine], [c for *_, c in want], atol=2e-3)


def plain_votes(t):
    """The eight heuristics on one text, word by word."""
    b = (t or "").encode()
    ws = [w for w in re.split(rb"[\x20\x09-\x0d]+", b) if w]
    n, some, symbols = len(ws), max(1, len(ws)), b"!#$%&*<>@^_`{|}~\\=+"
    capitals, odd = (sum(x in s for x in b) / max(1, len(b)) for s in (bytes(range(65, 91)), symbols))
    bars, again = sum(len(w) == 1 and w in symbols for w in ws) / some, sum(x == y for x, y in zip(ws, ws[1:])) / some
    stops, variety, length = sum(w[-1:] in b".,;:?!" for w in ws) / some, len(set(ws)) / some, sum(map(len, ws)) / some
    rules = [
        (capitals > 0.3, n > 0 and capitals < 0.15), (odd > 0.04, n > 0 and odd < 0.02), (bars > 0.15, n >= 5 and bars < 0.05), (again > 0.1, n >= 5 and again < 0.04),
        (n >= 20 and (stops < 0.02 or stops > 0.6), n >= 5 and 0.03 < stops < 0.4), (n >= 20 and variety < 0.25, n >= 20 and variety > 0.35),
        (n > 0 and (length < 2 or length > 14), 3 <= length <= 11), (n < 2, n >= 8),
    ]
    return [0 if bad else 1 if good else 2 for bad, good in rules]


def test_quality_equals_plain_python(spark):
    """Votes rule by rule, and expectation-maximisation row by row instead of by patterns."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(awkward(spark).select("doc_id", "text"))
    got = sorted(((str(r.doc_id), r.votes, r.weak_label) for r in quality.quality_scores(df).collect()), key=str)
    votes = np.array([plain_votes(r.text) for r in df.collect()])
    good, bad = (votes == 1).sum(1), (votes == 0).sum(1)
    post = (good + 1.0) / (good + 3 * bad + 2.0)
    for _ in range(200):
        said = [[[(w * (votes[:, k] == v)).sum() + 1 for v in (0, 1)] for k in range(8)] for w in (1 - post, post)]
        share = [(1 - post).sum() + 1, post.sum() + 1]
        likely = [np.log(share[c] / sum(share)) + sum(np.where(
            votes[:, k] == 2, 0.0, np.log(np.take(said[c][k], np.minimum(votes[:, k], 1)) / sum(said[c][k]))
        ) for k in range(8)) for c in (0, 1)]
        after = 1 / (1 + np.exp(likely[0] - likely[1]))
        if np.abs(after - post).max() < 1e-9:
            break
        post = after
    want = sorted(((str(r.doc_id), v.tolist(), p) for r, v, p in zip(df.collect(), votes, post)), key=str)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert np.allclose(sorted(x[2] for x in got), sorted(x[2] for x in want), atol=1e-6)


def test_quality_agrees_with_labels_it_has_not_seen(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = quality.quality_scores(docs, most_rows=2000).join(labels, "doc_id")
    bad, good = got.filter("quality = 0"), got.filter("quality = 1")
    assert bad.filter("NOT kept").count() > 0.97 * bad.count()
    assert good.filter("kept").count() > 0.98 * good.count()


def test_quality_of_awkward_rows(spark):
    df = awkward(spark)
    assert quality.quality_scores(df).count() == df.count()
    assert quality.quality_scores(empty(spark)).count() == 0


def test_expectation_maximisation_finds_accuracies():
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.8
    votes = np.full((20_000, 8), 2)
    accuracy = [0.95, 0.9, 0.7, 0.85, 0.8, 0.6, 0.9, 0.75]
    for k, a in enumerate(accuracy):
        right = rng.random(20_000) < a
        votes[:, k] = np.where(right, truth, ~truth)
    patterns, n = np.unique(quality.pattern(votes), return_counts=True)
    _, table = quality.fit_votes(patterns, n)
    assert all(abs(table[1, k, 1] - a) < 0.05 and abs(table[0, k, 0] - a) < 0.08 for k, a in enumerate(accuracy))
