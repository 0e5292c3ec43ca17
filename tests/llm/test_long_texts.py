"""Texts of some MB, one beside its copy and a near copy, in every operator on documents."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, language_id, line_dedup, mixing, near_dup, packing, phrases, quality

WORDS = " ".join(f"w{k * k % 9973}" for k in range(500_000))  # some 3 MB


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, WORDS, "en", "a"), (2, WORDS, "en", "b"), (3, WORDS + " and a little more", None, "a"), (4, "short text of a few words", "en", "a"),
        (5, None, None, None), (6, "line of more than twenty letters\n" * 60_000, "en", "a")
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_copies(docs):
    exact = {r.doc_id: (r.keep_id, r.group_size, r.text_sha256) for r in exact_dedup.exact_dedup(docs).collect()}
    assert exact[1] == exact[2] == (1, 2, hashlib.sha256(WORDS.encode()).hexdigest()) and exact[3][0] == 3
    near = {r.doc_id: (r.class_id, r.n_links, r.kept) for r in near_dup.jaccard_join(docs).collect()}
    assert near[1] == (1, 2, True) and near[2] == (1, 2, False) and near[3] == (1, 2, False) and near[4] == (4, 0, True)


def test_lines_and_phrases(docs):
    lines = {r.doc_id: (r.n_lines, r.n_dropped) for r in line_dedup.line_dedup(docs).collect()}
    assert lines[6] == (60_001, 0) and lines[1] == (1, 0) and lines[5] == (1, 0)
    got = {r.phrase: r for r in phrases.collocations(docs.filter("doc_id IN (4, 6)"), support=100).collect()}
    assert got["line of more than twenty"].a == got["of more than twenty letters"].a == 60_000 and set(got) == {"line of more than twenty", "of more than twenty letters"}


def test_packing_and_mixing(docs):
    pieces = packing.pack(docs).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).collect()
    assert len(pieces) == 6 and all(r.n == r["all"] for r in pieces)
    assert sum(r.size for r in mixing.mix_sources(docs).collect() if r.doc_id in (1, 2)) == 1_000_000


def test_language_and_quality(docs):
    model = language_id.train(docs, F.col("lang"), F.col("text"), key=F.col("doc_id"))
    assert language_id.identify_documents(docs, model).count() == 6
    assert quality.quality_scores(docs).count() == 6
