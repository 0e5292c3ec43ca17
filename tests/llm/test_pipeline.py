import re

import numpy as np
import pytest
from cases import awkward, empty
from test_dedup import brute_jaccard
from test_packing_mixing import brute_targets

import corpus_pipeline
from tidemark.llm._tokens import tokenizer


@pytest.fixture(scope="module")
def stages(spark, sf):
    """Every stage's result, each on what the one before it kept."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    out.append(docs.toPandas())
    for _, f in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut(f(spark, docs, sf))
        out.append(docs.toPandas())
    return out


def test_columns(stages):
    assert all(list(s.columns) == list(stages[0].columns) for s in stages[1:-1])


def test_language_keeps_every_document_with_letters(stages):
    assert set(stages[1].doc_id) == {i for i, t in zip(stages[0].doc_id, stages[0].text) if re.search(r"[^\W\d_]", t or "")}


def test_exact_keeps_the_first_of_equal_texts(stages):
    first = {}
    for i, t in sorted(zip(stages[1].doc_id, stages[1].text)):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), i)
    assert sorted(stages[2].doc_id) == sorted(first.values())


def test_near_keeps_the_first_of_near_copies(stages):
    assert sorted(stages[3].doc_id) == sorted(i for i, *_, kept in brute_jaccard(list(zip(stages[2].doc_id, stages[2].text))) if kept)


def test_mix_repeats_documents_up_to_their_targets(stages):
    size = {i: len(t.split()) for i, t in zip(stages[3].doc_id, stages[3].text)}
    source = dict(zip(stages[3].doc_id, stages[3].source))
    total, taken = {}, {}
    for i, n in size.items():
        total[source[i]] = total.get(source[i], 0) + n
    for i in stages[4].doc_id:
        taken[source[i]] = taken.get(source[i], 0) + size[i]
    assert stages[4].doc_id.value_counts().max() <= 3
    for s, target in brute_targets(total).items():
        assert abs(taken.get(s, 0) - target) <= max(50, 0.05 * target)


def test_pack_holds_every_token_once(stages):
    t = tokenizer("byte_bpe_50k.json")
    assert stages[5].length.sum() == sum(len(t.encode(x, add_special_tokens=False).ids) + 1 for x in stages[4].text)
    assert (stages[5].groupby("sequence_id").length.sum() <= 1024).all() and np.isin(stages[5].doc_id, stages[4].doc_id).all()


def test_empty_table_goes_through(spark, tmp_path):
    empty(spark).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_mix_takes_repeated_rows_as_often_as_planned(spark, sf):
    rows = [(k % 3 if k < 30 else k, "w " * (k % 5 + 1), f"s{k % 2}") for k in range(60)] + [(None, "w", None), (-1, "w", "s0"), (None, "w", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    planned = corpus_pipeline.mixing.mix_sources(df).groupBy("doc_id", "source", "size").sum("copies").filter("`sum(copies)` > 0").collect()
    got = corpus_pipeline.mix(spark, df, sf).groupBy("doc_id", "source", "text").count().collect()
    assert {(r[0], r[1], len(r[2].split())): r[3] for r in got} == {tuple(r[:3]): r[3] for r in planned}


def test_dedup_stages_keep_one_row_of_each_text_whatever_its_id(spark, sf):
    w, v, u = (" ".join(f"{x}{k}" for k in range(40)) for x in "wvu")
    rows = [
        (1, w, "a"), (None, w, "b"), (5, w, "c"), (5, v, "d"), (7, w + "  ", "e"), (None, u, "f"), (None, u, "f"), (None, u + " end", "g"),
        (8, u + " end here", "h"), (None, "alone", None), (9, v + " end", "i"), (9, "another", "j"), (9, "another", "j")
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = corpus_pipeline.cut(corpus_pipeline.exact(spark, df, sf))
    assert sorted(((r.doc_id, r.text, r.source) for r in kept.collect()), key=str) == sorted([rows[k] for k in (0, 3, 4, 5, 7, 8, 9, 10, 11)], key=str)
    assert sorted(((r.doc_id, r.text) for r in corpus_pipeline.near(spark, kept, sf).collect()), key=str) == sorted([rows[k][:2] for k in (0, 3, 8, 9, 11)], key=str)
    assert corpus_pipeline.near(spark, df, sf).count() == 5  # by itself, too


def test_awkward_rows_go_through(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    awkward(spark).write.parquet(path)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
