"""Strings that a polynomial modulo 2**64 can't tell apart, whatever its base: a Thue-Morse word of 1,024 letters and its complement."""

import numpy as np
import pytest
from test_models import brute_lm

from tidemark.llm import _tokens, lm_score, near_dup
from tidemark.llm._text import prefix_hash, rolled, rolling, span_hash

WORD = "a"
for _ in range(10):
    WORD += WORD.translate(str.maketrans("ab", "ba"))
OTHER = WORD.translate(str.maketrans("ab", "ba"))
SPAN = np.array([0, 1024]), np.array([1024, 2048])


def test_hash_tells_them_apart():
    buf = np.frombuffer((WORD + OTHER).encode(), np.uint8)
    assert len(set(rolled(rolling(buf), *SPAN))) == 1 and len(set(span_hash(prefix_hash(buf), *SPAN))) == 2


def test_hash_does_not_depend_on_the_place():
    x = np.random.default_rng(0).integers(0, 256, 2_500_000).astype(np.uint8)
    x[2_300_000:2_300_700] = x[100:800]
    a, b, c = span_hash(prefix_hash(x), np.array([100, 2_300_000, 1_048_000]), np.array([800, 2_300_700, 1_049_000]))
    assert a == b and c == span_hash(prefix_hash(x[1_048_000:1_049_000]), np.array([0]), np.array([1000]))[0]


@pytest.mark.parametrize("same_hash", [False, True])
def test_ids_are_the_librarys(monkeypatch, same_hash):
    if same_hash:  # even if all stretches had one hash
        monkeypatch.setattr(_tokens, "rolled", lambda h, s, e: np.zeros(len(s), np.uint64))
    texts = [WORD, OTHER, f"x {WORD} y {OTHER}", "one two", ""]
    data = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in data])])
    ids, counts = _tokens.Encoded("byte_bpe_50k.json")(np.frombuffer(b"".join(data), np.uint8), offsets)
    want = _tokens.ids_of(texts, "byte_bpe_50k.json")
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])


def test_no_link_and_own_counts(spark):
    df = spark.createDataFrame([(1, WORD), (2, OTHER), (3, f"{WORD} {OTHER}")], "doc_id long, text string")
    assert {(r.doc_id, r.class_id, r.n_links) for r in near_dup.jaccard_join(df).collect()} == {(1, 1, 0), (2, 2, 0), (3, 3, 0)}
    got = lm_score.lm_scores(df, order=2).collect()
    assert sorted((
        str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), round(r.score, 4)
    ) for r in got) == brute_lm([(1, WORD), (2, OTHER), (3, f"{WORD} {OTHER}")], 2)
