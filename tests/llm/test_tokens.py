import os

import pytest

from inkweave.llm import tokens as K
from inkweave.llm.queries import VOCABULARY

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary here")


def check(df, docs):
    n = [len(K.encoding(VOCABULARY).encode_ordinary(t)) if t else 0 for t in docs]
    sums = K.suffix_sums(K.histogram(K.lengths(df, VOCABULARY)), chunk=50)
    got = {r.length: r for r in sums.collect()}
    assert got.keys() == set(n)
    for k, r in got.items():
        assert (r.n_docs, r.docs_from, r.tokens_from, r.total_tokens, r.truncated_total) == (n.count(k), sum(x >= k for x in n), sum(x for x in n if x >= k), sum(n), sum(min(x, k) for x in n))
        assert abs(r.share_up_to - sum(x <= k for x in n) / len(n)) < 1e-12
    for r in K.at_limits(sums, [0, 3, 100, 777, 10**9]).collect():
        assert (r.docs_over, r.truncated_total) == (sum(x > r.limit for x in n), sum(min(x, r.limit) for x in n))
    ordered = sorted(n)
    for r in K.quantiles(sums, [0.25, 0.5, 1.0]).collect():
        assert r.length == ordered[-(-len(n) * int(r.share * 4) // 4) - 1]


def test_documents(documents):
    check(documents, [r.text for r in documents.collect()])


def test_corpus_is_encoded_once(spark, documents):
    sums = K.suffix_sums(K.histogram(K.lengths(documents, VOCABULARY)))
    assert "MapInArrow" not in sums._jdf.queryExecution().toString()


def test_long_runs_without_a_break(spark):
    texts = ["y" * 2_000_000, "ab" * 500_000, "é" * 300_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in K.lengths(df, VOCABULARY).collect()} == {k: len(K.encoding(VOCABULARY).encode_ordinary(t)) for k, t in enumerate(texts)}


def test_nasty_rows(nasty):
    check(nasty, [r.text for r in nasty.collect()])
    none = K.suffix_sums(K.histogram(K.lengths(nasty.limit(0), VOCABULARY)))
    assert none.count() == 0 and [tuple(r) for r in K.at_limits(none, [5]).collect()] == [(5, 0, 0)]


def test_control_strings_are_text():
    assert len(K.encoding(VOCABULARY).encode_ordinary("<|endoftext|>")) > 1
