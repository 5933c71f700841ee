import hashlib
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkweave.llm import substring as S
from tests.llm.conftest import WORD, collected


def brute(rows):
    words = [re.findall(WORD, t or "") for _, t in rows]
    first = {}
    for (d, _), w in zip(rows, words):
        for i in range(len(w) - 12 if d is not None else 0):
            k = tuple(w[i : i + 13])
            first[k] = min(first.get(k, d), d)
    out = []
    for (d, _), w in zip(rows, words):
        gone = [False] * len(w)
        for i in range(len(w) - 12 if d is not None else 0):
            if first[tuple(w[i : i + 13])] < d:
                gone[i : i + 13] = [True] * 13
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(map(str, out))


def result(df, **options):
    return collected(S.remove_repeats(df, **options).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)))


def test_documents(documents):
    assert result(documents) == brute([(r.doc_id, r.text) for r in documents.collect()])


def test_small_alphabet_in_many_ranges(spark):
    rng = random.Random(3)
    made = lambda: rng.choice([None, "", " ".join(rng.choice("a b c".split()) for _ in range(rng.randint(0, 60))), " ".join(rng.choice(["x y z w"] * 3 + ["q r"]) for _ in range(12))])
    rows = [(rng.choice([None, *range(40)]), made()) for _ in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(df, range_entries=50) == result(df, range_entries=50, fan_out=4) == result(df) == brute(rows)


def test_candidates_come_from_the_index(spark, monkeypatch):
    """Without blocks there are no hits, so nothing is found: the anchors decide what is compared."""
    text = " ".join(f"w{k}" for k in range(40))
    df = spark.createDataFrame([(1, text), (2, text), (-(2**63), "x " + text)], "doc_id long, text string")
    assert result(df) == brute([(r.doc_id, r.text) for r in df.collect()])
    row = S.packed(df.coalesce(1)).first().asDict()
    s = S.Slice(row)
    every, none = np.ones(len(s.keys), bool), np.zeros(len(s.keys), bool)
    assert len(s.windows(every, every, none)["at"]) == len(s.windows(every, none, every)["at"]) == 28 + 28 + 29
    assert not len(s.windows(every, none, none)["at"])
    assert not len(s.windows(none, every, every)["at"])


def test_equal_hashes_of_unequal_windows():
    h, check = np.array([5, 9, 5, 5, 9], np.uint64), np.array([1, 0, 2, 1, 0], np.uint32)
    order, head, group = S._distinct(h, check)
    assert [(int(h[order][k]), int(check[order][k])) for k in head] == [(5, 1), (5, 2), (9, 0)]
    assert np.bincount(group).tolist() == [2, 1, 2]


def test_passage_at_every_offset(spark):
    passage = [f"p{k}" for k in range(13)]
    rows = [(0, " ".join(["lead"] * 5 + passage))] + [(k + 1, " ".join([f"u{k}.{i}" for i in range(k)] + passage + [f"end{k}"])) for k in range(15)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(df) == brute(rows)
    assert all(r.n_removed == 13 for r in S.remove_repeats(df).where("doc_id > 0").collect())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1)))
def test_coding(values):
    v = np.array(sorted(values), np.uint64)
    assert S.decode_sorted(S.encode_sorted(v)).tolist() == v.tolist()
    assert S.decode(S.encode(v)).tolist() == v.tolist()


def test_nasty_rows(nasty):
    assert result(nasty) == brute([(r.doc_id, r.text) for r in nasty.collect()])
    assert S.remove_repeats(nasty.limit(0)).count() == 0
