import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from inkweave.llm import common as C
from tests.llm.conftest import WORD


@settings(max_examples=60, deadline=None)
@given(st.lists(st.none() | st.text("ab\t \n\x0b\x1fé漢", max_size=30), max_size=20), st.integers(1, 60))
def test_words_hashes_and_slices(texts, limit):
    col = pa.array(texts, pa.string())
    w = C.words(col)
    data = w.data.tobytes()
    got = [[data[w.start[k] : w.end[k]].decode() for k in range(w.first[d], w.first[d + 1])] for d in range(len(texts))]
    assert got == [re.findall(WORD, t or "") for t in texts]
    flat = [x for g in got for x in g]
    h = C.word_hashes(w)
    assert len(set(zip(flat, h.tolist()))) == len(set(flat)) == len(set(h.tolist()))
    at = C.inside(w, 3)
    assert len(at) == sum(max(0, len(g) - 2) for g in got)
    grams = C.gram_hashes(h, 3)
    pairs = {(tuple(flat[k : k + 3]), int(grams[k])) for k in at}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
    batch = pa.record_batch([col], names=["text"])
    parts = list(C.cut(batch, "text", limit))
    assert [x for p in parts for x in p.column(0).to_pylist()] == texts
    sliced = pa.concat_arrays([pa.array(["zz"]), col]).slice(1)
    assert C.words(sliced).n.tolist() == w.n.tolist()
    points, off = C.code_points(*C.spaced(col))
    assert ["".join(map(chr, points[a : b - 1])) for a, b in zip(off, off[1:])] == [t or "" for t in texts]


def test_gram_hash_is_position_free():
    rng = random.Random(1)
    words = [rng.choice("ab") for _ in range(2000)]
    h = C.word_hashes(C.words(pa.array([" ".join(words)])))
    for k in (1, 7, 13):
        seen = {}
        for i, g in enumerate(C.gram_hashes(h, k).tolist()):
            assert seen.setdefault(tuple(words[i : i + k]), g) == g
        assert len(set(seen.values())) == len(seen)
    assert len(C.gram_hashes(np.zeros(3, np.uint64), 7)) == 0


def test_stored_table_reads_back(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    assert sorted(map(tuple, C.stored(df, "t").collect()), key=str) == [(1, None), (2, "x")]
    assert C.stored(df.limit(0), "t").count() == 0
