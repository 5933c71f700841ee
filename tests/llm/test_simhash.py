import random
import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkweave.llm import simhash as S
from tests.llm.conftest import WORD


def slow_print(text):
    words = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    """(doc_id, fingerprint, n_near, component_id) by comparing all pairs."""
    prints = [slow_print(t) for _, t in rows]
    near = [[j for j in range(len(rows)) if j != i and (prints[i] ^ prints[j]).bit_count() <= 4] for i in range(len(rows))]
    out, seen = [None] * len(rows), set()
    for i in range(len(rows)):
        if i in seen:
            continue
        group, stack = {i}, [i]
        while stack:
            for j in near[stack.pop()]:
                if j not in group:
                    group.add(j)
                    stack.append(j)
        seen |= group
        least = min((rows[j][0] for j in group if rows[j][0] is not None), default=None)
        for j in group:
            out[j] = (rows[j][0], f"{prints[j]:016x}", len(near[j]), least)
    return sorted(map(str, out))


def result(df):
    return sorted(map(str, map(tuple, S.near_duplicates(df).select("doc_id", "fingerprint", "n_near", "component_id").collect())))


def test_documents(documents):
    assert result(documents) == brute([(r.doc_id, r.text) for r in documents.collect()])


@settings(max_examples=80, deadline=None)
@given(st.text("aB \n\té漢", max_size=60))
def test_fingerprint(text):
    assert S.fingerprint(text.encode()) == slow_print(text)


def test_hashes_of_all_lengths():
    rng = np.random.default_rng(6)
    data = rng.integers(0, 256, 5000, dtype=np.uint8)
    start = rng.integers(0, 4000, 600)
    stop = start + np.concatenate([np.arange(120), rng.integers(0, 1000, 480)])
    assert S.xxh64(data, start, stop).tolist() == [xxhash.xxh64_intdigest(data[a:b].tobytes(), 42) for a, b in zip(start, stop)]


def test_majority_of_many():
    rng = np.random.default_rng(7)
    h = rng.integers(0, 2**64, 140_000, dtype=np.uint64) | np.uint64(1 << 63)
    first = np.array([0, 0, 3, 70_003, 140_000, 140_000])
    want = [sum(1 << b for b in range(64) if 2 * int((h[a:z] >> np.uint64(b) & np.uint64(1)).sum()) > z - a) for a, z in zip(first, first[1:])]
    assert S.majority(h, first).tolist() == want


def test_one_of_equal_rows_is_the_same_each_time(spark):
    rows = [(1, "same text here", f"s{k}") for k in range(20)]
    kept = {S.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(n)).first().source for n in (1, 3, 7)}
    assert len(kept) == 1


def test_pigeonring_finds_every_pair(spark):
    rng = random.Random(4)
    prints = set()
    for _ in range(30):
        base = rng.getrandbits(64)
        prints.add(base)
        for _ in range(12):
            x = base
            for b in rng.sample(range(64), rng.randint(1, 7)):
                x ^= 1 << b
            prints.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    got = S.near_pairs(spark.createDataFrame([(x, 1) for x in signed], "fp long, n long")).collect()
    pairs = [(r.a, r.b) for r in got]
    want = {(a, b) for a in signed for b in signed if a != b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 4}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want and want


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(1000, k) for k in range(1001, 1100)] + [(5000, 4000), (4000, 4500)]
    got = {r.node: r.rep for r in S.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(61)} | {k: 1000 for k in range(1000, 1100)} | {k: 4000 for k in (4000, 4500, 5000)}
    assert S.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each(spark, documents):
    kept = S.one_of_each(documents)
    assert kept.columns == documents.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r.component_id for r in S.near_duplicates(documents).collect()})


def test_one_of_linked_texts_without_ids(spark):
    text = " ".join(f"word{k * k}" for k in range(100))
    df = spark.createDataFrame([(None, text), (None, text + " end"), (None, text + " end"), (None, "something else entirely here"), (7, "one more text with an id")], "doc_id long, text string")
    near = [r.n_near for r in S.near_duplicates(df).collect()]
    assert len({r.fingerprint for r in S.near_duplicates(df).collect()}) == 4 and sorted(near) == [0, 0, 2, 2, 2]
    kept = [r.text for r in S.one_of_each(df).collect()]
    assert len(kept) == 3 and sum(t.startswith(text) for t in kept) == 1


def test_nasty_rows(nasty):
    rows = [(r.doc_id, r.text) for r in nasty.collect()]
    assert result(nasty) == brute(rows)
    kept = S.one_of_each(nasty)
    groups = {r.component_id for r in S.near_duplicates(nasty).collect()}
    assert kept.columns == nasty.columns and kept.where("doc_id is not null").count() == len(groups - {None})
    assert kept.where("doc_id = 100").count() == 1
    assert S.near_duplicates(nasty.limit(0)).count() == 0 and S.one_of_each(nasty.limit(0)).count() == 0
    texts = {r.text for r in nasty.where(F.col("doc_id").isNull()).collect()}
    assert {r.text for r in kept.where("doc_id is null").collect()} <= texts
