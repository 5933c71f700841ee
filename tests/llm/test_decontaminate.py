import random

import numpy as np
import pyarrow as pa

from inkweave.llm import decontaminate as D


def slow(index: D.Index, text: str):
    """All windows, all items, no bound and no index: (item, similarity, start) of the best window within the radius."""
    w, h = D._scan(pa.array([text]))
    n, best = len(w.start), {}
    k = np.searchsorted(index.shingles, h).clip(0, len(index.shingles) - 1)
    weight = np.where(h != 0, np.where(index.shingles[k] == h, index.weights[k], index.other), 0)
    for item, (keys, weights) in enumerate(index.sets):
        size = int(index.size[item])
        if not size:
            continue
        for a in range(max(1, n - size + 1)):
            part = slice(a, max(a, min(n, a + size) - D.SHINGLE + 1))
            sums = sum((int(x) * np.where(np.unpackbits(np.array([y], ">u8").view(np.uint8)), 1, -1) for x, y in zip(weight[part], h[part])), np.zeros(64, int))
            bits = np.packbits(sums > 0).view(">u8")[0]
            sim = weights[np.isin(keys, h[part])].sum() / weights.sum()
            if bin(int(bits) ^ int(index.prints[item])).count("1") <= D.RADIUS and sim >= D.THRESHOLD and sim > best.get(item, (0,))[0]:
                best[item] = (sim, a)
    return {(i, round(s, 9), a) for i, (s, a) in best.items()}


def cases():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4)))
    items = [" ".join(word() for _ in range(rng.choice([1, 2, 5, 9, 14, 14, 20]))) for _ in range(25)]
    texts = ["", "one"]
    for _ in range(60):
        own = [word() for _ in range(rng.randint(0, 40))]
        cut = rng.choice(items).split()
        for _ in range(rng.randint(0, 3)):
            cut[rng.randrange(len(cut))] = word()
        at = rng.randint(0, len(own))
        texts.append(rng.choice([" ", ", "]).join(own[:at] + cut + own[at:]))
    return items, [*texts, items[3].upper() + "!"]


def test_matches_against_brute_force():
    items, texts = cases()
    index = D.Index(pa.table({"item_id": list(range(len(items))), "text": items}))
    d, y, sim, start, _, _ = index.matches(pa.array(texts))
    got = {}
    for a, b, s, at in zip(d.tolist(), y.tolist(), sim.tolist(), start.tolist()):
        got.setdefault(a, set()).add((b, round(s, 9), at))
    assert len(got) > 20
    for k, t in enumerate(texts):
        assert got.get(k, set()) == slow(index, t), t


def test_index_returns_all_within_the_radius():
    rng = np.random.default_rng(1)
    items, _ = cases()
    index = D.Index(pa.table({"item_id": list(range(len(items))), "text": items}))
    flips = np.zeros(400, np.uint64)
    for k in range(400):
        for b in rng.choice(64, rng.integers(0, 30), replace=False):
            flips[k] ^= np.uint64(1) << np.uint64(b)
    of = rng.integers(0, len(items), 400)
    x, y = index.candidates(index.prints[of] ^ flips, index.size[of])
    got = set(zip(x.tolist(), y.tolist()))
    want = {(k, i) for k in range(400) for i in range(len(items)) if index.size[i] == index.size[of[k]] and bin(int(index.prints[of[k]] ^ flips[k] ^ index.prints[i])).count("1") <= D.RADIUS and index.size[i]}
    assert {g for g in got if index.size[g[1]]} == want


def test_planted_passages(spark, documents, sf_dir):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = {(r.doc_id, r.item_id) for r in D.leaks(documents, bench).collect()}
    items = {r.item_id: r.text for r in bench.collect()}
    held = {(r.doc_id, k) for r in documents.collect() for k, t in items.items() if t in r.text}
    assert held <= found
    kept = {r.doc_id for r in D.clean(documents, bench).collect()}
    assert kept == {r.doc_id for r in documents.collect()} - {d for d, _ in found}
    blocks = D.ITEMS_AT_ONCE
    try:
        D.ITEMS_AT_ONCE = 20
        assert len(list(D.item_blocks(bench))) > 1
        assert {(r.doc_id, r.item_id) for r in D.leaks(documents, bench).collect()} >= held
    finally:
        D.ITEMS_AT_ONCE = blocks


def test_blocks_give_the_same_rows(spark, monkeypatch):
    items, texts = cases()
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    rows = lambda: (sorted(map(tuple, D.leaks(docs, bench).collect())), sorted(r.doc_id for r in D.clean(docs, bench).collect()))
    one = rows()
    assert len(one[0]) > 20
    monkeypatch.setattr(D, "ITEMS_AT_ONCE", 8)
    assert len(list(D.item_blocks(bench))) > 3
    assert rows() == one


def test_recall_of_edited_items(spark, sf_dir):
    """Items with words exchanged, within texts of their own: of those whose exact similarity reaches the threshold, how many are found."""
    rng = random.Random(12)
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect() if len(r.text.split()) > 8]
    index = D.Index(pa.table({"item_id": list(range(len(items))), "text": items}))
    word = lambda: "".join(rng.choice("qxzjkv") for _ in range(5))
    texts, of = [], []
    for _ in range(1500):
        k = rng.randrange(len(items))
        cut = items[k].split()
        for _ in range(rng.randint(0, max(1, len(cut) // 8))):
            cut[rng.randrange(len(cut))] = word()
        texts.append(" ".join([word() for _ in range(9)] + cut + [word() for _ in range(9)]))
        of.append(k)
    d, y, *_ = index.matches(pa.array(texts))
    got = set(zip(d.tolist(), y.tolist()))
    seen = {0.7: [0, 0], 0.8: [0, 0], 0.9: [0, 0]}
    for k, (t, item) in enumerate(zip(texts, of)):
        w, h = D._scan(pa.array([t]))
        n, (keys, weight) = int(index.size[item]), index.sets[item]
        sim = max(weight[np.isin(keys, h[a : a + n - D.SHINGLE + 1])].sum() / weight.sum() for a in range(len(w.start) - n + 1))
        for low in (0.9, 0.8, 0.7):
            if sim >= low:
                seen[low][0] += (k, item) in got
                seen[low][1] += 1
                break
    assert all(n > 100 for _, n in seen.values()), seen
    assert seen[0.9][0] == seen[0.9][1] and seen[0.8][0] >= 0.98 * seen[0.8][1] and seen[0.7][0] >= 0.9 * seen[0.7][1], seen
    print(seen)


def test_nasty_rows(spark, nasty):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (None, "long long long long"), (3, None), (4, ""), (5, "word"), (1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    got = D.leaks(nasty, bench)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(100, 1), (101, None)} and got.where("doc_id = 100").count() == 6
    kept = D.clean(nasty, bench)
    assert kept.columns == nasty.columns and kept.count() == nasty.count() - 4
    none = bench.limit(0)
    assert D.leaks(nasty, none).count() == 0 and D.clean(nasty, none).count() == nasty.count() and D.clean(nasty.limit(0), bench).count() == 0
