import hashlib
import random
import re

from pyspark.sql import functions as F

from inkweave.llm import mixing as M
from tests.conftest import same_as_duckdb
from tests.llm.conftest import WORD


def brute_targets(sizes):
    """Water filling by rounds: {source: size} to {source: target}."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(sizes.values()))
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def brute(rows):
    size = [len(re.findall(WORD, t or "")) for _, _, t in rows]
    sources = {s for _, s, _ in rows}
    sizes = {s: sum(n for n, r in zip(size, rows) if r[1] == s) for s in sources}
    target = brute_targets(sizes)
    out = []
    for s in sources:
        mine = sorted((hashlib.md5(f"{M.SEED}{'' if d is None else d}".encode()).hexdigest(), d is not None, d or 0, n, d) for n, (d, x, _) in zip(size, rows) if x == s)
        budget, at = int(target[s] + 0.5), 0
        for *_, n, d in mine:
            epochs, rest = divmod(budget, sizes[s]) if sizes[s] else (0, 0)
            out.append((d, n, sizes[s], round(target[s], 6), epochs * n + max(0, min(n, rest - at))))
            at += n
    return sorted(map(str, out))


def result(df, **options):
    return sorted(str((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken)) for r in M.mix(df, **options).collect())


def test_query_equals_sql(spark, documents, sf_dir):
    same_as_duckdb(M.mix(documents).select("doc_id", "size", "source_size", "target", "taken"), M.ORACLE, sf_dir)


def test_against_brute_force(spark, documents):
    rows = [(r.doc_id, r.source, r.text) for r in documents.collect()]
    assert result(documents) == result(documents, range_rows=3) == brute(rows)
    skewed = [(k, "big" if k % 3 else f"s{k % 9}", "w " * (k % 40)) for k in range(400)]
    assert result(spark.createDataFrame(skewed, "doc_id long, source string, text string"), range_rows=10) == brute(skewed)


def test_targets(spark):
    rng = random.Random(1)
    for _ in range(5):
        sizes = {rng.choice([f"s{k}", f"é{k}"]): rng.choice([0, 1, 10, 1000, 10**6]) for k in range(rng.randint(1, 8))} | {None: 5}
        got = {r.source: r.target for r in M.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        want = brute_targets(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)
        assert abs(sum(got.values()) - sum(sizes.values())) < 1e-3


def test_the_mix_itself(documents):
    plan = M.mix(documents).agg(F.sum("taken"), F.max(F.col("taken") / F.col("size"))).first()
    mixed = M.mixed(documents).persist()
    assert mixed.agg(F.sum("mix_words")).first()[0] == plan[0] and plan[1] <= 3
    assert mixed.columns == [*documents.columns, "mix_epoch", "mix_words"]
    texts = {r.doc_id: re.findall(WORD, r.text) for r in documents.collect()}
    for r in mixed.collect():
        assert re.findall(WORD, r.text) == texts[r.doc_id][: r.mix_words]


def test_repeated_rows_stay_within_the_budget(spark):
    text = "a b c d e f g"
    rows = [(1, "s1", text)] * 5 + [(1, "s2", text)] * 3 + [(None, "s2", text)] * 2 + [(2, "s2", "x y"), (3, "s1", "z " * 20), (4, None, "w " * 30), (4, None, "w " * 30)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    want, got = {}, {}
    plan = M.mix(df).collect()
    for r in plan:
        want[r.source, r.doc_id] = want.get((r.source, r.doc_id), 0) + r.taken
    mixed = M.mixed(df).collect()
    for r in mixed:
        assert 0 < r.mix_words == len(r.text.split()) <= 30
        got[r.source, r.doc_id] = got.get((r.source, r.doc_id), 0) + r.mix_words
    assert got == {k: v for k, v in want.items() if v}
    assert {(r.source, r.target) for r in plan} and all(abs(sum(v for (s, _), v in got.items() if s == r.source) - r.target) <= 0.5 for r in plan)


def test_nasty_rows(nasty):
    rows = [(r.doc_id, r.source, r.text) for r in nasty.collect()]
    assert result(nasty) == result(nasty, range_rows=5) == brute(rows)
    mixed = M.mixed(nasty)
    assert mixed.columns == [*nasty.columns, "mix_epoch", "mix_words"] and mixed.where("mix_words <= 0").count() == 0
    assert M.mix(nasty.limit(0)).count() == 0 and M.mixed(nasty.limit(0)).count() == 0
    blank = nasty.withColumn("text", F.lit(None).cast("string"))
    assert {(r.size, r.target, r.taken) for r in M.mix(blank).collect()} == {(0, 0.0, 0)}
