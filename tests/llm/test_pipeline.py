import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as C
from inkweave.llm import language, mixing, pii, simhash
from inkweave.llm.common import stored


def test_stages_against_brute_force(spark, documents, sf_dir):
    """Each stage's decisions, on its own input, made again by other means."""
    model = language.train(documents.where(~language.held_out()))
    judged = {r.doc_id: r for r in language.predict(documents, model).collect()}
    one = stored(C.by_language(spark, documents, sf_dir), "one")
    assert {r.doc_id for r in one.collect()} == {k for k, r in judged.items() if r.lang_pred != "und" and r.lang_score >= C.LEAST_SHARE}
    two = stored(C.without_near_duplicates(spark, one, sf_dir), "two")
    rows = one.collect()
    prints = {r.doc_id: simhash.fingerprint(r.text.encode()) for r in rows}
    group = {k: k for k in prints}
    for _ in prints:  # smallest id reachable, by passing it on until nothing changes
        new = {a: min(group[b] for b in prints if (prints[a] ^ prints[b]).bit_count() <= 4) for a in prints}
        if new == group:
            break
        group = new
    assert {r.doc_id for r in two.collect()} == set(group.values())
    three = stored(C.without_benchmark(spark, two, sf_dir), "three")
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert {r.doc_id for r in two.collect()} - {r.doc_id for r in three.collect()} == {r.doc_id for r in two.collect() if any(t in r.text for t in items)}
    four = stored(C.without_personal_data(spark, three, sf_dir), "four")
    texts = {r.doc_id: r.text for r in four.collect()}
    assert texts.keys() == {r.doc_id for r in three.collect()}
    more = {r.doc_id: [tuple(x) for x in r.more] for r in pii.discovered(pii.scan(three)).collect()}
    for r in three.collect():
        assert texts[r.doc_id] == pii.masked(r.text, more.get(r.doc_id, []))
        assert not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9-]|token = \"[0-9a-f]{40}", texts[r.doc_id])
    five = C.to_weights(spark, four, sf_dir)
    assert five.agg(F.sum("mix_words")).first() == mixing.mix(four).agg(F.sum("taken")).first()
    for df in (one, two, three, four):
        assert df.columns == documents.columns
    whole = C.run(spark, sf_dir)
    assert sorted(map(str, whole.collect())) == sorted(map(str, five.collect()))


def test_keeps_clean_documents(spark, sf_dir):
    """Distinct clean texts pass all filtering stages unchanged."""
    rows = [(k, " ".join(f"{a}{b}{chr(97 + k % 26)}{chr(97 + k // 26)}" for a in ("lo", "ra", "mi") for b in ("stu", "pel", "gor", "van", f"x{chr(97 + k % 20)}")), "en", f"s{k % 2}", 9) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in C.STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "clean")
    assert sorted((r.doc_id, r.text) for r in docs.collect()) == sorted((r[0], r[1]) for r in rows)


def test_nasty_rows(spark, nasty, sf_dir):
    for docs in (nasty, nasty.limit(0)):
        for _, stage in C.STAGES:
            docs = stored(stage(spark, docs, sf_dir), "nasty")
        assert docs.where("text is null").count() == 0 and set(nasty.columns) < set(docs.columns)


def test_registered():
    names = entry.queries()
    assert names["pipeline"] is C.run
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert [f.__name__ for _, f in C.STAGES]


@pytest.mark.parametrize("name", ["op7_chat_columnar", "op10_mix_sources"])
def test_sql_is_registered(name):
    assert name in entry.oracle_sql()
