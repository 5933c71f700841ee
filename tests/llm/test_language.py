import numpy as np
from pyspark.sql import functions as F

from inkweave.llm import language as L


def slow_viterbi(score, switch):
    if not len(score):
        return []
    k = score.shape[1]
    now, back = score[0].astype(float), []
    for row in score[1:]:
        step = now[None, :] - switch * (1 - np.eye(k))
        back.append(step.argmax(1))
        now = step.max(1) + row
    path = [int(now.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def test_viterbi_against_brute_force():
    rng = np.random.default_rng(0)
    for switch in (0.3, 2.0, 12.0):
        first = np.concatenate([[0], np.cumsum(rng.integers(0, 30, 40))])
        score = rng.normal(0, 5, (first[-1], 3)).astype(np.float32)
        assert L.viterbi(score, first, switch).tolist() == sum((slow_viterbi(score[a:b], switch) for a, b in zip(first, first[1:])), [])


def test_held_out_accuracy(documents):
    got = L.identify(documents)
    assert got.count() == documents.count()
    judged = got.join(documents.select("doc_id", "lang"), "doc_id").where("held_out")
    assert judged.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95
    assert got.where("score < 0 or score > 1 or lang_pred is null").count() == 0


def test_only_the_text_decides(documents):
    model = L.train(documents.where(~L.held_out()))
    changed = documents.withColumns({"lang": F.lit("xx"), "source": F.lit(None).cast("string"), "doc_id": F.col("doc_id") + 5})
    a = {r.text: r.lang_pred for r in L.predict(documents, model).collect()}
    assert a == {r.text: r.lang_pred for r in L.predict(changed, model).collect()}


def test_spans_of_mixed_text_and_scripts(spark):
    rows = [("en", "the cat and the dog ran with the man") for _ in range(5)] + [("de", "der hund und die katze auf dem dach") for _ in range(5)] + [("ru", "и вот он идёт по дороге домой")] * 5
    model = L.train(spark.createDataFrame(rows, "lang string, text string"))
    text = "the man and the dog ran with the cat. der hund und die katze auf dem dach, домой по дороге 12"
    got = L.predict(spark.createDataFrame([(text,), (None,), ("12 !",), ("",)], "text string"), model, spans=True).collect()
    assert [s.split(":")[0] for s in got[0].lang_spans.split(",")] == ["en", "de", "ru"]
    a, b = map(int, got[0].lang_spans.split(",")[2].split(":")[1:])
    assert text[a:b] == "домой по дороге"
    assert [(r.lang_pred, r.lang_score, r.lang_spans) for r in got[1:]] == [("und", 0.0, "")] * 3
    assert model.bar[3].tolist() == [-10000.0, -10000.0, 0.0] or model.bar[3].argmax() == 2  # Cyrillic leaves one candidate


def test_counts_cover_all_rows(spark):
    rows = [("en", "ab"), ("en", "ab"), ("de", "ab"), (None, "ab"), ("de", None)]
    got = L.counts(spark.createDataFrame(rows, "lang string, text string")).groupBy("lang").agg(F.sum("n").alias("n")).collect()
    assert {r.lang: r.n for r in got} == {"en": 2 * (3 + 3 + 2), "de": 3 + 3 + 2}  # bigrams, trigrams and letters


def test_nasty_rows(nasty):
    got = L.identify(nasty, spans=True)
    assert got.count() == nasty.count()
    blank = {r.text for r in nasty.select("text").collect() if not r.text or not any(c.isalpha() for c in r.text)}
    model = L.train(nasty)
    kept = L.predict(nasty.drop("lang_score"), model)
    assert kept.columns == [*nasty.drop("lang_score").columns, "lang_pred", "lang_score"]
    for r in kept.select("text", "lang_pred", "lang_score").collect():
        assert (r.lang_pred == "und") == (r.text in blank or r.text is None) and (r.lang_pred != "und" or r.lang_score == 0)
    assert L.identify(nasty.limit(0)).count() == 0
    unlabelled = nasty.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in L.identify(unlabelled).collect()} == {"und"}
