import io
import json
import pickle
import urllib.error

import pytest
from pyspark.sql import functions as F

from inkweave import engine
from inkweave.operators import clients, figures
from inkweave.sources import answers, sinks
from inkweave.sources import builder as B

IMAGE = bytes(range(256)) * 40
DOC = B.docx(B.paragraph("Top") + B.picture("rId1") + B.group(["Alpha", "Beta 42"]) + B.paragraph("End"), {"i.png": IMAGE}, links={"rId1": ("image", "media/i.png")})


def scripted(prompt, uri, model):
    if model == "broken":
        raise RuntimeError("no: Bearer abcdef")
    if "hallucination" in prompt:
        return f"hallucination: {'yes' if model == 'judge-a' else 'no'}\nmermaid_fit: n/a\nlanguage: {'no' if model == 'judge-b' else 'yes'}"
    return f"# Seen {uri.split(';')[0]}"


def test_convert_with_interpretation(spark):
    source = engine.in_memory(spark, [("a.docx", "docx", DOC), ("b.docx", "docx", DOC), ("c.xlsx", "xlsx", B.xlsx([{"name": "S", "rows": [["x"]]}])), ("bad.docx", "docx", b"no")])
    plain = engine.convert(source)
    assert not any(r.vlm_used for r in plain.collect())
    config = engine.Config(use_vlm=True, verify=True, model="m-1")
    got = engine.interpret(plain, source, scripted, config)
    rows = {r.source_id: r for r in got.results.collect()}
    assert [rows[k].vlm_used for k in ("a.docx", "b.docx", "c.xlsx", "bad.docx")] == [True, True, False, False] and rows["bad.docx"].markdown is None
    assert "VLM interpretation (m-1)" in rows["a.docx"].markdown and "**Seen data:image/png**" in rows["a.docx"].markdown and "composite content not analyzed" in rows["a.docx"].markdown
    ident = got.cache.first().id12
    assert rows["a.docx"].warnings == [f"vlm-judge-hallucination: {ident}", f"vlm-judge-language: {ident}"] and got.cache.count() == 1 and got.failures.count() == 0
    solo = engine.interpret(plain, source, scripted, engine.Config(use_vlm=True, verify=True, judge_mode="solo"))
    assert solo.cache.first().judge_verdict == ["vlm-judge-hallucination"]
    assert plain.columns == got.results.columns
    # the cache alone speaks without a client, and its answers are not asked for again
    again = engine.convert(source, engine.Config(use_vlm=True), cache=got.cache)
    assert {r.source_id for r in again.where("vlm_used").collect()} == {"a.docx", "b.docx"}
    failed = engine.interpret(plain, source, scripted, engine.Config(use_vlm=True, model="broken"))
    assert [(r.id12, r.error) for r in failed.failures.collect()] == [(ident, "no: ***REDACTED***")] and not failed.results.where("vlm_used").count()
    with pytest.raises(ValueError):
        engine.convert(source, config)


def test_least_recall_and_group_images(spark):
    source = engine.in_memory(spark, [("a.docx", "docx", DOC)])
    plain = engine.convert(source)
    group = figures.markers(plain, "source_id").where("kind = 'group'").first().id12
    images = spark.createDataFrame([(group, "data:image/png;base64,QUI=")], "id12 string, uri string")
    for least, many in ((0.9, 2), (0.0, 1)):
        got = engine.convert(source, engine.Config(use_vlm=True, min_recall=least), lambda p, u, m: "Only Alpha", group_images=images).first()
        assert len(got.warnings) == many and f"figure-witness-numeric: {group} witness_only=[42]" in got.warnings


def test_answers_table(spark, tmp_path):
    path = f"file://{tmp_path}/cache"
    assert answers.read(spark, path).count() == 0
    for n in range(3):
        answers.write(spark.createDataFrame([(f"{k}", "m", "t", None) for k in range(n + 1)], answers.KIND), path)
    assert answers.read(spark, path).count() == 3 and sorted(p.name for p in (tmp_path / "cache").iterdir()) == ["v=2", "v=3"]
    for f in (tmp_path / "cache/v=3").glob("*.parquet"):
        f.write_bytes(b"broken")
    assert answers.read(spark, path).count() == 0


class Reply(io.BytesIO):
    pass


class Script:
    """Answers in turn; an exception is raised."""

    def __init__(self, *steps):
        self.steps, self.sent = list(steps), []

    def __call__(self, request, timeout):
        self.sent.append(request)
        step = self.steps.pop(0)
        if isinstance(step, Exception):
            raise step
        return Reply(json.dumps(step).encode())


def status(code):
    return urllib.error.HTTPError("u", code, "x", {}, None)


CHAT = {"choices": [{"message": {"content": "fine"}}]}


def test_client_tries_again(monkeypatch):
    monkeypatch.setenv("K", "secret")
    slept = []
    script = Script(status(429), {"error": {"code": 502, "message": "x"}}, TimeoutError(), status(503), CHAT)
    client = clients.Remote("http://h/x", "K", open=script, sleep=slept.append)
    assert client("p", "data:image/png;base64,QQ==", "m") == "fine" and slept == [1, 4, 15, 60]
    body = json.loads(script.sent[0].data)
    assert body["model"] == "m" and body["messages"][0]["content"][1]["image_url"]["url"].endswith("QQ==") and script.sent[0].headers["Authorization"] == "Bearer secret"
    with pytest.raises(urllib.error.HTTPError):
        clients.Remote("http://h/x", "K", open=Script(status(400), CHAT), sleep=slept.append)("p", "u", "m")
    with pytest.raises(urllib.error.URLError):
        clients.Remote("http://h/x", "K", waits=(0,), open=Script(urllib.error.URLError("a"), urllib.error.URLError("b")), sleep=slept.append)("p", "u", "m")


def test_client_of_messages_and_its_key(monkeypatch):
    monkeypatch.setenv("K", "secret")
    script = Script({"content": [{"type": "text", "text": "a"}, {"type": "other"}, {"type": "text", "text": "b"}]})
    client = clients.Remote("http://h/x", "K", "messages", open=script)
    assert client("p", "data:image/png;base64,QQ==", "m") == "ab"
    assert json.loads(script.sent[0].data)["messages"][0]["content"][1]["source"] == {"type": "base64", "media_type": "image/png", "data": "QQ=="} and script.sent[0].headers["X-api-key"] == "secret"
    assert b"secret" not in pickle.dumps(clients.Remote("http://h/x", "K"))
    monkeypatch.delenv("K")
    with pytest.raises(clients.Refusal, match="K is not set"):
        clients.Remote("http://h/x", "K", open=Script(), sleep=lambda _: pytest.fail("waited"))("p", "u", "m")


def test_files_are_written_where_rows_are(spark, tmp_path):
    rows = engine.convert(engine.in_memory(spark, [("x/a.docx", "docx", DOC), ("../b.docx", "docx", DOC), ("c.docx", "docx", b"no")]))
    told = {r.source_id: r for r in sinks.write_each(rows, tmp_path.as_uri()).collect()}
    assert (tmp_path / "x/a.md").read_text() == (tmp_path / "b.md").read_text() and told["c.docx"].path is None and told["c.docx"].status == "corrupt_archive"
    sinks.write_each(rows, tmp_path.as_uri(), json=True).collect()
    assert set(json.loads((tmp_path / "x/a.json").read_text())) == set(sinks.FIELDS)


def test_content_box(spark):
    kind = "items array<struct<x0:double,top:double,x1:double,bottom:double>>, page struct<x0:double,top:double,x1:double,bottom:double>"
    page = (0.0, 0.0, 100.0, 50.0)
    rows = [([(5.0, -3.0, 20.0, 9.0), (1.0, 2.0, 120.0, 8.0)], page), ([], page), ([(200.0, 0.0, 220.0, 9.0)], page)]
    got = spark.createDataFrame(rows, kind).select(figures.content_box(F.col("items"), F.col("page")).alias("b")).collect()
    assert [r.b and tuple(r.b) for r in got] == [(1.0, 0.0, 100.0, 9.0), None, None]
