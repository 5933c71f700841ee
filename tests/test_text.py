from pyspark.sql import functions as F

from inkweave.functions import html
from inkweave.functions import numbers as N
from inkweave.functions import text as X
from inkweave.operators import figures


def one(spark, **columns):
    row = spark.createDataFrame([(1,)], "k int").select(*(c.alias(n) for n, c in columns.items())).first()
    return row.asDict()


def test_numbers(spark):
    values = ["12", " 7 ", "+3", "1_0", "1d", "nan", "1e3", ".5", "5.", "", "99999999999", None]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert [r[0] for r in df.select(N.safe_int(F.col("v"))).collect()] == [12, 7, 3, None, None, None, None, None, None, None, None, None]
    assert [r[0] for r in df.select(N.safe_float(F.col("v"))).collect()] == [12.0, 7.0, 3.0, None, None, None, 1000.0, 0.5, 5.0, None, 99999999999.0, None]
    doubles = spark.createDataFrame([(v,) for v in (0.42, 12.0, 1e-5, 1984.5, 1985.5, 123456.0, -0.0, None)], "v double")
    assert [r[0] for r in doubles.select(N.four_digits("v")).collect()] == ["0.42", "12", "1e-05", "1984", "1986", "1.235e+05", "-0", None]
    assert [r[0] for r in doubles.select(N.plain_number("v")).collect()] == ["0.42", "12", "1e-05", "1984.5", "1985.5", "123456", "0", ""]


def test_sanitizing_is_idempotent(spark):
    md = "# Top\n ```py\n# no\n```\n### Sub  \n> [Image]\n```mermaid\npie\n    \"a\" : 1\n```\n```mermaid\nnonsense\n```\n```\nopen"
    once = one(spark, x=X.sanitize(F.lit(md)))["x"]
    assert once == one(spark, x=X.sanitize(F.lit(once)))["x"]
    assert once.startswith("**Top**\n ```py\n# no\n```\n**Sub**\n> ​[Image]\n```mermaid\npie") and "```text\nnonsense" in once and once.endswith("open\n```")


def test_witness(spark):
    got = one(spark, a=X.witness_defects(F.lit("Ümlaut alpha 7 7 12"), F.lit("ümlaut 7"), F.lit("id")), b=X.witness_defects(F.lit(" "), F.lit("x"), F.lit("id")), c=X.witness_defects(F.lit("1 2"), F.lit("2 1"), F.lit("id")))
    assert got == {"a": ["figure-witness-recall: id 0.50", "figure-witness-numeric: id witness_only=[7,12]"], "b": [], "c": []}
    many = " ".join(map(str, range(14)))
    assert one(spark, a=X.missing_side(X.missing_numbers(F.lit(many), F.lit("13"))))["a"] == "0,1,2,3,4,5,6,7,8,9…+3"


def test_verdicts(spark):
    whole = "Hallucination: YES\n mermaid_fit: n/a\nlanguage : no"
    got = one(spark, a=X.verdict_defects(F.lit(whole)), b=X.verdict_defects(F.lit("hallucination: yes\nlanguage: no")), c=X.panel(F.array(F.lit("a")), F.array(F.lit("b"), F.lit("a"))))
    assert got == {"a": ["vlm-judge-hallucination", "vlm-judge-language"], "b": [], "c": ["a", "b"]}


def test_resolve_and_refs(spark):
    r = lambda s, t: X.resolve(F.lit(s), F.lit(t))
    got = one(spark, a=r("xl/worksheets/s.xml", "../drawings/d.xml"), b=r("xl/workbook.xml", "/xl/x.xml"), c=r("a.xml", "../../b"), d=X.formula_ref(F.lit("'It''s'!$A$1"))["sheet"], e=X.formula_ref(F.lit("A1")))
    assert got == {"a": "xl/drawings/d.xml", "b": "xl/x.xml", "c": "../../b", "d": "It's", "e": None}


def marker(k: str) -> str:
    return f"> [Image, docx media {k * 12} — raster content not analyzed]"


def test_enhancement_with_scripted_client(spark):
    group = f"> [Figure, docx group {'c' * 12} — composite content not analyzed]\n> captions: Alpha; 42"
    md = f"# D\n\n{marker('a')}\n\n{group}\n\n{marker('b')}\n{marker('d')}"
    docs = spark.createDataFrame([("x", md), ("y", "plain")], "source_id string, markdown string")
    images = spark.createDataFrame([(k * 12, f"data:image/png;base64,{k}") for k in "abc"], "id12 string, uri string")
    cache = spark.createDataFrame([("a" * 12, "old", "# Known", None), (None, "m", "t", None), ("b" * 12, None, "t", None)], "id12 string, model string, markdown string, judge_verdict array<string>")

    def client(prompt: str, uri: str, model: str):
        if uri.endswith(",b"):
            raise RuntimeError("no: Bearer abcdef")
        return "hallucination: yes\nmermaid_fit: no\nlanguage: yes" if "hallucination" in prompt else "Seen it"

    found = figures.markers(docs, "source_id")
    assert [(r.place, r.kind, r.id12[0], r.witness) for r in found.orderBy("place").collect()] == [(0, "image", "a", None), (1, "group", "c", "Alpha; 42"), (2, "image", "b", None), (3, "image", "d", None)]
    fresh, failed = figures.refreshed(found, images, cache, client, "m-1", ("j1", "j2"))
    assert [(r.id12[0], r.error) for r in failed.collect()] == [("b", "no: ***REDACTED***")]
    assert {r.id12[0]: (r.model, r.judge_verdict) for r in fresh.collect()} == {"a": ("old", ["vlm-judge-hallucination", "vlm-judge-mermaid"]), "c": ("m-1", ["vlm-judge-hallucination", "vlm-judge-mermaid"])}
    got = {r.source_id: r for r in figures.inject(docs, fresh, "source_id", verify=True).collect()}
    assert got["y"].markdown == "plain" and not got["y"].vlm_used
    assert got["x"].vlm_used and marker("b") in got["x"].markdown and marker("d") in got["x"].markdown
    assert f"> [Image, docx media {'a' * 12} — VLM interpretation (old); reconstruction, verify against original]\n\n**Known**\n\n> [/VLM interpretation docx media {'a' * 12}]" in got["x"].markdown
    assert got["x"].vlm_warnings == [f"vlm-judge-hallucination: {'a' * 12}", f"vlm-judge-mermaid: {'a' * 12}", f"figure-witness-recall: {'c' * 12} 0.00", f"figure-witness-numeric: {'c' * 12} witness_only=[42]", f"vlm-judge-hallucination: {'c' * 12}", f"vlm-judge-mermaid: {'c' * 12}"]
    errors = figures.ask(images.where("uri like '%,b'"), client, "m").first()
    assert errors.answer is None and errors.error == "no: ***REDACTED***"


def test_html():
    page = "<html><head><title>t</title></head><body><h2>A  b</h2><p>x <b>bold</b> *y*<br>z</p><ul><li>one<li>two</ul><ol><li>n</ol><a href='/u'>link</a><script>var t='</p>'</script><table><tr><td>1<td>2</table></body>"
    assert html.to_markdown(page) == "## A b\n\nx **bold** \\*y\\*  \nz\n\n* one\n* two\n\n1. n\n\n[link](/u)\n\n|  |  |\n| --- | --- |\n| 1 | 2 |"
    assert html.to_markdown(None) is None and html.to_markdown("") == ""
