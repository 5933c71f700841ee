import io
import json
import os
import struct
import time
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkweave import cli, engine
from inkweave.sources import builder as B
from inkweave.sources import packages as P
from inkweave.sources.batch import walk
from inkweave.sources.xmltree import BadXml, parse
from inkweave.streaming import ingest

IMAGE, OTHER = bytes(range(256)) * 40, bytes(reversed(range(256))) * 30
BARS = B.chart("barChart", "Regional", ["a", "b"], [("s", [1, 2.5])], "0.0")
EMPTY = B.chart("barChart", "Empty", [], [("s", [])], cached=False)


@pytest.fixture(scope="module")
def results(spark):
    body = (
        B.paragraph("Тест 😀", "Heading2") + B.paragraph("b*ld", props="<w:b/>") + B.paragraph("one", num="1") + B.paragraph("two", num="2") + B.picture("rId1") + B.picture("rId5") + B.grid([["a", "b"], ["1", "2"]])
        + B.group(["Alpha", "12", "Alpha"], ["rId3"]) + B.chart_anchor("rId2") + B.chart_anchor("rId4") + B.chart_anchor("rId99")
    )
    links = {"rId1": ("image", "media/i.png"), "rId3": ("image", "media/g.png"), "rId2": ("chart", "charts/c1.xml"), "rId4": ("chart", "/word/charts/c2.xml"), "rId5": ("image", "media/s.png"), "rId6": ("image", "media/h.png")}
    numbering = '<w:numbering xmlns:w="urn:w"><w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:numFmt w:val="decimal"/></w:lvl></w:abstractNum><w:num w:numId="2"><w:abstractNumId w:val="0"/></w:num></w:numbering>'
    header = {"word/header1.xml": '<h><x id="rId7"/></h>', "word/_rels/header1.xml.rels": B.rels({"rId7": ("image", "media/lost.png"), "rId8": ("image", "media/orphan.png")}), "word/numbering.xml": numbering}
    media = {"i.png": IMAGE, "g.png": OTHER, "s.png": b"small", "lost.png": IMAGE + b"x", "orphan.png": IMAGE + b"y"}
    styles = '<styleSheet><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="20"/></cellXfs></styleSheet>'
    rows = [["N", "V", None], ["x\ny", 5.0, True], [None, None, "z"], [0.1, 1e21, (44197.5, 1)], [(44197, 2), (0.25, 3), -3]]
    book = B.xlsx([{"name": "D", "rows": rows, "anchors": [(3, 8, [BARS, EMPTY]), (28, 1, [B.chart("lineChart", None, [], [("s", [1, None])])])]}, {"name": "E", "rows": [], "state": "hidden"}, {"name": "C", "rows": [], "anchors": [(0, 0, [BARS])]}], {"xl/styles.xml": styles})
    items = [("a", "docx", B.docx(body, media, {"c1.xml": BARS, "c2.xml": EMPTY}, links, header)), ("b", "xlsx", book), ("c", "docx", b""), ("d", "docx", book), ("e", "xlsx", book[:400]), ("f", None, b"x"), ("g", "docx", B.docx("")), ("h", "docx", B.archive({"word/document.xml": "<a"})), ("i", "xlsx", None)]
    return {r.source_id: r for r in engine.convert(engine.in_memory(spark, items)).collect()}


def test_statuses(results):
    assert {k: r.status for k, r in results.items()} == {"a": "ok", "b": "ok", "c": "corrupt_archive", "d": "unsupported_format", "e": "corrupt_archive", "f": "unsupported_format", "g": "ok", "h": "unsupported_format", "i": "corrupt_archive"}
    assert results["g"].markdown == "\n" and results["g"].warnings == ["no extractable content"] and results["c"].markdown is None


def test_document(results):
    r = results["a"]
    assert (r.charts_found, r.charts_rendered, r.groups_found) == (3, 1, 1)
    md = r.markdown
    order = ["## Тест 😀", "**b\\*ld**", "* one\n1. two", "> [Image, docx media ", "|  |  |\n| --- | --- |\n| a | b |\n| 1 | 2 |", "> [Figure, docx group ", "> captions: Alpha; old", "Regional\n\n```mermaid", "> [Figure, docx chart ", "> captions: Empty", "> captions: (no captions)", "## Figures (position unknown)"]
    places = [md.find(x) for x in order]
    assert -1 not in places and places == sorted(places)
    lost = md.split("## Figures (position unknown)\n\n")[1]
    assert lost.count("[Image") == 1  # neither placed, nor of the group, nor orphaned, nor small


def test_workbook(results):
    r = results["b"]
    assert (r.charts_found, r.charts_rendered) == (4, 3)
    assert r.markdown.startswith("## D\n\n| N | V |  |\n| --- | --- | --- |\n| x y | 5 | True |\n|  |  | z |\n| 0.1 | 1000000000000000000000 | 2021-01-01T12:00:00 |\n| 2021-01-01T00:00:00 | 06:00:00 | -3 |\n\n> sheet D, anchor AC2\n\n")
    assert '## E (hidden)\n\n> [Sheet "E" — empty, skipped]\n\n## C\n\n> sheet C, anchor A1\n\nRegional' in r.markdown
    assert "— chart content not analyzed]\n> captions: Empty" in r.markdown and " on D!D9 " in r.markdown


def test_declared_and_actual_sizes():
    big = io.BytesIO()
    with zipfile.ZipFile(big, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", b"0" * 5_000_000)
    with zipfile.ZipFile(io.BytesIO(big.getvalue())) as z:
        for limits in ({"max_member": 1000}, {"max_total": 1000}, {"max_entries": 0}):
            with pytest.raises(P.Refused):
                P.check(z, **limits)
        with pytest.raises(P.Refused):
            P.read(z, "word/document.xml", 1000)
    spoofed = bytearray(big.getvalue())
    at = spoofed.rfind(b"PK\x01\x02")
    spoofed[at + 24 : at + 28] = struct.pack("<I", 100)
    assert P.shred_bytes(bytes(spoofed), "docx")["status"] in ("corrupt_archive", "unsupported_format")
    many = B.archive({f"p{k}": "" for k in range(10_001)})
    assert P.shred_bytes(many, "docx")["status"] == "corrupt_archive"


def test_hostile_xml():
    for bad in (b'<!DOCTYPE a [<!ENTITY x "y">]><a>&x;</a>', b"<a>" * 300 + b"</a>" * 300, b"", b"<a>", b"<a><b></a>"):
        with pytest.raises(BadXml):
            parse(bad)
    assert parse(b'<a x="1">t<b/>u</a>').texts() == ["t", "u"]


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=4096), st.sampled_from(["docx", "xlsx"]))
def test_any_bytes(data, form):
    assert P.shred_bytes(data, form)["status"] in ("corrupt_archive", "unsupported_format")
    part = "word/document.xml" if form == "docx" else "xl/workbook.xml"
    assert P.shred_bytes(B.archive({part: data}), form)["status"] in ("ok", "unsupported_format")


def test_far_stray_cell(spark):
    def sheet(cells):
        rows = "".join(f'<s:row r="{r}"><s:c r="{ref}"><s:v>{v}</s:v></s:c></s:row>' for r, ref, v in cells)
        return f"<s:worksheet {B._SPACES}><s:sheetData>{rows}</s:sheetData></s:worksheet>"

    book = B.xlsx([{"name": "S", "rows": []}, {"name": "T", "rows": []}], {})
    parts = {n: zipfile.ZipFile(io.BytesIO(book)).read(n) for n in zipfile.ZipFile(io.BytesIO(book)).namelist()}
    parts["xl/worksheets/sheet1.xml"] = sheet([(1, "A1", 1), (1000000, "F1000000", 2)])
    parts["xl/worksheets/sheet2.xml"] = sheet([(1, "B1", 1), (4, "A4", 2)])
    r = engine.convert(engine.in_memory(spark, [("a", "xlsx", B.archive(parts))])).first()
    assert r.status == "ok"
    assert r.markdown == "## S\n\n| 1 |\n| --- | --- | --- | --- | --- | --- |\n| (999998 blank rows) |\n|  |  |  |  |  | 2 |\n\n## T\n\n|  | 1 |\n| --- | --- |\n|  |  |\n|  |  |\n| 2 |  |\n"


def test_sheet_table_is_linear(spark):
    from inkweave.operators import sheets

    def seconds(n):
        cell = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda c: F.struct(c.cast("int").alias("c"), F.lit("str").alias("t"), F.lit("x").alias("v"), F.lit(0).alias("s")))
        rows = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda r: F.struct(r.cast("int").alias("r"), cell.alias("cells"))).alias("rows")).persist()
        rows.count()
        none = F.array().cast("array<string>")
        took = []
        for _ in range(2):
            began = time.perf_counter()
            assert rows.select(F.length(sheets.table_text(F.col("rows"), none, none, F.lit(False)))).first()[0] > 10 * n
            took.append(time.perf_counter() - began)
        rows.unpersist()
        return min(took)

    seconds(100)
    assert seconds(40_000) < 30 * (seconds(4_000) + 0.2)


def test_times(spark):
    from inkweave.operators import sheets

    serials = [36526.5000001157, 0.5, 1.5, -1.25, 60.0, 59.0]
    df = spark.createDataFrame([(x,) for x in serials], "x double")
    got = df.select(sheets.iso(F.col("x"), F.lit(False)), sheets.elapsed(F.col("x"))).collect()
    assert [r[0] for r in got[:3]] == ["2000-01-01T12:00:00.010000", "12:00:00", "1900-01-01T12:00:00"] and got[5][0] == "1900-02-28T00:00:00"
    assert [r[1] for r in got[1:4]] == ["12:00:00", "1 day, 12:00:00", "-2 days, 18:00:00"]


def test_package_of_one_figure():
    xml = BARS
    doc = B.docx(B.paragraph("before") + B.group(["Alpha"]) + B.chart_anchor("rId1") + B.paragraph("after"), charts={"chart1.xml": xml}, links={"rId1": ("chart", "charts/chart1.xml")})
    for f in P.shred_bytes(doc, "docx")["figures"]:
        small = P.shred_bytes(P.figure_package(doc, f["id12"]), "docx")
        assert small["status"] == "ok" and [x["id12"] for x in small["figures"]] == [f["id12"]] and len(small["blocks"]) == 1 and len(small["parts"]) == len(P.shred_bytes(doc, "docx")["parts"])
    assert P.figure_package(doc, "0" * 12) is None


def test_cells_keep_inner_text():
    cell = B.nest("w:tc", B.paragraph("a") + B.grid([["b", "c"]]) + B.nest("w:sdt w:sdtContent", B.paragraph("d")) + B.paragraph("e", num="1"))
    got = P.shred_bytes(B.docx("<w:tbl>" + B.nest("w:sdt w:sdtContent w:tr", cell) + "</w:tbl>"), "docx")
    assert len(got["blocks"]) == 1 and ["".join(r["text"] for r in c["runs"]) for row in got["blocks"][0]["cells"] for c in row] == ["a b c d e"]


def test_ids_differ_by_content():
    a, b = parse(BARS.encode()), parse(EMPTY.encode())
    assert a.id12() == parse(BARS.encode()).id12() != b.id12()


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in/sub").mkdir(parents=True)
    doc = B.docx(B.paragraph("Hello"))
    (tmp_path / "in/a.docx").write_bytes(doc)
    (tmp_path / "in/sub/b.XLSX").write_bytes(B.xlsx([{"name": "S", "rows": [["x"]]}]))
    (tmp_path / "in/sub/bad.docx").write_bytes(b"no")
    (tmp_path / "in/note.txt").write_text("no")
    os.symlink(tmp_path / "in/a.docx", tmp_path / "in/link.docx")
    assert [r for _, r in walk([tmp_path / "in", tmp_path / "in/a.docx"])] == ["a.docx", "sub/b.XLSX", "sub/bad.docx"]
    run = lambda *a: cli.main([str(x) for x in a], spark)
    assert run(tmp_path / "in", "-o", tmp_path / "out") == 1
    assert (tmp_path / "out/a.md").read_text() == "Hello\n" and (tmp_path / "out/sub/b.md").read_text() == "## S\n\n| x |\n| --- |\n"
    assert "2/3 converted, 1 failed" in capsys.readouterr().err
    assert run(tmp_path / "in/a.docx", "--json") == 0
    assert json.loads(capsys.readouterr().out)["markdown"] == "Hello\n"
    assert run(tmp_path / "in/sub/bad.docx") == 4
    (tmp_path / "x/sub").mkdir(parents=True)
    (tmp_path / "x/a.docx").write_bytes(doc)
    assert run(tmp_path / "in", tmp_path / "x", "-o", tmp_path / "out") == 2
    for wrong in (["nowhere.docx"], [tmp_path / "in/note.txt"], [tmp_path / "in"], []):
        with pytest.raises(SystemExit) as e:
            run(*wrong)
        assert e.value.code == 2


def test_stream_converts_each_file_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.docx").write_bytes(B.docx(B.paragraph("One")))
    go = lambda: ingest.convert_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    go()
    (tmp_path / "in/b.docx").write_bytes(B.docx(B.paragraph("Two")))
    go()
    go()
    assert sorted(r.markdown for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["One\n", "Two\n"]
