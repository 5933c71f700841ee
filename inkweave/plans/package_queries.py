"""Queries on sheets, relationships, media, batches and whole packages, with their DuckDB text."""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkweave import engine
from inkweave.functions import html
from inkweave.functions import text as X
from inkweave.operators import package, sheets
from inkweave.sources import batch, builder
from inkweave.sources import builder as B
from inkweave.sources.tables import shared_dir, spread, stored, table
from inkweave.streaming import ingest


def anchor_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of all parts, and each one's rank on its sheet by row and column."""
    df = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("sheet"), (F.col("p_partkey") * 7919 % 18000).alias("col"), F.col("p_size").alias("row"))
    rank = F.row_number().over(Window.partitionBy("sheet").orderBy("row", "col", "p_partkey"))
    return df.select("p_partkey", X.cell_name(F.col("col"), F.col("row")).alias("cell"), rank.cast("long").alias("place"))


ANCHOR_CELL = """
WITH t AS (SELECT p_partkey, p_brand, p_partkey * 7919 % 18000 AS c, p_size AS r FROM part)
SELECT p_partkey, CASE WHEN c < 26 THEN chr((65 + c)::INT) WHEN c < 702 THEN chr((65 + (c - 26) // 26)::INT) || chr((65 + (c - 26) % 26)::INT)
  ELSE chr((65 + (c - 702) // 676)::INT) || chr((65 + (c - 702) // 26 % 26)::INT) || chr((65 + (c - 702) % 26)::INT) END || (r + 1) AS cell,
  row_number() OVER (PARTITION BY p_brand ORDER BY r, c, p_partkey) AS place FROM t"""


def _sheets(spark: SparkSession, sf_dir: str, least: float) -> DataFrame:
    """A sheet per nation: its customers under a balance, as rows of three cells, of which the middle is blank."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    cell = lambda c, t, v: F.struct(F.lit(c).alias("c"), F.lit(t).alias("t"), v.cast("string").alias("v"), F.lit(0).alias("s"))
    rows = table(spark, sf_dir, "customer").where(F.col("c_acctbal") < least)
    n = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    rows = rows.select("c_nationkey", F.struct((n + 1).alias("r"), F.array(cell(1, "n", F.col("c_custkey")), cell(3, "str", F.concat(F.lit(" "), F.col("c_name"), F.lit("\n"), F.col("c_mktsegment")))).alias("cells")).alias("x"))
    head = F.array(F.struct(F.lit(1).alias("r"), F.array(cell(1, "str", F.lit("key")), cell(2, "str", F.lit("-")), cell(3, "str", F.lit("name"))).alias("cells")))
    grouped = rows.groupBy("c_nationkey").agg(F.concat(head, F.array_sort(F.collect_list("x"), lambda a, b: a["r"] - b["r"])).alias("rows"))
    return nation.join(grouped, F.col("n_nationkey") == F.col("c_nationkey"), "left")


def _section(df: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    body = F.when(F.col("rows").isNotNull(), sheets.table_text(F.col("rows"), none, none, F.lit(False)))
    state = F.when(F.col("n_regionkey") == 0, "hidden").otherwise("visible")
    return df.select("n_nationkey", F.sha2(sheets.section(F.col("n_name"), state, body, F.lit(None).cast("string")).cast("binary"), 256).alias("section_sha256"), body.isNull().alias("empty"))


def sheet_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _section(_sheets(spark, sf_dir, 1e9))


def sheet_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _section(_sheets(spark, sf_dir, -985.0))


def _sheet_sql(least: str) -> str:
    return f"""
WITH b AS (SELECT c_nationkey, '| key | - | name |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || c_custkey || ' |  | ' || c_name || ' ' || c_mktsegment || ' |', chr(10) ORDER BY c_custkey) AS body
  FROM customer WHERE c_acctbal < {least} GROUP BY 1)
SELECT n_nationkey, sha256('## ' || n_name || CASE WHEN n_regionkey = 0 THEN ' (hidden)' ELSE '' END || chr(10) || chr(10) || coalesce(body, '> [Sheet "' || n_name || '" — empty, skipped]')) AS section_sha256, body IS NULL AS empty
FROM nation LEFT JOIN b ON n_nationkey = c_nationkey"""


SHEET_TABLE, SHEET_EMPTY = _sheet_sql("1e9"), _sheet_sql("-985.0")


def rel_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as parts: targets resolved from each url's folder, then followed to the customer of that key."""
    part = F.regexp_extract("url", r"^[a-z]+://([^?#]*)", 1)
    target = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("/pages//"), F.col("page_id").cast("string"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("../x/./"), F.col("page_id").cast("string"))).otherwise(F.concat(F.lit("a/../b/"), F.col("page_id").cast("string")))
    df = table(spark, sf_dir, "pages").select("page_id", part.alias("source_part"), target.alias("target"))
    links = df.select(F.lit("all").alias("source_id"), "source_part", F.col("page_id").cast("string").alias("rel_id"), X.resolve(F.col("source_part"), F.col("target")).alias("part"), "page_id")
    asked = df.select(F.lit("all").alias("source_id"), F.col("source_part").alias("at"), F.col("page_id").cast("string").alias("rid"), "page_id")
    followed = package.follow(asked, links.drop("page_id"), "at", "rid", "part")
    names = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return followed.join(names, F.col("page_id") == F.col("c_custkey"), "left").select("page_id", "part", "c_name")


REL_RESOLUTION = r"""
WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^?#]*)', 1) AS s FROM pages),
f AS (SELECT *, regexp_extract(s, '^(.*/)?[^/]*$', 1) AS folder FROM p)
SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'pages/' || page_id WHEN 1 THEN regexp_replace(rtrim(folder, '/'), '[^/]+$', '') || 'x/' || page_id ELSE folder || 'b/' || page_id END AS part, c_name
FROM f LEFT JOIN customer ON page_id = c_custkey"""


def media_id12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as media: large ones that the labels refer to and that no good label has placed, each content at its first name."""
    labels = table(spark, sf_dir, "labels")
    media = table(spark, sf_dir, "documents").select("doc_id", F.format_string("media/%012d", "doc_id").alias("part"), F.col("text").cast("binary").alias("content"))
    media = media.select("doc_id", "part", X.id12(F.col("content")).alias("id12"), F.octet_length("content").cast("long").alias("n_bytes")).where("n_bytes >= 2000")
    known = media.join(labels, "doc_id", "left_semi").join(labels.where("quality = 0"), "doc_id", "left_anti")
    first = known.groupBy("id12").agg(F.min(F.struct("part", "n_bytes")).alias("m")).select("id12", "m.part", "m.n_bytes")
    return first.withColumn("marker", X.image_marker(F.col("id12")))


MEDIA_ID12 = """
WITH m AS (SELECT doc_id, 'media/' || lpad(doc_id::VARCHAR, 12, '0') AS part, sha256(text)[:12] AS id12, octet_length(encode(text))::BIGINT AS n_bytes FROM documents)
SELECT id12, min(part) AS part, arg_min(n_bytes, part) AS n_bytes, '> [Image, docx media ' || id12 || ' — raster content not analyzed]' AS marker
FROM m WHERE n_bytes >= 2000 AND doc_id IN (SELECT doc_id FROM labels) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0) GROUP BY id12"""


def formula_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheet and range of formulas made of customers' names; some have quotes, some no sheet."""
    k = F.col("c_custkey")
    f = F.when(k % 4 == 0, F.concat(F.lit("'"), F.col("c_mktsegment"), F.lit("''s "), k.cast("string"), F.lit("'!$A$"), k.cast("string"))).when(k % 4 == 1, F.concat(F.col("c_name"), F.lit("!B"), k.cast("string"))).when(k % 4 == 2, F.lit("!C1")).otherwise(F.lit("D1"))
    return table(spark, sf_dir, "customer").select("c_custkey", X.formula_ref(f).alias("r")).select("c_custkey", F.col("r.sheet").alias("sheet"), F.col("r.range").alias("range"))


FORMULA_REF = """
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_mktsegment || '''s ' || c_custkey WHEN 1 THEN c_name END AS sheet, CASE c_custkey % 4 WHEN 0 THEN '$A$' || c_custkey WHEN 1 THEN 'B' || c_custkey END AS range FROM customer"""


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urls as a listing: path without host, html pages as documents, others as workbooks or text."""
    path = F.regexp_extract("url", r"^[a-z]+://[^/]*/([^?#]*)", 1)
    made = F.when(path.endswith(".html"), F.regexp_replace(path, "html$", "DOCX")).when(path.endswith("/"), F.concat(F.regexp_replace(path, "/$", ""), F.lit(".xlsx"))).otherwise(F.concat(path, F.lit(".txt")))
    return table(spark, sf_dir, "pages").select(F.regexp_replace(made, r"\d(\.[a-zA-Z]+)$", "$1").alias("path"), F.col("page_id").alias("ord"))


_LISTING = r"""l AS (SELECT page_id AS ord, regexp_extract(url, '^[a-z]+://[^/]*/([^?#]*)', 1) AS p FROM pages),
m AS (SELECT ord, regexp_replace(CASE WHEN p LIKE '%.html' THEN regexp_replace(p, 'html$', 'DOCX') WHEN p LIKE '%/' THEN regexp_replace(p, '/$', '') || '.xlsx' ELSE p || '.txt' END, '\d(\.[a-zA-Z]+)$', '\1') AS path FROM l),
k AS (SELECT path, min(ord) AS ord FROM m WHERE regexp_matches(lower(path), '[^/]\.(docx|xlsx)$') GROUP BY path)"""


def batch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.plan(_listing(spark, sf_dir)).select("path", "ord", batch.output_name(F.col("path")).alias("output"))


BATCH_PLAN = rf"""WITH {_LISTING} SELECT path, ord, regexp_replace(path, '\.[^./]*$', '') || '.md' AS output FROM k"""


def collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.collisions(batch.plan(_listing(spark, sf_dir)), "path").select("output", F.array_join("inputs", ";").alias("inputs"))


COLLISIONS = rf"""WITH {_LISTING} SELECT regexp_replace(path, '\.[^./]*$', '') || '.md' AS output, string_agg(path, ';' ORDER BY path) AS inputs FROM k GROUP BY 1 HAVING count(*) > 1"""


def html_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.with_markdown(spread(table(spark, sf_dir, "pages")), "page_id")


def package_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workbook per nation with its customers' orders by year, as cells and as a chart; built, shredded, converted."""
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    years = orders.groupBy("c_nationkey", F.year("o_orderdate").alias("y")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("v"))
    facts = years.groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("y", "v"))).alias("rows"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for rows in b.column("rows").to_pylist():
                cats, values = [str(r["y"]) for r in rows], [r["v"] for r in rows]
                xml = builder.chart("barChart", "Orders", cats, [("Total", values)], "#,##0.00", "Value", '<c:barDir val="col"/>')
                made.append(builder.xlsx([{"name": "Years", "rows": [["Year", "Total"], *([r["y"], r["v"]] for r in rows)], "anchors": [(3, 1, [xml])]}, {"name": "Rest", "rows": [], "state": "hidden"}]))
            yield pa.record_batch([pa.array([f"{k}.xlsx" for k in b.column("c_nationkey").to_pylist()]), pa.array(["xlsx"] * b.num_rows), pa.array(made, pa.binary())], names=["source_id", "format", "content"])

    got = engine.convert(facts.mapInArrow(build, "source_id string, format string, content binary"))
    return got.select("source_id", "status", F.sha2(F.col("markdown").cast("binary"), 256).alias("md_sha256"), "charts_found", "charts_rendered")


PACKAGE_ROUNDTRIP = """
WITH t AS (SELECT c_nationkey, year(o_orderdate) AS y, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
g AS (SELECT c_nationkey, string_agg('| ' || y || ' | ' || CASE WHEN v = trunc(v) THEN v::BIGINT::VARCHAR ELSE v::VARCHAR END || ' |', chr(10) ORDER BY y) AS cells, string_agg('"' || y || '"', ', ' ORDER BY y) AS axis,
  string_agg(format('{:.4g}', v), ', ' ORDER BY y) AS vals, least(0, min(v)) AS lo, max(v) AS hi, string_agg('| ' || y || ' | ' || format('{:,.2f}', v) || ' |', chr(10) ORDER BY y) AS body FROM t GROUP BY 1),
m AS (SELECT *, '## Years' || chr(10) || chr(10) || '| Year | Total |' || chr(10) || '| --- | --- |' || chr(10) || cells || chr(10) || chr(10) || '> sheet Years, anchor D2' || chr(10) || chr(10) || 'Orders — Value' || chr(10) || chr(10)
  || '```mermaid' || chr(10) || 'xychart-beta' || chr(10) || 'x-axis [' || axis || ']' || chr(10) || 'y-axis "Value" ' || format('{:.4g}', lo) || ' --> ' || format('{:.4g}', hi) || chr(10) || 'bar [' || vals || ']' || chr(10) || '```' || chr(10) || chr(10)
  || '| Category | Total |' || chr(10) || '| --- | --- |' || chr(10) || body || chr(10) || chr(10) || '## Rest (hidden)' || chr(10) || chr(10) || '> [Sheet "Rest" — empty, skipped]' || chr(10) AS md FROM g)
SELECT c_nationkey || '.xlsx' AS source_id, 'ok' AS status, sha256(md) AS md_sha256, 1 AS charts_found, 1 AS charts_rendered FROM m"""


def _years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per nation its orders by year, as ``c_nationkey, n_name, rows`` (y, n)."""
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    years = orders.groupBy("c_nationkey", F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))
    facts = years.groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("y", "n"))).alias("rows"))
    return facts.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_nationkey", "n_name", "rows")


def _packed(facts: DataFrame, form: str, make) -> DataFrame:
    """One package a row, made by ``make(key, name, rows)`` on the executors."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column("c_nationkey").to_pylist()
            made = [make(*x) for x in zip(keys, b.column("n_name").to_pylist(), b.column("rows").to_pylist())]
            yield pa.record_batch([pa.array([f"{k}.{form}" for k in keys]), pa.array([form] * b.num_rows), pa.array(made, pa.binary())], names=["source_id", "format", "content"])

    return facts.mapInArrow(build, "source_id string, format string, content binary")


def _told(got: DataFrame, *more: str) -> DataFrame:
    """Results with ids of figures, which hash their XML, left out."""
    shown = F.regexp_replace("markdown", r"(docx group|docx chart|xlsx chart) [0-9a-f]{12}", "$1 ID")
    return got.select("source_id", "status", F.sha2(shown.cast("binary"), 256).alias("md_sha256"), "charts_found", "charts_rendered", "groups_found", F.array_join("warnings", ";").alias("warnings"), *more)


def workbook_charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workbook per nation with charts of many kinds: several at an anchor, sparse, stacked, combined, without a cache; typed cells on a hidden sheet."""

    def make(key, name, rows):
        cats, n = [str(r["y"]) for r in rows], [r["n"] for r in rows]
        sparse = B.chart("lineChart", "Sparse", cats, [("Even", [r["n"] if r["y"] % 2 == 0 else None for r in rows])], "0")
        stacked = B.chart("barChart", "Stacked", cats, [("A", n), ("B", n)], "0", None, '<c:barDir val="bar"/><c:grouping val="stacked"/>')
        both = B.combined(B.chart("barChart", "Both", cats, [("Orders", n)], "0", "Count", '<c:barDir val="col"/>'), B.chart("lineChart", None, cats, [("Twice", [2 * x for x in n])], "0"))
        pie = B.chart("pieChart", "Pie (all)", cats, [("", n)], "0.0")
        area = B.chart("areaChart", None, [], [("Bare", n)], None)
        empty = B.chart("barChart", "Empty", cats, [("A", n)], "0", cached=False)
        anchors = [(5, 10, [pie]), (3, 1, [sparse, stacked]), (0, 1, [both]), (7, 20, [empty]), (27, 30, [area])]
        formats = '<s:numFmts><s:numFmt numFmtId="164" formatCode="[h]:mm"/><s:numFmt numFmtId="165" formatCode="yyyy\\-mm"/></s:numFmts><s:cellXfs>' + "".join(f'<s:xf numFmtId="{k}"/>' for k in (0, 14, 164, 165, 21)) + "</s:cellXfs>"
        typed = [["what", "value"], ["flag", key % 2 == 0], ["day", (36526 + key, 1)], ["moment", (36526.25 + key, 3)], ["span", (1.5 + key, 2)], ["clock", (0.75, 4)], ["tick", (0.000005787037037, 4)], ["whole", 5.0], ["part", 0.25], [None, None], [" two\nlines ", "x"]]
        return B.xlsx([{"name": "Data", "rows": [["Year", "Orders"], *([r["y"], r["n"]] for r in rows)], "anchors": anchors}, {"name": "Types", "state": "hidden", "rows": typed}], {"xl/styles.xml": f"<s:styleSheet {B._SPACES}>{formats}</s:styleSheet>"})

    return _told(engine.convert(_packed(_years(spark, sf_dir), "xlsx", make)))


_YEARS = """t AS (SELECT c_nationkey AS k, year(o_orderdate) AS y, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""
_LINES = "chr(10) || chr(10)"

WORKBOOK_CHARTS = f"""
WITH {_YEARS},
g AS (SELECT k, string_agg('| ' || y || ' | ' || n || ' |', chr(10) ORDER BY y) AS cells, string_agg('"' || y || '"', ', ' ORDER BY y) AS axis, string_agg(format('{{:.4g}}', n::DOUBLE), ', ' ORDER BY y) AS one, string_agg(format('{{:.4g}}', 2.0 * n), ', ' ORDER BY y) AS two, max(2 * n)::DOUBLE AS top, max(n)::DOUBLE AS high,
  string_agg('    "' || y || '" : ' || format('{{:.4g}}', n::DOUBLE), chr(10) ORDER BY y) AS slices,
  string_agg('| ' || y || ' | ' || CASE WHEN y % 2 = 0 THEN format('{{:,}}', n) ELSE '' END || ' |', chr(10) ORDER BY y) AS even, string_agg('| ' || y || ' | ' || format('{{:,}}', n) || ' | ' || format('{{:,}}', n) || ' |', chr(10) ORDER BY y) AS stack,
  string_agg('| ' || y || ' | ' || format('{{:,}}', n) || ' | ' || format('{{:,}}', 2 * n) || ' |', chr(10) ORDER BY y) AS pair, string_agg('| ' || y || ' | ' || format('{{:,.1f}}', n::DOUBLE) || ' |', chr(10) ORDER BY y) AS pied FROM t GROUP BY 1),
b AS (SELECT k, string_agg('| ' || i || ' | ' || format('{{:.4g}}', n::DOUBLE) || ' |', chr(10) ORDER BY i) AS bare FROM (SELECT k, n, row_number() OVER (PARTITION BY k ORDER BY y) AS i FROM t) GROUP BY 1),
m AS (SELECT k, '## Data' || {_LINES} || '| Year | Orders |' || chr(10) || '| --- | --- |' || chr(10) || cells
  || {_LINES} || '> sheet Data, anchor A2' || {_LINES} || 'Both — Count' || {_LINES} || '```mermaid' || chr(10) || 'xychart-beta' || chr(10) || 'x-axis [' || axis || ']' || chr(10) || 'y-axis "Count" 0 --> ' || format('{{:.4g}}', top) || chr(10) || 'bar [' || one || ']' || chr(10) || 'line [' || two || ']' || chr(10) || '```' || {_LINES} || '| Category | Orders | Twice |' || chr(10) || '| --- | --- | --- |' || chr(10) || pair
  || {_LINES} || '> sheet Data, anchor D2' || {_LINES} || 'Sparse' || {_LINES} || '| Category | Even |' || chr(10) || '| --- | --- |' || chr(10) || even
  || {_LINES} || '> sheet Data, anchor D2' || {_LINES} || 'Stacked' || {_LINES} || '| Category | A | B |' || chr(10) || '| --- | --- | --- |' || chr(10) || stack
  || {_LINES} || '> sheet Data, anchor F11' || {_LINES} || 'Pie (all)' || {_LINES} || '```mermaid' || chr(10) || 'pie title Pie all' || chr(10) || slices || chr(10) || '```' || {_LINES} || '| Category | Series 1 |' || chr(10) || '| --- | --- |' || chr(10) || pied
  || {_LINES} || '> [Figure, xlsx chart ID on Data!H21 — chart content not analyzed]' || chr(10) || '> captions: Empty'
  || {_LINES} || '> sheet Data, anchor AB31' || {_LINES} || '| Category | Bare |' || chr(10) || '| --- | --- |' || chr(10) || bare
  || {_LINES} || '## Types (hidden)' || {_LINES} || '| what | value |' || chr(10) || '| --- | --- |' || chr(10) || '| flag | ' || CASE WHEN k % 2 = 0 THEN 'True' ELSE 'False' END || ' |' || chr(10) || '| day | ' || strftime(DATE '2000-01-01' + k::INT, '%Y-%m-%dT00:00:00') || ' |' || chr(10) || '| moment | ' || strftime(DATE '2000-01-01' + k::INT, '%Y-%m-%dT06:00:00') || ' |' || chr(10)
  || '| span | ' || (k + 1) || CASE WHEN k = 0 THEN ' day' ELSE ' days' END || ', 12:00:00 |' || chr(10) || '| clock | 18:00:00 |' || chr(10) || '| tick | 00:00:00.500000 |' || chr(10) || '| whole | 5 |' || chr(10) || '| part | 0.25 |' || chr(10) || '|  |  |' || chr(10) || '| two lines | x |' || chr(10) AS md FROM g JOIN b USING (k))
SELECT k || '.xlsx' AS source_id, 'ok' AS status, sha256(md) AS md_sha256, 6 AS charts_found, 5 AS charts_rendered, 0 AS groups_found, '' AS warnings FROM m"""


def document_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word document per nation: headings, marks, links, lists, notes, a table with spans, images around the least size, a group, charts with and without values."""

    def make(key, name, rows):
        cats, n = [str(r["y"]) for r in rows], [r["n"] for r in rows]
        p, run = B.paragraph, lambda t: B.nest("w:r w:t", t)
        image = lambda size: (name * size)[:size].encode()
        tall = lambda t: B.nest("w:tc", B.nest("w:tcPr", B.nest("w:gridSpan", w__val="2")) + p(t))
        small = lambda *t: "".join(B.nest("w:tc", x) for x in t)
        body = (
            p(f"{name} report", "Heading1") + p("strong *text*", props="<w:b/>") + p("See ", more=B.nest("w:hyperlink", run("the site"), r__id="rId1") + run(" now") + B.note("footnote", "4") + B.note("endnote", "2"))
            + p("first", num="1") + p("second", num="1") + p("inner", num="2", level=1) + p("third", num="1") + p("point", num="2") + p("") + p("again", num="1")
            + "<w:tbl>" + B.nest("w:tr", tall("Years")) + "".join(B.nest("w:tr", small(p(c), p(str(x)) + p("orders"))) for c, x in zip(cats, n)) + B.nest("w:tr", small(B.grid([["deep", "er"]]), B.nest("w:sdt w:sdtContent", p("kept")))) + "</w:tbl>"
            + B.picture("rId2") + B.picture("rId3") + p("box:", more=B.text_box(p("boxed")))
            + B.group(["Alpha", "12", " Alpha ", name], ["rId4"]) + B.chart_anchor("rId6") + B.chart_anchor("rId7") + p("the end")
        )
        links = {"rId1": ("hyperlink", "http://example.com/x"), "rId2": ("image", "media/b.png"), "rId3": ("image", "media/s.png"), "rId4": ("image", "media/g.png"), "rId5": ("image", "media/l.png"), "rId6": ("chart", "charts/chart1.xml"), "rId7": ("chart", "charts/chart2.xml")}
        media = {"b.png": image(5000), "s.png": image(4999), "g.png": image(5001), "l.png": image(5002), "o.png": image(5003)}
        charts = {"chart1.xml": B.chart("radarChart", "Round", cats, [("N", n)], "0"), "chart2.xml": B.chart("barChart", "None", cats, [("N", n)], cached=False)}
        more = {"word/numbering.xml": B.numbering(n1="decimal", n2="bullet"), "word/footnotes.xml": B.notes("footnote", n4="of the foot"), "word/endnotes.xml": B.notes("endnote", n2="of the end"), "word/styles.xml": f"<w:styles {B._SPACES}>" + B.nest("w:style", B.nest("w:name", w__val="heading 1"), w__styleId="Heading1") + "</w:styles>"}
        # the lost image is used by a header only
        more |= {"word/header1.xml": f"<w:hdr {B._SPACES}>{B.picture('rId5')}</w:hdr>", "word/_rels/header1.xml.rels": B.rels({"rId5": links["rId5"]})}
        return B.docx(body, media, charts, links, more)

    return _told(engine.convert(_packed(_years(spark, sf_dir), "docx", make)))


DOCUMENT_ROUNDTRIP = f"""
WITH {_YEARS},
g AS (SELECT k, n_name AS name, string_agg('| ' || y || ' | ' || n || ' orders |', chr(10) ORDER BY y) AS cells, string_agg('s' || i || y || '["' || y || '"]', ', ' ORDER BY y) || chr(10) || 'curve n["N"]{{' || string_agg(format('{{:.4g}}', n::DOUBLE), ', ' ORDER BY y) || '}}' AS axes,
  string_agg('| ' || y || ' | ' || format('{{:,}}', n) || ' |', chr(10) ORDER BY y) AS body FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY y) - 1 AS i FROM t) JOIN nation ON k = n_nationkey GROUP BY ALL),
m AS (SELECT k, '# ' || replace(name, '_', '\\_') || ' report' || {_LINES} || '**strong \\*text\\***' || {_LINES} || 'See [the site](http://example.com/x) now[[1]](#footnote-4)[[2]](#endnote-2)' || {_LINES}
  || '1. first' || chr(10) || '2. second' || chr(10) || '  * inner' || chr(10) || '3. third' || chr(10) || '* point' || chr(10) || '1. again' || {_LINES}
  || '|  |  |' || chr(10) || '| --- | --- |' || chr(10) || '| Years | |' || chr(10) || cells || chr(10) || '| deep er | kept |' || {_LINES}
  || '> [Image, docx media ' || sha256(repeat(name, 5000)[:5000])[:12] || ' — raster content not analyzed]' || {_LINES} || 'box:' || {_LINES} || 'boxed' || {_LINES}
  || '> [Figure, docx group ID — composite content not analyzed]' || chr(10) || '> captions: Alpha; ' || name || '; old' || {_LINES}
  || 'Round' || {_LINES} || '```mermaid' || chr(10) || 'radar-beta' || chr(10) || 'axis ' || axes || chr(10) || '```' || {_LINES} || '| Category | N |' || chr(10) || '| --- | --- |' || chr(10) || body || {_LINES}
  || '> [Figure, docx chart ID — chart content not analyzed]' || chr(10) || '> captions: None' || {_LINES} || 'the end' || {_LINES} || '1. of the foot [↑](#footnote-ref-4)' || chr(10) || '2. of the end [↑](#endnote-ref-2)' || chr(10)
  || chr(10) || '## Figures (position unknown)' || {_LINES} || '> [Image, docx media ' || sha256(repeat(name, 5002)[:5002])[:12] || ' — raster content not analyzed]' || chr(10) AS md FROM g)
SELECT k || '.docx' AS source_id, 'ok' AS status, sha256(md) AS md_sha256, 2 AS charts_found, 1 AS charts_rendered, 1 AS groups_found, '' AS warnings FROM m"""


def _described(prompt: str, uri: str, model: str) -> str:
    """A scripted client: repeats the name that the image holds; judges find fault with some."""
    seen = base64.b64decode(uri.partition("base64,")[2]).decode()[:9].rstrip("N")
    if prompt.startswith("Compare"):
        return f"hallucination: {'yes' if seen.endswith('3') else 'no'}\nmermaid_fit: n/a\nlanguage: {'no' if model == 'judge-b' else 'yes'}"
    return f"# Seen {seen}\n> [x]"


def interpret_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document per nation with an image and a group; a cache knows every third, a scripted client describes the rest and two judges look at them."""

    def make(key, name, rows):
        return B.docx(B.paragraph("Before") + B.picture("rId1") + B.group(["Alpha 7", "Rows"]) + B.paragraph("After"), {"b.png": (name * 5000)[:6000].encode()}, links={"rId1": ("image", "media/b.png")})

    facts = _years(spark, sf_dir)
    source = stored(_packed(facts, "docx", make), "source")
    ident = F.substring(F.sha2(F.substring(F.repeat("n_name", 5000), 1, 6000).cast("binary"), 256), 1, 12)
    cache = facts.where("c_nationkey % 3 = 0").select(ident.alias("id12"), F.lit("old").alias("model"), F.lit("Known").alias("markdown"), F.lit(None).cast("array<string>").alias("judge_verdict"))
    got = engine.convert(source, engine.Config(use_vlm=True, verify=True, model="m-1"), _described, cache)
    return _told(got, "vlm_used").select("source_id", "md_sha256", "warnings", "vlm_used")


INTERPRET_FIGURES = f"""
WITH n AS (SELECT DISTINCT c_nationkey AS k, n_name AS name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
i AS (SELECT *, sha256(repeat(name, 5000)[:6000])[:12] AS id, rtrim(repeat(name, 2)[:9], 'N') AS seen FROM n),
m AS (SELECT *, 'Before' || {_LINES} || '> [Image, docx media ' || id || ' — VLM interpretation (' || CASE WHEN k % 3 = 0 THEN 'old' ELSE 'm-1' END || '); reconstruction, verify against original]' || {_LINES}
  || CASE WHEN k % 3 = 0 THEN 'Known' ELSE '**Seen ' || seen || '**' || chr(10) || '> ' || chr(8203) || '[x]' END || {_LINES} || '> [/VLM interpretation docx media ' || id || ']' || {_LINES}
  || '> [Figure, docx group ID — composite content not analyzed]' || chr(10) || '> captions: Alpha 7; Rows; old' || {_LINES} || 'After' || chr(10) AS md FROM i)
SELECT k || '.docx' AS source_id, sha256(md) AS md_sha256, CASE WHEN seen LIKE '%3' THEN 'vlm-judge-hallucination: ' || id || ';' ELSE '' END || 'vlm-judge-language: ' || id AS warnings, true AS vlm_used FROM m"""


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table read as a file stream, aggregated by hour, to a table."""
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")
    ingest.run_to_table(ingest.hourly(events.withColumn("ts", F.col("ts").cast("timestamp"))), f"{at}/out", f"{at}/state")
    return spark.read.parquet(f"{at}/out").select(F.date_format("hour", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n", F.col("total").cast("string").alias("total"))


STREAM_INGEST = """
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n, sum(value::DECIMAL(18,4))::DECIMAL(28,4)::VARCHAR AS total FROM events GROUP BY ALL"""

HTML_TO_MARKDOWN = None
QUERIES = {f.__name__: (f, globals()[f.__name__.upper()]) for f in (anchor_cell, sheet_table, sheet_empty, rel_resolution, media_id12, formula_ref, batch_plan, collisions, html_to_markdown, package_roundtrip, workbook_charts, document_roundtrip, interpret_figures, stream_ingest)}
