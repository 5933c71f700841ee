"""Queries that apply the text operators to the driver's tables, with their DuckDB text.

The documents hold no fences, headings, markers or bearer tokens, so the
queries add such lines to every document, alike on both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkweave.functions import text as X
from inkweave.operators import figures, recall
from inkweave.sources.tables import spread, table

_LETTERS = r"[\p{L}\p{Nl}\p{No}]+"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def caption_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.split(F.replace(F.concat(F.col("text"), F.lit("\n-12\n 7 \n\n"), F.col("doc_id").cast("string")), F.lit(". "), F.lit("\n")), "\n", -1)
    return _documents(spark, sf_dir).select("doc_id", F.posexplode(X.captions(lines))).select("doc_id", (F.col("pos") + 1).cast("long").alias("place"), F.col("col").alias("caption"))


CAPTION_FILTER = r"""
WITH l AS (SELECT doc_id, unnest(string_split(replace(text || chr(10) || '-12' || chr(10) || ' 7 ' || chr(10) || chr(10) || doc_id, '. ', chr(10)), chr(10))) AS raw, generate_subscripts(string_split(replace(text || chr(10) || '-12' || chr(10) || ' 7 ' || chr(10) || chr(10) || doc_id, '. ', chr(10)), chr(10)), 1) AS i FROM documents),
s AS (SELECT doc_id, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS caption, min(i) AS i FROM l GROUP BY ALL)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS place, caption FROM s WHERE caption <> '' AND NOT regexp_full_match(caption, '-?[0-9]+')"""


def token_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document, of all benchmark items the one whose words it has the largest share of (of equals, the smallest id)."""
    return recall.best_items(_documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


TOKEN_RECALL = rf"""
WITH a AS (SELECT doc_id, list_distinct([lower(x) FOR x IN regexp_extract_all(text, '{_LETTERS}')]) AS a FROM documents),
b AS (SELECT item_id, list_distinct([lower(x) FOR x IN regexp_extract_all(text, '{_LETTERS}')]) AS b FROM benchmark),
r AS (SELECT doc_id, item_id, CASE WHEN len(b) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(b, a))::DOUBLE / len(b)::DOUBLE END AS recall FROM a, b)
SELECT doc_id, item_id, recall FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY recall DESC, item_id) = 1"""


def _neighbour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the next one, both with a few numbers added."""
    d = _documents(spark, sf_dir).withColumn("text", F.concat(F.col("text"), F.lit(" 10 2 030 "), (F.col("doc_id") % 7).cast("string"), F.lit(" "), (F.col("doc_id") * 3).cast("string")))
    other = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other"))
    return d.join(other, "doc_id")


_NEIGHBOUR = "d AS (SELECT doc_id, text || ' 10 2 030 ' || (doc_id % 7) || ' ' || (doc_id * 3) AS text FROM documents), p AS (SELECT a.doc_id, a.text, b.text AS other FROM d a JOIN d b ON b.doc_id - 1 = a.doc_id)"
_MISSING = """n AS (SELECT doc_id, x, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\\d+')) AS x FROM p) GROUP BY ALL),
o AS (SELECT doc_id, x, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(other, '\\d+')) AS x FROM p) GROUP BY ALL),
m AS (SELECT n.doc_id, n.x, row_number() OVER (PARTITION BY n.doc_id ORDER BY n.x::HUGEINT, n.x) AS i, count(*) OVER (PARTITION BY n.doc_id) AS c FROM n LEFT JOIN o ON n.doc_id = o.doc_id AND n.x = o.x WHERE n.k > coalesce(o.k, 0)),
g AS (SELECT doc_id, string_agg(x, ',' ORDER BY i) FILTER (WHERE i <= 10) || CASE WHEN max(c) > 10 THEN '…+' || (max(c) - 10) ELSE '' END AS side FROM m GROUP BY doc_id)"""


def numeric_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbour(spark, sf_dir).select("doc_id", X.missing_side(X.missing_numbers(F.col("text"), F.col("other"))).alias("missing"))


NUMERIC_MISSING = f"WITH {_NEIGHBOUR}, {_MISSING} SELECT p.doc_id, coalesce(side, 'none') AS missing FROM p LEFT JOIN g USING (doc_id)"


def witness_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's captions against its neighbour's text; where the labels call a document toxic, the recall must be higher."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    p = _neighbour(spark, sf_dir).join(labels, "doc_id", "left")
    ident = F.substring(F.sha2(F.col("doc_id").cast("string").cast("binary"), 256), 1, 12)
    return p.select("doc_id", X.witness_defects(F.col("text"), F.col("other"), ident, F.when(F.col("toxic") == 1, 0.9).otherwise(0.4)).alias("defects")).select("doc_id", F.array_join("defects", "\n").alias("defects"))


WITNESS_DEFECTS = rf"""
WITH {_NEIGHBOUR}, {_MISSING},
w AS (SELECT doc_id, list_distinct([lower(x) FOR x IN regexp_extract_all(text, '{_LETTERS}')]) AS a, list_distinct([lower(x) FOR x IN regexp_extract_all(other, '{_LETTERS}')]) AS b FROM p),
r AS (SELECT doc_id, CASE WHEN len(a) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(a, b))::DOUBLE / len(a)::DOUBLE END AS recall FROM w),
t AS (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY 1)
SELECT r.doc_id, concat_ws(chr(10), CASE WHEN recall < CASE WHEN toxic = 1 THEN 0.9 ELSE 0.4 END THEN 'figure-witness-recall: ' || sha256(r.doc_id::VARCHAR)[:12] || ' ' || format('{{:.2f}}', recall) END,
       'figure-witness-numeric: ' || sha256(r.doc_id::VARCHAR)[:12] || ' witness_only=[' || side || ']') AS defects
FROM r LEFT JOIN g USING (doc_id) LEFT JOIN t USING (doc_id)"""


def _verdict(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column, Column]:
    """Two judges' replies written from the labels; some are incomplete."""
    df = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    yes = lambda c: F.when(c, "Yes").otherwise("no")
    reply = lambda a, b, c: F.concat(F.lit("Judged.\n hallucination: "), yes(a), F.lit("\nMERMAID_FIT : "), F.when(F.col("doc_id") % 3 == 0, "n/a").otherwise(yes(b)), F.when(F.col("doc_id") % 11 == 0, F.lit("\nlanguage?")).otherwise(F.concat(F.lit("\nlanguage: "), yes(c))))
    return df, reply(F.col("toxic") == 1, F.col("quality") == 1, F.col("doc_id") % 2 == 0), reply(F.col("quality") == 0, F.col("toxic") == 0, F.col("doc_id") % 5 != 0)


_REPLIES = """v AS (SELECT doc_id, doc_id % 11 <> 0 AS whole, toxic = 1 AS h1, doc_id % 3 <> 0 AND quality <> 1 AS m1, doc_id % 2 <> 0 AS l1, quality = 0 AS h2, doc_id % 3 <> 0 AND toxic <> 0 AS m2, doc_id % 5 = 0 AS l2 FROM labels)"""


def judge_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, reply, _ = _verdict(spark, sf_dir)
    return df.select("doc_id", F.array_join(X.verdict_defects(reply), ",").alias("tags"))


JUDGE_PARSE = f"""WITH {_REPLIES} SELECT doc_id, CASE WHEN whole THEN concat_ws(',', CASE WHEN h1 THEN 'vlm-judge-hallucination' END, CASE WHEN m1 THEN 'vlm-judge-mermaid' END, CASE WHEN l1 THEN 'vlm-judge-language' END) ELSE '' END AS tags FROM v"""


def judge_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, one, two = _verdict(spark, sf_dir)
    return df.select("doc_id", F.array_join(F.array_sort(X.panel(X.verdict_defects(one), X.verdict_defects(two))), ",").alias("tags"))


JUDGE_PANEL = f"""WITH {_REPLIES} SELECT doc_id, CASE WHEN whole THEN concat_ws(',', CASE WHEN h1 OR h2 THEN 'vlm-judge-hallucination' END, CASE WHEN l1 OR l2 THEN 'vlm-judge-language' END, CASE WHEN m1 OR m2 THEN 'vlm-judge-mermaid' END) ELSE '' END AS tags FROM v"""


def redact_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = F.concat(F.col("text"), F.lit("\nbearer ab"), F.col("doc_id").cast("string"), F.lit(" authorization:  Basic"), F.col("doc_id").cast("string"), F.lit(" x sk-"), F.repeat(F.lit("Z9"), (F.col("doc_id") % 15).cast("int")), F.lit(" sk-ant-a-b."))
    return _documents(spark, sf_dir).select("doc_id", F.sha2(X.redact(noisy).cast("binary"), 256).alias("redacted_sha256"))


REDACT_SECRETS = f"""
SELECT doc_id, sha256(regexp_replace(text || chr(10) || 'bearer ab' || doc_id || ' authorization:  Basic' || doc_id || ' x sk-' || repeat('Z9', (doc_id % 15)::INT) || ' sk-ant-a-b.',
  '{X.SECRETS}', '***REDACTED***', 'g')) AS redacted_sha256 FROM documents"""


def _decorated() -> Column:
    """Every other document opens a fence that it may leave open; headings stand inside and outside."""
    first = F.concat(F.lit("## Title "), F.col("doc_id").cast("string"), F.lit("  \n"))
    fence = F.when(F.col("doc_id") % 2 == 0, F.lit("\n ```py\n# comment\n")).otherwise(F.lit("\n"))
    close = F.when(F.col("doc_id") % 4 == 0, F.lit("\n```\n### End\n> [Image]\n")).otherwise(F.lit("\n#### Last one\n> [x]\n\n"))
    return F.concat(first, F.col("text"), fence, F.col("text"), close)


_DECORATED = """d AS (SELECT doc_id, '## Title ' || doc_id || '  ' || chr(10) || text || CASE WHEN doc_id % 2 = 0 THEN chr(10) || ' ```py' || chr(10) || '# comment' || chr(10) ELSE chr(10) END || text
  || CASE WHEN doc_id % 4 = 0 THEN chr(10) || '```' || chr(10) || '### End' || chr(10) || '> [Image]' || chr(10) ELSE chr(10) || '#### Last one' || chr(10) || '> [x]' || chr(10) || chr(10) END AS md FROM documents)"""


def demote_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", F.sha2(X.demote_headings(_decorated()).cast("binary"), 256).alias("md_sha256"))


DEMOTE_HEADINGS = rf"""
WITH {_DECORATED}, l AS (SELECT doc_id, unnest(string_split(md, chr(10))) AS x, generate_subscripts(string_split(md, chr(10)), 1) AS i FROM d),
f AS (SELECT *, regexp_replace(x, '^\s+|\s+$', '', 'g') AS s FROM l),
g AS (SELECT *, sum((s LIKE '```%')::INT) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM f)
SELECT doc_id, sha256(string_agg(CASE WHEN s NOT LIKE '```%' AND k % 2 = 0 AND regexp_matches(s, '^#{{1,6}}\s+.') THEN '**' || regexp_replace(s, '^#{{1,6}}\s+', '') || '**' ELSE x END, chr(10) ORDER BY i)) AS md_sha256
FROM g GROUP BY doc_id"""


def balance_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", F.sha2(X.balance_fences(_decorated()).cast("binary"), 256).alias("md_sha256"))


BALANCE_FENCES = f"""WITH {_DECORATED} SELECT doc_id, sha256(CASE WHEN ((length(md) - length(replace(md, '```', ''))) // 3) % 2 = 1 THEN rtrim(md, chr(10)) || chr(10) || '```' ELSE md END) AS md_sha256 FROM d"""


def neutralize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", F.sha2(X.neutralize(_decorated()).cast("binary"), 256).alias("md_sha256"))


NEUTRALIZE = f"""WITH {_DECORATED} SELECT doc_id, sha256(substr(replace(chr(10) || md, chr(10) || '> [', chr(10) || '> ' || chr(8203) || '['), 2)) AS md_sha256 FROM d"""


def sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", F.sha2(X.sanitize(_decorated()).cast("binary"), 256).alias("md_sha256"))


SANITIZE = DEMOTE_HEADINGS.replace("SELECT doc_id, sha256(string_agg(", "e AS (SELECT doc_id, string_agg(").replace("ORDER BY i)) AS md_sha256\nFROM g GROUP BY doc_id", "ORDER BY i) AS md FROM g GROUP BY doc_id),\nb AS (SELECT doc_id, CASE WHEN ((length(md) - length(replace(md, '```', ''))) // 3) % 2 = 1 THEN rtrim(md, chr(10)) || chr(10) || '```' ELSE md END AS md FROM e)\nSELECT doc_id, sha256(substr(replace(chr(10) || md, chr(10) || '> [', chr(10) || '> ' || chr(8203) || '['), 2)) AS md_sha256 FROM b").replace("k FROM f)\ne AS", "k FROM f),\ne AS")


def _marked() -> Column:
    ident = F.substring(F.sha2(F.col("doc_id").cast("string").cast("binary"), 256), 1, 12)
    other = F.substring(F.sha2(F.concat(F.lit("g"), F.col("doc_id").cast("string")).cast("binary"), 256), 1, 12)
    image = X.image_marker(ident)
    group = X.figure_marker(F.lit("group"), other, F.array(F.lit("a 1"), F.lit("b")))
    return F.concat(F.lit("x\n"), image, F.lit("\n"), F.col("text"), F.lit("\n"), group, F.lit("\n"), F.when(F.col("doc_id") % 5 == 0, image).otherwise("> [Image, docx media ZZ]"))


_MARKED = """m AS (SELECT doc_id, text, sha256(doc_id::VARCHAR)[:12] AS a, sha256('g' || doc_id)[:12] AS b FROM documents)"""


def marker_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = figures.markers(_documents(spark, sf_dir).select("doc_id", _marked().alias("markdown")), "doc_id")
    return scanned.select("doc_id", "place", "kind", "id12", "witness")


MARKER_SCAN = f"""WITH {_MARKED}
SELECT doc_id, 0 AS place, 'image' AS kind, a AS id12, NULL::VARCHAR AS witness FROM m
UNION ALL SELECT doc_id, 1, 'group', b, 'a 1; b' FROM m UNION ALL SELECT doc_id, 2, 'image', a, NULL FROM m WHERE doc_id % 5 = 0"""


def inject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers joined with a cache that knows the images of two documents in three."""
    docs = _documents(spark, sf_dir).select("doc_id", _marked().alias("markdown"))
    ident = F.substring(F.sha2(F.col("doc_id").cast("string").cast("binary"), 256), 1, 12)
    cache = _documents(spark, sf_dir).where(F.col("doc_id") % 3 != 0).select(ident.alias("id12"), F.lit("m-1").alias("model"), F.concat(F.lit("# Seen "), F.col("doc_id").cast("string")).alias("markdown"))
    return figures.inject(docs, cache, "doc_id").select("doc_id", F.sha2(F.col("markdown").cast("binary"), 256).alias("md_sha256"), "vlm_used")


INJECT = f"""WITH {_MARKED},
i AS (SELECT *, '> [Image, docx media ' || a || ' — raster content not analyzed]' AS mark, '> [Image, docx media ' || a || ' — VLM interpretation (m-1); reconstruction, verify against original]' || chr(10) || chr(10) || '**Seen ' || doc_id || '**' || chr(10) || chr(10) || '> [/VLM interpretation docx media ' || a || ']' AS seen FROM m),
j AS (SELECT *, CASE WHEN doc_id % 3 <> 0 THEN seen ELSE mark END AS shown FROM i)
SELECT doc_id, sha256('x' || chr(10) || shown || chr(10) || text || chr(10) || '> [Figure, docx group ' || b || ' — composite content not analyzed]' || chr(10) || '> captions: a 1; b' || chr(10) || CASE WHEN doc_id % 5 = 0 THEN shown ELSE '> [Image, docx media ZZ]' END) AS md_sha256,
  doc_id % 3 <> 0 AS vlm_used FROM j"""


def data_uri(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data URIs of all texts under names of many types, and what splitting gives back."""
    kind = F.element_at(F.array(*map(F.lit, ("a.png", "b.JPG", "c.tif", "d.emf", "e.svg", "f.bmp"))), (F.col("doc_id") % 6 + 1).cast("int"))
    df = _documents(spark, sf_dir).select("doc_id", X.mime(kind).alias("mime"), F.col("text").cast("binary").alias("content"))
    df = df.select("doc_id", "mime", "content", X.data_uri(F.col("mime"), F.col("content")).alias("uri"))
    parts = X.split_uri(F.col("uri"))
    return df.select("doc_id", "mime", F.sha2(F.col("uri").cast("binary"), 256).alias("uri_sha256"), (parts["mime"] == F.col("mime")).alias("same_mime"), F.sha2(F.unbase64(parts["body"]), 256).alias("body_sha256"))


DATA_URI = """
WITH t AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'image/tiff' WHEN 5 THEN 'image/bmp' END AS mime, text FROM documents)
SELECT doc_id, mime, sha256('data:' || mime || ';base64,' || base64(encode(text))) AS uri_sha256, CASE WHEN mime IS NOT NULL THEN true END AS same_mime, CASE WHEN mime IS NOT NULL THEN sha256(text) END AS body_sha256 FROM t"""


QUERIES = {f.__name__: (f, globals()[f.__name__.upper()]) for f in (caption_filter, token_recall, numeric_missing, witness_defects, judge_parse, judge_panel, redact_secrets, demote_headings, balance_fences, neutralize, sanitize, marker_scan, inject, data_uri)}
