"""Relationships between parts, as joins on document and part."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkweave.functions.text import cell_name, resolve


def rels(shredded: DataFrame) -> DataFrame:
    """``source_id, source_part, rel_id, rel_type, used, part``: each relationship with the part it leads to."""
    r = shredded.select("source_id", F.explode("rels").alias("r")).select("source_id", "r.*")
    return r.select("source_id", "source_part", "rel_id", "rel_type", "used", resolve(F.col("source_part"), F.col("target")).alias("part"))


def follow(df: DataFrame, links: DataFrame, part: str, rid: str, to: str) -> DataFrame:
    """Adds the part that relationship ``rid`` of ``part`` leads to; rows without one go."""
    links = links.select(F.col("source_id").alias("_s"), F.col("source_part").alias("_p"), F.col("rel_id").alias("_r"), F.col("part").alias(to))
    return df.join(links, (df["source_id"] == F.col("_s")) & (df[part] == F.col("_p")) & (df[rid] == F.col("_r"))).drop("_s", "_p", "_r")


def sheet_parts(shredded: DataFrame, links: DataFrame) -> DataFrame:
    """``source_id, sheet_ord, sheet, state, sheet_part`` of sheets whose part is known."""
    s = shredded.select("source_id", F.explode("sheets").alias("s"), F.lit("xl/workbook.xml").alias("book")).select("source_id", "book", F.col("s.ord").alias("sheet_ord"), F.col("s.name").alias("sheet"), F.col("s.state").alias("state"), F.col("s.rid").alias("rid"))
    return follow(s.where(F.col("sheet").isNotNull()), links, "book", "rid", "sheet_part").drop("book", "rid")


def sheet_charts(shredded: DataFrame) -> DataFrame:
    """One row per chart of a workbook: sheet, anchor, order within the sheet, id, captions and raw facts.

    sheet -> drawing -> anchor -> chart part; a broken link drops what hangs on
    it, and an anchor may hold several charts.
    """
    links = rels(shredded)
    drawings = shredded.select("source_id", F.explode("drawings").alias("d")).select("source_id", F.col("d.part").alias("sheet_part"), F.col("d.rid").alias("drawing_rid"))
    anchors = shredded.select("source_id", F.explode("anchors").alias("a")).select("source_id", F.col("a.part").alias("drawing_part"), F.col("a.ord").alias("chart_ord"), F.col("a.col").alias("col"), F.col("a.row").alias("row"), F.col("a.rid").alias("chart_rid"))
    charts = shredded.select("source_id", F.explode("charts").alias("c")).select("source_id", F.col("c.part").alias("chart_part"), F.col("c.id12").alias("id12"), F.col("c.captions").alias("texts"), F.col("c.raw").alias("raw"))
    at = sheet_parts(shredded, links).join(drawings, ["source_id", "sheet_part"])
    at = follow(at, links, "sheet_part", "drawing_rid", "drawing_part").join(anchors, ["source_id", "drawing_part"])
    at = follow(at, links, "drawing_part", "chart_rid", "chart_part").join(charts, ["source_id", "chart_part"])
    cell = F.coalesce(cell_name(F.col("col"), F.col("row")), F.lit("?"))
    return at.select("source_id", "sheet_ord", "sheet", "chart_ord", "col", "row", cell.alias("anchor_cell"), "id12", "texts", "raw")
