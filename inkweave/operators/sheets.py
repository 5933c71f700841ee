"""Workbooks to Markdown: typed cells, dense tables, sections, charts in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkweave.functions.text import built, captions, let, sheet_chart_marker, strip
from inkweave.operators import charts, package, render

#: Cells of a used range, gaps included, that are written out one by one.
MOST_CELLS = 5_000_000
_BUILT_IN_DATES = tuple(f"#{k}" for k in (*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)))


def is_date(code: Column) -> Column:
    """Whether a number format shows a date or time: built-in numbers, or date letters outside quotes, escapes and colours."""
    bare = F.regexp_replace(code, r'"[^"]*"|\\.|\[(?![hms]+\])[^\]]*\]|_.', "")
    return code.isin(*_BUILT_IN_DATES) | (~code.startswith("#") & F.lower(bare).rlike("[dmyhs]") & (F.lower(bare) != "general"))


def kind_of(code: Column) -> Column:
    """``span`` for formats of elapsed time, ``date`` for other dates and times, else null."""
    return F.when(F.lower(code).rlike(r"\[(h+|m+|s+)\]") | (code == "#46"), "span").when(is_date(code), "date")


def _clock(micros: Column, hours: Column) -> Column:
    """``hours``:MM:SS, with six more digits where there is a fraction."""
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    seconds = F.floor(micros / 1_000_000)
    rest = micros % 1_000_000
    return F.concat(hours, F.lit(":"), two(F.floor(seconds / 60) % 60), F.lit(":"), two(seconds % 60), F.when(rest > 0, F.concat(F.lit("."), F.lpad(rest.cast("string"), 6, "0"))).otherwise(""))


def iso(serial: Column, date1904: Column) -> Column:
    """Serial day number to ISO text, to the millisecond: the time alone below one day, else date and time."""
    whole = F.floor(serial)
    millis = F.round((serial - whole) * 86_400_000).cast("long")
    days = whole.cast("int") + F.when(millis == 86_400_000, 1).otherwise(0) + F.when(~date1904 & (serial >= 1) & (serial < 60), 1).otherwise(0)
    micros = millis % 86_400_000 * 1000
    clock = _clock(micros, F.lpad(F.floor(micros / 3_600_000_000).cast("string"), 2, "0"))
    day = F.when(date1904, F.date_add(F.lit("1904-01-01").cast("date"), days)).otherwise(F.date_add(F.lit("1899-12-30").cast("date"), days)).cast("string")
    return F.when((serial >= 0) & (days < 1), clock).otherwise(F.concat(day, F.lit("T"), clock))


def elapsed(serial: Column) -> Column:
    """Days as elapsed time: ``1 day, 2:03:04``; below zero the days are counted down and the clock up."""
    micros = F.round(serial * 86_400_000_000).cast("long")
    days = F.floor(micros / 86_400_000_000).cast("long")
    left = F.pmod(micros, F.lit(86_400_000_000))
    head = F.when(days != 0, F.concat(days.cast("string"), F.when(F.abs(days) == 1, " day, ").otherwise(" days, "))).otherwise("")
    return F.concat(head, _clock(left, F.floor(left / 3_600_000_000).cast("string")))


def cell_text(cell: Column, shared: Column, dates: Column, date1904: Column) -> Column:
    """``dates``: what each style shows (``kind_of``)."""
    serial = cell["v"].try_cast("double")
    how = F.when(serial.isNotNull() & (F.abs(serial) < 2958466), F.get(dates, cell["s"]))
    text = (
        F.when(cell["t"] == "s", F.get(shared, cell["v"].try_cast("int")))
        .when(cell["t"] == "b", F.when(cell["v"].isin("1", "true"), "True").otherwise("False"))
        .when((cell["t"] == "n") & (how == "date"), iso(serial, date1904))
        .when((cell["t"] == "n") & (how == "span"), elapsed(serial))
        .otherwise(cell["v"])
    )
    return F.replace(strip(F.coalesce(text, F.lit(""))), F.lit("\n"), F.lit(" "))


def table_text(rows: Column, shared: Column, dates: Column, date1904: Column) -> Column:
    """A sheet's used range from A1; its first row is the header.  Null without cells.

    Linear in cells and gaps.  Where the range has more than ``MOST_CELLS``
    cells, mostly gaps (a stray cell far away), rows end with their last cell and
    a run of blank rows is one row that says how many; no cell is left out.
    """
    whole = F.struct(rows.alias("rows"), F.coalesce(F.array_max(F.transform(rows, lambda r: F.element_at(r["cells"], -1)["c"])), F.lit(0)).alias("wide"), dates.alias("dates"))
    blanks = lambda n: F.array_repeat(F.lit(""), F.greatest(n, F.lit(0)).cast("int"))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    def written(x: Column) -> Column:
        sparse = F.element_at(x["rows"], -1)["r"].cast("long") * x["wide"] > MOST_CELLS
        pad = F.when(sparse, 0).otherwise(x["wide"])

        def dense(cells: Column) -> Column:
            filled = F.flatten(F.transform(cells, lambda c, i: F.concat(blanks(c["c"] - F.when(i > 0, F.get(cells, i - 1)["c"]).otherwise(0) - 1), F.array(cell_text(c, shared, x["dates"], date1904)))))
            return line(F.concat(filled, blanks(pad - F.element_at(cells, -1)["c"])))

        def gap(n: Column) -> Column:
            told = F.array(F.concat(F.lit("| ("), n.cast("string"), F.lit(" blank rows) |")))
            return F.when(n <= 0, F.slice(F.array(F.lit("")), 1, 0)).when(sparse & (n > 1), told).otherwise(F.array_repeat(line(blanks(x["wide"])), n.cast("int")))

        lines = F.flatten(F.transform(x["rows"], lambda r, i: F.concat(gap(r["r"] - F.when(i > 0, F.get(x["rows"], i - 1)["r"]).otherwise(0) - 1), F.array(dense(r["cells"])))))
        rule = line(F.array_repeat(F.lit("---"), x["wide"]))
        return let(lines, lambda t: F.array_join(F.concat(F.slice(t, 1, 1), F.array(rule), F.slice(t, F.lit(2), F.greatest(F.size(t) - 1, F.lit(0)))), "\n"))

    return F.when(F.size(rows) > 0, let(whole, written))


@built
def _body() -> Column:
    return table_text(F.col("s.rows"), F.col("shared"), F.col("dates"), F.col("date1904"))


def section(name: Column, state: Column, body: Column, blocks: Column) -> Column:
    """A sheet's heading, table and charts, or a note that it is empty."""
    heading = F.concat(F.lit("## "), name, F.when(state == "visible", "").otherwise(" (hidden)"))
    note = F.concat(F.lit('> [Sheet "'), name, F.lit('" — empty, skipped]'))
    return F.concat_ws("\n\n", heading, F.when(body.isNull() & blocks.isNull(), note), body, blocks)


def chart_blocks(found: DataFrame, gate: str = "structural") -> DataFrame:
    """``block`` and ``rendered`` for rows of ``sheet_charts``."""
    made = render.with_markdown(charts.parse(found), gate=gate)
    origin = F.concat(F.lit("> sheet "), F.col("sheet"), F.lit(", anchor "), F.col("anchor_cell"), F.lit("\n\n"))
    marker = sheet_chart_marker(F.col("id12"), F.col("sheet"), F.col("anchor_cell"), captions(F.col("texts")))
    return made.withColumn("rendered", F.col("markdown").isNotNull()).withColumn("block", F.coalesce(F.concat(origin, F.col("markdown")), marker))


def workbooks(shredded: DataFrame, gate: str = "structural") -> DataFrame:
    """``source_id, markdown, charts_found, charts_rendered, has_content`` of readable workbooks."""
    links = package.rels(shredded)
    bodies = shredded.select("source_id", "shared", F.transform("formats", kind_of).alias("dates"), "date1904", F.explode("sheet_rows").alias("s"))
    bodies = bodies.select("source_id", F.col("s.part").alias("sheet_part"), _body().alias("body"))
    every = shredded.select("source_id", F.explode("sheets").alias("s")).select("source_id", F.col("s.ord").alias("sheet_ord"), F.col("s.name").alias("sheet"), F.col("s.state").alias("state"))
    parts = package.sheet_parts(shredded, links).select("source_id", "sheet_ord", "sheet_part")
    blocks = chart_blocks(package.sheet_charts(shredded), gate)
    place = F.struct(F.coalesce("row", F.lit(1 << 30)), F.coalesce("col", F.lit(1 << 30)), "chart_ord", "block")
    blocks = blocks.groupBy("source_id", "sheet_ord").agg(F.array_sort(F.collect_list(place)).alias("b"), F.count("*").cast("int").alias("found"), F.count_if("rendered").cast("int").alias("drawn"))
    blocks = blocks.select("source_id", "sheet_ord", F.array_join(F.transform("b", lambda x: x["block"]), "\n\n").alias("blocks"), "found", "drawn")
    sheets = every.join(parts, ["source_id", "sheet_ord"], "left").join(bodies, ["source_id", "sheet_part"], "left").join(blocks, ["source_id", "sheet_ord"], "left")
    text = section(F.col("sheet"), F.col("state"), F.col("body"), F.col("blocks"))
    sheets = sheets.select("source_id", "sheet_ord", text.alias("text"), (F.col("body").isNotNull() | F.col("blocks").isNotNull()).alias("full"), "found", "drawn")
    whole = sheets.groupBy("source_id").agg(
        F.array_sort(F.collect_list(F.struct("sheet_ord", "text"))).alias("t"), F.coalesce(F.sum("found"), F.lit(0)).cast("int").alias("charts_found"), F.coalesce(F.sum("drawn"), F.lit(0)).cast("int").alias("charts_rendered"), F.bool_or("full").alias("has_content")
    )
    return whole.select("source_id", F.concat(F.array_join(F.transform("t", lambda x: x["text"]), "\n\n"), F.lit("\n")).alias("markdown"), "charts_found", "charts_rendered", "has_content")
