"""Chart structs to Markdown: caption, diagram, table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkweave.functions.numbers import formatted, four_digits_nested, style
from inkweave.functions.text import accepted, built, label, let, slug

FENCE, CLOSE = "```mermaid\n", "\n```"


def has_values(chart: Column) -> Column:
    return F.exists(chart["series"], lambda s: F.exists(s["values"], lambda v: v.isNotNull()))


def shape_ok(chart: Column) -> Column:
    """Categories, and every series as long and without gaps."""
    n = F.size(chart["categories"])
    return (n > 0) & F.forall(chart["series"], lambda s: (F.size(s["values"]) == n) & F.forall(s["values"], lambda v: v.isNotNull()))


def caption(chart: Column) -> Column:
    return F.nullif(F.concat_ws(" — ", F.nullif(chart["title"], F.lit("")), F.nullif(chart["value_axis_title"], F.lit(""))), F.lit(""))


def markdown_table(chart: Column, four: Column) -> Column:
    """The values under their series' names; cells beyond a series are empty."""
    longest = F.coalesce(F.array_max(F.transform(chart["series"], lambda s: F.size(s["values"]))), F.lit(0))
    numbered = F.when(longest > 0, F.transform(F.sequence(F.lit(1), F.greatest(longest, F.lit(1))), lambda i: i.cast("string"))).otherwise(F.array().cast("array<string>"))
    labels = F.when(F.size(chart["categories"]) > 0, chart["categories"]).otherwise(numbered)
    names = F.transform(chart["series"], lambda s, i: F.coalesce(F.nullif(s["name"], F.lit("")), F.concat(F.lit("Series "), (i + 1).cast("string"))))
    row = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    header = F.concat(F.array(F.lit("Category")), names)
    cell = lambda how, s, k, i: F.coalesce(formatted(F.get(s["values"], i), how, F.get(F.get(four, k), i)), F.lit(""))
    line = lambda how, c, i: row(F.concat(F.array(F.replace(c, F.lit("\n"), F.lit(" "))), F.transform(chart["series"], lambda s, k: cell(how, s, k, i))))
    body = let(style(F.coalesce(chart["value_format"], F.lit(""))), lambda how: F.transform(labels, lambda c, i: line(how, c, i)))
    return F.array_join(F.concat(F.array(row(header), row(F.transform(header, lambda _: F.lit("---")))), body), "\n")


def pie(chart: Column, four: Column) -> Column:
    values = F.get(chart["series"], F.lit(0))["values"]
    head = F.when(F.coalesce(chart["title"], F.lit("")) != "", F.concat(F.lit("pie title "), label(chart["title"]))).otherwise("pie")
    slices = F.transform(chart["categories"], lambda c, i: F.concat(F.lit('    "'), label(c), F.lit('" : '), F.get(F.get(four, F.lit(0)), i)))
    return F.when((F.size(chart["series"]) == 1) & shape_ok(chart) & F.forall(values, lambda v: v >= 0), F.array_join(F.concat(F.array(head), slices), "\n"))


def extremes(chart: Column) -> Column:
    """Lower and upper end of the value axis."""
    every = F.flatten(F.transform(chart["series"], lambda s: s["values"]))
    low = F.least(F.lit(0.0), F.array_min(every))
    high = F.array_max(every)
    return F.array(low, F.when(low == high, low + 1).otherwise(high))


def xychart(chart: Column, four: Column, ends: Column) -> Column:
    quoted = F.array_join(F.transform(chart["categories"], lambda c: F.concat(F.lit('"'), label(c), F.lit('"'))), ", ")
    axis = F.when(F.coalesce(chart["value_axis_title"], F.lit("")) != "", label(chart["value_axis_title"])).otherwise("Value")
    lines = F.transform(chart["series"], lambda s, k: F.concat(F.when(s["kind"].isin("bar", "column"), "bar").otherwise("line"), F.lit(" ["), F.array_join(F.get(four, k), ", "), F.lit("]")))
    head = F.array(F.lit("xychart-beta"), F.concat(F.lit("x-axis ["), quoted, F.lit("]")), F.concat(F.lit('y-axis "'), axis, F.lit('" '), F.get(ends, F.lit(0)), F.lit(" --> "), F.get(ends, F.lit(1))))
    return F.when(~F.coalesce(chart["stacked"], F.lit(False)) & shape_ok(chart), F.array_join(F.concat(head, lines), "\n"))


def radar(chart: Column, four: Column) -> Column:
    axes = F.array_join(F.transform(chart["categories"], lambda c, i: F.concat(slug(c, i), F.lit('["'), label(c), F.lit('"]'))), ", ")

    def curve(s: Column, k: Column) -> Column:
        named = F.coalesce(s["name"], F.lit("")) != ""
        shown = F.when(named, label(s["name"])).otherwise(F.concat(F.lit("Series "), (k + 1).cast("string")))
        word = slug(F.when(named, s["name"]).otherwise(F.concat(F.lit("series"), k.cast("string"))), k)
        return F.concat(F.lit("curve "), word, F.lit('["'), shown, F.lit('"]{'), F.array_join(F.get(four, k), ", "), F.lit("}"))

    head = F.array(F.lit("radar-beta"), F.concat(F.lit("axis "), axes))
    return F.when(shape_ok(chart), F.array_join(F.concat(head, F.transform(chart["series"], curve)), "\n"))


@built
def _code(chart: str) -> Column:
    c = F.col(chart)
    four, last, kind = F.col("_four"), F.element_at("_four", -1), c["chart_type"]
    code = F.when(kind.isin("pie", "doughnut"), pie(c, four)).when(kind.isin("area", "combo", "line", "bar", "column"), xychart(c, four, last)).when(kind == "radar", radar(c, four))
    return F.when(has_values(c), code)


@built
def _values(chart: str) -> Column:
    """All values, those of the axis' ends last."""
    c = F.col(chart)
    ends = F.when(shape_ok(c) & (F.size(c["series"]) > 0), F.array(extremes(c)))
    return F.concat(F.transform(c["series"], lambda s: s["values"]), F.coalesce(ends, F.array().cast("array<array<double>>")))


@built
def _whole(chart: str) -> Column:
    c = F.col(chart)
    whole = F.concat_ws("\n\n", caption(c), F.concat(F.lit(FENCE), F.col("diagram"), F.lit(CLOSE)), markdown_table(c, F.col("_four")))
    return F.when(has_values(c), whole)


@built
def _kept() -> Column:
    return F.when(accepted(F.col("diagram")), F.col("diagram"))


def with_markdown(df: DataFrame, chart: str = "chart", to: str = "markdown", gate: str = "structural") -> DataFrame:
    """Adds the chart's Markdown (null without any value) and ``diagram``, its code or null.

    ``gate``: ``structural`` keeps a diagram only if the grammar accepts it,
    ``off`` keeps any, ``none`` draws none.
    """
    df = df.withColumn("_four", four_digits_nested(_values(chart)))
    df = df.withColumn("diagram", _code(chart) if gate != "none" else F.lit(None).cast("string"))
    if gate == "structural":
        df = df.withColumn("diagram", _kept())
    return df.withColumn(to, _whole(chart)).drop("_four")
