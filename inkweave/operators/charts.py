"""Chart facts to chart structs, by expressions and joins.

``parse`` turns the raw struct of a chart part into a chart; ``raw_of`` builds
such a raw struct from long-form points of any table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkweave.functions.numbers import plain_numbers, safe_float, safe_int
from inkweave.functions.text import built, let, rich_text
from inkweave.schemas import RAW_SERIES

#: More points than a sheet has rows can't be meant; such a count or index is malformed.
MOST_POINTS = 1 << 20
SIMPLE = {f"{kind}Chart": kind for kind in ("radar", "area", "line", "doughnut", "scatter", "pie")}


def tag_type(tag: Column, bar_dir: Column) -> Column:
    kinds = F.create_map(*(F.lit(x) for pair in SIMPLE.items() for x in pair))
    bar = F.when(bar_dir == "bar", "bar").otherwise("column")
    return F.when(tag == "barChart", bar).otherwise(F.coalesce(F.try_element_at(kinds, tag), F.lit("other")))


def chart_type(plots: Column) -> Column:
    """Elements count, not kinds: two bar charts are a combination."""
    known = F.filter(plots, lambda p: p["tag"].isin("barChart", *SIMPLE))
    one = F.get(known, F.lit(0))
    return F.when(F.size(known) == 0, "other").when(F.size(known) > 1, "combo").otherwise(tag_type(one["tag"], one["bar_dir"]))


def is_stacked(plots: Column) -> Column:
    return F.exists(plots, lambda p: p["tag"].isin("barChart", "lineChart", "areaChart") & F.coalesce(p["grouping"].isin("stacked", "percentStacked"), F.lit(False)))


def _points(cache: Column) -> Column:
    """``n`` and the valid ``points`` by index, the last of equal ones, of a cache."""
    numbered = F.transform(cache["points"], lambda p, i: F.struct(safe_int(p["idx"]).alias("idx"), i.alias("ord"), p["v"].alias("v")))
    numbered = F.filter(numbered, lambda p: p["idx"].isNotNull() & (p["idx"] < MOST_POINTS))
    asked = safe_int(cache["pt_count"])

    def counted(rows: Column) -> Column:
        highest = F.array_max(F.transform(rows, lambda p: p["idx"])) + 1
        return F.struct(rows.alias("rows"), F.greatest(F.lit(0), F.coalesce(F.when(asked <= MOST_POINTS, asked), highest, F.lit(0))).alias("n"))

    def lasts(x: Column) -> Column:
        inside = F.array_sort(F.filter(x["rows"], lambda p: (p["idx"] >= 0) & (p["idx"] < x["n"])))
        # the last of equal indexes is the one that the next doesn't repeat
        last = let(inside, lambda s: F.filter(s, lambda p, i: F.coalesce(F.get(s, i + 1)["idx"] != p["idx"], F.lit(True))))
        return F.struct(x["n"].alias("n"), last.alias("points"))

    return let(let(numbered, counted), lasts)


def materialize(cache: Column) -> Column:
    """Texts at every index of a cache, null in gaps.  Linear: each point brings the gap before it."""
    gap = lambda k: F.array_repeat(F.lit(None).cast("string"), F.greatest(k, F.lit(0)).cast("int"))

    def filled(x: Column) -> Column:
        points = x["points"]
        shown = F.flatten(F.transform(points, lambda p, i: F.concat(gap(p["idx"] - F.when(i > 0, F.get(points, i - 1)["idx"]).otherwise(-1) - 1), F.array(p["v"]))))
        return F.concat(shown, gap(x["n"] - 1 - F.coalesce(F.array_max(F.transform(points, lambda p: p["idx"])), F.lit(-1))))

    return F.when(F.coalesce(cache["present"], F.lit(False)), let(_points(cache), filled)).otherwise(F.array().cast("array<string>"))


def _texts(cache: Column) -> Column:
    return F.transform(materialize(cache), lambda v: F.coalesce(v, F.lit("")))


def _doubles(cache: Column) -> Column:
    return F.transform(materialize(cache), safe_float)


@built
def _series(raw: str) -> Column:
    none = F.array()
    return F.transform(F.coalesce(F.col(raw)["series"], none.cast(f"array<{RAW_SERIES}>")), lambda s: F.struct(
        F.when(s["name"].isNotNull(), F.nullif(F.get(_texts(s["name"]), F.lit(0)), F.lit(""))).otherwise(s["name_text"]).alias("name"),
        F.coalesce(_doubles(s["val"]), none.cast("array<double>")).alias("values"),
        tag_type(s["parent"], s["bar_dir"]).alias("kind"),
        s["val"]["format"].alias("format"),
        s["cat"]["variant"].alias("variant"),
        F.coalesce(F.when(s["cat"]["variant"].startswith("str"), _texts(s["cat"])), none.cast("array<string>")).alias("labels"),
        F.coalesce(F.when(s["cat"]["variant"].startswith("num"), _doubles(s["cat"])), none.cast("array<double>")).alias("figures"),
    ))


@built
def _first() -> Column:
    """The first series that has categories, wherever it stands, gives them."""
    return F.get(F.filter("_series", lambda s: (F.size(s["labels"]) > 0) | (F.size(s["figures"]) > 0)), F.lit(0))


@built
def _chart(raw: str) -> Column:
    r = F.col(raw)
    plots = F.coalesce(r["plots"], F.array().cast("array<struct<tag:string,bar_dir:string,grouping:string>>"))
    axis = F.get(F.filter(F.transform(r["axis_titles"], rich_text), lambda t: t.isNotNull()), F.lit(0))
    code = F.get(F.filter(F.transform("_series", lambda s: s["format"]), lambda f: f.isNotNull()), F.lit(0))
    return F.struct(
        chart_type(plots).alias("chart_type"), rich_text(r["title"]).alias("title"), axis.alias("value_axis_title"), code.alias("value_format"), is_stacked(plots).alias("stacked"),
        F.coalesce("_categories", F.array().cast("array<string>")).alias("categories"), F.transform("_series", lambda s: F.struct(s["name"].alias("name"), s["values"].alias("values"), s["kind"].alias("kind"))).alias("series"),
    )


def parse(df: DataFrame, raw: str = "raw", to: str = "chart") -> DataFrame:
    """Adds the chart struct of a raw chart column; a null raw chart is an empty chart."""
    made = df.withColumn("_series", _series(raw)).withColumn("_first", _first())
    categories = F.when(F.col("_first.variant").startswith("num"), plain_numbers("_first.figures")).otherwise(F.coalesce("_first.labels", F.array().cast("array<string>")))
    return made.withColumn("_categories", categories).withColumn(to, _chart(raw)).drop("_series", "_first", "_categories")


# == from long-form points


def raw_of(points: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, raw``: the facts of a chart as a package would hold them, from rows ``keys, series_ord, series_name, kind, cat_ord, category, value, value_format, title, axis, stacked``.

    Values are sparse points at their category's place; ``parse`` makes a chart
    of the result.  Two aggregations over one pass of the points.
    """
    spot = F.dense_rank().over(Window.partitionBy(*keys).orderBy("cat_ord")) - 1
    point = lambda i, v: F.struct(i.alias("idx"), v.alias("v"))
    heads = [F.max(c).alias(c) for c in ("title", "axis", "value_format", "stacked")]
    rows = points.withColumn("spot", spot).groupBy(*keys, "series_ord").agg(
        F.max("series_name").alias("name"), F.max("kind").alias("kind"), *heads,
        F.collect_list(point(F.col("spot"), F.col("value").cast("string"))).alias("val"), F.collect_set(point(F.col("spot"), F.col("category"))).alias("cat"),
    )
    rows = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("series_ord", "name", "kind", "val"))).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("cat")))).alias("cat"), *heads)
    texts = lambda ps: F.transform(ps, lambda p: F.struct(p["idx"].cast("string").alias("idx"), p["v"].alias("v")))
    cache = lambda kind, code, n, ps: F.struct(F.lit(kind).alias("variant"), F.lit(True).alias("present"), code.cast("string").alias("format"), n.cast("string").alias("pt_count"), texts(ps).alias("points"))
    tag = lambda kind: F.when(kind.isin("bar", "column"), "barChart").otherwise(F.concat(kind, F.lit("Chart")))
    side = lambda kind: F.when(kind == "bar", "bar").when(kind == "column", "col")
    n, nothing = F.size("cat"), F.lit(None)
    series = F.transform("s", lambda x: F.struct(
        tag(x["kind"]).alias("parent"), side(x["kind"]).alias("bar_dir"), cache("strRef", nothing, F.lit(1), F.array(point(F.lit(0), x["name"]))).alias("name"), nothing.cast("string").alias("name_text"),
        cache("strRef", nothing, n, F.col("cat")).alias("cat"), cache("numRef", F.col("value_format"), n, x["val"]).alias("val"),
    ))
    plots = F.array_distinct(F.transform("s", lambda x: F.struct(tag(x["kind"]).alias("tag"), side(x["kind"]).alias("bar_dir"), F.when(F.col("stacked"), "stacked").otherwise("clustered").alias("grouping"))))
    lines = lambda c: F.filter(F.array(c), lambda t: t.isNotNull())
    raw = F.struct(lines(F.col("title")).alias("title"), F.lit(True).alias("has_plot"), plots.alias("plots"), F.array(lines(F.col("axis"))).alias("axis_titles"), series.alias("series"))
    return rows.select(*keys, raw.alias("raw"))
