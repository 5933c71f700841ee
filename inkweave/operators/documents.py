"""Word documents to Markdown: blocks, lists, tables, images and figures in place.

A document's own relationships, media and rendered charts are looked up in maps
beside its blocks, so its text is made where its row is; only charts are
exploded, rendered and gathered again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkweave.functions.text import built, captions, figure_marker, image_marker, let, resolve, strip
from inkweave.operators import charts, render

MIN_IMAGE = 5000
MAIN = "word/document.xml"


@built
def _links() -> Column:
    own = F.filter("rels", lambda r: r["source_part"] == MAIN)
    return F.map_from_entries(F.transform(own, lambda r: F.struct(r["rel_id"], F.when(r["rel_type"].endswith("/hyperlink"), r["target"]).otherwise(resolve(r["source_part"], r["target"])))))


@built
def _pictures() -> Column:
    return F.map_from_entries(F.transform("media", lambda m: F.struct(m["part"], F.struct(m["id12"].alias("id12"), m["n_bytes"].alias("n_bytes")))))


@built
def _referenced() -> Column:
    image = F.filter("rels", lambda r: r["used"] & r["rel_type"].endswith("/image") & r["source_part"].startswith("word/") & r["source_part"].endswith(".xml"))
    return F.array_distinct(F.filter(F.transform(image, lambda r: F.try_element_at(F.col("pictures"), resolve(r["source_part"], r["target"]))["id12"]), lambda x: x.isNotNull()))


def _maps(shredded: DataFrame, gate: str) -> DataFrame:
    """Adds ``links`` (relationship to part, or to a hyperlink's target), ``pictures`` (part to id and size), ``plots`` (chart part to Markdown and captions) and ``referenced`` (ids)."""
    df = shredded.withColumn("links", _links()).withColumn("pictures", _pictures()).withColumn("referenced", _referenced())
    plots = shredded.select("source_id", F.explode("charts").alias("c")).select("source_id", F.col("c.part").alias("part"), F.col("c.raw").alias("raw"), captions(F.col("c.captions")).alias("texts"))
    plots = render.with_markdown(charts.parse(plots), gate=gate)
    plots = plots.groupBy("source_id").agg(F.map_from_entries(F.collect_list(F.struct("part", F.struct("markdown", "texts")))).alias("plots"))
    return df.join(plots, "source_id", "left")


def _escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([*_])", r"\\$1")


def _inline(run: Column, links: Column, figures: Column) -> Column:
    """A run as Markdown; spaces at its ends stay outside of its marks."""
    text = _escaped(run["text"])
    core = strip(text)
    marks = F.concat(F.when(run["bold"], "**").otherwise(""), F.when(run["italic"], "*").otherwise(""))
    target = F.when(run["href"].startswith("rel:"), F.try_element_at(links, F.substr(run["href"], F.lit(5)))).otherwise(run["href"])
    dressed = F.concat(marks, core, F.reverse(marks))
    linked = F.when(target.isNotNull(), F.concat(F.lit("["), dressed, F.lit("]("), target, F.lit(")"))).otherwise(dressed)
    ends = lambda pattern: F.when(text.rlike(pattern), " ").otherwise("")
    word = F.when(core == "", F.when(text == "", "").otherwise(" ")).otherwise(F.concat(ends(r"^\s"), linked, ends(r"\s$")))
    note = F.concat(F.lit("[["), run["text"], F.lit("]](#"), run["ref"], F.lit(")"))
    return F.when(run["kind"] == "text", word).when(run["kind"] == "break", "  \n").when(run["kind"] == "note", note).when(run["kind"] == "figure", F.concat(F.lit("\n\n"), F.get(figures, run["ref"].cast("int"))["block"], F.lit("\n\n"))).when(run["kind"] == "image", F.get(F.filter(figures, lambda f: f["rid"] == run["ref"]), F.lit(0))["block"]).otherwise("")


def _joined(runs: Column, links: Column, figures: Column) -> Column:
    return F.array_join(F.transform(runs, lambda r: F.coalesce(_inline(r, links, figures), F.lit(""))), "")


def _picture(rid: Column) -> Column:
    return F.try_element_at(F.col("pictures"), F.try_element_at(F.col("links"), rid))


@built
def _figs() -> Column:
    plot = lambda f: F.try_element_at(F.col("plots"), F.try_element_at(F.col("links"), f["chart_rid"]))
    texts = lambda f: F.when(f["kind"] == "group", captions(f["texts"])).otherwise(F.coalesce(plot(f)["texts"], F.array().cast("array<string>")))
    return F.transform("figures", lambda f: F.struct(
        F.lit(None).cast("string").alias("rid"), F.coalesce(F.when(f["kind"] == "chart", plot(f)["markdown"]), figure_marker(f["kind"], f["id12"], texts(f))).alias("block"),
        (F.coalesce(plot(f)["markdown"], F.lit("")) != "").alias("drawn"), f["kind"].alias("kind"),
    ))


@built
def _imgs() -> Column:
    """Images of the text, by relationship; small ones vanish."""
    runs = F.flatten(F.transform("blocks", lambda b: F.concat(b["runs"], F.coalesce(F.flatten(F.transform(F.flatten(b["cells"]), lambda c: c["runs"])), F.slice(b["runs"], 1, 0)))))
    rids = F.array_distinct(F.transform(F.filter(runs, lambda r: r["kind"] == "image"), lambda r: r["ref"]))
    return F.transform(rids, lambda rid: F.struct(rid.alias("rid"), _picture(rid)["id12"].alias("id12"), F.coalesce(_picture(rid)["n_bytes"] >= MIN_IMAGE, F.lit(False)).alias("shown")))


@built
def _shown() -> Column:
    return F.transform("imgs", lambda x: F.struct(x["rid"].alias("rid"), F.when(x["shown"], F.concat(F.lit("\n\n"), image_marker(x["id12"]), F.lit("\n\n"))).otherwise("").alias("block"), F.lit(False).alias("drawn"), F.lit("image").alias("kind")))


@built
def _made() -> Column:
    """The blocks as Markdown, and whether each is an item of a list."""
    links, figs = F.col("links"), F.col("figs")
    named = lambda b: F.lower(F.coalesce(F.get(F.filter("styles", lambda s: s["id"] == b["style"]), F.lit(0))["name"], F.regexp_replace(b["style"], r"(?i)^heading(\d)$", "heading $1"), F.lit("")))
    listed = lambda b: b["num_id"].isNotNull() & (b["num_id"] != "0")

    def paragraph(b: Column) -> Column:
        text = strip(_joined(b["runs"], links, figs))
        depth = F.regexp_extract(named(b), r"^heading ([1-6])$", 1)
        item = lambda t: F.concat(F.repeat(F.lit("  "), b["level"]), F.when(b["number"] > 0, F.concat(b["number"].cast("string"), F.lit(". "))).otherwise("* "), t)
        head = lambda d, t: F.concat(F.repeat(F.lit("#"), d.try_cast("int")), F.lit(" "), F.replace(t, F.lit("\n"), F.lit(" ")))
        return let(text, lambda t: F.when(t == "", "").otherwise(let(depth, lambda d: F.when(d != "", head(d, t)).when(listed(b), item(t)).otherwise(t))))

    def grid(b: Column) -> Column:
        cell = lambda c: F.concat(F.lit(" "), F.regexp_replace(strip(_joined(c["runs"], links, figs)), r"\s*\n\s*", " "), F.repeat(F.lit(" |"), c["span"]))
        rows = F.transform(b["cells"], lambda r: F.concat(F.lit("|"), F.array_join(F.transform(r, cell), "")))
        wide = F.greatest(F.lit(1), F.aggregate(F.get(b["cells"], F.lit(0)), F.lit(0), lambda n, c: n + c["span"]))
        return F.array_join(F.concat(F.array(F.concat(F.lit("|"), F.repeat(F.lit("  |"), wide)), F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), wide))), rows), "\n")

    made = F.transform("blocks", lambda b: F.struct(listed(b).alias("item"), F.when(b["kind"] == "table", grid(b)).otherwise(paragraph(b)).alias("text")))
    return F.filter(made, lambda b: F.coalesce(b["text"], F.lit("")) != "")


@built
def _text() -> Column:
    glue = lambda b, i: F.when(i == 0, "").when(b["item"] & F.get(F.col("made"), i - 1)["item"], "\n").otherwise("\n\n")
    return strip(F.regexp_replace(F.array_join(F.transform("made", lambda b, i: F.concat(glue(b, i), b["text"])), ""), r"\n{3,}", "\n\n"))


@built
def _lost() -> Column:
    """Referenced images that stand nowhere in the text."""
    taken = F.transform(F.filter("imgs", lambda x: x["shown"]), lambda x: x["id12"])
    inside = F.transform(F.flatten(F.transform("figures", lambda f: f["rel_ids"])), lambda rid: _picture(rid)["id12"])
    big = F.transform(F.array_sort(F.filter("media", lambda m: m["part"].startswith("word/media/") & (m["n_bytes"] >= MIN_IMAGE))), lambda m: m["id12"])
    placed = F.filter(F.concat(taken, inside), lambda y: y.isNotNull())
    return F.array_except(F.array_intersect(big, "referenced"), placed)


@built
def _tail() -> Column:
    return F.when(F.size("lost") > 0, F.concat(F.lit("\n## Figures (position unknown)\n\n"), F.array_join(F.transform("lost", image_marker), "\n"), F.lit("\n"))).otherwise("")


def documents(shredded: DataFrame, gate: str = "structural") -> DataFrame:
    """``source_id, markdown, charts_found, charts_rendered, groups_found, has_content`` of readable documents."""
    df = _maps(shredded, gate).withColumn("figs", _figs()).withColumn("imgs", _imgs())
    df = df.withColumn("figs", F.concat("figs", _shown())).withColumn("made", _made()).withColumn("text", _text()).withColumn("lost", _lost())
    count = lambda kind: F.size(F.filter("figures", lambda f: f["kind"] == kind))
    return df.select(
        "source_id", F.concat("text", F.lit("\n"), _tail()).alias("markdown"), count("chart").alias("charts_found"), F.size(F.filter("figs", lambda f: (f["kind"] == "chart") & f["drawn"])).alias("charts_rendered"),
        count("group").alias("groups_found"), (F.col("text") != "").alias("has_content"),
    )
