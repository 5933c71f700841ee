"""Text functions as columns: labels, captions, Markdown hygiene, scoring, markers."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO_WIDTH = "​"
MAX_ANSWER = 50_000
SHOWN_NUMBERS = 10
SECRETS = "(?i)(" + "|".join((r"sk-ant-[A-Za-z0-9-]+", r"sk-[A-Za-z0-9]{20,}", r"Authorization:\s*\S+", r"Bearer\s+\S+")) + ")"
IMAGE_MARK = r"> \[Image, docx media ([0-9a-f]{12}) — raster content not analyzed\]"
GROUP_MARK = r"> \[Figure, docx group ([0-9a-f]{12}) — composite content not analyzed\]\n> captions: ([^\n]*)"
RASTER = {"png": "png", "jpg": "jpeg", "jpeg": "jpeg", "gif": "gif", "bmp": "bmp", "tif": "tiff", "tiff": "tiff"}


def built(make: Callable[..., Column]) -> Callable[..., Column]:
    """Keeps the expression that ``make`` builds of names and flags: large ones take seconds of calls to the JVM."""
    kept: dict = {}

    @wraps(make)
    def once(*names):
        key = (SparkContext._gateway, *names)
        if key not in kept:
            kept.clear() if kept and next(iter(kept))[0] is not key[0] else None
            kept[key] = make(*names)
        return kept[key]

    return once


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def label(c: Column) -> Column:
    """Text fit for a quoted diagram label."""
    return F.coalesce(F.nullif(strip(F.translate(c, '"[]{}()', "'")), F.lit("")), F.lit("?"))


def slug(c: Column, number: Column) -> Column:
    """A bare word for diagram ids."""
    s = F.lower(F.regexp_replace(F.regexp_replace(c, "[^a-zA-Z0-9]+", "_"), "^_+|_+$", ""))
    return F.when(s.rlike("^[a-z]"), s).otherwise(F.concat(F.lit("s"), number.cast("string"), s))


def captions(texts: Column) -> Column:
    """Non-blank, non-geometry texts, each at its first place."""
    return F.array_distinct(F.filter(F.transform(texts, strip), lambda t: (t != "") & ~t.rlike(r"^-?\d+$")))


def rich_text(texts: Column) -> Column:
    """Non-blank text nodes joined by a space; null if there is none."""
    return F.nullif(F.array_join(F.filter(F.transform(texts, strip), lambda t: t != ""), " "), F.lit(""))


def id12(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 12)


# == Markdown hygiene


def demote_headings(md: Column) -> Column:
    """Headings outside code fences become bold text.

    Fence lines toggle, so the text between them is outside and inside in turn:
    the even pieces are rewritten, in one pass over the text.
    """
    fence = r"(?mdU)^[^\S\n]*```[^\n]*$"
    heading = r"(?mdU)^[^\S\n]*#{1,6}[^\S\n]+(\S(?:[^\n]*\S)?)[^\S\n]*$"
    fences = F.regexp_extract_all(md, F.lit(f"({fence})"))
    pieces = F.transform(F.split(md, fence, -1), lambda x, i: F.when(i % 2 == 0, F.regexp_replace(x, heading, r"**$1**")).otherwise(x))
    return _woven(pieces, fences)


def _woven(pieces: Column, between: Column) -> Column:
    """The pieces of a split with what stood between them, in one pass."""
    return F.array_join(F.zip_with(pieces, between, lambda x, y: F.concat(x, F.coalesce(y, F.lit("")))), "")


def balance_fences(md: Column) -> Column:
    """Closes a last fence that was left open."""
    odd = F.regexp_count(md, F.lit("```")) % 2 == 1
    return F.when(odd, F.concat(F.regexp_replace(md, r"\n+\z", ""), F.lit("\n```"))).otherwise(md)


def gate_fences(md: Column, gate: str = "structural") -> Column:
    """Diagram fences whose code isn't accepted become plain text fences.  A fence is split off, tested and put back."""
    if gate == "off":
        return md
    fence = r"(?ms)^```mermaid[ \t]*\n.*?^```[ \t]*$"
    found, rest = F.regexp_extract_all(md, F.lit(f"({fence})")), F.split(md, fence, -1)
    code = lambda x: F.regexp_replace(F.regexp_replace(x, r"^```mermaid[ \t]*\n", ""), r"\n*```[ \t]*\z", "")
    kept = F.transform(found, lambda x: F.when(accepted(code(x)), x).otherwise(F.regexp_replace(x, r"^```mermaid", "```text")))
    return _woven(rest, kept)


_NUM = r"-?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?"
_QUOTED = r'"[^"\n]+"'
_LIST = rf"{_NUM}(, ?{_NUM})*"


def accepted(code: Column) -> Column:
    """Structural grammar of the three diagram kinds; weaker than a renderer's judgement."""
    pie = rf'\Apie( title [^\n]+)?(\n\s*{_QUOTED} : (\d+\.?\d*|\.\d+)(e[+-]?\d+)?)+\s*\z'
    chart = rf"\Axychart-beta\nx-axis \[{_QUOTED}(, {_QUOTED})*\]\ny-axis {_QUOTED} {_NUM} --> {_NUM}(\n(bar|line) \[{_LIST}\])+\s*\z"
    radar = rf"\Aradar-beta\naxis \w+\[{_QUOTED}\](, \w+\[{_QUOTED}\])*(\ncurve \w+\[{_QUOTED}\]\{{{_LIST}\}})+\s*\z"
    return code.rlike(pie) | code.rlike(chart) | code.rlike(radar)


def neutralize(md: Column) -> Column:
    """Quoted brackets at a line's start get a zero-width space, so that they can't pass for markers."""
    return F.regexp_replace(md, r"(?m)^> \[", f"> {ZERO_WIDTH}[")


def sanitize(md: Column, gate: str = "structural") -> Column:
    return let(demote_headings(md), lambda x: let(balance_fences(x), lambda y: neutralize(gate_fences(y, gate))))


def redact(text: Column) -> Column:
    return F.regexp_replace(text, SECRETS, "***REDACTED***")


def answer(text: Column) -> Column:
    """A model's answer if it isn't blank, cut at the cap."""
    return F.when(strip(text) != "", F.substring(text, 1, MAX_ANSWER))


# == scoring


def letters(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"([\p{L}\p{Nl}\p{No}]+)")), F.lower))


def token_recall(reference: Column, candidate: Column) -> Column:
    """Share of the reference's distinct words that the candidate has; 1 without words."""
    return let(letters(reference), lambda words: F.when(F.size(words) == 0, 1.0).otherwise(F.size(F.array_intersect(words, letters(candidate))) / F.size(words)))


def numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(\p{Nd}+)"))


def _numbered(rows: Column) -> Column:
    """Texts with the how-manieth of its kind each is, by sorting: ``a a b`` as ``a#1 a#2 b#1`` (in runs)."""

    def runs(s: Column) -> Column:
        heads = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (x != F.get(s, i - 1)), i)), lambda i: i.isNotNull())
        return let(heads, lambda h: F.flatten(F.transform(h, lambda at, k: F.transform(F.sequence(F.lit(1), F.coalesce(F.get(h, k + 1), F.size(s)) - at), lambda n: F.concat(F.get(s, at), F.lit("#"), n.cast("string"))))))

    return let(F.array_sort(rows), runs)


def missing_numbers(witness: Column, description: Column) -> Column:
    """Digit runs that the witness has more often than the description, distinct, in numeric order."""
    left = F.array_except(_numbered(numbers(witness)), _numbered(numbers(description)))
    gone = F.array_distinct(F.transform(left, lambda x: F.regexp_extract(x, "^([^#]*)", 1)))
    digits = lambda x: F.regexp_replace(x, "^0+", "")
    return F.transform(F.array_sort(F.transform(gone, lambda x: F.struct(F.length(digits(x)).alias("n"), digits(x).alias("d"), x.alias("x")))), lambda s: s["x"])


def missing_side(gone: Column) -> Column:
    """The first ones and how many more; ``none`` if there are none."""

    def told(g: Column) -> Column:
        more = F.size(g) - SHOWN_NUMBERS
        text = F.concat(F.array_join(F.slice(g, 1, SHOWN_NUMBERS), ","), F.when(more > 0, F.concat(F.lit("…+"), more.cast("string"))).otherwise(""))
        return F.when(F.size(g) == 0, "none").otherwise(text)

    return let(gone, told)


def witness_defects(witness: Column, description: Column, ident: Column, least: float | Column = 0.8) -> Column:
    """Defects of a description against the document's own captions; a signal, not an error."""
    low = lambda r: F.when(r < least, F.concat(F.lit("figure-witness-recall: "), ident, F.lit(" "), F.format_number(r, 2)))
    numeric = lambda side: F.when(side != "none", F.concat(F.lit("figure-witness-numeric: "), ident, F.lit(" witness_only=["), side, F.lit("]")))
    found = F.array(let(token_recall(witness, description), low), let(missing_side(missing_numbers(witness, description)), numeric))
    return F.when(strip(witness) == "", F.array().cast("array<string>")).otherwise(F.filter(found, lambda x: x.isNotNull()))


_VERDICTS = (("hallucination", "yes", "vlm-judge-hallucination"), ("mermaid_fit", "no", "vlm-judge-mermaid"), ("language", "no", "vlm-judge-language"))


def verdict_defects(reply: Column) -> Column:
    """Tags of a judge's reply; an incomplete reply gives none.  The last line of a key counts."""
    said = [F.regexp_extract_all(reply, F.lit(rf"(?im)^\s*{key}\s*:\s*(n/a|no|yes)\s*$")) for key, _, _ in _VERDICTS]
    tags = [F.when(F.lower(F.try_element_at(x, F.lit(-1))) == bad, tag) for x, (_, bad, tag) in zip(said, _VERDICTS)]
    whole = (F.size(said[0]) > 0) & (F.size(said[1]) > 0) & (F.size(said[2]) > 0)
    return F.when(whole, F.filter(F.array(*tags), lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))


def panel(first: Column, second: Column) -> Column:
    """Union of two judges' tags, each once, in order."""
    return F.array_union(first, second)


# == markers


def image_marker(ident: Column) -> Column:
    return F.concat(F.lit("> [Image, docx media "), ident, F.lit(" — raster content not analyzed]"))


def caption_line(texts: Column) -> Column:
    return F.concat(F.lit("> captions: "), F.when(F.size(texts) > 0, F.array_join(texts, "; ")).otherwise("(no captions)"))


def figure_marker(kind: Column, ident: Column, texts: Column) -> Column:
    noun = F.when(kind == "group", "composite").otherwise("chart")
    return F.concat(F.lit("> [Figure, docx "), kind, F.lit(" "), ident, F.lit(" — "), noun, F.lit(" content not analyzed]\n"), caption_line(texts))


def sheet_chart_marker(ident: Column, sheet: Column, cell: Column, texts: Column) -> Column:
    return F.concat(F.lit("> [Figure, xlsx chart "), ident, F.lit(" on "), sheet, F.lit("!"), cell, F.lit(" — chart content not analyzed]\n"), caption_line(texts))


def injected(head: Column, address: Column, model: Column, markdown: Column, gate: str = "structural") -> Column:
    """A model's text between an opening and a closing line."""
    opened = F.concat(F.lit("> ["), head, F.lit(" — VLM interpretation ("), model, F.lit("); reconstruction, verify against original]"))
    return F.concat(opened, F.lit("\n\n"), sanitize(markdown, gate), F.lit("\n\n> [/VLM interpretation "), address, F.lit("]"))


def mime(name: Column) -> Column:
    """Image type of a part by its extension; null for what isn't raster."""
    kinds = F.create_map(*(F.lit(x) for k, v in RASTER.items() for x in (k, f"image/{v}")))
    return F.try_element_at(kinds, F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1)))


def data_uri(kind: Column, content: Column) -> Column:
    return F.concat(F.lit("data:"), kind, F.lit(";base64,"), F.replace(F.base64(content), F.lit("\r\n"), F.lit("")))


def split_uri(uri: Column) -> Column:
    """``mime`` and ``body`` of a data URI; null if it is none."""
    whole = r"^data:([^;,]+);base64,(.*)$"
    return F.when(uri.rlike(f"(?s){whole}"), F.struct(F.regexp_extract(uri, f"(?s){whole}", 1).alias("mime"), F.regexp_extract(uri, f"(?s){whole}", 2).alias("body")))


def cell_name(col: Column, row: Column) -> Column:
    """A1 notation from zero-based column and row (columns up to ZZZ)."""
    letter = lambda n: F.char(F.lit(65) + n)
    n = col.cast("long")
    two, three = n - 26, n - 702
    name = (
        F.when(n < 26, letter(n))
        .when(n < 702, F.concat(letter(F.floor(two / 26)), letter(two % 26)))
        .otherwise(F.concat(letter(F.floor(three / 676)), letter(F.floor(three / 26) % 26), letter(three % 26)))
    )
    return F.concat(name, (row.cast("long") + 1).cast("string"))


def formula_ref(f: Column) -> Column:
    """``sheet`` and ``range`` of a chart formula; null without a sheet."""
    sheet = strip(F.regexp_extract(f, r"^([^!]*)!", 1))
    sheet = F.when(sheet.rlike("^'.*'$"), F.replace(F.regexp_replace(sheet, "^'|'$", ""), F.lit("''"), F.lit("'"))).otherwise(sheet)
    return F.when((F.instr(f, "!") > 0) & (sheet != ""), F.struct(sheet.alias("sheet"), F.regexp_extract(f, r"(?s)^[^!]*!(.*)$", 1).alias("range")))


def resolve(source_part: Column, target: Column) -> Column:
    """A relationship's target as a part name: from the package's root if it begins with a slash, else from the source's folder."""
    folder = F.regexp_extract(source_part, r"^(.*/)?[^/]*$", 1)
    joined = F.when(target.startswith("/"), F.regexp_replace(target, "^/+", "")).otherwise(F.concat(folder, target))
    steps = F.filter(F.split(joined, "/", -1), lambda s: (s != "") & (s != "."))

    def step(acc: Column, s: Column) -> Column:
        up = (s == "..") & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("..")) != "..")
        return F.when(up, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(steps, F.array().cast("array<string>"), step, lambda acc: F.array_join(acc, "/"))
