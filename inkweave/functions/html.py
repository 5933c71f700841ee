"""HTML to Markdown: ATX headings, star bullets, tables with an empty header row where there is none."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

_SKIP = {"script", "style", "head", "template", "noscript"}
_BLOCK = {"p", "div", "article", "section", "nav", "footer", "header", "body", "ul", "ol", "blockquote", "main", "aside"}
_HEADINGS = {f"h{k}": k for k in range(1, 7)}


class _Markdown(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = 0
        self.lists: list[list] = []
        self.links: list[str | None] = []
        self.row: list[str] | None = None
        self.rows: list[tuple[bool, list[str]]] = []
        self.head = False
        self.saved: list[list[str]] = []

    def gap(self) -> None:
        self.out.append("\n\n")

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _SKIP:
            self.skip += 1
        elif self.skip:
            pass
        elif tag in _HEADINGS:
            self.out.append("\n\n" + "#" * _HEADINGS[tag] + " ")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "br":
            self.out.append("  \n")
        elif tag == "a":
            self.links.append(dict(attrs).get("href"))
            self.out.append("[" if self.links[-1] else "")
        elif tag == "li":
            kind = self.lists[-1] if self.lists else ["ul", 0]
            kind[1] += 1
            self.out.append("\n" + "  " * (len(self.lists) - 1) + (f"{kind[1]}. " if kind[0] == "ol" else "* "))
        elif tag == "table":
            self.rows = []
        elif tag == "tr":
            self.handle_endtag("tr")  # one that was left open
            self.row, self.head = [], False
        elif tag in ("td", "th"):
            self.handle_endtag("td")
            self.head |= tag == "th"
            self.saved.append(self.out)
            self.out = []
        elif tag in _BLOCK:
            if tag in ("ul", "ol"):
                self.lists.append([tag, 0])
            self.gap()

    def handle_endtag(self, tag: str) -> None:
        if tag in _SKIP:
            self.skip = max(0, self.skip - 1)
        elif self.skip:
            pass
        elif tag in _HEADINGS:
            self.gap()
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "a" and self.links:
            target = self.links.pop()
            self.out.append(f"]({target})" if target else "")
        elif tag in ("td", "th") and self.saved:
            text = re.sub(r"\s+", " ", "".join(self.out)).strip()
            self.out = self.saved.pop()
            if self.row is not None:
                self.row.append(text)
        elif tag == "tr" and self.row is not None:
            self.handle_endtag("td")
            self.rows.append((self.head, self.row))
            self.row = None
        elif tag == "table":
            self.handle_endtag("tr")
            wide = max([1, *(len(r) for _, r in self.rows)])
            head = self.rows.pop(0)[1] if self.rows and self.rows[0][0] else []
            line = lambda r: "| " + " | ".join([*r, *[""] * (wide - len(r))]) + " |"
            self.out.append("\n\n" + "\n".join([line(head), line(["---"] * wide), *(line(r) for _, r in self.rows)]) + "\n\n")
            self.rows = []
        elif tag in _BLOCK:
            if tag in ("ul", "ol") and self.lists:
                self.lists.pop()
            self.gap()

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.out.append(re.sub(r"([*_])", r"\\\1", re.sub(r"\s+", " ", data)))


def to_markdown(html: str | None) -> str | None:
    """Markdown of one page; scripts, styles and the head are left out."""
    if html is None:
        return None
    p = _Markdown()
    p.feed(html)
    p.close()
    while p.saved:
        p.out = [*p.saved.pop(), *p.out]
    text = re.sub(r"[ \t]*\n[ \t]*\n\s*", "\n\n", "".join(p.out))
    return re.sub(r"\*\*\s*\*\*", "", text).strip()


def with_markdown(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """``key, markdown`` of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([to_markdown(x) for x in batch.column(1).to_pylist()], pa.string())], names=[key, "markdown"])

    return pages.select(key, html).mapInArrow(run, f"{key} {pages.schema[key].dataType.simpleString()}, markdown string")
