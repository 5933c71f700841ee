"""Office packages to rows: one row a document, with all that later joins and expressions need.

The kernel only unpacks and shreds.  Limits are checked on the central
directory before anything is read, and again on the bytes that come.
"""

from __future__ import annotations

import hashlib
import io
import posixpath
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType, _parse_datatype_string

from inkweave.schemas import RAW_CHART
from inkweave.sources.xmltree import BadXml, Node, parse, spans_of

MAX_MEMBER = 128 << 20
MAX_TOTAL = 512 << 20
MAX_ENTRIES = 10_000
CHUNK = 1 << 20
#: Names of packages, however their suffix is spelt, as a file pattern.
ANY_CASE = "*.{[dD][oO][cC][xX],[xX][lL][sS][xX]}"
MAX_ROW, MAX_COLUMN = 1 << 20, 1 << 14

RUN = "struct<kind:string,text:string,bold:boolean,italic:boolean,href:string,ref:string>"
BLOCK = f"struct<kind:string,style:string,num_id:string,level:int,number:int,runs:array<{RUN}>,cells:array<array<struct<span:int,runs:array<{RUN}>>>>>"
FIGURE = "struct<kind:string,id12:string,texts:array<string>,rel_ids:array<string>,chart_rid:string>"
SHREDDED = (
    "status string, error string, parts array<struct<part:string,size:bigint>>, rels array<struct<source_part:string,rel_id:string,rel_type:string,target:string,used:boolean>>, "
    f"media array<struct<part:string,id12:string,n_bytes:bigint>>, charts array<struct<part:string,id12:string,captions:array<string>,raw:{RAW_CHART}>>, "
    f"blocks array<{BLOCK}>, figures array<{FIGURE}>, styles array<struct<id:string,name:string>>, numbering array<struct<num_id:string,level:int,fmt:string>>, "
    "sheets array<struct<ord:int,name:string,rid:string,state:string>>, sheet_rows array<struct<part:string,rows:array<struct<r:int,cells:array<struct<c:int,t:string,v:string,s:int>>>>>>, "
    "shared array<string>, formats array<string>, date1904 boolean, drawings array<struct<part:string,rid:string>>, anchors array<struct<part:string,ord:int,col:int,row:int,rid:string>>"
)


class Refused(ValueError):
    """The archive is corrupt or beyond a limit."""


class Unsupported(ValueError):
    """The archive isn't of the expected format."""


# == archive


def check(z: zipfile.ZipFile, max_member: int = MAX_MEMBER, max_total: int = MAX_TOTAL, max_entries: int = MAX_ENTRIES) -> None:
    """Refuses by what the central directory declares."""
    listing = z.infolist()
    if len(listing) > max_entries:
        raise Refused(f"{len(listing)} entries, more than {max_entries}")
    total = 0
    for info in listing:
        total += info.file_size
        if info.file_size > max_member:
            raise Refused(f"{info.filename}: {info.file_size} bytes declared, more than {max_member}")
        if total > max_total:
            raise Refused(f"over {max_total} bytes declared in all")


def read(z: zipfile.ZipFile, part: str, most: int = MAX_MEMBER) -> bytes:
    """A member's bytes; stops as soon as there are more than ``most``, whatever was declared."""
    got, size = [], 0
    with z.open(part) as f:
        while chunk := f.read(CHUNK):
            size += len(chunk)
            if size > most:
                raise Refused(f"{part}: more than {most} bytes")
            got.append(chunk)
    return b"".join(got)


# == charts


def _cache(holder: Node | None) -> dict | None:
    """Points of a reference's cache or of literals; of several variants the first in the order of precedence."""
    if holder is None:
        return None
    for variant, inner in (("strRef", "strCache"), ("strLit", None), ("numRef", "numCache"), ("numLit", None)):
        found = holder.find(variant)
        if found is not None:
            cache = found.find(inner) if inner else found
            if cache is None:
                return {"variant": variant, "present": False, "format": None, "pt_count": None, "points": []}
            code, count = cache.find("formatCode"), cache.find("ptCount")
            points = [{"idx": p.get("idx"), "v": (v.text if (v := p.find("v")) is not None else None)} for p in cache.children if p.tag == "pt"]
            return {"variant": variant, "present": True, "format": code.text if code is not None else None, "pt_count": count.get("val") if count is not None else None, "points": points}
    return None


def _only(holder: Node | None, *variants: str) -> dict | None:
    if holder is None:
        return None
    kept = Node(holder.ns, holder.tag, {})
    kept.content = [x for x in holder.children if x.tag in variants]
    return _cache(kept)


def _val(node: Node, child: str) -> str | None:
    found = node.find(child)
    return found.get("val") if found is not None else None


def raw_chart(root: Node) -> dict | None:
    """The facts of a chart part as written; null if it holds no chart."""
    chart = root.find("chart")
    if chart is None:
        return None
    title, plot = chart.find("title"), chart.find("plotArea")
    out = {"title": title.texts() if title is not None else [], "has_plot": plot is not None, "plots": [], "axis_titles": [], "series": []}
    if plot is None:
        return out
    parent = {id(kid): node for node in [plot, *plot.walk()] for kid in node.children}
    out["plots"] = [{"tag": p.tag, "bar_dir": _val(p, "barDir"), "grouping": _val(p, "grouping")} for p in plot.children]
    out["axis_titles"] = [t.texts() for ax in chart.walk() if ax.tag == "valAx" and (t := ax.find("title")) is not None]
    for s in plot.walk():
        if s.tag != "ser":
            continue
        up, tx = parent[id(s)], s.find("tx")
        ref = tx.find("strRef") if tx is not None else None
        literal = tx.find("v") if tx is not None and ref is None else None
        cat = s.find("cat")
        val = s.find("val")
        out["series"].append({
            "parent": up.tag, "bar_dir": _val(up, "barDir"), "name": _only(tx, "strRef"), "name_text": literal.text if literal is not None else None,
            "cat": _cache(cat if cat is not None else s.find("xVal")), "val": _only(val if val is not None else s.find("yVal"), "numRef", "numLit"),
        })
    return out


# == word documents

_GRAPHICS = ("drawing", "pict", "object")


def _is_group(node: Node) -> bool:
    choice = node.find("Choice")
    return node.tag == "AlternateContent" and choice is not None and any(x.tag == "wgp" for x in choice.walk())


def _on(props: Node | None, tag: str) -> bool:
    found = props.find(tag) if props is not None else None
    return found is not None and found.get("val") not in ("0", "false", "off", "none")


def _figure(node: Node, kind: str, chart_rid: str | None = None) -> dict:
    ids = [v for x in [node, *node.walk()] for k, v in x.attrs.items() if k in ("r:embed", "r:id", "r:link")]
    return {"kind": kind, "id12": node.id12(), "texts": node.texts() if kind == "group" else [], "rel_ids": ids, "chart_rid": chart_rid}


def _space() -> dict:
    return {"kind": "text", "text": " ", "bold": False, "italic": False, "href": None, "ref": None}


def _inside(node: Node, tag: str) -> list[Node]:
    """Children of a kind, content controls looked through."""
    return [y for x in node.children for y in ([x] if x.tag == tag else _inside(x, tag) if x.tag in ("sdt", "sdtContent", "customXml", "ins") else [])]


def _count(blocks: list[dict], formats: dict[tuple[str, int], str]) -> None:
    """Gives the items of ordered lists their numbers; a list ends where other text or an outer item comes."""
    open_lists: list[tuple[int, bool, int]] = []
    for b in blocks:
        if b["num_id"] in (None, "0"):
            if b["runs"] or b["cells"]:
                open_lists.clear()
            continue
        ordered = formats.get((b["num_id"], b["level"]), "bullet") != "bullet"
        while open_lists and open_lists[-1][0] > b["level"]:
            open_lists.pop()
        n = 1
        if open_lists and open_lists[-1][0] == b["level"]:
            _, same, last = open_lists.pop()
            n = last + 1 if same == ordered else 1
        open_lists.append((b["level"], ordered, n))
        b["number"] = n if ordered else 0


class _Body:
    """Walks a body once; figures and notes get numbers in the order of the text."""

    def __init__(self) -> None:
        self.figures: list[dict] = []
        self.notes: list[tuple[str, str]] = []
        self.boxes: list[dict] = []  # blocks of text boxes, which follow their paragraph

    def runs(self, node: Node, bold: bool = False, italic: bool = False, href: str | None = None) -> list[dict]:
        out: list[dict] = []

        def put(kind: str, text: str = "", ref: str | None = None, b: bool = bold, i: bool = italic) -> None:
            if kind == "text" and out and out[-1]["kind"] == "text" and (out[-1]["bold"], out[-1]["italic"], out[-1]["href"]) == (b, i, href):
                out[-1]["text"] += text
            else:
                out.append({"kind": kind, "text": text, "bold": b, "italic": i, "href": href, "ref": ref})

        for x in node.children:
            if x.tag == "r":
                props = x.find("rPr")
                for r in self.runs(x, _on(props, "b"), _on(props, "i"), href):
                    put(r["kind"], r["text"], r["ref"], r["bold"], r["italic"])
            elif x.tag == "t":
                put("text", "".join(x.texts()))
            elif x.tag == "tab":
                put("text", "\t")
            elif x.tag in ("br", "cr"):
                put("break")
            elif x.tag == "noBreakHyphen":
                put("text", "‑")
            elif x.tag == "hyperlink":
                link = x.get("r:id")
                target = f"rel:{link}" if link else f"#{x.get('anchor')}" if x.get("anchor") else None
                out.extend(self.runs(x, bold, italic, target))
            elif x.tag in ("footnoteReference", "endnoteReference"):
                self.notes.append((x.tag[: -len("Reference")], x.get("id") or ""))
                put("note", str(len(self.notes)), "-".join(self.notes[-1]))
            elif x.tag == "AlternateContent":
                if _is_group(x):
                    self.figures.append(_figure(x, "group"))
                    put("figure", ref=str(len(self.figures) - 1))
                elif (other := x.find("Fallback")) is not None:
                    out.extend(self.runs(other, bold, italic, href))
            elif x.tag in _GRAPHICS:
                for box in (b for b in x.walk() if b.tag == "txbxContent"):
                    self.boxes += self.blocks(box)
                charts = [c for c in x.walk() if c.tag == "chart" and c.get("r:id")] if x.tag == "drawing" else []
                for c in charts:
                    self.figures.append(_figure(x, "chart", c.get("r:id")))
                    put("figure", ref=str(len(self.figures) - 1))
                if not charts:
                    for b in x.walk():
                        rid = b.get("r:embed") if b.tag == "blip" else b.get("r:id") if b.tag == "imagedata" else None
                        if rid:
                            put("image", ref=rid)
            elif x.tag in ("ins", "smartTag", "sdt", "sdtContent", "fldSimple", "customXml", "moveTo"):
                out.extend(self.runs(x, bold, italic, href))
        return out

    def paragraph(self, p: Node) -> dict:
        props = p.find("pPr")
        style = _val(props, "pStyle") if props is not None else None
        num = props.find("numPr") if props is not None else None
        level = _val(num, "ilvl") if num is not None else None
        return {"kind": "paragraph", "style": style, "num_id": _val(num, "numId") if num is not None else None, "level": int(level) if level and level.isdigit() else 0, "number": 0, "runs": self.runs(p), "cells": None}

    def cell(self, tc: Node) -> list[dict]:
        """All text of a cell as one line: its paragraphs, content controls and inner tables, with spaces between."""
        out: list[dict] = []
        for x in tc.children:
            if x.tag == "p":
                kept, self.boxes = self.boxes, []
                own = self.runs(x) + [r for b in self.boxes for r in [_space(), *b["runs"]]]
                self.boxes = kept
            else:
                own = self.cell(x) if x.tag in ("sdt", "sdtContent", "customXml", "ins", "tbl", "tr", "tc") else []
            if own:
                out += ([_space()] if out else []) + own
        return out

    def blocks(self, node: Node) -> list[dict]:
        out = []
        for x in node.children:
            if x.tag == "p":
                kept, self.boxes = self.boxes, []
                out.append(self.paragraph(x))
                out += self.boxes
                self.boxes = kept
            elif x.tag == "tbl":
                rows = []
                for tr in _inside(x, "tr"):
                    row = []
                    for tc in _inside(tr, "tc"):
                        props = tc.find("tcPr")
                        span = _val(props, "gridSpan") if props is not None else None
                        row.append({"span": int(span) if span and span.isdigit() else 1, "runs": self.cell(tc)})
                    rows.append(row)
                out.append({"kind": "table", "style": None, "num_id": None, "level": 0, "number": 0, "runs": [], "cells": rows})
            elif x.tag in ("sdt", "sdtContent", "customXml", "ins"):
                out.extend(self.blocks(x))
        return out


def _docx(z: zipfile.ZipFile, names: set[str], out: dict) -> None:
    if "word/document.xml" not in names:
        raise Unsupported("no word/document.xml")
    try:
        body = parse(read(z, "word/document.xml")).find("body")
    except BadXml as e:
        raise Unsupported(f"word/document.xml: {e}") from None
    if body is None:
        raise Unsupported("no body in word/document.xml")
    reader = _Body()
    out["blocks"] = reader.blocks(body)
    try:
        if "word/styles.xml" in names:
            out["styles"] = [{"id": s.get("styleId"), "name": _val(s, "name")} for s in parse(read(z, "word/styles.xml")).children if s.tag == "style" and s.get("styleId")]
        if "word/numbering.xml" in names:
            root = parse(read(z, "word/numbering.xml"))
            plans = {a.get("abstractNumId"): {lv.get("ilvl"): _val(lv, "numFmt") for lv in a.children if lv.tag == "lvl"} for a in root.children if a.tag == "abstractNum"}
            out["numbering"] = [{"num_id": n.get("numId"), "level": int(k), "fmt": f} for n in root.children if n.tag == "num" for k, f in plans.get(_val(n, "abstractNumId"), {}).items() if k and k.isdigit()]
    except BadXml:
        pass  # the text stays; only its styling is lost
    _count(out["blocks"], {(x["num_id"], x["level"]): x["fmt"] for x in out["numbering"]})
    out["blocks"] += _notes(z, names, reader)
    out["figures"] = reader.figures


def _notes(z: zipfile.ZipFile, names: set[str], reader: _Body) -> list[dict]:
    """The bodies of all notes that the text refers to, as a numbered list with links back."""
    bodies = {}
    for kind in ("footnote", "endnote"):
        if f"word/{kind}s.xml" in names:
            try:
                bodies |= {(kind, n.get("id")): n for n in parse(read(z, f"word/{kind}s.xml")).children if n.tag == kind}
            except BadXml:
                continue
    out, at = [], 0
    while at < len(reader.notes):  # a note may refer to others
        kind, ident = reader.notes[at]
        at += 1
        runs = reader.cell(bodies[kind, ident]) if (kind, ident) in bodies else []
        back = {"kind": "text", "text": "↑", "bold": False, "italic": False, "href": f"#{kind}-ref-{ident}", "ref": None}
        out.append({"kind": "paragraph", "style": None, "num_id": "notes", "level": 0, "number": at, "runs": [*runs, _space(), back] if runs else [back], "cells": None})
    return out


def figure_package(content: bytes, id12: str) -> bytes | None:
    """A document that holds only the block with this figure and the page's geometry, all other parts as they are; null if there is no such figure."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        check(z)
        data = read(z, "word/document.xml")
        body = parse(data).find("body")
        spans, ends = spans_of(data, 2)
        blocks = body.children if body is not None else []
        holds = lambda b: any((_is_group(x) or x.tag == "drawing") and x.id12() == id12 for x in [b, *b.walk()])
        found = next((k for k, b in enumerate(blocks) if holds(b)), None)
        if found is None:
            return None
        keep = sorted({found, *([len(blocks) - 1] if blocks[-1].tag == "sectPr" else [])})
        small = data[: spans[0][0]] + b"".join(data[slice(*spans[k])] for k in keep) + data[ends:]
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as made:
            for name in z.namelist():
                made.writestr(zipfile.ZipInfo(name, (2020, 1, 1, 0, 0, 0)), small if name == "word/document.xml" else read(z, name))
        return out.getvalue()


# == workbooks


def _column(ref: str) -> int:
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n


def _number(v: str) -> str | None:
    try:
        x = float(v)
    except ValueError:
        return v
    return v if x != x or abs(x) == float("inf") else str(int(x)) if x == int(x) else repr(x)


def _sheet(root: Node) -> list[dict]:
    rows, data, r = [], root.find("sheetData"), 0
    for row in data.children if data is not None else []:
        r = int(n) if (n := row.get("r") or "").isdigit() else r + 1
        cells, c = [], 0
        for x in row.children:
            c = _column(x.get("r") or "") or c + 1
            kind, v = x.get("t") or "n", x.find("v")
            text = "".join(v.texts()) if v is not None else None
            if kind == "inlineStr":
                inline = x.find("is")
                text = "".join(y for t in inline.walk() if t.tag == "t" for y in t.texts()) if inline is not None else None
            if text is not None and (text != "" or kind in ("str", "inlineStr")):
                style = x.get("s") or "0"
                cells.append({"c": c, "t": kind, "v": _number(text) if kind == "n" else text, "s": int(style) if style.isdigit() else 0})
        cells = [x for x in cells if x["c"] <= MAX_COLUMN]
        if cells and r <= MAX_ROW:
            rows.append({"r": r, "cells": sorted({x["c"]: x for x in cells}.values(), key=lambda x: x["c"])})
    return sorted({x["r"]: x for x in rows}.values(), key=lambda x: x["r"])


def _xlsx(z: zipfile.ZipFile, names: set[str], out: dict) -> None:
    if "xl/workbook.xml" not in names:
        raise Unsupported("no xl/workbook.xml")
    try:
        book = parse(read(z, "xl/workbook.xml"))
        out["sheets"] = [{"ord": k, "name": s.get("name"), "rid": s.get("r:id"), "state": s.get("state") or "visible"} for k, s in enumerate(x for x in book.walk() if x.tag == "sheet")]
        props = book.find("workbookPr")
        out["date1904"] = props is not None and props.get("date1904") in ("1", "true")
        if "xl/sharedStrings.xml" in names:
            out["shared"] = ["".join(y for t in si.walk() if t.tag == "t" for y in t.texts()) for si in parse(read(z, "xl/sharedStrings.xml")).children if si.tag == "si"]
        if "xl/styles.xml" in names:
            sheet = parse(read(z, "xl/styles.xml"))
            codes = {n.get("numFmtId"): n.get("formatCode") for n in sheet.walk() if n.tag == "numFmt"}
            xfs = sheet.find("cellXfs")
            out["formats"] = [codes.get(k) or f"#{k}" for k in ((x.get("numFmtId") or "0") for x in (xfs.children if xfs is not None else []))]
        for part in sorted(n for n in names if n.startswith("xl/worksheets/") and n.endswith(".xml")):
            root = parse(read(z, part))
            out["sheet_rows"].append({"part": part, "rows": _sheet(root)})
            drawing = root.find("drawing")
            if drawing is not None:
                out["drawings"].append({"part": part, "rid": drawing.get("r:id")})
    except BadXml as e:
        raise Unsupported(str(e)) from None
    for part in sorted(n for n in names if n.startswith("xl/drawings/") and n.endswith(".xml")):
        try:
            root = parse(read(z, part))
        except BadXml:
            continue
        k = 0
        for tag in ("oneCellAnchor", "twoCellAnchor", "absoluteAnchor"):
            for anchor in (a for a in root.children if a.tag == tag):
                at = anchor.find("from")
                col, row = (x.text if at is not None and (x := at.find(n)) is not None else None for n in ("col", "row"))
                for chart in (c for c in anchor.walk() if c.tag == "chart"):
                    out["anchors"].append({"part": part, "ord": k, "col": int(col) if col and col.isdigit() else None, "row": int(row) if row and row.isdigit() else None, "rid": chart.get("r:id")})
                    k += 1


# == one document


def shred_bytes(content: bytes | None, form: str | None) -> dict:
    """All facts of one package; ``status`` says what came of it, and nothing is raised."""
    out: dict = {k: [] for k in ("parts", "rels", "media", "charts", "blocks", "figures", "styles", "numbering", "sheets", "sheet_rows", "shared", "formats", "drawings", "anchors")}
    out |= {"status": "ok", "error": None, "date1904": False}
    try:
        if form not in ("docx", "xlsx"):
            raise Unsupported("expected .docx or .xlsx")
        with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
            check(z)
            names = set(z.namelist())
            out["parts"] = [{"part": i.filename, "size": i.file_size} for i in z.infolist()]
            (_docx if form == "docx" else _xlsx)(z, names, out)
            for part in sorted(names):
                if part.endswith(".rels"):
                    folder, base = posixpath.split(part)
                    source = posixpath.join(posixpath.dirname(folder), base[: -len(".rels")])
                    try:
                        root = parse(read(z, part))
                    except BadXml:
                        continue
                    body = read(z, source) if source in names else b""
                    known = {r.get("Id"): r for r in root.children if r.get("Id") and r.get("Target") is not None}
                    out["rels"] += [{"source_part": source, "rel_id": k, "rel_type": r.get("Type"), "target": r.get("Target"), "used": f'"{k}"'.encode() in body} for k, r in known.items()]
                elif "/media/" in part:
                    data = read(z, part)
                    out["media"].append({"part": part, "id12": hashlib.sha256(data).hexdigest()[:12], "n_bytes": len(data)})
                elif "/charts/" in part and part.endswith(".xml") and "/_rels/" not in part:
                    try:
                        root = parse(read(z, part))
                    except BadXml:
                        continue
                    title = root.within("title")
                    out["charts"].append({"part": part, "id12": root.id12(), "captions": title.texts() if title is not None else [], "raw": raw_chart(root)})
    except (Refused, zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError) as e:
        out |= {"status": "corrupt_archive", "error": str(e) or type(e).__name__}
    except Unsupported as e:
        out |= {"status": "unsupported_format", "error": str(e)}
    except Exception as e:  # noqa: BLE001 - a bad document becomes a row, never a failed task
        out |= {"status": "internal_error", "error": f"{type(e).__name__}: {e}"}
    return out


def pictures(files: DataFrame) -> DataFrame:
    """``source_id, part, id12, content`` of the media of word documents, for whoever looks at them; unreadable packages give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, form, content in zip(batch.column("source_id").to_pylist(), batch.column("format").to_pylist(), batch.column("content")):
                try:
                    with zipfile.ZipFile(io.BytesIO(content.as_py() or b"")) as z:
                        check(z)
                        for part in sorted(n for n in z.namelist() if form == "docx" and n.startswith("word/media/")):
                            data = read(z, part)
                            yield pa.record_batch([pa.array([source]), pa.array([part]), pa.array([hashlib.sha256(data).hexdigest()[:12]]), pa.array([data], pa.binary())], names=["source_id", "part", "id12", "content"])
                except (Refused, zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError):
                    continue

    return files.select("source_id", "format", "content").mapInArrow(run, "source_id string, part string, id12 string, content binary")


def format_of(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))
    return F.when(suffix.isin("docx", "xlsx"), suffix)


def shred(files: DataFrame) -> DataFrame:
    """Rows of ``source_id, format, content`` to rows of ``source_id, format`` and the facts (``SHREDDED``)."""
    kind = _parse_datatype_string(SHREDDED)
    types = [(f.name, to_arrow_type(f.dataType)) for f in kind.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # packages may be large: one at a time
                got = shred_bytes(batch.column("content")[k].as_py(), batch.column("format")[k].as_py())
                yield pa.record_batch([batch.column("source_id").slice(k, 1), batch.column("format").slice(k, 1), *(pa.array([got[n]], t) for n, t in types)], names=["source_id", "format", *(n for n, _ in types)])

    schema = StructType(_parse_datatype_string("source_id string, format string").fields + kind.fields)
    return files.select("source_id", "format", "content").mapInArrow(run, schema)
