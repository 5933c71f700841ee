"""Small office packages made in memory, for the round-trip query and the tests."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape, quoteattr

_OPEN = "http://schemas.openxmlformats.org"
_NS = {
    "s": f"{_OPEN}/spreadsheetml/2006/main", "xdr": f"{_OPEN}/drawingml/2006/spreadsheetDrawing", "a": f"{_OPEN}/drawingml/2006/main", "c": f"{_OPEN}/drawingml/2006/chart",
    "w": f"{_OPEN}/wordprocessingml/2006/main", "r": f"{_OPEN}/officeDocument/2006/relationships", "mc": f"{_OPEN}/markup-compatibility/2006",
    "wpg": "http://schemas.microsoft.com/office/word/2010/wordprocessingGroup",
}
_SPACES = " ".join(f'xmlns:{k}="{v}"' for k, v in _NS.items())


def nest(path: str, inner: str = "", **attrs: str) -> str:
    """``inner`` within the elements of ``path``, the outermost first; attributes go to the innermost."""
    tags = path.split()
    own = "".join(f" {k.replace('__', ':')}={quoteattr(v)}" for k, v in attrs.items())
    return "".join(f"<{t}>" for t in tags[:-1]) + f"<{tags[-1]}{own}>{inner}" + "".join(f"</{t}>" for t in reversed(tags))


def archive(parts: dict[str, bytes | str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(zipfile.ZipInfo(name, (2020, 1, 1, 0, 0, 0)), data)
    return out.getvalue()


def rels(links: dict[str, tuple[str, str]]) -> str:
    """A relationship part from id -> (kind, target)."""
    rows = "".join(f'<Relationship Id="{k}" Type="{_NS["r"]}/{kind}" Target={quoteattr(t)}/>' for k, (kind, t) in links.items())
    return nest("Relationships", rows, xmlns=f"{_OPEN}/package/2006/relationships")


def points(values: list, n: int | None = None) -> str:
    """Point elements; None leaves a gap."""
    count = f'<c:ptCount val="{len(values) if n is None else n}"/>'
    return count + "".join(f'<c:pt idx="{k}"><c:v>{escape(str(v))}</c:v></c:pt>' for k, v in enumerate(values) if v is not None)


def combined(*charts: str) -> str:
    """One chart with the plots of several; title and axes are the first one's."""
    first, *others = charts
    plots = "".join(x[x.index("<c:plotArea>") + 12 : x.index("</c:plotArea>")] for x in others)
    return first.replace("</c:plotArea>", plots + "</c:plotArea>", 1)


def chart(tag: str, title: str | None, categories: list, series: list[tuple[str, list]], code: str | None = None, axis: str | None = None, inner: str = "", cached: bool = True) -> str:
    rich = lambda t: nest("c:title c:tx c:rich a:p a:r a:t", escape(t))
    sers = ""
    for name, values in series:
        cats = nest("c:cat c:strRef", nest("c:f", "S!$A$1") + nest("c:strCache", points(categories))) if categories else ""
        cache = nest("c:numCache", (nest("c:formatCode", escape(code)) if code else "") + points(values)) if cached else ""
        sers += nest("c:ser", nest("c:tx c:strRef c:strCache", points([name])) + cats + nest("c:val c:numRef", nest("c:f", "S!$B$1") + cache))
    plot = nest("c:plotArea", nest(f"c:{tag}", inner + sers) + (nest("c:valAx", rich(axis)) if axis else ""))
    return f"<c:chartSpace {_SPACES}>" + nest("c:chart", (rich(title) if title else "") + plot) + "</c:chartSpace>"


def paragraph(text: str, style: str | None = None, num: str | None = None, props: str = "", level: int = 0, more: str = "") -> str:
    """``more``: runs after the text."""
    head = (nest("w:pStyle", w__val=style) if style else "") + (nest("w:numPr", nest("w:ilvl", w__val=str(level)) + nest("w:numId", w__val=num)) if num else "")
    run = (nest("w:rPr", props) if props else "") + nest("w:t", escape(text))
    return nest("w:p", (nest("w:pPr", head) if head else "") + nest("w:r", run) + more)


def numbering(**formats: str) -> str:
    """A numbering part: for each number its format at the first two levels."""
    levels = lambda f: "".join(nest("w:lvl", nest("w:numFmt", w__val=f), w__ilvl=str(k)) for k in range(2))
    plans = "".join(nest("w:abstractNum", levels(f), w__abstractNumId=k) for k, f in formats.items())
    return f"<w:numbering {_SPACES}>{plans}" + "".join(nest("w:num", nest("w:abstractNumId", w__val=k), w__numId=k.lstrip("n")) for k in formats) + "</w:numbering>"


def notes(kind: str, **texts: str) -> str:
    """A part of foot- or endnotes, by ``n`` and their id."""
    return f"<w:{kind}s {_SPACES}>" + "".join(nest(f"w:{kind}", paragraph(t), w__id=k.lstrip("n")) for k, t in texts.items()) + f"</w:{kind}s>"


def note(kind: str, ident: str) -> str:
    return nest(f"w:r w:{kind}Reference", w__id=ident)


def text_box(inner: str) -> str:
    return nest("w:r w:pict w:txbxContent", inner)


def picture(rid: str) -> str:
    return nest("w:p w:r w:drawing a:blip", r__embed=rid)


def group(texts: list[str], rids: list[str] = ()) -> str:
    inner = "".join(nest("a:t", escape(t)) for t in texts) + "".join(nest("a:blip", r__embed=r) for r in rids)
    return nest("w:p w:r mc:AlternateContent", nest("mc:Choice w:drawing wpg:wgp", inner) + nest("mc:Fallback w:t", "old"))


def chart_anchor(rid: str) -> str:
    return nest("w:p w:r w:drawing c:chart", r__id=rid)


def grid(rows: list[list[str]]) -> str:
    return "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{paragraph(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"


def docx(body: str, media: dict[str, bytes] | None = None, charts: dict[str, str] | None = None, links: dict[str, tuple[str, str]] | None = None, more: dict | None = None) -> bytes:
    """A document; ``media`` and ``charts`` by file name, ``links`` its relationships."""
    parts = {"[Content_Types].xml": "<Types/>", "word/document.xml": f"<w:document {_SPACES}><w:body>{body}<w:sectPr/></w:body></w:document>"}
    if links is not None:
        parts["word/_rels/document.xml.rels"] = rels(links)
    parts |= {f"word/media/{k}": v for k, v in (media or {}).items()} | {f"word/charts/{k}": v for k, v in (charts or {}).items()}
    return archive(parts | (more or {}))


def sheet(rows: list[list], drawing: str | None = None) -> str:
    """A sheet part; numbers, texts, booleans and (value, style) pairs; None is no cell."""
    out = ""
    for r, row in enumerate(rows, 1):
        cells = ""
        for c, v in enumerate(row):
            style = ""
            if isinstance(v, tuple):
                v, style = v[0], f' s="{v[1]}"'
            ref = f"{chr(65 + c)}{r}"
            if isinstance(v, bool):
                cells += f'<s:c r="{ref}" t="b"><s:v>{int(v)}</s:v></s:c>'
            elif isinstance(v, (int, float)):
                cells += f'<s:c r="{ref}"{style}><s:v>{v!r}</s:v></s:c>'
            elif v is not None:
                cells += f'<s:c r="{ref}" t="inlineStr"><s:is><s:t>{escape(v)}</s:t></s:is></s:c>'
        out += f'<s:row r="{r}">{cells}</s:row>'
    return f'<s:worksheet {_SPACES}><s:sheetData>{out}</s:sheetData>{f"<s:drawing r:id={quoteattr(drawing)}/>" if drawing else ""}</s:worksheet>'


def anchors(places: list[tuple[int, int, list[str]]]) -> str:
    """A drawing part; each anchor (column, row) holds charts by relationship."""
    out = ""
    for col, row, rids in places:
        charts = "".join(f'<xdr:graphicFrame><c:chart r:id="{r}"/></xdr:graphicFrame>' for r in rids)
        out += f"<xdr:twoCellAnchor><xdr:from><xdr:col>{col}</xdr:col><xdr:row>{row}</xdr:row></xdr:from><xdr:grpSp>{charts}</xdr:grpSp></xdr:twoCellAnchor>"
    return f"<xdr:wsDr {_SPACES}>{out}</xdr:wsDr>"


def xlsx(sheets: list[dict], more: dict | None = None) -> bytes:
    """A workbook.  Each sheet: ``name``, ``rows``, optional ``state``, ``anchors`` [(col, row, [chart xml, ...])]."""
    parts: dict = {"[Content_Types].xml": "<Types/>"}
    book, links, n = "", {}, 0
    for k, s in enumerate(sheets, 1):
        state = f' state="{s["state"]}"' if s.get("state") else ""
        book += f'<s:sheet name={quoteattr(s["name"])} sheetId="{k}" r:id="rId{k}"{state}/>'
        links[f"rId{k}"] = ("worksheet", f"worksheets/sheet{k}.xml")
        placed = s.get("anchors")
        parts[f"xl/worksheets/sheet{k}.xml"] = sheet(s.get("rows", []), "rId1" if placed else None)
        if placed:
            parts[f"xl/worksheets/_rels/sheet{k}.xml.rels"] = rels({"rId1": ("drawing", f"../drawings/drawing{k}.xml")})
            inner, rows = {}, []
            for col, row, charts in placed:
                rids = []
                for xml in charts:
                    n += 1
                    parts[f"xl/charts/chart{n}.xml"] = xml
                    inner[f"rId{n}"] = ("chart", f"/xl/charts/chart{n}.xml")
                    rids.append(f"rId{n}")
                rows.append((col, row, rids))
            parts[f"xl/drawings/drawing{k}.xml"] = anchors(rows)
            parts[f"xl/drawings/_rels/drawing{k}.xml.rels"] = rels(inner)
    parts["xl/workbook.xml"] = f"<s:workbook {_SPACES}><s:sheets>{book}</s:sheets></s:workbook>"
    parts["xl/_rels/workbook.xml.rels"] = rels(links)
    return archive(parts | (more or {}))
