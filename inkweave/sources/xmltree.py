"""Untrusted XML as small trees: no document types, bounded depth and size."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from xml.parsers import expat

MAX_DEPTH = 256
MAX_NODES = 20_000_000


_TAG = re.compile(rb"""<(?:[^>"']|"[^"]*"|'[^']*')*>""")


class BadXml(ValueError):
    pass


class Node:
    __slots__ = ("attrs", "content", "ns", "tag")

    def __init__(self, ns: str, tag: str, attrs: dict[str, str]):
        self.ns, self.tag, self.attrs = ns, tag, attrs
        self.content: list[Node | str] = []

    @property
    def children(self) -> list[Node]:
        return [x for x in self.content if isinstance(x, Node)]

    def walk(self) -> Iterator[Node]:
        """All descendants in document order, without recursion."""
        stack = self.children[::-1]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(node.children[::-1])

    def find(self, tag: str) -> Node | None:
        return next((x for x in self.content if isinstance(x, Node) and x.tag == tag), None)

    def within(self, tag: str) -> Node | None:
        return next((x for x in self.walk() if x.tag == tag), None)

    def get(self, name: str) -> str | None:
        return self.attrs.get(name)

    @property
    def text(self) -> str | None:
        """Text before the first child."""
        return self.content[0] if self.content and isinstance(self.content[0], str) else None

    def texts(self) -> list[str]:
        out, stack = [], [*self.content[::-1]]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                stack.extend(x.content[::-1])
        return out

    def id12(self) -> str:
        """Content hash of the canonical form: names with namespaces, sorted attributes, texts."""
        h = hashlib.sha256()
        stack: list = [self]
        while stack:
            x = stack.pop()
            if x is None:
                h.update(b")")
            elif isinstance(x, str):
                h.update(f"\x01{len(x)}:{x}".encode())
            else:
                h.update(repr((x.ns, x.tag, sorted(x.attrs.items()))).encode() + b"(")
                stack.append(None)
                stack.extend(x.content[::-1])
        return h.hexdigest()[:12]


def parse(data: bytes) -> Node:
    """The root; attributes go by local name, those of relationships by ``r:`` and the name."""
    top = Node("", "", {})
    stack, count = [top], [0]

    def name(full: str) -> tuple[str, str]:
        ns, _, local = full.rpartition(" ")
        return ns, local

    def start(full: str, attrs: dict[str, str]) -> None:
        count[0] += 1
        if len(stack) > MAX_DEPTH or count[0] > MAX_NODES:
            raise BadXml("nested too deep" if len(stack) > MAX_DEPTH else "too many nodes")
        own = {}
        for k, v in attrs.items():
            ns, local = name(k)
            own[f"r:{local}" if ns.endswith("/relationships") else local] = v
        node = Node(*name(full), own)
        stack[-1].content.append(node)
        stack.append(node)

    def text(data: str) -> None:
        content = stack[-1].content
        if content and isinstance(content[-1], str):
            content[-1] += data
        else:
            content.append(data)

    def refuse(*_: object) -> None:
        raise BadXml("document types are not accepted")

    p = expat.ParserCreate(namespace_separator=" ")
    p.buffer_text = True
    p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler, p.StartDoctypeDeclHandler = start, lambda _: stack.pop(), text, refuse
    try:
        p.Parse(data, True)
    except expat.ExpatError as e:
        raise BadXml(str(e)) from None
    return top.children[0]


def spans_of(data: bytes, depth: int) -> tuple[list[tuple[int, int]], int]:
    """Byte ranges of the elements at a depth (the root is at 0), and where the tag that closes their parent begins."""
    spans: list[tuple[int, int]] = []
    at, level, closing = [0], [0], [0]
    p = expat.ParserCreate()

    def start(*_: object) -> None:
        if level[0] == depth:
            at[0] = p.CurrentByteIndex
        level[0] += 1

    def end(name: str) -> None:
        level[0] -= 1
        here = p.CurrentByteIndex
        if level[0] == depth:
            tag = _TAG.match(data, at[0])
            spans.append((at[0], tag.end() if tag[0].endswith(b"/>") else data.index(b">", here) + 1))
        elif level[0] == depth - 1:
            closing[0] = here

    p.StartElementHandler, p.EndElementHandler = start, end
    p.Parse(data, True)
    return spans, closing[0]
