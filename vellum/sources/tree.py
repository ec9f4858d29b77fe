"""XML parts as trees that remember their bytes: what isn't changed is written back as it was read."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.parsers import expat
from xml.sax.saxutils import escape, quoteattr

OPEN = re.compile(rb"<[^\s/>]+(?:\s+[^=\s]+\s*=\s*(?:\"[^\"]*\"|'[^']*'))*\s*(/?)>")
STEP = re.compile(r"(?:\{[^}]*\})?[^/{}]+")
XML = "http://www.w3.org/XML/1998/namespace"


class Node:
    """An element. Names are as in ElementTree, `{namespace}name`; prefixes and declarations stay as they are in the file."""

    __slots__ = ("attributes", "close", "end", "kids", "name", "parent", "raw", "spaces", "start", "tag", "text")

    def __init__(self, name: str, attributes: dict[str, str], spaces: dict[str, str], parent: Node | None = None):
        self.name, self.attributes, self.spaces, self.parent = name, attributes, spaces, parent
        self.tag, self.kids, self.text = self.clark(name, True), [], None
        self.raw, self.start, self.close, self.end = None, 0, 0, 0

    def clark(self, name: str, element: bool = False) -> str:
        prefix, _, local = name.rpartition(":")
        space = self.spaces.get(prefix) if prefix or element else None
        return f"{{{space}}}{local}" if space else local

    def qualified(self, tag: str, attribute: bool = False) -> str:
        """The name in the file for `{namespace}name`, by a prefix that is declared here."""
        if not tag.startswith("{"):
            return tag
        space, _, local = tag[1:].partition("}")
        for prefix, known in self.spaces.items():
            if known == space and (prefix or not attribute):
                return f"{prefix}:{local}" if prefix else local
        raise ValueError(f"no prefix for {space}")

    def __iter__(self) -> Iterator[Node]:
        return iter([k for k in self.kids if isinstance(k, Node)])

    def get(self, tag: str, default: str | None = None) -> str | None:
        for name, value in self.attributes.items():
            if self.clark(name) == tag:
                return value
        return default

    def set(self, tag: str, value: str) -> None:
        name = next((n for n in self.attributes if self.clark(n) == tag), None) or self.qualified(tag, True)
        self.attributes[name] = value
        self.touch()

    def touch(self) -> None:
        """This element and those around it are written anew."""
        node: Node | None = self
        while node is not None and node.raw is not None:
            node.raw, node = None, node.parent

    def findall(self, path: str) -> list[Node]:
        found = [self]
        for step in STEP.findall(path):
            found = [k for n in found for k in n if k.tag == step]
        return found

    def find(self, path: str) -> Node | None:
        return next(iter(self.findall(path)), None)

    def iter(self, tag: str | None = None) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            if tag is None or node.tag == tag:
                yield node
            stack.extend(reversed(list(node)))

    def place(self) -> int:
        """Where this element stands among all that its parent holds."""
        return next(i for i, k in enumerate(self.parent.kids) if k is self)

    def insert(self, at: int, node: Node) -> Node:
        node.parent = self
        self.kids.insert(at, node)
        self.touch()
        return node

    def append(self, node: Node) -> Node:
        return self.insert(len(self.kids), node)

    def detach(self) -> Node:
        at, parent = self.place(), self.parent
        del parent.kids[at]
        parent.touch()
        self.parent = None
        return self

    def made(self, tag: str, text: str | None = None, **attributes: str | None) -> Node:
        """A new element that isn't anywhere yet; attributes have the namespace of the tag."""
        out = Node(self.qualified(tag), {}, self.spaces)
        space = tag[: tag.find("}") + 1]
        for name, value in attributes.items():
            if value is not None:
                out.attributes[self.qualified(space + name, True)] = value
        if text is not None:
            out.text = text
            out.kids.append(escape(text).encode())
        return out

    def copied(self) -> Node:
        out = Node(self.name, dict(self.attributes), self.spaces)
        out.text = self.text
        for k in self.kids:
            if isinstance(k, Node):
                k = k.copied()
                k.parent = out
            out.kids.append(k)
        return out


def parse(data: bytes) -> tuple[bytes, Node, bytes]:
    """What stands before the root element, the root, and what stands behind it."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        data = re.sub(r'encoding="[^"]*"', 'encoding="UTF-8"', data.decode("utf-16"), count=1).encode()
    parser = expat.ParserCreate()
    parser.buffer_text = True
    root: list[Node] = []
    stack: list[tuple[Node, int]] = []  # with the place up to which its bytes are among its kids

    def start(name: str, attributes: dict[str, str]) -> None:
        parent = stack[-1][0] if stack else None
        spaces = parent.spaces if parent is not None else {"xml": XML}
        if any(a == "xmlns" or a.startswith("xmlns:") for a in attributes):
            spaces = spaces | {a[6:]: v for a, v in attributes.items() if a == "xmlns" or a.startswith("xmlns:")}
        node = Node(name, attributes, spaces, parent)
        node.raw, node.start = data, parser.CurrentByteIndex
        opening = OPEN.match(data, node.start)
        node.close = opening.end()
        if parent is None:
            root.append(node)
        else:
            take(node.start)
            parent.kids.append(node)
        stack.append((node, node.close))
        node.end = node.close if opening[1] else 0

    def take(upto: int) -> None:
        node, at = stack[-1]
        if upto > at:
            node.kids.append(data[at:upto])

    def end(_: str) -> None:
        node, _at = stack[-1]
        if not node.end:
            take(parser.CurrentByteIndex)
            node.end = data.index(b">", parser.CurrentByteIndex) + 1
        stack.pop()
        if stack:
            stack[-1] = (stack[-1][0], node.end)

    def text(piece: str) -> None:
        node = stack[-1][0]
        if not any(isinstance(k, Node) for k in node.kids):
            node.text = (node.text or "") + piece

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, text
    parser.Parse(data, True)
    return data[: root[0].start], root[0], data[root[0].end :]


def written(root: Node) -> bytes:
    """The element's bytes: those that were read wherever nothing below has changed."""
    out: list[bytes] = []
    stack: list[Node | bytes] = [root]
    while stack:
        item = stack.pop()
        if isinstance(item, bytes):
            out.append(item)
        elif item.raw is not None:
            out.append(item.raw[item.start : item.end])
        else:
            attributes = "".join(f" {n}={quoteattr(v)}" for n, v in item.attributes.items())
            out.append(f"<{item.name}{attributes}{'>' if item.kids else '/>'}".encode())
            if item.kids:
                stack.append(f"</{item.name}>".encode())
                stack.extend(reversed(item.kids))
    return b"".join(out)
