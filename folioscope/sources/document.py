"""A parsed document: nested sections with positioned blocks, anchors and frontmatter."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from folioscope.functions.names import utf16

from .markdown import Node, flatten, parse_blocks, split_frontmatter
from .yaml12 import load_positioned

TRAILING = re.compile(r"(?:^|\s)\^([A-Za-z0-9_-]+)\s*$")
STANDALONE = re.compile(r"\^([A-Za-z0-9_-]+)$")
#: Links between documents: ``[[target#fragment|alias]]``, transcluded with ``!``; brackets may be escaped.
REFERENCE = re.compile(r"(!?)\\?\[\\?\[([^\[\]\n]+?)\\?\]\\?\]")


@dataclass
class Item:
    text: str
    checked: bool | None
    line: int
    column: int


@dataclass
class Block:
    kind: str  # paragraph, list, code, table
    line: int
    column: int
    anchor: str | None = None
    text: str = ""
    lang: str | None = None
    ordered: bool = False
    items: list[Item] = field(default_factory=list)
    columns: list[str] = field(default_factory=list)
    rows: list[list[str]] = field(default_factory=list)
    row_lines: list[int] = field(default_factory=list)
    cell_columns: list[list[int]] = field(default_factory=list)
    spans: list[tuple[int, int, int, int, str]] = field(default_factory=list)

    def placed(self) -> list[tuple[int, str]]:
        """Its text by source line, for text rules."""
        if self.kind == "list":
            return [(i.line, i.text) for i in self.items]
        if self.kind == "table":
            return [(self.line, " ".join(self.columns)), *((n, " ".join(r)) for n, r in zip(self.row_lines, self.rows, strict=True))]
        return [(self.line, self.text)]


@dataclass
class Section:
    name: str
    depth: int
    line: int
    column: int = 1
    sections: list[Section] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)
    own_anchors: list[str] = field(default_factory=list)

    @property
    def anchors(self) -> list[str]:
        return [*self.own_anchors, *(b.anchor for b in self.blocks if b.anchor)]

    def walk(self):
        yield self
        for s in self.sections:
            yield from s.walk()

    def scope_text(self) -> str:
        """Texts of the blocks beneath, each at its source line."""
        lines: dict[int, str] = {}
        for s in self.walk():
            for b in s.blocks:
                for line, text in b.placed():
                    if text:
                        for k, part in enumerate(text.split("\n"), line):
                            lines[k] = f"{lines[k]} {part}" if lines.get(k) else part
        return "\n".join(lines.get(k, "") for k in range(1, max(lines, default=0) + 1))


@dataclass
class Document:
    root: Section
    title: str | None
    frontmatter: Any
    has_frontmatter: bool
    key_lines: dict[tuple, int]
    code_lines: list[tuple[int, int]]
    body: str

    def line_of(self, path: tuple) -> int | None:
        if not path:
            return min(self.key_lines.values(), default=None)
        return self.key_lines.get(path)


def parse(source: str) -> Document:
    front, body, first = split_frontmatter(source)
    data, key_lines = (None, {})
    if front is not None:
        data, key_lines = load_positioned(front)
        key_lines = {p: n + 1 for p, n in key_lines.items()}
    nodes, labels = parse_blocks(body, first)
    root = Section("", 1, 0, 0)
    stack, title = [root], None
    for node in nodes:
        if node.kind == "heading":
            text = flatten(node.text, labels).strip()
            if node.depth == 1 and title is None:
                title = text
                continue
            while len(stack) > 1 and stack[-1].depth >= node.depth:
                stack.pop()
            section = Section(text, node.depth, node.line, node.column)
            stack[-1].sections.append(section)
            stack.append(section)
        else:
            _attach(stack[-1], node, labels)
    code: list[tuple[int, int]] = []
    _code_lines(nodes, code)
    return Document(root, title, data, front is not None, key_lines, code, body)


def _code_lines(nodes: list[Node], out: list[tuple[int, int]]) -> None:
    for n in nodes:
        if n.kind == "code":
            out.append((n.line, n.last))
        _code_lines(n.children, out)


def _attach(section: Section, node: Node, labels: set[str]) -> None:
    if node.kind == "paragraph":
        spans: list[tuple[int, int]] = []
        text = flatten(node.text, labels, spans)
        if m := STANDALONE.match(text.strip()):
            last = section.blocks[-1] if section.blocks else None
            if last is not None and last.anchor is None:
                last.anchor = m[1]
            else:
                section.own_anchors.append(m[1])
            return
        text, anchor = _trailing(text)
        section.blocks.append(Block("paragraph", node.line, node.column, anchor, text, spans=_span_places(node, spans)))
    elif node.kind == "code":
        section.blocks.append(Block("code", node.line, node.column, text=node.text, lang=node.lang))
    elif node.kind == "list":
        block = Block("list", node.line, node.column, ordered=node.ordered)
        for item in node.children:
            text = " ".join(flatten(c.text, labels) for c in item.children if c.kind == "paragraph").strip()
            if block.anchor is None:
                text, block.anchor = _trailing(text)
            block.items.append(Item(text, item.checked, item.line, item.column))
        section.blocks.append(block)
    elif node.kind == "table":
        block = Block("table", node.line, node.column, columns=[flatten(c, labels) for c, _ in node.rows[0]])
        rows = [([flatten(c, labels) for c, _ in row], line, [o for _, o in row]) for row, line in zip(node.rows[1:], node.row_lines[1:], strict=True)]
        if rows and len(rows[-1][0]) == 1 and (m := STANDALONE.match(rows[-1][0][0].strip())):
            block.anchor = m[1]
            rows.pop()
        for cells, line, columns in rows:
            block.rows.append(cells)
            block.row_lines.append(line)
            block.cell_columns.append(columns)
        for row, line in zip(node.rows, node.row_lines, strict=True):
            for cell, column in row:
                spans = []
                flatten(cell, labels, spans)
                block.spans += [(line, column + utf16(cell[:a]), line, column + utf16(cell[:b]), cell[a:b]) for a, b in spans]
        section.blocks.append(block)


def _trailing(text: str) -> tuple[str, str | None]:
    lines = text.rstrip().split("\n")
    m = TRAILING.search(lines[-1])
    if not m:
        return text, None
    lines[-1] = lines[-1][: m.start()]
    return "\n".join(lines).rstrip(), m[1]


def _span_places(node: Node, spans: list[tuple[int, int]]) -> list[tuple[int, int, int, int, str]]:
    def place(offset: int) -> tuple[int, int]:
        k = node.text.count("\n", 0, offset)
        begin = node.text.rfind("\n", 0, offset) + 1
        return node.lines[k].number, node.lines[k].column + utf16(node.text[begin:offset])

    return [(*place(a), *place(b), node.text[a:b]) for a, b in spans]


def references(text: str) -> list[dict]:
    """Links to other documents in a text: kind, target, fragment, alias and the link as written."""
    out = []
    for m in REFERENCE.finditer(text):
        target, alias = (x.strip() for x in (m[2].replace("\\|", "|").split("|", 1) + [""])[:2])
        target, _, fragment = target.partition("#")
        out.append({"kind": "transclusion" if m[1] else "link", "target": target.strip(), "fragment": fragment.strip() or None, "alias": alias or None, "raw": m[0]})
    return out


def raw_rows(source: str, first: int, count: int, width: int | None = None) -> list[list[str]]:
    """Cells of ``count`` table lines from line ``first`` as written, split at every bar, padded to ``width``."""
    out = []
    for line in re.split(r"\r\n|\n|\r", source)[first - 1 : first - 1 + count]:
        cells = [c.strip() for c in line.strip().split("|")]
        cells = cells[1:] if cells and not cells[0] else cells
        cells = cells[:-1] if cells and not cells[-1] else cells
        if cells:
            out.append(cells + [""] * ((width or 0) - len(cells)))
    return out
