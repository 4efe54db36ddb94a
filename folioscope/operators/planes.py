"""The planes of a contract, evaluated over one parsed document: structure, frontmatter, content, text and rules.

A document's findings depend on it alone, so a task evaluates whole documents as they are parsed: no shuffle, and the
findings are the only rows that leave.  Order: line, column, plane, then order of emission.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

from folioscope.functions.names import camel_key, needle_regex, utf16, words
from folioscope.functions.schema import check, passes, path_text
from folioscope.plans.grammar import Code, Contract, Gap, Leaf, Level, List, MaxWords, Slot, Table, TextSpec
from folioscope.sources.document import Block, Document, Section, parse

#: Default levels: all findings are errors but these.
WARNINGS = {"structure/heading-depth-jump": "warn"}
PLANES = ("frontmatter", "structure", "content", "text")


@dataclass
class Finding:
    id: str
    message: str
    line: int | None = None
    col: int | None = None
    hint: str | None = None
    level: str = "error"
    emitted: int = 0

    @property
    def plane(self) -> int:
        area = self.id.split("/", 1)[0]
        return PLANES.index(area) if area in PLANES else len(PLANES)


class Findings(list):
    def add(self, id: str, message: str, at: Section | Block | tuple | None = None, hint: str | None = None, level: str | None = None) -> None:  # noqa: A002
        line, col = (at.line, at.column) if isinstance(at, (Section, Block)) else at or (None, None)
        self.append(Finding(id, message, line or None, col, hint, level or WARNINGS.get(id, "error"), len(self)))


def evaluate(doc: Document, contract: Contract) -> list[Finding]:
    out = Findings()
    for s in doc.root.walk():
        if s is not doc.root:
            for c in s.sections:
                if c.depth > s.depth + 1:
                    out.add("structure/heading-depth-jump", f"heading level {c.depth} follows level {s.depth}", c, contract.description)
    if contract.body is not None:
        _level(doc.root, contract.body, contract.description, out)
    if contract.frontmatter is not None:
        _frontmatter(doc, contract, out)
    if contract.body is not None:
        _content_level(doc.root, contract.body, contract.description, out)
    _text(contract.text, doc.root, "doc", None, contract.description, out)
    for r in contract.rules:
        _custom(r, doc, out)
    return sorted(out, key=lambda f: (f.line or 0, f.col or 0, f.plane, f.emitted))


def validate_text(source: str, contract: Contract) -> list[Finding]:
    return evaluate(parse(source), contract)


def _custom(r, node, out: Findings) -> None:
    for found in r.check(node) or ():
        message, level, line = (found, None, None) if isinstance(found, str) else (*found, None, None)[:3]
        out.add(r.id, message, (line, None), None, level)


# ---- structure -----------------------------------------------------------------------------------------------


def _level(parent: Section, level: Level, inherited: str | None, out: Findings) -> None:
    nodes, specs = parent.sections, level.specs
    hint = level.description or inherited
    slots = {k: x for k, x in enumerate(specs) if isinstance(x, Slot)}
    of = [level.slot_of(n.name) for n in nodes]
    free = {name for s in slots.values() if s.repeatable for name in s.names}

    # of each name and of each key the first heading stands; what differs from it is reported
    first = {n.name: at for at, n in reversed([*enumerate(nodes)])}
    owner = {camel_key(n.name): n.name for n in reversed(nodes)}
    for at, n in enumerate(nodes):
        key = camel_key(n.name)
        if n.name in free:
            continue
        if first[n.name] != at:
            out.add("structure/duplicate-section", f"the section {n.name!r} stands twice", n, hint)
        elif key and owner[key] != n.name:
            out.add("structure/key-collision", f"{n.name!r} and {owner[key]!r} share the key {key!r}", n, hint)

    bound: dict[int, str] = {}
    for n, k in zip(nodes, of, strict=True):
        if k is not None and len(slots[k].names) > 1 and not slots[k].repeatable and bound.setdefault(k, n.name) != n.name:
            out.add("structure/duplicate-section", f"{n.name!r} is another spelling of {bound[k]!r}", n, hint)

    for k, s in slots.items():
        if not s.optional and k not in of:
            out.add("structure/section-missing", f"the section {' or '.join(map(repr, s.names))} is missing", nodes[0] if nodes else None, s.description or hint)

    for s in slots.values():
        have = [n for n in nodes if n.name in s.names]
        if s.repeatable and s.max is not None and len(have) > s.max:
            out.add("structure/repeat-count", f"{s.names[0]!r} stands {len(have)} times, at most {s.max} may", have[s.max], s.description or hint)
        elif s.repeatable and s.min is not None and 0 < len(have) < s.min:
            out.add("structure/repeat-count", f"{s.names[0]!r} stands {len(have)} times, at least {s.min} must", have[0], s.description or hint)

    if level.order == "strict":
        walk = Strict(level).run([n.name for n in nodes])
        for k in walk.flagged:
            out.add("structure/section-order", f"{nodes[k].name!r} stands out of order", nodes[k], hint)
        for k, count in walk.gaps.items():
            g = specs[k]
            if (g.min or 0) > count or g.max is not None and count > g.max:
                after = next((s for s in specs[k + 1 :] if isinstance(s, Slot)), None)
                at = next((n for n in nodes if after is not None and n.name in after.names), None)
                out.add("structure/gap-count", f"{count} sections stand in a gap", at, hint)
    else:
        if level.order == "recognized-relative":
            furthest = -1
            for n, k in zip(nodes, of, strict=True):
                if k is not None and k < furthest:
                    out.add("structure/section-order", f"{n.name!r} stands out of order", n, hint)
                elif k is not None:
                    furthest = k
        if not level.allow_unknown:
            unknown = [n for n, k in zip(nodes, of, strict=True) if k is None]
            g = next((s for s in specs if isinstance(s, Gap)), None)
            if g is None:
                for n in unknown:
                    out.add("structure/section-order", f"{n.name!r} is not a section of this level", n, hint)
            elif (g.min or 0) > len(unknown) or g.max is not None and len(unknown) > g.max:
                out.add("structure/gap-count", f"{len(unknown)} sections stand in a gap", None, hint)

    for n, k in zip(nodes, of, strict=True):
        if k is not None:
            _slot(n, slots[k], slots[k].description or hint, out)


def _slot(n: Section, s: Slot, hint: str | None, out: Findings) -> None:
    if s.anchor is not None and s.anchor not in n.anchors:
        out.add("structure/anchor-missing", f"the anchor ^{s.anchor} is missing", n, hint)
    for name, leaf in _leaves(s):
        block = _block(n, name)
        leaf_hint = leaf.description or hint
        if block is None:
            out.add("structure/block-missing", f"there is no {leaf.kind}" + (f" ^{name}" if name else ""), n, leaf_hint)
        elif block.kind != leaf.kind:
            out.add("structure/block-kind", f"a {leaf.kind} is expected, not a {block.kind}", block, leaf_hint)
    _text(s.text, n, camel_key(n.name), n, hint, out)
    for r in s.rules:
        _custom(r, n, out)
    if s.children is not None:
        _level(n, s.children, hint, out)


def _leaves(s: Slot) -> list[tuple[str | None, Leaf]]:
    if s.content is None:
        return []
    return list(s.content) if isinstance(s.content, tuple) else [(None, s.content)]


def _block(n: Section, anchor: str | None) -> Block | None:
    if anchor is not None:
        return next((b for b in n.blocks if b.anchor == anchor), None)
    return n.blocks[0] if n.blocks else None


@dataclass
class Walk:
    flagged: list[int]
    gaps: dict[int, int]


class Strict:
    """Strict order by tables of the level: from each place the next slot, the next gap, and the next spec that holds an unknown section.

    A name's own places in the level say where its section may go; what lies between is looked up, not walked over.
    """

    def __init__(self, level: Level):
        self.level, specs = level, level.specs
        n = self.end = len(specs)
        self.slot, self.gap, self.hold = [n] * (n + 1), [n] * (n + 1), [n] * (n + 1)
        self.free = [isinstance(x, Slot) and x.optional for x in specs]
        self.places: dict[str, list[int]] = {}
        for k, x in reversed([*enumerate(specs)]):
            space = isinstance(x, Gap)
            self.slot[k], self.gap[k] = (self.slot[k + 1], k) if space else (k, self.gap[k + 1])
            self.hold[k] = self.hold[k + 1] if self.free[k] else k
            for name in () if space else set(x.names):
                self.places.setdefault(name, []).insert(0, k)

    def run(self, names: list[str]) -> Walk:
        specs, end = self.level.specs, self.end
        gaps = {k: 0 for k, x in enumerate(specs) if isinstance(x, Gap)}
        flagged, at, filled = [], 0, False  # filled: the repeatable slot at ``at`` has a section already
        for x, name in enumerate(names):
            own = self.places.get(name, [])
            to = next((k for k in own if k >= at), None)
            if to is None:
                at = self.gap[at] if own else self.hold[at + 1 if filled else at]
                counted = at if at in gaps else end - 1 if at == end and not own and end - 1 in gaps else None
                if counted is not None:
                    gaps[counted] += 1
                elif not own and not self.level.allow_unknown:
                    flagged.append(x)
                filled = False
            elif self.slot[at] == to:
                at, filled = (to, True) if specs[to].repeatable else (to + 1, False)
            else:
                if not self.free[self.slot[at]] and not (filled and self.slot[at] == at):
                    flagged.append(x)
                at, filled = to + 1, False
        return Walk(flagged, gaps)


# ---- content -------------------------------------------------------------------------------------------------


def _content_level(parent: Section, level: Level, inherited: str | None, out: Findings) -> None:
    """Content binds the first section of each slot only."""
    hint = level.description or inherited
    done: set[int] = set()
    for n in parent.sections:
        k = level.slot_of(n.name)
        if k is None or k in done:
            continue
        done.add(k)
        s = level.specs[k]
        own = s.description or hint
        for name, leaf in _leaves(s):
            if (block := _block(n, name)) is not None and block.kind == leaf.kind:
                {"table": _table, "list": _list, "code": _code, "paragraph": _paragraph}[leaf.kind](block, leaf, leaf.description or own, out)
        if s.children is not None:
            _content_level(n, s.children, own, out)


def _table(b: Block, leaf: Table, hint: str | None, out: Findings) -> None:
    for c in leaf.columns:
        if c not in b.columns:
            out.add("content/table/column-missing", f"the column {c!r} is missing", b, hint)
    if leaf.extra_columns == "error":
        for c in b.columns:
            if c not in leaf.columns:
                out.add("content/table/column-extra", f"the column {c!r} is not expected", b, hint)
    if leaf.min_rows is not None and len(b.rows) < leaf.min_rows:
        out.add("content/table/min-rows", f"{len(b.rows)} rows, at least {leaf.min_rows} must stand", b, hint)
    for c, schema in leaf.cells:
        if c in b.columns:
            at = b.columns.index(c)
            for row, line in zip(b.rows, b.row_lines, strict=True):
                value = row[at] if at < len(row) else ""
                if not passes(schema, value):
                    out.add("content/table/cell", f"{c!r}: {value!r} is not allowed", (line, b.column), schema.description or hint)


def _list(b: Block, leaf: List, hint: str | None, out: Findings) -> None:
    for item in b.items:
        if leaf.items == "checkbox" and item.checked is None:
            out.add("content/list/item-kind", f"{item.text!r} is no checkbox", (item.line, item.column), hint)
        elif leaf.items not in (None, "checkbox") and not passes(leaf.items, item.text):
            out.add("content/list/item-kind", f"{item.text!r} is not allowed", (item.line, item.column), leaf.items.description or hint)
    if leaf.min_items is not None and len(b.items) < leaf.min_items:
        out.add("content/list/min-items", f"{len(b.items)} items, at least {leaf.min_items} must stand", b, hint)


def _code(b: Block, leaf: Code, hint: str | None, out: Findings) -> None:
    if leaf.lang is not None and b.lang != leaf.lang:
        out.add("content/code/lang", f"language {b.lang or '(none)'}, {leaf.lang} is expected", b, hint)


def _paragraph(b: Block, leaf: MaxWords, hint: str | None, out: Findings) -> None:
    count = len(words(b.text))
    if count > leaf.limit:
        out.add("content/max-words", f"{count} words, at most {leaf.limit} may stand", b, hint)


# ---- frontmatter and text ------------------------------------------------------------------------------------


def _frontmatter(doc: Document, contract: Contract, out: Findings) -> None:
    data = doc.frontmatter if doc.has_frontmatter and doc.frontmatter is not None else {}
    kinds = {"required": "required", "type": "type", "bound": "type", "value": "enum", "unknown": "unknown-key", "refine": "refine"}
    for issue in check(contract.frontmatter, data):
        out.add(f"frontmatter/{kinds[issue.code]}", f"{path_text(issue.path)}: {issue.text}", (doc.line_of(issue.path), None), issue.hint or contract.description)


@lru_cache(maxsize=512)
def _needle(spec: TextSpec) -> re.Pattern | None:
    pattern = needle_regex(spec)
    return re.compile(pattern, re.I if spec.ignore_case else 0) if pattern else None


def hits(text: str, spec: TextSpec) -> list[tuple[int, int]]:
    """Line and column of each occurrence, none of which overlap."""
    needle = _needle(spec)
    if needle is None:
        return []
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    out = []
    for m in needle.finditer(text):
        k = bisect_right(starts, m.start()) - 1
        out.append((k + 1, utf16(text[starts[k] : m.start()]) + 1))
    return out


def _text(specs: tuple[TextSpec, ...], node: Section, scope: str, at: Section | None, hint: str | None, out: Findings) -> None:
    if not specs:
        return
    text = node.scope_text()
    for spec in sorted(specs, key=lambda s: s.kind != "requires"):
        found = hits(text, spec)
        needle = spec.pattern if spec.pattern is not None else f"/{spec.regex}/"
        say = f" ({spec.note})" if spec.note else ""
        if spec.kind == "requires":
            least = 1 if spec.min is None else spec.min
            if len(found) < least:
                kind = "requires" if least == 1 else "count"
                out.add(spec.finding_id(kind, scope), f"{needle!r} stands {len(found)} times, at least {least} must{say}", at, hint, spec.level)
            elif spec.max is not None and len(found) > spec.max:
                out.add(spec.finding_id("count", scope), f"{needle!r} stands {len(found)} times, at most {spec.max} may{say}", at, hint, spec.level)
        elif len(found) > (spec.max or 0):
            if spec.max:
                out.add(spec.finding_id("count", scope), f"{needle!r} stands {len(found)} times, at most {spec.max} may{say}", at, hint, spec.level)
            else:
                for place in found:
                    out.add(spec.finding_id("forbids", scope), f"{needle!r} must not stand{say}", place, hint, spec.level)


def iter_findings(source: str | None, contract: Contract) -> Iterator[Finding]:
    yield from validate_text(source or "", contract)
