"""Markdown documents to positioned nodes: blocks first, then the inline text of each.

CommonMark's block rules and GFM tables and task items; YAML frontmatter is split off before.  Lines and columns count
from 1, columns in UTF-16 units.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

from folioscope.functions.names import utf16

FENCE = re.compile(r" {0,3}(`{3,}|~{3,})[ \t]*([^\n]*)$")
ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*))?$")
BREAK = re.compile(r" {0,3}([-*_])[ \t]*(?:\1[ \t]*){2,}$")
QUOTE = re.compile(r" {0,3}> ?")
ITEM = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])([ \t]+|$)")
SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
DEFINITION = re.compile(r" {0,3}\[((?:[^\[\]\\]|\\.)+)\]:[ \t]*(\S+)(?:[ \t]+(?:\"[^\"]*\"|'[^']*'|\([^)]*\)))?[ \t]*$")
DELIMITER = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
HTML_OPEN = re.compile(r" {0,3}<(?:script|pre|style|textarea)(?:[\s>]|$)|(?P<c> {0,3}<!--)|(?P<p> {0,3}<\?)|(?P<d> {0,3}<![A-Za-z])|(?P<t> {0,3}</?[A-Za-z][\w-]*(?:[\s/>]|$))", re.I)
FRONT = re.compile(r"---[ \t]*\r?\n")
FRONT_END = re.compile(r"^---[ \t]*\r?$", re.M)


@dataclass
class Line:
    text: str
    number: int
    column: int = 1  # where text begins in the source line
    lazy: bool = False


@dataclass
class Node:
    kind: str
    line: int
    column: int = 1
    depth: int = 0
    text: str = ""
    lines: list[Line] = field(default_factory=list)
    last: int = 0
    lang: str | None = None
    ordered: bool = False
    checked: bool | None = None
    children: list[Node] = field(default_factory=list)
    rows: list[list[tuple[str, int]]] = field(default_factory=list)  # cells: source text, column
    row_lines: list[int] = field(default_factory=list)


def split_frontmatter(source: str) -> tuple[str | None, str, int]:
    """The frontmatter's YAML (None: there is none), the body, and the line of the body's first line."""
    opened = FRONT.match(source)
    if not opened:
        return None, source, 1
    closed = FRONT_END.search(source, opened.end())
    if not closed:
        return None, source, 1
    rest = source[closed.end() :]
    return source[opened.end() : closed.start()], rest[1:] if rest[:1] == "\n" else rest, source.count("\n", 0, closed.end()) + 2


def _expand(text: str) -> str:
    """Leading tabs as spaces to stops of four."""
    if "\t" not in text[: len(text) - len(text.lstrip())]:
        return text
    out = ""
    for k, ch in enumerate(text):
        if ch == "\t":
            out += " " * (4 - len(out) % 4)
        elif ch == " ":
            out += ch
        else:
            return out + text[k:]
    return out


def _indent(text: str) -> int:
    return len(text) - len(text.lstrip(" "))


_BAR = re.compile(r"(?:[^\\|]|\\.|\\$)*")


def _cells(text: str) -> list[tuple[str, int]]:
    """Cells of a table row and the offset of each one's text."""
    body = text.rstrip()
    k = len(text) - len(text.lstrip())
    k += body[k : k + 1] == "|"
    cells = []
    if "\\" not in body:
        for raw in (body[k:-1] if body[k:].endswith("|") else body[k:]).split("|") if k < len(body) else ():
            cells.append((raw.strip(), k + len(raw) - len(raw.lstrip())))
            k += len(raw) + 1
        return cells
    while k < len(body):
        end = _BAR.match(body, k).end()
        raw = body[k:end]
        cells.append((raw.strip().replace("\\|", "|"), k + len(raw) - len(raw.lstrip())))
        k = end + 1
    return cells


#: What a block other than a paragraph, a table or an indented one begins with; the empty text is in it too.
_OPENERS = "#-*_+>`~<[0123456789"


def _starts_block(text: str) -> bool:
    """Whether the line ends a paragraph before it."""
    if text.lstrip(" ")[:1] not in _OPENERS:
        return False
    if ATX.match(text) or BREAK.match(text) or QUOTE.match(text):
        return True
    fence = FENCE.match(text)
    if fence and not (fence[1][0] == "`" and "`" in fence[2]):
        return True
    item = ITEM.match(text)
    if item and item[3] and text[item.end() :].strip():
        return item[2] in "-+*" or item[2][:-1] == "1"
    opened = HTML_OPEN.match(text)
    return bool(opened) and not (opened["t"] and not _known_tag(text))


#: HTML elements whose tags end a paragraph (CommonMark, HTML blocks of type 6).
_TAGS = set("address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead title tr track ul".split())


def _known_tag(text: str) -> bool:
    tag = re.match(r" {0,3}</?([A-Za-z][\w-]*)", text)
    return bool(tag) and tag[1].lower() in _TAGS


class Blocks:
    """The block nodes of lines, and the labels of link definitions."""

    def __init__(self, lines: list[Line], labels: set[str]):
        self.lines, self.labels, self.at, self.out = lines, labels, 0, []

    def parse(self) -> list[Node]:
        while self.at < len(self.lines):
            line = self.lines[self.at]
            text = line.text = _expand(line.text)
            if not text.strip():
                self.at += 1
            elif _indent(text) >= 4:
                self.indented()
            elif text.lstrip(" ")[:1] not in _OPENERS:
                self.table() if self.is_table(self.at) else self.paragraph()
            elif (m := FENCE.match(text)) and not (m[1][0] == "`" and "`" in m[2]):
                self.fenced(m)
            elif m := ATX.match(text):
                body = re.sub(r"(?:^|[ \t]+)#+[ \t]*$", "", (m[2] or "").rstrip()).strip()
                self.out.append(Node("heading", line.number, line.column + _indent(text), len(m[1]), body))
                self.at += 1
            elif BREAK.match(text):
                self.out.append(Node("break", line.number, line.column))
                self.at += 1
            elif QUOTE.match(text):
                self.quote()
            elif ITEM.match(text):
                self.list()
            elif (m := HTML_OPEN.match(text)) and (not m["t"] or _known_tag(text) or re.match(r" {0,3}</?[A-Za-z][^<>]*>[ \t]*$", text)):
                self.html(m)
            elif m := DEFINITION.match(text):
                self.labels.add(" ".join(m[1].lower().split()))
                self.out.append(Node("definition", line.number, line.column))
                self.at += 1
            elif self.is_table(self.at):
                self.table()
            else:
                self.paragraph()
        return self.out

    def indented(self) -> None:
        first = self.lines[self.at]
        rows, last = [], self.at
        k = self.at
        while k < len(self.lines):
            text = _expand(self.lines[k].text)
            if text.strip() and _indent(text) < 4:
                break
            rows.append(text[4:])
            if text.strip():
                last = k
            k += 1
        rows = rows[: last - self.at + 1]
        self.out.append(Node("code", first.number, first.column + 4, text="\n".join(rows), last=self.lines[last].number))
        self.at = last + 1

    def fenced(self, m: re.Match) -> None:
        first, indent = self.lines[self.at], _indent(self.lines[self.at].text)
        close = re.compile(rf" {{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}[ \t]*$")
        rows, k = [], self.at + 1
        while k < len(self.lines) and not close.match(self.lines[k].text):
            text = self.lines[k].text
            rows.append(text[min(indent, _indent(text)) :])
            k += 1
        last = self.lines[min(k, len(self.lines) - 1)].number
        info = m[2].strip().split()
        self.out.append(Node("code", first.number, first.column + indent, text="\n".join(rows), lang=_plain(info[0]) if info else None, last=last))
        self.at = k + 1

    def quote(self) -> None:
        first, inner = self.lines[self.at], []
        while self.at < len(self.lines):
            line = self.lines[self.at]
            text = _expand(line.text)
            if m := QUOTE.match(text):
                inner.append(Line(text[m.end() :], line.number, line.column + m.end()))
            elif text.strip() and inner and _open_paragraph(inner) and not _starts_block(text):
                inner.append(Line(text, line.number, line.column, True))
            else:
                break
            self.at += 1
        self.out.append(Node("quote", first.number, first.column, children=Blocks(inner, self.labels).parse()))

    def list(self) -> None:
        first = ITEM.match(self.lines[self.at].text)
        mark = first[2][-1]
        node = Node("list", self.lines[self.at].number, self.lines[self.at].column + len(first[1]), ordered=mark in ".)")
        while self.at < len(self.lines):
            line = self.lines[self.at]
            text = _expand(line.text)
            m = ITEM.match(text)
            if not m or m[2][-1] != mark or BREAK.match(text):
                break
            space = len(m[3])
            rest = text[m.end() :]
            width = len(m[1]) + len(m[2]) + (space if 1 <= space <= 4 and rest.strip() else 1)
            inner = [Line(text[width:], line.number, line.column + width)]
            self.at += 1
            blank = False
            while self.at < len(self.lines):
                after = self.lines[self.at]
                body = _expand(after.text)
                if not body.strip():
                    if len(inner) == 1 and not inner[0].text.strip():
                        break
                    blank = True
                    inner.append(Line("", after.number))
                elif _indent(body) >= width:
                    inner.append(Line(body[width:], after.number, after.column + width))
                    blank = False
                elif not blank and _open_paragraph(inner) and not _starts_block(body) and not ITEM.match(body):
                    inner.append(Line(body.lstrip(), after.number, after.column + _indent(body), True))
                else:
                    break
                self.at += 1
            while len(inner) > 1 and not inner[-1].text:
                inner.pop()
            item = Node("item", line.number, line.column + len(m[1]))
            task = re.match(r"[ \t]*\[([ xX])\](?=[ \t\n]|$)[ \t]*", inner[0].text)
            if task and inner[0].text[task.end() :].strip():
                item.checked = task[1] != " "
                inner[0] = Line(inner[0].text[task.end() :], inner[0].number, inner[0].column + task.end())
            item.children = Blocks(inner, self.labels).parse()
            node.children.append(item)
            while self.at < len(self.lines) and not self.lines[self.at].text.strip():
                k = self.at
                while k < len(self.lines) and not self.lines[k].text.strip():
                    k += 1
                if k == len(self.lines) or not ((n := ITEM.match(_expand(self.lines[k].text))) and n[2][-1] == mark):
                    break
                self.at = k
        self.out.append(node)

    def html(self, m: re.Match) -> None:
        ends = "-->" if m["c"] else "?>" if m["p"] else ">" if m["d"] else None if m["t"] else re.compile("</(script|pre|style|textarea)>", re.I)
        self.out.append(Node("html", self.lines[self.at].number, self.lines[self.at].column))
        while self.at < len(self.lines):
            text = self.lines[self.at].text
            if ends is None and not text.strip():
                return
            self.at += 1
            if ends is not None and (ends in text if isinstance(ends, str) else ends.search(text)):
                return

    def is_table(self, k: int) -> bool:
        if k + 1 >= len(self.lines):
            return False
        head, rule = self.lines[k].text, _expand(self.lines[k + 1].text)
        return ("|" in head or "|" in rule) and bool(DELIMITER.match(rule)) and ("|" in rule or "|" in head) and len(_cells(head)) == len(_cells(rule))

    def table(self) -> None:
        first = self.lines[self.at]
        node = Node("table", first.number, first.column + _indent(first.text))
        k = self.at
        while k < len(self.lines):
            text = _expand(self.lines[k].text)
            if not text.strip() or k > self.at + 1 and (_starts_block(text) or _indent(text) >= 4):
                break
            if k != self.at + 1:
                node.rows.append([(c, self.lines[k].column + utf16(text[:o])) for c, o in _cells(text)])
                node.row_lines.append(self.lines[k].number)
            k += 1
        self.out.append(node)
        self.at = k

    def paragraph(self) -> None:
        rows: list[Line] = []
        while self.at < len(self.lines):
            line = self.lines[self.at]
            text = _expand(line.text)
            if not text.strip():
                break
            if rows and not line.lazy:
                m = SETEXT.match(text)
                if m:
                    self.out.append(Node("heading", rows[0].number, rows[0].column, 1 if m[1][0] == "=" else 2, "\n".join(r.text for r in rows).strip()))
                    self.at += 1
                    return
                if _starts_block(text) or self.is_table(self.at):
                    break
            elif rows and _starts_block(text):
                break
            rows.append(Line(text.lstrip(), line.number, line.column + _indent(text)))
            self.at += 1
        rows[-1].text = rows[-1].text.rstrip()
        self.out.append(Node("paragraph", rows[0].number, rows[0].column, text="\n".join(r.text for r in rows), lines=rows))


def _open_paragraph(lines: list[Line]) -> bool:
    """Whether the lines so far end in a paragraph that a lazy line may go on with."""
    text = lines[-1].text
    if not text.strip():
        return False
    while m := QUOTE.match(text) or ITEM.match(text):
        text = text[m.end() :]
    inside = False
    for line in lines[:-1]:
        if FENCE.match(line.text):
            inside = not inside
    return bool(text.strip()) and not inside and not (ATX.match(text) or BREAK.match(text) or FENCE.match(text)) and (len(lines) > 1 or _indent(text) < 4)


# ---- inline ----------------------------------------------------------------------------------------------------

_PUNCT = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_AUTOLINK = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[\w.!#$%&'*+/=?^`{|}~-]+@[\w-]+(?:\.[\w-]+)*)>")
_TAG = re.compile(r"</?[A-Za-z][\w-]*(?:\s+[\w:.-]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'=<>`]+))?)*\s*/?>|<!--.*?-->|<\?.*?\?>", re.S)
_ENTITY = re.compile(r"&(?:#[xX][0-9a-fA-F]{1,6}|#\d{1,7}|[A-Za-z][A-Za-z0-9]*);")
_TARGET = re.compile(r"\(\s*(?:<[^<>\n]*>|(?:[^\s()\\]|\\.|\([^\s()]*\))*)(?:\s+(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?\s*\)")
_SPECIAL = re.compile(r"[\\`*_~\[\]!<&\n]")


def _plain(text: str) -> str:
    return html.unescape(re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", text))


def flatten(text: str, labels: frozenset[str] | set[str] = frozenset(), spans: list[tuple[int, int]] | None = None) -> str:
    """The text of inline Markdown: marks dropped, code verbatim, a hard break a space, a soft one a line feed, images nothing.

    ``spans`` receives the offsets of inline code in ``text``.
    """
    if not _SPECIAL.search(text):
        return text
    out: list = []  # strings and delimiter runs [char, count, opens, closes, place]
    brackets: list[tuple[int, bool, int]] = []  # place in out, image, offset after
    k = 0
    while k < len(text):
        ch = text[k]
        if ch == "\\":
            if text[k + 1 : k + 2] == "\n":
                out.append(" ")
                k += 2
            elif k + 1 < len(text) and text[k + 1] in _PUNCT:
                out.append(text[k + 1])
                k += 2
            else:
                out.append(ch)
                k += 1
            continue
        if ch == "\n":
            hard = isinstance(out[-1], str) and out[-1].endswith("  ") if out else False
            if out and isinstance(out[-1], str):
                out[-1] = out[-1].rstrip(" ")
            out.append(" " if hard else "\n")
            k += 1
            continue
        if ch == "`":
            n = len(text[k:]) - len(text[k:].lstrip("`"))
            m = re.compile(rf"(?<!`)`{{{n}}}(?!`)").search(text, k + n)
            if m:
                body = text[k + n : m.start()].replace("\n", " ")
                if body.strip() and body[0] == body[-1] == " ":
                    body = body[1:-1]
                if spans is not None:
                    spans.append((k, m.end()))
                out.append(body)
                k = m.end()
            else:
                out.append("`" * n)
                k += n
            continue
        if ch == "<":
            if m := _AUTOLINK.match(text, k):
                out.append(m[1])
                k = m.end()
                continue
            if m := _TAG.match(text, k):
                k = m.end()
                continue
        if ch == "&" and (m := _ENTITY.match(text, k)):
            out.append(html.unescape(m[0]))
            k = m.end()
            continue
        if ch in "*_~":
            n = len(text[k:]) - len(text[k:].lstrip(ch))
            before, after = text[k - 1 : k] or " ", text[k + n : k + n + 1] or " "
            left = not after.isspace() and (after not in _PUNCT or before.isspace() or before in _PUNCT)
            right = not before.isspace() and (before not in _PUNCT or after.isspace() or after in _PUNCT)
            if ch == "_":
                left, right = left and (not right or before in _PUNCT), right and (not left or after in _PUNCT)
            out.append([ch, n, left, right] if ch != "~" or n <= 2 else ch * n)
            k += n
            continue
        if ch == "[" or text[k : k + 2] == "![":
            image = ch == "!"
            brackets.append((len(out), image, k + 1 + image))
            out.append("![" if image else "[")
            k += 1 + image
            continue
        if ch == "]" and brackets:
            at, image, begin = brackets.pop()
            m = _TARGET.match(text, k + 1)
            end = m.end() if m else None
            if end is None:
                ref = re.compile(r"\[([^\[\]]*)\]").match(text, k + 1)
                label = (ref[1] if ref and ref[1] else text[begin:k]).lower()
                if " ".join(label.split()) in labels:
                    end = ref.end() if ref else k + 1
            if end is not None:
                inner = _emphasis(out[at + 1 :])
                del out[at:]
                if not image:
                    out.append(inner)
                    brackets = [(a, i, b) for a, i, b in brackets if i]
                k = end
                continue
            out.append("]")
            k += 1
            continue
        m = _SPECIAL.search(text, k + 1)
        stop = m.start() if m else len(text)
        out.append(text[k:stop])
        k = stop
    return _emphasis(out)


def _emphasis(parts: list) -> str:
    """Matched delimiter runs are dropped; what is left of others is text."""
    runs = [p for p in parts if isinstance(p, list)]
    opened: list[list] = []
    whole = {id(r): r[1] for r in runs}
    for run in runs:
        if run[3]:
            while run[1] > 0:
                for o in reversed(opened):
                    if o[0] == run[0] and o[1] > 0:
                        odd = (o[3] or run[2]) and (whole[id(o)] + whole[id(run)]) % 3 == 0 and not (whole[id(o)] % 3 == 0 and whole[id(run)] % 3 == 0)
                        if run[0] == "~" and o[1] != run[1] or run[0] != "~" and odd:
                            continue
                        used = run[1] if run[0] == "~" else 2 if o[1] > 1 and run[1] > 1 else 1
                        o[1] -= used
                        run[1] -= used
                        del opened[next(k for k, x in enumerate(opened) if x is o) + (1 if o[1] else 0) :]
                        break
                else:
                    break
        if run[2] and run[1]:
            opened.append(run)
    return "".join(p if isinstance(p, str) else p[0] * p[1] for p in parts)


def parse_blocks(body: str, first_line: int = 1) -> tuple[list[Node], set[str]]:
    lines = re.split(r"\r\n|\n|\r", body)
    labels: set[str] = set()
    return Blocks([Line(x, first_line + k) for k, x in enumerate(lines)], labels).parse(), labels
