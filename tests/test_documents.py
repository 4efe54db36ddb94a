"""Parsing: blocks, inline text, sections, anchors, frontmatter."""

import pytest

from folioscope.functions import formats, names
from folioscope.sources import yaml12
from folioscope.sources.document import parse, raw_rows, references
from folioscope.sources.markdown import flatten, split_frontmatter


def names_of(source):
    return [(s.name, s.depth, s.line) for s in parse(source).root.walk()][1:]


def test_sections_nest_by_depth_and_the_first_h1_is_the_title():
    doc = parse("intro\n\n# Title\n\n## A\n### B\n## C\n#### D\n# Second\ntext\n")
    assert doc.title == "Title"
    assert [(s.name, [c.name for c in s.sections]) for s in doc.root.sections] == [("A", ["B"]), ("C", ["D"]), ("Second", [])]
    assert [b.text for b in doc.root.blocks] == ["intro"]


def test_setext_headings_and_closing_marks():
    assert names_of("One\n---\n\n## Two ##\n") == [("One", 2, 1), ("Two", 2, 4)]


def test_fences_hide_headings_and_keep_their_language():
    doc = parse("## A\n\n```py x\n# no\n| a |\n^id\n```\n")
    (block,) = doc.root.sections[0].blocks
    assert (block.kind, block.lang, block.text) == ("code", "py", "# no\n| a |\n^id")
    assert doc.code_lines == [(3, 7)]


def test_quotes_html_breaks_and_definitions_give_no_block():
    assert parse("## A\n\n> quote\n> | a |\n\n<div>\nx\n</div>\n\n***\n\n[x]: http://y\n").root.sections[0].blocks == []


def test_tables_keep_ragged_rows_and_lift_the_anchor_row():
    (t,) = parse("## A\n\n| a | b |\n|---|---|\n| 1 | x\\|y |\n| 2 |\n^rows\n").root.sections[0].blocks
    assert (t.columns, t.rows, t.anchor, t.row_lines) == (["a", "b"], [["1", "x|y"], ["2"]], "rows", [5, 6])


def test_list_items_are_tasks_or_not_and_the_first_anchor_counts():
    (block,) = parse("## A\n\n- [x] one ^k\n- [ ] two\n- three\n  - nested\n").root.sections[0].blocks
    assert [(i.text, i.checked) for i in block.items] == [("one", True), ("two", False), ("three", None)]
    assert block.anchor == "k"


def test_standalone_anchors_bind_to_the_block_before_or_the_section():
    s = parse("## A\n\n^own\n\ntext ^t\n\n^more\n\nplain\n\n^p\n").root.sections[0]
    assert s.own_anchors == ["own", "more"] and [b.anchor for b in s.blocks] == ["t", "p"]
    assert s.anchors == ["own", "more", "t", "p"]


@pytest.mark.parametrize(
    ("source", "text"),
    [("a *b* **c** `d *e*`", "a b c d *e*"), ("![i](u)x [l](u)", "x l"), ("a  \nb\nc", "a b\nc"), ("\\*a\\* &amp; b", "*a* & b"), ("snake_case_name", "snake_case_name"), ("[[A|b]]", "[[A|b]]"), ("**open", "**open"), ("<b>t</b> <http://x.y>", "t http://x.y")],
)
def test_inline_text(source, text):
    assert flatten(source) == text


def test_frontmatter_is_split_with_its_lines():
    assert split_frontmatter("---\r\na: 1\r\n---\r\nx") == ("a: 1\r\n", "x", 4)
    assert split_frontmatter("---\na: 1\n")[0] is None
    doc = parse("---\na: 1\nb:\n  - x\n---\n# T\n\n## S\n")
    assert doc.frontmatter == {"a": 1, "b": ["x"]} and doc.line_of(("b", 0)) == 4 and doc.line_of(()) == 2
    assert doc.root.sections[0].line == 8


def test_yaml_has_the_core_schema():
    assert yaml12.load("[2024-01-05, yes, 1:30, 010, 0o10, 1e3, ~, True]") == ["2024-01-05", "yes", "1:30", 10, 8, 1000.0, None, True]
    simple = "a: 1\nb: x y\nc:\nd: 2024-01-05\ne: 1.5\nf: true\n"
    assert yaml12.load_positioned(simple)[0] == yaml12.load(simple) == {"a": 1, "b": "x y", "c": None, "d": "2024-01-05", "e": 1.5, "f": True}
    assert yaml12.load_positioned("a: [1\n") == (None, {})


def test_references_and_raw_rows():
    assert [(r["kind"], r["target"], r["fragment"], r["alias"]) for r in references("[[A#b|c]] ![[D]] [[#^x]]")] == [("link", "A", "b", "c"), ("transclusion", "D", None, None), ("link", "", "^x", None)]
    assert raw_rows("| `a` | b |\n|---|---|\n| 1 |\n", 1, 3, 2)[0] == ["`a`", "b"] and raw_rows("| 1 |", 1, 1, 2) == [["1", ""]]


def test_names_ids_and_lengths():
    assert names.camel_key("Foo bar-BAZ") == "fooBarBaz" and names.camel_key("--") == "" and names.slug(" A b!") == "a-b"
    assert names.utf16("a😀") == 3 and names.words("a b  c") == ["a", "b", "c"]
    assert names.did_you_mean("colums", ["columns", "anchor"]) == "columns" and names.did_you_mean("zzz", ["columns"]) is None


def test_synthesized_ids_are_stable():
    from folioscope.plans.grammar import requires

    assert requires("outcome").finding_id("requires", "summary") == "text/requires/summary/1tc7itx"
    assert requires("x", id="own/id").finding_id("requires", "doc") == "own/id"


@pytest.mark.parametrize(
    ("name", "good", "bad"),
    [("email", "a.b@c.de", "a..b@c.de"), ("uuid", "123e4567-e89b-12d3-a456-426614174000", "123e4567"), ("date", "2024-02-29", "2023-02-29"), ("time", "23:59:59", "24:00"), ("datetime", "2024-01-01T00:00:00Z", "2024-01-01 00:00"),
     ("ipv4", "10.0.0.255", "256.1.1.1"), ("ipv6", "::1", "1::2::3"), ("cidrv4", "10.0.0.0/8", "10.0.0.0/33"), ("cidrv6", "::/0", "::/129"), ("duration", "P1DT2H", "P"), ("e164", "+15551234567", "555"), ("base64", "YWI=", "YWI"), ("ulid", "01ARZ3NDEKTSV4RRFFQ69G5FAV", "01ARZ"), ("emoji", "😀", "a"), ("hostname", "a-b.example.com", "-a"), ("url", "https://x.y/z", "x y"), ("nanoid", "V1StGXR8_Z5jdHi6B-myT", "x"), ("cuid", "cjld2cjxh0000", "x"), ("cuid2", "tz4a98xx", "T_")],
)
def test_formats(name, good, bad):
    assert formats.matches(name, good) and not formats.matches(name, bad)
