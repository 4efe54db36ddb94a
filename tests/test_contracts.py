"""Contracts: the planes' findings, the YAML language and its rejections."""

import random

import pytest

from folioscope.operators.planes import Strict, validate_text
from folioscope.plans import ddl
from folioscope.plans import grammar as g


def contract(body="", front=""):
    return ddl.load_contract(f"mcVersion: 2\nkind: contract\n{front}\n{body}")


def ids(source, c):
    return [(f.id, f.line) for f in validate_text(source, c)]


def test_missing_duplicate_and_collision():
    c = contract("body: {sections: [{section: A}, {section: B, description: say b}]}")
    assert ids("## A\n", c) == [("structure/section-missing", 1)]
    assert validate_text("", c)[1].hint == "say b"
    assert ids("## A\n## B\n## A\n", c) == [("structure/duplicate-section", 3)]
    assert ids("## A\n## B\n## a!\n", c) == [("structure/key-collision", 3)]


def test_aliases_fill_one_slot_once():
    c = contract("body: {sections: [{section: A, aliases: [Alpha]}]}")
    assert ids("## Alpha\n", c) == [] and ids("## A\n## Alpha\n", c) == [("structure/duplicate-section", 2)]


def test_repeats_have_bounds():
    c = contract("body: {sections: [{section: S, minContains: 2, maxContains: 3}]}")
    assert ids("## S\n", c) == [("structure/repeat-count", 1)]
    assert ids("## S\n" * 3, c) == []
    assert ids("## S\n" * 4, c) == [("structure/repeat-count", 4)]


def test_relative_order_flags_what_comes_too_late():
    c = contract("body: {order: recognized-relative, sections: [{section: A}, {section: B}, {section: C}]}")
    assert ids("## B\n## X\n## A\n## C\n", c) == [("structure/section-order", 3)]


def test_strict_order_gaps_and_strays():
    c = contract("body: {order: strict, additionalSections: false, sections: [{section: A}, {gap: {min: 1, max: 2}}, {section: B}]}")
    assert ids("## A\n## x\n## B\n", c) == []
    assert ids("## A\n## B\n", c) == [("structure/gap-count", 2)]
    assert ids("## A\n## x\n## B\n## y\n", c) == [("structure/section-order", 4)]
    loose = contract("body: {additionalSections: false, sections: [{section: A}]}")
    assert ids("## A\n## x\n", loose) == [("structure/section-order", 2)]


def walk(level, names):
    """The strict walk, spec by spec."""
    specs, i, taken, flagged, gaps = level.specs, 0, False, [], {k: 0 for k, s in enumerate(level.specs) if isinstance(s, g.Gap)}
    for n, name in enumerate(names):
        fits = [k for k, s in enumerate(specs) if isinstance(s, g.Slot) and name in s.names]
        while True:
            if i >= len(specs):
                if not fits:
                    if specs and isinstance(specs[-1], g.Gap):
                        gaps[len(specs) - 1] += 1
                    elif not level.allow_unknown:
                        flagged.append(n)
                break
            s, later = specs[i], [k for k in fits if k > i]
            if isinstance(s, g.Gap):
                if later:
                    i += 1
                    continue
                gaps[i] += 1
                break
            if i in fits:
                i, taken = (i, True) if s.repeatable else (i + 1, False)
                break
            free = s.optional or s.repeatable and taken
            if later:
                if not free:
                    flagged.append(n)
                i, taken = later[0] + 1, False
                break
            if free or fits:
                i, taken = i + 1, False
                continue
            if not level.allow_unknown:
                flagged.append(n)
            break
    return flagged, gaps


def test_the_tables_equal_the_walk():
    r = random.Random(5)
    for _ in range(3000):
        specs = [g.Gap() if r.random() < 0.25 else g.Slot((f"{k}{r.choice('ab')}", *r.sample(["p", "q"], r.randint(0, 1))), optional=r.random() < 0.4, repeatable=r.random() < 0.3) for k in range(r.randint(0, 5))]
        level = g.Level(tuple(specs), "strict", r.random() < 0.5)
        names = [r.choice(["0a", "1a", "2b", "3a", "4b", "p", "q", "x"]) for _ in range(r.randint(0, 7))]
        got = Strict(level).run(names)
        assert (got.flagged, got.gaps) == walk(level, names)


def test_content_planes():
    body = """
body:
  sections:
    - section: T
      content: {table: {columns: [a, b], minRows: 2, extraColumns: error, cells: {a: {enum: [x]}}}}
    - section: L
      content: {list: {items: checkbox, minItems: 2}}
    - section: C
      content: {code: {lang: py}}
    - section: W
      content: {maxWords: 2}
"""
    source = "## T\n\n| a | c |\n|---|---|\n| y | 1 |\n\n## L\n\n- one\n\n## C\n\n```js\n```\n\n## W\n\none two three\n"
    assert ids(source, contract(body)) == [("content/table/column-missing", 3), ("content/table/column-extra", 3), ("content/table/min-rows", 3), ("content/table/cell", 5), ("content/list/item-kind", 9), ("content/list/min-items", 9), ("content/code/lang", 13), ("content/max-words", 18)]


def test_blocks_anchors_and_kinds():
    c = contract("body: {sections: [{section: A, anchor: top, content: {rows: {table: {columns: [a]}}}}, {section: B, content: {list: {}}}]}")
    assert ids("## A\n## B\n\ntext\n", c) == [("structure/anchor-missing", 1), ("structure/block-missing", 1), ("structure/block-kind", 4)]


def test_words_are_those_of_the_first_or_anchored_paragraph():
    c = contract("body: {sections: [{section: A, content: {maxWords: 4}}]}")
    assert ids("## A\n\none two three\n\nfour five six\n", c) == []
    assert ids("## A\n\n- item\n", c) == [("structure/block-kind", 3)]
    assert ids("## A\n", c) == [("structure/block-missing", 1)]
    assert ids("text\n\n## A\n\none two three four five\n", c) == [("content/max-words", 5)]
    anchored = contract("body: {sections: [{section: A, content: {note: {maxWords: 2}}}]}")
    assert ids("## A\n\none two three\n\nfour five ^note\n", anchored) == []
    assert ids("## A\n\none two three\n", anchored) == [("structure/block-missing", 1)]
    assert ids("## A\n\none\n\ntwo three four ^note\n", anchored) == [("content/max-words", 5)]


def test_content_binds_the_first_section_of_a_slot_only():
    c = contract("body: {sections: [{section: A, maxContains: 9, content: {maxWords: 1}}]}")
    assert ids("## A\n\none\n\n## A\n\none two\n", c) == []


def test_nested_levels_and_depth_jumps():
    c = contract("body: {sections: [{section: A, sections: [{section: B}]}]}")
    assert ids("## A\n#### C\n", c) == [("structure/heading-depth-jump", 2), ("structure/section-missing", 2)]


def test_frontmatter():
    front = "frontmatter: {type: object, required: [id, kind], additionalProperties: false, properties: {id: {type: integer, minimum: 1}, kind: {enum: [a]}, n: {type: [string, 'null'], minLength: 2}, d: {type: string, format: date}}}"
    c = contract(front=front)
    assert ids("text", c) == [("frontmatter/required", None), ("frontmatter/enum", None)]
    assert ids("---\nid: 0\nkind: b\nn: x\nd: no\nz: 1\n---\n", c) == [("frontmatter/type", 2), ("frontmatter/enum", 3), ("frontmatter/type", 4), ("frontmatter/type", 5), ("frontmatter/unknown-key", 6)]
    assert ids("---\nid: 1.0\nkind: a\nn: null\n---\n", c) == []


def test_text_rules():
    c = contract("body: {sections: [{section: A, requires: [{pattern: so be it, min: 2}]}], forbids: [{pattern: TODO, id: text/forbids/todo, level: warn}]}")
    found = validate_text("## A\n\nso be\nit TODO\nTODO\n", c)
    assert [(f.id.split("/")[1], f.line, f.col, f.level) for f in found] == [("count", 1, 1, "error"), ("forbids", 4, 4, "warn"), ("forbids", 5, 1, "warn")]


def test_rules_of_ones_own_and_refinements():
    node = g.rule("summary/short", lambda s: [("too long", "warn", s.line)] if len(s.blocks) > 1 else [])
    doc = g.doc_rule("task/title", lambda d: [] if d.title else ["no title"])
    even = g.Schema("object", properties=(("n", g.Schema("integer", refine=lambda n: n % 2 == 0)),))
    c = g.contract(even, g.sections([g.section("A", rules=(node,))]), rules=[doc])
    assert ids("---\nn: 3\n---\n## A\n\na\n\nb\n", c) == [("task/title", None), ("frontmatter/refine", 2), ("summary/short", 4)]


@pytest.mark.parametrize(
    "text",
    ["mcVersion: 1\nkind: contract", "mcVersion: 2\nkind: config", "mcVersion: 2\nkind: contract\nextra: 1", "mcVersion: 2\nkind: contract\nbody: {sections: [{section: A, repeatable: true}]}",
     "mcVersion: 2\nkind: contract\nbody: {sections: [{section: A, colour: 1}]}", "mcVersion: 2\nkind: contract\nbody: {sections: [{section: A, maxContains: 0}]}", "mcVersion: 2\nkind: contract\nbody: {sections: [{section: A B}, {section: a b}]}",
     "mcVersion: 2\nkind: contract\nbody: {sections: [], requires: [{pattern: a, max: 0}]}", "mcVersion: 2\nkind: contract\nbody: {sections: [], requires: [{pattern: a}, {pattern: a}]}", "mcVersion: 2\nkind: contract\nfrontmatter: {type: strin}",
     "mcVersion: 2\nkind: contract\nfrontmatter: {type: object, properties: {a: {type: string, format: dat}}}", "a: ["],
)
def test_rejections(text):
    with pytest.raises(ddl.DeclarativeError):
        ddl.load_contract(text)


def test_build_guards():
    for options in ({"min": 1}, {"repeatable": True, "min": 3, "max": 2}, {"repeatable": True, "max": -1}):
        with pytest.raises(g.ContractError) as e:
            g.section("A", **options)
        assert e.value.code == "contract/repeat-bounds"
    with pytest.raises(g.ContractError):
        g.sections([g.section("A b"), g.section("a B")])
