"""The planes over tables give what the planes over documents give."""

import random

import pytest

from folioscope.operators import relational
from folioscope.operators.validate import validate
from folioscope.plans import ddl
from folioscope.sources.projection import open_table, project


def random_document(r):
    out = "intro\n\n" if r.random() < 0.3 else ""
    for _ in range(r.randint(0, 6)):
        out += f"{'#' * r.randint(2, 4)} {r.choice(['A', 'Alpha', 'B', 'b!', 'T', 'L', 'C', 'X'])}\n\n"
        out += r.choice(["", "one two three\n\n", "| a | b |\n|---|---|\n| x | 1 |\n| y |\n\n", "| b |\n|---|\n\n", "- [x] t\n- u\n\n", "```py\n1\n```\n\n", "```\n1\n```\n\n", "text ^k\n\n", "^k\n\n"])
    return out


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(7)
    return spark.createDataFrame([(k, random_document(r)) for k in range(250)] + [(900, None), (901, "")], "doc_id int, source string").persist()


LEVELS = [
    "{order: recognized-relative, sections: [{section: A, aliases: [Alpha]}, {section: B, maxContains: 2, minContains: 2}, {section: T, minContains: 0, maxContains: 1}]}",
    "{additionalSections: false, sections: [{section: A}, {section: B, minContains: 0}]}",
    "{additionalSections: false, sections: [{section: A, minContains: 0}, {gap: {min: 1, max: 2}}]}",
]
CONTENT = ["{table: {columns: [a, b], minRows: 2, extraColumns: error, cells: {a: {enum: [x]}, b: {type: string, minLength: 1}}}}", "{list: {items: checkbox, minItems: 3}}", "{code: {lang: py}}", "{maxWords: 2}"]


def rows(df, only=None):
    return sorted((r.doc_id, r.id, r.line or 0) for r in df.select("doc_id", "id", "line").collect() if only is None or r.id.startswith(only))


@pytest.mark.parametrize("body", LEVELS)
def test_structure(docs, body):
    c = ddl.load_contract(f"mcVersion: 2\nkind: contract\nbody: {body}")
    sections = open_table(project(docs, tables=("sections",)), "sections")
    got = relational.structure(docs, sections, c.body).unionByName(relational.depth_jumps(sections))
    assert rows(got) == rows(validate(docs, c))


@pytest.mark.parametrize("leaf", CONTENT)
def test_content(docs, leaf):
    # content binds a slot's first section, but the presence of blocks is asked of each: documents with one such section
    c = ddl.load_contract(f"mcVersion: 2\nkind: contract\nbody: {{sections: [{{section: A, minContains: 0, anchor: k, content: {leaf}}}]}}")
    p = project(docs, tables=("sections", "blocks", "cells", "items"))
    t = {k: open_table(p, k) for k in ("sections", "blocks", "cells", "items")}
    once = t["sections"].where("parent_id = 0 AND name = 'A'").groupBy("doc_id").count().where("count = 1").select("doc_id")
    got = relational.content(t["sections"], t["blocks"], t["cells"], t["items"], c.body.slots[0]).join(once, "doc_id", "left_semi")
    want = validate(docs, c).where("id LIKE 'content/%' OR id LIKE 'structure/block-%' OR id = 'structure/anchor-missing'").join(once, "doc_id", "left_semi")
    assert rows(got) == rows(want) and rows(want)
