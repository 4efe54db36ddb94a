"""What is asked of one document at a time takes one pass over the documents, and gives what the tables give."""

import random

import pytest
from test_relational import CONTENT, random_document, rows

from folioscope import queries
from folioscope.operators import navigate, relational
from folioscope.operators.validate import validate
from folioscope.plans import ddl
from folioscope.sources.projection import open_table, project


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(11)
    extra = lambda: r.choice(["", "[[#^k]] and [[#^no]]\n\n", "[[x#^k]] [[#k]]\n\n", "| b | a | a |\n|---|---|---|\n| 1 | 2 | 3 | 4 |\n^t\n\n"])
    out = [(k, "".join(random_document(r) + extra() for _ in range(2))) for k in range(250)]
    return spark.createDataFrame([*out, (900, None), (901, "")], "doc_id int, source string").persist()


@pytest.mark.parametrize("leaf", CONTENT)
def test_content_within(docs, leaf):
    c = ddl.load_contract(f"mcVersion: 2\nkind: contract\nbody: {{sections: [{{section: A, aliases: [Alpha], minContains: 0, anchor: k, content: {leaf}}}]}}")
    p = project(docs, tables=("sections", "blocks", "cells", "items", "grids"))
    t = {k: open_table(p, k) for k in ("sections", "blocks", "cells", "items")}
    got = relational.content_within(p, c.body.slots[0])
    assert rows(got) == rows(relational.content(t["sections"], t["blocks"], t["cells"], t["items"], c.body.slots[0])) and rows(got)
    once = t["sections"].where("parent_id = 0 AND name IN ('A', 'Alpha')").groupBy("doc_id").count().where("count = 1").select("doc_id")
    want = validate(docs, c).where("id LIKE 'content/%' OR id LIKE 'structure/block-%' OR id = 'structure/anchor-missing'")
    assert rows(got.join(once, "doc_id", "left_semi")) == rows(want.join(once, "doc_id", "left_semi"))


def test_tables_and_references_within(docs):
    p = project(docs, tables=("sections", "blocks", "cells", "refs", "grids", "anchors"))
    s, b, cells, refs = (open_table(p, k) for k in ("sections", "blocks", "cells", "refs"))
    as_set = lambda df: sorted(map(str, df.collect()))
    for where in ({}, {"anchor": "t"}, {"section_id": 1}):
        got = navigate.grid_rows(p, ["a", "b", "none"], **where)
        assert as_set(got.drop("_line")) == as_set(navigate.table_view(b, cells, ["a", "b", "none"], **where)) and got.count()
    records = navigate.table_view(b, cells, ["a", "b"]).select("doc_id", "a", "b")
    got = navigate.first_rows_of_records(navigate.grid_rows(p, ["a", "b"]), records, ["a", "b"])
    assert as_set(got) == as_set(navigate.rows_of_records(b, cells, records, ["a", "b"]))
    dead = navigate.dead_references_within(p)
    assert as_set(dead.select("doc_id", "anchor", "line")) == as_set(navigate.dead_references(refs, navigate.anchors(s, b)).select("doc_id", "anchor", "line")) and dead.count()


@pytest.mark.parametrize("name", ["dead_anchors", "rows_of_records", "table_round_trip", "content_over_tables"])
def test_documents_are_parsed_once(spark, sf_dir, name):
    plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
