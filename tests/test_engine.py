"""DataFrame operators: corpora, reports, navigation, history, inference, streams; and the queries against DuckDB."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

import folioscope.queries as q
from folioscope.functions import columns as c
from folioscope.functions.names import camel_key, slug
from folioscope.operators import findings, history, infer, navigate
from folioscope.operators.validate import read, validate_corpus
from folioscope.plans import ddl
from folioscope.plans.grammar import ContractError, TextSpec
from folioscope.sources.files import read_tree
from folioscope.sources.projection import open_table, project
from folioscope.streaming import watch

CONFIG = """
mcVersion: 2
kind: config
contracts:
  task: {frontmatter: {type: object, required: [status], properties: {status: {enum: [open, done]}}}, body: {sections: [{section: Goal, description: say why}]}}
rules:
  - {include: "tasks/**/*.md", exclude: "tasks/old/**", contract: task, name: task}
  - {include: "**/*.md", contract: {body: {sections: [{section: Intro}]}}}
"""
FILES = [("tasks/b.md", "---\nstatus: nope\n---\n## Goal\n"), ("tasks/a/c.md", "# T\n"), ("tasks/old/x.md", "## Intro\n"), ("readme.md", "text\n"), ("pic.png", "bytes")]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(FILES, "path string, source string")


@pytest.fixture(scope="module")
def result(files):
    return validate_corpus(files, ddl.load_config(CONFIG))


def test_corpus_routes_first_match_and_orders_as_a_walk(result):
    rows = [(r.path, r.id, r.line) for r in result.ordered().collect()]
    assert rows == [("readme.md", "structure/section-missing", None), ("tasks/a/c.md", "frontmatter/enum", None), ("tasks/a/c.md", "structure/section-missing", None), ("tasks/b.md", "frontmatter/enum", 2)]
    assert result.stats().first().asDict() == {"files_scanned": 5, "files_matched": 4, "files_unmatched": 1}
    assert [tuple(r) for r in result.matched_by_rule().orderBy("rule").collect()] == [(0, "task", 2), (1, None, 2)]
    assert result.exit_code() == 1


def test_reports(result):
    text = findings.render_human(result.findings)
    assert "tasks/b.md:2 error frontmatter/enum — " in text and "  hint: say why" in text and text.endswith("4 finding(s): 4 error, 0 warn, 0 report")
    assert findings.run_summary(result) == "Scanned 5 files; 4 matched across 1 contract, 1 unmatched\n  task: 2"
    assert [x["id"] for x in json.loads(findings.render_json(result.findings))][:1] == ["structure/section-missing"]
    sarif = json.loads(findings.render_sarif(result.findings))["runs"][0]
    assert [r["id"] for r in sarif["tool"]["driver"]["rules"]] == ["structure/section-missing", "frontmatter/enum"]
    assert "region" not in sarif["results"][0]["locations"][0]["physicalLocation"]
    assert findings.filter_findings(result.findings, "frontmatter").count() == 2 and findings.has_errors(result.findings)
    assert findings.render_human(result.findings.limit(0)) == "No findings."


def test_read_keeps_documents_without_errors(spark):
    docs = spark.createDataFrame([(1, "## A\n"), (2, "x"), (3, None)], "doc_id int, source string")
    contract = ddl.load_contract("mcVersion: 2\nkind: contract\nbody: {sections: [{section: A}]}")
    assert [r.doc_id for r in read(docs, contract).collect()] == [1]
    with pytest.raises(ContractError):
        read(docs, contract, strict=True)


def test_files_of_a_tree(spark, tmp_path):
    for path, text in (("a/b.md", "B"), ("a.md", "A"), ("a/c.txt", "C"), ("x/d.md", "D")):
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_text(text)
    rows = read_tree(spark, str(tmp_path), include=("**/*.md",), exclude=("x/**",)).orderBy(F.split("path", "/")).collect()
    assert [tuple(r) for r in rows] == [("a/b.md", "B"), ("a.md", "A")]


def test_navigation_and_views(spark):
    source = "## A\n\none\ntwo\n\n### B\n\nthree ^k\n\n## C\n\n| x | y |\n|---|---|\n| 1 |\n\n- [x] t\n\n```\nz\n```\n"
    p = project(spark.createDataFrame([(1, source), (2, None)], "doc_id int, source string"))
    s, b, cells = (open_table(p, t) for t in ("sections", "blocks", "cells"))
    assert navigate.find_section(s, ["c"], ignore_case=True).first().name == "C" and navigate.find_section(s, ["B"]).count() == 0
    assert {r.name: r.text for r in navigate.text_view(s.where("section_id > 0"), b, "all").collect()}["A"] == "one two\n\nthree"
    assert navigate.blocks_of_kind(b, "paragraph", s.where("name = 'A'")).count() == 2
    assert [tuple(r)[3:] for r in navigate.table_view(b, cells, ["y", "x"]).collect()] == [("", "1")]
    assert navigate.by_anchor(b, "k").first().text == "three"
    assert sorted(r.line for r in navigate.code_lines(open_table(p, "code_spans")).collect()) == [18, 19, 20]
    assert sorted(r.line for r in navigate.table_lines(b, cells).collect()) == [12, 14]
    assert navigate.list_view(b, open_table(p, "items")).first().checked
    groups = navigate.section_groups(s, {"first": ["A"]}).orderBy("section_id").collect()
    assert [(r.name, r.slot, r.is_declared) for r in groups] == [("A", "first", True), ("C", None, False)]


def test_columns_equal_the_driver_functions(spark):
    texts = ["Foo bar-BAZ", "", "--", "straße 2x", "  a  b\tc", "ÉCOLE d'été"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", c.camel_key(F.col("t")).alias("k"), c.slug(F.col("t")).alias("s"), c.word_count(F.col("t")).alias("w"), c.utf16_length(F.lit("a😀")).alias("u")).collect()
    for r in rows:
        assert (r.k, r.s, r.w, r.u) == (camel_key(r.t), slug(r.t), len(r.t.split()), 3)
    one = spark.range(1)
    get = lambda x: one.select(x.alias("x")).first().x
    assert get(c.text_count(F.lit("A b\nA  B ab"), TextSpec("requires", "a b", ignore_case=True))) == 2
    assert get(c.trailing_anchor(F.lit("x\ny ^id "))) == "id" and get(c.standalone_anchor(F.lit(" ^id"))) == "id"
    assert get(c.relevant_change(F.lit("a/.git/x.md"))) is False and get(c.relevant_change(F.lit(None).cast("string"))) is True
    assert get(c.any_glob(F.lit("a/b/c.md"), ["**/*.md"])) and not get(c.any_glob(F.lit("a/b.md"), ["*.md"])) and get(c.any_glob(F.lit("b.md"), ["**/*.{md,txt}"]))
    assert get(c.pad(c.table_cells(F.lit("| a | `b` |")), 3)) == ["a", "`b`", ""]
    assert get(c.json_path(F.array(F.lit("a"), F.lit("0"), F.lit("b")))) == "a[0].b"
    assert get(c.plural(F.lit(1), "file")) == "1 file" and get(c.join_path(F.lit("/r/"), F.lit("/a.md"))) == "/r/a.md" and get(c.unwrap(F.lit("a \n b"))) == "a b"


def test_history(spark, result):
    run, records = history.record_run(result.findings, "r1", "v", "manual", "t0", "t1")
    assert run.first().status == "findings" and run.first().error_count == 4
    assert [r.id for r in records.orderBy("id").collect()] == [f"r1-f{k}" for k in range(4)]
    runs = spark.createDataFrame([("1", "v", "a", "green"), ("2", "v", "b", "findings"), ("3", "v", "b", "running"), ("0", "w", "a", "findings")], "id string, vault_id string, started_at string, status string")
    assert {(r.vault_id, r.id) for r in history.latest(runs).collect()} == {("v", "3"), ("w", "0")}
    assert {(r.vault_id, r.previous, r.status) for r in history.transitions(runs).collect()} == {("v", "green", "findings"), ("w", "green", "findings")}
    vaults = spark.createDataFrame([("v", "V"), ("u", "U")], "id string, name string")
    states = {r.vault_id: (r.state, r.findings) for r in history.vault_status(vaults, runs, spark.createDataFrame([("2", "error")], "scan_run_id string, level string")).collect()}
    assert states == {"v": ("running", 1), "u": ("unknown", 0)}
    assert history.drift(result.findings).where("kind = 'section-removed'").count() == 2


def test_inference_accepts_its_own_corpus_and_is_deterministic(spark):
    vault = [(f"tasks/t{k}.md", f"---\nid: {k}\nkind: task\nstate: {'open' if k % 2 else 'done'}\ndue: 2024-01-0{k + 1}\ntags: [a]\n---\n# T{k}\n\n## Goal\n\n" + ("## Notes\n\n" if k % 3 else "") + "## Done\n") for k in range(6)]
    vault += [("notes/a.md", "## One\n## One\n"), ("notes/b.md", "## Two\n## One\n"), ("top.md", "## Root\n")]
    files = spark.createDataFrame(vault, "path string, source string")
    found = infer.infer(files, depth=1)
    assert sorted(found) == ["", "notes", "tasks"] and found == infer.infer(files.repartition(3), depth=1)
    props = found["tasks"]["frontmatter"]["properties"]
    assert props == {"id": {"type": "integer"}, "kind": {"const": "task"}, "state": {"enum": ["done", "open"]}, "due": {"type": "string", "format": "date"}, "tags": {"type": "array", "items": {"type": "string"}}}
    assert found["tasks"]["body"] == {"order": "recognized-relative", "additionalSections": False, "sections": [{"section": "Goal"}, {"section": "Notes", "minContains": 0, "maxContains": 1}, {"section": "Done"}]}
    for one in (found, infer.infer(files), infer.infer(files, depth=1, relax=True)):
        assert infer.check(files, infer.load_inferred(one)).count() == 0
    drifted = files.unionByName(spark.createDataFrame([("tasks/z.md", "## Goal\n")], files.schema))
    assert infer.check(drifted, infer.load_inferred(found)).count() > 0


def test_streams(spark, tmp_path):
    (tmp_path / "in" / "tasks").mkdir(parents=True)
    for path, text in FILES[:2]:
        (tmp_path / "in" / path).parent.mkdir(exist_ok=True)
        (tmp_path / "in" / path).write_text(text)
    runs = []
    query = watch.validate_stream(watch.changed_files(spark, str(tmp_path / "in")), ddl.load_config(CONFIG), lambda run, records: runs.append((run.first().error_count, records.count())), str(tmp_path / "cp"))
    query.awaitTermination(120)
    assert runs == [(3, 3)]


def test_status_edges_and_bursts_of_streams(spark, tmp_path):
    runs = [("1", "v", "2024-01-01T00:00", "green"), ("2", "v", "2024-01-01T00:01", "findings"), ("3", "v", "2024-01-01T00:02", "running"), ("4", "v", "2024-01-01T00:03", "green"), ("5", "w", "2024-01-01T00:00", "error")]
    schema = "id string, vault_id string, started_at string, status string"
    spark.createDataFrame(runs, schema).coalesce(1).write.parquet(str(tmp_path / "runs"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "runs"))
    q1 = watch.edges(stream).writeStream.format("memory").queryName("edges").outputMode("append").trigger(availableNow=True).start()
    q1.awaitTermination(120)
    assert sorted(map(tuple, spark.table("edges").collect())) == [("v", "2", "green", "findings"), ("v", "4", "findings", "green"), ("w", "5", "green", "error")]
    events = stream.select("vault_id", F.to_timestamp("started_at").alias("ts"))
    q2 = watch.debounced(events, quiet="90 seconds", late="0 seconds").writeStream.format("memory").queryName("bursts").outputMode("append").trigger(availableNow=True).start()
    q2.awaitTermination(120)
    assert spark.table("bursts").count() <= 2
    batch = history.debounce(spark.createDataFrame(runs, schema).select("vault_id", F.to_timestamp("started_at").alias("ts")), "90 seconds", "vault_id")
    assert sorted((r.vault_id, r.events) for r in batch.collect()) == [("v", 4), ("w", 1)]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n in q.QUERIES if n in q.ORACLES])
def test_query_equals_sql(spark, duck, sf_dir, name):
    df = q.QUERIES[name](spark, sf_dir)
    names = sorted(df.columns)
    got = sorted(map(str, (tuple(r) for r in df.select(names).collect())))
    rows = duck.execute(f"SELECT {', '.join(names)} FROM ({q.ORACLES[name]})").fetchall()
    assert got == sorted(map(str, rows))
