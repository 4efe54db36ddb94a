"""The command line, configurations, rules over DataFrames, typed rows and live state."""

import pytest
from pyspark.sql import functions as F

from folioscope import cli
from folioscope.operators import history, rules
from folioscope.plans import ddl
from folioscope.plans.grammar import ContractError, table
from folioscope.sources.files import merge_first, page, upsert
from folioscope.sources.projection import project

CONTRACT = "mcVersion: 2\nkind: contract\nbody: {sections: [{section: Goal}]}\n"


@pytest.fixture
def vault(tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.md").write_text("---\nid: 1\n---\n## Goal\n")
    (tmp_path / "a" / "y.md").write_text("---\nid: 2\n---\n## Aim\n")
    (tmp_path / "c.yaml").write_text(CONTRACT)
    return tmp_path


def test_validate(spark, vault):
    code, text = cli.run(["validate", str(vault), "--contract", str(vault / "c.yaml")], spark)
    assert code == 1 and "a/y.md:4 error structure/section-missing" in text and "Scanned 3 files; 2 matched across 1 contract, 1 unmatched" in text
    assert cli.run(["validate", str(vault), "--contract", str(vault / "c.yaml"), "--exclude", "**/y.md", "--format", "json"], spark) == (0, "[]")
    (vault / "folioscope.yaml").write_text("mcVersion: 2\nkind: config\nrules: [{include: ['**/x.md'], contract: c.yaml}]")
    assert cli.run(["validate", str(vault)], spark)[0] == 0


def test_usage_errors(spark, vault):
    assert cli.run(["validate"], spark)[0] == 2 and cli.run(["validate", str(vault)], spark)[0] == 2
    assert cli.run(["validate", str(vault), "--config", "x", "--contract", "y"], spark)[0] == 2
    with pytest.raises(ContractError):
        ddl.inline_config(["a", "b"])


def test_init_writes_once_checks_and_finds_drift(spark, vault):
    out = vault / "folioscope.yaml"
    args = ["init", str(vault), "--out", str(out)]
    assert cli.run([*args, "--dry-run"], spark)[0] == 0 and not out.exists()
    assert cli.run(args, spark)[0] == 0 and cli.run(args, spark)[0] == 2 and cli.run([*args, "--force"], spark)[0] == 0
    assert cli.run(["init", str(vault), "--check"], spark)[0] == 0
    (vault / "a" / "z.md").write_text("## Other\n")
    assert cli.run(["init", str(vault), "--check"], spark)[0] == 1


def test_python_configurations(tmp_path):
    (tmp_path / "folioscope.config.py").write_text("from folioscope.plans.grammar import *\nconfig = CorpusConfig((Route(('*.md',), contract(), (), 'all'),))\n")
    assert ddl.find_config(str(tmp_path)).routes[0].name == "all" and ddl.find_config("/nowhere") is None


def test_rules_over_dataframes_and_typed_rows(spark):
    docs = spark.createDataFrame([(1, "---\nn: 3\ntags: [a]\n---\n## A\n\nSee [[#^x]] and [[#^y]]. ^x\n\n| k | v |\n|---|---|\n| a | 2 |\n| b |\n")], "doc_id int, source string")
    p = project(docs)
    (f,) = rules.apply(p, [rules.dead_anchor_rule()]).collect()
    assert (f.id, f.line, f.message) == ("links/dead-anchor", 7, "there is no ^y")
    c = ddl.load_contract("mcVersion: 2\nkind: contract\nfrontmatter: {type: object, properties: {n: {type: integer}, tags: {type: array, items: {type: string}}, x: {type: string}}}")
    assert rules.typed_frontmatter(p, c).first()[1:] == (3, ["a"], None)
    rows = rules.typed_table(p, table(["k", "v"]), {"v": lambda x: F.nullif(x, F.lit("")).cast("int")}).orderBy("row_idx").collect()
    assert [(r.k, r.v) for r in rows] == [("a", 2), ("b", None)]


def test_live_state(spark):
    events = spark.createDataFrame([(1, "a", "running", None), (2, "b", "validated", False), (3, "b", "checked", True), (4, "c", "checked", True), (5, "d", "validated", True), (6, "d", "checked", False), (7, "e", "error", None)], "id int, vault_id string, kind string, clean boolean")
    live = history.live_state(events)
    assert {r.vault_id: r.state for r in live.collect()} == {"a": "running", "b": "findings", "c": "green", "d": "drift", "e": "error"}
    vaults = spark.createDataFrame([("a",), ("z",)], "vault_id string")
    assert {r.vault_id: r.state for r in history.with_live_state(vaults, live).collect()} == {"a": "running", "z": "running"}


def test_entities(spark):
    a = spark.createDataFrame([(1, "x", 5), (2, "y", 6)], "id int, name string, n int")
    patch = spark.createDataFrame([(2, None, 7), (3, "z", None)], "id int, name string, n int")
    assert sorted(map(tuple, upsert(a, patch).collect())) == [(1, "x", 5), (2, "y", 7), (3, "z", None)]
    assert [r.id for r in page(a, 1, 1).collect()] == [2]
    assert sorted(map(tuple, merge_first(a, patch.fillna("q"), key="id").select("id", "name").collect())) == [(1, "x"), (2, "y"), (3, "z")]
    assert set(history.tables(spark)) == {"scan_runs", "finding_records", "vaults"}


def test_small_tables_are_replaced_and_paths_stay_inside(spark, tmp_path):
    from folioscope import api

    path = str(tmp_path / "vaults")
    assert api.load_table(spark, path, "id int, name string").count() == 0
    for rows in ([(1, "a")], [(1, "b"), (2, "c")]):
        api.save_table(spark.createDataFrame(rows, "id int, name string"), path)
        assert sorted(map(tuple, api.load_table(spark, path, "id int, name string").collect())) == rows
    assert api.resolve_inside(str(tmp_path), "a/../b.md").endswith("/b.md")
    with pytest.raises(ValueError):
        api.resolve_inside(str(tmp_path), "../x")


def test_presets_and_builders():
    from folioscope import api

    body = api.strict_body(api.section("A"), api.optional_section("B"), api.gap(max=1))
    assert (body.order, body.allow_unknown, body.slots[1].optional) == ("strict", False, True)
    c = api.contract(body=api.lenient_body(api.one_of(["X", "Y"], content=api.table(["a"], cells={"a": api.Schema(enum=("1",))}))), text=[api.requires("done")])
    assert [f.id.split("/")[0] for f in api.validate_text("## Y\n\n| a |\n|---|\n| 2 |\n", c)] == ["text", "content"]
    assert api.match_text("so so", api.forbids("so")) == [(1, 1), (1, 4)]
