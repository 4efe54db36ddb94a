"""What the engine does where it must not gather everything in one place: tables, records, facts, schedules."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from folioscope.operators import history, infer
from folioscope.operators.validate import validate_corpus
from folioscope.plans.ddl import load_contract
from folioscope.plans.grammar import ContractError, CorpusConfig, Route
from folioscope.sources import files
from folioscope.streaming import watch
from folioscope.streaming.schedule import Cron, due


def test_tables_are_replaced_by_a_pointer(spark, tmp_path):
    path = str(tmp_path / "t")
    assert files.load_table(spark, path, "k int").count() == 0
    first = None
    for n in range(1, 5):
        files.save_table(spark.range(n).selectExpr("cast(id AS int) AS k"), path)
        now = files.load_table(spark, path, "k int")
        assert now.count() == n and (first is None or first.count() == n - 1)  # who has begun to read the version before can go on
        first = now
    assert len([x for x in (tmp_path / "t").iterdir() if x.name.startswith("v-")]) == 2
    # a version that was written but never pointed at is not read
    spark.range(99).selectExpr("cast(id AS int) AS k").write.parquet(f"{path}/v-99999999999999999999")
    assert files.load_table(spark, path, "k int").count() == 4


def found(spark, n):
    docs = [(f"d{k % 7}/f{k:03d}.md", "## B\n\n## B\n" if k % 3 else "## A\n") for k in range(n)]
    contract = load_contract("mcVersion: 2\nkind: contract\nbody: {sections: [{section: A}]}")
    return validate_corpus(spark.createDataFrame(docs, "path string, source string").repartition(5), CorpusConfig((Route(("**/*.md",), contract, (), "all"),)))


def test_records_are_numbered_in_order(spark):
    result = found(spark, 60)
    run, records = history.record_run(result.findings.repartition(6), "r", "v", "manual", "a", "b")
    got = sorted(records.collect(), key=lambda r: int(r.id[3:]))
    assert [r.id for r in got] == [f"r-f{k}" for k in range(80)]
    assert [(r.file_path, r.finding_id) for r in got] == [(r.path, r.id) for r in result.ordered().collect()]
    assert records.columns == [x.split()[0] for x in history.RECORDS.split(", ")] and run.first().error_count == 80


def test_streamed_runs_have_times_and_sort_by_their_ids(spark, tmp_path):
    runs = []
    source = tmp_path / "in"
    source.mkdir()
    for k in range(11):
        (source / f"{k:02d}.md").write_text("## B\n")
    contract = load_contract("mcVersion: 2\nkind: contract\nbody: {sections: [{section: A}]}")
    stream = watch.changed_files(spark, str(source), 1)
    query = watch.validate_stream(stream, CorpusConfig((Route(("**/*.md",), contract, (), "all"),)), lambda run, records: runs.append((run.first(), records.count())), str(tmp_path / "c"))
    query.awaitTermination(240)
    assert len(runs) == 11 and sorted(r.id for r, _ in runs) == [r.id for r, _ in runs] and all(r.started_at <= r.finished_at and r.started_at > "2020" for r, _ in runs)
    latest = history.latest(spark.createDataFrame([r for r, _ in runs], history.RUNS)).first()
    assert latest.id == runs[-1][0].id and all(n == 1 for _, n in runs)


def test_values_of_a_key_stop_at_the_most_of_an_enum(spark):
    docs = spark.createDataFrame([(k, "g") for k in range(40)], "doc_id int, grp string")
    kv = docs.select("doc_id", F.explode(F.array(F.array(F.lit("few")), F.array(F.lit("many")))).alias("path"), "grp").withColumn("ord", F.lit(0)).withColumn("json_type", F.lit("string"))
    kv = kv.withColumn("value", F.concat(F.lit('"'), F.when(F.col("path")[0] == "few", F.col("doc_id") % 12).otherwise(F.col("doc_id")).cast("string"), F.lit('"')))
    facts = {r.key: r for r in infer.field_facts(kv, docs).collect()}
    assert facts["few"]["values"] == [f'"{k}"' for k in range(12)] and facts["few"].distinct_values == 12
    assert facts["many"]["values"] is None and facts["many"].distinct_values == 40


def test_corpora_that_are_too_free_are_refused(spark, monkeypatch):
    monkeypatch.setattr(infer, "MAX_NAMES", 5)
    docs = spark.createDataFrame([(f"{k}.md", f"## H{k}\n") for k in range(8)], "path string, source string")
    with pytest.raises(ContractError, match="headings"):
        infer.infer(docs)
    assert set(infer.infer(docs.limit(5))) == {""}


def test_orders_that_conflict_and_merged_spellings(spark):
    docs = spark.createDataFrame([("a/x.md", "## One\n## Two\n"), ("a/y.md", "## Two\n## One\n"), ("b/x.md", "## One\n## Two\n"), ("b/y.md", "## one\n## Two\n"), ("z.md", "")], "path string, source string")
    out = infer.infer(docs, depth=1)
    assert out["a"]["body"]["order"] == "none" and out["b"]["body"]["order"] != "none"
    sections = spark.createDataFrame([("a", "x", 0, "Big Plan", 0), ("a", "y", 0, "big-plan", 0), ("b", "z", 0, "Big Plan", 0)], "grp string, doc_id string, parent_id int, name string, ord int")
    assert [(r.grp, r.key, r.names) for r in infer.alias_merges(sections).collect()] == [("a", "bigPlan", ["Big Plan", "big-plan"])]
    assert sorted(r.path for r in infer.stranded(spark.createDataFrame([("a/b/c.md",), ("a/c.md",), ("c.md",), ("a/c.txt",)], "path string"), 2).collect()) == ["a/c.md"]


@pytest.mark.parametrize(
    ("text", "after", "want"),
    [("*/15 * * * *", "2024-02-28T23:50", "2024-02-29T00:00"), ("0 0 29 2 *", "2024-03-01T00:00", "2028-02-29T00:00"), ("30 6 * * 1-5", "2024-03-01T06:30", "2024-03-04T06:30"), ("5 4 1 * 7", "2024-03-02T00:00", "2024-03-03T04:05"),
     ("0 12 1,15 * *", "2024-03-01T12:00", "2024-03-15T12:00"), ("10-20/5 3 * 12 *", "2024-12-31T03:16", "2024-12-31T03:20"), ("0 0 30 2 *", "2024-01-01T00:00", None), ("7/20 * * * *", "2024-01-01T00:08", "2024-01-01T00:27")],
)
def test_schedules(text, after, want):
    assert Cron.parse(text).next(datetime.fromisoformat(after)) == (want and datetime.fromisoformat(want))


@pytest.mark.parametrize("text", ["", "* * * *", "60 * * * *", "* 24 * * *", "* * 0 * *", "a * * * *", "5-1 * * * *", "*/0 * * * *", "* * * 13 *", "* * * * 8"])
def test_wrong_schedules(text):
    with pytest.raises(ValueError, match=r".*"):
        Cron.parse(text)


def test_what_is_due(spark):
    vaults = spark.createDataFrame([("a", "0 * * * *"), ("b", "0 5 * * *"), ("c", None), ("d", "no")], "id string, schedule string")
    at = lambda x: F.to_timestamp(F.lit(x))
    assert [r.id for r in due(vaults, at("2024-01-01 03:30:00"), at("2024-01-01 04:10:00")).collect()] == ["a"]
