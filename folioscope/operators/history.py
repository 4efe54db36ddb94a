"""Scan history: runs, their findings, latest status, transitions and drift.

Latest-per-group is ``max_by`` or ``max`` of a struct, which is summed before the shuffle; only transitions need a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from folioscope.functions.columns import drift_kind, plane_rank, plural

RUNS = "id string, vault_id string, started_at string, finished_at string, trigger string, status string, error_count int, warn_count int, report_count int, error_message string"
RECORDS = "id string, scan_run_id string, finding_id string, level string, file_path string, line int, col int, message string"
VAULTS = "id string, name string, path string, config_path string, watch_enabled boolean, schedule string, created_at string, updated_at string"


def run_status(errors: Column, warnings: Column, failed: Column | None = None) -> Column:
    """error, findings or green."""
    out = F.when((errors > 0) | (warnings > 0), "findings").otherwise("green")
    return out if failed is None else F.when(failed, "error").otherwise(out)


def web_status(errors: Column, failed: Column | None = None) -> Column:
    """error, failed or passed."""
    out = F.when(errors > 0, "failed").otherwise("passed")
    return out if failed is None else F.when(failed, "error").otherwise(out)


def latest(runs: DataFrame, group: str = "vault_id", order: tuple[str, ...] = ("started_at", "id")) -> DataFrame:
    """The newest run of each group; ties go to the greater id."""
    rest = [c for c in runs.columns if c not in (*order, group)]
    return runs.groupBy(group).agg(F.max(F.struct(*order, *rest)).alias("_r")).select([F.col(group) if c == group else F.col(f"_r.{c}").alias(c) for c in runs.columns])


def latest_finished(runs: DataFrame, group: str = "vault_id", order: tuple[str, ...] = ("started_at", "id")) -> DataFrame:
    return latest(runs.where("status <> 'running'"), group, order)


def newest_first(runs: DataFrame, vault: str) -> DataFrame:
    return runs.where(F.col("vault_id") == vault).orderBy(F.desc("started_at"), F.desc("id"))


def vault_status(vaults: DataFrame, runs: DataFrame, records: DataFrame) -> DataFrame:
    """Each vault's state (its latest run's status, or unknown), and the findings of its latest finished run."""
    now = latest(runs).select("vault_id", F.col("status").alias("_state"), F.col("id").alias("last_run_id"), F.col("started_at").alias("last_scan_at"))
    done = latest_finished(runs).select("vault_id", F.col("id").alias("_done"))
    counts = (records.join(done, records.scan_run_id == done._done).groupBy("vault_id")
              .agg(F.count_if(F.col("level") == "error").alias("errors"), F.count_if(F.col("level") == "warn").alias("warnings"), F.count("*").alias("findings")))
    v = vaults.select(F.col("id").alias("vault_id"), "name")
    return (v.join(now, "vault_id", "left").join(counts, "vault_id", "left")
            .select("vault_id", "name", F.coalesce("_state", F.lit("unknown")).alias("state"), "last_run_id", "last_scan_at", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("errors", "warnings", "findings")]))


def transitions(runs: DataFrame, group: str = "vault_id", order: tuple[str, ...] = ("started_at", "id")) -> DataFrame:
    """Finished runs whose status differs from the one before; the first counts as coming from green."""
    w = W.partitionBy(group).orderBy(*order)
    done = runs.where("status <> 'running'").withColumn("previous", F.coalesce(F.lag("status").over(w), F.lit("green")))
    return done.where("previous <> status")


def previous_finished(runs: DataFrame, group: str = "vault_id", order: tuple[str, ...] = ("started_at", "id")) -> DataFrame:
    """Every run with the status of the latest finished run before it."""
    w = W.partitionBy(group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return runs.withColumn("previous", F.last_value(F.when(F.col("status") != "running", F.col("status")), F.lit(True)).over(w))


def notification(name: Column, status: Column, errors: Column, warnings: Column, message: Column) -> Column:
    """Title and body of what a transition tells."""
    title = F.concat(name, F.when(status == "green", " is green").when(status == "error", ": scan failed").otherwise(" has findings"))
    body = (F.when(status == "green", "All findings resolved — the vault validates clean.").when(status == "error", F.coalesce(message, F.lit("The scan could not complete.")))
            .otherwise(F.concat(plural(errors, "error"), F.lit(", "), plural(warnings, "warning"), F.lit("."))))
    return F.struct(title.alias("title"), body.alias("body"))


def drift(findings: DataFrame) -> DataFrame:
    """Error findings as drift entries: kind, target and detail."""
    at = F.when(F.col("line").isNull(), "").otherwise(F.concat(F.lit(":"), F.col("line").cast("string")))
    return findings.where("level = 'error'").select(drift_kind(F.col("id")).alias("kind"), F.concat("path", at).alias("target"), F.concat("id", F.lit(" — "), "message").alias("detail"))


def record_run(findings: DataFrame, run_id: str, vault_id: str, trigger: str, started_at: str, finished_at: str) -> tuple[DataFrame, DataFrame]:
    """A run's row, and its findings as records numbered in order: by the sorted rows' partitions, none of which holds all."""
    ordered = findings.orderBy(F.split("path", "/"), F.coalesce("line", F.lit(0)), F.coalesce("col", F.lit(0)), plane_rank(F.col("id")), "emitted")
    numbered = ordered.select("id", "level", "path", "line", "col", "message").rdd.zipWithIndex()
    records = findings.sparkSession.createDataFrame(numbered.map(lambda x: (f"{run_id}-f{x[1]}", run_id, *x[0])), RECORDS)
    c = {x: F.count_if(F.col("level") == x).cast("int") for x in ("error", "warn", "report")}
    run = findings.agg(c["error"].alias("e"), c["warn"].alias("w"), c["report"].alias("r")).select(
        F.lit(run_id).alias("id"), F.lit(vault_id).alias("vault_id"), F.lit(started_at).alias("started_at"), F.lit(finished_at).alias("finished_at"), F.lit(trigger).alias("trigger"),
        run_status(F.col("e"), F.col("w")).alias("status"), F.col("e").alias("error_count"), F.col("w").alias("warn_count"), F.col("r").alias("report_count"), F.lit(None).cast("string").alias("error_message"))
    return run, records


def live_state(events: DataFrame, by: str = "vault_id", order: str = "id") -> DataFrame:
    """What a dashboard shows of each vault, from its events (kind: running, validated, checked or error; clean: boolean).

    The state follows the last event; a check without drift shows the last validation's state.  The last results stay.
    """
    last = lambda kind, value: F.max_by(value, F.when(F.col("kind") == kind, F.col(order)))
    out = events.groupBy(by).agg(F.max_by("kind", order).alias("_k"), last("validated", F.col("clean")).alias("validated_clean"), last("checked", F.col("clean")).alias("checked_clean"))
    validated = F.when(F.col("validated_clean"), "green").otherwise("findings")
    state = (F.when(F.col("_k") == "running", "running").when(F.col("_k") == "error", "error").when(F.col("_k") == "validated", validated)
             .when(~F.col("checked_clean"), "drift").when(F.col("validated_clean").isNull(), "green").otherwise(validated))
    return out.select(by, state.alias("state"), "validated_clean", "checked_clean")


def with_live_state(vaults: DataFrame, live: DataFrame, key: str = "vault_id") -> DataFrame:
    """Registered vaults with their live state; those that have not run yet count as running."""
    return vaults.join(live, key, "left").withColumn("state", F.coalesce("state", F.lit("running")))


def as_of(events: DataFrame, by: str, ts: str, asks: Column, gives: Column, value: Column, name: str) -> DataFrame:
    """Of the events that ask, the value of the last one at or before each that gives: one window over both, no range join."""
    w = W.partitionBy(by).orderBy(ts).rangeBetween(W.unboundedPreceding, 0)
    last = F.last_value(F.when(gives, value), F.lit(True)).over(w)
    return events.where(asks | gives).withColumn(name, last).where(asks)


def replay(events: DataFrame, after: int, buffer: int = 200) -> DataFrame:
    """Events after an id, of the last ``buffer`` only."""
    return events.orderBy(F.desc("id")).limit(buffer).where(F.col("id") > after).orderBy("id")


def debounce(events: DataFrame, quiet: str, by: str, ts: str = "ts") -> DataFrame:
    """One row for each burst: it fires when ``quiet`` has passed without another event."""
    return events.groupBy(by, F.session_window(ts, quiet).alias("_w")).agg(F.count("*").alias("events"), F.min(ts).alias("first_ts")).select(by, "first_ts", F.col("_w.end").alias("fire_ts"), "events")


def tables(spark: SparkSession) -> dict[str, DataFrame]:
    """Empty tables of the history's schemas."""
    return {k: spark.createDataFrame([], v) for k, v in (("scan_runs", RUNS), ("finding_records", RECORDS), ("vaults", VAULTS))}
