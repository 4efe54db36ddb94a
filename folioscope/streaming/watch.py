"""Watching a folder: file events, debounced, validated in micro-batches and added to the history."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folioscope.functions.columns import relevant_change
from folioscope.operators.history import record_run
from folioscope.operators.validate import validate_corpus
from folioscope.plans.grammar import CorpusConfig

QUIET = "300 milliseconds"


def changed_files(spark: SparkSession, folder: str, per_trigger: int = 10_000) -> DataFrame:
    """A stream of path and source of new files that matter."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(folder)
    base = folder.rstrip("/") + "/"
    path = F.expr(f"substring(path, instr(path, '{base}') + {len(base)})")
    return raw.where(relevant_change(path)).select(path.alias("path"), F.decode("content", "UTF-8").alias("source"), F.col("modificationTime").alias("ts"))


def debounced(events: DataFrame, by: str = "vault_id", quiet: str = QUIET, late: str = "10 seconds") -> DataFrame:
    """Bursts of a stream of events; the watermark is ours, for the reference of time is the event's own."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", quiet).alias("_w"), by).agg(F.count("*").alias("events")).select(by, F.col("_w.end").alias("fire_ts"), "events")


def _now() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z")


def validate_stream(files: DataFrame, config: CorpusConfig, sink: Callable[[DataFrame, DataFrame], None], checkpoint: str, vault: str = "vault", available_now: bool = True) -> StreamingQuery:
    """Each micro-batch is one run: ``sink`` gets its row and its records, once for each batch id."""

    def batch(df: DataFrame, number: int) -> None:
        began = _now()
        found = validate_corpus(df, config).findings.persist()
        try:
            found.count()
            sink(*record_run(found, f"{vault}-{number:012d}", vault, "watch", began, _now()))  # ids sort as their numbers do
        finally:
            found.unpersist()

    writer = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def edges(runs: DataFrame) -> DataFrame:
    """Status changes of a stream of finished runs (vault_id, id, started_at, status), from green at first."""

    def step(key: tuple, pages: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last: Any = state.get[0] if state.exists else "green"
        rows = []
        for page in pages:
            for r in page.sort_values(["started_at", "id"]).itertuples():
                if r.status != "running" and r.status != last:
                    rows.append((key[0], r.id, last, r.status))
                    last = r.status
        state.update((last,))
        yield pd.DataFrame(rows, columns=["vault_id", "id", "previous", "status"])

    return runs.groupBy("vault_id").applyInPandasWithState(step, "vault_id string, id string, previous string, status string", "status string", "append", GroupStateTimeout.NoTimeout)
