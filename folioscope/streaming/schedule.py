"""Schedules: five-field cron expressions, what is due, and one sweep over all vaults."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.operators.history import run_status
from folioscope.operators.validate import validate_corpus
from folioscope.plans.grammar import CorpusConfig

#: Each field's least and greatest number.
FIELDS = {"minute": (0, 59), "hour": (0, 23), "day": (1, 31), "month": (1, 12), "weekday": (0, 7)}


@dataclass(frozen=True)
class Cron:
    """Minutes at which something is to happen; 0 and 7 are both Sunday, and of day and weekday one is enough if both are restricted."""

    allowed: tuple[frozenset[int], ...]
    free: tuple[bool, ...]

    @staticmethod
    def parse(text: str) -> Cron:
        """ValueError unless each field is ``*``, numbers, ranges and steps, separated by commas."""
        parts = text.split()
        if len(parts) != len(FIELDS):
            raise ValueError(f"{text!r}: a schedule has {len(FIELDS)} fields")
        out = []
        for part, (name, (least, most)) in zip(parts, FIELDS.items(), strict=True):
            numbers: set[int] = set()
            for item in part.split(","):
                span, _, step = item.partition("/")
                first, dash, last = span.partition("-")
                try:
                    a, b = (least, most) if span == "*" else (int(first), int(last) if dash else most if step else int(first))
                    every = int(step) if step else 1
                except ValueError:
                    raise ValueError(f"{text!r}: {item!r} is no {name}") from None
                if not least <= a <= b <= most or every < 1:
                    raise ValueError(f"{text!r}: {item!r} is out of range for {name}")
                numbers |= set(range(a, b + 1, every))
            out.append(frozenset(n % 7 for n in numbers) if name == "weekday" else frozenset(numbers))
        return Cron(tuple(out), tuple(p == "*" for p in parts))

    def _day(self, at: datetime) -> bool:
        _, _, days, months, weekdays = self.allowed
        day, weekday = at.day in days, at.isoweekday() % 7 in weekdays
        return at.month in months and (day and weekday if self.free[2] or self.free[4] else day or weekday)

    def next(self, after: datetime) -> datetime | None:
        """The first minute after, within eight years; None if there is none (the 30th of February)."""
        minutes, hours = sorted(self.allowed[0]), sorted(self.allowed[1])
        start = after.replace(second=0, microsecond=0) + timedelta(minutes=1)
        for k in range(8 * 366):
            day = (start + timedelta(days=k)).replace(hour=0, minute=0) if k else start
            if self._day(day):
                for h in hours:
                    for m in minutes:
                        if (at := day.replace(hour=h, minute=m)) >= start:
                            return at
        return None


def next_runs(vaults: DataFrame, after: Column, schedule: str = "schedule") -> DataFrame:
    """Vaults with ``next_run``, the first time that their schedule names after ``after``; null without a valid schedule."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vaults.schema) + ", next_run timestamp"

    def run(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, Cron | None] = {}
        for page in pages:
            out = []
            for text, at in zip(page[schedule], page.pop("_after"), strict=True):
                if text not in known:
                    try:
                        known[text] = Cron.parse(text) if isinstance(text, str) else None
                    except ValueError:
                        known[text] = None
                out.append(known[text].next(at.to_pydatetime()) if known[text] and not pd.isna(at) else None)
            yield page.assign(next_run=pd.Series(out, index=page.index, dtype="datetime64[ns]"))

    return vaults.withColumn("_after", after).mapInPandas(run, schema)


def due(vaults: DataFrame, since: Column, now: Column) -> DataFrame:
    """Vaults whose schedule names a time after ``since`` and up to ``now``."""
    return next_runs(vaults, since).where(F.col("next_run") <= now)


def sweep(files: DataFrame, config: CorpusConfig, vault: str = "vault_id") -> DataFrame:
    """One batch over the files (vault_id, path, source) of all vaults: a run's counts and status for each vault, those without findings too."""
    found = validate_corpus(files.select(F.col(vault).alias("_vault"), "path", "source"), config, key="_vault").findings
    count = {x: F.count_if(F.col("level") == x).cast("int").alias(f"{x}_count") for x in ("error", "warn", "report")}
    per = found.groupBy("_vault").agg(*count.values())
    all_ = files.select(F.col(vault)).distinct()
    out = all_.join(per, all_[vault] == per["_vault"], "left").select(vault, *[F.coalesce(f"{x}_count", F.lit(0)).alias(f"{x}_count") for x in count])
    return out.withColumn("status", run_status(F.col("error_count"), F.col("warn_count")))
