"""Validation of documents and of corpora: findings as rows.

Routing is an expression over the path, so files without a rule are dropped before their text is looked at.  Parsing and all
planes are one narrow Arrow pass; nothing is shuffled but by the caller's own grouping or ordering.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.columns import any_glob, plane_rank
from folioscope.plans.grammar import Contract, ContractError, CorpusConfig

from .planes import iter_findings

FINDINGS = ["path string", "id string", "level string", "line int", "col int", "message string", "hint string", "emitted int"]
_TYPES = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32()]
_NAMES = [f.split()[0] for f in FINDINGS][1:]


def _run(contracts: tuple[Contract, ...], key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for k, (source, rule) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                for f in iter_findings(source, contracts[rule]):
                    rows.append(k)
                    found.append((f.id, f.level, f.line, f.col, f.message, f.hint, f.emitted))
            columns = zip(*found, strict=True) if found else [()] * len(_TYPES)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True))], [key, *_NAMES])

    return run


def validate(docs: DataFrame, contract: Contract, key: str = "doc_id", source: str = "source") -> DataFrame:
    """Findings of every document under one contract, with the document's key."""
    schema = ", ".join([f"`{key}` {docs.schema[key].dataType.simpleString()}", *FINDINGS[1:]])
    return docs.select(key, source, F.lit(0)).mapInArrow(_run((contract,), key), schema)


def route(path: Column, config: CorpusConfig) -> Column:
    """Number of the first rule whose include patterns match a path and whose exclude patterns do not; null: none."""
    passes = F.lit(True)
    if config.include:
        passes = passes & any_glob(path, config.include)
    if config.exclude:
        passes = passes & ~any_glob(path, config.exclude)
    out = F.lit(None).cast("int")
    for k, r in reversed(list(enumerate(config.routes))):
        hit = any_glob(path, r.include)
        if r.exclude:
            hit = hit & ~any_glob(path, r.exclude)
        out = F.when(hit, F.lit(k)).otherwise(out)
    return F.when(passes, out)


@dataclass
class CorpusResult:
    """Findings of a corpus and its statistics, both lazy."""

    findings: DataFrame
    routed: DataFrame  # path, rule
    config: CorpusConfig

    def ordered(self) -> DataFrame:
        return order(self.findings)

    def stats(self) -> DataFrame:
        """files_scanned, files_matched and files_unmatched."""
        return self.routed.agg(F.count("*").alias("files_scanned"), F.count("rule").alias("files_matched"), F.count_if(F.col("rule").isNull()).alias("files_unmatched"))

    def matched_by_rule(self) -> DataFrame:
        """rule, name and files of every rule, those without files too."""
        spark = self.routed.sparkSession
        rules = spark.createDataFrame([(k, r.name) for k, r in enumerate(self.config.routes)], "rule int, name string")
        counts = self.routed.where("rule IS NOT NULL").groupBy("rule").agg(F.count("*").alias("files"))
        return rules.join(counts, "rule", "left").select("rule", "name", F.coalesce("files", F.lit(0)).alias("files"))

    def exit_code(self) -> int:
        return 1 if self.findings.where("level = 'error'").limit(1).count() else 0


def validate_corpus(files: DataFrame, config: CorpusConfig, key: str = "path") -> CorpusResult:
    """Findings of (path, source) under the first rule that takes each file; ``key``: the column that findings carry."""
    routed = files.withColumn("rule", route(F.col("path"), config))
    contracts = tuple(r.contract for r in config.routes)
    schema = ", ".join([f"`{key}` {files.schema[key].dataType.simpleString()}", *FINDINGS[1:]])
    findings = routed.where("rule IS NOT NULL").select(key, "source", "rule").mapInArrow(_run(contracts, key), schema)
    return CorpusResult(findings, routed.select("path", "rule"), config)


def order(findings: DataFrame, key: str = "path") -> DataFrame:
    """Walk order of files, then line, column, plane and emission, missing lines and columns first."""
    first = F.split(key, "/") if key == "path" else F.col(key)
    return findings.orderBy(first, F.coalesce("line", F.lit(0)), F.coalesce("col", F.lit(0)), plane_rank(F.col("id")), "emitted")


def read(docs: DataFrame, contract: Contract, key: str = "doc_id", source: str = "source", strict: bool = False) -> DataFrame:
    """The documents without error findings; ``strict`` raises if any has one."""
    errors = validate(docs, contract, key, source).where("level = 'error'")
    if strict and (found := errors.limit(20).collect()):
        raise ContractError(f"{len(found)} or more error findings bar the read", findings=found)
    bad = errors.select(key).distinct()
    return docs.join(bad, key, "left_anti")
