"""Findings as text, JSON and SARIF, counts and filters."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.columns import in_area, plural, sarif_level

from .validate import CorpusResult, order


def count_by_level(findings: DataFrame, *by: str) -> DataFrame:
    """error, warn and report, all three always there."""
    counts = [F.count_if(F.col("level") == x).alias(x) for x in ("error", "warn", "report")]
    return findings.groupBy(*by).agg(*counts) if by else findings.agg(*counts)


def has_errors(findings: DataFrame) -> bool:
    return findings.where("level = 'error'").limit(1).count() > 0


def filter_findings(findings: DataFrame, area: str | None = None, ids: list[str] | None = None) -> DataFrame:
    if area is not None:
        findings = findings.where(in_area(F.col("id"), area))
    return findings if ids is None else findings.where(F.col("id").isin(ids))


def location(path: str = "path") -> Column:
    return F.when(F.col("line").isNull(), F.col(path)).otherwise(F.concat(F.col(path), F.lit(":"), F.col("line").cast("string")))


def line_text(path: str = "path") -> Column:
    return F.concat(location(path), F.lit(" "), F.col("level"), F.lit(" "), F.col("id"), F.lit(" — "), F.col("message"))


def full_text(path: str = "path") -> Column:
    return F.concat(line_text(path), F.when(F.col("hint").isNull(), "").otherwise(F.concat(F.lit("\n  hint: "), F.col("hint"))))


def by_file(findings: DataFrame) -> DataFrame:
    """path and its findings by line and column."""
    entry = F.struct(F.coalesce("line", F.lit(0)).alias("l"), F.coalesce("col", F.lit(0)).alias("c"), "emitted", "id", "level", "line", "col", "message", "hint")
    return findings.groupBy("path").agg(F.sort_array(F.collect_list(entry)).alias("found")).select("path", F.transform("found", lambda x: x.dropFields("l", "c", "emitted")).alias("findings"))


def distinct_ids(findings: DataFrame) -> DataFrame:
    """Finding ids and the first file and place of each."""
    return findings.groupBy("id").agg(F.min(F.struct(F.split("path", "/").alias("at"), F.coalesce("line", F.lit(0)).alias("line"), F.coalesce("col", F.lit(0)).alias("col"), "emitted")).alias("first"))


def render_human(findings: DataFrame) -> str:
    """The report a person reads; for results that fit on one screen or file."""
    rows = order(findings).select(full_text().alias("t")).toLocalIterator()
    text = [r.t for r in rows]
    if not text:
        return "No findings."
    c = count_by_level(findings).first()
    return "\n".join([*text, "", f"{len(text)} finding(s): {c.error} error, {c.warn} warn, {c.report} report"])


def as_json(findings: DataFrame) -> DataFrame:
    """A JSON object for each finding; missing fields have no key."""
    at = F.when(F.col("line").isNotNull(), F.struct("line", "col"))
    return order(findings).select(F.to_json(F.struct("id", "level", "path", "message", "hint", at.alias("pos"))).alias("json"))


def render_json(findings: DataFrame) -> str:
    return json.dumps([json.loads(r.json) for r in as_json(findings).toLocalIterator()], indent=2, ensure_ascii=False)


def render_sarif(findings: DataFrame, tool: str = "folioscope") -> str:
    rows = order(findings).select("id", sarif_level(F.col("level")).alias("level"), "path", "line", "col", "message", "hint").toLocalIterator()
    rules, results = {}, []
    for r in rows:
        rules.setdefault(r.id, {"id": r.id})
        place: dict = {"artifactLocation": {"uri": r.path}}
        if r.line is not None:
            place["region"] = {"startLine": r.line} | ({"startColumn": r.col} if r.col is not None else {})
        results.append({"ruleId": r.id, "level": r.level, "message": {"text": r.message}, "locations": [{"physicalLocation": place}]} | ({"properties": {"hint": r.hint}} if r.hint is not None else {}))
    return json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": {"name": tool, "rules": list(rules.values())}}, "results": results}]}, indent=2, ensure_ascii=False)


def run_summary(result: CorpusResult) -> str:
    s = result.stats().select("*", plural(F.col("files_scanned"), "file").alias("files")).first()
    named = [r for r in result.matched_by_rule().orderBy("rule").collect() if r.name is not None]
    across = f" across {len(named)} contract{'' if len(named) == 1 else 's'}" if named else ""
    return "\n".join([f"Scanned {s.files}; {s.files_matched} matched{across}, {s.files_unmatched} unmatched", *(f"  {r.name}: {r.files}" for r in named)])
