"""Rules of one's own over DataFrames: tables of a projection to findings, and typed rows of contract tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, LongType, StringType, StructField, StructType

from folioscope.plans.grammar import Contract, Schema, Table
from folioscope.sources.projection import open_table

from .navigate import anchors, dead_references, table_view

Rule = Callable[[dict[str, DataFrame]], DataFrame]


def tables_of(projection: DataFrame, key: str = "doc_id") -> dict[str, DataFrame]:
    return {name: open_table(projection, name, key) for name in ("sections", "blocks", "cells", "items", "frontmatter_kv", "refs", "code_spans")}


def finding(id: str, message: Column | str, level: str = "error", line: Column | None = None, col: Column | None = None, hint: str | None = None) -> list[Column]:  # noqa: A002
    """The columns of a finding, for a rule's select."""
    message = F.lit(message) if isinstance(message, str) else message
    return [F.lit(id).alias("id"), F.lit(level).alias("level"), (F.lit(None) if line is None else line).cast("int").alias("line"), (F.lit(None) if col is None else col).cast("int").alias("col"), message.alias("message"), F.lit(hint).cast("string").alias("hint"), F.lit(1 << 20).alias("emitted")]


def apply(projection: DataFrame, rules: list[Rule], key: str = "doc_id") -> DataFrame:
    """Findings of every rule; a rule gets the tables by name and gives the key and ``finding`` columns."""
    tables, out = tables_of(projection, key), None
    for rule in rules:
        found = rule(tables)
        out = found if out is None else out.unionByName(found)
    return out


def dead_anchor_rule(key: str = "doc_id") -> Rule:
    """References to anchors that their own document does not have."""

    def rule(t: dict[str, DataFrame]) -> DataFrame:
        dead = dead_references(t["refs"], anchors(t["sections"], t["blocks"], key), key)
        return dead.select(key, *finding("links/dead-anchor", F.concat(F.lit("there is no ^"), F.col("anchor")), line=F.col("line")))

    return rule


def struct_type(schema: Schema | None) -> DataType:
    """The Spark type of values that a schema admits."""
    if schema is None or schema.enum is not None:
        return StringType()
    if schema.has_const:
        return BooleanType() if isinstance(schema.const, bool) else DoubleType() if isinstance(schema.const, (int, float)) else StringType()
    if schema.type == "object":
        return StructType([StructField(n, struct_type(s), n not in schema.required or s.nullable) for n, s in schema.properties])
    if schema.type == "array":
        return ArrayType(struct_type(schema.items))
    return {"integer": LongType(), "number": DoubleType(), "boolean": BooleanType()}.get(schema.type, StringType())


def typed_frontmatter(projection: DataFrame, contract: Contract, key: str = "doc_id") -> DataFrame:
    """Each document's frontmatter as the columns of its contract; values of other types are null."""
    kind = struct_type(contract.frontmatter)
    return projection.select(key, F.from_json(F.coalesce("frontmatter", F.lit("{}")), kind).alias("_f")).select(key, "_f.*")


def typed_table(projection: DataFrame, leaf: Table, transforms: dict[str, Callable[[Column], Column]] | None = None, anchor: str | None = None, key: str = "doc_id") -> DataFrame:
    """Rows of a contract's table, with columns transformed where a transform is given."""
    rows = table_view(open_table(projection, "blocks", key), open_table(projection, "cells", key), list(leaf.columns), anchor=anchor or leaf.anchor, key=key)
    return rows.select([(transforms[c](F.col(c)).alias(c) if transforms and c in transforms else F.col(c)) for c in rows.columns])
