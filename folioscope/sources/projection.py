"""Documents to tables: one Arrow pass parses each document, everything after is ``inline``.

``project`` gives a row for each document with arrays; the table functions open one array each.  Keep the projection
(``persist``) to read several tables from one parse.  No function shuffles.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import accumulate
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from .document import Document, parse, references

SECTION = "section_id int, parent_id int, ord int, name string, depth int, line int, col int, subtree_end int, anchors array<string>, scope_text string"
BLOCK = "section_id int, block_id int, ord int, kind string, line int, col int, anchor string, lang string, text string, ordered boolean, columns array<string>, spans array<struct<sl:int,sc:int,el:int,ec:int,raw:string>>"
CELL = "block_id int, row_idx int, col_idx int, col_name string, value string, line int, col int"
ITEM = "block_id int, idx int, text string, checked boolean, line int, col int"
KEY = "path array<string>, ord int, json_type string, value string, line int"
REF = "kind string, target string, fragment string, alias string, raw string, section_id int, line int"
CODE = "first int, last int"
ARRAYS = {"sections": SECTION, "blocks": BLOCK, "cells": CELL, "items": ITEM, "frontmatter_kv": KEY, "refs": REF, "code_spans": CODE}
#: Asked for by name only: each table block with its rows in one row, and the anchors of sections below the root and of their blocks.
GRID = "section_id int, block_id int, line int, col int, anchor string, columns array<string>, row_lines array<int>, rows array<array<string>>"
ANCHOR = "section_id int, anchor string"
NESTED = ARRAYS | {"grids": GRID, "anchors": ANCHOR}


def rows_of(doc: Document, tables: tuple[str, ...] = tuple(ARRAYS), scope_text: bool = True) -> dict[str, list[tuple]]:
    """The rows of the tables asked for, sections in pre-order."""
    from folioscope.functions.schema import type_name

    out: dict[str, list[tuple]] = {k: [] for k in tables}
    sections, blocks, grids, cells, items, refs, anchors = map(out.get, ("sections", "blocks", "grids", "cells", "items", "refs", "anchors"))
    ids = block = 0

    def walk(s, parent: int, ord_: int) -> int:
        nonlocal ids, block
        own = ids
        ids += 1
        at = len(sections) if sections is not None else 0
        if sections is not None:
            sections.append(())
        if anchors is not None and own:
            anchors.extend((own, a) for a in s.anchors)
        for k, b in enumerate(s.blocks):
            if blocks is not None:
                blocks.append((own, block, k, b.kind, b.line, b.column, b.anchor, b.lang, None if b.kind in ("list", "table") else b.text, b.ordered, b.columns or None, [dict(zip(("sl", "sc", "el", "ec", "raw"), x, strict=True)) for x in b.spans]))
            if grids is not None and b.kind == "table":
                grids.append((own, block, b.line, b.column, b.anchor, b.columns or None, b.row_lines, b.rows))
            if cells is not None:
                for r, (row, line, cols) in enumerate(zip(b.rows, b.row_lines, b.cell_columns, strict=True)):
                    cells.extend((block, r, c, b.columns[c] if c < len(b.columns) else None, v, line, cols[c]) for c, v in enumerate(row))
            if items is not None:
                items.extend((block, k, i.text, i.checked, i.line, i.column) for k, i in enumerate(b.items))
            if refs is not None:
                for line, text in b.placed():
                    if "[[" in text or "\\[" in text:
                        refs.extend((*x.values(), own, line) for x in references(text))
            block += 1
        last = own
        for k, c in enumerate(s.sections):
            last = walk(c, own, k)
        if sections is not None:
            sections[at] = (own, parent, ord_, s.name, s.depth, s.line, s.column, last, s.anchors, s.scope_text() if scope_text else None)
        return last

    walk(doc.root, -1, 0)

    def keys(value: Any, path: tuple) -> None:
        inner = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
        if path:
            out["frontmatter_kv"].append((list(map(str, path)), len(out["frontmatter_kv"]), type_name(value), json.dumps(value, ensure_ascii=False, sort_keys=True, default=str), doc.line_of(path)))
        for k, v in inner:
            keys(v, (*path, k))

    if "frontmatter_kv" in out:
        keys(doc.frontmatter, ())
    if "code_spans" in out:
        out["code_spans"] = doc.code_lines
    return out


def project(docs: DataFrame, key: str = "doc_id", source: str = "source", tables: tuple[str, ...] = tuple(ARRAYS), scope_text: bool = True) -> DataFrame:
    """key, title, has_frontmatter, frontmatter (JSON) and the arrays of the tables asked for; null sources are empty documents.

    Without ``scope_text`` that column of the sections is null.
    """
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, title string, has_frontmatter boolean, frontmatter string, " + ", ".join(f"{k} array<struct<{_nested(NESTED[k])}>>" for k in tables)
    types = {k: to_arrow_type(_parse_datatype_string(f"array<struct<{_nested(NESTED[k])}>>")).value_type for k in tables}

    def column(name: str, rows: list[list[tuple]]) -> pa.Array:
        kind = types[name]
        flat = [r for x in rows for r in x]
        fields = list(zip(*flat, strict=True)) if flat else [()] * kind.num_fields
        inner = pa.StructArray.from_arrays([pa.array(v, kind.field(k).type) for k, v in enumerate(fields)], fields=[kind.field(k) for k in range(kind.num_fields)])
        return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, rows))], pa.int32()), inner)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = [parse(x or "") for x in batch.column(1).to_pylist()]
            rows = [rows_of(d, tables, scope_text) for d in docs]
            front = [json.dumps(d.frontmatter, ensure_ascii=False, default=str) if d.has_frontmatter else None for d in docs]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([d.title for d in docs], pa.string()), pa.array([d.has_frontmatter for d in docs], pa.bool_()), pa.array(front, pa.string()), *(column(k, [r[k] for r in rows]) for k in tables)],
                [key, "title", "has_frontmatter", "frontmatter", *tables])

    return docs.select(key, source).mapInArrow(run, schema)


def _columns(text: str) -> list[str]:
    out, depth, begin = [], 0, 0
    for k, ch in enumerate(text):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(text[begin:k].strip())
            begin = k + 1
    return [*out, text[begin:].strip()]


def _nested(text: str) -> str:
    return ",".join(f"{c.split(None, 1)[0]}:{c.split(None, 1)[1]}" for c in _columns(text))


def open_table(projection: DataFrame, name: str, key: str = "doc_id") -> DataFrame:
    """sections, blocks, cells, items, frontmatter_kv, refs, code_spans, grids or anchors of a projection, with the document's key.

    Each table opened takes a pass over the projection's documents, unless it is kept; what is asked of one document at a time can be
    had in one pass (``navigate.grid_rows``, ``navigate.dead_references_within``, ``relational.content_within``).
    """
    return projection.select(key, F.inline(name))
