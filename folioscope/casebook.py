"""Small texts and what each contract finds in them, dealt over the orders: a query and its SQL for each case list.

Order number k gets the text k modulo the number of texts; what is expected of it is written down by hand, so the SQL knows
nothing of the parser.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import navigate
from folioscope.operators.validate import validate
from folioscope.plans import ddl
from folioscope.sources.projection import open_table, project

#: By name: a contract, and texts with their findings (id, line).
FINDINGS: dict[str, tuple[str, list[tuple[str, list[tuple[str, int | None]]]]]] = {
    "alias_slots": ("body: {sections: [{section: Alpha, aliases: [A, First]}]}", [
        ("## Alpha\n\n## A\n", [("structure/duplicate-section", 3)]), ("## A\n", []), ("## B\n", [("structure/section-missing", 1)]),
        ("## First\n## A\n## Alpha\n", [("structure/duplicate-section", 2), ("structure/duplicate-section", 3)]), ("## Alpha\n## Alpha\n", [("structure/duplicate-section", 2)])]),
    "key_collisions": ("body: {sections: []}", [
        ("## Big Plan\n## big-plan\n", [("structure/key-collision", 2)]), ("## Big Plan\n## Big Plan\n", [("structure/duplicate-section", 2)]), ("## One\n## Two\n", []),
        ("## Big Plan\n## big-plan\n## Big Plan\n", [("structure/key-collision", 2), ("structure/duplicate-section", 3)]), ("## !!!\n## ???\n", [])]),
    "strict_walks": ("body: {order: strict, additionalSections: false, sections: [{section: A}, {gap: {min: 1, max: 2}}, {section: B}, {gap: {min: 0, max: 1}}]}", [
        ("## A\n## x\n## B\n", []), ("## A\n## B\n", [("structure/gap-count", 2)]), ("## A\n## x\n## y\n## z\n## B\n", [("structure/gap-count", 5)]),
        ("## A\n## x\n## B\n## y\n## z\n", [("structure/gap-count", None)]), ("## B\n", [("structure/section-missing", 1), ("structure/section-order", 1), ("structure/gap-count", 1)]),
        ("## x\n## A\n## y\n## B\n", [("structure/section-order", 1)])]),
    "strict_tails": ("body: {order: strict, additionalSections: false, sections: [{section: A}, {section: B, minContains: 0, maxContains: 1}, {section: C, minContains: 1}]}", [
        ("## A\n## C\n## C\n", []), ("## A\n## B\n## C\n## x\n", [("structure/section-order", 4)]), ("## A\n## C\n## B\n", []),
        ("## A\n## C\n## C\n## B\n## x\n", [("structure/section-order", 5)]), ("## C\n## A\n", [("structure/section-order", 1)])]),
    "depth_jumps": ("body: {sections: []}", [("## A\n#### B\n", [("structure/heading-depth-jump", 2)]), ("## A\n### B\n", []), ("#### A\n", []), ("## A\n### B\n##### C\n", [("structure/heading-depth-jump", 3)])]),
    "nested_levels": ("body: {sections: [{section: A, minContains: 1, sections: [{section: B}]}]}", [
        ("## A\n### B\n## A\n### B\n", []), ("## A\n### B\n## A\n### C\n", [("structure/section-missing", 4)]), ("## A\n### C\n", [("structure/section-missing", 2)]), ("## A\n", [("structure/section-missing", None)])]),
    "list_bounds": ("body: {sections: [{section: L, content: {list: {items: checkbox, minItems: 2}}}]}", [
        ("## L\n\n- [x] a\n- [ ] b\n", []), ("## L\n\n- [x] a\n", [("content/list/min-items", 3)]), ("## L\n\n- a\n- [x] b\n", [("content/list/item-kind", 3)]),
        ("## L\n\ntext\n", [("structure/block-kind", 3)]), ("## L\n", [("structure/block-missing", 1)])]),
    "code_languages": ("body: {sections: [{section: C, content: {code: {lang: py}}}]}", [
        ("## C\n\n```py\nx\n```\n", []), ("## C\n\n```js\nx\n```\n", [("content/code/lang", 3)]), ("## C\n\n```\nx\n```\n", [("content/code/lang", 3)]), ("## C\n\n- x\n", [("structure/block-kind", 3)])]),
    "first_of_slot": ("body: {sections: [{section: A, minContains: 1, content: {maxWords: 2}}]}", [
        ("## A\n\none\n\n## A\n\none two three\n", []), ("## A\n\none two three\n\n## A\n\none\n", [("content/max-words", 3)]), ("## A\n\none two\n\nthree four five\n", []), ("## A\n\n- one\n", [("structure/block-kind", 3)])]),
    "anchored_words": ("body: {sections: [{section: A, content: {note: {maxWords: 2}}}]}", [
        ("## A\n\none two three\n\nfour ^note\n", []), ("## A\n\none\n\ntwo three four ^note\n", [("content/max-words", 5)]), ("## A\n\none\n", [("structure/block-missing", 1)])]),
    "schema_strings": ("frontmatter: {type: object, required: [id], properties: {id: {type: string, minLength: 2, maxLength: 4, pattern: '^a'}, day: {type: string, format: date}}}", [
        ("---\nid: abc\n---\n", []), ("---\nid: b\n---\n", [("frontmatter/type", 2), ("frontmatter/type", 2)]), ("---\nid: abcde\n---\n", [("frontmatter/type", 2)]), ("---\nid: 7\n---\n", [("frontmatter/type", 2)]),
        ("---\nid: ab\nday: 2024-02-29\n---\n", []), ("---\nid: ab\nday: 2023-02-29\n---\n", [("frontmatter/type", 3)]), ("text\n", [("frontmatter/required", None)])]),
    "schema_values": ("frontmatter: {type: object, properties: {on: {type: boolean}, tags: {type: array, items: {type: string}, minItems: 1, maxItems: 2}, kind: {const: x}, n: {const: 3}}}", [
        ("---\non: true\n---\n", []), ("---\non: yes\n---\n", [("frontmatter/type", 2)]), ("---\ntags: []\n---\n", [("frontmatter/type", 2)]), ("---\ntags: [a, b, c]\n---\n", [("frontmatter/type", 2)]),
        ("---\ntags: [a, 2]\n---\n", [("frontmatter/type", 2)]), ("---\nkind: x\nn: 3\n---\n", []), ("---\nkind: y\n---\n", [("frontmatter/enum", 2)]), ("---\nn: '3'\n---\n", [("frontmatter/enum", 2)])]),
    "schema_nulls": ("frontmatter: {type: object, required: [size, note], properties: {note: {type: [string, 'null']}, opt: {type: string}, size: {type: number, default: 1}}}", [
        ("---\nnote: null\n---\n", []), ("---\nnote: a\nopt: b\nsize: 2.5\n---\n", []), ("---\nnote: 1\n---\n", [("frontmatter/type", 2)]), ("---\nnote: a\nopt: null\n---\n", [("frontmatter/type", 3)]),
        ("---\nsize: 1\n---\n", [("frontmatter/required", None)]), ("text\n", [("frontmatter/required", None)])]),
    "text_bounds": ("body: {sections: [{section: A, requires: [{pattern: so be it, min: 2, id: text/count/so}], forbids: [{pattern: TODO, id: text/forbids/todo, level: warn}]}]}", [
        ("## A\n\nso be it, so be\nit\n", []), ("## A\n\nso be it TODO\nso be it\nTODO\n", [("text/forbids/todo", 3), ("text/forbids/todo", 5)]), ("## A\n\nso be it\n", [("text/count/so", 1)]),
        ("TODO\n\n## A\n\nso be it so be it\n", []), ("## A\n\n- so be it\n- so be it\n\n```\nTODO\n```\n", [("text/forbids/todo", 6)])]),
}

#: Texts, and what a view of their projection shows: lines of code, and lines of headers and rows of tables in sections.
LINES: list[tuple[str, list[int], list[int]]] = [
    ("## A\n\n```\nx\n```\n", [3, 4, 5], []), ("## A\n\n| a |\n|---|\n| 1 |\n| 2 |\n", [], [3, 5, 6]), ("## A\n\n- ```\n  y\n  ```\n", [3, 4, 5], []), ("text\n", [], []),
    ("## A\n\n| a |\n|---|\n\n~~~js\n| b |\n|---|\n~~~\n", [6, 7, 8, 9], [3])]


def dealt(spark: SparkSession, d: str, texts: list[str]) -> DataFrame:
    at = F.pmod("o_orderkey", F.lit(len(texts))).cast("int")
    return spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("doc_id"), F.get(F.array(*map(F.lit, texts)), at).alias("source"))


def _values(rows: list[tuple], columns: str) -> str:
    say = lambda x: "NULL::INT" if x is None else f"'{x}'" if isinstance(x, str) else str(x)
    return f"(VALUES {', '.join('(' + ', '.join(map(say, r)) + ')' for r in rows)}) x({columns})"


def _finder(name: str) -> tuple[Callable[[SparkSession, str], DataFrame], str]:
    contract, cases = FINDINGS[name]

    def run(spark: SparkSession, d: str) -> DataFrame:
        found = validate(dealt(spark, d, [t for t, _ in cases]), ddl.load_contract(f"mcVersion: 2\nkind: contract\n{contract}\n"))
        return found.groupBy("doc_id", "id", "line").agg(F.count("*").alias("n"))

    run.__name__ = name
    rows = [(k, i, line) for k, (_, found) in enumerate(cases) for i, line in found]
    return run, f"SELECT o_orderkey AS doc_id, x.id, x.line::INT AS line, count(*) AS n FROM orders JOIN {_values(rows, 'k, id, line')} ON o_orderkey % {len(cases)} = x.k GROUP BY ALL"


def code_and_table_lines(spark: SparkSession, d: str) -> DataFrame:
    p = project(dealt(spark, d, [t for t, _, _ in LINES]), tables=("blocks", "cells", "code_spans"))
    code, tables = navigate.code_lines(open_table(p, "code_spans")), navigate.table_lines(open_table(p, "blocks"), open_table(p, "cells"))
    return code.select("doc_id", F.lit("code").alias("kind"), "line").unionByName(tables.select("doc_id", F.lit("table").alias("kind"), "line"))


QUERIES = {name: _finder(name)[0] for name in FINDINGS} | {"code_and_table_lines": code_and_table_lines}
ORACLES = {name: _finder(name)[1] for name in FINDINGS} | {
    "code_and_table_lines": "SELECT o_orderkey AS doc_id, x.kind, x.line::INT AS line FROM orders JOIN "
    + _values([(k, kind, x) for k, (_, code, tables) in enumerate(LINES) for kind, lines in (("code", code), ("table", tables)) for x in lines], "k, kind, line") + f" ON o_orderkey % {len(LINES)} = x.k"}
