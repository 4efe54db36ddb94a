"""Queries over the test tables, and what DuckDB says of the same rows.

No SQL here looks at a parser's output: each is written against the tables that the sheets were rendered from.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from folioscope import casebook
from folioscope.functions import columns as c
from folioscope.operators import findings as fnd
from folioscope.operators import history, infer, navigate, relational
from folioscope.operators.validate import read, route, validate, validate_corpus
from folioscope.plans import ddl
from folioscope.plans.grammar import CorpusConfig, Contract, Route, TextSpec
from folioscope.plans.sheets import flag_sheets, orders_with_lines, sheets, text
from folioscope.sources import files
from folioscope.sources.files import merge_first, upsert
from folioscope.sources.projection import open_table, project
from folioscope.streaming import schedule

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        name = f.__name__
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contract(body: str = "", front: str = "") -> Contract:
    return ddl.load_contract(f"mcVersion: 2\nkind: contract\n{front}\n{body}")


def by_document(found: DataFrame) -> DataFrame:
    return found.groupBy("doc_id", "id").agg(F.count("*").alias("n"))


# ---- validation of rendered sheets ---------------------------------------------------------------------------

CELLS = """
body:
  sections:
    - section: Lines
      content:
        table:
          columns: [line, part, flag, status]
          cells:
            flag: {enum: [A, N]}
"""


@query("SELECT l_orderkey AS doc_id, 'content/table/cell' AS id, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY l_orderkey")
def cell_findings(spark, d):
    """The flagship: render, parse, validate cells, count findings."""
    return by_document(validate(sheets(spark, d), contract(CELLS)))


@query("SELECT o_orderkey AS doc_id, 'frontmatter/enum' AS id, 'error' AS level, 3 AS line FROM orders WHERE o_orderstatus NOT IN ('F', 'O')")
def frontmatter_enum(spark, d):
    front = "frontmatter: {type: object, required: [status], properties: {order: {type: integer}, status: {enum: [F, O]}, priority: {type: string}}}"
    return validate(sheets(spark, d), contract(front=front)).select("doc_id", "id", "level", "line")


@query("SELECT o_orderkey AS doc_id, 'frontmatter/type' AS id, 1::BIGINT AS n FROM orders WHERE o_orderkey > 1000 UNION ALL SELECT o_orderkey, 'frontmatter/required', 1 FROM orders UNION ALL SELECT o_orderkey, 'frontmatter/unknown-key', 2 FROM orders")
def frontmatter_types(spark, d):
    front = "frontmatter: {type: object, required: [owner], additionalProperties: false, properties: {owner: {type: string}, order: {type: integer, maximum: 1000}}}"
    return by_document(validate(sheets(spark, d), contract(front=front)))


@query("SELECT o_orderkey AS doc_id, 'content/table/min-rows' AS id, 1::BIGINT AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey HAVING count(l_orderkey) < 3")
def table_min_rows(spark, d):
    return by_document(validate(sheets(spark, d), contract("body: {sections: [{section: Lines, content: {table: {columns: [line], minRows: 3}}}]}")))


@query("SELECT o_orderkey AS doc_id, 'structure/section-missing' AS id, 1::BIGINT AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus <> 'F')")
def section_missing(spark, d):
    return by_document(validate(sheets(spark, d), contract("body: {sections: [{section: Shipped}, {section: Lines}]}")))


@query("SELECT o_orderkey AS doc_id, 'content/list/item-kind' AS id, 1::BIGINT AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus <> 'F')")
def list_item_kind(spark, d):
    return by_document(validate(sheets(spark, d), contract("body: {sections: [{section: Checklist, content: {list: {items: checkbox, minItems: 1}}}]}")))


@query("SELECT o_orderkey AS doc_id, x.id, 1::BIGINT AS n FROM orders, (VALUES ('content/table/column-missing'), ('content/table/column-extra'), ('structure/anchor-missing'), ('structure/block-kind'), ('structure/block-missing')) x(id)")
def table_columns(spark, d):
    body = """
body:
  sections:
    - {section: Lines, anchor: rows, content: {table: {columns: [line, part, flag, weight], extraColumns: error}}}
    - {section: Summary, content: {list: {}}}
    - {section: Checklist, content: {todo: {table: {columns: []}}}}
"""
    return by_document(validate(sheets(spark, d), contract(body)))


@query("""WITH s AS (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY ALL)
SELECT l_orderkey AS doc_id, 'structure/duplicate-section' AS id, sum(n - 1)::BIGINT AS n FROM s WHERE l_returnflag IN ('A', 'N') GROUP BY l_orderkey HAVING sum(n - 1) > 0
UNION ALL SELECT l_orderkey, 'structure/repeat-count', 1 FROM s WHERE l_returnflag = 'R' AND n > 2""")
def repeats(spark, d):
    body = "body: {sections: [{section: R, minContains: 0, maxContains: 2}, {section: A, minContains: 0, maxContains: 1}, {section: N, minContains: 0, maxContains: 1}]}"
    return by_document(validate(flag_sheets(spark, d), contract(body)))


@query("""WITH r AS (SELECT l_orderkey, ascii(l_returnflag) AS f, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus) AS k FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)),
m AS (SELECT l_orderkey, f, max(f) OVER (PARTITION BY l_orderkey ORDER BY k ROWS UNBOUNDED PRECEDING) AS top FROM r)
SELECT l_orderkey AS doc_id, 'structure/section-order' AS id, count(*) AS n FROM m WHERE f < top GROUP BY l_orderkey""")
def section_order(spark, d):
    repeated = ", ".join(f"{{section: {x}, minContains: 0, maxContains: 99}}" for x in "ANR")
    return by_document(validate(flag_sheets(spark, d), contract(f"body: {{order: recognized-relative, sections: [{repeated}]}}")))


@query("""WITH r AS (SELECT l_orderkey, l_returnflag AS f, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus) AS k FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)),
o AS (SELECT l_orderkey, max(f) FILTER (k = 1) AS first, count(*) FILTER (f <> 'A') AS others FROM r GROUP BY l_orderkey)
SELECT l_orderkey AS doc_id, 'structure/gap-count' AS id, 1::BIGINT AS n FROM o WHERE others > 3 OR others < 1
UNION ALL SELECT o_orderkey, 'structure/gap-count', 1 FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def gap_count(spark, d):
    body = "body: {order: none, additionalSections: false, sections: [{section: A, minContains: 0, maxContains: 99}, {gap: {min: 1, max: 3}}]}"
    return by_document(validate(flag_sheets(spark, d), contract(body)).where("id = 'structure/gap-count'"))


@query("""WITH r AS (SELECT l_orderkey, l_returnflag AS f, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus) AS k FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)),
p AS (SELECT l_orderkey, coalesce(min(k) FILTER (f <> 'A'), 99) AS past FROM r GROUP BY l_orderkey)
SELECT r.l_orderkey AS doc_id, 'structure/section-order' AS id, count(*) AS n FROM r JOIN p USING (l_orderkey) WHERE r.k >= p.past AND r.f <> 'A' GROUP BY r.l_orderkey""")
def strict_order(spark, d):
    body = "body: {order: strict, additionalSections: false, sections: [{section: A, minContains: 0, maxContains: 99}]}"
    return by_document(validate(flag_sheets(spark, d), contract(body)).where("id = 'structure/section-order'"))


@query("SELECT o_orderkey AS doc_id FROM orders WHERE o_orderstatus IN ('F', 'O')")
def read_valid(spark, d):
    front = "frontmatter: {type: object, required: [status], properties: {status: {enum: [F, O]}}}"
    return read(sheets(spark, d), contract(front=front)).select("doc_id")


@query("SELECT 'frontmatter/enum' AS id, count(*) FILTER (o_orderstatus = 'P') AS error, 0::BIGINT AS warn, 0::BIGINT AS report FROM orders HAVING count(*) FILTER (o_orderstatus = 'P') > 0")
def level_counts(spark, d):
    front = "frontmatter: {type: object, properties: {status: {enum: [F, O]}}}"
    return fnd.count_by_level(validate(sheets(spark, d), contract(front=front)), "id")


@query("SELECT o_orderkey AS doc_id, 'text/requires/shipped' AS id, 'warn' AS level, NULL::INT AS line FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus <> 'F')")
def text_plane(spark, d):
    return validate(sheets(spark, d), contract("body: {requires: [{pattern: All lines, id: text/requires/shipped, level: warn}]}")).select("doc_id", "id", "level", "line")


# ---- projection and navigation ------------------------------------------------------------------------------


@query("SELECT l_orderkey AS doc_id, l_linenumber::VARCHAR AS line, l_partkey::VARCHAR AS part, l_returnflag AS flag, l_linestatus AS status, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY ALL")
def table_round_trip(spark, d):
    rows = navigate.grid_rows(project(sheets(spark, d), tables=("grids",)), ["line", "part", "flag", "status"], anchor="lines")
    return rows.groupBy("doc_id", "line", "part", "flag", "status").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey AS doc_id, x.* FROM orders, (VALUES ('Summary', 2, 1), ('Lines', 2, 2), ('Checklist', 2, 3)) x(name, depth, section_id)
UNION ALL SELECT o_orderkey, 'Shipped', 2, 4 FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus <> 'F')""")
def section_rows(spark, d):
    return open_table(project(sheets(spark, d), tables=("sections",)), "sections").where("section_id > 0").select("doc_id", "name", "depth", "section_id")


@query("""WITH n AS (SELECT o_orderkey, count(l_orderkey) AS n, coalesce(bool_and(l_linestatus = 'F'), true) AS f FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey)
SELECT o_orderkey AS doc_id, 'Summary' AS name, 9 AS first_line, 11 AS last_line FROM n UNION ALL SELECT o_orderkey, 'Lines', 13, 17 + n FROM n
UNION ALL SELECT o_orderkey, 'Checklist', 19 + n, CASE WHEN f THEN 21 + n ELSE 23 + n END FROM n UNION ALL SELECT o_orderkey, 'Shipped', 23 + n, 25 + n FROM n WHERE f""")
def section_spans(spark, d):
    docs = sheets(spark, d)
    lines = docs.select("doc_id", F.size(F.split("source", "\n")).alias("lines"))
    out = navigate.section_spans(open_table(project(docs, tables=("sections",)), "sections"), lines)
    return out.select("doc_id", "name", "first_line", "last_line")


@query("SELECT o_orderkey AS doc_id, 'Lines' AS name, 17 AS line FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT o_orderkey, 'Summary', 10 FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def section_of_line(spark, d):
    docs = orders_with_lines(spark, d).where(F.size("lines") > 0).select(F.col("o_orderkey").alias("doc_id"))
    lines = docs.select("doc_id", F.explode(F.array(F.lit(10), F.lit(17))).alias("line"))
    src = sheets(spark, d).join(docs, "doc_id", "left_semi")
    return navigate.section_for_line(open_table(project(src, tables=("sections",)), "sections"), lines).select("doc_id", "name", "line")


@query("SELECT o_orderkey AS doc_id, 'shipped' AS anchor FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus <> 'F')")
def dead_anchors(spark, d):
    return navigate.dead_references_within(project(sheets(spark, d), tables=("refs", "anchors"))).select("doc_id", "anchor")


@query("SELECT o_orderkey AS doc_id, k AS key, t AS json_type, v AS value, l AS line FROM orders, LATERAL (VALUES ('order', 'number', o_orderkey::VARCHAR, 2), ('status', 'string', '\"' || o_orderstatus || '\"', 3), ('priority', 'string', '\"' || o_orderpriority || '\"', 4)) x(k, t, v, l)")
def frontmatter_rows(spark, d):
    kv = open_table(project(sheets(spark, d), tables=("frontmatter_kv",)), "frontmatter_kv")
    return kv.select("doc_id", c.json_path(F.col("path")).alias("key"), "json_type", "value", "line")


@query("SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\n'), lambda x: trim(x) <> ''))::BIGINT AS lines, 1::BIGINT AS paragraphs FROM documents WHERE text NOT LIKE '%|%' AND text NOT LIKE '%*%' AND text NOT LIKE '%#%' AND text NOT LIKE '%`%'")
def paragraph_projection(spark, d):
    plain = table(spark, d, "documents").where(~F.col("text").rlike(r"[|*#`]")).select("doc_id", F.col("text").alias("source"))
    blocks = open_table(project(plain, tables=("blocks",)), "blocks").where("kind = 'paragraph'")
    return blocks.groupBy("doc_id").agg(F.sum(F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""))).alias("lines"), F.count("*").alias("paragraphs"))


@query("""WITH w AS (SELECT doc_id, len(list_filter(string_split(regexp_replace(coalesce(text, ''), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '')) AS n FROM documents)
SELECT doc_id, CASE WHEN n = 0 THEN 'structure/block-missing' ELSE 'content/max-words' END AS id, CASE WHEN n = 0 THEN 1 ELSE 3 END AS line FROM w WHERE n = 0 OR n > 400""")
def max_words(spark, d):
    """Every document's words as the paragraph of a section that may have 400."""
    words = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\p{L}\p{N}]+", " "))
    docs = table(spark, d, "documents").select("doc_id", text("## Body\n\n", words, "\n").alias("source"))
    return validate(docs, contract("body: {sections: [{section: Body, content: {maxWords: 400}}]}")).select("doc_id", "id", "line")


@query()
def documents_projected(spark, d):
    """All documents through the parser, with what Markdown is in them: blocks by kind."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("source"))
    blocks = open_table(project(docs, tables=("blocks",)), "blocks")
    return blocks.groupBy("doc_id", "kind").agg(F.count("*").alias("blocks"), F.min("line").alias("first_line"))


# ---- text rules over whole texts -----------------------------------------------------------------------------

LICENSE = TextSpec("requires", "General  Public License", ignore_case=True)


@query("SELECT lang, source, count(*) AS docs, count(*) FILTER (regexp_matches(text, 'general\\s+public\\s+license', 'i')) AS with_license, sum(len(regexp_extract_all(text, '(?i)general\\s+public\\s+license')))::BIGINT AS hits FROM documents GROUP BY lang, source")
def text_counts(spark, d):
    n = c.text_count(F.col("text"), LICENSE)
    return table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("docs"), F.count_if(n > 0).alias("with_license"), F.sum(n).alias("hits"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents)
SELECT doc_id, line::INT AS line, len(regexp_extract_all(x, 'the'))::BIGINT AS n FROM l WHERE x LIKE '%the%'""")
def text_hit_lines(spark, d):
    hits = c.line_hits(F.col("text"), TextSpec("forbids", "the"))
    return table(spark, d, "documents").select("doc_id", F.inline(hits))


@query("SELECT doc_id, len(regexp_extract_all(substr(text, 1, strpos(text, 'th') - 1), chr(10)))::INT + 1 AS line, length(regexp_replace(substr(text, 1, strpos(text, 'th') - 1), '^(.|\\n)*\\n', ''))::INT + 1 AS col FROM documents WHERE strpos(text, 'th') > 0")
def text_first_hit(spark, d):
    at = c.first_hit(F.col("text"), TextSpec("requires", "th"))
    return table(spark, d, "documents").select("doc_id", at.alias("at")).where("at IS NOT NULL").select("doc_id", "at.line", "at.col")


# ---- routing, names, formats ---------------------------------------------------------------------------------

ROUTES = CorpusConfig((Route(("*.example.com/en/**",), Contract(), ("*.example.com/en/*.html",), "com-en"), Route(("**/*.html",), Contract(), (), "html"), Route(("*.example.org/**",), Contract(), (), "org")))


@query("""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages)
SELECT page_id, CASE WHEN regexp_full_match(path, '[^/]*\\.example\\.com/en/.*') AND NOT regexp_full_match(path, '[^/]*\\.example\\.com/en/[^/]*\\.html') THEN 'com-en'
WHEN regexp_full_match(path, '(?:[^/]+/)*[^/]*\\.html') THEN 'html' WHEN regexp_full_match(path, '[^/]*\\.example\\.org/.*') THEN 'org' END AS rule FROM p""")
def routed_pages(spark, d):
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    names = F.array(*[F.lit(r.name) for r in ROUTES.routes])
    return table(spark, d, "pages").select("page_id", F.get(names, route(path, ROUTES)).alias("rule"))


@query("""WITH p AS (SELECT regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages),
m AS (SELECT CASE WHEN regexp_full_match(path, '[^/]*\\.example\\.com/en/.*') AND NOT regexp_full_match(path, '[^/]*\\.example\\.com/en/[^/]*\\.html') THEN 0
WHEN regexp_full_match(path, '(?:[^/]+/)*[^/]*\\.html') THEN 1 WHEN regexp_full_match(path, '[^/]*\\.example\\.org/.*') THEN 2 END AS rule FROM p)
SELECT 'scanned' AS name, count(*) AS files FROM m UNION ALL SELECT 'matched', count(rule) FROM m UNION ALL SELECT 'unmatched', count(*) - count(rule) FROM m
UNION ALL SELECT x.name, count(m.rule) FROM (VALUES (0, 'com-en'), (1, 'html'), (2, 'org')) x(k, name) LEFT JOIN m ON m.rule = x.k GROUP BY x.name""")
def run_stats(spark, d):
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    result = validate_corpus(table(spark, d, "pages").select(path.alias("path"), F.lit("").alias("source")), ROUTES)
    totals = result.stats().select(F.inline(F.array(*[F.struct(F.lit(x).alias("name"), F.col(f"files_{x}").alias("files")) for x in ("scanned", "matched", "unmatched")])))
    return totals.unionByName(result.matched_by_rule().select("name", "files"))


@query("""WITH w AS (SELECT p_partkey, list_filter(regexp_split_to_array(p_name, '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w, p_name FROM part)
SELECT p_partkey, lower(coalesce(w[1], '')) || array_to_string(list_transform(w[2:], lambda x: upper(x[1]) || lower(x[2:])), '') AS camel, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM w""")
def names_of_parts(spark, d):
    return table(spark, d, "part").select("p_partkey", c.camel_key(F.col("p_name")).alias("camel"), c.slug(F.col("p_name")).alias("slug"))


#: By format: a text that has it, made of the order's key, and one that has not.
FORMATTED = {
    "email": ("a%s@example.com", "a%s@example"), "url": ("https://example.com/%s", "//example.com/%s"), "uuid": ("00000000-0000-4000-8000-%012s", "00000000-0000-4000-c000-%012s"),
    "hostname": ("h%s.example.com", "h%s-.example"), "datetime": ("2024-02-29T10:00:00.%sZ", "2023-02-29T10:00:00.%sZ"), "date": ("2024-02-29", "2024-02-30"), "time": ("10:30:00.%s", "24:30:00.%s"),
    "duration": ("P%sDT2H", "P%s"), "ipv4": ("10.0.0.1", "10.0.0.%s00000"), "cidrv4": ("10.0.0.0/8", "10.0.0.0/%s00"), "nanoid": ("%021s", "%020s"), "cuid": ("c%012s", "k%012s"), "cuid2": ("a%s", "A%s"),
    "ulid": ("%026s", "U%025s"), "base64": ("%08s", "%07s"), "e164": ("+1%010s", "+0%010s")}


@query(" UNION ALL ".join(f"SELECT '{name}' AS format, count(*) FILTER (o_orderkey % 3 <> 1) AS hits FROM orders" for name in FORMATTED))
def format_checks(spark, d):
    """Two thirds of the orders' texts have the format, the others are near it."""
    k = F.col("o_orderkey")

    def made(shape: str) -> Column:
        head, mark, tail = re.match(r"(.*?)(%0?\d*s|$)(.*)", shape).groups()
        return text(head, F.lpad(k.cast("string"), int(mark[2:-1]), "0") if mark[1:2] == "0" else k, tail) if mark else F.lit(shape)

    checks = [F.count_if(c.matches_format(F.when(k % 3 != 1, made(good)).otherwise(made(bad)), name)).alias(name) for name, (good, bad) in FORMATTED.items()]
    counts = table(spark, d, "orders").agg(*checks)
    return counts.select(F.inline(F.array(*[F.struct(F.lit(name).alias("format"), F.col(name).alias("hits")) for name in FORMATTED])))


@query("""SELECT page_id, len(string_split(regexp_replace(url, '^[a-z]+://', ''), '/'))::INT - 1 AS depth, CASE WHEN strpos(regexp_replace(url, '^[a-z]+://', ''), '/') > 0 THEN regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '/[^/]*$', '') ELSE '' END AS dir,
string_split(regexp_replace(url, '^[a-z]+://', ''), '/')[1] AS top FROM pages""")
def path_functions(spark, d):
    p = F.regexp_replace("url", "^[a-z]+://", "")
    return table(spark, d, "pages").select("page_id", c.depth_of(p).alias("depth"), c.dir_of(p).alias("dir"), F.coalesce(c.ancestor_at(p, 1), p).alias("top"))


@query("""SELECT p_partkey, 'link' AS kind, replace(p_brand, '#', ' ') AS target, 's' || p_size AS fragment, p_type AS alias FROM part UNION ALL SELECT p_partkey, 'transclusion', p_name, NULL, NULL FROM part""")
def wiki_links(spark, d):
    t = text("See [[", F.translate("p_brand", "#", " "), "#s", F.col("p_size"), "|", F.col("p_type"), "]] and ![[", F.col("p_name"), "]].")
    return table(spark, d, "part").select("p_partkey", F.inline(c.references(t))).drop("raw")


# ---- history, drift, debounce --------------------------------------------------------------------------------


def runs_of(spark: SparkSession, d: str) -> DataFrame:
    """Events as runs: users are vaults, some types are statuses."""
    status = F.when(F.col("event_type") == F.lit("click"), "findings").when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "running").otherwise("green")
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("vault_id"), F.col("ts").alias("started_at"), status.alias("status"))


RUNS = "r AS (SELECT event_id AS id, user_id AS vault_id, ts AS started_at, CASE event_type WHEN 'click' THEN 'findings' WHEN 'error' THEN 'error' WHEN 'view' THEN 'running' ELSE 'green' END AS status FROM events)"


@query(f"WITH {RUNS} SELECT vault_id, arg_max(id, (started_at, id)) AS id, arg_max(status, (started_at, id)) AS status FROM r GROUP BY vault_id")
def latest_runs(spark, d):
    return history.latest(runs_of(spark, d)).select("vault_id", "id", "status")


@query(f"WITH {RUNS} SELECT vault_id, arg_max(id, (started_at, id)) AS id, arg_max(status, (started_at, id)) AS status FROM r WHERE status <> 'running' GROUP BY vault_id")
def latest_finished_runs(spark, d):
    return history.latest_finished(runs_of(spark, d)).select("vault_id", "id", "status")


@query(f"""WITH {RUNS}, p AS (SELECT *, coalesce(lag(status) OVER (PARTITION BY vault_id ORDER BY started_at, id), 'green') AS previous FROM r WHERE status <> 'running')
SELECT vault_id, id, previous, status FROM p WHERE previous <> status""")
def status_transitions(spark, d):
    return history.transitions(runs_of(spark, d)).select("vault_id", "id", "previous", "status")


@query(f"""WITH {RUNS} SELECT id, last_value(CASE WHEN status <> 'running' THEN status END IGNORE NULLS) OVER (PARTITION BY vault_id ORDER BY started_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM r""")
def previous_status(spark, d):
    return history.previous_finished(runs_of(spark, d)).select("id", "previous")


@query(f"""WITH {RUNS}, c AS (SELECT vault_id, arg_max(status, (started_at, id)) AS state, arg_max(id, (started_at, id)) AS last_run_id FROM r GROUP BY vault_id),
f AS (SELECT vault_id, arg_max(id, (started_at, id)) AS done FROM r WHERE status <> 'running' GROUP BY vault_id),
n AS (SELECT f.vault_id, count(*) FILTER (l_returnflag = 'R') AS errors, count(*) FILTER (l_returnflag = 'A') AS warnings, count(*) AS findings FROM f JOIN lineitem ON l_orderkey = f.done GROUP BY f.vault_id)
SELECT c_custkey AS vault_id, c_name AS name, coalesce(c.state, 'unknown') AS state, c.last_run_id, coalesce(n.errors, 0) AS errors, coalesce(n.warnings, 0) AS warnings, coalesce(n.findings, 0) AS findings
FROM customer LEFT JOIN c ON c.vault_id = c_custkey LEFT JOIN n ON n.vault_id = c_custkey""")
def vault_statuses(spark, d):
    vaults = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    flag = F.col("l_returnflag")
    records = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("scan_run_id"), F.when(flag == "R", "error").when(flag == "A", "warn").otherwise("report").alias("level"))
    return history.vault_status(vaults, runs_of(spark, d), records).drop("last_scan_at")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS first_ts, max(ts) + INTERVAL 6 HOUR AS fire_ts, count(*) AS events FROM s GROUP BY user_id, k""")
def debounced_events(spark, d):
    return history.debounce(table(spark, d, "events"), "6 hours", "user_id")


@query("""SELECT a.event_id, b.event_id AS click_id FROM (SELECT * FROM events WHERE event_type = 'purchase') a ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') b ON a.user_id = b.user_id AND a.ts >= b.ts""")
def as_of_event(spark, d):
    kind = F.col("event_type")
    return history.as_of(table(spark, d, "events"), "user_id", "ts", kind == "purchase", kind == "click", F.col("event_id"), "click_id").select("event_id", "click_id")


@query("""SELECT p_partkey, CASE WHEN contains(lower(p_type), 'order') THEN 'order-changed' WHEN regexp_matches(lower(p_type), 'unknown|unexpected|extra') THEN CASE WHEN contains(lower(p_type), 'section') THEN 'section-added' ELSE 'field-added' END
WHEN regexp_matches(lower(p_type), 'missing|absent|required') THEN CASE WHEN contains(lower(p_type), 'section') THEN 'section-removed' ELSE 'field-removed' END ELSE 'field-changed' END AS kind
FROM (SELECT p_partkey, list_value('structure/section-order', 'structure/section-missing', 'content/table/column-extra', 'frontmatter/required', 'frontmatter/unknown-key', 'content/max-words')[p_partkey % 6 + 1] AS p_type FROM part)""")
def drift_kinds(spark, d):
    ids = F.array(*map(F.lit, ["structure/section-order", "structure/section-missing", "content/table/column-extra", "frontmatter/required", "frontmatter/unknown-key", "content/max-words"]))
    return table(spark, d, "part").select("p_partkey", c.drift_kind(F.get(ids, (F.col("p_partkey") % 6).cast("int"))).alias("kind"))


@query("""SELECT o_orderkey, c_name || CASE o_orderstatus WHEN 'F' THEN ' is green' WHEN 'P' THEN ': scan failed' ELSE ' has findings' END AS title,
CASE o_orderstatus WHEN 'F' THEN 'All findings resolved — the vault validates clean.' WHEN 'P' THEN 'The scan could not complete.'
ELSE (o_orderkey % 3)::VARCHAR || CASE WHEN o_orderkey % 3 = 1 THEN ' error, ' ELSE ' errors, ' END || (o_orderkey % 2)::VARCHAR || CASE WHEN o_orderkey % 2 = 1 THEN ' warning.' ELSE ' warnings.' END END AS body FROM orders JOIN customer ON c_custkey = o_custkey""")
def notifications(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    status = F.when(F.col("o_orderstatus") == "F", "green").when(F.col("o_orderstatus") == "P", "error").otherwise("findings")
    k = F.col("o_orderkey")
    return o.select("o_orderkey", history.notification(F.col("c_name"), status, k % 3, k % 2, F.lit(None).cast("string")).alias("n")).select("o_orderkey", "n.title", "n.body")


@query("SELECT event_id AS id, user_id FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 200) WHERE event_id > 9900 ORDER BY event_id")
def event_replay(spark, d):
    return history.replay(table(spark, d, "events").select(F.col("event_id").alias("id"), "user_id"), 9900)


@query("SELECT c_custkey AS id, c_name AS name FROM customer ORDER BY c_custkey LIMIT 50 OFFSET 100")
def entity_page(spark, d):
    from folioscope.sources.files import page

    return page(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), 50, 100)


@query("""SELECT c_custkey AS id, coalesce(s_name, c_name) AS name, c_mktsegment AS segment FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey AND s_suppkey % 2 = 0 WHERE c_custkey % 10 <> 0
UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer) AND s_suppkey % 10 <> 0""")
def entity_upsert(spark, d):
    cur = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    patch = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("name"))
    return upsert(cur, patch, delete=cur.where("id % 10 = 0"))


@query("SELECT n_nationkey AS path, n_name AS name FROM nation UNION ALL SELECT s_suppkey::INT, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT n_nationkey FROM nation)")
def merged_files(spark, d):
    a = table(spark, d, "nation").select(F.col("n_nationkey").alias("path"), F.col("n_name").alias("name"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").cast("int").alias("path"), F.col("s_name").alias("name"))
    return merge_first(a, b)


@query("""SELECT c_custkey, s || CASE WHEN n > 1 THEN '-' || n ELSE '' END AS slug_id FROM (SELECT c_custkey, lower(c_mktsegment) AS s, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS n FROM customer)""")
def numbered_slugs(spark, d):
    return files.numbered_slugs(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey", c.slug(F.col("c_mktsegment"))).select("c_custkey", "slug_id")


@query("""SELECT coalesce(c_custkey, s_suppkey) AS id, CASE WHEN c_custkey % 10 = 0 THEN 'deleted' WHEN c_custkey IS NULL THEN 'created' ELSE 'updated' END AS change
FROM customer FULL JOIN supplier ON c_custkey = s_suppkey + 1400 WHERE c_custkey % 10 = 0 OR s_suppkey IS NOT NULL""".replace("s_suppkey) AS id", "s_suppkey + 1400) AS id"))
def entity_changes(spark, d):
    cur = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    patch = table(spark, d, "supplier").select((F.col("s_suppkey") + 1400).alias("id"), F.col("s_name").alias("name"))
    return files.changes(cur, patch, delete=cur.where("id % 10 = 0"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN CASE WHEN ts < date_trunc('day', ts) + INTERVAL '6:30' HOUR TO MINUTE THEN date_trunc('day', ts) + INTERVAL '6:30' HOUR TO MINUTE ELSE date_trunc('day', ts) + INTERVAL 1 DAY + INTERVAL '6:30' HOUR TO MINUTE END
WHEN 1 THEN time_bucket(INTERVAL 15 MINUTE, ts) + INTERVAL 15 MINUTE END AS next_run FROM events""".replace("INTERVAL '6:30' HOUR TO MINUTE", "INTERVAL 390 MINUTE"))
def scheduled_runs(spark, d):
    """The next time of a daily schedule, of one each quarter of an hour, and of one that is not valid."""
    at = F.get(F.array(F.lit("30 6 * * *"), F.lit("*/15 * * * *"), F.lit("61 * * * *")), (F.col("event_id") % 3).cast("int"))
    return schedule.next_runs(table(spark, d, "events").select("event_id", "ts", at.alias("schedule")), F.col("ts")).select("event_id", "next_run")


@query("""SELECT o_orderpriority AS vault_id, count(*) FILTER (o_orderstatus = 'P' AND o_orderkey % 2 = 0)::INT AS error_count, 0 AS warn_count, 0 AS report_count,
CASE WHEN count(*) FILTER (o_orderstatus = 'P' AND o_orderkey % 2 = 0) > 0 THEN 'findings' ELSE 'green' END AS status FROM orders GROUP BY o_orderpriority""")
def swept_vaults(spark, d):
    """One batch over vaults, of whose files one in two has a rule."""
    front = "frontmatter: {type: object, properties: {status: {enum: [F, O]}}}"
    docs = sheets(spark, d).join(table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("vault_id")), "doc_id")
    paths = docs.select("vault_id", text(F.when(F.col("doc_id") % 2 == 0, "in/").otherwise("out/"), F.col("doc_id"), ".md").alias("path"), "source")
    return schedule.sweep(paths, CorpusConfig((Route(("in/*.md",), contract(front=front), (), "in"),)))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus) AS k FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)),
z AS (SELECT l_orderkey, max(k) AS k FROM r GROUP BY l_orderkey), t AS (SELECT r.* FROM r JOIN z USING (l_orderkey, k))
SELECT t.l_orderkey AS doc_id, (15 + min(r.k))::INT AS line FROM t JOIN r ON r.l_orderkey = t.l_orderkey AND r.l_linenumber = t.l_linenumber AND r.l_partkey = t.l_partkey AND r.l_returnflag = t.l_returnflag AND r.l_linestatus = t.l_linestatus GROUP BY t.l_orderkey""")
def rows_of_records(spark, d):
    """The first row of each sheet that holds what its last line does."""
    last = orders_with_lines(spark, d).select(F.col("o_orderkey").alias("doc_id"), F.try_element_at("lines", F.lit(-1)).alias("x")).where("x IS NOT NULL")
    records = last.select("doc_id", *[F.col(f"x.{a}").cast("string").alias(b) for a, b in (("l_linenumber", "nr"), ("l_partkey", "part"), ("l_returnflag", "flag"), ("l_linestatus", "status"))])
    columns = ["nr", "part", "flag", "status"]
    rows = navigate.grid_rows(project(sheets(spark, d), tables=("grids",)), ["line", *columns[1:]], names=columns)
    return navigate.first_rows_of_records(rows, records, columns).select("doc_id", "line")


@query("SELECT o_orderkey AS doc_id, 'lines' AS slot, 14 AS line FROM orders")
def promoted_tables(spark, d):
    p = project(sheets(spark, d), tables=("sections", "blocks"))
    return navigate.promoted_tables(open_table(p, "sections"), open_table(p, "blocks"), {"lines": ["Lines"], "summary": ["Summary"]}).select("doc_id", "slot", "line")


@query("""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '\\.html$', '.md') AS path FROM pages) SELECT page_id FROM p WHERE ends_with(path, '.md') AND len(string_split(path, '/')) BETWEEN 2 AND 3""")
def stranded_files(spark, d):
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), r"\.html$", ".md")
    pages = table(spark, d, "pages").select("page_id", path.alias("path"))
    return pages.join(infer.stranded(pages, 3).select("path").distinct(), "path").select("page_id")


# ---- reports -------------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey AS doc_id, o_orderkey || ':3 error frontmatter/enum' AS line FROM orders WHERE o_orderstatus = 'P'""")
def report_lines(spark, d):
    front = "frontmatter: {type: object, properties: {status: {enum: [F, O]}}}"
    found = validate(sheets(spark, d), contract(front=front)).withColumn("path", F.col("doc_id").cast("string"))
    return found.select("doc_id", F.substring_index(fnd.line_text(), " — ", 1).alias("line"))


@query("""SELECT l_orderkey AS doc_id, count(*) AS n, min(k)::INT AS first_line, max(k)::INT AS last_line FROM (SELECT l_orderkey, l_returnflag, 13 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus) + 2 AS k FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)) WHERE l_returnflag = 'R' GROUP BY l_orderkey""")
def findings_by_file(spark, d):
    found = validate(sheets(spark, d), contract(CELLS)).withColumn("path", F.col("doc_id").cast("string"))
    return fnd.by_file(found).select(F.col("path").cast("long").alias("doc_id"), F.size("findings").cast("long").alias("n"), F.element_at("findings", 1)["line"].alias("first_line"), F.element_at("findings", -1)["line"].alias("last_line"))


# ---- inference -----------------------------------------------------------------------------------------------


@query("""SELECT o_orderpriority AS grp, k AS key, count(*)::BIGINT AS files, count(*)::BIGINT AS present, (count(DISTINCT v))::BIGINT AS distinct_values, bool_and(k = 'order') AS all_integer
FROM orders, LATERAL (VALUES ('order', o_orderkey::VARCHAR), ('status', o_orderstatus), ('priority', o_orderpriority)) x(k, v) GROUP BY o_orderpriority, k""")
def inferred_fields(spark, d):
    docs = orders_with_lines(spark, d)
    from folioscope.plans.sheets import sheet

    p = project(docs.select(F.col("o_orderkey").alias("doc_id"), sheet().alias("source")), tables=("frontmatter_kv",))
    groups = docs.select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("grp"))
    facts = infer.field_facts(open_table(p, "frontmatter_kv").join(groups, "doc_id"), groups, "grp")
    return facts.select("grp", "key", "files", "present", "distinct_values", "all_integer")


@query("""WITH s AS (SELECT o_orderkey, o_orderpriority AS grp, coalesce(bool_and(l_linestatus = 'F'), true) AS f FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT grp, x.name, count(*)::BIGINT AS present, false AS repeats FROM s, (VALUES ('Summary'), ('Lines'), ('Checklist')) x(name) GROUP BY ALL UNION ALL SELECT grp, 'Shipped', count(*), false FROM s WHERE f GROUP BY grp""")
def inferred_sections(spark, d):
    docs = orders_with_lines(spark, d)
    from folioscope.plans.sheets import sheet

    p = project(docs.select(F.col("o_orderkey").alias("doc_id"), sheet().alias("source")), tables=("sections",))
    groups = docs.select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("grp"))
    return infer.section_facts(open_table(p, "sections").join(groups, "doc_id"), "grp").select("grp", "name", "present", "repeats")




# ---- planes over tables, views and order ---------------------------------------------------------------------


@query("""WITH r AS (SELECT l_orderkey, l_returnflag AS f, ascii(l_returnflag) AS v, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus) AS k FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)),
m AS (SELECT *, max(v) OVER (PARTITION BY l_orderkey ORDER BY k ROWS UNBOUNDED PRECEDING) AS top FROM r)
SELECT l_orderkey AS doc_id, 'structure/section-order' AS id, (4 * k - 1)::INT AS line FROM m WHERE v < top
UNION ALL SELECT o_orderkey, 'structure/section-missing', (CASE WHEN EXISTS (SELECT 1 FROM r WHERE l_orderkey = o_orderkey) THEN 3 END)::INT FROM orders WHERE NOT EXISTS (SELECT 1 FROM r WHERE l_orderkey = o_orderkey AND f = 'N')""")
def structure_over_tables(spark, d):
    """The structure plane as windows and aggregates over the section table."""
    level = contract("body: {order: recognized-relative, sections: [{section: A, minContains: 0}, {section: N, minContains: 1}, {section: R, minContains: 0}]}").body
    docs = flag_sheets(spark, d)
    found = relational.structure(docs, open_table(project(docs, tables=("sections",)), "sections"), level)
    return found.select("doc_id", "id", "line")


@query("SELECT l_orderkey AS doc_id, 'content/table/cell' AS id, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY l_orderkey")
def content_over_tables(spark, d):
    """The content plane over the tables of each document."""
    p = project(sheets(spark, d), tables=("sections", "blocks", "grids"), scope_text=False)
    return by_document(relational.content_within(p, contract(CELLS).body.slots[0]))


@query("SELECT o_orderkey AS doc_id, 'Summary' AS name, 'Order of customer ' || o_custkey || ' with ' || count(l_orderkey) || ' lines.' AS text FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey")
def prose_of_sections(spark, d):
    p = project(sheets(spark, d), tables=("sections", "blocks"))
    return navigate.text_view(open_table(p, "sections").where("name = 'Summary'"), open_table(p, "blocks")).select("doc_id", "name", "text")


@query("SELECT o_orderkey AS doc_id, 'table' AS kind, 14 AS line, ['line', 'part', 'flag', 'status'] AS columns FROM orders")
def blocks_by_anchor(spark, d):
    return navigate.by_anchor(open_table(project(sheets(spark, d), tables=("blocks",)), "blocks"), "lines").select("doc_id", "kind", "line", "columns")


@query("""WITH s AS (SELECT o_orderpriority AS grp, o_orderkey, coalesce(bool_and(l_linestatus = 'F'), true) AS f FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT grp, count(DISTINCT f) AS sequences FROM s GROUP BY grp""")
def heading_sequences(spark, d):
    docs = orders_with_lines(spark, d).select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("grp"))
    return infer.sequences(open_table(project(sheets(spark, d), tables=("sections",)), "sections"), docs)


@query("""WITH s AS (SELECT DISTINCT o_orderpriority AS grp, coalesce(bool_and(l_linestatus = 'F') OVER (PARTITION BY o_orderkey), true) AS f FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey)
SELECT DISTINCT grp, a, b FROM s, (VALUES ('Summary', 'Lines', false), ('Summary', 'Checklist', false), ('Lines', 'Checklist', false), ('Summary', 'Shipped', true), ('Lines', 'Shipped', true), ('Checklist', 'Shipped', true)) x(a, b, shipped) WHERE f OR NOT shipped""")
def heading_precedence(spark, d):
    docs = orders_with_lines(spark, d).select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("grp"))
    return infer.precedence(open_table(project(sheets(spark, d), tables=("sections",)), "sections").join(docs, "doc_id"))


@query("""SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY k)::INT AS place, (15 + k)::INT AS line FROM (SELECT l_orderkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus) AS k FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)) WHERE l_returnflag = 'R'""")
def findings_in_order(spark, d):
    found = validate(sheets(spark, d), contract(CELLS))
    w = W.partitionBy("doc_id").orderBy(F.coalesce("line", F.lit(0)), F.coalesce("col", F.lit(0)), c.plane_rank(F.col("id")), "emitted")
    return found.select("doc_id", F.row_number().over(w).alias("place"), "line")


@query("SELECT page_id, regexp_matches(lower(url), '\\.html$') AND NOT contains(url, '/en/') AS relevant FROM pages")
def relevant_files(spark, d):
    path = F.regexp_replace(F.regexp_replace("url", r"\.html$", ".md"), "/en/", "/.en/")
    return table(spark, d, "pages").select("page_id", c.relevant_change(path).alias("relevant"))


QUERIES |= casebook.QUERIES
ORACLES |= casebook.ORACLES
