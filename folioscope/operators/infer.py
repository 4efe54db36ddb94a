"""The tightest contract that a corpus satisfies.

Two grouped aggregations over the projection give facts, one for each distinct key and heading, of which the driver takes ``MAX_NAMES`` at
most and turns them into a contract.
"""

from __future__ import annotations

import json
from collections import defaultdict
from typing import Any

import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from folioscope.functions.columns import ancestor_at, depth_of, matches_format
from folioscope.functions.names import camel_key, slug
from folioscope.plans import ddl
from folioscope.plans.grammar import ContractError, CorpusConfig
from folioscope.sources.projection import open_table, project

#: Formats that are tried, in this order, and the limits of the ladder's rungs.
FORMATS = ["uuid", "ulid", "datetime", "date", "time", "duration", "email", "url", "ipv4", "cidrv4", "e164"]
MAX_CONST, MIN_CONST_DOCS, MAX_ENUM = 64, 3, 12
#: Distinct headings, and keys, of all groups that the driver takes: beyond that a corpus is too free for a contract.
MAX_NAMES = 2000


def field_facts(kv: DataFrame, groups: DataFrame, by: str = "grp") -> DataFrame:
    """For each group and top-level key: files of the group, files with the key, what all its values are, and distinct values."""
    top = kv.where(F.size("path") == 1).withColumn("key", F.get("path", F.lit(0)))
    text = F.get_json_object(F.concat(F.lit('{"v":'), F.col("value"), F.lit("}")), "$.v")
    some = F.col("json_type") != "null"
    number = (F.col("json_type") == "number") & (F.col("value").try_cast("double") == F.floor(F.col("value").try_cast("double"))) & (F.abs(F.col("value").try_cast("double")) <= 2**53 - 1)
    whole = lambda x: F.coalesce(F.bool_and(F.when(some, x)), F.lit(False))
    string = F.col("json_type") == "string"
    facts = top.groupBy(by, "key").agg(
        F.count("*").alias("present"), F.count_if(~some).alias("nulls"), F.count_distinct(F.when(some, F.col("value"))).alias("distinct_values"),
        F.min(F.struct("doc_id", "ord")).alias("first"), F.min_by("value", F.struct("doc_id", "ord")).alias("first_value"), whole(number).alias("all_integer"),
        *[whole(F.col("json_type") == t).alias(f"all_{t}") for t in ("number", "boolean", "string", "array", "object")],
        *[whole(string & matches_format(text, f)).alias(f"is_{f}") for f in FORMATS])
    # the first few values are enough to tell whether there are more: the rest goes before the shuffle
    few = W.partitionBy(by, "key").orderBy("at")
    values = (top.where(some & string).groupBy(by, "key", "value").agg(F.min(F.struct("doc_id", "ord")).alias("at"))
              .withColumn("_k", F.row_number().over(few)).where(F.col("_k") <= MAX_ENUM + 1).groupBy(by, "key")
              .agg(F.when(F.count("*") <= MAX_ENUM, F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"])).alias("values")))
    files = groups.groupBy(by).agg(F.count("*").alias("files"))
    return facts.join(values, [by, "key"], "left").join(files, by)


def section_facts(sections: DataFrame, by: str = "grp") -> DataFrame:
    """For each group and top-level heading: documents that have it, whether one repeats it, and its first appearance."""
    top = sections.where("parent_id = 0").groupBy(by, "doc_id", "name").agg(F.count("*").alias("n"), F.min("ord").alias("ord"))
    return top.groupBy(by, "name").agg(F.count("*").alias("present"), F.bool_or(F.col("n") > 1).alias("repeats"), F.min(F.struct("doc_id", "ord")).alias("first"))


def sequences(sections: DataFrame, groups: DataFrame, by: str = "grp") -> DataFrame:
    """For each group the number of distinct heading sequences: 1 means that the order is strict."""
    top = sections.where("parent_id = 0").groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]).alias("names"))
    return groups.join(top, "doc_id", "left").groupBy(by).agg(F.count_distinct(F.to_json(F.coalesce("names", F.array().cast("array<string>")))).alias("sequences"))


def precedence(sections: DataFrame, by: str = "grp") -> DataFrame:
    """Pairs of headings (a, b) where a stands before b in some document of a group; pairs within a document only."""
    top = sections.where("parent_id = 0").select(by, "doc_id", "ord", "name")
    names = top.groupBy(by, "doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]).alias("s"))
    pairs = F.flatten(F.transform("s", lambda x, k: F.transform(F.slice(F.col("s"), k + 2, F.size("s")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return names.select(by, F.inline(F.array_distinct(pairs))).where("a <> b").distinct()


def reversals(pairs: DataFrame, by: str = "grp") -> DataFrame:
    """Groups in which some heading stands before another and after it."""
    back = pairs.select(by, F.col("b").alias("a"), F.col("a").alias("b"))
    return pairs.join(back, [by, "a", "b"], "left_semi").select(by).distinct()


def _taken(facts: DataFrame, what: str) -> list:
    rows = facts.limit(MAX_NAMES + 1).collect()
    if len(rows) > MAX_NAMES:
        raise ContractError(f"more than {MAX_NAMES} distinct {what}: no contract holds such a corpus", "infer/too-free")
    return rows


def _schema(f: Any, relax: bool) -> dict:
    out: dict = {}
    some = f.present - f.nulls
    value = json.loads(f.first_value)
    if some and f.distinct_values == 1 and f.files >= MIN_CONST_DOCS and some == f.files and not f.all_array and not f.all_object and len(str(value)) <= MAX_CONST:
        return {"const": value}
    if f.all_integer:
        out = {"type": "integer"}
    elif f.all_number:
        out = {"type": "number"}
    elif f.all_boolean:
        out = {"type": "boolean"}
    elif f.all_array:
        out = {"type": "array", "items": {"type": "string"}}
    elif f.all_object:
        out = {"type": "object", "properties": {}}
    elif f.all_string:
        form = next((x for x in FORMATS if f[f"is_{x}"]), None)
        if form:
            out = {"type": "string", "format": form}
        elif not relax and not f.nulls and f["values"] and f.distinct_values <= MAX_ENUM and 2 * f.distinct_values < f.files:
            return {"enum": [json.loads(v) for v in f["values"]]}
        else:
            out = {"type": "string"}
    if out and f.nulls:
        out["type"] = [out["type"], "null"]
    return out or {"type": "string"}


def _order(names: list[str], before: set[tuple[str, str]]) -> list[str]:
    """Names so that none stands before one that precedes it; what lies on a cycle keeps its order of appearance."""
    left, out = list(names), []
    while left:
        free = next((n for n in left if not any((m, n) in before for m in left if m != n)), None)
        if free is None:
            return out + left
        out.append(free)
        left.remove(free)
    return out


def _group(depth: int | None) -> Column:
    return F.lit("") if depth is None else F.coalesce(ancestor_at(F.col("path"), depth), F.when(depth_of(F.col("path")) == 0, F.lit("")))


def stranded(files: DataFrame, depth: int) -> DataFrame:
    """Markdown files that ``infer`` leaves out, for they lie in folders above ``depth``: a warning for each."""
    left = files.where(F.col("path").endswith(".md") & _group(depth).isNull())
    return left.select("path", F.lit("infer/stranded").alias("id"), F.concat(F.lit("it lies above depth "), F.lit(str(depth))).alias("message"))


def alias_merges(sections: DataFrame, by: str = "grp") -> DataFrame:
    """Headings of one group that share a key, and so become one section with aliases: a warning for each key."""
    from folioscope.functions.columns import camel_key as key_of

    heads = section_facts(sections, by).withColumn("key", key_of(F.col("name"))).where("key <> ''")
    return heads.groupBy(by, "key").agg(F.array_sort(F.collect_set("name")).alias("names")).where(F.size("names") > 1)


def infer(files: DataFrame, depth: int | None = None, relax: bool = False) -> dict[str, dict]:
    """A contract, as plain data, for each group of (path, source): by folder at ``depth``, or one for all ("")."""
    docs = files.where(F.col("path").endswith(".md")).withColumn("grp", _group(depth)).where("grp IS NOT NULL").withColumnRenamed("path", "doc_id")
    p = project(docs.select("doc_id", "source"), tables=("sections", "frontmatter_kv")).persist()
    try:
        groups = docs.select("doc_id", "grp")
        sections = open_table(p, "sections").join(groups, "doc_id")
        fields = _taken(field_facts(open_table(p, "frontmatter_kv").join(groups, "doc_id"), groups), "frontmatter keys")
        heads = _taken(section_facts(sections), "headings")
        strict = {r.grp: r.sequences == 1 for r in sequences(open_table(p, "sections"), groups).collect()}
        counts = {r.grp: r.files for r in groups.groupBy("grp").agg(F.count("*").alias("files")).collect()}
        pairs = precedence(sections)
        conflicts = {r.grp for r in reversals(pairs).collect()}
        before = defaultdict(set)
        free = [g for g in counts if g not in conflicts]  # in the others headings keep their order of appearance
        for r in pairs.where(F.col("grp").isin(free)).collect() if free else ():
            before[r.grp].add((r.a, r.b))
    finally:
        p.unpersist()
    out = {}
    for g, n in sorted(counts.items()):
        own = sorted((f for f in fields if f.grp == g), key=lambda f: f["first"])
        contract: dict = {"mcVersion": 2, "kind": "contract"}
        if own:
            contract["frontmatter"] = {"type": "object", "required": [f.key for f in own if f.present == n], "properties": {f.key: _schema(f, relax) for f in own}} | ({} if relax else {"additionalProperties": False})
        mine = sorted((h for h in heads if h.grp == g), key=lambda h: h["first"])
        if mine:
            contract["body"] = _body(mine, n, before[g], g in conflicts, strict[g], relax)
        out[g] = contract
    return out


def _body(heads: list, n: int, before: set[tuple[str, str]], conflict: bool, strict: bool, relax: bool) -> dict:
    spelled: dict[str, list] = {}
    for h in heads:
        spelled.setdefault(camel_key(h.name) or h.name, []).append(h)
    order = "none" if relax or conflict else "strict" if strict and not any(h.repeats for h in heads) else "recognized-relative"
    names = [h.name for h in heads]
    nodes = []
    for name in names if conflict else _order(names, before):
        group = next(v for v in spelled.values() if v[0].name == name or any(h.name == name for h in v))
        if group[0].name != name:
            continue
        together = sum(h.present for h in group)
        if len(group) > 1 and together > n:
            raise ContractError(f"{' and '.join(h.name for h in group)} share a key and stand in one document", "contract/key-collision")
        node: dict = {"section": name} | ({"aliases": [h.name for h in group[1:]]} if len(group) > 1 else {})
        if any(h.repeats for h in group):
            node["minContains"] = 1 if together >= n else 0  # without a most, it repeats
        elif together < n:
            node |= {"minContains": 0, "maxContains": 1}
        nodes.append(node)
    return {"order": order, "additionalSections": bool(relax), "sections": nodes}


def name_for(folder: str) -> str:
    return slug(folder) or "root"


def as_config(contracts: dict[str, dict]) -> str:
    """The inferred contracts as one configuration, first folder first."""
    rules = [{"include": f"{g}/**/*.md" if g else "**/*.md", "contract": name_for(g), "name": name_for(g)} for g in sorted(contracts, key=lambda g: g == "")]
    bare = {name_for(g): {k: v for k, v in x.items() if k not in ("mcVersion", "kind")} for g, x in contracts.items()}
    return yaml.safe_dump({"mcVersion": 2, "kind": "config", "contracts": bare, "rules": rules}, sort_keys=False, allow_unicode=True)


def load_inferred(contracts: dict[str, dict]) -> CorpusConfig:
    return ddl.load_config(as_config(contracts))


def check(files: DataFrame, config: CorpusConfig) -> DataFrame:
    """Error findings of a corpus under a configuration: none for the one inferred from it."""
    from .validate import validate_corpus

    return validate_corpus(files, config).findings.where("level = 'error'")
