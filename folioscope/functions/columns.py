"""Column functions: all built-in expressions, so they stay within generated code and reach the scans."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import formats
from .names import WS, needle_regex


def camel_key(name: Column) -> Column:
    parts = F.filter(F.split(name, r"[^\p{L}\p{N}]+"), lambda w: w != "")
    capital = F.transform(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 2**31 - 1))))
    return F.concat(F.coalesce(F.lower(F.get(parts, F.lit(0))), F.lit("")), F.array_join(capital, ""))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def word_count(text: Column) -> Column:
    """Runs of characters other than white space."""
    return F.when(text.isNull(), F.lit(0)).otherwise(F.size(F.filter(F.split(text, f"{WS}+"), lambda w: w != ""))).cast("long")


def text_count(text: Column, spec) -> Column:
    """Occurrences of a text rule's needle, none of which overlap; an empty needle has none."""
    pattern = needle_regex(spec)
    if not pattern:
        return F.lit(0).cast("long")
    return F.coalesce(F.regexp_count(text, F.lit(f"(?iu){pattern}" if spec.ignore_case else pattern)), F.lit(0)).cast("long")


def first_hit(text: Column, spec) -> Column:
    """Line and column of the first occurrence; null if there is none."""
    pattern = needle_regex(spec)
    at = F.regexp_instr(text, F.lit(f"(?iu){pattern}" if spec.ignore_case else pattern))
    before = F.substring(text, F.lit(1), at - 1)
    line = F.regexp_count(before, F.lit("\n")) + 1
    return F.when(at > 0, F.struct(line.cast("int").alias("line"), (F.char_length(F.substring_index(before, "\n", -1)) + 1).cast("int").alias("col")))


def line_hits(text: Column, spec) -> Column:
    """Line of each line with an occurrence, and their number on it, for needles without a line feed."""
    lines = F.transform(F.split(text, "\n", -1), lambda x, k: F.struct((k + 1).alias("line"), text_count(x, spec).alias("n")))
    return F.filter(lines, lambda x: x.n > 0)


def matches_format(text: Column, name: str) -> Column:
    """Whether a text has a format; those in ``formats.CODED`` need ``schema.passes`` instead."""
    return text.rlike(formats.java_pattern(name))


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def glob_regex(glob: str) -> str:
    """``*`` and ``?`` stay within a segment, ``**/`` is any number of folders, braces and classes are alternatives."""
    out, k = "", 0
    depth = 0
    while k < len(glob):
        ch = glob[k]
        if glob.startswith("**/", k) and (k == 0 or glob[k - 1] == "/"):
            out += "(?:[^/]+/)*"
            k += 3
            continue
        if glob.startswith("**", k):
            out += ".*"
            k += 2
            continue
        if ch == "*":
            out += "[^/]*"
        elif ch == "?":
            out += "[^/]"
        elif ch == "[" and "]" in glob[k + 2 :]:
            end = glob.index("]", k + 2)
            body = glob[k + 1 : end]
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]"
            k = end
        elif ch == "{" and "}" in glob[k:]:
            out += "(?:"
            depth += 1
        elif ch == "," and depth:
            out += "|"
        elif ch == "}" and depth:
            out += ")"
            depth -= 1
        else:
            out += re.escape(ch)
        k += 1
    return rf"\A(?:{out})\z"


def any_glob(path: Column, globs: tuple[str, ...] | list[str]) -> Column:
    return F.lit(False) if not globs else path.rlike("|".join(glob_regex(g) for g in globs))


def depth_of(path: Column) -> Column:
    """Folders above a file."""
    return F.size(F.split(path, "/")) - 1


def dir_of(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def ancestor_at(path: Column, depth: int) -> Column:
    """The folder that stands ``depth`` levels below the root; null for files above it."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > depth, F.array_join(F.slice(parts, 1, depth), "/"))


def join_path(root: Column, path: Column) -> Column:
    return F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"), F.regexp_replace(path, "^/+", ""))


def plural(count: Column, one: str, many: str | None = None) -> Column:
    return F.concat(count.cast("string"), F.lit(" "), F.when(count == 1, one).otherwise(many or one + "s"))


def unwrap(text: Column) -> Column:
    return F.regexp_replace(text, "[ \\t]*\\n[ \\t]*", " ")


def trailing_anchor(text: Column) -> Column:
    last = F.substring_index(F.regexp_replace(text, f"{WS}+$", ""), "\n", -1)
    return F.nullif(F.regexp_extract(last, r"(?:^|\s)\^([A-Za-z0-9_-]+)$", 1), F.lit(""))


def standalone_anchor(text: Column) -> Column:
    return F.nullif(F.regexp_extract(F.trim(text), r"\A\^([A-Za-z0-9_-]+)\z", 1), F.lit(""))


def references(text: Column) -> Column:
    """Links ``[[target#fragment|alias]]`` of a text, transcluded ones with ``!``."""
    raw = F.regexp_extract_all(text, F.lit(r"!?\\?\[\\?\[[^\[\]\n]+?\\?\]\\?\]"), F.lit(0))

    def split(x: Column) -> Column:
        inner = F.regexp_replace(F.regexp_replace(x, r"^!?\\?\[\\?\[|\\?\]\\?\]$", ""), r"\\\|", "|")
        target = F.substring_index(inner, "|", 1)
        return F.struct(
            F.when(x.startswith("!"), "transclusion").otherwise("link").alias("kind"), F.trim(F.substring_index(target, "#", 1)).alias("target"),
            F.nullif(F.trim(F.when(F.instr(target, "#") > 0, F.substring(target, F.instr(target, "#") + 1, F.lit(2**31 - 1)))), F.lit("")).alias("fragment"),
            F.nullif(F.trim(F.when(F.instr(inner, "|") > 0, F.substring(inner, F.instr(inner, "|") + 1, F.lit(2**31 - 1)))), F.lit("")).alias("alias"), x.alias("raw"))

    return F.transform(raw, split)


def table_cells(line: Column) -> Column:
    """Cells of a table line as written, split at every bar."""
    body = F.regexp_replace(F.trim(line), r"^\||\|$", "")
    return F.transform(F.split(body, r"\|", -1), lambda c: F.trim(c))


def pad(cells: Column, width: Column | int) -> Column:
    width = F.lit(width) if isinstance(width, int) else width
    return F.concat(cells, F.array_repeat(F.lit(""), F.greatest(width - F.size(cells), F.lit(0))))


def relevant_change(path: Column) -> Column:
    """Whether a changed file may matter: Markdown or YAML outside hidden folders and node_modules; unknown paths do."""
    hidden = F.exists(F.split(path, "/"), lambda s: s.startswith(".") | (s == "node_modules"))
    return F.coalesce(path.rlike(r"(?i)\.(md|ya?ml)\z") & ~hidden, F.lit(True))


def plane_rank(finding_id: Column) -> Column:
    area = F.substring_index(finding_id, "/", 1)
    return F.when(area == "frontmatter", 0).when(area == "structure", 1).when(area == "content", 2).when(area == "text", 3).otherwise(4)


def sarif_level(level: Column) -> Column:
    return F.when(level == "error", "error").when(level == "warn", "warning").otherwise("note")


def in_area(finding_id: Column, area: str) -> Column:
    return (finding_id == area) | finding_id.startswith(f"{area}/")


def drift_kind(finding_id: Column) -> Column:
    """What kind of drift an error finding shows, by the first keyword that its id holds."""
    low = F.lower(finding_id)
    section = low.contains("section")
    return (F.when(low.contains("order"), "order-changed")
            .when(low.rlike("unknown|unexpected|extra"), F.when(section, "section-added").otherwise("field-added"))
            .when(low.rlike("missing|absent|required"), F.when(section, "section-removed").otherwise("field-removed")).otherwise("field-changed"))


def json_path(parts: Column) -> Column:
    """``a.b[0]`` from path parts, whole numbers being indexes."""
    return F.aggregate(parts, F.lit(""), lambda acc, p: F.when(p.rlike(r"\A[0-9]+\z"), F.concat(acc, F.lit("["), p, F.lit("]"))).when(acc == "", p).otherwise(F.concat(acc, F.lit("."), p)))
