"""Contracts and corpus configurations from YAML: an envelope of version 2 and closed keys."""

from __future__ import annotations

import runpy
from pathlib import Path
from typing import Any

import yaml

from folioscope.functions import formats
from folioscope.functions.names import did_you_mean
from folioscope.sources.yaml12 import load

from . import grammar as g


class DeclarativeError(g.ContractError):
    """A YAML contract or configuration that says something that is not in the language."""


#: The keys of each node.
LEVEL = ["order", "additionalSections", "sections", "description", "requires", "forbids"]
SECTION = ["section", "aliases", "anchor", "content", "requires", "forbids", "description", "minContains", "maxContains", "sections", "order", "additionalSections"]
ONE_OF = ["oneOf", *[k for k in SECTION if k not in ("section", "aliases")]]
TABLE = ["columns", "anchor", "minRows", "cells", "extraColumns", "description"]
LIST = ["items", "minItems", "ordered", "description"]
CODE = ["lang", "description"]
TEXT = ["pattern", "regex", "normalize", "ignoreCase", "min", "max", "id", "note", "level"]
TYPES = ["string", "number", "integer", "boolean", "array", "object"]
BY_TYPE = {"string": ["minLength", "maxLength", "pattern", "format"], "number": ["minimum", "maximum"], "integer": ["minimum", "maximum"], "boolean": [], "array": ["items", "minItems", "maxItems"], "object": ["properties", "required", "additionalProperties"]}
SCHEMA = ["type", "enum", "const", "default", "description"]
#: Spellings of version 1 and what stands for them now.
OLD = {"optional": "minContains: 0", "repeatable": "minContains or maxContains", "min": "minContains", "max": "maxContains", "children": "sections on the node", "allowUnknown": "additionalSections", "everyItem": "items"}


def _map(x: Any, path: str) -> dict:
    if not isinstance(x, dict):
        raise DeclarativeError(f"{path}: a mapping is expected")
    return x


def _closed(x: dict, known: list[str], path: str) -> None:
    for key in x:
        if key not in known:
            if key in OLD and known not in (TEXT,):
                raise DeclarativeError(f"{path}: {key!r} is a spelling of version 1; version 2 has {OLD[key]}")
            near = did_you_mean(key, known)
            raise DeclarativeError(f"{path}: unknown key {key!r}" + (f"; did you mean {near!r}?" if near else ""))


def _is(x: dict, key: str, kind: type | tuple, path: str, word: str, default: Any = None) -> Any:
    if key not in x:
        return default
    value = x[key]
    if not isinstance(value, kind) or isinstance(value, bool) and kind is not bool:
        raise DeclarativeError(f"{path}.{key}: {word} is expected")
    return value


def _count(x: dict, key: str, path: str) -> int | None:
    value = _is(x, key, int, path, "a whole number")
    if value is not None and value < 0:
        raise DeclarativeError(f"{path}.{key}: a whole number from 0 is expected")
    return value


def _names(x: dict, key: str, path: str) -> tuple[str, ...]:
    value = _is(x, key, list, path, "a list of texts", [])
    if not all(isinstance(v, str) for v in value):
        raise DeclarativeError(f"{path}.{key}: a list of texts is expected")
    return tuple(value)


def _guard(make, path: str):
    try:
        return make()
    except DeclarativeError:
        raise
    except g.ContractError as e:
        raise DeclarativeError(f"{path}: {e}", e.code) from e


def envelope(text: str, kind: str) -> dict:
    try:
        x = load(text)
    except yaml.YAMLError as e:
        raise DeclarativeError(f"not YAML: {e}") from e
    x = _map(x, "document")
    if x.get("mcVersion") != 2:
        raise DeclarativeError("mcVersion: version 2 is expected" + ("; version 1 has to be migrated" if x.get("mcVersion") == 1 else ""))
    if x.get("kind") != kind:
        raise DeclarativeError(f"kind: {kind!r} is expected")
    return x


def load_contract(text: str, name: str | None = None) -> g.Contract:
    return compile_contract(envelope(text, "contract"), name)


def load_contract_file(path: str) -> g.Contract:
    return load_contract(Path(path).read_text(encoding="utf-8"), path)


def compile_contract(x: dict, name: str | None = None) -> g.Contract:
    _closed(x, ["mcVersion", "kind", "frontmatter", "body", "description"], "contract")
    front = compile_schema(x["frontmatter"], "frontmatter") if "frontmatter" in x else None
    if front is not None and front.type != "object":
        raise DeclarativeError("frontmatter: a schema of type object is expected")
    body, text = None, ()
    if "body" in x:
        node = _map(x["body"], "body")
        _closed(node, LEVEL, "body")
        body = _level(node, "body")
        text = _texts(node, "body")
    return _guard(lambda: g.Contract(front, body, (), text, _is(x, "description", str, "contract", "a text"), name), "contract")


def _level(x: dict, path: str) -> g.Level:
    order = _is(x, "order", str, path, "an order", "none")
    if order not in ("none", "recognized-relative", "strict"):
        raise DeclarativeError(f"{path}.order: none, recognized-relative or strict is expected")
    nodes = _is(x, "sections", list, path, "a list", [])
    if "sections" not in x and not ("requires" in x or "forbids" in x):
        raise DeclarativeError(f"{path}.sections: a list is expected")
    specs = tuple(_node(_map(n, f"{path}.sections[{k}]"), f"{path}.sections[{k}]") for k, n in enumerate(nodes))
    return _guard(lambda: g.Level(specs, order, _is(x, "additionalSections", bool, path, "true or false", True), _is(x, "description", str, path, "a text")), path)


def _node(x: dict, path: str) -> g.Slot | g.Gap:
    kinds = [k for k in ("section", "oneOf", "gap") if k in x]
    if len(kinds) != 1:
        raise DeclarativeError(f"{path}: one of section, oneOf and gap is expected")
    if kinds[0] == "gap":
        _closed(x, ["gap"], path)
        bounds = _map({} if x["gap"] is None else x["gap"], f"{path}.gap")
        for key in bounds:
            if key not in ("min", "max"):
                raise DeclarativeError(f"{path}.gap: unknown key {key!r}")
        least, most = _count(bounds, "min", path), _count(bounds, "max", path)
        if least is not None and most is not None and least > most:
            raise DeclarativeError(f"{path}.gap: the least is above the most")
        return g.Gap(least, most)
    if kinds[0] == "section":
        _closed(x, SECTION, path)
        names = (_is(x, "section", str, path, "a text"), *_names(x, "aliases", path))
    else:
        _closed(x, ONE_OF, path)
        names = _names(x, "oneOf", path)
        if not names:
            raise DeclarativeError(f"{path}.oneOf: names are expected")
    options: dict[str, Any] = {"anchor": _is(x, "anchor", str, path, "a text"), "description": _is(x, "description", str, path, "a text"), "text": _texts(x, path)}
    if "content" in x:
        options["content"] = _content(_map(x["content"], f"{path}.content"), f"{path}.content")
    if "sections" in x:
        options["children"] = _level({k: x[k] for k in ("sections", "order", "additionalSections") if k in x}, path)
    elif "order" in x or "additionalSections" in x:
        raise DeclarativeError(f"{path}: order and additionalSections need sections")
    if "minContains" in x or "maxContains" in x:
        least = _count(x, "minContains", path) if "minContains" in x else 1
        most = _count(x, "maxContains", path)
        if most is not None and (most < 1 or most < least):
            raise DeclarativeError(f"{path}.maxContains: {most} is too few")
        options["optional"] = least == 0
        if most != 1:
            options |= {"repeatable": True, "min": least if least >= 2 else None, "max": most}
    return _guard(lambda: g.Slot(names, **options), path)


def _texts(x: dict, path: str) -> tuple[g.TextSpec, ...]:
    out = []
    for kind in ("requires", "forbids"):
        for k, raw in enumerate(_is(x, kind, list, path, "a list", [])):
            at = f"{path}.{kind}[{k}]"
            raw = _map(raw, at)
            _closed(raw, TEXT, at)
            if ("pattern" in raw) == ("regex" in raw):
                raise DeclarativeError(f"{at}: either pattern or regex is expected")
            level = _is(raw, "level", str, at, "a level")
            if level not in (None, "error", "warn"):
                raise DeclarativeError(f"{at}.level: error or warn is expected")
            options = {"pattern": _is(raw, "pattern", str, at, "a text"), "regex": _is(raw, "regex", str, at, "a text"), "normalize": _is(raw, "normalize", bool, at, "true or false", True),
                       "ignore_case": _is(raw, "ignoreCase", bool, at, "true or false", False), "min": _is(raw, "min", int, at, "a number"), "max": _is(raw, "max", int, at, "a number"),
                       "id": _is(raw, "id", str, at, "a text"), "note": _is(raw, "note", str, at, "a text"), "level": level}
            out.append(_guard(lambda: g.TextSpec(kind, **options), at))  # noqa: B023
    return _guard(lambda: g.check_text(out), path)


def _content(x: dict, path: str):
    leaf = [k for k in x if k in ("table", "list", "code", "maxWords")]
    if len(leaf) == 1 and len(x) == 1:
        return _leaf(leaf[0], x[leaf[0]], path)
    if leaf:
        raise DeclarativeError(f"{path}: one kind of content is expected")
    out = []
    for name, inner in x.items():
        inner = _map(inner, f"{path}.{name}")
        if len(inner) != 1 or next(iter(inner)) not in ("table", "list", "code", "maxWords"):
            raise DeclarativeError(f"{path}.{name}: table, list, code or maxWords is expected")
        kind = next(iter(inner))
        out.append((name, _leaf(kind, inner[kind], f"{path}.{name}")))
    return tuple(out)


def _leaf(kind: str, x: Any, path: str) -> g.Leaf:
    path = f"{path}.{kind}"
    if kind == "maxWords":
        if not isinstance(x, int) or isinstance(x, bool) or x < 0:
            raise DeclarativeError(f"{path}: a whole number from 0 is expected")
        return g.MaxWords(x)
    x = _map({} if x is None else x, path)
    _closed(x, {"table": TABLE, "list": LIST, "code": CODE}[kind], path)
    description = _is(x, "description", str, path, "a text")
    if kind == "table":
        columns = _names(x, "columns", path)
        cells = tuple((c, compile_schema(s, f"{path}.cells.{c}")) for c, s in _map(x.get("cells", {}), f"{path}.cells").items())
        extra = _is(x, "extraColumns", str, path, "allow or error", "allow")
        if extra not in ("allow", "error"):
            raise DeclarativeError(f"{path}.extraColumns: allow or error is expected")
        return g.Table(columns, _count(x, "minRows", path), cells, extra, _is(x, "anchor", str, path, "a text"), description)
    if kind == "list":
        items = x.get("items")
        if items is not None and items != "checkbox":
            items = compile_schema(items, f"{path}.items")
        return g.List(items, _count(x, "minItems", path), _is(x, "ordered", bool, path, "true or false"), description)
    return g.Code(_is(x, "lang", str, path, "a text"), description)


def compile_schema(x: Any, path: str) -> g.Schema:
    x = _map(x, path)
    kinds = [k for k in ("type", "enum", "const") if k in x]
    if len(kinds) != 1:
        raise DeclarativeError(f"{path}: one of type, enum and const is expected")
    common = {"description": _is(x, "description", str, path, "a text"), "has_default": "default" in x, "default": x.get("default")}
    if kinds[0] == "enum":
        _closed(x, ["enum", "default", "description"], path)
        values = x["enum"]
        if not isinstance(values, list) or not values or not all(isinstance(v, str) for v in values):
            raise DeclarativeError(f"{path}.enum: a list of texts is expected")
        return g.Schema(enum=tuple(values), **common)
    if kinds[0] == "const":
        _closed(x, ["const", "default", "description"], path)
        if not isinstance(x["const"], (str, int, float, bool)):
            raise DeclarativeError(f"{path}.const: a text, number or boolean is expected")
        return g.Schema(const=x["const"], has_const=True, **common)
    kind, nullable = x["type"], False
    if isinstance(kind, list):
        rest = [k for k in kind if k != "null"]
        if len(kind) != 2 or len(rest) != 1:
            raise DeclarativeError(f"{path}.type: a type, or a type and null, is expected")
        kind, nullable = rest[0], True
    if kind not in TYPES:
        near = did_you_mean(str(kind), TYPES)
        raise DeclarativeError(f"{path}.type: unknown type {kind!r}" + (f"; did you mean {near!r}?" if near else ""))
    _closed(x, [*SCHEMA, *BY_TYPE[kind]], path)
    o: dict[str, Any] = {"type": kind, "nullable": nullable, **common}
    if kind == "string":
        o |= {"min_length": _count(x, "minLength", path), "max_length": _count(x, "maxLength", path), "pattern": _is(x, "pattern", str, path, "a text"), "format": _is(x, "format", str, path, "a format")}
        if o["format"] is not None and o["format"] not in formats.NAMES:
            near = did_you_mean(o["format"], list(formats.NAMES))
            raise DeclarativeError(f"{path}.format: unknown format {o['format']!r}" + (f"; did you mean {near!r}?" if near else ""))
    elif kind in ("number", "integer"):
        o |= {"minimum": _is(x, "minimum", (int, float), path, "a number"), "maximum": _is(x, "maximum", (int, float), path, "a number")}
    elif kind == "array":
        if "items" not in x:
            raise DeclarativeError(f"{path}.items: a schema is expected")
        o |= {"items": compile_schema(x["items"], f"{path}.items"), "min_items": _count(x, "minItems", path), "max_items": _count(x, "maxItems", path)}
    elif kind == "object":
        if "properties" not in x:
            raise DeclarativeError(f"{path}.properties: a mapping is expected")
        inner = tuple((k, compile_schema(v, f"{path}.properties.{k}")) for k, v in _map(x["properties"], f"{path}.properties").items())
        needed = _names(x, "required", path)
        for k in needed:
            if k not in dict(inner):
                raise DeclarativeError(f"{path}.required: {k!r} is no property")
        o |= {"properties": inner, "required": frozenset(needed), "open": _is(x, "additionalProperties", bool, path, "true or false", True)}
    return g.Schema(**o)


#: Configuration files that are looked for, in this order.
CONFIG_NAMES = ["folioscope.config.py", "folioscope.config.yaml", "folioscope.config.yml", "folioscope.yaml", "folioscope.yml"]


def find_config(folder: str) -> g.CorpusConfig | None:
    """The first configuration that lies in a folder; a Python one defines ``config``."""
    for name in CONFIG_NAMES:
        path = Path(folder) / name
        if path.exists():
            return load_config_file(str(path))
    return None


def load_config_file(path: str) -> g.CorpusConfig:
    if path.endswith(".py"):
        config = runpy.run_path(path).get("config")
        if not isinstance(config, g.CorpusConfig):
            raise DeclarativeError(f"{path}: it defines no config")
        return config
    return load_config(Path(path).read_text(encoding="utf-8"), str(Path(path).parent))


def inline_config(contracts: list[str], paths: list[str] | None = None) -> g.CorpusConfig:
    """One contract for every Markdown file, or contract files paired with the globs that they hold for."""
    if not paths:
        if len(contracts) != 1:
            raise DeclarativeError("several contracts need a path each")
        paths = ["**/*.md"]
    if len(paths) != len(contracts):
        raise DeclarativeError("as many paths as contracts are expected")
    return g.CorpusConfig(tuple(g.Route((p,), load_contract_file(c), (), Path(c).name) for c, p in zip(contracts, paths, strict=True)))


def load_config(text: str, folder: str = ".") -> g.CorpusConfig:
    """Rules by name, by path or inline contract, first match first."""
    x = envelope(text, "config")
    _closed(x, ["mcVersion", "kind", "contracts", "rules", "include", "exclude", "description"], "config")
    named = {}
    for name, c in _map(x.get("contracts", {}), "contracts").items():
        named[name] = load_contract_file(str(Path(folder) / c)) if isinstance(c, str) else compile_contract(_map(c, f"contracts.{name}"), name)
    routes = []
    for k, r in enumerate(_is(x, "rules", list, "config", "a list", [])):
        path = f"rules[{k}]"
        r = _map(r, path)
        _closed(r, ["include", "exclude", "contract", "name"], path)
        c = r.get("contract")
        if isinstance(c, str):
            c = named[c] if c in named else load_contract_file(str(Path(folder) / c))
        else:
            c = compile_contract(_map(c, f"{path}.contract"))
        if not _globs(r, "include", path):
            raise DeclarativeError(f"{path}.include: globs are expected")
        own = r["contract"] if isinstance(r.get("contract"), str) else None  # a contract's name is its rule's
        routes.append(g.Route(_globs(r, "include", path), c, _globs(r, "exclude", path), _is(r, "name", str, path, "a text", own)))
    return g.CorpusConfig(tuple(routes), _globs(x, "include", "config"), _globs(x, "exclude", "config"))


def _globs(x: dict, key: str, path: str) -> tuple[str, ...]:
    return (x[key],) if isinstance(x.get(key), str) else _names(x, key, path)
