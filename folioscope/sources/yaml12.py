"""YAML with the 1.2 core schema: no timestamps, no octal by a leading zero, no yes and no; and the line of each key."""

from __future__ import annotations

import math
import re
from typing import Any

import yaml


_Base = getattr(yaml, "CSafeLoader", yaml.SafeLoader)


class CoreLoader(_Base):
    """Resolves null, booleans, integers and floats as the core schema does; all else is text."""


CoreLoader.yaml_implicit_resolvers = {}
_SCALARS = (
    ("null", r"^(?:null|Null|NULL|~|)$", ["n", "N", "~", ""]),
    ("bool", r"^(?:true|True|TRUE|false|False|FALSE)$", list("tTfF")),
    ("int", r"^(?:[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+)$", list("-+0123456789")),
    ("float", r"^(?:[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN))$", list("-+.0123456789")),
)
for _tag, _pattern, _first in _SCALARS:
    CoreLoader.add_implicit_resolver(f"tag:yaml.org,2002:{_tag}", re.compile(_pattern), _first)


def _integer(text: str) -> int:
    return int(text[2:], 8) if text.startswith("0o") else int(text[2:], 16) if text.startswith("0x") else int(text)


def _real(text: str) -> float:
    text = text.lower()
    return -math.inf if text == "-.inf" else math.inf if text.endswith(".inf") else math.nan if text == ".nan" else float(text)


CoreLoader.add_constructor("tag:yaml.org,2002:int", lambda loader, node: _integer(node.value))
CoreLoader.add_constructor("tag:yaml.org,2002:float", lambda loader, node: _real(node.value))
CoreLoader.add_constructor("tag:yaml.org,2002:bool", lambda loader, node: node.value.lower() == "true")


def _text_keys(value: Any) -> Any:
    if isinstance(value, dict):
        return {_key(k): _text_keys(v) for k, v in value.items()}
    return [_text_keys(v) for v in value] if isinstance(value, list) else value


def _key(k: Any) -> str:
    return {True: "true", False: "false", None: "null"}.get(k, str(k)) if isinstance(k, bool) or k is None else str(k)


def load(text: str) -> Any:
    """The value of a YAML text; YAMLError if it has none."""
    return _text_keys(yaml.load(text, CoreLoader))  # noqa: S506


#: Frontmatter of plain ``key: value`` lines, which needs no YAML parser.
_SIMPLE = re.compile(r"(?:[A-Za-z_][A-Za-z0-9_-]*:(?: +[A-Za-z0-9_./][A-Za-z0-9_ ./+()-]*)?\r?\n)*\Z")
_PLAIN = [(tag, re.compile(pattern)) for tag, pattern, _ in _SCALARS]


def _simple(text: str) -> tuple[dict, dict[tuple, int]] | None:
    data: dict[str, Any] = {}
    lines: dict[tuple, int] = {}
    for n, line in enumerate(text.splitlines(), 1):
        key, _, value = line.partition(":")
        value = value.strip()
        if key in data:
            return None
        tag = next((t for t, p in _PLAIN if p.match(value)), None)
        if tag == "null":
            data[key] = None
        elif tag == "bool":
            data[key] = value.lower() == "true"
        elif tag == "int":
            data[key] = _integer(value)
        elif tag == "float":
            data[key] = _real(value)
        else:
            data[key] = value
        lines[(key,)] = n
    return data, lines


def load_positioned(text: str) -> tuple[Any, dict[tuple, int]]:
    """The value, and the line, from 1, of each key and element by its path.  Text that is not YAML has no value."""
    if text and _SIMPLE.match(text) and (out := _simple(text)) is not None:
        return out
    try:
        loader = CoreLoader(text)
        node = loader.get_single_node()
        value = _text_keys(loader.construct_document(node)) if node is not None else None
    except (yaml.YAMLError, ValueError, TypeError):
        return None, {}
    lines: dict[tuple, int] = {}

    def walk(x: yaml.Node | None, path: tuple) -> None:
        if isinstance(x, yaml.MappingNode):
            for k, v in x.value:
                if isinstance(k, yaml.ScalarNode):
                    at = (*path, k.value)
                    lines[at] = k.start_mark.line + 1
                    walk(v, at)
        elif isinstance(x, yaml.SequenceNode):
            for k, v in enumerate(x.value):
                lines[*path, k] = v.start_mark.line + 1
                walk(v, (*path, k))

    walk(node, ())
    return value, lines
