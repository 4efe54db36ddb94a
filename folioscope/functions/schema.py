"""Values against schemas: one issue for each thing that is wrong, in the schema's order."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import Any

from folioscope.plans.grammar import Schema

from .formats import matches
from .names import translate, utf16

MISSING = object()
SAFE = 2**53 - 1


@dataclass(frozen=True)
class Issue:
    code: str  # type, required, value, bound, unknown, refine
    path: tuple
    text: str
    hint: str | None = None


def type_name(value: Any) -> str:
    if value is MISSING:
        return "undefined"
    if value is None:
        return "null"
    return {bool: "boolean", str: "string", list: "array", dict: "object"}.get(type(value), "number")


@lru_cache(maxsize=512)
def _compiled(pattern: str) -> re.Pattern:
    return re.compile(translate(pattern))


def _number(value: Any) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(value)


def check(s: Schema, value: Any, path: tuple = (), hint: str | None = None) -> Iterator[Issue]:
    hint = s.description or hint
    if value is MISSING and s.has_default or value is None and s.nullable:
        return
    if s.enum is not None or s.has_const:
        known = s.enum if s.enum is not None else (s.const,)
        same = any(type_name(value) == type_name(k) and value == k for k in known)
        if not same:
            yield Issue("value", path, f"expected {' | '.join(repr(k) for k in known)}", hint)
            return
    elif s.type is not None:
        good = {"string": isinstance(value, str), "boolean": isinstance(value, bool), "array": isinstance(value, list), "object": isinstance(value, dict), "number": _number(value)}.get(s.type, False)
        if s.type == "integer":
            good = _number(value) and float(value).is_integer() and abs(value) <= SAFE
        if not good:
            wanted = "int" if s.type == "integer" and _number(value) else s.type
            yield Issue("required" if value is MISSING else "type", path, f"expected {wanted}, received {type_name(value)}", hint)
            return
        yield from {"string": _string, "number": _bounds, "integer": _bounds, "array": _array, "object": _object}.get(s.type, lambda *_: iter(()))(s, value, path, hint)
    if s.refine is not None and not s.refine(value):
        yield Issue("refine", path, "a rule of the contract does not hold", hint)


def _string(s: Schema, value: str, path: tuple, hint: str | None) -> Iterator[Issue]:
    if s.format is not None and not matches(s.format, value):
        yield Issue("bound", path, f"not a valid {s.format}", hint)
    if s.min_length is not None and utf16(value) < s.min_length:
        yield Issue("bound", path, f"shorter than {s.min_length} characters", hint)
    if s.max_length is not None and utf16(value) > s.max_length:
        yield Issue("bound", path, f"longer than {s.max_length} characters", hint)
    if s.pattern is not None and not _compiled(s.pattern).search(value):
        yield Issue("bound", path, f"does not match /{s.pattern}/", hint)


def _bounds(s: Schema, value: float, path: tuple, hint: str | None) -> Iterator[Issue]:
    if s.minimum is not None and value < s.minimum:
        yield Issue("bound", path, f"less than {s.minimum}", hint)
    if s.maximum is not None and value > s.maximum:
        yield Issue("bound", path, f"more than {s.maximum}", hint)


def _array(s: Schema, value: list, path: tuple, hint: str | None) -> Iterator[Issue]:
    if s.min_items is not None and len(value) < s.min_items:
        yield Issue("bound", path, f"fewer than {s.min_items} items", hint)
    if s.max_items is not None and len(value) > s.max_items:
        yield Issue("bound", path, f"more than {s.max_items} items", hint)
    if s.items is not None:
        for k, x in enumerate(value):
            yield from check(s.items, x, (*path, k), hint)


def _object(s: Schema, value: dict, path: tuple, hint: str | None) -> Iterator[Issue]:
    known = dict(s.properties)
    for name, inner in s.properties:
        x = value.get(name, MISSING)
        if x is MISSING and name not in s.required:
            continue
        yield from check(inner, x, (*path, name), hint)
    if not s.open:
        for name in value:
            if name not in known:
                yield Issue("unknown", (*path, name), f"unknown key {name!r}", hint)


def passes(s: Schema, value: Any) -> bool:
    return next(check(s, value), None) is None


def path_text(path: tuple) -> str:
    out = ""
    for p in path:
        out += f"[{p}]" if isinstance(p, int) else f".{p}" if out else p
    return out
