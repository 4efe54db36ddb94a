"""Contracts as plain values: what a document must hold.  Built on the driver, sent to the tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from typing import Any

from folioscope.functions.names import camel_key, text_rule_id


class ContractError(ValueError):
    """A contract that cannot hold, or findings that bar a strict read."""

    def __init__(self, message: str, code: str | None = None, findings: list | None = None):
        super().__init__(message)
        self.code, self.findings = code, findings or []


# ---- schemas -------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Schema:
    """A node of the schema language: a typed value, an enum or a constant."""

    type: str | None = None
    nullable: bool = False
    enum: tuple[str, ...] | None = None
    const: Any = None
    has_const: bool = False
    min_length: int | None = None
    max_length: int | None = None
    pattern: str | None = None
    format: str | None = None
    minimum: float | None = None
    maximum: float | None = None
    items: Schema | None = None
    min_items: int | None = None
    max_items: int | None = None
    properties: tuple[tuple[str, Schema], ...] = ()
    required: frozenset[str] = frozenset()
    open: bool = True
    has_default: bool = False
    default: Any = None
    description: str | None = None
    refine: Callable[[Any], bool] | None = None
    transform: Callable[[Any], Any] | None = None


# ---- text rules ----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class TextSpec:
    """A phrase or regular expression, and how often it may stand in a scope."""

    kind: str  # requires, forbids
    pattern: str | None = None
    regex: str | None = None
    normalize: bool = True
    ignore_case: bool = False
    min: int | None = None
    max: int | None = None
    id: str | None = None
    note: str | None = None
    level: str | None = None

    def __post_init__(self):
        if (self.pattern is None) == (self.regex is None):
            raise ContractError("a text rule has either a pattern or a regex", "contract/text")
        if self.max is not None:
            floor = max(self.min if self.min is not None else 1, 1) if self.kind == "requires" else self.min or 0
            if self.max < floor:
                raise ContractError(f"a count of {floor} or more and {self.max} or fewer cannot be met", "contract/text")

    def finding_id(self, kind: str, scope: str) -> str:
        return self.id or text_rule_id(kind, scope, self)

    @property
    def matcher(self) -> tuple:
        needle = self.regex if self.regex is not None else " ".join(self.pattern.split()) if self.normalize else self.pattern
        return self.regex is not None, needle, self.ignore_case, self.normalize or self.regex is not None


def requires(pattern: str | None = None, **options: Any) -> TextSpec:
    return TextSpec("requires", pattern, **options)


def forbids(pattern: str | None = None, **options: Any) -> TextSpec:
    return TextSpec("forbids", pattern, **options)


def check_text(specs: Iterable[TextSpec]) -> tuple[TextSpec, ...]:
    """Rejects a matcher that stands twice in one list, or is both required and forbidden as a literal."""
    specs, seen = tuple(specs), {}
    for spec in specs:
        if (spec.kind, spec.matcher) in seen:
            raise ContractError(f"the same text rule stands twice: {spec.pattern or spec.regex}", "contract/text")
        seen[spec.kind, spec.matcher] = spec
    for (kind, matcher), spec in seen.items():
        other = seen.get(("forbids", matcher))
        if kind == "requires" and other is not None and spec.pattern is not None and not other.max:
            raise ContractError(f"a text is both required and forbidden: {spec.pattern}", "contract/text")
    return specs


# ---- content -------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Table:
    columns: tuple[str, ...]
    min_rows: int | None = None
    cells: tuple[tuple[str, Schema], ...] = ()
    extra_columns: str = "allow"
    anchor: str | None = None
    description: str | None = None
    kind: str = "table"


@dataclass(frozen=True)
class List:
    items: str | Schema | None = None  # "checkbox", a schema, or nothing
    min_items: int | None = None
    ordered: bool | None = None  # declared only; no operator looks at it
    description: str | None = None
    kind: str = "list"


@dataclass(frozen=True)
class Code:
    lang: str | None = None
    description: str | None = None
    kind: str = "code"


@dataclass(frozen=True)
class MaxWords:
    limit: int
    description: str | None = None
    kind: str = "paragraph"


Leaf = Table | List | Code | MaxWords


def table(columns: Iterable[str], min_rows: int | None = None, cells: dict[str, Schema] | None = None, extra_columns: str = "allow", anchor: str | None = None, description: str | None = None) -> Table:
    return Table(tuple(columns), min_rows, tuple((cells or {}).items()), extra_columns, anchor, description)


# ---- structure -----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """A rule of one's own: ``check`` gets a section (or the document) and yields (message, level, line) or a message."""

    id: str
    check: Callable[..., Iterable]


@dataclass(frozen=True)
class Slot:
    """A place of a level that sections of certain names fill."""

    names: tuple[str, ...]
    optional: bool = False
    repeatable: bool = False
    min: int | None = None
    max: int | None = None
    anchor: str | None = None
    content: Leaf | tuple[tuple[str, Leaf], ...] | None = None
    children: Level | None = None
    rules: tuple[Rule, ...] = ()
    text: tuple[TextSpec, ...] = ()
    description: str | None = None

    def __post_init__(self):
        if self.min is not None or self.max is not None:
            if not self.repeatable:
                raise ContractError(f"{self.names[0]}: bounds need a repeatable section", "contract/repeat-bounds")
            if any(x is not None and (not isinstance(x, int) or isinstance(x, bool) or x < 0) for x in (self.min, self.max)):
                raise ContractError(f"{self.names[0]}: bounds are whole numbers from 0", "contract/repeat-bounds")
            if self.min is not None and self.max is not None and self.min > self.max:
                raise ContractError(f"{self.names[0]}: the least is above the most", "contract/repeat-bounds")
        check_text(self.text)


@dataclass(frozen=True)
class Gap:
    min: int | None = None
    max: int | None = None


@dataclass(frozen=True)
class Level:
    specs: tuple[Slot | Gap, ...] = ()
    order: str = "none"  # none, recognized-relative, strict
    allow_unknown: bool = True
    description: str | None = None

    def __post_init__(self):
        seen: dict[str, str] = {}
        for slot in self.slots:
            key = camel_key(slot.names[0])
            if key and seen.setdefault(key, slot.names[0]) != slot.names[0]:
                raise ContractError(f"{slot.names[0]} and {seen[key]} share the key {key}", "contract/key-collision")

    @property
    def slots(self) -> list[Slot]:
        return [x for x in self.specs if isinstance(x, Slot)]

    def slot_of(self, name: str) -> int | None:
        """Index in specs of the first slot that takes the name."""
        return next((k for k, x in enumerate(self.specs) if isinstance(x, Slot) and name in x.names), None)


@dataclass(frozen=True)
class Contract:
    frontmatter: Schema | None = None
    body: Level | None = None
    rules: tuple[Rule, ...] = ()
    text: tuple[TextSpec, ...] = ()
    description: str | None = None
    name: str | None = None

    def __post_init__(self):
        check_text(self.text)


def section(names: str | Iterable[str], **options: Any) -> Slot:
    return Slot((names,) if isinstance(names, str) else tuple(names), **options)


def optional(slot: Slot) -> Slot:
    return replace(slot, optional=True)


def optional_section(names: str | Iterable[str], **options: Any) -> Slot:
    return optional(section(names, **options))


def one_of(names: Iterable[str], **options: Any) -> Slot:
    return Slot(tuple(names), **options)


def gap(min: int | None = None, max: int | None = None) -> Gap:  # noqa: A002
    return Gap(min, max)


def sections(specs: Iterable[Slot | Gap], order: str = "none", allow_unknown: bool = True, description: str | None = None) -> Level:
    return Level(tuple(specs), order, allow_unknown, description)


def contract(frontmatter: Schema | None = None, body: Level | None = None, rules: Iterable[Rule] = (), text: Iterable[TextSpec] = (), description: str | None = None, name: str | None = None) -> Contract:
    return Contract(frontmatter, body, tuple(rules), tuple(text), description, name)


def rule(id: str, check: Callable[..., Iterable]) -> Rule:  # noqa: A002
    return Rule(id, check)


doc_rule = rule

#: Presets: options of a level.
LENIENT = {"order": "none", "allow_unknown": True}
STRICT = {"order": "strict", "allow_unknown": False}


def lenient_body(*specs: Slot | Gap) -> Level:
    return Level(specs, **LENIENT)


def strict_body(*specs: Slot | Gap) -> Level:
    return Level(specs, **STRICT)


@dataclass(frozen=True)
class Route:
    """Files that a contract holds for."""

    include: tuple[str, ...]
    contract: Contract
    exclude: tuple[str, ...] = ()
    name: str | None = None


@dataclass(frozen=True)
class CorpusConfig:
    routes: tuple[Route, ...] = field(default=())
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
